"""The typed graph of impacts, needs, risks and responses, and its geographic aggregates (ON01 to ON08, AG16 to AG24, JN07, JN08, SL06 to SL09).

One DataFrame per kind of node; edges are equi-joins on lower-cased names. Figures are in long form, (node, figure_key, value).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import to_ymd
from tidemark.operators.classify import actor, all_impacts, hazard_category, is_risk, needs, risk_horizon, severity_to_phase, sub_hazards
from tidemark.operators.figures import figure_map


def annotate(evidence: DataFrame) -> DataFrame:
    """ON01: all labels of an evidence row in one pass; persist it and take one node table after another from it."""
    # The joined text stands behind a generator, so that the nine expressions that read it do not each make it anew.
    joined = evidence.select("*", F.explode(F.array(F.concat_ws(" ", "title", "summary", "text"))).alias("_all"))
    text = F.col("_all")
    return joined.withColumns({
        "impact_types": all_impacts(text), "need_types": needs(text), "risk": is_risk(text), "horizon": risk_horizon(text), "actor": actor(text), "sub_hazards": sub_hazards(text),
        "figures": figure_map(text), "severity_phase": severity_to_phase(F.col("severity")), "reported_date": to_ymd(F.col("published_at")),
    }).drop("_all")


def claims(annotated: DataFrame) -> DataFrame:
    """ON06: a claim for each row, 500 characters at most."""
    return annotated.select("event_id", F.substring(F.concat_ws(": ", "title", "summary"), 1, 500).alias("claim_text"), "url", "source_label", "connector", "published_at", "confidence")


def impacts(annotated: DataFrame, *keep: str) -> DataFrame:
    """ON02: an impact for each type, with any further columns; figures stand with the first one only, so that none is counted twice."""
    each = annotated.select("*", F.posexplode("impact_types").alias("pos", "impact_type"))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    return each.select(
        "event_id", "pos", "impact_type", "geo_area", "severity_phase", F.substring("summary", 1, 300).alias("description"), F.when(F.col("pos") == 0, F.col("figures")).otherwise(none).alias("figures"), "reported_date", "source_label", "connector", "url", *keep
    )


def need_statements(annotated: DataFrame, *keep: str) -> DataFrame:
    """ON01, ON06: a need for each type."""
    return annotated.select(*keep, "event_id", F.explode("need_types").alias("need_type"), "geo_area", "severity_phase", F.get("impact_types", 0).alias("indicates_impact"), F.substring("summary", 1, 200).alias("description"), "reported_date")


def risk_statements(annotated: DataFrame) -> DataFrame:
    """ON01, PR15."""
    return annotated.filter("risk").select("event_id", F.col("disaster_type").alias("hazard_name"), "geo_area", "horizon", F.substring("summary", 1, 200).alias("description"), "reported_date")


def responses(annotated: DataFrame) -> DataFrame:
    """ON01, ON07: the sector is the first need."""
    sector = F.coalesce(F.get("need_types", 0), F.lit(""))
    return annotated.filter("actor is not null").select("event_id", "actor.actor", "actor.actor_type", "geo_area", sector.alias("sector"), F.substring("summary", 1, 200).alias("description"))


def hazard_nodes(annotated: DataFrame, order: str) -> DataFrame:
    """ON04: a node for each hazard with its category and the sub-hazards of its first sighting."""
    return annotated.groupBy(F.lower("disaster_type").alias("hazard")).agg(F.min_by("sub_hazards", order).alias("sub_hazards")).withColumn("category", hazard_category(F.col("hazard")))


def geo_nodes(areas: DataFrame, order: str) -> DataFrame:
    """ON03, ON05: areas by lower-cased name; the first one's level and parent stand, the ISO3 code is filled in from any."""
    return areas.groupBy(F.lower(F.trim("name")).alias("geo_key")).agg(
        F.min_by("name", order).alias("name"), F.min_by("admin_level", order).alias("admin_level"), F.lower(F.trim(F.min_by("parent", order))).alias("parent"), F.max("iso3").alias("iso3")
    )


def merge_gazetteers(rows: DataFrame) -> DataFrame:
    """SO07: (country_ord, admin1, admin2) to one list of districts for each admin1; that of the later country stands."""
    each = rows.groupBy("country_ord", "admin1").agg(F.sort_array(F.collect_set("admin2")).alias("districts"))
    return each.groupBy("admin1").agg(F.max_by("districts", "country_ord").alias("districts"))


def located(facts: DataFrame, geo: DataFrame) -> DataFrame:
    """JN07: facts with their area and its admin1, which is the area itself or its parent; others go."""
    g = geo.select("geo_key", F.col("name").alias("geo_name"), F.col("admin_level").alias("geo_level"), "parent")
    joined = facts.withColumn("geo_key", F.lower(F.trim("geo_area"))).join(g, "geo_key")
    key = F.when(F.col("geo_level") == 1, F.col("geo_key")).when((F.col("geo_level") == 2) & (F.col("parent") != ""), F.col("parent"))
    return joined.withColumn("admin1_key", key)


def explode_figures(rows: DataFrame, *keep: str) -> DataFrame:
    """An outer explode: of an inner one the optimizer would infer that the map isn't empty, and find all figures once more to see that."""
    return rows.select(*keep, F.explode_outer("figures").alias("figure_key", "value")).filter("figure_key is not null")


def national_figures(figures: DataFrame) -> DataFrame:
    """AG16: (geo_area, figure_key, value) to totals: the largest value of each area, then their sum."""
    largest = figures.groupBy(F.lower(F.trim("geo_area")).alias("geo_key"), "figure_key").agg(F.max("value").alias("value"))
    return largest.groupBy("figure_key").agg(F.sum("value").alias("value"))


def national_figures_dated(figures: DataFrame, order: str = "ord") -> DataFrame:
    """AG17: with the latest date among the areas' figures and its source. Of equal values the later date stands, then the earlier row."""
    label = F.trim(F.coalesce("source_label", F.lit("")))
    source = F.when((label != "") & ~F.lower(label).isin("unknown", "n/a"), label).otherwise(F.coalesce(F.nullif("connector", F.lit("")), F.nullif("url", F.lit("")), F.lit("Aggregated evidence")))
    row = figures.withColumn("_date", F.coalesce("reported_date", F.lit(""))).withColumn("_source", source)
    best = F.max_by(F.struct("value", "_date", "_source", F.col(order).alias("_ord")), F.struct("value", "_date", -F.col(order)))
    areas = row.groupBy(F.lower(F.trim("geo_area")).alias("geo_key"), "figure_key").agg(best.alias("b"))
    latest = F.max_by("b._source", F.struct("b._date", -F.col("b._ord")))
    return areas.groupBy("figure_key").agg(F.sum("b.value").alias("value"), F.max("b._date").alias("as_of"), latest.alias("source"))


def admin1_rollup(impacts_: DataFrame, geo: DataFrame) -> DataFrame:
    """AG18: (admin1_key, impact_count, max_severity, districts): impacts of an admin1 and its districts."""
    return located(impacts_, geo).filter("admin1_key is not null").groupBy("admin1_key").agg(
        F.count(F.lit(1)).alias("impact_count"), F.max("severity_phase").alias("max_severity"), F.array_join(F.sort_array(F.collect_set(F.when(F.col("geo_level") == 2, F.col("geo_name")))), ", ").alias("districts")
    )


def admin1_figures(impacts_: DataFrame, geo: DataFrame) -> DataFrame:
    """AG18: (admin1_key, figure_key, value): the largest of each leaf area, then their sum."""
    each = explode_figures(located(impacts_, geo).filter("admin1_key is not null"), "admin1_key", "geo_key")
    return each.groupBy("admin1_key", "geo_key", "figure_key").agg(F.max("value").alias("value")).groupBy("admin1_key", "figure_key").agg(F.sum("value").alias("value"))


def admin2_rollup(impacts_: DataFrame, geo: DataFrame, admin1: str | None = None) -> DataFrame:
    """AG19: (geo_key, parent, impact_count, max_severity), of one admin1 if asked for."""
    rows = located(impacts_, geo).filter("geo_level = 2")
    rows = rows if admin1 is None else rows.filter(F.col("parent") == admin1.strip().lower())
    return rows.groupBy("geo_key").agg(F.first("parent").alias("parent"), F.count(F.lit(1)).alias("impact_count"), F.max("severity_phase").alias("max_severity"))


def admin2_figures(impacts_: DataFrame, geo: DataFrame) -> DataFrame:
    """AG19: (geo_key, figure_key, value)."""
    return explode_figures(located(impacts_, geo).filter("geo_level = 2"), "geo_key").groupBy("geo_key", "figure_key").agg(F.max("value").alias("value"))


def sector_summary(need_rows: DataFrame) -> DataFrame:
    """AG20: (need_type, needs, max_severity, areas); the areas of a sector are at most those of the gazetteer."""
    return need_rows.groupBy("need_type").agg(F.count(F.lit(1)).alias("needs"), F.max("severity_phase").alias("max_severity"), F.array_join(F.sort_array(F.collect_set("geo_area")), ", ").alias("areas"))


def sector_by_area(need_rows: DataFrame, order: str = "event_id") -> DataFrame:
    """AG23: (need_type, geo_area, needs, max_severity, description): the first description that is not blank."""
    first = F.min_by("description", F.when(F.trim("description") != "", F.col(order)))
    return need_rows.groupBy("need_type", "geo_area").agg(F.count(F.lit(1)).alias("needs"), F.max("severity_phase").alias("max_severity"), first.alias("description"))


def max_severity(impacts_: DataFrame) -> DataFrame:
    """AG21."""
    return impacts_.agg(F.coalesce(F.max("severity_phase"), F.lit(0)).alias("max_severity"))


def actor_types(response_rows: DataFrame, limit: int = 3) -> DataFrame:
    """AG24: the most frequent types of actor; ties by name."""
    return response_rows.groupBy("actor_type").agg(F.count(F.lit(1)).alias("responses")).orderBy(F.desc("responses"), "actor_type").limit(limit)


def allocate(impacts_: DataFrame, geo: DataFrame) -> DataFrame:
    """AG22: (admin1_key, figure_key, value, distributed): national figures shared out by the admin1 areas' share of mentions.

    ``impacts_`` also has admin_level; the figures of level 0 are national. An area keeps its own figure where that is larger.
    """
    mentions = located(impacts_, geo).filter("admin1_key is not null").groupBy("admin1_key").agg(F.count(F.lit(1)).alias("m"))
    total = mentions.agg(F.sum("m").alias("total"))
    national = explode_figures(impacts_.filter("admin_level = 0"), "event_id").groupBy("figure_key").agg(F.max("value").alias("national"))
    # Mentions and figures have a row for each area and each kind of figure at most.
    shares = mentions.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(national)).select("admin1_key", "figure_key", F.bround(F.col("national") * (F.col("m") / F.col("total")), 0).cast("long").alias("share"))
    own = admin1_figures(impacts_, geo)
    both = own.join(shares, ["admin1_key", "figure_key"], "full")
    taken = F.coalesce("share", F.lit(0)) > F.coalesce("value", F.lit(0))
    return both.select("admin1_key", "figure_key", F.when(taken, F.col("share")).otherwise(F.coalesce("value", F.lit(0))).alias("value"), taken.alias("distributed")).filter("value > 0 or not distributed")


def children_of(geo: DataFrame, parent: str) -> DataFrame:
    """JN08, SL09: the areas under one, by name."""
    return geo.filter(F.col("parent") == parent.strip().lower()).orderBy("name")


def admin1_areas(geo: DataFrame) -> DataFrame:
    """SL09."""
    return geo.filter("admin_level = 1").orderBy("name")


def impacts_in(impacts_: DataFrame, geo: DataFrame, area: str) -> DataFrame:
    """SL06: the impacts of an area, and of the areas under it, most severe first."""
    key = area.strip().lower()
    return located(impacts_, geo).filter((F.col("geo_key") == key) | (F.col("parent") == key)).orderBy(F.desc("severity_phase"), "event_id", "pos")


def where_equal(nodes: DataFrame, **values) -> DataFrame:
    """SL07: nodes by type, sector, area or horizon, in any case."""
    for name, value in values.items():
        nodes = nodes.filter(F.lower(F.trim(name)) == str(value).strip().lower())
    return nodes


def claims_naming(claim_rows: DataFrame, area: str) -> DataFrame:
    """SL08."""
    return claim_rows.filter(F.lower("claim_text").contains(area.strip().lower()))


def clip(text: Column, most: int) -> Column:
    """ON06, SNK02."""
    return F.substring(text, 1, most)
