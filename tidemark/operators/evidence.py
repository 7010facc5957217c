"""Evidence retrieval: joins of events with raw items, facets, scores, balanced selection (JN02, JN03, AG10 to AG15, SL01 to SL05, WN01, WN06)."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.functions.text import source_label
from tidemark.functions.urls import domain
from tidemark.operators.classify import connector_weight, source_tier, tier_weight
from tidemark.operators.ordering import numbered
from tidemark.sources.shared import written


def event_texts(events: DataFrame, items: DataFrame) -> DataFrame:
    """JN02: events with the text of the raw item of the same cycle and url, of several the one with the least id."""
    first = items.groupBy("cycle_id", "url").agg(F.min_by(F.get_json_object("payload_json", "$.text"), "id").alias("text"))
    return events.join(first, ["cycle_id", "url"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def last_item_texts(events: DataFrame, items: DataFrame) -> DataFrame:
    """JN03: events with the text of the last raw item of the same url."""
    last = items.groupBy("url").agg(F.max_by("text", "ord").alias("text"))
    return events.join(last, "url", "left")


#: Facet values up to which their counts are broadcast.
MOST_FACETS = 100_000


def facets(events: DataFrame, names: tuple[str, ...] = ("country", "disaster_type", "connector")) -> DataFrame:
    """AG10, WN04: add how many events, before any filter, share the country, the hazard and the connector.

    All counts come from one pass with a map-side part. They are broadcast if there are few, which is checked, for a shuffle
    by a column of few values would put the events in few tasks; beyond that they are joined by a shuffle that can be split.
    """
    each = F.array(*[F.struct(F.lit(n).alias("facet"), F.lower(n).alias("value")) for n in names])
    counts = written(events.select(F.explode(each).alias("f")).groupBy("f.facet", "f.value").agg(F.count(F.lit(1)).alias("n")), "facets")
    few = counts.count() <= MOST_FACETS
    out = events
    for name in names:
        own = counts.filter(F.col("facet") == name).select(F.col("value").alias(f"_{name}"), F.col("n").alias(f"facet_{name}"))
        out = out.join(F.broadcast(own) if few else own, F.lower(out[name]) == F.col(f"_{name}"), "left").drop(f"_{name}")
    return out


def graph_score(hazards: list[str]) -> Column:
    """SL03: corroboration and facets, weighted by connector and credibility."""
    facet = F.col("corroboration_sources") + F.col("facet_country") + F.col("facet_disaster_type") + 0.5 * F.col("facet_connector")
    tier = source_tier(F.col("connector"), F.col("source_type"), domain(F.col("url")))
    return F.bround(facet * connector_weight(F.col("connector"), hazards) * tier_weight(tier), 3)


def score_evidence(events: DataFrame, countries: list[str], hazards: list[str], not_before: Column | None = None, published: str = "published") -> DataFrame:
    """SL03 with its filters, which stand after the facets: country, hazard, and age (a report drops what is exactly at the limit)."""
    out = facets(events)
    if not_before is not None:
        out = out.filter(F.col(published).isNull() | (F.col(published) > not_before))
    if countries:
        out = out.filter(F.lower("country").isin([c.lower() for c in countries]))
    if hazards:
        out = out.filter(F.lower("disaster_type").isin(hazards))
    tier = source_tier(F.col("connector"), F.col("source_type"), domain(F.col("url")))
    return out.withColumns({"graph_score": graph_score(hazards), "source_label": source_label(F.col("title")), "credibility_tier": tier, "credibility_weight": tier_weight(tier)})



def evidence_order() -> list[Column]:
    """SL01: score, then severity as a string, then date as a string, all descending; the newest id first among equals."""
    return [F.desc("graph_score"), F.desc("severity"), F.desc(F.coalesce("published_at", F.lit(""))), F.desc("id")]


def top_evidence(scored: DataFrame, limit: int) -> DataFrame:
    """SL01 with a limit: a top-k."""
    return scored.orderBy(*evidence_order()).limit(limit)


def capped(scored: DataFrame, by: str, cap: int, limit: int) -> DataFrame:
    """WN06, SL02 with a single cap: at most ``cap`` rows for each value of ``by``, then the first ``limit``."""
    ranked = scored.withColumn("_n", F.row_number().over(W.partitionBy(by).orderBy(*evidence_order()))).filter(F.col("_n") <= cap).drop("_n")
    return top_evidence(ranked, limit)


def balanced(scored: DataFrame, limit: int, countries: list[str], per_country: int, per_connector: int, per_source: int) -> DataFrame:
    """SL02: a quota for each country in turn, then the best of the rest, under caps for connectors and sources and a limit.

    Whether a row is taken depends on all taken before it, so the last step is a loop. It sees few rows. Of a country, connector
    and source only the first ``per_source`` events can be taken. Of a country and connector, a row is passed over because its
    source is full (at most ``limit`` sources can be, each with so many rows) or its event was taken (at most ``limit`` were, each
    with one row a source, of which the first ``limit`` + 1 settle it); so only its first ``limit`` * (2 * ``limit`` + 3) rows can be.
    The loop has ids and keys of so many rows for each pair of a country and a connector, whatever the number of sources.
    """
    source = F.when((F.col("source_label") != "unknown"), F.col("source_label")).otherwise(F.coalesce(F.nullif(domain(F.coalesce("canonical_url", "url") if "canonical_url" in scored.columns else F.col("url")), F.lit("")), F.lit("unknown")))
    keyed = scored.withColumn("_source", source).withColumn("_country", F.lower("country"))
    keys = ["_country", "connector", "_source"]
    group = W.partitionBy(*keys).orderBy(*evidence_order())
    # An event is taken once, so its best row in a group is the only one that can be; others must not fill the group's places.
    rank = F.struct("graph_score", "severity", F.coalesce("published_at", F.lit("")).alias("published_at"), "id")
    events = keyed.groupBy(*keys, "event_id").agg(F.max(rank).alias("_best")).select(*keys, "event_id", "_best.*")
    # The first rows of each group, and of those the best of each country and connector.
    most = min(limit, per_source) if per_source > 0 else limit
    near = events.withColumn("_n", F.row_number().over(group)).filter(F.col("_n") <= most).drop("_n")
    place = lambda *keys: F.row_number().over(W.partitionBy(*keys).orderBy(*evidence_order()))
    near = near.withColumn("_n", place("_country", "connector", "event_id")).filter(F.col("_n") <= limit + 1)
    near = near.withColumn("_n", place("_country", "connector")).filter(F.col("_n") <= limit * (2 * limit + 3)).drop("_n")
    light = near.orderBy(*evidence_order()).select("id", "event_id", "_country", "connector", "_source").toLocalIterator()
    rows, taken, used, connectors, sources = list(light), [], set(), Counter(), Counter()

    def take(row) -> bool:
        if row.event_id in used or (per_connector > 0 and connectors[row.connector] >= per_connector) or (per_source > 0 and sources[row._source] >= per_source):
            return False
        taken.append(row.id)
        used.add(row.event_id)
        connectors[row.connector] += 1
        sources[row._source] += 1
        return True

    for country in [c.lower() for c in countries] if per_country > 0 else []:
        wanted = per_country
        for row in rows:
            if len(taken) >= limit or wanted <= 0:
                break
            wanted -= row._country == country and take(row)
    for row in rows:
        if len(taken) >= limit:
            break
        take(row)
    return scored.filter(F.col("id").isin(taken)).orderBy(*evidence_order())


def with_fallback(scored: DataFrame, events: DataFrame, limit: int) -> DataFrame:
    """SL04: where the filters leave nothing, the newest events, scored by corroboration alone."""
    newest = events.orderBy(F.desc("id")).limit(limit)
    spare = newest.withColumns({"graph_score": F.col("corroboration_sources").cast("double"), "source_label": source_label(F.col("title")), "credibility_tier": F.lit(4), "credibility_weight": F.lit(0.7)})
    return spare if scored.isEmpty() else scored.select(*spare.columns)


def selection_counts(evidence: DataFrame, *columns: str) -> DataFrame:
    """AG11: (facet, value, selected) for several columns in one pass."""
    each = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])
    return evidence.select(F.explode(each).alias("f")).groupBy("f.facet", "f.value").agg(F.count(F.lit(1)).alias("selected"))


def tier_distribution(evidence: DataFrame) -> DataFrame:
    """AG12: one row with all four tiers."""
    return evidence.agg(*[F.count_if(F.col("credibility_tier") == t).alias(f"tier_{t}") for t in (1, 2, 3, 4)])


def domain_counts(evidence: DataFrame, url: Column) -> DataFrame:
    """AG13."""
    return evidence.select(domain(url).alias("domain")).filter("domain <> ''").groupBy("domain").agg(F.count(F.lit(1)).alias("items"))


def diversity(counts: DataFrame, by: list[str], count: str) -> DataFrame:
    """AG14: the sum of squared shares, from two sums, so no window is needed."""
    sums = counts.groupBy(*by).agg(F.sum(count).alias("_s"), F.sum(F.col(count).cast("double") * F.col(count)).alias("_q"))
    return sums.select(*by, F.when(F.col("_s") > 0, F.col("_q") / (F.col("_s").cast("double") * F.col("_s"))).otherwise(0.0).alias("hhi"))


def top_labels(counts: DataFrame, label: str, count: str, limit: int) -> DataFrame:
    """AG15: one row "a (3), b (2)"; ties by label."""
    top = counts.orderBy(F.desc(count), label).limit(limit)
    listed = F.transform(F.sort_array(F.collect_list(F.struct((-F.col(count)).alias("n"), F.col(label).alias("label")))), lambda x: F.concat(x["label"], F.lit(" ("), (-x["n"]).cast("string"), F.lit(")")))
    return top.agg(F.coalesce(F.nullif(F.array_join(listed, ", "), F.lit("")), F.lit("none")).alias("labels"))


def citation_numbers(evidence: DataFrame, url: str, order: str) -> DataFrame:
    """WN01: (url, n): addresses numbered in order of their first appearance; ``order`` is the evidence's rank."""
    first = evidence.filter(F.coalesce(F.col(url), F.lit("")) != "").groupBy(F.trim(url).alias("url")).agg(F.min(order).alias("_first"))
    return numbered(first, ["_first", "url"]).select("url", (F.col("n") + 1).cast("long").alias("n"))


def citation_refs(evidence: DataFrame, numbers: DataFrame, url: str) -> DataFrame:
    """SC33: add ``ref``: [N], or [unavailable]."""
    joined = evidence.join(numbers.withColumnRenamed("url", "_url"), F.trim(F.col(url)) == F.col("_url"), "left").drop("_url")
    return joined.withColumn("ref", F.coalesce(F.concat(F.lit("["), F.col("n").cast("string"), F.lit("]")), F.lit("[unavailable]"))).drop("n")


def batches(rows: DataFrame, by: str, order: str, size: int = 15) -> DataFrame:
    """WN08: (by, batch, ids): rows of each group in order, ``size`` to a batch."""
    placed = numbered(rows.select(by, order), [order], [by]).withColumn("batch", F.floor(F.col("n") / size))
    return placed.groupBy(by, "batch").agg(F.sort_array(F.collect_list(order)).alias("members"))


def apply_batch_results(items: DataFrame, results: DataFrame) -> DataFrame:
    """JN09: results (batch, index, value) laid over items (batch, index, value); a missing one keeps the item's own."""
    found = results.select("batch", "index", F.col("value").alias("_value"))
    return items.join(found, ["batch", "index"], "left").withColumn("value", F.coalesce("_value", "value")).drop("_value")
