"""Classification of texts by fixed word lists (PR08 to PR18), credibility (PR23 to PR25, SC31), alerts (PR27)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.dims import (
    ACTORS, CONNECTOR_WEIGHTS, EVENT_SEVERITY, FOCUS_CONNECTORS, HAZARD_CATEGORIES, HUMANITARIAN_FOCUS, IMPACTS, NEEDS, RISKS, SEVERITY_LEVELS, SEVERITY_PHASES, SUB_HAZARDS,
    TIER_CONNECTORS, TIER_DOMAINS, TIER_LABELS, TIER_SOURCE_TYPES, TIER_WEIGHTS, inverted, lookup,
)
from tidemark.functions.text import contains_any, count_terms, let, normalize


def _ladder(text: Column, steps: dict, default) -> Column:
    def steps_of(t: Column) -> Column:
        out = None
        for value, terms in steps.items():
            hit = contains_any(t, terms)
            out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
        return out.otherwise(F.lit(default))

    return let(text, steps_of)


def event_severity(text: Column) -> Column:
    """PR08: critical, high, medium or low by the strongest word (substrings)."""
    return _ladder(normalize(text), EVENT_SEVERITY, "low")


def severity_phase(text: Column) -> Column:
    """PR10: phase 1 to 5."""
    return _ladder(F.lower(text), SEVERITY_PHASES, 1)


def source_confidence(source_type: Column) -> Column:
    """PR09."""
    return F.when(source_type == "official", "high").when(source_type.isin("humanitarian", "news"), "medium").otherwise("low")


def impact_scores(text: Column, table: dict[str, list[str]] = IMPACTS) -> Column:
    """Array of struct<score, first, label> of the impact types with a hit; a sort of it puts the best and then the first last."""

    def scores(t: Column) -> Column:
        each = F.array(*[F.struct(count_terms(t, terms).alias("score"), F.lit(-i).alias("first"), F.lit(label).alias("label")) for i, (label, terms) in enumerate(table.items())])
        return F.filter(each, lambda x: x["score"] > 0)

    return let(F.lower(text), scores)


def all_impacts(text: Column, table: dict[str, list[str]] = IMPACTS) -> Column:
    """PR12: impact types by descending number of words, list order among equals; people_impact if there is none."""
    ordered = F.transform(F.reverse(F.sort_array(impact_scores(text, table))), lambda x: x["label"])
    return let(ordered, lambda labels: F.when(F.size(labels) > 0, labels).otherwise(F.array(F.lit("people_impact"))))


def main_impact(text: Column) -> Column:
    """PR11: the first of ``all_impacts``."""
    return F.coalesce(F.array_max(impact_scores(text))["label"], F.lit("people_impact"))


def needs(text: Column, table: dict[str, list[str]] = NEEDS) -> Column:
    """PR13: need types with a hit, in list order."""
    return let(F.lower(text), lambda t: F.array_compact(F.array(*[F.when(contains_any(t, terms), F.lit(label)) for label, terms in table.items()])))


def is_risk(text: Column, words: list[str] = RISKS) -> Column:
    """PR14."""
    return contains_any(F.lower(text), words)


def risk_horizon(text: Column) -> Column:
    """PR15."""
    return F.when(contains_any(F.lower(text), ["7 day", "7-day", "week", "weekly"]), "7d").otherwise("48h")


def actor(text: Column) -> Column:
    """PR16: struct of the first actor in list order, in capitals, and its type; null if there is none."""
    t = F.lower(text)
    return F.coalesce(*[F.when(t.contains(k), F.struct(F.lit(k.upper()).alias("actor"), F.lit(v).alias("actor_type"))) for k, v in ACTORS.items()])


def sub_hazards(text: Column) -> Column:
    """PR17."""
    return let(F.lower(text), lambda t: F.array_compact(F.array(*[F.when(t.contains(s), F.lit(s)) for s in SUB_HAZARDS])))


def hazard_category(hazard: Column) -> Column:
    """ON04: meteorological unless listed."""
    return F.coalesce(lookup(HAZARD_CATEGORIES, F.lower(hazard)), F.lit("meteorological"))


def severity_to_phase(severity: Column) -> Column:
    """SC31: an event's severity as a phase; 2 if unknown."""
    return F.coalesce(lookup(SEVERITY_LEVELS, F.lower(F.trim(severity))), F.lit(2))


def source_tier(connector: Column, source_type: Column, domain: Column) -> Column:
    """PR23: the tier of the connector, else of the domain, else of the kind of source, else 4."""
    clean = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.coalesce(lookup(inverted(TIER_CONNECTORS), clean(connector)), lookup(inverted(TIER_DOMAINS), clean(domain)), lookup(inverted(TIER_SOURCE_TYPES), clean(source_type)), F.lit(4))


def tier_label(tier: Column) -> Column:
    """SC31."""
    return F.coalesce(lookup(TIER_LABELS, tier), F.concat(F.lit("Tier "), tier.cast("string")))


def tier_weight(tier: Column) -> Column:
    """SC31."""
    return F.coalesce(lookup(TIER_WEIGHTS, tier), F.lit(0.7))


def connector_weight(connector: Column, hazards: list[str]) -> Column:
    """PR25: fixed weights; a tenth more for humanitarian connectors where a hazard asked for is a humanitarian one."""
    name = F.lower(F.coalesce(connector, F.lit("")))
    base = F.coalesce(lookup(CONNECTOR_WEIGHTS, name), F.lit(1.0))
    if any(h in HUMANITARIAN_FOCUS for h in hazards):
        return F.when(name.isin(FOCUS_CONNECTORS), base + 0.1).otherwise(base)
    return base


def alert_bucket(severity: Column, status: Column) -> Column:
    """PR27: where an event goes; null for a medium one of any other status."""
    return (
        F.when(severity.isin("critical", "high"), "critical_high_alerts")
        .when((severity == "medium") & status.isin("new", "updated"), "medium_updates")
        .when((severity == "low") | ((severity == "medium") & (status == "unchanged")), "watchlist_signals")
    )


def detect_area(items: DataFrame, areas: DataFrame, text: str, id_column: str) -> DataFrame:
    """PR18: add ``area``: of the areas named in the text, the one of the highest level, the first listed of equals.

    ``areas`` (name, admin_level, ord) is joined by its words, not by a scan of every area for every text: of each area's name the
    word that fewest names have meets the distinct words of the text in an equi-join, and only those pairs are tested for the whole name.
    So a word that many names begin with brings no text together with all of them.
    """
    low = F.lower(F.col(text))
    words = F.array_distinct(F.regexp_extract_all(low, F.lit(r"(?U)(\w+)"), 1))
    own = F.array_distinct(F.regexp_extract_all(F.lower("name"), F.lit(r"(?U)(\w+)"), 1))
    each = areas.filter("admin_level >= 1").select(F.struct("name", "admin_level", "ord").alias("_a"), F.explode(own).alias("_word"))
    times = each.groupBy("_word").agg(F.count(F.lit(1)).alias("_times"))
    rarest = each.join(times, "_word").groupBy("_a").agg(F.min_by("_word", F.struct("_times", -F.char_length("_word"), "_word")).alias("_word"))
    named = rarest.select("_word", F.lower("_a.name").alias("_name"), F.col("_a.name").alias("_area"), F.col("_a.admin_level").alias("_level"), F.col("_a.ord").alias("_ord"))
    texts = items.select(id_column, low.alias("_text"), F.explode(words).alias("_word"))
    # The name with its special characters quoted, between word boundaries.
    pattern = F.concat(F.lit(r"(?U)(?<!\w)"), F.regexp_replace("_name", r"([^\w\s])", r"\\$1"), F.lit(r"(?!\w)"))
    found = texts.join(named, "_word").filter(F.regexp_like("_text", pattern))
    best = found.groupBy(id_column).agg(F.min_by("_area", F.struct(-F.col("_level"), F.col("_ord"))).alias("area"))
    return items.join(best, id_column, "left")
