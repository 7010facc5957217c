"""Quality, health and extraction reports over cycles (JN01, AG01 to AG09, AG25 to AG31), staleness (WN02, WN03)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.operators.ordering import in_ranges


def recent_cycles(cycles: DataFrame, limit: int) -> DataFrame:
    """SRC16: the newest cycles; a top-k, so only ``limit`` rows leave each task."""
    return cycles.orderBy(F.col("cycle_id").desc()).limit(limit)


def in_recent(facts: DataFrame, cycles: DataFrame, limit: int) -> DataFrame:
    """JN01: the facts of the newest cycles; the build side has ``limit`` rows."""
    return facts.join(F.broadcast(recent_cycles(cycles, limit).select("cycle_id")), "cycle_id", "left_semi")


def rate(part: Column, whole: Column, places: int = 4) -> Column:
    """part / whole, 0 where whole is 0, rounded half to even."""
    return F.coalesce(F.bround(part / F.nullif(whole, F.lit(0)), places), F.lit(0.0))


COUNTERS = ("llm_attempted", "llm_fallback", "llm_insufficient_text", "llm_provider_error", "llm_validation_fail")


def quality_sums(events: DataFrame, *by: str) -> DataFrame:
    """The counts that the quality report is made of; they add up across cycles."""
    severe = F.col("severity").isin("high", "critical")
    return events.groupBy(*by).agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.col("status") == "unchanged").alias("unchanged"),
        F.count_if((F.coalesce("url", F.lit("")) != "") & (F.coalesce("published_at", F.lit("")) != "")).alias("traceable"),
        F.count_if(severe).alias("high_critical"),
        F.count_if(severe & (F.col("confidence") == "high")).alias("high_confidence"),
        F.count_if(F.col("llm_enriched")).alias("enriched"),
        F.count_if(F.size("citations") > 0).alias("cited"),
    )


def quality_report(events: DataFrame, cycles: DataFrame, limit: int = 10) -> DataFrame:
    """AG01: one row. Without events the traceable rate is 1, without cycles 0."""
    recent = recent_cycles(cycles, limit)
    totals = recent.agg(F.count(F.lit(1)).alias("cycles"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS])
    counts = quality_sums(in_recent(events, cycles, limit))
    # Two tables of one row each.
    joined = totals.crossJoin(F.broadcast(counts))
    return joined.select(
        F.col("cycles").alias("cycles_analyzed"), F.col("events").alias("events_analyzed"), rate(F.col("unchanged"), F.col("events")).alias("duplicate_rate_estimate"),
        F.when(F.col("events") > 0, rate(F.col("traceable"), F.col("events"))).when(F.col("cycles") > 0, 1.0).otherwise(0.0).alias("traceable_rate"),
        F.col("high_critical").alias("high_critical_count"), F.col("high_confidence").alias("high_confidence_high_critical_count"),
        F.col("llm_attempted").alias("llm_attempted_events"), F.col("enriched").alias("llm_enriched_events"), F.col("llm_fallback").alias("llm_fallback_events"),
        F.col("llm_insufficient_text").alias("llm_insufficient_text_events"), rate(F.col("enriched"), F.col("events")).alias("llm_enrichment_rate"),
        rate(F.col("cited"), F.col("events")).alias("citation_coverage_rate"), F.col("llm_provider_error").alias("llm_provider_error_count"),
        F.col("llm_validation_fail").alias("llm_validation_fail_count"),
    )


def quality_trend(events: DataFrame, cycles: DataFrame, window: int = 10) -> DataFrame:
    """AG09: the quality report of the last 1, 2, ... ``window`` cycles in one pass: sums by cycle, then running sums over ``window`` rows."""
    recent = recent_cycles(cycles, window)
    sums = recent.select("cycle_id").join(quality_sums(in_recent(events, cycles, window), "cycle_id"), "cycle_id", "left").fillna(0)
    newest_first = W.orderBy(F.col("cycle_id").desc()).rowsBetween(W.unboundedPreceding, 0)
    run = lambda c: F.sum(c).over(newest_first)
    return sums.select(
        F.count(F.lit(1)).over(newest_first).alias("cycles_analyzed"), run("events").alias("events_analyzed"), rate(run("unchanged"), run("events")).alias("duplicate_rate"),
        F.when(run("events") > 0, rate(run("traceable"), run("events"))).otherwise(1.0).alias("traceable_rate"), rate(run("enriched"), run("events")).alias("llm_enrichment_rate"),
        rate(run("cited"), run("events")).alias("citation_coverage_rate"),
    )


def connector_health(health: DataFrame) -> DataFrame:
    """AG02: sums and rates by connector."""
    sums = ("attempted_sources", "healthy_sources", "failed_sources", "fetched_count", "matched_count")
    out = health.groupBy("connector").agg(F.count(F.lit(1)).alias("runs"), *[F.sum(c).alias(c) for c in sums])
    return out.withColumns({
        "failure_rate": F.bround(F.col("failed_sources") / F.greatest(F.lit(1), F.col("attempted_sources")), 4),
        "match_rate": F.bround(F.col("matched_count") / F.greatest(F.lit(1), F.col("fetched_count")), 4),
    })


def feed_health(feeds: DataFrame) -> DataFrame:
    """AG03: runs, failed runs, counts and rates by connector and source; the last error of a failed run, by id."""
    failed = F.col("status").isin("failed", "error")
    error = F.when(failed & (F.coalesce("error", F.lit("")) != ""), F.struct("id", "error"))
    out = feeds.groupBy("connector", "source_url").agg(
        F.min_by("source_name", "id").alias("source_name"), F.count(F.lit(1)).alias("runs"), F.count_if(failed).alias("failed_runs"), F.sum("fetched_count").alias("fetched_count"),
        F.sum("matched_count").alias("matched_count"), F.coalesce(F.max(error)["error"], F.lit("")).alias("last_error"),
    )
    return out.withColumns({
        "failure_rate": F.bround(F.col("failed_runs") / F.greatest(F.lit(1), F.col("runs")), 4),
        "match_rate": F.bround(F.col("matched_count") / F.greatest(F.lit(1), F.col("fetched_count")), 4),
    })


def extraction_status(records: DataFrame) -> DataFrame:
    """AG04."""
    return records.groupBy(F.coalesce(F.nullif("status", F.lit("")), F.lit("unknown")).alias("status")).agg(F.count(F.lit(1)).alias("records"))


def _mean_of_positive(column: str) -> Column:
    return F.coalesce(F.bround(F.avg(F.when(F.col(column) > 0, F.col(column))), 0), F.lit(0.0)).cast("long")


def extraction_by_connector(records: DataFrame) -> DataFrame:
    """AG05: the four known statuses side by side; others are not in the total."""
    known = ("ok", "empty", "failed", "skipped")
    out = records.groupBy("connector").agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in known], _mean_of_positive("char_count").alias("avg_char_count"), _mean_of_positive("duration_ms").alias("avg_duration_ms")
    )
    total = F.col("ok") + F.col("empty") + F.col("failed") + F.col("skipped")
    return out.withColumn("total", total).withColumn("ok_rate", F.bround(F.col("ok") / F.greatest(F.lit(1), F.col("total")), 4))


def extraction_by_method(records: DataFrame) -> DataFrame:
    """AG06: here the total counts every status."""
    out = records.groupBy(F.coalesce(F.nullif("method", F.lit("")), F.lit("unknown")).alias("method")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "failed").alias("failed"), _mean_of_positive("char_count").alias("avg_char_count")
    )
    return out.withColumn("ok_rate", F.bround(F.col("ok") / F.greatest(F.lit(1), F.col("total")), 4))


def top_errors(records: DataFrame, limit: int = 10) -> DataFrame:
    """AG07: the most frequent errors of failed extractions, by their first 120 characters."""
    failed = records.filter((F.col("status") == "failed") & (F.coalesce("error", F.lit("")) != ""))
    keyed = failed.groupBy("connector", F.coalesce(F.nullif("method", F.lit("")), F.lit("unknown")).alias("method"), F.trim(F.substring("error", 1, 120)).alias("error")).agg(F.count(F.lit(1)).alias("errors"))
    return keyed.orderBy(F.desc("errors"), "connector", "method", "error").limit(limit)


def low_yield(records: DataFrame, below: float = 0.5, least: int = 3) -> DataFrame:
    """AG08."""
    return extraction_by_connector(records).filter((F.col("ok_rate") < below) & (F.col("total") >= least)).select("connector")


def stale_streaks(checks: DataFrame) -> DataFrame:
    """WN02: add ``stale_streak`` after each check of a source (source_url, check_id, freshness): stale adds one, fresh sets it to none, unknown leaves it.

    Each fresh check begins an island; the streak is the number of stale ones so far in the island. A source's checks are spread
    over ranges, each counted by itself; what a range hands on to the next is one row, so no task holds a whole source.
    """
    ranged = in_ranges(checks, ["source_url"], ["check_id"])
    upto = lambda *keys: W.partitionBy(*keys).orderBy("check_id").rowsBetween(W.unboundedPreceding, 0)
    count = lambda value: F.sum((F.col("freshness") == value).cast("long"))
    islands = ranged.withColumn("_island", F.coalesce(count("fresh").over(upto("source_url", "_range")), F.lit(0)))
    local = islands.withColumn("_stale", F.coalesce(count("stale").over(upto("source_url", "_range", "_island")), F.lit(0)))
    ends = local.groupBy("source_url", "_range").agg(F.max_by("_stale", "check_id").alias("_end"), F.max("_island").alias("_fresh"))
    # A range's end counts from its last fresh check, or adds to what came in.
    by_range = W.partitionBy("source_url").orderBy("_range")
    groups = ends.withColumn("_group", F.sum((F.col("_fresh") > 0).cast("long")).over(by_range.rowsBetween(W.unboundedPreceding, 0)))
    handed = groups.withColumn("_sum", F.sum("_end").over(W.partitionBy("source_url", "_group").orderBy("_range").rowsBetween(W.unboundedPreceding, 0)))
    carried = handed.select(F.col("source_url").alias("_url"), F.col("_range").alias("_r"), F.coalesce(F.lag("_sum").over(by_range), F.lit(0)).alias("_in"))
    joined = local.join(carried, F.col("source_url").eqNullSafe(F.col("_url")) & (F.col("_range") == F.col("_r")))
    return joined.select(*checks.columns, (F.col("_stale") + F.when(F.col("_island") == 0, F.col("_in")).otherwise(0)).alias("stale_streak"))


def stale_action(streak: Column, warn_after: int = 2, demote_after: int = 5, warn: bool = True, demote: bool = False) -> Column:
    """WN03: demote before warn, each from its number of stale checks on; null for none."""
    out = F.when(F.lit(demote) & (streak >= max(1, demote_after)), "demote")
    return out.when(F.lit(warn) & (streak >= max(1, warn_after)), "warn")


def hardening_gate(quality: DataFrame, connectors: DataFrame, enforce_llm: bool = False) -> DataFrame:
    """GT01, AG28: one row: status, the checks and the worst connector's failure rate."""
    worst = connectors.agg(F.coalesce(F.max("failure_rate"), F.lit(0.0)).alias("worst_connector_failure_rate"))
    applies = F.lit(enforce_llm) | (F.col("llm_attempted_events") > 0)
    checks = {
        "duplicate_rate_ok": F.col("duplicate_rate_estimate") <= 0.10, "traceable_rate_ok": F.col("traceable_rate") >= 0.95, "connector_failure_ok": F.col("worst_connector_failure_rate") <= 0.60,
        "llm_enrichment_rate_ok": ~applies | (F.col("llm_enrichment_rate") >= 0.10), "citation_coverage_ok": ~applies | (F.col("citation_coverage_rate") >= 0.95),
    }
    every = F.lit(True)
    for check in checks:
        every = every & F.col(check)
    status = F.when(F.col("cycles_analyzed") == 0, "insufficient_data").when(F.col("events_analyzed") == 0, "warning").when(every, "pass").otherwise("fail")
    return quality.crossJoin(F.broadcast(worst)).withColumns(checks).select(status.alias("status"), *checks, "worst_connector_failure_rate", "events_analyzed", "cycles_analyzed")


def llm_gate(quality: DataFrame, enforce_llm: bool = False) -> DataFrame:
    """GT02: one row."""
    applies = F.lit(enforce_llm) | (F.col("llm_attempted_events") > 0)
    rate_ok, cited_ok = F.col("llm_enrichment_rate") >= 0.10, F.col("citation_coverage_rate") >= 0.95
    return quality.select(
        F.when(~applies, "warning").when(rate_ok & cited_ok, "pass").otherwise("fail").alias("status"), (~applies | rate_ok).alias("llm_enrichment_rate_ok"),
        (~applies | cited_ok).alias("citation_coverage_ok"), "llm_attempted_events", "llm_provider_error_count", "llm_validation_fail_count",
    )


def conformance(checks: DataFrame, hardening_status: Column) -> DataFrame:
    """GT03: (name, value) to one row. A failed check fails it; else an open gate, then an open check, makes it a warning."""
    value = F.lower(F.trim(F.coalesce(F.nullif("value", F.lit("")), F.lit("pending"))))
    known = F.when(value.isin("pass", "fail"), value).otherwise("pending")
    counts = checks.select(known.alias("v")).agg(*[F.count_if(F.col("v") == v).alias(n) for v, n in (("pass", "passed"), ("fail", "failed"), ("pending", "pending"))])
    status = F.when(F.col("failed") > 0, "fail").when(hardening_status != "pass", "warning").when(F.col("pending") > 0, "warning").otherwise("pass")
    return counts.select(status.alias("status"), "passed", "failed", "pending")


def running_totals(events: DataFrame) -> DataFrame:
    """WN05: (cycle_id, events, events_so_far); a row a cycle is all that the window has."""
    return events.groupBy("cycle_id").agg(F.count(F.lit(1)).alias("events")).withColumn("events_so_far", F.sum("events").over(W.orderBy("cycle_id").rowsBetween(W.unboundedPreceding, 0)))


def cycle_summary(events: DataFrame) -> DataFrame:
    """AG29: new, updated and unchanged events of each cycle."""
    return events.groupBy("cycle_id").agg(*[F.count_if(F.col("status") == s).alias(f"{s}_events") for s in ("new", "updated", "unchanged")])


def source_check(feeds: DataFrame) -> DataFrame:
    """PR28: add ``working``: read without failure and with items."""
    return feeds.withColumn("working", F.col("status").isin("ok", "recovered") & (F.col("fetched_count") > 0))


def source_check_totals(feeds: DataFrame) -> DataFrame:
    """AG26."""
    checked = source_check(feeds)
    return checked.agg(F.count_if("working").alias("working"), F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "stale").alias("stale"), F.count_if(F.col("status") == "demoted_stale").alias("demoted"))


def working_by_connector(feeds: DataFrame) -> DataFrame:
    """AG31."""
    return source_check(feeds).groupBy("connector").agg(F.count_if("working").alias("working"), F.count(F.lit(1)).alias("total"))
