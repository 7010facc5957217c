"""Queries of the health, evidence, deduplication and gate operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import dedupe, evidence, health
from tidemark.plans.adapters import CYCLES, EV, TM, cycles, events, telemetry
from tidemark.sources.shared import written

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLE[name] = sql
        return function

    return add


_REC = "rc AS (SELECT cycle_id FROM cy ORDER BY cycle_id DESC LIMIT 10)"
_SUMS = """count(*) AS n, count(*) FILTER (status = 'unchanged') AS unchanged, count(*) FILTER (url <> '' AND published_at <> '') AS traceable, count(*) FILTER (severity IN ('high', 'critical')) AS hc,
  count(*) FILTER (severity IN ('high', 'critical') AND confidence = 'high') AS hchc, count(*) FILTER (llm_enriched) AS enriched, count(*) FILTER (n_citations > 0) AS cited"""
_QUALITY = f"""{EV}, {CYCLES}, {_REC}, k AS (SELECT {_SUMS} FROM ev WHERE cycle_id IN (SELECT cycle_id FROM rc)),
t AS (SELECT count(*) AS cycles, sum(llm_attempted)::BIGINT AS a, sum(llm_fallback)::BIGINT AS f, sum(llm_insufficient_text)::BIGINT AS i, sum(llm_provider_error)::BIGINT AS p, sum(llm_validation_fail)::BIGINT AS v FROM cy WHERE cycle_id IN (SELECT cycle_id FROM rc)),
q AS (SELECT cycles AS cycles_analyzed, n AS events_analyzed, round_even(unchanged / n, 4) AS duplicate_rate_estimate, round_even(traceable / n, 4) AS traceable_rate, hc AS high_critical_count, hchc AS high_confidence_high_critical_count,
  a AS llm_attempted_events, enriched AS llm_enriched_events, f AS llm_fallback_events, i AS llm_insufficient_text_events, round_even(enriched / n, 4) AS llm_enrichment_rate, round_even(cited / n, 4) AS citation_coverage_rate,
  p AS llm_provider_error_count, v AS llm_validation_fail_count FROM k, t)"""


def _quality(spark, sf_dir):
    return health.quality_report(events(spark, sf_dir), cycles(spark, sf_dir))


@query("ag01_quality_report", f"WITH {_QUALITY} SELECT * FROM q")
def ag01(spark, sf_dir):
    return _quality(spark, sf_dir)


_AG02 = """h AS (SELECT connector, count(*) AS runs, sum(attempted_sources)::BIGINT AS attempted_sources, sum(healthy_sources)::BIGINT AS healthy_sources, sum(failed_sources)::BIGINT AS failed_sources, sum(fetched_count)::BIGINT AS fetched_count,
  sum(matched_count)::BIGINT AS matched_count FROM tm GROUP BY connector), hh AS (SELECT *, round_even(failed_sources / greatest(1, attempted_sources), 4) AS failure_rate, round_even(matched_count / greatest(1, fetched_count), 4) AS match_rate FROM h)"""


@query("ag02_connector_health", f"WITH {TM}, {_AG02} SELECT * FROM hh")
def ag02(spark, sf_dir):
    return health.connector_health(telemetry(spark, sf_dir))


@query(
    "ag03_feed_health",
    f"""WITH {TM}, f AS (SELECT connector, source_url, arg_min(source_name, id) AS source_name, count(*) AS runs, count(*) FILTER (status IN ('failed', 'error')) AS failed_runs, sum(fetched_count)::BIGINT AS fetched_count,
  sum(matched_count)::BIGINT AS matched_count, coalesce(arg_max(error, id) FILTER (status IN ('failed', 'error') AND error <> ''), '') AS last_error FROM tm GROUP BY connector, source_url)
SELECT *, round_even(failed_runs / runs, 4) AS failure_rate, round_even(matched_count / greatest(1, fetched_count), 4) AS match_rate FROM f""",
)
def ag03(spark, sf_dir):
    return health.feed_health(telemetry(spark, sf_dir))


@query("ag04_extraction_status", f"WITH {TM} SELECT status, count(*) AS records FROM tm GROUP BY status")
def ag04(spark, sf_dir):
    return health.extraction_status(telemetry(spark, sf_dir))


_MEANS = "coalesce(round_even(avg(char_count) FILTER (char_count > 0), 0), 0)::BIGINT AS avg_char_count"
_AG05 = f"""c AS (SELECT connector, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'empty') AS empty, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped, {_MEANS},
  coalesce(round_even(avg(duration_ms) FILTER (duration_ms > 0), 0), 0)::BIGINT AS avg_duration_ms FROM tm GROUP BY connector), cc AS (SELECT *, ok + empty + failed + skipped AS total, round_even(ok / greatest(1, ok + empty + failed + skipped), 4) AS ok_rate FROM c)"""


@query("ag05_extraction_by_connector", f"WITH {TM}, {_AG05} SELECT * FROM cc")
def ag05(spark, sf_dir):
    return health.extraction_by_connector(telemetry(spark, sf_dir))


@query("ag06_extraction_by_method", f"WITH {TM}, m AS (SELECT coalesce(nullif(method, ''), 'unknown') AS method, count(*) AS total, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'failed') AS failed, {_MEANS} FROM tm GROUP BY ALL) SELECT *, round_even(ok / greatest(1, total), 4) AS ok_rate FROM m")
def ag06(spark, sf_dir):
    return health.extraction_by_method(telemetry(spark, sf_dir))


@query("ag07_top_errors", f"WITH {TM} SELECT connector, coalesce(nullif(method, ''), 'unknown') AS method, trim(substring(error, 1, 120)) AS error, count(*) AS errors FROM tm WHERE status = 'failed' AND error <> '' GROUP BY ALL ORDER BY errors DESC, connector, method, error LIMIT 10")
def ag07(spark, sf_dir):
    return health.top_errors(telemetry(spark, sf_dir))


@query("ag08_low_yield", f"WITH {TM}, {_AG05} SELECT connector FROM cc WHERE ok_rate < 0.5 AND total >= 3")
def ag08(spark, sf_dir):
    return health.low_yield(telemetry(spark, sf_dir))


@query(
    "ag09_quality_trend",
    f"""WITH {EV}, {CYCLES}, {_REC}, k AS (SELECT cycle_id, {_SUMS} FROM ev WHERE cycle_id IN (SELECT cycle_id FROM rc) GROUP BY cycle_id),
s AS (SELECT count(*) OVER w AS c, sum(n) OVER w AS n, sum(unchanged) OVER w AS u, sum(traceable) OVER w AS t, sum(enriched) OVER w AS e, sum(cited) OVER w AS ci FROM k WINDOW w AS (ORDER BY cycle_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT c AS cycles_analyzed, n::BIGINT AS events_analyzed, round_even(u::DOUBLE / n::DOUBLE, 4) AS duplicate_rate, round_even(t::DOUBLE / n::DOUBLE, 4) AS traceable_rate, round_even(e::DOUBLE / n::DOUBLE, 4) AS llm_enrichment_rate, round_even(ci::DOUBLE / n::DOUBLE, 4) AS citation_coverage_rate FROM s""",
)
def ag09(spark, sf_dir):
    return health.quality_trend(events(spark, sf_dir), cycles(spark, sf_dir))


_STREAK = """i AS (SELECT *, sum((freshness = 'fresh')::BIGINT) OVER (PARTITION BY source_url ORDER BY id ROWS UNBOUNDED PRECEDING) AS island FROM tm),
st AS (SELECT source_url, id, freshness, sum((freshness = 'stale')::BIGINT) OVER (PARTITION BY source_url, island ORDER BY id ROWS UNBOUNDED PRECEDING)::BIGINT AS stale_streak FROM i)"""


def _streaks(spark, sf_dir):
    return health.stale_streaks(telemetry(spark, sf_dir).select("source_url", F.col("id").alias("check_id"), "freshness"))


@query("wn02_stale_streak", f"WITH {TM}, {_STREAK} SELECT source_url, id AS check_id, freshness, stale_streak FROM st")
def wn02(spark, sf_dir):
    return _streaks(spark, sf_dir)


@query("wn03_stale_action", f"WITH {TM}, {_STREAK} SELECT source_url, id AS check_id, CASE WHEN stale_streak >= 5 THEN 'demote' WHEN stale_streak >= 2 THEN 'warn' END AS action FROM st")
def wn03(spark, sf_dir):
    return _streaks(spark, sf_dir).select("source_url", "check_id", health.stale_action(F.col("stale_streak"), demote=True).alias("action"))


@query(
    "gt01_hardening_gate",
    f"""WITH {_QUALITY}, {TM}, {_AG02}, w AS (SELECT max(failure_rate) AS worst_connector_failure_rate FROM hh), g AS (SELECT duplicate_rate_estimate <= 0.1 AS duplicate_rate_ok, traceable_rate >= 0.95 AS traceable_rate_ok, worst_connector_failure_rate <= 0.6 AS connector_failure_ok,
  llm_attempted_events = 0 OR llm_enrichment_rate >= 0.1 AS llm_enrichment_rate_ok, llm_attempted_events = 0 OR citation_coverage_rate >= 0.95 AS citation_coverage_ok, * FROM q, w)
SELECT CASE WHEN cycles_analyzed = 0 THEN 'insufficient_data' WHEN events_analyzed = 0 THEN 'warning' WHEN duplicate_rate_ok AND traceable_rate_ok AND connector_failure_ok AND llm_enrichment_rate_ok AND citation_coverage_ok THEN 'pass' ELSE 'fail' END AS status,
  duplicate_rate_ok, traceable_rate_ok, connector_failure_ok, llm_enrichment_rate_ok, citation_coverage_ok, worst_connector_failure_rate, events_analyzed, cycles_analyzed FROM g""",
)
def gt01(spark, sf_dir):
    return health.hardening_gate(_quality(spark, sf_dir), health.connector_health(telemetry(spark, sf_dir)))


@query("gt02_llm_gate", f"WITH {_QUALITY} SELECT CASE WHEN llm_attempted_events = 0 THEN 'warning' WHEN llm_enrichment_rate >= 0.1 AND citation_coverage_rate >= 0.95 THEN 'pass' ELSE 'fail' END AS status, llm_attempted_events = 0 OR llm_enrichment_rate >= 0.1 AS llm_enrichment_rate_ok, llm_attempted_events = 0 OR citation_coverage_rate >= 0.95 AS citation_coverage_ok, llm_attempted_events, llm_provider_error_count, llm_validation_fail_count FROM q")
def gt02(spark, sf_dir):
    return health.llm_gate(_quality(spark, sf_dir))


@query("gt03_conformance", f"WITH {TM}, v AS (SELECT DISTINCT connector, CASE event_group WHEN 0 THEN 'pass' WHEN 1 THEN 'pending' ELSE 'pass' END AS value FROM (SELECT connector, length(connector) % 3 AS event_group FROM tm)), k AS (SELECT count(*) FILTER (value = 'pass') AS passed, count(*) FILTER (value = 'fail') AS failed, count(*) FILTER (value = 'pending') AS pending FROM v) SELECT CASE WHEN failed > 0 THEN 'fail' WHEN pending > 0 THEN 'warning' ELSE 'pass' END AS status, passed, failed, pending FROM k")
def gt03(spark, sf_dir):
    checks = telemetry(spark, sf_dir).select("connector").distinct().select(F.col("connector").alias("name"), F.when(F.length("connector") % 3 == 1, " Pending ").otherwise("PASS").alias("value"))
    return health.conformance(checks, F.lit("pass"))


@query("ag26_source_check_totals", f"WITH {TM} SELECT count(*) FILTER (status IN ('ok', 'recovered') AND fetched_count > 0) AS working, count(*) AS total, count(*) FILTER (status = 'stale') AS stale, count(*) FILTER (status = 'demoted_stale') AS demoted FROM tm")
def ag26(spark, sf_dir):
    return health.source_check_totals(telemetry(spark, sf_dir))


@query("ag28_worst_connector", f"WITH {TM}, {_AG02} SELECT coalesce(max(failure_rate), 0) AS worst FROM hh")
def ag28(spark, sf_dir):
    return health.connector_health(telemetry(spark, sf_dir)).agg(F.coalesce(F.max("failure_rate"), F.lit(0.0)).alias("worst"))


@query("ag29_cycle_summary", f"WITH {EV} SELECT cycle_id, count(*) FILTER (status = 'new') AS new_events, count(*) FILTER (status = 'updated') AS updated_events, count(*) FILTER (status = 'unchanged') AS unchanged_events FROM ev GROUP BY cycle_id")
def ag29(spark, sf_dir):
    return health.cycle_summary(events(spark, sf_dir))


@query("ag31_working_by_connector", f"WITH {TM} SELECT connector, count(*) FILTER (status IN ('ok', 'recovered') AND fetched_count > 0) AS working, count(*) AS total FROM tm GROUP BY connector")
def ag31(spark, sf_dir):
    return health.working_by_connector(telemetry(spark, sf_dir))


@query("ag27_enrichment_counters", f"WITH {EV} SELECT count(*) AS attempted, count(*) FILTER (llm_enriched) AS enriched, count(*) FILTER (NOT llm_enriched AND n_citations = 0) AS fallback FROM ev")
def ag27(spark, sf_dir):
    return events(spark, sf_dir).agg(F.count(F.lit(1)).alias("attempted"), F.count_if("llm_enriched").alias("enriched"), F.count_if(~F.col("llm_enriched") & (F.size("citations") == 0)).alias("fallback"))


@query("pr28_source_check", f"WITH {TM} SELECT id, connector, status IN ('ok', 'recovered') AND fetched_count > 0 AS working FROM tm")
def pr28(spark, sf_dir):
    return health.source_check(telemetry(spark, sf_dir)).select("id", "connector", "working")


@query("jn01_recent_semi", f"WITH {EV}, {CYCLES}, {_REC} SELECT id, cycle_id FROM ev WHERE cycle_id IN (SELECT cycle_id FROM rc)")
def jn01(spark, sf_dir):
    return health.in_recent(events(spark, sf_dir), cycles(spark, sf_dir), 10).select("id", "cycle_id")


@query("src16_recent_cycles", f"WITH {EV}, {CYCLES} SELECT * FROM cy ORDER BY cycle_id DESC LIMIT 5")
def src16(spark, sf_dir):
    return health.recent_cycles(cycles(spark, sf_dir), 5)


@query("jn02_event_raw_left", f"""WITH {EV}, r AS (SELECT cycle_id, url, arg_min(text, id) AS text FROM ev WHERE id % 3 <> 0 GROUP BY cycle_id, url) SELECT ev.id, coalesce(r.text, '') AS text FROM ev LEFT JOIN r ON ev.cycle_id = r.cycle_id AND ev.url = r.url""")
def jn02(spark, sf_dir):
    facts = events(spark, sf_dir)
    items = facts.filter("id % 3 <> 0").select("id", "cycle_id", "url", F.to_json(F.struct("text")).alias("payload_json"))
    return evidence.event_texts(facts.select("id", "cycle_id", "url"), items).select("id", "text")


@query("jn03_event_last_item", f"WITH {EV}, r AS (SELECT url, arg_max(text, id) AS text FROM ev WHERE id % 2 = 0 GROUP BY url) SELECT ev.id, r.text FROM ev LEFT JOIN r ON ev.url = r.url")
def jn03(spark, sf_dir):
    facts = events(spark, sf_dir)
    items = facts.filter("id % 2 = 0").select("url", "text", F.col("id").alias("ord"))
    return evidence.last_item_texts(facts.select("id", "url"), items).select("id", "text")


@query("jn09_batch_results", f"WITH {EV}, b AS (SELECT id // 15 AS batch, id % 15 AS idx, summary AS value FROM ev) SELECT batch, idx AS \"index\", CASE WHEN (batch + idx) % 4 = 0 THEN concat('r', idx::STRING) ELSE value END AS value FROM b")
def jn09(spark, sf_dir):
    items = events(spark, sf_dir).select(F.floor(F.col("id") / 15).alias("batch"), (F.col("id") % 15).alias("index"), F.col("summary").alias("value"))
    results = items.filter((F.col("batch") + F.col("index")) % 4 == 0).select("batch", "index", F.concat(F.lit("r"), F.col("index").cast("string")).alias("value"))
    return evidence.apply_batch_results(items, results)


_FACETS = "fc AS (SELECT *, count(*) OVER (PARTITION BY lower(country)) AS facet_country, count(*) OVER (PARTITION BY lower(disaster_type)) AS facet_disaster_type, count(*) OVER (PARTITION BY lower(connector)) AS facet_connector FROM ev)"


@query("ag10_facets", f"WITH {EV}, {_FACETS} SELECT id, facet_country, facet_disaster_type, facet_connector FROM fc")
def ag10(spark, sf_dir):
    return evidence.facets(events(spark, sf_dir)).select("id", "facet_country", "facet_disaster_type", "facet_connector")


_TIERED = """td AS (SELECT *, regexp_extract(lower(url), '^https://([^/]+)', 1) AS dom FROM fc), ti AS (SELECT *, CASE WHEN lower(connector) IN ('reliefweb') THEN 1 WHEN lower(connector) = 'government_feeds' THEN 2 WHEN lower(connector) = 'bbc' THEN 3
  WHEN dom IN ('reliefweb.int', 'unocha.org') THEN 1 WHEN dom = 'fews.net' THEN 2 WHEN source_type = 'official' THEN 1 WHEN source_type = 'humanitarian' THEN 2 WHEN source_type = 'news' THEN 3 ELSE 4 END AS credibility_tier FROM td),
sc AS (SELECT *, CASE credibility_tier WHEN 1 THEN 2.0 WHEN 2 THEN 1.5 WHEN 3 THEN 1.0 ELSE 0.7 END::DOUBLE AS credibility_weight, coalesce(nullif(trim(regexp_extract(title, '^\\[(.+?)\\]\\s+', 1)), ''), 'unknown') AS source_label,
  CASE lower(connector) WHEN 'reliefweb' THEN 1.35::DOUBLE + 0.1::DOUBLE WHEN 'un_humanitarian_feeds' THEN 1.3::DOUBLE + 0.1::DOUBLE WHEN 'government_feeds' THEN 1.15 WHEN 'ngo_feeds' THEN 1.1 WHEN 'local_news_feeds' THEN 0.95 ELSE 1.0 END::DOUBLE AS cw FROM ti),
se AS (SELECT *, round_even(((corroboration_sources + facet_country + facet_disaster_type + 0.5::DOUBLE * facet_connector) * cw * credibility_weight)::STRING::DECIMAL(38, 15), 3)::DOUBLE AS graph_score FROM sc WHERE disaster_type IN ('flood', 'drought'))""".replace("\\\\", "\\")
_SCORED = f"{EV}, {_FACETS}, {_TIERED}"
_ORDER = "graph_score DESC, severity DESC, published_at DESC, id DESC"


def _scored(spark, sf_dir):
    return evidence.score_evidence(events(spark, sf_dir), [], ["flood", "drought"])


@query("sl03_graph_score", f"WITH {_SCORED} SELECT id, graph_score, credibility_tier, credibility_weight, source_label FROM se")
def sl03(spark, sf_dir):
    return _scored(spark, sf_dir).select("id", "graph_score", "credibility_tier", "credibility_weight", "source_label")


@query("sl01_top_evidence", f"WITH {_SCORED} SELECT id, graph_score FROM se ORDER BY {_ORDER} LIMIT 60")
def sl01(spark, sf_dir):
    return evidence.top_evidence(_scored(spark, sf_dir), 60).select("id", "graph_score")


@query("wn06_single_cap", f"WITH {_SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY connector ORDER BY {_ORDER}) AS n FROM se) SELECT id, connector, graph_score FROM r WHERE n <= 7 ORDER BY {_ORDER} LIMIT 40")
def wn06(spark, sf_dir):
    return evidence.capped(_scored(spark, sf_dir), "connector", 7, 40).select("id", "connector", "graph_score")


@query("sl02_balanced")
def sl02(spark, sf_dir):
    return evidence.balanced(_scored(spark, sf_dir), 40, ["NATION_1", "NATION_2", "NATION_3"], 4, 9, 5).select("id", "connector", "country", "graph_score")


@query("sl04_fallback", f"WITH {EV} SELECT id, corroboration_sources::DOUBLE AS graph_score FROM ev ORDER BY id DESC LIMIT 25")
def sl04(spark, sf_dir):
    facts = events(spark, sf_dir)
    return evidence.with_fallback(evidence.score_evidence(facts, ["nowhere"], []), facts, 25).select("id", "graph_score")


@query("sl05_first_entries", f"WITH {EV}, r AS (SELECT id, connector, row_number() OVER (PARTITION BY connector ORDER BY id) AS n FROM ev) SELECT id, connector FROM r WHERE n <= 3")
def sl05(spark, sf_dir):
    from tidemark.sources.feeds import first_entries

    return first_entries(events(spark, sf_dir).select("id", "connector"), "connector", "id", 3)


@query("ag11_selection_counts", f"WITH {_SCORED} SELECT 'country' AS facet, country AS value, count(*) AS selected FROM se GROUP BY country UNION ALL SELECT 'connector', connector, count(*) FROM se GROUP BY connector UNION ALL SELECT 'source_type', source_type, count(*) FROM se GROUP BY source_type UNION ALL SELECT 'credibility_tier', credibility_tier::STRING, count(*) FROM se GROUP BY credibility_tier")
def ag11(spark, sf_dir):
    return evidence.selection_counts(_scored(spark, sf_dir), "country", "connector", "source_type", "credibility_tier")


@query("ag12_tier_distribution", f"WITH {_SCORED} SELECT count(*) FILTER (credibility_tier = 1) AS tier_1, count(*) FILTER (credibility_tier = 2) AS tier_2, count(*) FILTER (credibility_tier = 3) AS tier_3, count(*) FILTER (credibility_tier = 4) AS tier_4 FROM se")
def ag12(spark, sf_dir):
    return evidence.tier_distribution(_scored(spark, sf_dir))


_DOMAINS = "dm AS (SELECT regexp_extract(lower(url), '^https://([^/]+)', 1) AS domain, count(*) AS items FROM ev GROUP BY ALL)"


@query("ag13_domain_counts", f"WITH {EV}, {_DOMAINS} SELECT * FROM dm")
def ag13(spark, sf_dir):
    return evidence.domain_counts(events(spark, sf_dir), F.col("url"))


@query("ag14_hhi", f"WITH {EV}, d AS (SELECT connector, country, count(*) AS items FROM ev GROUP BY ALL), s AS (SELECT connector, sum(items)::DOUBLE AS t, sum(items::DOUBLE * items) AS q FROM d GROUP BY connector) SELECT connector, q / (t * t) AS hhi FROM s")
def ag14(spark, sf_dir):
    counts = events(spark, sf_dir).groupBy("connector", "country").agg(F.count(F.lit(1)).alias("items"))
    return evidence.diversity(counts, ["connector"], "items")


@query("ag15_top_labels", f"WITH {EV}, c AS (SELECT country, count(*) AS n FROM ev GROUP BY country ORDER BY n DESC, country LIMIT 4) SELECT string_agg(country || ' (' || n::STRING || ')', ', ' ORDER BY n DESC, country) AS labels FROM c")
def ag15(spark, sf_dir):
    return evidence.top_labels(events(spark, sf_dir).groupBy("country").agg(F.count(F.lit(1)).alias("n")), "country", "n", 4)


@query("wn01_citation_numbers", f"WITH {EV}, f AS (SELECT trim(url) AS url, min(id) AS m FROM ev GROUP BY ALL) SELECT url, row_number() OVER (ORDER BY m)::BIGINT AS n FROM f")
def wn01(spark, sf_dir):
    return evidence.citation_numbers(events(spark, sf_dir), "url", "id")


@query("sc33_citation_ref", f"WITH {EV}, f AS (SELECT url, min(id) AS m FROM ev WHERE id % 2 = 0 GROUP BY ALL), n AS (SELECT url, row_number() OVER (ORDER BY m) AS n FROM f) SELECT id, coalesce('[' || n::STRING || ']', '[unavailable]') AS ref FROM ev LEFT JOIN n ON ev.url = n.url")
def sc33(spark, sf_dir):
    facts = events(spark, sf_dir).select("id", "url")
    return evidence.citation_refs(facts, evidence.citation_numbers(facts.filter("id % 2 = 0"), "url", "id"), "url").select("id", "ref")


@query("wn08_batches", f"WITH {EV}, r AS (SELECT connector, id, (row_number() OVER (PARTITION BY connector ORDER BY id) - 1) // 15 AS batch FROM ev) SELECT connector, batch::BIGINT AS batch, min(id) AS first_id, count(*)::INT AS members FROM r GROUP BY ALL")
def wn08(spark, sf_dir):
    return evidence.batches(events(spark, sf_dir), "connector", "id").select("connector", "batch", F.get("members", 0).alias("first_id"), F.size("members").alias("members"))


_ITEMS = "it AS (SELECT *, id AS ord, concat(country, ' flood situation ', CAST(id % 40 AS STRING)) AS t FROM ev), bl AS (SELECT *, lower(t) AS nt FROM it)"


def _items(spark, sf_dir):
    facts = events(spark, sf_dir)
    return facts.select(
        F.col("id").alias("ord"), "connector", "source_type", "url", F.concat("country", F.lit(" flood situation "), (F.col("id") % 40).cast("string")).alias("title"), "text", "published_at", "country", "disaster_type", F.lit("").alias("country_iso3")
    )


_CLUSTERS = """cl AS (SELECT *, min(ord) OVER (PARTITION BY country, disaster_type, nt) AS cluster, CASE source_type WHEN 'official' THEN 3 WHEN 'humanitarian' THEN 2 WHEN 'news' THEN 1 ELSE 0 END AS rank,
  CASE WHEN regexp_matches(lower(t || ' ' || text), 'evacuation|mass casualty|catastrophic|state of emergency') THEN 4 WHEN regexp_matches(lower(t || ' ' || text), 'fatal|deaths|major|severe|widespread') THEN 3 WHEN regexp_matches(lower(t || ' ' || text), 'warning|alert|watch|advisory') THEN 2 ELSE 1 END AS lv FROM bl),
pr AS (SELECT country, disaster_type, cluster, arg_max(ord, (rank, length(text), -ord)) AS primary_ord, count(*) AS sources, count(DISTINCT connector) AS connectors, count(DISTINCT source_type) AS types, max(rank) AS strongest, max(lv) AS base FROM cl GROUP BY ALL),
cf AS (SELECT *, CASE WHEN (strongest = 3 AND connectors >= 2) OR connectors - 1 + types - 1 + greatest(0, strongest - 1) >= 4 THEN 'high' WHEN connectors - 1 + types - 1 + greatest(0, strongest - 1) >= 2 THEN 'medium' WHEN strongest = 3 THEN 'high' WHEN strongest >= 1 THEN 'medium' ELSE 'low' END AS confidence FROM pr),
sv AS (SELECT *, CASE WHEN confidence = 'low' AND base >= 3 AND connectors < 2 THEN base - 1 WHEN confidence = 'high' AND base = 2 AND connectors >= 3 THEN 3 ELSE base END AS level FROM cf)"""


def _clusters(spark, sf_dir):
    return dedupe.primaries(dedupe.cluster(_items(spark, sf_dir), threshold=1.0))


@query("dd02_exact_clusters", f"WITH {EV}, {_ITEMS}, {_CLUSTERS} SELECT ord, cluster FROM cl")
def dd02x(spark, sf_dir):
    return dedupe.cluster(_items(spark, sf_dir), threshold=1.0).select("ord", "cluster")


@query("dd02_greedy_clusters")
def dd02(spark, sf_dir):
    return dedupe.cluster(_items(spark, sf_dir)).select("ord", "cluster")


@query("dd04_primary", f"WITH {EV}, {_ITEMS}, {_CLUSTERS} SELECT cluster, country, disaster_type, primary_ord FROM pr")
def dd04(spark, sf_dir):
    return _clusters(spark, sf_dir).select("cluster", "country", "disaster_type", F.col("primary.ord").alias("primary_ord"))


@query("dd05_corroboration", f"WITH {EV}, {_ITEMS}, {_CLUSTERS} SELECT cluster, country, disaster_type, sources, connectors, types FROM pr")
def dd05(spark, sf_dir):
    return _clusters(spark, sf_dir).select("cluster", "country", "disaster_type", F.col("corroboration_sources").alias("sources"), F.col("corroboration_connectors").alias("connectors"), F.col("corroboration_source_types").alias("types"))


@query("dd06_calibration", f"WITH {EV}, {_ITEMS}, {_CLUSTERS} SELECT cluster, country, disaster_type, confidence, CASE level WHEN 1 THEN 'low' WHEN 2 THEN 'medium' WHEN 3 THEN 'high' ELSE 'critical' END AS severity FROM sv")
def dd06(spark, sf_dir):
    confidence = dedupe.calibrated_confidence()
    return _clusters(spark, sf_dir).select("cluster", "country", "disaster_type", confidence.alias("confidence"), dedupe.calibrated_severity(confidence).alias("severity"))


_HASHED = "hs AS (SELECT sha256(concat(lower(pr.country), '|', pr.disaster_type, '|', bl.nt, '|', bl.published_at)) AS event_id, pr.cluster AS ord, bl.t AS title, pr.country, pr.sources FROM pr JOIN bl ON bl.ord = pr.primary_ord), ee AS (SELECT event_id, min(ord) AS ord, arg_min(title, ord) AS title, arg_min(sources, ord) AS sources FROM hs GROUP BY event_id)"


def _events_of(spark, sf_dir):
    return dedupe.events_of(_clusters(spark, sf_dir))


def _titles_of(spark, sf_dir):
    """What the states of events are told from; written, for they are read several times and each would cluster all items anew."""
    return written(dedupe.events_of(_clusters(spark, sf_dir), "ord", "ord", "title"), "events")


@query("dd08_event_dedupe", f"WITH {EV}, {_ITEMS}, {_CLUSTERS}, {_HASHED} SELECT event_id, ord, title, sources AS corroboration_sources FROM ee")
def dd08(spark, sf_dir):
    return _events_of(spark, sf_dir).select("event_id", "ord", "title", "corroboration_sources")


@query("dd09_status_exact", f"WITH {EV}, {_ITEMS}, {_CLUSTERS}, {_HASHED}, l AS (SELECT *, min(ord) OVER (PARTITION BY lower(title)) AS first FROM ee) SELECT event_id, CASE WHEN ord % 3 = 0 THEN 'unchanged' WHEN first < ord THEN 'updated' ELSE 'new' END AS status FROM l")
def dd09x(spark, sf_dir):
    found = _titles_of(spark, sf_dir)
    return dedupe.with_status(found, found.filter("ord % 3 = 0"), threshold=0.9999).select("event_id", "status")


@query("dd09_status")
def dd09(spark, sf_dir):
    found = _titles_of(spark, sf_dir)
    return dedupe.with_status(found, found.filter("ord % 3 = 0")).select("event_id", "status")


@query("dd10_hash_set", f"WITH {EV}, {_ITEMS}, {_CLUSTERS}, {_HASHED} SELECT DISTINCT event_id FROM hs")
def dd10(spark, sf_dir):
    return dedupe.hash_set(_events_of(spark, sf_dir))


@query("jn04_unchanged", f"WITH {EV}, {_ITEMS}, {_CLUSTERS}, {_HASHED} SELECT event_id, ord FROM ee WHERE event_id IN (SELECT event_id FROM ee WHERE ord % 3 = 0)")
def jn04(spark, sf_dir):
    found = _titles_of(spark, sf_dir)
    return found.select("event_id", "ord").join(found.filter("ord % 3 = 0").select("event_id"), "event_id", "left_semi")


@query("jn05_title_clusters_native")
def jn05(spark, sf_dir):
    return dedupe.cluster(_items(spark, sf_dir), threshold=0.9, exact_ratio=False).select("ord", "cluster")


@query("jn06_updated")
def jn06(spark, sf_dir):
    return dedupe.updated_events(_titles_of(spark, sf_dir))


@query("wn07_first_by_key", f"WITH {EV}, r AS (SELECT id, url, row_number() OVER (PARTITION BY url ORDER BY id) AS n FROM ev) SELECT id, url FROM r WHERE n = 1")
def wn07(spark, sf_dir):
    return dedupe.first_by_key(events(spark, sf_dir).select("id", "url"), ["url"], "id")


@query("so03_distinct_hashes", f"WITH {EV} SELECT DISTINCT url FROM ev")
def so03(spark, sf_dir):
    return events(spark, sf_dir).select("url").distinct()


@query("ag32_pilot", f"WITH {_QUALITY}, {TM}, {_AG02} SELECT q.events_analyzed, q.duplicate_rate_estimate, q.traceable_rate, max(hh.failure_rate) AS worst, count(*) AS connectors FROM q, hh GROUP BY ALL")
def ag32(spark, sf_dir):
    worst = health.connector_health(telemetry(spark, sf_dir)).agg(F.max("failure_rate").alias("worst"), F.count(F.lit(1)).alias("connectors"))
    return _quality(spark, sf_dir).select("events_analyzed", "duplicate_rate_estimate", "traceable_rate").crossJoin(F.broadcast(worst))  # one row each
