"""Queries of sources, sinks and streams: each writes to a new shared folder and returns what can be read back."""

from __future__ import annotations

import contextlib
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tidemark.functions.text import event_hash
from tidemark.operators import ontology
from tidemark.plans.adapters import EV, HAZARD_LIST, TM, case, events, read, telemetry
from tidemark.plans.core_queries import _STREAK
from tidemark.plans.graph_queries import _BASE as GRAPH
from tidemark.plans.graph_queries import _impacts
from tidemark.sources import feeds, paged
from tidemark.sources.paged import Asked, FolderClient
from tidemark.sources.shared import shared_folder, written
from tidemark.sources.tables import Warehouse, schema_drift
from tidemark.streaming.freshness import streak_stream
from tidemark.streaming.polling import poll, run_cycles

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLE[name] = sql
        return function

    return add


@query("st03_streak_stream", f"WITH {TM}, {_STREAK} SELECT source_url, id AS check_id, freshness, stale_streak FROM st")
def st03(spark, sf_dir):
    """ST03: the checks as a stream of three files, state kept between them."""
    folder = shared_folder(spark, "checks")
    checks = telemetry(spark, sf_dir).select("source_url", F.col("id").alias("check_id"), "freshness")
    last = checks.agg(F.max("check_id")).first()[0] or 0
    for k in range(3):  # three files, in order of their checks
        part = checks.filter(F.floor(3 * F.col("check_id") / (last + 1)) == k)
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(checks.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    running = streak_stream(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def _item_batch(spark, sf_dir, k: int):
    """Items of a cycle: a title for each nation, of which the later cycles keep a part."""
    nation = read(spark, sf_dir, "nation").filter(F.col("n_nationkey") % (k + 1) == 0)
    return nation.select(
        F.col("n_nationkey").cast("long").alias("ord"), F.lit("c").alias("connector"), F.lit("official").alias("source_type"), F.concat(F.lit("http://x/"), "n_name").alias("url"),
        F.concat(F.lit("Flood "), F.md5("n_name")).alias("title"), F.col("n_name").alias("text"), F.array(F.col("n_name")).alias("country_candidates"), F.lit("2026-01-01").alias("published_at"),
    )


_CYCLES = "c AS (SELECT k, n_nationkey FROM nation, (SELECT unnest([0, 1, 2]) AS k) WHERE n_nationkey % (k + 1) = 0)"


def _polled(spark, sf_dir):
    """Three runs at a fixed interval, before each of which the source has a new file."""
    folder = shared_folder(spark, "cycles")
    store = Warehouse(spark, f"{folder}/store")
    countries = [r.n_name for r in read(spark, sf_dir, "nation").select("n_name").orderBy("n_nationkey").collect()]  # configuration, one row a country
    batches = iter([_item_batch(spark, sf_dir, k) for k in range(3)])

    def run():
        batch = next(batches)
        batch.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        run_cycles(spark.readStream.schema(batch.schema).parquet(f"{folder}/in"), store, countries, ["flood"], f"{folder}/cp").awaitTermination()

    poll(run, 0.1, max_runs=3)
    return store


@query("st02_cycles", f"WITH {_CYCLES} SELECT c.k::BIGINT AS cycle, CASE WHEN p.n_nationkey IS NULL THEN 'new' ELSE 'unchanged' END AS status, count(*) AS events FROM c LEFT JOIN c p ON p.k = c.k - 1 AND p.n_nationkey = c.n_nationkey GROUP BY ALL")
def st02(spark, sf_dir):
    """ST01, ST02: three polling cycles, each compared with the one before only."""
    found = spark.read.parquet(_polled(spark, sf_dir).at("events"))
    return found.groupBy(F.col("cycle_id").cast("long").alias("cycle"), "status").agg(F.count(F.lit(1)).alias("events"))


@query(
    "st07_stage_events",
    f"WITH {_CYCLES}, n AS (SELECT k, count(*) AS rows FROM c GROUP BY k), s AS (SELECT unnest(['collect', 'detect', 'persist', 'state']) AS stage, unnest([0, 1, 2, 3]) AS i) "
    "SELECT k::BIGINT AS cycle_id, (2 * i + e)::INT AS n, stage, CASE e WHEN 0 THEN 'started' ELSE 'completed' END AS status, CASE WHEN e = 1 AND i < 2 THEN rows END AS rows FROM n, s, (SELECT unnest([0, 1]) AS e)",
)
def st07(spark, sf_dir):
    """ST07: what the stages of the polling cycles did, and on how many rows."""
    events_table = spark.read.parquet(_polled(spark, sf_dir).at("stage_events"))
    return events_table.select(F.col("cycle_id").cast("long").alias("cycle_id"), "n", "stage", "status", "rows")


@query("snk01_persist_cycle", f"WITH {EV}, c AS (SELECT cycle_id, status, count(*) AS events FROM ev GROUP BY ALL), t AS (SELECT cycle_id, count(*) AS raw_items FROM ev GROUP BY ALL) SELECT cycle_id, status, events, raw_items FROM c JOIN t USING (cycle_id)")
def snk01(spark, sf_dir):
    """SNK01: all cycles written; a second time; and once more, breaking off before the last table: each counts once."""
    store = Warehouse(spark, shared_folder(spark, "store"))
    facts = events(spark, sf_dir).drop("citations", "text", "id", "n_citations", "llm_enriched")
    tables = {"cycles": facts.groupBy("cycle_id").agg(F.count(F.lit(1)).cast("int").alias("event_count")), "events": facts, "raw_items": facts.select("cycle_id", "connector", "url", "title")}
    store.persist_cycles(tables)
    store.persist_cycles(tables)
    with contextlib.suppress(AnalysisException):
        store.persist_cycles({**tables, "raw_items": facts.select("no_such_column")})
    items = store.read("raw_items").groupBy("cycle_id").agg(F.count(F.lit(1)).alias("raw_items"))
    return store.read("events").groupBy("cycle_id", "status").agg(F.count(F.lit(1)).alias("events")).join(items, "cycle_id")


@query("snk02_ontology_snapshots", f"WITH {GRAPH} SELECT 1 AS snapshot_id, count(*) AS impacts FROM ix UNION ALL SELECT 2, count(*) FROM ix JOIN ev USING (id) WHERE severity IN ('high', 'critical')")
def snk02(spark, sf_dir):
    """SNK02, SNK03: a snapshot of all impacts, and one of the severe ones, which is written twice; the newest first."""
    store = Warehouse(spark, shared_folder(spark, "snapshots"))
    every = written(_impacts(spark, sf_dir), "impacts")
    store.persist_ontology(1, {"impacts": every})
    store.persist_ontology(2, {"impacts": every})
    store.persist_ontology(2, {"impacts": every.filter("severity_phase >= 3")})
    return store.snapshots(10).select(F.col("snapshot_id").cast("int").alias("snapshot_id"), "impacts")


@query("snk05_state", f"WITH {EV} SELECT DISTINCT connector FROM ev")
def snk05(spark, sf_dir):
    """SNK05: a state table, replaced by the second write."""
    store = Warehouse(spark, shared_folder(spark, "state"))
    facts = events(spark, sf_dir)
    store.save_state("sources", facts.select("country").distinct())
    store.save_state("sources", facts.select("connector").distinct())
    return store.state("sources")


@query(
    "so06_schema_drift",
    "WITH d AS (SELECT unnest(['event_id', 'event_type', 'ts', 'user_id', 'value', 'revision']) AS c), l AS (SELECT column_name AS c FROM (DESCRIBE SELECT * FROM events)) "
    "SELECT 'missing column ' || c AS warning FROM d WHERE c NOT IN (SELECT c FROM l) UNION ALL SELECT 'undeclared column ' || c FROM l WHERE c NOT IN (SELECT c FROM d)",
)
def so06(spark, sf_dir):
    """SO06: the table of stream events against a declared schema that is another version's."""
    live = read(spark, sf_dir, "events").schema
    declared = "event_id long, event_type string, ts timestamp, user_id long, value double, revision int"
    return spark.createDataFrame([(w,) for w in schema_drift(declared, live)], "warning string")


_COLUMNS = ("id", "title", "country", "disaster_type", "published_at", "url")
_REPORT = "id long, title string, country string, disaster_type string, published_at string, url string"
_SERVED = f"sv AS (SELECT page_id AS id, concat('Report ', CAST(page_id AS STRING), ' ', n_name) AS title, n_name AS country, {case('page_id', *HAZARD_LIST)} AS disaster_type, CAST(CAST(DATE '2026-01-01' + CAST(page_id % 90 AS INT) AS DATE) AS STRING) AS published_at, url FROM pages JOIN nation ON n_nationkey = page_id % 25)"


def _served(spark, sf_dir):
    """Reports of a source behind an API: one a page of the web."""
    made = read(spark, sf_dir, "pages").join(F.broadcast(read(spark, sf_dir, "nation")), F.col("n_nationkey") == F.col("page_id") % 25)  # a row a country
    hazard = F.element_at(F.array(*[F.lit(h) for h in HAZARD_LIST]), (F.col("page_id") % len(HAZARD_LIST) + 1).cast("int"))
    published = F.date_add(F.lit("2026-01-01").cast("date"), (F.col("page_id") % 90).cast("int")).cast("string")
    return made.select(F.col("page_id").alias("id"), F.concat(F.lit("Report "), F.col("page_id").cast("string"), F.lit(" "), "n_name").alias("title"), F.col("n_name").alias("country"), hazard.alias("disaster_type"), published.alias("published_at"), "url")


def _client(folder):
    return FolderClient(folder, _COLUMNS, ("title", "url"))


@query("src04_paged_source", f"WITH {_SERVED} SELECT id, title, place FROM (SELECT *, row_number() OVER (ORDER BY id) - 1 AS place FROM sv) WHERE place < 1000")
def src04(spark, sf_dir):
    """SRC04: the first ten pages of at most 100 reports, one task each."""
    folder = shared_folder(spark, "reports")
    _served(spark, sf_dir).orderBy("id").write.parquet(folder)
    return paged.load(spark, paged.paged_source("paged_reports", _REPORT, _client(folder))).select("id", "title", "place")


_SRC06 = "country IN ('NATION_5', 'NATION_10', 'NATION_15', 'NATION_20') AND disaster_type = 'flood' AND published_at >= '2026-01-05'"


@query("src06_pushdown", f"WITH {_SERVED} SELECT id, country, published_at FROM sv WHERE {_SRC06} AND id % 2 = 0")
def src06(spark, sf_dir):
    """SRC06: country, hazard and date are asked of the source, the rest is filtered here; all that the source has of these is read."""
    folder = shared_folder(spark, "reports")
    _served(spark, sf_dir).orderBy("id").write.parquet(folder)
    source = paged.paged_source("filtered_reports", _REPORT, _client(folder), limit=None, pushed=("country", "disaster_type", "published_at"))
    return paged.load(spark, source).filter(_SRC06).filter("id % 2 = 0").select("id", "country", "published_at")


@query("src06_query_terms", f"WITH {_SERVED} SELECT id, title FROM sv WHERE contains(lower(title || ' ' || url), 'report') AND contains(lower(title || ' ' || url), 'nation_6')")
def src06t(spark, sf_dir):
    """SRC06: terms that a report must have, all of them, each asked once; all reports that have them are read."""
    folder = shared_folder(spark, "reports")
    _served(spark, sf_dir).orderBy("id").write.parquet(folder)
    asked = Asked(terms=tuple(paged.query_terms(["Report", "NATION_6", "Nation_6 "], [])))
    return paged.load(spark, paged.paged_source("searched_reports", _REPORT, _client(folder), limit=None, asked=asked)).select("id", "title")


@query(
    "src05_matched_stream",
    f"WITH {_SERVED}, h AS (SELECT quantile_disc(id, 0.5) AS half FROM sv), m AS (SELECT *, row_number() OVER (ORDER BY id) AS n FROM sv WHERE country IN ('NATION_6', 'NATION_18', 'NATION_17', 'NATION_14') OR disaster_type = 'drought') SELECT CASE WHEN id <= half THEN 0 ELSE 1 END::BIGINT AS batch, id, title FROM m, h WHERE n <= 600",
)
def src05(spark, sf_dir):
    """SRC05, ST04: the first 600 matching reports, pulled in two runs: of the first half of the table, and of the rest from where the first run ended."""
    folder = shared_folder(spark, "reports")
    every = _served(spark, sf_dir)
    half = every.selectExpr("percentile_disc(0.5) WITHIN GROUP (ORDER BY id) AS h").first().h
    source = paged.paged_source("pulled_reports", _REPORT, _client(f"{folder}/reports"))
    match = F.col("country").isin("NATION_6", "NATION_18", "NATION_17", "NATION_14") | (F.col("disaster_type") == "drought")
    for k, part in enumerate((every.filter(F.col("id") <= half), every.filter(F.col("id") > half))):
        part.orderBy("id").write.parquet(f"{folder}/reports/{k}")
        paged.pull(spark, source, match, 600, f"{folder}/kept", f"{folder}/checkpoint")
    return paged.pulled(spark, f"{folder}/kept", f"{_REPORT}, place long, error string").select("batch", "id", "title")


@query("src01_feed_files", "SELECT '[Feed] ' || n_name AS title, 'http://f/' || n_nationkey::STRING AS url FROM nation WHERE n_nationkey % 4 <> 1")
def src01(spark, sf_dir):
    """SRC01 to SRC03: entries of feed files, those without a title left out."""
    folder = shared_folder(spark, "feeds")
    title = F.when(F.col("n_nationkey") % 4 != 1, F.col("n_name")).otherwise("")
    entry = F.concat(F.lit("<item><title>"), title, F.lit("</title><link>http://f/"), F.col("n_nationkey").cast("string"), F.lit("</link></item>"))
    read(spark, sf_dir, "nation").select(entry.alias("value")).groupBy().agg(F.concat(F.lit("<rss><channel>"), F.array_join(F.sort_array(F.collect_list("value")), "\n"), F.lit("</channel></rss>")).alias("value")).write.text(folder)
    return feeds.entry_items(feeds.read_feeds(spark, folder).withColumn("name", F.lit("Feed")), "name", "feed", "news").select("title", "url")


@query(
    "src11_replay",
    "WITH i AS (SELECT n_nationkey AS k, n_name, 'Severe flood ' || md5(n_name) AS title FROM nation) SELECT n_name AS country, 'flood' AS disaster_type, 'high' AS severity, CASE WHEN k % 3 = 0 THEN 'high' ELSE 'medium' END AS confidence, "
    "CASE WHEN k % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS corroboration_sources, CASE WHEN k % 2 = 0 THEN 'unchanged' ELSE 'new' END AS status, sha256(concat(lower(n_name), '|flood|', lower(title), '|', '2026-01-0' || (k % 9 + 1)::STRING)) AS event_id FROM i",
)
def src11(spark, sf_dir):
    """SRC11: a recorded cycle run again: a flood in each nation, of which every third has a second report and every other was known."""
    folder = shared_folder(spark, "replay")
    k = F.col("n_nationkey")
    nation = read(spark, sf_dir, "nation").select("n_name", k, F.concat(F.lit("Severe flood "), F.md5("n_name")).alias("title"), F.concat(F.lit("2026-01-0"), (k % 9 + 1).cast("string")).alias("day"))
    item = lambda kind, connector: F.struct(F.lit(connector).alias("connector"), kind.alias("source_type"), F.lit("u").alias("url"), "title", F.lit("").alias("text"), F.array("n_name").alias("country_candidates"), F.col("day").alias("published_at"))
    first, second = item(F.when(k % 3 == 0, "official").otherwise("news"), "g"), item(F.lit("news"), "n")
    reported = nation.select("n_name", k, F.when(k % 3 == 0, F.array(first, second)).otherwise(F.array(first)).alias("items"), event_hash(F.col("n_name"), F.lit("flood"), F.col("title"), F.col("day")).alias("id"))
    every = lambda c: F.collect_list(F.struct("n_nationkey", c))
    by_key = lambda c: F.transform(F.sort_array(every(c)), lambda x: x[c])
    fixture = F.struct(by_key("n_name").alias("countries"), F.array(F.lit("flood")).alias("disaster_types"), F.flatten(by_key("items")).alias("items"), F.array_sort(F.collect_list(F.when(k % 2 == 0, F.col("id")))).alias("previous_hashes"))
    reported.agg(F.to_json(fixture).alias("value")).coalesce(1).write.text(folder)  # a recording is one document, here of a row a country
    return feeds.replay(spark, folder).select("country", "disaster_type", "severity", "confidence", "corroboration_sources", "status", "event_id")


@query("db01_overview", f"WITH {EV} SELECT 'country' AS part, country AS name, count(*) AS n FROM ev GROUP BY ALL UNION ALL SELECT 'severity', severity, count(*) FROM ev GROUP BY ALL UNION ALL SELECT 'connector', connector, count(*) FROM ev GROUP BY ALL")
def db01(spark, sf_dir):
    """DB01: the overview's counts from one scan of the events."""
    parts = F.array(*[F.struct(F.lit(c).alias("part"), F.col(c).alias("name")) for c in ("country", "severity", "connector")])
    return events(spark, sf_dir).select(F.explode(parts).alias("p")).groupBy("p.part", "p.name").agg(F.count(F.lit(1)).alias("n"))


@query("sc35_flags", "SELECT r_regionkey, CASE r_regionkey % 3 WHEN 0 THEN 'env' WHEN 1 THEN 'file' ELSE 'default' END AS flag FROM region")
def sc35(spark, sf_dir):
    k = F.col("r_regionkey") % 3
    return read(spark, sf_dir, "region").select("r_regionkey", feeds.flag(F.lit("default"), F.when(k <= 1, "file"), F.when(k == 0, "env")).alias("flag"))


@query("sl07_conjunction", f"WITH {EV} SELECT id FROM ev WHERE lower(connector) = 'bbc' AND severity = 'high'")
def sl07c(spark, sf_dir):
    return ontology.where_equal(events(spark, sf_dir), connector=" BBC", severity="High").select("id")


@query("src15_find_extractions", f"WITH {TM} SELECT id FROM tm WHERE connector = 'error' AND status = 'failed'")
def src15(spark, sf_dir):
    return feeds.find_extractions(telemetry(spark, sf_dir), connector="error", status="failed", cycle_id=None).select("id")


@query("so01_bag_union", f"WITH {EV} SELECT connector, 2 * count(*) AS items FROM ev GROUP BY connector")
def so01(spark, sf_dir):
    facts = events(spark, sf_dir).select("connector")
    return reduce(lambda a, b: a.unionByName(b), [facts, facts]).groupBy("connector").agg(F.count(F.lit(1)).alias("items"))
