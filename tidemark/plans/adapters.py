"""The pipeline's tables made from the benchmark tables, by expressions that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def case(number: str, *values: str) -> str:
    """CASE number % n WHEN 0 THEN ... over string literals."""
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values[:-1]))
    return f"CASE {number} % {len(values)} {whens} ELSE '{values[-1]}' END"


CONNECTORS = ("reliefweb", "un_humanitarian_feeds", "government_feeds", "ngo_feeds", "local_news_feeds", "BBC", "other_feed")
HAZARD_LIST = ("flood", "earthquake", "cyclone/storm", "drought", "conflict emergency")
_A, _B = "CAST(o_custkey % 9000 AS STRING)", "CAST(o_orderkey % 120 AS STRING)"
TEXT = f"""concat(n_name, ' ', CASE o_orderkey % 6
  WHEN 0 THEN concat('flood: at least ', {_A}, ' people displaced and ', {_B}, ' houses damaged. Storm surge and flash flood reported; state of emergency.')
  WHEN 1 THEN concat('severe earthquake kills ', {_B}, '. Hospital and bridge destroyed; ', {_A}, ' injured. Government and Red Cross respond.')
  WHEN 2 THEN concat('cyclone warning: ', {_A}, ' families evacuated, road access cut, shelter and food needed this week.')
  WHEN 3 THEN concat('drought outlook: food insecurity expected, crop failure; 2,', {_B}, ' children affected.')
  WHEN 4 THEN concat('armed clashes and shelling: ', {_B}, ' killed, 1,', {_B}, ' displaced; UNICEF and WFP bring medicine and water.')
  ELSE concat('market and supply chain recovering; ', {_B}, ' schools open again.') END)"""

EVENT = {
    "id": "o_orderkey",
    "cycle_id": "CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT)",
    "event_id": "concat('e', CAST(o_orderkey AS STRING))",
    "connector": case("o_custkey", *CONNECTORS),
    "source_type": case("o_orderkey", "official", "humanitarian", "news", "social"),
    "url": f"concat('https://', {case('o_orderkey', 'reliefweb.int', 'www.bbc.com', 'news.example.org', 'fews.net', 'unocha.org', 'Blog.example.net:8080')}, '/e/', CAST(o_orderkey % 3000 AS STRING))",
    "title": f"concat({case('o_custkey', '[Wire] ', '[Desk] ', '')}, n_name, ' ', {case('o_orderkey', 'Flood', 'Earthquake', 'Cyclone', 'Drought', 'Conflict')}, ' update ', CAST(o_orderkey % 97 AS STRING))",
    "country": "n_name",
    "disaster_type": case("o_orderkey", *HAZARD_LIST),
    "severity": case("(o_custkey + o_orderkey)", "low", "medium", "high", "critical"),
    "confidence": case("o_orderkey", "low", "medium", "high"),
    "status": case("o_orderkey", "new", "updated", "new", "unchanged", "new"),
    "llm_enriched": "o_orderkey % 3 = 0",
    "n_citations": "CAST(o_orderkey % 4 AS INT)",
    "published_at": "CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END",
    "corroboration_sources": "CAST(o_orderkey % 5 + 1 AS BIGINT)",
    "summary": f"concat('Update: ', {TEXT})",
    "text": TEXT,
}
EVENT_FROM = "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"

TELEMETRY = {
    "id": "event_id",
    "cycle_id": "CAST(day(ts) AS BIGINT)",
    "connector": "event_type",
    "source_url": "concat('u', CAST(user_id % 200 AS STRING))",
    "source_name": "concat('Source ', CAST(user_id % 200 AS STRING))",
    "status": case("event_id", "ok", "empty", "failed", "skipped", "error", "recovered", "ok"),
    "method": case("event_id", "html", "pdf", ""),
    "char_count": "CAST(event_id % 1000 - 100 AS INT)",
    "duration_ms": "CAST(event_id % 700 AS INT)",
    "error": "CASE WHEN event_id % 7 IN (2, 4) THEN concat('timeout after ', CAST(event_id % 13 AS STRING), ' s') ELSE '' END",
    "attempted_sources": "CAST(event_id % 4 AS INT)",
    "healthy_sources": "CAST(event_id % 3 AS INT)",
    "failed_sources": "CAST(event_id % 2 AS INT)",
    "fetched_count": "CAST(event_id % 20 AS INT)",
    "matched_count": "CAST(event_id % 5 AS INT)",
    "freshness": case("(event_id + user_id)", "stale", "stale", "fresh", "unknown", "stale"),
    "llm_attempted": "CAST(event_id % 6 AS INT)",
    "llm_fallback": "CAST(event_id % 2 AS INT)",
    "llm_insufficient_text": "CAST(event_id % 3 AS INT)",
    "llm_provider_error": "CAST(event_id % 5 AS INT)",
    "llm_validation_fail": "CAST(event_id % 4 AS INT)",
}


def _sql(columns: dict[str, str], source: str) -> str:
    return "SELECT " + ", ".join(f"{e} AS {n}" for n, e in columns.items()) + f" FROM {source}"


#: CTEs for the oracles.
EV = f"ev AS ({_sql(EVENT, EVENT_FROM)})"
TM = f"tm AS ({_sql(TELEMETRY, 'events')})"
CYCLES = "cy AS (SELECT cycle_id, sum(corroboration_sources % 3)::BIGINT AS llm_attempted, sum(corroboration_sources % 2)::BIGINT AS llm_fallback, count(*) FILTER (id % 7 = 0)::BIGINT AS llm_insufficient_text, count(*) FILTER (id % 9 = 0)::BIGINT AS llm_provider_error, count(*) FILTER (id % 8 = 0)::BIGINT AS llm_validation_fail FROM ev GROUP BY cycle_id)"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in the shape of the pipeline, one an order."""
    orders, customer, nation = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))  # nation has a row a country
    made = joined.select(*[F.expr(e).alias(n) for n, e in EVENT.items()])
    return made.withColumn("citations", F.array_repeat(F.lit("c"), F.col("n_citations")))


def text_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose text is made once a row: behind a generator, for else the optimizer would write its long expression into every place that reads it."""
    return events(spark, sf_dir).select("*", F.explode(F.array("text")).alias("_text")).drop("text").withColumnRenamed("_text", "text")


def cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a cycle with its counters."""
    return events(spark, sf_dir).groupBy("cycle_id").agg(
        F.sum(F.col("corroboration_sources") % 3).alias("llm_attempted"), F.sum(F.col("corroboration_sources") % 2).alias("llm_fallback"), F.count_if(F.col("id") % 7 == 0).alias("llm_insufficient_text"),
        F.count_if(F.col("id") % 9 == 0).alias("llm_provider_error"), F.count_if(F.col("id") % 8 == 0).alias("llm_validation_fail"),
    )


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connector, feed and extraction records, one an event of the stream."""
    return read(spark, sf_dir, "events").select(*[F.expr(e).alias(n) for n, e in TELEMETRY.items()])
