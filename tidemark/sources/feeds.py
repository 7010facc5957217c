"""Feeds, reports and registries as DataFrames (SRC01 to SRC16, SO01, SO02).

Files of XML and JSON are read by Spark's own readers; sources behind an API are in ``paged.py``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.operators.dedupe import detect_changes

RAW_ITEM = (
    "connector string, source_type string, url string, canonical_url string, title string, published_at string, country_candidates array<string>, text string, language string, source_label string, "
    "content_mode string, content_sources array<struct<type:string,url:string>>, origin_url string"
)
ENTRY = "title string, link string, published string, updated string, summary string, _corrupt_record string"


def read_feeds(spark: SparkSession, path: str, row_tag: str = "item") -> DataFrame:
    """SRC01, SRC02: entries of RSS files with the file they came from.

    A file is text first, whose entries are cut out and parsed each by itself: a broken one keeps its text in _corrupt_record
    and costs no other, nor do bytes that are no UTF-8.
    """
    files = spark.read.option("wholetext", True).text(path).select("value", F.col("_metadata.file_path").alias("source_url"))
    entry = rf"(?is)<{row_tag}(?:\s[^>]*)?>.*?</{row_tag}\s*>"
    each = files.select("source_url", F.explode(F.regexp_extract_all("value", F.lit(entry), 0)).alias("entry"))
    parsed = F.from_xml("entry", ENTRY, {"mode": "PERMISSIVE", "rowTag": row_tag, "columnNameOfCorruptRecord": "_corrupt_record"})
    return each.select(parsed.alias("e"), "source_url").select("e.*", "source_url")


def first_entries(entries: DataFrame, by: str, order: str, limit: int) -> DataFrame:
    """SL05: the first entries of each source, one at least."""
    return entries.withColumn("_n", F.row_number().over(W.partitionBy(by).orderBy(order))).filter(F.col("_n") <= max(1, limit)).drop("_n")


def entry_items(entries: DataFrame, source_name: str, connector: str, source_type: str) -> DataFrame:
    """SRC03: entries to items; those without a title or a link go, and the source's name leads the title."""
    title, link = F.trim(F.coalesce("title", F.lit(""))), F.trim(F.coalesce("link", F.lit("")))
    return entries.filter((title != "") & (link != "")).select(
        F.lit(connector).alias("connector"), F.lit(source_type).alias("source_type"), link.alias("url"), F.concat(F.lit("["), F.col(source_name), F.lit("] "), title).alias("title"),
        F.coalesce("published", "updated").alias("published_at"), F.coalesce("summary", F.lit("")).alias("text"), F.col(source_name).alias("source_label"),
    )


REPORT = (
    "struct<fields:struct<title:string,url:string,url_alias:string,body:string,country:array<struct<name:string>>,language:array<struct<code:string>>,"
    "date:struct<original:string,created:string,changed:string>,source:array<struct<name:string>>,headline:struct<title:string,summary:string>,origin:string>>"
)


def report_items(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """SRC07: report JSON to items: the headline before the title, its summary before the body, the first three source names."""
    f = lambda name: F.col(f"_r.fields.{name}")
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    parsed = rows.withColumn("_r", F.from_json(payload, REPORT))
    text = F.concat_ws("\n\n", blank(f("headline.summary")), blank(f("body")))
    return parsed.select(
        *rows.columns, F.coalesce(blank(f("headline.title")), blank(f("title"))).alias("title"), F.coalesce(blank(f("url_alias")), blank(f("url"))).alias("url"), text.alias("text"),
        F.array_join(f("country.name"), ",").alias("countries"), F.get(f("language.code"), 0).alias("language"), F.coalesce(f("date.original"), f("date.created"), f("date.changed")).alias("published_at"),
        F.array_join(F.slice(f("source.name"), 1, 3), ", ").alias("source_label"),
    )


def union_sources(sources: dict[str, Callable[[], DataFrame]]) -> tuple[DataFrame | None, list[tuple[str, str]]]:
    """SRC09, SO01: the union of all sources that can be read, and (name, error) of those that can't."""
    frames, failed = [], []
    for name, make in sources.items():
        try:
            frames.append(make())
        except Exception as error:  # one source's failure, whatever it is, leaves the others
            failed.append((name, str(error)))
    out = None
    for frame in frames:
        out = frame if out is None else out.unionByName(frame, allowMissingColumns=True)
    return out, failed


def merge_registry(*layers: DataFrame) -> DataFrame:
    """SRC10, SO02: layers of (category, name, url, ord), first ones first; of feeds alike in name and address but for case the first stands."""
    every = None
    for i, layer in enumerate(layers):
        ranked = layer.withColumn("layer", F.lit(i))
        every = ranked if every is None else every.unionByName(ranked)
    return every.groupBy("category", F.lower("name").alias("_n"), F.lower("url").alias("_u")).agg(F.min_by(F.struct("name", "url", "layer", "ord"), F.struct("layer", "ord")).alias("f")).select("category", "f.*")


def replay(spark: SparkSession, path: str) -> DataFrame:
    """SRC11: a recorded cycle (JSON with items, countries, disaster_types, previous_hashes) run again: its events."""
    schema = f"description string, countries array<string>, disaster_types array<string>, check_interval_minutes int, previous_hashes array<string>, items array<struct<{RAW_ITEM.replace(' string', ':string').replace(' array', ':array')}>>"
    fixture = spark.read.schema(schema).json(path, multiLine=True)
    head = fixture.select("countries", "disaster_types").first()
    items = fixture.select(F.posexplode("items").alias("ord", "i")).select(F.col("ord").cast("long").alias("ord"), "i.*").withColumn("country_candidates", F.coalesce("country_candidates", F.array().cast("array<string>")))
    previous = fixture.select(F.explode("previous_hashes").alias("event_id"))
    return detect_changes(items, previous, list(head.countries), list(head.disaster_types))


def newest(rows: DataFrame, limit: int, *columns: str) -> DataFrame:
    """SRC12, SRC14: the newest rows, and of them the columns asked for."""
    out = rows.orderBy(F.desc("id")).limit(limit)
    return out.select(*columns) if columns else out


def find_events(events: DataFrame, country: str | None = None, hazard: str | None = None, limit: int | None = None) -> DataFrame:
    """SRC13: by country, and by part of the hazard's name in any case."""
    if country:
        events = events.filter(F.col("country") == country)
    if hazard:
        events = events.filter(F.lower("disaster_type").contains(hazard.lower()))
    return events if limit is None else newest(events, limit)


def find_extractions(records: DataFrame, limit: int | None = None, **equal) -> DataFrame:
    """SRC15: by any of cycle_id, connector and status."""
    for name, value in equal.items():
        if value is not None:
            records = records.filter(F.col(name) == value)
    return records if limit is None else records.limit(limit)


def feed_counts(registry: DataFrame) -> DataFrame:
    """AG30."""
    return registry.groupBy("category").agg(F.count(F.lit(1)).alias("feeds"))


def flag(default: Column, *overrides: Column) -> Column:
    """SC35: the last of default, file and environment values that is set."""
    return F.coalesce(*reversed(overrides), default)
