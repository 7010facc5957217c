"""Markdown from small aggregates (RN01 to RN05). Rows are formatted in Spark; only the finished lines of a report come to the driver."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.dims import TEMPLATE
from tidemark.operators.classify import tier_label
from tidemark.operators.evidence import citation_numbers, citation_refs
from tidemark.sources.shared import written


def table_rows(rows: DataFrame, *columns: str) -> DataFrame:
    """RN04: one pipe-table line a row; numbers with thousands separators, nulls as a dash."""
    cells = [F.coalesce(F.format_number(c, 0) if rows.schema[c].dataType.typeName() in ("integer", "long") else F.col(c).cast("string"), F.lit("—")) for c in columns]
    return rows.select(*rows.columns, F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def headed(name: str, columns: list[str], lines: list[str]) -> str:
    head = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join([f"## {name}", "", *(head + lines if lines else ["No data."]), ""])


def incident(evidence: DataFrame, numbers: DataFrame, url: str = "url") -> DataFrame:
    """RN01: the block of each evidence row, with its citation."""
    block = F.concat(
        F.col("rank").cast("string"), F.lit(". **"), F.col("title"), F.lit("**\n   - "), F.col("country"), F.lit(", "), F.col("disaster_type"), F.lit(", severity "), F.col("severity"), F.lit(", confidence "),
        F.col("confidence"), F.lit(", "), tier_label(F.col("credibility_tier")), F.lit("\n   - "), F.col("summary"), F.lit("\n   - Citation: "), F.col("ref"),
    )
    return citation_refs(evidence, numbers, url).select("rank", block.alias("block"))


def long_report(evidence: DataFrame, title: str, most: int = 60, template: dict = TEMPLATE) -> str:
    """RN01: the report of the ranked evidence (rank, title, country, ...), or the one that says there is none.

    All that comes to the driver are the ``most`` rows at most and what they add up to. Headings are those of the template.
    """
    name = template["sections"]
    chosen = evidence.filter(F.col("rank") <= most)
    numbers = citation_numbers(chosen, "url", "rank")
    blocks = [r.block for r in incident(chosen, numbers).orderBy("rank").collect()]
    if not blocks:
        return f"# {title}\n\nNo evidence found for selected filters and cycles.\n"
    links = [f"{r.n}. {r.url}" for r in numbers.orderBy("n").collect()]
    counts = chosen.groupBy("connector").agg(F.count(F.lit(1)).alias("items"), F.min("credibility_tier").alias("tier")).orderBy(F.desc("items"), "connector")
    sources = [r.line for r in table_rows(counts, "connector", "items", "tier").collect()]
    risks = chosen.filter(F.col("severity").isin("high", "critical")).groupBy("country").agg(F.count(F.lit(1)).alias("severe")).orderBy(F.desc("severe"), "country")
    parts = [
        f"# {title}", "", f"## {name['executive_summary']}", "", f"{len(blocks)} incidents from {len(links)} sources. [1]", "", f"## {name['incident_highlights']}", "", *blocks, "",
        headed(name["source_reliability"], ["Connector", "Items", "Tier"], sources), headed(name["risk_outlook"], ["Country", "Severe incidents"], [r.line for r in table_rows(risks, "country", "severe").collect()]),
        f"## {name['method']}", "", "Ranked by corroboration, source weight and credibility.", "", f"## {name['citations']}", "", *links, "",
    ]
    return "\n".join(parts)


def analysis_lines(
    event: str, national: DataFrame, admin1: DataFrame, admin2: DataFrame, sectors: DataFrame, by_area: DataFrame, constraints: DataFrame, risks: DataFrame, annex: DataFrame, sources: DataFrame, most: int = 20, first: int = 0
) -> DataFrame:
    """RN02, RN03, RN05: (part, place, text), the lines of the situation analysis from its aggregates.

    national (figure_key, value, as_of, source), admin1 (name, impact_count, max_severity, districts), admin2 (geo_key, parent,
    impact_count, max_severity), sectors (need_type, needs, max_severity, areas), by_area (need_type, geo_area, needs,
    max_severity), constraints (snippet, first), risks (hazard_name, horizon, event_id), annex (admin1, districts), sources (n,
    url). No line comes to the driver. Lists of constraints have the ``most`` first ones, of areas in need the most frequent.
    Sections before the part ``first`` are left out. Aggregates and lines are written once, for the lines, their count and their places each read them.
    """
    spark = national.sparkSession
    place = lambda c: F.lpad(F.col(c).cast("string"), 12, "0")
    fixed: list[tuple[int, str, str]] = []
    parts: list[DataFrame] = []

    def add(part: int, heading: str, lines: Callable[[], DataFrame], columns: list[str] | None = None) -> None:
        if part < first:
            return
        fixed.append((part, " 0", f"## {heading}\n"))
        if columns:
            fixed.append((part, " 1", "| " + " | ".join(columns) + " |\n|" + "---|" * len(columns)))
        own = written(lines().select(F.lit(part).alias("part"), F.concat(F.lit("+"), "place").alias("place"), "text"), "lines")
        none = own.agg(F.count(F.lit(1)).alias("n")).filter("n = 0").select(F.lit(part), F.lit("+"), F.lit("No data."))
        parts.extend([own, none])
        fixed.append((part, "~", ""))

    def table(rows: DataFrame, order: Column, *columns: str) -> DataFrame:
        return table_rows(rows.withColumn("place", order), *columns).select("place", F.col("line").alias("text"))

    def summary() -> DataFrame:
        counts = national.agg(F.count(F.lit(1)).alias("f")).crossJoin(F.broadcast(admin1.agg(F.count(F.lit(1)).alias("a"))))  # one row each
        return counts.select(F.lit("0").alias("place"), F.concat(F.col("f").cast("string"), F.lit(" kinds of figures in "), F.col("a").cast("string"), F.lit(" areas. [1]\nFigures are the largest reported for each area. [1]")).alias("text"))

    def sector(key: str) -> DataFrame:
        line = F.concat(F.col("needs").cast("string"), F.lit(" statements, phase "), F.col("max_severity").cast("string"), F.lit(" at most, most of them in "), F.col("top"), F.lit("."))
        return named.filter(F.col("need_type") == key).select(F.lit("0").alias("place"), line.alias("text"))

    sectors = written(sectors.select("need_type", "needs", "max_severity"), "sectors")
    if first <= 0:
        fixed.append((0, "0", f"# Situation Analysis: {event}\n"))
    if first < 20:
        national, admin1 = written(national, "national"), written(admin1, "admin1")
        worst = by_area.groupBy("need_type").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("needs")).alias("k"), F.col("geo_area").alias("area")))), 1, most).alias("top"))
        named = written(sectors.join(worst, "need_type", "left").withColumn("top", F.array_join(F.transform("top", lambda x: F.concat(x["area"], F.lit(" ("), (-x["k"]).cast("string"), F.lit(")"))), ", ")), "named")
    add(1, "Executive Summary", summary)
    add(2, "National Impact Overview", lambda: table(national, F.col("figure_key"), "figure_key", "value", "as_of", "source"), ["Category", "Figure", "As of", "Source"])
    add(3, "Province-Level Impact", lambda: table(admin1, F.col("name"), "name", "impact_count", "max_severity", "districts"), ["Area", "Impacts", "Severity", "Districts"])
    add(4, "District-Level Impact", lambda: table(admin2, F.concat_ws("/", "parent", "geo_key"), "parent", "geo_key", "impact_count", "max_severity"), ["Area", "District", "Impacts", "Severity"])
    for i, (heading, key) in enumerate(SECTORS.items()):
        add(5 + i, heading, partial(sector, key))
    add(20, "Access Constraints", lambda: constraints.orderBy("first", "snippet").limit(most).select(F.concat(place("first"), "snippet").alias("place"), F.concat(F.lit("- "), "snippet").alias("text")))
    add(21, "Outstanding Needs", lambda: sectors.select(F.lpad((F.lit(10**11) - F.col("needs")).cast("string"), 12, "0").alias("place"), F.concat(F.lit("- "), "need_type", F.lit(": "), F.col("needs").cast("string")).alias("text")))
    ahead = risks.groupBy("hazard_name", "horizon").agg(F.count(F.lit(1)).alias("n"))
    add(22, "Forecast", lambda: ahead.select(F.concat_ws("/", "horizon", "hazard_name").alias("place"), F.concat(F.lit("- "), "hazard_name", F.lit(", next "), "horizon", F.lit(": "), F.col("n").cast("string"), F.lit(" statements")).alias("text")))
    add(23, "Annex", lambda: annex.select(F.col("admin1").alias("place"), F.concat(F.lit("- "), "admin1", F.lit(": "), "districts").alias("text")))
    add(24, "Sources and References", lambda: sources.select(place("n").alias("place"), F.concat(F.col("n").cast("string"), F.lit(". "), "url").alias("text")))
    out = spark.createDataFrame(fixed, "part int, place string, text string")
    for lines in parts:
        out = out.union(lines)
    return out


#: Headings of the sectors' sections, and what the need types are called.
SECTORS = {"Shelter": "shelter", "WASH": "wash", "Health": "health", "Food Security": "food_security", "Protection": "protection", "Education": "education"}


def document(lines: DataFrame) -> DataFrame:
    """RN02: one row with the markdown of (part, place, text), for a report that is scored or shown as a whole; ``write_document`` is for any length."""
    every = F.sort_array(F.collect_list(F.struct("part", "place", "text")))
    return lines.groupBy().agg(F.array_join(F.transform(every, lambda x: x["text"]), "\n").alias("markdown"))


def write_document(lines: DataFrame, path: str) -> None:
    """RN02, SNK04: (part, place, text) as text files that are the document when they are read in order of their names, each written by its own task.

    The lines are range-partitioned in their order, so a task holds a range of them. A manifest tells, for each file, its lines and how
    many come before it.
    """
    spark = lines.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = lines.repartitionByRange(ranges, "part", "place", "text").sortWithinPartitions("part", "place", "text")
    ordered.select(F.col("text").alias("value")).write.mode("overwrite").text(f"{path}/text")
    counts = spark.read.text(f"{path}/text").groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("lines"))
    before = F.sum("lines").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1))  # a row a file
    counts.withColumn("before", F.coalesce(before, F.lit(0))).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """(n, text): the lines of a written document with their numbers, from 0 on, counted in each file by itself."""
    manifest = spark.read.schema("file string, lines long, before long").json(f"{path}/manifest")
    text = spark.read.text(f"{path}/text").select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("text"))
    local = F.row_number().over(W.partitionBy("file").orderBy("block", "at")) - 1
    return text.withColumn("local", local).join(manifest, "file").select((F.col("before") + F.col("local")).alias("n"), "text")


def percent(part: Column, whole: Column) -> Column:
    return F.concat(F.bround(100 * part / F.greatest(whole, F.lit(1)), 1).cast("string"), F.lit("%"))
