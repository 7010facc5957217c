"""Quality of Markdown reports as a table (doc_id, markdown): GT04 to GT07, SC30, JN10, JN11, DB05, and text features of evidence (PR20 to PR22)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.dims import ANALYSIS_FIGURES, ANALYSIS_LEAST, ANALYSIS_PASS, ANALYSIS_SECTIONS, ANALYSIS_WEIGHTS, REPORT_SECTIONS
from tidemark.functions.text import java_quote, word_total

NO_EVIDENCE = "No evidence found for selected filters and cycles."


def refs(markdown: Column) -> Column:
    """Distinct numbers in [N], sorted."""
    return F.sort_array(F.array_distinct(F.transform(F.regexp_extract_all(markdown, F.lit(r"\[(\d+)\]"), 1), lambda x: x.cast("long"))))


def listed(markdown: Column) -> Column:
    """Numbers of the lines "N. https://..."."""
    return F.transform(F.regexp_extract_all(markdown, F.lit(r"(?m)^\s*(\d+)\.\s+https?://\S+\s*$"), 1), lambda x: x.cast("long"))


def invalid_refs(markdown: Column) -> Column:
    """JN10, SO04: references that no line lists."""
    return F.array_except(refs(markdown), listed(markdown))


def validate_refs(narratives: DataFrame, valid: Column) -> DataFrame:
    """SC30: (doc_id, section, text) to the references of each section that are in ``valid`` and that are not."""
    every = F.transform(F.regexp_extract_all("text", F.lit(r"\[(\d+)\]"), 1), lambda x: x.cast("long"))
    good = F.filter(every, lambda n: F.array_contains(valid, n))
    return narratives.select("doc_id", "section", F.size(every).alias("total_refs"), F.size(good).alias("valid_refs"), (F.size(every) - F.size(good)).alias("invalid_refs"))


def strip_refs(text: Column, bad: Column) -> Column:
    """SC30: references in ``bad`` (array of long) taken out of the text, one after another."""
    return F.aggregate(F.transform(bad, lambda n: F.concat(F.lit("["), n.cast("string"), F.lit("]"))), text, lambda t, r: F.replace(t, r, F.lit("")))


def missing_sections(markdown: Column, sections: dict[str, list[str]] = REPORT_SECTIONS) -> Column:
    """JN11: required sections of which neither the name nor another stands as a heading."""
    low = F.lower(markdown)
    absent = []
    for name, others in sections.items():
        there = low.rlike("|".join(java_quote(f"## {n}".lower()) for n in [name, *others]))
        absent.append(F.when(~there, F.lit(name)))
    return F.array_compact(F.array(*absent))


def unsupported_blocks(reports: DataFrame) -> DataFrame:
    """GT04: (doc_id, blocks): incident lines "N. **...**" with no citation in their eight lines.

    The lines of one report are a short array; each is looked at with the seven that follow it, without a shuffle.
    """
    lines = F.split("markdown", r"\r?\n")
    window = lambda i: F.lower(F.array_join(F.slice(lines, i + 1, F.lit(8)), "\n"))
    is_block = lambda x: F.trim(x).rlike(r"^\d+\.\s+\*\*.+\*\*")
    bare = F.filter(lines, lambda x, i: is_block(x) & ~(window(i).contains("citation:") & window(i).rlike(r"\[\d+\]")))
    return reports.select("doc_id", F.size(bare).alias("blocks"))


def report_quality(reports: DataFrame, least_density: float = 0.005) -> DataFrame:
    """GT04: one row a report: counts, density, the floor it must reach, what is missing, and the status."""
    text = F.coalesce("markdown", F.lit(""))
    lines = F.split(text, r"\r?\n")
    window = lambda i: F.lower(F.array_join(F.slice(lines, i + 1, F.lit(8)), "\n"))
    bare = F.filter(lines, lambda x, i: F.trim(x).rlike(r"^\d+\.\s+\*\*.+\*\*") & ~(window(i).contains("citation:") & window(i).rlike(r"\[\d+\]")))
    out = reports.select(
        "doc_id", word_total(text).alias("word_count"), F.regexp_count(text, F.lit(r"https?://[^\s)]+")).alias("url_count"), F.regexp_count(text, F.lit(r"(?m)^\s*\d+\.\s+\*\*.+\*\*")).alias("incident_blocks"),
        text.contains(NO_EVIDENCE).alias("no_evidence"), F.size(missing_sections(text)).alias("missing_sections"), F.size(bare).alias("unsupported_blocks"), F.size(invalid_refs(text)).alias("invalid_refs"),
    )
    floor = F.when(F.col("incident_blocks") == 1, F.least(F.lit(least_density), F.lit(0.002))).when(F.col("incident_blocks") == 2, F.least(F.lit(least_density), F.lit(0.004))).otherwise(least_density)
    out = out.withColumn("density", F.col("url_count") / F.greatest(F.lit(1), F.col("word_count"))).withColumn("least_density", floor)
    good = (F.col("no_evidence") | (F.col("density") >= F.col("least_density"))) & (F.col("missing_sections") == 0) & (F.col("unsupported_blocks") == 0) & (F.col("invalid_refs") == 0)
    return out.withColumn("status", F.when(good, "pass").otherwise("fail")).withColumn("density", F.bround("density", 6))


def section(markdown: Column, heading: str) -> Column:
    """GT06: the text under the first "## " heading that holds ``heading``, up to the next one."""
    return F.regexp_extract(markdown, rf"(?ims)^##\s+[^\n]*{java_quote(heading)}[^\n]*\n(.*?)(?=^##\s|\z)", 1)


def narrative_sections(markdown: Column) -> Column:
    """GT06: sections with two or more lines of prose, one at least."""
    parts = F.slice(F.split(F.concat(F.lit("\n"), markdown), r"\n##\s+"), F.lit(2), F.greatest(F.lit(1), F.size(F.split(F.concat(F.lit("\n"), markdown), r"\n##\s+"))))
    prose = lambda s: F.filter(F.slice(F.split(F.trim(s), "\n"), F.lit(2), F.lit(1_000_000)), lambda x: (F.trim(x) != "") & ~F.trim(x).rlike(r"^(\||---|#)"))
    return F.greatest(F.size(F.filter(parts, lambda s: F.size(prose(s)) >= 2)), F.lit(1))


def analysis_score(reports: DataFrame) -> DataFrame:
    """GT05: six measures of a situation analysis, their weighted sum and whether it passes.

    What several measures read stands behind a generator, so that each pattern runs over a report once.
    """
    text = F.coalesce("markdown", F.lit(""))
    own_headings = F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^##\s+(.+)"), 1), lambda h: F.lower(h))
    has = lambda name: F.exists(F.col("headings"), lambda h: h.contains(name.lower())).cast("int")
    present = sum((has(name) for name in ANALYSIS_SECTIONS), F.lit(0))
    cells = r"(?m)\|\s*\*{0,2}(\w[\w\s]*?)\*{0,2}\s*\|\s*([\d,]+)\s*"
    labels = F.transform(F.regexp_extract_all(text, F.lit(cells), 1), lambda x: F.replace(F.lower(F.trim(x)), F.lit(" "), F.lit("_")))
    values = F.transform(F.regexp_extract_all(text, F.lit(cells), 2), lambda x: F.coalesce(F.try_to_number(F.replace(x, F.lit(","), F.lit("")), F.lit("9" * 18)).cast("long"), F.lit(0)))
    own_filled = F.size(F.filter(F.zip_with(labels, values, lambda a, v: a.isin(ANALYSIS_FIGURES) & (v > 0)), lambda x: x))
    own_known = F.transform(F.regexp_extract_all(section(text, "Sources and References"), F.lit(r"(?m)^\s*(\d+)(?=\.|\s*$)"), 1), lambda x: x.cast("long"))
    own_every = F.transform(F.flatten(F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d+(?:\s*,\s*\d+)*)\]"), 1), lambda g: F.split(g, r"\s*,\s*"))), lambda x: x.cast("long"))
    known, every, filled, national = F.col("known"), F.col("every"), F.col("filled"), F.col("national")
    valid = F.when(F.size(known) > 0, F.size(F.filter(every, lambda n: F.array_contains(known, n)))).otherwise(F.size(every))
    rows = F.filter(F.split(section(text, "Province-Level"), "\n"), lambda x: F.trim(x).startswith("|") & ~x.contains("---") & ~x.contains("Field") & ~x.rlike(r"^\|\s*#\s*\|"))
    date = r"(?i)\d{4}-\d{2}-\d{2}|\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\w*\s+\d{4}|(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[,.]?\s+\d{1,2}\s+\w+|\d{1,2}/\d{1,2}/\d{2,4}"
    third = lambda x: F.trim(F.coalesce(F.get(F.split(F.trim(x), r"\|"), 3), F.lit("")))
    dated_rows = F.filter(F.split(national, "\n"), lambda x: F.trim(x).startswith("|") & ~x.contains("---") & third(x).rlike(date))
    read = F.struct(
        own_headings.alias("headings"), own_filled.alias("filled"), own_known.alias("known"), own_every.alias("every"), F.size(rows).alias("rows"), section(text, "National Impact").alias("national"), narrative_sections(text).alias("narrative")
    )
    out = reports.select("doc_id", F.explode(F.array(read)).alias("_r")).select("doc_id", "_r.*").select(
        "doc_id", (present / F.lit(len(ANALYSIS_SECTIONS))).alias("section_completeness"), (filled / F.lit(len(ANALYSIS_FIGURES))).alias("key_figure_coverage"),
        F.when(F.size(every) > 0, valid / F.size(every)).otherwise(1.0).alias("citation_accuracy"), F.least(F.lit(1.0), F.size(every) / F.col("narrative")).alias("citation_density"),
        F.least(F.lit(1.0), F.col("rows") / F.lit(5)).alias("admin_coverage"),
        F.when(filled > 0, F.least(F.lit(1.0), (F.regexp_count(national, F.lit(r"(?i)as of \d{4}")) + F.size(dated_rows)) / filled)).otherwise(0.0).alias("date_attribution"),
    )
    overall = sum((F.col(k) * w for k, w in ANALYSIS_WEIGHTS.items()), F.lit(0.0))
    return out.withColumn("overall_score", F.bround(overall, 3)).withColumn("passed", F.col("overall_score") >= ANALYSIS_PASS)


def quality_table(scores: DataFrame, least: dict[str, float] = ANALYSIS_LEAST) -> DataFrame:
    """GT08: (doc_id, markdown): the verdict and a table of the measures with what each must reach."""
    number = lambda x: F.format_number(x, 2)
    rows = [F.concat(F.lit(f"| {k.replace('_', ' ').title()} | "), number(F.col(k)), F.lit(f" | {v:.2f} | "), F.when(F.col(k) >= v, "Pass").otherwise("**Fail**"), F.lit(" |")) for k, v in least.items()]
    head = F.concat(F.lit("### Quality Gate: **"), F.when(F.col("passed"), "PASS").otherwise("FAIL"), F.lit("** (score "), number(F.col("overall_score")), F.lit(")"))
    lines = [F.lit(""), F.lit("---"), F.lit(""), head, F.lit(""), F.lit("| Dimension | Score | Threshold | Status |"), F.lit("|-----------|-------|-----------|--------|"), *rows, F.lit("")]
    return scores.select("doc_id", F.concat_ws("\n", *lines).alias("markdown"))


def listing(reports: DataFrame, limit: int | None = None) -> DataFrame:
    """SL10: reports, the newest first; those changed at one time by name."""
    out = reports.orderBy(F.desc("modified"), "doc_id")
    return out if limit is None else out.limit(limit)


def section_words(reports: DataFrame, titles: list[str]) -> DataFrame:
    """GT07: (doc_id, title, words) of the lines under each heading "## title"."""
    lines = reports.select("doc_id", F.posexplode(F.split("markdown", r"\r?\n")).alias("line_no", "line"))
    heading = F.when(F.trim("line").startswith("## "), F.trim(F.substring(F.trim("line"), 4, 1_000_000)))
    upto = W.partitionBy("doc_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    under = lines.withColumn("_h", heading).withColumn("title", F.last("_h", ignorenulls=True).over(upto)).filter(F.col("_h").isNull() & F.col("title").isin(titles))
    return under.groupBy("doc_id", "title").agg(F.sum(word_total(F.col("line"))).alias("words"))


def tier_line(reports: DataFrame) -> DataFrame:
    """DB05: (tier, items) as the newest of the last five reports that states them does; reports are (doc_id, modified, markdown)."""
    pairs = lambda c, g: F.regexp_extract_all(c, F.lit(r"Tier (\d)[^:\n]*:\s*(\d+)"), g)
    last = reports.orderBy(F.desc("modified"), F.desc("doc_id")).limit(5).filter(F.size(pairs(F.col("markdown"), 1)) > 0).orderBy(F.desc("modified"), F.desc("doc_id")).limit(1)
    return last.select(F.explode(F.arrays_zip(pairs(F.col("markdown"), 1).alias("tier"), pairs(F.col("markdown"), 2).alias("items"))).alias("x")).select(F.col("x.tier").cast("int").alias("tier"), F.col("x.items").cast("long").alias("items"))


# Fixed value: what tells that a place is hard to reach.
ACCESS = re.compile(
    r"(road[s]?\s+(?:cut|block|impassable|damaged|destroy))|(bridge[s]?\s+(?:collapse|destroy|wash|damage))|(access\s+(?:restrict|limit|constrain|cut|block|hamper|difficult))|(strand|isolat|maroon|cut.off|unreachable)|(communication[s]?\s+(?:down|disrupt|cut|lost))",
    re.IGNORECASE,
)


def snippets_of(text: str | None) -> list[str]:
    """40 characters before and 80 after each sign of blocked access, each snippet once; they may overlap, which no one regular expression gives."""
    return list(dict.fromkeys(s for m in ACCESS.finditer(text or "") if (s := text[max(0, m.start() - 40) : m.end() + 80].strip())))


def access_snippets(text: Column | str) -> Column:
    """PR20."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(snippets_of)

    return F.pandas_udf(run, "array<string>")(text)


def access_constraints(evidence: DataFrame, text: str, order: str) -> DataFrame:
    """PR20: distinct snippets with the order of their first row. Rows without a sign never reach Python."""
    near = evidence.filter(F.col(text).rlike("(?i)" + ACCESS.pattern))
    return near.select(order, F.explode(access_snippets(text)).alias("snippet")).groupBy("snippet").agg(F.min(order).alias("first"))


def named_storms(evidence: DataFrame, *columns: str) -> DataFrame:
    """PR21's first pass: (name, mentions): storms called by name in any of the columns."""
    pattern = r"\b((?:[Tt]ropical )?(?:[Cc]yclone|[Ss]torm|[Hh]urricane|[Tt]yphoon))\s+([A-Z][a-z]+)"
    found = [F.zip_with(F.regexp_extract_all(c, F.lit(pattern), 1), F.regexp_extract_all(c, F.lit(pattern), 2), lambda a, b: F.initcap(F.concat_ws(" ", F.trim(a), b))) for c in columns]
    return evidence.select(F.explode(F.flatten(F.array(*found))).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("mentions"))


def event_name(evidence: DataFrame, country: str, hazard: str, *columns: str) -> DataFrame:
    """PR21: one row: the storm named most, else the hazard and the country."""
    top = named_storms(evidence, *columns).orderBy(F.desc("mentions"), "name").limit(1).agg(F.first("name").alias("n"))
    return top.select(F.coalesce("n", F.lit(f"{country.title()} {hazard.title()}" if hazard else f"{country.title()} Humanitarian Situation")).alias("event_name"))


def event_type_counts(evidence: DataFrame, text: str, keywords: dict[str, str]) -> DataFrame:
    """PR22: (event_type, texts): a text counts once for each of a type's keywords that it has."""
    low = F.lower(F.col(text))
    found = F.array_compact(F.array(*[F.when(low.contains(k), F.lit(v)) for k, v in keywords.items()]))
    return evidence.select(F.explode(found).alias("event_type")).groupBy("event_type").agg(F.count(F.lit(1)).alias("texts"))
