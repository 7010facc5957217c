"""Operator 2, quality rules with adaptive thresholds, DataFrame functions only.

Each metric of a document falls into a logarithmic bin, and the counts of bins are a quantile sketch: of fixed relative error,
with at most a few hundred bins, and merged by adding counts. One sketch is kept for each language and source; adding them up
gives those of a language and of the whole table. Thresholds are multiples of a quantile, or fences around the quartiles, of a
document's own language and source, or of the wider sketch where that has fewer than ``least_rows`` rows. They replace fixed
cutoffs: what is added to them is the error of measuring a rate in a document of so many words, and nothing else. Documents are
then filtered by a join with them.

Defined results: a null or empty text has no words and fails the base rule; a null language or source is a group of its own;
an empty table gives an empty result; repeated rows are judged alike, each by itself; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.llm.common import SPACE, materialise, table

#: The ratio of one bin's edge to the next, which is the sketch's relative error.
GAMMA = 1.02
LEAST_ROWS = 200
#: For each share: the quantile and the multiple of it that is allowed, what is counted and in what, and the words or lines of one event.
#: Symbols have their upper quartile, since junk may fill the tenths above; what else the base rule lets through may rest in a tail.
SHARES = {"symbols": (0.75, 4.0, "n_symbols", "n_words", 1.0), "repeats": (0.99, 2.0, "n_repeat_words", "n_words", 10.0), "lines": (0.99, 2.0, "n_dup_lines", "n_lines", 1.0)}
#: A share may be so many standard errors of a count over the threshold; a mean word length lies within quartile ranges and standard
#: errors of the quartiles, taking a word's length to vary by half the median.
ERRORS, LENGTH = 3.0, (4.0, 4.0)
METRICS = (*SHARES, "length")
LIMITS = (*(f"hi_{k}" for k in SHARES), "q1_length", "q2_length", "q3_length")
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def text_features(rows: DataFrame, text: Column) -> DataFrame:
    """Add the base columns, n_lines (lines with a word) and base_failed.

    A repeated 5-word window is found by its hash: the windows' hashes are sorted with their places, places whose neighbour
    has the same hash are the repeated ones, and each covers five words less those that the next one covers.
    """
    clean = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(clean, SPACE), "")
    lines = F.filter(F.split(clean, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    step1 = rows.withColumns({
        "_hashes": F.transform(words, lambda w: F.xxhash64(w)),
        "_lines": lines,
        "word_chars": F.char_length(F.regexp_replace(clean, SPACE, "")).cast("long"),
        "n_symbols": F.regexp_count(clean, F.lit(r"[#*$%&|<>]")).cast("long"),
    })
    at = lambda i, k: F.get("_hashes", i + k)
    windows = F.when(
        F.size("_hashes") >= 5, F.transform(F.sequence(F.lit(0), F.size("_hashes") - 5), lambda i: F.xxhash64(*[at(i, k) for k in range(5)]))
    ).otherwise(F.array().cast("array<bigint>"))
    step2 = step1.withColumns({
        "_windows": windows,
        "n_words": F.size("_hashes").cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
    }).drop("_lines", "_hashes")
    sorted_windows = F.when(
        F.size(F.array_distinct("_windows")) < F.size("_windows"), F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    )
    step3 = step2.withColumn("_sorted", sorted_windows).drop("_windows")
    same = lambda x, i, k: F.get("_sorted", i + k)["h"].eqNullSafe(x["h"])
    twice = F.filter("_sorted", lambda x, i: ((i > 0) & same(x, F.greatest(i, F.lit(1)), -1)) | same(x, i, 1))
    step4 = step3.withColumn("_places", F.sort_array(F.transform(twice, lambda x: x["i"]))).drop("_sorted")
    covered = F.aggregate(
        "_places",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-5).alias("end")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(5), p - a["end"])).alias("n"), p.alias("end")),
        lambda a: a["n"],
    )
    step5 = step4.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("_places")
    return step5.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def metrics() -> dict[str, Column]:
    """Whole numbers, so that every engine bins them alike."""
    words, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    of = lambda top, part, by: F.floor(top * F.col(part) / by).cast("long")
    return {"symbols": of(1000, "n_symbols", words), "repeats": of(1000, "n_repeat_words", words), "lines": of(1000, "n_dup_lines", lines), "length": of(100, "word_chars", words)}


def sketches(features: DataFrame) -> DataFrame:
    """(lang, source, metric, bin, n) over the rows that pass the base rule."""
    each = F.array(*[F.struct(F.lit(k).alias("metric"), F.when(v > 0, 1 + F.floor(F.ln(v.cast("double")) / F.ln(F.lit(GAMMA)))).otherwise(0).cast("int").alias("bin")) for k, v in metrics().items()])
    return features.filter("not base_failed").select("lang", "source", F.explode(each).alias("m")).groupBy("lang", "source", "m.metric", "m.bin").agg(F.count(F.lit(1)).alias("n"))


def fences(counts: DataFrame, by: list[str]) -> DataFrame:
    """(by..., rows and LIMITS) from the sketches merged to the groups of ``by``."""
    merged = counts.groupBy(*by, "metric", "bin").agg(F.sum("n").alias("n"))
    group = W.partitionBy(*by, "metric")
    ranked = merged.withColumn("_upto", F.sum("n").over(group.orderBy("bin"))).withColumn("_all", F.sum("n").over(group))
    value = F.when(F.col("bin") == 0, 0.0).otherwise(F.pow(F.lit(GAMMA), F.col("bin") - 0.5))
    quantile = lambda q: F.min(F.when(F.col("_upto") >= q * F.col("_all"), value))
    of = lambda k, q: F.max(F.when(F.col("metric") == k, F.col(f"_{q}")))
    marks = ranked.groupBy(*by, "metric").agg(*[quantile(q).alias(f"_{i}") for i, q in enumerate((0.25, 0.5, 0.75, 0.99))], F.max("_all").alias("rows"))
    place = {0.25: 0, 0.5: 1, 0.75: 2, 0.99: 3}
    out = [(m * of(k, place[q])).alias(f"hi_{k}") for k, (q, m, *_) in SHARES.items()] + [of("length", i).alias(f"q{i + 1}_length") for i in range(3)]
    return marks.groupBy(*by).agg(F.max("rows").alias("rows"), *out)


def thresholds(features: DataFrame, least_rows: int = LEAST_ROWS) -> DataFrame:
    """The fences that hold for each (lang, source) in ``features``; a group's own, or its language's, or the table's."""
    counts = materialise(sketches(features), "sketches")
    groups = features.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("_n")).drop("_n")
    own, lang = fences(counts, ["lang", "source"]), fences(counts, ["lang"])
    everything = fences(counts.withColumn("_t", F.lit(1)), ["_t"]).first()  # one row, of a few numbers
    joined = (
        groups.alias("g")
        .join(own.alias("o"), F.col("g.lang").eqNullSafe(F.col("o.lang")) & F.col("g.source").eqNullSafe(F.col("o.source")), "left")
        .join(lang.alias("l"), F.col("g.lang").eqNullSafe(F.col("l.lang")), "left")
    )
    level = F.when(F.col("o.rows") >= least_rows, "source").when(F.col("l.rows") >= least_rows, "lang").otherwise("all")
    pick = lambda c: F.when(F.col("_level") == "source", F.col(f"o.{c}")).when(F.col("_level") == "lang", F.col(f"l.{c}")).otherwise(F.lit(everything[c] if everything else None).cast("double")).alias(c)
    return joined.withColumn("_level", level).select("g.lang", "g.source", F.col("_level").alias("threshold_level"), *[pick(c) for c in LIMITS])


def judge(features: DataFrame, least_rows: int = LEAST_ROWS) -> DataFrame:
    """Add threshold_level and kept to a written table of features."""
    limits = materialise(thresholds(features, least_rows), "thresholds").withColumnsRenamed({"lang": "_lang", "source": "_source"})
    joined = features.join(limits, features.lang.eqNullSafe(F.col("_lang")) & features.source.eqNullSafe(F.col("_source")), "left")
    inside = F.lit(True)
    for k, (_, _, part, by, unit) in SHARES.items():
        # With no row that passed the base rule there are no thresholds, and nothing is judged by them.
        allowed = F.col(f"hi_{k}") * F.greatest(F.col(by), F.lit(1)) / F.lit(1000.0)
        inside = inside & F.coalesce(F.col(part) <= allowed + F.lit(ERRORS * unit) * F.sqrt(F.greatest(allowed / F.lit(unit), F.lit(1.0))), F.lit(True))
    ranges, errors = LENGTH
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    reach = F.lit(ranges) * (F.col("q3_length") - F.col("q1_length")) + F.lit(errors / 2) * F.col("q2_length") / F.sqrt(words)
    inside = inside & F.coalesce(metrics()["length"].between(F.col("q1_length") - reach, F.col("q3_length") + reach), F.lit(True))
    return joined.withColumn("kept", ~F.col("base_failed") & inside).drop("_lang", "_source", *LIMITS)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    columns = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), "text", "lang", "source")
    features = materialise(text_features(rows, F.col("text")).drop("text"), "quality-rows")
    return judge(features).filter("kept").select("_row.*")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    features = materialise(text_features(docs, F.col("text")).drop("text"), "quality-features")
    return judge(features).select("doc_id", *BASE, "base_failed", "kept", "n_lines", "threshold_level")


def _oracle() -> str:
    case = lambda k, v: f"SELECT doc_id, lang, source, base_failed, '{k}' AS metric, ({v})::BIGINT AS v FROM f"
    values = {"symbols": "1000 * n_symbols // greatest(n_words, 1)", "repeats": "1000 * n_repeat_words // greatest(n_words, 1)", "lines": "1000 * n_dup_lines // greatest(n_lines, 1)", "length": "100 * word_chars // greatest(n_words, 1)"}
    levels = {"own": "lang, source", "lang": "lang, NULL::VARCHAR", "all": "NULL::VARCHAR, NULL::VARCHAR"}
    limit = lambda k, q: f"max(CASE WHEN metric = '{k}' THEN {q} END)"
    limits = ", ".join([f"{m}::DOUBLE * {limit(k, 'p' + str(round(100 * q)))} AS hi_{k}" for k, (q, m, *_) in SHARES.items()] + [f"{limit('length', p)} AS q{i + 1}_length" for i, p in enumerate(("p25", "p50", "p75"))])
    allowed = lambda k, by: f"(hi_{k} * greatest({by}, 1) / 1000.0::DOUBLE)"
    fits = [f"coalesce({part} <= {allowed(k, by)} + {ERRORS * unit}::DOUBLE * sqrt(greatest({allowed(k, by)} / {unit}::DOUBLE, 1.0::DOUBLE)), true)" for k, (_, _, part, by, unit) in SHARES.items()]
    reach = f"({LENGTH[0]}::DOUBLE * (q3_length - q1_length) + {LENGTH[1] / 2}::DOUBLE * q2_length / sqrt(greatest(n_words, 1)::DOUBLE))"
    fits.append(f"coalesce({values['length']} BETWEEN q1_length - {reach} AND q3_length + {reach}, true)")
    mark = ", ".join(f"min(CASE WHEN upto >= {q}::DOUBLE * total THEN CASE WHEN bin = 0 THEN 0 ELSE pow({GAMMA}::DOUBLE, bin - 0.5::DOUBLE) END END) AS p{round(100 * q)}" for q in (0.25, 0.5, 0.75, 0.99))
    sketch = " UNION ALL ".join(f"SELECT '{n}' AS level, {c.split(',')[0]} AS lang, {c.split(',')[1]} AS source, metric, bin, sum(n) AS n FROM s GROUP BY ALL" for n, c in levels.items())
    return rf"""
WITH w AS (SELECT row_number() OVER () AS id, doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
p AS (SELECT id, unnest(range(0, len(words) - 4)) AS i, words FROM w WHERE len(words) >= 5),
g AS (SELECT id, i, array_to_string(words[i + 1:i + 5], ' ') AS gram FROM p),
r AS (SELECT id, i FROM (SELECT id, i, count(*) OVER (PARTITION BY id, gram) AS n FROM g) WHERE n > 1),
c AS (SELECT id, count(DISTINCT i + k) AS n_repeat_words FROM r, (SELECT unnest(range(0, 5)) AS k) GROUP BY id),
l AS (SELECT id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
f0 AS (SELECT w.doc_id, w.lang, w.source, len(w.words)::BIGINT AS n_words, length(array_to_string(w.words, ''))::BIGINT AS word_chars,
  length(regexp_replace(w.text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(l.ls)::BIGINT AS n_lines,
  (len(l.ls) - len(list_distinct(l.ls)))::BIGINT AS n_dup_lines, coalesce(c.n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w JOIN l USING (id) LEFT JOIN c USING (id)),
f AS (SELECT row_number() OVER () AS fid, *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f0),
m AS ({" UNION ALL ".join(case(k, v).replace("SELECT doc_id", "SELECT fid, doc_id") for k, v in values.items())}),
s AS (SELECT lang, source, metric, CASE WHEN v > 0 THEN 1 + floor(ln(v::DOUBLE) / ln({GAMMA}::DOUBLE)) ELSE 0 END::INT AS bin, count(*) AS n FROM m WHERE NOT base_failed GROUP BY ALL),
a AS ({sketch}),
u AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, metric ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY level, lang, source, metric) AS total FROM a),
q AS (SELECT level, lang, source, metric, max(total) AS rows, {mark} FROM u GROUP BY ALL),
b AS (SELECT level, lang, source, max(rows) AS rows, {limits} FROM q GROUP BY level, lang, source),
j AS (SELECT f.fid, CASE WHEN o.rows >= {LEAST_ROWS} THEN 'source' WHEN t.rows >= {LEAST_ROWS} THEN 'lang' ELSE 'all' END AS level
  FROM f LEFT JOIN b o ON o.level = 'own' AND o.lang IS NOT DISTINCT FROM f.lang AND o.source IS NOT DISTINCT FROM f.source LEFT JOIN b t ON t.level = 'lang' AND t.lang IS NOT DISTINCT FROM f.lang),
h AS (SELECT f.*, j.level AS threshold_level, b.* EXCLUDE (level, lang, source, rows) FROM f JOIN j USING (fid)
  LEFT JOIN b ON b.level = CASE j.level WHEN 'source' THEN 'own' ELSE j.level END AND (j.level = 'all' OR b.lang IS NOT DISTINCT FROM f.lang) AND (j.level <> 'source' OR b.source IS NOT DISTINCT FROM f.source))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {" AND ".join(fits)} AS kept, n_lines, threshold_level FROM h"""


QUERIES = {"op2_quality_rules": op2_quality_rules}
ORACLE = {"op2_quality_rules": _oracle()}
