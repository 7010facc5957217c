"""Operator 8, mixing sources to target weights: hash-random keys, ranges within each source, distributed prefix sums, exact cuts.

Defined results: a null text has size 0; a null source is a source of its own, last in order; an empty table gives an empty
result; rows that tie on the id are ordered by size; rows with a null id have one random key, and are ordered by size as well; a source
of size 0 has target 0; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.llm.common import SPACE, WORD, hash_key, materialise, prefix_sums, table

WEIGHTS, SHARE, MOST_EPOCHS, SEED = (3, 1, 2), 1.5, 2, "mix-1:"


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """Add ``target`` to (source, source_size): ``share`` of all sizes dealt by weight, none above ``most_epochs`` times its size.

    What exceeds a source's cap goes to the others by weight until none is above. Sources that reach their cap are those with
    the least cap a weight, so with sources in that order the level is where the rest, shared by weight, stays under the next
    cap. The windows run over one row a source.
    """
    ordered = sources.withColumn("_n", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_n") % len(weights) + 1).cast("int"))
    capped = ordered.withColumn("_w", weight).withColumn("_cap", most_epochs * F.col("source_size").cast("double"))
    everything = W.partitionBy()
    order = W.orderBy(F.col("_cap") / F.col("_w"), "_n")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    level = (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (
        F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    )
    levels = capped.withColumn("_level", level).withColumn("_fits", F.col("_level") * F.col("_w") <= F.col("_cap"))
    found = levels.withColumn("_at", F.first(F.when(F.col("_fits"), F.col("_level")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    return found.withColumn("target", F.when(F.col("_at").isNull() | (F.col("_at") * F.col("_w") > F.col("_cap")), F.col("_cap")).otherwise(F.col("_at") * F.col("_w"))).select(
        "source", "source_size", "target"
    )


def mix(sized: DataFrame, **targets) -> DataFrame:
    """Add source_size, target and taken to a written table (uid, source, size) with any carried columns.

    A source's budget is its target rounded to whole words. It takes every document once for each whole epoch in the budget;
    for the rest it walks its documents in order of their hash-random keys, and the document in which the budget ends gives
    just the words that are left.
    """
    sources = materialise(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), **targets).withColumn("_source", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))), "mix-sources").drop("source")
    keyed = sized.withColumn("_source", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).withColumn("_key", hash_key(F.col("uid"), SEED))
    placed = prefix_sums(keyed, "_source", "_key", "size", "_before")
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - F.col("_epochs") * F.col("source_size")
    return (
        placed.join(sources, "_source")
        .withColumn("_epochs", epochs)
        .withColumn("taken", F.col("_epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_before"))))
        .drop("_source", "_key", "_before", "_epochs")
    )


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def first_words(text: Column, number: Column) -> Column:
    """The text up to the end of its word of that number, as it stands; it must have more."""
    leading = text.rlike("^" + SPACE).cast("int")
    rest = F.element_at(F.split(text, SPACE, number + 1 + leading), -1)
    return F.regexp_replace(F.substring(text, F.lit(1), F.char_length(text) - F.char_length(rest)), SPACE + "$", "")


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a document once for each time it is taken whole, and the first words of one that is cut.

    A column n_chars, if there is one, is that of the text given. A document without words has no share of the budget and is left out.
    """
    columns = docs.columns
    rows = materialise(docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), F.col("doc_id").alias("uid"), "source", word_count(F.col("text")).alias("size")), "mix-rows")
    light = rows.select("uid", "source", "size", F.xxhash64("_row.text").alias("_same"))
    taken = mix(light).select("uid", "source", "size", "_same", "taken")
    once = taken.groupBy("uid", "source", "size", "_same").agg(F.sort_array(F.collect_list("taken")).alias("_takens"))
    numbered = rows.withColumn("_same", F.xxhash64("_row.text"))
    same = W.partitionBy("uid", "source", "size", "_same").orderBy(F.to_json("_row"))
    numbered = numbered.withColumn("_i", F.row_number().over(same))
    joined = numbered.alias("r").join(
        once.alias("t"), F.col("r.uid").eqNullSafe(F.col("t.uid")) & F.col("r.source").eqNullSafe(F.col("t.source")) & (F.col("r.size") == F.col("t.size")) & (F.col("r._same") == F.col("t._same"))
    ).select("r._row", "r.size", F.element_at("t._takens", F.col("r._i")).alias("taken"))
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    cut = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(0).cast("int")
    texts = F.concat(
        F.array_repeat(F.col("_row.text"), whole),
        F.when(cut > 0, F.array(first_words(F.col("_row.text"), cut))).otherwise(F.array().cast("array<string>")),
    )
    out = joined.withColumn("_text", F.explode(texts))
    made = {"text": F.col("_text"), "n_chars": F.char_length("_text").cast("long")}
    return out.select(*[made.get(c, F.col(f"_row.`{c}`")).alias(c) for c in columns])


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = materialise(docs.select(F.col("doc_id").alias("uid"), "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    return mix(sized).select(F.col("uid").alias("doc_id"), "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))


ORACLE = {
    "op8_mixing": r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size)::DOUBLE AS cap, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n FROM d GROUP BY source),
w AS (SELECT *, (CASE n % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END)::DOUBLE AS w FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lvl FROM w),
a AS (SELECT arg_min(lvl, (cap / w, n)) AS lvl FROM l WHERE lvl * w <= cap),
t AS (SELECT l.source, l.source_size, least(l.cap, coalesce(a.lvl * l.w, l.cap)) AS target FROM l LEFT JOIN a ON true),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, round(t.target)::BIGINT AS budget,
  coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM p)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, budget - epochs * source_size - before)))::BIGINT AS taken FROM e"""
}
QUERIES = {"op8_mixing": op8_mixing}
