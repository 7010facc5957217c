"""Operator 13, benchmark decontamination by a prefix-filtered set join, DataFrame functions only.

A window is so many consecutive words of a benchmark item, or the whole of a shorter one. A window is the set of its word shingles
with their places, and a document contains it when it has all of them, one after the other. Since none may be missing, the necessary
prefix is one shingle: the rarest, by its count over all documents. Documents are joined on that alone. Where the shingle lies
bounds where the window would begin and end, and whatever does not fit into the document goes; the rest is compared word by
word over a stretch of the item's window size.

The documents are read once. Each one's shingles are looked up in a bitmap of those of the benchmark, whose size has a bound, and
only places found there are written, with the words around them; what the bitmap lets through wrongly has no partner in the join.
With more shingles than the bitmap tells apart more is written, and nothing else changes. Joins are by shingle hash, of rows that are
spread by it; Spark broadcasts the benchmark's side only if it is below its own limit.

Defined results: a null or empty text has no words and is clean; a null or empty item has no window; a null item id is written
``null``; items alike in their id are one item with the windows of all; repeated documents are each reported; an empty benchmark
finds nothing; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, UPPER, ascii_lower, materialise, table

#: What stands between words: ASCII characters other than letters and digits.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, SHINGLE = 10, 5
#: The bitmap has this many bits a shingle, and 2^MOST_BITS of them at most (4 MB).
BITS_PER_SHINGLE, MOST_BITS = 256, 25


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


def shingle_at(hashes: Column | str, i: Column, m: int) -> Column:
    """The hash of m words from place i (from 0) on, out of the words' own hashes; the same for equal words everywhere."""
    return F.xxhash64(F.lit(m), *[F.get(hashes, i + k) for k in range(m)])


def word_hashes(found: Column | str) -> Column:
    return F.transform(found, lambda w: F.xxhash64(w))


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, size, win): the distinct windows of each item, as arrays of words."""
    each = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), words(F.col("text")).alias("w"))
    sized = each.withColumn("size", F.least(F.size("w"), F.lit(window))).filter("size > 0")
    starts = F.sequence(F.lit(1), F.size("w") - F.col("size") + 1)
    return sized.select("item_id", "size", F.explode(F.transform(starts, lambda i: F.slice("w", i, F.col("size")))).alias("win")).distinct()


def window_shingles(windows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(size, win) to (size, win, offset, h): every shingle of each window; a window shorter than a shingle is one itself."""
    sizes = [r["size"] for r in windows.select("size").distinct().collect()]  # no more than words in a window
    hashed = windows.select("size", "win", word_hashes("win").alias("_h"))
    parts = []
    for size in sorted(sizes):
        m = min(size, shingle)
        each = F.array(*[F.struct(F.lit(k).alias("offset"), shingle_at("_h", F.lit(k), m).alias("h")) for k in range(size - m + 1)])
        parts.append(hashed.filter(F.col("size") == size).select("size", "win", F.explode(each).alias("s")).select("size", "win", "s.offset", "s.h"))
    out = parts[0] if parts else hashed.select("size", "win", F.lit(0).alias("offset"), F.lit(0).cast("long").alias("h")).limit(0)
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def bitmap(hashes: DataFrame, bits: int) -> DataFrame:
    """One row, an array of 2^(bits - 6) numbers with a bit set for each ``h``."""
    place = F.shiftrightunsigned(F.col("h"), 64 - bits)
    numbers = hashes.groupBy(F.shiftright(place, 6).alias("i")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))).alias("b"))
    every = hashes.sparkSession.range(1 << (bits - 6)).withColumnRenamed("id", "i")
    filled = every.join(numbers, "i", "left").select("i", F.coalesce("b", F.lit(0).cast("long")).alias("b"))
    return filled.agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "b"))), lambda x: x["b"]).alias("bits"))


def candidate_places(docs: DataFrame, shingles: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(uid, doc_id, n_words, at, h, first, near): a row a document, where h is null, and one for each place whose shingle is in the bitmap.

    ``near`` are the words that any window with that shingle can have, from place ``first`` on.
    """
    lengths = sorted({min(r["size"], shingle) for r in shingles.select("size").distinct().collect()})
    hashes = materialise(shingles.select("h").distinct(), "shingle-hashes")
    bits = min(MOST_BITS, max(12, (BITS_PER_SHINGLE * max(1, hashes.count()) - 1).bit_length()))
    known = bitmap(hashes, bits).scalar()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text")).alias("words"))
    rows = rows.withColumns({"_h": word_hashes("words"), "n_words": F.size("words"), "uid": F.monotonically_increasing_id()})
    parts, begin, size = [F.array(F.lit(None).cast("long"))], F.lit(1), F.lit(0)
    at, reach = F.lit(None).cast("int"), F.lit(0)
    for m in lengths:
        of_length = lambda i: shingle_at("_h", i, m)  # noqa: E731, B023
        parts.append(F.when(F.size("_h") >= m, F.transform(F.sequence(F.lit(0), F.size("_h") - m), of_length)).otherwise(F.array().cast("array<bigint>")))
        here = F.col("place") >= begin
        at, size, reach = F.when(here, F.col("place") - begin).otherwise(at), F.when(here, m).otherwise(size), F.when(here, 0 if m < shingle else window - m).otherwise(reach)
        begin = begin + F.greatest(F.lit(0), F.col("n_words") - (m - 1))
    # An outer explode: of an inner one the optimizer would infer that the array isn't empty, and make it a second time to see that.
    every = rows.select("uid", "doc_id", "n_words", "words", F.concat(*parts).alias("all")).select("uid", "doc_id", "n_words", "words", F.posexplode_outer("all").alias("place", "h"))
    bit = F.shiftrightunsigned("h", 64 - bits)
    found = every.filter(F.col("h").isNull() | (F.getbit(F.get(known, F.shiftright(bit, 6).cast("int")), bit.bitwiseAND(F.lit(63)).cast("int")) == 1))
    first = F.greatest(at - reach, F.lit(0))
    near = F.when(F.col("h").isNotNull(), F.slice("words", first + 1, at - first + size + reach))
    return found.select("uid", "doc_id", F.col("n_words").cast("long").alias("n_words"), at.alias("at"), "h", first.alias("first"), near.alias("near"))


def rarest(shingles: DataFrame, places: DataFrame) -> DataFrame:
    """(size, win, offset, h): each window's necessary prefix, the shingle with the fewest places in all documents."""
    times = places.groupBy("h").agg(F.count(F.lit(1)).alias("times"))
    # A shingle that no document has leaves its window without a partner, and is the rarest.
    ranked = shingles.join(times, "h", "left").withColumn("times", F.coalesce("times", F.lit(0)))
    return ranked.groupBy("size", "win").agg(F.min(F.struct("times", "h", "offset")).alias("p")).select("size", "win", "p.h", "p.offset")


def hits(docs: DataFrame, windows: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """Written tables: (uid, doc_id, n_words) of all documents, and (uid, start, size, win) of all windows that occur in them."""
    shingles = materialise(window_shingles(windows.select("size", "win").distinct(), shingle), "window-shingles")
    rows = materialise(candidate_places(docs, shingles, window, shingle), "candidate-places")
    places = rows.filter("h is not null")
    prefix = materialise(rarest(shingles, places.select("h")), "window-prefixes")
    start = F.col("at") - F.col("offset")
    bounded = places.join(prefix, "h").withColumn("start", start).filter((F.col("start") >= 0) & (F.col("start") + F.col("size") <= F.col("n_words")))
    exact = bounded.filter(F.slice("near", F.col("start") - F.col("first") + 1, F.col("size")) == F.col("win"))
    return rows.filter("h is null").select("uid", "doc_id", "n_words"), materialise(exact.select("uid", "start", "size", "win"), "window-hits")


def covered(spans: Column) -> Column:
    """How many words the spans (start, size) of one document cover, each once."""
    step = lambda a, s: F.struct(
        (a["n"] + F.greatest(F.lit(0), s["start"] + s["size"] - F.greatest(a["end"], s["start"]))).alias("n"), F.greatest(a["end"], s["start"] + s["size"]).alias("end")
    )
    return F.aggregate(F.sort_array(spans), F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step, lambda a: a["n"]).cast("long")


def decontaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, item_ids (sorted strings), contaminated."""
    windows = materialise(item_windows(items, window), "item-windows")
    rows, found = hits(docs, windows, window, shingle)
    spans = found.groupBy("uid").agg(covered(F.collect_set(F.struct("start", "size"))).alias("n_hit"))
    whose = found.select("uid", "size", "win").distinct().join(windows, ["size", "win"]).groupBy("uid").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    out = rows.join(spans.join(whose, "uid"), "uid", "left")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), (n_hit > 0).alias("contaminated"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.withColumn("items_sha256", F.sha2(F.array_join("item_ids", ",").cast("binary"), 256)).drop("item_ids")


ORACLE = {
    "op13_decontamination": rf"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
s AS (SELECT item_id, w, least(len(w), 10) AS size FROM b WHERE len(w) > 0),
o AS (SELECT item_id, size, w, unnest(range(0, len(w) - size + 1)) AS i FROM s),
g AS (SELECT DISTINCT item_id, size, array_to_string(w[i + 1:i + size], ' ') AS win FROM o),
z AS (SELECT DISTINCT size FROM g),
q AS (SELECT uid, w, size, unnest(range(0, len(w) - size + 1)) AS i FROM d, z WHERE len(w) >= size),
p AS (SELECT uid, size, i, array_to_string(w[i + 1:i + size], ' ') AS win FROM q),
h AS (SELECT p.uid, p.i, p.size, g.item_id FROM p JOIN g ON p.win = g.win AND p.size = g.size),
k AS (SELECT DISTINCT uid, i + unnest(range(0, size)) AS place FROM h),
c AS (SELECT uid, count(*) AS n_hit FROM k GROUP BY uid),
t AS (SELECT uid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT uid, item_id FROM h) GROUP BY uid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (uid) LEFT JOIN t USING (uid)"""
}
QUERIES = {"op13_decontamination": op13_decontamination}
