"""Operator 1, toxicity by maximum-scoring segments.

Each word has a log-odds of standing in a toxic document, smoothed by Dirichlet priors: a word's prior is what its longest
prefix has, a prefix's that of the next shorter one, down to the rate of all words,
each without the counts that the longer one has itself. A linear-time scan of a text's words finds
all maximal segments (Ruzzo and Tompa); words with little evidence cost a small drift, so that a segment is a passage dense in
evidence. The best segment's score is set against what chance gives in a text of that length (the extreme-value law of Karlin
and Altschul, its parameters from texts that are not toxic), and that is calibrated to a probability on the training rows,
each scored without its own counts.

The training rows are labelled rows, a bounded sample of ``max_labels`` by hash where there are more. Their words and prefixes
are not bounded: each one that is in ``LEAST_ROWS`` rows counts, at every size. Counts and scores of features (words and
prefixes) are written tables; what a task holds is a bitmap of the hashes of features that score, of ``MOST_BITS`` at most. Words
of which one passes are joined with the features' scores, and a word has the score of its longest known feature; so a full
bitmap costs time and no result.

Defined results: a null or empty text has no segment and the lowest score; without labelled rows every score is 0; repeated
labels of a document count once, as toxic if any is; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import hash_key, materialise, table, u32

MAX_LABELS, LEAST_ROWS, CUT = 200_000, 2, 0.7
PREFIXES = (3, 4, 5, 6, 7)
PRIOR, DRIFT, EVIDENCE, MOST = 4.0, 0.04, 2.0, 6.0
LETTERS = re.compile(r"[^\W\d_]+")
PARTS = re.compile(r"([^\W\d_]+)")
SIGNIFICANT = 0.05
#: Places of the bitmap for each feature that scores, so that few other words pass, and places at most.
FEATURE_BITS, MOST_BITS = 512, 1 << 27


def words(text: str | None) -> list[str]:
    return LETTERS.findall((text or "").lower())


def features(word: str, length: Column | None = None) -> Column:
    """The word's prefixes, marked as such, and the word itself; of a prefix (with its length) the shorter ones and itself."""
    length = F.char_length(word) if length is None else length
    prefixes = [F.when(length > k, F.concat(F.substring(word, 1, k), F.lit("*"))) for k in PREFIXES]
    return F.filter(F.array(*prefixes, F.col(word)), lambda x: x.isNotNull())


def feature_list(word: str) -> list[str]:
    return [word[:k] + "*" for k in PREFIXES if len(word) > k] + [word]


def word_score(found: list[tuple[int, int]], base: float, own: int | None = None) -> float:
    """Log-odds of a word from (toxic, rows) of those of its features that are known, shortest first; 0 for little evidence.

    ``own`` is the label of a row that is scored without its own counts, or None.
    """
    own, one = (own, 1) if own is not None else (0, 0)
    chain = [(max(t - own, 0), n - one) for t, n in found if n > one]
    p = base
    for i, (toxic, rows) in enumerate(chain):
        # What the next longer feature has of these counts is its own evidence, not its prior's.
        t, n = chain[i + 1] if i + 1 < len(chain) else (0, 0)
        p = (max(toxic - t, 0) + PRIOR * p) / (max(rows - n, toxic - t, 0) + PRIOR)
    odds = math.log(p / (1 - p)) - math.log(base / (1 - base))
    return min(odds, MOST) if odds >= EVIDENCE else 0.0


def maximal_segments(evidence: list[tuple[int, float]], drift: float = DRIFT) -> list[tuple[float, int, int]]:
    """All maximal scoring segments of a text as (score, first word, last word).

    ``evidence`` holds the places and scores of words above zero; every other word scores -drift. Each segment on the list
    has the sum before it (left) and with it (right); a new one is merged with the nearest earlier one of a smaller left
    whose right is smaller too. Each keeps a link to the nearest earlier one of a smaller left, so that no search passes the
    same segments twice, and the scan is linear.
    """
    found: list[tuple[float, float, int, int]] = []
    earlier: list[int] = []
    total, last = 0.0, -1
    for place, score in evidence:
        total -= drift * (place - last - 1)
        left, right, first = total, total + score, place
        total, last = right, place
        j = len(found) - 1
        while j >= 0 and found[j][0] >= left:
            j = earlier[j]
        while j >= 0 and found[j][1] < right:
            left, first, before = found[j][0], found[j][2], earlier[j]
            del found[j:], earlier[j:]
            j = before
        found.append((left, right, first, place))
        earlier.append(j)
    return [(right - left, first, end) for left, right, first, end in found]


def labelled(labels: DataFrame, train: Column, max_labels: int) -> DataFrame:
    """(doc_id, toxic), at most ``max_labels`` rows: those of the least hashes."""
    once = labels.filter(train & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = once.count()
    if n > max_labels:
        key = hash_key(F.col("doc_id"), "tox-1:")
        once = once.filter(u32(key) < int(2**32 * min(1.0, 1.1 * max_labels / n + 1e-6))).orderBy(key, "doc_id").limit(max_labels)
    return once


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, toxic, rows) of labelled rows (text, toxic): in how many rows' sets of words each word occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, toxic, fields = Counter(), Counter(), ["word", "toxic", "rows"]

        def counted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(rows.keys(), pa.string()), pa.array([toxic[w] for w in rows], pa.int64()), pa.array(rows.values(), pa.int64())], fields)

        for batch in batches:
            for text, label in zip(batch.column("text"), batch.column("toxic").to_pylist()):
                seen = set(words(text.as_py()))
                rows.update(seen)
                if label:
                    toxic.update(seen)
                if len(rows) > 100_000:
                    yield counted()
                    rows, toxic = Counter(), Counter()
        yield counted()

    return rows.select("text", "toxic").mapInArrow(count, "word string, toxic long, rows long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("rows").alias("rows"))


SCORES = "score double, score0 double, score1 double"


def feature_scores(counts: DataFrame, base: float) -> DataFrame:
    """(feature, length, at, score, score0, score1) of the known features: a word's score if this is its longest known one, and without the counts of a row of label 0 or 1."""
    named = counts.select(F.explode(features("word")).alias("feature"), "toxic", "rows")
    known = named.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("rows").alias("rows")).filter(F.col("rows") >= LEAST_ROWS)
    # A prefix is shorter than its word, and its mark does not make it longer than the word.
    length = F.char_length("feature") - F.endswith("feature", F.lit("*")).cast("int")
    known = materialise(known.withColumn("length", length), "toxic-features")
    each = known.select(F.col("feature").alias("whole"), F.col("length").alias("size"), F.explode(features("feature", F.col("length"))).alias("feature")).join(known, "feature")
    chains = each.groupBy("whole", "size").agg(F.sort_array(F.collect_list(F.struct("length", "toxic", "rows"))).alias("chain"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], []]
            for chain in batch.column("chain").to_pylist():
                found = [(x["toxic"], x["rows"]) for x in chain]
                for scores, own in zip(out, (None, 0, 1)):
                    scores.append(word_score(found, base, own))
            at = pa.array(map(place_of, batch.column("whole").to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("whole"), batch.column("size"), at, *[pa.array(x, pa.float64()) for x in out]], ["feature", "length", "at", "score", "score0", "score1"])

    return chains.mapInArrow(score, f"feature string, length int, at long, {SCORES}")


def word_scores(found: DataFrame, known: DataFrame) -> DataFrame:
    """(word, score, score0, score1) of the words of ``candidates`` that score: each by its longest known feature."""
    each = found.select(F.explode("found.word").alias("word")).distinct().select("word", F.explode(features("word")).alias("feature")).join(known.drop("at"), "feature")
    longest = each.groupBy("word").agg(F.max(F.struct("length", "score", "score0", "score1")).alias("f")).select("word", "f.score", "f.score0", "f.score1")
    return longest.filter("score > 0 OR score0 > 0 OR score1 > 0")


def place_of(word: str) -> int:
    return xxhash.xxh64_intdigest(word) % MOST_BITS


def bitmap(scored: DataFrame) -> np.ndarray:
    """A bitmap of the features' places, of FEATURE_BITS each and MOST_BITS at most; its size is a power of two."""
    bits = min(MOST_BITS, max(1 << 15, 1 << (FEATURE_BITS * scored.count()).bit_length()))
    place = F.col("at") % bits + 1
    parts = scored.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for part, chunk in parts.toLocalIterator():
        out[(part - 1) * 4096 : part * 4096] = np.frombuffer(chunk, np.uint8)
    return out


def candidates(rows: DataFrame, bits: np.ndarray) -> DataFrame:
    """(uid, doc_id, toxic, text) to uid, doc_id, toxic, n (words) and found: the words of which the bitmap has a feature, with their places."""
    FOUND = pa.list_(pa.struct([("word", pa.string()), ("place", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))

    class Scores(dict):
        """Whether the bitmap has a feature."""

        def __missing__(self, feature: str) -> bool:
            at = place_of(feature) % (8 * len(bits))
            self[feature] = found = bool(bits[at >> 3] >> (at & 7) & 1)
            return found

    class Passes(dict):
        """Whether it has one of a word's features."""

        scores = Scores()

        def __missing__(self, word: str) -> bool:
            if len(self.scores) > 300_000:
                self.scores.clear()
            self[word] = passes = any(map(self.scores.__getitem__, feature_list(word)))
            return passes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = Passes()
        for batch in batches:
            n, found = [], []
            for cell in batch.column("text"):
                text = (cell.as_py() or "").lower()
                if len(passes) > 300_000:
                    passes.clear()
                # What is between words, and the words, in turn.
                parts = PARTS.split(text)
                all_words = parts[1::2]
                hits = [i for i, hit in enumerate(map(passes.__getitem__, all_words)) if hit]
                ends = list(accumulate(map(len, parts))) if hits else []
                n.append(len(all_words))
                found.append([{"word": all_words[i], "place": i, "start": ends[2 * i], "end": ends[2 * i + 1]} for i in hits])
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("doc_id"), batch.column("toxic"), pa.array(n, pa.int64()), pa.array(found, FOUND)], ["uid", "doc_id", "toxic", "n", "found"])

    return rows.select("uid", "doc_id", "toxic", "text").mapInArrow(run, "uid long, doc_id long, toxic int, n long, found array<struct<word:string,place:int,start:int,end:int>>")


def segments(found: DataFrame, scored: DataFrame) -> DataFrame:
    """``candidates`` to doc_id, toxic, n, segments, and of training rows best and evidence without their own counts."""
    each = found.select("uid", F.explode("found").alias("f")).select("uid", "f.*").join(scored, "word")
    hits = each.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("place", "start", "end", "score", "score0", "score1"))).alias("hits"))

    SEGMENTS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_segments, best, evidence = [], [], []
            for label, hits in zip(batch.column("toxic").to_pylist(), batch.column("hits").to_pylist()):
                at = {h["place"]: h for h in hits or ()}
                all_segments.append([{"start": at[i]["start"], "end": at[j]["end"], "score": s} for s, i, j in maximal_segments([(i, h["score"]) for i, h in at.items() if h["score"]])])
                own = [(i, h["score1" if label else "score0"]) for i, h in at.items() if h["score1" if label else "score0"]] if label is not None else []
                best.append(max((s for s, _, _ in maximal_segments(own)), default=0.0))
                evidence.append([round(s, 1) for _, s in own])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), batch.column("n"), pa.array(all_segments, SEGMENTS), pa.array(best, pa.float64()), pa.array(evidence, pa.list_(pa.float64()))], ["doc_id", "toxic", "n", "segments", "best", "evidence"])

    joined = found.drop("found").join(hits, "uid", "left").select("doc_id", "toxic", "n", "hits")
    return joined.mapInArrow(run, "doc_id long, toxic int, n long, segments array<struct<start:int,end:int,score:double>>, best double, evidence array<double>")


def karlin_altschul(histogram: dict[float, int], plain: int) -> float:
    """The lambda for which the mean of exp(lambda * score) is 1 over background words: ``plain`` of them score -DRIFT."""
    if not histogram or not plain:
        return 1.0
    s, n = np.array([*histogram, -DRIFT]), np.array([*histogram.values(), plain], dtype=float)
    n /= n.sum()
    if (s * n).sum() >= 0:
        return 0.05
    low, high = 0.0, 50.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if (n * np.exp(np.clip(mid * s, -700, 700))).sum() < 1 else (low, mid)
    return max(low, 0.05)


def logistic(x: np.ndarray, ones: np.ndarray, zeros: np.ndarray) -> tuple[float, float]:
    """Platt's fit of a probability to binned values, by Newton steps, with his targets against certainty."""
    a, b, n1, n0 = 0.0, 0.0, ones.sum(), zeros.sum()
    y1, y0 = (n1 + 1) / (n1 + 2), 1 / (n0 + 2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        n = ones + zeros
        g = ones * y1 + zeros * y0 - n * p
        w = n * p * (1 - p) + 1e-9
        hess = np.array([[w.sum() + 1e-3, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 1e-3]])
        step = np.linalg.solve(hess, [g.sum() - 1e-3 * a, (g * x).sum() - 1e-3 * b])
        a, b = a + float(np.clip(step[0], -2, 2)), b + float(np.clip(step[1], -2, 2))
        if np.abs(step).max() < 1e-8:
            break
    return a, max(b, 0.0)


#: Normalised scores are held between these: nothing found, and beyond doubt.
NOTHING, CERTAIN = -12.0, 15.0


class ToxicityModel:
    """The extreme-value parameters and the calibration."""

    def __init__(self, lam: float = 1.0, k: float = 1.0, a: float = -30.0, b: float = 0.0):
        self.lam, self.k, self.a, self.b, self.least = lam, k, a, b, -math.log(SIGNIFICANT)

    def normalised(self, best: float, n: int) -> float:
        """Minus the log of the number of such segments that chance gives in n words."""
        return min(max(self.lam * best - math.log(self.k * max(n, 1)), NOTHING), CERTAIN) if best > 0 else NOTHING

    def probability(self, x: float) -> float:
        return 1 / (1 + math.exp(-min(max(self.a + self.b * x, -30), 30)))

    @classmethod
    def fit(cls, measured: DataFrame) -> ToxicityModel:
        """From the training rows of ``segments``."""
        self, measured = cls(), measured.filter("toxic IS NOT NULL")
        clean = measured.filter("toxic = 0")
        # Scores are rounded to tenths below MOST, so the histogram has at most 60 rows.
        histogram = {r[0]: r[1] for r in clean.select(F.explode("evidence").alias("s")).groupBy("s").count().collect()}
        words_, high, docs_ = clean.agg(F.sum("n"), F.sum((F.col("best") >= 1.0).cast("long")), F.count(F.lit(1))).first()
        self.lam = karlin_altschul(histogram, (words_ or 0) - sum(histogram.values()))
        self.k = max(((high or 0) + 0.5) / (max(words_ or 0, 1) * math.exp(-self.lam)), 1e-6)
        # Tenths between NOTHING and CERTAIN: a few hundred bins.
        raw = F.col("best") * self.lam - F.ln(F.lit(self.k) * F.greatest(F.col("n"), F.lit(1)))
        x = F.when(F.col("best") > 0, F.least(F.greatest(raw, F.lit(NOTHING)), F.lit(CERTAIN))).otherwise(NOTHING)
        bins = measured.groupBy(F.round(x, 1).alias("x")).agg(F.sum(F.col("toxic").cast("long")).alias("ones"), F.count(F.lit(1)).alias("n")).orderBy("x").toPandas()
        # Words are not independent, so the law alone promises too much: a passage is significant from where SIGNIFICANT of the
        # rows that are not toxic have one, or from where the law says so, if that is higher.
        x, zeros = bins.x.to_numpy(float), (bins.n - bins.ones).to_numpy(float)
        from_here = np.cumsum(zeros[::-1])[::-1]
        over = x[from_here > SIGNIFICANT * max(from_here[:1].sum(), 1)] if len(x) else x
        self.least = max(self.least, float(over.max()) + 0.05 if len(over) else NOTHING)
        self.a, self.b = logistic(bins.x.to_numpy(float), bins.ones.to_numpy(float), (bins.n - bins.ones).to_numpy(float))
        return self

    def score(self, found: DataFrame) -> DataFrame:
        """``segments`` to doc_id, score, n_segments and the significant passages by their places in the text."""
        model, PASSAGES = self, "array<struct<start:int,end:int,score:double>>"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                score, strong = [], []
                for n, all_segments in zip(batch.column("n").to_pylist(), batch.column("segments").to_pylist()):
                    score.append(model.probability(model.normalised(max((s["score"] for s in all_segments), default=0.0), n)))
                    strong.append([s for s in all_segments if model.normalised(s["score"], n) >= model.least])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64()), pa.array(map(len, strong), pa.int32()), pa.array(strong, batch.schema.field("segments").type)], ["doc_id", "score", "n_segments", "passages"])

        return found.select("doc_id", "n", "segments").mapInArrow(run, f"doc_id long, score double, n_segments int, passages {PASSAGES}")


def toxicity(docs: DataFrame, labels: DataFrame, train: Column, max_labels: int = MAX_LABELS) -> DataFrame:
    """(doc_id, text) to doc_id, score, n_segments, passages; trained on the labels of rows that ``train`` names."""
    # At most max_labels rows of two numbers, so the texts need not be shuffled to meet them.
    rows = docs.select("doc_id", "text").join(F.broadcast(labelled(labels, train, max_labels)), "doc_id", "left")
    rows = rows.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), "toxic", "text")
    counts = materialise(word_counts(rows.filter("toxic IS NOT NULL")), "toxic-words")
    toxic, total = counts.agg(F.sum("toxic"), F.sum("rows")).first()
    known = materialise(feature_scores(counts, toxic / total), "toxic-scores") if toxic and toxic != total else None
    strong = known and known.filter("score > 0 OR score0 > 0 OR score1 > 0")
    if strong is None or strong.isEmpty():
        nothing = F.array().cast("array<struct<start:int,end:int,score:double>>")
        return rows.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("n_segments"), nothing.alias("passages"))
    found = materialise(candidates(rows, bitmap(strong)), "toxic-candidates")
    scored = materialise(word_scores(found, known), "toxic-words-found")
    measured = materialise(segments(found, scored), "toxic-segments")
    return ToxicityModel.fit(measured).score(measured)


def remainder(doc_id: Column, by: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % by


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 3) != 1).select(
        "doc_id", F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"), "n_segments", "passages"
    )


QUERIES = {"op1_toxicity": op1_toxicity}
ORACLE: dict[str, str] = {}
