"""Operator 7, packing in the order of a space-filling curve.

A document's token ids are hashed to a vector that is projected to a few dimensions; the Hilbert key of that point orders the
documents, so that neighbours on the curve are alike. The projection's mean is not taken out: the grid has 2^16 places a side,
and the curve is cut at quantiles of tokens, so that a crowded region has more ranges. The documents are range-partitioned by (key, tie) and laid end to end
along the curve; every ``length`` tokens a sequence ends, so only the last one has padding.

Texts are tokenised once and written with their keys. Range bounds and the tokens before each range are the only numbers that
reach the driver, and their count is a parameter; equal keys (copies) are split by the tie, a hash of the id.

Defined results: a null text is empty, and an empty text is its end id alone; an empty table gives an empty result; ties in
(key, tie) are broken by the ids themselves, and rows alike in all of that are interchangeable; further columns are not read.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import hash_key, materialise, table, text_slices, u32

LENGTH, END_ID, DIMS, BITS, SEED = 2048, 1, 3, 16, 20_25
#: A document counts once for each so many tokens in the quantiles that cut the curve.
WEIGHT = 256
#: White space beyond ASCII in UTF-8: the bytes before the last one, and what that may be.
WIDE_SPACES = (((0xC2,), (0x85, 0xA0)), ((0xE1, 0x9A), (0x80,)), ((0xE2, 0x80), (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)), ((0xE2, 0x81), (0x9F,)), ((0xE3, 0x80), (0x80,)))
#: Last bytes of letters of two bytes from U+00C0 to U+00FF, other than the signs of multiplication and division.
LATIN_SIGNS = (0x97, 0xB7)
#: Texts are encoded together up to so many characters.
SLICE = 8_000_000
#: A task remembers the ids of so many stretches of up to so many characters.
MOST_KNOWN, MOST_CHARS = 900_000, 64


@lru_cache(maxsize=2)
def encoder(name: str) -> Callable[[list[str]], list[np.ndarray]]:
    """A function from texts to their token ids by the byte-level BPE ``name``, special tokens not added, those in a text known as such.

    Equal stretches have equal ids, so each one is encoded once while the task remembers it. New words after one space are
    encoded many at a time, laid end to end: the tokens that begin with a space are where each begins.
    """
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
    after_space = np.zeros(tokenizer.get_vocab_size(), dtype=bool)
    after_space[[i for token, i in tokenizer.get_vocab().items() if token.startswith("\u0120")]] = True
    known: dict[str, bytes] = {}

    def encoded(stretches: list[str]) -> dict[str, bytes]:
        words = [s for s in stretches if s[0] == " " and len(s) > 1 and not s[1].isspace() and "<|" not in s]
        out: dict[str, bytes] = {}
        for a in range(0, len(words), 5000):
            part = words[a : a + 5000]
            ids = np.array(tokenizer.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids, dtype=np.uint32)
            begins = np.flatnonzero(after_space[ids])
            if len(begins) == len(part):
                cells, at = ids.tobytes(), [*(4 * begins).tolist(), 4 * len(ids)]
                out.update((s, cells[at[k] : at[k + 1]]) for k, s in enumerate(part))
        others = [s for s in stretches if s not in out]
        for a in range(0, len(others), 1000):
            part = others[a : a + 1000]
            out.update(zip(part, (array("I", e.ids).tobytes() for e in tokenizer.encode_batch_fast(part, add_special_tokens=False))))
        return out

    def encode(texts: list[str]) -> list[np.ndarray]:
        if len(known) > MOST_KNOWN:
            known.clear()
        cells = [text.encode() for text in texts]
        if not any(cells):
            return [np.zeros(0, dtype=np.uint32) for _ in cells]
        data = np.frombuffer(b"".join(cells), dtype=np.uint8)
        ends = np.cumsum([len(cell) for cell in cells])
        begins = stretches(data, np.concatenate([[0], ends[:-1]]))
        # Equal stretches are found by Arrow's dictionary, over the bytes as they lie there.
        offsets = np.append(begins, len(data))
        distinct = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(offsets.astype("<i8")), pa.py_buffer(data)).dictionary_encode()
        words = distinct.dictionary.to_pylist()
        new = encoded([w for w in words if w not in known])
        known.update((w, cell) for w, cell in new.items() if len(w) <= MOST_CHARS)
        each = [known[w] if w in known else new[w] for w in words]
        # The ids of all stretches, gathered from those of the distinct ones laid end to end.
        ids = np.frombuffer(b"".join(each), dtype=np.uint32)
        sizes = np.fromiter((len(cell) // 4 for cell in each), dtype=np.int64, count=len(each))
        starts = np.cumsum(sizes) - sizes
        which = distinct.indices.to_numpy()
        upto = np.cumsum(sizes[which])
        from_ = np.repeat(starts[which] - (upto - sizes[which]), sizes[which])
        every = ids[from_ + np.arange(len(from_))]
        places = np.searchsorted(begins, ends)  # stretches before the end of each text
        return np.split(every, np.concatenate([[0], upto])[places][:-1])

    return encode


def stretches(data: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Where stretches begin in UTF-8 bytes, of texts that begin at ``texts``: at each of these, at white space after something else, and at a full
    stop or comma after a letter or digit.

    No token of a byte-level vocabulary reaches from a word into white space, or from a letter or digit into those marks.
    """
    n = len(data)
    first = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))  # bytes that a white space character begins with, and ends with
    last = first.copy()
    for head, tails in WIDE_SPACES:
        k = len(head)
        at = np.flatnonzero(data[: max(0, n - k)] == head[0])
        for i in range(1, k):
            at = at[data[at + i] == head[i]]
        at = at[np.isin(data[at + k], tails)]
        first[at], last[at + k] = True, True
    begin = np.zeros(n, dtype=bool)
    begin[1:] = first[1:] & ~last[:-1]
    mark = np.flatnonzero((data[1:] == 0x2E) | (data[1:] == 0x2C)) + 1
    before = data[mark - 1]
    letter = ((before | 0x20) >= 0x61) & ((before | 0x20) <= 0x7A) | (before >= 0x30) & (before <= 0x39)
    two = mark >= 2
    letter[two] |= (data[mark[two] - 2] == 0xC3) & (before[two] >= 0x80) & ~np.isin(before[two], LATIN_SIGNS)
    begin[mark[letter]] = True
    begin[texts[texts < n]] = True
    return np.flatnonzero(begin)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index along the Hilbert curve of each row of unsigned integers below 2^bits (Skilling's transform)."""
    x = points.astype(np.uint64).copy()
    dims = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        p = np.uint64(q - 1)
        for i in range(dims):
            high = (x[:, i] & np.uint64(q)) != 0
            swap = np.where(high, np.uint64(0), (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] ^= np.where(high, p, np.uint64(0)) ^ swap
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(len(x), dtype=np.uint64)
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[:, -1] & np.uint64(q)) != 0, turn ^ np.uint64(q - 1), turn)
        q >>= 1
    x ^= turn[:, None]
    key = np.zeros(len(x), dtype=np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << np.uint64(1)) | ((x[:, i] >> np.uint64(b)) & np.uint64(1))
    return key.astype(np.int64)


@lru_cache(maxsize=2)
def _directions(dims: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((1 << 16, dims)).astype(np.float32)


def curve_points(ids: list[np.ndarray], dims: int = DIMS) -> np.ndarray:
    """Each document's projected mean direction as a point of the curve's grid."""
    directions, points = _directions(dims), np.zeros((len(ids), dims))
    for i, x in enumerate(ids):
        points[i] = directions[x & 0xFFFF].mean(axis=0)
    return np.clip((points + 0.5) * (1 << BITS), 0, (1 << BITS) - 1).astype(np.uint64)


def tokenised(docs: DataFrame, tokenizer: str = "byte_bpe_50k", end_id: int = END_ID) -> DataFrame:
    """(doc_id, text) to (doc_id, n, key, ids): ids as little-endian unsigned numbers of 16 bits, or 32 where one needs it, the end id last."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end = encoder(tokenizer), np.array([end_id], dtype=np.uint32)
        for batch, texts in text_slices(batches, most=SLICE):
            ids = [np.concatenate([x, end]) for x in tokens(texts)]
            # A document of ids below 65,536 is kept in two bytes an id, for it is written and shuffled once.
            cells = [(x.astype("<u2") if x.max() < 65_536 else x).tobytes() for x in ids]
            keys = hilbert(curve_points(ids)) if ids else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array(keys, pa.int64()), pa.array(cells, pa.binary())],
                ["doc_id", "n", "key", "ids"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, "doc_id long, n long, key long, ids binary")


def pack(docs: DataFrame, length: int = LENGTH, tokenizer: str = "byte_bpe_50k", end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, curve_key; with its ids if asked for."""
    spark = docs.sparkSession
    ranges = max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = materialise(tokenised(docs, tokenizer, end_id).withColumn("tie", u32(hash_key(F.col("doc_id"), "pack-1:"))), "tokens")
    # Ranges hold like numbers of tokens, not of documents: a long one counts as often as it has WEIGHT tokens.
    weighted = rows.select(F.explode(F.array_repeat("key", F.greatest(F.lit(1), F.round(F.col("n") / WEIGHT)).cast("int"))).alias("key"))
    bounds = weighted.select(F.percentile_approx("key", [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0]
    edges, times = np.unique(np.array(bounds or [0], dtype=np.int64), return_counts=True)
    base = np.concatenate([[0], np.cumsum(times)])

    @F.pandas_udf("int")
    def range_of(key: pd.Series, tie: pd.Series) -> pd.Series:
        # Keys above an edge come after it. A key that is an edge more than once gets as many ranges, dealt by the tie.
        k, t = key.to_numpy(), tie.to_numpy()
        i = np.searchsorted(edges, k, side="left")
        on = edges[np.minimum(i, len(edges) - 1)] == k
        many = np.where(on, times[np.minimum(i, len(edges) - 1)], 1)
        return pd.Series((base[i] + np.where(on, (t * many) >> 32, 0)).astype("int32"))

    ranged = rows.withColumn("range", range_of("key", "tie"))
    sums = dict(ranged.groupBy("range").agg(F.sum("n")).collect())
    before, total = {}, 0
    for r in sorted(sums):
        before[r], total = total, total + sums[r]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, at = None, 0
        for batch in batches:
            out: list[tuple] = []
            for doc, n, key, ids, r in zip(*(batch.column(c) for c in ("doc_id", "n", "key", "ids", "range"))):
                if r.as_py() != current:
                    current = r.as_py()
                    at = before[current]
                doc, n, key, cell, start = doc.as_py(), n.as_py(), key.as_py(), ids.as_buffer(), 0
                ids = np.frombuffer(cell, "<u2" if cell.size == 2 * n else "<u4").astype("<u4")
                while start < n:
                    size = min(n - start, length - at % length)
                    piece = ids[start : start + size]
                    out.append((doc, start, size, zlib.crc32(piece), n, at // length, at % length, key, *([piece.astype(np.int32)] if with_ids else [])))
                    start, at = start + size, at + size
            columns = list(zip(*out)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "curve_key"] + ["ids"] * with_ids
    types = [pa.int64()] * 8 + [pa.list_(pa.int32())] * with_ids
    schema = ", ".join(f"{n} long" for n in names[:8]) + ", ids array<int>" * with_ids
    ordered = ranged.repartitionById(ranges, "range").sortWithinPartitions("range", "key", "tie", "ids")
    return ordered.select("doc_id", "n", "key", "ids", "range").mapInArrow(cut, schema)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op7_packing": op7_packing}
ORACLE: dict[str, str] = {}
