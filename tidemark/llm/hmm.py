"""Operator 4, a hidden Markov language model over all texts.

Latent states pass from token to token; a state emits a class of tokens and the class its token. Classes are hash bins, so the
states' tables have a size set by parameters, while each token's share of its class comes from its exact count in the training
texts, which grows with the corpus. Baum-Welch runs on Spark: every task adds up the expected counts of its texts under the
current parameters, the counts are summed across partitions, and the next parameters are made from the sums. The score is the
exact likelihood by the forward recursion, scaled at each token.

A token's count is found without a dictionary in any task: each block of texts lists its distinct tokens with the documents
that hold them; the lists are joined with the counts by token (a join that can be split where a token is in every block) and
added up by block. A block is bounded in tokens by ``BLOCK_TOKENS`` and one text.

Defined results: a null or empty text is one end token; with no training texts every token is unknown, the base score is what
the formula gives with N = 0 and V = 0, and the model is uniform; an empty table gives an empty result; repeated rows are
scored alike, and each one counts in training; a row with a null id is scored and held out; further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, table

STATES, CLASSES, ROUNDS, BLOCK_TOKENS, SEED = 4, 1 << 14, 4, 1_000_000, 7
#: The end of a text. No word holds a space.
END = b" "
SMOOTH = 0.1


def token_codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Code of every token (the end token after each text's words), tokens a text, and the distinct tokens by code."""
    # bytes.lower() changes A-Z alone, and bytes.split() splits at space and 9 to 13 alone.
    codes: dict[bytes, int] = {}
    known = codes.setdefault
    flat, lengths = [], np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        tokens = text.lower().split()
        tokens.append(END)
        lengths[i] = len(tokens)
        flat.append(np.fromiter((known(t, len(codes)) for t in tokens), dtype=np.int32, count=len(tokens)))
    return (np.concatenate(flat) if flat else np.zeros(0, np.int32)), lengths, list(codes)


def token_class(tokens: list[bytes]) -> np.ndarray:
    import zlib

    return np.fromiter((zlib.crc32(t) % CLASSES for t in tokens), dtype=np.uint16, count=len(tokens))


BLOCK_SCHEMA = "kind int, block long, doc_id long, doc int, train boolean, n long, classes binary, token binary, train_count long, held binary"
BLOCK_FIELDS = pa.schema([
    ("kind", pa.int32()), ("block", pa.int64()), ("doc_id", pa.int64()), ("doc", pa.int32()), ("train", pa.bool_()), ("n", pa.int64()), ("classes", pa.binary()),
    ("token", pa.binary()), ("train_count", pa.int64()), ("held", pa.binary()),
])
#: One entry of ``held``: a document of the block, and how often it holds the token; more than the most are several entries.
ENTRY = np.dtype([("doc", "<u2"), ("times", "<u2")])
MOST_DOCS = MOST_TIMES = 65_535


def entries_of(codes: np.ndarray, owner: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Code and entry for every token and document that holds it, in order of codes."""
    pairs, times = np.unique(codes.astype(np.int64) * docs + owner, return_counts=True)
    if len(times) and times.max() > MOST_TIMES:
        parts = -(-times // MOST_TIMES)
        first = np.repeat(np.cumsum(parts) - parts, parts) == np.arange(parts.sum())
        rest = np.repeat(times - (parts - 1) * MOST_TIMES, parts)
        pairs, times = np.repeat(pairs, parts), np.where(first, rest, MOST_TIMES)
    entries = np.empty(len(pairs), dtype=ENTRY)
    entries["doc"], entries["times"] = pairs % docs, times
    return pairs // docs, entries


def blocks_of(docs: DataFrame) -> DataFrame:
    """(doc_id, train, text) to rows of two kinds: 0, a document's token classes; 1, a block's token with the documents that hold it."""

    def batch_of(**columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in BLOCK_FIELDS], schema=BLOCK_FIELDS)

    def one(block: int, ids: list, trains: list, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        codes, lengths, tokens = token_codes(texts)
        classes = token_class(tokens)[codes]
        cells = [classes[e - n : e].tobytes() for e, n in zip(np.cumsum(lengths), lengths)]
        rows = len(ids)
        yield batch_of(
            kind=pa.array(np.zeros(rows, np.int32)), block=pa.array(np.full(rows, block)), doc_id=pa.array(ids, pa.int64()), doc=pa.array(np.arange(rows, dtype=np.int32)),
            train=pa.array(trains, pa.bool_()), n=pa.array(lengths), classes=pa.array(cells, pa.binary()),
        )
        which, entries = entries_of(codes, np.repeat(np.arange(rows), lengths), rows)
        offsets = np.searchsorted(which, np.arange(len(tokens) + 1))
        trained = np.bincount(which, weights=entries["times"] * np.array(trains)[entries["doc"]], minlength=len(tokens)).astype(np.int64)
        step = 50_000
        for a in range(0, len(tokens), step):
            b = min(a + step, len(tokens))
            lo, hi = offsets[a], offsets[b]
            at = ((offsets[a : b + 1] - lo) * ENTRY.itemsize).astype(np.int32)
            held = pa.BinaryArray.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(entries[lo:hi].tobytes())])
            yield batch_of(kind=pa.array(np.ones(b - a, np.int32)), block=pa.array(np.full(b - a, block)), token=pa.array(tokens[a:b], pa.binary()), train_count=pa.array(trained[a:b]), held=held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = count(TaskContext.get().partitionId() << 32)
        ids, trains, texts, size = [], [], [], 0
        for batch in batches:
            for doc_id, train, text in zip(batch.column("doc_id").to_pylist(), batch.column("train").to_pylist(), batch.column("text")):
                text = (text.as_py() or "").encode()
                if texts and (size + len(text) > 6 * BLOCK_TOKENS or len(texts) == MOST_DOCS):
                    yield from one(next(number), ids, trains, texts)
                    ids, trains, texts, size = [], [], [], 0
                ids.append(doc_id)
                trains.append(train)
                texts.append(text)
                size += len(text)
        if texts:
            yield from one(next(number), ids, trains, texts)

    return docs.select("doc_id", "train", "text").mapInArrow(run, BLOCK_SCHEMA)


class Hmm:
    """Start, transition and class emission probabilities of the latent states."""

    def __init__(self, start: np.ndarray, step: np.ndarray, emit: np.ndarray):
        self.start, self.step, self.emit = start, step, emit

    @classmethod
    def initial(cls, class_counts: np.ndarray, states: int = STATES, seed: int = SEED) -> Hmm:
        """States that tend to last, each with the classes' shares shaken at random."""
        shaken = (class_counts + 1.0) * np.random.default_rng(seed).gamma(1.0, 1.0, (states, len(class_counts)))
        step = np.full((states, states), 0.05 / max(states - 1, 1))
        np.fill_diagonal(step, 0.95 if states > 1 else 1.0)
        return cls(np.full(states, 1 / states), step, shaken / shaken.sum(axis=1, keepdims=True))

    def lanes(self, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sequences laid side by side, longest first: their order, the classes step by step, and where each step begins."""
        lengths = np.array([len(s) for s in sequences])
        order = np.argsort(-lengths, kind="stable")
        active = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(1, lengths.max() + 1))
        begins = np.concatenate([[0], np.cumsum(active)])
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        where = np.concatenate([begins[: len(s)] + r for s, r in zip(sequences, rank)])
        laid = np.empty(begins[-1], dtype=np.int64)
        laid[where] = np.concatenate(sequences)
        return order, laid, begins

    def forward(self, laid: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scaled forward probabilities of every step and the scales; the likelihood is the product of a sequence's scales."""
        seen = self.emit.T.copy()[laid]
        scale = np.empty(len(laid))
        for t in range(len(begins) - 1):
            a, b = begins[t], begins[t + 1]
            now = seen[a:b]
            now *= self.start if t == 0 else seen[begins[t - 1] : begins[t - 1] + b - a] @ self.step
            total = now.sum(axis=1)
            scale[a:b] = total
            now /= total[:, None]
        return seen, scale

    def log_likelihoods(self, sequences: list[np.ndarray]) -> np.ndarray:
        order, laid, begins = self.lanes(sequences)
        _, scale = self.forward(laid, begins)
        logs = np.log10(scale)
        out = np.zeros(len(sequences))
        for t in range(len(begins) - 1):
            out[: begins[t + 1] - begins[t]] += logs[begins[t] : begins[t + 1]]
        back = np.empty(len(order))
        back[order] = out
        return back

    def expected(self, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected starts, transitions and emissions, and the log-likelihood: what Baum-Welch adds up."""
        _, laid, begins = self.lanes(sequences)
        alpha, scale = self.forward(laid, begins)
        emit = self.emit.T.copy()
        back_step = self.step.T.copy()
        states = len(self.start)
        beta = np.ones((begins[1], states))
        moves = np.zeros((states, states))
        gamma = alpha  # turned into gamma from the last step to the first
        for t in range(len(begins) - 2, 0, -1):
            a, b = begins[t], begins[t + 1]
            p, n = begins[t - 1], b - a
            ahead = emit[laid[a:b]] * beta[:n] / scale[a:b, None]
            moves += alpha[p : p + n].T @ ahead
            gamma[a:b] *= beta[:n]
            beta[:n] = ahead @ back_step
        gamma[: begins[1]] *= beta
        emissions = np.stack([np.bincount(laid, weights=gamma[:, k], minlength=self.emit.shape[1]) for k in range(states)])
        return gamma[: begins[1]].sum(axis=0), moves * self.step, emissions, float(np.log(scale).sum())


def batches_of(batches: Iterator[pa.RecordBatch], column: str, most: int = BLOCK_TOKENS) -> Iterator[tuple[list[dict], list[np.ndarray]]]:
    """Rows with their sequences of classes, in groups of about ``most`` tokens."""
    rows, sequences, size = [], [], 0
    for batch in batches:
        others = batch.select([c for c in batch.schema.names if c != column]).to_pylist()
        for row, cell in zip(others, batch.column(column)):
            sequences.append(np.frombuffer(cell.as_buffer(), dtype=np.uint16))
            rows.append(row)
            size += len(sequences[-1])
            if size >= most:
                yield rows, sequences
                rows, sequences, size = [], [], 0
    if rows:
        yield rows, sequences


def baum_welch(texts: DataFrame, class_counts: np.ndarray, states: int = STATES, rounds: int = ROUNDS, seed: int = SEED) -> Hmm:
    """Train on the written rows (classes). A round's sums are states x classes numbers, whatever the corpus."""
    model = Hmm.initial(class_counts, states, seed)
    classes = len(class_counts)
    for _ in range(rounds if class_counts.sum() else 0):

        def add_up(batches: Iterator[pa.RecordBatch], model: Hmm = model) -> Iterator[pa.RecordBatch]:
            start, moves, emissions = np.zeros(states), np.zeros((states, states)), np.zeros((states, classes))
            for _, sequences in batches_of(batches, "classes", 3 * BLOCK_TOKENS):
                s, m, e, _ = model.expected(sequences)
                start, moves, emissions = start + s, moves + m, emissions + e
            flat = np.concatenate([start, moves.ravel(), emissions.ravel()])
            used = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(flat[used])], ["cell", "value"])

        sums = texts.select("classes").mapInArrow(add_up, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).toPandas()
        flat = np.zeros(states + states * states + states * classes)
        flat[sums.cell] = sums.value
        start, moves, emissions = flat[:states] + 1.0, flat[states : states + states**2].reshape(states, states) + 1.0, flat[states + states**2 :].reshape(states, classes)
        prior = (class_counts + 0.1) / (class_counts + 0.1).sum()
        emissions = emissions + 20.0 * prior
        model = Hmm(start / start.sum(), moves / moves.sum(axis=1, keepdims=True), emissions / emissions.sum(axis=1, keepdims=True))
    return model


SUMS = "block long, docs binary, logs binary, known binary"


def combined(batches: Iterator[pa.RecordBatch], most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Rows (block, held, c) to sums by block and document, of some millions of entries at a time: what is shuffled is sums, not tokens."""

    def emit(parts: list) -> pa.RecordBatch:
        block, doc, logs, known = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 4
        order = np.lexsort((doc, block))
        block, doc, logs, known = block[order], doc[order], logs[order], known[order]
        new = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (doc[1:] != doc[:-1])])) if len(block) else np.zeros(0, np.int64)
        if len(new):
            block, doc, logs, known = block[new], doc[new], np.add.reduceat(logs, new), np.add.reduceat(known, new)
        cuts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else np.zeros(0, np.int64)
        spans = list(zip(cuts, [*cuts[1:], len(block)]))
        cells = [[x[a:b].astype(t).tobytes() for a, b in spans] for x, t in ((doc, "<u2"), (logs, "<f8"), (known, "<u4"))]
        return pa.RecordBatch.from_arrays([pa.array(block[cuts], pa.int64()), *[pa.array(c, pa.binary()) for c in cells]], ["block", "docs", "logs", "known"])

    parts, size = [], 0
    for batch in batches:
        held = batch.column("held")
        lengths = pc.binary_length(held).to_numpy() // ENTRY.itemsize
        entries = np.frombuffer(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held), b"")[0].as_buffer(), dtype=ENTRY)
        c, times = np.repeat(batch.column("c").to_numpy(), lengths), entries["times"].astype(np.int64)
        parts.append((np.repeat(batch.column("block").to_numpy(), lengths), entries["doc"], times * np.log10(c + SMOOTH), times * (c > 0)))
        size += len(entries)
        if size >= most:
            yield emit(parts)
            parts, size = [], 0
    yield emit(parts)


def block_sums(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of one block by document."""
    logs, known, size = np.zeros(MOST_DOCS + 1), np.zeros(MOST_DOCS + 1, dtype=np.int64), 0
    for batch in batches:
        for docs, some, n in zip(batch.column("docs"), batch.column("logs"), batch.column("known")):
            at = np.frombuffer(docs.as_buffer(), dtype="<u2")  # each document once
            logs[at] += np.frombuffer(some.as_buffer(), dtype="<f8")
            known[at] += np.frombuffer(n.as_buffer(), dtype="<u4")
            size = max(size, int(at[-1]) + 1)  # in order, and never none
    yield pa.RecordBatch.from_arrays([pa.array(np.full(size, key[0].as_py())), pa.array(np.arange(size, dtype=np.int32)), pa.array(logs[:size]), pa.array(known[:size])], ["block", "doc", "logs", "known"])


def score_texts(docs: DataFrame, train: Column, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, text) to doc_id, train, n_tokens, n_known, train_tokens, base_score and score."""
    blocks = materialise(blocks_of(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(train, F.lit(False)).alias("train"), "text")), "hmm-blocks")
    texts, tokens = blocks.filter("kind = 0").select("block", "doc", "doc_id", "train", "n", "classes"), blocks.filter("kind = 1")
    counts = materialise(tokens.filter("train_count > 0").groupBy("token").agg(F.sum("train_count").alias("c")), "hmm-counts")
    per_class = counts.groupBy((F.crc32("token") % CLASSES).cast("int").alias("class")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).toPandas()
    class_counts, class_tokens = np.zeros(CLASSES), np.zeros(CLASSES)
    class_counts[per_class["class"]], class_tokens[per_class["class"]] = per_class.c, per_class.v
    total, distinct = int(class_counts.sum()), int(class_tokens.sum())

    model = baum_welch(texts.filter("train"), class_counts, states, rounds)
    # A token's share of its class, its part that does not depend on the token.
    share = np.log10(class_counts + SMOOTH * (class_tokens + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, sequences in batches_of(batches, "classes", 3 * BLOCK_TOKENS):
            scores = model.log_likelihoods(sequences) - np.array([share[s].sum() for s in sequences])
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], t) for k, t in (("block", pa.int64()), ("doc", pa.int32()), ("doc_id", pa.int64()), ("train", pa.bool_()), ("n", pa.int64()))] + [pa.array(scores)],
                ["block", "doc", "doc_id", "train", "n", "part"],
            )

    parts = texts.mapInArrow(run, "block long, doc int, doc_id long, train boolean, n long, part double")

    found = tokens.select("block", "token", "held").join(counts, "token", "left").select("block", "held", F.coalesce("c", F.lit(0)).alias("c"))
    sums = found.mapInArrow(combined, SUMS).groupBy("block").applyInArrow(block_sums, "block long, doc int, logs double, known long")
    all_tokens = math.log10(total + SMOOTH * (distinct + 1))
    return parts.join(sums, ["block", "doc"]).select(
        "doc_id", "train", F.col("n").alias("n_tokens"), F.col("known").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n") * all_tokens).alias("base_score"), (F.col("part") + F.col("logs")).alias("score"),
    )


def op4_hmm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    return score_texts(docs, ~held_out).select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op4_hmm_score": op4_hmm_score}
ORACLE: dict[str, str] = {}
