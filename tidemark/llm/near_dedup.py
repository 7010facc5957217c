"""Operator 6, n-gram Jaccard join: a MinHash LSH forest with exact verification.

A text's set of five-word shingles has a label of ``DEPTH`` MinHash values in each of ``TREES`` trees. The labels of a tree are
sorted, by ranges, and a sorted list is its prefix trie: the values that a label shares with its neighbours say how deep it goes
with company. Texts under one node of a level are candidates. The search begins at full depth and matched prefixes are shortened
while too many links are missed: each link found, with its exact similarity, says how likely its like were found at this level
(and would be at a shorter prefix), so the recall is measured on the links of all texts, and the next level is the
longest prefix that promises the target. ``prefix_depth`` is where even pairs at the similarity sought meet it; nothing goes below.

Copies (equal shingle sets) are one class from the start, and only one of each goes on. Texts gather at the least text that they
meet within two steps through nodes; a gathering is cut into blocks of some ``TILE`` texts, and for each two blocks with a node
in common (and each block with itself) there is one tile, in which all pairs are verified exactly: no pair is written out,
none is verified twice, and a tile's size is bounded, whatever hangs together. A tile returns each text's number of links and one
edge of a spanning forest; components of those edges are the classes.

Defined results: words are lower-cased in A-Z; a text of fewer than five words is one shingle, the whole text; null and empty
texts are copies of one another; an empty table gives an empty result; repeated rows are copies; a null id is allowed, and its
class takes the least id that is not null; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import finished, intermediates, materialise, table, text_slices
from tidemark.llm.components import connected_components

SHINGLE, SIMILARITY, TREES, DEPTH, RECALL, SEED = 5, Fraction(4, 5), 24, 8, 0.9999, 11
#: Documents of one tile side on average.
TILE = 128
#: Steps through nodes within which texts gather.
STEPS = 2


def prefix_depth(similarity: float, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix at which a pair of that similarity shares one in some tree with probability ``recall``."""
    while depth > 1 and detection(similarity, depth, trees) < recall:
        depth -= 1
    return depth


def detection(similarity: np.ndarray | float, depth: int, trees: int = TREES) -> np.ndarray | float:
    """The probability that a pair of that similarity shares a prefix of that depth in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(texts: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of all texts, and the number of each text (repeats included)."""
    codes: dict[bytes, int] = {}
    known = codes.setdefault
    flat, lengths = [], np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        tokens = text.lower().split()
        lengths[i] = len(tokens)
        flat.append(np.fromiter((known(t, len(codes)) for t in tokens), dtype=np.int64, count=len(tokens)))
    if not codes:
        return np.zeros(0, dtype=np.uint64), lengths
    words = np.fromiter((xxhash.xxh64_intdigest(t) for t in codes), dtype=np.uint64, count=len(codes))[np.concatenate(flat)]
    padded = np.concatenate([words, np.zeros(size - 1, dtype=np.uint64)])
    # Words of the next text are not part of a shingle: a text of fewer words is one shingle with zeros for the rest.
    ends = np.cumsum(lengths)
    left = np.repeat(ends, lengths) - np.arange(len(words))
    hashes = np.zeros(len(words), dtype=np.uint64)
    for k in range(size):
        hashes = _mixed(hashes * np.uint64(0x9E3779B97F4A7C15) + np.where(left > k, padded[k : k + len(words)], np.uint64(0)) + np.uint64(k + 1))
    first = np.repeat(ends - lengths, lengths) == np.arange(len(words))
    whole = left >= size
    keep = whole | (first & (np.repeat(lengths, lengths) < size))
    counts = np.where(lengths == 0, 0, np.maximum(lengths - size + 1, 1))
    return hashes[keep], counts


class Forest:
    """MinHash labels of ``trees`` x ``depth`` values."""

    def __init__(self, trees: int, depth: int, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.trees, self.depth = trees, depth
        self.factors = rng.integers(1, 2**63, trees * depth, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def labels(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """One row of 16-bit values per text that has shingles, tree by tree, in the byte order that sorts."""
        starts = np.concatenate([[0], np.cumsum(counts)])[:-1]
        out = np.empty((len(counts), len(self.factors)), dtype=">u2")
        a = 0
        while a < len(counts):  # some 100,000 shingles at a time stay in the processor's cache
            b = max(a + 1, int(np.searchsorted(starts, starts[a] + 100_000)))
            part = hashes[starts[a] : starts[b] if b < len(starts) else len(hashes)]
            at = starts[a:b] - starts[a]
            for j, factor in enumerate(self.factors):
                # The low half of the product shares its low bits among factors; the high half is the hash. Of the least one the low bits stay.
                out[a:b, j] = np.minimum.reduceat(((part * factor) >> np.uint64(32)).astype(np.uint32), at) & 0xFFFF
            a = b
        return out


def labelled(docs: DataFrame, forest: Forest) -> DataFrame:
    """(key, doc_id, text) to (key, doc_id, set, labels): the digest of the shingle set, and the labels of all trees (null: no words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches):
            hashes, counts = shingle_hashes([t.encode() for t in texts])
            ends = np.cumsum(counts)
            sets = [hashlib.blake2b(np.unique(hashes[e - n : e]).tobytes(), digest_size=16).digest() for e, n in zip(ends, counts)]
            some = np.flatnonzero(counts)
            labels: list[bytes | None] = [None] * len(texts)
            if len(some):
                for i, row in zip(some, forest.labels(hashes, counts[some])):
                    labels[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("doc_id"), pa.array(sets, pa.binary()), pa.array(labels, pa.binary())], ["key", "doc_id", "set", "labels"])

    return docs.mapInArrow(run, "key string, doc_id long, set binary, labels binary")


def sorted_tries(members: DataFrame, forest: Forest, least: int) -> DataFrame:
    """(set, labels) to (tree, label, set, depth) of labels with company at ``least`` values or more; ``depth`` is how deep it goes.

    Neighbours in other partitions are not looked at: the first and the last label of each count as deep as can be, and the
    grouping by prefix decides about them.
    """
    width = 2 * forest.depth
    each = F.explode(F.transform(F.sequence(F.lit(0), F.lit(forest.trees - 1)), lambda i: F.struct(i.alias("tree"), F.substring("labels", i * width + 1, F.lit(width)).alias("label"))))
    entries = members.filter("labels IS NOT NULL").select("set", each.alias("e")).select("e.tree", "e.label", "set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, above = None, forest.depth  # the last row seen, and what it shares with the one before it
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            values = np.frombuffer(b"".join(batch.column("label").to_pylist()), dtype=">u2").reshape(-1, forest.depth)
            tree = batch.column("tree").to_numpy()
            same = np.cumprod((values[1:] == values[:-1]) & (tree[1:] == tree[:-1])[:, None], axis=1).sum(axis=1)
            shared = np.concatenate([[above], same]).astype(np.int32)
            depth = np.maximum(shared[:-1], shared[1:])
            whole = pa.RecordBatch.from_arrays([*batch.slice(0, batch.num_rows - 1).columns, pa.array(depth)], ["tree", "label", "set", "depth"])
            yield whole.filter(pa.array(depth >= least))
            held, above = batch.slice(batch.num_rows - 1), int(shared[-1])
        if held is not None:
            yield pa.RecordBatch.from_arrays([*held.columns, pa.array([forest.depth], pa.int32())], ["tree", "label", "set", "depth"])

    ranges = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = entries.repartitionByRange(ranges, "tree", "label", "set").sortWithinPartitions("tree", "label", "set")
    return ordered.mapInArrow(run, "tree int, label binary, set binary, depth int")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(set, copies, text) to (set, copies, shingles): the sorted distinct hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches):
            hashes, counts = shingle_hashes([t.encode() for t in texts])
            cells = [np.unique(hashes[e - n : e]).tobytes() for e, n in zip(np.cumsum(counts), counts)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("set", "copies")] + [pa.array(cells, pa.binary())], ["set", "copies", "shingles"])

    return docs.select("set", "copies", "text").mapInArrow(run, "set binary, copies long, shingles binary")


def linked(left: list[np.ndarray], right: list[np.ndarray], similarity: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Whether each text of ``left`` and each of ``right`` has that Jaccard similarity, from exact counts of common shingles, and the similarities."""
    n, sizes = len(left), np.array([len(s) for s in left + right])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    _, code, times = np.unique(np.concatenate(left + right), return_inverse=True, return_counts=True)
    shared = times[code] > 1
    _, code = np.unique(code[shared], return_inverse=True)
    owner = owner[shared]
    common = np.zeros((n, len(right)), dtype=np.float32)
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    width = 2048
    columns = int(code[-1]) + 1 if len(code) else 0
    for a in range(0, columns, width):
        lo, hi = np.searchsorted(code, [a, a + width])
        part = np.zeros((len(sizes), min(width, columns - a)), dtype=np.float32)
        part[owner[lo:hi], code[lo:hi] - a] = 1
        common += part[:n] @ part[n:].T
    total = sizes[:n, None] + sizes[None, n:]
    # common / (total - common) >= p / q, in whole numbers.
    p, q = similarity.numerator, similarity.denominator
    return (q + p) * common.astype(np.int64) >= p * total, common / np.maximum(total - common, 1)


def verify_tiles(members: DataFrame, similarity: Fraction, trees: int, level: int, depth: int) -> DataFrame:
    """(tile, side, set, copies, shingles), sorted by tile, to (set, links, root, weights).

    ``links`` is the number of documents that the tile links to the text, ``root`` a text that it is connected to in the tile.
    One row of a tile has weights, sums over its linked pairs: of 1 / the probability that such a pair is found at this level,
    then of that fraction times the probability for each level from 1 to ``depth``.
    """

    def solve(rows: list[tuple[int, bytes, int, np.ndarray]]) -> list[tuple[bytes, int, bytes, list[float] | None]]:
        first, second = [r for r in rows if r[0] == 0], [r for r in rows if r[0] == 1]
        within = not second
        if within:
            second = first
        if not first or not second:
            return []
        found, alike = linked([r[3] for r in first], [r[3] for r in second], similarity)
        if within:
            np.fill_diagonal(found, False)
        pairs = alike[np.triu(found) if within else found]
        expected = 1 / detection(pairs, level, trees)
        weights = [float(expected.sum()), *(float((expected * detection(pairs, m, trees)).sum()) for m in range(1, depth + 1))]
        names = [r[1] for r in first] + ([] if within else [r[1] for r in second])
        links = found @ np.array([r[2] for r in second], dtype=np.int64)
        if not within:
            links = np.concatenate([links, found.T @ np.array([r[2] for r in first], dtype=np.int64)])
        # Least reachable place in rounds: each place takes the least of its neighbours', then of its own place's.
        places = np.arange(len(names))
        i, j = np.nonzero(found)
        if not within:
            j = j + len(first)
        while True:
            least = places.copy()
            np.minimum.at(least, i, places[j])
            np.minimum.at(least, j, places[i])
            least = least[least]
            if (least == places).all():
                break
            places = least
        return [(names[k], int(links[k]), names[places[k]], None if n else weights) for n, k in enumerate(np.flatnonzero(links))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rows, out = None, [], []

        def batch_of(out: list) -> pa.RecordBatch:
            columns = list(zip(*out)) or [[], [], [], []]
            types = (pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.float64()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["set", "links", "root", "weights"])

        for batch in batches:
            for tile, side, name, copies, cell in zip(*(batch.column(c) for c in ("tile", "side", "set", "copies", "shingles"))):
                tile = tile.as_py()
                if tile != current:
                    out += solve(rows)
                    current, rows = tile, []
                    if len(out) > 10_000:
                        yield batch_of(out)
                        out = []
                rows.append((side.as_py(), name.as_py(), copies.as_py(), np.frombuffer(cell.as_buffer(), dtype=np.uint64)))
        yield batch_of(out + solve(rows))

    return members.select("tile", "side", "set", "copies", "shingles").mapInArrow(run, "set binary, links long, root binary, weights array<double>")


def gathered(under: DataFrame) -> DataFrame:
    """(set, node) to (set, block): texts that meet within STEPS steps through nodes, in blocks of about TILE."""
    home = under.select("set", F.col("set").alias("home"), "node")
    for _ in range(STEPS):
        # Written, so that the join has two plain shuffles, which Spark can split where a node holds many.
        least = materialise(home.groupBy("node").agg(F.min("home").alias("least")), "least")
        nearer = materialise(under.join(least, "node").groupBy("set").agg(F.min("least").alias("home")), "home")
        home = under.join(nearer, "set")
    sizes = materialise(nearer.groupBy("home").agg(F.count(F.lit(1)).alias("size")), "sizes")
    number = F.pmod(F.xxhash64("set"), F.ceil(F.col("size") / TILE))
    return nearer.join(sizes, "home").select("set", F.concat_ws("/", F.hex("home"), number).alias("block"))


def verified_at(level: int, tries: DataFrame, shingles: DataFrame, similarity: Fraction, forest: Forest) -> DataFrame | None:
    """``verify_tiles`` of all texts that share a prefix of ``level`` values in some tree; None if no two do."""
    node = F.xxhash64("tree", F.substring("label", 1, 2 * level))
    alive = tries.filter(F.col("depth") >= level).select("set", node.alias("node"))
    shared = materialise(alive.groupBy("node").agg(F.min("set").alias("least"), F.max("set").alias("last")).filter("least <> last").select("node"), "shared")
    under = materialise(alive.join(shared, "node").select("set", "node"), "under")
    if under.isEmpty():
        return None
    homes = materialise(gathered(under), "blocks")
    # The blocks of each node, and each two of them that some node has in common: what is paired is blocks, not texts.
    blocks = materialise(under.join(homes, "set").select("node", "block").distinct(), "node-blocks")
    split = materialise(blocks.groupBy("node").agg(F.min("block").alias("a"), F.max("block").alias("b")).filter("a <> b").select("node"), "split")
    across = blocks.join(split, "node")
    others = across.select("node", F.col("block").alias("other"))
    pairs = across.join(others, "node").filter("block < other").select("block", "other").distinct()
    tile = F.concat_ws(" ", "block", "other")
    own = homes.select("block").distinct().select("block", F.concat_ws(" ", "block", "block").alias("tile"), F.lit(0).alias("side"))
    pairs = materialise(pairs.select("block", "other", tile.alias("tile")), "block-pairs")
    places = own.union(pairs.select("block", "tile", F.lit(0))).union(pairs.select("other", "tile", F.lit(1)))
    members = homes.join(materialise(places, "tiles"), "block").join(shingles, "set")
    tiles = members.select("tile", "side", "set", "copies", "shingles").repartition("tile").sortWithinPartitions("tile")
    return materialise(verify_tiles(tiles, similarity, forest.trees, level, forest.depth), "verified")


def missed_shares(verified: DataFrame, similarity: float, forest: Forest) -> list[float]:
    """The share of links that a search at each level from 1 on is estimated to miss, from the links found at one.

    One more link at the similarity sought is added to those found, so that few links don't promise much.
    """
    sums = dict(verified.select(F.posexplode("weights").alias("k", "w")).groupBy("k").agg(F.sum("w")).collect())
    total = sums.get(0, 0.0)
    return [(total - sums.get(m, 0.0) + 1 - detection(similarity, m, forest.trees)) / (total + 1) for m in range(1, forest.depth + 1)]


def search(tries: DataFrame, shingles: DataFrame, similarity: Fraction, forest: Forest, recall: float) -> tuple[DataFrame | None, int]:
    """The verified tiles at the first level, from full depth on, whose measured recall is ``recall``; and that level."""
    least = prefix_depth(float(similarity), forest.trees, forest.depth, recall)
    level = forest.depth
    while True:
        verified = verified_at(level, tries, shingles, similarity, forest)
        if level == least:
            return verified, level
        if verified is None:
            level -= 1
            continue
        missed = missed_shares(verified, float(similarity), forest)
        if missed[level - 1] <= 1 - recall:
            return verified, level
        level = max((m for m in range(least, level) if missed[m - 1] <= 1 - recall), default=least)


def near_duplicates(docs: DataFrame, similarity: Fraction = SIMILARITY, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> DataFrame:
    """(doc_id, text) to one row per document: key, doc_id, class_id, class_size, n_links, kept.

    ``class_id`` is the least id of the class, ``n_links`` the number of other documents with at least that similarity, and
    ``kept`` marks one document of each class.
    """
    spark, forest = docs.sparkSession, Forest(trees, depth)
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(F.concat_ws(":", F.md5(text.cast("binary")), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    with intermediates(spark):
        rows = materialise(labelled(keyed, forest), "labels")
        # One text of each set goes on, under the set's name.
        sets = materialise(rows.groupBy("set").agg(F.max("key").alias("key"), F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least_id")), "sets")
        members = materialise(rows.join(sets.select("set", "key"), ["set", "key"]).groupBy("set", "key").agg(F.first("labels").alias("labels")), "members")
        tries = materialise(sorted_tries(members, forest, prefix_depth(float(similarity), trees, depth, recall)), "tries")
        wanted = tries.select("set").distinct().join(sets.select("set", "key", "copies"), "set").withColumnRenamed("key", "_key")
        texts = keyed.select("key", "text").join(wanted, F.col("key") == F.col("_key"))
        shingles = materialise(shingle_sets(texts).groupBy("set", "copies").agg(F.first("shingles").alias("shingles")), "shingles")
        verified, _ = search(tries, shingles, similarity, forest, recall)
        named = sets
        if verified is None:
            named = named.withColumns({"component": F.col("set"), "links": F.lit(0).cast("long")})
        else:
            links = verified.groupBy("set").agg(F.sum("links").alias("links"))
            classes = connected_components(verified.select(F.col("set").alias("a"), F.col("root").alias("b"))).withColumnsRenamed({"node": "set"})
            named = named.join(classes, "set", "left").join(links, "set", "left").withColumn("component", F.coalesce("component", "set")).withColumn("links", F.coalesce("links", F.lit(0).cast("long")))
        named = materialise(named, "classes")
        ids = materialise(named.groupBy("component").agg(F.min("least_id").alias("class_id"), F.max("key").alias("kept_key"), F.sum("copies").alias("class_size")), "class-ids")
        full = named.join(ids, "component").select("set", "class_id", "class_size", (F.col("links") + F.col("copies") - 1).alias("n_links"), "kept_key")
        out = rows.select("key", "doc_id", "set").join(full, "set").select("key", "doc_id", "class_id", "class_size", "n_links", (F.col("key") == F.col("kept_key")).alias("kept"))
        return finished(out, "near-duplicates")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with all their columns, one for each near-duplicate class."""
    columns = docs.columns
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.concat_ws(":", F.md5(text.cast("binary")), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    kept = near_duplicates(docs.select("doc_id", "text")).filter("kept").select("key").distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), key.alias("key"))
    # Rows that share both text and id are the same document delivered again: the one whose columns are the greatest as text stays.
    return rows.join(kept, "key").groupBy("key").agg(F.max_by("_row", F.to_json("_row")).alias("_row")).select("_row.*")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "class_id", "class_size", "n_links", "kept")


QUERIES = {"op6_near_dedup": op6_near_dedup}
ORACLE: dict[str, str] = {}
