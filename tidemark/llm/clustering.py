"""Operator 12, clustering by centroids with Hamerly's bounds, in exact integers.

Each vector keeps its cluster, one upper bound of its distance to that centroid and one lower bound of its distance to any other. When
the centroids have moved, the upper bound grows by its own centroid's drift and the lower one shrinks by the largest drift of the
others. Where the upper bound is below the lower one, or below half the way to the nearest other centroid, the cluster stays as it is
and no distance is computed. Other vectors get their own distance first, and if that does not settle it, a full scan of all
centroids in exact integers, where the smaller number wins a tie. Bounds are doubles, rounded outwards, and only strict
comparisons settle anything, so the clusters are those of a full scan of every vector.

Each round writes the vectors with their bounds to the shared folder, reads them once more for those that changed their cluster, and
deletes the table of the round before: a lost executor costs a part of one round. Only changes are summed, in each task first; what
reaches the driver is a number for each centroid and component, and the centroids themselves are what every task gets. Their number
is a parameter, no vector is grouped with others, and a vector that occurs any number of times is a row like another.

Defined results: vectors of another length and such with a null or a component that is not finite are left out, a null vector too; a
null id is hashed as the word ``null``; repeated rows are clustered each by itself; equal ids are put in order by their components
when centroids are chosen; with fewer vectors than centroids there are as many centroids as vectors; an empty table gives an empty
result; a component of more than 2^27 after scaling counts as 2^27, so that squared distances fit 64 bits; an inertia that does not
fit them is null; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import delete_folder, finished, intermediates, materialise, materialise_at, table

DIMS, SCALE, CENTROIDS, ROUNDS, SEED = 64, 256, 40, 5, "2:"
#: Components beyond this are cut off, and those below LARGE are multiplied as doubles, in which sums of their products are exact.
MOST, LARGE = 1 << 27, 1 << 22
#: Relative width by which a bound is rounded outwards, far above the error of the few operations that it comes from.
ROUNDING = 1e-12
STATE = "vec_id long, v binary, cluster int, was int, upper double, lower double"


def quantised(vectors: DataFrame, column: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): the vectors that are kept, their components floor(scale * x) as little-endian integers of 16 bits, or 32 where one needs it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.equal(pc.list_value_length(batch.column(column)), dims))
            if not batch.num_rows:
                continue
            flat = batch.column(column).flatten().cast(pa.float64())
            x = flat.to_numpy(zero_copy_only=False).reshape(-1, dims)  # a null is NaN here
            good = np.isfinite(x).all(axis=1)
            with np.errstate(over="ignore"):
                whole = np.clip(np.floor(scale * x[good]), -MOST, MOST).astype("<i4")
            short = (np.abs(whole) < 1 << 15).all(axis=1)
            cells = [(row.astype("<i2") if s else row).tobytes() for row, s in zip(whole, short)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").filter(pa.array(good)), pa.array(cells, pa.binary())], ["vec_id", "v"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column)).mapInArrow(run, "vec_id long, v binary")


def unpacked(cells: list[bytes], dims: int) -> np.ndarray:
    """Cells of ``quantised`` as rows of 64-bit integers."""
    out = np.empty((len(cells), dims), dtype=np.int64)
    for i, cell in enumerate(cells):
        out[i] = np.frombuffer(cell, "<i2" if len(cell) == 2 * dims else "<i4")
    return out


def squared_distances(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of all vectors to all centroids; by doubles where every number stays below 2^53."""
    if max(np.abs(v).max(initial=0), np.abs(centroids).max(initial=0)) ** 2 * v.shape[1] * 4 < 1 << 53:
        a, b = v.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2.0 * (a @ b.T) + (b * b).sum(axis=1)[None, :]).astype(np.int64)
    out = np.empty((len(v), len(centroids)), dtype=np.int64)
    for j, c in enumerate(centroids):
        out[:, j] = ((v - c) ** 2).sum(axis=1)
    return out


def own_distances(v: np.ndarray, centroids: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    """Exact squared distance of each vector to the centroid of its cluster."""
    return ((v - centroids[cluster]) ** 2).sum(axis=1)


def half_gaps(centroids: np.ndarray) -> np.ndarray:
    """For each centroid half its distance to the nearest other one, rounded down; infinite for a single one."""
    gaps = squared_distances(centroids, centroids).astype(np.float64)
    np.fill_diagonal(gaps, np.inf)
    return np.sqrt(gaps.min(axis=1)) / 2 * (1 - ROUNDING)


def drifts(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """How far each centroid moved, rounded up."""
    return np.sqrt(((new - old) ** 2).sum(axis=1).astype(np.float64)) * (1 + ROUNDING)


def reassigned(v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One round for a batch: cluster, upper, lower, and which vectors were scanned in full. A cluster of -1 is none yet."""
    cluster, fresh = cluster.copy(), cluster < 0
    order = np.argsort(-moved, kind="stable")
    # The largest drift of the other centroids is the largest of all, or the second for the one that moved most.
    others = np.full(len(moved), moved[order[0]])
    others[order[0]] = moved[order[1]] if len(moved) > 1 else 0.0
    at = np.maximum(cluster, 0)
    upper = np.where(fresh, np.inf, (upper + moved[at]) * (1 + ROUNDING))
    lower = np.where(fresh, -np.inf, lower - others[at])
    lower -= np.abs(lower) * ROUNDING
    safe = np.where(fresh, -np.inf, np.maximum(lower, half_gaps(centroids)[at]))
    doubt = np.flatnonzero(~(upper < safe))
    known = doubt[~fresh[doubt]]
    upper[known] = np.sqrt(own_distances(v[known], centroids, cluster[known]).astype(np.float64)) * (1 + ROUNDING)
    scan = doubt[~(upper[doubt] < safe[doubt])]
    if len(scan):
        distances = squared_distances(v[scan], centroids)
        best = distances.argmin(axis=1)  # the first of equal ones
        rows = np.arange(len(scan))
        cluster[scan] = best
        upper[scan] = np.sqrt(distances[rows, best].astype(np.float64)) * (1 + ROUNDING)
        distances[rows, best] = np.iinfo(np.int64).max
        second = np.sqrt(distances.min(axis=1).astype(np.float64)) * (1 - ROUNDING)
        lower[scan] = second if len(centroids) > 1 else np.finfo(float).max
    scanned = np.zeros(len(v), dtype=bool)
    scanned[scan] = True
    return cluster, upper, lower, scanned


def next_round(state: DataFrame, centroids: np.ndarray, moved: np.ndarray) -> DataFrame:
    """The vectors with their cluster and bounds for ``centroids``, which moved by ``moved`` since the round before."""
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                was, upper, lower = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cluster", "upper", "lower"))
                cluster, upper, lower, _ = reassigned(unpacked(batch.column("v").to_pylist(), dims), was, upper, lower, centroids, moved)
                columns = [batch.column("vec_id"), batch.column("v"), pa.array(cluster, pa.int32()), pa.array(was, pa.int32()), pa.array(upper), pa.array(lower)]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "v", "cluster", "was", "upper", "lower"])

    return state.select("vec_id", "v", "cluster", "upper", "lower").mapInArrow(run, STATE)


def changes(state: DataFrame, k: int, dims: int) -> list[tuple[int, int, int]]:
    """(cluster, place, amount): what the vectors that changed their cluster add to its components, or take from them; place ``dims`` counts them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dims + 1), dtype=np.int64)
        for batch in batches:
            v = np.column_stack([unpacked(batch.column("v").to_pylist(), dims), np.ones(batch.num_rows, dtype=np.int64)])
            was = batch.column("was").to_numpy()
            np.add.at(total, batch.column("cluster").to_numpy(), v)
            np.subtract.at(total, was[was >= 0], v[was >= 0])
        cluster, place = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cluster, pa.int32()), pa.array(place, pa.int32()), pa.array(total[cluster, place])], ["cluster", "place", "amount"])

    parts = state.filter("cluster <> was").select("v", "cluster", "was").mapInArrow(run, "cluster int, place int, amount long")
    sums = parts.groupBy("cluster", "place").agg(F.sum(F.col("amount").cast("decimal(38,0)")).alias("amount"))
    return [(r.cluster, r.place, int(r.amount)) for r in sums.collect()]


def first_centroids(vectors: DataFrame, k: int, dims: int, seed: str = SEED) -> np.ndarray:
    """The k vectors whose ids have the smallest hashes, in that order."""
    hashed = vectors.select(F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))).cast("binary"), 256).alias("h"), "v")
    return unpacked([bytes(r.v) for r in hashed.orderBy("h", "v").limit(k).collect()], dims)


def clustered(vectors: DataFrame, column: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: str = SEED) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of the vectors that are kept, written, and the final centroids."""
    spark = vectors.sparkSession
    start = quantised(vectors, column, dims, scale).withColumns({"cluster": F.lit(-1), "was": F.lit(-1), "upper": F.lit(float("inf")), "lower": F.lit(0.0)})
    with intermediates(spark):
        state, path = materialise_at(start, "vectors")
        centroids = first_centroids(state, k, dims, seed)
        sums, moved = np.zeros((len(centroids), dims + 1), dtype=object), np.zeros(len(centroids))
        for i in range((rounds + 1) * (len(centroids) > 0)):
            before, (state, path) = path, materialise_at(next_round(state, centroids, moved), f"vectors-{i}")
            delete_folder(spark, before)
            if i == rounds:
                break
            for cluster, place, amount in changes(state, len(centroids), dims):
                sums[cluster, place] += amount
            # Python's integers: of any size, and // rounds down.
            new = np.array([[s // row[dims] for s in row[:dims]] if row[dims] else c for row, c in zip(sums.tolist(), centroids.tolist())], dtype=np.int64)
            moved, centroids = drifts(centroids, new), new

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                distance = own_distances(unpacked(batch.column("v").to_pylist(), dims), centroids, batch.column("cluster").to_numpy())
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("cluster"), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"])

        return finished(state.select("vec_id", "v", "cluster").mapInArrow(measure, "vec_id long, cluster int, distance long"), "clusters"), centroids


def with_inertia(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Add cluster_inertia, inertia and centroid_sha256 to (vec_id, cluster, distance)."""
    spark = rows.sparkSession
    sums = {r.cluster: int(r.s) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # a row a centroid
    fits = lambda n: n if n < 1 << 63 else None
    total = fits(sum(sums.values()))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    each = spark.createDataFrame([(j, fits(s), total, digests[j]) for j, s in sorted(sums.items())], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_inertia(*clustered(table(spark, sf_dir, "embeddings")))


def _oracle(k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE) -> str:
    """Full scans, a round after the other."""
    nearest = lambda i: f"""
d{i} AS MATERIALIZED (SELECT rid, j, sum((x - c) * (x - c)) AS d FROM e JOIN c{i} USING (p) GROUP BY rid, j),
a{i} AS MATERIALIZED (SELECT rid, arg_min(j, d * {k} + j) AS j, min(d) AS d FROM d{i} GROUP BY rid)"""  # noqa: E731
    moved = lambda i: f"""
s{i} AS MATERIALIZED (SELECT j, p, sum(x) AS s, count(*) AS n FROM e JOIN a{i} USING (rid) GROUP BY j, p),
c{i + 1} AS MATERIALIZED (SELECT j, p, CASE WHEN s IS NULL THEN c ELSE ((s - ((s % n) + n) % n) // n)::BIGINT END AS c FROM c{i} LEFT JOIN s{i} USING (j, p))"""  # noqa: E731
    steps = "".join(f",{nearest(i)},{moved(i)}" for i in range(rounds)) + f",{nearest(rounds)}"
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS xs FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
e AS MATERIALIZED (SELECT rid, unnest(range(1, {dims} + 1)) AS p, unnest(xs) AS x FROM v),
f AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || coalesce(vec_id::VARCHAR, 'null'))) - 1 AS j, rid FROM v QUALIFY j < {k}),
c0 AS MATERIALIZED (SELECT j, p, x AS c FROM f JOIN e USING (rid)){steps},
h AS (SELECT j, sha256(string_agg(c::VARCHAR, ',' ORDER BY p)) AS digest FROM c{rounds} GROUP BY j),
i AS (SELECT j, sum(d)::BIGINT AS own FROM a{rounds} GROUP BY j)
SELECT vec_id, a.j::INT AS cluster, a.d::BIGINT AS distance, i.own AS cluster_inertia, (SELECT sum(d)::BIGINT FROM a{rounds}) AS inertia, h.digest AS centroid_sha256
FROM v JOIN a{rounds} a USING (rid) JOIN h ON h.j = a.j JOIN i ON i.j = a.j"""


QUERIES = {"op12_centroid_clusters": op12_centroid_clusters}
ORACLE = {"op12_centroid_clusters": _oracle()}
