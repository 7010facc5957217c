"""Operator 9, sharding: a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` points of a ring of 2^32 places; a document hashes to a place and belongs to the next point
clockwise. A shard holds a fixed load at most: what overflows continues clockwise to shards with room. How much each arc
overflows follows from the load of each arc alone, so only those sums (shards x vnodes numbers, a bound set by parameters)
reach the driver; each document then finds its piece of the ring by its running load, which is a distributed prefix sum.

Law ``rows``: the loads are rows and the capacities sum to the number of rows, so counts are at most one apart. Law
``bytes``: the loads are bytes and no shard exceeds its even share by more than one document.

Defined results: a null text has size 8 and checksum 0; an empty table gives an empty result; repeated rows are placed one by
one; a null id is a key like any other; further columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import hash_key, materialise, prefix_sums, table, u32

SHARDS, VNODES, SEED = 24, 64, "ring-1:"


def ring(shards: int, vnodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the virtual nodes in ascending order, and the shard that owns each."""
    points = sorted((int(hashlib.md5(f"{SEED}shard {s}, point {v}".encode()).hexdigest()[:8], 16), s) for s in range(shards) for v in range(vnodes))
    return np.array([p for p, _ in points], dtype=np.int64), np.array([s for _, s in points], dtype=np.int64)


def capacities(demand: np.ndarray) -> np.ndarray:
    """Even integer capacities that sum to the whole demand; the shards that most keys hash to get the odd ones."""
    total, shards = int(demand.sum()), len(demand)
    out = np.full(shards, total // shards, dtype=np.int64)
    out[np.argsort(-demand, kind="stable")[: total % shards]] += 1
    return out


def place_arcs(loads: np.ndarray, owner: np.ndarray, shards: int) -> list[tuple[int, int, int, int]]:
    """(place of its first unit of load counted along the ring, units, shard, units put in the shard before it) of each piece.

    Each arc first fills its own shard, in ring order; what is left of it then goes clockwise from there.
    """
    room = capacities(np.bincount(owner, weights=loads, minlength=shards).astype(np.int64))
    put = np.zeros(shards, dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(loads)])[:-1]
    pieces: list[tuple[int, int, int, int]] = []

    def give(arc: int, at: int, units: int, shard: int) -> int:
        took = int(min(units, room[shard] - put[shard]))
        if took > 0:
            pieces.append((int(at), took, int(shard), int(put[shard])))
            put[shard] += took
        return max(took, 0)

    left = [(arc, give(arc, starts[arc], int(loads[arc]), owner[arc])) for arc in range(len(loads)) if loads[arc]]
    for arc, took in left:
        at, units, step = int(starts[arc]) + took, int(loads[arc]) - took, arc
        while units:
            step = (step + 1) % len(owner)
            took = give(arc, at, units, owner[step])
            at, units = at + took, units - took
    return sorted(pieces)


def shard_rows(keyed: DataFrame, shards: int = SHARDS, vnodes: int = VNODES, law: str = "rows") -> DataFrame:
    """Add shard and slot to a written table (uid, size, and carried columns)."""
    points, owner = ring(shards, vnodes)

    @F.pandas_udf("int")
    def arc_of(place: pd.Series) -> pd.Series:
        return pd.Series((np.searchsorted(points, place.to_numpy(), side="left") % len(points)).astype("int32"))

    load = F.lit(1).cast("long") if law == "rows" else F.col("size")
    # The arc that crosses zero is put first, so that the ring's order is that of the turned key.
    turn = int(points[-1]) + 1
    turned = F.pmod(u32(F.col("_hash")) - F.lit(turn), F.lit(2**32))
    placed = materialise(
        keyed.withColumn("_hash", hash_key(F.col("uid"), SEED)).withColumn("_load", load).withColumn("_key", F.concat(F.lpad(F.lower(F.hex(turned)), 8, "0"), F.substring("_hash", 9, 24))), "shard-keys"
    )
    sums = dict(placed.groupBy(arc_of(u32(F.col("_hash"))).alias("arc")).agg(F.sum("_load").alias("n")).collect())
    pieces = place_arcs(np.array([sums.get(a, 0) for a in range(len(points))], dtype=np.int64), owner, shards)
    first, units, shard, put = (np.array(x, dtype=np.int64) for x in zip(*pieces)) if pieces else (np.zeros(1, dtype=np.int64),) * 4

    @F.pandas_udf("shard int, slot long")
    def piece_of(before: pd.Series) -> pd.DataFrame:
        at = before.to_numpy()
        i = np.clip(np.searchsorted(first, at, side="right") - 1, 0, None)
        return pd.DataFrame({"shard": shard[i].astype("int32"), "slot": put[i] + at - first[i]})

    ordered = prefix_sums(placed, None, "_key", "_load", "_before").withColumn("_piece", piece_of("_before"))
    out = ordered.withColumn("shard", F.col("_piece.shard")).withColumn("slot", F.col("_piece.slot")).drop("_hash", "_before", "_piece")
    if law == "rows":
        return out.drop("_load", "_key")
    counted = materialise(out.drop("slot").withColumn("_one", F.lit(1).cast("long")).withColumn("_shard", F.col("shard").cast("string")), "shard-slots")
    return prefix_sums(counted, "_shard", "_key", "_one", "slot").drop("_shard", "_one", "_load", "_key")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("uid"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    return shard_rows(docs).select(
        F.col("uid").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


QUERIES = {"op9_sharding": op9_sharding}
ORACLE: dict[str, str] = {}
