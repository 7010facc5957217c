"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: A word is a maximal run of characters other than space and U+0009..U+000D.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_own_scratch: str | None = None
#: Folders of written tables, one list for each block of ``intermediates`` that is being run.
_written: list[list[str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The shared folder for written intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``; only where that is unset on a local master (tests, a single
    machine) a temporary folder is made, which goes when Python ends. Other masters must name one.
    """
    global _own_scratch
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_scratch is None:
        _own_scratch = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, _own_scratch, ignore_errors=True)
    return f"file://{_own_scratch}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and lost executors cost no recomputation."""
    return materialise_at(df, name)[0]


def materialise_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``materialise``, and the folder, for who deletes it early. What nobody deletes goes when the application ends."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    if _written:
        _written[-1].append(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def delete_folder(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[None]:
    """Tables that are written in this block are deleted when it ends: its result must be written after it was computed, by ``finished``."""
    _written.append([])
    try:
        yield
    finally:
        for path in _written.pop():
            delete_folder(spark, path)


def finished(df: DataFrame, name: str) -> DataFrame:
    """``materialise`` the result of a block of ``intermediates``; what is around the block, if anything, deletes it."""
    inner = _written.pop()
    try:
        return materialise(df, name)
    finally:
        _written.append(inner)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else. A text of one byte a character takes the faster ``lower``."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def hash_key(column: Column, seed: str = "") -> Column:
    """A pseudo-random hex key of a value, the same in every engine that has MD5."""
    return F.md5(F.concat(F.lit(seed), F.coalesce(column.cast("string"), F.lit("null"))).cast("binary"))


def u32(hex_key: Column) -> Column:
    """The first 32 bits of a hex key as a long."""
    return F.conv(F.substring(hex_key, 1, 8), 16, 10).cast("long")


def prefix_sums(df: DataFrame, group: str | None, key: str, value: str, out: str, buckets: int | None = None) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the same ``group`` that come before in order of ``key``.

    ``key`` is a hex hash (see ``hash_key``), so its leading bits cut each group into ranges of like size. Ranges are summed
    first, a window runs over those sums, and the rows of one range get the sum before it plus their own running sum. No task
    holds a whole group, however large. ``df`` is read twice: hand in a written table. ``group`` must hold no nulls.
    """
    spark = df.sparkSession
    n = buckets or max(256, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    g = F.lit("") if group is None else F.col(group)
    ranged = df.withColumn("_g", g).withColumn("_b", F.floor(u32(F.col(key)) * n / F.lit(float(2**32))).cast("int"))
    sums = ranged.groupBy("_g", "_b").agg(F.sum(value).alias("_s"))
    earlier = W.partitionBy("_g").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    bases = sums.select("_g", "_b", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_base"))
    ties = [c for c in df.columns if c not in (group, key)]
    within = W.partitionBy("_g", "_b").orderBy(key, *ties).rowsBetween(W.unboundedPreceding, -1)
    return (
        ranged.join(bases.hint("shuffle_merge"), ["_g", "_b"])
        .withColumn(out, F.col("_base") + F.coalesce(F.sum(value).over(within), F.lit(0)))
        .drop("_g", "_b", "_base")
    )


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 2_000_000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of Arrow batches with their texts (a null one is empty), of about ``most`` characters and one text at least, so that what a task makes of them stays small."""
    for batch in batches:
        texts, size, start = [], 0, 0
        for i, cell in enumerate(batch.column(column)):
            texts.append(cell.as_py() or "")
            size += len(texts[-1])
            if size >= most or i + 1 == batch.num_rows:
                yield batch.slice(start, i + 1 - start), texts
                texts, size, start = [], 0, i + 1
