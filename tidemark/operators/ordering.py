"""Numbering rows in an order without bringing them, or a large group of them, into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.sources.shared import written


def in_ranges(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``rows`` in range partitions of (by, order), written with the number of their range, which grows with both."""
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(rows.repartitionByRange(ranges, *by, *order).withColumn("_range", F.spark_partition_id()), "ranges")


def numbered(rows: DataFrame, order: list[str], by: list[str] | None = None, out: str = "n") -> DataFrame:
    """Add ``out``, the place of each row (from 0) in the order given, among all rows or those alike in ``by``.

    Rows are range-partitioned by (by, order) and written with the number of their range; rows of a range are numbered by a
    window, and to that comes the number of rows in earlier ranges, from one count a range and group. A group of any size
    is spread over as many ranges as it fills.
    """
    by = by or []
    ranged = in_ranges(rows, by, order)
    counts = ranged.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # without ``by``: one row a range
    before = counts.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_range").alias("_r"), F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    joined = ranged.join(before, [F.col("_range") == F.col("_r"), *[F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]])
    local = F.row_number().over(W.partitionBy(*by, "_range").orderBy(*order)) - 1
    return joined.withColumn(out, F.col("_before") + local).drop("_range", "_r", "_before", *[f"_{c}" for c in by])
