"""Operator 3, exact deduplication: a persistent digest index, bucketed and sorted by hash.

New data is deduplicated by a sort-merge anti-join with the index and appended. Copies of what the index has are appended as
further entries of their digest, so that the largest id and the number of copies are those of all batches. Entries carry the name of
their batch: one that is added again, after a failure say, is compared with the other batches only and counts once. DataFrame
functions only.

Defined results: a null text counts as empty; an empty table gives an empty result; repeated rows are copies of one another;
when rows tie on the id, the group keeps that id (each such row then counts as kept); a null id loses to any other; rows
of earlier batches are not reported again when a later copy takes their place; a batch that is added again with the same rows changes
nothing, and with other rows adds what it lacked; further columns of the input, whatever their
names, are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, delete_folder, materialise, scratch, table

ENTRY = "text_sha256 string, keep_id long, group_size long, batch string"
#: The query takes its table through the index in two batches, of which the second is compared with the first.
BATCHES = 2


def digest(text: Column) -> Column:
    """SHA-256 of the text with A-Z lower-cased, lowercase hex; a null text counts as empty."""
    return F.sha2(ascii_lower(F.coalesce(text, F.lit(""))).cast("binary"), 256)


class DigestIndex:
    """Digests seen so far with the row that stays, in Parquet buckets sorted by digest; one entry for each batch that has it.

    ``name`` is the table name and ``path`` its folder, which all executors must share. The number of buckets is fixed when
    the index is made, so that each later batch alone is shuffled, never the index.
    """

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int = 64):
        self.spark, self.name, self.path, self.buckets = spark, name, path, buckets
        if not spark.catalog.tableExists(name):
            self._append(spark.createDataFrame([], ENTRY))

    @classmethod
    def temporary(cls, spark: SparkSession, buckets: int | None = None) -> DigestIndex:
        """An index of its own in the shared folder, to be dropped."""
        name = f"digest_index_{uuid.uuid4().hex}"
        return cls(spark, name, f"{scratch(spark)}/{name}", buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        delete_folder(self.spark, self.path)

    def _append(self, entries: DataFrame) -> None:
        (
            entries.repartition(self.buckets, "text_sha256")
            .write.mode("append").format("parquet").option("path", self.path)
            .bucketBy(self.buckets, "text_sha256").sortBy("text_sha256").saveAsTable(self.name)
        )

    def read(self, without: str | None = None) -> DataFrame:
        """One row per digest: the largest id and the number of rows of all batches, or of all but one."""
        entries = self.spark.table(self.name)
        entries = entries if without is None else entries.filter(F.col("batch") != without)
        # Buckets hold all entries of a digest, so neither step is a shuffle.
        once = entries.groupBy("text_sha256", "batch").agg(F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"))
        return once.groupBy("text_sha256").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))

    def add(self, digests: DataFrame, name: str | None = None) -> DataFrame:
        """Append the digests of a batch (doc_id, text_sha256); the written entries that hold for them from now on are returned.

        A batch that may be added again has a name of its own.
        """
        name = name or uuid.uuid4().hex
        batch = digests.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        # Written first: the optimizer would push the joins below the aggregate, and then a hot digest's rows meet in one task.
        batch = materialise(batch, "digest-batch")
        new = batch.join(self.read(name).select("text_sha256").hint("merge"), "text_sha256", "left_anti")
        known = self.read(name).select("text_sha256", F.col("keep_id").alias("_id"), F.col("group_size").alias("_size"))
        again = batch.join(known.hint("merge"), "text_sha256").select("text_sha256", F.greatest("keep_id", "_id").alias("keep_id"), (F.col("group_size") + F.col("_size")).alias("group_size"))
        now = materialise(new.union(again), "digest-entries")
        self._append(batch.withColumn("batch", F.lit(name)))
        return now


def exact_duplicates(docs: DataFrame, index: DigestIndex | None = None, name: str | None = None, batches: int = 1) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256. ``index`` holds earlier data and is appended to, under the batch's ``name``.

    Without an index, one is made for the call, and the documents go through it in so many batches; the result is that of all.
    """
    digests = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text")).alias("text_sha256")), "digests")
    return digests.join(_added(digests, index, name, batches), "text_sha256").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def _added(digests: DataFrame, index: DigestIndex | None, name: str | None = None, batches: int = 1) -> DataFrame:
    if index is not None:
        return index.add(digests, name)
    own = DigestIndex.temporary(digests.sparkSession)
    try:
        if batches == 1:
            return own.add(digests)
        for k in range(batches):
            own.add(digests.filter(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == k), str(k))
        return materialise(own.read(), "digest-entries")
    finally:
        own.drop()


def keep_first_copies(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The rows of ``docs`` with all their columns, one per text: the one with the largest doc_id; of rows alike in that, the greatest as JSON."""
    columns = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text")).alias("text_sha256"))

    def key(row_id: Column) -> Column:
        return F.concat_ws(":", "text_sha256", row_id.cast("string"))

    winners = _added(rows.select("doc_id", "text_sha256"), index).select(key(F.col("keep_id")).alias("_key"))
    # Joined by text and id together, a large group of copies spreads over all tasks, and only its one survivor finds a partner.
    found = rows.select("_row", key(F.col("doc_id")).alias("_key")).join(winners, "_key")
    # Rows that share both text and id are the same document delivered again.
    return found.groupBy("_key").agg(F.max_by("_row", F.to_json("_row")).alias("_row")).select("_row.*")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"), batches=BATCHES)


ORACLE = {
    "op3_exact_dedup": """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256 FROM d JOIN g USING (text_sha256)"""
}
QUERIES = {"op3_exact_dedup": op3_exact_dedup}
