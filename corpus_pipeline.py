"""The corpus pipeline: quality rules, exact dedup, near-duplicate dedup, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of ``documents``, and further
columns with whatever names. Between
stages the rows are written as Parquet and read again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import materialise, table
from tidemark.llm.exact_dedup import keep_first_copies
from tidemark.llm.mixing import mixed_rows
from tidemark.llm.near_dedup import keep_one_of_each
from tidemark.llm.packing import pack
from tidemark.llm.quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or lie outside their group's thresholds go.

    A null or empty text fails the base rule; null languages and sources are groups; repeated rows are judged alike; an empty table stays empty.
    """
    return keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays.

    A null text counts as empty; a null id loses to any other; of rows alike in text and id the greatest as JSON stays.
    """
    return keep_first_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate class one document stays, that of the greatest digest of its text and id.

    Null and empty texts are copies of one another; of rows alike in text and id the greatest as JSON stays.
    """
    return keep_one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated, left out or cut so that each source has its share of words.

    Null sources are one source; texts without words, null or empty ones among them, are left out; repeated rows have shares of their own.
    """
    return mixed_rows(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents in sequences of 2048 tokens.

    A null or empty text is its end id alone; repeated rows and null ids are packed like any other; an empty table gives no piece.
    """
    return pack(docs)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mixing", mixing), ("packing", packing)]

#: SQL can't express the near-duplicate stage or the token ids; tests/llm/test_pipeline.py holds the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs, f"stage-{name}")
    return docs
