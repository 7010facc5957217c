from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make_docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, source) tuples."""

    def make(rows, extra: str = ""):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        docs = spark.createDataFrame(full, SCHEMA)
        for name in filter(None, extra.split()):
            from pyspark.sql import functions as F

            docs = docs.withColumn(name, F.lit("clash"))
        return docs

    return make


@pytest.fixture
def write_table(tmp_path):
    def write(**tables):
        for name, df in tables.items():
            df.write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return write
