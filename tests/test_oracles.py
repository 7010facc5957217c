"""Every query that has SQL against DuckDB, row by row, and not empty."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from tidemark.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Queries whose result may be empty on the smallest tables.
MAY_BE_EMPTY = {"ag08_low_yield", "jn08_children", "sl06_impacts_in_area", "src13_find_events", "sl08_claims_naming"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def shown(value) -> str:
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(name, spark, sf_dir, duck):
    wanted = duck.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in wanted.description]
    rows = sorted(tuple(map(shown, r)) for r in wanted.fetchall())
    got = registry.queries()[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(tuple(map(shown, r)) for r in got.select(*[f"`{c}`" for c in columns]).collect()) == rows
    assert rows or name in MAY_BE_EMPTY


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(name, spark, sf_dir):
    assert registry.queries()[name](spark, sf_dir).count() > 0
