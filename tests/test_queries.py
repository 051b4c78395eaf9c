"""Every query against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

from quadrel.plans import all_queries  # noqa: F401
from quadrel.plans.catalog import ORACLES, QUERIES, steady

SMALL = "/root/testdata/sf0.001"
TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(rows, names, order):
    at = [names.index(c) for c in order]
    return sorted((tuple(None if v is None or isinstance(v, float) and math.isnan(v) else v for v in (row[i] for i in at)) for row in rows), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    df = QUERIES[name](spark, SMALL)
    rows = df.collect()
    assert len(df.columns) == len(set(df.columns))
    if name in ORACLES:
        want = oracle.sql(ORACLES[name])
        assert dict(df.dtypes) == {c: TYPES.get(str(t), str(t).lower()) for c, t in zip(want.columns, want.types)}
        order = sorted(df.columns)
        assert plain(map(tuple, rows), df.columns, order) == plain(want.fetchall(), want.columns, order)


def test_rounding_is_rewritten_where_it_stands():
    assert steady("SELECT round(a + round(b, 2), 4) AS x, bround(y, 1)") == "SELECT (round((a + (round((b) + 1e-9::DOUBLE, 2) + 0.0::DOUBLE)) + 1e-9::DOUBLE, 4) + 0.0::DOUBLE) AS x, bround(y, 1)"
