"""Every registered query with SQL gives what DuckDB gives on the same tables."""

import math
import os

import duckdb
import pytest

from ledgerloom.plans import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{data}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return c


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if hasattr(v, "as_tuple"):
        return round(float(v), 5)
    return v


def _close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return abs(a - b) <= 1e-9 * max(1.0, abs(a))  # both sides are rounded in the query
    return a == b


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, data, name):
    df = QUERIES[name](spark, data)
    cols = sorted(df.columns)
    found = con.sql(ORACLES[name])
    assert sorted(found.columns) == cols
    at = [found.columns.index(c) for c in cols]
    key = lambda row: [str(v) for v in row if not isinstance(v, float)] + [str(v) for v in row]
    mine = sorted([tuple(_value(r[c]) for c in cols) for r in df.collect()], key=key)
    theirs = sorted([tuple(_value(x[i]) for i in at) for x in found.fetchall()], key=key)
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs):
        assert all(_close(x, y) for x, y in zip(a, b)), (a, b)


def test_names_are_known():
    assert set(ORACLES) <= set(QUERIES)
