"""Corpus queries that SQL can say give what DuckDB gives."""

import duckdb
import pytest

pytest.importorskip("ledgerloom.llm")

from ledgerloom.llm.queries import ORACLES, QUERIES  # noqa: E402


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    df = QUERIES[name](spark, data)
    found = con.sql(ORACLES[name])
    assert sorted(found.columns) == sorted(df.columns)
    mine = sorted(tuple(str(r[c]) for c in found.columns) for r in df.collect())
    assert mine == sorted(tuple(str(v) for v in row) for row in found.fetchall()) and mine
