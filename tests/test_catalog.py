"""Every registered query with SQL against DuckDB, at the smallest scale that has gaps."""

import math
import os

import duckdb
import pytest

from rampwise.plans import catalog

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
SQL = catalog.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return "null" if math.isnan(v) else f"{v:.6g}" if abs(v) > 1e-9 else "0"
    return "null" if v is None else f"{float(v):.6g}" if isinstance(v, int) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "lineitem", "embeddings", "customer"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(SQL[name])
    got = catalog.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    by = sorted(got.columns)
    mine = sorted([plain(r[c]) for c in by] for r in got.collect())
    theirs = sorted([plain(r[want.columns.index(c)]) for c in by] for r in want.fetchall())
    assert len(mine) == len(theirs) and len(mine) > 0
    assert mine == theirs
