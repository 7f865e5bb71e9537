"""Every query against its DuckDB oracle, at the smallest scale."""

import duckdb
import pytest

from tidemark.plans.catalog import ORACLES, QUERIES
from tidemark.session import TABLES

SF = "/root/testdata/sf0.001"


def same(v):
    return ("0" if v == 0 else f"{v:.6g}") if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(tuple(same(r[c]) for c in names) for r in df.collect())
    if name not in ORACLES:
        assert got
        return
    out = duck.sql(ORACLES[name])
    assert sorted(out.columns) == names
    at = [out.columns.index(c) for c in names]
    assert got == sorted(tuple(same(r[k]) for k in at) for r in out.fetchall())
