"""Every query with SQL gives on the smallest tables what DuckDB gives; every other one runs."""

import duckdb
import pytest

import __spark_entry__ as entry
from tracelake.plans import derived, evidence, model, relational, slices, structures

PLANS = (relational, model, slices, structures, derived, evidence)
QUERIES, ORACLES = ({k: v for p in PLANS for k, v in getattr(p, name).items()} for name in ("QUERIES", "ORACLES"))
D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"create view {name} as select * from '{D}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sql, name):
    got = QUERIES[name](spark, D)
    columns = sorted(got.columns)
    rows = sorted(repr(tuple(r[c] for c in columns)) for r in got.collect())
    if name in ORACLES:
        want = sql.sql(ORACLES[name])
        assert sorted(want.columns) == columns
        assert rows == sorted(repr(tuple(dict(zip(want.columns, r))[c] for c in columns)) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
