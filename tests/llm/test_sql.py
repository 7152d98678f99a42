"""Operators that SQL can express give the rows that their SQL gives."""

import duckdb
import pytest

from tracelake.llm import registry

TABLES = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_rows_are_those_of_the_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{TABLES}/{t}.parquet'")
    want = con.sql(registry.ORACLES[name])
    got = registry.QUERIES[name](spark, TABLES)
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert sorted(map(repr, want.select(*columns).fetchall())) == sorted(repr(tuple(r)) for r in got.select(*columns).collect())
