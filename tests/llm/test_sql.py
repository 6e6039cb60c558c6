"""Queries of the subpackage that have SQL, held against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from textquarry.llm import registry

SF = "/root/testdata/sf0.001"


def plain(rows):
    return sorted(tuple(repr(float(x)) if isinstance(x, float) else str(x) for x in r) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for f in ("documents", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {f} AS SELECT * FROM '{SF}/{f}.parquet'")
    cursor = con.execute(registry.SQL[name])
    columns = [c[0] for c in cursor.description]
    got = registry.QUERIES[name](spark, SF)
    assert sorted(columns) == sorted(got.columns)
    assert plain(tuple(r) for r in got.select(*columns).collect()) == plain(cursor.fetchall())
