"""Every corpus query against its SQL, where there is one, on the smallest driver tables."""

import os

import duckdb
import pytest

from codeseam.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no driver tables")
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    rows = [tuple(map(str, r)) for r in got.select(sorted(got.columns)).collect()]
    assert rows
    if name in queries.ORACLES:
        want = duck.execute(queries.ORACLES[name])
        columns = [c[0] for c in want.description]
        assert sorted(columns) == sorted(got.columns)
        order = [columns.index(c) for c in sorted(columns)]
        assert sorted(rows) == sorted(tuple(str(r[i]) for i in order) for r in want.fetchall())
