"""Every registered query against its SQL on the smallest driver tables."""

import os

import duckdb
import pytest

from codeseam.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no driver tables")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canon(rows):
    return sorted(repr(tuple(f"{x:.6g}" if isinstance(x, float) else None if x is None else str(x) for x in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    rows = got.select(sorted(got.columns)).collect()
    if not name.startswith(("g07", "d11", "b21", "d12")):
        assert rows, "vacuous"
    if name in catalog.ORACLES:
        want = duck.execute(catalog.ORACLES[name])
        cols = [c[0] for c in want.description]
        assert sorted(cols) == sorted(got.columns)
        order = [cols.index(c) for c in sorted(cols)]
        assert canon(map(tuple, rows)) == canon([tuple(r[i] for i in order) for r in want.fetchall()])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
