"""Batches of one global order, by ranges, against a plain fold."""

import random

import pytest

from codeseam.operators import batching


def fold(rows, budget):
    out, batch, total = [], 0, 0
    for o, t in sorted(rows):
        if total and total + t > budget:
            batch, total = batch + 1, 0
        total += t
        out.append((o, batch))
    return out


def table(kind):
    r = random.Random(kind)
    sizes = {
        "mixed": lambda i: r.choice([0, 1, 5, 30, 99, 100, 101, 250]), "tiny": lambda i: r.choice([0, 0, 1]), "huge": lambda i: 500, "zero": lambda i: 0,
        "runs": lambda i: 0 if i % 150 > 60 else 40, "last": lambda i: 1000 if i == 599 else 0,
    }
    return [(i * 3, sizes[kind](i)) for i in range(600)]


@pytest.mark.parametrize("kind", ["mixed", "tiny", "huge", "zero", "runs", "last"])
def test_ranges(spark, kind):
    rows = table(kind)
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame([(*x, "clash") for x in rows], "o int, t int, p string").repartition(3)
        got = batching.next_fit(df, "o", "t", 100)
        assert sorted(map(tuple, got.select("o", "batch_id").collect())) == fold(rows, 100)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_edges(spark):
    none = spark.createDataFrame([], "o long, t long")
    assert batching.next_fit(none, "o", "t", 10).count() == 0
    one = spark.createDataFrame([(5, None)], "o long, t long")
    assert [tuple(r) for r in batching.next_fit(one, "o", "t", 10).collect()] == [(5, 0)]
    scoped = spark.createDataFrame([("a", 1, 9), ("a", 2, 9), ("b", 1, None)], "s string, o long, t long")
    assert sorted(tuple(r) for r in batching.next_fit(scoped, "o", "t", 10, ["s"]).collect()) == [("a", 1, 0), ("a", 2, 1), ("b", 1, 0)]
