"""Patterns in texts by sharded automata, and trailing sums by buckets, against plain versions."""

import random
from datetime import datetime, timedelta

import pytest

from codeseam.operators import automata, usage


@pytest.mark.parametrize("sizes", [(2_000_000, 50_000_000), (40, 300)])
def test_contained(spark, sizes):
    r = random.Random(1)
    patterns = ["".join(r.choice("abé:") for _ in range(r.randint(1, 7))) for _ in range(80)] + [None, "", "ab", "ab", "zzz"]
    texts = ["".join(r.choice("abé: \n") for _ in range(r.randint(0, 40))) for _ in range(60)] + [None, "", "zzzz"]
    got = automata.contained(spark.createDataFrame([(p, 1) for p in patterns], "pattern string, text int"), spark.createDataFrame([(t, 2) for t in texts * 2], "text string, pattern int"), *sizes)
    want = {p for p in patterns if p and any(p in t for t in texts if t)}
    assert sorted(r.pattern for r in got.collect()) == sorted(want) and 5 < len(want) < 80
    none = spark.createDataFrame([], "text string")
    assert automata.contained(spark.createDataFrame([("a",)], "pattern string"), none).count() == 0


def test_trailing(spark):
    r = random.Random(2)
    begin = datetime(2024, 1, 1)
    rows = [(i, r.choice(["m", "n", None]), begin + timedelta(seconds=r.choice([0, 59, 60, 61, 120, 180]) + r.randrange(3), microseconds=r.choice([0, 0, 1])), r.choice([None, 0, 5, 7])) for i in range(200)]
    got = {x.request_id: x.trailing for x in usage.trailing_tokens(spark.createDataFrame(rows, "request_id long, model string, timestamp timestamp, input_tokens int").repartition(3)).collect()}
    minute = timedelta(seconds=60)
    assert got == {i: sum(n or 0 for _, k, u, n in rows if k == m and t - minute <= u <= t) for i, m, t, _ in rows}
