import numpy as np
import pandas as pd
import pytest

from codeseam.operators import quantiles

QS = [0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0]


def frame(spark, groups):
    return spark.createDataFrame(pd.concat(pd.DataFrame({"g": g, "v": np.asarray(v, float)}) for g, v in groups.items()), "g string, v double")


def between(v, q):
    v, at = sorted(map(float, v)), q * (len(v) - 1)
    a, b, part = v[int(at)], v[int(np.ceil(at))], at - int(at)
    return a if a == b else a * (1 - part) + b * part


def check(spark, groups, few, monkeypatch):
    monkeypatch.setattr(quantiles, "FEW", few)
    got = {(r.g, r.q): (r.quantile, r.n) for r in quantiles.exact_quantiles(frame(spark, groups), ["g"], "v", QS).collect()}
    assert len(got) == len(groups) * len(QS)
    for g, v in groups.items():
        for q in QS:
            value, n = got[g, q]
            assert n == len(v) and value == pytest.approx(between(v, q), rel=1e-12, abs=1e-12), (g, q)


def test_against_sorting(spark, monkeypatch):
    r = np.random.default_rng(1)
    heavy = np.concatenate([np.zeros(4000), r.random(60), np.ones(4000)])  # most rows at the ends, the wanted ones between
    groups = {
        "plain": r.normal(size=9000), "wide": 10.0 ** r.uniform(-200, 200, 5000), "ties": r.integers(0, 3, 6000), "heavy": heavy, "one": [7.0], "two": [1.0, 2.0],
        "same": np.full(3000, 5.0), "negative": -np.abs(r.standard_cauchy(4000)), "infinite": [*r.normal(size=50), np.inf, -np.inf][:51],
    }
    check(spark, groups, 20, monkeypatch)


def test_small_groups_need_no_round(spark, monkeypatch):
    r = np.random.default_rng(2)
    check(spark, {f"g{k}": r.normal(size=k + 1) for k in range(12)}, 1000, monkeypatch)


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", None), ("b", 2.0), ("b", None)], "g string, v double")
    got = {r.g: (r.quantile, r.n) for r in quantiles.exact_quantiles(df, ["g"], "v", [0.5]).collect()}
    assert got == {None: (2.0, 2), "b": (2.0, 1)}
    assert quantiles.exact_quantiles(df.where("false"), ["g"], "v", [0.5]).count() == 0
    whole = quantiles.exact_quantiles(df, [], "v", [0.5]).collect()
    assert [(r.q, r.quantile, r.n) for r in whole] == [(0.5, 2.0, 3)]


def test_sketches_merge_within_their_error(spark):
    r = np.random.default_rng(3)
    df = frame(spark, {f"{k}": r.lognormal(0, 3, 20_000) for k in range(5)})
    parts = quantiles.sketched(df, ["g"], "v")
    merged = quantiles.merged_sketches(parts, [])
    answers = quantiles.sketch_quantiles(merged, QS)
    errors = quantiles.rank_errors(df, [], "v", answers).collect()
    assert len(errors) == len(QS) and max(e.error for e in errors) < 0.006
