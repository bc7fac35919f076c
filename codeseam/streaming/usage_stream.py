"""Streaming forms: limiter and token bucket per model, budgets per day. Watermark 10 minutes; later rows are dropped."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.usage import TokenBucket, Window60, cost_micro

WATERMARK = "10 minutes"


def budget_by_day(usage: DataFrame, daily: int) -> DataFrame:
    """Cost and alert status of each day, updated as rows arrive."""
    s = usage.withWatermark("timestamp", WATERMARK).withColumn("cost", cost_micro())
    d = s.groupBy(F.window("timestamp", "1 day")).agg(F.sum("cost").alias("cost"), F.count("*").alias("requests"))
    return d.select(F.col("window.start").alias("day"), "cost", "requests", F.when(F.col("cost") >= daily, "exceeded").when(F.col("cost") >= 0.8 * daily, "warning").otherwise("ok").alias("status"))


def limiter(usage: DataFrame, limit: int = 40_000) -> DataFrame:
    """Waits of a sliding 60-second limiter per model; state: the entries of the window."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = Window60(limit)
        if state.exists:
            times, tokens = state.get
            held.held = list(zip(times, tokens))
        rows = pd.concat(list(frames)).sort_values(["timestamp", "request_id"])
        waits = [held.acquire(t.timestamp(), int(n)) for t, n in zip(rows["timestamp"], rows["input_tokens"])]
        state.update(([float(t) for t, _ in held.held], [int(n) for _, n in held.held]))
        yield pd.DataFrame({"model": key[0], "request_id": rows["request_id"].to_numpy(), "wait": waits})

    return usage.withWatermark("timestamp", WATERMARK).groupBy("model").applyInPandasWithState(step, "model string, request_id long, wait double", "times array<double>, tokens array<long>", "append", GroupStateTimeout.NoTimeout)


def token_bucket(usage: DataFrame, rate: float = 2.0, burst: float = 5.0) -> DataFrame:
    """Whether each request of a model is let through."""

    def step(key, frames, state: GroupState):
        bucket = TokenBucket(rate, burst)
        if state.exists:
            bucket.tokens, bucket.at = state.get
        rows = pd.concat(list(frames)).sort_values(["timestamp", "request_id"])
        ok = [bucket.try_acquire(t.timestamp()) for t in rows["timestamp"]]
        state.update((float(bucket.tokens), float(bucket.at)))
        yield pd.DataFrame({"model": key[0], "request_id": rows["request_id"].to_numpy(), "allowed": ok})

    return usage.withWatermark("timestamp", WATERMARK).groupBy("model").applyInPandasWithState(step, "model string, request_id long, allowed boolean", "tokens double, at double", "append", GroupStateTimeout.NoTimeout)
