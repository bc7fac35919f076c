"""Model usage: cost in integer micro-dollars, budgets, trailing windows, limiter replay."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..schemas import literal_map

#: Dollars per million input and output tokens; a model that isn't listed is priced as medium.
PRICES = {"large": (15, 75), "medium": (3, 15), "small": (0.25, 1.25)}
DEFAULT = "medium"


def cost_micro(prices: dict = PRICES) -> Column:
    """Dollars per million tokens are micro-dollars per token; kept times 100 to stay whole, then rounded down."""
    def price(i):
        return F.coalesce(literal_map({m: int(p[i] * 100) for m, p in prices.items()})[F.col("model")], F.lit(int(prices[DEFAULT][i] * 100)))

    return F.floor((F.col("input_tokens") * price(0) + F.col("output_tokens") * price(1)) / 100).cast("long")


def priced(usage: DataFrame) -> DataFrame:
    return usage.withColumn("cost", cost_micro())


def usage_summary(usage: DataFrame) -> DataFrame:
    return priced(usage).agg(F.count("*").alias("requests"), F.coalesce(F.sum("cost"), F.lit(0)).alias("cost"), F.coalesce(F.sum(F.col("input_tokens") + F.col("output_tokens")), F.lit(0)).alias("tokens"), F.count_if("success").alias("succeeded"), F.count_if(~F.col("success")).alias("failed"), F.coalesce(F.round(F.avg("cost"), 2), F.lit(0.0)).alias("avg_cost"))


#: Columns of a history, and of its table form.
HISTORY = "timestamp string, model string, input_tokens long, output_tokens long, cost double, request_type string, duration double, success boolean, error_message string"
HISTORY_COLUMNS = [x.split()[0] for x in HISTORY.split(", ")]


def history_from(raw: DataFrame) -> DataFrame:
    """Usage rows of stored histories (column json); a text that is none gives no rows."""
    rows = F.from_json("json", f"usage_history array<struct<{HISTORY.replace(' ', ':').replace(',:', ',')}>>")["usage_history"]
    return raw.select(F.explode(rows).alias("u")).select("u.*").withColumn("timestamp", F.to_timestamp_ntz("timestamp"))


def load_history(spark, path: str) -> DataFrame:
    return history_from(spark.read.text(path, wholetext=True).withColumnRenamed("value", "json"))


def export_rows(usage: DataFrame) -> DataFrame:
    """The table form of a history: times in ISO form, cost in dollars; columns that aren't there are null."""
    p = priced(usage) if "cost" not in usage.columns else usage
    have = {"timestamp": iso(F.col("timestamp")), "cost": F.col("cost") / 1e6 if "cost" not in usage.columns else F.col("cost")}
    return p.select(*((have[c] if c in have else F.col(c) if c in p.columns else F.lit(None).cast("string")).alias(c) for c in HISTORY_COLUMNS))


def iso(t: Column) -> Column:
    """yyyy-mm-ddThh:mm:ss, with microseconds where there are some."""
    return F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.date_format(t, "SSSSSS") != "000000", F.concat(F.lit("."), F.date_format(t, "SSSSSS"))).otherwise(""))


def export_history(usage: DataFrame, path: str, form: str = "json", as_of: str | None = None) -> None:
    """Writes a history: as CSV, or as JSON lines with the summary of the year before as_of beside them."""
    rows = export_rows(usage)
    if form == "csv":
        rows.write.mode("overwrite").option("header", True).csv(path)
    elif form == "json":
        rows.write.mode("overwrite").json(f"{path}/usage_history")
        usage_summary(since(usage, as_of, 365) if as_of else usage).write.mode("overwrite").json(f"{path}/summary")
    else:
        raise ValueError(f"unsupported form {form!r}")


def usage_by(usage: DataFrame, column: str) -> DataFrame:
    return priced(usage).groupBy(column).agg(F.count("*").alias("requests"), F.sum("cost").alias("cost"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"))


def budget_status(usage: DataFrame, daily: int, monthly: int, total: int) -> DataFrame:
    """Limits, used, remaining and percentage for the day and month of the latest request and over all time, one pass."""
    days = priced(usage).groupBy(F.to_date("timestamp").alias("day")).agg(F.sum("cost").alias("cost"))
    latest = F.max("day")
    a = days.agg(latest.alias("last"), F.sum("cost").alias("all"), F.max_by("cost", "day").alias("today"), F.collect_list(F.struct("day", "cost")).alias("d"))
    month = F.aggregate(F.filter("d", lambda x: F.trunc(x["day"], "month") == F.trunc(F.col("last"), "month")), F.lit(0).cast("long"), lambda s, x: s + x["cost"])
    rows = F.array(*(F.struct(F.lit(n).alias("period"), F.lit(lim).cast("long").alias("limit_micro"), F.coalesce(u, F.lit(0)).cast("long").alias("used")) for n, lim, u in (("daily", daily, F.col("today")), ("monthly", monthly, month), ("total", total, F.col("all")))))
    r = a.select(F.explode(rows).alias("r")).select("r.*")
    return r.select("period", "limit_micro", "used", F.greatest(F.lit(0), F.col("limit_micro") - F.col("used")).cast("long").alias("remaining"), F.when(F.col("limit_micro") > 0, F.round(100.0 * F.col("used") / F.col("limit_micro"), 2)).otherwise(0.0).alias("percentage"))


def trailing_tokens(usage: DataFrame, seconds: int = 60) -> DataFrame:
    """Tokens of the trailing window up to each request, per model (the limiter's scope); null tokens count as none.

    Time is cut into buckets as long as the window, so a window reaches into one bucket before its own: a request's
    tokens are added in its bucket and, carried over, taken off in the next one just after they leave the window. A
    task sorts a model's bucket, never all of a model."""
    length = seconds * 1_000_000
    rows = usage.select("request_id", "model", F.unix_micros(F.col("timestamp").cast("timestamp")).alias("us"), F.coalesce(F.col("input_tokens").cast("long"), F.lit(0)).alias("n"))
    bucket = F.floor(F.col("us") / length)
    own = rows.select("request_id", "model", bucket.alias("bucket"), (2 * F.col("us")).alias("at"), "n", F.lit(0).cast("long").alias("carried"), F.lit(True).alias("own"))
    left = rows.select(F.lit(None).cast(dict(rows.dtypes)["request_id"]).alias("request_id"), "model", (bucket + 1).alias("bucket"), (2 * (F.col("us") + length) + 1).alias("at"), (-F.col("n")).alias("n"), F.col("n").alias("carried"), F.lit(False).alias("own"))
    w = W.partitionBy("model", "bucket")
    total = F.sum("n").over(w.orderBy("at").rangeBetween(W.unboundedPreceding, W.currentRow)) + F.sum("carried").over(w)
    return own.union(left).withColumn("trailing", total).where("own").select("request_id", "model", "trailing")


def budget_alerts(usage: DataFrame, daily: int, warn: float = 0.8) -> DataFrame:
    """Running cost of each day; ok, warning from 80 %, exceeded from 100 %."""
    p = priced(usage).withColumn("day", F.to_date("timestamp"))
    w = W.partitionBy("day").orderBy("timestamp", "request_id").rowsBetween(W.unboundedPreceding, 0)
    run = F.sum("cost").over(w)
    return p.select("request_id", "day", run.alias("running"), F.when(run >= daily, "exceeded").when(run >= warn * daily, "warning").otherwise("ok").alias("status"))


class Window60:
    """Sliding window limiter: waits until the oldest entries that stand in the way leave the window, plus slack."""

    def __init__(self, limit: int, seconds: float = 60.0, slack: float = 0.1):
        self.limit, self.seconds, self.slack, self.held = limit, seconds, slack, []

    def acquire(self, now: float, tokens: int) -> float:
        self.held = [x for x in self.held if x[0] >= now - self.seconds]
        used = sum(n for _, n in self.held)
        wait = 0.0
        if used + tokens > self.limit and self.held:
            need, freed, wait = used + tokens - self.limit, 0, self.seconds
            for t, n in self.held:
                freed += n
                if freed >= need:
                    wait = t + self.seconds + self.slack - now
                    break
            wait = max(0.0, wait)
            self.held = [x for x in self.held if x[0] >= now + wait - self.seconds]
        self.held.append((now + wait, tokens))
        return wait


class TokenBucket:
    def __init__(self, rate: float = 2.0, burst: float = 5.0):
        self.rate, self.burst, self.tokens, self.at = rate, burst, burst, None

    def try_acquire(self, now: float, n: float = 1.0) -> bool:
        if self.at is not None:
            self.tokens = min(self.burst, self.tokens + max(0.0, now - self.at) * self.rate)
        self.at = now
        if self.tokens >= n:
            self.tokens -= n
            return True
        return False


def replay_limiter(usage: DataFrame, limit: int = 40_000) -> DataFrame:
    """request_id, wait: the limiter's waits if requests of a model arrive in time order; streams per model."""
    rows = usage.select("model", F.col("timestamp").cast("timestamp").cast("double").alias("t"), "request_id", "input_tokens").repartition("model").sortWithinPartitions("model", "t", "request_id")

    def run(batches):
        at, limiter = None, None
        for batch in batches:
            waits = []
            for model, t, n in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
                if model != at:
                    at, limiter = model, Window60(limit)
                waits.append(round(limiter.acquire(t, n), 6))
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(waits, pa.float64())], ["request_id", "wait"])

    return rows.mapInArrow(run, "request_id long, wait double")


def replay_bucket(usage: DataFrame, rate: float = 2.0, burst: float = 5.0) -> DataFrame:
    """request_id, granted: a token bucket of each model, asked for one token in time order; streams per model."""
    rows = usage.select("model", F.col("timestamp").cast("timestamp").cast("double").alias("t"), "request_id").repartition("model").sortWithinPartitions("model", "t", "request_id")

    def run(batches):
        at, bucket = None, None
        for batch in batches:
            granted = []
            for model, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if model != at:
                    at, bucket = model, TokenBucket(rate, burst)
                granted.append(bucket.try_acquire(t))
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(granted, pa.bool_())], ["request_id", "granted"])

    return rows.mapInArrow(run, "request_id long, granted boolean")


def limiter_status(usage: DataFrame, limit: int, seconds: int = 60) -> DataFrame:
    """Requests, tokens and what is left in the window that ends with the last request."""
    last = usage.agg(F.max("timestamp").alias("last"))
    held = usage.join(F.broadcast(last), F.col("timestamp") >= F.col("last") - F.make_dt_interval(secs=F.lit(seconds)))  # one row
    used = F.coalesce(F.sum("input_tokens"), F.lit(0))
    return held.agg(F.count("*").alias("requests"), used.alias("used"), F.greatest(limit - used, F.lit(0)).alias("remaining"))


def since(rows: DataFrame, as_of: str, days: int, column: str = "timestamp") -> DataFrame:
    """Rows of the last days before as_of, which is a parameter so that runs can be repeated."""
    return rows.where(F.col(column) >= F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(days)))


def sampled(usage: DataFrame, every: str, value: str) -> DataFrame:
    """Mean, least and most of a value in windows of time."""
    return usage.groupBy(F.window(F.col("timestamp").cast("timestamp"), every).alias("w")).agg(F.bround(F.avg(value), 6).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "mean", "least", "most")
