import os

from pyspark.sql import functions as F

from codeseam.adapters import usage_v
from codeseam.operators import usage
from codeseam.streaming import usage_stream

SF = "/root/testdata/sf0.001"


def run(spark, build, name, mode, tmp_path):
    source = str(tmp_path / "in")
    if not os.path.isdir(source):
        usage_v(spark, SF).withColumn("timestamp", F.col("timestamp").cast("timestamp")).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    q = build(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name), spark.read.parquet(source)


def test_budget_stream_equals_batch(spark, tmp_path):
    got, batch = run(spark, lambda s: usage_stream.budget_by_day(s, 5_000_000), "budget", "complete", tmp_path)
    want = {r[0]: r[1] for r in usage.priced(batch).groupBy(batch.timestamp.cast("date")).sum("cost").collect()}
    assert {r.day.date(): r.cost for r in got.collect()} == want


def test_limiter_stream_equals_batch(spark, tmp_path):
    got, batch = run(spark, usage_stream.limiter, "limits", "append", tmp_path)
    want = {r.request_id: r.wait for r in usage.replay_limiter(batch).collect()}
    assert {r.request_id: round(r.wait, 6) for r in got.collect()} == want


def test_bucket_stream(spark, tmp_path):
    got, batch = run(spark, usage_stream.token_bucket, "bucket", "append", tmp_path)
    assert got.count() == batch.count()
