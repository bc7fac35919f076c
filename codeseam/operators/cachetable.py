"""A cache as a table: upsert, expiry, invalidation, eviction; and the analysis history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .findings import numbered


def upsert(cache: DataFrame, new: DataFrame, key: str = "key", order: str = "timestamp") -> DataFrame:
    """Of each key the newest row; new rows win ties."""
    both = cache.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    w = W.partitionBy(key).orderBy(F.desc(order), F.desc("__new"))
    return both.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__new")


def live(cache: DataFrame, now) -> DataFrame:
    """Rows whose age is at most their ttl; no ttl never expires."""
    return cache.where(F.col("ttl").isNull() | (F.lit(now) - F.col("timestamp") <= F.col("ttl")))


def invalidate_by_dependency(cache: DataFrame, dependency: str) -> DataFrame:
    return cache.where(~F.coalesce(F.array_contains("dependencies", dependency), F.lit(False)))


def invalidate_changed(cache: DataFrame, current: DataFrame, key: str = "path") -> DataFrame:
    """Entries whose file hash is still the current one."""
    return cache.join(current.select(key, F.col("file_hash").alias("__h")), key, "left").where(F.col("file_hash").eqNullSafe(F.col("__h"))).drop("__h")


def changed(stored: DataFrame, current: DataFrame, key: str = "path") -> DataFrame:
    """Keys that are new, gone or have another hash."""
    s, c = stored.select(key, F.col("file_hash").alias("old")), current.select(key, F.col("file_hash").alias("new"))
    j = s.join(c, key, "full")
    return j.where(~F.col("old").eqNullSafe(F.col("new"))).select(key, F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed").alias("state"))


def file_hash(modified, size):
    return F.md5(F.concat_ws(":", modified.cast("string"), size.cast("string")))


def evict(cache: DataFrame, most: int) -> DataFrame:
    """Keeps the most recently used: a top-k, never a global window."""
    return cache.orderBy(F.desc("accessed"), "key").limit(most)


def read_through(keys: DataFrame, first: DataFrame, second: DataFrame, key: str = "key") -> DataFrame:
    a, b = first.select(key, F.col("value").alias("v1")), second.select(key, F.col("value").alias("v2"))
    return keys.join(a, key, "left").join(b, key, "left").select(key, F.coalesce("v1", "v2").alias("value"), F.when(F.col("v1").isNotNull(), 1).when(F.col("v2").isNotNull(), 2).otherwise(0).alias("level"))


def stats(cache: DataFrame, now) -> DataFrame:
    dead = F.col("ttl").isNotNull() & (F.lit(now) - F.col("timestamp") > F.col("ttl"))
    return cache.agg(F.count("*").alias("size"), F.count_if(dead).alias("expired"), F.count_if(~dead).alias("active"))


def lookups(keys: DataFrame, cache: DataFrame, now, key: str = "key") -> DataFrame:
    """Hits, misses and hit rate of looking keys up in the live part of a cache."""
    found = keys.select(key).join(live(cache, now).select(key, F.lit(True).alias("hit")), key, "left")
    n = found.agg(F.count_if("hit").alias("hits"), F.count_if(F.col("hit").isNull()).alias("misses"))
    return n.withColumn("hit_rate", F.when(F.col("hits") + F.col("misses") > 0, F.round(F.col("hits") / (F.col("hits") + F.col("misses")), 6)).otherwise(0.0))


def invalidate(cache: DataFrame, key: str) -> DataFrame:
    return cache.where(F.col("key") != key)


def cleanup(cache: DataFrame, now) -> DataFrame:
    """The rows that have expired."""
    return cache.join(live(cache, now).select("key"), "key", "left_anti")


def history_add(history: DataFrame, new: DataFrame) -> DataFrame:
    """A history with new analyses, numbered on from its largest id in the order of their time."""
    last = history.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    rows = numbered(new, ["timestamp"], "at", 8)
    return history.unionByName(rows.join(F.broadcast(last)).withColumn("id", F.col("last") + F.col("at") + 1).drop("last", "at"), allowMissingColumns=True)


def history_get(history: DataFrame, key: int) -> DataFrame:
    return history.where(F.col("id") == key)


def history_count(history: DataFrame) -> DataFrame:
    return history.agg(F.count("*").alias("n"))


def history_delete(history: DataFrame, keys: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """What is left without some analyses (all if None), and how many are gone."""
    gone = F.lit(True) if keys is None else F.col("id").isin(keys)
    return history.where(~gone), history.agg(F.count_if(gone).alias("deleted"))


def history_append(path: str, rows: DataFrame) -> None:
    rows.write.mode("append").parquet(path)


def history_page(history: DataFrame, offset: int, limit: int) -> DataFrame:
    return history.orderBy(F.desc("id")).offset(offset).limit(limit)
