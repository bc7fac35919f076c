"""Connected components over an edge table, without collecting edges anywhere."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, some, stored


TASK_EDGES = 1 << 20  # edges that one task joins at once (16 MB)


def smallest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ends of the edges, and the smallest end that each one reaches."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y = at[: len(u)], at[len(u) :]
    top = np.arange(len(nodes))
    while True:
        p, q = top[x], top[y]
        apart = p != q
        if not apart.any():
            return nodes, nodes[top]
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        np.minimum.at(top, np.maximum(p, q), np.minimum(p, q))
        while (top[top] != top).any():
            top = top[top]


def contracted(edges: DataFrame, roots: bool = False) -> DataFrame:
    """The edges (u, v) as stars: each task gives, for every TASK_EDGES of its edges or fewer, each node (u) with the
    smallest one (v) that it reaches there. roots: whether that one is given as a node, too."""
    most = TASK_EDGES

    def run(batches):
        def stars(held):
            node, root = smallest(*(np.concatenate(x) for x in zip(*held)))
            keep = slice(None) if roots else node != root
            return pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(root[keep])], ["u", "v"])

        held, n = [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, most):
                part = [batch.column(k).slice(lo, most).to_numpy() for k in (0, 1)]
                if held and n + len(part[0]) > most:
                    yield stars(held)
                    held, n = [], 0
                held.append(part)
                n += len(part[0])
        if held:
            yield stars(held)

    return edges.where("u <> v").select("u", "v").mapInArrow(run, "u long, v long")


def _canonical(e: DataFrame) -> DataFrame:
    return e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return _canonical(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _canonical(moved.union(low.select("u", F.col("m").alias("v"))))


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest reachable id of every node of an edge; nodes without edges are absent.

    Each task first makes stars of its own edges. Where these are at most TASK_EDGES, one task joins them: every
    exchange costs the driver threads and memory, however few its rows. More of them go through rounds of large-star
    and small-star steps: each is an aggregation with map-side combine plus an equi-join, so that no neighbour
    list is ever gathered and a hub's rows can be split by AQE. Every round is written to the shared folder. Null
    ends are ignored; an empty table gives an empty one.
    """
    e = stored(contracted(edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))))
    if e.count() <= TASK_EDGES:
        out = stored(contracted(e.coalesce(1), roots=True).toDF("node", "root"))
        drop_stored(e)
        return out
    before = None
    for _ in range(max_rounds):
        after = stored(_small_star(_large_star(e)))
        drop_stored(e)
        e = after
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not converge")
    out = stored(e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))
    drop_stored(e)
    return out


def extended(label: DataFrame | None, edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) after further edges. Where all are few, they are joined anew; else the further ones are drawn between the
    roots known so far, so that old links aren't gone over again."""
    if label is None:
        return components(edges, a, b)
    if label.select("node").union(edges.select(a)).count() <= TASK_EDGES:
        return components(label.toDF(a, b).unionByName(edges.select(a, b)), a, b)
    ends = [label.select(F.col("node").alias(f"{c}_node"), F.col("root").alias(f"{c}_root")).hint("merge") for c in ("x", "y")]
    drawn = edges.join(ends[0], F.col(a) == F.col("x_node"), "left").join(ends[1], F.col(b) == F.col("y_node"), "left")
    drawn = stored(drawn.select(F.coalesce("x_root", a).alias("p"), F.coalesce("y_root", b).alias("q")).where("p <> q").distinct())
    if not some(drawn):
        drop_stored(drawn)
        return label
    top = components(drawn, "p", "q")
    moved = label.join(top.select(F.col("node").alias("root"), F.col("root").alias("new")), "root", "left").select("node", F.coalesce("new", "root").alias("root"))
    out = stored(moved.union(top.join(label.select("node"), "node", "left_anti")))
    drop_stored(drawn, top)
    return out
