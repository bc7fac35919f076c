"""Exact deduplication over a minimal perfect hash of historical digests.

The index maps every distinct historical digest to its own slot: level by level, keys that fall alone
into a bit array keep their place and the rest go on; the rank of a key's bit is its slot. A slot holds
the full digest and the locator (largest doc_id, number of rows) of its group. A lookup hashes to a slot
and compares all digest bytes, so a digest that was never indexed is told apart for certain.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, drop_stored, mix, stored

SHARD_KEYS = 1_024  # digests in a shard of the index, about: small, so that shards spread evenly over tasks
GAMMA, MAX_LEVELS = 2.0, 64


def build_mph(digests: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Bit arrays of the levels, and the slot of each of the distinct 32-byte digests (n x 4 uint64)."""
    levels, slots, rest, base = [], np.full(len(digests), -1, np.int64), np.arange(len(digests)), 0
    while len(rest):
        if len(levels) == MAX_LEVELS:
            raise ValueError("digests are not distinct")
        size = max(64, int(GAMMA * len(rest)))
        at = _place(digests[rest], len(levels), size)
        alone = np.bincount(at, minlength=size) == 1
        rank = np.cumsum(alone) - 1
        won = alone[at]
        slots[rest[won]] = base + rank[at[won]]
        base += int(alone.sum())
        levels.append(alone)
        rest = rest[~won]
    return levels, slots


def _place(digests: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(digests[:, 1] + np.uint64(level) * mix(digests[:, 2] | np.uint64(1))) % np.uint64(size)).astype(np.int64)


def lookup_mph(levels: list[np.ndarray], digests: np.ndarray) -> np.ndarray:
    """The slot each digest would have; -1 where no level takes it. A member always gets its own slot."""
    out, rest, base = np.full(len(digests), -1, np.int64), np.arange(len(digests)), 0
    for k, bits in enumerate(levels):
        at = _place(digests[rest], k, len(bits))
        hit = bits[at]
        out[rest[hit]] = base + (np.cumsum(bits) - 1)[at[hit]]
        base += int(bits.sum())
        rest = rest[~hit]
    return out


def _words(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.uint64).reshape(-1, 4)


def _pack(levels, digests, keep, size) -> bytes:
    out = io.BytesIO()
    np.savez(out, sizes=np.array([len(x) for x in levels], np.int64), bits=np.packbits(np.concatenate(levels) if levels else np.zeros(0, bool)), digests=digests, keep=keep, size=size)
    return out.getvalue()


def _unpack(blob: bytes):
    x = np.load(io.BytesIO(blob), allow_pickle=False)
    bits = np.unpackbits(x["bits"]).astype(bool)
    ends = np.cumsum(x["sizes"])
    return [bits[e - n : e] for e, n in zip(ends, x["sizes"])], x["digests"], x["keep"], x["size"]


def digests_of(docs: DataFrame, history: Column) -> DataFrame:
    """doc_id, text_hash, digest (SHA-256 of the text with A-Z lower-cased; null is empty), old (row is historical)."""
    text = normalised(F.col("text"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.unhex(F.sha2(text, 256)).alias("digest"), F.coalesce(history, F.lit(False)).alias("old"))


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def groups_of(digests: DataFrame) -> DataFrame:
    return digests.groupBy("digest").agg(F.max("doc_id").alias("keep"), F.count("*").alias("size"))


def _shard(n: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(n)).cast("int").alias("shard")


def build_index(groups: DataFrame, shards: int) -> DataFrame:
    """(shard, blob): a minimal perfect hash with its slots for each shard; shards have about SHARD_KEYS digests."""
    rows = groups.select(_shard(shards), "digest", "keep", "size").repartition("shard").sortWithinPartitions("shard")

    def run(batches):
        def done(shard, parts):
            d, k, s = (sum((p[i] for p in parts), []) for i in range(3))
            words, keep = _words(d), np.array([-(2**63) if x is None else x for x in k], np.int64)
            levels, slots = build_mph(words)
            order = np.argsort(slots)
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([_pack(levels, words[order], keep[order], np.array(s, np.int64)[order])], pa.binary())], ["shard", "blob"])

        at, parts = None, []
        for batch in batches:
            shard = batch.column(0).to_numpy()
            cuts = np.r_[0, np.flatnonzero(shard[1:] != shard[:-1]) + 1, len(shard)] if len(shard) else []
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if at is not None and shard[lo] != at:
                    yield done(at, parts)
                    parts = []
                at = shard[lo]
                parts.append([batch.column(i).slice(lo, hi - lo).to_pylist() for i in (1, 2, 3)])
        if at is not None:
            yield done(at, parts)

    return rows.mapInArrow(run, "shard int, blob binary")


def lookup_index(index: DataFrame, groups: DataFrame, shards: int) -> DataFrame:
    """digest, keep, size of groups, and old_keep, old_size of the slot whose digest is byte for byte the same (else null)."""
    queries = groups.select(_shard(shards), F.lit(1).alias("kind"), "digest", "keep", "size")
    blobs = index.select("shard", F.lit(0).alias("kind"), F.col("blob").alias("digest"), F.lit(None).cast("long").alias("keep"), F.lit(None).cast("long").alias("size"))
    rows = blobs.union(queries).repartition("shard").sortWithinPartitions("shard", "kind")

    def run(batches):
        at, held = None, None
        for batch in batches:
            shard, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.r_[0, np.flatnonzero((shard[1:] != shard[:-1]) | (kind[1:] != kind[:-1])) + 1, len(shard)] if len(shard) else []
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                part = batch.slice(lo, hi - lo)
                if kind[lo] == 0:
                    at, held = shard[lo], _unpack(part.column(2)[0].as_py())
                    continue
                n = hi - lo
                old_keep, old_size = [None] * n, [None] * n
                if at == shard[lo]:
                    levels, digests, keep, size = held
                    words = _words(part.column(2).to_pylist())
                    slot = lookup_mph(levels, words)
                    same = (slot >= 0) & (digests[np.maximum(slot, 0)] == words).all(axis=1)
                    for i in np.flatnonzero(same):
                        k = int(keep[slot[i]])
                        old_keep[i], old_size[i] = (None if k == -(2**63) else k), int(size[slot[i]])
                yield pa.RecordBatch.from_arrays([part.column(2), part.column(3), part.column(4), pa.array(old_keep, pa.int64()), pa.array(old_size, pa.int64())], ["digest", "keep", "size", "old_keep", "old_size"])

    return rows.mapInArrow(run, "digest binary, keep long, size long, old_keep long, old_size long")


def exact_duplicates(docs: DataFrame, history: Column | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, text_hash (xxhash64 of the normalised text): one row for each row of docs.

    history marks the rows that earlier loads brought; their digests form the index. Without it, half of
    the rows (by a checksum of doc_id) take that part. The groups don't depend on the split. Texts are
    equal if identical after lower-casing A-Z; null is empty. The largest doc_id of a group stays; null
    ids never win over others, and a group of null ids keeps them all; repeated rows count in group_size
    and share one decision; texts of any length are hashed in the JVM, whole; an empty table gives an empty one;
    other columns are ignored, whatever their names.
    """
    if history is None:
        history = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    digests = stored(digests_of(docs, history))
    old = stored(groups_of(digests.where("old")))
    shards = max(1, -(-old.count() // SHARD_KEYS))
    index = build_index(old, shards)
    found = stored(lookup_index(index, groups_of(digests.where("not old")), shards))
    joined = found.select("digest", F.greatest("keep", "old_keep").alias("keep_id"), (F.col("size") + F.coalesce("old_size", F.lit(0))).alias("group_size"))
    members = found.where("old_size is not null").select("digest")
    untouched = old.join(members, "digest", "left_anti").select("digest", F.col("keep").alias("keep_id"), F.col("size").alias("group_size"))
    groups = joined.union(untouched)
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept")
    out = stored(digests.join(groups, "digest").select("doc_id", "keep_id", "group_size", kept, F.lower(F.hex("digest")).alias("text_sha256"), "text_hash"))
    drop_stored(digests, old, found)
    return out
