"""Shared helpers of the corpus operators: tables, shared storage, bounded batches, word splitting and hashing."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Only A-Z changes; every other byte of the UTF-8 text stays as it is.
ASCII_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of an Arrow batch that a Python worker gets at once, unless one row is larger.
BATCH_BYTES = 8 << 20
#: Least time between two collections of garbage that ``drop_stored`` asks for.
GC_SECONDS = 3.0
_last_gc = 0.0
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> SparkSession:
    """Bounds the batches of Python workers by bytes; a smaller bound of the session's own stays."""
    now = re.match(r"\d+", spark.conf.get(_BATCH_CONF))
    if not now or not 0 < int(now[0]) <= BATCH_BYTES:
        spark.conf.set(_BATCH_CONF, BATCH_BYTES)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; read through Spark so that any Hadoop file system works."""
    return small_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a fresh local folder
    serves a local master (tests); on a cluster that is an error, for executors don't see the driver's folders."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="codeseam-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """Writes df as a table into the shared folder and reads it back: cuts lineage, survives lost executors.

    Operators that return a lazy frame over such a table leave it there, as a checkpoint does;
    ``drop_stored`` removes tables nothing reads any more."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/codeseam-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._codeseam_path = path
    return out


def drop_stored(*dfs: DataFrame | None) -> None:
    """Deletes stored tables that nothing reads any more, and lets Spark's cleaner find the shuffle files of finished steps."""
    held = [df for df in dfs if df is not None]
    for df in held:
        path = getattr(df, "_codeseam_path", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
    global _last_gc
    if held and time.monotonic() - _last_gc > GC_SECONDS:
        gc.collect()
        held[0].sparkSession._jvm.System.gc()
        _last_gc = time.monotonic()


def some(df: DataFrame) -> bool:
    return df.limit(1).count() > 0


def ascii_words(text: str | None, lower: bool) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8 bytes (bytes.split() splits at exactly these)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.translate(ASCII_LOWER) if lower else raw).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """One 64-bit hash for each run of n consecutive words, joined from runs of 1, 2, 4, ... words."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out, used, run, size = None, 0, hashes, 1
    while True:
        if n & size:
            part = run[used : used + count]
            out = mix(part + np.uint64(n)) if out is None else mix(out + part)
            used += size
        if used == n:
            return out
        run = mix(run[:-size] * np.uint64(0x9FB21C651E98DF25) + run[size:])
        size *= 2


def bitmap_of(hashes: DataFrame, column: str, bits: int) -> np.ndarray:
    """A map of the low bits of 64-bit hashes, as words of 64: at most bits / 64 rows come to the driver."""
    p = hashes.select(F.col(column).bitwiseAND(bits - 1).alias("p"))
    one = F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))"))
    got = p.groupBy(F.shiftright("p", 6).cast("int").alias("slot")).agg(one.alias("bits")).toPandas()
    out = np.zeros(bits // 64, np.uint64)
    out[got["slot"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def in_bitmap(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes (uint64) may be in the map: all that are, and few others while it isn't full."""
    p = hashes & np.uint64(64 * len(bitmap) - 1)
    return bitmap[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1) > 0


def texts_of(column: pa.Array) -> pa.Array:
    """A string column whose nulls are empty texts."""
    return pc.fill_null(column, "") if column.null_count else column


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one behind the other, and where each begins (and the last ends)."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(texts.type) else np.int32)
    at = at[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if data is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def row_slices(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows of about ``most`` bytes, so that one vectorised step has a bounded size."""
    _, at = _bytes_of(texts)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


#: Word bytes: all but ASCII white space.
NOT_SPACE = np.array([c not in b" \t\n\x0b\x0c\r" for c in range(256)])
_BLOCK = 1 << 17
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def _powers(base: int) -> np.ndarray:
    out = np.full(_BLOCK, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE), _powers(_BACK)
_VALUE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64)
_LOWER_VALUE = _VALUE.copy()
_LOWER_VALUE[65:91] = _VALUE[97:123]


def hashed_words(texts: pa.Array, lower: bool, is_word: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All words of all texts (without nulls): 64-bit hashes, the bytes' begins and ends (counted from the first
    text's begin), and the number of each text's first word (and of all words).

    A word's hash is that of its bytes alone: the sum of a random value for each byte times a power of an odd
    base, mixed with the length. Sums over all bytes, block by block, give those of words as differences."""
    data, at = _bytes_of(texts)
    n = len(data)
    if not n:
        zero = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), zero, zero, np.zeros(len(texts) + 1, np.int64)
    inside = is_word[data]
    edge = np.empty(n, bool)
    edge[0], edge[1:] = True, ~inside[:-1]
    edge[at[:-1][at[:-1] < n]] = True
    starts = np.flatnonzero(inside & edge)
    edge[-1], edge[:-1] = True, ~inside[1:]
    edge[at[1:][at[1:] > 0] - 1] = True
    ends = np.flatnonzero(inside & edge) + 1
    value = _LOWER_VALUE if lower else _VALUE
    marks = np.column_stack([starts, ends]).ravel()  # in order: a word ends before the next begins
    sums, back = np.empty(len(marks), np.uint64), np.empty(len(starts), np.uint64)
    total, done, mask = 0, 0, (1 << 64) - 1
    for lo in range(0, n, _BLOCK):
        hi = min(n, lo + _BLOCK)
        prefix = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(value[data[lo:hi]] * _UP[: hi - lo], out=prefix[1:])
        up, until = pow(_BASE, lo, 1 << 64), int(np.searchsorted(marks, hi))
        sums[done:until] = prefix[marks[done:until] - lo] * np.uint64(up) + np.uint64(total)
        first, last = (done + 1) // 2, (until + 1) // 2  # the words that begin in this block
        back[first:last] = _DOWN[starts[first:last] - lo] * np.uint64(pow(_BACK, lo, 1 << 64))
        total, done = (total + int(prefix[-1]) * up) & mask, until
    sums[done:] = total
    of = (sums[1::2] - sums[::2]) * back
    hashes = mix(of + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return hashes, starts, ends, np.searchsorted(starts, at)


def sliced(texts: list, max_chars: int = 4_000_000):
    """Ranges of consecutive rows of about max_chars of text, so that one vectorised step has a bounded size."""
    start = total = 0
    for i, t in enumerate(texts):
        total += len(t or "")
        if total >= max_chars:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
