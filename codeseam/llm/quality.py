"""Quality scores: ridge regression on random Fourier features of document statistics, isotonically calibrated.

The features approximate a Gaussian kernel. Partitions sum their normal equations, for two folds apart, so
that each fold can be scored by the other's fit; isotonic regression of labels on those scores, summed in
fine bins, turns the scores of the fit on both folds into probabilities.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, small_batches, stored

FEATURES, RIDGE, SEED = 256, 1e-3, 97
#: Bound of the labelled rows that a fit uses; where there are more, a checksum thins them.
MAX_TRAINING_ROWS = 200_000
BINS, LOW, HIGH = 1024, -1.0, 2.0
NAMES = ("log_bytes", "log_words", "log_lines", "upper", "digit", "space", "symbol", "stop_marks", "non_ascii", "commas", "symbol_words", "mean_word", "sd_word", "distinct_words", "top_word", "repeated_neighbours", "distinct_lines", "mean_line", "sentence_ends", "capital_words", "entropy", "compression")

_UPPER, _LOWERCASE, _DIGIT = (np.array([c in s for c in range(256)]) for s in (range(65, 91), range(97, 123), range(48, 58)))
_SPACE = np.array([c in b" \t\n\r\x0b\x0c" for c in range(256)])
_STOPS = np.array([c in b".!?" for c in range(256)])
_SYMBOL = np.array([c < 128 and not chr(c).isalnum() and not chr(c).isspace() and c not in b".,;:!?'\"()-" for c in range(256)])


def statistics(text: str | None) -> np.ndarray:
    """Fixed statistics of a whole text; zeros for null and empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(len(NAMES), np.float32)
    if not raw:
        return out
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = len(raw)
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    p = count[count > 0] / n
    out[0], out[1], out[2] = np.log1p(n), np.log1p(len(words)), np.log1p(len(lines))
    out[3:9] = [count[m].sum() / n for m in (_UPPER, _DIGIT, _SPACE, _SYMBOL, _STOPS)] + [count[128:].sum() / n]
    out[9] = count[44] / n
    out[20], out[21] = -(p * np.log2(p)).sum(), len(zlib.compress(raw, 1)) / n
    if words:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        seen = Counter(words)
        out[10] = sum(k for w, k in seen.items() if not w.isalnum() and w[-1] not in b".,;:!?" and w.isascii()) / len(words)
        out[11], out[12] = min(sizes.mean(), 50), min(sizes.std(), 50)
        out[13], out[14] = len(seen) / len(words) ** 0.75, max(seen.values()) / len(words)
        out[15] = sum(map(bytes.__eq__, words[1:], words)) / len(words)
        out[19] = sum(k for w, k in seen.items() if w[:1].isupper()) / len(words)
    if lines:
        out[16] = len(set(lines)) / len(lines)
        out[17] = np.log1p(n / len(lines))
        out[18] = sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines) / len(lines)
    return out


def expand(stats: np.ndarray, mean: np.ndarray, sd: np.ndarray) -> np.ndarray:
    """Random Fourier features of standardised statistics, and a constant."""
    rng = np.random.default_rng(SEED)
    z = np.clip((stats - mean) / sd, -6, 6)
    w = rng.normal(size=(stats.shape[1], FEATURES)) / np.sqrt(stats.shape[1])  # bandwidth: root of the dimension
    phi = np.sqrt(2 / FEATURES) * np.cos(z @ w + rng.uniform(0, 2 * np.pi, FEATURES))
    return np.hstack([phi, np.ones((len(stats), 1))])


def _bin(score: np.ndarray) -> np.ndarray:
    return np.clip((score - LOW) / (HIGH - LOW) * BINS, 0, BINS - 1).astype(np.int64)


def isotonic(total: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Non-decreasing means of the bins (pool adjacent violators); bins without rows take neighbours' values."""
    blocks: list[list[float]] = []  # ones, total, bins
    for t, o in zip(total, ones):
        blocks.append([o, t, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1] and (blocks[-1][1] and blocks[-2][1] or not blocks[-1][1] or not blocks[-2][1]):
            o2, t2, b2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + o2, blocks[-1][1] + t2, blocks[-1][2] + b2]
    value = [(o + 0.5 * (sum(ones) / max(1, sum(total)))) / (t + 0.5) for o, t, _ in blocks]
    return np.maximum.accumulate(np.repeat(value, [b for _, _, b in blocks]))


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """stats, label, fold of the labelled rows of docs that a fit uses: labels are thinned by a checksum to
    MAX_TRAINING_ROWS at most (98 % of that are expected), which bounds their broadcast; texts aren't shuffled."""
    known = labels.where("doc_id is not null and label is not null").select("doc_id", F.col("label").cast("double").alias("label"))
    n = known.count()
    if n > MAX_TRAINING_ROWS:
        most = int(0.98 * MAX_TRAINING_ROWS / n * (1 << 32))
        known = known.where(F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1 << 32)) < most)
    fold = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(2)).cast("int").alias("fold")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id").select("text", "label", fold)

    def run(batches):
        for batch in batches:
            stats = [statistics(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(stats, pa.list_(pa.float32())), batch.column(1), batch.column(2)], ["stats", "label", "fold"])

    return own.mapInArrow(run, "stats array<float>, label double, fold int")


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """A model from texts and labels (doc_id, label 0/1); without two classes, the constant share of ones."""
    rows = stored(training_rows(docs, labels))
    d = len(NAMES)
    sums = rows.agg(F.count("*"), F.sum("label"), *[F.avg(F.col("stats")[i]) for i in range(d)], *[F.stddev_pop(F.col("stats")[i]) for i in range(d)]).first()
    if not sums[0] or sums[1] in (0, sums[0]):
        drop_stored(rows)
        return {"constant": float(sums[1] / sums[0]) if sums[0] else 0.5}
    mean, sd = np.array(sums[2 : 2 + d], float), np.maximum(np.array(sums[2 + d :], float), 1e-3)

    def equations(batches):
        a, b = np.zeros((2, FEATURES + 1, FEATURES + 1)), np.zeros((2, FEATURES + 1))
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), float).reshape(-1, d)
            y, fold = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for k in (0, 1):
                phi = expand(x[fold == k], mean, sd)
                a[k] += phi.T @ phi
                b[k] += phi.T @ y[fold == k]
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()), pa.array([b.tobytes()], pa.binary())], ["a", "b"])

    parts = rows.coalesce(8).mapInArrow(equations, "a binary, b binary").collect()  # 8 rows of fixed size
    a = sum(np.frombuffer(p.a).reshape(2, FEATURES + 1, -1) for p in parts)
    b = sum(np.frombuffer(p.b).reshape(2, -1) for p in parts)

    def solve(a, b):
        return np.linalg.solve(a + RIDGE * max(1.0, a[-1, -1]) * np.eye(FEATURES + 1), b)

    halves = np.array([solve(a[1], b[1]), solve(a[0], b[0])])  # each fold is scored by the other's fit

    def scored(batches):
        total, ones = np.zeros(BINS), np.zeros(BINS)
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), float).reshape(-1, d)
            y, fold = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            at = _bin((expand(x, mean, sd) * halves[fold]).sum(axis=1))
            total += np.bincount(at, minlength=BINS)
            ones += np.bincount(at, y, minlength=BINS)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([ones.tobytes()], pa.binary())], ["total", "ones"])

    bins = rows.coalesce(8).mapInArrow(scored, "total binary, ones binary").collect()
    drop_stored(rows)
    curve = isotonic(sum(np.frombuffer(p.total) for p in bins), sum(np.frombuffer(p.ones) for p in bins))
    return {"mean": mean, "sd": sd, "weights": solve(a.sum(axis=0), b.sum(axis=0)), "curve": curve}


def predict(stats: np.ndarray, model: dict) -> np.ndarray:
    if "constant" in model:
        return np.full(len(stats), model["constant"])
    raw = expand(stats, model["mean"], model["sd"]) @ model["weights"]
    middle = LOW + (np.arange(BINS) + 0.5) * (HIGH - LOW) / BINS
    return np.clip(np.interp(raw, middle, model["curve"]), 0, 1)


def not_held_out(labels: DataFrame, column: str = "quality", modulus: int = 3, remainder: int = 1) -> DataFrame:
    return labels.where(F.crc32(F.col("doc_id").cast("string")) % modulus != remainder).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).alias("label"))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score for each row of docs; only the text is used for a score.

    labels: doc_id, label. Null and empty texts have zero statistics and get a score like others; statistics are
    those of whole texts of any length. Labels that are null or of absent documents are ignored; several labels of
    a document all count, as do repeated rows; without labels of two classes every score is their share (0.5
    without any); an empty table gives an empty one; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    model = fit(docs, labels)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(predict(matrix(batch.column(1)), model), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs with a score of at least threshold, all columns; texts aren't shuffled."""
    small_batches(docs.sparkSession)
    model = fit(docs, labels)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(predict(matrix(batch.column(at)), model) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def matrix(texts: pa.Array) -> np.ndarray:
    return np.array([statistics(t.as_py()) for t in texts], float).reshape(-1, len(NAMES))
