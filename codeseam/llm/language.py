"""Language mixtures: each document's language proportions by expectation-maximisation over n-gram likelihoods.

Texts are read as symbols: a blank at word borders, the letters a to z, and 37 classes of other bytes (those of
non-ASCII letters). Training counts the trigrams of the words of every labelled text for each language, exactly;
partitions send their sums, and counts of bigrams and single symbols are their margins. A symbol's probability after two
others interpolates the three orders, so trigrams that a language never showed fall back on shorter ones. A
document is a mixture: its words are drawn from languages in unknown proportions, which EM estimates; languages
join the set one by one as long as the penalised likelihood (BIC) gains.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, drop_stored, small_batches, sliced, stored

BITS = 6  # of a symbol
TRIGRAMS, BIGRAMS, SYMBOLS = 1 << 3 * BITS, 1 << 2 * BITS, 1 << BITS
#: Weights of trigrams, bigrams, single symbols and of the uniform distribution.
WEIGHTS = (0.7, 0.2, 0.09, 0.01)
SHARD_LANGUAGES = 256  # languages whose tables are held side by side; more are dealt to several shards
DENSE_LANGUAGES = 16  # up to that many, a shard holds every trigram's value (1 MB a language), else the counted ones'
HELD_COUNTS = 64  # languages that a worker counts at once
BLOCK_CELLS = 1_000_000  # words x languages that are scored at once
KEPT_CELLS = 8_000_000  # words x languages of one document that are kept; above that each pass scores anew
EM_STEPS = 12
_BLANK = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in ASCII_LOWER)
_SYMBOL = np.array([c - 96 if 97 <= c <= 122 else 27 + c % 37 if c >= 128 else 0 for c in range(256)], np.uint32)


def normalised(text: str | None) -> bytes:
    """Lower-cased words with one blank around each: other characters than letters (and non-ASCII) are blanks."""
    return b" ".join([b"", *(text or "").lower().encode("utf-8", "surrogatepass").translate(_BLANK).split(), b""])


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text)) if text else False


def trigrams(raw: bytes) -> np.ndarray:
    """The number of the trigram that ends at each byte, from the third on; those that cross from word to word, which
    have a blank in the middle, count for nothing."""
    x = _SYMBOL[np.frombuffer(raw, np.uint8)]
    return x[:-2] << 2 * BITS | x[1:-1] << BITS | x[2:]


def crossing(grams: np.ndarray) -> np.ndarray:
    return grams & (SYMBOLS - 1) << BITS == 0


class Shard:
    """Log-probabilities of some languages: those of counted trigrams, and for all others what the shorter orders say."""

    def __init__(self, n: int, k: np.ndarray, gram: np.ndarray, count: np.ndarray):
        """count of gram in language k (0 to n - 1), for all counted ones."""
        first, last = gram >> BITS, gram & BIGRAMS - 1  # the first and the last two symbols
        pairs = np.bincount(k * BIGRAMS + first, count, n * BIGRAMS).reshape(n, BIGRAMS)  # as contexts of a third
        ends = np.bincount(k * BIGRAMS + last, count, n * BIGRAMS).reshape(n, SYMBOLS, SYMBOLS)
        middle = ends.sum(axis=2, keepdims=True)
        single = ends.sum(axis=1) / np.maximum(1, ends.sum(axis=(1, 2)))[:, None]
        three, two, one, none = WEIGHTS
        lower = two * ends / np.maximum(1, middle) + one * single[:, None, :] + none / SYMBOLS
        lower = (lower / np.where(middle > 0, 1, 1 - two)).reshape(n, BIGRAMS)
        self.lower = np.log(lower).astype(np.float32)
        self.context = np.log(np.where(pairs > 0, 1, 1 / (1 - three))).astype(np.float32)
        order = np.argsort(gram, kind="stable")
        self.lang = k[order].astype(np.int32)
        self.value = np.log(three * count / pairs[k, first] + lower[k, last])[order].astype(np.float32)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(gram, minlength=TRIGRAMS))])
        self.dense = self.of(np.arange(TRIGRAMS)) if n <= DENSE_LANGUAGES else None

    def __len__(self) -> int:
        return len(self.lower)

    def of(self, grams: np.ndarray) -> np.ndarray:
        """languages x grams, for distinct grams."""
        n = self.starts[grams + 1] - self.starts[grams]
        flat = np.repeat(self.starts[grams] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        out = self.lower[:, grams & BIGRAMS - 1] + self.context[:, grams >> BITS]
        out[self.lang[flat], np.repeat(np.arange(len(grams)), n)] = self.value[flat]
        out[:, crossing(grams)] = 0
        return out

    def scores(self, grams: np.ndarray) -> np.ndarray:
        if self.dense is not None:
            return self.dense[:, grams]
        some, back = np.unique(grams.astype(np.int64), return_inverse=True)
        return self.of(some)[:, back]


def train(docs: DataFrame) -> tuple[list[str], list[Shard]]:
    """Languages (all non-null lang values, sorted) and their log-probabilities in shards, from doc text.

    Null texts teach nothing; a language without a word is learned, but never likely; repeated rows count as often
    as they stand there; without labels there are no languages."""
    small_batches(docs.sparkSession)
    rows = docs.select("lang", "text").where("lang is not null and text is not null")
    names = sorted(r[0] for r in rows.select("lang").distinct().collect())
    if not names:
        return [], []
    at = {x: i for i, x in enumerate(names)}

    def run(batches):
        sums: dict[int, np.ndarray] = {}

        def partial():
            for k, v in sums.items():
                held = np.flatnonzero(v)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held), k), pa.int32()), pa.array(held, pa.int32()), pa.array(v[held], pa.int64())], ["k", "gram", "n"])
            sums.clear()

        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in sliced(texts):
                of: dict[str, list[bytes]] = {}
                for x, t in zip(langs[lo:hi], texts[lo:hi]):
                    of.setdefault(x, []).append(normalised(t))
                for lang, parts in of.items():
                    raw = b"".join(parts)
                    if len(raw) > 2:
                        grams = trigrams(raw)
                        if at[lang] not in sums:
                            if len(sums) == HELD_COUNTS:  # bounds a worker's memory
                                yield from partial()
                            sums[at[lang]] = np.zeros(TRIGRAMS, np.int64)
                        sums[at[lang]] += np.bincount(grams[~crossing(grams)], minlength=TRIGRAMS)
        yield from partial()

    total = rows.mapInArrow(run, "k int, gram int, n long").groupBy("k", "gram").agg(F.sum("n").alias("n"))
    several = len(names) > SHARD_LANGUAGES
    if several:
        total = stored(total)
    shards = []
    for lo in range(0, len(names), SHARD_LANGUAGES):  # at most SHARD_LANGUAGES * TRIGRAMS sums at once
        size = min(SHARD_LANGUAGES, len(names) - lo)
        part = (total.where(F.col("k").between(lo, lo + size - 1)) if several else total).toPandas()
        shards.append(Shard(size, part["k"].to_numpy(np.int64) - lo, part["gram"].to_numpy(np.int64), part["n"].to_numpy(np.float64)))
    if several:
        drop_stored(total)
    return names, shards


def em(like: np.ndarray, weight: np.ndarray, steps: int = EM_STEPS) -> tuple[np.ndarray, float]:
    """Proportions of the columns and the log-likelihood; like: words x languages, scaled per word."""
    pi = np.full(like.shape[1], 1 / like.shape[1])
    total = weight.sum()
    for _ in range(steps):
        joint = like * pi
        norm = joint.sum(axis=1)
        new = (weight / norm) @ joint / total
        if np.abs(new - pi).max() < 1e-4:
            pi = new
            break
        pi = new
    return pi, float(weight @ np.log(like @ pi))


def word_likes(raw: bytes, shards: list[Shard]) -> tuple[int, int, Iterator]:
    """Numbers of words and languages, and a way to go over (lo, hi, words x languages): the likelihoods of a block of
    words, each scaled by its largest (e^-40 at least). Blocks are bounded; those of a short text are kept."""
    starts = np.flatnonzero(np.frombuffer(raw, np.uint8)[:-2] == 32)  # each word begins with its leading blank
    words, languages = len(starts), sum(map(len, shards))
    step = max(1, BLOCK_CELLS // languages)
    ends = np.append(starts[1:], len(raw) - 1)
    held: list | None = [] if words * languages <= KEPT_CELLS else None

    def blocks():
        if held:
            yield from held
            return
        for lo in range(0, words, step):
            hi = min(words, lo + step)
            grams = trigrams(raw[starts[lo] : ends[hi - 1] + 1])
            at = starts[lo:hi] - starts[lo]
            score = np.concatenate([np.add.reduceat(s.scores(grams), at, axis=1) for s in shards]).T.astype(np.float64)
            like = np.exp(np.maximum(score - score.max(axis=1, keepdims=True), -40.0))
            if held is not None:
                held.append((lo, hi, like))
            yield lo, hi, like

    return words, languages, blocks


def mixture(raw: bytes, shards: list[Shard]) -> np.ndarray | None:
    """Proportions of all languages (zero outside the selected set); None without a word."""
    if len(raw) < 3:
        return None
    words, n, blocks = word_likes(raw, shards)

    def column(language):
        return np.concatenate([like[:, language] for _, _, like in blocks()])

    weight = np.ones(words)
    single = sum(np.log(like).sum(axis=0) for _, _, like in blocks())
    chosen = [int(single.argmax())]
    best, pi = float(single[chosen[0]]), np.ones(1)
    columns = column(chosen[0])[:, None]
    while len(chosen) < n:
        mixed = 0.5 * (columns @ pi)[:, None]
        gain = sum(np.log(0.5 * like + mixed[lo:hi]).sum(axis=0) for lo, hi, like in blocks())
        gain[chosen] = -np.inf
        trial = chosen + [int(gain.argmax())]
        wider = np.column_stack([columns, column(trial[-1])])
        p, value = em(wider, weight)
        if value - best <= 0.5 * 2 * np.log(words + 1):  # a proportion and a choice of language
            break
        chosen, best, pi, columns = trial, value, p, wider
    out = np.zeros(n)
    out[chosen] = pi
    return out


def identify(docs: DataFrame, model: tuple[list[str], list[Shard]]) -> DataFrame:
    """doc_id, lang_pred, score, mixture (languages with their proportions) of each row.

    Only the whole text is used; a long one is scored in bounded blocks of words. lang_pred is the language with
    the largest proportion (the first by name in a tie), or und if the text is null or has no letter, or nothing was
    learned; score is its proportion. Every row gives one row, repeated ones too; an empty table gives an empty one;
    other columns are ignored, whatever their names.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        names, shards = shared.value
        for batch in batches:
            pred, score, mixed = [], [], []
            for text in batch.column(1):
                text = text.as_py()
                pi = mixture(normalised(text), shards) if names and has_letter(text) else None
                if pi is None and names and has_letter(text):
                    pi = np.full(len(names), 1 / len(names))
                k = int(pi.argmax()) if pi is not None else None
                pred.append("und" if k is None else names[k])
                score.append(0.0 if k is None else float(min(1.0, pi[k])))
                mixed.append([] if k is None else [{"lang": names[i], "share": float(pi[i])} for i in np.flatnonzero(pi)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(mixed, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))], ["doc_id", "lang_pred", "score", "mixture"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, mixture array<struct<lang:string,share:double>>")


def held_out(modulus: int, remainder: int):
    return (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % modulus == remainder).alias("held_out")
