"""Removal of passages that repeat across documents, by sharded Aho-Corasick automata over recurring phrases.

A passage of ``window`` words is found through its anchor: the 8-word phrase with the smallest hash in it, which
depends on the passage's words alone, so that equal passages have equal anchors wherever they stand.

1. Every document gives its anchors (about 2 in 44 words); anchors of at least two documents recur.
2. Documents stream past the recurring anchors, as a bitmap of bounded size or, beyond that, joined to each
   document, and give the stretches around them: the words of all windows with that anchor. Equal stretches
   collapse to one, with the smallest and the largest document they stand in.
3. Stretches are dealt to shards of anchors. A shard confirms the windows that stand in at least two documents,
   compiles the phrases of confirmed ones into an Aho-Corasick automaton and streams all its stretches through it;
   the windows around each occurrence give runs of windows, each with its smallest document.
4. The few anchors that stand in very many different stretches don't go to a shard: their windows are confirmed
   row by row, so that no task holds all of them.
5. Runs return to every document that has the stretch; those of smaller documents mark its words.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap_of, drop_stored, hashed_words, in_bitmap, mix, row_slices, shingle_hashes, small_batches, some, stored, texts_of

PHRASE = 8
SLICE = 1 << 19  # bytes of text that are hashed at once
RUN = 64  # windows of a stretch, at most
SHARD_STRETCHES, HOT_STRETCHES = 20_000, 10_000  # stretches of a shard, about, and of one anchor in it, at most
#: Recurring anchors of a bitmap (8 bits and more each, so 16 MB at most); more are joined to their documents.
MOST_ANCHORS = 1 << 24
KNOWN_TEXTS = 200_000  # stretches of which a task remembers that it has given their text


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def sliding_min(x: np.ndarray, span: int) -> np.ndarray:
    """The smallest of each span consecutive values, from those of 1, 2, 4, ... values."""
    size = 1
    while 2 * size <= span:
        x, size = np.minimum(x[:-size], x[size:]), 2 * size
    rest = span - size
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def anchors(texts: pa.Array, window: int) -> list[np.ndarray]:
    """Of each text the anchor (a phrase's hash) of each of its windows."""
    hashes, _, _, first = hashed_words(texts, lower=False)
    flat = shingle_hashes(hashes, PHRASE)
    if len(flat) < window - PHRASE + 1:
        return [flat[:0]] * len(texts)
    flat = sliding_min(flat, window - PHRASE + 1)
    return [flat[a : max(a, b - window + 1)] for a, b in zip(first[:-1].tolist(), first[1:].tolist())]


def anchors_of(docs: DataFrame, window: int) -> DataFrame:
    """(anchor, doc_id): the distinct anchors of each document."""

    def run(batches):
        for batch in batches:
            texts, ids = texts_of(batch.column(2)), batch.column(0).to_numpy()
            for lo, hi in row_slices(texts, SLICE):
                found = [np.unique(x) for x in anchors(texts.slice(lo, hi - lo), window)]
                flat = np.concatenate(found).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(np.repeat(ids[lo:hi], [len(x) for x in found]))], ["anchor", "doc_id"])

    return docs.mapInArrow(run, "anchor long, doc_id long")


STRETCH = "anchor long, stretch long, doc_id long, text_hash long, start int, text string"
_STRETCH = pa.schema([("anchor", pa.int64()), ("stretch", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("start", pa.int32()), ("text", pa.string())])


def stretches_of(docs: DataFrame, window: int, bitmap) -> DataFrame:
    """Stretches around the recurring anchors of docs (doc_id, text_hash, text and, without a bitmap, anchors), in words
    from start on. A task gives the text of a stretch that it meets again only now and then: one text is enough."""

    def run(batches):
        given: set[int] = set()
        for batch in batches:
            ids, hashes, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch.column(2))
            for lo, hi in row_slices(texts, SLICE):
                out: list[list] = [[] for _ in _STRETCH]
                for k, found in enumerate(anchors(texts.slice(lo, hi - lo), window), lo):
                    if not len(found):
                        continue
                    if bitmap is not None:
                        hit = in_bitmap(bitmap.value, found)
                    else:
                        hit = np.isin(found, np.array(batch.column(3)[k].as_py(), np.int64).view(np.uint64))
                    if not hit.any():
                        continue
                    turn = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
                    place = np.arange(len(found)) - np.repeat(turn, np.diff(np.append(turn, len(found))))
                    edges = np.append(np.flatnonzero(place % RUN == 0), len(found))
                    words, wanted = words_of(texts[k].as_py()), hit[edges[:-1]]
                    for a, b in zip(edges[:-1][wanted].tolist(), edges[1:][wanted].tolist()):
                        raw = b" ".join(words[a : b + window - 1])
                        stretch = hash_of(raw)
                        if len(given) >= KNOWN_TEXTS:
                            given.clear()
                        text = None if stretch in given else raw.decode("utf-8", "surrogatepass")
                        given.add(stretch)
                        for col, v in zip(out, (int(found[a].view(np.int64)), stretch, ids[k], hashes[k], a, text)):
                            col.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, _STRETCH)], schema=_STRETCH)

    return docs.mapInArrow(run, STRETCH)


def hash_of(raw: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(raw) - 2**63


def window_hashes(texts: list[str], window: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the windows of all texts, and how many each has."""
    hashes, _, _, first = hashed_words(pa.array(texts, pa.large_string()), lower=False)
    flat, sizes = shingle_hashes(hashes, window), np.maximum(0, np.diff(first) - window + 1)
    at = np.repeat(first[:-1] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    return flat[at], sizes


HITS = "anchor long, stretch long, runs array<struct<at:int,n:int,low:long>>"
_RUNS = pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32()), ("low", pa.int64())]))


class Shard:
    """Stretches of some anchors: confirms windows, compiles the automaton, locates its phrases."""

    def __init__(self, window: int):
        self.window, self.rows = window, ([], [], [], [], [])

    def add(self, *row) -> None:
        for col, v in zip(self.rows, row):
            col.append(v)

    def hits(self):
        """Batches of (anchor, stretch, runs) of the stretches with confirmed windows."""
        anchor, stretch, low, high, texts = self.rows
        flat, sizes = [], []
        for lo in range(0, len(texts), 2000):
            w, n = window_hashes(texts[lo : lo + 2000], self.window)
            flat.append(w)
            sizes.append(n)
        flat, sizes = np.concatenate(flat), np.concatenate(sizes)
        of = np.repeat(np.arange(len(texts)), sizes)
        anchors = np.array(anchor, np.int64)
        key = mix(flat + anchors.view(np.uint64)[of] * np.uint64(0x9FB21C651E98DF25))
        order = np.argsort(key)
        begins = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
        first, last = (f.reduceat(np.array(x, np.int64)[of][order], begins) for f, x in ((np.minimum, low), (np.maximum, high)))
        group = np.empty(len(key), np.int64)
        group[order] = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(key))))
        sure, lows = (first < last)[group], first[group]
        starts = np.cumsum(sizes) - sizes
        held = np.unique(of[sure])  # stretches with confirmed windows
        automaton = ahocorasick.Automaton()
        for k in held[np.unique(anchors[held], return_index=True)[1]].tolist():
            phrase = self.phrase(texts[k], anchor[k])
            automaton.add_word(phrase, anchor[k])
        if not len(automaton):
            return
        automaton.make_automaton()
        span = self.window - PHRASE
        out: list[list] = [[], [], []]
        for k in held.tolist():
            padded, found = f" {texts[k]} ", np.zeros(sizes[k], bool)
            for end, name in automaton.iter(padded):
                if name == anchor[k]:  # a window belongs to its own anchor
                    place = padded.count(" ", 0, end) - PHRASE
                    found[max(0, place - span) : place + 1] = True
            found &= sure[starts[k] : starts[k] + sizes[k]]
            at = np.flatnonzero(found)
            if len(at):
                own = lows[starts[k] + at]
                cut = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (own[1:] != own[:-1])]))
                n = np.diff(np.append(cut, len(at)))
                runs = [{"at": a, "n": m, "low": x} for a, m, x in zip(at[cut].tolist(), n.tolist(), own[cut].tolist())]
                for col, v in zip(out, (anchor[k], stretch[k], runs)):
                    col.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], _RUNS)], ["anchor", "stretch", "runs"])

    def phrase(self, text: str, anchor: int) -> str:
        """The words of a stretch's anchor, with blanks around: the first run of words with its hash."""
        hashes = shingle_hashes(hashed_words(pa.array([text]), lower=False)[0], PHRASE).view(np.int64)
        p = int(np.flatnonzero(hashes == anchor)[0])
        return " " + b" ".join(words_of(text)[p : p + PHRASE]).decode("utf-8", "surrogatepass") + " "


def locate(distinct: DataFrame, window: int) -> DataFrame:
    """(anchor, stretch, runs) of the distinct stretches (anchor, stretch, low, high, text) with confirmed windows."""
    shards = max(1, -(-distinct.count() // SHARD_STRETCHES))
    shard = F.pmod(F.xxhash64("anchor"), F.lit(shards)).cast("int").alias("shard")
    rows = distinct.select(shard, "anchor", "stretch", "low", "high", "text").repartition("shard").sortWithinPartitions("shard")

    def run(batches):
        now, held = None, None
        for batch in batches:
            for shard, *row in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if shard != now:
                    if held:
                        yield from held.hits()
                    now, held = shard, Shard(window)
                held.add(*row)
        if held:
            yield from held.hits()

    return rows.mapInArrow(run, HITS)


def locate_hot(distinct: DataFrame, window: int) -> DataFrame:
    """As ``locate``, for anchors with very many stretches: a row for each window, so no key has to be held whole."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                flat, sizes = window_hashes(part.column(4).to_pylist(), window)
                of = pa.array(np.repeat(np.arange(part.num_rows), sizes))
                at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                cols = [part.column(k).take(of) for k in range(4)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(at, pa.int32()), pa.array(flat.view(np.int64))], ["anchor", "stretch", "low", "high", "at", "window"])

    rows = distinct.select("anchor", "stretch", "low", "high", "text").mapInArrow(run, "anchor long, stretch long, low long, high long, at int, window long")
    sure = rows.groupBy("anchor", "window").agg(F.min("low").alias("first"), F.max("high").alias("last")).where("first < last").select("anchor", "window", "first")
    one = F.struct("at", F.lit(1).alias("n"), F.col("first").alias("low"))
    return rows.join(sure, ["anchor", "window"]).groupBy("anchor", "stretch").agg(F.collect_list(one).alias("runs"))


def repeated_windows(docs: DataFrame, window: int = 50) -> DataFrame:
    """(doc_id, text_hash, runs): for each text with such, the runs of windows (first word, number) that also start in
    a document with a smaller id. docs: doc_id, text_hash, text."""
    spark = docs.sparkSession
    docs = docs.where("doc_id is not null")
    seen = stored(anchors_of(docs, window))
    recurring = stored(seen.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("anchor"))
    n, marks = recurring.count(), None
    if n <= MOST_ANCHORS:
        bitmap = spark.sparkContext.broadcast(bitmap_of(recurring, "anchor", max(1 << 16, 1 << (8 * n).bit_length())))
        found = stretches_of(docs, window, bitmap)
    else:
        marks = stored(seen.join(recurring, "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors")))
        found = stretches_of(docs.join(marks, "doc_id").select("doc_id", "text_hash", "text", "anchors"), window, None)
    found = stored(found)
    drop_stored(seen, recurring, marks)
    distinct = stored(found.groupBy("anchor", "stretch").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.max("text").alias("text")))
    by_anchor = distinct.groupBy("anchor").agg(F.count("*").alias("n"), F.min("low").alias("first"), F.max("high").alias("last"))
    several = stored(distinct.join(by_anchor.where("first < last").select("anchor", "n"), "anchor"))
    drop_stored(distinct)
    hot = several.where(F.col("n") > HOT_STRETCHES)
    hits = locate(several.where(F.col("n") <= HOT_STRETCHES), window)
    if some(hot):
        hits = hits.union(locate_hot(hot, window))
    hits = stored(hits)
    drop_stored(several)
    smaller = F.transform(F.filter("runs", lambda h: h["low"] < F.col("doc_id")), lambda h: F.struct((h["at"] + F.col("start")).alias("at"), h["n"].alias("n")))
    own = found.select("anchor", "stretch", "doc_id", "text_hash", "start").join(hits, ["anchor", "stretch"]).select("doc_id", "text_hash", smaller.alias("runs"))
    out = stored(own.where(F.size("runs") > 0).groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list("runs")).alias("runs")))
    drop_stored(found, hits)
    return out


def covered(n: int, runs: list[dict], window: int) -> np.ndarray:
    """Which of n words lie in a window of the runs."""
    edge = np.zeros(n + 1, np.int64)
    at, many = np.array([r["at"] for r in runs], np.int64), np.array([r["n"] for r in runs], np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + many + window - 1, -1)
    return np.cumsum(edge)[:n] > 0


def dedup_substrings(docs: DataFrame, window: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the remaining words, joined by one blank) for each row of docs.

    Words are runs without ASCII white space, unchanged. A word goes if a window of consecutive words that covers
    it also starts in a document with a smaller doc_id, judged on the input. Null and empty texts have no words; texts
    may be of any length. Rows with a null doc_id are returned whole; rows that share a doc_id count as one document
    and don't repeat each other, and each loses only windows of its own text; repeated rows are repeated. An empty
    table gives an empty one; other columns are ignored, whatever their names.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    joined = docs.join(repeated_windows(docs, window), ["doc_id", "text_hash"], "left").select("doc_id", "text", "runs")

    def run(batches):
        for batch in batches:
            n, gone, kept = [], [], []
            for text, runs in zip(batch.column(1), batch.column(2)):
                words = rest = words_of(text.as_py())
                if runs.is_valid:
                    drop = covered(len(words), runs.as_py(), window)
                    rest = [w for w, d in zip(words, drop.tolist()) if not d]
                n.append(len(words))
                gone.append(len(words) - len(rest))
                kept.append(b" ".join(rest).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def digest_substrings(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
