"""Benchmark decontamination with a generalised suffix automaton over the words of the test items.

The automaton accepts every run of consecutive words of any item. A document's words stream through it;
after each word it knows the longest run that ends there and also lies in an item. Where that reaches the
window length, the last ``window`` words are a window of an item; items shorter than that are windows as
a whole, found through the nearest marked state on the suffix links.
"""

from __future__ import annotations

import hashlib
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ASCII_LOWER, bitmap_of, hashed_words, in_bitmap, row_slices, shingle_hashes, small_batches, stored, texts_of

#: Every byte that isn't 0-9, a-z or part of a non-ASCII character becomes a blank; A-Z are lower-cased.
_WORDS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in ASCII_LOWER)
_IS_WORD = np.array([c != 32 for c in _WORDS])
#: Item text, in characters, that one automaton holds (about 100 bytes of memory for each); more items are dealt to several.
AUTOMATON_CHARS = 1_000_000
#: Bits of the map of the windows of all items, at most (16 MB); a fuller map only lets more documents be looked at closely.
MOST_BITS = 1 << 27
#: Documents that one task matches with one automaton, about.
TASK_DOCUMENTS = 20_000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


class SuffixAutomaton:
    """Generalised over many word sequences; transitions are keyed by word numbers."""

    def __init__(self, window: int):
        self.window = window
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        self.vocabulary: dict[bytes, int] = {}
        self.items: list = []
        self.found: dict[int, set] = {}  # state of a window -> items that have it
        self.whole: dict[int, list] = {}  # state of a short item -> (its length, item numbers)

    def add(self, item, words: list[bytes]) -> None:
        if not words:
            return
        number = len(self.items)
        self.items.append((item, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]))
        last = 0
        for c in self.items[number][1]:
            last = self._extend(last, c)

    def _state(self, length: int, copy: int | None = None) -> int:
        self.next.append({} if copy is None else dict(self.next[copy]))
        self.length.append(length)
        self.link.append(0 if copy is None else self.link[copy])
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """The state of the longest run that reaches q by c from p; q itself if that is all of q."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, q)
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:  # an earlier item has this run already
            return self._split(last, c, self.next[last][c])
        new = self._state(self.length[last] + 1)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, c, self.next[p][c])
        return new

    def finish(self) -> "SuffixAutomaton":
        """Notes the windows' states, and for each state the nearest short item on its suffix links."""
        for number, (_, ids) in enumerate(self.items):
            if len(ids) < self.window:
                state = 0
                for c in ids:
                    state = self.next[state][c]
                self.whole.setdefault(state, [len(ids), []])[1].append(number)
            else:
                for end, state, run in self.stream(ids):
                    if run >= self.window:
                        self.found.setdefault(self.cut(state), set()).add(number)
        self.marked = [-1] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.marked[s] = s if s in self.whole else self.marked[self.link[s]]
        self.shortest = min((len(ids) for _, ids in self.items), default=0)
        self.pairs = np.zeros(1 << 22, bool)  # by hash: pairs of neighbouring words of items
        for _, ids in self.items:
            a = np.array(ids, np.int64)
            self.pairs[self._pair(a[:-1], a[1:])] = True
        return self

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * 2_654_435_761 + b * 40_503) & ((1 << 22) - 1)

    def cut(self, state: int) -> int:
        """The state of the last ``window`` words of a run at state."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def stream(self, ids):
        """(end, state, run length) after each known word; an unknown word (None) starts anew."""
        state = run = 0
        nxt, link, length = self.next, self.link, self.length
        for end, c in enumerate(ids):
            to = nxt[state].get(c)
            while to is None and state:
                state = link[state]
                run = length[state]
                to = nxt[state].get(c)
            if to is None:
                continue
            state = to
            run += 1
            yield end, state, run

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Merged spans [start, end) of words inside windows, and the numbers of the items that have them."""
        n, least = len(words), min(self.window, self.shortest)
        if not self.items or n < least:
            return [], set()
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, n)
        known = ids >= 0
        if least > 1:  # a run of an item needs its neighbouring words in pairs that items have
            known = known[:-1] & known[1:] & self.pairs[self._pair(ids[:-1], ids[1:])]
        edges = np.flatnonzero(np.diff(np.concatenate([[0], known.view(np.int8), [0]]))).reshape(-1, 2)
        edges[:, 1] += least > 1
        spans: list[list[int]] = []
        items: set[int] = set()
        for lo, hi in edges[edges[:, 1] - edges[:, 0] >= least]:
            for end, state, run in self.stream(ids[lo:hi].tolist()):
                covered = 0
                if run >= self.window:
                    covered = run
                    items |= self.found.get(self.cut(state), set())
                at = self.marked[state]
                if at == state and self.whole[at][0] > run:
                    at = self.marked[self.link[at]]
                while at > 0:
                    size, numbers = self.whole[at]
                    covered = max(covered, size)
                    items.update(numbers)
                    at = self.marked[self.link[at]]
                if covered:
                    stop = int(lo) + end + 1
                    start = stop - covered
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append([start, stop])
        return [tuple(s) for s in spans], items


def build(items, window: int) -> SuffixAutomaton:
    """The automaton over (item_id, text) pairs."""
    out = SuffixAutomaton(window)
    for item, text in items:
        out.add(item, words_of(text))
    return out.finish()


HITS = "doc_id long, n_words long, spans array<struct<start:long,end:long>>, items array<string>"
_SPANS = "array<struct<start:long,end:long>>"
_HIT_TYPES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.string())


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans of which none touch."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and out[-1][1] >= a:
            a, b = out[-1][0], max(b, out.pop()[1])
        out.append((a, b))
    return out


def matched(docs: DataFrame, benchmark: DataFrame, window: int, judge, schema) -> DataFrame:
    """judge(batch, place of text, word counts, spans, items) of each batch of docs, with what the items' automaton found in each row.

    Items of up to AUTOMATON_CHARS make one automaton, which is broadcast; more are dealt to several (``matched_in_shards``)."""
    small_batches(docs.sparkSession)
    items = benchmark.select(F.col("item_id"), "text").where("text is not null and item_id is not null")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    if size > AUTOMATON_CHARS:
        return matched_in_shards(docs, items, size, window, judge, schema)
    at = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(build(items.toLocalIterator(), window))

    def run(batches):
        automaton = shared.value
        for batch in batches:
            n, spans, found = [], [], []
            for text in batch.column(at):
                words = words_of(text.as_py())
                s, i = automaton.match(words)
                n.append(len(words))
                spans.append(s)
                found.append({str(automaton.items[k][0]) for k in i})
            yield judge(batch, at, n, spans, found)

    return docs.mapInArrow(run, schema)


def window_hashes(texts: pa.Array, lengths: list[int]):
    """(text number, hash) of the runs of each of these lengths of words, for all texts at once."""
    hashes, _, _, first = hashed_words(texts, lower=True, is_word=_IS_WORD)
    for n in lengths:
        found = shingle_hashes(hashes, n)
        row = np.searchsorted(first, np.arange(len(found)), "right") - 1
        whole = np.arange(len(found)) + n <= first[row + 1]
        yield n, row[whole], found[whole]


def item_windows(texts: pa.Array, window: int) -> list[np.ndarray]:
    """The hashes of each item's windows; an item shorter than a window is one as a whole."""
    hashes, _, _, first = hashed_words(texts, lower=True, is_word=_IS_WORD)
    return [shingle_hashes(hashes[a:b], min(window, int(b - a))) if b > a else hashes[:0] for a, b in zip(first[:-1], first[1:])]


def matched_in_shards(docs: DataFrame, items: DataFrame, size: int, window: int, judge, schema) -> DataFrame:
    """As ``matched``, for items beyond one automaton. Documents are read twice, however many shards there are:

    1. a bitmap of the hashes of all items' windows, of bounded size, is broadcast; documents without a window in it
       are judged at once (first reading), the others are written with a row number and their hits (second reading);
    2. a candidate's hits say which shards have its windows; it goes to those, where tasks build the shard's
       automaton from its items and match whole texts; a shard with many candidates is dealt to several tasks;
    3. what a row's shards found is united and judged once, on the text as it was."""
    spark, names, at = docs.sparkSession, {c.lower() for c in docs.columns}, docs.columns.index("text")
    n_col, hit_col, row_col, span_col, item_col = (_free(x, names) for x in ("n", "hits", "number", "spans", "items"))
    shards = -(-size // AUTOMATON_CHARS)
    held = stored(items.select(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)).cast("int").alias("shard"), F.col("item_id").cast("string").alias("item"), "text"))

    def shard_windows(batches):
        for batch in batches:
            found = item_windows(texts_of(batch.column(2)), window)
            shard = np.repeat(batch.column(0).to_numpy(), [len(x) for x in found])
            size = pa.array(np.repeat([min(window, len(words_of(t.as_py()))) for t in batch.column(2)], [len(x) for x in found]), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(shard, pa.int32()), size], ["hash", "shard", "words"])

    windows = stored(held.mapInArrow(shard_windows, "hash long, shard int, words int").distinct())
    lengths = sorted(r[0] for r in windows.select("words").distinct().collect())  # at most window different ones
    bits = min(MOST_BITS, max(64, 1 << (8 * size).bit_length()))
    bitmap = bitmap_of(windows, "hash", bits)
    shared = spark.sparkContext.broadcast(bitmap)

    def flag(batches):
        bitmap = shared.value
        for batch in batches:
            texts = texts_of(batch.column(at))
            for lo, hi in row_slices(texts):
                part = texts.slice(lo, hi - lo)
                first = hashed_words(part, lower=True, is_word=_IS_WORD)[3]
                rows, hits = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
                for _, row, found in window_hashes(part, lengths):
                    hit = in_bitmap(bitmap, found)
                    rows.append(row[hit])
                    hits.append(found[hit])
                row, hit = np.concatenate(rows), np.concatenate(hits).view(np.int64)
                order = np.argsort(row, kind="stable")
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=hi - lo))]).astype(np.int32)
                own = batch.slice(lo, hi - lo)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(hit[order]))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(np.diff(first), pa.int64()), lists], [*own.schema.names, n_col, hit_col])

    flagged = docs.mapInArrow(flag, T.StructType([*docs.schema.fields, T.StructField(n_col, T.LongType()), T.StructField(hit_col, T.ArrayType(T.LongType()))]))
    width = len(docs.columns)

    def judged(batches):
        for batch in batches:
            own, n = batch.select(list(range(width))), batch.column(width).to_pylist()
            if batch.num_columns > width + 2:
                spans = [united([(x["start"], x["end"]) for x in s or ()]) for s in batch.column(width + 2).to_pylist()]
                found = [set(i or ()) for i in batch.column(width + 3).to_pylist()]
            else:
                spans, found = [[] for _ in n], [set() for _ in n]
            yield judge(own, at, n, spans, found)

    clean = flagged.where(F.size(hit_col) == 0).mapInArrow(judged, schema)
    wanted = stored(flagged.where(F.size(hit_col) > 0).withColumn(row_col, F.monotonically_increasing_id()))
    asked = wanted.select(F.col(row_col).alias("row"), F.explode(F.array_distinct(hit_col)).alias("hash")).join(windows.select("hash", "shard"), "hash").select("row", "shard").distinct()
    asked = stored(asked)
    parts = asked.groupBy("shard").agg(F.ceil(F.count("*") / TASK_DOCUMENTS).cast("int").alias("parts"))
    dealt = asked.join(parts, "shard").select("row", "shard", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int").alias("part"))
    sent = dealt.join(wanted.select(F.col(row_col).alias("row"), F.col("text")), "row").select("shard", "part", F.lit(1).alias("kind"), "row", F.lit(None).cast("string").alias("item"), "text")
    known = held.join(parts, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("row"), "item", "text")
    rows = known.union(sent).repartition("shard", "part").sortWithinPartitions("shard", "part", "kind")

    def locate(batches):
        now, items, automaton = None, [], None
        for batch in batches:
            out: list[list] = [[], [], []]
            for shard, part, kind, row, item, text in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if (shard, part) != now:
                    now, items, automaton = (shard, part), [], None
                if kind == 0:
                    items.append((item, text))
                    continue
                if automaton is None:
                    automaton, items = build(items, window), []
                spans, found = automaton.match(words_of(text))
                if spans:
                    for col, v in zip(out, (row, spans, {automaton.items[k][0] for k in found})):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *arrow_hits(out[1], out[2])], ["row", "spans", "items"])

    located = rows.mapInArrow(locate, f"row long, spans {_SPANS}, items array<string>")
    united_rows = located.groupBy("row").agg(F.flatten(F.collect_list("spans")).alias(span_col), F.flatten(F.collect_list("items")).alias(item_col))
    whole = wanted.join(united_rows.withColumnRenamed("row", row_col), row_col, "left").select(*docs.columns, n_col, hit_col, span_col, item_col)
    return clean.union(whole.mapInArrow(judged, schema))


def _free(name: str, taken: set[str]) -> str:
    while name.lower() in taken:
        name = "_" + name
    return name


def arrow_hits(spans: list, items: list) -> list[pa.Array]:
    return [pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], _HIT_TYPES[0]), pa.array([sorted(i) for i in items], _HIT_TYPES[1])]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, spans (in words, merged), items (sorted ids as strings) for each row of docs.

    Null and empty texts have no words; whole texts of any length are read. Items without words, and with a null
    id, are none; items with equal texts all count. Each row is judged on its own, so repeated rows and rows with
    null or shared ids are all returned. Empty tables give an empty one, or documents without hits; other columns
    are ignored, whatever their names.
    """

    def judge(batch, at, n, spans, items):
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *arrow_hits(spans, items)], ["doc_id", "n_words", "spans", "items"])

    return matched(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, window, judge, HITS)


def digest_contamination(found: DataFrame) -> DataFrame:
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.0, max_span: int | None = None) -> DataFrame:
    """docs without what the benchmark holds: a document goes if more than max_coverage of its words are
    inside windows or one span is longer than max_span words; from the others the spans are cut, the rest of
    the text staying as it is. All columns are kept, whatever their names. With the default limits a contaminated
    document goes. Rows are judged on their own whole text: null and empty ones stay, repeated ones share their fate,
    null and shared ids don't matter. An empty table gives an empty one, an empty benchmark all rows.
    """

    def judge(batch, at, n, spans, items):
        keep, left = [], []
        for text, size, found in zip(batch.column(at).to_pylist(), n, spans):
            hit = sum(b - a for a, b in found)
            go = hit > max_coverage * size or max_span is not None and any(b - a > max_span for a, b in found)
            keep.append(not (hit and go))
            left.append(cut_words(text, found) if hit and not go else text)
        return batch.set_column(at, "text", pa.array(left, pa.string())).filter(pa.array(keep, pa.bool_()))

    return matched(docs, benchmark, window, judge, docs.schema)


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the bytes from the first to the last word of each span."""
    raw = text.encode("utf-8", "surrogatepass")
    plain = raw.translate(_WORDS)
    starts, ends, at = [], [], 0
    for w in plain.split():
        at = plain.index(w, at)
        starts.append(at)
        at += len(w)
        ends.append(at)
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : starts[a]])
        at = ends[b - 1]
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def digest_items(items) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
