"""Cross-tokenizer alignment by elementary intervals.

Two tokenizers cut the same bytes. The union of both end arrays cuts them into elementary intervals; searchsorted
gives each interval's owner on either side, and an interval is one overlap of its owners. Where both end together a
group closes: the smallest stretches that both tokenizers cover with whole tokens. ``group_products`` expands
groups to all pairs of their tokens, for uses that need more than overlaps.

Texts are encoded once, into a table of each document's id pairs with their numbers. How many documents hold a pair is
summed up in tasks before anything moves. The counts of the most frequent pairs, a table of bounded size, go to every
worker; pairs beyond it are looked up by a join, which has no frequent keys left.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, row_slices, small_batches, some, stored, texts_of

#: Pairs whose counts go to every worker (13 bytes each), and pairs that a task sums up before it passes them on.
HELD_PAIRS, TASK_PAIRS = 4_000_000, 1_000_000
#: Size of a generation of remembered words, of which a worker holds two (about 30 MB each).
CACHE_WORDS = 100_000
#: Bytes of text encoded at once.
SLICE = 1 << 19
#: Fixed value: the split of byte-level tokenizers.
BYTE_LEVEL = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from 256 on.
_SELF = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or 174 <= c]
_BYTE_OF = {chr(c): c for c in _SELF} | {chr(256 + k): c for k, c in enumerate(sorted(set(range(256)) - set(_SELF)))}


class Pieces:
    """The bytes of a vocabulary's tokens."""

    def __init__(self, tokens: list[bytes]):
        self.tokens, self.sizes = tokens, np.array([len(t) for t in tokens], np.int64)

    def ends(self, ids: np.ndarray) -> np.ndarray:
        return np.cumsum(self.sizes[ids])


class ByteBpe:
    """A byte-level BPE file; ids of " " + text. Strings of special tokens are ordinary text.

    Where ids follow the order of merges, as in byte-level files of the usual kind, the ranks alone give the same ids
    much faster (tests compare them); other files go through their own library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        vocab = self.whole.get_vocab(with_added_tokens=False)
        tokens = [b""] * (max(self.whole.get_vocab().values()) + 1)
        for t, i in vocab.items():
            tokens[i] = bytes(_BYTE_OF[c] for c in t) if all(c in _BYTE_OF for c in t) else t.encode()
        self.pieces = Pieces(tokens)
        self.ranked = self._ranked(path, vocab)

    def _ranked(self, path: str, vocab: dict[str, int]):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        split, model = told.get("pre_tokenizer") or {}, told["model"]
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not told.get("normalizer")
        merged = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model.get("merges", [])]
        if not plain or model.get("type") != "BPE" or model.get("dropout") or model.get("ignore_merges") or None in merged or merged != sorted(merged) or set(_BYTE_OF) - set(vocab):
            return None
        special = {x.content for x in self.whole.get_added_tokens_decoder().values()}
        import tiktoken

        ranks = {bytes(_BYTE_OF[c] for c in t): i for t, i in vocab.items() if t not in special}
        return tiktoken.Encoding("ranked", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        spaced = [" " + t for t in texts]
        if self.ranked:
            return [self.ranked.encode_ordinary(t) for t in spaced]
        return [self.whole.encode(t, add_special_tokens=False).ids for t in spaced]


class PieceBpe:
    """A sentencepiece model, which itself puts a space before a text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        self.pieces = Pieces([bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)])
        self.cuts_at_blanks = not any("▁" in n[1:] and n.strip("▁") for n in names)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@dataclass
class Alignment:
    """a, b: ids. owner_a, owner_b: the tokens of each elementary interval. closes_a, closes_b: whether a token ends a group."""

    a: np.ndarray
    b: np.ndarray
    owner_a: np.ndarray
    owner_b: np.ndarray
    closes_a: np.ndarray
    closes_b: np.ndarray


def align(a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> Alignment:
    """ends: byte ends of tokens of at least one byte, both over the same bytes."""
    cuts = np.union1d(ends_a, ends_b)
    owner_a, owner_b = np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts)
    both = (ends_a[owner_a] == cuts) & (ends_b[owner_b] == cuts)
    closes_a, closes_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    closes_a[owner_a[both]] = True
    closes_b[owner_b[both]] = True
    return Alignment(a, b, owner_a, owner_b, closes_a, closes_b)


def group_products(x: Alignment) -> tuple[np.ndarray, np.ndarray]:
    """Tokens (places in a and in b) of all pairs within a group, group by group."""
    first_a, first_b = (np.concatenate([[0], np.flatnonzero(c) + 1]) for c in (x.closes_a, x.closes_b))
    n_a, n_b = np.diff(first_a), np.diff(first_b)
    of_a = np.repeat(np.arange(len(x.a)), np.repeat(n_b, n_a))
    size = n_a * n_b
    within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return of_a, np.repeat(first_b[:-1], size) + within % np.repeat(n_b, size)


class GroupText:
    """Groups as text: ids of both sides in order, ``a1,a2|b1;a3|b2,b3``."""

    def __init__(self, n_a: int, n_b: int):
        self.n = max(n_a, n_b)
        self.told = [f"{i}{sep}".encode() for sep in ",|;" for i in range(self.n)]

    def pieces(self, x: Alignment) -> list[bytes]:
        """Each token's id and the mark behind it, in the order of the text."""
        ends_a, ends_b = (np.concatenate([[0], np.flatnonzero(c) + 1]) for c in (x.closes_a, x.closes_b))
        group_a, group_b = (np.cumsum(c) - c for c in (x.closes_a, x.closes_b))
        out = np.empty(len(x.a) + len(x.b), np.int64)
        out[np.arange(len(x.a)) + ends_b[group_a]] = x.a + self.n * x.closes_a
        out[np.arange(len(x.b)) + ends_a[group_b + 1]] = x.b + 2 * self.n * x.closes_b
        return list(map(self.told.__getitem__, out.tolist()))


class Aligner:
    """Both tokenizers of a worker's process, and what it has learned of words, in two generations of bounded size.

    In a text without neighbouring, leading or trailing white space both tokenizers cut before each blank (no piece of
    the second holds a blank behind its first byte, but for runs of blanks), so a text's tokens, groups and overlaps are those of its words, one by
    one. Other texts, and those with a word that isn't given back byte by byte, are aligned whole."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteBpe(path_a), PieceBpe(path_b)
        self.told = GroupText(len(self.a.pieces.sizes), len(self.b.pieces.sizes))
        self.by_words = bool(self.a.ranked) and self.b.cuts_at_blanks
        self.young: dict[str, tuple | None] = {}
        self.old: dict[str, tuple | None] = {}

    def texts(self, texts: list[str]) -> list[tuple]:
        """n_a, n_b, n_groups, n_links, hash of the groups, pairs, times of each text."""
        words = [t.split(" ") if self.by_words and t and self.apart(t) else None for t in texts]
        if len(self.young) > CACHE_WORDS:
            self.young, self.old = {}, self.young
        self.learn(list(set().union(*(w for w in words if w)).difference(self.young)))
        return [self.text(t, w) for t, w in zip(texts, words)]

    def apart(self, text: str) -> bool:
        return text.replace("\n", " ") == " ".join(text.split()) or not _GAPS.search(text)

    def text(self, text: str, words: list[str] | None) -> tuple:
        if not text:
            return NONE
        parts = list(map(self.young.__getitem__, words)) if words else [None]
        if None in parts:
            parts = [self.part(text)]
            if parts[0] is None:
                return NONE
        told = b";".join([p[2] for p in parts])
        n_a, n_groups = sum([p[0] for p in parts]), told.count(b"|")
        raw = b"".join([p[1] for p in parts])
        pairs, times = np.unique(np.frombuffer(raw, "<i8"), return_counts=True)
        n_b = told.count(b",") + 2 * n_groups - n_a  # a mark stands behind each token but the last
        return n_a, n_b, n_groups, len(raw) // 8, hashlib.sha256(told).hexdigest(), pairs.tobytes(), times.astype("<u4").tobytes()

    def learn(self, words: list[str]) -> None:
        new = []
        for w in words:
            if w in self.old:
                self.young[w] = self.old[w]
            else:
                new.append(w)
        if not new:
            return
        found = self.cut(new)
        self.young.update(zip(new, found or map(self.part, new)))

    def part(self, text: str) -> tuple | None:
        found = self.cut([text])
        return found[0] if found else None

    def cut(self, words: list[str]) -> list[tuple] | None:
        """The alignment of words, as if they were one text: of each word n_a, the bytes of its overlaps' pairs and its groups'
        text. None where a tokenizer doesn't give them back."""
        text = " ".join(words)
        raw = b" " + text.encode()
        (left,), by_word = self.a.encode([text]), self.b.encode(words)
        right = list(chain.from_iterable(by_word))
        if not b"".join(map(self.a.pieces.tokens.__getitem__, left)) == raw == b"".join(map(self.b.pieces.tokens.__getitem__, right)):
            return None
        a, b = np.array(left, np.int64), np.array(right, np.int64)
        ends_a, ends_b = self.a.pieces.ends(a), self.b.pieces.ends(b)
        x = align(a, b, ends_a, ends_b)
        upto_b = np.cumsum(list(map(len, by_word)))
        upto_a = np.searchsorted(ends_a, ends_b[upto_b - 1]) + 1
        upto = np.searchsorted(x.owner_a, upto_a)
        pairs = (a[x.owner_a] << 32 | b[x.owner_b]).astype("<i8").tobytes()
        told, out, link, token = self.told.pieces(x), [], 0, 0
        for n, to_link, to_token in zip(np.diff(upto_a, prepend=0).tolist(), upto.tolist(), (upto_a + upto_b).tolist()):
            out.append((n, pairs[8 * link : 8 * to_link], b"".join(told[token:to_token])[:-1]))
            link, token = to_link, to_token
        return out


#: A text without tokens.
NONE = (0, 0, 0, 0, "", b"", b"")
#: White space by which words depend on each other.
_GAPS = re.compile(r"^\s|\s\s|\s$")
#: The tokenizers of this worker's process.
_HELD: dict[tuple, Aligner] = {}


def held_aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _HELD:
        _HELD.clear()
        _HELD[path_a, path_b] = Aligner(path_a, path_b)
    return _HELD[path_a, path_b]


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"


def aligned(docs: DataFrame, path_a: str, path_b: str, text_col: str = "text") -> DataFrame:
    """ALIGNED, one row for each row of docs. pairs: the distinct id pairs that overlap, as sorted 64-bit numbers
    (a << 32 | b), zero for none; times: how often each does, 32-bit.

    Texts that are null, empty, or that either tokenizer doesn't give back byte by byte have no tokens. Texts of any
    length are encoded whole, in one worker's memory."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        aligner = held_aligner(path_a, path_b)
        for batch in batches:
            ids, texts = batch.column(0), texts_of(batch.column(1))
            for lo, hi in row_slices(texts, SLICE):
                told = aligner.texts(texts.slice(lo, hi - lo).to_pylist())
                columns = [pa.array(c, t) for c, t in zip(zip(*told), [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary()])]
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), *columns], [x.split()[0] for x in ALIGNED.split(", ")])

    return rows.mapInArrow(run, ALIGNED)


def _added(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    pairs, where = np.unique(np.concatenate(codes), return_inverse=True)
    return pairs, np.bincount(where, np.concatenate(counts), len(pairs)).astype(np.int64)


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, n, best: in how many rows of ALIGNED each pair is, and whether no pair of its first id is in more."""

    def run(batches):
        codes, counts, size = [], [], 0
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                if raw:
                    codes.append(np.frombuffer(raw, "<i8"))
                    counts.append(np.ones(len(codes[-1]), np.int64))
                    size += len(codes[-1])
                if size > 2 * TASK_PAIRS:
                    codes, counts = ([x] for x in _added(codes, counts))
                    size = len(codes[0])
                    if size > TASK_PAIRS:
                        yield pa.RecordBatch.from_arrays([pa.array(codes[0]), pa.array(counts[0])], ["pair", "k"])
                        codes, counts, size = [], [], 0
        if codes:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _added(codes, counts)], ["pair", "k"])

    counts = stored(rows.select("pairs").mapInArrow(run, "pair long, k long").groupBy("pair").agg(F.sum("k").alias("n")))
    most = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("most"))
    out = stored(counts.join(most, F.shiftright("pair", 32) == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best")))
    drop_stored(counts)
    return out


def _least_held(counts: DataFrame, most: int) -> int:
    """The least count of pairs that all workers hold: at most ``most`` pairs have it or more."""
    by_size = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("size")).agg(F.count("*").alias("k")).collect()  # 63 rows at most
    total, least = 0, 1
    for size, k in sorted(map(tuple, by_size), reverse=True):
        total += k
        if total > most:
            least = 2 ** (size + 1)
            break
    return least


SUMMED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, rest array<struct<pair:long,times:long>>"


def cross_tokenizer_alignment(docs: DataFrame, path_a: str, path_b: str, text_col: str = "text", held_pairs: int = HELD_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, one row for each row of docs.

    A pair's count is the number of rows that hold it; repeated rows count each for itself. Null doc_ids stay null,
    texts without tokens (see aligned) have zeros and an empty hash, other columns are ignored, an empty table gives an
    empty one."""
    spark = docs.sparkSession
    rows = stored(aligned(docs, path_a, path_b, text_col).withColumn("row", F.monotonically_increasing_id()))
    counts = pair_counts(rows)
    least = _least_held(counts, held_pairs)
    told = counts.where(F.col("n") >= least).toPandas().sort_values("pair")
    held = spark.sparkContext.broadcast((told["pair"].to_numpy(np.int64), told["n"].to_numpy(np.int64), told["best"].to_numpy(bool)))
    names = [x.split()[0] for x in SUMMED.split(", ")]
    of_rest = pa.list_(pa.struct([("pair", pa.int64()), ("times", pa.int64())]))

    def run(batches):
        pairs, n, best = held.value
        for batch in batches:
            found, links = [], []
            for raw, much in zip(batch.column("pairs").to_pylist(), batch.column("times").to_pylist()):
                codes, times = np.frombuffer(raw, "<i8"), np.frombuffer(much, "<u4").astype(np.int64)
                at = np.searchsorted(pairs, codes)
                known = at < len(pairs)
                known[known] = pairs[at[known]] == codes[known]
                at, t = at[known], times[known]
                found.append((int(t[best[at]].sum()), int((t * n[at]).sum())))
                links.append([{"pair": p, "times": k} for p, k in zip(codes[~known].tolist(), times[~known].tolist())])
            kept = [batch.column(c) for c in names[:7]]
            sums = [pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*kept, *sums, pa.array(links, of_rest)], names)

    out = rows.select(*names[:7], "pairs", "times").mapInArrow(run, SUMMED)
    if least > 1 and some(counts.where(F.col("n") < least)):
        out = stored(out)
        rare = out.select("row", F.explode("rest").alias("r")).select("row", F.col("r.pair").alias("pair"), F.col("r.times").alias("times"))
        more = rare.join(counts.where(F.col("n") < least), "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
        zero = F.lit(0).cast("long")
        out = out.join(more, "row", "left").withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", zero), "count_sum": F.col("count_sum") + F.coalesce("more_sum", zero)})
    else:
        drop_stored(counts)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
