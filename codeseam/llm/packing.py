"""Best-fit packing of tokenised documents under several capacities.

A bin has residual tokens, documents and attention cost (the sum of squared lengths). An item goes to the
bin, among those that can take it in every dimension, with the largest weighted dot product of demand and
residual, or the smallest residual norm after placing. Items are dealt by a checksum of (document, piece)
into blocks of about BLOCK_TOKENS, so packing runs in as many bounded tasks as the corpus needs; each block
leaves at most about one part-filled bin.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, row_slices, small_batches, stored, texts_of

CAPACITY, END_ID = 4096, 1
BLOCK_TOKENS = 16_000_000
#: Size of a generation of remembered words, of which a worker holds two (about 20 MB each).
CACHE_WORDS = 100_000
#: Characters of text that are looked up at once, and bytes of ids that go into one batch.
SLICE, OUT_BYTES = 1_000_000, 8_000_000
#: Characters for which Python's and the library's normalisation, lower-casing and classes agree
#: (one code point stays one code point; checked by tests): ASCII, Latin-1 letters and Latin Extended-A but for dotted and dotless I.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\u00a1-\u00ac\u00ae-\u00b1\u00b4\u00b6\u00b7\u00bb\u00bf-\u012f\u0132-\u0148\u014a-\u017e\u2010-\u2027\u2030-\u205e\u20ac]*")
#: What the file of a tokenizer says whose words can be looked up one by one, and its split for lower-cased plain text.
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
#: The characters that stand for bytes in byte-level tokenizers: printable ones for themselves, others from 256 on.
_SELF = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or 174 <= c]
_BYTE_CHARS = {c: c for c in _SELF} | {c: 256 + k for k, c in enumerate(sorted(set(range(256)) - set(_SELF)))}


def by_words(tokenizer) -> bool:
    """Whether ids of plain text are those of its words, one by one: a byte-level BPE over lower-cased words and marks."""
    told = json.loads(tokenizer.to_str())
    normal, split, model = (told.get(k) or {} for k in ("normalizer", "pre_tokenizer", "model"))
    cut = {"type": "Split", "pattern": {"Regex": _PATTERN}, "behavior": "Removed", "invert": True}
    rest = [x for x in split.get("pretokenizers", []) if x != cut]
    return (
        normal.get("normalizers") == _NORMAL and cut in split.get("pretokenizers", []) and [x.get("type") for x in rest] == ["ByteLevel"]
        and not rest[0]["add_prefix_space"] and not rest[0]["use_regex"] and model.get("type") == "BPE" and not model.get("dropout")
        and not model.get("ignore_merges") and not any(told.get(k) for k in ("post_processor", "truncation", "padding"))
    )


class WordIds:
    """ids of texts as little-endian unsigned 32-bit bytes; those of words are remembered in two generations of bounded size.

    White space always separates words of the split, and words don't affect each other's ids, so what lies between
    white space can be looked up as a whole. Texts with other characters or with the string of a special token, and
    all texts of a tokenizer that works otherwise, go through the library whole."""

    def __init__(self, tokenizer):
        self.tokenizer, self.young, self.old = tokenizer, {}, {}
        self.model = tokenizer.model if by_words(tokenizer) else None
        added = [x.content.lower() for x in tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added)) or "(?!)")
        self.raw = [i.to_bytes(4, "little") for i in range(max(tokenizer.get_vocab().values()) + 1)]

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.young) > CACHE_WORDS:
            self.young, self.old = {}, self.young
        chunks = [self.chunks(t) for t in texts]
        self.learn(set().union(*(c for c in chunks if c)).difference(self.young))
        get = self.young.__getitem__
        return [self.whole(t) if c is None else b"".join(map(get, c)) for t, c in zip(texts, chunks)]

    def chunks(self, text: str) -> list[str] | None:
        if self.model and _PLAIN.fullmatch(text):
            low = text.lower()
            if not self.special.search(low):
                return low.split()
        return None

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, chunks: set[str]) -> None:
        young, old = self.young, self.old
        for c in chunks:
            known = old.get(c)
            if known is None:
                known = self.word(c) if c.isalpha() else b"".join([young.get(w) or self.part(w) for w in _SPLIT.findall(c)])
            young[c] = known

    def part(self, word: str) -> bytes:
        out = self.young[word] = self.old.get(word) or self.word(word)
        return out

    def word(self, word: str) -> bytes:
        chars = word if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_CHARS)
        raw = self.raw
        return b"".join([raw[t.id] for t in self.model.tokenize(chars)])


def load_tokenizer(path: str, control_as_text: bool = False):
    """control_as_text: strings of special tokens in a document are ordinary text (by default the library's rule holds)."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.encode_special_tokens = control_as_text
    return out


#: The words of this worker's process, by tokenizer: tasks that follow each other go on with them.
_HELD: dict[tuple, WordIds] = {}


def held_words(path: str, control_as_text: bool = False) -> WordIds:
    if (path, control_as_text) not in _HELD:
        _HELD.clear()
        _HELD[path, control_as_text] = WordIds(load_tokenizer(path, control_as_text))
    return _HELD[path, control_as_text]


def pieces_of(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, control_as_text: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian unsigned 32-bit): documents of more than capacity
    ids are cut. Null text is empty: its only id is end_id."""

    def run(batches):
        words = held_words(tokenizer_path, control_as_text)
        tail = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), batch.column(1)
            rows: list[list] = [[], [], [], [], []]
            size = 0
            for lo, hi in row_slices(texts_of(texts), SLICE):
                for d, raw in zip(docs[lo:hi], words.encode([t or "" for t in texts.slice(lo, hi - lo).to_pylist()])):
                    raw += tail
                    for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                        cut = raw[at : at + 4 * capacity]
                        for col, v in zip(rows, (d, k, at // 4, len(cut) // 4, cut)):
                            col.append(v)
                    size += len(raw)
                    if size > OUT_BYTES:
                        yield _pieces(*rows)
                        rows, size = [[], [], [], [], []], 0
            yield _pieces(*rows)

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


def _pieces(doc, piece, start, length, ids):
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "piece", "start", "length", "ids"])


def vector_best_fit(lengths: np.ndarray, capacity: int, max_docs: int, max_cost: int, rule: str = "norm", weights=(1.0, 1e-3, 1e-3)) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; items are taken by decreasing length.

    Bins with equal residuals are interchangeable, so they are kept as stacks under their residual vector.
    The search goes over residual token counts (from the tightest for the norm, from the loosest for the
    dot product) and stops where the token term alone can't give a better score; scores are relative to
    the capacities, and the first state found wins ties.
    """
    order = np.argsort(-lengths, kind="stable")
    out, offset = np.full(len(lengths), -1, np.int64), np.zeros(len(lengths), np.int64)
    states: list[dict] = [{} for _ in range(capacity + 1)]  # residual tokens -> (docs, cost) -> bins
    filled = np.zeros(capacity + 1, bool)
    w = (np.asarray(weights) / np.array([capacity, max_docs, max_cost], float) ** 2).tolist()
    bins = 0
    for item in order:
        n = int(lengths[item])
        cost_n = n * n
        best, score = None, None
        room = np.flatnonzero(filled[n:]) + n
        for tokens in room if rule == "norm" else room[::-1]:
            tokens = int(tokens)
            bound = -w[0] * (tokens - n) ** 2 if rule == "norm" else w[0] * n * tokens + w[1] * max_docs + w[2] * cost_n * max_cost
            if score is not None and bound <= score:
                break
            for docs, cost in states[tokens]:
                if docs >= 1 and cost >= cost_n:
                    s = bound - w[1] * (docs - 1) ** 2 - w[2] * (cost - cost_n) ** 2 if rule == "norm" else w[0] * n * tokens + w[1] * docs + w[2] * cost_n * cost
                    if score is None or s > score:
                        best, score = (tokens, docs, cost), s
        if best is None:
            best, b = (capacity, max_docs, max_cost), bins
            bins += 1
        else:
            stack = states[best[0]][best[1:]]
            b = stack.pop()
            if not stack:
                del states[best[0]][best[1:]]
                filled[best[0]] = bool(states[best[0]])
        out[item], offset[item] = b, capacity - best[0]
        left = (best[0] - n, best[1] - 1, best[2] - cost_n)
        if left[0] > 0 and left[1] > 0:
            states[left[0]].setdefault(left[1:], []).append(b)
            filled[left[0]] = True
    return out, offset


def pack(pieces: DataFrame, capacity: int = CAPACITY, max_docs: int | None = None, max_cost: int | None = None, rule: str = "norm", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """pieces with sequence_id and offset: every piece in exactly one sequence, gapless from 0.

    max_docs and max_cost bound the documents and the summed squared lengths of a sequence (default: what
    the token capacity allows anyway, so that they only rank bins). A piece that no sequence can take, for its
    length or its cost, is an error. Ties go by doc_id and piece; repeated rows are packed each on their own; an
    empty table gives an empty one.
    """
    max_docs, max_cost = max_docs or capacity, max_cost or capacity * capacity
    total, longest = pieces.agg(F.coalesce(F.sum("length"), F.lit(0)), F.coalesce(F.max("length"), F.lit(0))).first()
    if longest > capacity or longest * longest > max_cost:
        raise ValueError(f"a piece of {longest} tokens is beyond the capacity of {capacity} tokens or the cost of {max_cost}")
    blocks = max(1, round(total / block_tokens))
    names = pieces.columns
    key = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks)).cast("int")
    rows = pieces.withColumn("__block", key).repartition("__block").sortWithinPartitions("__block", F.desc("length"), "doc_id", "piece")
    at_length, at_block = names.index("length"), len(names)

    def run(batches):
        def done(block, held):
            t = pa.Table.from_batches(held)
            seq, offset = vector_best_fit(t.column(at_length).to_numpy(), capacity, max_docs, max_cost, rule)
            t = t.select(names).append_column("sequence_id", pa.array(seq + (int(block) << 40))).append_column("offset", pa.array(offset))
            yield from t.combine_chunks().to_batches(max_chunksize=20_000)

        at, held = None, []
        for batch in batches:
            block = batch.column(at_block).to_numpy()
            if not len(block):
                continue
            cuts = np.r_[0, np.flatnonzero(block[1:] != block[:-1]) + 1, len(block)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if at is not None and block[lo] != at:
                    yield from done(at, held)
                    held = []
                at = block[lo]
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from done(at, held)

    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long"
    return rows.mapInArrow(run, schema)


def best_fit_packing(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, control_as_text: bool = False, **limits) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of docs.

    Every row of docs gives at least one piece (null text: empty; null doc_ids stay null; repeated rows are packed
    each on their own); texts may be of any length; an empty table gives an empty one; other columns are ignored,
    whatever their names. Only narrow rows are packed: the pieces' ids stay with the documents."""
    pieces = pieces_of(docs, tokenizer_path, capacity, end_id, control_as_text).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    held = stored(pieces)
    out = stored(pack(held, capacity, **limits))
    drop_stored(held)
    return out


def materialise(pieces: DataFrame, packed: DataFrame) -> DataFrame:
    """sequence_id, ids: the packed sequences themselves, each of at most capacity ids."""
    placed = pieces.join(packed.select("doc_id", "piece", "sequence_id", "offset"), ["doc_id", "piece"])
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return placed.groupBy("sequence_id").agg(joined.alias("ids"))
