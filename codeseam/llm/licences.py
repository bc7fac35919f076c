"""Licence scans by conditional compression.

Candidate blocks of a text (around words that licence notices use) are compressed by zstandard with each
template as a raw dictionary; templates are tried from the largest saving on, relative to compressing without one,
and the first whose wording is confirmed wins: the block's words are aligned with the template's and their exact differences counted.
Blocks are cut at a bound, with overlaps longer than any wording, so a text full of such words takes bounded steps.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import groupby

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .licence_texts import TEMPLATES

#: Words that notices use and other texts seldom do: preferred as trigger words.
_TELLING = re.compile(r"licen[sc]e|copyright|permission|redistribut|reserved|domain|foundation")
_WORD = re.compile(r"[A-Za-z0-9]+(?:[.\-/][A-Za-z0-9]+)*")
_YEAR = re.compile(r"(?:19|20)\d\d(?:[-/](?:19|20)?\d\d)*")
#: What follows the tag of an SPDX line: identifiers joined by operators.
_SPDX = re.compile(r":?[ \t]*(\(*[A-Za-z0-9.+:-]*[A-Za-z0-9+]\)*(?:[ \t]+(?:AND|OR|WITH)[ \t]+\(*[A-Za-z0-9.+:-]*[A-Za-z0-9+]\)*)*)")
#: Characters of a block around a trigger word, at least; and where a long block is cut.
REACH, CUT = 240, 8_000
MIN_SAVING, MAX_DIFFERENCES = 0.25, 0.15


def wanted_words(wording: str) -> list[str]:
    """The words of a template; <year> stands for any year or range of years."""
    return re.findall(rf"<year>|{_WORD.pattern}", wording.lower())


def allowed(words: int, max_differences: float) -> int:
    """How many words of a wording may differ: a share of them."""
    return int(max_differences * words)


def reaches(templates: dict[str, str], max_differences: float = MAX_DIFFERENCES) -> dict[str, int]:
    """Trigger words, and how far a wording may reach around each: every text with a wording near a template has a
    word that begins with one of them. Of each template they count one more than may differ, so one is always left;
    few words that many templates use are preferred, and words that notices use and other texts seldom do."""
    counts, need, out = {}, {}, {}
    for name, wording in templates.items():
        words = wanted_words(wording)
        need[name] = allowed(len(words), max_differences) + 1
        counts[name] = Counter(w for w in words if w != "<year>")
    vocabulary = sorted({w for c in counts.values() for w in c})
    begun = {w: {name: n for name, c in counts.items() if (n := sum(k for x, k in c.items() if x.startswith(w)))} for w in vocabulary}
    for least in (6, 1):  # short words serve only where there are no others
        usable = [w for w in vocabulary if len(w) >= least or _TELLING.search(w)]
        while usable:
            gain = {w: sum(min(need[name], n) for name, n in begun[w].items() if need[name] > 0) * (3 if _TELLING.search(w) else 1) for w in usable}
            best = max(usable, key=gain.__getitem__)
            if not gain[best]:
                break
            usable = [w for w in usable if not w.startswith(best)]
            for name, n in begun[best].items():
                need[name] -= n
                out[best] = max(out.get(best, REACH), len(templates[name]) * 5 // 4)
    return out


def triggers(templates: dict[str, str], max_differences: float = MAX_DIFFERENCES) -> str:
    """A regular expression (of Python and Java) for the trigger words."""
    words = "|".join(w.replace(".", "[.]") for w in reaches(templates, max_differences))
    return f"(?i)(?<![A-Za-z0-9])(?:{words})" if words else "(?!)"


def blocks(text: str, trigger: re.Pattern, reach: dict[str, int]):
    """Character ranges around trigger words; ranges that touch are one, and long ones are cut into pieces that
    overlap by more than any wording takes."""
    lo = hi = None
    most = max(reach.values(), default=REACH)
    for m in trigger.finditer(text):
        n = reach.get(m[0].lower(), most)
        a, b = max(0, m.start() - n), min(len(text), m.end() + n)
        if hi is not None and a <= hi:
            lo, hi = min(lo, a), max(hi, b)
        else:
            if hi is not None:
                yield from pieces(lo, hi, 2 * most)
            lo, hi = a, b
    if hi is not None:
        yield from pieces(lo, hi, 2 * most)


def pieces(lo: int, hi: int, overlap: int):
    while hi - lo > CUT + overlap:
        yield lo, lo + CUT + overlap
        lo += CUT
    yield lo, hi


def word(text: str) -> str:
    return "<year>" if _YEAR.fullmatch(text) else text.lower()


def cores(got: list[str], want: list[str], least: int) -> list[tuple[int, int]]:
    """Places (in got, in want) of the longest runs of equal words, longest first; runs below least are left out.
    A wording with few differences has a run of at least (words - differences) / (differences + 1)."""
    places: dict[str, list[int]] = {}
    for j, w in enumerate(want):
        places.setdefault(w, []).append(j)
    runs, before = [], {}  # before: place in want -> length of the run that ends there
    for i, w in enumerate([*got, None]):
        now = {j: before.get(j - 1, 0) + 1 for j in places.get(w, ())}
        runs += [(-n, i - n, j - n + 1) for j, n in before.items() if n >= least and j + 1 not in now]
        before = now
    return [(i, j) for _, i, j in sorted(runs)]


def align(got: list[str], want: list[str]) -> list[tuple[int | None, int | None, bool]]:
    """The pairs (place in got, in want, equal) of the fewest changes that make want of a part of got."""
    rows = [[0] * (len(got) + 1)]
    for j, w in enumerate(want):
        up, row = rows[-1], [j + 1]
        for i, g in enumerate(got):
            row.append(min(up[i] + (g != w), up[i + 1] + 1, row[i] + 1))
        rows.append(row)
    i, j, out = rows[-1].index(min(rows[-1])), len(want), []
    while j:
        here = rows[j][i]
        if i and here == rows[j - 1][i - 1] + (got[i - 1] != want[j - 1]):
            i, j = i - 1, j - 1
            out.append((i, j, got[i] == want[j]))
        elif here == rows[j - 1][i] + 1:
            j -= 1
            out.append((None, j, False))
        else:
            i -= 1
            out.append((i, None, False))
    return out[::-1]


class Scanner:
    def __init__(self, templates: dict[str, str] = TEMPLATES, min_saving: float = MIN_SAVING, max_differences: float = MAX_DIFFERENCES):
        self.min_saving, self.max_differences = min_saving, max_differences
        self.trigger = re.compile(triggers(templates, max_differences))
        self.reach = reaches(templates, max_differences)
        self.plain = zstandard.ZstdCompressor(level=19)
        self.templates = {}
        for name, wording in templates.items():
            raw = zstandard.ZstdCompressionDict(wording.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(level=19)
            self.templates[name] = (zstandard.ZstdCompressor(level=19, dict_data=raw), wanted_words(wording))

    def ranked(self, block: str) -> list[tuple[float, str]]:
        """All templates by the size they save of the block, as a share of what they could save at most."""
        return sorted(zip(self.savings(block, list(self.templates)), self.templates), key=lambda x: (-x[0], x[1]))

    def savings(self, block: str, names: list[str]) -> list[float]:
        raw = block.encode("utf-8", "surrogatepass")
        base = len(self.plain.compress(raw))
        out = []
        for name in names:
            compressor, words = self.templates[name]
            out.append((base - len(compressor.compress(raw))) / max(1, min(base, sum(len(w) for w in words if w != "<year>"))))
        return out

    def confirm(self, block: str, name: str) -> list[tuple[int, int, list[str]]]:
        """Ranges of the wording in the block, which don't overlap, and each one's exact differences from the template."""
        found = [(word(m[0]), m.start(), m.end()) for m in _WORD.finditer(block)]
        want = self.templates[name][1]
        got = [w for w, _, _ in found]
        most, taken, out = allowed(len(want), self.max_differences), [False] * len(got), []
        for i, j in cores(got, want, -(-(len(want) - most) // (most + 1))):
            if taken[i]:
                continue
            first = max(0, i - j - most)
            aligned = align(got[first : i - j + len(want) + most], want)
            same = [k for k, (x, y, equal) in enumerate(aligned) if equal]
            # words of the template outside the first and last equal one are missing, not replaced
            inner = range(same[0], same[-1] + 1)
            pairs = [(x if k in inner else None, y, equal) for k, (x, y, equal) in enumerate(aligned) if k in inner or y is not None]
            a, b = first + aligned[same[0]][0], first + aligned[same[-1]][0] + 1
            if sum(not equal for _, _, equal in pairs) > most or any(taken[a:b]):
                continue
            taken[a:b] = [True] * (b - a)
            differences = []
            for equal, run in groupby(pairs, key=lambda x: x[2]):
                if not equal:
                    run = list(run)
                    wanted, there = (want[y] for _, y, _ in run if y is not None), (got[first + x] for x, _, _ in run if x is not None)
                    differences.append(f"{' '.join(wanted)} -> {' '.join(there)}")
            end = found[b - 1][2]
            if name == "SPDX" and (more := _SPDX.match(block, end)):
                end = more.end(1)
            out.append((found[a][1], end, differences))
        return sorted(out)

    def scan(self, text: str | None):
        """(start, end, template, saving, differences) in text order; ranges don't overlap."""
        text, out = text or "", {}
        for piece in blocks(text, self.trigger, self.reach):
            rest = [piece]
            while rest:
                a, b = rest.pop()
                for saving, name in self.ranked(text[a:b]):
                    sure = []
                    for start, end, differences in self.confirm(text[a:b], name):
                        # in a long block a short notice saves little: it's measured alone
                        own = saving if saving >= self.min_saving else self.savings(text[a + start : a + end], [name])[0]
                        if own >= self.min_saving:
                            sure.append((a + start, a + end))
                            out[a + start, a + end] = (name, own, differences)
                    if sure:
                        edges = [a, *(x for s in sure for x in s), b]
                        rest += [(x, y) for x, y in zip(edges[::2], edges[1::2]) if x < y and self.trigger.search(text, x, y)]
                        break
        # pieces overlap: what one of them found in part, another found whole
        last, kept = 0, []
        for start, end in sorted(out, key=lambda x: (x[0], -x[1])):
            if start >= last:
                kept.append((start, end, *out[start, end]))
                last = end
        return kept


FOUND = "doc_id long, start long, end long, licence string, saving double, n_differences long, differences array<string>"


def scan_licences(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """One row for each confirmed notice of each row of docs: place in code points, template, share of the
    template's size that it saved, and the exact differences in wording ("template -> text").

    Null and empty texts have none; texts may be of any length; repeated rows are repeated; an empty table has none;
    other columns are ignored, whatever their names."""
    small_batches(docs.sparkSession)

    def run(batches):
        scanner = Scanner(templates)
        for batch in batches:
            rows = [[] for _ in range(7)]
            for d, text in zip(batch.column(0), batch.column(1)):
                for start, end, name, saving, differences in scanner.scan(text.as_py()):
                    for col, v in zip(rows, (d.as_py(), start, end, name, round(saving, 6), len(differences), differences)):
                        col.append(v)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], [x.split()[0] for x in FOUND.split(", ")])

    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").rlike(triggers(templates)))
    return wanted.mapInArrow(run, FOUND)


REPORT = "doc_id long, n_notices long, licences string, spans string"


def licence_report(docs: DataFrame) -> DataFrame:
    """One row for each row of docs, from that row alone (ids may be null or shared): doc_id, n_notices,
    licences (distinct, sorted, comma-joined), spans. Null and empty texts have no notices; repeated rows are
    repeated; an empty table gives an empty one; other columns are ignored, whatever their names."""
    small_batches(docs.sparkSession)

    def run(batches):
        scanner = Scanner()
        for batch in batches:
            rows = [[] for _ in range(3)]
            for text in batch.column(1):
                found = scanner.scan(text.as_py())
                spans = ",".join(f"{name}:{start}:{end}:{len(differences)}" for start, end, name, _, differences in found)
                for col, v in zip(rows, (len(found), ",".join(sorted({x[2] for x in found})), spans)):
                    col.append(v)
            types = (pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(rows, types))], [x.split()[0] for x in REPORT.split(", ")])

    # texts without a trigger word stay in the JVM
    text = F.when(F.col("text").rlike(triggers(TEMPLATES)), F.col("text"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).mapInArrow(run, REPORT)
