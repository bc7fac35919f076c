"""Scripts by their syntax: a lexer with bracket matching gives tokens, and from them functions, classes and their ends.

Strings, comments, regular expressions and the texts of templates are no code. One pass over a file, linear in its
length, feeds symbols, complexity, rules and snippets. A file is one row of its worker; texts are never refused: an
open string ends with its line, an open comment, template or bracket with the file.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Collection, Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A token behind spaces; the end of a text has no group. Groups begin with different characters, but for comments and marks.
TOKEN = re.compile(
    r"""[^\S\n]*(?:(?P<name>\#?(?!\d)[\w$]+)|(?P<line>\n\s*)
    |(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z)|\A\#![^\n]*)
    |(?P<mark>[()\[\]{},;:`]|=>|\?\?=?|\?\.(?![0-9])|&&=?|\|\|=?|[=!]==?|[-+*/%<>]=|\+\+|--|\.\.\.|\.(?![0-9])|[^\s"'0-9.])
    |(?P<string>"[^"\\\n]*(?:\\.[^"\\\n]*)*(?:"|(?=\n)|\Z|\\\Z)|'[^'\\\n]*(?:\\.[^'\\\n]*)*(?:'|(?=\n)|\Z|\\\Z))
    |(?P<number>0[xXbBoO][0-9a-fA-F_]+n?|(?:[0-9][0-9_]*(?:\.[0-9_]*)?|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9]+)?n?)|\Z)""",
    re.S | re.X,
)
_NAME, _LINE, _COMMENT, _MARK = (TOKEN.groupindex[k] for k in ("name", "line", "comment", "mark"))
_KINDS = ["", *sorted(TOKEN.groupindex, key=TOKEN.groupindex.get)]
_REGEX = re.compile(r"/(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*\]|[^/\\\[\n])+/[A-Za-z]*")
_TEMPLATE = re.compile(r"[^`\\$]*(?:(?:\\.|\$(?!\{))[^`\\$]*)*", re.S)
#: A line without characters of comments, regular expressions, templates and escapes: its tokens hang on nothing before it.
_PLAIN = re.compile(r"[^\n`/\\]{0,200}\n")
_PAIRS = {"(": ")", "[": "]", "{": "}", "${": "}"}
_CLOSE = {")", "]", "}"}
_CODE = ("name", "mark")
#: Words after which a slash begins a regular expression, words that take brackets but are no functions, and branches.
_BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "instanceof", "yield", "await"}
_CONTROL = {"if", "for", "while", "switch", "catch", "with", "return", "typeof", "await", "function", "super", "import", "new", "do", "else"}
_HEAD_ENDS = {"{", ":"}
_STARTS = {"=>", "function", "class", "const", "let", "var", "("}
BRANCHES = {"if", "for", "while", "case", "catch", "&&", "||", "??", "?"}
#: Bounds of the rules.
LARGE_FUNCTION, DEEP_FUNCTIONS, CHAINED_CALLS, PLAIN_NUMBERS = 50, 4, 2, {"100", "1000"}


@dataclass(slots=True)
class Token:
    kind: str
    text: str
    line: int
    match: int = -1  # of a bracket: the place of its other end


class Tokens:
    """Tokens in lists, one for each of their parts."""

    def __init__(self) -> None:
        self.kinds: list[str] = []
        self.texts: list[str] = []
        self.lines: list[int] = []
        self.match: dict[int, int] = {}  # places of brackets that have another end

    def __len__(self) -> int:
        return len(self.texts)

    def __getitem__(self, k: int) -> Token:
        return Token(self.kinds[k], self.texts[k], self.lines[k], self.match.get(k, -1))

    def text(self, k: int) -> str:
        """The text of a name or mark; nothing of other tokens and outside."""
        return self.texts[k] if 0 <= k < len(self.texts) and self.kinds[k] in _CODE else ""

    def is_name(self, k: int) -> bool:
        return 0 <= k < len(self.texts) and self.kinds[k] == "name"

    @cached_property
    def branches(self) -> list[int]:
        """Places of decisions."""
        return [k for k, x in enumerate(self.texts) if x in BRANCHES and branch(self, k)]


@lru_cache(maxsize=1024)
def _plain_line(text: str) -> tuple[list[str], list[str], list[tuple[int, int]], list[int]]:
    """Kinds and texts of the tokens of a plain line, pairs of brackets if all of them match inside, else places of brackets."""
    kinds, texts, pairs, brackets, stack = [], [], [], [], []
    for m in TOKEN.finditer("\n" + text, 1):  # a line inside a text
        if m.lastindex == _LINE:
            break
        kinds.append(m.lastgroup)
        texts.append(m[m.lastindex])
        if m.lastindex == _MARK and (texts[-1] in _PAIRS or texts[-1] in _CLOSE):
            brackets.append(len(texts) - 1)
    for k in brackets:
        if texts[k] in _PAIRS:
            stack.append(k)
        elif stack and _PAIRS[texts[stack[-1]]] == texts[k]:
            pairs.append((stack.pop(), k))
        else:
            return kinds, texts, [], brackets
    return (kinds, texts, [], brackets) if stack else (kinds, texts, pairs, [])


def tokens_of(source: str, comments: bool = False) -> Tokens:
    """Tokens without space (and comments, unless asked for), with the line where each begins and matching brackets. Plain lines
    are remembered, for many lines come again and again."""
    out = Tokens()
    kinds, texts, lines, match = out.kinds, out.texts, out.lines, out.match
    stack: list[int] = []  # places of open brackets and of templates' ${
    awaited = dict.fromkeys(_CLOSE, 0)  # how many of them each closing bracket could close
    at, line, templates = 0, 1, 0

    def add(kind: str, text: str) -> None:
        kinds.append(kind)
        texts.append(text)
        lines.append(line)

    def bracket(text: str, place: int) -> int:
        """Opens or closes; the place that a closing bracket's match opened, else -1."""
        if text in _PAIRS:
            stack.append(place)
            awaited[_PAIRS[text]] += 1
            return -1
        while stack and texts[stack[-1]] != "${" and _PAIRS[texts[stack[-1]]] != text and awaited[text]:
            awaited[_PAIRS[texts[stack.pop()]]] -= 1  # an open bracket inside that nothing closes
        if not stack or _PAIRS[texts[stack[-1]]] != text:
            return -1
        awaited[text] -= 1
        begun = stack.pop()
        match[begun], match[place] = place, begun
        return begun

    def template(at: int) -> int:
        """From behind ` or } to behind ` or ${; the text is one token."""
        nonlocal line, templates
        end = _TEMPLATE.match(source, at).end()
        add("template", source[at:end])
        line += source.count("\n", at, end)
        if source.startswith("${", end):
            templates += 1
            bracket("${", len(texts))
            add("mark", "${")
            return end + 2
        return end + 1

    def regex(at: int) -> int:
        """Behind the regular expression that begins at ``at``; 0 if none does."""
        k = len(texts) - 1
        while k >= 0 and kinds[k] == "comment":
            k -= 1
        if k < 0 or (texts[k] in _BEFORE_REGEX if kinds[k] == "name" else kinds[k] == "mark" and texts[k] not in (")", "]", "}", "++", "--")):
            m = _REGEX.match(source, at)
            if m:
                add("regex", m[0])
                return m.end()
        return 0

    while True:  # begins anew behind what TOKEN doesn't know
        for m in TOKEN.finditer(source, at):
            group = m.lastindex
            if group == _NAME:
                kinds.append("name")
                texts.append(m[_NAME])
                lines.append(line)
            elif group == _MARK:
                text = m[_MARK]
                if text in _PAIRS or text in _CLOSE:
                    begun = bracket(text, len(texts))
                    if begun >= 0 and texts[begun] == "${":
                        templates -= 1
                        add("mark", "}")
                        at = template(m.end())
                        break
                elif text == "`":
                    at = template(m.end())
                    break
                elif text == "/" or text == "/=":
                    at = regex(m.end() - len(text))
                    if at:
                        break
                kinds.append("mark")
                texts.append(text)
                lines.append(line)
            elif group == _LINE:
                line += m[_LINE].count("\n")
                at = m.end()
                while not templates and (m := _PLAIN.match(source, at)):
                    more_kinds, more, pairs, brackets = _plain_line(m[0])
                    place = len(texts)
                    kinds += more_kinds
                    texts += more
                    lines += [line] * len(more)
                    for x, y in pairs:
                        match[place + x], match[place + y] = place + y, place + x
                    for k in brackets:
                        bracket(more[k], place + k)
                    at = m.end()
                    line += 1
                break
            elif group is None:
                return out
            else:
                text = m[group]
                if group != _COMMENT or comments:
                    add(_KINDS[group], text)
                line += text.count("\n")


@dataclass(slots=True)
class Unit:
    """A function, method, arrow, class or variable; first and last are tokens, complexity is that of its own code."""

    kind: str
    name: str | None
    first: int
    last: int
    parent: int = -1
    level: int = 0  # functions around it
    complexity: int = 1
    lines: tuple[int, int] = field(default=(0, 0))


def _body_end(t: Tokens, at: int) -> int:
    """The last token of an expression that begins at ``at``: before the comma, semicolon or bracket that closes it, or where a
    line ends that could end it."""
    k, kinds, texts, lines = at, t.kinds, t.texts, t.lines
    while k < len(t):
        if kinds[k] == "mark" and texts[k] != "${" and t.match.get(k, -1) > k:
            k = t.match[k]
        elif kinds[k] == "mark" and texts[k] in (",", ";", ")", "]", "}"):
            return k - 1
        elif k > at and lines[k] > lines[k - 1] and kinds[k] == "name" and (kinds[k - 1] != "mark" or texts[k - 1] in (")", "]", "}")):
            return k - 1
        k += 1
    return len(t) - 1


def units_of(t: Tokens) -> list[Unit]:
    """Units in the order of their first tokens. t: tokens without comments."""
    found: list[Unit] = []
    n, texts, kinds, lines, match, text, is_name = len(t), t.texts, t.kinds, t.lines, t.match, t.text, t.is_name

    def closes(k: int) -> int:
        return match[k] if match.get(k, -1) > k else n - 1

    def given(k: int) -> str | None:
        """The name before = or : in front of token k."""
        return texts[k - 2] if text(k - 1) in ("=", ":") and is_name(k - 2) else None

    def past_type(k: int) -> int:
        """Behind a closing bracket: over a return type, to what follows it."""
        if text(k) == ":":
            k += 1
            while k < n and text(k) not in ("{", "}", "=>", ";", ",", ")"):
                k = match[k] + 1 if text(k) in ("[", "(") and match.get(k, -1) > k else k + 1
        return k

    last = -1
    for k in [k for k, x in enumerate(texts) if x in _STARTS]:
        if texts[k] == "(":  # a method, if the bracket's end is before a body or type; keywords before it have had their turn
            end = match.get(k, n)
            if end < k or end + 1 >= n or texts[end + 1] not in _HEAD_ENDS:
                continue
            k -= 1
        if k <= last:
            continue
        last = k
        if kinds[k] == "mark":
            if texts[k] == "=>":
                first = max(k - 1, 0)
                if text(k - 1) == ")" and k - 1 in match:
                    first = match[k - 1]
                if text(first - 1) == "async":
                    first -= 1
                if k + 1 < n:
                    found.append(Unit("arrow", given(first), first, closes(k + 1) if text(k + 1) == "{" else _body_end(t, k + 1)))
            continue
        word = text(k)
        if word == "function" and text(k - 1) != ".":
            at = k + 1 + (text(k + 1) == "*")
            name = texts[at] if is_name(at) else given(k)
            at += is_name(at)
            if text(at) == "(" and at in match and text(past_type(match[at] + 1)) == "{":
                found.append(Unit("function", name, k - (text(k - 1) == "async"), closes(past_type(match[at] + 1))))
        elif word == "class" and text(k - 1) != "." and text(k + 1) not in ("=", ":", ",", ")", ""):
            at = k + 1
            while at < n and text(at) not in ("{", ";"):
                at = match[at] + 1 if text(at) in ("(", "[") and match.get(at, -1) > at else at + 1
            if text(at) == "{":
                found.append(Unit("class", texts[k + 1] if is_name(k + 1) and word != text(k + 1) and text(k + 1) != "extends" else given(k), k, closes(at)))
        elif is_name(k) and text(k + 1) == "(" and match.get(k + 1, -1) > k and (word not in _CONTROL and text(k - 1) not in (".", "function", "new", "*", "?.") or text(k - 1) == "*" and text(k - 2) != "function"):
            at = past_type(match[k + 1] + 1)
            if text(at) == "{" and lines[at] == lines[at - 1]:
                found.append(Unit("method", word, k, closes(at)))
        elif word in ("const", "let", "var") and is_name(k + 1):
            found.append(Unit("variable", texts[k + 1], k + 1, k + 1))
    found.sort(key=lambda u: (u.first, -u.last))
    around: list[tuple[int, int]] = []  # units around, and how many functions these are
    for i, u in enumerate(found):
        while around and found[around[-1][0]].last < u.first:
            around.pop()
        u.parent, u.level = around[-1] if around else (-1, 0)
        if u.kind != "variable":
            around.append((i, u.level + (u.kind != "class")))
        u.lines = lines[u.first], lines[u.last] + (texts[u.last].count("\n") if kinds[u.last] == "template" else 0)
    own = [u for u in found if u.kind not in ("class", "variable")]
    inside: list[Unit] = []
    i = 0
    for k in t.branches:  # a branch counts for the last function that begins before it and isn't over
        while i < len(own) and own[i].first <= k:
            inside.append(own[i])
            i += 1
        while inside and inside[-1].last < k:
            inside.pop()
        if inside:
            inside[-1].complexity += 1
    return found


def branch(t: Tokens, k: int) -> bool:
    """Whether a token is a decision; an optional mark of a type (?: ?, ?)) and a property of that name are none."""
    word = t.text(k)
    if word not in BRANCHES:
        return False
    if word == "?":
        return not (k + 1 < len(t) and t.kinds[k + 1] == "mark" and t.texts[k + 1] in (":", ",", ")", "="))
    return t.kinds[k] == "mark" or not (k and t.texts[k - 1] in (".", "?."))


def _chain(t: Tokens, k: int) -> tuple[int, bool, int]:
    """From the dot of a .then( on: how many .then( the chain has, whether it has a .catch( or .finally(, and its last token."""
    thens, caught, texts = 0, False, t.texts
    while k + 2 < len(t) and texts[k] in (".", "?.") and t.kinds[k + 1] == "name" and texts[k + 2] == "(" and t.match.get(k + 2, -1) > k:
        thens += texts[k + 1] == "then"
        caught |= texts[k + 1] == "catch"
        k = t.match[k + 2] + 1
    return thens, caught, k - 1


def findings_of(t: Tokens, units: list[Unit]) -> Iterator[tuple]:
    """(line, type, name, severity, message) by syntax: each rule as its name says, whatever the layout of lines."""
    for u in units:
        size = u.lines[1] - u.lines[0] + 1
        if u.kind not in ("class", "variable"):
            if size > LARGE_FUNCTION:
                yield u.lines[0], "code_smell", "large_function", "warning", f"{u.name or 'function'} has {size} lines"
            if u.level >= DEEP_FUNCTIONS:
                yield u.lines[0], "anti_pattern", "callback_hell", "warning", f"{u.level} functions around a function"
    texts, kinds, lines = t.texts, t.kinds, t.lines
    for k in [k for k, kind in enumerate(kinds) if kind == "number"]:
        whole = texts[k].rstrip("n").replace("_", "")
        if whole.isdigit() and len(whole) > 1 and whole not in PLAIN_NUMBERS:
            yield lines[k], "code_smell", "magic_number", "info", f"Magic number {texts[k]}"
    done = -1
    for k in [k - 1 for k, x in enumerate(texts) if x == "then"]:
        if k > done and texts[k] in (".", "?.") and k + 2 < len(t) and texts[k + 2] == "(":
            thens, caught, done = _chain(t, k)
            if thens > CHAINED_CALLS:
                yield lines[k], "anti_pattern", "promise_hell", "warning", f"{thens} calls of then in a chain"
            if not caught:
                yield lines[k], "code_smell", "missing_error_handling", "warning", "No catch for a promise"
    declared = {u.name for u in units if u.kind == "variable"}
    seen = Counter([x for k, x in enumerate(texts) if x in declared and kinds[k] == "name"])
    for u in units:
        if u.kind == "variable" and seen[u.name] == 1:
            yield u.lines[0], "code_smell", "unused_variable", "info", f"Unused variable {u.name}"


SYNTAX = "path string, part string, kind string, name string, first_line int, last_line int, level int, complexity int, severity string, message string, most int, functions int"
_FIELDS = [(x.split()[0], pa.int32() if x.endswith(" int") else pa.string()) for x in SYNTAX.split(", ")]


_PARTS = ("file", "unit", "finding")


def rows_of(source: str, parts: Collection[str] = _PARTS) -> Iterator[tuple]:
    t = tokens_of(source)
    units = units_of(t)
    if "file" in parts:
        own = [u.complexity for u in units if u.kind not in ("class", "variable")]
        yield "file", "script", None, 1, source.count("\n") + 1, 0, 1 + len(t.branches), None, None, max(own, default=0), len(own)
    if "unit" in parts:
        for u in units:
            yield "unit", u.kind, u.name, *u.lines, u.level, u.complexity, None, None, None, None
    if "finding" in parts:
        for line, kind, name, severity, message in sorted(findings_of(t, units)):
            yield "finding", kind, name, line, line, None, None, severity, message, None, None


def syntax(files: DataFrame, parts: Collection[str] = _PARTS) -> DataFrame:
    """SYNTAX rows of scripts (path, content) in one pass: a row of each file (part file: lines, complexity, the largest complexity of
    a function and the number of functions), of each
    function, arrow, method, class and variable (unit) and of each finding. Null texts are empty; an empty table gives an
    empty one, repeated rows repeat. parts: those that are wanted; others are neither made nor sent on."""

    def run(batches):
        for batch in batches:
            cols: list[list] = [[] for _ in _FIELDS]
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for row in rows_of(content or "", parts):
                    for col, v in zip(cols, (path, *row)):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(cols, _FIELDS)], [n for n, _ in _FIELDS])

    return files.select(F.col("path").cast("string"), "content").mapInArrow(run, SYNTAX)


def symbols(found: DataFrame) -> DataFrame:
    """Functions, methods, classes and variables with names, their lines and how many functions lie around them."""
    return found.where("part = 'unit' and name is not null").select("path", F.when(F.col("kind") == "arrow", "function").otherwise(F.col("kind")).alias("kind"), "name", "first_line", "last_line", "level")


def complexity(found: DataFrame) -> DataFrame:
    """Of each file its own complexity, the largest of a function, and the number of functions."""
    return found.where("part = 'file'").select("path", "complexity", "most", F.col("functions").cast("long").alias("functions"))


def findings(found: DataFrame) -> DataFrame:
    """Detector rows."""
    return found.where("part = 'finding'").select(F.col("path").alias("file_path"), F.col("first_line").alias("line"), F.col("kind").alias("pattern_type"), F.col("name").alias("pattern_name"), "severity", "message")


def snippets(files: DataFrame, found: DataFrame) -> DataFrame:
    """path, kind, name, first_line, last_line, text of the outermost functions, methods and classes: whole lines.

    Units meet their texts by path; a path that stands for several files gives the snippets of each with each. Both sides are
    sorted: Spark may take texts for as small as what they are made from, and would send them through the driver."""
    units = found.where("part = 'unit' and kind <> 'variable' and level = 0").select("path", "kind", "name", "first_line", "last_line")
    texts = files.select(F.col("path").cast("string").alias("path"), "content")
    text = F.array_join(F.slice(F.split("content", "\n"), F.col("first_line"), F.col("last_line") - F.col("first_line") + 1), "\n")
    return units.join(texts.hint("merge"), "path").select("path", "kind", "name", "first_line", "last_line", text.alias("text"))
