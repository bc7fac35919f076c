"""Syntax trees as flat rows: Python, HTML, JSON, YAML, style sheets and notes, one parse of each file."""

from __future__ import annotations

import ast
import json
import re
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cache, partial
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Column, its type here and in Arrow. parent_*: of the node above; key_path: of JSON and YAML keys; attrs: scalar fields as JSON.
_COLUMNS = [
    ("path", "string", pa.string()), ("node_id", "int", pa.int32()), ("parent_id", "int", pa.int32()), ("depth", "int", pa.int32()),
    ("node_type", "string", pa.string()), ("name", "string", pa.string()), ("line", "int", pa.int32()), ("end_line", "int", pa.int32()),
    ("parent_type", "string", pa.string()), ("parent_name", "string", pa.string()), ("parent_line", "int", pa.int32()),
    ("key_path", "string", pa.string()), ("value", "string", pa.string()), ("attrs", "string", pa.string()),
]
NODE = ", ".join(f"{n} {t}" for n, t, _ in _COLUMNS)
#: Rows of a batch that a parser gives back.
BATCH_ROWS = 5_000
#: What ast.parse raises for texts that aren't Python, or nest too deep.
UNPARSED = (SyntaxError, ValueError, RecursionError, MemoryError)


@dataclass(frozen=True)
class Want:
    """What of a tree is wanted: nodes of some types, or below nodes of some (all if kinds is None; Error nodes always
    stay), and some columns (all if None)."""

    kinds: frozenset[str] | None = None
    parents: frozenset[str] = frozenset()
    columns: tuple[str, ...] | None = None

    def keeps(self, kind: str, parent: str | None) -> bool:
        return self.kinds is None or kind in self.kinds or parent in self.parents or kind == "Error"

    def gives(self, column: str) -> bool:
        return self.columns is None or column in self.columns


class Nodes(list):
    """Nodes of one file; each is a dict and knows what its parent tells about itself."""

    def add(self, parent: int | None, node_type: str, name: str | None = None, line: int | None = None, end_line: int | None = None, **more) -> int:
        above = self[parent] if parent is not None else {}
        self.append(
            dict(
                node_id=len(self), parent_id=parent, depth=above.get("depth", -1) + 1, node_type=node_type, name=name, line=line, end_line=end_line,
                parent_type=above.get("node_type"), parent_name=above.get("name"), parent_line=above.get("line"), **more,
            )
        )
        return len(self) - 1


def assigned(node: ast.Assign) -> list[str]:
    """The names among an assignment's targets, and in its tuple and list targets."""
    parts = [e for t in node.targets for e in (t.elts if isinstance(t, (ast.Tuple, ast.List)) else [t])]
    return [e.id for e in parts if isinstance(e, ast.Name)]


def exported(node: ast.AST) -> list[str] | None:
    """The texts of a list that alone is assigned to __all__."""
    if isinstance(node, ast.Assign) and len(node.targets) == 1 and isinstance(node.targets[0], ast.Name) and node.targets[0].id == "__all__":
        if isinstance(node.value, ast.List):
            return [e.value for e in node.value.elts if isinstance(e, ast.Constant) and isinstance(e.value, str)]
    return None


#: Forms in which Python names modules, functions, classes and variables at the start of a line.
RECOVERED_FORMS = [
    ("Import", r"(?m)^\s*import\s+([A-Za-z0-9_.]+)"), ("ImportFrom", r"(?m)^\s*from\s+([A-Za-z0-9_.]+)\s+import"),
    ("FunctionDef", r"(?m)^\s*(?:async\s+)?def\s+([A-Za-z_][A-Za-z0-9_]*)\s*\("), ("ClassDef", r"(?m)^\s*class\s+([A-Za-z_][A-Za-z0-9_]*)\s*[:(]"),
    ("Assign", r"(?m)^\s*([A-Za-z_][A-Za-z0-9_]*)\s*=(?!=)"),
]


def recovered(source: str, out: Nodes) -> None:
    """Import, definition and assignment nodes of a text that can't be parsed, by the regex forms."""
    for node_type, m in sorted(((t, m) for t, rx in RECOVERED_FORMS for m in re.finditer(rx, source)), key=lambda x: x[1].start(1)):
        line = source.count("\n", 0, m.start(1)) + 1
        me = out.add(0, node_type, None if node_type == "Import" else m[1], line)
        if node_type.startswith("Import"):  # the forms name the module only
            out.add(me, "alias", m[1] if node_type == "Import" else "*", line)


def _python_name(node: ast.AST) -> str | None:
    if isinstance(node, ast.ImportFrom):
        return "." * node.level + (node.module or "")
    if isinstance(node, ast.BoolOp):
        return str(len(node.values))
    if isinstance(node, ast.Assign):
        return ",".join(assigned(node)) or None
    found = getattr(node, "name", None) or getattr(node, "id", None) or getattr(node, "attr", None)
    return found if isinstance(found, str) else None


def _scalars(node: ast.AST) -> str | None:
    found = {k: v for k, v in ast.iter_fields(node) if isinstance(v, (str, int, float, bool))}
    names = exported(node)
    if names is not None:
        found["exports"] = names
    return json.dumps(found, sort_keys=True) if found else None


#: Fields that hold statements, or parts of statements that hold some; no expression has a statement below it.
_BLOCKS = ("names", "body", "handlers", "orelse", "finalbody", "cases")
_STATEMENTS = {c.__name__ for c in ast.stmt.__subclasses__()} | {"Module", "ExceptHandler", "match_case", "alias"}


@cache
def _block_fields(kind: type) -> tuple[str, ...]:
    return tuple(f for f in kind._fields if f in _BLOCKS)


def below(node: ast.AST) -> list[ast.AST]:
    """The children of a statement without its expressions, in order."""
    return [c for f in _block_fields(type(node)) for c in getattr(node, f) if isinstance(c, ast.AST)]


def children(node: ast.AST) -> list[ast.AST]:
    """All children, as ast.iter_child_nodes has them."""
    out = []
    for f in node._fields:
        v = getattr(node, f, None)
        if isinstance(v, ast.AST):
            out.append(v)
        elif isinstance(v, list):
            out += [c for c in v if isinstance(c, ast.AST)]
    return out


def statements(node: ast.AST) -> Iterator[ast.AST]:
    """The node and all below it but expressions, level by level as ast.walk has them."""
    todo = deque([node])
    while todo:
        node = todo.popleft()
        todo.extend(below(node))
        yield node


def python_nodes_of(source: str, want: Want = Want()) -> Nodes:
    """All syntax nodes with their scalar fields; a syntax error gives a node Error, and below it what the regex
    forms find of imports and symbols. Where neither numbers nor expressions are wanted, expressions aren't visited."""
    out = Nodes()
    try:
        top = ast.parse(source)
    except UNPARSED as e:
        out.add(None, "Error", str(e), getattr(e, "lineno", None))
        recovered(source, out)
        return out
    whole = want.kinds is None or want.gives("node_id") or want.gives("parent_id") or not want.kinds <= _STATEMENTS or bool(want.parents)
    next_of = children if whole else below
    scalars, number = want.gives("attrs"), 0
    todo: list[tuple[ast.AST, ast.AST | None, int | None, int]] = [(top, None, None, 0)]
    while todo:
        node, above, parent, depth = todo.pop()
        kind, me = type(node).__name__, number
        number += 1
        if want.keeps(kind, type(above).__name__):
            out.append(
                dict(
                    node_id=me, parent_id=parent, depth=depth, node_type=kind, name=_python_name(node), line=getattr(node, "lineno", None), end_line=getattr(node, "end_lineno", None),
                    parent_type=above and type(above).__name__, parent_name=above and _python_name(above), parent_line=getattr(above, "lineno", None), attrs=_scalars(node) if scalars else None,
                )
            )
        todo.extend((c, node, me, depth + 1) for c in reversed(next_of(node)))
    return out


class _Tags(HTMLParser):
    """Elements with their attributes; the text of scripts is their value."""

    VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

    def __init__(self):
        super().__init__()
        self.out, self.stack = Nodes(), []

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in reversed(attrs)}  # of repeated attributes the first counts
        me = self.out.add(self.stack[-1] if self.stack else None, tag, a.get("id") or a.get("href") or a.get("src"), self.getpos()[0], attrs=json.dumps(a, sort_keys=True))
        if tag not in self.VOID:
            self.stack.append(me)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in self.VOID:
            self.stack.pop()

    def handle_endtag(self, tag):
        for k in range(len(self.stack) - 1, -1, -1):
            if self.out[self.stack[k]]["node_type"] == tag:
                del self.stack[k:]
                break

    def handle_data(self, data):
        if self.stack and self.out[self.stack[-1]]["node_type"] == "script":
            self.out[self.stack[-1]]["value"] = (self.out[self.stack[-1]].get("value") or "") + data


def html_nodes_of(source: str) -> Nodes:
    p = _Tags()
    p.feed(source)
    p.close()
    return p.out


def flat(value, mapping: str = "object", sequence: str = "array") -> Nodes:
    """Nodes of nested values; key_path is a, a.b, c, c[0].d. Keys that aren't texts, and all below them, have none."""
    out, todo = Nodes(), [(value, None, None, "")]
    while todo:
        v, name, parent, path = todo.pop()
        kind = mapping if isinstance(v, dict) else sequence if isinstance(v, list) else "null" if v is None else type(v).__name__
        scalar = None if isinstance(v, (dict, list)) else "null" if v is None else str(v)
        me = out.add(parent, kind, name, key_path=path, value=scalar)
        if isinstance(v, dict):
            below = [(x, str(k), me, None if path is None or not isinstance(k, str) else f"{path}.{k}" if path else k) for k, x in v.items()]
        else:
            below = [(x, f"[{i}]", me, None if path is None else f"{path}[{i}]") for i, x in enumerate(v)] if isinstance(v, list) else []
        todo.extend(reversed(below))
    return out


def json_nodes_of(source: str) -> Nodes:
    return flat(json.loads(source))


#: The two parsers of YAML differ in tabs, question marks in brackets and texts too deep for one of them: none of these is
#: given to the one in C. Blocks nest by at most two a column of indent, others by brackets.
_ODD, _INDENT, YAML_DEPTH = re.compile("[\t\r\x85\u2028\u2029\ufeff]"), re.compile("(?m)^[ ?:-]+"), 200


def yaml_nodes_of(source: str) -> Nodes:
    import yaml

    value = None
    try:  # the parser in C, where it is there and takes the text; else the other one says what is wrong
        brackets = source.count("[") + source.count("{")
        plain = not _ODD.search(source) and not (brackets and "?" in source) and brackets + 2 * max(map(len, _INDENT.findall(source)), default=0) < YAML_DEPTH
        if not plain or (value := yaml.load(source, yaml.CSafeLoader)) is None:
            value = yaml.safe_load(source)
    except (AttributeError, yaml.YAMLError):
        value = yaml.safe_load(source)
    return flat(value, "mapping", "sequence")


_COMMENT = re.compile(r"/\*.*?\*/", re.S)


def css_nodes_of(source: str) -> Nodes:
    """stylesheet > style_rule (its selector) > property (its value); at-rules by their name, blocks inside them below."""
    out = Nodes()
    top = out.add(None, "stylesheet", "root")
    text = _COMMENT.sub(lambda m: "\n" * m[0].count("\n"), source)
    stack, start, quote = [top], 0, ""

    def line(at):
        return text.count("\n", 0, at + len(text[at:]) - len(text[at:].lstrip())) + 1

    def declare(a, b):
        part = text[a:b].strip()
        if not part:
            return
        if part.startswith("@"):
            out.add(stack[-1], part[1:].split(None, 1)[0].lower() + "_rule", part[:100], line(a))
        elif ":" in part and stack[-1] != top:
            name, value = part.split(":", 1)
            out.add(stack[-1], "property", name.strip(), line(a), value=value.strip())

    for m in re.finditer(r"[{};'\"]", text):
        c = m[0]
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c == "{":
            head = text[start : m.start()].strip()
            kind = head[1:].split(None, 1)[0].lower() + "_rule" if head.startswith("@") else "style_rule"
            stack.append(out.add(stack[-1], kind, head, line(start)))
            start = m.end()
        else:
            declare(start, m.start())
            start = m.end()
            if c == "}" and len(stack) > 1:
                stack.pop()
    declare(start, len(text))
    return out


def markdown_nodes_of(source: str) -> Nodes:
    """document > code_block, header_1..6; below a header lists (by indent) with their items, and links."""
    out = Nodes()
    top = out.add(None, "document", "root")
    section, held, indent, fenced = top, None, 0, False
    for number, line in enumerate(source.split("\n"), 1):
        bare = line.strip()
        if bare.startswith("```"):
            if not fenced:
                out.add(top, "code_block", re.match(r"```(\w*)", bare)[1] or "text", number)
            fenced = not fenced
            continue
        if fenced:
            continue
        if m := re.match(r"(#{1,6})\s+(.+)$", bare):
            section, held = out.add(top, f"header_{len(m[1])}", m[2].strip(), number), None
            continue
        if m := re.match(r"(\s*)([-*+]|\d+\.)\s+(.+)$", line):
            prefix, item = ("numbered_list", "numbered_item") if m[2][0].isdigit() else ("list", "list_item")
            if held is None or indent != len(m[1]):
                indent = len(m[1])
                held = out.add(section, prefix, f"{prefix}_indent_{indent}", number)
            out.add(held, item, m[3][:50] + "..." if len(m[3]) > 50 else m[3], number)
            continue
        for m in re.finditer(r"\[([^\]]*)\]\(([^)]+)\)", line):
            out.add(section, "link", m[1] or m[2], number, value=m[2])
        held = None
    return out


#: file type -> parser of one text; register() adds more.
PARSERS: dict[str, Callable[[str], Nodes]] = {
    "python": python_nodes_of, "html": html_nodes_of, "json": json_nodes_of, "yaml": yaml_nodes_of, "css": css_nodes_of, "markdown": markdown_nodes_of,
}


def register(file_type: str, parser: Callable[[str], Nodes]) -> None:
    PARSERS[file_type] = parser


def parsed(parser: Callable[[str], Nodes], content: str | None) -> Nodes:
    """The nodes of one text; a text that can't be parsed gives an Error node, never a failed job."""
    try:
        return parser(content or "")
    except Exception as e:  # noqa: BLE001
        out = Nodes()
        out.add(None, "Error", str(e))
        return out


def _batches(rows: Iterator[tuple[str, dict]], columns: list) -> Iterator[pa.RecordBatch]:
    names = [n for n, _, _ in columns]
    held: list[list] = [[] for _ in names]

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, _, t) in zip(held, columns)], names)

    for path, node in rows:
        for col, name in zip(held, names):
            col.append(path if name == "path" else node.get(name))
        if len(held[0]) >= BATCH_ROWS:
            yield batch()
            held = [[] for _ in names]
    yield batch()


def nodes(files: DataFrame, file_type: str, **want) -> DataFrame:
    """Syntax nodes of the files (path, content) of one type; a text that can't be parsed gives an Error node. For want see ``parse``."""
    return parse(files.select("path", F.lit(file_type).alias("file_type"), "content"), **want)


def parse(files: DataFrame, kinds: Iterable[str] | None = None, parents: Iterable[str] = (), columns: Iterable[str] | None = None) -> DataFrame:
    """Syntax nodes of files (path, file_type, content) of all types in one pass; types without a parser have none.

    kinds, parents: only nodes of these types, or right below nodes of these types, and Error nodes leave the worker;
    columns: only these are made."""
    parsers = dict(PARSERS)
    want = Want(None if kinds is None else frozenset(kinds), frozenset(parents), None if columns is None else tuple(columns))
    given = [c for c in _COLUMNS if want.gives(c[0])]
    if parsers.get("python") is python_nodes_of:
        parsers["python"] = partial(python_nodes_of, want=want)

    def run(batches):
        def rows():
            for batch in batches:
                for path, kind, content in zip(*(batch.column(k).to_pylist() for k in range(3))):
                    if kind in parsers:
                        for node in parsed(parsers[kind], content):
                            if want.keeps(node.get("node_type"), node.get("parent_type")):
                                yield path, node

        yield from _batches(rows(), given)

    return files.select("path", "file_type", "content").mapInArrow(run, ", ".join(f"{n} {t}" for n, t, _ in given))
