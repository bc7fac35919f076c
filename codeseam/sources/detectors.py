"""Rule detectors: files to detector rows. Python files by one parse of each, scripts by array functions over their lines."""

from __future__ import annotations

import ast

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .trees import UNPARSED, below, statements

FINDING = "file_path string, line int, pattern_type string, pattern_name string, severity string, message string"
_NAMES = [x.split()[0] for x in FINDING.split(", ")]
_HIT = "array<struct<line:int,pattern_type:string,pattern_name:string,severity:string,message:string>>"
#: Bounds of the rules.
LONG_METHOD, GOD_METHODS, GOD_ATTRIBUTES, DEEP_NESTING, DUPLICATE_STATEMENTS = 50, 20, 15, 4, 3
LARGE_FUNCTION, DEEP_INDENT, CHAINED_CALLS, CATCH_AHEAD = 50, 16, 2, 5


def nesting(node: ast.AST) -> int:
    """How deep branches and loops nest below a statement; expressions hold none."""
    best, todo = 0, [(node, 0)]
    while todo:
        n, d = todo.pop()
        best = max(best, d)
        todo += [(c, d + isinstance(c, (ast.If, ast.For, ast.While, ast.With, ast.Try))) for c in below(n)]
    return best


def _class_findings(node: ast.ClassDef):
    methods = [n for n in node.body if isinstance(n, ast.FunctionDef)]
    if any(m.name == "__new__" and any(isinstance(s, ast.If) for s in m.body) for m in methods):
        yield node.lineno, "design_pattern", "singleton", "info", node.name
    names = [m.name.lower() for m in methods]
    held = [t.id.lower() for n in node.body if isinstance(n, ast.Assign) for t in n.targets if isinstance(t, ast.Name)]
    held += [t.attr.lower() for m in methods for n in statements(m) if isinstance(n, ast.Assign) for t in n.targets if isinstance(t, ast.Attribute)]
    watched = ("observer", "listener")
    if any(w in h for h in held for w in watched) and any("notify" in n for n in names) and any("add" in n and any(w in n for w in watched) for n in names):
        yield node.lineno, "design_pattern", "observer", "info", node.name
    many = sum(isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) for n in node.body)
    if many > GOD_METHODS or sum(isinstance(n, ast.Assign) for n in node.body) > GOD_ATTRIBUTES:
        yield node.lineno, "anti_pattern", "god_class", "warning", f"{node.name} does too much"


def _function_findings(node: ast.FunctionDef | ast.AsyncFunctionDef):
    name = node.name.lower()
    if name.startswith(("create_", "make_")) or name.endswith("_factory"):
        if any(isinstance(n, ast.If) and any(isinstance(r, ast.Return) for r in statements(n)) for n in statements(node)):
            yield node.lineno, "design_pattern", "factory_method", "info", node.name
    size = node.end_lineno - node.lineno + 1
    if size > LONG_METHOD:
        yield node.lineno, "code_smell", "long_method", "warning", f"{node.name} has {size} lines"
    depth = nesting(node)
    if depth > DEEP_NESTING:
        yield node.lineno, "code_smell", "deep_nesting", "warning", f"{node.name} nests {depth} deep"


def python_findings_of(source: str) -> list[tuple]:
    """All findings of one file, sorted; a text that can't be parsed gives analysis_error."""
    try:
        top = ast.parse(source)
        out, bodies = [], {}
        for node in statements(top):
            if isinstance(node, ast.ClassDef):
                out += _class_findings(node)
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                out += _function_findings(node)
                first = node.body[0]
                told = isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant)
                kinds = tuple(type(s).__name__ for s in node.body[told:])
                if len(kinds) > DUPLICATE_STATEMENTS:
                    if kinds in bodies:
                        out.append((node.lineno, "code_smell", "duplicate_code", "warning", f"{node.name} is built as {bodies[kinds]}"))
                    else:
                        bodies[kinds] = node.name
        return sorted(out)
    except UNPARSED as e:
        return [(getattr(e, "lineno", None), "code_smell", "analysis_error", "error", f"Analysis failed: {e}")]


def _hit(line: Column, kind: str, name: str, severity: str, message: Column) -> Column:
    return F.struct(line.cast("int").alias("line"), F.lit(kind).alias("pattern_type"), F.lit(name).alias("pattern_name"), F.lit(severity).alias("severity"), message.alias("message"))


def _where(lines: Column, test, hit) -> Column:
    """The hits of the lines that pass."""
    return F.array_compact(F.transform(lines, lambda x, i: F.when(test(x, i), hit(i + 1))))


def script_hits(lines: Column) -> Column:
    """The findings of one script's lines as an array; no line leaves its row, so nothing is shuffled. lines is a column:
    an expression would be computed anew for each line."""
    n = F.size(lines)
    numbers = F.flatten(
        F.transform(
            lines,
            lambda x, i: F.transform(
                F.filter(F.regexp_extract_all(x, F.lit(r"(?<![A-Za-z0-9_])[0-9]{2,}(?![A-Za-z0-9_])"), F.lit(0)), lambda v: ~v.isin("100", "1000")),
                lambda v: _hit(i + 1, "code_smell", "magic_number", "info", F.concat(F.lit("Magic number "), v)),
            ),
        )
    )
    chains = _where(lines, lambda x, i: F.regexp_count(x, F.lit(r"\.then\(")) > CHAINED_CALLS, lambda at: _hit(at, "anti_pattern", "promise_hell", "warning", F.lit("Long promise chain")))
    unhandled = _where(
        lines,
        lambda x, i: F.contains(x, F.lit(".then(")) & (i + 1 < n - CATCH_AHEAD) & ~F.exists(F.slice(lines, i + 1, CATCH_AHEAD + 1), lambda y: F.contains(y, F.lit(".catch("))),
        lambda at: _hit(at, "code_smell", "missing_error_handling", "warning", F.lit("No catch for a promise")),
    )
    deep = _where(
        lines,
        lambda x, i: (F.contains(x, F.lit("function(")) | F.contains(x, F.lit("=>"))) & (F.length(x) - F.length(F.regexp_replace(x, r"^\s+", "")) > DEEP_INDENT),
        lambda at: _hit(at, "anti_pattern", "callback_hell", "warning", F.lit("Deeply nested callback")),
    )
    starts = F.array_compact(F.transform(lines, lambda x, i: F.when(x.rlike(r"function\s+\w+|=>\s*\{"), i + 1)))
    others = F.greatest(F.size(starts) - 1, F.lit(0))
    large = F.array_compact(
        F.zip_with(F.slice(starts, 1, others), F.slice(starts, 2, others), lambda a, b: F.when(b - a > LARGE_FUNCTION, _hit(a, "code_smell", "large_function", "warning", F.lit("Large function"))))
    )
    return F.concat(*(x.cast(_HIT) for x in (numbers, chains, unhandled, deep, large)))


_AT = "\x00"  # between a name and its line: sorts before all characters of names


def declarations(lines: Column) -> Column:
    """Names with the line that declares them, as texts."""
    form = F.lit(r"(?:const|let|var)\s+([A-Za-z_$][A-Za-z0-9_$]*)")
    return F.flatten(F.transform(lines, lambda x, i: F.transform(F.regexp_extract_all(x, form, F.lit(1)), lambda v: F.concat(v, F.lit(_AT), (i + 1).cast("string")))))


def words_at(lines: Column) -> Column:
    """All words with their lines, as texts, each once, in order: a word's lines are neighbours."""
    word = F.lit(r"[A-Za-z_$][A-Za-z0-9_$]*")
    return F.sort_array(F.flatten(F.transform(lines, lambda x, i: F.transform(F.array_distinct(F.regexp_extract_all(x, word, F.lit(0))), lambda v: F.concat(v, F.lit(_AT), (i + 1).cast("string"))))))


def word_of(told: Column) -> Column:
    return F.substring_index(told, _AT, 1)


def unused(declared: Column, words: Column) -> Column:
    """Declared names that stand on one line only, that of their declaration. Both are columns; linear but for the sort of words."""
    n = F.size(words)
    none = F.array(F.lit(None).cast("string"))
    near = F.arrays_zip(words.alias("w"), F.concat(none, F.slice(words, 1, F.greatest(n - 1, F.lit(0)))).alias("before"), F.slice(words, 2, n).alias("after"))
    alone = F.filter(near, lambda x: ~word_of(x["w"]).eqNullSafe(word_of(x["before"])) & ~word_of(x["w"]).eqNullSafe(word_of(x["after"])))
    return F.array_intersect(declared, F.transform(alone, lambda x: x["w"]))


def unused_hits(declared: Column, words: Column) -> Column:
    return F.transform(unused(declared, words), lambda d: _hit(F.substring_index(d, _AT, -1), "code_smell", "unused_variable", "info", F.concat(F.lit("Unused variable "), word_of(d)))).cast(_HIT)


def unused_variables(files: DataFrame) -> DataFrame:
    """path, name, line_no of the declared names of each script (path, content) that stand on no other line; nothing is shuffled."""
    cut = files.select("path", F.split("content", "\r?\n").alias("lines"))
    told = cut.select("path", declarations(F.col("lines")).alias("declared"), words_at(F.col("lines")).alias("words"))
    names = told.select("path", F.explode(unused(F.col("declared"), F.col("words"))).alias("told"))
    return names.select("path", word_of(F.col("told")).alias("name"), F.substring_index("told", _AT, -1).cast("int").alias("line_no"))


def detect(files: DataFrame, rules: list[str] | None = None, disabled: list[str] = ()) -> DataFrame:
    """Detector rows of files (path, file_type, content) in one pass; files of other types have none.

    rules: names to keep (all if None), disabled: names to leave out; disabled wins. Scripts are judged by
    expressions in the JVM, only Python files' contents go to a Python worker."""
    script = F.col("file_type").isin("javascript", "typescript")
    cut = files.where(script | (F.col("file_type") == "python")).select("path", F.when(~script, F.coalesce("content", F.lit(""))).alias("source"), F.when(script, F.split("content", "\r?\n")).alias("lines"))
    told = cut.select("path", "source", "lines", declarations(F.col("lines")).alias("declared"), words_at(F.col("lines")).alias("words"))
    rows = told.select("path", "source", F.concat(script_hits(F.col("lines")), unused_hits(F.col("declared"), F.col("words"))).alias("hits"))

    def run(batches):
        for batch in batches:
            cols: list[list] = [[] for _ in _NAMES]
            for path, source, hits in zip(*(batch.column(k).to_pylist() for k in range(3))):
                found = [tuple(h.values()) for h in hits or ()] if source is None else python_findings_of(source)
                for row in found:
                    for col, v in zip(cols, (path, *row)):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "line" else pa.string()) for c, n in zip(cols, _NAMES)], _NAMES)

    out = rows.mapInArrow(run, FINDING)
    keep = enabled(F.col("pattern_name"), rules, disabled)
    return out if keep is None else out.where(keep)


def enabled(rule: Column, rules: list[str] | None, disabled: list[str]) -> Column | None:
    """A rule counts unless it is disabled, or others are named and it isn't."""
    keep = None if rules is None else rule.isin(list(rules))
    if disabled:
        keep = ~rule.isin(list(disabled)) if keep is None else keep & ~rule.isin(list(disabled))
    return keep


def structural_findings(files: DataFrame) -> DataFrame:
    """Findings of Python files (path, content)."""
    return detect(files.select("path", F.lit("python").alias("file_type"), "content"))
