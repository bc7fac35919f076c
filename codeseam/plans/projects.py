"""Registered queries over the files of a project whose texts are written from the rows of part."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..adapters import spread, table
from ..operators import deps, filegraph
from ..sources import lexer, parsers
from ..storage import fresh_folder
from ..streaming import incremental

QUERIES: dict = {}
ORACLES: dict = {}

#: Each row p writes a Python module and a script. Siblings halve towards small numbers, and the smallest go round in circles.
_SIBLING = "if(p <= 25, p + 5, cast(floor(p / 10) as bigint) * 5 + p % 5)"
_PYTHON = f"""concat('import os, json\\n# from . import m1\\nx = "import pkg1.m1"\\nfrom . import m', {_SIBLING}, '\\n',
    if(p % 3 = 0, concat('from ..pkg', n % 5, ' import m', n, ' as other\\n'), ''), 'import pkg', p % 5, '.m', cast(floor(p / 2) as bigint), '.thing\\n',
    if(p % 4 = 0, concat('def f():\\n    from ...lib import x\\n    from .m', p, ' import f\\n'), ''), if(p % 7 = 0, 'import nowhere.m1\\n', ''))"""
_SCRIPT = """concat('import React from "react";\\nimport a from "./s', if(p <= 9, p + 3, cast(floor(p / 6) as bigint) * 3 + p % 3), '";\\n',
    'const b = require("../d', n % 3, '/s', n, '.js");\\n', if(p % 5 = 0, 'import c from "../d1";\\n', ''), if(p % 6 = 0, 'import d from "../../../../out";\\n', ''))"""


def project_files(spark, sf_dir: str) -> DataFrame:
    rows = spread(table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("p"), F.col("p_size").cast("long").alias("n")), "p")
    python = rows.selectExpr("concat('/proj/pkg', p % 5, '/m', p, '.py') AS path", "'python' AS file_type", f"{_PYTHON} AS content")
    script = rows.selectExpr("concat('/proj/web/d', p % 3, '/s', p, '.js') AS path", "'javascript' AS file_type", f"{_SCRIPT} AS content")
    packages = rows.selectExpr("concat('/proj/pkg', p % 5, '/__init__.py') AS path", "'python' AS file_type", "'' AS content").distinct()
    folders = rows.selectExpr("concat('/proj/web/d', p % 3, '/index.js') AS path", "'javascript' AS file_type", "'' AS content").distinct()
    return python.union(script).union(packages).union(folders)


def project_edges(files: DataFrame) -> DataFrame:
    """source, target, name of all files: parsed, then resolved."""
    python = files.where("file_type = 'python'")
    found = parsers.python_edges(parsers.nodes(python, "python", **parsers.EDGES)).select("path", F.lit("python").alias("file_type"), "target")
    for t in ("javascript",):
        found = found.union(parsers.edges(files.where(F.col("file_type") == t), t).select("path", F.lit(t).alias("file_type"), "target"))
    return filegraph.resolved(found, files, ["/proj"])


_FILES = """f AS (SELECT p_partkey AS p, p_size AS n FROM part),
    file AS (SELECT DISTINCT unnest(['/proj/pkg' || p % 5 || '/m' || p || '.py', '/proj/pkg' || p % 5 || '/__init__.py', '/proj/web/d' || p % 3 || '/s' || p || '.js', '/proj/web/d' || p % 3 || '/index.js']) AS path FROM f),
    w AS (SELECT *, '/proj/pkg' || p % 5 || '/m' || p || '.py' AS py, '/proj/pkg' || p % 5 AS pkg, '/proj/web/d' || p % 3 || '/s' || p || '.js' AS js FROM f),
    may AS (SELECT py AS source, 1 AS edge, 0 AS rank, pkg || '/m' || (CASE WHEN p <= 25 THEN p + 5 ELSE p // 10 * 5 + p % 5 END) || '.py' AS path FROM w UNION ALL SELECT py, 1, 1, pkg || '/__init__.py' FROM w
            UNION ALL SELECT py, 2, 0, '/proj/pkg' || n % 5 || '/m' || n || '.py' FROM w WHERE p % 3 = 0 UNION ALL SELECT py, 2, 1, '/proj/pkg' || n % 5 || '/__init__.py' FROM w WHERE p % 3 = 0
            UNION ALL SELECT py, 3, 0, pkg || '/m' || p // 2 || '.py' FROM w UNION ALL SELECT py, 3, 1, pkg || '/__init__.py' FROM w
            UNION ALL SELECT py, 4, 0, py FROM w WHERE p % 4 = 0
            UNION ALL SELECT js, 5, 0, '/proj/web/d' || p % 3 || '/s' || (CASE WHEN p <= 9 THEN p + 3 ELSE p // 6 * 3 + p % 3 END) || '.js' FROM w
            UNION ALL SELECT js, 6, 0, '/proj/web/d' || n % 3 || '/s' || n || '.js' FROM w UNION ALL SELECT js, 7, 0, '/proj/web/d1/index.js' FROM w WHERE p % 5 = 0),
    e AS (SELECT DISTINCT source, arg_min(path, rank) AS target FROM may JOIN file USING (path) GROUP BY source, edge)"""


def _on_edges(name: str, build, sql: str) -> None:
    def run(spark, sf_dir):
        return build(project_edges(project_files(spark, sf_dir)).select("source", "target").distinct())

    QUERIES[name], ORACLES[name] = run, f"WITH RECURSIVE {_FILES}{sql}"


def _nodes(edges: DataFrame, condition: str) -> DataFrame:
    return edges.select(F.explode(F.array("source", "target")).alias("node")).distinct().where(condition)


_PAIRS = ", r(a, b) AS (SELECT source, target FROM e UNION SELECT r.a, e.target FROM r JOIN e ON e.source = r.b), s AS (SELECT x.a AS node, least(x.a, min(x.b)) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a)"
_on_edges("h01_file_edges", lambda e: e, " SELECT source, target FROM e")
_on_edges("h01_file_out", lambda e: deps.out_edges(e, _nodes(e, "node LIKE '%5.py'")).select("source", "target"), " SELECT source, target FROM e WHERE source LIKE '%5.py'")
_on_edges("h02_file_in", lambda e: deps.in_edges(e, _nodes(e, "node LIKE '%/__init__.py' OR node LIKE '%/index.js'")), " SELECT source, target FROM e WHERE target LIKE '%/__init__.py' OR target LIKE '%/index.js'")
_on_edges("h02_file_cycles", filegraph.cycles, _PAIRS + ", m AS (SELECT component FROM s GROUP BY 1 HAVING count(*) > 1) SELECT component, node FROM s JOIN m USING (component)")
_on_edges(
    "h02_file_reach", lambda e: filegraph.reachable(e, _nodes(e, "node LIKE '%7.py' OR node LIKE '%8.js'")).select("node", "component"),
    _PAIRS + ", g AS (SELECT source AS node FROM e UNION SELECT target FROM e), o AS (SELECT node FROM g WHERE node LIKE '%7.py' OR node LIKE '%8.js'), "
    "t AS (SELECT node FROM o UNION SELECT b FROM r JOIN o ON o.node = r.a) SELECT t.node, coalesce(component, t.node) AS component FROM t LEFT JOIN s USING (node)",
)


# Scripts whose strings, comments, templates and regular expressions look like code


def script_files(spark, sf_dir: str) -> DataFrame:
    rows = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey")
    p, n = (F.col(c).cast("long") for c in ("p_partkey", "p_size"))
    p_text, n_text = p.cast("string"), n.cast("string")
    parts = [
        F.lit('// function fake(a) { if (a) {} }\nconst s'), p_text, F.lit(' = "function no() { return a && b; }"; /* class Hidden {\n} */ const re = /[/}]"{/g;\nfunction outer'), n_text, F.lit("(a, b) {\n"),
        F.repeat(F.lit('  step(a, "if (b) {");\n'), n.cast("int")), F.lit("  if (a && b || s"), p_text, F.lit(') { return `x ${a ? `y${b}` : "}"} {`; }\n}\n'),
        F.when(p % 2 == 1, F.concat(F.lit("class K"), (p % 5).cast("string"), F.lit(" extends B {\n  async m"), (p % 3).cast("string"), F.lit("() { for (;;) { while (re) { go("), p_text, F.lit(" + 10); } } }\n}\n"))).otherwise(""),
        F.when(p % 3 == 0, F.lit("const f = x => x > 77 ? x : go(x).then(a)\n  .then(b).then(c);\n")).otherwise(""),
    ]
    return rows.select(F.concat(F.lit("/web/s"), p_text, F.lit(".js")).alias("path"), F.concat(*parts).alias("content"))


def _on_scripts(name: str, build, sql: str, **want) -> None:
    def run(spark, sf_dir):
        files = script_files(spark, sf_dir)
        return build(files, lexer.syntax(files, **want))

    QUERIES[name] = run
    ORACLES[name] = "WITH s AS (SELECT p_partkey AS p, p_size AS n, '/web/s' || p_partkey || '.js' AS path, p_size + 7 + CASE WHEN p_partkey % 2 = 1 THEN 3 ELSE 0 END AS tail FROM part) " + sql


_UNITS = """SELECT path, 'function' AS kind, 'outer' || n AS name, 4 AS first_line, n + 6 AS last_line FROM s
    UNION ALL SELECT path, 'class', 'K' || p % 5, n + 7, n + 9 FROM s WHERE p % 2 = 1 UNION ALL SELECT path, 'method', 'm' || p % 3, n + 8, n + 8 FROM s WHERE p % 2 = 1
    UNION ALL SELECT path, 'function', 'f', tail, tail + 1 FROM s WHERE p % 3 = 0"""
_on_scripts(
    "c10_lexed_symbols", lambda f, x: lexer.symbols(x).drop("level"),
    _UNITS + " UNION ALL SELECT path, 'variable', 's' || p, 2, 2 FROM s UNION ALL SELECT path, 'variable', 're', 3, 3 FROM s UNION ALL SELECT path, 'variable', 'f', tail, tail FROM s WHERE p % 3 = 0",
    parts=["unit"],
)
_on_scripts(
    "e07_lexed_complexity", lambda f, x: lexer.complexity(x).select("path", "complexity", "most", "functions"),
    "SELECT path, 5 + CASE WHEN p % 2 = 1 THEN 2 ELSE 0 END + CASE WHEN p % 3 = 0 THEN 1 ELSE 0 END AS complexity, 5 AS most, 1 + p % 2 + CASE WHEN p % 3 = 0 THEN 1 ELSE 0 END AS functions FROM s",
    parts=["file"],
)
_on_scripts(
    "d08_lexed_findings", lambda f, x: lexer.findings(x).select("file_path", "line", "pattern_name", "message"),
    """SELECT path AS file_path, 4 AS line, 'large_function' AS pattern_name, 'outer' || n || ' has ' || (n + 3) || ' lines' AS message FROM s WHERE n > 47
    UNION ALL SELECT path, n + 8, 'magic_number', 'Magic number 10' FROM s WHERE p % 2 = 1 UNION ALL SELECT path, n + 8, 'magic_number', 'Magic number ' || p FROM s WHERE p % 2 = 1 AND p > 9
    UNION ALL SELECT path, tail, 'magic_number', 'Magic number 77' FROM s WHERE p % 3 = 0 UNION ALL SELECT path, tail, 'promise_hell', '3 calls of then in a chain' FROM s WHERE p % 3 = 0
    UNION ALL SELECT path, tail, 'missing_error_handling', 'No catch for a promise' FROM s WHERE p % 3 = 0 UNION ALL SELECT path, tail, 'unused_variable', 'Unused variable f' FROM s WHERE p % 3 = 0
    UNION ALL SELECT path, 3, 'unused_variable', 'Unused variable re' FROM s WHERE p % 2 = 0""",
    parts=["finding"],
)
_METHOD = "'  async m' || p % 3 || '() { for (;;) { while (re) { go(' || p || ' + 10); } } }'"
_on_scripts(
    "r01_script_snippets", lambda f, x: lexer.snippets(f, x).select("path", "kind", "name", "first_line", "last_line", F.md5("text").alias("text_md5")),
    f"""SELECT path, CASE WHEN name = 'f' THEN 'arrow' ELSE kind END AS kind, name, first_line, last_line, md5(CASE
        WHEN name = 'f' THEN 'const f = x => x > 77 ? x : go(x).then(a)' || chr(10) || '  .then(b).then(c);'
        WHEN kind = 'function' THEN 'function outer' || n || '(a, b) {{' || chr(10) || repeat('  step(a, "if (b) {{");' || chr(10), n) || '  if (a && b || s' || p || ') {{ return `x ${{a ? `y${{b}}` : "}}"}} {{`; }}' || chr(10) || '}}'
        WHEN kind = 'class' THEN 'class K' || p % 5 || ' extends B {{' || chr(10) || {_METHOD} || chr(10) || '}}'
        ELSE {_METHOD} END) AS text_md5
    FROM ({_UNITS}) JOIN s USING (path)""",
    parts=["unit"],
)


# Three scans of a project that changes between them, and a stream that parses only what changed

_VERSIONS = {1: "true", 2: "p % 5 <> 0", 3: "p % 5 <> 0 or p % 10 = 0"}  # the files that each scan finds
_CHANGED = {1: "1", 2: "if(p % 3 = 0, 2, 1)", 3: "if(p % 10 = 0, 3, if(p % 3 = 0, 2, 1))"}  # the version of each


def _scanned(rows: DataFrame, seq: int) -> DataFrame:
    version = f"cast({_CHANGED[seq]} as string)"
    return rows.where(_VERSIONS[seq]).selectExpr(
        "concat('/src/m', p, '.py') AS path", f"{version} AS file_hash", f"timestamp_seconds({seq}) AS modified", "'python' AS file_type",
        f"concat('import base', n, '\\nimport v', {version}, '_', p, '\\n', repeat('x = 1  # import none\\n', cast(n as int))) AS content",
    )


def incremental_imports(spark, sf_dir: str) -> DataFrame:
    """path, target of the last versions of all modules, after three scans; each stream run parses what one of them changed."""
    rows = spread(table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("p"), F.col("p_size").cast("long").alias("n")), "p")
    root = fresh_folder(spark)

    def analyse(files: DataFrame) -> DataFrame:
        return parsers.python_edges(parsers.nodes(files, "python", **parsers.EDGES)).select("path", "target")

    for seq in _VERSIONS:
        files = _scanned(rows, seq)
        incremental.record(spark, root, files)
        incremental.update(spark, root, lambda changes: files.drop("modified").join(changes.select("path", "file_hash"), ["path", "file_hash"], "left_semi"), analyse, whole_every=2)
    return incremental.current(spark, root)


QUERIES["t01_incremental"] = incremental_imports
ORACLES["t01_incremental"] = """WITH f AS (SELECT p_partkey AS p, p_size AS n, CASE WHEN p_partkey % 10 = 0 THEN 3 WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END AS v FROM part WHERE p_partkey % 5 <> 0 OR p_partkey % 10 = 0)
    SELECT '/src/m' || p || '.py' AS path, 'base' || n AS target FROM f UNION ALL SELECT '/src/m' || p || '.py', 'v' || v || '_' || p FROM f"""
