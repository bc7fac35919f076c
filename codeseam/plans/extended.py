"""Registered queries of readers, converters, reports, trees of other languages, snippets, responses and histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import storage
from ..adapters import ORD, SQL, advisories_v, files_v, findings_v, full_v, packages_v, spread, table, usage_v
from ..functions import text
from ..operators import batching, cachetable, dedup, deps, enrich, findings, patterns, quantiles, stats, usage
from ..schemas import DEBT_BASE, DEBT_FACTOR, EMOJI
from ..sinks import documents, reports
from ..sources import detectors, linters, manifests, parsers, readers, trees
from ..sources import files as scans
from .details import _repeat, _s, _text, python_code, script_code

QUERIES: dict = {}
ORACLES: dict = {}
_VIEWS = {"findings_v": findings_v, "full_v": full_v, "usage_v": usage_v, "files_v": files_v}
_PART = "WITH part_v AS (SELECT p_partkey AS p, p_size AS n, CAST(p_partkey AS VARCHAR) AS path FROM part) "
_DEBT = (
    "floor((CASE severity " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in DEBT_BASE.items()) + " END)::DOUBLE * (CASE finding_type "
    + " ".join(f"WHEN '{k}' THEN {v}" for k, v in DEBT_FACTOR.items()) + " ELSE 1.0 END)::DOUBLE * confidence * 100 + 0.5) / 100"
)
_TITLE = "array_to_string([upper(left(w, 1)) || lower(substr(w, 2)) FOR w IN string_split(replace({0}, '_', ' '), ' ')], ' ')"
_ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN extract('microsecond' FROM {0}) % 1000000 <> 0 THEN strftime({0}, '.%f') ELSE '' END"
_ID = "substr(sha256(concat_ws(':', finding_type, file_path, coalesce(CAST(line_start AS VARCHAR),'None'), title, coalesce(rule_id,'None'))), 1, 16)"


def on(view: str, name: str, build, sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(_VIEWS[view](spark, sf_dir))
    if sql:
        ORACLES[name] = f"WITH {SQL[view]}{'' if sql.lstrip().startswith(',') else ' '}{sql}"


def written(name: str, source, build, sql: str) -> None:
    """A query over texts that ``source`` writes from part's rows (p: key, n: size of 1 to 50)."""

    def run(spark, sf_dir):
        rows = spread(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("p"), F.col("p_size").alias("n")), "p")
        return build(rows.select(F.col("p").cast("string").alias("path"), source().alias("content")))

    QUERIES[name], ORACLES[name] = run, _PART + sql


def both(name: str, build, sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(packages_v(spark, sf_dir), advisories_v(spark, sf_dir))
    ORACLES[name] = f"WITH {SQL['packages_v']}, {SQL['advisories_v']} {sql}"


def tree(kind: str, build, want: dict = {}):
    return lambda files: build(parsers.nodes(files, kind, **want))


# Python: fallbacks for broken files, imports, exports, metrics, rules


def broken_code():
    return _text("import m", _s("n"), "\n  from .q", _s("p % 3"), " import z\nv", _s("p"), " = 1\nasync def f", _s("n"), "(a):\n  w == 1\nclass C", _s("p % 5"), "(B):\nif x ==\n")


written("c02_recovered_edges", broken_code, tree("python", lambda t: parsers.python_edges(t).select("path", "target", "line", "is_relative", "is_external")), "SELECT path, 'm' || n AS target, 1 AS line, false AS is_relative, true AS is_external FROM part_v UNION ALL SELECT path, '.q' || (p % 3), 2, true, false FROM part_v")
written("c04_recovered_symbols", broken_code, tree("python", parsers.python_symbols), "SELECT path, 'variable' AS kind, 'v' || p AS name FROM part_v UNION ALL SELECT path, 'function', 'f' || n FROM part_v UNION ALL SELECT path, 'class', 'C' || (p % 5) FROM part_v")


def module_code():
    return _text(
        "import os.path, a", _s("n"), "\nfrom . import b\nfrom .c import d\nfrom e", _s("p % 4"), ".f import g\n__all__ = ['x", _s("p"), "', 'y', 3]\n# note\ndef x", _s("p"), "(q):\n    try:\n        return q and not n or s\n"
        "    except ValueError:\n        with q as r:\n            pass\n\nclass K:\n", _repeat("n % 30", "concat('    a', i, ' = ', i, '\\n')"), "    b = 1\n",
    )


written("c06_python_imports", module_code, tree("python", parsers.python_imports, parsers.IMPORTS), "SELECT path, unnest(['os.path', 'a' || n, 'c', 'e' || (p % 4) || '.f']) AS module FROM part_v")
written("c07_python_exports", module_code, tree("python", parsers.python_exports, parsers.EXPORTS), "SELECT path, unnest(['x' || p, 'y']) AS name FROM part_v")
written("c08_external", module_code, tree("python", lambda t: parsers.python_edges(t).select("path", "target", "is_external", parsers.is_standard(F.col("target"), "python").alias("is_standard")), parsers.EDGES), "SELECT path, e.t AS target, e.x AS is_external, e.t = 'os.path' AS is_standard FROM part_v, unnest([struct_pack(t := 'os.path', x := true), struct_pack(t := 'a' || n, x := true), struct_pack(t := '.b', x := false), struct_pack(t := '.c.d', x := false), struct_pack(t := 'e' || (p % 4) || '.f.g', x := true)]) u(e)")
written("e02_all_branches", module_code, tree("python", parsers.python_complexity, parsers.COMPLEXITY), "SELECT path, CAST(1 + 1 + 1 + 1 + 1 AS BIGINT) AS complexity FROM part_v")
written("e03_python_metrics", lambda: F.when(F.expr("p % 7 = 0"), broken_code()).otherwise(module_code()), parsers.python_metrics, """SELECT path, CASE WHEN p % 7 <> 0 THEN 13 + n % 30 END::BIGINT AS loc, CASE WHEN p % 7 <> 0 THEN 1 END::BIGINT AS functions, CASE WHEN p % 7 <> 0 THEN 1 END::BIGINT AS classes, CASE WHEN p % 7 <> 0 THEN 4 END::BIGINT AS imports,
    CASE WHEN p % 7 <> 0 THEN 5 END::BIGINT AS complexity, CASE WHEN p % 7 = 0 THEN 7 END::BIGINT AS total_lines FROM part_v""")
written("d04_god_class_by_attributes", module_code, tree("python", lambda t: parsers.god_classes(t).select("file_path", "message"), parsers.GOD_CLASSES), "SELECT path AS file_path, 'K does too much' AS message FROM part_v WHERE n % 30 + 1 > 15")
written("d07_duplicate_code", lambda: _text("def a(x):\n    \"\"\"d\"\"\"\n    y = x\n    if y:\n        pass\n    y = 1\n    return y\n\ndef b", _s("p"), "(x):\n    z = 2\n    if x:\n        z = 3\n    z = 4\n", F.expr("if(n % 2 = 0, '    return z\\n', '    z()\\n')")), lambda f: parsers.structural_findings(f).where("pattern_name = 'duplicate_code'").select("file_path", "line", "message"), "SELECT path AS file_path, 9 AS line, 'b' || p || ' is built as a' AS message FROM part_v WHERE n % 2 = 0")
written("d14_analysis_errors", lambda: F.when(F.expr("p % 3 = 0"), _text("x = (", _s("n"))).otherwise(_text("x = ", _s("n"))), lambda f: parsers.structural_findings(f).select("file_path", "pattern_name", "severity", F.substring_index("message", ":", 1).alias("start")), "SELECT path AS file_path, 'analysis_error' AS pattern_name, 'error' AS severity, 'Analysis failed' AS start FROM part_v WHERE p % 3 = 0")


def _mixed(f):
    """Every other file is a script."""
    return f.withColumn("file_type", F.when(F.col("path").cast("long") % 2 == 0, "python").otherwise("javascript"))


_MIXED_RULES = ["singleton", "promise_hell", "missing_error_handling", "callback_hell", "unused_variable", "factory_method"]
_MIXED = """SELECT path AS file_path, 'singleton' AS pattern_name FROM part_v WHERE p % 2 = 0 AND p % 3 = 0 UNION ALL SELECT path, 'factory_method' FROM part_v WHERE p % 2 = 0
    UNION ALL SELECT path, 'promise_hell' FROM part_v WHERE p % 2 = 1 AND n % 5 > 2 UNION ALL SELECT path, 'missing_error_handling' FROM part_v WHERE p % 2 = 1 AND n % 5 > 0 AND 4 < 7 + n % 10 - 5
    UNION ALL SELECT path, 'callback_hell' FROM part_v WHERE p % 2 = 1 AND n > 16 UNION ALL SELECT path, 'unused_variable' FROM part_v WHERE p % 2 = 1"""
written("d16_detect", lambda: F.when(F.expr("p % 2 = 0"), python_code()).otherwise(script_code()), lambda f: detectors.detect(_mixed(f), _MIXED_RULES).select("file_path", "pattern_name"), _MIXED)
written("d15_rules", lambda: F.when(F.expr("p % 2 = 0"), python_code()).otherwise(script_code()), lambda f: detectors.detect(_mixed(f), _MIXED_RULES, ["singleton", "callback_hell"]).select("file_path", "pattern_name"), f"SELECT * FROM ({_MIXED}) WHERE pattern_name NOT IN ('singleton', 'callback_hell')")
written("c35_dispatch", lambda: F.when(F.expr("p % 2 = 0"), python_code()).otherwise(_text('{"a": {"b', _s("n"), '": [1]}}')), lambda f: trees.parse(_mixed(f).withColumn("file_type", F.replace("file_type", F.lit("javascript"), F.lit("json"))), ["ImportFrom", "array"], columns=["path", "node_type", "name", "key_path"]).where("node_type in ('ImportFrom', 'array')").select("path", "node_type", "name", "key_path"), "SELECT path, 'ImportFrom' AS node_type, 'pkg' || (n % 7) AS name, NULL::VARCHAR AS key_path FROM part_v WHERE p % 2 = 0 UNION ALL SELECT path, 'array', 'b' || n, 'a.b' || n FROM part_v WHERE p % 2 = 1")


# scripts


def long_script():
    return _text("function a(x) {\n", _repeat("n", "'  if (x) { y(i) } else { for (;;) { while (z && w || v) { s ? t : u } } }\\n'"), _repeat("n", "'\\n'"), "}\nconst b", _s("p"), " = () => {\n}\n")


written("e07_script_complexity", long_script, text.js_complexity, "SELECT path, CAST(1 + 7 * n AS BIGINT) AS complexity FROM part_v")
written("d09_function_gaps", long_script, lambda f: text.gaps(text.lines(f), r"function\s+\w+|=>\s*\{", 50).select("path", "line_no", "gap"), "SELECT path, 1 AS line_no, CAST(2 * n + 2 AS INT) AS gap FROM part_v WHERE 2 * n + 2 > 50")
written("c11_script_imports", lambda: _text("import {\n  a } from './m", _s("p % 6"), "'\nimport b from \"c\"\nimport('d", _s("n"), "')\nrequire( 'e' ); require('e')\n"), parsers.script_imports, "SELECT path, unnest(['c', 'd' || n, 'e']) AS module FROM part_v")
written("c12_script_exports", lambda: _text("export function f", _s("p"), "() {}\nexport { a, b", _s("n"), " , c }\nexport default function G() {}\nexport const k = 1\nexport default h\n"), parsers.script_exports, "SELECT path, unnest(['f' || p, 'a', 'b' || n, 'c', 'G', 'k', 'h']) AS name FROM part_v")
written("c13_node_modules", lambda: _text("require('fs')\nrequire('./a", _s("p"), "')\nrequire('@s/b", _s("n"), "/c/d')\nrequire('lodash')\n"), lambda f: parsers.edges(f, "javascript").select("path", "target", "is_external", parsers.is_standard(F.col("target"), "javascript").alias("is_standard")), "SELECT path, e.t AS target, e.x AS is_external, e.t = 'fs' AS is_standard FROM part_v, unnest([struct_pack(t := 'fs', x := true), struct_pack(t := './a' || p, x := false), struct_pack(t := '@s/b' || n || '/c/d', x := false), struct_pack(t := 'lodash', x := true)]) u(e)")


# pages, keys, manifests, notes


def page_code():
    return _text(
        "<html><head><link rel='preload stylesheet' href='s", _s("p % 5"), ".css'><link rel=icon href=i.png><script src='//cdn/x", _s("n"), ".js'></script></head><body id=top class='a  b", _s("p % 3"), "'>"
        "<img src=p.png><video><source src='m.mp4'><track src='t.vtt'></video><embed src='e.swf'><object data='o.pdf'></object><script>function f", _s("p"), "() {} g = function(a) {}; var o = { h: function() {} }</script></body></html>",
    )


written("c16_page_edges", page_code, tree("html", lambda t: parsers.page_edges(t).select("path", "kind", "target", "is_external")), """SELECT path, e.k AS kind, e.t AS target, starts_with(e.t, '//') AS is_external FROM part_v, unnest([struct_pack(k := 'stylesheet', t := 's' || (p % 5) || '.css'), struct_pack(k := 'resource', t := 's' || (p % 5) || '.css'),
    struct_pack(k := 'resource', t := 'i.png'), struct_pack(k := 'script', t := '//cdn/x' || n || '.js'), struct_pack(k := 'image', t := 'p.png'), struct_pack(k := 'media', t := 'm.mp4'), struct_pack(k := 'track', t := 't.vtt'), struct_pack(k := 'embed', t := 'e.swf'), struct_pack(k := 'object', t := 'o.pdf')]) u(e)""")
written("c18_page_symbols", page_code, tree("html", parsers.page_symbols), "SELECT path, 'class' AS kind, unnest(['a', 'b' || (p % 3)]) AS name FROM part_v UNION ALL SELECT path, 'variable', 'top' FROM part_v UNION ALL SELECT path, 'function', unnest(['f' || p, 'g', 'h']) FROM part_v")
written("c20_script_functions", page_code, lambda f: parsers.html_symbols(f).where("kind = 'function'").select("path", "name"), "SELECT path, unnest(['f' || p, 'g', 'h']) AS name FROM part_v")
written("c21_page_tree", page_code, tree("html", lambda t: t.groupBy("path", "node_type").agg(F.count("*").alias("n"), F.max("depth").alias("depth"))), "SELECT path, e.t AS node_type, e.n::BIGINT AS n, e.d AS depth FROM part_v, unnest([struct_pack(t := 'html', n := 1, d := 0), struct_pack(t := 'head', n := 1, d := 1), struct_pack(t := 'link', n := 2, d := 2), struct_pack(t := 'script', n := 2, d := 2), struct_pack(t := 'body', n := 1, d := 1), struct_pack(t := 'img', n := 1, d := 2), struct_pack(t := 'video', n := 1, d := 2), struct_pack(t := 'source', n := 1, d := 3), struct_pack(t := 'track', n := 1, d := 3), struct_pack(t := 'embed', n := 1, d := 2), struct_pack(t := 'object', n := 1, d := 2)]) u(e)")
written("c25_package_edges", lambda: _text('{"dependencies":{"a', _s("p"), '":"1"},"peerDependencies":{"b":"2"},"bundledDependencies":["c"],"optionalDependencies":{"d', _s("n"), '":"*"},"imports":{"#x":{"node":"y"},"./z":"w"}}'), parsers.package_edges, "SELECT path, e.k AS kind, e.t AS target, e.t <> './z' AS is_external FROM part_v, unnest([struct_pack(k := 'dependencies', t := 'a' || p), struct_pack(k := 'peerDependencies', t := 'b'), struct_pack(k := 'optionalDependencies', t := 'd' || n), struct_pack(k := 'import', t := '#x'), struct_pack(k := 'import', t := './z')]) u(e)")
written("c26_deep_keys", lambda: _text('{"a":{"b', _s("p"), '":1},"c":[{"d":2},[{"e', _s("n"), '":[]}]]}'), tree("json", parsers.key_paths), "SELECT path, unnest(['a', 'a.b' || p, 'c', 'c[0].d', 'c[1][0].e' || n]) AS key FROM part_v")
written("c27_loose_keys", lambda: F.when(F.expr("p % 2 = 0"), _text('{"a', _s("p"), "\": 1, 'b': [}")).otherwise(_text('{"k', _s("n"), '": 1}')), lambda f: parsers.keys(f, "json"), "SELECT path, unnest(['a' || p, 'b']) AS key FROM part_v WHERE p % 2 = 0 UNION ALL SELECT path, 'k' || n FROM part_v WHERE p % 2 = 1")
written("c28_json_tree", lambda: _text('{"a":[1,null,"x', _s("p"), '",{"b":true}]}'), tree("json", lambda t: t.select("path", "node_type", "key_path", "depth", "value")), "SELECT path, e.t AS node_type, e.k AS key_path, e.d AS depth, e.v AS value FROM part_v, unnest([struct_pack(t := 'object', k := '', d := 0, v := NULL), struct_pack(t := 'array', k := 'a', d := 1, v := NULL), struct_pack(t := 'int', k := 'a[0]', d := 2, v := '1'), struct_pack(t := 'null', k := 'a[1]', d := 2, v := 'null'), struct_pack(t := 'str', k := 'a[2]', d := 2, v := 'x' || p), struct_pack(t := 'object', k := 'a[3]', d := 2, v := NULL), struct_pack(t := 'bool', k := 'a[3].b', d := 3, v := 'True')]) u(e)")
written("c29_yaml_edges", lambda: _text("services:\n  web:\n    image: repo/w", _s("n"), "\n    build: ./d", _s("p % 3"), "\n  db:\n    build:\n      context: ../e\nspec:\n  containers:\n    - image: c", _s("p"), "\njobs:\n  j:\n    uses: o/r@v", _s("n % 4"), "\n    steps:\n      - uses: a/b@v1\n      - run: x\n"), tree("yaml", lambda t: parsers.yaml_edges(t).select("path", "kind", "target"), parsers.YAML_EDGES), "SELECT path, e.k AS kind, e.t AS target FROM part_v, unnest([struct_pack(k := 'docker_image', t := 'repo/w' || n), struct_pack(k := 'build_context', t := './d' || (p % 3)), struct_pack(k := 'build_context', t := '../e'), struct_pack(k := 'container_image', t := 'c' || p), struct_pack(k := 'github_action', t := 'o/r@v' || (n % 4)), struct_pack(k := 'github_action', t := 'a/b@v1')]) u(e)")


def list_notes():
    return _text("# Top ", _s("n"), "\n- one\n- two\n  - deep\n\n1. first\n2. second\n[go](u", _s("p % 5"), ")\n```py\n- no\n```\n## Sub\ncall `run", _s("p % 4"), "(1)` here\n")


written("c34_note_tree", list_notes, tree("markdown", lambda t: t.select("path", "node_type", "parent_type", "name", "line")), """SELECT path, e.t AS node_type, e.p AS parent_type, e.n AS name, e.l AS line FROM part_v, unnest([struct_pack(t := 'document', p := NULL, n := 'root', l := NULL), struct_pack(t := 'header_1', p := 'document', n := 'Top ' || part_v.n, l := 1), struct_pack(t := 'list', p := 'header_1', n := 'list_indent_0', l := 2),
    struct_pack(t := 'list_item', p := 'list', n := 'one', l := 2), struct_pack(t := 'list_item', p := 'list', n := 'two', l := 3), struct_pack(t := 'list', p := 'header_1', n := 'list_indent_2', l := 4), struct_pack(t := 'list_item', p := 'list', n := 'deep', l := 4),
    struct_pack(t := 'numbered_list', p := 'header_1', n := 'numbered_list_indent_0', l := 6), struct_pack(t := 'numbered_item', p := 'numbered_list', n := 'first', l := 6), struct_pack(t := 'numbered_item', p := 'numbered_list', n := 'second', l := 7),
    struct_pack(t := 'link', p := 'header_1', n := 'go', l := 8), struct_pack(t := 'code_block', p := 'document', n := 'py', l := 9), struct_pack(t := 'header_2', p := 'document', n := 'Sub', l := 12)]) u(e)""")
written("c33_note_symbols_all", list_notes, parsers.markdown_symbols, "SELECT path, 'variable' AS kind, unnest(['h1-top-' || n, 'h2-sub']) AS name FROM part_v UNION ALL SELECT path, 'class', 'code-py' FROM part_v UNION ALL SELECT path, 'function', 'run' || (p % 4) FROM part_v")

# manifests, registries, linters


def _tree_of(f):
    """Manifests at several places of a tree."""
    places = ["", "a/", "a/b/", "a/b/c/", "node_modules/x/", "vendor/"]
    names = ["package.json", "Requirements.txt", "Pipfile", "readme.md"]
    where = F.element_at(F.array(*map(F.lit, places)), (F.col("path").cast("long") % 6 + 1).cast("int"))
    name = F.element_at(F.array(*map(F.lit, names)), (F.col("path").cast("long") % 4 + 1).cast("int"))
    return f.withColumn("path", F.concat(F.lit("/data/build/proj/"), where, name))


written("a12_manifests", lambda: _s("p"), lambda f: manifests.discover(_tree_of(f), root="/data/build/proj").groupBy("path").agg(F.count("*").alias("n")), "SELECT '/data/build/proj/' || d || b AS path, count(*) AS n FROM (SELECT ['', 'a/', 'a/b/', 'a/b/c/', 'node_modules/x/', 'vendor/'][p % 6 + 1] AS d, ['package.json', 'Requirements.txt', 'Pipfile', 'readme.md'][p % 4 + 1] AS b, p FROM part_v) WHERE p % 6 < 3 AND p % 4 < 3 GROUP BY 1")
written("a14_requirement_packages", lambda: _text("pkg", _s("p"), "==1.", _s("n"), "\n# c==1\nnumpy\na[b]==2\nextra>=2.", _s("n"), " ; x\npkg", _s("p"), "~=3"), lambda f: manifests.packages(f.withColumn("path", F.concat("path", F.lit("/requirements.txt")))).select("manager", "package", "version", "dev", "error"), "SELECT 'pip' AS manager, 'pkg' || p AS package, '~=3' AS version, false AS dev, NULL::VARCHAR AS error FROM part_v UNION ALL SELECT 'pip', 'extra', '>=2.' || n || ' ; x', false, NULL FROM part_v")
written("a18_npm_registry", lambda: _text('{"name":"pkg', _s("p"), '","license":', F.expr("if(n % 2 = 0, '\"MIT\"', '{\"type\":\"ISC\"}')"), ',"description":"d', _s("n"), '","dependencies":{"z":"1","b', _s("p % 3"), '":"2"}}'), lambda f: manifests.npm_registry(f.select(F.col("content").alias("json"))).select("package", "licence", "description", F.array_join("dependencies", ",").alias("dependencies")), "SELECT 'pkg' || p AS package, CASE WHEN n % 2 = 0 THEN 'MIT' ELSE 'ISC' END AS licence, 'd' || n AS description, 'b' || (p % 3) || ',z' AS dependencies FROM part_v")
written("a19_pypi_registry", lambda: _text('{"info":{"name":"pkg', _s("p"), '","license":"L', _s("n % 4"), '","summary":"s"}}'), lambda f: manifests.pypi_registry(f.select(F.col("content").alias("json"))), "SELECT 'pkg' || p AS package, 'L' || (n % 4) AS licence, 's' AS description FROM part_v")
written("a20_ecosystems", lambda: _text('{"id":"A', _s("p"), '","database_specific":{"severity":"HIGH"},"affected":[{"package":{"ecosystem":"', F.expr("if(p % 2 = 0, 'PyPI', 'npm')"), '","name":"pkg', _s("n"), '"},"ranges":[{"events":[{"introduced":"0"}]}]}]}'), lambda f: manifests.advisories_for(f.select(F.element_at(F.array(*map(F.lit, ["pip", "npm", "poetry"])), (F.col("path").cast("long") % 3 + 1).cast("int")).alias("manager"), F.concat(F.lit("pkg"), F.col("path")).alias("package")), manifests.advisories(f.select(F.col("content").alias("json")))).groupBy("manager", "package").agg(F.count("*").alias("n"), F.max("severity").alias("severity")), "SELECT a.m AS manager, 'pkg' || a.p AS package, count(*) AS n, 'HIGH' AS severity FROM (SELECT ['pip', 'npm', 'poetry'][p % 3 + 1] AS m, p FROM part_v) a JOIN part_v b ON a.p = b.n AND ((a.m = 'pip' AND b.p % 2 = 0) OR (a.m = 'npm' AND b.p % 2 = 1)) GROUP BY 1, 2")
written("a23_pylint_objects", lambda: _text('{"issues":[{"type":"', F.expr("element_at(array('convention','refactor','error','odd'), cast(p % 4 + 1 as int))"), '","path":"f.py","line":', _s("n"), ',"message-id":"X1","message":"m"}]}'), lambda f: linters.pylint_json(f.select(F.col("content").alias("json"))).groupBy("pattern_type", "level", "rule").agg(F.sum("line").alias("lines")), "SELECT ['design_pattern', 'code_smell', 'anti_pattern', 'code_smell'][p % 4 + 1] AS pattern_type, ['info', 'warning', 'error', 'info'][p % 4 + 1] AS level, 'X1' AS rule, CAST(sum(n) AS BIGINT) AS lines FROM part_v GROUP BY ALL")
written("a24_eslint_rules", lambda: _text('[{"filePath":"/r/src/f', _s("p"), '.js","messages":[{"ruleId":"', F.expr("element_at(array('no-var','prefer-const','eqeqeq'), cast(p % 3 + 1 as int))"), '","severity":', _s("n % 3"), ',"message":"m","line":1,"column":2}]}]'), lambda f: linters.eslint_json(f.select(F.col("content").alias("json")), "/r").select("file_path", "rule", "severity", "pattern_type"), "SELECT 'src/f' || p || '.js' AS file_path, ['no-var', 'prefer-const', 'eqeqeq'][p % 3 + 1] AS rule, CASE n % 3 WHEN 2 THEN 'error' WHEN 1 THEN 'warning' ELSE 'info' END AS severity, ['anti_pattern', 'design_pattern', 'code_smell'][p % 3 + 1] AS pattern_type FROM part_v")
written("a25_eslint_lines", lambda: _text("  ", _s("n"), ":", _s("p % 9"), ":  ", F.expr("if(p % 2 = 0, 'error', 'warning')"), "  Unexpected var x", _s("p"), "  no-var"), lambda f: linters.eslint_lines(f.withColumnRenamed("content", "line")), "SELECT n AS line, CAST(p % 9 AS INT) AS \"column\", CASE WHEN p % 2 = 0 THEN 'error' ELSE 'warning' END AS severity, 'no-var' AS rule, 'Unexpected var x' || p AS message, 'anti_pattern' AS pattern_type FROM part_v")
written("q04_linter_adapters", lambda: _text("a.py:", _s("n"), ":5: E501 too long"), lambda f: findings.from_linter(linters.read("flake8", f.withColumnRenamed("content", "line")), "flake8").groupBy("line_start", "rule_id", "severity").agg(F.count("*").alias("n"), F.first(F.array_join("tags", ",")).alias("tags")), "SELECT n AS line_start, 'E501' AS rule_id, 'medium' AS severity, count(*) AS n, 'flake8,linter' AS tags FROM part_v GROUP BY 1")

# readers
written("a29_findings_json", lambda: _text('{"title":"t', _s("p"), '","severity":"', F.expr("if(p % 5 = 0, 'odd', 'high')"), '","location":{"file_path":"f', _s("n"), '.py","line_start":', _s("n"), '},"tags":["b","a"],"detected_at":"2024-01-0', _s("p % 9 + 1"), 'T10:00:00"}'), lambda f: readers.findings_from(f.select(F.col("content").alias("json"))).select("title", "severity", "finding_type", "source", "file_path", "line_start", "confidence", "impact", F.array_join("tags", ",").alias("tags"), F.date_format("detected_at", "yyyy-MM-dd HH").alias("at"), "error"), "SELECT 't' || p AS title, CASE WHEN p % 5 = 0 THEN NULL ELSE 'high' END AS severity, 'other' AS finding_type, 'static_analyzer' AS source, 'f' || n || '.py' AS file_path, n AS line_start, 1.0::DOUBLE AS confidence, 'medium' AS impact, 'b,a' AS tags, '2024-01-0' || (p % 9 + 1) || ' 10' AS at, CASE WHEN p % 5 = 0 THEN 'unknown severity odd' END AS error FROM part_v")
written("a30_tolerant", lambda: F.when(F.expr("p % 2 = 0"), _text('{"a":', _s("n"), "}")).otherwise(_text("{broken")), lambda f: readers.tolerant(f.select(F.col("content").alias("json")), "a long").select("a"), "SELECT CASE WHEN p % 2 = 0 THEN n END::BIGINT AS a FROM part_v")
written("a31_history", lambda: _text('{"usage_history":[{"timestamp":"2024-01-01T00:00:0', _s("p % 10"), '","model":"m', _s("n % 3"), '","input_tokens":', _s("n"), ',"output_tokens":1,"cost":0.5,"request_type":"r","duration":1.5,"success":true}]}'), lambda f: usage.history_from(f.select(F.col("content").alias("json"))).groupBy("model", "timestamp", "success").agg(F.sum("input_tokens").alias("n"), F.sum("cost").alias("cost"), F.count("error_message").alias("errors")), "SELECT 'm' || (n % 3) AS model, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(p % 10) AS timestamp, true AS success, CAST(sum(n) AS BIGINT) AS n, sum(0.5::DOUBLE) AS cost, 0::BIGINT AS errors FROM part_v GROUP BY 1, 2")

# model responses


def response():
    one = '"confidence":0.5,"file_path":"f.py","line_start":1,"line_end":2,"description":"d","evidence":["e"],"severity":"warning","impact":"low","effort":"low"'
    return _text("```json\n{\"design_patterns\":[{\"pattern_type\":\"singleton\",", one, ",\"benefits\":[\"x", _s("p"), "\"]}],\"anti_patterns\":[{\"pattern_type\":\"", F.expr("if(n % 2 = 0, 'god_object', 'unheard_of')"), "\",", one, ",\"solutions\":[\"s\",\"t", _s("n"), "\"]},{\"pattern_type\":\"long_method\"}],\"code_quality_issues\":[{\"pattern_type\":\"performance_issue\",", one, "}]}\n```")


def _responses(f):
    return patterns.parse_responses(f.select(F.col("path").alias("batch_id"), F.col("content").alias("response")))


written("f10_responses", response, lambda f: _responses(f).select("batch_id", "pattern_type", "category", F.array_join("benefits", ",").alias("benefits"), F.array_join("solutions", ",").alias("solutions")), "SELECT path AS batch_id, 'singleton' AS pattern_type, 'design_pattern' AS category, 'x' || p AS benefits, '' AS solutions FROM part_v UNION ALL SELECT path, 'god_object', 'anti_pattern', '', 's,t' || n FROM part_v WHERE n % 2 = 0 UNION ALL SELECT path, 'performance_issue', 'quality_issue', '', '' FROM part_v")
written("f05_anti_patterns", response, lambda f: findings.from_pattern(_responses(f).where("category = 'anti_pattern'"), "anti_pattern").groupBy("title", "severity", "suggestion", "message", "effort_to_fix").agg(F.count("*").alias("n")), "SELECT 'Anti-Pattern: God Object' AS title, 'medium' AS severity, 's; t' || n AS suggestion, 'Anti-pattern detected: god_object' AS message, 'low' AS effort_to_fix, count(*) AS n FROM part_v WHERE n % 2 = 0 GROUP BY 3")
written("f06_quality_issues", response, lambda f: findings.from_pattern(_responses(f).where("category = 'quality_issue'"), "quality_issue").groupBy("finding_type", "title", "severity", F.array_join("tags", ",").alias("tags")).agg(F.count("*").alias("n")), "SELECT 'performance_issue' AS finding_type, 'Code Quality: Performance Issue' AS title, 'medium' AS severity, 'ai-detected,code-quality' AS tags, count(*) AS n FROM part_v")
written("i20_response_summary", response, lambda f: patterns.summary(_responses(f)), "SELECT count(*) * 2 + count(*) FILTER (n % 2 = 0) AS total_patterns, count(*) AS design_patterns_count, count(*) FILTER (n % 2 = 0) AS anti_patterns_count, count(*) AS code_quality_issues_count, 0::BIGINT AS critical_issues, 0::BIGINT AS high_issues, count(*) * 2 + count(*) FILTER (n % 2 = 0) AS medium_issues, 0::BIGINT AS low_issues FROM part_v")
written("g06_patterns_of", response, lambda f: patterns.of_file(patterns.of_severity(_responses(f), "warning"), "f.py").select("batch_id", "pattern_type"), "SELECT path AS batch_id, unnest(CASE WHEN n % 2 = 0 THEN ['singleton', 'god_object', 'performance_issue'] ELSE ['singleton', 'performance_issue'] END) AS pattern_type FROM part_v")
written("b15_pattern_sections", response, lambda f: patterns.sections(_responses(f)).select("category", F.md5("section").alias("section_md5")), "SELECT 'design_pattern' AS category, md5('### Singleton' || chr(10) || chr(10) || '- **File**: `f.py`' || chr(10) || '- **Lines**: 1-2' || chr(10) || '- **Confidence**: 0.50' || chr(10) || '- **Description**: d' || chr(10) || '- **Benefits**: x' || p) AS section_md5 FROM part_v UNION ALL SELECT 'anti_pattern', md5('### God Object (WARNING)' || chr(10) || chr(10) || '- **File**: `f.py`' || chr(10) || '- **Lines**: 1-2' || chr(10) || '- **Confidence**: 0.50' || chr(10) || '- **Description**: d' || chr(10) || '- **Problems**: ' || chr(10) || '- **Solutions**: s, t' || n) FROM part_v WHERE n % 2 = 0")
written("b15_pattern_rows", response, lambda f: patterns.export_rows(_responses(f)).groupBy(*patterns.EXPORT).agg(F.count("*").alias("rows")), "SELECT t AS pattern_type, 0.5::DOUBLE AS confidence, 'f.py' AS file_path, 1 AS line_start, 2 AS line_end, 'd' AS description, 'warning' AS severity, 'low' AS impact, 'low' AS effort, c AS category, count(*) AS rows FROM (SELECT 'singleton' AS t, 'design_pattern' AS c FROM part_v UNION ALL SELECT 'god_object', 'anti_pattern' FROM part_v WHERE n % 2 = 0 UNION ALL SELECT 'performance_issue', 'quality_issue' FROM part_v) GROUP BY ALL")
written("n19_json_objects", lambda: _text('say {x} {"a": ', _s("p"), '} and {"b": {"c": "', _s("n"), '"}} then {"d'), lambda f: f.select("path", F.posexplode(patterns.json_objects("content")).alias("at", "object")), "SELECT path, 0 AS at, '{\"a\": ' || p || '}' AS object FROM part_v UNION ALL SELECT path, 1, '{\"b\": {\"c\": \"' || n || '\"}}' FROM part_v")
written("h07_batch_results", lambda: _s("n"), lambda f: batching.with_batch(f.select(F.col("path").alias("batch_id"), "content"), f.where("path % 3 <> 0").select(F.col("path").alias("batch_id"), F.col("content").cast("long").alias("tokens")).union(f.select("path", F.lit(1000).cast("long")))), "SELECT path AS batch_id, CAST(n AS VARCHAR) AS content, CASE WHEN p % 3 <> 0 THEN n ELSE 1000 END::BIGINT AS tokens FROM part_v")
written("r08_analysed", lambda: _text("x", _s("n")), lambda f: batching.analysed(f.withColumnRenamed("path", "batch_id"), _model).select("batch_id", "response", "error"), "SELECT path AS batch_id, CASE WHEN n % 10 <> 0 THEN upper('x' || n) END AS response, CASE WHEN n % 10 = 0 THEN 'no answer' END AS error FROM part_v")


def _model(prompt: str) -> str:
    """Stands for a model: some prompts always fail."""
    if prompt.endswith("0"):
        raise RuntimeError("no answer")
    return prompt.upper()


# findings: filters, numbering, enrichment, reports
on("findings_v", "g01_by_source", lambda f: findings.of_source(f, "linter").select("ingest_seq"), "SELECT ingest_seq FROM findings_v WHERE source = 'linter'")
on("files_v", "g05_files", lambda f: scans.of_type(f.withColumn("file_type", F.element_at(F.split("path", "/"), 3)), "en").select("path"), "SELECT path FROM files_v WHERE string_split(path, '/')[3] = 'en'")
on("files_v", "g08_shown_tree", lambda f: scans.shown_tree(f.withColumn("path", F.concat(F.when(F.col("doc_id") % 4 == 0, "/.hid").otherwise(""), "path")), ["src1", "/nope"]).where("depth = 3 or depth = 1").select("path", "depth", "is_excluded"), "SELECT DISTINCT CASE WHEN d = 1 THEN split_part(path, '/', 2) ELSE substr(path, 2) END AS path, d AS depth, contains(CASE WHEN d = 1 THEN split_part(path, '/', 2) ELSE path END, 'src1') AS is_excluded FROM files_v, unnest([1, 3]) u(d) WHERE doc_id % 4 <> 0")
both("g10_views", lambda p, a: deps.only("licenses", p, a), "SELECT licence, count(*) AS n, count(DISTINCT package) AS packages FROM packages_v WHERE licence IS NOT NULL GROUP BY 1")
on("files_v", "g11_languages", lambda f: findings.of_language(f.withColumn("path", F.concat("path", F.lit("."), F.element_at(F.array(*map(F.lit, ["PY", "tsx", "rb", "zip"])), (F.col("doc_id") % 4 + 1).cast("int")))), ["python", "ruby"]).select("path"), "SELECT path || CASE doc_id % 4 WHEN 0 THEN '.PY' ELSE '.rb' END AS path FROM files_v WHERE doc_id % 4 IN (0, 2)")
on("findings_v", "k01_numbered", lambda f: findings.numbered(f.select("file_path", "detected_at", F.col("ingest_seq").alias("was")), ["file_path", "detected_at", "was"], "at", 16), "SELECT file_path, detected_at, ingest_seq AS was, row_number() OVER (ORDER BY file_path, detected_at, ingest_seq) - 1 AS at FROM findings_v")
on("findings_v", "f08_engine_rows", lambda f: findings.engine_rows(f.select("ingest_seq", F.col("tool_name").alias("language"), "severity", F.col("finding_type").alias("pattern_type"), F.col("rule_id").alias("pattern_name"), "file_path", F.col("line_start").alias("line"), "message", F.when(F.col("ingest_seq") % 2 == 0, "told").otherwise("").alias("description"))).select("id", "type", "description", "line_number"), "SELECT tool_name || '_' || ingest_seq AS id, finding_type AS type, CASE WHEN ingest_seq % 2 = 0 THEN 'told' ELSE message END AS description, line_start AS line_number FROM findings_v")
both("f09_engine_vulnerabilities", lambda p, a: findings.engine_rows(_no_static(p), deps.advisories_of(p.select("manifest", "position", "package"), a).select((F.col("manifest") * 10 + F.col("position")).alias("ingest_seq"), "severity", F.col("package").cast("string").alias("title"))).select("id", "severity", "title", "type"), "SELECT 'vuln_' || (manifest * 10 + position) AS id, severity, CAST(p.package AS VARCHAR) AS title, 'vulnerability' AS type FROM packages_v p JOIN advisories_v a USING (package)")


def _no_static(p):
    return p.where("false").select(F.lit(0).cast("long").alias("ingest_seq"), F.lit("").alias("language"), F.lit("").alias("severity"), F.lit("").alias("pattern_type"), F.lit("").alias("pattern_name"), F.lit("").alias("file_path"), F.lit(0).alias("line"), F.lit("").alias("message"))




def _plan(i: int) -> str:
    return "CASE finding_type " + " ".join(f"WHEN '{k}' THEN '{v[i]}'" for k, v in enrich.REMEDIATION.items()) + " END"


on("full_v", "o01_pattern_info", lambda f: f.withColumns({"title": F.when(F.col("ingest_seq") % 3 == 0, "A God Object here").otherwise(F.col("title")), "rule_id": F.when(F.col("ingest_seq") % 3 == 1, "X-Spaghetti_Code-1").otherwise(F.col("rule_id"))}).select("ingest_seq", enrich.pattern_info().alias("i")).select("ingest_seq", "i.pattern_id", "i.confidence_score", F.size("i.evidence").alias("evidence")), "SELECT ingest_seq, CASE WHEN finding_type = 'anti_pattern' THEN CASE ingest_seq % 3 WHEN 0 THEN 'god_object' WHEN 1 THEN 'spaghetti_code' END END AS pattern_id, CASE WHEN finding_type = 'anti_pattern' THEN CASE ingest_seq % 3 WHEN 0 THEN 0.85 WHEN 1 THEN 0.75 END END::DOUBLE AS confidence_score, CASE WHEN finding_type = 'anti_pattern' AND ingest_seq % 3 < 2 THEN 3 END AS evidence FROM full_v")
on("full_v", "o02_remediation", lambda f: f.select("ingest_seq", enrich.remediation_plan(F.col("suggestion"), F.col("fix_recommendation")).alias("r")).select("ingest_seq", "r.priority", "r.description", F.size("r.steps").alias("steps"), "r.risk_level", "r.code_example"), f"SELECT ingest_seq, {_plan(0)} AS priority, CASE WHEN {_plan(0)} IS NOT NULL THEN coalesce(nullif(suggestion, ''), {_plan(2)}) END AS description, CASE finding_type {' '.join(f'''WHEN '{k}' THEN {len(v[3])}''' for k, v in enrich.REMEDIATION.items())} END AS steps, {_plan(5)} AS risk_level, CASE WHEN {_plan(0)} IS NOT NULL AND suggestion <> '' AND fix_recommendation <> '' THEN fix_recommendation END AS code_example FROM full_v")
on("full_v", "b01_summary", stats.report_summary, "SELECT 'total' AS part, unnest(['total', 'affected_files_count']) AS name, unnest([count(*), count(DISTINCT file_path)]) AS n FROM full_v UNION ALL SELECT 'severity', s, count(f.severity) FROM unnest(['info', 'low', 'medium', 'high', 'critical']) u(s) LEFT JOIN full_v f ON f.severity = s GROUP BY 2 UNION ALL SELECT 'type', finding_type, count(*) FROM full_v GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM full_v GROUP BY 2")
on("full_v", "b03_markdown", lambda f: reports.markdown_files(f).select("file_path", F.md5("section").alias("section_md5")), f"""SELECT file_path, md5('### ' || file_path || chr(10) || chr(10) || string_agg('#### ' || CASE severity {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in EMOJI.items())} END || ' ' || title || chr(10) || '**Severity**: ' || {_TITLE.format('severity')} || chr(10) || '**Type**: ' || {_TITLE.format('finding_type')}
    || chr(10) || '**Source**: ' || {_TITLE.format('source')} || ' (' || tool_name || ')' || CASE WHEN coalesce(line_start, 0) <> 0 THEN chr(10) || '**Location**: Line ' || line_start || CASE WHEN line_end <> line_start THEN '-' || line_end ELSE '' END ELSE '' END
    || CASE WHEN description <> '' THEN chr(10) || '**Description**: ' || description ELSE '' END || chr(10) || '**Message**: ' || message || CASE WHEN suggestion <> '' THEN chr(10) || '**Suggestion**: ' || suggestion ELSE '' END
    || CASE WHEN affected_code IS NOT NULL THEN chr(10) || '**Affected Code**:' || chr(10) || '```' || chr(10) || affected_code || chr(10) || '```' ELSE '' END || chr(10), chr(10) ORDER BY {ORD} DESC, coalesce(line_start, 0) DESC, ingest_seq)) AS section_md5 FROM full_v GROUP BY 1""")
on("full_v", "b04_csv", reports.csv_rows, f"""SELECT {_ID} AS "ID", title AS "Title", severity AS "Severity", finding_type AS "Type", source AS "Source", tool_name AS "Tool", file_path AS "File", line_start AS "Line Start", line_end AS "Line End", column_start AS "Column Start", column_end AS "Column End",
    coalesce(rule_id, '') AS "Rule ID", message AS "Message", description AS "Description", suggestion AS "Suggestion", confidence AS "Confidence", impact AS "Impact", effort_to_fix AS "Effort to Fix", array_to_string(list_sort(tags), ', ') AS "Tags", {_ISO.format('detected_at')} AS "Detected At" FROM full_v""")
_J = {"rule_id": "$.ruleId", "level": "$.level", "message": "$.message.text", "uri": "$.locations[0].physicalLocation.artifactLocation.uri", "start_line": "$.locations[0].physicalLocation.region.startLine", "end_line": "$.locations[0].physicalLocation.region.endLine", "start_column": "$.locations[0].physicalLocation.region.startColumn", "end_column": "$.locations[0].physicalLocation.region.endColumn", "effort": "$.properties.effort", "kind": "$.properties.findingType"}
on("full_v", "b05_sarif_results", lambda f: reports.sarif_results(f).select("source", "tool_name", "ingest_seq", *(F.get_json_object("result", p).alias(n) for n, p in _J.items())), "SELECT source, tool_name, ingest_seq, rule_id, CASE WHEN severity IN ('critical','high') THEN 'error' WHEN severity = 'medium' THEN 'warning' ELSE 'note' END AS level, message, file_path AS uri, CAST(nullif(line_start, 0) AS VARCHAR) AS start_line, CAST(nullif(line_end, 0) AS VARCHAR) AS end_line, CAST(nullif(column_start, 0) AS VARCHAR) AS start_column, CAST(nullif(column_end, 0) AS VARCHAR) AS end_column, effort_to_fix AS effort, finding_type AS kind FROM full_v")
on("full_v", "b05_sarif_rules", lambda f: reports.sarif_rules(f).select("source", "tool_name", "rule_id", "first", F.get_json_object("rule", "$.name").alias("name"), F.get_json_object("rule", "$.fullDescription.text").alias("full"), F.get_json_object("rule", "$.defaultConfiguration.level").alias("level"), F.get_json_object("rule", "$.properties.tags[1]").alias("tag")), "SELECT source, tool_name, rule_id, min(ingest_seq) AS first, arg_min(title, ingest_seq) AS name, arg_min(coalesce(nullif(description, ''), message), ingest_seq) AS full, arg_min(CASE WHEN severity IN ('critical','high') THEN 'error' WHEN severity = 'medium' THEN 'warning' ELSE 'note' END, ingest_seq) AS level, arg_min(list_sort(tags)[2], ingest_seq) AS tag FROM full_v WHERE rule_id IS NOT NULL GROUP BY 1, 2, 3")
on("full_v", "b06_summary_lines", lambda f: reports.summary_lines(f).select("line"), f"SELECT 'Total findings: ' || count(*) AS line FROM full_v UNION ALL SELECT 'Files affected: ' || count(DISTINCT file_path) FROM full_v UNION ALL SELECT '  ' || upper(severity) || ': ' || count(*) FROM full_v GROUP BY severity UNION ALL SELECT '  ' || {_TITLE.format('finding_type')} || ': ' || count(*) FROM full_v GROUP BY finding_type UNION ALL SELECT '  ' || {_TITLE.format('source')} || ': ' || count(*) FROM full_v GROUP BY source")
on("full_v", "b07_enhanced", lambda f: reports.enhanced_rows(f).select("ingest_seq", *(F.get_json_object("json", p).alias(n) for n, p in {"title": "$.title", "business": "$.business_impact", "security": "$.impact_analysis.security_impact", "plan": "$.remediation.priority", "tag": "$.tags[0]", "weakness": "$.security_info.cwe_ids[0]"}.items())), f"SELECT ingest_seq, title, CASE WHEN finding_type IN ('security_vulnerability','performance_issue','memory_leak') THEN CASE WHEN severity IN ('high','critical') THEN 'high' WHEN severity = 'medium' THEN 'medium' ELSE 'low' END ELSE 'low' END AS business, CASE WHEN finding_type = 'security_vulnerability' THEN CASE WHEN severity IN ('critical','high','medium') THEN severity ELSE 'low' END ELSE 'minimal' END AS security, {_plan(0)} AS plan, tags[1] AS tag, NULL::VARCHAR AS weakness FROM full_v")
on("full_v", "b08_charts", lambda f: stats.chart_rows(enrich.enrich(f, half_even=False)).where("chart <> 'impact'"), "SELECT 'severity' AS chart, severity AS label, count(*) AS n FROM full_v GROUP BY 2 UNION ALL SELECT 'type', finding_type, count(*) FROM full_v GROUP BY 2 UNION ALL (SELECT 'files', string_split(file_path, '/')[-1], count(*) AS n FROM full_v GROUP BY file_path ORDER BY n DESC, file_path LIMIT 10)")
on("full_v", "i10_dashboard", lambda f: stats.dashboard(enrich.enrich(f.withColumns({"confidence": F.when(F.col("ingest_seq") % 5 == 0, 0.0).otherwise(F.col("confidence")), "message": F.replace("message", F.lit("error"), F.lit("xss authentication"))}), half_even=False)), f"SELECT count(*) AS total_findings, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(DISTINCT file_path) AS affected_files, count(*) FILTER (contains(message, 'error')) AS security_findings, round(avg({_DEBT}) FILTER (ingest_seq % 5 <> 0 AND {_DEBT} <> 0), 2) AS average_debt, 1::BIGINT AS unique_cwes FROM full_v")
on("full_v", "f11_table", lambda f: reports.table_rows(f).drop("detected_at"), f"""SELECT ingest_seq, {_ID} AS id, title, severity, file_path, line_start, line_end, function_name, class_name, description, confidence, {_DEBT} AS technical_debt_score, CASE WHEN finding_type IN ('security_vulnerability','performance_issue','memory_leak') THEN CASE WHEN severity IN ('high','critical') THEN 'high' WHEN severity = 'medium' THEN 'medium' ELSE 'low' END ELSE 'low' END AS business_impact,
    effort_to_fix, source, tool_name, array_to_string(list_sort(tags), ',') AS tags, '' AS cwe_ids, '' AS owasp_categories, finding_type AS type, coalesce(CASE WHEN {_plan(0)} IS NOT NULL THEN coalesce(nullif(suggestion, ''), {_plan(2)}) END, '') AS remediation_description, coalesce({_plan(0)}, '') AS remediation_priority, '' AS pattern_name, 0.0::DOUBLE AS pattern_confidence FROM full_v""")
on("full_v", "b14_first", lambda f: stats.arrival(f, 10).select("ingest_seq", "severity", "title"), "SELECT ingest_seq, severity, title FROM full_v ORDER BY ingest_seq LIMIT 10")
on("full_v", "b22_tickets", lambda f: reports.tickets(f).select("ingest_seq", "summary", "priority", F.array_join("labels", ",").alias("labels")), "SELECT ingest_seq, '[' || upper(severity) || '] ' || title AS summary, CASE severity WHEN 'critical' THEN 'Highest' ELSE 'High' END AS priority, 'code-analysis,' || replace(finding_type, '_', '-') AS labels FROM full_v WHERE severity IN ('critical', 'high') ORDER BY ingest_seq LIMIT 50")
on(
    "full_v", "b21_contained_issues",
    lambda f: reports.issues(f, f.where("ingest_seq % 3 = 0").select(F.concat(F.lit("Seen in "), "file_path", F.lit(":"), "title", F.lit("0 and elsewhere, see "), "tool_name").alias("body")), 1_000_000).select("signature", "severity"),
    "SELECT file_path || ':' || title AS signature, severity FROM full_v WHERE severity IN ('critical','high') AND NOT EXISTS "
    "(SELECT 1 FROM full_v b WHERE b.ingest_seq % 3 = 0 AND contains('Seen in ' || b.file_path || ':' || b.title || '0 and elsewhere, see ' || b.tool_name, full_v.file_path || ':' || full_v.title))",
)
on(
    "full_v", "b05_sarif_fragments", lambda f: documents.sarif_fragments(f).groupBy("edge", "source", "tool_name", "section").agg(F.count("*").alias("n"), F.count_if(F.startswith("text", F.lit(","))).alias("commas"), F.max("seq").alias("last")),
    """, t AS (SELECT source, tool_name, count(*) AS n, max(ingest_seq) AS last, row_number() OVER (ORDER BY source, tool_name) AS k FROM full_v GROUP BY 1, 2),
    u AS (SELECT source, tool_name, rule_id, min(ingest_seq) AS first FROM full_v WHERE rule_id <> '' GROUP BY ALL), v AS (SELECT source, tool_name, count(*) AS n, max(first) AS last FROM u GROUP BY 1, 2)
    SELECT 1 AS edge, source, tool_name, 0 AS section, 1 AS n, (k > 1)::BIGINT AS commas, 0 AS last FROM t UNION ALL SELECT 1, source, tool_name, 1, n, n - 1, last FROM v UNION ALL SELECT 1, source, tool_name, 2, 1, 0, 0 FROM t
    UNION ALL SELECT 1, source, tool_name, 3, n, n - 1, last FROM t UNION ALL SELECT 1, source, tool_name, 4, 1, 0, 0 FROM t UNION ALL VALUES (0, NULL, NULL, 0, 1, 0, 0), (2, NULL, NULL, 0, 1, 0, 0)""",
)
on("full_v", "h09_open_issues", lambda f: reports.issues(f, f.where("ingest_seq % 3 = 0").select(F.concat(F.lit("Found:\n- `"), "file_path", F.lit(":"), "title", F.lit("`\nmore")).alias("body")), 1000).select("signature", F.array_join("labels", ",").alias("labels")), "SELECT file_path || ':' || title AS signature, array_to_string(list_sort(['code-analysis', severity, replace(finding_type, '_', '-')]), ',') AS labels FROM full_v WHERE severity IN ('critical','high') AND file_path || ':' || title NOT IN (SELECT file_path || ':' || title FROM full_v WHERE ingest_seq % 3 = 0) ORDER BY ingest_seq LIMIT 1000")
on("full_v", "n02_columns", lambda f: f.select("ingest_seq", text.location_text(columns=True).alias("location")), "SELECT ingest_seq, file_path || coalesce(':' || line_start || CASE WHEN line_end <> line_start THEN '-' || line_end ELSE '' END, '') || coalesce(':' || column_start || CASE WHEN column_end <> column_start THEN '-' || column_end ELSE '' END, '') AS location FROM full_v")
on("full_v", "n01_texts", lambda f: f.select("ingest_seq", text.title(F.replace("message", F.lit("="), F.lit("-"))).alias("title"), text.truncate(F.col("message"), 6).alias("short")), "SELECT ingest_seq, upper(left(message, 1)) || substr(split_part(message, ' ', 1), 2) || ' K-' || split_part(message, '=', 2) AS title, CASE WHEN length(message) > 6 THEN left(message, 6) || '...' ELSE message END AS short FROM full_v")
on("full_v", "n16_formats", lambda f: f.select("ingest_seq", text.percentage(F.floor(F.col("confidence") * 100) / 8).alias("percent"), text.minute(F.date_format("detected_at", "yyyy-MM-dd'T'HH:mm:ss")).alias("minute")), "SELECT ingest_seq, printf('%.1f', floor(confidence * 100) / 8) || '%' AS percent, strftime(detected_at, '%Y-%m-%d %H:%M') AS minute FROM full_v")
on("full_v", "n15_colours", lambda f: f.select("ingest_seq", text.severity_colour(F.col("severity")).alias("severity"), text.debt_colour(enrich.debt(False)).alias("debt"), text.emoji(F.col("severity")).alias("mark")), f"SELECT ingest_seq, CASE severity WHEN 'critical' THEN 'danger' WHEN 'high' THEN 'warning' WHEN 'medium' THEN 'info' WHEN 'low' THEN 'secondary' ELSE 'light' END AS severity, CASE WHEN {_DEBT} >= 8 THEN 'danger' WHEN {_DEBT} >= 5 THEN 'warning' WHEN {_DEBT} >= 2 THEN 'info' ELSE 'success' END AS debt, CASE severity {' '.join(f'''WHEN '{k}' THEN '{v}' ''' for k, v in EMOJI.items())} END AS mark FROM full_v")
on("full_v", "l04_compatible", lambda f: f.groupBy("file_path").agg(dedup.within_one_group(F.collect_set("finding_type")).alias("one_group")), "SELECT file_path, count(DISTINCT finding_type) <= 1 AS one_group FROM full_v GROUP BY 1")
on("files_v", "n05_globs", lambda f: f.where(F.col("path").rlike(text.glob_regex("/src[12]/[!d]*/doc_*[0-4]"))).select("path"), "SELECT path FROM files_v WHERE regexp_full_match(path, '/src[12]/[^d].*/doc_.*[0-4]')")
on("usage_v", "n09_jitter", lambda u: u.select("request_id", text.backoff(F.col("request_id") % 10, jitter=0.25, key=F.col("request_id")).between(0.75 * text.backoff(F.col("request_id") % 10), 1.25 * text.backoff(F.col("request_id") % 10)).alias("within")), "SELECT request_id, true AS within FROM usage_v")
on("full_v", "n14_sorted_json", lambda f: f.select("ingest_seq", text.sorted_json({"z": F.col("title"), "a": F.col("line_start"), "m": F.col("tags")}).alias("json")), "SELECT ingest_seq, '{' || coalesce('\"a\":' || line_start || ',', '') || '\"m\":[\"' || array_to_string(tags, '\",\"') || '\"],\"z\":\"' || title || '\"}' AS json FROM full_v")

# packages
both("b10_documents", lambda p, a: deps.manifest_documents(p, a).withColumn("dependencies", F.md5("dependencies")), "SELECT manifest, count(*) AS total_dependencies, count(*) FILTER (NOT dev) AS production_dependencies, count(*) FILTER (dev) AS dev_dependencies, count(*) FILTER (optional) AS optional_dependencies, count(*) FILTER (package IN (SELECT package FROM advisories_v)) AS vulnerabilities, count(DISTINCT licence) AS unique_licenses, md5('[' || string_agg('{\"name\":\"' || package || '\",\"version\":\"' || version || '\",\"licence\":\"' || coalesce(licence, 'Unknown') || '\",\"dev\":' || dev || ',\"optional\":' || optional || '}', ',' ORDER BY position, CAST(package AS VARCHAR), CAST(version AS VARCHAR), coalesce(licence, 'Unknown'), dev, optional) || ']') AS dependencies FROM packages_v GROUP BY 1")
both("b11_sections", lambda p, a: deps.manifest_sections(p).withColumn("section", F.md5("section")), "SELECT manifest, md5('### ' || manifest || chr(10) || chr(10) || '| Package | Version | Type | License |' || chr(10) || '|---------|---------|------|---------|' || chr(10) || string_agg(row, chr(10) ORDER BY position, row)) AS section FROM (SELECT manifest, position, '| ' || package || ' | ' || version || ' | ' || CASE WHEN dev THEN 'dev' ELSE 'prod' END || CASE WHEN optional THEN ' (optional)' ELSE '' END || ' | ' || coalesce(licence, 'Unknown') || ' |' AS row FROM packages_v) GROUP BY 1")
both("b13_summary", deps.report_summary, "SELECT 'total' AS part, unnest(['total_files', 'total_dependencies', 'total_license_types']) AS name, unnest([count(DISTINCT manifest), count(*), count(DISTINCT licence)]) AS n FROM packages_v UNION ALL SELECT 'total', 'total_vulnerabilities', count(*) FROM packages_v JOIN advisories_v USING (package) UNION ALL SELECT 'severity', severity, count(*) FROM packages_v JOIN advisories_v USING (package) GROUP BY 2 UNION ALL SELECT 'licence', licence, count(*) FROM packages_v WHERE licence IS NOT NULL GROUP BY 2 UNION ALL SELECT 'manager', package_manager, count(DISTINCT manifest) FROM packages_v GROUP BY 2")

# snippets and batches
written("r01_tree_snippets", lambda: _text("import a\n\nclass C", _s("p"), ":\n", _repeat("n", "'    x = 1\\n'"), "\ndef f(a):\n    return a\n"), lambda f: batching.tree_snippets(parsers.nodes(f, "python", **batching.SNIPPETS), f, 1, 10_000).select("path", "snippet_type", "name", "start_line", "end_line"), "SELECT path, 'class' AS snippet_type, 'C' || p AS name, 3 AS start_line, CAST(least(n + 7, n + 13) AS INT) AS end_line FROM part_v UNION ALL SELECT path, 'function', 'f', CAST(n + 5 AS INT), CAST(n + 7 AS INT) FROM part_v")
written("r02_token_chunks", lambda: _repeat("n", "'0123456789012345678901234567\\n'"), lambda f: batching.token_chunks(f.where("length(content) > 0"), 100, 30, 1).select("path", "chunk", "first_line"), "SELECT path, CAST(s // st AS INT) AS chunk, CAST(s + 1 AS INT) AS first_line FROM (SELECT *, unnest(range(0, n + 1, st)) AS s FROM (SELECT path, n, l, greatest(l - floor(30 / a), 1)::BIGINT AS st FROM (SELECT path, n, a, greatest(floor(100 / a), 1)::BIGINT AS l FROM (SELECT path, n, greatest(29 * n // 3, 1) / (n + 1)::DOUBLE AS a FROM part_v)))) WHERE (least(l, n - s) * 28 + least(l, n + 1 - s) - 1) // 3 >= 1")
on("files_v", "r03_whole_files", lambda f: batching.snippets(f, 300, chunk_large_files=False, min_tokens=0).groupBy("snippet_type").agg(F.countDistinct("path").alias("files")), "SELECT CASE WHEN tokens <= 300 THEN 'full_file' ELSE 'chunk' END AS snippet_type, count(DISTINCT path) AS files FROM files_v WHERE length(content) > 0 GROUP BY 1")


def _batched(f):
    return f.select("path", (F.col("doc_id") % 10).alias("batch_id"), "tokens", F.element_at(F.split("path", "/"), 3).alias("language"), F.lit("chunk").alias("snippet_type"), F.array(F.element_at(F.split("path", "/"), 2)).alias("dependencies"), F.lit(2).cast("long").alias("lines"))


on("files_v", "i31_batch_metadata", lambda f: batching.batch_metadata(_batched(f)).withColumn("languages", F.array_join("languages", ",")).withColumn("snippet_types", F.array_join("snippet_types", ",")), "SELECT doc_id % 10 AS batch_id, count(DISTINCT path) AS file_count, string_agg(DISTINCT string_split(path, '/')[3], ',' ORDER BY string_split(path, '/')[3]) AS languages, 'chunk' AS snippet_types, count(DISTINCT string_split(path, '/')[2]) AS total_dependencies FROM files_v GROUP BY 1")
on("files_v", "b17_batches", lambda f: batching.batch_totals(_batched(f)).withColumn("batch_id", batching.batch_name(F.col("batch_id"))), "SELECT printf('batch_%03d', doc_id % 10 + 1) AS batch_id, count(*) AS n, CAST(sum(tokens) AS BIGINT) AS tokens, count(DISTINCT path) AS files, CAST(2 * count(*) AS BIGINT) AS lines FROM files_v GROUP BY 1")
on("files_v", "o14_estimates", lambda f: batching.run_estimates(f, 8000, 40_000, 2, 3.0, 15.0), "SELECT count(*) AS snippets, CAST(sum(tokens) AS BIGINT) AS tokens, (ceil(sum(tokens) / 8000.0) / (least(40000, 8000 * 2 * 60) / 8000.0) * 60)::DOUBLE AS seconds, CAST(floor(sum(tokens) * 0.2) AS BIGINT) AS tokens_out, ((sum(tokens) * 3.0 + floor(sum(tokens) * 0.2) * 15.0) / 1e6)::DOUBLE AS cost FROM files_v")

# caches, histories, usage
_CACHE = "path AS key, doc_id % 100 AS timestamp, CASE WHEN doc_id % 3 <> 0 THEN 40 END AS ttl"


def _cache(f):
    return f.select(F.col("path").alias("key"), (F.col("doc_id") % 100).alias("timestamp"), F.when(F.col("doc_id") % 3 != 0, F.lit(40)).alias("ttl"), F.col("size").alias("value"))


on("files_v", "i33_lookups", lambda f: cachetable.lookups(f.select(F.col("path").alias("key")), _cache(f.where("doc_id % 2 = 0")), 90), f", c AS (SELECT {_CACHE}, doc_id FROM files_v WHERE doc_id % 2 = 0), h AS (SELECT count(*) AS hits FROM c WHERE ttl IS NULL OR 90 - timestamp <= ttl) SELECT hits, n - hits AS misses, round(hits / n, 6) AS hit_rate FROM h, (SELECT count(*) AS n FROM files_v)")
on("files_v", "s04_cleanup", lambda f: cachetable.cleanup(_cache(f), 90).select("key"), f", c AS (SELECT {_CACHE} FROM files_v) SELECT key FROM c WHERE ttl IS NOT NULL AND 90 - timestamp > ttl")
on("files_v", "s01_invalidate", lambda f: cachetable.invalidate(_cache(f), "/src1/en/doc_1").select("key"), "SELECT path AS key FROM files_v WHERE path <> '/src1/en/doc_1'")
on("files_v", "a33_history", lambda f: cachetable.history_get(f.select(F.col("doc_id").alias("id"), "path"), 7).unionByName(cachetable.history_count(f).select(F.lit(-1).cast("long").alias("id"), F.col("n").cast("string").alias("path"))), "SELECT doc_id AS id, path FROM files_v WHERE doc_id = 7 UNION ALL SELECT -1, CAST(count(*) AS VARCHAR) FROM files_v")
on("files_v", "b19_history_add", lambda f: cachetable.history_add(f.where("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), "path"), f.where("doc_id % 2 = 1").select((-F.col("doc_id")).alias("timestamp"), "path")).where("timestamp is not null").select("id", "path"), "SELECT (SELECT max(doc_id) FROM files_v WHERE doc_id % 2 = 0) + row_number() OVER (ORDER BY -doc_id) AS id, path FROM files_v WHERE doc_id % 2 = 1")
on("files_v", "s07_history_delete", lambda f: _deleted(f.select(F.col("doc_id").alias("id"), "path")), "SELECT doc_id AS id, path FROM files_v WHERE doc_id NOT IN (3, 5) UNION ALL SELECT -1, CAST(count(*) AS VARCHAR) FROM files_v WHERE doc_id IN (3, 5)")


def _deleted(history):
    left, gone = cachetable.history_delete(history, [3, 5])
    return left.unionByName(gone.select(F.lit(-1).cast("long").alias("id"), F.col("deleted").cast("string").alias("path")))


on("usage_v", "b16_usage_rows", lambda u: usage.export_rows(u).select("timestamp", "model", "input_tokens", "output_tokens", F.round(F.col("cost") * 1_000_000).cast("long").alias("micro"), "success", "error_message"), f"SELECT {_ISO.format('timestamp')} AS timestamp, model, input_tokens, output_tokens, CAST(floor((input_tokens * (CASE model WHEN 'large' THEN 1500 WHEN 'small' THEN 25 ELSE 300 END) + output_tokens * (CASE model WHEN 'large' THEN 7500 WHEN 'small' THEN 125 ELSE 1500 END)) / 100.0) AS BIGINT) AS micro, success, NULL::VARCHAR AS error_message FROM usage_v")
on("usage_v", "i30_benchmark", lambda u: stats.benchmark(u, "output_tokens"), "SELECT round_even(avg(output_tokens), 6) AS mean, quantile_cont(output_tokens, 0.5) AS median, max(output_tokens) AS most, min(output_tokens) AS least FROM usage_v")
on("usage_v", "b18_benchmark_lines", lambda u: stats.benchmark_markdown(u, "model", "output_tokens").select("line"), "SELECT printf('- %s: mean %.1f, median %.1f, max %.1f, min %.1f', model, round_even(avg(output_tokens), 6), quantile_cont(output_tokens, 0.5)::DOUBLE, max(output_tokens)::DOUBLE, min(output_tokens)::DOUBLE) AS line FROM usage_v GROUP BY model")
on("files_v", "j10_listing", lambda f: scans.directories(f), "SELECT DISTINCT string_split(path, '/')[2] AS name FROM files_v ORDER BY 1")


def _project(spark, sf_dir):
    return scans.project(spark, 40, 4000).select("path", F.size(F.split("content", "\n")).alias("lines"), F.element_at(F.split("content", "\n"), -1).alias("last"))


QUERIES["a35_project"] = _project
ORACLES["a35_project"] = "SELECT printf('/src/module_%03d.py', i) AS path, 100 AS lines, 'value_84 = \"text 84\"' AS last FROM range(40) t(i) UNION ALL SELECT printf('/src/script_%03d.js', i), 50, 'const value46 = \"text 46\";' FROM range(4) t(i)"

_QS = [0.01, 0.25, 0.5, 0.75, 0.99]
QUERIES["i29_exact_quantiles"] = lambda spark, sf_dir: quantiles.exact_quantiles(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", _QS).withColumn("quantile", F.bround("quantile", 4))
ORACLES["i29_exact_quantiles"] = " UNION ALL ".join(
    f"SELECT l_returnflag, l_linestatus, CAST({q} AS DOUBLE) AS q, round_even(quantile_cont(CAST(l_extendedprice AS DOUBLE), {q}), 4) AS quantile, count(l_extendedprice) AS n FROM lineitem GROUP BY 1, 2" for q in _QS
)


def _sketches(spark, sf_dir):
    """Sketches of each return flag and status, merged to one for each status; whether their ranks are within 1 %."""
    rows = table(spark, sf_dir, "lineitem")
    merged = quantiles.merged_sketches(quantiles.sketched(rows, ["l_linestatus", "l_returnflag"], "l_extendedprice"), ["l_linestatus"])
    answers = quantiles.sketch_quantiles(merged, _QS)
    return quantiles.rank_errors(rows, ["l_linestatus"], "l_extendedprice", answers).select("l_linestatus", "q", (F.col("error") < 0.01).alias("within"))


QUERIES["i30_sketch_ranks"] = _sketches
ORACLES["i30_sketch_ranks"] = " UNION ALL ".join(f"SELECT DISTINCT l_linestatus, CAST({q} AS DOUBLE) AS q, true AS within FROM lineitem" for q in _QS)


def _tokenized(spark, sf_dir):
    """Documents in batches of at most 8,000 tokens of a public tokenizer, in the order of their ids."""
    import public_tokenizers

    counted = batching.with_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), "text").select("doc_id", F.coalesce("tokens", F.lit(0)).alias("tokens"))
    counted = storage.written(counted)
    return counted.join(batching.next_fit(counted, "doc_id", "tokens", 8000).select("doc_id", "batch_id"), "doc_id")


QUERIES["n11_tokenizer_batches"] = _tokenized
