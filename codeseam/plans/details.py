"""More registered queries: parsers, detectors, projections, functions and tables, each with its SQL where SQL can say it.

Code files are written from the rows of ``part`` (one file a row, its shape set by the columns), so that the
SQL can state which findings they must have.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import ORD, SQL, advisories_v, files_v, findings_v, lines_v, packages_v, spread, table, usage_v
from ..functions import text
from ..operators import batching, cachetable, deps, enrich, findings, stats, usage
from ..schemas import DEBT_BASE, DEBT_FACTOR, SECURITY_TYPES, type_group
from ..sinks import reports
from ..sources import files as scans
from ..sources import detectors, linters, manifests, parsers

QUERIES: dict = {}
ORACLES: dict = {}
_VIEWS = {"findings_v": findings_v, "usage_v": usage_v, "files_v": files_v, "lines_v": lines_v}


def _add(name: str, view: str, build, sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(_VIEWS[view](spark, sf_dir))
    if sql:
        ORACLES[name] = f"WITH {SQL[view]} {sql}"


def _code(name: str, source, build, sql: str | None = None) -> None:
    """A query over the files that ``source`` writes from part's rows (p: key, n: size of 1 to 50)."""

    def run(spark, sf_dir):
        rows = spread(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("p"), F.col("p_size").alias("n")), "p")
        return build(rows.select(F.col("p").cast("string").alias("path"), source().alias("content")))

    QUERIES[name] = run
    if sql:
        ORACLES[name] = "WITH part_v AS (SELECT p_partkey AS p, p_size AS n, CAST(p_partkey AS VARCHAR) AS path FROM part) " + sql


def _s(c):
    return (F.expr(c) if isinstance(c, str) else c).cast("string")


def _text(*parts):
    """Strings as they are; columns as their text."""
    return F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))


def _repeat(count: str, line: str):
    return F.expr(f"array_join(transform(filter(sequence(0, {count}), i -> i > 0), i -> {line}), '')")


def python_code():
    p, n = _s("p"), _s("n")
    return _text(
        "import m", n, "\nfrom pkg", _s("n % 7"), " import x", _s("p % 5"), "\ndef ", F.expr("if(p % 2 = 0, 'create_', 'run_')"), p, "(a):\n", _repeat("n", "'    a = a\\n'"),
        "    if a:\n        return a\nclass C", p, ":\n", _repeat("n", "concat('    def m', i, '(self):\\n        pass\\n')"),
        "def deep_", p, "(a):\n", _repeat("n % 8", "concat(repeat('    ', i), 'if a:\\n')"), F.expr("repeat('    ', n % 8 + 1)"), "pass\n",
        F.expr("if(p % 3 = 0, concat('class S', p, ':\\n    def __new__(cls):\\n        if cls:\\n            pass\\n'), '')"),
        F.expr("if(p % 5 = 0, concat('class O', p, ':\\n    observers = []\\n    def add_observer(self, o):\\n        pass\\n    def notify(self):\\n        pass\\n'), '')"),
    )


def script_code():
    p, n = _s("p"), _s("n")
    return _text(
        "import a from './lib", _s("p % 7"), "'\nconst x", p, " = require('pkg", n, "')\nfunction f", p, "(a) { return a }\nfetch(u)", F.expr("repeat('.then(g)', n % 5)"), "\nclass K", p, " {}\n",
        F.expr("repeat(' ', n)"), "go(function(e) {", F.expr("if(p % 2 = 0, concat(' x', p), '')"), " })\n", _repeat("n % 10", "'// end\\n'"),
    )


def _tree(build, want: dict = {}):
    return lambda files: build(parsers.nodes(files, "python", **want))


# Python files
_code("c01_python_edges", python_code, _tree(lambda t: parsers.python_edges(t).select("path", "target", "is_relative"), parsers.EDGES), "SELECT path, 'm' || n AS target, false AS is_relative FROM part_v UNION ALL SELECT path, 'pkg' || (n % 7) || '.x' || (p % 5), false FROM part_v")
_code("c03_python_symbols", python_code, _tree(lambda t: parsers.python_symbols(t).where("kind <> 'variable'").groupBy("path", "kind").agg(F.count("*").alias("n")), parsers.SYMBOLS | {"kinds": ["FunctionDef", "AsyncFunctionDef", "ClassDef"]}), "SELECT path, 'function' AS kind, CAST(2 + n + (p % 3 = 0)::INT + 2 * (p % 5 = 0)::INT AS BIGINT) AS n FROM part_v UNION ALL SELECT path, 'class', CAST(1 + (p % 3 = 0)::INT + (p % 5 = 0)::INT AS BIGINT) FROM part_v")
_code("c03_python_variables", python_code, _tree(lambda t: parsers.python_symbols(t).where("kind = 'variable'").select("path", "name"), parsers.SYMBOLS | {"kinds": ["Assign"]}), "SELECT path, 'a' AS name FROM part_v WHERE n > 0 UNION ALL SELECT path, 'observers' FROM part_v WHERE p % 5 = 0")
_code("c05_python_nodes", python_code, _tree(lambda t: t.where("node_type in ('FunctionDef', 'ClassDef', 'If', 'ImportFrom')").where("attrs is not null or node_type = 'If'").groupBy("node_type").agg(F.count("*").alias("n")), {"kinds": ["FunctionDef", "ClassDef", "If", "ImportFrom"], "columns": ["path", "node_type", "attrs"]}), """SELECT 'FunctionDef' AS node_type, CAST(sum(2 + n + (p % 3 = 0)::INT + 2 * (p % 5 = 0)::INT) AS BIGINT) AS n FROM part_v
    UNION ALL SELECT 'ClassDef', CAST(sum(1 + (p % 3 = 0)::INT + (p % 5 = 0)::INT) AS BIGINT) FROM part_v UNION ALL SELECT 'If', CAST(sum(1 + n % 8 + (p % 3 = 0)::INT) AS BIGINT) FROM part_v UNION ALL SELECT 'ImportFrom', count(*) FROM part_v""")
_code("c01_import_counts", python_code, _tree(lambda t: parsers.python_edges(t).where("not is_relative").groupBy("target").agg(F.count("*").alias("n")), parsers.EDGES), "SELECT target, count(*) AS n FROM (SELECT 'm' || n AS target FROM part_v UNION ALL SELECT 'pkg' || (n % 7) || '.x' || (p % 5) FROM part_v) GROUP BY 1")
_code("e02_python_complexity", python_code, _tree(parsers.python_complexity, parsers.COMPLEXITY), "SELECT path, CAST(2 + n % 8 + (p % 3 = 0)::INT AS BIGINT) AS complexity FROM part_v")
_code("d04_god_class", python_code, _tree(lambda t: parsers.god_classes(t).select("file_path", "message"), parsers.GOD_CLASSES), "SELECT path AS file_path, 'C' || p || ' does too much' AS message FROM part_v WHERE n > 20")
_code("d05_long_method", python_code, _tree(lambda t: parsers.long_methods(t).select("file_path", "message"), parsers.LONG_METHODS), "SELECT path AS file_path, CASE WHEN p % 2 = 0 THEN 'create_' ELSE 'run_' END || p || ' has ' || (n + 3) || ' lines' AS message FROM part_v WHERE n + 3 > 50")
for _name, _kind, _when, _message in (("d01_singleton", "singleton", "p % 3 = 0", "'S' || p"), ("d02_factory_method", "factory_method", "p % 2 = 0", "'create_' || p"), ("d03_observer", "observer", "p % 5 = 0", "'O' || p"), ("d06_deep_nesting", "deep_nesting", "n % 8 > 4", "'deep_' || p || ' nests ' || (n % 8) || ' deep'")):
    _code(_name, python_code, lambda files, k=_kind: parsers.structural_findings(files).where(F.col("pattern_name") == k).select("file_path", "message"), f"SELECT path AS file_path, {_message} AS message FROM part_v WHERE {_when}")
_code("f01_static_findings", python_code, lambda files: findings.from_static(parsers.structural_findings(files)).groupBy("finding_type", "severity", "rule_id").agg(F.count("*").alias("n")), """SELECT * FROM (SELECT 'design_pattern' AS finding_type, 'info' AS severity, 'singleton' AS rule_id, count(*) AS n FROM part_v WHERE p % 3 = 0
    UNION ALL SELECT 'design_pattern', 'info', 'factory_method', count(*) FROM part_v WHERE p % 2 = 0 UNION ALL SELECT 'design_pattern', 'info', 'observer', count(*) FROM part_v WHERE p % 5 = 0
    UNION ALL SELECT 'code_smell', 'medium', 'deep_nesting', count(*) FROM part_v WHERE n % 8 > 4 UNION ALL SELECT 'code_smell', 'medium', 'long_method', count(*) FROM part_v WHERE n + 3 > 50
    UNION ALL SELECT 'anti_pattern', 'medium', 'god_class', count(*) FROM part_v WHERE n > 20) WHERE n > 0""")

# scripts
_code("c09_script_edges", script_code, lambda files: parsers.edges(files, "javascript").select("path", "kind", "target", "is_external"), "SELECT path, 'import' AS kind, './lib' || (p % 7) AS target, false AS is_external FROM part_v UNION ALL SELECT path, 'require', 'pkg' || n, true FROM part_v")
_code("c10_script_symbols", script_code, lambda files: parsers.symbols(files, "javascript"), "SELECT path, 'function' AS kind, unnest(['f' || p, 'go']) AS name FROM part_v UNION ALL SELECT path, 'class', 'K' || p FROM part_v UNION ALL SELECT path, 'variable', 'x' || p FROM part_v")
_code("c14_typed_edges", lambda: _text("import type { A } from './t", _s("p % 9"), "'\nimport { type B, c } from './u", _s("n"), "'\n/// <reference path='r", _s("n"), ".d.ts' />\n/// <reference types='y' />\n"), lambda files: parsers.edges(files, "typescript").select("path", "kind", "target"), "SELECT path, k AS kind, './t' || (p % 9) AS target FROM part_v, unnest(['type_import', 'import']) u(k) UNION ALL SELECT path, k, './u' || n FROM part_v, unnest(['type_import', 'import']) u(k) UNION ALL SELECT path, 'reference', unnest(['r' || n || '.d.ts', 'y']) FROM part_v")
_code("c15_typed_symbols", lambda: _text("interface I", _s("p"), " {}\nenum E", _s("n"), " {}\ntype T", _s("p"), " = string\n// class Z\nabstract class A", _s("n"), " {}\nnamespace N {}\n"), lambda files: parsers.symbols(files, "typescript"), "SELECT path, 'class' AS kind, unnest(['I' || p, 'E' || n, 'T' || p, 'A' || n, 'N']) AS name FROM part_v")
_code("d08_deep_callbacks", script_code, lambda files: text.deep_indents(text.lines(files)).select("path", "line_no"), "SELECT path, 6 AS line_no FROM part_v WHERE n > 16")
_code("d10_unused_variables", script_code, detectors.unused_variables, "SELECT path, 'x' || p AS name, 2 AS line_no FROM part_v WHERE p % 2 = 1")
_code("d13_unhandled_promises", script_code, lambda files: text.unhandled_promises(text.lines(files)).select("path", "line_no"), "SELECT path, 4 AS line_no FROM part_v WHERE n % 5 > 0 AND 4 < 7 + n % 10 - 5")
_code("d12_promise_chains", script_code, lambda files: text.promise_chains(text.lines(files)).select("path", "line_no"), "SELECT path, 4 AS line_no FROM part_v WHERE n % 5 > 2")
_code("e05_script_lines", script_code, lambda files: text.lines_of_code(text.lines(files), "//").select("path", "loc"), "SELECT path, CAST(6 AS BIGINT) AS loc FROM part_v")
_code("e06_script_counts", script_code, lambda files: text.js_counts(files).select("path", "functions", "classes"), "SELECT path, CAST(1 AS BIGINT) AS functions, CAST(1 AS BIGINT) AS classes FROM part_v")
def style_code():
    return _text("@import url('b", _s("p % 7"), ".css');\n@import \"a", _s("n"), ".css\";\n@IMPORT url(c.css);\n.c", _s("n"), ", .d:hover { --v", _s("p % 9"), ": 1; width: calc(1px + var(--w)); color (2) }\n")


_code("c22_style_imports", style_code, lambda files: parsers.edges(files, "css").select("path", "target", "is_external"), "SELECT path, unnest(['b' || (p % 7) || '.css', 'a' || n || '.css', 'c.css']) AS target, false AS is_external FROM part_v")
_code("c23_style_symbols", style_code, lambda files: parsers.symbols(files, "css"), "SELECT path, 'class' AS kind, unnest(['css', 'c' || n, 'd']) AS name FROM part_v UNION ALL SELECT path, 'variable', unnest(['--v' || (p % 9), '--w']) FROM part_v UNION ALL SELECT path, 'function', unnest(['url', 'calc', 'var']) FROM part_v")
_code("c24_style_nodes", style_code, lambda files: parsers.nodes(files, "css").groupBy("path", "node_type").agg(F.count("*").alias("n")), "SELECT path, t AS node_type, CASE WHEN t IN ('import_rule') THEN 3 WHEN t = 'property' THEN 2 ELSE 1 END::BIGINT AS n FROM part_v, unnest(['stylesheet', 'import_rule', 'style_rule', 'property']) u(t)")
_code("c30_yaml_uses", lambda: _text("image: repo/i", _s("n"), "\nbuild: ./d", _s("p % 3"), "\nsteps:\n  - uses: act/a", _s("p % 7"), "@v1\n"), lambda files: parsers.edges(files, "yaml").select("path", "kind", "target"), "SELECT path, 'image' AS kind, 'repo/i' || n AS target FROM part_v UNION ALL SELECT path, 'build', './d' || (p % 3) FROM part_v UNION ALL SELECT path, 'uses', 'act/a' || (p % 7) || '@v1' FROM part_v")
_code("c31_yaml_keys", lambda: _text("a: ", _s("n"), "\nb:\n  k", _s("p % 7"), ": 1\n"), lambda files: parsers.key_paths(parsers.nodes(files, "yaml")), "SELECT path, unnest(['a', 'b', 'b.k' || (p % 7)]) AS key FROM part_v")


def notes():
    return _text("# Title ", _s("n"), "!\n[a](x", _s("p % 7"), ".md)\n```\n# no\n```\n## Part ", _s("p % 3"), "\nsee ![i](y.png)\n")


_code("c32_note_edges", notes, lambda files: parsers.edges(files, "markdown").select("path", "kind", "target"), "SELECT path, 'link' AS kind, 'x' || (p % 7) || '.md' AS target FROM part_v UNION ALL SELECT path, 'link', 'y.png' FROM part_v UNION ALL SELECT path, 'image', 'y.png' FROM part_v")
_code("c33_note_symbols", notes, lambda files: parsers.markdown_headers(text.lines(files)).select("path", "symbol"), "SELECT path, 'h1-title-' || n AS symbol FROM part_v UNION ALL SELECT path, 'h2-part-' || (p % 3) FROM part_v")
_code("k08_note_sections", notes, lambda files: parsers.markdown_sections(text.lines(files)).where("line like 'see%' or line = '# no'").select("path", "line_no", "fenced", "section"), "SELECT path, 4 AS line_no, true AS fenced, 'Title ' || n || '!' AS section FROM part_v UNION ALL SELECT path, 7, false, 'Part ' || (p % 3) FROM part_v")

# manifests, advisories, linter output
_code("a14_requirements", lambda: _text("pkg", _s("p"), "==1.", _s("n"), "\n# c\nnumpy\nextra>=2.", _s("n"), "\npkg", _s("p"), "==3.", _s("n")), manifests.requirements, "SELECT path, 'pkg' || p AS package, '==3.' || n AS version FROM part_v UNION ALL SELECT path, 'extra', '>=2.' || n FROM part_v")


def _manifest(basename, source, build=None):
    return lambda files: manifests.packages(files.withColumn("path", _text(F.col("path"), "/" + basename))).select("manager", "package", "version", "dev")


_PKG = "SELECT '{m}' AS manager, 'pkg' || p AS package, '{v}' || n AS version, {d} AS dev FROM part_v"
_code("a15_pyproject", lambda: _text('[tool.poetry.dependencies]\npython="3"\npkg', _s("p"), '="^', _s("n"), '"\n'), _manifest("pyproject.toml", None), _PKG.format(m="poetry", v="^", d="false"))
_code("a16_lock", lambda: _text('[[package]]\nname="pkg', _s("p"), '"\nversion="1.', _s("n"), '"\ncategory="dev"\n'), _manifest("poetry.lock", None), _PKG.format(m="poetry", v="1.", d="true"))
_code("a17_pipfile", lambda: _text("[dev-packages]\npkg", _s("p"), '="==', _s("n"), '"\n'), _manifest("Pipfile", None), _PKG.format(m="pipenv", v="==", d="true"))
_code("c25_package_json", lambda: _text('{"dependencies":{"pkg', _s("p"), '":"1.0"},"devDependencies":{"pkg', _s("p"), '":"~', _s("n"), '"}}'), _manifest("package.json", None), _PKG.format(m="npm", v="~", d="true"))
_code("a20_advisories", lambda: _text('{"id":"A', _s("p"), '","summary":"s","affected":[{"package":{"ecosystem":"npm","name":"pkg', _s("n"), '"},"ranges":[{"events":[{"introduced":"0"},{"fixed":"', _s("n"), '.1"}]}]}]}'), lambda f: manifests.advisories(f.select(F.col("content").alias("json"))).select("id", "package", F.array_join("affected_versions", ",").alias("affected"), F.array_join("fixed_versions", ",").alias("fixed")), "SELECT 'A' || p AS id, 'pkg' || n AS package, '>=0' AS affected, n || '.1' AS fixed FROM part_v")
_code("a18_clean_versions", lambda: _text("^v1.", _s("n"), "-beta"), lambda f: f.select("path", manifests.clean_version(F.col("content")).alias("version")), "SELECT path, '1.' || n AS version FROM part_v")
_ISSUE = "SELECT 'f' || p || '.py' AS file_path, CAST(n AS INT) AS line, {rule} AS rule FROM part_v"
_code("a26_pylint_text", lambda: _text("f", _s("p"), ".py:", _s("n"), ":0: C0114: Missing docstring"), lambda f: linters.pylint_text(f.withColumnRenamed("content", "line")).select("file_path", "line", "rule"), _ISSUE.format(rule="'C0114'"))
_code("a27_flake8_text", lambda: _text("f", _s("p"), ".py:", _s("n"), ":5: E501 line too long"), lambda f: linters.flake8_text(f.withColumnRenamed("content", "line")).select("file_path", "line", "rule"), _ISSUE.format(rule="'E501'"))
_code("a28_eslint_text", lambda: _text("  ", _s("n"), ":5 error Unexpected var no-var"), lambda f: linters.eslint_text(f.withColumnRenamed("content", "line")).groupBy("line", "severity").agg(F.count("*").alias("k")), "SELECT CAST(n AS INT) AS line, 'error' AS severity, count(*) AS k FROM part_v GROUP BY 1")
_code("a23_pylint_json", lambda: _text('[{"type":"warning","path":"f', _s("p"), '.py","line":', _s("n"), ',"column":1,"symbol":"s', _s("p % 3"), '","message":"m"}]'), lambda f: linters.pylint_json(f.select(F.col("content").alias("json"))).select("file_path", "line", "rule"), _ISSUE.format(rule="'s' || (p % 3)"))
_code("a24_eslint_json", lambda: _text('[{"filePath":"f', _s("p"), '.py","messages":[{"ruleId":"r', _s("p % 3"), '","severity":2,"message":"m","line":', _s("n"), ',"column":1}]}]'), lambda f: linters.eslint_json(f.select(F.col("content").alias("json"))).select("file_path", "line", "rule"), _ISSUE.format(rule="'r' || (p % 3)"))


# findings
def _f(name, build, sql=None):
    _add(name, "findings_v", build, sql)


_SEC = "(" + ",".join(f"'{x}'" for x in SECURITY_TYPES) + ")"
_THREE = "CASE WHEN severity IN ('high','critical') THEN 'high' WHEN severity = 'medium' THEN 'medium' ELSE 'low' END"
_DEBT = "floor((CASE severity " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in DEBT_BASE.items()) + " END)::DOUBLE * (CASE finding_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in DEBT_FACTOR.items()) + " ELSE 1.0 END)::DOUBLE * confidence * 100 + 0.5) / 100"
_f("g01_in_file", lambda f: findings.in_file(f, "/src/user_7.py").select("ingest_seq"), "SELECT ingest_seq FROM findings_v WHERE file_path = '/src/user_7.py'")
_f("g03_allow_all", lambda f: findings.with_type(findings.with_severity(f, []), ["code_smell"]).select("ingest_seq"), "SELECT ingest_seq FROM findings_v WHERE finding_type = 'code_smell'")
_f("g13_cutoff", lambda f: usage.since(f, "2024-01-20 00:00:00", 7, "detected_at").select("ingest_seq"), "SELECT ingest_seq FROM findings_v WHERE detected_at >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 7 DAY")
_f("j11_table_view", lambda f: stats.table_view(f, 25, 1).select("ingest_seq", "severity"), f"SELECT ingest_seq, severity FROM findings_v ORDER BY {ORD} DESC, ingest_seq LIMIT 25 OFFSET 25")
_f("i05_total", stats.total, "SELECT count(*) AS total FROM findings_v")
_f("i08_categories", stats.by_category, "SELECT CASE WHEN finding_type IN ('design_pattern','anti_pattern','code_smell') THEN finding_type ELSE 'none' END AS category, count(*) AS n FROM findings_v GROUP BY 1")
_f("i09_weaknesses", lambda f: stats.weakness_stats(f, enrich.security_map(F.replace("message", F.lit("error"), F.lit("authentication")))), "SELECT count(*) AS n, CAST(2 AS BIGINT) AS cwes, CAST(1 AS BIGINT) AS categories FROM findings_v WHERE contains(message, 'error')")
_f("i20_pattern_summary", stats.pattern_summary, "SELECT count(*) AS total, count(*) FILTER (finding_type='design_pattern') AS design_pattern, count(*) FILTER (finding_type='anti_pattern') AS anti_pattern, count(*) FILTER (finding_type='code_smell') AS code_smell, count(*) FILTER (severity IN ('critical','high')) AS high, count(*) FILTER (severity='medium') AS medium, count(*) FILTER (severity IN ('low','info')) AS low, count(DISTINCT file_path) AS files FROM findings_v")
_f("j05_arrival", lambda f: stats.arrival(f, 20).select("ingest_seq"), "SELECT ingest_seq FROM findings_v ORDER BY ingest_seq LIMIT 20")
_f("m02_type_groups", lambda f: f.groupBy(type_group("finding_type").alias("type_group")).agg(F.count("*").alias("n")), f"SELECT CASE WHEN finding_type IN {_SEC} THEN '#security' WHEN finding_type IN ('code_smell','anti_pattern','maintainability') THEN '#quality' ELSE finding_type END AS type_group, count(*) AS n FROM findings_v GROUP BY 1")
_f("l01_union", lambda f: findings.unite(f.where("source = 'linter'").select("ingest_seq", "severity"), f.where("source = 'custom'").select("ingest_seq", "rule_id")), "SELECT ingest_seq, severity, CAST(NULL AS VARCHAR) AS rule_id FROM findings_v WHERE source = 'linter' UNION ALL SELECT ingest_seq, NULL, rule_id FROM findings_v WHERE source = 'custom'")
_f("f04_pattern_findings", lambda f: findings.from_pattern(f.select("file_path", "line_start", F.when(F.col("severity") == "critical", "critical").otherwise("warning").alias("severity"), F.lit("factory_method").alias("pattern_type"), F.lit("d").alias("description"), F.lit("s").alias("suggestion"), "confidence", F.array().cast("array<string>").alias("solutions"), F.array().cast("array<string>").alias("benefits"), F.lit(1).alias("line_end"), "message"), "design_pattern").groupBy("severity", "rule_id").agg(F.count("*").alias("n")), "SELECT CASE WHEN severity = 'critical' THEN 'high' ELSE 'low' END AS severity, 'factory_method' AS rule_id, count(*) AS n FROM findings_v GROUP BY 1")
_IMPACT = {"o05_maintainability": ("maintainability_impact", f"CASE WHEN finding_type IN ('code_smell','anti_pattern','style_violation','missing_documentation') THEN {_THREE} ELSE 'minimal' END"), "o06_security": ("security_impact", f"CASE WHEN finding_type IN {_SEC} THEN CASE WHEN severity IN ('critical','high','medium') THEN severity ELSE 'low' END ELSE 'minimal' END"), "o07_performance": ("performance_impact", "CASE WHEN finding_type IN ('performance_issue','memory_leak','inefficient_algorithm') THEN severity ELSE 'minimal' END"), "o08_reliability": ("reliability_impact", "CASE WHEN finding_type IN ('memory_leak','performance_issue','syntax_error','flaky_test') THEN severity ELSE 'minimal' END")}
for _name, (_k, _sql) in _IMPACT.items():
    _f(_name, lambda f, k=_k: f.select("ingest_seq", enrich.impacts()[k].alias("impact")), f"SELECT ingest_seq, {_sql} AS impact FROM findings_v")
_f("o09_impact_map", lambda f: enrich.enrich(f).select("ingest_seq", F.col("impact_analysis")["security_impact"].alias("security"), F.size(F.map_keys("impact_analysis")).cast("long").alias("kinds")), f"SELECT ingest_seq, {_IMPACT['o06_security'][1]} AS security, CAST(4 AS BIGINT) AS kinds FROM findings_v")
_f("o11_debt_timeline", stats.debt_timeline, f"SELECT CAST(detected_at AS DATE) AS day, ingest_seq, {_DEBT} AS debt FROM findings_v WHERE severity = 'critical'")
_f("h12_remediation", lambda f: enrich.remediation(f, f.sparkSession.createDataFrame([("code_smell", "refactor", 2), ("security_vulnerability", "patch", 8)], "finding_type string, steps string, effort int")).select("ingest_seq", "steps", "effort"), "SELECT ingest_seq, CASE finding_type WHEN 'code_smell' THEN 'refactor' WHEN 'security_vulnerability' THEN 'patch' END AS steps, CASE finding_type WHEN 'code_smell' THEN 2 WHEN 'security_vulnerability' THEN 8 END AS effort FROM findings_v")
_f("n15_levels", lambda f: f.select("ingest_seq", F.create_map(*(F.lit(x) for kv in reports.LEVELS.items() for x in kv))[F.col("severity")].alias("level")), "SELECT ingest_seq, CASE WHEN severity IN ('critical','high') THEN 'error' WHEN severity = 'medium' THEN 'warning' ELSE 'note' END AS level FROM findings_v")
_f("n04_slugs", lambda f: f.select(text.slug("message").alias("slug")).groupBy("slug").agg(F.count("*").alias("n")), "SELECT regexp_replace(regexp_replace(lower(message), '[^a-z0-9 _-]', '', 'g'), '[ _-]+', '-', 'g') AS slug, count(*) AS n FROM findings_v GROUP BY 1")
_f("b23_chat_message", lambda f: reports.chat_message(f).select("total", "urgent", "more"), "SELECT count(*) AS total, count(*) FILTER (severity IN ('critical','high')) AS urgent, greatest(count(*) FILTER (severity IN ('critical','high')) - 10, 0) AS more FROM findings_v")
_f("b01_json", lambda f: reports.as_json(f.select("ingest_seq", "severity", "rule_id")), "SELECT ingest_seq, '{\"severity\":\"' || severity || '\"' || coalesce(',\"rule_id\":\"' || rule_id || '\"', '') || '}' AS json FROM findings_v")
_f("e09_debt_score", stats.debt_score, "SELECT 10 * count(*) FILTER (severity='critical') + 5 * count(*) FILTER (severity='high') AS debt FROM findings_v")


# usage
def _u(name, build, sql=None):
    _add(name, "usage_v", build, sql)


_u("i29_profile", lambda u: stats.profile(u, "model", "output_tokens"), "SELECT model, count(*) AS n, min(output_tokens) AS least, max(output_tokens) AS most, round_even(avg(output_tokens), 6) AS mean, CAST(sum(output_tokens) AS BIGINT) AS total, quantile_cont(output_tokens, 0.5) AS median FROM usage_v GROUP BY 1")
_u("j08_fastest", lambda u: stats.fastest(u, "request_id", "output_tokens"), "SELECT request_id AS best, output_tokens AS value FROM usage_v ORDER BY output_tokens, request_id LIMIT 1")
_u("p02_limiter_status", lambda u: usage.limiter_status(u, 1_000_000, 3600), "SELECT count(*) AS requests, CAST(sum(input_tokens) AS BIGINT) AS used, CAST(greatest(1000000 - sum(input_tokens), 0) AS BIGINT) AS remaining FROM usage_v WHERE timestamp >= (SELECT max(timestamp) FROM usage_v) - INTERVAL 1 HOUR")
_u("p03_token_bucket", lambda u: usage.replay_bucket(u, 0.001, 2.0))
_u("p08_samples", lambda u: usage.sampled(u, "1 hour", "output_tokens"), "SELECT date_trunc('hour', timestamp) AS start, round_even(avg(output_tokens), 6) AS mean, min(output_tokens) AS least, max(output_tokens) AS most FROM usage_v GROUP BY 1")
_u("n07_dates", lambda u: u.select("request_id", F.date_format("timestamp", "yyyy-MM-dd HH:mm").alias("stamp"), F.to_date(F.date_trunc("month", "timestamp")).alias("month"), F.to_date("timestamp").alias("day")), "SELECT request_id, strftime(timestamp, '%Y-%m-%d %H:%M') AS stamp, CAST(date_trunc('month', timestamp) AS DATE) AS month, CAST(timestamp AS DATE) AS day FROM usage_v")
_u("n09_backoff", lambda u: u.select("request_id", text.backoff(F.col("request_id") % 10).alias("wait")), "SELECT request_id, least(pow(2.0, request_id % 10), 60.0)::DOUBLE AS wait FROM usage_v")


# packages
def _p(name, build, sql):
    QUERIES[name] = lambda spark, sf_dir: build(packages_v(spark, sf_dir), advisories_v(spark, sf_dir))
    ORACLES[name] = f"WITH {SQL['packages_v']}, {SQL['advisories_v']} {sql}"


_NODES = "SELECT DISTINCT 'manifest:' || manifest AS source, 'package:' || package AS target FROM packages_v"
_p("h01_out_edges", lambda p, a: deps.out_edges(deps.graph(p), p.select(F.concat(F.lit("manifest:"), F.col("manifest").cast("string")).alias("node")).where("node rlike '7$'")), f"SELECT * FROM ({_NODES}) WHERE source LIKE '%7'")
_p("h02_in_edges", lambda p, a: deps.in_edges(deps.graph(p), p.join(a, "package", "left_semi").select(F.concat(F.lit("package:"), F.col("package").cast("string")).alias("node"))), f"SELECT * FROM ({_NODES}) WHERE target IN (SELECT 'package:' || package FROM advisories_v)")
_p("b12_dependency_rows", lambda p, a: deps.report_rows(p, a), "SELECT manifest, position, package_manager, package, version, coalesce(licence, 'Unknown') AS licence, CASE WHEN dev THEN 'development' ELSE 'production' END AS type, CASE WHEN optional THEN 'Yes' ELSE 'No' END AS optional, CASE WHEN package IN (SELECT package FROM advisories_v) THEN 'Yes' ELSE 'No' END AS vulnerable FROM packages_v")
_p("o13_direct_tree", lambda p, a: deps.direct_tree(p).select("manifest", F.array_join(F.transform("packages", lambda x: x.cast("string")), ",").alias("packages")), "SELECT manifest, string_agg(CAST(package AS VARCHAR), ',' ORDER BY package) AS packages FROM (SELECT DISTINCT manifest, package FROM packages_v) GROUP BY 1")
_p("f02_vulnerability_findings", lambda p, a: findings.from_vulnerability(deps.advisories_of(p, a).select(F.col("manifest").cast("string").alias("file_path"), "severity", F.col("package").cast("string").alias("title"), F.lit("").alias("description"), F.lit(None).cast("string").alias("cve_id"), F.lit("A1").alias("advisory_id"))).groupBy("severity", "rule_id").agg(F.count("*").alias("n"), F.countDistinct("title", "message").alias("titles"), F.first(F.array_join("tags", ",")).alias("tags")), "SELECT a.severity, 'A1' AS rule_id, count(*) AS n, count(DISTINCT p.package) AS titles, 'dependency,security,vulnerability' AS tags FROM packages_v p JOIN advisories_v a USING (package) GROUP BY 1")
_p("f03_outdated_findings", lambda p, a: findings.from_outdated(p.where("version < 5").select(F.col("manifest").cast("string").alias("file_path"), F.col("package").cast("string").alias("package"))).groupBy("title", "severity").agg(F.count("*").alias("n")), "SELECT 'Outdated Package: ' || package AS title, 'low' AS severity, count(*) AS n FROM packages_v WHERE version < 5 GROUP BY 1")


# files: tables of a cache, paths, batches
def _d(name, build, sql=None):
    _add(name, "files_v", build, sql)


def _cache(f):
    return f.select(F.col("path").alias("key"), (F.col("doc_id") % 100).alias("timestamp"), F.when(F.col("doc_id") % 3 != 0, F.lit(40)).alias("ttl"), F.col("size").alias("value"))


_DEAD = "doc_id % 3 <> 0 AND 90 - doc_id % 100 > 40"
_d("g14_live", lambda f: cachetable.live(_cache(f), 90).select("key"), f"SELECT path AS key FROM files_v WHERE NOT ({_DEAD})")
_d("i33_cache_stats", lambda f: cachetable.stats(_cache(f), 90), f"SELECT count(*) AS size, count(*) FILTER ({_DEAD}) AS expired, count(*) FILTER (NOT ({_DEAD})) AS active FROM files_v")
_d("s05_read_through", lambda f: cachetable.read_through(f.select(F.col("path").alias("key")), _cache(f.where("doc_id % 2 = 0")), _cache(f.where("doc_id % 3 = 0"))), "SELECT path AS key, CASE WHEN doc_id % 2 = 0 OR doc_id % 3 = 0 THEN size END AS value, CASE WHEN doc_id % 2 = 0 THEN 1 WHEN doc_id % 3 = 0 THEN 2 ELSE 0 END AS level FROM files_v")
_d("s06_file_hash", lambda f: f.select("path", cachetable.file_hash(F.col("doc_id"), F.col("size")).alias("hash")), "SELECT path, md5(doc_id || ':' || size) AS hash FROM files_v")
_d("s08_history", lambda f: cachetable.history_page(f.select(F.col("doc_id").alias("id"), "path"), 0, 20), "SELECT doc_id AS id, path FROM files_v ORDER BY doc_id DESC LIMIT 20")
_d("n18_paths", lambda f: f.select("path", text.basename(F.col("path")).alias("basename"), F.regexp_extract("path", r"^/([^/]*)/", 1).alias("top")), "SELECT path, string_split(path, '/')[-1] AS basename, string_split(path, '/')[2] AS top FROM files_v")
_d("a05_file_types", lambda f: f.select("path", text.file_type(F.concat("path", F.lit("."), F.element_at(F.array(*map(F.lit, ["PY", "tsx", "yml", "zip"])), (F.col("doc_id") % 4 + 1).cast("int")))).alias("file_type")), "SELECT path, ['python','typescript','yaml','unknown'][CAST(doc_id % 4 + 1 AS INT)] AS file_type FROM files_v")
_d("e13_test_files", lambda f: f.select("doc_id", text.is_test_file(F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("/tests"), "path")).when(F.col("doc_id") % 4 == 1, F.concat("path", F.lit("_test.py"))).otherwise(F.col("path"))).alias("is_test")), "SELECT doc_id, doc_id % 4 < 2 AS is_test FROM files_v")
_d("a11_directories", lambda f: scans.directories(f, "/src1"), "SELECT DISTINCT string_split(path, '/')[3] AS name FROM files_v WHERE starts_with(path, '/src1/')")
_d("g09_size_band", lambda f: batching.whole_files(f, 400).where("tokens >= 50").select("path", "end_line"), "SELECT path, CAST(len(string_split(regexp_replace(content, '\\r?\\n$', ''), chr(10))) AS INT) AS end_line FROM files_v WHERE tokens BETWEEN 50 AND 400")
_d("n11_tokens", lambda f: f.select("path", batching.token_count(F.col("content")).alias("tokens")), "SELECT path, tokens FROM files_v")
_d("j06_priority", lambda f: f.select("path", batching.priority((F.col("doc_id") % 7 == 0).cast("long"), F.col("doc_id") % 5, F.col("doc_id") % 3).alias("score")), "SELECT path, CAST(1000 * (doc_id % 7 = 0)::INT + doc_id % 5 + 10 * (doc_id % 3) AS BIGINT) AS score FROM files_v")
_d("i32_batch_totals", lambda f: batching.batch_totals(f.select((F.col("doc_id") % 10).alias("batch_id"), "tokens")), "SELECT doc_id % 10 AS batch_id, count(*) AS n, CAST(sum(tokens) AS BIGINT) AS tokens FROM files_v GROUP BY 1")
_add("e10_grade", "lines_v", lambda x: x.groupBy("doc_id").agg(F.count("*").alias("n")).select("doc_id", stats.grade(F.col("doc_id") % 20, F.col("n")).alias("grade")), "SELECT doc_id, CASE WHEN doc_id % 20 / greatest(n / 1000.0, 1) <= 1 THEN 'A' WHEN doc_id % 20 / greatest(n / 1000.0, 1) <= 3 THEN 'B' WHEN doc_id % 20 / greatest(n / 1000.0, 1) <= 7 THEN 'C' WHEN doc_id % 20 / greatest(n / 1000.0, 1) <= 15 THEN 'D' ELSE 'F' END AS grade FROM (SELECT doc_id, count(*) AS n FROM lines_v GROUP BY 1)")
