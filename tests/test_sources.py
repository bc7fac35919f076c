"""Scans, parsers, detectors, manifests and linter output on small fixtures."""

import json

from pyspark.sql import functions as F

from codeseam.functions import text
from codeseam.operators import batching, cachetable
from codeseam.plans import pipeline
from codeseam.sources import files as scans
from codeseam.sources import linters, manifests, parsers

PY = 'import os\nfrom a.b import c as d, e\nfrom . import x\n\nclass S:\n    def __new__(cls):\n        if True:\n            return None\n\ndef create_a(k):\n    if k:\n        return 1\n' + "def long():\n" + "    x = 1\n" * 50 + "def brief():\n" + "    y = 2\n" * 49
JS = "const alpha = 42;\nlet beta = 100;\nfetch(u).then(a).then(b).then(c)\nconsole.log(alpha)"


def one(spark, content, path="/f"):
    return spark.createDataFrame([(path, content)], "path string, content string")


def test_scan(spark, tmp_path):
    for name, body in {"a.py": PY, "b.js": JS, "node_modules/c.js": "1", "d.pyc": "x", "tests/test_e.py": "a = 1"}.items():
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text(body)
    (tmp_path / "latin.md").write_bytes("# caf\xe9".encode("latin-1"))
    f = scans.scan(spark, str(tmp_path)).cache()
    got = {r.path.rsplit("/", 1)[-1]: r for r in f.collect()}
    assert set(got) == {"a.py", "b.js", "test_e.py", "latin.md"}
    assert got["latin.md"].content == "# caf\xe9" and got["b.js"].file_type == "javascript"
    assert scans.scan(spark, str(tmp_path), include_tests=False).count() == 3
    assert scans.scan_paths(spark, [str(tmp_path), str(tmp_path / "tests")]).count() == 4
    found = {(r.file_path.rsplit("/", 1)[-1], r.pattern_name) for r in pipeline.detect(f).collect()}
    assert {("a.py", "singleton"), ("a.py", "factory_method"), ("a.py", "long_method"), ("b.js", "magic_number"), ("b.js", "unused_variable"), ("b.js", "promise_hell")} == found
    assert pipeline.analyse(spark, str(tmp_path))["risk"].count() == 1


def test_detectors_of_scripts(spark):
    lines = text.lines(one(spark, JS))
    assert [(r.line_no, r.number) for r in text.magic_numbers(lines).collect()] == [(1, "42")]
    assert [r.name for r in text.unused_variables(lines).collect()] == ["beta"]
    assert text.promise_chains(lines).count() == 1 and text.unhandled_promises(lines).count() == 0
    tail = "p.then(f)\n" + "x\n" * 5
    assert text.unhandled_promises(text.lines(one(spark, tail + "p.catch(f)\ny"))).count() == 1
    assert text.unhandled_promises(text.lines(one(spark, "p.then(f)\nx\n.catch(g)\nx\nx\nx\nx\nx"))).count() == 0
    assert text.js_complexity(one(spark, JS)).first().complexity == 1


def test_python(spark):
    n = parsers.nodes(one(spark, PY), "python").cache()
    assert {r.target for r in parsers.python_edges(n).collect()} == {"os", "a.b.c", "a.b.e", ".x"}
    assert {("class", "S"), ("function", "long")} <= {(r.kind, r.name) for r in parsers.python_symbols(n).collect()}
    assert [r.message for r in parsers.long_methods(n).collect()] == ["long has 51 lines"]
    assert parsers.python_complexity(n).first().complexity == 3
    assert parsers.nodes(one(spark, "def ("), "python").first().node_type == "Error"


def test_python_variables(spark):
    n = parsers.nodes(one(spark, "a = b = 1\n(c, d.e), f = g\nh, *i = [j, k] = l\nm: int = 1\nn += 1\nclass O:\n    p = [q for q in r]\n"), "python")
    assert {r.name for r in parsers.python_symbols(n).where("kind = 'variable'").collect()} == {"a", "b", "f", "h", "j", "k", "p"}


def test_python_with_syntax_error(spark):
    f = one(spark, "import os\n  from .a import b\nx = 1\nif x == 1\nclass C:\n    async def g(self):\n        y == 2\n").withColumn("file_type", F.lit("python"))
    n = parsers.nodes(f, "python").cache()
    assert n.where("node_type = 'Error'").count() == 1
    assert {(r.target, r.line, r.is_relative) for r in parsers.python_edges(n).collect()} == {("os", 1, False), (".a", 2, True)}
    assert {(r.kind, r.name) for r in parsers.python_symbols(n).collect()} == {("variable", "x"), ("class", "C"), ("function", "g")}
    assert parsers.python_complexity(n).first().complexity == 1
    r = pipeline.detect(f).collect()
    assert [(x.pattern_name, x.severity, x.line) for x in r] == [("analysis_error", "error", 2)] and r[0].message.startswith("Analysis failed: ")
    deep = one(spark, "a = " + "-" * 200_000 + "1")
    assert [x.pattern_name for x in parsers.structural_findings(deep).collect()] == ["analysis_error"]


def test_other_parsers(spark):
    j = parsers.nodes(one(spark, '{"a":{"b":1},"c":[{"d":2}]}'), "json")
    assert {r.key for r in parsers.key_paths(j).collect()} == {"a", "a.b", "c", "c[0].d"}
    assert parsers.nodes(one(spark, "{"), "json").first().node_type == "Error"
    m = one(spark, "## Hello, World!\n![a](b.png)\n```\n# no\n```\n")
    assert {(r.kind, r.target) for r in parsers.edges(m, "markdown").collect()} == {("link", "b.png"), ("image", "b.png")}
    assert [r.symbol for r in parsers.markdown_headers(text.lines(m)).where("line_no = 1").collect()] == ["h2-hello-world"]
    assert [r.section for r in parsers.markdown_sections(text.lines(m)).orderBy("line_no").collect()] == ["Hello, World!"] * 6
    h = one(spark, '<p class="a b"><script>function f(){}</script><a href="x.html">')
    assert {(r.kind, r.name) for r in parsers.html_symbols(h).collect()} == {("class", "a"), ("class", "b"), ("function", "f")}
    assert {r.kind for r in parsers.edges(one(spark, "import a from './b'\nrequire('c')"), "javascript").collect()} == {"import", "require"}
    assert {r.name for r in parsers.symbols(one(spark, ".x { --y: 1 }"), "css").collect()} == {"x", "--y"}


def test_manifests(spark):
    r = manifests.requirements(one(spark, "flask==2.3.2\nrequests>=2.31.0\n# c\nnumpy\nuvicorn[standard]==0.1"))
    assert {(x.package, x.version) for x in r.collect()} == {("flask", "==2.3.2"), ("requests", ">=2.31.0")}
    files = spark.createDataFrame([("/package.json", json.dumps({"dependencies": {"a": "1"}, "devDependencies": {"a": "2", "b": "3"}, "optionalDependencies": {"b": "3"}})), ("/pyproject.toml", "[tool.poetry.dependencies]\npython='3'\nx='1'\n"), ("/Pipfile", "[packages\n"), ("/z/y/x/package.json", "{}")], "path string, content string")
    assert manifests.discover(files).count() == 3
    got = {(r.package, r.version, r.dev, r.optional) for r in manifests.packages(files).where("error is null").collect()}
    assert got == {("a", "2", True, False), ("b", "3", True, True), ("x", "1", False, False)}
    assert manifests.packages(files).where("error is not null").count() == 1


def test_linters(spark):
    line = lambda s: spark.createDataFrame([(s,)], "line string")
    r = linters.pylint_text(line("a.py:3:0: C0114: Missing module docstring")).first()
    assert (r.line, r.column, r.rule, r.message) == (3, 0, "C0114", "Missing module docstring")
    r = linters.flake8_text(line("a.py:10:5: E501 line too long")).first()
    assert (r.line, r.column, r.rule, r.message) == (10, 5, "E501", "line too long")
    r = linters.eslint_text(line("3:5 error Unexpected var no-var")).first()
    assert (r.line, r.column, r.severity, r.rule) == (3, 5, "error", "error")


def test_batches_and_cache(spark):
    s = spark.createDataFrame(list(enumerate([6, 5, 5, 12, 3])), "seq long, tokens long")
    assert [r.batch_id for r in batching.next_fit(s, "seq", "tokens", 10).orderBy("seq").collect()] == [0, 1, 1, 2, 3]
    c = spark.createDataFrame([("k1", 1), ("k2", 2), ("k3", 3)], "key string, accessed int")
    assert {r.key for r in cachetable.evict(c, 2).collect()} == {"k2", "k3"}
    t = spark.createDataFrame([("a", 0, 5), ("b", 0, None)], "key string, timestamp int, ttl int")
    assert [r.key for r in cachetable.live(t, 10).collect()] == ["b"]
