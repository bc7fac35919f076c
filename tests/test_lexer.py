"""The lexer of scripts on texts that regular expressions over lines get wrong."""

import time

import pytest

from codeseam.sources import lexer

CODE = '''#!/usr/bin/env node
// function fake() { if (x) {} }
const s = "function no() { return a && b; }" + 'it\\'s } ';
/* class Hidden {
} */ const re = /[/}]"{/g, half = s / 2 / re;
function outer(a, b = {x: [1]}) {
  if (a && b || s) { return `x ${a ? `y${b}` : "}"} { function z() {`; }
  const inner = async (q) => { for (;;) { while (q) { half(); } } };
  return inner;
}
class K extends Base {
  static async m1() { switch (s) { case 1: return; case 2: return 77; } }
  *gen() {}
  get prop() { return this.if ? 1 : 2 }
}
const f = x =>
  x > 1_000 ? x : go(x).then(a)
    .then(b).then(
      c => 0x1F)
const o = { run() { try { return 1 } catch (e) { return a?.b ?? 42 } }, half: 2 };
export default function* () {
  fetchIt().then(r => r).catch(() => 0);
}
interface T { a?: string; b(x?: number): void }
function typed(x?: number): Array<string> { return [] }
'''


def units(source):
    t = lexer.tokens_of(source)
    return t, lexer.units_of(t)


def test_units():
    t, found = units(CODE)
    got = [(u.kind, u.name, *u.lines, u.level, u.complexity) for u in found if u.kind != "variable"]
    assert got == [
        ("function", "outer", 6, 10, 0, 5), ("arrow", "inner", 8, 8, 1, 3), ("class", "K", 11, 15, 0, 1), ("method", "m1", 12, 12, 0, 3), ("method", "gen", 13, 13, 0, 1), ("method", "prop", 14, 14, 0, 2),
        ("arrow", "f", 16, 19, 0, 2), ("arrow", None, 19, 19, 1, 1), ("method", "run", 20, 20, 0, 3), ("function", None, 21, 23, 0, 1), ("arrow", None, 22, 22, 1, 1), ("arrow", None, 22, 22, 1, 1),
        ("function", "typed", 25, 25, 0, 1),
    ]
    assert [u.name for u in found if u.kind == "variable"] == ["s", "re", "inner", "f", "o"]
    for k, x in enumerate(t):
        if x.match >= 0:
            assert t[x.match].match == k


def test_findings():
    t, found = units(CODE)
    got = {(line, name) for line, _, name, _, _ in lexer.findings_of(t, found)}
    assert got == {(12, "magic_number"), (20, "magic_number"), (17, "promise_hell"), (17, "missing_error_handling"), (16, "unused_variable"), (20, "unused_variable")}
    deep = "a(function(){b(()=>{c(()=>{d(()=>{e(()=>{})})})})})"
    assert [x[2] for x in lexer.findings_of(*units(deep))] == ["callback_hell"]
    long = "function big() {\n" + "x();\n" * 50 + "}"
    assert [x[2] for x in lexer.findings_of(*units(long))] == ["large_function"]
    assert not list(lexer.findings_of(*units(long.replace("x();\n", "", 2))))


@pytest.mark.parametrize("text", ["", "\n", "'open", '"open\nx', "`open ${ a", "/* open", "}})]", "((({", "a = /[", "\\", "'\\", "x => ", "function", "class", "=>", "`${`${`", "const", "a(", "\x00é퟿", "#!", "/", "function f(", "class A"])
def test_any_text(text):
    assert next(lexer.rows_of(text))[0] == "file"
    assert list(lexer.rows_of(text * 3))


def test_rejoined():
    assert "".join(x.text for x in lexer.tokens_of(CODE, comments=True)).replace(" ", "").replace("\n", "") == CODE.replace("`", "").replace(" ", "").replace("\n", "")


def test_linear():
    script = "".join(f"const v{i} = {{k: [v{i - 1}, 'x' /* y */]}};\nfunction f{i}(a) {{ if (a) {{ return v{i} / 2; }} }}\n" for i in range(8000))
    began = time.process_time()
    rows = list(lexer.rows_of(script))
    assert time.process_time() - began < 20 and sum(r[1] == "function" for r in rows) == 8000
    assert [r[2] for r in rows if r[0] == "finding"] == []


def test_frames(spark):
    files = spark.createDataFrame([("/a.js", CODE, "clash"), ("/b.js", None, "clash"), ("/c.js", "let x", "clash")], "path string, content string, kind string")
    found = lexer.syntax(files).cache()
    assert {r.path: (r.complexity, r.most, r.functions) for r in lexer.complexity(found).collect()} == {"/a.js": (13, 5, 12), "/b.js": (1, 0, 0), "/c.js": (1, 0, 0)}
    assert {(r.path, r.name) for r in lexer.symbols(found).where("kind = 'variable'").collect()} >= {("/c.js", "x"), ("/a.js", "re")}
    told = {r.name: r.text for r in lexer.snippets(files, found).collect()}
    assert told["K"] == "\n".join(CODE.split("\n")[10:15]) and told["outer"].endswith("inner;\n}")
    assert lexer.findings(found).count() == 7
    assert lexer.syntax(files.limit(0)).count() == 0


def test_unused_by_lines_is_linear(spark):
    """The rule over lines that detect() applies: names on one line only; time grows with the file."""
    from codeseam.sources import detectors

    lines = ["let a = 1; let a = 2", "const b = a", "var c", "let c", "let $d = $d", "const e", "", "letter e2", "const f = 1; f()"]
    long = [x for i in range(8000) for x in (f"const v{i} = 1;", f"use(v{i - 1});")]
    files = spark.createDataFrame([("/a.js", "javascript", "\n".join(lines)), ("/long.js", "javascript", "\n".join(long))], "path string, file_type string, content string")
    detectors.detect(files.where("path = '/a.js'")).collect()
    began = time.monotonic()
    got = {(r.file_path, r.line, r.message) for r in detectors.detect(files, ["unused_variable"]).collect()}
    assert got == {("/a.js", 2, "Unused variable b"), ("/a.js", 5, "Unused variable $d"), ("/a.js", 6, "Unused variable e"), ("/a.js", 9, "Unused variable f"), ("/long.js", 15999, "Unused variable v7999")}
    assert time.monotonic() - began < 60


def test_scripts_are_dealt_to_many_tasks(spark):
    from codeseam.plans import projects

    files = projects.script_files(spark, "/root/testdata/sf0.001")
    assert files.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    assert files.select("path").distinct().count() == files.count() == 200


def test_wanted_parts_are_those_of_all(spark):
    files = spark.createDataFrame([("/a.js", CODE), ("/b.js", None)], "path string, content string")
    whole = lexer.syntax(files).collect()
    for part in ("file", "unit", "finding"):
        assert lexer.syntax(files, [part]).collect() == [r for r in whole if r.part == part] != []


def test_brackets_that_nothing_opens_are_linear():
    began = time.process_time()
    assert len(lexer.tokens_of("(" * 30000 + "}" * 30000)) == 60000
    assert time.process_time() - began < 5


def test_complexity_of_files_that_share_a_path(spark):
    files = spark.createDataFrame([("/a.js", "if (a) {}"), ("/a.js", "function f() { if (a || b) {} }"), ("/a.js", "if (a) {}")], "path string, content string")
    found = lexer.complexity(lexer.syntax(files, ["file"]))
    assert sorted(map(tuple, found.collect())) == [("/a.js", 2, 0, 0), ("/a.js", 2, 0, 0), ("/a.js", 3, 3, 1)]
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_arrow_without_head():
    assert [u.lines for u in units("=> a\nb")[1]] == [(1, 1)]


def test_snippets_do_not_go_through_the_driver(spark):
    from codeseam.plans import projects

    plan = projects.QUERIES["r01_script_snippets"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    files = spark.createDataFrame([("/a.js", "function f() {\n}"), ("/a.js", "function f() {\n}")], "path string, content string")
    assert [r.text for r in lexer.snippets(files, lexer.syntax(files, ["unit"])).collect()] == ["function f() {\n}"] * 4


def test_unused_by_lines_joins_nothing(spark):
    """Words of all lines met declarations by a join that Spark made through the driver."""
    from codeseam.functions import text
    from codeseam.plans import details
    from codeseam.sources import detectors

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    codes = ["let a = 1; let a = 2\nconst b = a", "let c\nlet c", "const e\r\n$e", "var x = x", None, "", "let y; const y1 = y\nletter y1", "myconst z"]
    files = spark.createDataFrame([(f"/{k}.js", code) for k, code in enumerate(codes)], "path string, content string")
    found = [text.unused_variables(text.lines(files)), detectors.unused_variables(files)]
    assert sorted(map(tuple, found[0].select("path", "name", "line_no").collect())) == sorted(map(tuple, found[1].collect())) == [
        ("/0.js", "b", 2), ("/2.js", "e", 1), ("/3.js", "x", 1), ("/6.js", "y", 1), ("/7.js", "z", 1)]
    assert "Join" not in plan(found[0]) and "Exchange" not in plan(found[1])
    assert "Join" not in plan(details.QUERIES["d10_unused_variables"](spark, "/root/testdata/sf0.001"))
    assert detectors.unused_variables(files.where("path = '/2.js'").union(files.where("path = '/2.js'"))).count() == 2


def test_remembered_lines_change_nothing(monkeypatch):
    text = "#!x\n" + CODE + "#!x\n} else {\n((\n))\n)](\n'open\n" + "x" * 300 + "(\n\n\t\r\nlet s = `a\nb(\n${c(\n{}\n)}\n}\n`\n}\n" + CODE + "const last = [\n1]"
    parts = [text, text * 2, CODE.replace(" ", "\n"), text.replace(" ", "\n")]

    def told():
        return [([(x.kind, x.text, x.line, x.match) for x in lexer.tokens_of(p)], list(lexer.rows_of(p))) for p in parts]

    lexer._plain_line.cache_clear()
    got = told()
    assert lexer._plain_line.cache_info().hits > 100 and told() == got
    monkeypatch.setattr(lexer, "_PLAIN", lexer.re.compile("(?!)"))
    assert told() == got
