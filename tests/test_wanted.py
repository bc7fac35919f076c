"""Trees of which only some nodes and columns are wanted, and texts that many tasks parse."""

import ast

from codeseam.adapters import spread
from codeseam.sources import parsers, trees

CODE = '''import os.path, a
from .b import c as d
@deco(lambda: [x for x in y])
class K(B, metaclass=M):
    z = w = 1
    def m(self, *, q=1):
        try:
            if q and (p or not q):
                with q as r: pass
        except E as e:
            import late
        else:
            for i in r: s, t = i, i
        finally:
            match q:
                case [u] if u: v = 1
async def n(): await o
__all__ = ["x", "y"]
while 1:
    if 2: pass
    elif 3: g = lambda: 1 if 2 else 3
'''
BROKEN = "import os\n  from .a import b\nx = 1\nif x == 1\nclass C:\n    async def g(self):\n        y == 2\n"


def texts(spark):
    return spark.createDataFrame([("/a", CODE), ("/b", BROKEN), ("/c", None), ("/d", "")], "path string, content string")


def check_same(spark, build, want):
    """What build makes of the wanted part of the trees is what it makes of whole ones."""
    f = texts(spark)
    part = parsers.nodes(f, "python", **want)
    assert part.columns == [c for c in parsers.nodes(f, "python").columns if c in want["columns"]]
    rows = [sorted(map(repr, build(t).collect())) for t in (parsers.nodes(f, "python"), part)]
    assert rows[0] == rows[1] and rows[0]
    assert part.count() < parsers.nodes(f, "python").count() / 2


def test_small_table_is_spread(spark):
    rows = spark.range(1000).coalesce(1)
    out = spread(rows, "id")
    assert out.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    assert sum(n > 0 for n in out.rdd.glom().map(len).collect()) > 8 and out.distinct().count() == 1000


def test_wanted_nodes_are_those_of_whole_trees():
    whole = trees.python_nodes_of(CODE)
    assert [n["node_type"] for n in whole[:2]] == ["Module", "Import"] and len(whole) == sum(1 for _ in ast.walk(ast.parse(CODE)))
    for kinds in (["alias", "ImportFrom"], ["Assign", "FunctionDef"], ["BoolOp", "Name"], ["ExceptHandler", "If"], []):
        for columns in (("path", "node_type", "name", "depth", "parent_type", "parent_name", "parent_line", "line", "end_line"), ("node_id", "parent_id", "attrs")):
            got = trees.python_nodes_of(CODE, trees.Want(frozenset(kinds), frozenset(), columns))
            assert [[n[c] for c in columns[1:]] for n in got] == [[n[c] for c in columns[1:]] for n in whole if n["node_type"] in kinds]
    got = trees.python_nodes_of(CODE, trees.Want(frozenset(), frozenset(["ClassDef"])))
    assert got == [n for n in whole if n["parent_type"] == "ClassDef"]


def test_imports(spark):
    check_same(spark, parsers.python_imports, parsers.IMPORTS)


def test_exports(spark):
    check_same(spark, parsers.python_exports, parsers.EXPORTS)


def test_edges(spark):
    check_same(spark, parsers.python_edges, parsers.EDGES)


def test_yaml_parsers_agree(spark):
    """The parser in C is used, and never where it differs from the other one or would fall over."""
    import yaml

    calls = []
    loader = yaml.CSafeLoader
    for text in ("a:\t1", "[1? ]", "[" * 900 + "]" * 900, "- " * 900, "a: [", "{a: 1}", "a:\n- b: 2020-01-01\n", "", "a: \x07", "%x"):
        assert trees.parsed(trees.yaml_nodes_of, text) == trees.parsed(lambda s: trees.flat(yaml.safe_load(s), "mapping", "sequence"), text)
    try:
        yaml.CSafeLoader = lambda s: calls.append(s) or loader(s)
        trees.yaml_nodes_of("a: 1")
        trees.yaml_nodes_of("[" * 300 + "]" * 300)
    except RecursionError:
        pass
    finally:
        yaml.CSafeLoader = loader
    assert calls == ["a: 1"]


def test_yaml_edges(spark):
    f = spark.createDataFrame([("/a", "services:\n  w:\n    image: r\n    build:\n      context: ../e\njobs:\n  j:\n    uses: o/r@v\n"), ("/b", "a: [")], "path string, content string")
    whole, part = (sorted(map(tuple, parsers.yaml_edges(parsers.nodes(f, "yaml", **w)).collect())) for w in ({}, parsers.YAML_EDGES))
    assert part == whole and len(part) == 3


def test_findings_visit_statements_only(spark, monkeypatch):
    """Rules look at statements: no expression is visited, and nested ones are found all the same."""
    from codeseam.sources import detectors

    seen = []
    monkeypatch.setattr(detectors, "below", lambda n: seen.append(n) or trees.below(n))
    deep = "def create_a(x):\n" + "".join("    " * k + "if x:\n" for k in range(1, 7)) + "    " * 7 + "return [lambda: y]\n"
    assert [f[2] for f in detectors.python_findings_of(deep)] == ["deep_nesting", "factory_method"]
    assert seen and all(isinstance(n, (ast.stmt, ast.Module)) for n in seen)
    assert {f[2] for f in detectors.python_findings_of(CODE)} == set()


def test_god_classes(spark):
    f = spark.createDataFrame([("/a", "class A:\n" + "    x = 1\n" * 16 + "class A:\n    y = 2\n" + "def f():\n" + "    z = 1\n" * 30)], "path string, content string")
    whole, part = (parsers.god_classes(parsers.nodes(f, "python", **w)).collect() for w in ({}, parsers.GOD_CLASSES))
    assert part == whole and len(part) == 1
    assert parsers.nodes(f, "python", **parsers.GOD_CLASSES).count() == 17


def test_complexity(spark):
    check_same(spark, parsers.python_complexity, parsers.COMPLEXITY)


def test_metrics_do_not_copy_rows(spark):
    f = texts(spark)
    assert "Expand" not in parsers.python_metrics(f)._jdf.queryExecution().optimizedPlan().toString()
    got = {r.path: r.asDict() for r in parsers.python_metrics(f.where("path <> '/c'")).collect()}
    assert (got["/a"]["functions"], got["/a"]["classes"], got["/a"]["imports"], got["/a"]["complexity"]) == (2, 1, 4, 10) and got["/b"]["total_lines"] == 7


def test_graph_is_not_sent_to_driver(spark):
    from codeseam.operators import deps, filegraph

    files = spark.createDataFrame([(f"/p/m{k}.py",) for k in range(5)], "path string")
    edges = spark.createDataFrame([(f"/p/m{k}.py", "python", f".m{(k + 1) % 5}") for k in range(5)], "path string, file_type string, target string")
    found = filegraph.resolved(edges, files)
    out = deps.out_edges(found, files.withColumnRenamed("path", "node"))
    assert out.count() == 5 and "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert filegraph.cycles(found.select("source", "target")).count() == 5


def test_symbols(spark):
    check_same(spark, parsers.python_symbols, parsers.SYMBOLS)


def test_long_methods(spark):
    f = spark.createDataFrame([("/a", "def f():\n" + "    x = 1\n" * 60 + "async def g():\n" + "    x = [1, 2]\n" * 51)], "path string, content string")
    whole, part = (sorted(parsers.long_methods(parsers.nodes(f, "python", **w)).collect()) for w in ({}, parsers.LONG_METHODS))
    assert part == whole and len(part) == 2 and parsers.nodes(f, "python", **parsers.LONG_METHODS).count() == 2


def test_snippets_make_trees_once(spark):
    from codeseam.operators import batching

    f = texts(spark)
    whole, part = (batching.tree_snippets(parsers.nodes(f, "python", **w), f, 1, 10_000) for w in ({}, batching.SNIPPETS))
    assert part._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    rows = sorted(map(repr, part.collect()))
    assert rows == sorted(map(repr, whole.collect()))
    assert sorted((r.name, r.start_line, r.end_line) for r in part.where("path = '/a'").collect()) == [("K", 4, 16), ("m", 6, 17), ("n", 17, 22)]
