"""Resolution of names to files, cycles and reachability against plain versions."""

import random

import pytest

from codeseam.operators import filegraph

FILES = [
    "/src/app/__init__.py", "/src/app/core/__init__.py", "/src/app/core/base.py", "/src/app/core/base/__init__.py", "/src/app/run.py", "/src/tools.py", "/tools.py", "/src/app/tools.py",
    "/web/a.ts", "/web/a.js", "/web/lib/index.tsx", "/web/lib/b.mjs", "/web/c.d.ts", "/shared/x.json", "/web/page.html", "/web/style/_part.scss", "/web/style/main.css", "/docs/README.md", "/docs/guide.md", "/ci/act/action.yml",
]
CASES = [  # of a file, of a type, a name: what it means
    ("/src/app/core/base.py", "python", ".", "/src/app/core/__init__.py"),
    ("/src/app/core/base.py", "python", "..run.main", "/src/app/run.py"),
    ("/src/app/core/base.py", "python", "..core.base.f", "/src/app/core/base.py"),
    ("/src/app/core/base.py", "python", "...tools", "/src/tools.py"),
    ("/src/app/core/base.py", "python", ".....x", None),
    ("/src/app/run.py", "python", "app.core.base.Thing.part", "/src/app/core/base.py"),
    ("/src/app/run.py", "python", "app.nothing", "/src/app/__init__.py"),
    ("/src/app/run.py", "python", "tools", "/src/tools.py"),
    ("/src/app/run.py", "python", "os.path", None),
    ("/src/app/run.py", "python", "", None),
    ("/web/lib/b.mjs", "javascript", "../a", "/web/a.ts"),
    ("/web/lib/b.mjs", "javascript", "../a.js", "/web/a.js"),
    ("/web/lib/b.mjs", "javascript", "../c.js", "/web/c.d.ts"),
    ("/web/lib/b.mjs", "javascript", ".", "/web/lib/index.tsx"),
    ("/web/a.ts", "typescript", "./lib?raw#x", "/web/lib/index.tsx"),
    ("/web/a.ts", "typescript", "react", None),
    ("/web/a.ts", "typescript", "../../../up", None),
    ("/web/page.html", "html", "a.js?v=3", "/web/a.js"),
    ("/web/page.html", "html", "/docs/guide.md", "/docs/guide.md"),
    ("/web/page.html", "html", "https://x.org/web/a.js", None),
    ("/web/page.html", "html", "#top", None),
    ("/web/style/main.css", "css", "part", "/web/style/_part.scss"),
    ("/docs/guide.md", "markdown", "../docs/", "/docs/README.md"),
    ("/docs/guide.md", "markdown", None, None),
    ("/ci/run.yml", "yaml", "./act", "/ci/act/action.yml"),
]


@pytest.mark.parametrize("roots", [["/src", ""]])
def test_names(spark, roots):
    edges = spark.createDataFrame([(*c[:3], "clash") for c in CASES], "path string, file_type string, target string, source string")
    files = spark.createDataFrame([(f,) for f in FILES * 2], "path string")
    got = {(r.source, r.name): r.target for r in filegraph.resolved(edges, files, roots).collect()}
    assert got == {(p, name): t for p, _, name, t in CASES if t}
    assert filegraph.resolved(edges, files.limit(0), roots).count() == 0


def random_edges(seed):
    r = random.Random(seed)
    edges = [(f"n{r.randrange(14):02}", f"n{r.randrange(14):02}") for _ in range(22)] + [("z1", "z2"), ("z2", "z1"), ("n03", "n03"), ("loop", "loop")]
    return edges * 2 + [(None, "n01"), ("n01", None)]


def reach(edges):
    out = {n: {n} for e in edges if None not in e for n in e}
    for _ in out:
        for a, b in edges:
            if a is not None and b is not None:
                out[a] |= out[b]
    return out


def test_components_and_reach(spark):
    edges = random_edges(4)
    df = spark.createDataFrame(edges, "source string, target string").repartition(2)
    far = reach(edges)
    want = {n: min(m for m in far[n] if n in far[m]) for n in far}
    assert len(set(want.values())) < len(want)
    assert {r.node: r.component for r in filegraph.strong_components(df).collect()} == want
    starts = spark.createDataFrame([("n00",), ("z1",), ("new",), ("n00",), (None,)], "node string")
    got = filegraph.reachable(df, starts).collect()
    assert sorted((r.node, r.component) for r in got) == sorted([(n, want[n]) for n in far["n00"] | far["z1"]] + [("new", "new")])
    assert {r.steps for r in got if r.node in ("n00", "z1", "z2", "new")} == {0}


def test_no_edges(spark):
    none = spark.createDataFrame([], "source string, target string")
    assert filegraph.strong_components(none).count() == filegraph.cycles(none).count() == 0
    assert [tuple(r) for r in filegraph.reachable(none, spark.createDataFrame([("a",)], "node string")).collect()] == [("a", "a", 0)]
