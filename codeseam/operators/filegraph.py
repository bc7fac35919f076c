"""Dependencies between the files of a project: module names and links resolved to paths, cycles, reachability.

Resolution is a join: each distinct (folder, type, target) makes the few paths it may mean, ranked as the language ranks
them, and the best one that is a file of the project stands. Cycles are strongly connected components, found by trimming
and colouring; reachability is a search by frontiers over the graph of components, a row for each node reached, never
for each pair of nodes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import dropped, written

#: What a target without an extension may be, in order; and what stands for a folder.
SCRIPT_ENDINGS = ["", ".ts", ".tsx", ".d.ts", ".js", ".jsx", ".mjs", ".cjs", ".json"]
ENDINGS = {"javascript": SCRIPT_ENDINGS, "typescript": SCRIPT_ENDINGS, "html": ["", ".html"], "css": ["", ".css", ".scss", ".sass", ".less"], "markdown": ["", ".md"], "yaml": ["", ".yml", ".yaml"]}
FOLDER_FILES = {
    "javascript": [f"index{e}" for e in SCRIPT_ENDINGS[1:]], "typescript": [f"index{e}" for e in SCRIPT_ENDINGS[1:]], "html": ["index.html"], "css": [],
    "markdown": ["README.md", "index.md"], "yaml": ["action.yml", "action.yaml", "Dockerfile"],
}
EDGE = ["source", "target"]


def folder_of(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def normal(path: Column) -> Column:
    """A path without empty, . and .. steps; null if it leads out of the root."""
    out = F.array().cast("array<string>")

    def step(at: Column, x: Column) -> Column:
        up = F.when(F.size(at) > 0, F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0))))
        return F.when(x.isin("", "."), at).when(x == "..", up).otherwise(F.concat(at, F.array(x)))

    return F.aggregate(F.split(path, "/"), out, step, lambda at: F.when(at.isNotNull(), F.concat(F.lit("/"), F.array_join(at, "/"))))


def _python_candidates(target: Column, folder: Column, roots: list[str]) -> Column:
    """Paths of a dotted name, the longest match first: a module, then a package; at last the package named itself.

    Leading dots go up from the file's folder; other names are sought below each root, then beside the file."""
    dots = F.length(F.regexp_extract(target, r"^\.*", 0))
    names = F.filter(F.split(F.regexp_replace(target, r"^\.+", ""), r"\."), lambda x: x != "")
    base = F.concat(folder, F.repeat(F.lit("/.."), F.greatest(dots - 1, F.lit(0))))
    starts = F.when(dots > 0, F.array(base)).otherwise(F.array(*map(F.lit, roots), folder))
    lengths = F.sequence(F.size(names), F.when(dots > 0, 0).otherwise(F.least(F.size(names), F.lit(1))), F.lit(-1))

    def of_length(n: Column) -> Column:
        stem = F.array_join(F.slice(names, F.lit(1), n), "/")

        def of_start(s: Column) -> Column:
            return F.array(F.when(n > 0, F.concat(s, F.lit("/"), stem, F.lit(".py"))), F.concat(s, F.lit("/"), stem, F.lit("/__init__.py")))

        return F.flatten(F.transform(starts, of_start))

    return F.when(F.size(names) + dots > 0, F.flatten(F.transform(lengths, of_length))).otherwise(F.array().cast("array<string>"))


def _link_candidates(target: Column, folder: Column, file_type: str, roots: list[str]) -> Column:
    """Paths of a script's module or a link: beside the file, below the roots where it starts with a slash (scripts: or is bare)."""
    plain = F.regexp_replace(target, "[?#].*$", "")
    below = [F.concat(F.lit(r + "/"), plain) for r in roots]
    if file_type in ("javascript", "typescript"):
        bases = F.when(plain.rlike(r"^\.\.?(/|$)"), F.array(F.concat(folder, F.lit("/"), plain))).otherwise(F.array(*below))
    else:
        bases = F.when(plain.startswith("/"), F.array(*below)).otherwise(F.array(F.concat(folder, F.lit("/"), plain)))
    as_source = F.regexp_replace(plain, r"\.[mc]?jsx?$", "")  # a script's import may name what its source becomes

    def of_base(b: Column) -> Column:
        told = [F.concat(b, F.lit(e)) for e in ENDINGS[file_type]] + [F.concat(b, F.lit("/" + f)) for f in FOLDER_FILES[file_type]]
        if file_type in ("javascript", "typescript"):
            stem = F.substr(b, F.lit(1), F.length(b) - (F.length(plain) - F.length(as_source)))
            told += [F.when(plain != as_source, F.concat(stem, F.lit(e))) for e in (".ts", ".tsx", ".d.ts")]
        if file_type == "css":
            told += [F.regexp_replace(b, "([^/]+)$", f"_$1{e}") for e in (".scss", ".sass")]
        return F.array(*told)

    outside = plain.rlike(r"^([a-zA-Z][a-zA-Z0-9+.-]*:|//)") | (plain == "")
    return F.when(outside, F.array().cast("array<string>")).otherwise(F.flatten(F.transform(bases, of_base)))


def resolved(edges: DataFrame, files: DataFrame, roots: list[str] = ("",)) -> DataFrame:
    """source, target, name: the files that edges (path, file_type, target: the name as written) mean, each once.

    files: path. roots: folders from which absolute names go, in order ("" is the root itself). A name that no file of
    the project answers to, an address, an empty or null name gives no row; a file that names itself does. Each distinct
    (folder, type, name) is sought once, however many files use it."""
    asked = edges.where("path is not null and target is not null").select(F.col("path").alias("source"), folder_of(F.col("path")).alias("folder"), "file_type", F.col("target").alias("name"))
    words = asked.select("folder", "file_type", "name").distinct()
    kinds = {"python": _python_candidates(F.col("name"), F.col("folder"), list(roots))} | {t: _link_candidates(F.col("name"), F.col("folder"), t, list(roots)) for t in ENDINGS}
    may = reduce(lambda c, k: c.when(F.col("file_type") == k, kinds[k]), kinds, F.when(F.lit(False), F.array().cast("array<string>")))
    ranked = words.select("folder", "file_type", "name", F.posexplode(may).alias("rank", "may")).select("folder", "file_type", "name", "rank", normal(F.col("may")).alias("may"))
    there = ranked.join(files.select(F.col("path").alias("target")).distinct().transform(_by_sort), F.col("may") == F.col("target"))
    best = there.groupBy("folder", "file_type", "name").agg(F.min_by("target", "rank").alias("target"))
    return asked.join(_by_sort(best), ["folder", "file_type", "name"]).select("source", "target", "name").distinct()


def _by_sort(df: DataFrame) -> DataFrame:
    """For a side of a join: Spark takes a written table for as large as its compressed files, and would send a graph's
    nodes whole to the driver."""
    return df.hint("merge")


def _some(df: DataFrame) -> bool:
    return df.limit(1).count() > 0


def _trimmed(edges: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Edges without nodes that have no way in or no way out, and those nodes: each is a component of its own."""
    gone = []
    while True:
        ends = edges.select(F.explode(F.array(F.struct(F.col("source").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")), F.struct(F.col("target").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))).alias("e")).select("e.*")
        free = written(ends.groupBy("node").agg(F.max("out").alias("out"), F.max("into").alias("into")).where("out = 0 or into = 0").select("node"))
        if not _some(free):
            dropped(free)
            return edges, gone
        left = written(edges.join(_by_sort(free), edges["source"] == free["node"], "left_anti").join(_by_sort(free), F.col("target") == free["node"], "left_anti"))
        dropped(edges)
        gone.append(free)
        edges = left


def _coloured(edges: DataFrame) -> DataFrame:
    """node, colour: the smallest node that leads to it (itself included)."""
    now = written(edges.select(F.explode(F.array(*EDGE)).alias("node")).distinct().withColumn("colour", F.col("node")))
    while True:
        passed = edges.join(_by_sort(now), edges["source"] == now["node"]).groupBy(F.col("target").alias("to")).agg(F.min("colour").alias("new"))
        after = written(now.join(_by_sort(passed), F.col("node") == F.col("to"), "left").select("node", F.least("colour", F.coalesce("new", "colour")).alias("colour"), (F.col("new") < F.col("colour")).alias("moved")))
        moved = _some(after.where("moved"))
        dropped(now)
        now = after.drop("moved")
        now._codeseam_path = after._codeseam_path
        if not moved:
            return now


def _swept(edges: DataFrame, frontier: DataFrame) -> DataFrame:
    """node, tag, steps: all that edges (source, target and, where both have it, tag) lead to from frontier (node, tag), once each."""
    tagged = "tag" in edges.columns
    seen = [written(frontier.select("node", "tag").distinct().withColumn("steps", F.lit(0)))]
    while True:
        last = seen[-1].alias("f")
        meet = F.col("f.node") == F.col("e.source")
        met = edges.alias("e").join(_by_sort(last), meet & (F.col("e.tag") == F.col("f.tag")) if tagged else meet)
        new = met.select(F.col("e.target").alias("node"), F.col("f.tag").alias("tag")).distinct()
        known = reduce(DataFrame.union, seen).select("node", "tag")
        found = written(new.join(_by_sort(known), ["node", "tag"], "left_anti").withColumn("steps", F.lit(len(seen))))
        if not _some(found):
            dropped(found)
            return reduce(DataFrame.union, seen)
        seen.append(found)


def strong_components(edges: DataFrame) -> DataFrame:
    """node, component: nodes of edges (source, target) that lead to each other share a component, named by its smallest node.

    Nodes without a way in or out go first; then colours flow along the edges, and what leads back to a colour's own node
    within the colour is its component; the rest goes round again. Rounds grow with the graph's depth, no round pairs
    nodes, and ends that are null are left out."""
    edges = written(edges.where("source is not null and target is not null").select(*EDGE).distinct())
    every = edges.select(F.explode(F.array(*EDGE)).alias("node")).distinct()
    every = written(every)
    left = written(edges.where("source <> target"))
    dropped(edges)
    found = []
    while True:
        left, _ = _trimmed(left)
        if not _some(left):
            break
        colour = _coloured(left)
        ends = [colour.select(F.col("node").alias(f"{c}_node"), F.col("colour").alias(f"{c}_colour")) for c in ("s", "t")]
        inside = left.join(_by_sort(ends[0]), F.col("source") == F.col("s_node")).join(_by_sort(ends[1]), F.col("target") == F.col("t_node")).where("s_colour = t_colour")
        inside = written(inside.select(*EDGE, F.col("s_colour").alias("tag")))
        back = inside.select(F.col("target").alias("source"), F.col("source").alias("target"), "tag")
        own = written(_swept(back, colour.where("node = colour").select("node", F.col("colour").alias("tag"))).select("node", F.col("tag").alias("component")))
        found.append(own)
        rest = written(inside.join(own, F.col("source") == F.col("node"), "left_anti").join(own, F.col("target") == F.col("node"), "left_anti").select(*EDGE))
        dropped(left, colour, inside)
        left = rest
    named = reduce(DataFrame.union, found).withColumnRenamed("node", "n") if found else every.limit(0).select(F.col("node").alias("n"), F.col("node").alias("component"))
    return written(every.join(_by_sort(named), F.col("node") == F.col("n"), "left").select("node", F.coalesce("component", "node").alias("component")))


def cycles(edges: DataFrame) -> DataFrame:
    """component, node: the files of each cycle of dependencies (components of two files or more)."""
    parts = strong_components(edges)
    many = parts.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
    return parts.join(_by_sort(many), "component", "left_semi").select("component", "node")


def reachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """node, component, steps: all that edges lead to from starts (node), the starts themselves included; steps counts the
    fewest edges between components. Starts that no edge knows are components of their own."""
    parts = strong_components(edges)
    ends = [parts.select(F.col("node").alias(f"{c}_node"), F.col("component").alias(f"{c}_part")) for c in ("s", "t")]
    drawn = edges.join(_by_sort(ends[0]), F.col("source") == F.col("s_node")).join(_by_sort(ends[1]), F.col("target") == F.col("t_node")).where("s_part <> t_part")
    drawn = written(drawn.select(F.col("s_part").alias("source"), F.col("t_part").alias("target")).distinct())
    wanted = starts.where("node is not null").select("node").distinct()
    first = wanted.join(_by_sort(parts), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    met = written(_swept(drawn, first.select(F.col("component").alias("node"), F.lit(0).alias("tag"))).select(F.col("node").alias("component"), "steps"))
    known = parts.join(_by_sort(met), "component").select("node", "component", "steps")
    alone = first.join(_by_sort(parts.select("node")), "node", "left_anti").select("node", "component", F.lit(0).alias("steps"))
    return known.union(alone)
