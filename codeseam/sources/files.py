"""File scans: a directory tree as a DataFrame, filters before contents, decoding with fallbacks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import basename, file_type, glob_regex, is_test_file
from ..schemas import IGNORED_DIRS, IGNORED_FILES


@F.pandas_udf(T.StringType())
def decode_other(raw: pd.Series) -> pd.Series:
    """Bytes that aren't UTF-8: utf-16 (with its mark), else latin-1, which never fails."""

    def one(b):
        if b is None:
            return None
        if b[:2] in (b"\xff\xfe", b"\xfe\xff"):
            try:
                return bytes(b).decode("utf-16")
            except UnicodeDecodeError:
                pass
        return bytes(b).decode("latin-1")

    return raw.map(one)


def decoded(raw: Column) -> Column:
    """The text of bytes: UTF-8 in the JVM, only other bytes go to Python."""
    text = F.try_validate_utf8(raw.cast("string"))
    return F.coalesce(text, decode_other(F.when(text.isNull(), raw)))


def _root(spark: SparkSession, root: str) -> tuple[str, bool]:
    """A root's full path without scheme, and whether it is a directory; a missing one is an error."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    status = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(path)
    return status.getPath().toUri().getPath(), status.isDirectory()


def listing(spark: SparkSession, root: str, name_glob: str | None = None) -> DataFrame:
    """path, relative (to root), size, modified of all files below root; no file is opened."""
    try:
        top, directory = _root(spark, root)
    except Exception as e:  # noqa: BLE001
        raise FileNotFoundError(f"{root}: {e}") from None
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True)
    raw = (reader.option("pathGlobFilter", name_glob) if name_glob else reader).load(root)
    path = F.regexp_replace("path", "^[a-z0-9]+:/+", "/")
    # parts that a cluster's address puts before the path don't count
    inside = F.substr(path, F.length(F.substring_index(path, top.rstrip("/") + "/", 1)) + len(top.rstrip("/")) + 2) if directory else basename(path)
    return raw.select(path.alias("path"), inside.alias("relative"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.col("content").alias("raw"))


def _globs(globs) -> str:
    return "|".join(glob_regex(g)[1:-1] for g in globs)


def scan(
    spark: SparkSession, root: str, ignored_dirs=tuple(IGNORED_DIRS), ignored_files=tuple(IGNORED_FILES), max_bytes: int = 10 * 1024 * 1024,
    include_tests: bool = True, name_glob: str | None = None, exclude=(), extensions=None,
) -> DataFrame:
    """path, relative, size, modified, file_type, content of the files below root, or of root itself if it is a file.

    Whole path segments below root are matched, exclude holds globs over names and relative paths (``**/x/**`` too),
    extensions an allow-list. Too large files are pruned by the source before they are read."""
    raw = listing(spark, root, name_glob).where(F.col("size") <= max_bytes)
    segments = F.split("relative", "/")
    dirs = F.slice(segments, 1, F.size(segments) - 1)
    plain = [d for d in ignored_dirs if not set("*?[") & set(d)]
    keep = ~F.exists(dirs, lambda s: s.isin(plain))
    wild = _globs(d for d in ignored_dirs if set("*?[") & set(d))
    if wild:
        keep &= ~F.exists(dirs, lambda s: s.rlike(f"^(?:{wild})$"))
    if ignored_files:
        keep &= ~basename(F.col("relative")).rlike(f"^(?:{_globs(ignored_files)})$")
    if exclude:
        within = _globs(g[3:] if g.startswith("**/") else g for g in exclude)
        keep &= ~F.concat(F.lit("/"), "relative").rlike(f"/(?:{within})$") & ~basename(F.col("relative")).rlike(f"^(?:{within})$")
    if extensions is not None:
        keep &= F.lower(F.concat(F.lit("."), F.substring_index("relative", ".", -1))).isin([e.lower() for e in extensions])
    if not include_tests:
        keep &= ~is_test_file(F.col("relative"))
    return raw.where(keep).select("path", "relative", "size", "modified", file_type(F.col("relative")).alias("file_type"), decoded(F.col("raw")).alias("content"))


def scan_directory(spark: SparkSession, root: str, **options) -> DataFrame:
    """As ``scan``, for directories only."""
    if not _is_directory(spark, root):
        raise ValueError(f"{root} is not a directory")
    return scan(spark, root, **options)


def _is_directory(spark: SparkSession, root: str) -> bool:
    try:
        return _root(spark, root)[1]
    except Exception as e:  # noqa: BLE001
        raise FileNotFoundError(f"{root}: {e}") from None


def scan_errors(spark: SparkSession, root: str, **options) -> DataFrame:
    """path, error of the files that a scan wanted and couldn't read."""
    listed = listing(spark, root, options.get("name_glob")).select("path", "size")
    read = scan(spark, root, **options).select("path")
    wanted = listed.where(F.col("size") <= options.get("max_bytes", 10 * 1024 * 1024)).join(read, "path", "left_anti")
    # what the filters left out is no error: those files can be opened
    opened = listing(spark, root, options.get("name_glob")).where(F.col("raw").isNotNull()).select("path")
    return wanted.join(opened, "path", "left_anti").select("path", F.lit("unreadable").alias("error"))


def scan_paths(spark: SparkSession, roots: list[str], **options) -> DataFrame:
    """Several files and directories; a file reached twice counts once."""
    out = None
    for r in roots:
        one = scan(spark, r, **options)
        out = one if out is None else out.unionByName(one)
    return out.dropDuplicates(["path"])


def tree(files: DataFrame) -> DataFrame:
    """path, parent, depth, children, size of each directory and file."""
    segs = F.split(F.regexp_replace("path", "^/", ""), "/")
    nodes = files.select("size", segs.alias("s")).select("size", "s", F.explode(F.sequence(F.lit(1), F.size("s"))).alias("d"))
    nodes = nodes.select(F.array_join(F.slice("s", 1, F.col("d")), "/").alias("path"), F.array_join(F.slice("s", 1, F.col("d") - 1), "/").alias("parent"), F.col("d").alias("depth"), "size")
    nodes = nodes.groupBy("path", "parent", "depth").agg(F.sum("size").alias("size"))
    kids = nodes.groupBy(F.col("parent").alias("path")).agg(F.count("*").alias("children"))
    return nodes.join(kids, "path", "left").fillna(0, ["children"])


def shown_tree(files: DataFrame, excluded: list[str] = ()) -> DataFrame:
    """The tree as a browser shows it: without dot files, with each node's excluded flag (a part or the start of its path)."""
    t = tree(files)
    hidden = F.exists(F.split("path", "/"), lambda s: s.startswith("."))
    return t.where(~hidden).withColumn("is_excluded", excluded_path(F.concat(F.lit("/"), "path"), excluded))


def excluded_path(path: Column, excluded: list[str]) -> Column:
    """Whether a path has one of the parts in it or at its start."""
    out = F.lit(False)
    for e in excluded:
        out = out | path.contains(e) | path.startswith(e)
    return out


def directories(files: DataFrame, parent: str = "") -> DataFrame:
    """name of the directories right below a directory, each once, sorted."""
    path, top = F.regexp_replace("path", "^/", ""), parent.strip("/")
    under = F.substr(path, F.lit(len(top) + 2)) if top else path
    rows = files.where(path.startswith(top + "/") if top else F.lit(True)).select(under.alias("p")).where(F.contains("p", F.lit("/")))
    return rows.select(F.substring_index("p", "/", 1).alias("name")).distinct().orderBy("name")


def by_path(files: DataFrame, path: str) -> DataFrame:
    return files.where(F.col("path") == path)


def of_type(files: DataFrame, kind: str) -> DataFrame:
    return files.where(F.col("file_type") == kind)


def statistics(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("n_files"), F.sum("size").alias("total_size"), F.max_by("path", F.struct("size", "path")).alias("largest"), F.max("size").alias("largest_size"))


def by_type(files: DataFrame) -> DataFrame:
    return files.groupBy("file_type").agg(F.count("*").alias("n"), F.sum("size").alias("size"))


def project(spark: SparkSession, n: int, loc: int = 10_000) -> DataFrame:
    """A synthetic project of n Python modules and a tenth as many scripts (10 at most): path, content, size. loc is the
    number of lines of all modules; a script has half as many as a module."""

    def body(head: list, each: int, comment: str, statement: str):
        more = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.lit(each - len(head)))), lambda i: F.when(i % 5 == 0, F.format_string(comment, i)).otherwise(F.format_string(statement, i, i)))
        return F.array_join(F.concat(F.array(*(h if isinstance(h, Column) else F.lit(h) for h in head)), F.when(F.lit(each > len(head)), more).otherwise(F.array().cast("array<string>"))), "\n")

    each = loc // max(1, n)
    modules = body(
        ["import os", "import sys", "", F.format_string("class Part%d:", "id"), "    def __init__(self, name):", "        self.name = name", "        self.data = []", "", "    def add(self, item):", "        self.data.append(item)", "",
         F.format_string("def work_%d(x, y=0):", "id"), "    if y > 0:", "        return x * y", "    return x", ""], each, "# note %d", 'value_%d = "text %d"',
    )
    scripts = body([F.format_string("class Part%d {", "id"), "  add(item) { this.data.push(item) }", "}", F.format_string("function work%d(x) { return x }", "id")], each // 2, "// note %d", 'const value%d = "text %d";')
    made = [
        spark.range(n).select(F.format_string("/src/module_%03d.py", "id").alias("path"), modules.alias("content")),
        spark.range(min(10, n // 10)).select(F.format_string("/src/script_%03d.js", "id").alias("path"), scripts.alias("content")),
    ]
    both = made[0].unionByName(made[1])
    return both.withColumn("size", F.length("content").cast("long"))
