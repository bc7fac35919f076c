"""Parsing table functions over trees and texts: dependency edges, imports, exports, symbols, key paths, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import lines_of_code, slug
from ..functions.text import lines as lines_of
from .detectors import structural_findings
from .trees import PARSERS, nodes, parse, register

__all__ = ["PARSERS", "nodes", "parse", "register", "structural_findings"]

#: Modules that come with Python and with Node.
STANDARD = {
    "python": [
        "os", "sys", "json", "datetime", "time", "math", "random", "collections", "itertools", "functools", "operator", "copy", "pickle", "re",
        "glob", "shutil", "subprocess", "threading", "multiprocessing", "logging", "unittest", "argparse", "configparser", "urllib", "http",
        "email", "html", "xml", "sqlite3", "csv", "hashlib", "uuid", "base64", "zlib", "gzip", "tarfile", "zipfile",
    ],
    "javascript": [
        "fs", "path", "os", "crypto", "http", "https", "url", "util", "events", "stream", "buffer", "child_process", "cluster", "dgram", "dns",
        "net", "readline", "repl", "tls", "tty", "vm", "zlib", "assert", "querystring", "string_decoder",
    ],
}
_WEB = r"^(?:https?:)?//"


def is_standard(target: Column, file_type: str) -> Column:
    top = F.substring_index(target, ".", 1) if file_type == "python" else target
    return top.isin(STANDARD["python" if file_type == "python" else "javascript"])


def is_external(target: Column, file_type: str) -> Column:
    """Whether a target lies outside the project: by its address for pages, style sheets and notes, else a module that
    comes with the language or a name that is no path of more than two slashes."""
    if file_type in ("html", "css"):
        return target.rlike(_WEB)
    if file_type == "markdown":
        return target.rlike("^(?:https?://|ftp://|mailto:)")
    plain = ~target.rlike(r"^[./]") & (F.length(target) - F.length(F.replace(target, F.lit("/"))) <= 2)
    return (target != "") & (is_standard(target, file_type) | plain)


# Python


def _kind(n: str) -> Column:
    return F.col("node_type") == n


#: What python_edges reads of a tree.
EDGES = {"kinds": ["alias"], "columns": ["path", "node_type", "name", "line", "parent_type", "parent_name", "parent_line"]}


def python_edges(tree: DataFrame) -> DataFrame:
    """path -> module: import a gives a, from m import n gives m.n (m for *); one row for each name of a statement."""
    module = F.col("parent_name")
    full = (
        F.when(F.col("parent_type") == "Import", F.col("name")).when(F.col("name") == "*", module)
        .when(module.rlike(r"^\.*$"), F.concat(module, "name")).otherwise(F.concat(module, F.lit("."), "name"))
    )
    relative = F.coalesce(module.startswith("."), F.lit(False))
    rows = tree.where(_kind("alias") & F.col("parent_type").isin("Import", "ImportFrom"))
    return rows.select("path", full.alias("target"), F.coalesce("parent_line", "line").alias("line"), relative.alias("is_relative")).withColumn("is_external", ~F.col("is_relative") & is_external(F.col("target"), "python"))


#: What python_imports reads of a tree.
IMPORTS = {"kinds": ["alias", "ImportFrom"], "columns": ["path", "node_type", "name", "parent_type"]}


def python_imports(tree: DataFrame) -> DataFrame:
    """The modules that a file imports, each once, without the names taken from them and without leading dots."""
    module = F.when(_kind("alias") & (F.col("parent_type") == "Import"), F.col("name")).when(_kind("ImportFrom"), F.regexp_replace("name", r"^\.+", ""))
    return tree.select("path", module.alias("module")).where("module <> ''").distinct()


#: What python_exports reads of a tree.
EXPORTS = {"kinds": ["Assign"], "columns": ["path", "node_type", "attrs"]}


def python_exports(tree: DataFrame) -> DataFrame:
    """The names in lists that are assigned to __all__."""
    names = F.from_json("attrs", "exports array<string>")["exports"]
    return tree.where(_kind("Assign") & F.col("attrs").contains('"exports"')).select("path", F.explode(names).alias("name")).distinct()


#: What python_symbols reads of a tree.
SYMBOLS = {"kinds": ["FunctionDef", "AsyncFunctionDef", "ClassDef", "Assign"], "columns": ["path", "node_type", "name"]}


def python_symbols(tree: DataFrame) -> DataFrame:
    """Functions, classes and assigned names (an Assign node's name has all of its targets')."""
    t = F.col("node_type")
    kind = F.when(t.isin("FunctionDef", "AsyncFunctionDef"), "function").when(t == "ClassDef", "class").when(t == "Assign", "variable")
    return tree.where(kind.isNotNull() & F.col("name").isNotNull()).select("path", kind.alias("kind"), F.explode(F.split("name", ",")).alias("name")).distinct()


_BRANCHES = ["If", "While", "For", "AsyncFor", "ExceptHandler", "With"]
#: What python_complexity reads of a tree; every file has one of its nodes.
COMPLEXITY = {"kinds": ["Module", "BoolOp", *_BRANCHES], "columns": ["path", "node_type", "name"]}


def _complexity() -> Column:
    t = F.col("node_type")
    branches = F.count_if(t.isin(*_BRANCHES))
    return (1 + branches + F.coalesce(F.sum(F.when(t == "BoolOp", F.col("name").cast("int") - 1)), F.lit(0))).alias("complexity")


def python_complexity(tree: DataFrame) -> DataFrame:
    return tree.groupBy("path").agg(_complexity())


_METRICS = {"kinds": [*COMPLEXITY["kinds"], "FunctionDef", "AsyncFunctionDef", "ClassDef", "alias", "ImportFrom"], "columns": ["path", "node_type", "name", "parent_type"]}


def python_metrics(files: DataFrame) -> DataFrame:
    """path, loc, functions, classes, imports (distinct names), complexity; of a file that can't be parsed only
    total_lines, the lines with text, is known."""
    tree, ok = nodes(files, "python", **_METRICS), F.max((F.col("node_type") == "Error").cast("int")) == 0
    t = F.col("node_type")
    module = F.when(_kind("alias") & (F.col("parent_type") == "Import"), F.col("name")).when(_kind("ImportFrom"), F.nullif(F.regexp_replace("name", r"^\.+", ""), F.lit("")))

    def names(x: Column) -> Column:  # as count(distinct x), which would copy each row once for each of the three
        return F.size(F.collect_set(x)).cast("long")

    counted = tree.groupBy("path").agg(
        ok.alias("parsed"), names(F.when(t.isin("FunctionDef", "AsyncFunctionDef"), F.col("name"))).alias("functions"),
        names(F.when(t == "ClassDef", F.col("name"))).alias("classes"), names(module).alias("imports"), _complexity(),
    )
    text = F.filter(F.transform(F.split("content", "\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    sizes = files.select("path", F.size(text).cast("long").alias("total"), F.size(F.filter(text, lambda x: ~x.startswith("#"))).cast("long").alias("loc"))
    known = {c: F.when(F.col("parsed"), F.col(c)).alias(c) for c in ("loc", "functions", "classes", "imports", "complexity")}
    return sizes.join(counted, "path").select("path", *known.values(), F.when(~F.col("parsed"), F.col("total")).alias("total_lines"))


def _finding(rows: DataFrame, kind: str, name: str, severity: str, message: Column) -> DataFrame:
    return rows.select(F.col("path").alias("file_path"), "line", F.lit(kind).alias("pattern_type"), F.lit(name).alias("pattern_name"), F.lit(severity).alias("severity"), message.alias("message"))


#: What long_methods reads of a tree.
LONG_METHODS = {"kinds": ["FunctionDef", "AsyncFunctionDef"], "columns": ["path", "node_type", "name", "line", "end_line"]}


def long_methods(tree: DataFrame, most: int = 50) -> DataFrame:
    size = F.col("end_line") - F.col("line") + 1
    rows = tree.where(F.col("node_type").isin("FunctionDef", "AsyncFunctionDef") & (size > most))
    return _finding(rows, "code_smell", "long_method", "warning", F.concat("name", F.lit(" has "), size.cast("string"), F.lit(" lines")))


#: What god_classes reads of a tree.
GOD_CLASSES = {"kinds": [], "parents": ["ClassDef"], "columns": ["path", "node_type", "parent_id", "parent_type", "parent_name", "parent_line"]}


def god_classes(tree: DataFrame, methods: int = 20, attributes: int = 15) -> DataFrame:
    """Classes of many methods or assigned attributes; members know their class, so one aggregation does."""
    t = F.col("node_type")
    own = tree.where((F.col("parent_type") == "ClassDef") & t.isin("FunctionDef", "AsyncFunctionDef", "Assign"))
    n = own.groupBy("path", "parent_id", F.col("parent_name").alias("name"), F.col("parent_line").alias("line")).agg(F.count_if(t != "Assign").alias("m"), F.count_if(t == "Assign").alias("a"))
    return _finding(n.where((F.col("m") > methods) | (F.col("a") > attributes)), "anti_pattern", "god_class", "warning", F.concat("name", F.lit(" does too much")))


# keys


def key_paths(tree: DataFrame) -> DataFrame:
    """a, a.b, c, c[0].d of JSON and YAML nodes; of texts that can't be parsed see ``loose_keys``."""
    return tree.where(F.col("parent_type").isin("object", "mapping") & F.col("key_path").isNotNull()).select("path", F.col("key_path").alias("key"))


#: Forms of keys in texts that can't be parsed.
LOOSE_KEYS = {"json": r"""['"]([^'":]+)['"]\s*:""", "yaml": r"(?m)^\s*([a-zA-Z_][a-zA-Z0-9_-]*)\s*:"}


def loose_keys(files: DataFrame, file_type: str) -> DataFrame:
    """Distinct keys by the form of a type, for texts that no parser takes."""
    return files.select("path", F.explode(F.array_distinct(_all(F.col("content"), LOOSE_KEYS[file_type]))).alias("key"))


def keys(files: DataFrame, file_type: str) -> DataFrame:
    """Key paths of files that can be parsed, loose keys of the others."""
    tree = nodes(files, file_type)
    failed = files.join(tree.where("node_type = 'Error'").select("path"), "path", "left_semi")
    return key_paths(tree).distinct().unionByName(loose_keys(failed, file_type))


def package_edges(files: DataFrame) -> DataFrame:
    """path, kind, target of the package objects of JSON manifests and of their import maps."""
    kinds = ["dependencies", "devDependencies", "peerDependencies", "optionalDependencies", "bundledDependencies", "imports"]
    doc = F.from_json("content", ", ".join(f"{k} map<string,string>" for k in kinds))

    def named(k):
        kind = F.lit("import" if k == "imports" else k).alias("kind")
        return F.transform(F.coalesce(F.map_keys(doc[k]), F.array().cast("array<string>")), lambda n: F.struct(kind, n.alias("target")))

    found = F.flatten(F.array(*(named(k) for k in kinds)))
    e = files.select("path", F.explode(found).alias("e")).select("path", "e.kind", "e.target")
    return e.withColumn("is_external", (F.col("kind") != "import") | ~F.col("target").startswith("."))


#: What yaml_edges reads of a tree.
YAML_EDGES = {"columns": ["path", "name", "depth", "parent_name", "key_path", "value"]}


def yaml_edges(tree: DataFrame) -> DataFrame:
    """path, kind, target by structure: images and builds of services, images of a pod's containers, actions of jobs and steps."""
    k, n, scalar = F.col("key_path"), F.col("name"), F.col("value").isNotNull()
    service = k.startswith("services.") & (F.col("depth") == 3)
    build = (service & (n == "build") & scalar) | (k.startswith("services.") & (F.col("depth") == 4) & (F.col("parent_name") == "build") & (n == "context"))
    kind = (
        F.when(service & (n == "image"), "docker_image").when(build, "build_context")
        .when(k.rlike(r"^spec\.containers\[[0-9]+\]\.image$"), "container_image")
        .when(k.startswith("jobs.") & (n == "uses") & ((F.col("depth") == 3) | ((F.col("depth") == 5) & k.rlike(r"\.steps\[[0-9]+\]\.uses$"))), "github_action")
    )
    return tree.where(kind.isNotNull() & scalar).select("path", kind.alias("kind"), F.col("value").alias("target"), (kind != "build_context").alias("is_external"))


# pages


def page_edges(tree: DataFrame) -> DataFrame:
    """path, kind, target by elements: a style sheet is a resource too, as any link is."""
    a = F.from_json("attrs", "map<string,string>")
    sheet = F.array_contains(F.split(F.lower(F.coalesce(a["rel"], F.lit(""))), r"\s+"), "stylesheet")
    found = F.array(
        F.when(_kind("link") & sheet, F.struct(F.lit("stylesheet").alias("kind"), a["href"].alias("target"))),
        *(F.when(_kind(tag), F.struct(F.lit(kind).alias("kind"), a[attr].alias("target"))) for tag, attr, kind in (
            ("script", "src", "script"), ("img", "src", "image"), ("link", "href", "resource"), ("source", "src", "media"),
            ("track", "src", "track"), ("embed", "src", "embed"), ("object", "data", "object"),
        )),
    )
    e = tree.where(F.col("node_type").isin("script", "img", "link", "source", "track", "embed", "object")).select("path", F.explode(F.array_compact(found)).alias("e"))
    return e.select("path", "e.kind", "e.target").where("target <> ''").withColumn("is_external", is_external(F.col("target"), "html"))


#: Forms of functions inside scripts of pages.
PAGE_FUNCTIONS = [r"function\s+([a-zA-Z_$][a-zA-Z0-9_$]*)\s*\(", r"([a-zA-Z_$][a-zA-Z0-9_$]*)\s*=\s*function\s*\(", r"([a-zA-Z_$][a-zA-Z0-9_$]*)\s*:\s*function\s*\("]


def _names(kind: str, values: Column) -> Column:
    return F.transform(values, lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name")))


def page_symbols(tree: DataFrame) -> DataFrame:
    """Class tokens, ids and functions of scripts by elements."""
    a = F.from_json("attrs", "map<string,string>")
    classes = F.filter(F.split(F.coalesce(a["class"], F.lit("")), r"\s+"), lambda x: x != "")
    script = F.when(_kind("script"), F.coalesce("value", F.lit(""))).otherwise("")
    found = F.concat(_names("class", classes), _names("variable", F.array_compact(F.array(F.nullif(a["id"], F.lit(""))))), *(_names("function", _all(script, rx)) for rx in PAGE_FUNCTIONS))
    return tree.select("path", F.explode(found).alias("s")).select("path", "s.kind", "s.name").distinct()


# forms


def _all(text: Column, regex: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(regex), F.lit(group))


#: Forms in which scripts, pages, style sheets and notes name others.
EDGE_FORMS = {
    "javascript": [("import", r"import\s[^'\"\n;]*?from\s+['\"]([^'\"]+)['\"]"), ("dynamic_import", r"import\(\s*['\"]([^'\"]+)['\"]\s*\)"), ("require", r"require\(\s*['\"]([^'\"]+)['\"]\s*\)")],
    "typescript": [
        ("type_import", r"import\s+type\s[^'\"\n;]*?from\s+['\"]([^'\"]+)['\"]"), ("type_import", r"import\s+\{[^'\"\n;]*?type\s+[^'\"\n;]*?\}\s+from\s+['\"]([^'\"]+)['\"]"),
        ("reference", r"///\s*<reference\s+(?:path|types)\s*=\s*['\"]([^'\"]+)['\"]"),
    ],
    "html": [
        ("script", r"(?i)<script[^>]+src\s*=\s*['\"]([^'\"]+)"), ("stylesheet", r"(?i)<link[^>]+href\s*=\s*['\"]([^'\"]+)"), ("image", r"(?i)<img[^>]+src\s*=\s*['\"]([^'\"]+)"),
        ("media", r"(?i)<source[^>]+src\s*=\s*['\"]([^'\"]+)"), ("track", r"(?i)<track[^>]+src\s*=\s*['\"]([^'\"]+)"), ("anchor", r"(?i)<a\s[^>]*href=['\"]([^'\"]+)"),
    ],
    "css": [("import", r"(?i)@import\s+(?:url\s*\(\s*)?['\"]?([^'\")\s;]+)")],
    "markdown": [("link", r"\[[^\]]*\]\(\s*([^)\s]+)[^)]*\)"), ("image", r"!\[[^\]]*\]\(\s*([^)\s]+)[^)]*\)"), ("reference_definition", r"(?m)^\[[^\]]+\]:\s*(\S+)"), ("autolink", r"<(https?://[^>]+)>")],
    "yaml": [("image", r"(?mi)^\s*image:\s*['\"]?([^\s'\"]+)"), ("uses", r"(?mi)^\s*-?\s*uses:\s*['\"]?([^\s'\"]+)"), ("build", r"(?mi)^\s*build:\s*['\"]?([^\s'\"]+)")],
}


def edges(files: DataFrame, file_type: str) -> DataFrame:
    """path, kind, target, is_external by the forms of a file type (TypeScript also has JavaScript's)."""
    forms = EDGE_FORMS[file_type] + (EDGE_FORMS["javascript"] if file_type == "typescript" else [])
    found = F.flatten(F.array(*(_named(kind, rx, F.col("content")) for kind, rx in forms)))
    e = files.select("path", F.explode(found).alias("e")).select("path", "e.kind", "e.target")
    return e.withColumn("is_external", is_external(F.col("target"), file_type))


def script_imports(files: DataFrame) -> DataFrame:
    """The modules that a script names in any form, each once; a statement may go over lines."""
    forms = [r"import\s+.*?\s+from\s+['\"]([^'\"]+)['\"]", r"import\s*\(\s*['\"]([^'\"]+)['\"]\s*\)", r"require\s*\(\s*['\"]([^'\"]+)['\"]\s*\)"]
    return files.select("path", F.explode(F.array_distinct(F.flatten(F.array(*(_all(F.col("content"), rx) for rx in forms))))).alias("module"))


#: Forms of exports; names in braces are divided by commas.
EXPORT_FORMS = [
    r"export\s+(?:function|class|const|let|var)\s+([a-zA-Z_$][a-zA-Z0-9_$]*)", r"export\s*\{\s*([a-zA-Z_$][a-zA-Z0-9_$,\s]*)\s*\}",
    r"export\s+default\s+(?:function\s+)?([a-zA-Z_$][a-zA-Z0-9_$]*)",
]


def script_exports(files: DataFrame) -> DataFrame:
    listed = F.flatten(F.array(*(_all(F.col("content"), rx) for rx in EXPORT_FORMS)))
    names = F.transform(F.flatten(F.transform(listed, lambda x: F.split(x, ","))), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return files.select("path", F.explode(F.array_distinct(names)).alias("name")).where("name <> ''")


def _named(kind: str, regex: str, text: Column) -> Column:
    return F.transform(_all(text, regex), lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("target")))


_NAME = r"([a-zA-Z_$][a-zA-Z0-9_$]*)"
#: Forms in which symbols are declared. Whatever stands before braces with arguments counts as a function.
SYMBOL_FORMS = {
    "javascript": [
        ("function", rf"function\s+{_NAME}\s*\("), ("function", rf"(?:const|let|var)\s+{_NAME}\s*=\s*(?:async\s*)?\(.*?\)\s*=>"), ("function", rf"{_NAME}\s*\(.*?\)\s*\{{"),
        ("class", rf"class\s+{_NAME}"), ("variable", rf"(?:const|let|var)\s+{_NAME}"),
    ],
    "typescript": [("class", rf"(?:interface|enum|namespace)\s+{_NAME}"), ("class", rf"type\s+{_NAME}\s*="), ("class", rf"abstract\s+class\s+{_NAME}")],
    "css": [("class", r"\.([a-zA-Z_-][a-zA-Z0-9_-]*)"), ("variable", r"(--[a-zA-Z_-][a-zA-Z0-9_-]*)"), ("function", r"([a-zA-Z-]+)\s*\(")],
}
#: Names before brackets in style sheets that are no functions.
NO_FUNCTIONS = ["color", "background", "border", "margin", "padding", "font"]


def symbols(files: DataFrame, file_type: str) -> DataFrame:
    """path, kind, name, each once; lines of scripts that begin as comments don't count."""
    forms = SYMBOL_FORMS[file_type] + (SYMBOL_FORMS["javascript"] if file_type == "typescript" else [])
    text = F.col("content") if file_type == "css" else F.regexp_replace("content", r"(?m)^[ \t]*(?://|/\*).*$", "")
    found = F.array_distinct(F.flatten(F.array(*(_named(kind, rx, text) for kind, rx in forms))))
    if file_type == "css":
        found = F.array_except(found, F.array(*(F.struct(F.lit("function").alias("kind"), F.lit(n).alias("target")) for n in NO_FUNCTIONS)))
    return files.select("path", F.explode(found).alias("e")).select("path", "e.kind", F.col("e.target").alias("name"))


def html_symbols(files: DataFrame) -> DataFrame:
    """Class tokens, ids, and functions inside scripts, by forms."""
    c = F.col("content")
    classes = F.flatten(F.transform(_all(c, r"(?i)class\s*=\s*['\"]([^'\"]+)['\"]"), lambda x: F.split(x, r"\s+")))
    scripts = F.array_join(_all(c, r"(?is)<script[^>]*>(.*?)</script>"), "\n")
    parts = F.concat(_names("class", classes), _names("variable", _all(c, r"(?i)id\s*=\s*['\"]([^'\"]+)['\"]")), *(_names("function", _all(scripts, rx)) for rx in PAGE_FUNCTIONS))
    return files.select("path", F.explode(F.array_distinct(parts)).alias("s")).select("path", "s.kind", "s.name").where("name <> ''")


# notes


def markdown_sections(lines: DataFrame) -> DataFrame:
    """Each line with its fence state and the header it stands under: running sums and last values."""
    w = W.partitionBy("path").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    t = lines.withColumn("fenced", F.sum(F.col("line").rlike("^```").cast("int")).over(w) % 2 == 1)
    header = F.when(~F.col("fenced") & F.col("line").rlike("^#{1,6} "), F.regexp_extract("line", r"^#{1,6} +(.*)$", 1))
    return t.withColumn("section", F.last(header, ignorenulls=True).over(w))


def markdown_headers(lines: DataFrame) -> DataFrame:
    """h{level}-{slug} of each header; lines inside fences are none."""
    n = F.length(F.regexp_extract("line", r"^(#{1,6}) ", 1))
    rows = markdown_sections(lines).where(~F.col("fenced") & F.col("line").rlike("^#{1,6} "))
    return rows.select("path", "line_no", F.concat(F.lit("h"), n.cast("string"), F.lit("-"), slug(F.regexp_extract("line", r"^#{1,6} +(.*)$", 1))).alias("symbol"))


def markdown_symbols(files: DataFrame) -> DataFrame:
    """path, kind, name: headers are variables, languages of code blocks classes, calls in inline code functions."""
    t = lines_of(files)
    heads = markdown_headers(t).select("path", F.lit("variable").alias("kind"), F.col("symbol").alias("name"))
    fences = t.select("path", F.lit("class").alias("kind"), F.concat(F.lit("code-"), F.regexp_extract("line", r"^\s*```(\w+)", 1)).alias("name")).where("name <> 'code-'")
    calls = t.select("path", F.explode(_all(F.col("line"), r"`([a-zA-Z_][a-zA-Z0-9_]*)\s*\([^`]*\)[^`]*`")).alias("name")).select("path", F.lit("function").alias("kind"), "name")
    return heads.unionByName(fences).unionByName(calls).distinct()


def script_metrics(files: DataFrame) -> DataFrame:
    """Lines of code, functions, classes, imports and complexity of scripts."""
    from ..functions.text import js_complexity, js_counts

    return lines_of_code(lines_of(files), "//").select("path", "loc").join(js_counts(files), "path").join(js_complexity(files), "path")
