"""Linter output: text and JSON forms as (file_path, line, column, severity, rule, message)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import literal_map

#: What kinds of patterns and which severities pylint's categories are; rules of eslint that are design or anti patterns.
PYLINT_PATTERNS = {"convention": "design_pattern", "refactor": "code_smell", "warning": "code_smell", "error": "anti_pattern", "fatal": "anti_pattern"}
PYLINT_SEVERITIES = {"convention": "info", "refactor": "warning", "warning": "warning", "error": "error", "fatal": "critical"}
ESLINT_DESIGN = ["prefer-const", "prefer-template", "prefer-arrow-callback", "class-methods-use-this", "prefer-destructuring"]
ESLINT_ANTI = ["no-var", "no-eval", "no-implicit-globals", "no-with", "no-prototype-builtins", "no-constructor-return"]


def pylint_text(lines: DataFrame) -> DataFrame:
    """file:line:col: type: message; lines that start with * are headings."""
    p = F.split("line", ":", 5)
    ok = (F.size(p) >= 4) & ~F.col("line").startswith("*") & F.trim(p[1]).rlike("^[0-9]+$")
    return lines.where(ok).select(
        F.trim(p[0]).alias("file_path"), F.trim(p[1]).cast("int").alias("line"), F.trim(p[2]).try_cast("int").alias("column"),
        F.lit("warning").alias("severity"), F.trim(p[3]).alias("rule"), F.trim(F.get(p, F.lit(4))).alias("message"),
    )


def flake8_text(lines: DataFrame) -> DataFrame:
    """file:line:col: CODE message."""
    p = F.split("line", ":", 4)
    rest = F.trim(F.get(p, F.lit(3)))
    rule = F.regexp_extract(rest, r"^(\S+) ", 1)
    is_rule = (F.length(rule) > 0) & (F.length(rule) <= 5) & (F.upper(rule) == rule) & rule.rlike("[A-Z]")
    return lines.where((F.size(p) >= 4) & F.trim(p[1]).rlike("^[0-9]+$")).select(
        F.trim(p[0]).alias("file_path"), F.trim(p[1]).cast("int").alias("line"), F.trim(p[2]).try_cast("int").alias("column"),
        F.lit("warning").alias("severity"), F.when(is_rule, rule).alias("rule"), F.when(is_rule, F.regexp_extract(rest, r"^\S+ (.*)$", 1)).otherwise(rest).alias("message"),
    )


def eslint_text(lines: DataFrame) -> DataFrame:
    """line:col severity message... ; the second token is taken as the rule too, as in the published form."""
    t = F.split(F.trim("line"), r"\s+")
    at = F.split(F.get(t, F.lit(0)), ":")
    bad = F.contains("line", F.lit("error"))
    return lines.where((bad | F.contains("line", F.lit("warning"))) & (F.size(t) >= 3)).select(
        F.get(at, F.lit(0)).try_cast("int").alias("line"), F.get(at, F.lit(1)).try_cast("int").alias("column"), F.when(bad, "error").otherwise("warning").alias("severity"),
        F.get(t, F.lit(1)).alias("rule"), F.array_join(F.slice(t, 3, F.greatest(F.size(t) - 2, F.lit(1))), " ").alias("message"),
    )


#: Fixed value: a line of eslint's own text form, with the rule at its end.
ESLINT_LINE = r"(\d+):(\d+):\s+(error|warning)\s+(.+?)\s+([a-zA-Z-]+)$"


def eslint_lines(lines: DataFrame) -> DataFrame:
    """line:col: severity message rule, for output that isn't JSON."""
    part = [F.regexp_extract("line", ESLINT_LINE, k) for k in range(6)]
    rows = lines.where(F.col("line").rlike(ESLINT_LINE))
    return rows.select(part[1].cast("int").alias("line"), part[2].cast("int").alias("column"), part[3].alias("severity"), part[5].alias("rule"), part[4].alias("message"), eslint_pattern(part[5]).alias("pattern_type"))


def eslint_pattern(rule: Column) -> Column:
    return F.when(rule.isin(ESLINT_DESIGN), "design_pattern").when(rule.isin(ESLINT_ANTI), "anti_pattern").otherwise("code_smell")


def pylint_json(raw: DataFrame) -> DataFrame:
    """Reports (column json): a list of issues, or an object with one under issues. Category and severity come from the
    issue's severity, else from its type."""
    one = "struct<type:string,severity:string,path:string,line:int,column:int,symbol:string,`message-id`:string,message:string>"
    listed, held = F.from_json("json", f"array<{one}>"), F.from_json("json", f"issues array<{one}>")["issues"]
    i = raw.select(F.explode(F.when(F.ltrim("json").startswith("{"), held).otherwise(listed)).alias("i"))
    category = F.lower(F.coalesce("i.severity", "i.type"))
    return i.select(
        F.col("i.path").alias("file_path"), F.col("i.line"), F.col("i.column"), category.alias("severity"), F.coalesce(F.col("i.symbol"), F.col("i.`message-id`")).alias("rule"),
        F.col("i.message"), F.coalesce(literal_map(PYLINT_PATTERNS)[F.lower("i.type")], F.lit("code_smell")).alias("pattern_type"),
        F.coalesce(literal_map(PYLINT_SEVERITIES)[category], F.lit("info")).alias("level"),
    )


def eslint_json(raw: DataFrame, root: str = "") -> DataFrame:
    """Reports (column json) of files with their messages; paths below root lose it, so that they match those of a scan."""
    s = "array<struct<filePath:string,messages:array<struct<ruleId:string,severity:int,message:string,line:int,column:int>>>>"
    m = raw.select(F.explode(F.from_json("json", s)).alias("r")).select(F.col("r.filePath").alias("file_path"), F.explode("r.messages").alias("m"))
    top = root.rstrip("/") + "/"
    path = F.when(F.col("file_path").startswith(top), F.substr("file_path", F.lit(len(top) + 1))).otherwise(F.col("file_path")) if root else F.col("file_path")
    severity = F.when(F.col("m.severity") == 2, "error").when(F.col("m.severity") == 1, "warning").otherwise("info")
    return m.select(path.alias("file_path"), "m.line", "m.column", severity.alias("severity"), F.col("m.ruleId").alias("rule"), F.col("m.message"), eslint_pattern(F.coalesce("m.ruleId", F.lit(""))).alias("pattern_type"))


#: linter -> adapter of its output lines (column line) or reports (column json); register() adds more.
ADAPTERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "pylint": pylint_text, "flake8": flake8_text, "eslint": eslint_text, "eslint-lines": eslint_lines, "pylint-json": pylint_json, "eslint-json": eslint_json,
}


def register(linter: str, adapter: Callable[[DataFrame], DataFrame]) -> None:
    ADAPTERS[linter] = adapter


def read(linter: str, output: DataFrame) -> DataFrame:
    return ADAPTERS[linter](output)
