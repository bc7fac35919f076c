"""Normalising projections, filters and unions of findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import extensions, literal_map
from ..storage import written

#: How each source's severities map.
STATIC = {"info": "info", "warning": "medium", "error": "high", "critical": "critical"}
DESIGN = {"info": "info", "warning": "low", "error": "medium", "critical": "high"}
ANTI = {"info": "info", "warning": "medium", "error": "high", "critical": "critical"}
LINTER = {"error": "high", "warning": "medium", "info": "low", "note": "info"}


#: Kinds of findings that quality issues become; keywords of linter messages, the first that applies counts.
QUALITY_KINDS = ["security_vulnerability", "performance_issue", "cyclomatic_complexity", "cognitive_complexity", "maintainability"]
LINTER_KEYWORDS = [("security", "security_vulnerability"), ("vulnerability", "security_vulnerability"), ("performance", "performance_issue"), ("syntax", "syntax_error"), ("format", "formatting_issue")]


def linter_type(message: Column) -> Column:
    """First keyword that applies, in this order."""
    m, out = F.lower(message), F
    for word, kind in LINTER_KEYWORDS:
        out = out.when(m.contains(word), kind)
    return out.otherwise("style_violation")


def _tags(*names: str | Column) -> Column:
    return F.array_sort(F.array(*(F.lit(n) if isinstance(n, str) else n for n in names)))


def from_linter(rows: DataFrame, tool: str) -> DataFrame:
    """file_path, line, column, severity, rule, message -> findings."""
    sev = F.coalesce(literal_map(LINTER)[F.lower("severity")], F.lit("medium"))
    return rows.select(
        "file_path", F.col("line").alias("line_start"), F.col("column").alias("column_start"), sev.alias("severity"),
        linter_type(F.coalesce("message", F.lit(""))).alias("finding_type"), F.lit("linter").alias("source"), F.lit(tool).alias("tool_name"), F.col("rule").alias("rule_id"),
        F.when(F.length("rule") > 0, F.concat(F.lit("Linter Issue: "), "rule")).otherwise("Linter Issue").alias("title"), "message", F.col("message").alias("description"), _tags("linter", tool.lower()).alias("tags"),
    )


def from_static(rows: DataFrame, compat: bool = False) -> DataFrame:
    """Detector rows (pattern_type, pattern_name, severity, ...) -> findings; compat: every one is medium."""
    sev = F.lit("medium") if compat else F.coalesce(literal_map(STATIC)[F.lower("severity")], F.lit("medium"))
    return rows.select(
        "file_path", F.col("line").alias("line_start"), sev.alias("severity"), F.col("pattern_type").alias("finding_type"), F.lit("static_analysis").alias("source"),
        F.lit("static_analyzer").alias("tool_name"), F.col("pattern_name").alias("rule_id"), title_case(F.col("pattern_name")).alias("title"), "message",
    )


def title_case(name: Column) -> Column:
    """Names with blanks for underscores, each word with a capital."""
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def from_vulnerability(rows: DataFrame) -> DataFrame:
    """Advisories of packages (file_path, severity, title, description, cve_id, advisory_id, affected_versions,
    fixed_versions) -> findings; the description joins what is there by ' | '."""
    rule = F.coalesce("cve_id", "advisory_id")

    def listed(column, label):
        return F.when(F.size(column) > 0, F.concat(F.lit(label), F.array_join(column, ", "))) if column in rows.columns else F.lit(None).cast("string")

    text = F.concat_ws(" | ", F.nullif("description", F.lit("")), listed("affected_versions", "Affected versions: "), listed("fixed_versions", "Fixed in: "))
    low = F.lower("severity")
    title = F.coalesce(F.nullif("title", F.lit("")), F.concat(F.lit("Security Vulnerability "), rule))
    return rows.select(
        "file_path", F.lit(None).cast("int").alias("line_start"), F.when(low.isin("critical", "high", "medium", "low"), low).otherwise("medium").alias("severity"),
        F.lit("vulnerable_dependency").alias("finding_type"), F.lit("dependency_analysis").alias("source"), F.lit("dependency_analyzer").alias("tool_name"), rule.alias("rule_id"),
        title.alias("title"), F.concat(F.lit("Vulnerable dependency detected: "), F.coalesce("title", F.lit(""))).alias("message"), text.alias("description"), _tags("security", "dependency", "vulnerability").alias("tags"),
    )


def from_outdated(rows: DataFrame) -> DataFrame:
    return rows.select(
        "file_path", F.lit(None).cast("int").alias("line_start"), F.lit("low").alias("severity"), F.lit("outdated_dependency").alias("finding_type"), F.lit("dependency_analysis").alias("source"),
        F.lit("dependency_analyzer").alias("tool_name"), F.lit(None).cast("string").alias("rule_id"), F.concat(F.lit("Outdated Package: "), "package").alias("title"),
        F.concat(F.lit("Package "), "package", F.lit(" is outdated")).alias("message"), F.concat(F.lit("Package "), "package", F.lit(" is outdated and should be updated")).alias("description"),
        F.lit("Update to the latest stable version").alias("suggestion"), _tags("dependency", "outdated", "maintenance").alias("tags"),
    )


#: kind -> (severities, default, start of title, start of message, tags)
_PATTERNS = {
    "design_pattern": (DESIGN, "info", "Design Pattern: ", "Design pattern detected: ", ("design-pattern", "architecture", "ai-detected")),
    "anti_pattern": (ANTI, "medium", "Anti-Pattern: ", "Anti-pattern detected: ", ("anti-pattern", "code-smell", "refactoring", "ai-detected")),
    "quality_issue": (STATIC, "medium", "Code Quality: ", "Code quality issue: ", ("code-quality", "ai-detected")),
}


def from_pattern(rows: DataFrame, kind: str) -> DataFrame:
    """Patterns that a model found (pattern_type, severity, description, ... ) -> findings; kind: design_pattern,
    anti_pattern or quality_issue. An anti-pattern's solutions are its suggestion."""
    severities, default, title, message, tags = _PATTERNS[kind]
    name = F.col("pattern_type")
    finding_type = F.when(name.isin(QUALITY_KINDS), name).otherwise("code_smell") if kind == "quality_issue" else F.lit(kind)
    suggestion = F.array_join("solutions", "; ") if kind == "anti_pattern" and "solutions" in rows.columns else F.lit("")
    given = {c: F.col(c) if c in rows.columns else F.lit(d) for c, d in (("confidence", 1.0), ("line_end", None), ("impact", "medium"), ("effort", "medium"))}
    return rows.select(
        "file_path", "line_start", given["line_end"].cast("int").alias("line_end"), F.coalesce(literal_map(severities)[F.lower("severity")], F.lit(default)).alias("severity"), finding_type.alias("finding_type"),
        F.lit("ai_analysis").alias("source"), F.lit("pattern_model").alias("tool_name"), name.alias("rule_id"), F.concat(F.lit(title), title_case(name)).alias("title"), F.concat(F.lit(message), name).alias("message"),
        "description", suggestion.alias("suggestion"), given["confidence"].cast("double").alias("confidence"), given["impact"].alias("impact"), given["effort"].alias("effort_to_fix"), _tags(*tags).alias("tags"),
    )


def engine_rows(static: DataFrame, vulnerabilities: DataFrame | None = None) -> DataFrame:
    """The flat rows of a whole run: id ({tool}_{running number}), source, tool, severity, type, title, description (else
    the message), file_path, line_number, message, suggestion. static: ingest_seq, language and detector columns."""
    def column(df, name):
        return F.col(name) if name in df.columns else F.lit("")

    numbered = static.withColumn("at", F.col("ingest_seq"))
    out = numbered.select(
        F.concat("language", F.lit("_"), F.col("at").cast("string")).alias("id"), F.lit("static_analysis").alias("source"), F.col("language").alias("tool"), "severity", F.col("pattern_type").alias("type"),
        F.col("pattern_name").alias("title"), F.coalesce(F.nullif(column(static, "description"), F.lit("")), "message").alias("description"), "file_path", F.col("line").alias("line_number"), "message", column(static, "suggestion").alias("suggestion"),
    )
    if vulnerabilities is None:
        return out
    v = vulnerabilities
    more = v.select(
        F.concat(F.lit("vuln_"), F.col("ingest_seq").cast("string")).alias("id"), F.lit("dependency_analysis").alias("source"), F.lit("dependency_analyzer").alias("tool"), F.coalesce("severity", F.lit("medium")).alias("severity"),
        F.lit("vulnerability").alias("type"), F.coalesce("title", F.lit("Security Vulnerability")).alias("title"), column(v, "description").alias("description"), column(v, "file_path").alias("file_path"),
        F.lit(None).cast("int").alias("line_number"), column(v, "summary").alias("message"), column(v, "fix_recommendation").alias("suggestion"),
    )
    return out.unionByName(more)


def numbered(rows: DataFrame, order: list[str], name: str = "ingest_seq", partitions: int = 64) -> DataFrame:
    """rows with a running number from 0 in an order: rows are dealt by ranges, and each range's begin is the sum of the
    sizes of those before. No task sees more than its range, and the sizes are one row for each.

    Ranges come from a sample and rows that tie in the order may come either way, so the dealt rows are a table in the
    shared folder before they are numbered: every use reads the same numbers, also after an executor was lost. The
    other columns' hash ends the order, so that only equal rows tie. This runs a job at once; the table stays, for the
    result reads it."""
    spread = F.xxhash64(*(F.to_json(F.struct(c)) for c in rows.columns if c not in order)) if set(rows.columns) - set(order) else F.lit(0).cast("long")
    keyed = rows.withColumn("__last", spread)
    dealt = keyed.repartitionByRange(partitions, *order, "__last").sortWithinPartitions(*order, "__last").drop("__last")
    local = dealt.withColumn("__id", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__id", 33)).withColumn("__at", F.col("__id").bitwiseAND((1 << 33) - 1)).drop("__id")
    held = written(local)
    sizes = held.groupBy("__part").agg(F.count("*").alias("__n")).agg(F.map_from_entries(F.collect_list(F.struct("__part", "__n"))).alias("__sizes"))  # one row, at most partitions entries
    before = F.aggregate(F.map_entries("__sizes"), F.lit(0).cast("long"), lambda a, e: a + F.when(e["key"] < F.col("__part"), e["value"]).otherwise(0))
    return held.join(F.broadcast(sizes)).select(*rows.columns, (before + F.col("__at")).alias(name))


def with_severity(findings: DataFrame, wanted: list[str]) -> DataFrame:
    """Allow-list; an empty one allows all."""
    return findings.where(F.col("severity").isin(wanted)) if wanted else findings


def with_type(findings: DataFrame, wanted: list[str]) -> DataFrame:
    return findings.where(F.col("finding_type").isin(wanted)) if wanted else findings


def in_file(findings: DataFrame, path: str) -> DataFrame:
    return findings.where(F.col("file_path") == path)


def of_source(findings: DataFrame, source: str) -> DataFrame:
    return findings.where(F.col("source") == source)


def of_language(files: DataFrame, languages: list[str]) -> DataFrame:
    """Files whose suffix belongs to one of the languages."""
    suffix = F.concat(F.lit("."), F.lower(F.substring_index("path", ".", -1)))
    return files.where(F.contains("path", F.lit(".")) & suffix.isin(extensions(languages)))


def search(findings: DataFrame, severity: list[str] = (), types: list[str] = (), text: str = "") -> DataFrame:
    out = with_type(with_severity(findings, list(severity)), list(types))
    return out.where(F.lower("title").contains(text.lower()) | F.lower("message").contains(text.lower())) if text else out


def unite(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
