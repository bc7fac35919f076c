"""Aggregations, rankings and scores over findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..schemas import QUALITY_WEIGHT, SEVERITIES, literal_map, severity_ordinal
from .enrich import debt, impacts


def by_severity(findings: DataFrame) -> DataFrame:
    """All five severities, zeros included."""
    dim = findings.sparkSession.createDataFrame([(s,) for s in SEVERITIES], "severity string")
    n = findings.groupBy("severity").agg(F.count("*").alias("n"))
    return dim.join(n, "severity", "left").select("severity", F.coalesce("n", F.lit(0)).alias("n"))


def counts(findings: DataFrame, column: str) -> DataFrame:
    return findings.groupBy(column).agg(F.count("*").alias("n"))


def affected_files(findings: DataFrame) -> DataFrame:
    """file_path, n: each file with findings once; its rows are the count of files."""
    return findings.groupBy("file_path").agg(F.count("*").alias("n"))


def report_summary(findings: DataFrame) -> DataFrame:
    """(part, name, n) of a report's summary: the total, all five severities, types and sources that occur, affected files."""
    total = findings.agg(F.count("*").alias("total"), F.countDistinct("file_path").alias("affected_files_count"))
    pairs = F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in total.columns))
    out = total.select(F.explode(pairs).alias("p")).select(F.lit("total").alias("part"), "p.name", "p.n")
    out = out.unionByName(by_severity(findings).select(F.lit("severity").alias("part"), F.col("severity").alias("name"), "n"))
    for part, column in (("type", "finding_type"), ("source", "source")):
        out = out.unionByName(counts(findings, column).select(F.lit(part).alias("part"), F.col(column).alias("name"), "n"))
    return out


def dashboard(enriched: DataFrame) -> DataFrame:
    """The dashboard's figures over enriched findings: totals, files, findings with a weakness and different weaknesses,
    and the average debt of those that have some."""
    d = F.col("technical_debt_score")
    base = enriched.agg(
        F.count("*").alias("total_findings"), F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "high").alias("high"), F.countDistinct("file_path").alias("affected_files"),
        F.count_if(F.size("cwe_ids") > 0).alias("security_findings"), F.coalesce(F.round(F.avg(F.when(d != 0, d)), 2), F.lit(0.0)).alias("average_debt"), F.size(F.array_distinct(F.flatten(F.collect_set("cwe_ids")))).cast("long").alias("unique_cwes"),
    )
    return base


def chart_rows(enriched: DataFrame) -> DataFrame:
    """(chart, label, n) of the charts: severities, types, the ten files with most findings by their name, impacts."""
    parts = [
        counts(enriched, "severity").select(F.lit("severity").alias("chart"), F.col("severity").alias("label"), "n"), counts(enriched, "finding_type").select(F.lit("type").alias("chart"), F.col("finding_type").alias("label"), "n"),
        top(enriched, "file_path").select(F.lit("files").alias("chart"), F.substring_index("file_path", "/", -1).alias("label"), "n"),
        impact_matrix(enriched).select(F.lit("impact").alias("chart"), F.concat_ws(":", "kind", "level").alias("label"), "n"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def top(findings: DataFrame, column: str, n: int = 10) -> DataFrame:
    """A top-k report: the limit is the feature; ties by name."""
    return counts(findings, column).orderBy(F.desc("n"), column).limit(n)


def impact_matrix(findings: DataFrame) -> DataFrame:
    pairs = F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("level")) for k, v in impacts().items()))
    return findings.select(F.explode(pairs).alias("p")).select("p.kind", "p.level").where("level <> 'minimal'").groupBy("kind", "level").agg(F.count("*").alias("n"))


def rollup(findings: DataFrame) -> DataFrame:
    """Root, type and type-severity totals in one pass."""
    return findings.rollup("finding_type", "severity").agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("gid"))


def security_matrix(findings: DataFrame) -> DataFrame:
    t = F.col("finding_type")
    return findings.groupBy("severity").agg(F.count_if(t.contains("security")).alias("security"), F.count_if(t.contains("pattern")).alias("pattern"), F.count_if(t.contains("dependency")).alias("dependency"), F.count("*").alias("total"))


def daily_trend(findings: DataFrame) -> DataFrame:
    return findings.groupBy(F.to_date("detected_at").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum(debt(False)), 1).alias("debt"), F.count_if(F.col("severity") == "critical").alias("critical"))


def debt_stats(findings: DataFrame) -> DataFrame:
    d = findings.select(debt(False).alias("d"))
    return d.agg(F.round(F.sum("d"), 1).alias("total"), F.round(F.avg("d"), 2).alias("average"), F.max("d").alias("highest"), F.min("d").alias("lowest"))


def debt_heatmap(findings: DataFrame) -> DataFrame:
    """By file name without directory."""
    f = findings.select(F.element_at(F.split("file_path", "/"), -1).alias("file"), debt(False).alias("d"), "severity")
    return f.groupBy("file").agg(F.round(F.avg("d"), 2).alias("avg_debt"), F.count("*").alias("n"), *(F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES))


def summary(findings: DataFrame) -> DataFrame:
    s, t = F.col("severity"), F.col("finding_type")
    return findings.agg(F.count("*").alias("total"), F.count_if(s == "critical").alias("critical"), F.count_if(s == "high").alias("high"), F.count_if(t == "security_vulnerability").alias("security"), F.countDistinct("file_path").alias("files"), F.countDistinct("tool_name").alias("tools"))


def recommendations(findings: DataFrame) -> DataFrame:
    c = findings.agg(F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("finding_type") == "code_smell").alias("smells"), F.count_if(F.col("finding_type") == "outdated_dependency").alias("outdated"))
    rules = F.array(
        F.when(F.col("critical") > 0, F.struct(F.lit("immediate").alias("priority"), F.lit("security").alias("category"), F.col("critical").alias("n"))),
        F.when(F.col("smells") > 5, F.struct(F.lit("high").alias("priority"), F.lit("maintainability").alias("category"), F.col("smells").alias("n"))),
        F.when(F.col("outdated") > 0, F.struct(F.lit("medium").alias("priority"), F.lit("maintenance").alias("category"), F.col("outdated").alias("n"))),
    )
    return c.select(F.explode(F.array_compact(rules)).alias("r")).select("r.priority", "r.category", "r.n")


def quality(findings: DataFrame) -> DataFrame:
    w = findings.agg(F.coalesce(F.sum(literal_map(QUALITY_WEIGHT)[F.col("severity")]), F.lit(0.0)).alias("w"), F.count("*").alias("n"))
    score = F.when(F.col("n") == 0, 100.0).otherwise(F.greatest(F.lit(0.0), 100 - F.col("w") / (F.col("n") * 0.1) * 100))
    return w.select(F.round(score, 1).alias("overall_score"), F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F").alias("grade"), F.col("n").alias("total_issues"), F.round("w", 1).alias("weighted_severity_score"))


def risk(findings: DataFrame) -> DataFrame:
    r = findings.agg(F.count_if(F.col("severity") == "critical").alias("c"), F.count_if(F.col("severity") == "high").alias("h"), F.count_if(F.col("finding_type").isin("security_vulnerability", "authentication_issue", "authorization_issue")).alias("s"))
    level = F.when((F.col("c") > 0) | (F.col("s") > 3), "high").when((F.col("h") > 5) | (F.col("s") > 1), "medium").when((F.col("h") > 0) | (F.col("s") > 0), "low").otherwise("minimal")
    return r.select(level.alias("risk_level"), F.col("s").alias("security"), F.col("c").alias("critical"), F.col("h").alias("high"), F.least(F.lit(100), 25 * F.col("c") + 10 * F.col("h") + 15 * F.col("s")).cast("long").alias("risk_score"))


def code_quality(findings: DataFrame, lines: DataFrame) -> DataFrame:
    """Findings per thousand lines, debt 10 per critical and 5 per high, and the grade of debt per thousand lines."""
    s = F.col("severity")
    marks = findings.select(F.lit(1).alias("f"), (10 * (s == "critical").cast("int") + 5 * (s == "high").cast("int")).alias("d"), F.lit(0).alias("l"))
    both = marks.unionByName(lines.select(F.lit(0).alias("f"), F.lit(0).alias("d"), F.lit(1).alias("l")))
    a = both.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (("f", "n"), ("d", "debt"), ("l", "total_lines"))))
    kloc = F.greatest(F.col("total_lines") / 1000, F.lit(1.0))
    return a.select("total_lines", F.round(F.col("n") / kloc, 2).alias("findings_per_kloc"), "debt", grade(F.col("debt"), F.col("total_lines")).alias("grade"))


def debt_score(findings: DataFrame) -> DataFrame:
    s = F.col("severity")
    return findings.agg((10 * F.count_if(s == "critical") + 5 * F.count_if(s == "high")).alias("debt"))


def debt_timeline(findings: DataFrame, severity: str = "critical") -> DataFrame:
    """Day and debt of each finding of a severity."""
    return findings.where(F.col("severity") == severity).select(F.to_date("detected_at").alias("day"), "ingest_seq", debt(False).alias("debt"))


def file_order(findings: DataFrame) -> DataFrame:
    """Place of each finding in its file's report: severity, then line, both descending."""
    w = W.partitionBy("file_path").orderBy(severity_ordinal().desc(), F.coalesce("line_start", F.lit(0)).desc(), "ingest_seq")
    return findings.select("file_path", "ingest_seq", F.row_number().over(w).alias("place"))


def page(rows: DataFrame, key: str, offset: int, limit: int) -> DataFrame:
    return rows.orderBy(F.desc(key)).offset(offset).limit(limit)


def total(findings: DataFrame) -> DataFrame:
    return findings.agg(F.count("*").alias("total"))


def by_category(findings: DataFrame) -> DataFrame:
    """Findings of each kind of pattern; other types are no patterns."""
    kind = F.when(F.col("finding_type").isin("design_pattern", "anti_pattern", "code_smell"), F.col("finding_type")).otherwise("none")
    return findings.groupBy(kind.alias("category")).count().withColumnRenamed("count", "n")


def weakness_stats(findings: DataFrame, mapping: dict) -> DataFrame:
    """Findings with a weakness, and how many different weaknesses and categories there are."""
    rows = findings.select(*(c.alias(k) for k, c in mapping.items())).where(F.size("cwe_ids") > 0)
    sets = rows.agg(F.count("*").alias("n"), F.collect_set("cwe_ids").alias("c"), F.collect_set("owasp_categories").alias("o"))
    return sets.select("n", F.size(F.array_distinct(F.flatten("c"))).cast("long").alias("cwes"), F.size(F.array_distinct(F.flatten("o"))).cast("long").alias("categories"))


def pattern_summary(rows: DataFrame) -> DataFrame:
    """Counts by kind and by three levels of severity."""
    kinds = [F.count_if(F.col("finding_type") == k).alias(k) for k in ("design_pattern", "anti_pattern", "code_smell")]
    levels = [F.count_if(F.col("severity").isin(*names)).alias(k) for k, names in (("high", ("critical", "high")), ("medium", ("medium",)), ("low", ("low", "info")))]
    return rows.agg(F.count("*").alias("total"), *kinds, *levels, F.countDistinct("file_path").alias("files"))


def profile(samples: DataFrame, name: str, value: str) -> DataFrame:
    """Of each name: count, least, most, mean, total and exact median."""
    return samples.groupBy(name).agg(F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), F.bround(F.avg(value), 6).alias("mean"), F.sum(value).alias("total"), F.percentile(value, F.lit(0.5)).alias("median"))


def benchmark(samples: DataFrame, value: str) -> DataFrame:
    """Mean, median, most and least of all samples, in one row."""
    return samples.agg(F.bround(F.avg(value), 6).alias("mean"), F.percentile(value, F.lit(0.5)).alias("median"), F.max(value).alias("most"), F.min(value).alias("least"))


def benchmark_markdown(samples: DataFrame, name: str, value: str) -> DataFrame:
    """A line of the benchmark report for each name."""
    p = profile(samples, name, value)
    return p.select(name, F.format_string("- %s: mean %.1f, median %.1f, max %.1f, min %.1f", F.col(name), "mean", F.col("median").cast("double"), F.col("most").cast("double"), F.col("least").cast("double")).alias("line"))


def fastest(samples: DataFrame, name: str, value: str) -> DataFrame:
    return samples.agg(F.min_by(name, F.struct(value, name)).alias("best"), F.min(value).alias("value"))


def grade(debt: Column, lines: Column) -> Column:
    """A letter by debt for each thousand lines; no lines: N/A."""
    ratio = debt / F.greatest(lines / 1000, F.lit(1))
    return F.when(lines == 0, "N/A").when(ratio <= 1, "A").when(ratio <= 3, "B").when(ratio <= 7, "C").when(ratio <= 15, "D").otherwise("F")


def table_view(findings: DataFrame, page_size: int = 25, number: int = 0) -> DataFrame:
    """A page of the findings table: most severe first, in arrival order within a severity."""
    return findings.orderBy(severity_ordinal().desc(), "ingest_seq").offset(page_size * number).limit(page_size)


def arrival(findings: DataFrame, n: int) -> DataFrame:
    return findings.orderBy("ingest_seq").limit(n)
