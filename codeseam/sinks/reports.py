"""Reports over findings: JSON, CSV, Markdown, HTML, SARIF, text; payload frames of external trackers.

Rows of reports are built in Spark, one for each finding, file or rule; only summaries and reports that are one
document by nature come to the driver, and those read their rows one by one."""

from __future__ import annotations

import html
import json
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import emoji, sorted_json, title
from ..operators import stats
from ..operators.enrich import enrich
from ..operators.usage import iso
from ..operators.automata import contained
from ..schemas import SEVERITIES, complete, literal_map, severity_ordinal

#: SARIF levels.
LEVELS = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "note"}
#: The columns of the table form, and what they are called.
CSV_COLUMNS = {
    "ID": "id", "Title": "title", "Severity": "severity", "Type": "finding_type", "Source": "source", "Tool": "tool_name", "File": "file_path", "Line Start": "line_start", "Line End": "line_end",
    "Column Start": "column_start", "Column End": "column_end", "Rule ID": "rule_id", "Message": "message", "Description": "description", "Suggestion": "suggestion", "Confidence": "confidence",
    "Impact": "impact", "Effort to Fix": "effort_to_fix", "Tags": "tags", "Detected At": "detected_at",
}


def only(findings: DataFrame, severities: list[str] = ()) -> DataFrame:
    """A report's allow-list; an empty one allows all."""
    return findings.where(F.col("severity").isin(list(severities))) if severities else findings


def as_json(findings: DataFrame) -> DataFrame:
    """One JSON text for each finding; nulls are left out."""
    return findings.select("ingest_seq", F.to_json(F.struct(*[c for c in findings.columns if c != "ingest_seq"])).alias("json"))


def write_json(findings: DataFrame, path: str) -> None:
    findings.write.mode("overwrite").json(path)


def write_json_report(findings: DataFrame, path: str, metadata: dict | None = None) -> None:
    """A folder with metadata, summary and the findings, each as JSON lines."""
    n = findings.count()
    about = {"tool": "codeseam", "version": "1.0.0", "total_findings": n, "collection_metadata": metadata or {}}
    findings.sparkSession.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")
    stats.report_summary(findings).coalesce(1).write.mode("overwrite").json(f"{path}/summary")
    write_json(findings, f"{path}/findings")


def json_report(findings: DataFrame, metadata: dict | None = None, pretty: bool = True) -> str:
    """The whole report as one text: metadata, summary and findings; for reports that fit the driver."""
    return _document([('"metadata"', json.dumps({"tool": "codeseam", "version": "1.0.0", "total_findings": findings.count(), "collection_metadata": metadata or {}})), ('"summary"', json.dumps(summary(findings)))], findings, pretty)


def _document(parts: list[tuple[str, str]], findings: DataFrame, pretty: bool) -> str:
    rows = ",".join(r.json for r in as_json(findings).orderBy("ingest_seq").toLocalIterator())
    text = "{" + ",".join(f"{k}:{v}" for k, v in parts) + f',"findings":[{rows}]}}'
    return json.dumps(json.loads(text), indent=2, ensure_ascii=False) if pretty else text


def summary(findings: DataFrame) -> dict:
    """The summary's parts by name; empty findings have zeros."""
    out: dict = {"severity_counts": {}, "type_counts": {}, "source_counts": {}}
    for r in stats.report_summary(findings).collect():
        if r.part == "total":
            out[r.name] = r.n
        else:
            out[f"{r.part}_counts"][r.name] = r.n
    return out


def csv_rows(findings: DataFrame) -> DataFrame:
    """The 20 columns of the table form: tags sorted and joined, times in ISO form, null rules empty."""
    f = complete(findings)
    special = {"tags": F.array_join(F.array_sort("tags"), ", "), "rule_id": F.coalesce("rule_id", F.lit("")), "detected_at": iso(F.col("detected_at"))}
    if "id" not in f.columns:
        from ..operators.dedup import content_id

        special["id"] = content_id()
    return f.select(*(special.get(c, F.col(c)).alias(name) for name, c in CSV_COLUMNS.items()))


def write_csv(findings: DataFrame, path: str) -> None:
    csv_rows(findings).write.mode("overwrite").option("header", True).csv(path)


def write_parquet(findings: DataFrame, path: str, by: str | None = None) -> None:
    w = findings.write.mode("overwrite")
    (w.partitionBy(by) if by else w).parquet(path)


def summary_lines(findings: DataFrame) -> DataFrame:
    """(place, line) of the text summary: severities that occur in fixed order, the ten most frequent types, sources."""
    s = stats.report_summary(findings)
    rank = F.when(F.col("part") == "severity", 6 - severity_ordinal("name"))
    total = s.where("part = 'total'").select(F.when(F.col("name") == "total", F.lit("0total")).otherwise("1files").alias("place"), F.concat(F.when(F.col("name") == "total", "Total findings: ").otherwise("Files affected: "), F.col("n").cast("string")).alias("line"))
    severities = s.where("part = 'severity' and n > 0").select(F.concat(F.lit("2"), rank.cast("string")).alias("place"), F.concat(F.lit("  "), F.upper("name"), F.lit(": "), F.col("n").cast("string")).alias("line"))
    types = stats.top(findings, "finding_type", 10).select(F.concat(F.lit("3"), F.lpad((10**12 - F.col("n")).cast("string"), 13, "0"), "finding_type").alias("place"), F.concat(F.lit("  "), _named(F.col("finding_type")), F.lit(": "), F.col("n").cast("string")).alias("line"))
    sources = s.where("part = 'source'").select(F.concat(F.lit("4"), "name").alias("place"), F.concat(F.lit("  "), _named(F.col("name")), F.lit(": "), F.col("n").cast("string")).alias("line"))
    return total.unionByName(severities).unionByName(types).unionByName(sources)


def _named(x: Column) -> Column:
    return title(F.replace(x, F.lit("_"), F.lit(" ")))


def text_summary(findings: DataFrame) -> str:
    """Counts by severity in fixed order, the ten most frequent types and the sources; zeros for an empty table."""
    out, last = [], ""
    for r in summary_lines(findings).orderBy("place").collect():
        if r.place[0] != last and r.place[0] in "234":
            out.append({"2": "Severities:", "3": "Top types:", "4": "Sources:"}[r.place[0]])
        last = r.place[0]
        out.append(r.line)
    return "\n".join(out)


def markdown_files(findings: DataFrame) -> DataFrame:
    """The section of each file: findings by severity and line, descending; built in Spark, one row a file."""
    f = complete(findings)
    span = F.when(F.col("line_end").isNotNull() & (F.col("line_end") != F.col("line_start")), F.concat(F.lit("-"), F.col("line_end").cast("string"))).otherwise("")
    lines = [
        F.concat(F.lit("#### "), emoji(F.col("severity")), F.lit(" "), "title"), F.concat(F.lit("**Severity**: "), title(F.col("severity"))), F.concat(F.lit("**Type**: "), _named(F.col("finding_type"))),
        F.concat(F.lit("**Source**: "), _named(F.col("source")), F.lit(" ("), "tool_name", F.lit(")")), F.when(F.col("line_start") != 0, F.concat(F.lit("**Location**: Line "), F.col("line_start").cast("string"), span)),
        *(F.when(F.col(c) != "", F.concat(F.lit(f"**{c.capitalize()}**: "), c)) for c in ("description", "message", "suggestion")),
        F.when(F.length("affected_code") > 0, F.concat(F.lit("**Affected Code**:\n```\n"), "affected_code", F.lit("\n```"))), F.lit(""),
    ]
    item = F.struct((-severity_ordinal()).alias("s"), (-F.coalesce("line_start", F.lit(0))).alias("l"), "ingest_seq", F.concat_ws("\n", *lines).alias("text"))
    g = f.groupBy("file_path").agg(F.array_sort(F.collect_list(item)).alias("i"))
    return g.select("file_path", F.concat(F.lit("### "), "file_path", F.lit("\n\n"), F.array_join(F.transform("i", lambda x: x["text"]), "\n")).alias("section"))


def markdown_report(findings: DataFrame, name: str = "Code Analysis Report") -> Iterator[str]:
    """The report's parts, one for each file after the summary."""
    s = summary(findings)
    yield "\n".join([f"# {name}", "", "## Summary", f"- **Total Findings**: {s['total']}", *(f"- **{x.capitalize()}**: {s['severity_counts'][x]}" for x in reversed(SEVERITIES)), f"- **Files Affected**: {s['affected_files_count']}", "", "## Detailed Findings", ""])
    for r in markdown_files(findings).orderBy("file_path").toLocalIterator():
        yield r.section


def _level(column: str = "severity") -> Column:
    return F.coalesce(literal_map(LEVELS)[F.col(column)], F.lit("warning"))


def _set(c: str) -> Column:
    return F.when(F.col(c) != 0, F.col(c))


def _or(*columns: str) -> Column:
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns), F.lit(""))


def sarif_results(findings: DataFrame) -> DataFrame:
    """source, tool_name, ingest_seq and one SARIF result as JSON for each finding; what a region doesn't know is left out."""
    f = complete(findings)
    region = F.struct(_set("line_start").alias("startLine"), _set("line_end").alias("endLine"), _set("column_start").alias("startColumn"), _set("column_end").alias("endColumn"))
    place = F.struct(F.struct(F.struct(F.col("file_path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    properties = F.struct("confidence", "impact", F.col("effort_to_fix").alias("effort"), "source", F.col("finding_type").alias("findingType"))
    result = F.struct(F.col("rule_id").alias("ruleId"), _level().alias("level"), F.struct(_or("message", "title").alias("text")).alias("message"), F.array(place).alias("locations"), properties.alias("properties"))
    return f.select("source", "tool_name", "ingest_seq", F.to_json(result).alias("result"))


def sarif_rules(findings: DataFrame) -> DataFrame:
    """source, tool_name, rule_id and one SARIF rule as JSON for each rule of a tool: its first finding describes it."""
    f = complete(findings).where("rule_id <> ''")
    rule = F.struct(
        F.col("rule_id").alias("id"), F.col("title").alias("name"), F.struct(_or("message", "title").alias("text")).alias("shortDescription"), F.struct(_or("description", "message", "title").alias("text")).alias("fullDescription"),
        F.struct(_level().alias("level")).alias("defaultConfiguration"), F.struct(F.col("finding_type").alias("category"), F.array_sort("tags").alias("tags")).alias("properties"),
    )
    first = f.groupBy("source", "tool_name", "rule_id").agg(F.min("ingest_seq").alias("first"), F.min_by(F.to_json(rule), "ingest_seq").alias("rule"))
    return first


def sarif(findings: DataFrame) -> Iterator[str]:
    """The SARIF document in parts: a run for each source and tool, rules and results read one by one."""
    rules: dict[tuple, list] = {}
    for r in sarif_rules(findings).orderBy("source", "tool_name", "first").toLocalIterator():
        rules.setdefault((r.source, r.tool_name), []).append(r.rule)
    yield '{"version":"2.1.0","$schema":"https://json.schemastore.org/sarif-2.1.0.json","runs":['
    now = None
    for r in sarif_results(findings).orderBy("source", "tool_name", "ingest_seq").toLocalIterator():
        if (r.source, r.tool_name) != now:
            yield ("" if now is None else "]},") + f'{{"tool":{{"driver":{{"name":{json.dumps(r.tool_name)},"version":"1.0.0","rules":[{",".join(rules.get((r.source, r.tool_name), ()))}]}}}},"results":['
            now = (r.source, r.tool_name)
            yield r.result
        else:
            yield "," + r.result
    yield "]}]}" if now else "]}"


def write_sarif(findings: DataFrame, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(sarif(findings))


def enhanced_rows(findings: DataFrame) -> DataFrame:
    """ingest_seq and one enhanced finding as JSON with sorted keys: the finding, its pattern, plan, impacts, debt and weaknesses."""
    e = enrich(complete(findings))
    security = F.struct(F.col("compliance_violations"), F.col("cwe_ids"), F.col("owasp_categories"))
    left = {c: F.col(c) for c in e.columns if c not in ("ingest_seq", "cwe_ids", "owasp_categories", "compliance_violations")}
    return e.select("ingest_seq", sorted_json({**left, "security_info": security}).alias("json"))


def write_enhanced(findings: DataFrame, path: str) -> None:
    """A folder with the enhanced findings, statistics, recommendations, quality metrics and risk, each as JSON lines."""
    e = enrich(complete(findings))
    enhanced_rows(findings).select("json").write.mode("overwrite").text(f"{path}/findings")
    for name, frame in (("statistics", stats.report_summary(e)), ("recommendations", stats.recommendations(e)), ("quality_metrics", stats.quality(e)), ("risk_assessment", stats.risk(e))):
        frame.coalesce(1).write.mode("overwrite").json(f"{path}/{name}")


def table_rows(findings: DataFrame) -> DataFrame:
    """The 24 columns of the findings table of an interactive report."""
    e = enrich(complete(findings), half_even=False)
    names = {"type": "finding_type", "remediation_description": "remediation.description", "remediation_priority": "remediation.priority", "pattern_name": "pattern_info.pattern_name", "pattern_confidence": "pattern_info.confidence_score"}
    plain = ["title", "severity", "file_path", "line_start", "line_end", "function_name", "class_name", "description", "confidence", "technical_debt_score", "business_impact", "effort_to_fix", "source", "tool_name"]
    from ..operators.dedup import content_id

    own = F.col("id") if "id" in findings.columns else content_id()
    texts = [F.coalesce(F.col(c), F.lit("")).alias(n) for n, c in names.items() if n != "pattern_confidence"]
    return e.select(
        "ingest_seq", own.alias("id"), *plain, iso(F.col("detected_at")).alias("detected_at"), *(F.array_join(F.array_sort(c), ",").alias(c) for c in ("tags", "cwe_ids", "owasp_categories")), *texts,
        F.coalesce(F.col(names["pattern_confidence"]), F.lit(0.0)).alias("pattern_confidence"),
    )


def _table(rows: list, columns: list[str]) -> str:
    head = "".join(f"<th>{html.escape(c)}</th>" for c in columns)
    body = "".join("<tr>" + "".join(f"<td>{html.escape('' if v is None else str(v))}</td>" for v in r) + "</tr>" for r in rows)
    return f"<table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>"


_FILTER = "<script>function show(s){document.querySelectorAll('tbody tr').forEach(r=>{r.hidden=s!==''&&r.cells[0].textContent!==s})}</script>"


def html_report(findings: DataFrame, rows: int = 100, severities: list[str] = ()) -> str:
    """Cards by severity and type, a filter, and the worst findings (a report: the number of rows is the feature)."""
    f = only(findings, severities)
    s = summary(f)
    cards = "".join(f"<button class='card {x}' onclick=\"show('{x}')\">{x}: {s['severity_counts'][x]}</button>" for x in reversed(SEVERITIES))
    types = "".join(f"<div class='type'>{html.escape(k)}: {n}</div>" for k, n in sorted(s["type_counts"].items()))
    columns = ["severity", "file_path", "line_start", "title", "message"]
    worst = f.orderBy(severity_ordinal().desc(), "ingest_seq").limit(rows).select(*columns).collect()
    return f"<html><body><button class='card' onclick=\"show('')\">all: {s.get('total', 0)}</button>{cards}{types}{_table(worst, columns)}{_FILTER}</body></html>"


def interactive_html(findings: DataFrame, rows: int = 1000) -> str:
    """A page with the dashboard's figures and charts as data, and the table of the worst findings."""
    e = enrich(complete(findings), half_even=False)
    figures = stats.dashboard(e).first().asDict()
    charts: dict = {}
    for r in stats.chart_rows(e).collect():
        charts.setdefault(r.chart, []).append([r.label, r.n])
    t = table_rows(findings).drop("ingest_seq")
    columns = ["severity", *(c for c in t.columns if c != "severity")]
    worst = t.orderBy(severity_ordinal().desc(), F.desc("technical_debt_score"), "file_path", "id").limit(rows).select(columns).collect()
    data = json.dumps({"metrics": figures, "charts": charts}).replace("</", "<\\/")
    return f"<html><body><script>const data = {data};</script>{_table(list(figures.items()), ['figure', 'value'])}{_table(worst, columns)}{_FILTER}</body></html>"


def enhanced_html(findings: DataFrame) -> str:
    """A page with the data of its plots: the heat map of debt, the daily trend, types with severities, the security matrix."""
    frames = {"heatmap": stats.debt_heatmap(findings).orderBy(F.desc("avg_debt")).limit(50), "trend": stats.daily_trend(findings).orderBy("day"), "sunburst": stats.rollup(findings), "security": stats.security_matrix(findings)}
    parts = []
    for name, frame in frames.items():
        parts.append(f"<h2>{name}</h2>" + _table([tuple(r) for r in frame.collect()], frame.columns))
    return f"<html><body>{''.join(parts)}</body></html>"


def dependency_html(packages: DataFrame, advisories: DataFrame, rows: int = 500) -> str:
    """A page with the summary of packages and the packages with advisories first."""
    from ..operators import deps

    s = [tuple(r) for r in deps.report_summary(packages, advisories).orderBy("part", "name").collect()]
    t = deps.report_rows(packages, advisories)
    first = t.orderBy(F.desc("vulnerable"), "manifest", "position").limit(rows)
    return f"<html><body>{_table(s, ['part', 'name', 'n'])}{_table([tuple(r) for r in first.collect()], t.columns)}</body></html>"


def dependency_markdown(packages: DataFrame, advisories: DataFrame) -> Iterator[str]:
    """Summary, a section for each manifest, recommendations."""
    from ..operators import deps

    s = {(r.part, r.name): r.n for r in deps.report_summary(packages, advisories).collect()}
    yield "# Dependency & Security Analysis Report\n\n## Summary\n" + "\n".join(f"- **{k}**: {n}" for (_, k), n in sorted(s.items()))
    for r in deps.manifest_sections(packages).orderBy("manifest").toLocalIterator():
        yield r.section
    unknown = deps.unlicensed(packages).first().unlicensed
    yield "## Recommendations\n" + "\n".join(f"- {x}" for x in recommendations(s.get(("total", "total_vulnerabilities"), 0), unknown))


#: The sentences of recommendations.
VULNERABLE_ADVICE = "Found {} security vulnerabilities. Update affected packages immediately."
UNLICENSED_ADVICE = "{} dependencies have unknown licenses. Review for compliance."
ALWAYS_ADVICE = ["Regularly update dependencies to latest stable versions.", "Use semantic versioning and pin critical dependency versions."]


def recommendations(vulnerabilities: int, unlicensed: int) -> list[str]:
    out = [VULNERABLE_ADVICE.format(vulnerabilities)] if vulnerabilities else []
    return out + ([UNLICENSED_ADVICE.format(unlicensed)] if unlicensed else []) + ALWAYS_ADVICE


def engine_report(results: dict, form: str = "console") -> str:
    """The report of a run (files, findings, metrics): summary, severities and the first ten findings by arrival."""
    f = results["findings"]
    s, files = summary(f), results["files"].count()
    first = f.orderBy("ingest_seq").limit(10).select("severity", "title", "file_path", "line_start", "message").collect()
    severities = {x: s["severity_counts"][x] for x in reversed(SEVERITIES) if s["severity_counts"][x]}
    if form == "json":
        return json.dumps({"total_files": files, "total_findings": s.get("total", 0), "severity_breakdown": s["severity_counts"], "findings": [r.asDict() for r in first]}, indent=2)
    if form == "markdown":
        top = [f"### {k}. {r.title}\n\n- **Severity:** {r.severity}\n- **File:** {r.file_path}\n- **Description:** {r.message}\n" for k, r in enumerate(first, 1)]
        return "\n".join(["# Analysis Report", "", "## Summary", "", f"- **Total Files:** {files}", f"- **Total Findings:** {s.get('total', 0)}", "", "## Findings by Severity", "", *(f"- **{k.capitalize()}:** {n}" for k, n in severities.items()), "", "## Top Findings", "", *top])
    if form == "html":
        return f"<html><body><h1>Analysis Report</h1><p>Total Files: {files}</p>{_table(list(severities.items()), ['severity', 'n'])}{_table(first, ['severity', 'title', 'file', 'line', 'message'])}</body></html>"
    if form == "console":
        return "\n".join([f"Total Files: {files}", f"Total Findings: {s.get('total', 0)}", *(f"  {k}: {n}" for k, n in severities.items()), *(f"{k}. [{r.severity}] {r.title} {r.file_path}" for k, r in enumerate(first, 1))])
    raise ValueError(f"unknown form {form!r}")


def issues(findings: DataFrame, existing: DataFrame, most: int = 20) -> DataFrame:
    """Payload of an issue tracker: critical and high findings without an open issue of the same file and title.

    existing: signature, or body: the texts of recent issues, of which none may hold ``file:title`` anywhere."""
    sign = F.concat("file_path", F.lit(":"), "title")
    new = findings.where(F.col("severity").isin("critical", "high")).withColumn("signature", sign)
    if "signature" in existing.columns:
        known = existing.select("signature").distinct()
    else:
        known = contained(new.select(F.col("signature").alias("pattern")), existing.select(F.col("body").alias("text"))).withColumnRenamed("pattern", "signature")
    new = new.join(known, "signature", "left_anti")
    labels = F.array_sort(F.array_distinct(F.array(F.lit("code-analysis"), "severity", F.replace("finding_type", F.lit("_"), F.lit("-")))))
    return new.orderBy("ingest_seq").limit(most).select("signature", "severity", "title", labels.alias("labels"))


#: A tracker's priorities by severity.
PRIORITIES = {"critical": "Highest", "high": "High", "medium": "Medium", "low": "Low", "info": "Lowest"}


def tickets(findings: DataFrame, severities: list[str] = ("critical", "high"), most: int = 50, labels: list[str] = ("code-analysis",)) -> DataFrame:
    """Payload of a ticket tracker: summary, priority and labels of the first findings of some severities."""
    kind = F.replace("finding_type", F.lit("_"), F.lit("-"))
    return only(findings, list(severities)).orderBy("ingest_seq").limit(most).select(
        "ingest_seq", F.concat(F.lit("["), F.upper("severity"), F.lit("] "), "title").alias("summary"), F.coalesce(literal_map(PRIORITIES)[F.col("severity")], F.lit("Medium")).alias("priority"),
        F.array(*map(F.lit, labels), kind).alias("labels"), F.concat_ws("\n", F.concat(F.lit("File: "), "file_path"), "message").alias("description"),
    )


def epic(findings: DataFrame, date: str) -> str:
    """The text of the ticket above the others: severities, the ten most frequent types and files."""
    s = summary(findings)
    severities = [f"* *{x.capitalize()}:* {s['severity_counts'][x]}" for x in reversed(SEVERITIES) if s["severity_counts"][x]]
    types = [f"* *{r[0]}:* {r.n}" for r in stats.top(findings, "finding_type").collect()]
    files = [f"* {r[0]}: {r.n} issues" for r in stats.top(findings, "file_path").collect()]
    return "\n".join(["h2. Code Analysis Summary", f"*Analysis Date:* {date}", f"*Total Findings:* {s.get('total', 0)}", "h3. Findings by Severity", *severities, "h3. Top Finding Types", *types, "h3. Files with Most Issues", *files])


def chat_message(findings: DataFrame, first: int = 10) -> DataFrame:
    """Payload of a chat channel: summary and the first urgent findings, in one pass that holds only those."""
    urgent = F.col("severity").isin("critical", "high")
    top = findings.where(urgent).orderBy("ingest_seq").limit(first).select(F.lit(0).alias("total"), F.lit(0).alias("urgent"), F.struct("ingest_seq", "title", "file_path").alias("item"))
    n = findings.select(F.lit(1).alias("total"), urgent.cast("int").alias("urgent"), F.lit(None).cast(top.schema["item"].dataType).alias("item"))
    items = F.array_join(F.transform(F.array_sort(F.collect_list("item")), lambda x: F.concat(x["title"], F.lit(" in "), x["file_path"])), "\n")
    a = n.union(top).agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.coalesce(F.sum("urgent"), F.lit(0)).alias("urgent"), items.alias("items"))
    return a.select("total", "urgent", "items", F.greatest(F.col("urgent") - first, F.lit(0)).alias("more"))


def webhook(findings: DataFrame, timestamp: str, template: str | None = None, full: bool = False) -> str:
    """Payload of a web hook: a template with its {names} filled in, or source, time and summary, with all findings if asked."""
    s = summary(findings)
    if template:
        values = {"total_findings": s.get("total", 0), "timestamp": timestamp, **{f"{x}_count": n for x, n in s["severity_counts"].items()}}
        for k, v in values.items():
            template = template.replace("{" + k + "}", str(v))
        try:
            return json.dumps(json.loads(template))
        except ValueError:
            pass  # a template that gives no JSON falls back on the default
    out = {"source": "codeseam", "timestamp": timestamp, "summary": s}
    return json.dumps(out) if not full else _document([(json.dumps(k), json.dumps(v)) for k, v in out.items()], findings, False)


def _write_text(path: str, parts) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(parts)


def _whole_sarif(findings: DataFrame, path: str) -> None:
    from .documents import write_sarif as in_parts

    in_parts(findings, path)


#: form -> writer; more can be registered.
EXPORTS: dict[str, Callable[[DataFrame, str], None]] = {
    "json": write_json, "csv": write_csv, "parquet": write_parquet, "report": write_json_report, "enhanced": write_enhanced,
    "sarif": lambda f, path: _whole_sarif(f, path), "html": lambda f, path: _write_text(path, [html_report(f)]), "markdown": lambda f, path: _write_text(path, (x + "\n" for x in markdown_report(f))),
}


def register(form: str, writer: Callable[[DataFrame, str], None]) -> None:
    EXPORTS[form] = writer


def export(findings: DataFrame, folder: str, formats: list[str], dry_run: bool = False) -> dict[str, str]:
    """Writes each format; an error of one is noted and doesn't stop the others."""
    out = {}
    for f in formats:
        try:
            if not dry_run:
                EXPORTS[f](findings, f"{folder}/{f}")
            out[f] = "planned" if dry_run else "written"
        except Exception as e:  # noqa: BLE001
            out[f] = f"failed: {e}"
    return out
