"""Registered queries over the driver tables, each with the SQL that gives the same rows (where SQL can)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..adapters import ORD, SQL, advisories_v, files_v, findings_v, full_v, lines_v, packages_v, table, usage_v
from ..functions import text
from ..operators import batching, cachetable, dedup, deps, enrich, findings, stats, usage
from ..schemas import DEBT_BASE, DEBT_FACTOR, QUALITY_TYPES, SECURITY_TYPES
from ..sinks import reports
from ..sources import files as scans
from ..sources import parsers
from . import details, extended, projects, pipeline

QUERIES: dict = {}
ORACLES: dict = {}


def _add(name: str, view, build, view_name: str | None = None, sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(view(spark, sf_dir))
    if sql:
        ORACLES[name] = f"WITH {SQL[view_name]} {sql}" if not sql.lstrip().startswith(",") else f"WITH {SQL[view_name]}{sql}"


def _f(name, build, sql=None):
    _add(name, findings_v, build, "findings_v", sql)


_DEBT = "floor((CASE severity " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in DEBT_BASE.items()) + " END)::DOUBLE * (CASE finding_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in DEBT_FACTOR.items()) + " ELSE 1.0 END)::DOUBLE * confidence * 100 + 0.5) / 100"
_THREE = "CASE WHEN severity IN ('high','critical') THEN 'high' WHEN severity = 'medium' THEN 'medium' ELSE 'low' END"
_SEC = "(" + ",".join(f"'{x}'" for x in SECURITY_TYPES) + ")"
_GRP = f"CASE WHEN finding_type IN {_SEC} THEN '#s' WHEN finding_type IN (" + ",".join(f"'{x}'" for x in QUALITY_TYPES) + ") THEN '#q' ELSE finding_type END"
_DIM = "(VALUES ('info'),('low'),('medium'),('high'),('critical')) d(severity)"

_f("i01_severity_zero_filled", lambda f: stats.by_severity(findings.with_severity(f, ["critical", "high", "low"])), f"SELECT d.severity, count(f.ingest_seq) AS n FROM {_DIM} LEFT JOIN (SELECT * FROM findings_v WHERE severity IN ('critical','high','low')) f ON f.severity = d.severity GROUP BY 1")
_f("i02_type_counts", lambda f: stats.counts(f, "finding_type"), "SELECT finding_type, count(*) AS n FROM findings_v GROUP BY 1")
_f("i03_source_counts", lambda f: stats.counts(f, "source"), "SELECT source, count(*) AS n FROM findings_v GROUP BY 1")
_f("i04_affected_files", stats.affected_files, "SELECT file_path, count(*) AS n FROM findings_v GROUP BY 1")
_f("i07_debt_stats", stats.debt_stats, f"SELECT round(sum(d), 1) AS total, round(avg(d), 2) AS average, max(d) AS highest, min(d) AS lowest FROM (SELECT {_DEBT} AS d FROM findings_v)")
_f("i11_top_files", lambda f: stats.top(f, "file_path"), "SELECT file_path, count(*) AS n FROM findings_v GROUP BY 1 ORDER BY n DESC, file_path LIMIT 10")
_f("j04_top_types", lambda f: stats.top(f, "finding_type", 5), "SELECT finding_type, count(*) AS n FROM findings_v GROUP BY 1 ORDER BY n DESC, 1 LIMIT 5")
_f("i12_impact_matrix", stats.impact_matrix, f""", m AS (
    SELECT 'maintainability_impact' AS kind, CASE WHEN finding_type IN ('code_smell','anti_pattern','style_violation','missing_documentation') THEN {_THREE} ELSE 'minimal' END AS level FROM findings_v
    UNION ALL SELECT 'security_impact', CASE WHEN finding_type IN {_SEC} THEN CASE WHEN severity IN ('critical','high','medium') THEN severity ELSE 'low' END ELSE 'minimal' END FROM findings_v
    UNION ALL SELECT 'performance_impact', CASE WHEN finding_type IN ('performance_issue','memory_leak','inefficient_algorithm') THEN severity ELSE 'minimal' END FROM findings_v
    UNION ALL SELECT 'reliability_impact', CASE WHEN finding_type IN ('memory_leak','performance_issue','syntax_error','flaky_test') THEN severity ELSE 'minimal' END FROM findings_v)
    SELECT kind, level, count(*) AS n FROM m WHERE level <> 'minimal' GROUP BY 1, 2""")
_f("i13_summary", stats.summary, "SELECT count(*) AS total, count(*) FILTER (severity='critical') AS critical, count(*) FILTER (severity='high') AS high, count(*) FILTER (finding_type='security_vulnerability') AS security, count(DISTINCT file_path) AS files, count(DISTINCT tool_name) AS tools FROM findings_v")
_f("i21_rollup", stats.rollup, "SELECT finding_type, severity, count(*) AS n, CAST(grouping(finding_type, severity) AS INT) AS gid FROM findings_v GROUP BY ROLLUP (finding_type, severity)")
_f("i22_security_matrix", stats.security_matrix, "SELECT severity, count(*) FILTER (contains(finding_type,'security')) AS security, count(*) FILTER (contains(finding_type,'pattern')) AS pattern, count(*) FILTER (contains(finding_type,'dependency')) AS dependency, count(*) AS total FROM findings_v GROUP BY 1")
_f("i23_daily_trend", stats.daily_trend, f"SELECT CAST(detected_at AS DATE) AS day, count(*) AS n, round(sum({_DEBT}), 1) AS debt, count(*) FILTER (severity='critical') AS critical FROM findings_v GROUP BY 1")
_f("i24_debt_heatmap", stats.debt_heatmap, f"SELECT string_split(file_path,'/')[-1] AS file, round(avg({_DEBT}), 2) AS avg_debt, count(*) AS n, " + ", ".join(f"count(*) FILTER (severity='{s}') AS {s}" for s in DEBT_BASE) + " FROM findings_v GROUP BY 1")
_f("i34_recommendations", stats.recommendations, "SELECT * FROM (SELECT 'immediate' AS priority, 'security' AS category, count(*) FILTER (severity='critical') AS n FROM findings_v UNION ALL SELECT 'high','maintainability', CASE WHEN count(*) FILTER (finding_type='code_smell') > 5 THEN count(*) FILTER (finding_type='code_smell') ELSE 0 END FROM findings_v UNION ALL SELECT 'medium','maintenance', count(*) FILTER (finding_type='outdated_dependency') FROM findings_v) WHERE n > 0")
_f("i35_quality", stats.quality, "SELECT greatest(0.0, round(100 - w / (n * 0.1) * 100, 1)) AS overall_score, 'F' AS grade, n AS total_issues, round(w, 1) AS weighted_severity_score FROM (SELECT sum((CASE severity WHEN 'critical' THEN 10 WHEN 'high' THEN 5 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0.1 END)::DOUBLE) AS w, count(*) AS n FROM findings_v)")
_f("i36_risk", stats.risk, "SELECT CASE WHEN c > 0 OR s > 3 THEN 'high' WHEN h > 5 OR s > 1 THEN 'medium' WHEN h > 0 OR s > 0 THEN 'low' ELSE 'minimal' END AS risk_level, s AS security, c AS critical, h AS high, CAST(least(100, 25*c + 10*h + 15*s) AS BIGINT) AS risk_score FROM (SELECT count(*) FILTER (severity='critical') AS c, count(*) FILTER (severity='high') AS h, count(*) FILTER (finding_type='security_vulnerability') AS s FROM findings_v)")
_f("o03_security_map", lambda f: f.select("ingest_seq", *(F.array_join(c, ",").alias(k) for k, c in enrich.security_map(F.replace("message", F.lit("error"), F.lit("authentication error"))).items())), "SELECT ingest_seq, CASE WHEN a THEN 'CWE-287,CWE-306' ELSE '' END AS cwe_ids, CASE WHEN a THEN 'A07:2021 – Identification and Authentication Failures' ELSE '' END AS owasp_categories, CASE WHEN a THEN 'PCI-DSS,HIPAA' ELSE '' END AS compliance_violations FROM (SELECT ingest_seq, contains(message, 'error') AS a FROM findings_v)")
_f("o04_debt", lambda f: f.select("ingest_seq", enrich.debt(False).alias("debt")), f"SELECT ingest_seq, {_DEBT} AS debt FROM findings_v")
_f("o10_business", lambda f: f.select("ingest_seq", enrich.business_impact().alias("business_impact")), f"SELECT ingest_seq, CASE WHEN finding_type IN ('security_vulnerability','performance_issue','memory_leak') THEN {_THREE} ELSE 'low' END AS business_impact FROM findings_v")
_f("g04_filter", lambda f: findings.search(f, ["high", "critical"], ["security_vulnerability", "code_smell"], "k=1").select("ingest_seq", "file_path", "severity"), "SELECT ingest_seq, file_path, severity FROM findings_v WHERE severity IN ('high','critical') AND finding_type IN ('security_vulnerability','code_smell') AND (contains(lower(title),'k=1') OR contains(lower(message),'k=1'))")
_f("m01_ids", lambda f: f.select("ingest_seq", dedup.content_id().alias("id")), "SELECT ingest_seq, substr(sha256(concat_ws(':', finding_type, file_path, coalesce(CAST(line_start AS VARCHAR),'None'), title, coalesce(rule_id,'None'))), 1, 16) AS id FROM findings_v")
_SIM = "((a.rule_id = b.rule_id AND b.rule_id <> '') OR contains(lower(a.title), lower(b.title)) OR contains(lower(b.title), lower(a.title)) OR contains(lower(a.message), lower(b.message)) OR contains(lower(b.message), lower(a.message)))"
_NEAR = "(abs(a.line_start - b.line_start) <= 5 OR a.line_start IS NULL OR b.line_start IS NULL)"
_f("m03_similar_pairs", dedup.similar_pairs, f", g AS (SELECT *, {_GRP} AS grp FROM findings_v) SELECT a.ingest_seq AS a, b.ingest_seq AS b FROM g a JOIN g b ON a.file_path = b.file_path AND a.grp = b.grp AND a.ingest_seq < b.ingest_seq AND {_NEAR} AND coalesce({_SIM}, false)")


def _cluster(view: str, function: str = "NULL::VARCHAR", class_: str = "NULL::VARCHAR") -> str:
    """lead(ingest_seq, leader): the fold in arrival order, as a recursion over each file and type group."""
    item = f"struct_pack(q := {{0}}ingest_seq, l := line_start, r := rule_id, t := lower(title), m := lower(message), f := {function}, c := {class_})"
    near = f"(abs(x.l - g.line_start) <= 5 OR ((x.l IS NULL OR g.line_start IS NULL) AND (x.f IS NOT DISTINCT FROM g.{function} OR x.c IS NOT DISTINCT FROM g.{class_})))" if "NULL" not in function else "(abs(x.l - g.line_start) <= 5 OR x.l IS NULL OR g.line_start IS NULL)"
    like = "(x.r = g.rule_id OR contains(x.t, lower(g.title)) OR contains(lower(g.title), x.t) OR contains(x.m, lower(g.message)) OR contains(lower(g.message), x.m))"
    return f""", g AS (SELECT *, {_GRP} AS grp, row_number() OVER (PARTITION BY file_path, {_GRP} ORDER BY ingest_seq) AS rn FROM {view}),
    lead(file_path, grp, rn, ls, ingest_seq, leader) AS (
      SELECT file_path, grp, rn, [{item.format('')}], ingest_seq, ingest_seq FROM g WHERE rn = 1
      UNION ALL
      SELECT g.file_path, g.grp, g.rn, CASE WHEN h.q IS NULL THEN list_append(ls, {item.format('g.')}) ELSE ls END, g.ingest_seq, coalesce(h.q, g.ingest_seq)
      FROM lead JOIN g ON g.file_path = lead.file_path AND g.grp = lead.grp AND g.rn = lead.rn + 1,
      LATERAL (SELECT list_filter(ls, lambda x: coalesce({near} AND {like}, false))[1].q AS q) h)"""


_CLUSTER = _cluster("findings_v")
_ID = "substr(sha256(concat_ws(':', finding_type, file_path, coalesce(CAST(line_start AS VARCHAR),'None'), title, coalesce(rule_id,'None'))), 1, 16)"
# members of groups; of each the primary; all that fold (the primary first, then those with another id by arrival)
_MEMBERS = f"""j AS MATERIALIZED (SELECT f.*, l.leader, {ORD} AS o, {_ID} AS id FROM {{view}} f JOIN (SELECT ingest_seq, leader FROM lead) l USING (ingest_seq)),
    p AS (SELECT *, row_number() OVER (PARTITION BY leader ORDER BY o DESC, confidence DESC, ingest_seq) AS rn FROM j), pr AS (SELECT * FROM p WHERE rn = 1),
    q AS (SELECT p.*, (p.rn > 1)::INT AS k FROM p JOIN pr USING (leader) WHERE p.rn = 1 OR p.id <> pr.id), sizes AS (SELECT leader, count(*) AS group_size FROM j GROUP BY 1)"""
_BAR = "list_reduce(list({0} ORDER BY k, ingest_seq), lambda a, b: CASE WHEN b = '' OR b = a THEN a WHEN a = '' THEN b ELSE a || ' | ' || b END)"
_FIRST = "list_filter(list({0} ORDER BY k, ingest_seq), lambda x: x <> '')[1]"
_SET = "array_to_string(list_sort(list_distinct(flatten(list({0})))), ',')"
ORACLES["m05_clusters"] = f"WITH RECURSIVE {SQL['findings_v']}{_CLUSTER} SELECT ingest_seq, leader FROM lead"
ORACLES["m11_stats"] = (
    f"WITH RECURSIVE {SQL['findings_v']}{_CLUSTER}, n AS (SELECT leader, count(*) AS n FROM lead GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS before_count, count(*) AS total_groups, "
    "count(*) FILTER (n > 1) AS merged_count, count(*) FILTER (n = 1) AS kept_count, round(100.0::DOUBLE * (sum(n) - count(*)) / sum(n), 2) AS reduction_percent FROM n"
)
ORACLES["m10_duplicates"] = f"WITH RECURSIVE {SQL['findings_v']}{_CLUSTER} SELECT ingest_seq, leader AS duplicate_of FROM lead WHERE ingest_seq <> leader"
_MERGED = ["leader", "primary", "id", "severity", "group_size", "confidence", "detected_at", "tool_name", "description", "suggestion", "title", "message", "rule_id", "impact", "effort_to_fix", "line_start", "affected_code", "fix_recommendation"]
ORACLES["m06_merged"] = f"""WITH RECURSIVE {SQL['full_v']}{_cluster('full_v', 'function_name', 'class_name')}, {_MEMBERS.format(view='full_v')},
    a AS (SELECT leader, max(confidence) AS confidence, min(detected_at) AS detected_at, string_agg(tool_name, ', ' ORDER BY k, ingest_seq) AS tool_name, {_BAR.format('description')} AS description, {_BAR.format('suggestion')} AS suggestion,
        {_FIRST.format('title')} AS title, {_FIRST.format('message')} AS message, {_FIRST.format('rule_id')} AS rule_id, {_FIRST.format('affected_code')} AS affected_code, coalesce({_FIRST.format('fix_recommendation')}, '') AS fix_recommendation,
        {_SET.format('tags')} AS tags, {_SET.format('related_findings')} AS related FROM q GROUP BY 1)
    SELECT a.leader, pr.ingest_seq AS "primary", pr.id, pr.severity, group_size, a.confidence, a.detected_at, a.tool_name, a.description, a.suggestion, a.title, a.message, a.rule_id, pr.impact, pr.effort_to_fix, pr.line_start,
        a.affected_code, a.fix_recommendation, a.tags, a.related FROM a JOIN pr USING (leader) JOIN sizes USING (leader)"""
ORACLES["t_pipeline"] = f"""WITH RECURSIVE {SQL['findings_v']}{_CLUSTER}, {_MEMBERS.format(view='findings_v')}, c AS (SELECT leader, max(confidence) AS best FROM q GROUP BY 1),
    m AS (SELECT finding_type, severity, group_size, best AS confidence FROM pr JOIN c USING (leader) JOIN sizes USING (leader))
    SELECT finding_type, severity, count(*) AS n, CAST(sum(group_size) AS BIGINT) AS raw, round(sum({_DEBT}), 2) AS debt, count(*) FILTER (finding_type IN ('security_vulnerability','performance_issue','memory_leak') AND severity IN ('high','critical')) AS urgent FROM m GROUP BY 1, 2"""
_INSIDE = "len(list_filter({0}, lambda a: len(list_filter({0}, lambda b: a <> b AND contains(b, a))) > 0)) > 0"
_SUBSET = " OR ".join(f"len(list_filter(types, lambda t: NOT list_contains({names!r}, t))) = 0" for names in dedup.REASON_GROUPS.values())
ORACLES["m08_merge_reasons"] = f"""WITH RECURSIVE {SQL['full_v']}{_cluster('full_v', 'function_name', 'class_name')}, j AS (SELECT f.*, l.leader FROM full_v f JOIN (SELECT ingest_seq, leader FROM lead) l USING (ingest_seq)),
    s AS (SELECT leader, count(*) AS n, count(DISTINCT coalesce(line_start::VARCHAR, '-') || ':' || coalesce(column_start::VARCHAR, '-')) AS places, count(DISTINCT line_start) AS lines, count(DISTINCT rule_id) AS rules,
        list(DISTINCT finding_type) AS types, list(DISTINCT lower(title)) AS t, list(DISTINCT lower(message)) AS m FROM j GROUP BY 1 HAVING count(*) > 1),
    r AS (SELECT leader, n, list_filter([CASE WHEN places = 1 THEN 'exact_location_match' WHEN lines <= 5 THEN 'nearby_location_match' END, CASE WHEN rules = 1 THEN 'same_rule_id' END,
        CASE WHEN len(types) = 1 THEN 'same_finding_type' WHEN {_SUBSET} THEN 'compatible_finding_types' END, CASE WHEN {_INSIDE.format('t')} THEN 'similar_titles' END, CASE WHEN {_INSIDE.format('m')} THEN 'similar_messages' END], lambda x: x IS NOT NULL) AS rs FROM s)
    SELECT leader, n AS group_size, CASE WHEN len(rs) = 0 THEN 'similarity_match' ELSE array_to_string(rs, ',') END AS reasons FROM r"""
_f("m05_clusters", dedup.leader_groups)
_f("m11_stats", lambda f: dedup.dedup_stats(dedup.leader_groups(f)))
_f("m10_duplicates", lambda f: dedup.duplicates(dedup.leader_groups(f)))
_add("m06_merged", full_v, lambda f: dedup.deduplicate(f).select(*_MERGED, F.array_join("tags", ",").alias("tags"), F.array_join("related_findings", ",").alias("related")))
_add("m08_merge_reasons", full_v, lambda f: dedup.merge_reasons(f, dedup.leader_groups(f)))
_f("j01_file_order", stats.file_order, f"SELECT file_path, ingest_seq, row_number() OVER (PARTITION BY file_path ORDER BY {ORD} DESC, coalesce(line_start,0) DESC, ingest_seq) AS place FROM findings_v")
_f("j07_page", lambda f: stats.page(f.select("ingest_seq", "title"), "ingest_seq", 50, 25), "SELECT ingest_seq, title FROM findings_v ORDER BY ingest_seq DESC LIMIT 25 OFFSET 50")
_f("k04_first_per_rule", lambda f: dedup.first_per(f.where("rule_id is not null"), ["tool_name", "rule_id"]).select("tool_name", "rule_id", "ingest_seq"), "SELECT tool_name, rule_id, min(ingest_seq) AS ingest_seq FROM findings_v WHERE rule_id IS NOT NULL GROUP BY 1, 2")
_f("b21_issues", lambda f: reports.issues(f, f.where("ingest_seq % 2 = 0").select(F.concat("file_path", F.lit(":"), "title").alias("signature"))).select("signature", "severity"), "SELECT file_path || ':' || title AS signature, severity FROM findings_v WHERE severity IN ('critical','high') AND file_path || ':' || title NOT IN (SELECT file_path || ':' || title FROM findings_v WHERE ingest_seq % 2 = 0) ORDER BY ingest_seq LIMIT 20")
_f("t_pipeline", pipeline.flagship)

_add("n02_locations", findings_v, lambda f: f.withColumn("line_end", F.col("line_start") + 2).select("ingest_seq", text.location_text().alias("location")), "findings_v", "SELECT ingest_seq, file_path || coalesce(':' || line_start || '-' || (line_start + 2), '') AS location FROM findings_v")
_add("n17_templates", findings_v, lambda f: f.select("ingest_seq", text.fill_template("{sev}: {title} @ {file}", {"sev": F.col("severity"), "title": F.col("title"), "file": F.col("file_path")}).alias("payload")), "findings_v", "SELECT ingest_seq, severity || ': ' || title || ' @ ' || file_path AS payload FROM findings_v")


def _u(name, build, sql=None):
    _add(name, usage_v, build, "usage_v", sql)


_COST = "CAST(floor((input_tokens * (CASE model WHEN 'large' THEN 1500 WHEN 'small' THEN 25 ELSE 300 END) + output_tokens * (CASE model WHEN 'large' THEN 7500 WHEN 'small' THEN 125 ELSE 1500 END)) / 100.0) AS BIGINT)"
_f_u = "SELECT {k}, count(*) AS requests, CAST(sum(" + _COST + ") AS BIGINT) AS cost, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS tokens FROM usage_v GROUP BY 1"
_u("h11_cost", lambda u: usage.priced(u).select("request_id", "model", "cost"), f"SELECT request_id, model, {_COST} AS cost FROM usage_v")
_u("i25_usage", usage.usage_summary, f"SELECT count(*) AS requests, CAST(sum({_COST}) AS BIGINT) AS cost, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS tokens, count(*) FILTER (success) AS succeeded, count(*) FILTER (NOT success) AS failed, round(avg({_COST}), 2) AS avg_cost FROM usage_v")
_u("i26_model", lambda u: usage.usage_by(u, "model"), _f_u.format(k="model"))
_u("i27_type", lambda u: usage.usage_by(u, "request_type"), _f_u.format(k="request_type"))
_u("i28_budget", lambda u: usage.budget_status(u, 5_000_000, 100_000_000, 1_000_000_000), f""", c AS (SELECT timestamp AS t, {_COST} AS cost FROM usage_v), l AS (SELECT max(t) AS t FROM c), x AS (
    SELECT 'daily' AS period, CAST(5000000 AS BIGINT) AS limit_micro, CAST(sum(cost) AS BIGINT) AS used FROM c, l WHERE CAST(c.t AS DATE) = CAST(l.t AS DATE)
    UNION ALL SELECT 'monthly', 100000000, CAST(sum(cost) AS BIGINT) FROM c, l WHERE date_trunc('month', c.t) = date_trunc('month', l.t) UNION ALL SELECT 'total', 1000000000, CAST(sum(cost) AS BIGINT) FROM c)
    SELECT period, limit_micro, used, CAST(greatest(0, limit_micro - used) AS BIGINT) AS remaining, round(100.0::DOUBLE * used / limit_micro, 2) AS percentage FROM x""")
_u("k06_trailing_60s", usage.trailing_tokens, "SELECT request_id, model, CAST(sum(input_tokens) OVER (PARTITION BY model ORDER BY timestamp RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW) AS BIGINT) AS trailing FROM usage_v")
_u("p06_alerts", lambda u: usage.budget_alerts(u, 5_000_000), f", r AS (SELECT request_id, CAST(timestamp AS DATE) AS day, CAST(sum({_COST}) OVER (PARTITION BY CAST(timestamp AS DATE) ORDER BY timestamp, request_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM usage_v) SELECT request_id, day, running, CASE WHEN running >= 5000000 THEN 'exceeded' WHEN running >= 4000000 THEN 'warning' ELSE 'ok' END AS status FROM r")
_u("p01_limiter", usage.replay_limiter)


def _p(name, build, sql, **view):
    QUERIES[name] = lambda spark, sf_dir: build(packages_v(spark, sf_dir, **view), advisories_v(spark, sf_dir))
    ORACLES[name] = f"WITH {SQL['packages_v']}, {SQL['advisories_v']} {sql}"


_HAS = "package IN (SELECT package FROM advisories_v)"
_p("a13_last_wins", lambda p, a: deps.last_wins(p, "mention").select("manifest", "package", "position", "dev"), "SELECT manifest, package, position, dev FROM (SELECT *, row_number() OVER (PARTITION BY manifest, package ORDER BY position DESC) AS rn FROM packages_v) WHERE rn = 1", mention=True)
_p("h04_vulnerable_packages", lambda p, a: deps.vulnerable(p, a).select("manifest", "position", "package", "has_vulnerabilities"), f"SELECT manifest, position, package, {_HAS} AS has_vulnerabilities FROM packages_v")
_p("h05_metadata", lambda p, a: deps.with_metadata(p, a.select("package", F.when(F.col("severity") != "low", F.col("severity")).otherwise("").alias("licence"))), "SELECT manifest, position, p.package, coalesce(nullif(CASE WHEN a.severity <> 'low' THEN a.severity ELSE '' END, ''), licence) AS licence FROM packages_v p LEFT JOIN advisories_v a ON a.package = p.package")
_p("h06_advisories", lambda p, a: deps.advisories_of(p, a).groupBy("package_manager", "severity").agg(F.count("*").alias("n"), F.countDistinct("package").alias("packages")), "SELECT package_manager, severity, count(*) AS n, count(DISTINCT p.package) AS packages FROM packages_v p JOIN advisories_v a ON a.package = p.package GROUP BY 1, 2")
_p("i14_manifest_stats", deps.manifest_stats, f"SELECT manifest, count(*) AS total, count(*) FILTER (NOT dev AND NOT optional) AS prod, count(*) FILTER (dev) AS dev, count(*) FILTER (optional) AS optional, count(*) FILTER ({_HAS}) AS vulnerable, count(DISTINCT licence) AS licences FROM packages_v GROUP BY 1")
_p("i15_advisory_severity", lambda p, a: stats.counts(a, "severity"), "SELECT severity, count(*) AS n FROM advisories_v GROUP BY 1")
_p("i16_licences", lambda p, a: deps.licence_distribution(p), "SELECT licence, count(*) AS n, count(DISTINCT package) AS packages FROM packages_v WHERE licence IS NOT NULL GROUP BY 1")
_p("i17_managers", lambda p, a: stats.counts(p, "package_manager"), "SELECT package_manager, count(*) AS n FROM packages_v GROUP BY 1")
_p("i18_licence_names", lambda p, a: deps.licence_names(p), "SELECT DISTINCT licence, package FROM packages_v WHERE licence IS NOT NULL")
_p("i19_unlicensed", lambda p, a: deps.unlicensed(p), "SELECT count(*) FILTER (coalesce(licence,'') = '') AS unlicensed, count(*) AS total FROM packages_v")
_p("o12_graph", lambda p, a: deps.graph(p), "SELECT DISTINCT 'manifest:' || manifest AS source, 'package:' || package AS target FROM packages_v")


def _l(name, build, sql=None):
    _add(name, lines_v, build, "lines_v", sql)


_l("e01_loc", lambda x: text.lines_of_code(x, "#"), "SELECT path, count(*) FILTER (t <> '' AND NOT starts_with(t, '#')) AS loc, count(*) AS total_lines FROM (SELECT path, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS t FROM lines_v) GROUP BY 1")
_l("d07_duplicate_lines", lambda x: text.repeated_lines(x).select("path", "line_no", "first_line"), "SELECT path, line_no, first_line FROM (SELECT path, line_no, row_number() OVER w AS rn, first(line_no) OVER w AS first_line FROM lines_v WHERE length(line) > 0 WINDOW w AS (PARTITION BY path, line ORDER BY line_no)) WHERE rn > 1")
_l("d11_numbers", lambda x: text.magic_numbers(x).groupBy("number").agg(F.count("*").alias("n")), "SELECT number, count(*) AS n FROM (SELECT unnest(list_filter(regexp_split_to_array(line, '[^A-Za-z0-9_]+'), lambda t: regexp_full_match(t, '[0-9]{2,}'))) AS number FROM lines_v) WHERE number NOT IN ('100','1000') GROUP BY 1")
_l("k03_lookahead", lambda x: x.withColumn("ahead", F.max(F.contains("line", F.lit("the")).cast("int")).over(W.partitionBy("path").orderBy("line_no").rowsBetween(1, 5))).select("path", "line_no", "ahead"), "SELECT path, line_no, max(CAST(contains(line,'the') AS INT)) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS ahead FROM lines_v")
_l("f07_linter_norm", lambda x: findings.from_linter(x.select(F.col("path").alias("file_path"), F.col("line_no").alias("line"), F.lit(1).alias("column"), F.when(F.col("line_no") % 3 == 0, "error").when(F.col("line_no") % 3 == 1, "note").otherwise("odd").alias("severity"), F.lit(None).cast("string").alias("rule"), F.replace("line", F.lit("the "), F.lit("format ")).alias("message")), "tool").select("file_path", "line_start", "severity", "finding_type", "title"), "SELECT path AS file_path, line_no AS line_start, CASE line_no % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'info' ELSE 'medium' END AS severity, CASE WHEN contains(m,'security') OR contains(m,'vulnerability') THEN 'security_vulnerability' WHEN contains(m,'performance') THEN 'performance_issue' WHEN contains(m,'syntax') THEN 'syntax_error' WHEN contains(m,'format') THEN 'formatting_issue' ELSE 'style_violation' END AS finding_type, 'Linter Issue' AS title FROM (SELECT *, lower(replace(line, 'the ', 'format ')) AS m FROM lines_v)")


def _d(name, build, sql=None):
    _add(name, files_v, build, "files_v", sql)


_d("e11_file_stats", scans.statistics, "SELECT count(*) AS n_files, CAST(sum(size) AS BIGINT) AS total_size, (SELECT path FROM files_v ORDER BY size DESC, path DESC LIMIT 1) AS largest, max(size) AS largest_size FROM files_v")
_d("e12_type_histogram", lambda f: scans.by_type(f.withColumn("file_type", F.element_at(F.split("path", "/"), 3))), "SELECT string_split(path,'/')[3] AS file_type, count(*) AS n, CAST(sum(size) AS BIGINT) AS size FROM files_v GROUP BY 1")
_d("a10_tree", lambda f: scans.tree(f).select("path", "parent", "depth", "children", "size"), """, n AS (SELECT split_part(path,'/',2) AS a, split_part(path,'/',3) AS b, split_part(path,'/',4) AS c, size FROM files_v)
    SELECT a AS path, '' AS parent, 1 AS depth, count(DISTINCT b) AS children, CAST(sum(size) AS BIGINT) AS size FROM n GROUP BY a
    UNION ALL SELECT a || '/' || b, a, 2, count(DISTINCT c), CAST(sum(size) AS BIGINT) FROM n GROUP BY a, b
    UNION ALL SELECT a || '/' || b || '/' || c, a || '/' || b, 3, 0, CAST(sum(size) AS BIGINT) FROM n GROUP BY a, b, c""")
_d("g07_excluded", lambda f: f.where(~F.col("path").rlike(text.glob_regex("/src1/*/doc_?5")) & (F.col("tokens").between(10, 500))).select("path", "tokens"), "SELECT path, tokens FROM files_v WHERE NOT regexp_full_match(path, '/src1/.*/doc_.5') AND tokens BETWEEN 10 AND 500")
_d("h10_changed", lambda f: cachetable.changed(f.where("doc_id % 7 <> 0").select("path", F.md5(F.concat_ws(":", "path", F.when(F.col("doc_id") % 5 == 0, F.lit(0)).otherwise(F.col("size")).cast("string"))).alias("file_hash")), f.where("doc_id % 11 <> 0").select("path", F.md5(F.concat_ws(":", "path", F.col("size").cast("string"))).alias("file_hash"))), "SELECT path, CASE WHEN doc_id % 7 = 0 THEN 'added' WHEN doc_id % 11 = 0 THEN 'removed' ELSE 'changed' END AS state FROM files_v WHERE NOT (doc_id % 7 = 0 AND doc_id % 11 = 0) AND (doc_id % 7 = 0 OR doc_id % 11 = 0 OR (doc_id % 5 = 0 AND size <> 0))")
_d("s03_invalidate", lambda f: cachetable.invalidate_by_dependency(f.select("path", F.array(F.element_at(F.split("path", "/"), 2), F.element_at(F.split("path", "/"), 3)).alias("dependencies")), "src3").select("path"), "SELECT path FROM files_v WHERE NOT list_contains([split_part(path,'/',2), split_part(path,'/',3)], 'src3')")
_d("s02_upsert", lambda f: cachetable.upsert(f.select(F.col("path").alias("key"), (F.col("doc_id") % 10).alias("timestamp"), F.col("size").alias("value")), f.where("doc_id % 2 = 0").select(F.col("path").alias("key"), F.lit(5).cast("long").alias("timestamp"), F.lit(-1).cast("long").alias("value"))), "SELECT path AS key, CASE WHEN doc_id % 2 = 0 AND doc_id % 10 <= 5 THEN 5 ELSE doc_id % 10 END AS timestamp, CASE WHEN doc_id % 2 = 0 AND doc_id % 10 <= 5 THEN -1 ELSE size END AS value FROM files_v")
_d("k07_evict", lambda f: cachetable.evict(f.select(F.col("path").alias("key"), F.col("size").alias("accessed")), 50), "SELECT path AS key, size AS accessed FROM files_v ORDER BY size DESC, path LIMIT 50")
_d("r02_chunks", lambda f: batching.chunks(f, 4, 1, 10).select("path", "chunk", "first_line", "tokens"), """, p AS (SELECT path, string_split(content, chr(10)) AS l FROM files_v), c AS (SELECT path, l, unnest(range(0, len(l), 3)) AS s FROM p)
    SELECT path, CAST(s // 3 AS INT) AS chunk, CAST(s + 1 AS INT) AS first_line, CAST(length(array_to_string(l[s+1:s+4], chr(10))) // 3 AS BIGINT) AS tokens FROM c WHERE length(array_to_string(l[s+1:s+4], chr(10))) // 3 >= 10""")
_d("r04_packing", lambda f: batching.next_fit(f, "doc_id", "tokens", 8000).select("doc_id", "batch_id"))
ORACLES["r04_packing"] = f"WITH RECURSIVE {SQL['files_v']}, o AS (SELECT doc_id, tokens, row_number() OVER (ORDER BY doc_id) AS rn FROM files_v), r AS (SELECT doc_id, rn, tokens AS total, CAST(0 AS BIGINT) AS batch_id FROM o WHERE rn = 1 UNION ALL SELECT o.doc_id, o.rn, CASE WHEN r.total > 0 AND r.total + o.tokens > 8000 THEN o.tokens ELSE r.total + o.tokens END, CASE WHEN r.total > 0 AND r.total + o.tokens > 8000 THEN r.batch_id + 1 ELSE r.batch_id END FROM r JOIN o ON o.rn = r.rn + 1) SELECT doc_id, batch_id FROM r"


def _page_files(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.col("html").alias("content"))


QUERIES["c17_page_links"] = lambda spark, sf_dir: parsers.edges(_page_files(spark, sf_dir), "html").groupBy("path", "kind", "target").agg(F.count("*").alias("n"))
ORACLES["c17_page_links"] = "SELECT CAST(page_id AS VARCHAR) AS path, kind, t AS target, count(*) AS n FROM (" + " UNION ALL ".join(
    "SELECT page_id, '{}' AS kind, unnest(regexp_extract_all(html, '{}', 1)) AS t FROM pages".format(kind, form.replace("'", "''")) for kind, form in parsers.EDGE_FORMS["html"]
) + ") GROUP BY ALL"
QUERIES["c19_page_symbols"] = lambda spark, sf_dir: parsers.html_symbols(_page_files(spark, sf_dir))
_SCRIPT = "(SELECT page_id, array_to_string(regexp_extract_all(html, '(?is)<script[^>]*>(.*?)</script>', 1), chr(10)) AS s FROM pages)"
ORACLES["c19_page_symbols"] = (
    "SELECT DISTINCT CAST(page_id AS VARCHAR) AS path, kind, name FROM (SELECT page_id, 'class' AS kind, unnest(regexp_split_to_array(c, '\\s+')) AS name FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)class\\s*=\\s*[''\"]([^''\"]+)[''\"]', 1)) AS c FROM pages) "
    "UNION ALL SELECT page_id, 'variable', unnest(regexp_extract_all(html, '(?i)id\\s*=\\s*[''\"]([^''\"]+)[''\"]', 1)) FROM pages "
    + "".join(f"UNION ALL SELECT page_id, 'function', unnest(regexp_extract_all(s, '{form}', 1)) FROM {_SCRIPT} " for form in parsers.PAGE_FUNCTIONS) + ") WHERE name <> ''"
)
QUERIES["c21_page_nodes"] = lambda spark, sf_dir: parsers.nodes(_page_files(spark, sf_dir), "html").groupBy("node_type").agg(F.count("*").alias("n"))
ORACLES["c21_page_nodes"] = "SELECT lower(t) AS node_type, count(*) AS n FROM (SELECT unnest(regexp_extract_all(regexp_replace(html, '(?is)(<script[^>]*>).*?</script>', '\\1</script>', 'g'), '<([a-zA-Z][a-zA-Z0-9]*)', 1)) AS t FROM pages) GROUP BY 1"
QUERIES["c26_json_keys"] = lambda spark, sf_dir: parsers.key_paths(parsers.nodes(table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("path"), F.col("props").alias("content")), "json"))
ORACLES["c26_json_keys"] = "SELECT CAST(event_id AS VARCHAR) AS path, unnest(json_keys(props)) AS key FROM events"
QUERIES["r05_prompts"] = lambda spark, sf_dir: batching.prompt(table(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", F.md5("content").alias("content_md5"))
ORACLES["r05_prompts"] = "SELECT conv_id, md5(string_agg('// ' || role || chr(10) || coalesce(text, ''), chr(10) ORDER BY turn)) AS content_md5 FROM conversations GROUP BY 1"
QUERIES["e08_code_quality"] = lambda spark, sf_dir: stats.code_quality(findings_v(spark, sf_dir), lines_v(spark, sf_dir))
ORACLES["e08_code_quality"] = f"WITH {SQL['findings_v']}, {SQL['lines_v']}, a AS (SELECT count(*) AS n, 10 * count(*) FILTER (severity='critical') + 5 * count(*) FILTER (severity='high') AS debt FROM findings_v), b AS (SELECT count(*) AS l FROM lines_v) SELECT l AS total_lines, round(n / greatest(l / 1000.0, 1.0)::DOUBLE, 2) AS findings_per_kloc, debt, CASE WHEN debt / (l / 1000.0) <= 1 THEN 'A' WHEN debt / (l / 1000.0) <= 3 THEN 'B' WHEN debt / (l / 1000.0) <= 7 THEN 'C' WHEN debt / (l / 1000.0) <= 15 THEN 'D' ELSE 'F' END AS grade FROM a, b"

QUERIES |= details.QUERIES | extended.QUERIES | projects.QUERIES
ORACLES |= details.ORACLES | extended.ORACLES | projects.ORACLES
