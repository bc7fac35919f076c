"""Worked cases of the findings operators."""

import datetime as dt
import json

from pyspark.sql import functions as F

from codeseam.operators import dedup, findings, stats, usage
from codeseam.operators.enrich import debt
from codeseam.sinks import reports

COLS = "ingest_seq long, file_path string, line_start int, severity string, finding_type string, rule_id string, title string, message string, confidence double, tool_name string, source string, detected_at timestamp_ntz"


def make(spark, rows):
    base = dict(ingest_seq=0, file_path="/a.py", line_start=1, severity="medium", finding_type="code_smell", rule_id="r", title="t", message="m", confidence=0.5, tool_name="tool", source="linter", detected_at=dt.datetime(2024, 1, 1))
    return spark.createDataFrame([tuple({**base, "ingest_seq": i, **r}.values()) for i, r in enumerate(rows)], COLS)


def test_content_id(spark):
    f = make(spark, [dict(file_path="/src/user_service.py", line_start=45, title="Long method detected", rule_id="too-many-lines")])
    assert f.select(dedup.content_id().alias("i")).first().i == "e07688a10b824cb7"


def groups(spark, lines):
    f = make(spark, [dict(line_start=x) for x in lines])
    return sorted(tuple(r) for r in dedup.leader_groups(f, 2).collect())


def test_leader_groups_depend_on_order(spark):
    assert groups(spark, [10, 12, 14]) == [(0, 0), (1, 0), (2, 2)]
    assert groups(spark, [12, 10, 14]) == [(0, 0), (1, 0), (2, 0)]
    assert groups(spark, [None, None]) == [(0, 0), (1, 0)]


def test_merge(spark):
    f = make(spark, [dict(severity="medium", confidence=0.9, tool_name="a", rule_id="x", title="same"), dict(severity="high", confidence=0.5, tool_name="b", line_start=2, rule_id="x", title="same", detected_at=dt.datetime(2024, 1, 2))])
    r = dedup.merged(f, dedup.leader_groups(f)).first()
    assert (r.primary, r.severity, r.confidence, r.tool_name, r.detected_at) == (1, "high", 0.9, "b, a", dt.datetime(2024, 1, 1))
    assert dedup.merge_reasons(f, dedup.leader_groups(f)).first().reasons == "nearby_location_match,same_rule_id,same_finding_type"


def test_debt_and_scores(spark):
    f = make(spark, [dict(severity="critical", finding_type="security_vulnerability", confidence=0.95)])
    assert f.select(debt().alias("d")).first().d == 14.25
    assert stats.quality(f).first().grade == "F"
    assert stats.risk(f).first().risk_level == "high"
    empty = f.limit(0)
    assert {r.severity: r.n for r in stats.by_severity(empty).collect()} == dict(info=0, low=0, medium=0, high=0, critical=0)
    assert stats.quality(empty).first().overall_score == 100.0
    assert "Total findings: 0" in reports.text_summary(empty)


def test_limiter():
    x = usage.Window60(100)
    assert x.acquire(0, 60) == 0 and x.acquire(10, 30) == 0
    assert round(x.acquire(20, 20), 6) == 40.1
    b = usage.TokenBucket(2, 5)
    assert [b.try_acquire(0) for _ in range(6)] == [True] * 5 + [False]
    assert b.try_acquire(1)


def test_reports(spark, tmp_path):
    f = make(spark, [{}, dict(severity="high", rule_id=None, message='say "</script>"'), dict(source="custom", line_start=0)])
    doc = json.loads("".join(reports.sarif(f)))
    assert doc["version"] == "2.1.0" and [len(r["results"]) for r in doc["runs"]] == [1, 2] and doc["runs"][1]["tool"]["driver"]["rules"][0]["id"] == "r"
    assert "startLine" not in doc["runs"][0]["results"][0]["locations"][0]["physicalLocation"].get("region", {})
    assert json.loads("".join(reports.sarif(f.limit(0)))) == {"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": []}
    out = reports.export(f, str(tmp_path), ["json", "csv", "sarif", "html", "markdown", "report", "enhanced", "nope"])
    assert out.pop("nope").startswith("failed") and set(out.values()) == {"written"} and reports.export(f, "x", ["csv"], dry_run=True) == {"csv": "planned"}
    back = spark.read.option("header", True).csv(f"{tmp_path}/csv")
    assert back.count() == 3 and back.columns == list(reports.CSV_COLUMNS)
    assert "<table>" in reports.html_report(f) and "high: 1" in reports.html_report(f, severities=["high"]) and "medium: 0" in reports.html_report(f, severities=["high"])
    assert "</script>\"" not in reports.interactive_html(f).split("const data")[1].split(";</script>")[0] and "heatmap" in reports.enhanced_html(f)
    r = reports.chat_message(f).first()
    assert (r.total, r.urgent, r.items, r.more) == (3, 1, "t in /a.py", 0)
    whole = json.loads(reports.json_report(f, {"run": 1}))
    assert whole["metadata"]["total_findings"] == 3 and whole["summary"]["severity_counts"]["high"] == 1 and len(whole["findings"]) == 3
    assert json.loads(reports.webhook(f, "2024-01-01", '{"n": {total_findings}, "h": {high_count}}')) == {"n": 3, "h": 1}
    assert json.loads(reports.webhook(f, "2024-01-01", "{broken"))["summary"]["total"] == 3 and len(json.loads(reports.webhook(f, "2024-01-01", full=True))["findings"]) == 3
    assert "*Total Findings:* 3" in reports.epic(f, "2024-01-01")
    assert reports.text_summary(f).splitlines()[:2] == ["Total findings: 3", "Files affected: 1"]


def test_places_without_lines(spark):
    """Where a line is missing, findings are near if function or class are the same, none included."""
    rows = [dict(line_start=None), dict(line_start=90), dict(line_start=None, title="z", message="z", rule_id="q")]
    f = make(spark, rows)
    assert {tuple(r) for r in dedup.similar_pairs(f).collect()} == {(0, 1)}
    named = f.withColumn("function_name", F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("ingest_seq") + 1).cast("int"))).withColumn("class_name", F.col("function_name"))
    assert dedup.similar_pairs(named).count() == 0 and dedup.leader_groups(named).where("ingest_seq <> leader").count() == 0


def test_merge_of_texts(spark):
    f = make(spark, [dict(severity="high"), dict(line_start=2), dict(line_start=3), dict(line_start=4)])
    f = f.withColumn("description", F.element_at(F.array(*map(F.lit, ["one", "two", "one", "two"])), (F.col("ingest_seq") + 1).cast("int"))).withColumn("tags", F.array(F.col("ingest_seq").cast("string")))
    r = dedup.deduplicate(f).first()
    assert (r.description, r.tags, r.group_size, r.is_merged) == ("one | two | one | two", ["0", "1", "2", "3"], 4, True) and len(r.merged_from) == 4


def test_numbered(spark):
    f = spark.range(20_000).select((F.col("id") * 7919 % 20_000).alias("k"), F.col("id").cast("string").alias("ingest_seq"))
    assert findings.numbered(f, ["k"], "n", 7).where("k <> n").count() == 0
    assert findings.numbered(f.limit(0), ["k"], "n").count() == 0


def test_numbered_ties_keep_their_numbers(spark):
    f = spark.range(5000).select((F.col("id") % 3).alias("k"), F.rand().alias("x"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("maybe"))
    held = spark.sparkContext._jsc.getPersistentRDDs().size()
    got = findings.numbered(f, ["k"], "n", 5)
    first, again = ({(r.k, r.x, r.maybe): r.n for r in got.collect()} for _ in range(2))
    assert first == again and sorted(first.values()) == list(range(5000))
    ks = [k for (k, _, _), _ in sorted(first.items(), key=lambda e: e[1])]
    assert ks == sorted(ks) and spark.sparkContext._jsc.getPersistentRDDs().size() == held
    shuffled = spark.createDataFrame(f.orderBy("x").collect(), f.schema)  # the same rows, dealt otherwise, get the same numbers
    one, two = ({(r.k, r.maybe, r.j): r.n for r in findings.numbered(d.selectExpr("k", "maybe", "coalesce(maybe, -1) % 7 AS j").distinct(), ["k"], "n", p).collect()} for d, p in ((f, 5), (shuffled, 2)))
    assert one == two


def test_normalise(spark):
    rows = spark.createDataFrame([("f", 1, 1, "ERROR", "E1", "Performance and format")], "file_path string, line int, column int, severity string, rule string, message string")
    r = findings.from_linter(rows, "t").first()
    assert (r.severity, r.finding_type, r.title) == ("high", "performance_issue", "Linter Issue: E1")
    d = spark.createDataFrame([("f", 1, "code_smell", "long_method", "warning", "m")], "file_path string, line int, pattern_type string, pattern_name string, severity string, message string")
    assert findings.from_static(d).first().title == "Long Method"
    assert findings.from_static(d.withColumn("severity", F.lit("error")), compat=True).first().severity == "medium"


def test_limiters_replay(spark):
    """Waits and grants of a day's requests by a naive simulation, one request after the other."""
    import random

    r = random.Random(3)
    rows = [(k, f"m{r.randrange(3)}", dt.datetime(2024, 1, 1) + dt.timedelta(seconds=r.randrange(4000) / 2), r.randrange(30) * 100) for k in range(600)]
    u = spark.createDataFrame(rows, "request_id long, model string, timestamp timestamp, input_tokens long")
    waits, grants = {}, {}
    for model in ("m0", "m1", "m2"):
        held, tokens, at = [], 5.0, None
        for k, _, t, n in sorted((x for x in rows if x[1] == model), key=lambda x: (x[2], x[0])):
            now, wait = t.timestamp(), 0.0
            inside = [(s, m) for s, m in held if s >= now - 60]
            if inside and sum(m for _, m in inside) + n > 6000:
                wait, freed = 60.0, 0
                for s, m in inside:
                    freed += m
                    if freed >= sum(m for _, m in inside) + n - 6000:
                        wait = max(0.0, s + 60 + 0.1 - now)
                        break
            held = [x for x in inside if x[0] >= now + wait - 60] if wait else inside
            held.append((now + wait, n))
            waits[k] = round(wait, 6)
            tokens = min(5.0, tokens + (0 if at is None else now - at) * 0.01)
            at = now
            grants[k] = tokens >= 1
            tokens -= grants[k]
    assert {x.request_id: x.wait for x in usage.replay_limiter(u, 6000).collect()} == waits and any(waits.values())
    assert {x.request_id: x.granted for x in usage.replay_bucket(u, 0.01, 5.0).collect()} == grants and len(set(grants.values())) == 2
