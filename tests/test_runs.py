"""Whole runs over folders: scans, detection in one pass, plug-ins, settings, the command line, responses, batches."""

import json
import random

import pytest
from pyspark.sql import functions as F

from codeseam import __main__ as cli
from codeseam import config, profiling
from codeseam.functions import text
from codeseam.operators import batching, cachetable, deps, patterns, stats, usage
from codeseam.plans import analyzers, pipeline
from codeseam.sources import detectors, manifests, parsers, readers
from codeseam.sources import files as scans
from codeseam.streaming import responses

SCRIPT = "const alpha = 42;\nlet beta = 100;\nfetch(u).then(a).then(b).then(c)\nconsole.log(alpha)"


def write(root, files):
    for name, body in files.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(body)


def test_scan_below_a_folder_named_build(spark, tmp_path):
    root = tmp_path / "build" / "env" / "x"
    write(root, {"a.py": "x = 1", "dist/b.py": "y", "src/dist2/c.py": "z", "gen/skip/d.py": "w", "e.min.js": "v", "package.json": '{"dependencies": {"p": "1"}}', "sub/requirements.txt": "q==2\n", "a/b/c/package.json": "{}", "vendor/package.json": "{}"})
    f = scans.scan(spark, str(root), exclude=["gen/*", "**/*.min.js"])
    assert {r.relative for r in f.collect()} == {"a.py", "src/dist2/c.py", "package.json", "sub/requirements.txt", "a/b/c/package.json", "vendor/package.json"}
    assert {r.relative for r in manifests.discover(f).collect()} == {"package.json", "sub/requirements.txt"}
    out = pipeline.dependencies(spark, str(root))
    assert {(r.manager, r.package, r.version) for r in out["packages"].collect()} == {("npm", "p", "1"), ("pip", "q", "==2")}
    assert scans.scan(spark, str(root / "a.py")).first().relative == "a.py"
    assert scans.scan(spark, str(root), extensions=[".py"]).count() == 3 and scans.scan(spark, str(root), ignored_dirs=["s*"]).where("relative like 'src%'").count() == 0
    assert scans.scan_errors(spark, str(root)).count() == 0
    with pytest.raises(FileNotFoundError):
        scans.scan(spark, str(root / "nope"))
    with pytest.raises(ValueError):
        scans.scan_directory(spark, str(root / "a.py"))


def line_findings(files):
    """The findings of scripts by the line detectors, one after the other."""
    t = text.lines(files)
    rows = [("magic_number", text.magic_numbers(t)), ("promise_hell", text.promise_chains(t)), ("missing_error_handling", text.unhandled_promises(t)), ("callback_hell", text.deep_indents(t)), ("unused_variable", text.unused_variables(t)), ("large_function", text.gaps(t, r"function\s+\w+|=>\s*\{", 50))]
    return sorted((r.path, r.line_no, name) for name, frame in rows for r in frame.select("path", "line_no").collect())


def test_one_pass_finds_what_the_line_detectors_find(spark):
    r = random.Random(4)
    parts = ["const a = 12;", "let b = a", "p.then(f)", ".catch(g)", " " * 20 + "go(function(e) {", "function f() {", "x => {", "", "// b 100 77", "q.then(a).then(b).then(c)", "var a = 1000", "y"]
    files = spark.createDataFrame([(str(k), "\n".join(r.choice(parts) if r.random() < 0.4 else "" for _ in range(r.randint(1, 160)))) for k in range(25)], "path string, content string")
    got = detectors.detect(files.withColumn("file_type", F.lit("javascript")))
    assert sorted((x.file_path, x.line, x.pattern_name) for x in got.collect()) == line_findings(files)


def test_detection_reads_once(spark, tmp_path):
    write(tmp_path, {"a.py": "class S:\n    def __new__(cls):\n        if 1:\n            pass\n", "b.js": SCRIPT, "c.md": "# x"})
    found = pipeline.detect(scans.scan(spark, str(tmp_path)), disabled=["magic_number"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan binaryFile") == 1 and "Exchange" not in plan
    assert {(r.pattern_name) for r in found.collect()} == {"singleton", "promise_hell", "unused_variable"}


def test_plug_ins(spark):
    files = spark.createDataFrame([("a.sh", "shell", "rm -rf /"), ("b.py", "python", "x = (")], "path string, file_type string, content string")
    entry = analyzers.register("shell", lambda f: f.where("content like '%rm -rf%'").select(F.col("path").alias("file_path"), F.lit(1).alias("line"), F.lit("anti_pattern").alias("pattern_type"), F.lit("rm").alias("pattern_name"), F.lit("critical").alias("severity"), F.lit("m").alias("message")))
    try:
        assert {r.pattern_name for r in analyzers.analyse(files).collect()} == {"rm", "analysis_error"} and "shell" in analyzers.languages()
        entry.disable("rm")
        assert {r.pattern_name for r in analyzers.analyse(files).collect()} == {"analysis_error"}
        entry.enable("rm")
        assert analyzers.analyse(files).where("pattern_name = 'rm'").count() == 1
    finally:
        analyzers.unregister("shell")
    m = analyzers.metrics("python", parsers.python_metrics(files.where("file_type = 'python'").select("path", "content")))
    assert [(r.name, r.value) for r in m.collect()] == [("python.total_lines", 1.0)]


def test_settings(tmp_path):
    (tmp_path / "codeseam.yaml").write_text("output_format: JSON\nanalysis:\n  max_file_size: 5\n")
    c = config.load(folder=str(tmp_path), environment={"CODESEAM_INCLUDE_TESTS": "off", "CODESEAM_LOG_LEVEL": "debug", "CODESEAM_MAX_FILE_SIZE": "1"})
    assert (c.output_format, c.analysis.max_file_size, c.analysis.include_tests, c.logging.level) == ("json", 1, False, "DEBUG")
    config.save(c, str(tmp_path / "again.yaml"))
    assert config.load(str(tmp_path / "again.yaml"), environment={}) == c
    for bad in ("output_format: x", "nope: 1", "analysis:\n  include_tests: 3", "a: [", "logging:\n  level: loud"):
        (tmp_path / "bad.yaml").write_text(bad)
        with pytest.raises(ValueError):
            config.load(str(tmp_path / "bad.yaml"), environment={})
    with pytest.raises(FileNotFoundError):
        config.load(str(tmp_path / "none.yaml"))


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.chdir(tmp_path)
    write(tmp_path / "p", {"a.js": SCRIPT, "package.json": '{"dependencies": {"left": "1"}}', "test_b.py": "x = ("})
    (tmp_path / "adv.jsonl").write_text('{"id": "A1", "affected": [{"package": {"ecosystem": "npm", "name": "left"}, "ranges": []}]}\n')
    assert cli.main(["analyse", "p", "--format", "markdown", "--no-tests", "--export", "csv"]) == 0
    assert "**Total Findings:** 3" in capsys.readouterr().out and (tmp_path / "reports" / "csv").is_dir()
    assert cli.main(["analyse", "p", "--format", "json", "--language", "python", "--output", "out.json"]) == 0
    assert json.loads((tmp_path / "out.json").read_text())["total_findings"] == 1
    assert cli.main(["dependencies", "p", "--advisories", "adv.jsonl"]) == 1 and "A1" in capsys.readouterr().out
    assert cli.main(["init-config"]) == 0 and cli.main(["init-config"]) == 1 and cli.main(["config-info"]) == 0 and cli.main(["version"]) == 0


def test_objects_in_text():
    assert patterns.objects_in('a {"x": 1}{bad}{"y": {"z": "}"}} {"p"')[0] == ['{"x": 1}']  # braces inside texts count, as they come
    assert patterns.objects_in('{"x": {}} rest {') == (['{"x": {}}'], " rest {")
    assert patterns.objects_in("{{\"a\": 1}}")[0] == ['{"a": 1}']


def test_response_stream(spark, tmp_path):
    pieces = [("s", 0, '{"a": 1} {"b"'), ("s", 1, ': {"c": 2}} {'), ("t", 0, "no")]
    spark.createDataFrame(pieces, "stream string, seq long, piece string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("stream string, seq long, piece string").parquet(str(tmp_path / "in"))
    q = responses.json_objects(stream).writeStream.format("memory").queryName("objects").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("objects").collect())) == [("s", '{"a": 1}'), ("s", '{"b": {"c": 2}}')]


def test_model_patterns(spark):
    files = spark.createDataFrame([(f"/f{k}.py", "x = 1\n" * 60) for k in range(4)] + [("/z.txt", "y" * 300)], "path string, content string")

    def model(prompt):
        if "/z.txt" in prompt:
            raise RuntimeError("busy")
        names = [line[3:] for line in prompt.split("\n") if line.startswith("// /")]
        one = dict(pattern_type="singleton", confidence=0.5, line_start=1, line_end=2, description="d", evidence=[], severity="info", impact="low", effort="low")
        return json.dumps({"design_patterns": [{**one, "file_path": n} for n in names]})

    got = pipeline.model_patterns(files, model, max_tokens=250, attempts=2)
    assert sorted(r.file_path for r in got.collect()) == ["/f0.py", "/f1.py", "/f2.py", "/f3.py"]
    assert sorted(r.file_path for r in pipeline.model_patterns(files, model, max_tokens=250, exclude=["*f[01]*"]).collect()) == ["/f2.py", "/f3.py"]


def test_stored_forms(spark, tmp_path):
    b = spark.createDataFrame([(0, 1, "/a", "x" * 30), (1, 1, "/b", "y" * 30)], "seq long, batch_id long, path string, text string").withColumn("tokens", batching.token_count(F.col("text")))
    batching.save_batches(b, str(tmp_path / "b"))
    back = batching.load_batches(spark, str(tmp_path / "b"))
    assert {(r.path, r.text, r.id) for r in back.collect()} == {("/a", "x" * 30, "batch_002"), ("/b", "y" * 30, "batch_002")}
    assert readers.load(spark, str(tmp_path / "none"), "a long").count() == 0
    (tmp_path / "h.json").write_text(json.dumps({"usage_history": [dict(timestamp="2024-01-01T10:00:00", model="m", input_tokens=1, output_tokens=2, cost=0.5, request_type="r", duration=1.0, success=True)]}))
    h = usage.load_history(spark, str(tmp_path / "h.json"))
    assert h.first().input_tokens == 1
    usage.export_history(h, str(tmp_path / "u"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "u")).first().timestamp == "2024-01-01T10:00:00"
    history = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    left, gone = cachetable.history_delete(history)
    assert left.count() == 0 and gone.first().deleted == 2
    f = readers.findings_from(spark.createDataFrame([("{",), ("{}",)], "json string")).collect()
    assert [r.error for r in f] == ["no JSON", None] and f[1].severity == "info"


def test_closure(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    e = spark.createDataFrame([(k, k + 1) for k in range(20)], "source long, target long")
    assert deps.closure(e).count() == 210
    with pytest.raises(RuntimeError):
        deps.closure(e, rounds=2)


def test_profile(spark):
    profiling.SAMPLES.clear()

    @profiling.profiled
    def work(fail):
        if fail:
            raise ValueError
        return spark.range(10).count()

    assert work(False) == 10
    with pytest.raises(ValueError):
        work(True)
    s = profiling.samples(spark)
    assert [(r.name, r.failed) for r in s.collect()] == [("work", False), ("work", True)] and stats.profile(s, "name", "seconds").first().n == 2
    spark.sparkContext.setJobGroup("g", "g")
    spark.range(100).count()
    assert set(profiling.progress(spark, "g")) == {"done", "total", "progress"}
