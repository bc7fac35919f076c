"""Whole documents written in parts."""

import json
import os

import pytest
from pyspark.sql import functions as F

from codeseam.sinks import documents, reports


def findings(spark, n):
    r = F.col("id")
    return spark.range(n).repartition(5).select(
        r.alias("ingest_seq"), F.concat(F.lit("/src/é"), r % 7).alias("file_path"), (r % 50).cast("int").alias("line_start"), F.lit("code_smell").alias("finding_type"), F.lit("high").alias("severity"),
        F.concat(F.lit('title "'), r % 9, F.lit('"\n')).alias("title"), F.lit("m \\").alias("message"), F.when(r % 4 > 0, F.concat(F.lit("rule"), r % 11)).alias("rule_id"), F.lit("static_analysis").alias("source"),
        F.element_at(F.array(F.lit("pylint"), F.lit('es"lint'), F.lit("flake8")), (r % 3 + 1).cast("int")).alias("tool_name"), F.lit(0.5).alias("confidence"),
    )


@pytest.mark.parametrize("n", [0, 1, 3000])
def test_sarif(spark, tmp_path, n):
    f = findings(spark, n)
    path = f"file://{tmp_path}/out.sarif"
    for _ in range(2):  # the second replaces the first
        documents.write_sarif(f, path)
    told = json.loads((tmp_path / "out.sarif").read_text())
    assert told == json.loads("".join(reports.sarif(f)))
    assert sum(len(run["results"]) for run in told["runs"]) == n
    assert [x for x in os.listdir(tmp_path) if not x.startswith(".")] == ["out.sarif"]


def test_failure_leaves_the_old(spark, tmp_path):
    path = f"file://{tmp_path}/doc"
    good = spark.range(500).select("id", F.concat(F.lit("line "), "id").alias("text")).repartition(4)
    documents.write_document(good, ["id"], path)
    assert (tmp_path / "doc").read_text() == "".join(f"line {i}\n" for i in range(500))
    bad = good.withColumn("text", F.when(F.col("id") == 77, F.raise_error("no")).otherwise("new"))
    with pytest.raises(Exception):
        documents.write_document(bad, ["id"], path)
    assert (tmp_path / "doc").read_text().startswith("line 0\n")
    assert [x for x in os.listdir(tmp_path) if not x.startswith(".")] == ["doc"]
