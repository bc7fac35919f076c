"""Readers of stored findings and other JSON, tolerant of what isn't as it should be."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import FINDING_DEFAULTS, SEVERITIES, TYPES

#: Sources that a stored finding may name, beside those of this engine's views.
SOURCES = ["static_analyzer", "linter", "ai_analysis", "dependency_analysis", "pattern_recognition", "security_scanner", "custom", "static_analysis", "dependency_check", "security_scan", "performance_analysis"]
_PLACE = "struct<file_path:string,line_start:int,line_end:int,column_start:int,column_end:int,function_name:string,class_name:string>"
SCHEMA = (
    "id string, title string, description string, finding_type string, severity string, confidence double, source string, tool_name string, rule_id string, "
    f"location {_PLACE}, affected_code string, message string, suggestion string, fix_recommendation string, metadata map<string,string>, tags array<string>, "
    "detected_at string, impact string, effort_to_fix string, related_findings array<string>, duplicate_of string"
)


def findings_from(raw: DataFrame) -> DataFrame:
    """Findings of texts (column json, one finding each): fields that are missing get their defaults; one that names an
    unknown type, severity or source, or is no JSON, has that as its error, and the field null."""
    j = raw.select(F.from_json("json", SCHEMA + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("j")).select("j.*")
    known = {"finding_type": TYPES, "severity": SEVERITIES, "source": SOURCES}
    given = {c: F.coalesce(F.col(c), F.lit(d)) for c, d in FINDING_DEFAULTS.items()}
    wrong = [F.when(~given[c].isin(values), F.concat(F.lit(f"unknown {'type' if c == 'finding_type' else c} "), given[c])) for c, values in known.items()]
    error = F.nullif(F.concat_ws("; ", F.when(F.col("_corrupt").isNotNull(), "no JSON"), *wrong), F.lit(""))
    checked = {c: F.when(given[c].isin(values), given[c]) for c, values in known.items()}
    place = [F.col(f"location.{x.split(':')[0]}").alias(x.split(":")[0]) for x in _PLACE[7:-1].split(",")]
    return j.select(
        "id", *({**given, **checked}[c].alias(c) for c in FINDING_DEFAULTS), "rule_id", *place, "affected_code", "metadata", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        F.try_to_timestamp("detected_at").cast("timestamp_ntz").alias("detected_at"), F.coalesce("related_findings", F.array().cast("array<string>")).alias("related_findings"), "duplicate_of", error.alias("error"),
    )


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    """Findings of JSON lines, or of files that hold one document each."""
    return findings_from(spark.read.text(path).withColumnRenamed("value", "json"))


def tolerant(raw: DataFrame, schema: str) -> DataFrame:
    """The columns of a schema of JSON texts (column json); texts that are none have nulls."""
    return raw.select(F.from_json("json", schema).alias("j")).select("j.*")


def load(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents of a file or folder; one that isn't there has no rows."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p):
        return spark.createDataFrame([], schema)
    return tolerant(spark.read.text(path, wholetext=True).withColumnRenamed("value", "json"), schema)
