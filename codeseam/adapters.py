"""Driver tables as canonical views: the same definitions for Spark and, as SQL text, for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import SEVERITIES, SOURCES, literal_map

EVENT_TYPES = {"error": "security_vulnerability", "purchase": "anti_pattern", "signup": "outdated_dependency", "click": "code_smell", "view": "style_violation"}
MODELS = {"error": "large", "purchase": "medium", "signup": "small", "click": "medium", "view": "unlisted"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Narrow rows from which long texts are made, dealt by their keys to several tasks a core: a small table may be one
    piece of one file, and all work on its texts would be one task."""
    tasks = max(4 * rows.sparkSession.sparkContext.defaultParallelism, rows.rdd.getNumPartitions())
    return rows.repartition(tasks, *keys)


def _k():
    return F.get_json_object("props", "$.k").cast("int")


def findings_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    e = table(spark, sf_dir, "events").withColumn("k", _k())
    return e.select(
        F.col("event_id").alias("ingest_seq"),
        F.concat(F.lit("/src/user_"), F.col("user_id").cast("string"), F.lit(".py")).alias("file_path"),
        F.when(F.col("event_id") % 97 != 0, ((F.col("event_id") * 7) % 200).cast("int")).alias("line_start"),
        F.element_at(F.array(*map(F.lit, SEVERITIES)), (k % 5 + 1)).alias("severity"),
        literal_map(EVENT_TYPES)[F.col("event_type")].alias("finding_type"),
        F.element_at(F.array(*map(F.lit, SOURCES)), (k % 7 + 1)).alias("source"),
        F.when(k % 10 != 0, F.col("event_type")).alias("rule_id"),
        F.concat("event_type", F.lit(" issue")).alias("title"),
        F.concat("event_type", F.lit(" k="), k.cast("string")).alias("message"),
        F.least(F.lit(1.0), F.col("value") / 500).alias("confidence"),
        F.col("ts").alias("detected_at"),
        F.concat(F.lit("tool_"), (k % 3).cast("string")).alias("tool_name"),
    )


def full_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """findings_v with the model's other columns."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("ingest_seq"), "event_type", _k().alias("k"))
    k = F.col("k")
    more = e.select(
        "ingest_seq",
        F.when(k % 4 != 0, F.concat(F.lit("about "), "event_type", F.lit(" "), (k % 3).cast("string"))).otherwise("").alias("description"),
        (k % 3).alias("extent"), F.when(k % 6 != 0, k % 40).alias("column_start"), F.when(k % 6 != 0, k % 40 + k % 2).alias("column_end"),
        F.when(k % 5 != 0, F.concat(F.lit("f"), (k % 7).cast("string"))).alias("function_name"), F.when(k % 3 == 0, F.concat(F.lit("C"), (k % 2).cast("string"))).alias("class_name"),
        F.when(k % 3 != 0, F.concat(F.lit("do "), (k % 4).cast("string"))).otherwise("").alias("suggestion"), F.when(k % 7 == 0, "fix").otherwise("").alias("fix_recommendation"),
        F.when(k % 9 == 0, "x = 1").alias("affected_code"), F.element_at(F.array(*map(F.lit, ["low", "medium", "high", "critical"])), k % 4 + 1).alias("impact"),
        F.element_at(F.array(*map(F.lit, ["low", "medium", "high"])), k % 3 + 1).alias("effort_to_fix"),
        F.array("event_type", F.concat(F.lit("t"), (k % 3).cast("string"))).alias("tags"), F.array(F.concat(F.lit("r"), (k % 4).cast("string"))).alias("related_findings"),
    )
    return findings_v(spark, sf_dir).join(more, "ingest_seq").withColumn("line_end", F.col("line_start") + F.col("extent")).drop("extent")


def usage_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("k", _k())
    return e.select(
        F.col("event_id").alias("request_id"), F.col("ts").alias("timestamp"), literal_map(MODELS)[F.col("event_type")].alias("model"),
        (F.col("k") * 100).cast("long").alias("input_tokens"), F.floor("value").cast("long").alias("output_tokens"),
        (F.col("event_type") != "error").alias("success"), F.concat(F.lit("type_"), (F.col("k") % 4).cast("string")).alias("request_type"),
    )


def packages_v(spark: SparkSession, sf_dir: str, mention: bool = False) -> DataFrame:
    """mention: whether a row's place in its table is told too, as a last column."""
    place = [F.struct("_metadata.file_path", "_metadata.row_index").alias("mention")] if mention else []
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_linestatus", *place)
    pt = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return li.join(pt, li.l_partkey == pt.p_partkey).join(od, li.l_orderkey == od.o_orderkey).select(
        F.col("l_orderkey").alias("manifest"), F.col("l_linenumber").alias("position"), F.col("l_partkey").alias("package"),
        F.when(F.col("p_size") % 10 != 0, F.lower("p_brand")).alias("licence"), (F.col("l_returnflag") == "R").alias("dev"),
        (F.col("l_linestatus") == "O").alias("optional"), F.col("o_orderpriority").alias("package_manager"), F.col("p_size").alias("version"),
        *(["mention"] if mention else []),
    )


def advisories_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").where("p_size >= 40")
    return p.select(F.col("p_partkey").alias("package"), F.element_at(F.array(*map(F.lit, ["low", "medium", "high", "critical"])), (F.col("p_partkey") % 4 + 1).cast("int")).alias("severity"))


def files_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/"), F.col("source"), F.lit("/"), F.col("lang"), F.lit("/doc_"), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), F.col("text").alias("content"), F.col("n_chars").alias("size"), F.floor(F.length("text") / 3).cast("long").alias("tokens"))


def lines_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files_v(spark, sf_dir).select("doc_id", "path", F.posexplode(F.split("content", "\n")).alias("pos", "line")).select("doc_id", "path", (F.col("pos") + 1).alias("line_no"), "line")


_SEV = "CASE k % 5 WHEN 0 THEN 'info' WHEN 1 THEN 'low' WHEN 2 THEN 'medium' WHEN 3 THEN 'high' ELSE 'critical' END"
_TYPE = "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in EVENT_TYPES.items()) + " END"
_MODEL = "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in MODELS.items()) + " END"
_SRC = "CASE k % 7 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(SOURCES)) + " END"
ORD = "CASE severity WHEN 'info' THEN 1 WHEN 'low' THEN 2 WHEN 'medium' THEN 3 WHEN 'high' THEN 4 WHEN 'critical' THEN 5 END"

#: WITH clauses for the oracle.
SQL = {
    "findings_v": f"""findings_v AS (SELECT event_id AS ingest_seq, '/src/user_' || user_id || '.py' AS file_path,
        CASE WHEN event_id % 97 = 0 THEN NULL ELSE CAST((event_id * 7) % 200 AS INT) END AS line_start, {_SEV} AS severity, {_TYPE} AS finding_type, {_SRC} AS source,
        CASE WHEN k % 10 = 0 THEN NULL ELSE event_type END AS rule_id, event_type || ' issue' AS title, event_type || ' k=' || k AS message,
        least(1.0::DOUBLE, value / 500) AS confidence, ts AS detected_at, 'tool_' || (k % 3) AS tool_name
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events))""",
    "full_v": "",
    "usage_v": f"""usage_v AS (SELECT event_id AS request_id, ts AS timestamp, {_MODEL} AS model, CAST(k * 100 AS BIGINT) AS input_tokens, CAST(floor(value) AS BIGINT) AS output_tokens,
        event_type <> 'error' AS success, 'type_' || (k % 4) AS request_type FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events))""",
    "packages_v": """packages_v AS (SELECT l_orderkey AS manifest, l_linenumber AS position, l_partkey AS package, CASE WHEN p_size % 10 <> 0 THEN lower(p_brand) END AS licence,
        l_returnflag = 'R' AS dev, l_linestatus = 'O' AS optional, o_orderpriority AS package_manager, p_size AS version
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)""",
    "advisories_v": """advisories_v AS (SELECT p_partkey AS package, ['low','medium','high','critical'][CAST(p_partkey % 4 + 1 AS INT)] AS severity FROM part WHERE p_size >= 40)""",
    "files_v": """files_v AS (SELECT doc_id, '/' || source || '/' || lang || '/doc_' || doc_id AS path, text AS content, n_chars AS size, CAST(length(text) // 3 AS BIGINT) AS tokens FROM documents)""",
    "lines_v": """files_v AS (SELECT doc_id, '/' || source || '/' || lang || '/doc_' || doc_id AS path, text AS content, n_chars AS size, CAST(length(text) // 3 AS BIGINT) AS tokens FROM documents),
        lines_v AS (SELECT doc_id, path, CAST(i AS INT) AS line_no, parts[i] AS line FROM (SELECT doc_id, path, string_split(content, chr(10)) AS parts, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS i FROM files_v))""",
}

SQL["full_v"] = SQL["findings_v"] + """, full_v AS (SELECT f.*, CASE WHEN k % 4 = 0 THEN '' ELSE 'about ' || event_type || ' ' || (k % 3) END AS description, CAST(line_start + k % 3 AS INT) AS line_end,
        CASE WHEN k % 6 <> 0 THEN k % 40 END AS column_start, CASE WHEN k % 6 <> 0 THEN k % 40 + k % 2 END AS column_end, CASE WHEN k % 5 <> 0 THEN 'f' || (k % 7) END AS function_name,
        CASE WHEN k % 3 = 0 THEN 'C' || (k % 2) END AS class_name, CASE WHEN k % 3 = 0 THEN '' ELSE 'do ' || (k % 4) END AS suggestion, CASE WHEN k % 7 = 0 THEN 'fix' ELSE '' END AS fix_recommendation,
        CASE WHEN k % 9 = 0 THEN 'x = 1' END AS affected_code, ['low','medium','high','critical'][k % 4 + 1] AS impact, ['low','medium','high'][k % 3 + 1] AS effort_to_fix,
        [event_type, 't' || (k % 3)] AS tags, ['r' || (k % 4)] AS related_findings
        FROM findings_v f JOIN (SELECT event_id AS ingest_seq, event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events) USING (ingest_seq))"""
