"""Single documents of any size: written in parts by tasks, put together by a copy of bytes.

A document is a table of fragments, one a row, with the columns that order them. Tasks write ranges of that order as text
files; Spark's committer lets each range in once, whatever attempts fail. Then the files are copied, in order, into one
beside the target, which it replaces at the end. The driver holds a copy buffer.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .reports import sarif_results, sarif_rules

#: Sections of a run of a SARIF document, in order.
HEAD, RULES, MIDDLE, RESULTS, END = range(5)


def _path(spark, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def write_document(fragments: DataFrame, order: list[str], path: str) -> None:
    """Writes the column text of fragments, a line for each, by order (nulls first), as the file path.

    order should name every row once: rows that tie may come in any order. Fragments must hold no line breaks. If the
    write fails, what was there before stays, and the parts are removed; an empty table gives an empty file."""
    spark = fragments.sparkSession
    target, fs = _path(spark, path)
    parts, beside = (_path(spark, f"{path}.{uuid.uuid4().hex}.{kind}")[0] for kind in ("parts", "whole"))
    try:
        fragments.repartitionByRange(*order).sortWithinPartitions(*order).select("text").write.text(parts.toString())
        names = sorted(s.getPath().toString() for s in fs.listStatus(parts) if s.getPath().getName().startswith("part-"))
        out = fs.create(beside, True)
        try:
            for name in names:
                source = fs.open(_path(spark, name)[0])
                try:
                    spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 16, False)
                finally:
                    source.close()
        finally:
            out.close()
        fs.delete(target, True)
        if not fs.rename(beside, target):
            raise OSError(f"{path} could not be replaced")
    finally:
        fs.delete(parts, True)
        fs.delete(beside, True)


def sarif_fragments(findings: DataFrame) -> DataFrame:
    """edge, source, tool_name, section, seq, text: a SARIF document in pieces, ordered by these columns.

    A run for each source and tool; commas stand before all rules, results and runs but the first."""
    rules = sarif_rules(findings).select("source", "tool_name", F.lit(RULES).alias("section"), F.col("first").alias("seq"), F.col("rule").alias("text"))
    results = sarif_results(findings).select("source", "tool_name", F.lit(RESULTS).alias("section"), F.col("ingest_seq").alias("seq"), F.col("result").alias("text"))
    items = rules.union(results)
    keys = ["source", "tool_name", "section"]
    firsts = items.groupBy(*(F.col(k).alias(f"of_{k}") for k in keys)).agg(F.min("seq").alias("first"))  # two rows for each tool
    same = [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys]
    listed = items.join(firsts, same).select(*keys, "seq", F.concat(F.when(F.col("seq") == F.col("first"), "").otherwise(","), "text").alias("text"))
    runs = results.groupBy("source", "tool_name").agg(F.lit(0).cast("long").alias("seq"))
    lead = runs.agg(F.min(F.struct("source", "tool_name")).alias("r")).first()["r"]
    is_lead = F.lit(False) if lead is None else F.struct("source", "tool_name").eqNullSafe(F.struct(F.lit(lead["source"]).alias("source"), F.lit(lead["tool_name"]).alias("tool_name")))
    name = F.substring(F.to_json(F.array("tool_name")), 2, 1 << 20)
    tool = F.concat(F.when(is_lead, "").otherwise(","), F.lit('{"tool":{"driver":{"name":'), F.regexp_replace(name, "]$", ""), F.lit(',"version":"1.0.0","rules":['))
    frame = [runs.select("source", "tool_name", F.lit(k).alias("section"), "seq", t.alias("text")) for k, t in ((HEAD, tool), (MIDDLE, F.lit(']}},"results":[')), (END, F.lit("]}")))]
    inner = listed.union(frame[0]).union(frame[1]).union(frame[2]).select(F.lit(1).alias("edge"), "*")
    head = json.dumps({"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json"}, separators=(",", ":"))[:-1] + ',"runs":['
    edges = findings.sparkSession.createDataFrame([(0, None, None, 0, 0, head), (2, None, None, 0, 0, "]}")], "edge int, source string, tool_name string, section int, seq long, text string")
    return inner.union(edges)


def write_sarif(findings: DataFrame, path: str) -> None:
    """A SARIF document of any number of findings; see write_document."""
    write_document(sarif_fragments(findings), ["edge", "source", "tool_name", "section", "seq"], path)
