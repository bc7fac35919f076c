"""The corpus pipeline: quality, exact copies, near copies, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as the
next stage's docs. All but the last return the columns of documents, whatever others there are beside doc_id and
text. Rows with null texts are scored, compared and packed as empty texts; texts may be of any length; of ties and
repeated rows one stays after exact_dedup; empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeseam.llm import decontaminate, packing, quality
from codeseam.llm.common import drop_stored, some, stored, table
from codeseam.llm.exact_dedup import exact_duplicates, normalised
from codeseam.llm.near_dedup import near_duplicates
from codeseam.llm.queries import tokenizer_path


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated quality is at least 0.5; empty and null texts are scored like others."""
    return quality.keep_good(docs, quality.not_held_out(table(spark, sf_dir, "labels")))


def first_copies(docs: DataFrame, decided: DataFrame, group: str, text_hash: Column) -> DataFrame:
    """The rows of docs that decided keeps. decided: doc_id, text_hash, kept and what tells groups apart (null: no group),
    one row for each row of docs.

    Rows go by doc_id and the hash of their text, so a dropped text stays dropped where its doc_id also has another
    one. Of repeated rows, and of rows of one doc_id in one group, one stays. Texts are shuffled once at most:
    only the dropped rows' keys meet them. Null ids: each text is kept once."""
    key = decided.groupBy("doc_id", "text_hash").agg(F.max("kept").alias("kept"), F.min(group).alias("of"), F.count("*").alias("copies"))
    key = stored(key.select(F.coalesce("kept", F.lit(True)).alias("kept"), "of", "copies", F.col("doc_id").alias("d"), F.col("text_hash").alias("h")))
    twice = key.where("kept and d is not null and of is not null").groupBy("d", "of").agg(F.min("h").alias("first"), F.count("*").alias("n")).where("n > 1")
    gone = key.where("not kept").select("d", "h")
    if some(twice):
        t = twice.select(F.col("d").alias("td"), F.col("of").alias("tof"), "first")
        gone = gone.union(key.where("kept").join(t, (F.col("d") == F.col("td")) & (F.col("of") == F.col("tof")) & (F.col("h") != F.col("first"))).select("d", "h"))
    rows = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), docs["doc_id"].cast("long").alias("id"), text_hash.alias("hash"))
    rows = rows.join(gone, F.col("id").eqNullSafe(F.col("d")) & (F.col("hash") == F.col("h")), "left_anti")
    if some(key.where("kept and copies > 1")):
        rows = rows.dropDuplicates(["id", "hash"])
    return rows.select(*(F.col("row")[c].alias(c) for c in docs.columns))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the largest doc_id; of repeated rows one. Null text is empty."""
    return first_copies(docs, exact_duplicates(docs), "text_hash", F.xxhash64(normalised(docs["text"])))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (5-word shingles, similarity 0.8): the smallest doc_id; of repeated
    rows one. Null and wordless texts are near nothing and stay."""
    return first_copies(docs, near_duplicates(docs, shingle=5, percent=80), "root", F.xxhash64(docs["text"]))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any 10-word window of the benchmark; row by row, so repeats and null texts stay as they are."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), window=10)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most 4096 tokens; a null text is one end id."""
    return packing.best_fit_packing(docs, tokenizer_path(), capacity=4096, end_id=1)


STAGES = [
    ("quality_classifier", good_quality),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: A classifier, hashing and a tokenizer are beyond SQL: the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir))
        drop_stored(before)
    return STAGES[-1][1](spark, docs, sf_dir)
