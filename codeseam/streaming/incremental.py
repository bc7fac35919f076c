"""Analysis of changed files only: a log of changes feeds a stream, whose batches replace the rows of their files.

Three tables below one root folder:

* ``log``: (path, state, file_hash, modified, seq), one row for each file that a scan found added, changed or removed. What is known of
  a file is its last row there, so a scan that dies halfway is mended by the next one.
* ``rows/batch=N``: the rows of the files of stream batch N.
* ``touched/batch=N``: (path, state) of these files. A file's valid rows are those of the newest batch that touched it.

A batch overwrites the folders of its own number, and ``touched`` is written last, so a batch that is run again after a
failure, or after a restart from the checkpoint, leaves each row once. Every ``whole_every``-th batch writes all valid
rows anew and so makes the folders before it needless; the next batch, which begins only when that one is committed,
deletes them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cachetable import changed, file_hash
from ..operators.findings import from_static
from ..plans import analyzers
from ..sources import files as scans

CHANGES = "path string, state string, file_hash string, modified timestamp, seq long"
_TOUCHED = "path string, state string"


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def _batches(spark: SparkSession, table: str) -> list[int]:
    """The numbers of the batches whose folders were written whole."""
    fs, p = _folder(spark, table)
    if not fs.exists(p):
        return []
    names = [s.getPath() for s in fs.listStatus(p)]
    done = (n for n in names if n.getName().startswith("batch=") and fs.exists(_folder(spark, f"{n}/_SUCCESS")[1]))
    return sorted(int(n.getName().split("=")[1]) for n in done)


def _table(spark: SparkSession, table: str, schema: str, batches: list[int]) -> DataFrame:
    if not batches:
        return spark.createDataFrame([], f"{schema}, batch int")
    return spark.read.schema(schema).option("basePath", table).parquet(*(f"{table}/batch={n}" for n in batches)).withColumn("batch", F.col("batch").cast("int"))


def known(spark: SparkSession, root: str) -> DataFrame:
    """path, file_hash of all files that the log holds and that aren't removed, and seq of the log's last scan."""
    fs, p = _folder(spark, f"{root}/log")
    log = spark.read.schema(CHANGES).parquet(f"{root}/log") if fs.exists(p) else spark.createDataFrame([], CHANGES)
    last = log.groupBy("path").agg(F.max_by(F.struct("state", "file_hash", "seq"), "seq").alias("x")).select("path", "x.*")
    return last.where("state <> 'removed'")


def record(spark: SparkSession, root: str, current: DataFrame) -> None:
    """Appends to the log what differs between it and the current files (path, file_hash, modified): one full join of
    names and hashes, no file is opened."""
    fs, p = _folder(spark, f"{root}/log")
    seq = (spark.read.schema(CHANGES).parquet(f"{root}/log").agg(F.max("seq")).first()[0] or 0) + 1 if fs.exists(p) else 1
    new = changed(known(spark, root), current).join(current.select("path", "file_hash", "modified"), "path", "left")
    new.select("path", "state", "file_hash", "modified", F.lit(seq).cast("long").alias("seq")).write.mode("append").parquet(f"{root}/log")


def record_folder(spark: SparkSession, root: str, folder: str, **options) -> None:
    """As ``record``, for the files below a folder that a scan with the same options would read."""
    files = scans.scan(spark, folder, **options)
    record(spark, root, files.select("path", file_hash(F.col("modified"), F.col("size")).alias("file_hash"), "modified"))


def folder_reader(spark: SparkSession, folder: str, **options) -> Callable[[DataFrame], DataFrame]:
    """Reads the files of a batch of changes. Two times, the first and last of the batch, go to the source, which opens
    no file outside them; the rest is a join by path."""

    def read(changes: DataFrame) -> DataFrame:
        first, last = changes.agg(F.min("modified"), F.max("modified")).first()
        files = scans.scan(spark, folder, **options).where(F.col("modified").between(F.lit(first), F.lit(last)))
        return files.join(changes.select("path"), "path", "left_semi")

    return read


def static_findings(files: DataFrame) -> DataFrame:
    return from_static(analyzers.analyse(files)).withColumnRenamed("file_path", "path")


def update(
    spark: SparkSession, root: str, read: Callable[[DataFrame], DataFrame], analyse: Callable[[DataFrame], DataFrame] = static_findings,
    files_per_batch: int | None = None, whole_every: int = 20,
) -> None:
    """Analyses what the log gained since the last call, then ends. read: changes -> files; analyse: files -> rows with
    a path. files_per_batch bounds the log's part files (not the analysed ones) of a batch."""

    def step(batch: DataFrame, number: int) -> None:
        now = batch.groupBy("path").agg(F.max_by(F.struct("state", "file_hash", "modified"), "seq").alias("x")).select("path", "x.*").persist()
        try:
            rows, touched = analyse(read(now.where("state <> 'removed'"))), now.select("path", "state")
            before = [n for n in _batches(spark, f"{root}/touched") if n < number]
            whole = [n for n in before if n % whole_every == 0]
            for n in before if whole else []:
                if n < whole[-1]:
                    for t in ("touched", "rows"):
                        fs, p = _folder(spark, f"{root}/{t}/batch={n}")
                        fs.delete(p, True)
            if number % whole_every == 0 and before:
                schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
                kept = _valid(spark, root, schema, before).join(now.select("path"), "path", "left_anti")
                rows = rows.unionByName(kept)
                old = _newest(spark, root, before).where("state <> 'removed'").select("path", "state")
                touched = touched.where("state <> 'removed'").union(old.join(now.select("path"), "path", "left_anti"))
            rows.write.mode("overwrite").parquet(f"{root}/rows/batch={number}")
            touched.write.mode("overwrite").parquet(f"{root}/touched/batch={number}")
        finally:
            now.unpersist()

    source = spark.readStream.schema(CHANGES)
    if files_per_batch:
        source = source.option("maxFilesPerTrigger", files_per_batch)
    stream = source.parquet(f"{root}/log").writeStream.foreachBatch(step).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    stream.awaitTermination()


def _newest(spark: SparkSession, root: str, batches: list[int]) -> DataFrame:
    """path, state, batch: of each file the newest batch that touched it."""
    touched = _table(spark, f"{root}/touched", _TOUCHED, batches)
    return touched.groupBy("path").agg(F.max_by("state", "batch").alias("state"), F.max("batch").alias("batch"))


def _valid(spark: SparkSession, root: str, schema: str, batches: list[int]) -> DataFrame:
    rows = _table(spark, f"{root}/rows", schema, batches)
    return rows.join(_newest(spark, root, batches).select("path", "batch"), ["path", "batch"], "left_semi").drop("batch")


def current(spark: SparkSession, root: str, schema: str | None = None) -> DataFrame:
    """The valid rows of all files. schema: that of the rows, needed only where no batch has been written yet."""
    batches = _batches(spark, f"{root}/touched")
    if schema is None:
        if not batches:
            raise ValueError("no batch has been written: name a schema")
        found = spark.read.parquet(f"{root}/rows/batch={batches[-1]}").schema
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found)
    return _valid(spark, root, schema, batches)
