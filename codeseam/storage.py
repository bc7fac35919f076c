"""Tables between the steps of an iteration, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset a fresh local folder on a local master, on a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not hasattr(spark, "_codeseam_dir"):
        spark._codeseam_dir = "file://" + tempfile.mkdtemp(prefix="codeseam-")
    return spark._codeseam_dir


def fresh_folder(spark: SparkSession) -> str:
    """A new name in the shared folder."""
    return f"{shared_dir(spark)}/codeseam-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: lineage ends there, and a lost executor takes nothing with it."""
    spark = df.sparkSession
    path = fresh_folder(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._codeseam_path = path
    return out


def dropped(*tables: DataFrame | None) -> None:
    """Deletes written tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_codeseam_path", None)
        if path:
            p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
