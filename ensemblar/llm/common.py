"""Helpers shared by the operators: the shared folder, and cutting lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` names it on a cluster. Where that is unset, as in
    tests on one machine, a temporary folder is taken and kept for the session.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if not found and current.isDefined():
        return current.get()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        found = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
    if not current.isDefined():
        sc.setCheckpointDir(found)
    return found


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read from a reliable checkpoint; lineage ends there."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def id_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; null ids count as the text 'null'."""
    text = F.coalesce(doc_id.cast("string"), F.lit("null"))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(n)).cast("int")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hands texts to Python workers in batches of ``rows`` at most, which bounds a worker's memory where texts are long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read for Python operators too."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
