"""Shared plumbing: written tables in the cluster's shared folder, worker path."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every text contract: space and U+0009 to U+000D.
BLANK = r"[\x20\x09-\x0D]"


def ready(spark: SparkSession, batch_rows: int = 1000) -> None:
    """Make the package importable by Python workers and keep Arrow batches small.

    A batch of `batch_rows` texts bounds what a worker holds at once.
    """
    root = str(Path(__file__).resolve().parents[2])
    spark.sparkContext.environment["PYTHONPATH"] = root
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch_rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, by spark.checkpoint.dir.

    Where none is named, a local master gets a temporary one; on a cluster that
    would lose data, so it is an error there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tidemark-", dir=os.environ.get("TMPDIR"))
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def staged(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write `df` to the shared folder and read it back: the lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.staged_path = path
    return back


def release(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for t in tables:
        spark, path = t.sparkSession, t.staged_path
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text column as a string, null as empty."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def text_key(text: Column) -> Column:
    """What tells one text from another in a join: 16 bytes."""
    return F.unhex(F.md5(text))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
