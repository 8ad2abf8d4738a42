"""Archives, exports and published datasets."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def archive(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files as raw documents: identity by content hash, size, time, content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    digest = F.sha2("content", 256)
    return files.select(F.concat(F.lit("rawdoc_"), F.substring(digest, 1, 20)).alias("document_id"), digest.alias("content_hash"), F.concat_ws("/", F.substring(digest, 1, 2), digest).alias("archive_key"), F.col("path").alias("url"), F.col("modificationTime").alias("fetched_at"), F.col("length").alias("size"), "content")


def replay(documents: DataFrame, parse: Callable[[DataFrame], DataFrame], encoding: str = "UTF-8") -> DataFrame:
    """Stored documents parsed again, without fetching. Repeats of one content count once."""
    once = documents.dropDuplicates(["content_hash"])
    return parse(once.withColumn("body", F.decode("content", encoding)).drop("content"))


def export(tables: dict[str, DataFrame], path: str) -> dict[str, int]:
    """Each table as JSON lines under its name; returns the row counts, observed while writing."""
    from pyspark.sql import Observation

    counts = {}
    for name, df in tables.items():
        seen = Observation(name)
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(f"{path}/{name}")
        counts[name] = seen.get["n"]
    return counts


def publish(tables: dict[str, DataFrame], path: str, checks: dict[str, Callable[[DataFrame], DataFrame]]) -> str:
    """Write a new version beside the old ones, check what was written, and name it current last.

    checks: table -> violations; any row stops the publication and leaves the current version alone.
    """
    version = uuid.uuid4().hex
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.parquet(f"{path}/{version}/{name}")
    for name, check in checks.items():
        bad = check(spark.read.parquet(f"{path}/{version}/{name}"))
        if not bad.isEmpty():
            raise ValueError(f"{name} breaks its checks: {bad.first()}")
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").json(f"{path}/current")
    return version


def published(spark: SparkSession, path: str, name: str) -> DataFrame:
    version = spark.read.schema("version string").json(f"{path}/current").first()["version"]
    return spark.read.parquet(f"{path}/{version}/{name}")


def expose(spark: SparkSession, queries: dict[str, Callable], sf_dir: str, names: list[str] | None = None) -> list[str]:
    """Queries as temp views of their names, to be read with SQL; plans stay lazy."""
    chosen = names or sorted(queries)
    for name in chosen:
        queries[name](spark, sf_dir).createOrReplaceTempView(name)
    return chosen
