"""Days replayed one after another on sealed input, each a stream run of its own."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import date, datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.quality import trading_day

RECORD = "run_date date, status string, rows long, error string, completed_at timestamp"


def days_between(first: date, last: date) -> list[date]:
    if last < first:
        raise ValueError("last must be on or after first")
    return [date.fromordinal(n) for n in range(first.toordinal(), last.toordinal() + 1)]


def open_days(spark: SparkSession, days: Iterable[date]) -> set[date]:
    rows = spark.createDataFrame([(d,) for d in days], "day date")
    return {r["day"] for r in rows.where(trading_day("day")).collect()}  # as many rows as days were asked for


def replay(spark: SparkSession, source: str, day: str, days: Iterable[date], run: Callable[[DataFrame, date], DataFrame], out: str) -> DataFrame:
    """Run every day on what was known at its end; returns the run records of these days.

    source: a folder of Parquet; `day`: its date column. A trading day gets one availableNow run over
    the rows up to that day and no later ones; `run(rows, day)` gives its results, written to out/results/run_date=<day>.
    Its progress is kept under out/progress/<day>: a day that went through is not run again, one that
    failed is taken up where it stopped, and a failure stays with its day. Days without trading are
    recorded as skipped. A record is replaced by that of a later run of its day, unless there was nothing left to do."""
    schema, days = spark.read.parquet(source).schema, sorted(set(days))
    trading = open_days(spark, days)
    for d in days:
        if d not in trading:
            record(spark, out, d, "SKIPPED_NON_TRADING")
            continue
        counts: list[int] = []
        causes: list[Exception] = []

        def settle(batch: DataFrame, number: int, d: date = d, counts: list[int] = counts, causes: list[Exception] = causes) -> None:
            target = f"{out}/results/run_date={d.isoformat()}"
            try:
                run(batch, d).write.mode("overwrite").parquet(target)
            except Exception as e:
                causes.append(e)
                raise
            counts.append(batch.sparkSession.read.parquet(target).count())

        try:
            sealed = spark.readStream.schema(schema).parquet(source).where(F.col(day) <= F.lit(d))
            sealed.writeStream.foreachBatch(settle).option("checkpointLocation", f"{out}/progress/{d.isoformat()}").trigger(availableNow=True).start().awaitTermination()
        except Exception as e:  # stays with its day, in the record
            cause = causes[-1] if causes else e
            record(spark, out, d, "FAILED", error=f"{type(cause).__name__}: {cause}"[:500])
        else:
            if counts:
                record(spark, out, d, "SUCCEEDED", rows=counts[-1])
    wanted = spark.createDataFrame([(d,) for d in days], "run_date date")
    return spark.read.schema(RECORD).parquet(f"{out}/records").join(F.broadcast(wanted), "run_date", "left_semi")  # as many rows as days


def record(spark: SparkSession, out: str, day: date, status: str, rows: int | None = None, error: str | None = None) -> None:
    one = spark.createDataFrame([(status, rows, error, datetime.now(timezone.utc))], "status string, rows long, error string, completed_at timestamp")
    one.coalesce(1).write.mode("overwrite").parquet(f"{out}/records/run_date={day.isoformat()}")


def results(spark: SparkSession, out: str) -> DataFrame:
    """The results of all days, with their run_date."""
    return spark.read.parquet(f"{out}/results").withColumn("run_date", F.col("run_date").cast("date"))
