"""The event register, source counters and windows as Structured Streaming queries."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.events import REGISTER, merge_report, registered
from ..operators.storage import merge_partitions, one_each, upsert

REPORT = "event_id string, seq long, source string, confidence double, metadata map<string,string>, action string"


def register_stream(reports: DataFrame) -> DataFrame:
    """Stateful twin of the batch register: every batch emits the new revision of each
    fact that changed. State is one JSON text per fact, bounded by its sources."""

    def step(key: tuple, parts, state: GroupState):
        current = json.loads(state.get[0]) if state.exists else None
        rows = pd.concat(list(parts)).sort_values("seq")
        before = current
        for r in rows.to_dict("records"):
            meta = r["metadata"]
            current = merge_report(current, r | {"metadata": dict(meta) if meta is not None else {}})
        if current != before:
            state.update((json.dumps(current),))
            yield pd.DataFrame([registered(key[0], current)])

    return reports.groupBy("event_id").applyInPandasWithState(step, REGISTER, "state string", "update", GroupStateTimeout.NoTimeout)


def source_counters(runs: DataFrame) -> DataFrame:
    """Running counters per source, and the failures in a row at its end."""

    def step(key: tuple, parts, state: GroupState):
        total, ok, streak = state.get if state.exists else (0, 0, 0)
        for r in pd.concat(list(parts)).sort_values("run_id").itertuples():
            total, ok, streak = total + 1, ok + int(r.succeeded), 0 if r.succeeded else streak + 1
        state.update((int(total), int(ok), int(streak)))
        yield pd.DataFrame({"source_id": [key[0]], "runs_total": [total], "runs_succeeded": [ok], "consecutive_failures": [streak]})

    return runs.groupBy("source_id").applyInPandasWithState(step, "source_id string, runs_total long, runs_succeeded long, consecutive_failures long", "total long, ok long, streak long", "update", GroupStateTimeout.NoTimeout)


def timed(rows: DataFrame, column: str, late: str = "10 minutes") -> DataFrame:
    """A zone-less time as an instant (UTC session) with a watermark, which needs one."""
    return rows.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, late)


def windowed(rows: DataFrame, column: str, keys: list[str], aggregates: dict[str, Column], width: str, slide: str | None = None) -> DataFrame:
    """Tumbling or sliding windows; an extension of the domain for event tables."""
    w = F.window(column, width, slide) if slide else F.window(column, width)
    return rows.groupBy(w.alias("w"), *keys).agg(*[c.alias(n) for n, c in aggregates.items()]).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, *aggregates)


def sessions(rows: DataFrame, column: str, key: str, gap: str, aggregates: dict[str, Column]) -> DataFrame:
    w = F.session_window(column, gap)
    return rows.groupBy(w.alias("w"), key).agg(*[c.alias(n) for n, c in aggregates.items()]).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, *aggregates)


def once_each(rows: DataFrame, key: list[str], column: str, late: str) -> DataFrame:
    """Repeats of a key within the lateness bound go; a later repeat is an upsert again."""
    return timed(rows, column, late).dropDuplicatesWithinWatermark(key)


def upsert_batches(stream: DataFrame, path: str, key: list[str], checkpoint: str, by: list[str] | None = None, order: list[str] | None = None):
    """Idempotent ingest: each micro-batch merges by key, so a repeated batch is harmless. Of several
    rows of a key in one batch the largest by `order` wins.

    With `by` the table is one folder laid out by those columns (of the key), and a batch rewrites only the partitions
    it touches. Without, each batch makes a new version, a folder; readers take the newest complete one."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if by:
            merge_partitions(spark, path, batch, key, by, order)
            return
        latest = one_each(batch, key, order)
        if number:
            latest = upsert(spark.read.parquet(f"{path}/v={number - 1}"), latest, key)
        latest.write.mode("overwrite").parquet(f"{path}/v={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
