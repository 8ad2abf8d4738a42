import os
import random
from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.operators import outcomes, storage
from tidemark.streaming import events, replay

DAYS = replay.days_between(date(2024, 1, 1), date(2024, 1, 12))


@pytest.fixture
def source(spark, tmp_path):
    rows = [(t, d, float(d.toordinal() % 7 + k)) for d in DAYS for k, t in enumerate("AB") if d.weekday() not in (4, 5)]
    path = f"file://{tmp_path}/in"
    spark.createDataFrame(rows, "ticker string, trade_date date, close double").repartition(4).write.parquet(path)
    return path


def totals(rows, day):
    return rows.groupBy("ticker").agg(F.sum("close").alias("total"), F.max("trade_date").alias("newest"))


def test_replay_equals_batch_and_repeats_change_nothing(spark, source, tmp_path):
    out = f"file://{tmp_path}/out"
    records = replay.replay(spark, source, "trade_date", DAYS, totals, out).collect()
    status = {r["run_date"]: r["status"] for r in records}
    assert len(status) == len(DAYS) and {d for d, s in status.items() if s == "SUCCEEDED"} == replay.open_days(spark, DAYS)
    got = {(r["run_date"], r["ticker"]): (r["total"], r["newest"]) for r in replay.results(spark, out).collect()}
    want = {}
    for d in DAYS:
        if status[d] == "SUCCEEDED":
            for r in totals(spark.read.parquet(source).where(F.col("trade_date") <= F.lit(d)), d).collect():
                want[d, r["ticker"]] = (r["total"], r["newest"])
    assert got == want and all(newest <= d for (d, _), (_, newest) in got.items())
    before = sorted((r["run_date"], r["status"], r["completed_at"]) for r in records if r["status"] == "SUCCEEDED")
    again = replay.replay(spark, source, "trade_date", DAYS, lambda rows, day: rows.limit(0), out).collect()
    assert sorted((r["run_date"], r["status"], r["completed_at"]) for r in again if r["status"] == "SUCCEEDED") == before
    assert {(r["run_date"], r["ticker"]): (r["total"], r["newest"]) for r in replay.results(spark, out).collect()} == want


def test_a_failing_day_stays_alone_and_can_be_repeated(spark, source, tmp_path):
    out, bad = f"file://{tmp_path}/out", date(2024, 1, 3)

    def run(rows, day):
        if day == bad:
            raise ValueError("broken day")
        return totals(rows, day)

    days = [date(2024, 1, 2), bad, date(2024, 1, 4)]
    records = {r["run_date"]: r for r in replay.replay(spark, source, "trade_date", days, run, out).collect()}
    assert records[bad]["status"] == "FAILED" and "broken day" in records[bad]["error"]
    assert records[days[0]]["status"] == records[days[2]]["status"] == "SUCCEEDED"
    assert {r["run_date"] for r in replay.results(spark, out).collect()} == {days[0], days[2]}
    records = {r["run_date"]: r for r in replay.replay(spark, source, "trade_date", days, totals, out).collect()}
    assert records[bad]["status"] == "SUCCEEDED" and records[bad]["error"] is None
    with pytest.raises(ValueError):
        replay.days_between(days[2], days[0])


def files(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")}


def test_merge_rewrites_only_touched_partitions(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "year int, ticker string, day int, close double"
    rows = {(y, t, d): float(y + d) for y in range(2000, 2010) for t in "AB" for d in range(5)}
    as_rows = lambda m: spark.createDataFrame([(*k, v) for k, v in m.items()], schema)
    assert storage.merge_partitions(spark, path, as_rows(rows), ["year", "ticker", "day"], ["year"]) == 10
    before = files(path)
    new = {(2003, "A", 1): -1.0, (2003, "C", 1): 9.0, (2011, "A", 0): 7.0}
    for _ in range(2):  # a repeated batch changes nothing
        assert storage.merge_partitions(spark, path, as_rows(new), ["year", "ticker", "day"], ["year"]) == 2
        got = {(r["year"], r["ticker"], r["day"]): r["close"] for r in spark.read.parquet(path).collect()}
        assert got == rows | new
    after = files(path)
    assert {f for f in before if after.get(f) != before[f]} == {f for f in before if f.startswith("year=2003")}
    with pytest.raises(ValueError):
        storage.merge_partitions(spark, path, as_rows(new), ["ticker", "day"], ["year"])


def test_merge_with_null_and_several_partition_columns(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "a string, b int, k int, v string"
    first = [("x", 1, 1, "p"), (None, 1, 2, "q"), ("x", None, 3, "r")]
    storage.merge_partitions(spark, path, spark.createDataFrame(first, schema), ["a", "b", "k"], ["a", "b"])
    storage.merge_partitions(spark, path, spark.createDataFrame([(None, 1, 2, "new"), (None, 1, 4, "s")], schema), ["a", "b", "k"], ["a", "b"])
    got = {(r["a"], r["b"], r["k"], r["v"]) for r in spark.read.parquet(path).collect()}
    assert got == {("x", 1, 1, "p"), (None, 1, 2, "new"), ("x", None, 3, "r"), (None, 1, 4, "s")}


def test_ties_within_a_batch_are_defined(spark):
    rows = [(k % 5, k % 3, f"v{k}") for k in range(60)]
    seen = set()
    for parts in (1, 3, 7):
        df = spark.createDataFrame(rows, "k int, version int, v string").repartition(parts)
        got = storage.one_each(df, ["k"], ["version"]).collect()
        assert all(r["version"] == 2 for r in got)
        seen.add(tuple(sorted((r["k"], r["v"]) for r in got)))
    assert len(seen) == 1


def test_stream_merges_into_partitions(spark, tmp_path):
    inbox, path = f"{tmp_path}/inbox", f"{tmp_path}/t"
    schema = "year int, k int, v int, at int"
    spark.createDataFrame([(2000, 1, 1, 1), (2000, 1, 2, 2), (2001, 1, 5, 1)], schema).coalesce(1).write.mode("append").parquet(inbox)
    run = lambda: events.upsert_batches(spark.readStream.schema(schema).parquet(inbox), path, ["year", "k"], f"{tmp_path}/c", ["year"], ["at"]).awaitTermination()
    run()
    spark.createDataFrame([(2001, 1, 6, 2), (2001, 2, 7, 1)], schema).coalesce(1).write.mode("append").parquet(inbox)
    run()
    run()
    assert {(r["year"], r["k"], r["v"]) for r in spark.read.parquet(path).collect()} == {(2000, 1, 2), (2001, 1, 6), (2001, 2, 7)}
    assert os.path.isdir(f"{path}/year=2000")


@pytest.mark.parametrize("dependent", [False, True])
def test_ranks_of_all_tests_need_no_single_task(spark, dependent):
    rng = random.Random(9)
    p = [rng.choice([rng.random() ** 3, 0.01, 1.0]) for _ in range(700)]
    df = spark.createDataFrame(list(enumerate(p)), "k int, p double").repartition(6)
    got = {r["k"]: r for r in outcomes.fdr_mask(df, "p", 0.1, dependent=dependent).collect()}
    one = {r["k"]: r for r in outcomes.fdr_mask(df.withColumn("all", F.lit(0)), "p", 0.1, ["all"], dependent).collect()}
    assert {k: (r["accepted"], round(r["q_value"], 12)) for k, r in got.items()} == {k: (r["accepted"], round(r["q_value"], 12)) for k, r in one.items()}
    ranks = outcomes.numbered(df, ["p", "k"], 5).collect()
    assert [r["k"] for r in sorted(ranks, key=lambda r: r["_r"])] == [k for _, k in sorted((x, k) for k, x in enumerate(p))]
    assert sorted(r["_r"] for r in ranks) == list(range(1, 701)) and len({r["_part"] for r in ranks}) > 3
    assert outcomes.fdr_mask(df.where("false"), "p", 0.1).count() == 0
