"""Queries over event streams, in their batch form (the streams share the code)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..operators import features
from ..plans import views
from ..plans.stage import shared_path
from ..plans.views import sql, table
from ..streaming import events as streams
from ..streaming import fund, replay
from .registry import query



@query("st9_tumbling_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def st9(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = streams.windowed(e, "ts", ["event_type"], {"n": F.count("*"), "total": F.round(F.sum("value"), 4)}, "1 hour")
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query("st9_sessions", """
WITH a AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM a)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, sid""")
def st9_sessions(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return streams.sessions(e, "ts", "user_id", "2 hours", {"n": F.count("*")}).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("st6_failure_streaks", sql("runs", """
SELECT source_id, count(*) AS runs_total, count(*) FILTER (succeeded) AS runs_succeeded, count(*) FILTER (run_id > coalesce(last, -1)) AS consecutive_failures
FROM runs LEFT JOIN (SELECT source_id, max(run_id) FILTER (succeeded) AS last FROM runs GROUP BY 1) USING (source_id) GROUP BY source_id"""))
def st6(spark, d):
    from pyspark.sql.window import Window

    r = views.runs(spark, d).withColumn("last", F.max(F.when(F.col("succeeded"), F.col("run_id"))).over(Window.partitionBy("source_id")))
    return r.groupBy("source_id").agg(F.count("*").alias("runs_total"), F.count_if("succeeded").alias("runs_succeeded"), F.count_if(F.col("run_id") > F.coalesce("last", F.lit(-1))).alias("consecutive_failures"))


@query("st7_d12_fund_nav")
def st7(spark, d):
    """Two funds for every five tickers, in the order of their numbers; weights change with the month."""
    bars = features.with_adjusted(views.bars(spark, d))
    five = F.floor((F.regexp_extract("ticker", r"(\d+)", 1).cast("int") - 1) / 5) + 1
    rows = bars.withColumn("kind", F.explode(F.array(F.lit("equal"), F.lit("tilted")))).withColumn("fund", F.concat_ws(" ", "kind", five.cast("string")))
    lean = F.when(F.col("kind") == "equal", 0.18).otherwise(0.06 + 0.04 * ((F.month("trade_date") + F.regexp_extract("ticker", r"(\d+)", 1).cast("int")) % 4))
    return fund.nav_history(rows.select("fund", F.col("trade_date").alias("day"), "ticker", F.col("close").alias("price"), lean.alias("target"))).withColumns({c: F.round(c, 6) for c in ("nav", "cash", "turnover", "costs", "drawdown")})


@query("st5_outcome_fill", sql("bars", """
WITH s AS (SELECT ticker, trade_date, close FROM bars WHERE volume > 80), n AS (SELECT ticker, trade_date, close, lead(close, 20) OVER (PARTITION BY ticker ORDER BY trade_date) AS x FROM bars)
SELECT s.ticker, s.trade_date, round((n.x - s.close) / s.close, 4) AS actual_20d FROM s JOIN n USING (ticker, trade_date)"""))
def st5(spark, d):
    b = features.with_adjusted(views.bars(spark, d))
    from ..operators.targets import forward

    return b.withColumn("actual_20d", F.round(forward(20), 4)).where("volume > 80").select("ticker", "trade_date", "actual_20d")


@query("st8_day_replay", sql("bars", """
WITH y AS (SELECT DISTINCT year(trade_date) AS y FROM bars), d AS (SELECT make_date(y, 12, k) AS run_date FROM y, (VALUES (30), (31)) v(k)),
o AS (SELECT run_date, isodow(run_date) NOT IN (5, 6) AS open FROM d),
r AS (SELECT run_date, ticker, arg_max(close, trade_date) AS last_close, count(*) AS n_bars FROM o JOIN bars ON trade_date <= run_date WHERE o.open GROUP BY ALL)
SELECT run_date, 'SUCCEEDED' AS status, ticker, round(last_close, 6) AS last_close, n_bars FROM r UNION ALL SELECT run_date, 'SKIPPED_NON_TRADING', NULL, NULL, NULL FROM o WHERE NOT open"""))
def st8(spark, d):
    """The last two days of every year, each replayed on the bars known by then."""
    source, out = shared_path(spark, "bars"), shared_path(spark, "replay")
    views.bars(spark, d).select("ticker", "trade_date", "close").write.parquet(source)
    years = [r["y"] for r in spark.read.parquet(source).select(F.year("trade_date").alias("y")).distinct().collect()]
    days = [date(y, 12, k) for y in years for k in (30, 31)]
    run = lambda rows, day: rows.groupBy("ticker").agg(F.max_by("close", "trade_date").alias("last_close"), F.count("*").alias("n_bars"))
    records = replay.replay(spark, source, "trade_date", days, run, out)
    rows = records.select("run_date", "status").join(replay.results(spark, out), "run_date", "left")
    return rows.select("run_date", "status", "ticker", F.round("last_close", 6).alias("last_close"), "n_bars")
