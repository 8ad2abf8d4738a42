"""Queries over bars: features, targets, breadth, regimes."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.stats import change
from ..operators import adjust, features, market, targets
from ..plans import views
from ..plans.stage import written
from ..plans.views import sql
from .registry import query

W = "PARTITION BY ticker ORDER BY trade_date"
RET = "(close - lag(close, {n}) OVER w) / nullif(lag(close, {n}) OVER w, 0)"


def plain(spark, d):
    return features.with_adjusted(views.bars(spark, d))


def r(column, digits=6):
    return F.round(F.col(column), digits).alias(column)


@query("w1_returns", sql("bars", "SELECT ticker, trade_date, " + ", ".join(f"round({RET.format(n=n)}, 4) AS return_{n}d" for n in features.PRICE_WINDOWS) + f" FROM bars WINDOW w AS ({W})"))
def w1_returns(spark, d):
    return plain(spark, d).select("ticker", "trade_date", *[F.round(features.ret(n), 4).alias(f"return_{n}d") for n in features.PRICE_WINDOWS])


@query("w2_w4_price_features", sql("bars", f"""
WITH a AS (SELECT *, {RET.format(n=1)} AS r1, {RET.format(n=5)} AS r5, row_number() OVER w AS rn FROM bars WINDOW w AS ({W}))
SELECT ticker, trade_date, round(r5 - lag(r5, 5) OVER ({W}), 4) AS acceleration_5d,
  round(CASE WHEN rn >= 20 THEN (close - max(high) OVER w20) / max(high) OVER w20 END, 6) AS distance_high_20d,
  round(CASE WHEN rn >= 20 THEN (close - min(low) OVER w20) / min(low) OVER w20 END, 4) AS distance_low_20d,
  round(CASE WHEN count(r1) OVER w20 = 20 THEN stddev_pop(r1) OVER w20 END, 4) AS volatility_20d
FROM a WINDOW w20 AS ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"""))
def w2_w4(spark, d):
    f = features.price_features(plain(spark, d), (5, 20))
    return f.select("ticker", "trade_date", r("acceleration_5d", 4), r("distance_high_20d"), r("distance_low_20d", 4), r("volatility_20d", 4))


@query("w5_volatility_regime", sql("bars", f"""
WITH a AS (SELECT *, {RET.format(n=1)} AS r1 FROM bars WINDOW w AS ({W})),
v AS (SELECT ticker, trade_date, CASE WHEN count(r1) OVER w = 20 THEN round(stddev_pop(r1) OVER w, 6) END AS vol, row_number() OVER ({W}) AS rn FROM a WINDOW w AS ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT v.ticker, v.trade_date, round((count(*) FILTER (p.vol < v.vol) + 0.5::DOUBLE * count(*) FILTER (p.vol = v.vol)) / 119, 6) AS percentile
FROM v JOIN v AS p ON p.ticker = v.ticker AND p.rn BETWEEN v.rn - 119 AND v.rn - 1 AND p.vol IS NOT NULL
WHERE v.vol IS NOT NULL GROUP BY v.ticker, v.trade_date HAVING count(*) = 119"""))
def w5(spark, d):
    f = features.price_features(plain(spark, d), (20,)).withColumn("vol", F.round("volatility_20d", 6))
    f = f.withColumn("percentile", features.percentile_in_past("vol"))
    return f.where("percentile is not null").select("ticker", "trade_date", r("percentile"))


@query("w6_w10_volume_features", sql("bars", f"""
WITH a AS (SELECT *, CAST(volume AS DOUBLE) AS v, {RET.format(n=1)} AS r1, row_number() OVER w AS rn FROM bars WINDOW w AS ({W})),
b AS (SELECT *, CASE WHEN count(v) OVER p >= 2 THEN v / nullif(avg(v) OVER p, 0) END AS rel,
  CASE WHEN count(v) OVER p >= 2 AND stddev_pop(v) OVER p > 1e-9 THEN (v - avg(v) OVER p) / stddev_pop(v) OVER p END AS z,
  CASE WHEN count(r1) OVER c = 10 AND stddev_pop(r1) OVER c > 1e-12 * abs(avg(r1) OVER c) AND stddev_pop(v) OVER c > 1e-12 * abs(avg(v) OVER c)
    THEN (avg(r1 * v) OVER c - avg(r1) OVER c * avg(v) OVER c) / (stddev_pop(r1) OVER c * stddev_pop(v) OVER c) END AS pv,
  list(v) OVER (ORDER BY ticker, trade_date ROWS BETWEEN 9 PRECEDING AND 1 PRECEDING) AS past
  FROM a WINDOW p AS ({W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), c AS ({W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
SELECT ticker, trade_date, round(rel, 6) AS relative_volume_10d, round(z, 6) AS turnover_anomaly_10d, round(rel - lag(rel, 10) OVER ({W}), 6) AS volume_acceleration_10d,
  round(pv, 4) AS price_volume_correlation_10d,
  round(CASE WHEN rn >= 10 THEN (len(list_filter(past, lambda x: x < v)) + 0.5::DOUBLE * len(list_filter(past, lambda x: x = v))) / 9 END, 6) AS volume_percentile_10d
FROM b"""))
def w6_w10(spark, d):
    f = features.volume_features(plain(spark, d), (10,))
    return f.select("ticker", "trade_date", r("relative_volume_10d"), r("turnover_anomaly_10d"), r("volume_acceleration_10d"), r("price_volume_correlation_10d", 4), r("volume_percentile_10d"))


CROSS = f"""
WITH a AS (SELECT b.*, s.sector, (close - lag(close, 5) OVER w) / nullif(lag(close, 5) OVER w, 0) AS r5 FROM bars b JOIN sectors s USING (ticker) WINDOW w AS (PARTITION BY b.ticker ORDER BY trade_date)),
k AS (SELECT * FROM a WHERE r5 IS NOT NULL)"""


@query("w11_w14_cross_sectional", sql("bars sectors", CROSS + """
SELECT ticker, trade_date,
  round((rank() OVER (PARTITION BY trade_date ORDER BY r5) - 1 + 0.5::DOUBLE * count(*) OVER (PARTITION BY trade_date, r5)) / count(*) OVER (PARTITION BY trade_date), 6) AS market_percentile_5d,
  round((rank() OVER (PARTITION BY trade_date, sector ORDER BY r5) - 1 + 0.5::DOUBLE * count(*) OVER (PARTITION BY trade_date, sector, r5)) / count(*) OVER (PARTITION BY trade_date, sector), 6) AS sector_percentile_5d,
  round(r5 - avg(r5) OVER (PARTITION BY trade_date), 4) AS relative_strength_5d,
  round(CASE WHEN count(*) OVER (PARTITION BY trade_date) > 1 THEN stddev_pop(r5) OVER (PARTITION BY trade_date) END, 4) AS dispersion_5d
FROM k"""))
def w11_w14(spark, d):
    f = features.cross_sectional(plain(spark, d), views.sectors(spark, d), (5,)).where("return_5d is not null")
    return f.select("ticker", "trade_date", r("market_percentile_5d"), r("sector_percentile_5d"), r("relative_strength_5d", 4), r("dispersion_5d", 4))


@query("w13_rank_change", sql("bars sectors", CROSS + """,
p AS (SELECT ticker, trade_date, (rank() OVER (PARTITION BY trade_date ORDER BY r5) - 1 + 0.5::DOUBLE * count(*) OVER (PARTITION BY trade_date, r5)) / count(*) OVER (PARTITION BY trade_date) AS x FROM k),
c AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS pos FROM (SELECT DISTINCT trade_date FROM p))
SELECT p.ticker, p.trade_date, round(p.x - q.x, 6) AS rank_change
FROM p JOIN c USING (trade_date) LEFT JOIN c AS c2 ON c2.pos = c.pos - 5 LEFT JOIN p AS q ON q.ticker = p.ticker AND q.trade_date = c2.trade_date"""))
def w13(spark, d):
    f = features.cross_sectional(plain(spark, d), views.sectors(spark, d), (5,)).where("return_5d is not null")
    return features.rank_change(f.select("ticker", "trade_date", F.col("market_percentile_5d").alias("percentile")), 5).select("ticker", "trade_date", r("rank_change"))


@query("a14_market_wide", sql("bars", f"""
WITH a AS (SELECT *, {RET.format(n=1)} AS r1 FROM bars WINDOW w AS ({W})), e AS (SELECT *, CAST(r1 AS DECIMAL(18, 9)) AS x FROM a),
t AS (
  SELECT trade_date, CAST(sum(CAST(volume AS HUGEINT) * volume) AS DOUBLE) AS squares, CAST(sum(volume) AS DOUBLE) AS total, count(r1) AS n, count(*) FILTER (r1 > 0) AS up,
         CAST(sum(x) AS DOUBLE) AS s, CAST(sum(x * x) AS DOUBLE) AS s2, count(*) AS n_bars
  FROM e GROUP BY 1)
SELECT trade_date, round(squares / nullif(total * total, 0), 6) AS volume_hhi, round(up::DOUBLE / nullif(n, 0), 6) AS breadth,
  round(s / nullif(n, 0), 4) AS mean_return, round(CASE WHEN n > 1 THEN sqrt(greatest(0, s2 / n - (s / n) * (s / n))) END, 4) AS dispersion, n_bars
FROM t"""))
def a14(spark, d):
    return features.market_wide(plain(spark, d)).select("trade_date", r("volume_hhi"), r("breadth"), r("mean_return", 4), r("dispersion", 4), "n_bars")


@query("w15_fundamentals", sql("financials", """
WITH a AS (SELECT *, row_number() OVER w AS rn, lag(value, 4) OVER w AS y, lag(value) OVER w AS q FROM financials WHERE line_item = 'revenue' WINDOW w AS (PARTITION BY ticker ORDER BY period_end_date)),
b AS (SELECT *, (value - y) / nullif(abs(y), 0) AS yoy FROM a)
SELECT ticker, period_end_date, round(yoy, 6) AS yoy, round((value - q) / nullif(abs(q), 0), 6) AS qoq,
  round(CASE WHEN rn >= 2 THEN avg(value) OVER (PARTITION BY ticker ORDER BY period_end_date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) END, 0) AS trailing_mean,
  round(yoy - lag(yoy) OVER (PARTITION BY ticker ORDER BY period_end_date), 6) AS yoy_acceleration, period_end_date + 45 AS known_on
FROM b"""))
def w15(spark, d):
    f = features.fundamentals(views.financials(spark, d), "revenue")
    return f.select("ticker", "period_end_date", r("yoy"), r("qoq"), r("trailing_mean", 0), r("yoy_acceleration"), "known_on")


@query("w16_macro_features", sql("macro", """
WITH a AS (SELECT *, (value - lag(value) OVER w) / nullif(lag(value) OVER w, 0) AS change, row_number() OVER w AS rn FROM macro WINDOW w AS (PARTITION BY series_id ORDER BY observation_date)),
p AS (SELECT x.series_id, x.observation_date, count(*) AS n, count(*) FILTER (y.value < x.value) AS lo, count(*) FILTER (y.value = x.value) AS eq
  FROM a x JOIN a y ON y.series_id = x.series_id AND y.rn < x.rn GROUP BY ALL)
SELECT a.series_id, a.observation_date, a.value, round(change, 6) AS change, round(change - lag(change) OVER (PARTITION BY a.series_id ORDER BY a.observation_date), 6) AS acceleration,
  round(coalesce((lo + 0.5::DOUBLE * eq) / n, 0.5), 6) AS percentile
FROM a LEFT JOIN p ON p.series_id = a.series_id AND p.observation_date = a.observation_date"""))
def w16(spark, d):
    return features.macro_features(views.macro(spark, d)).select("series_id", "observation_date", "value", r("change"), r("acceleration"), r("percentile"))


@query("w19_w23_forward_targets", sql("bars sectors", """
WITH a AS (SELECT b.*, s.sector, lead(close, 10) OVER w AS x, max(high) OVER f AS hi, min(low) OVER f AS lo, list(close) OVER f AS path
  FROM bars b JOIN sectors s USING (ticker)
  WINDOW w AS (PARTITION BY b.ticker ORDER BY trade_date), f AS (PARTITION BY b.ticker ORDER BY trade_date ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING)),
g AS (SELECT *, (x - close) / nullif(close, 0) AS fr FROM a),
dd AS (SELECT ticker, trade_date, min(worst) AS worst FROM (
  SELECT ticker, trade_date, (p - greatest(close, max(p) OVER (PARTITION BY ticker, trade_date ORDER BY i))) / greatest(close, max(p) OVER (PARTITION BY ticker, trade_date ORDER BY i)) AS worst
  FROM (SELECT ticker, trade_date, close, unnest(path) AS p, unnest(range(1, len(path) + 1)) AS i FROM g WHERE x IS NOT NULL)) GROUP BY ALL)
SELECT g.ticker, g.trade_date, round(fr, 4) AS forward_return_10d, round(CASE WHEN x IS NOT NULL THEN (hi - close) / close END, 4) AS mfe_10d,
  round(CASE WHEN x IS NOT NULL THEN (lo - close) / close END, 6) AS mae_10d, round(CASE WHEN x IS NOT NULL THEN least(0.0, dd.worst) END, 6) AS max_drawdown_10d,
  CASE WHEN x IS NOT NULL THEN CAST(fr > 0 AS DOUBLE) END AS positive_10d, CASE WHEN x IS NOT NULL THEN CAST(fr > 0.05 AS DOUBLE) END AS exceeds_5pct_10d,
  round(fr - avg(fr) OVER (PARTITION BY g.trade_date), 4) AS vs_market_10d, round(fr - avg(fr) OVER (PARTITION BY g.trade_date, sector), 4) AS vs_sector_10d
FROM g LEFT JOIN dd USING (ticker, trade_date)"""))
def w19_w23(spark, d):
    f = targets.forward_targets(plain(spark, d), (10,)).drop("forward_return_10d")
    f = targets.relative_targets(f, views.sectors(spark, d), (10,))
    return f.select("ticker", "trade_date", r("forward_return_10d", 4), r("mfe_10d", 4), r("mae_10d"), r("max_drawdown_10d"), "positive_10d", "exceeds_5pct_10d", r("vs_market_10d", 4), r("vs_sector_10d", 4))


@query("w24_triple_barrier", sql("bars", f"""
WITH n AS (SELECT *, row_number() OVER ({W}) AS rn FROM bars),
h AS (SELECT a.ticker, a.trade_date, b.rn - a.rn AS step, b.high >= a.close * (1 + 0.05::DOUBLE) AS up, b.low <= a.close * (1 + -0.03::DOUBLE) AS down
  FROM n a JOIN n b ON b.ticker = a.ticker AND b.rn BETWEEN a.rn + 1 AND a.rn + 20),
f AS (SELECT ticker, trade_date, arg_min(CASE WHEN up AND down THEN 0.0 WHEN up THEN 1.0 ELSE -1.0 END, step) FILTER (up OR down) AS hit FROM h GROUP BY ALL)
SELECT n.ticker, n.trade_date, CAST(CASE WHEN f.ticker IS NULL THEN NULL ELSE coalesce(hit, 0.0) END AS DOUBLE) AS barrier FROM n LEFT JOIN f USING (ticker, trade_date)"""))
def w24(spark, d):
    return plain(spark, d).select("ticker", "trade_date", targets.triple_barrier(None, 0.05, -0.03, 20).alias("barrier"))


@query("w36_j14_split_adjusted", sql("corporate_events", """
SELECT b.ticker, b.trade_date, b.close, b.close / power(2.0::DOUBLE, count(e.event_date)) AS adj
FROM bars b LEFT JOIN corporate_events e ON e.ticker = b.ticker AND e.event_type = 'SPLIT' AND e.event_date > b.trade_date GROUP BY b.ticker, b.trade_date, b.close"""))
def w36_splits(spark, d):
    b = views.shared_bars(spark, d)
    return adjust.split_adjusted(b, views.corporate_events(spark, d, b)).select("ticker", "trade_date", "close", "adj")


@query("j14_mixed_adjustment")
def j14_mixed(spark, d):
    b = views.shared_bars(spark, d)
    return adjust.adjusted(b, views.corporate_events(spark, d, b)).select("ticker", "trade_date", "close", F.round("adj", 6).alias("adj"))


@query("w37_horizon_forward", sql("bars", f"""
SELECT ticker, trade_date, round((lead(close, 3) OVER w - close) / close, 4) AS micro, round((lead(close, 20) OVER w - close) / close, 4) AS swing, round((lead(close, 126) OVER w - close) / close, 4) AS investment
FROM bars WINDOW w AS ({W})"""))
def w37(spark, d):
    return plain(spark, d).select("ticker", "trade_date", *[F.round(targets.forward(h), 4).alias(n) for n, h in (("micro", 3), ("swing", 20), ("investment", 126))])


@query("a12_market_breadth", sql("bars", f"""
WITH a AS (SELECT *, {RET.format(n=1)} AS r1, row_number() OVER w AS rn, avg(volume) OVER (PARTITION BY ticker ORDER BY trade_date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS av FROM bars WINDOW w AS ({W})),
l AS (SELECT ticker, arg_max(r1, trade_date) FILTER (r1 IS NOT NULL) AS r1, arg_max(volume, trade_date) AS v, arg_max(av, trade_date) AS av, count(*) AS n FROM a GROUP BY ticker)
SELECT (SELECT count(DISTINCT ticker) FROM bars) AS universe, count(*) AS with_price, count(*) FILTER (r1 > 0) AS advancers, count(*) FILTER (r1 < 0) AS decliners, count(*) FILTER (r1 = 0) AS unchanged,
  round(count(*) FILTER (r1 > 0)::DOUBLE / nullif(count(*) FILTER (r1 < 0), 0), 6) AS advance_decline_ratio, round(avg(r1) * 100, 4) AS average_return_pct,
  count(*) FILTER (av > 0 AND v > av) AS above_average_volume, count(*) FILTER (av > 0 AND NOT v > av) AS below_average_volume
FROM l WHERE n >= 2"""))
def a12(spark, d):
    return market.breadth(plain(spark, d)).withColumns({"advance_decline_ratio": F.round("advance_decline_ratio", 6), "average_return_pct": F.round("average_return_pct", 4)})


@query("a13_market_regime", sql("bars", f"""
WITH a AS (SELECT *, {RET.format(n=1)} AS r1 FROM bars WINDOW w AS ({W})),
m AS (SELECT trade_date, avg(r1) AS m FROM a WHERE r1 IS NOT NULL GROUP BY 1 ORDER BY 1 DESC LIMIT 20),
s AS (SELECT count(*) AS days, product(1 + m) - 1 AS c, CASE WHEN count(*) > 1 THEN stddev_pop(m) ELSE 0 END AS v FROM m)
SELECT days, round(ln(1 + c), 6) AS log_growth, round(v * 100, 4) AS daily_volatility_pct,
  CASE WHEN c >= 0.03 THEN 'bullish' WHEN c <= -0.03 THEN 'bearish' ELSE 'neutral' END AS trend, CASE WHEN v >= 0.025 THEN 'high' WHEN v >= 0.015 THEN 'elevated' ELSE 'low' END AS volatility FROM s"""))
def a13(spark, d):
    f = market.regime(plain(spark, d)).withColumn("log_growth", F.round(F.log1p(F.col("cumulative_return_pct") / 100), 6))
    return f.withColumn("daily_volatility_pct", F.round("daily_volatility_pct", 4)).drop("cumulative_return_pct")


@query("w17_w18_regime_buckets", sql("bars", f"""
WITH a AS (SELECT *, {RET.format(n=1)} AS r1 FROM bars WINDOW w AS ({W})),
m AS (SELECT trade_date, round(count(*) FILTER (r1 > 0)::DOUBLE / nullif(count(r1), 0), 9) AS breadth, row_number() OVER (ORDER BY trade_date) AS rn FROM a GROUP BY trade_date),
p AS (SELECT x.trade_date, (count(*) FILTER (y.breadth < x.breadth) + 0.5::DOUBLE * count(*) FILTER (y.breadth = x.breadth)) / 119 AS pct
  FROM m x JOIN m y ON y.rn BETWEEN x.rn - 119 AND x.rn - 1 WHERE x.breadth IS NOT NULL AND y.breadth IS NOT NULL GROUP BY x.trade_date HAVING count(*) = 119)
SELECT trade_date, 'breadth' AS dimension, 3 AS k, CAST(least(2, floor(pct * 3)) AS INTEGER) AS bucket FROM p"""))
def w17_w18(spark, d):
    return market.regime_buckets(plain(spark, d), ("breadth",), 3).where("bucket is not null").select("trade_date", "dimension", "k", "bucket")


@query("w18_regime_dimensions", sql("bars", f"""
WITH a AS (SELECT *, {RET.format(n=1)} AS r1, {RET.format(n=20)} AS r20 FROM bars WINDOW w AS ({W})),
m AS (SELECT trade_date, avg(r1) AS m, avg(r20) AS trend, sum(close * volume) AS turnover, round(count(*) FILTER (r1 > 0)::DOUBLE / nullif(count(r1), 0), 9) AS breadth, CASE WHEN count(r1) > 1 THEN stddev_pop(r1) END AS dispersion, row_number() OVER (ORDER BY trade_date) AS rn FROM a GROUP BY trade_date),
v AS (SELECT *, CASE WHEN count(m) OVER s = 20 THEN stddev_pop(m) OVER s END AS volatility FROM m WINDOW s AS (ORDER BY trade_date ROWS 19 PRECEDING)),
t AS (SELECT trade_date, rn, unnest(['trend', 'turnover', 'breadth', 'dispersion', 'volatility']) AS dimension, unnest([trend, turnover, breadth, dispersion, volatility]) AS value FROM v),
p AS (SELECT x.trade_date, x.dimension, x.value, CASE WHEN count(y.value) = 119 THEN (count(*) FILTER (y.value < x.value) + 0.5::DOUBLE * count(*) FILTER (y.value = x.value)) / 119 END AS pct
  FROM t x LEFT JOIN t y ON y.dimension = x.dimension AND y.rn BETWEEN x.rn - 119 AND x.rn - 1 WHERE x.value IS NOT NULL GROUP BY ALL)
SELECT trade_date, dimension, 3 AS k, CASE dimension WHEN 'turnover' THEN round(value, 0) ELSE round(value, 4) END AS value, CAST(least(2, floor(pct * 3)) AS INTEGER) AS bucket FROM p WHERE pct IS NOT NULL"""))
def w18_all(spark, d):
    five = tuple(x for x in market.DIMENSIONS if x != "correlation")  # that one has a query of its own
    return market.regime_buckets(plain(spark, d), five, 3).where("bucket is not null").withColumn("value", F.when(F.col("dimension") == "turnover", F.round("value", 0)).otherwise(F.round("value", 4)))


@query("a32_sector_leader", sql("bars sectors", """
WITH v AS (SELECT sector, ticker, sum(volume) AS total FROM bars JOIN sectors USING (ticker) GROUP BY ALL)
SELECT sector, ticker AS leader, CAST(total AS BIGINT) AS total_volume FROM v QUALIFY row_number() OVER (PARTITION BY sector ORDER BY total DESC, ticker) = 1"""))
def a32(spark, d):
    return market.sector_leaders(views.bars(spark, d), views.sectors(spark, d))


@query("a33_price_stats", sql("bars", f"""
WITH a AS (SELECT *, {RET.format(n=1)} AS r1, lag(close, 20) OVER w AS c20, avg(close) OVER (PARTITION BY ticker ORDER BY trade_date ROWS 19 PRECEDING) AS s20, avg(close) OVER (PARTITION BY ticker ORDER BY trade_date ROWS 49 PRECEDING) AS s50,
  max(high) OVER (PARTITION BY ticker ORDER BY trade_date ROWS 251 PRECEDING) AS hi, min(low) OVER (PARTITION BY ticker ORDER BY trade_date ROWS 251 PRECEDING) AS lo, row_number() OVER (PARTITION BY ticker ORDER BY trade_date DESC) AS rev FROM bars WINDOW w AS ({W})),
v AS (SELECT ticker, stddev_samp(r1) * sqrt(252) AS vol FROM a GROUP BY 1)
SELECT ticker, trade_date, close, round((close - c20) / c20, 6) AS momentum_20d, round(vol, 4) AS annual_volatility, hi AS high_252d, lo AS low_252d, round(s20, 4) AS sma20, round(s50, 4) AS sma50,
  CASE WHEN close > s20 AND s20 > s50 THEN 'up' WHEN close < s20 AND s20 < s50 THEN 'down' ELSE 'flat' END AS trend
FROM a JOIN v USING (ticker) WHERE rev = 1"""))
def a33(spark, d):
    return market.price_stats(plain(spark, d)).withColumns({"momentum_20d": F.round("momentum_20d", 6), "annual_volatility": F.round("annual_volatility", 4), "sma20": F.round("sma20", 4), "sma50": F.round("sma50", 4)})


@query("j8_pair_correlation", sql("bars", f"""
WITH a AS (SELECT *, {RET.format(n=1)} AS x FROM bars WINDOW w AS ({W})), k AS (SELECT * FROM a WHERE x IS NOT NULL)
SELECT a.ticker AS a, b.ticker AS b, count(*) AS n, round((avg(a.x * b.x) - avg(a.x) * avg(b.x)) / nullif(stddev_pop(a.x) * stddev_pop(b.x), 0), 4) AS correlation
FROM k a JOIN k b ON a.trade_date = b.trade_date AND a.ticker < b.ticker GROUP BY ALL"""))
def j8(spark, d):
    return market.pair_correlations(plain(spark, d)).select("a", "b", "n", F.round("correlation", 4).alias("correlation"))


@query("j8_strong_pairs", sql("bars", """
WITH s AS (SELECT ticker || '|' || name AS id, trade_date AS day, value FROM (UNPIVOT (SELECT ticker, trade_date, open, high, low, close FROM bars) ON open, high, low, close INTO NAME name VALUE value)),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS n, (avg(a.value * b.value) - avg(a.value) * avg(b.value)) / nullif(stddev_pop(a.value) * stddev_pop(b.value), 0) AS c FROM s a JOIN s b ON a.day = b.day AND a.id < b.id GROUP BY ALL),
d AS (SELECT id, count(*) AS days FROM s GROUP BY 1)
SELECT a, b, 0 AS lag, n, round(c, 4) AS correlation FROM p JOIN d x ON x.id = a JOIN d y ON y.id = b WHERE abs(c) >= 0.6 AND n >= 0.9 * greatest(x.days, y.days)"""))
def j8_strong(spark, d):
    """Of all series of opening, high, low and closing prices, the pairs that move together."""
    long = plain(spark, d).unpivot(["ticker", "trade_date"], ["open", "high", "low", "close"], "name", "value")
    rows = long.select(F.concat_ws("|", "ticker", "name").alias("id"), F.col("trade_date").alias("day"), "value")
    return market.strong_pairs(written(rows, "series"), 0.6, bits=8).withColumn("correlation", F.round("correlation", 4))


@query("j9_lead_lag", sql("bars", f"""
WITH a AS (SELECT *, {RET.format(n=1)} AS x FROM bars WINDOW w AS ({W})), k AS (SELECT ticker, trade_date, x, row_number() OVER (PARTITION BY ticker ORDER BY trade_date) AS rn FROM a WHERE x IS NOT NULL),
p AS (SELECT l.ticker AS leader, f.ticker AS follower, g.lag, l.x AS x, f.x AS y FROM k f JOIN k s ON s.ticker <> f.ticker AND s.trade_date = f.trade_date CROSS JOIN (VALUES (1), (2), (5)) AS g(lag) JOIN k l ON l.ticker = s.ticker AND l.rn = s.rn - g.lag)
SELECT leader, follower, CAST(lag AS INTEGER) AS lag, count(*) AS n, round((avg(x * y) - avg(x) * avg(y)) / nullif(stddev_pop(x) * stddev_pop(y), 0), 4) AS correlation FROM p GROUP BY ALL"""))
def j9(spark, d):
    return market.lead_lag(plain(spark, d), (1, 2, 5)).select("leader", "follower", "lag", "n", F.round("correlation", 4).alias("correlation"))


@query("w26_worst_window", sql("bars", f"""
WITH a AS (SELECT *, {RET.format(n=1)} AS r1 FROM bars WINDOW w AS ({W})), k AS (SELECT ticker, trade_date, r1 FROM a WHERE r1 IS NOT NULL),
s AS (SELECT ticker, trade_date, round(sum(r1) OVER f, 6) AS total, count(*) OVER f AS n FROM k WINDOW f AS (PARTITION BY ticker ORDER BY trade_date ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING))
SELECT ticker, trade_date AS starts_on, total AS worst_sum FROM s WHERE n = 5 QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY total, trade_date) = 1"""))
def w26(spark, d):
    return market.worst_window(plain(spark, d), 5)


@query("w30_directional_backtest", sql("bars", f"""
WITH a AS (SELECT ticker, trade_date, {RET.format(n=1)} AS r1 FROM bars WINDOW w AS ({W})), p AS (SELECT *, coalesce(sign(lag(r1) OVER ({W})), 0) AS pos FROM a),
k AS (SELECT ticker, trade_date, pos, pos * r1 - abs(pos - coalesce(lag(pos) OVER ({W}), 0)) * 10.0::DOUBLE / 10000 AS net, row_number() OVER ({W}) AS i, count(*) OVER (PARTITION BY ticker) AS n FROM p WHERE r1 IS NOT NULL)
SELECT ticker, count(*) AS days, round(sum(net), 4) AS net_return, round(avg(net) / nullif(stddev_pop(net), 0) * sqrt(250), 4) AS sharpe,
  round(count(*) FILTER (pos <> 0 AND net > 0)::DOUBLE / nullif(count(*) FILTER (pos <> 0), 0), 6) AS hit_rate FROM k WHERE i > floor(n * (1 - 0.3::DOUBLE)) GROUP BY ticker"""))
def w30(spark, d):
    return market.backtest(plain(spark, d))


@query("w32_liquidity_proxies", sql("bars", f"""
WITH a AS (SELECT *, {RET.format(n=1)} AS r1, ln(close / nullif(lag(close) OVER w, 0)) AS lr FROM bars WINDOW w AS ({W}))
SELECT ticker, trade_date, round(CASE WHEN count(*) OVER f >= 10 THEN ln(median(close * volume) OVER f) END, 8) AS log_median_turnover_20d,
  round(CASE WHEN count(lr) OVER f >= 10 THEN stddev_samp(lr) OVER f END, 6) AS log_return_stdev_20d, round(abs(r1) / nullif(close * volume, 0), 9) AS amihud
FROM a WINDOW f AS ({W} ROWS 19 PRECEDING)"""))
def w32(spark, d):
    f = market.liquidity_proxies(plain(spark, d))
    return f.select("ticker", "trade_date", F.round(F.ln("median_turnover_20d"), 8).alias("log_median_turnover_20d"), r("log_return_stdev_20d"), r("amihud", 9))


@query("w28_analogs")
def w28(spark, d):
    return market.analogs(plain(spark, d))
