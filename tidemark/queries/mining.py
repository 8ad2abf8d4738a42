"""Queries over the rule search and its gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features, market, mining, targets
from ..plans import views
from ..plans.stage import written
from ..plans.views import sql
from .market import RET, W, plain, r
from .registry import query

#: The usual number of rules, of each kind: singles and pairs leave room for triples and regimes.
SEARCH = mining.Search(most=2000, each=500)


def searched(spark, d):
    """Panel of price, volume and market series of every ticker, its targets, and the proposed rules."""
    bars = written(plain(spark, d), "bars")
    price = features.price_features(bars, (5, 20)).drop("ret1")
    names = [c for c in price.columns if c.endswith("d") and c not in bars.columns]
    volume = features.volume_features(bars, (5, 20))
    more = [f"{n}_{k}d" for n in ("relative_volume", "turnover_anomaly", "price_volume_correlation", "volume_percentile") for k in (5, 20)]
    wide = price.select("ticker", "trade_date", *names, targets.forward(10).alias("outcome"), targets.forward(20).alias("later")).join(volume.select("ticker", "trade_date", *more), ["ticker", "trade_date"])
    wide = written(wide, "features")
    own = wide.unpivot(["ticker", "trade_date"], [*names, *more], "feature_id", "value")
    day = features.market_wide(bars).select("trade_date", "breadth", "dispersion").unpivot(["trade_date"], ["breadth", "dispersion"], "feature_id", "value").withColumn("feature_id", F.concat(F.lit("market_"), "feature_id"))
    rows = written(mining.panel(own, day), "panel")
    goal = wide.select("ticker", "trade_date", "outcome")
    return rows, goal, wide.select("ticker", "trade_date", F.col("later").alias("outcome"), F.lit(20).alias("horizon")), written(mining.candidates(rows, goal, SEARCH), "rules")


@query("x19_j10_candidates")
def x19_all(spark, d):
    return searched(spark, d)[3].withColumn("threshold", F.round("threshold", 6))


#: Rules of every kind with thresholds that need no search: (kind, conditions as feature, threshold, lag).
FIXED_RULES = {
    "up": ("single", [("return_5d", 0.0, 0)]), "up_month": ("single", [("return_20d", 0.0, 0)]), "both_up": ("pair", [("return_1d", 0.0, 0), ("return_5d", 0.0, 0)]),
    "all_up": ("triple", [("return_1d", 0.0, 0), ("return_5d", 0.0, 0), ("return_20d", 0.0, 0)]), "broad_up": ("regime", [("return_5d", 0.0, 0), ("market_breadth", 0.5, 0)]),
    "after_broad": ("lead_lag", [("market_breadth", 0.5, 3)]), "long_after_broad": ("lead_lag", [("market_breadth", 0.5, 20)]),
}


@query("x19_j10_matches", sql("bars", f"""
WITH a AS (SELECT ticker, trade_date, {RET.format(n=1)} AS r1, {RET.format(n=5)} AS r5, {RET.format(n=20)} AS r20, (lead(close, 10) OVER w - close) / nullif(close, 0) AS o, row_number() OVER w - 1 AS pos FROM bars WINDOW w AS ({W})),
m AS (SELECT trade_date, count(*) FILTER (r1 > 0)::DOUBLE / nullif(count(r1), 0) AS b FROM a GROUP BY 1),
k AS (SELECT a.ticker, trade_date, pos, o, last_value(r1 IGNORE NULLS) OVER w AS r1, last_value(r5 IGNORE NULLS) OVER w AS r5, last_value(r20 IGNORE NULLS) OVER w AS r20, last_value(b IGNORE NULLS) OVER w AS b
      FROM a JOIN m USING (trade_date) WINDOW w AS (PARTITION BY ticker ORDER BY trade_date)),
l AS (SELECT *, lag(b, 3) OVER w AS b3, lag(b, 20) OVER w AS b20 FROM k WINDOW w AS (PARTITION BY ticker ORDER BY trade_date)),
u AS (SELECT ticker, o, unnest(list_filter([CASE WHEN r5 > 0 THEN 'up' END, CASE WHEN r20 > 0 THEN 'up_month' END, CASE WHEN r1 > 0 AND r5 > 0 THEN 'both_up' END, CASE WHEN r1 > 0 AND r5 > 0 AND r20 > 0 THEN 'all_up' END,
        CASE WHEN r5 > 0 AND b > 0.5 THEN 'broad_up' END, CASE WHEN b3 > 0.5 THEN 'after_broad' END, CASE WHEN b20 > 0.5 THEN 'long_after_broad' END], lambda x: x IS NOT NULL)) AS rule_id FROM l WHERE o IS NOT NULL)
SELECT ticker, rule_id, count(*) AS matches, count(*) FILTER (o > 0) AS hits FROM u GROUP BY ALL"""))
def x19_matches(spark, d):
    bars = plain(spark, d)
    names = ["return_1d", "return_5d", "return_20d"]
    wide = written(bars.select("ticker", "trade_date", *[features.ret(int(n[7:-1])).alias(n) for n in names], targets.forward(10).alias("outcome")), "returns")
    day = features.market_wide(bars).select("trade_date", F.lit("market_breadth").alias("feature_id"), F.col("breadth").alias("value"))
    rows = written(mining.panel(wide.unpivot(["ticker", "trade_date"], names, "feature_id", "value"), day), "panel")
    made = [(rule, kind, len(conds), k, f, ">", t, lag) for rule, (kind, conds) in FIXED_RULES.items() for k, (f, t, lag) in enumerate(conds)]
    rules = spark.createDataFrame(made, "rule_id string, kind string, n_conditions int, place int, feature_id string, op string, threshold double, lag int")
    rules = rules.join(rows.select("ticker", "feature_id").distinct(), "feature_id")
    found = mining.matched(rules, rows, wide)
    return found.groupBy("ticker", "rule_id").agg(F.count("*").alias("matches"), F.count_if(F.col("outcome") > 0).alias("hits"))


@query("x20_x15_lifecycle")
def x20_all(spark, d):
    rows, goal, later, rules = searched(spark, d)
    out = mining.lifecycle(rules, rows, goal, later)
    return out.withColumns({c: F.round(c, 4) for c in ("expectancy", "oos_expectancy", "holdout_expectancy")})


@query("x23_control_suite")
def x23(spark, d):
    return mining.control_suite(plain(spark, d)).withColumn("rate", F.round("rate", 6))


@query("x16_all_baselines", sql("bars sectors financials", f"""
WITH a AS (SELECT b.ticker, b.trade_date, s.sector, {RET.format(n=20)} AS past, (lead(close, 10) OVER w - close) / nullif(close, 0) AS o FROM bars b JOIN sectors s USING (ticker) WINDOW w AS (PARTITION BY b.ticker ORDER BY trade_date)),
k AS (SELECT *, avg(o) OVER (PARTITION BY sector, trade_date) AS peers FROM a),
g AS (SELECT ticker, period_end_date, (value - lag(value, 4) OVER p) / nullif(abs(lag(value, 4) OVER p), 0) AS growth FROM financials WHERE line_item = 'revenue' WINDOW p AS (PARTITION BY ticker ORDER BY period_end_date)),
f AS (SELECT g.ticker, a.o FROM g ASOF JOIN (SELECT ticker, trade_date, o FROM a) a ON a.ticker = g.ticker AND a.trade_date >= g.period_end_date WHERE growth > 0),
u AS (SELECT ticker, 'buy_and_hold' AS name, o FROM k UNION ALL SELECT ticker, 'momentum', o FROM k WHERE past > 0 UNION ALL SELECT ticker, 'mean_reversion', o FROM k WHERE past < 0 UNION ALL SELECT '*', 'unconditional_market', o FROM k
  UNION ALL SELECT ticker, 'sector_relative', o - peers FROM k UNION ALL SELECT ticker, 'revenue_growth', o FROM f)
SELECT ticker, name, count(o) AS n, round(avg(o), 4) AS mean_outcome, round(avg(CAST(o > 0 AS DOUBLE)), 6) AS hit_rate FROM u GROUP BY ALL HAVING count(o) >= 2"""))
def x16_all(spark, d):
    rows = plain(spark, d).withColumns({"past": features.ret(20), "outcome": targets.forward(10)})
    out = mining.all_baselines(rows, views.sectors(spark, d), views.financials(spark, d))
    return out.select("ticker", "name", "n", r("mean_outcome", 4), r("hit_rate"))


@query("w18_six_dimensions", sql("bars", f"""
WITH a AS (SELECT *, {RET.format(n=1)} AS r1 FROM bars WINDOW w AS ({W})), k AS (SELECT ticker, trade_date, r1 FROM a WHERE r1 IS NOT NULL),
cal AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS pos FROM (SELECT DISTINCT trade_date FROM k)),
n AS (SELECT ticker, trade_date, r1, pos FROM k JOIN cal USING (trade_date)),
p AS (SELECT x.ticker AS a, y.ticker AS b, x.pos, x.r1 AS x, y.r1 AS y FROM n x JOIN n y ON x.pos = y.pos AND x.ticker < y.ticker),
c AS (SELECT a, b, pos, count(*) OVER f AS n, (avg(x * y) OVER f - avg(x) OVER f * avg(y) OVER f) / nullif(stddev_pop(x) OVER f * stddev_pop(y) OVER f, 0) AS c FROM p WINDOW f AS (PARTITION BY a, b ORDER BY pos RANGE BETWEEN 59 PRECEDING AND CURRENT ROW))
SELECT trade_date, count(c) AS pairs, round(avg(c), 4) AS mean_correlation FROM c JOIN cal USING (pos) WHERE n >= 20 GROUP BY ALL HAVING count(c) > 0"""))
def w18_six(spark, d):
    return market.mean_correlation(plain(spark, d)).select("trade_date", "pairs", r("mean_correlation", 4))
