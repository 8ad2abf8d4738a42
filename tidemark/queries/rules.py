"""Queries over rules, outcomes, statistics, events, decisions, valuation and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import decisions, events, features, graph, market, outcomes, rules, targets, valuation
from ..plans import views
from ..plans.stage import written
from ..plans.views import sql, table
from .market import RET, W, plain, r
from .registry import query

BASE = f"""
WITH a AS (SELECT *, {RET.format(n=1)} AS r1, {RET.format(n=5)} AS r5, {RET.format(n=20)} AS r20, (lead(close, 10) OVER w - close) / nullif(close, 0) AS outcome FROM bars WINDOW w AS ({W})),
f AS (SELECT ticker, trade_date, 'return_5d' AS feature_id, r5 AS value FROM a WHERE r5 IS NOT NULL UNION ALL SELECT ticker, trade_date, 'return_20d', r20 FROM a WHERE r20 IS NOT NULL),
q AS (SELECT ticker, feature_id, quantile_cont(value, 0.2) AS lo, quantile_cont(value, 0.8) AS hi FROM f GROUP BY ALL),
c AS (SELECT ticker, feature_id, '<' AS op, lo AS threshold, feature_id || ':<' AS cond_id FROM q UNION ALL SELECT ticker, feature_id, '>', hi, feature_id || ':>' FROM q),
h AS (SELECT f.ticker, cond_id, feature_id, f.trade_date, outcome FROM f JOIN c USING (ticker, feature_id) JOIN a ON a.ticker = f.ticker AND a.trade_date = f.trade_date
  WHERE outcome IS NOT NULL AND ((op = '<' AND value < threshold) OR (op = '>' AND value > threshold)))"""


def mined(spark, d):
    """Features, conditions, hits and outcomes that the rule queries share."""
    wide = plain(spark, d).withColumns({"return_5d": features.ret(5), "return_20d": features.ret(20), "outcome": targets.forward(10)})
    wide = written(wide.select("ticker", "trade_date", "return_5d", "return_20d", "outcome"), "features")  # every branch below reads it
    long = rules.long_features(wide, ["return_5d", "return_20d"])
    conds = rules.conditions(long)
    out = wide.select("ticker", "trade_date", "outcome")
    return long, conds, out, rules.hits(long, conds, out)


@query("a1_a2_distribution", sql("bars", BASE + """
SELECT ticker, cond_id, count(*) AS sample_count, round(avg(CAST(outcome > 0 AS DOUBLE)), 6) AS hit_rate, round(avg(outcome), 4) AS expectancy, round(quantile_cont(outcome, 0.5), 4) AS median_outcome, round(stddev_pop(outcome), 4) AS stdev,
  round(sqrt(avg(power(least(outcome, 0), 2))), 6) AS downside_deviation, round(coalesce(sum(outcome) FILTER (outcome > 0), 0) / nullif(-sum(outcome) FILTER (outcome < 0), 0), 3) AS profit_factor
FROM h GROUP BY ALL HAVING count(*) >= 2"""))
def a2(spark, d):
    o = outcomes.distribution(mined(spark, d)[3], ["ticker", "cond_id"])
    return o.select("ticker", "cond_id", "sample_count", r("hit_rate"), r("expectancy", 4), r("median_outcome", 4), r("stdev", 4), r("downside_deviation"), r("profit_factor", 3))


@query("a3_stability", sql("bars", BASE + """,
n AS (SELECT ticker, cond_id, outcome, row_number() OVER (PARTITION BY ticker, cond_id ORDER BY trade_date) - 1 AS i, count(*) OVER (PARTITION BY ticker, cond_id) AS n FROM h),
b AS (SELECT ticker, cond_id, least(i // (n // 4), 3) AS b, avg(outcome) AS m, sum(outcome) AS s FROM n WHERE n >= 8 GROUP BY ALL),
t AS (SELECT ticker, cond_id, sum(s) >= 0 AS up FROM b GROUP BY ALL)
SELECT ticker, cond_id, count(*) FILTER ((m >= 0) = up) / 4.0::DOUBLE AS stability FROM b JOIN t USING (ticker, cond_id) GROUP BY ALL"""))
def a3(spark, d):
    return outcomes.stability(mined(spark, d)[3], ["ticker", "cond_id"], "trade_date")


@query("x19_pair_rules", sql("bars", BASE + """
SELECT x.ticker, x.cond_id AS "first", y.cond_id AS "second", count(*) AS n, round(avg(x.outcome), 4) AS expectancy, round(avg(CAST(x.outcome > 0 AS DOUBLE)), 6) AS hit_rate
FROM h x JOIN h y ON x.ticker = y.ticker AND x.trade_date = y.trade_date AND x.cond_id < y.cond_id AND x.feature_id <> y.feature_id GROUP BY ALL HAVING count(*) >= 30"""))
def x19(spark, d):
    return rules.pairs(mined(spark, d)[3]).select("ticker", "first", "second", "n", r("expectancy", 4), r("hit_rate"))


@query("t6_jaccard_overlap", sql("bars", BASE + """,
s AS (SELECT ticker, cond_id, count(*) AS n FROM h GROUP BY ALL), b AS (SELECT x.ticker, x.cond_id AS a, y.cond_id AS b, count(*) AS k FROM h x JOIN h y ON x.ticker = y.ticker AND x.trade_date = y.trade_date AND x.cond_id < y.cond_id GROUP BY ALL)
SELECT b.ticker, a AS "first", b.b AS "second", round(k::DOUBLE / (s1.n + s2.n - k), 6) AS jaccard FROM b JOIN s s1 ON s1.ticker = b.ticker AND s1.cond_id = a JOIN s s2 ON s2.ticker = b.ticker AND s2.cond_id = b.b"""))
def t6(spark, d):
    return rules.overlaps(mined(spark, d)[3]).withColumn("jaccard", F.round("jaccard", 6))


@query("t7_greedy_pruning")
def t7(spark, d):
    found = mined(spark, d)[3]
    ranked = rules.singles(found).withColumn("priority", F.round(-F.abs("expectancy"), 6))
    return rules.keep_first(ranked.select("ticker", "cond_id", "n", "priority"), rules.overlaps(found).where("jaccard >= 0.3"))


@query("x1_x2_fdr", """
WITH p AS (SELECT p_partkey, round((p_partkey * 7919 % 1000) / 1000.0::DOUBLE * (p_partkey % 5) / 8, 6) AS p FROM part),
k AS (SELECT *, row_number() OVER (ORDER BY p, p_partkey) AS i, count(*) OVER () AS m FROM p), l AS (SELECT coalesce(max(i) FILTER (p <= i::DOUBLE / m * 0.1), 0) AS last FROM k)
SELECT p_partkey, p, i <= last AS accepted, round(least(1.0, min(p * m / i) OVER (ORDER BY p, p_partkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 9) AS q_value FROM k, l""")
def x1(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.round((F.col("p_partkey") * 7919 % 1000) / 1000.0 * (F.col("p_partkey") % 5) / 8, 6).alias("p"))
    return outcomes.fdr_mask(p, "p", 0.1).select("p_partkey", "p", "accepted", r("q_value", 9))


@query("x3_benjamini_yekutieli", """
WITH p AS (SELECT p_partkey, round((p_partkey * 7919 % 1000) / 1000.0::DOUBLE * (p_partkey % 5) / 8, 6) AS p FROM part),
k AS (SELECT *, row_number() OVER (ORDER BY p, p_partkey) AS i, count(*) OVER () AS m FROM p), h AS (SELECT sum(1.0::DOUBLE / g) AS c FROM unnest(range(1, (SELECT count(*) FROM part) + 1)) AS t(g)),
l AS (SELECT coalesce(max(i) FILTER (p <= i::DOUBLE / m * 0.1 / c), 0) AS last FROM k, h)
SELECT p_partkey, i <= last AS accepted FROM k, l""")
def x3(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.round((F.col("p_partkey") * 7919 % 1000) / 1000.0 * (F.col("p_partkey") % 5) / 8, 6).alias("p"))
    return outcomes.fdr_mask(p, "p", 0.1, dependent=True).select("p_partkey", "accepted")


@query("a9_family_groups", sql("bars", BASE + """,
s AS (SELECT ticker, cond_id, count(*) AS n FROM h GROUP BY ALL)
SELECT concat_ws('|', ticker, regexp_replace(cond_id, '_\\d+d(:)', '\\1'), 'forward_10d', 'no_regime') AS family, count(*) AS size, CAST(sum(n) AS BIGINT) AS hits, least(1.0, 0.01 * count(*)) AS corrected_p FROM s GROUP BY 1"""))
def a9(spark, d):
    s = mined(spark, d)[3].groupBy("ticker", "cond_id").agg(F.count("*").alias("n"))
    key = outcomes.family_key(F.col("cond_id"), F.col("ticker"), F.lit("forward_10d"), F.lit(None).cast("string"))
    return s.groupBy(key.alias("family")).agg(F.count("*").alias("size"), F.sum("n").alias("hits")).withColumn("corrected_p", outcomes.bonferroni(F.lit(0.01), F.col("size")))


@query("a11_grouping_sets", sql("bars sectors", f"""
WITH a AS (SELECT b.*, s.sector FROM bars b JOIN sectors s USING (ticker))
SELECT sector, year(trade_date) AS year, ticker, count(*) AS n, CAST(sum(volume) AS BIGINT) AS volume, CAST(grouping_id(sector, year, ticker) AS BIGINT) AS level FROM (SELECT *, year(trade_date) AS year FROM a) GROUP BY GROUPING SETS ((sector), (sector, year), (ticker), ())""".replace("year(trade_date) AS year, ticker, count", "year, ticker, count")))
def a11(spark, d):
    a = views.bars(spark, d).join(views.sectors(spark, d), "ticker").withColumn("year", F.year("trade_date").cast("long"))
    g = a.groupingSets([[F.col("sector")], [F.col("sector"), F.col("year")], [F.col("ticker")], []], "sector", "year", "ticker")
    return g.agg(F.count("*").alias("n"), F.sum("volume").alias("volume"), F.grouping_id().alias("level"))


@query("a10_rollup_breadth", sql("bars sectors", "SELECT sector, ticker, count(*) AS n, count(DISTINCT trade_date) AS days, round(max(high), 4) AS top FROM bars JOIN sectors USING (ticker) GROUP BY ROLLUP (sector, ticker)"))
def a10(spark, d):
    a = views.bars(spark, d).join(views.sectors(spark, d), "ticker")
    return a.rollup("sector", "ticker").agg(F.count("*").alias("n"), F.countDistinct("trade_date").alias("days"), F.round(F.max("high"), 4).alias("top"))


@query("x14_walk_forward", sql("bars", BASE + """,
n AS (SELECT a.ticker, c.cond_id, a.trade_date, a.outcome, h.cond_id IS NOT NULL AS hit, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY a.ticker, c.cond_id) AS n
  FROM a JOIN c ON c.ticker = a.ticker LEFT JOIN h ON h.ticker = a.ticker AND h.trade_date = a.trade_date AND h.cond_id = c.cond_id WINDOW w AS (PARTITION BY a.ticker, c.cond_id ORDER BY a.trade_date)),
g AS (SELECT *, CASE WHEN i >= 30 AND n >= 34 AND (i - 30) // greatest(1, (n - 30) // 4) < 4 THEN (i - 30) // greatest(1, (n - 30) // 4) END AS fold FROM n WHERE hit AND outcome IS NOT NULL)
SELECT ticker, cond_id, count(*) AS n, round(avg(outcome), 4) AS expectancy, count(fold) AS oos_n, round(avg(outcome) FILTER (fold IS NOT NULL), 4) AS oos_expectancy, count(DISTINCT fold) AS folds,
  count(fold) >= 10 AND (avg(outcome) FILTER (fold IS NOT NULL) > 0) = (avg(outcome) > 0) AS survived FROM g GROUP BY ALL"""))
def x14(spark, d):
    _, conds, out, found = mined(spark, d)
    hit = found.select("ticker", "cond_id", "trade_date", F.lit(True).alias("hit"))
    rows = out.join(conds.select("ticker", "cond_id"), "ticker").join(hit, ["ticker", "cond_id", "trade_date"], "left").withColumns({"hit": F.coalesce("hit", F.lit(False)), "rule": F.struct("ticker", "cond_id")})
    return outcomes.walk_forward(rows, "rule", "trade_date", "outcome", "hit").select("rule.*", "n", r("expectancy", 4), "oos_n", r("oos_expectancy", 4), "folds", "survived")


@query("x15_threshold_variants", sql("bars", BASE + """,
sd AS (SELECT ticker, feature_id, stddev_pop(value) AS sd FROM f GROUP BY ALL),
v AS (SELECT c.ticker, c.feature_id, op, cond_id, delta, threshold + delta * sd AS threshold FROM c JOIN sd USING (ticker, feature_id) CROSS JOIN (SELECT unnest([0.0, -0.25, -0.1, 0.1, 0.25])::DOUBLE AS delta)),
e AS (SELECT v.ticker, cond_id, delta, count(*) AS n, avg(outcome) AS e FROM f JOIN v USING (ticker, feature_id) JOIN a ON a.ticker = f.ticker AND a.trade_date = f.trade_date
  WHERE outcome IS NOT NULL AND ((op = '<' AND value < threshold) OR (op = '>' AND value > threshold)) GROUP BY ALL),
b AS (SELECT *, max(CASE WHEN delta = 0 THEN e END) OVER (PARTITION BY ticker, cond_id) AS base FROM e)
SELECT ticker, cond_id, count(*) FILTER (delta <> 0 AND n >= 10 AND base IS NOT NULL) AS checks, count(*) FILTER (delta <> 0 AND n >= 10 AND (e > 0) = (base > 0)) AS agreeing FROM b GROUP BY ALL"""))
def x15(spark, d):
    long, conds, out, _ = mined(spark, d)
    return rules.threshold_variants(long, conds, out)


@query("x16_baselines", sql("bars", BASE + """
SELECT ticker, name, count(*) AS n, round(avg(outcome), 4) AS mean_outcome, round(avg(CAST(outcome > 0 AS DOUBLE)), 6) AS hit_rate
FROM (SELECT ticker, outcome, unnest([x for x in ['buy_and_hold', CASE WHEN r20 > 0 THEN 'momentum' END, CASE WHEN r20 < 0 THEN 'mean_reversion' END] if x IS NOT NULL]) AS name FROM a WHERE outcome IS NOT NULL) GROUP BY ALL HAVING count(*) >= 2"""))
def x16(spark, d):
    rows = plain(spark, d).withColumns({"past": features.ret(20), "outcome": targets.forward(10)})
    return rules.baselines(rows).select("ticker", "name", "n", r("mean_outcome", 4), r("hit_rate"))


@query("x17_cost_grid", sql("bars", BASE + """
SELECT ticker, cond_id, cost_bps, count(*) AS n, round(avg(outcome - cost_bps / 10000), 4) AS net_expectancy, round(avg(CAST(outcome - cost_bps / 10000 > 0 AS DOUBLE)), 6) AS net_hit_rate, avg(outcome - cost_bps / 10000) > 0 AS survives
FROM h CROSS JOIN (SELECT unnest([0.0, 5.0, 10.0, 20.0, 50.0, 100.0])::DOUBLE AS cost_bps) GROUP BY ALL"""))
def x17(spark, d):
    return outcomes.cost_grid(mined(spark, d)[3], ["ticker", "cond_id"]).select("ticker", "cond_id", "cost_bps", "n", r("net_expectancy", 4), r("net_hit_rate"), "survives")


@query("x18_regime_profile", sql("bars", BASE + """,
m AS (SELECT trade_date, avg(r20) AS trend, round(count(*) FILTER (r1 > 0)::DOUBLE / nullif(count(r1), 0), 9) AS breadth, row_number() OVER (ORDER BY trade_date) AS rn FROM a GROUP BY trade_date),
t AS (SELECT trade_date, rn, 'trend' AS dimension, trend AS value FROM m UNION ALL SELECT trade_date, rn, 'breadth', breadth FROM m),
p AS (SELECT x.trade_date, x.dimension, x.value, CASE WHEN count(y.value) = 119 THEN (count(*) FILTER (y.value < x.value) + 0.5::DOUBLE * count(*) FILTER (y.value = x.value)) / 119 END AS pct
  FROM t x LEFT JOIN t y ON y.dimension = x.dimension AND y.rn BETWEEN x.rn - 119 AND x.rn - 1 WHERE x.value IS NOT NULL GROUP BY ALL),
e AS (SELECT ticker, cond_id, dimension, least(2, floor(pct * 3)) AS bucket, count(*) AS n, avg(outcome) AS e FROM h JOIN p USING (trade_date) WHERE pct IS NOT NULL GROUP BY ALL)
SELECT ticker, cond_id, dimension, 3 AS k, count(*) FILTER (n >= 10) AS buckets, count(*) FILTER (n >= 10 AND e > 0) AS positive, round(min(e) FILTER (n >= 10), 4) AS worst,
  CASE WHEN count(*) FILTER (n >= 10) = 0 THEN 'insufficient' WHEN count(*) FILTER (n >= 10 AND e <= 0) = 0 THEN 'unconditional' WHEN count(*) FILTER (n >= 10 AND e > 0) = 0 THEN 'failing' WHEN count(*) FILTER (n >= 10 AND e > 0) = 1 THEN 'regime_specific' ELSE 'sensitive' END AS tag
FROM e GROUP BY ALL"""))
def x18(spark, d):
    found = mined(spark, d)[3]
    return rules.regime_profile(found, market.regime_buckets(plain(spark, d), ("breadth", "trend"), 3)).withColumn("worst", F.round("worst", 4))


@query("a4_a5_a7_seeded_tests")
def seeded(spark, d):
    """Every rule of every ticker; `rule` is the ticker and the condition."""
    found = mined(spark, d)[3].withColumn("rule", F.concat_ws("|", "ticker", "cond_id"))
    return outcomes.tested(found, "rule", iterations=200)


@query("a4_poisson_bootstrap")
def a4_poisson(spark, d):
    """Interval and sign of the mean ten-day return of every ticker, over all its bars."""
    rows = plain(spark, d).select("ticker", "trade_date", targets.forward(10).alias("outcome"))
    out = outcomes.poisson_bootstrap(rows, ["ticker"], ["trade_date"])
    return out.select("ticker", "n", r("mean", 4), r("low", 4), r("high", 4), "p_value")


@query("x20_discovery")
def x20(spark, d):
    """Single and paired rules, their t-test p-values, family correction and false-discovery control per ticker."""
    found = mined(spark, d)[3]
    one = found.groupBy("ticker", F.col("cond_id").alias("rule")).agg(F.count("*").alias("n"), F.avg("outcome").alias("e"), F.stddev_samp("outcome").alias("sd"))
    b = found.select("ticker", "trade_date", F.col("cond_id").alias("c2"), F.col("feature_id").alias("f2"))
    two = found.join(b, ["ticker", "trade_date"]).where("cond_id < c2 and feature_id <> f2").groupBy("ticker", F.concat_ws("&", "cond_id", "c2").alias("rule")).agg(F.count("*").alias("n"), F.avg("outcome").alias("e"), F.stddev_samp("outcome").alias("sd"))
    rows = one.unionByName(two).where(F.col("n") >= rules.LEAST)
    p = outcomes.t_test(F.col("e"), F.col("sd"), F.col("n"))
    size = F.count("*").over(Window.partitionBy("ticker", F.substring_index("rule", ":", 1)))
    rows = rows.withColumn("p", F.round(outcomes.bonferroni(F.coalesce(p, F.lit(1.0)), size), 9)).select("ticker", "rule", "n", F.round("e", 4).alias("expectancy"), "p")
    return outcomes.fdr_mask(rows, "p", 0.05, within=["ticker"])


@query("ev4_price_events", sql("bars", f"""
WITH a AS (SELECT ticker, trade_date, {RET.format(n=1)} AS m FROM bars WINDOW w AS ({W}))
SELECT 'event_' || substr(sha256('market|large_price_move|' || ticker || '|' || CAST(trade_date AS VARCHAR)), 1, 20) AS event_id, trade_date AS event_date, CASE WHEN abs(m) >= 0.06 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, round(m, 4) AS value FROM a WHERE abs(m) >= 0.03"""))
def ev4(spark, d):
    return events.from_prices(views.bars(spark, d)).select("event_id", "event_date", "severity", r("value", 4))


@query("ev1_ev2_filing_and_macro_events", sql("corporate_events macro", """
WITH m AS (SELECT series_id, observation_date, (value - lag(value) OVER w) / nullif(lag(value) OVER w, 0) AS p FROM macro WINDOW w AS (PARTITION BY series_id ORDER BY observation_date))
SELECT 'corporate' AS event_type, CASE event_type WHEN 'SPLIT' THEN 'stock_split' ELSE 'dividend' END AS subtype, event_date, 'MEDIUM' AS severity, count(*) AS n FROM corporate_events GROUP BY ALL
UNION ALL SELECT 'macroeconomic', 'unknown', observation_date, CASE WHEN abs(p) >= 0.02 THEN 'HIGH' ELSE 'MEDIUM' END, count(*) FROM m WHERE abs(p) >= 0.01 GROUP BY ALL"""))
def ev12(spark, d):
    e = events.from_filings(views.corporate_events(spark, d)).unionByName(events.from_macro(views.macro(spark, d)))
    return e.groupBy("event_type", "subtype", "event_date", "severity").agg(F.count("*").alias("n"))


@query("ev3_news_events", "SELECT subtype, source, count(*) AS n FROM (SELECT CASE WHEN doc_id % 4 = 0 THEN 'macro_news' ELSE 'company_news' END AS subtype, source FROM documents) GROUP BY ALL")
def ev3(spark, d):
    news = table(spark, d, "documents").select(F.to_date(F.lit("2024-01-01")).alias("published_at"), "source", F.substring_index("text", "\n", 1).alias("headline"), F.when(F.col("doc_id") % 4 != 0, F.array(F.concat(F.lit("T"), F.col("doc_id") % 9))).alias("tickers"))
    return events.from_news(news).groupBy("subtype", "source").agg(F.count("*").alias("n"))


def reports(spark, d):
    e = table(spark, d, "events")
    return e.select(
        F.concat(F.lit("e"), F.col("user_id") % 40).alias("event_id"), F.col("event_id").alias("seq"), F.concat(F.lit("s"), F.col("event_id") % 4).alias("source"), F.round(0.5 + (F.col("event_id") % 5) / 10.0, 2).alias("confidence"),
        F.create_map(F.lit("k"), (F.col("user_id") % 3).cast("string")).alias("metadata"), F.when(F.col("event_id") % 997 == 0, "RETRACTED").alias("action"),
    )


@query("st1_event_register")
def st1(spark, d):
    return events.register(reports(spark, d))


@query("w35_event_risk", sql("bars", f"""
WITH a AS (SELECT ticker, trade_date, {RET.format(n=1)} AS m FROM bars WINDOW w AS ({W})), e AS (SELECT ticker, max(CASE WHEN abs(m) >= 0.06 THEN 3 ELSE 2 END) AS rank FROM a WHERE abs(m) >= 0.03 GROUP BY 1)
SELECT ticker, least(0.3, CASE rank WHEN 3 THEN 0.12 ELSE 0.05 END)::DOUBLE AS event_risk FROM e"""))
def w35(spark, d):
    e = events.from_prices(views.bars(spark, d)).withColumn("ticker", F.get("entities", F.lit(0)))
    return events.event_risk(events.representative(e, ["ticker"]), ["ticker"])


@query("a16_performance", sql("decisions", """
WITH x AS (SELECT *, realized_return - benchmark_return AS excess, sum(ln(1 + realized_return)) OVER w AS lw FROM decisions WINDOW w AS (PARTITION BY horizon ORDER BY decided_on, decision_id)),
y AS (SELECT *, exp(lw - greatest(0, max(lw) OVER (PARTITION BY horizon ORDER BY decided_on, decision_id))) - 1 AS dd FROM x)
SELECT horizon, count(*) AS decisions, round(avg(CAST(excess > 0 AS DOUBLE)), 6) AS hit_rate, round(avg(realized_return), 6) AS mean_realized, round(avg(excess), 6) AS mean_excess, round(quantile_cont(excess, 0.5), 6) AS median_excess,
  round(avg(excess) - 1.645 * stddev_samp(excess) / sqrt(count(*)), 6) AS excess_lower_95, round(least(0, min(dd)), 6) AS max_drawdown, round(abs(avg(expected_return) - avg(realized_return)), 6) AS calibration_error, CASE WHEN count(*) >= 30 THEN 'sufficient' ELSE 'insufficient_sample' END AS sample_status
FROM y GROUP BY horizon"""))
def a16(spark, d):
    p = decisions.performance(views.decisions(spark, d))
    return p.select("horizon", "decisions", *[r(c) for c in ("hit_rate", "mean_realized", "mean_excess", "median_excess", "excess_lower_95", "max_drawdown", "calibration_error")], "sample_status")


@query("a17_calibration", sql("decisions", """
WITH x AS (SELECT horizon, confidence, CAST(realized_return - benchmark_return > 0 AS DOUBLE) AS hit, least(floor(confidence * 10 + 1e-12), 9) AS bin FROM decisions),
b AS (SELECT horizon, bin, count(*) AS n, avg(confidence) AS c, avg(hit) AS h FROM x GROUP BY ALL)
SELECT horizon, (SELECT count(*) FROM x WHERE x.horizon = b.horizon) AS n, round((SELECT avg(power(confidence - hit, 2)) FROM x WHERE x.horizon = b.horizon), 6) AS brier, round(sum(n * abs(c - h)) / sum(n), 6) AS ece FROM b GROUP BY horizon"""))
def a17(spark, d):
    return decisions.calibration(views.decisions(spark, d)).select("horizon", "n", r("brier"), r("ece"))


@query("a18_liquidity_floor", sql("bars", "SELECT p.ticker, round(avg(close * volume), 2) AS traded FROM (SELECT DISTINCT p_brand AS ticker FROM part) p LEFT JOIN bars b USING (ticker) GROUP BY 1 HAVING coalesce(avg(close * volume), 0) < 200000"))
def a18(spark, d):
    universe = table(spark, d, "part").select(F.col("p_brand").alias("ticker")).distinct()
    return decisions.illiquid(universe, views.bars(spark, d), 200_000.0).select("ticker", r("traded", 2))


SCORES = """sc AS (SELECT c_nationkey AS book, CAST(c_custkey AS VARCHAR) AS ticker, 'S' || CAST(c_custkey % 5 AS VARCHAR) AS sector, round(c_acctbal / 1000, 3) AS score, 0.05 + (c_custkey % 4) * 0.05::DOUBLE AS max_position, 0.1 + (c_custkey % 7) * 0.02::DOUBLE AS expected_risk FROM customer)"""


def scores(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("book"), F.col("c_custkey").cast("string").alias("ticker"), F.concat(F.lit("S"), F.col("c_custkey") % 5).alias("sector"), F.round(F.col("c_acctbal") / 1000, 3).alias("score"), (0.05 + (F.col("c_custkey") % 4) * 0.05).alias("max_position"), (0.1 + (F.col("c_custkey") % 7) * 0.02).alias("expected_risk"))


@query("d5_portfolio_weights", f"WITH {SCORES} SELECT book, ticker, round(least(score / sum(score) OVER (PARTITION BY book), 0.25, max_position), 9) AS weight FROM sc WHERE score > 0")
def d5(spark, d):
    return decisions.construct(scores(spark, d), ["book"]).select("book", "ticker", r("weight", 9))


@query("a15_portfolio_validation", f"""WITH {SCORES}, p AS (SELECT book, ticker, sector, expected_risk, least(score / sum(score) OVER (PARTITION BY book), 0.25, max_position) AS weight FROM sc WHERE score > 0),
k AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY weight DESC, ticker) AS i FROM p), s AS (SELECT book, max(w) AS mw FROM (SELECT book, sector, sum(weight) AS w FROM p GROUP BY ALL) GROUP BY 1)
SELECT book, round(sum(weight), 6) AS invested, round(sum(weight * weight), 6) AS herfindahl, arg_min(ticker, i) AS max_ticker, round(sum(weight) FILTER (i <= 3), 6) AS top_3, round(sum(weight * expected_risk) / sum(weight), 6) AS downside, round(any_value(mw), 6) AS max_sector_weight,
  CASE WHEN sum(weight * weight) > 0.25 THEN 'concentrated' ELSE 'diversified' END AS status FROM k JOIN s USING (book) GROUP BY book""")
def a15(spark, d):
    v = decisions.validate_portfolio(decisions.construct(scores(spark, d), ["book"]), ["book"])
    return v.select("book", r("invested"), r("herfindahl"), "max_ticker", r("top_3"), r("downside"), r("max_sector_weight"), "status")


@query("d8_concentration_caps")
def d8(spark, d):
    w = decisions.construct(scores(spark, d), ["book"]).select("book", "ticker", "sector", "weight")
    return decisions.concentration_caps(w, "book").withColumns({"weight": F.round("weight", 9), "capped": F.round("capped", 9)})


@query("d10_capital_flows", """
WITH p AS (SELECT n_regionkey AS book, n_name AS ticker, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS rank, 0.02 * (n_nationkey % 7)::DOUBLE AS current, 0.03 * (n_nationkey * 3 % 7)::DOUBLE AS target FROM nation),
c AS (SELECT book, greatest(0, 1 - sum(current)) AS cash FROM p GROUP BY 1),
dm AS (SELECT book, ticker AS t, sum(target - current) OVER w - (target - current) AS lo, sum(target - current) OVER w AS hi FROM p WHERE target - current > 1e-9 WINDOW w AS (PARTITION BY book ORDER BY rank)),
sp AS (SELECT book, ticker AS f, sum(current - target) OVER w - (current - target) + cash AS lo, sum(current - target) OVER w + cash AS hi FROM p JOIN c USING (book) WHERE current - target > 1e-9 WINDOW w AS (PARTITION BY book ORDER BY rank DESC) UNION ALL SELECT book, NULL, 0, cash FROM c WHERE cash > 1e-9),
top AS (SELECT book, max(hi) AS d FROM dm GROUP BY 1)
SELECT dm.book, f AS from_ticker, t AS to_ticker, round(least(dm.hi, sp.hi) - greatest(dm.lo, sp.lo), 6) AS amount FROM dm JOIN sp USING (book) WHERE least(dm.hi, sp.hi) - greatest(dm.lo, sp.lo) > 1e-9
UNION ALL SELECT sp.book, f, NULL, round(sp.hi - greatest(sp.lo, coalesce(d, 0)), 6) FROM sp LEFT JOIN top USING (book) WHERE f IS NOT NULL AND sp.hi - greatest(sp.lo, coalesce(d, 0)) > 1e-9""")
def d10(spark, d):
    n = table(spark, d, "nation")
    p = n.select(F.col("n_regionkey").alias("book"), F.col("n_name").alias("ticker"), F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_name")).alias("rank"), (0.02 * (F.col("n_nationkey") % 7)).alias("current"), (0.03 * (F.col("n_nationkey") * 3 % 7)).alias("target"))
    return decisions.capital_flows(p, ["book"]).withColumn("amount", F.round("amount", 6))


@query("d6_macro_overlay", sql("macro", """
WITH l AS (SELECT series_id, max(value) FILTER (i = 1) AS now, max(value) FILTER (i = 2) AS before FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY observation_date DESC) AS i FROM macro) GROUP BY 1),
f AS (SELECT * FROM (VALUES ('a', 1, '1-URGENT', 0.2, -1), ('a', 2, '2-HIGH', 0.2, -1), ('b', 1, 'missing', 0.3, 1), ('b', 2, '3-MEDIUM', 0.3, 1), ('c', 1, '5-LOW', 0.1, 1)) t(factor, pos, series_id, weight, direction)),
u AS (SELECT factor, arg_min(weight, pos) AS w, arg_min(direction * sign(now - before), pos) AS s FROM f JOIN l USING (series_id) WHERE before IS NOT NULL GROUP BY 1)
SELECT count(*) AS factors, round(sum(w)::DOUBLE, 6) AS available, round((sum(w * s) / sum(w))::DOUBLE, 6) AS score, CASE WHEN sum(w * s) / sum(w) > 0.25 THEN 'supportive' WHEN sum(w * s) / sum(w) >= -0.25 THEN 'cautious' ELSE 'defensive' END AS decision FROM u"""))
def d6(spark, d):
    f = spark.sql("SELECT * FROM VALUES ('a', 1, '1-URGENT', 0.2D, -1), ('a', 2, '2-HIGH', 0.2D, -1), ('b', 1, 'missing', 0.3D, 1), ('b', 2, '3-MEDIUM', 0.3D, 1), ('c', 1, '5-LOW', 0.1D, 1) AS t(factor, position, series_id, weight, direction)")
    return decisions.macro_overlay(views.macro(spark, d), f).select("factors", r("available"), r("score"), "decision")


@query("a28_weighted_view", sql("decisions", "SELECT horizon, round(sum(confidence * expected_return) / sum(confidence), 6) AS expected_return, round(least(avg(confidence), max(confidence)), 6) AS confidence FROM decisions WHERE confidence > 0 GROUP BY 1"))
def a28(spark, d):
    k = views.decisions(spark, d).withColumn("expected_risk", F.lit(0.1))
    return decisions.weighted_view(k, ["horizon"]).select("horizon", r("expected_return"), r("confidence"))


@query("f13_quality_gate", sql("decisions", "SELECT decision_id, CAST((confidence < 0.3)::INT + (expected_return <= 0)::INT + (decided_on > DATE '2000-01-01')::INT AS INTEGER) AS n_failed, least(0.05, greatest(0.01, confidence * 0.05)) AS position_cap FROM decisions"))
def f13(spark, d):
    q = views.decisions(spark, d)
    gate = decisions.quality_gate({"confident": F.col("confidence") >= 0.3, "positive": F.col("expected_return") > 0, "fresh": F.col("decided_on") <= F.lit("2000-01-01").cast("date")}, F.col("confidence"))
    return q.withColumns(gate).select("decision_id", F.size("failed_checks").alias("n_failed"), "position_cap")


@query("a27_trailing_year", sql("financials", """
WITH e AS (SELECT ticker, period_end_date, row_number() OVER (PARTITION BY ticker ORDER BY period_end_date DESC) AS i FROM (SELECT DISTINCT ticker, period_end_date FROM financials)), l AS (SELECT * FROM e WHERE i <= 4)
SELECT ticker, line_item, round(CASE WHEN line_item IN ('revenue', 'operating_income', 'net_income') THEN sum(value) WHEN line_item = 'shares_outstanding' THEN avg(value) ELSE arg_max(value, period_end_date) END, 2) AS value, max(period_end_date) AS period_end_date
FROM financials JOIN l USING (ticker, period_end_date) GROUP BY ticker, line_item HAVING count(*) = 4"""))
def a27(spark, d):
    return valuation.trailing_year(views.financials(spark, d)).select("ticker", "line_item", r("value", 2), "period_end_date")


@query("d1_fair_value")
def d1(spark, d):
    """The tables state five items; the per-share and cash items the models read are derived from them by fixed shares."""
    items = views.financials(spark, d)
    wide = items.groupBy("ticker", "period_end_date", "period_type").pivot("line_item", ["net_income", "operating_income", "shares_outstanding"]).agg(F.first("value"))
    per_share = F.try_divide("net_income", "shares_outstanding")
    made = F.array(*[F.struct(F.lit(n).alias("line_item"), c.alias("value")) for n, c in (("eps_basic", per_share), ("dividend_per_share", per_share * 0.3), ("free_cash_flow", F.col("net_income") * 0.8), ("ebitda", F.col("operating_income") * 1.1))])
    more = wide.select("ticker", "period_end_date", "period_type", F.inline(made))
    last = F.add_months(F.max("period_end_date"), -6)
    as_of = str(items.agg(last.alias("d")).first()["d"] or "2000-01-01")  # one date: some quarters before the end
    return valuation.fair_values(valuation.facts(items.select(*more.columns).unionByName(more), views.sectors(spark, d), as_of))


@query("g1_neighbourhood", sql("edges", """
l AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
w AS (SELECT 'region:1' AS node, 0 AS hop UNION SELECT l.dst, hop + 1 FROM w JOIN l ON l.src = w.node WHERE hop < 2)
SELECT node, CAST(min(hop) AS INTEGER) AS hop FROM w GROUP BY node""", recursive=True).replace("FROM supplier)\nl AS", "FROM supplier),\nl AS"))
def g1(spark, d):
    return graph.within(views.edges(spark, d), spark.sql("SELECT 'region:1' AS node"), 2)


@query("g1_shortest_paths", sql("edges", """
l AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
p AS (SELECT 'supplier:1' AS node, 0 AS hop, ['supplier:1'] AS path UNION ALL SELECT l.dst, hop + 1, list_append(path, l.dst) FROM p JOIN l ON l.src = p.node WHERE hop < 4 AND NOT list_contains(path, l.dst))
SELECT node, hop, array_to_string(path, '>') AS path FROM p QUALIFY row_number() OVER (PARTITION BY node ORDER BY hop, path) = 1""", recursive=True).replace("FROM supplier)\nl AS", "FROM supplier),\nl AS"))
def g1_paths(spark, d):
    return graph.shortest_paths(views.edges(spark, d), spark.sql("SELECT 'supplier:1' AS node"), 4).select("node", "hop", F.array_join("path", ">").alias("path"))


@query("a30_network_stats", sql("edges", """
WITH e AS (SELECT DISTINCT src, dst FROM edges UNION SELECT dst, src FROM edges WHERE kind = 'LOCATED_IN'), o AS (SELECT src, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, src) AS r, count(*) OVER () AS k FROM e GROUP BY 1)
SELECT (SELECT count(*) FROM e) AS edges, round((SELECT count(*) FROM e a JOIN e b ON a.src = b.dst AND a.dst = b.src) / (SELECT count(*) FROM e)::DOUBLE, 6) AS reciprocity, (SELECT max(n) FROM o) AS max_out, (SELECT max(n) FROM (SELECT count(*) AS n FROM e GROUP BY dst)) AS max_in,
  round((SELECT sum(n) FROM o WHERE r <= ceil(k * 0.1)) / (SELECT count(*) FROM e)::DOUBLE, 6) AS top_10pct_share"""))
def a30(spark, d):
    e = views.edges(spark, d)
    both = e.select("src", "dst").unionByName(e.where("kind = 'LOCATED_IN'").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    s = graph.network_stats(both)
    return s.withColumns({"reciprocity": F.round("reciprocity", 6), "top_10pct_share": F.round("top_10pct_share", 6)})


@query("a30_leader_shares", sql("edges", """
WITH e AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges WHERE kind = 'LOCATED_IN'),
o AS (SELECT src, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, src) AS r, count(*) OVER () AS k FROM e GROUP BY 1), t AS (SELECT count(*) AS edges FROM e), d AS (SELECT DISTINCT src, dst FROM e)
SELECT any_value(edges) AS edges, (SELECT count(*) FROM (SELECT src FROM e UNION SELECT dst FROM e)) AS nodes, round(sum(n) FILTER (r <= greatest(1, ceil(k * 0.01))) / any_value(edges)::DOUBLE, 6) AS top_1pct_share,
  round(sum(n) FILTER (r <= greatest(1, ceil(k * 0.05))) / any_value(edges)::DOUBLE, 6) AS top_5pct_share, round(sum(n) FILTER (r <= greatest(1, ceil(k * 0.1))) / any_value(edges)::DOUBLE, 6) AS top_10pct_share,
  median(n)::DOUBLE AS median_leader, max(n) AS max_out_degree, (SELECT max(n) FROM (SELECT count(*) AS n FROM e GROUP BY dst)) AS max_in_degree, (SELECT count(*) // 2 FROM d a JOIN d b ON a.src = b.dst AND a.dst = b.src) AS reciprocal_pairs FROM o, t"""))
def a30_shares(spark, d):
    e = views.edges(spark, d)
    both = e.select("src", "dst").unionByName(e.where("kind = 'LOCATED_IN'").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    s = graph.leader_shares(both)
    return s.withColumns({c: F.round(c, 6) for c in s.columns if c.endswith("share")})


@query("a30_permutation_null", sql("edges", """
WITH e AS (SELECT DISTINCT src, dst FROM edges), v AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS place, count(*) OVER () AS total FROM (SELECT src AS node FROM e UNION SELECT dst FROM e)),
w AS (SELECT src, dst, place, total, p, CAST('0x' || substr(md5('42|' || p || '|' || src || '|' || dst || '|1'), 1, 8) AS BIGINT) % total AS d1, CAST('0x' || substr(md5('42|' || p || '|' || src || '|' || dst || '|2'), 1, 8) AS BIGINT) % total AS d2
      FROM e JOIN v ON node = src, generate_series(1, 200) g(p)),
m AS (SELECT p, max(n) AS m FROM (SELECT p, CASE WHEN d1 = place THEN d2 ELSE d1 END AS drawn, count(*) AS n FROM w GROUP BY ALL) GROUP BY 1), o AS (SELECT max(n) AS observed FROM (SELECT count(*) AS n FROM e GROUP BY dst))
SELECT count(*) AS permutations, any_value(observed) AS observed, round(avg(m), 6) AS null_mean, round(quantile_cont(m, 0.95), 6) AS null_p95, round((1 + count(*) FILTER (m >= observed)) / (1 + count(*))::DOUBLE, 6) AS p_value FROM m, o"""))
def a30_null(spark, d):
    s = graph.permuted_max_in_degree(views.edges(spark, d).select("src", "dst").distinct())
    return s.withColumns({c: F.round(c, 6) for c in ("null_mean", "null_p95", "p_value")})


@query("g3_merged_ancestors", """
WITH RECURSIVE p AS (SELECT DISTINCT node, parent FROM (SELECT c_custkey AS node, unnest([c_custkey // 2, c_custkey // 3]) AS parent FROM customer) WHERE parent > 0 AND parent <> node),
l AS (SELECT node, parent AS ancestor, 1 AS distance FROM p UNION SELECT l.node, p.parent, distance + 1 FROM l JOIN p ON p.node = l.ancestor)
SELECT node, ancestor, CAST(min(distance) AS INTEGER) AS distance FROM l GROUP BY ALL""")
def g3_merged(spark, d):
    """Customers as merges of two others: all ancestors by any path."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("node"), F.explode(F.array(F.expr("c_custkey div 2"), F.expr("c_custkey div 3"))).alias("parent"))
    return graph.ancestors(c.where("parent > 0"))


@query("g3_lineage", """
WITH RECURSIVE p AS (SELECT c_custkey AS node, CASE WHEN c_custkey > 1 THEN c_custkey // 2 END AS parent FROM customer),
l AS (SELECT node, parent AS ancestor, 1 AS distance FROM p WHERE parent IS NOT NULL UNION ALL SELECT l.node, p.parent, distance + 1 FROM l JOIN p ON p.node = l.ancestor WHERE p.parent IS NOT NULL)
SELECT node, ancestor, CAST(distance AS INTEGER) AS distance FROM l""")
def g3(spark, d):
    p = table(spark, d, "customer").select(F.col("c_custkey").alias("node"), F.expr("case when c_custkey > 1 then c_custkey div 2 end").alias("parent"))
    return graph.lineage(p)


@query("d17_replay_diff", "SELECT l_orderkey, count(*) AS n FROM (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber <= 5 EXCEPT ALL SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber <= 3) GROUP BY 1")
def d17(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    return li.where("l_linenumber <= 5").exceptAll(li.where("l_linenumber <= 3")).groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("t1_top_k", sql("bars", f"WITH a AS (SELECT *, {RET.format(n=5)} AS r5 FROM bars WINDOW w AS ({W})) SELECT trade_date, ticker, round(r5, 4) AS r5 FROM a WHERE r5 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY trade_date ORDER BY r5 DESC, ticker) <= 3"))
def t1(spark, d):
    rows = plain(spark, d).withColumn("r5", features.ret(5)).where("r5 is not null")
    rank = F.row_number().over(Window.partitionBy("trade_date").orderBy(F.col("r5").desc(), "ticker"))
    return rows.withColumn("k", rank).where("k <= 3").select("trade_date", "ticker", r("r5", 4))
