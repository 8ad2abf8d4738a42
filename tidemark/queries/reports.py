"""Queries over reviews, reports and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decisions, events, experiments, reporting, research, valuation
from ..plans import views
from ..plans.views import sql, table
from .market import RET, W, plain, r
from .registry import query
from .research import daily
from .rules import SCORES, scores


@query("d2_valuation_metrics", "SELECT p_brand AS ticker, round(max(p_retailprice) * sum(p_size), 4) AS market_cap, round(max(p_retailprice) * sum(p_size) + count(*) - 5, 4) AS enterprise_value, round((max(p_retailprice) * sum(p_size) + count(*) - 5) / avg(p_retailprice), 4) AS ev_ebitda FROM part GROUP BY 1")
def d2(spark, d):
    f = table(spark, d, "part").groupBy(F.col("p_brand").alias("ticker")).agg(F.max("p_retailprice").alias("close"), F.sum("p_size").alias("shares"), F.count("*").alias("debt"), F.lit(5).alias("cash"), F.avg("p_retailprice").alias("ebitda"), F.lit(1.0).alias("equity"))
    return valuation.metrics(f).select("ticker", r("market_cap", 4), r("enterprise_value", 4), r("ev_ebitda", 4))


@query("d3_blended_return", sql("decisions", """
WITH p AS (SELECT decision_id, expected_return AS e, 50.0 + decision_id % 40 AS price, CASE WHEN decision_id % 3 > 0 THEN 70.0 END AS fair, CASE WHEN decision_id % 4 > 0 THEN 1.0 + decision_id % 20 END AS pe FROM decisions),
m AS (SELECT *, CASE WHEN fair IS NULL THEN e ELSE 0.8 * e + 0.2 * least(2, greatest(-1, fair / price - 1)) END AS x FROM p)
SELECT decision_id, round((CASE WHEN pe IS NULL THEN x ELSE 0.9 * x + 0.1 * least(0.5, greatest(-0.5, 1 / pe - 0.125)) END)::DOUBLE, 6) AS expected_return FROM m"""))
def d3(spark, d):
    k = F.col("decision_id")
    p = views.decisions(spark, d).select("decision_id", "expected_return", (50.0 + k % 40).alias("price"), F.when(k % 3 > 0, 70.0).alias("fair_value"), F.when(k % 4 > 0, 1.0 + k % 20).alias("pe"))
    return research.blended(p).select("decision_id", r("expected_return"))


@query("d18_portfolio_summary", f"""WITH {SCORES}, p AS (SELECT book, score, expected_risk, least(score / sum(score) OVER (PARTITION BY book), 0.25, max_position) AS weight FROM sc WHERE score > 0)
SELECT book, count(*) AS positions, round(sum(weight), 6) AS invested, round(greatest(0, 1 - sum(weight)), 6) AS cash, round(sum(weight * score) / sum(weight), 6) AS expected_return, round(sum(weight * expected_risk) / sum(weight), 6) AS expected_risk FROM p GROUP BY book""")
def d18(spark, d):
    p = decisions.construct(scores(spark, d), ["book"]).withColumn("expected_return", F.col("score"))
    return reporting.portfolio_summary(p, ["book"]).select("book", "positions", r("invested"), r("cash"), r("expected_return"), r("expected_risk"))


@query("r1_review_board", sql("decisions", "SELECT decision_id, confidence >= 0.5 AND expected_return > 0 AND realized_return IS NOT NULL AND decided_on >= DATE '1996-01-01' AS approved FROM decisions"))
def r1(spark, d):
    q = views.decisions(spark, d)
    board = {"statistical": F.col("confidence") >= 0.5, "economic": F.col("expected_return") > 0, "data": F.col("realized_return").isNotNull(), "timing": F.col("decided_on") >= F.lit("1996-01-01").cast("date")}
    return reporting.reviewed(q, board).select("decision_id", "approved")


@query("r2_adversarial_confidence", sql("decisions", "SELECT decision_id, round(least(1, greatest(0, confidence - CASE WHEN decision_id % 3 = 0 THEN 0.2 ELSE 0 END - CASE WHEN expected_return < 0 THEN 0.1 ELSE 0 END)), 6)::DOUBLE AS confidence_after FROM decisions"))
def r2(spark, d):
    attacks = {"coincidence": (F.col("decision_id") % 3 == 0, -0.2), "look_ahead": (F.col("expected_return") < 0, -0.1)}
    return reporting.challenged(views.decisions(spark, d), attacks).select("decision_id", r("confidence_after"))


@query("a23_data_gaps", sql("bars financials sectors", """
WITH l AS (SELECT s.ticker, b.ticker IS NOT NULL AS prices, f.ticker IS NOT NULL AS statements, s.sector <> 'S0' AS classified FROM sectors s LEFT JOIN (SELECT DISTINCT ticker FROM bars WHERE volume > 95) b USING (ticker) LEFT JOIN (SELECT DISTINCT ticker FROM financials WHERE value < 0) f USING (ticker))
SELECT layer, round(avg(CAST(has AS DOUBLE)), 6) AS coverage, count(*) FILTER (NOT has) AS missing FROM (UNPIVOT l ON prices, statements, classified INTO NAME layer VALUE has) GROUP BY layer"""))
def a23(spark, d):
    have = lambda df, n: df.select("ticker").distinct().withColumn(n, F.lit(True))
    s = views.sectors(spark, d).withColumn("classified", F.col("sector") != "S0")
    l = s.join(have(views.bars(spark, d).where("volume > 95"), "prices"), "ticker", "left").join(have(views.financials(spark, d).where("value < 0"), "statements"), "ticker", "left")
    return reporting.gap_report(l, "ticker", ["prices", "statements", "classified"]).withColumn("coverage", F.round("coverage", 6))


@query("a24_maturity", sql("decisions", "WITH p AS (SELECT year(decided_on) AS year, horizon AS part, CASE WHEN count(*) > 330 THEN 3 WHEN count(*) > 20 THEN 2 ELSE 1 END AS level FROM decisions GROUP BY ALL) SELECT year, CAST(min(level) AS INTEGER) AS level, arg_min(part, (level, part)) AS weakest FROM p GROUP BY year"))
def a24(spark, d):
    n = F.count("*")
    p = views.decisions(spark, d).groupBy(F.year("decided_on").cast("long").alias("year"), F.col("horizon").alias("part")).agg(F.when(n > 330, 3).when(n > 20, 2).otherwise(1).alias("level"))
    return reporting.maturity(p, "year", "level")


@query("ev5_impact_horizons", sql("bars", f"""
WITH a AS (SELECT ticker, trade_date, {RET.format(n=1)} AS m FROM bars WINDOW w AS ({W}))
SELECT horizon, count(*) AS n FROM (SELECT unnest(['MICRO', 'SWING']) AS horizon FROM a WHERE abs(m) >= 0.03) GROUP BY 1"""))
def ev5(spark, d):
    e = reporting.impact(events.from_prices(views.bars(spark, d)))
    return e.select(F.explode("impact_horizons").alias("horizon")).groupBy("horizon").agg(F.count("*").alias("n"))


@query("g2_event_edges", sql("bars", f"""
WITH a AS (SELECT ticker, trade_date, {RET.format(n=1)} AS m FROM bars WINDOW w AS ({W})), e AS (SELECT * FROM a WHERE abs(m) >= 0.03)
SELECT dst, kind, count(*) AS n FROM (SELECT ticker AS dst, 'AFFECTS' AS kind FROM e UNION ALL SELECT 'price_history', 'REPORTED_BY' FROM e) GROUP BY ALL"""))
def g2(spark, d):
    return reporting.event_edges(events.from_prices(views.bars(spark, d))).groupBy("dst", "kind").agg(F.count("*").alias("n"))


@query("g4_label_search", "SELECT n_nationkey, n_name AS label FROM nation WHERE contains(lower(n_name), '1')")
def g4(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("label"))
    return reporting.found_by_label(n, "1")


@query("q3_method_ranking", "SELECT p_brand AS target, method, round((0.6 * a + 0.4 * b)::DOUBLE, 9) AS score, row_number() OVER (PARTITION BY p_brand ORDER BY round((0.6 * a + 0.4 * b)::DOUBLE, 9) DESC, method) AS rank FROM (SELECT p_brand, p_type AS method, avg(p_size % 10)::DOUBLE / 10 AS a, count(*) / 100.0::DOUBLE AS b FROM part GROUP BY ALL)")
def q3(spark, d):
    m = table(spark, d, "part").groupBy(F.col("p_brand").alias("target"), F.col("p_type").alias("method")).agg((F.avg(F.col("p_size") % 10) / 10).alias("success"), (F.count("*") / 100.0).alias("speed"))
    return reporting.ranked_methods(m, "target", {"success": 0.6, "speed": 0.4}).select("target", "method", "score", "rank")


@query("x13_chronological_split", sql("bars", f"""
WITH a AS (SELECT ticker, trade_date, {RET.format(n=1)} AS x FROM bars WINDOW w AS ({W})), k AS (SELECT ticker, trade_date, row_number() OVER ({W}) - 1 AS i, count(*) OVER (PARTITION BY ticker) AS n FROM a WHERE x IS NOT NULL)
SELECT ticker, count(*) FILTER (i < floor(n * 0.7)) AS train, count(*) FILTER (i >= floor(n * 0.7)) AS test, max(trade_date) FILTER (i < floor(n * 0.7)) AS train_end FROM k GROUP BY ticker"""))
def x13(spark, d):
    early = F.col("_i") < F.floor(F.col("_n") * 0.7)
    k = experiments.numbered(daily(spark, d), "ticker", "trade_date")
    return k.groupBy("ticker").agg(F.count_if(early).alias("train"), F.count_if(~early).alias("test"), F.max(F.when(early, F.col("trade_date"))).alias("train_end"))


@query("t9_study_control_split", sql("bars sectors", "SELECT sector, count(DISTINCT b.ticker) FILTER (b.ticker IN (SELECT p_brand FROM part WHERE p_size = 7)) AS study, count(DISTINCT b.ticker) FILTER (b.ticker NOT IN (SELECT p_brand FROM part WHERE p_size = 7)) AS control FROM bars b JOIN sectors USING (ticker) GROUP BY sector"))
def t9(spark, d):
    study = table(spark, d, "part").where("p_size = 7").select(F.col("p_brand").alias("ticker"), F.lit(True).alias("s")).distinct()
    rows = plain(spark, d).select("ticker").distinct().join(views.sectors(spark, d), "ticker").join(study, "ticker", "left")
    return rows.groupBy("sector").agg(F.count("s").alias("study"), F.count_if(F.col("s").isNull()).alias("control"))
