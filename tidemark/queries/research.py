"""Queries over experiments, research decisions, agents and reporting."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import agents, asof, experiments, features, graph, lifecycles, market, reporting, research, rules, storage, targets
from ..plans import views
from ..plans.views import sql, table
from .market import RET, W, plain, r
from .registry import query

RETURNS = f"WITH a AS (SELECT ticker, trade_date, close, volume, {RET.format(n=1)} AS x FROM bars WINDOW w AS ({W})), k AS (SELECT ticker, trade_date, x, row_number() OVER ({W}) - 1 AS i, count(*) OVER (PARTITION BY ticker) AS n FROM a WHERE x IS NOT NULL)"


def daily(spark, d):
    """Daily returns of each ticker."""
    return plain(spark, d).withColumn("r", features.ret(1)).where("r is not null").select("ticker", "trade_date", "r")


@query("x4_k_fold", sql("bars", RETURNS + """,
f AS (SELECT ticker, least(i // (n // 3), 2) AS f, avg(x) AS m, count(*) AS c FROM k WHERE n >= 6 GROUP BY ALL)
SELECT ticker, CAST(sum(c) AS BIGINT) AS n, count(*) AS folds, round(avg(m) / (stddev_samp(m) / sqrt(count(*))), 4) AS statistic FROM f GROUP BY ticker"""))
def x4(spark, d):
    return experiments.k_fold(daily(spark, d), "ticker", "trade_date", "r").select("ticker", "n", "folds", r("statistic", 4))


@query("w27_rolling_hac", sql("bars", RETURNS + """,
m AS (SELECT ticker, trade_date, avg(x) OVER w AS m, count(*) OVER w AS c FROM k WINDOW w AS (PARTITION BY ticker ORDER BY trade_date ROWS 4 PRECEDING)),
c AS (SELECT ticker, m, m - avg(m) OVER (PARTITION BY ticker) AS x, row_number() OVER (PARTITION BY ticker ORDER BY trade_date) AS i, count(*) OVER (PARTITION BY ticker) AS n FROM m WHERE c = 5),
g AS (SELECT a.ticker, j, sum(a.x * b.x) / any_value(a.n) AS g FROM c a CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS j) JOIN c b ON b.ticker = a.ticker AND b.i = a.i - j GROUP BY ALL),
v AS (SELECT ticker, sum(CASE WHEN j = 0 THEN g ELSE 2 * (1 - j / 5.0::DOUBLE) * g END) AS v FROM g GROUP BY 1),
s AS (SELECT ticker, count(*) AS windows, avg(m) AS mean FROM c GROUP BY 1)
SELECT ticker, windows, round(mean, 4) AS mean, round(CASE WHEN v > 0 THEN mean / sqrt(v / windows) ELSE 0 END, 4) AS statistic FROM s JOIN v USING (ticker)"""))
def w27(spark, d):
    return experiments.rolling_hac(daily(spark, d), "ticker", "trade_date", "r").select("ticker", "windows", r("mean", 4), r("statistic", 4))


@query("x6_out_of_sample", sql("bars", RETURNS + """
SELECT ticker, round(avg(x) FILTER (i < n // 2), 4) AS in_sample, round(avg(x) FILTER (i >= n // 2), 4) AS out_of_sample, count(*) FILTER (i >= n // 2) AS n_out, (avg(x) FILTER (i < n // 2) <= 0) = (avg(x) FILTER (i >= n // 2) <= 0) AS same_sign FROM k WHERE n >= 6 GROUP BY ticker"""))
def x6(spark, d):
    return experiments.halves(daily(spark, d), "ticker", "trade_date", "r").select("ticker", r("in_sample", 4), r("out_of_sample", 4), "n_out", "same_sign")


@query("x7_x10_trailing_fractions", sql("bars", RETURNS + """,
f AS (SELECT ticker, fr, avg(x) AS m FROM k CROSS JOIN (SELECT unnest([0.5, 0.75, 1.0])::DOUBLE AS fr) WHERE n >= 6 AND i >= n - greatest(3, floor(n * fr)) GROUP BY ALL),
b AS (SELECT ticker, m AS full_mean FROM f WHERE fr = 1.0)
SELECT ticker, count(*) AS settings, count(*) FILTER ((m <= 0) <> (full_mean <= 0)) AS sign_flips, round(any_value(full_mean), 4) AS full_mean FROM f JOIN b USING (ticker) GROUP BY ticker"""))
def x7(spark, d):
    return experiments.trailing(daily(spark, d), "ticker", "trade_date", "r").select("ticker", "settings", "sign_flips", r("full_mean", 4))


@query("x5_x8_x9_resampling")
def x8(spark, d):
    return experiments.resampled(daily(spark, d), "ticker", "trade_date", "r")


@query("x11_partial_lead_lag")
def x11(spark, d):
    logs = daily(spark, d).withColumn("r", F.log1p("r"))
    return experiments.partial_lead_lag(logs, (1, 2)).withColumns({"partial": F.round("partial", 6), "p": F.round("p", 6)})


@query("x12_replication")
def x12(spark, d):
    logs = daily(spark, d).withColumn("r", F.log1p("r"))
    cut = experiments.chronological_cut(logs, "trade_date", 0.6)
    early, late = experiments.partial_lead_lag(logs.where(F.col("trade_date") <= cut), (1,)), experiments.partial_lead_lag(logs.where(F.col("trade_date") > cut), (1,))
    return experiments.replicated(early.where("p < 0.1"), late, ["leader", "follower", "lag"], "partial").select("leader", "follower", "lag", "n")


@query("a31_clusters")
def a31(spark, d):
    f = features.price_features(plain(spark, d), (5, 20)).groupBy("ticker").agg(F.avg("volatility_20d").alias("v"), F.avg("distance_high_20d").alias("h"), F.avg("volume").alias("q"))
    return experiments.clustered(f, ["v", "h", "q"], 4)


@query("a8_quantiles", sql("bars", RETURNS + " SELECT ticker, round(quantile_cont(x, 0.05), 6) AS p5, round(quantile_cont(x, 0.5), 6) AS p50, round(quantile_cont(x, 0.95), 4) AS p95 FROM k GROUP BY ticker"))
def a8(spark, d):
    q = lambda x: F.percentile("r", F.lit(x))
    return daily(spark, d).groupBy("ticker").agg(F.round(q(0.05), 6).alias("p5"), F.round(q(0.5), 6).alias("p50"), F.round(q(0.95), 4).alias("p95"))


@query("a35_trailing_mean", sql("bars", RETURNS + " SELECT ticker, round(avg(x), 4) AS mean, round(stddev_pop(x), 4) AS volatility FROM k WHERE i >= n - 20 GROUP BY ticker HAVING count(*) >= 3"))
def a35(spark, d):
    last = experiments.numbered(daily(spark, d), "ticker", "trade_date").where("_i >= _n - 20")
    return last.groupBy("ticker").agg(F.round(F.avg("r"), 4).alias("mean"), F.round(F.stddev_pop("r"), 4).alias("volatility"), F.count("*").alias("c")).where("c >= 3").drop("c")


@query("d9_actions", sql("decisions", """
WITH p AS (SELECT *, 0.02 + (decision_id % 9) * 0.02::DOUBLE AS expected_risk, CASE WHEN decision_id % 6 <> 0 THEN 10.0 + decision_id % 90 END AS ref, expected_return * confidence / greatest(0.02 + (decision_id % 9) * 0.02::DOUBLE, 1e-9) AS score FROM decisions)
SELECT decision_id, round(score, 6) AS score, CASE WHEN confidence < 0.6 THEN 'ABSTAIN' WHEN expected_return <= 0 THEN 'AVOID' WHEN score >= 1 THEN CASE WHEN ref IS NULL THEN 'ABSTAIN' ELSE 'BUY_CANDIDATE' END ELSE 'WATCH' END AS action,
  decided_on + CASE horizon WHEN 'MICRO' THEN 3 WHEN 'SWING' THEN 28 ELSE 183 END AS valid_until,
  round(CASE WHEN confidence >= 0.6 AND expected_return > 0 AND score >= 1 THEN ref * (1 - least(0.25, greatest(0.02, expected_risk))) END, 6) AS invalidation FROM p"""))
def d9(spark, d):
    p = views.decisions(spark, d).withColumns({"expected_risk": 0.02 + (F.col("decision_id") % 9) * 0.02, "reference_price": F.when(F.col("decision_id") % 6 != 0, 10.0 + F.col("decision_id") % 90), "as_of": F.col("decided_on")})
    return research.actions(p).select("decision_id", r("score"), "action", "valid_until", r("invalidation"))


@query("f14_readiness", sql("bars", """
WITH l AS (SELECT ticker, count(*) AS n_bars, CAST(DATE '2001-11-10' - max(trade_date) AS INTEGER) AS stale, avg(close * volume) > 250000 AS liquid FROM bars GROUP BY 1)
SELECT ticker, horizon, CAST((n_bars < need)::INT + (stale > 7)::INT + (NOT liquid)::INT AS INTEGER) AS n_blockers FROM l CROSS JOIN (VALUES ('MICRO', 60), ('SWING', 120), ('INVESTMENT', 252)) AS h(horizon, need)"""))
def f14(spark, d):
    l = views.bars(spark, d).groupBy("ticker").agg(F.count("*").alias("n_bars"), F.datediff(F.lit("2001-11-10").cast("date"), F.max("trade_date")).alias("stale_days"), (F.avg(F.col("close") * F.col("volume")) > 250_000).alias("liquid"))
    l = l.withColumns({"horizon": F.explode(F.array(*map(F.lit, research.LEAST_BARS))), "n_macro": F.lit(3), "gap": F.lit(None).cast("double")})
    return research.readiness(l).select("ticker", "horizon", F.size("blockers").alias("n_blockers"))


@query("f15_legality", """
WITH s AS (SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN TRUE ELSE p_partkey % 2 = 0 END AS robots, CASE p_partkey % 4 WHEN 0 THEN 'No scraping please' WHEN 1 THEN 'open data' WHEN 2 THEN 'no scraping but open data' ELSE '' END AS terms, CASE WHEN p_partkey % 5 = 0 THEN 'HTML_SCRAPE' ELSE 'API' END AS m FROM part)
SELECT id, CASE WHEN robots = FALSE THEN 'BLOCKED' WHEN terms ILIKE '%no scraping%' AND terms NOT ILIKE '%open data%' THEN 'BLOCKED' WHEN m = 'HTML_SCRAPE' THEN 'AMBIGUOUS' WHEN terms ILIKE '%no scraping%' OR robots IS NULL THEN 'AMBIGUOUS' ELSE 'ALLOWED' END AS verdict FROM s""")
def f15(spark, d):
    k = F.col("p_partkey")
    s = table(spark, d, "part").select(
        k.alias("id"), F.when(k % 3 == 1, True).when(k % 3 == 2, k % 2 == 0).alias("robots_allows"), F.when(k % 4 == 0, "No scraping please").when(k % 4 == 1, "open data").when(k % 4 == 2, "no scraping but open data").otherwise("").alias("terms"),
        F.when(k % 5 == 0, "HTML_SCRAPE").otherwise("API").alias("access_method"),
    )
    return research.legality(s).select("id", "verdict")


@query("d11_evaluate_expired", sql("bars decisions", """
WITH dc AS (SELECT decision_id, 'Brand#' || CAST(1 + decision_id % 25 AS VARCHAR) AS ticker, decided_on AS d0, decided_on + CASE horizon WHEN 'MICRO' THEN 3 WHEN 'SWING' THEN 28 ELSE 183 END AS d1 FROM decisions),
e AS (SELECT dc.*, b.close AS entry FROM dc ASOF LEFT JOIN bars b ON b.ticker = dc.ticker AND b.trade_date >= dc.d0), x AS (SELECT e.*, b.close AS exit FROM e ASOF LEFT JOIN bars b ON b.ticker = e.ticker AND b.trade_date >= e.d1)
SELECT decision_id, round((exit - entry) / nullif(entry, 0) - 0.002, 4) AS realized_return, CASE WHEN entry IS NULL OR exit IS NULL THEN 'INSUFFICIENT_DATA' ELSE 'EVALUATED' END AS status FROM x WHERE d1 <= DATE '2001-06-30'"""))
def d11(spark, d):
    dc = views.decisions(spark, d).select("decision_id", F.concat(F.lit("Brand#"), 1 + F.col("decision_id") % 25).alias("ticker"), F.col("decided_on").alias("as_of"), F.date_add("decided_on", F.when(F.col("horizon") == "MICRO", 3).when(F.col("horizon") == "SWING", 28).otherwise(183)).alias("valid_until"))
    level = views.bars(spark, d).groupBy("trade_date").agg(F.avg("close").alias("level"))
    return research.evaluated(dc, plain(spark, d), level, "2001-06-30").select("decision_id", r("realized_return", 4), "status")


@query("d13_counterfactual", sql("decisions", """
WITH e AS (SELECT 'T' || CAST(decision_id % 50 AS VARCHAR) AS ticker, 'c' || CAST(decision_id % 4 AS VARCHAR) AS category, sum(confidence) AS w, sum(confidence * expected_return) AS x FROM decisions GROUP BY ALL)
SELECT ticker, category, round(sum(x) OVER t / nullif(sum(w) OVER t, 0), 6) AS "all", round((sum(x) OVER t - x) / nullif(round(sum(w) OVER t - w, 9), 0), 6) AS without FROM e WINDOW t AS (PARTITION BY ticker)"""))
def d13(spark, d):
    e = views.decisions(spark, d).select(F.concat(F.lit("T"), F.col("decision_id") % 50).alias("ticker"), F.concat(F.lit("c"), F.col("decision_id") % 4).alias("category"), "confidence", "expected_return")
    return research.counterfactual(e).select("ticker", "category", r("all"), r("without"))


@query("a26_attribution", sql("decisions", """
WITH e AS (SELECT 'T' || CAST(decision_id % 50 AS VARCHAR) AS ticker, horizon AS category, sum(confidence) AS w, sum(confidence * expected_return) AS x FROM decisions GROUP BY ALL)
SELECT ticker, category, round(x / sum(w) OVER (PARTITION BY ticker), 6) AS contribution FROM e"""))
def a26(spark, d):
    e = views.decisions(spark, d).select(F.concat(F.lit("T"), F.col("decision_id") % 50).alias("ticker"), F.col("horizon").alias("category"), "confidence", "expected_return")
    return research.attribution(e).select("ticker", "category", r("contribution"))


@query("a29_horizon_combination", sql("decisions", """
WITH w AS (SELECT 'T' || CAST(decision_id % 50 AS VARCHAR) AS ticker, expected_return, confidence * CASE horizon WHEN 'MICRO' THEN 0.2 WHEN 'SWING' THEN 0.3 ELSE 0.5 END AS w FROM decisions)
SELECT ticker, round((sum(w * expected_return) / sum(w))::DOUBLE, 6) AS expected_return, round(sum(w)::DOUBLE, 6) AS weight FROM w GROUP BY ticker"""))
def a29(spark, d):
    e = views.decisions(spark, d).select(F.concat(F.lit("T"), F.col("decision_id") % 50).alias("ticker"), "horizon", "confidence", "expected_return", F.lit(0.1).alias("expected_risk"))
    return research.combined(e, {"MICRO": 0.2, "SWING": 0.3, "INVESTMENT": 0.5}).select("ticker", r("expected_return"), r("weight"))


@query("r3_illegal_transitions", """
WITH a AS (SELECT o_custkey, o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'CONFIRMED' WHEN 'F' THEN 'CORROBORATED' ELSE 'DISPUTED' END AS s FROM orders), b AS (SELECT *, lag(s) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM a)
SELECT o_custkey, o_orderkey, p AS "from", s AS "to" FROM b WHERE p IS NOT NULL AND p <> s AND p || '>' || s NOT IN ('CONFIRMED>CORROBORATED', 'CONFIRMED>DISPUTED', 'CORROBORATED>DISPUTED', 'DISPUTED>CORROBORATED')""")
def r3(spark, d):
    s = F.when(F.col("o_orderstatus") == "O", "CONFIRMED").when(F.col("o_orderstatus") == "F", "CORROBORATED").otherwise("DISPUTED")
    return lifecycles.illegal_steps(table(spark, d, "orders").select("o_custkey", "o_orderkey", s.alias("s")), "o_custkey", "o_orderkey", "s", "event")


@query("r3_gene_steps", """
WITH a AS (SELECT user_id, event_id, CASE event_type WHEN 'signup' THEN 'PROPOSED' WHEN 'view' THEN 'PROMOTED' WHEN 'click' THEN 'MONITORING' WHEN 'error' THEN 'RETIRED' ELSE 'REPLACED' END AS s FROM events), b AS (SELECT *, lag(s) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM a)
SELECT user_id, event_id, p AS "from", s AS "to" FROM b WHERE p <> s AND NOT ((p = 'PROPOSED' AND s IN ('PROMOTED', 'RETIRED')) OR (p = 'PROMOTED' AND s IN ('MONITORING', 'RETIRED', 'REPLACED')) OR (p = 'MONITORING' AND s IN ('RETIRED', 'REPLACED')))""")
def r3_gene(spark, d):
    kind = F.element_at(F.create_map(*[F.lit(x) for x in ("signup", "PROPOSED", "view", "PROMOTED", "click", "MONITORING", "error", "RETIRED")]), F.col("event_type"))
    e = table(spark, d, "events").select("user_id", "event_id", F.coalesce(kind, F.lit("REPLACED")).alias("s"))
    return lifecycles.illegal_steps(e, "user_id", "event_id", "s", "gene")


def claim_records(spark, d):
    """Order lines as evidence for claims: an order is a claim, its lines its records."""
    stage = F.get(F.array(*map(F.lit, lifecycles.CLAIM_STAGES)), F.least(F.floor((F.col("l_linenumber") + F.col("l_suppkey") % 2) / 2), F.lit(5)).cast("int"))
    kind = F.when(F.col("l_partkey") % 11 == 0, "paper").otherwise("experiment")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", stage.alias("stage"), kind.alias("evidence_type"), (F.col("l_quantity") > 5).alias("passed"))


CLAIM_ORDER = ["l_linenumber", "l_shipdate", "l_partkey", "l_suppkey"]


@query("r3_claim_stages")
def r3_claims(spark, d):
    return lifecycles.claim_stages(claim_records(spark, d), "l_orderkey", CLAIM_ORDER)


@query("r3_gates", """
WITH g AS (SELECT o_custkey, o_orderkey % 8 AS k, max({'d': o_orderdate, 'i': o_orderkey, 'ok': o_totalprice > 50000}).ok AS ok FROM orders GROUP BY ALL),
n AS (SELECT c.o_custkey, min(t.k) AS k FROM (SELECT DISTINCT o_custkey FROM orders) c CROSS JOIN (SELECT unnest(range(8)) AS k) t LEFT JOIN g ON g.o_custkey = c.o_custkey AND g.k = t.k WHERE coalesce(NOT g.ok, TRUE) GROUP BY 1)
SELECT c.o_custkey, CAST(coalesce(n.k, 8) AS INTEGER) AS passed, ['OBSERVATION', 'HYPOTHESIS', 'DATA_COLLECTION', 'EXPERIMENT', 'STATISTICAL_VALIDATION', 'STRESS_TEST', 'BACKTEST', 'PEER_VALIDATION'][n.k + 1] AS next_gate,
  CASE WHEN n.k IS NULL THEN 'VALIDATED' WHEN count(*) FILTER (g.k = n.k) > 0 THEN 'REJECTED' ELSE 'IN_PROGRESS' END AS status, CAST(count(*) FILTER (g.ok AND g.k > n.k) AS INTEGER) AS skipped
FROM (SELECT DISTINCT o_custkey FROM orders) c LEFT JOIN n USING (o_custkey) JOIN g USING (o_custkey) GROUP BY c.o_custkey, n.k""")
def r3_gates(spark, d):
    gate = F.get(F.array(*map(F.lit, lifecycles.GATES)), (F.col("o_orderkey") % 8).cast("int"))
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", gate.alias("gate"), (F.col("o_totalprice") > 50_000).alias("passed"))
    return lifecycles.gate_states(o, "o_custkey", ["o_orderdate", "o_orderkey"])


@query("x22_decay", sql("bars", f"""
WITH s AS (SELECT ticker, (lead(close, 20) OVER w - close) / nullif(close, 0) AS a FROM bars WINDOW w AS ({W}))
SELECT ticker AS pattern_id, count(*) AS n, round(avg(CAST(a > 0 AS DOUBLE)), 6) AS live_hit_rate, count(*) >= 10 AND (avg(CAST(a > 0 AS DOUBLE)) < 0.7 - 0.2 OR (avg(a) > 0) <> TRUE) AS flagged FROM s WHERE a IS NOT NULL GROUP BY 1"""))
def x22(spark, d):
    live = plain(spark, d).select(F.col("ticker").alias("pattern_id"), targets.forward(20).alias("actual"), F.lit(0.7).alias("hit_rate"), F.lit(0.01).alias("expectancy"))
    return research.decayed(live).select("pattern_id", "n", r("live_hit_rate"), "flagged")


@query("x24_retirement", sql("decisions", "SELECT 'k' || CAST(decision_id % 97 AS VARCHAR) AS knowledge_id, count(*) AS n, count(*) FILTER ((realized_return > 0) <> (expected_return > 0)) AS against, count(*) >= 3 AND count(*) FILTER ((realized_return > 0) <> (expected_return > 0)) * 2 > count(*) AS retire FROM decisions GROUP BY 1"))
def x24(spark, d):
    p = views.decisions(spark, d).select(F.concat(F.lit("k"), F.col("decision_id") % 97).alias("knowledge_id"), F.col("realized_return").alias("realized"), F.col("expected_return").alias("expected"))
    return research.retire(p)


@query("x21_live_activation", sql("bars", """
WITH a AS (SELECT ticker, trade_date, """ + RET.format(n=5) + """ AS r5, """ + RET.format(n=20) + f""" AS r20 FROM bars WINDOW w AS ({W})),
f AS (SELECT ticker, trade_date, 'return_5d' AS feature_id, r5 AS value FROM a WHERE r5 IS NOT NULL UNION ALL SELECT ticker, trade_date, 'return_20d', r20 FROM a WHERE r20 IS NOT NULL),
q AS (SELECT ticker, feature_id, quantile_cont(value, 0.2) AS lo, quantile_cont(value, 0.8) AS hi FROM f GROUP BY ALL), l AS (SELECT ticker, feature_id, arg_max(value, trade_date) AS value FROM f WHERE trade_date <= DATE '2000-06-30' GROUP BY ALL)
SELECT ticker, feature_id || ':' || op AS rule_id, round(1 / (1 + coalesce(abs((value - th) / nullif(abs(th), 0)), 0)), 6) AS quality
FROM (SELECT *, '<' AS op, lo AS th FROM q JOIN l USING (ticker, feature_id) UNION ALL SELECT *, '>', hi FROM q JOIN l USING (ticker, feature_id)) WHERE CASE op WHEN '<' THEN value < th ELSE value > th END"""))
def x21(spark, d):
    wide = plain(spark, d).withColumns({"return_5d": features.ret(5), "return_20d": features.ret(20)})
    long = rules.long_features(wide, ["return_5d", "return_20d"])
    conds = rules.conditions(long).withColumn("rule_id", F.col("cond_id"))
    return research.live_matches(long, conds, "2000-06-30").withColumn("quality", F.round("quality", 6))


@query("agents_technical", sql("bars", f"""
WITH a AS (SELECT ticker, trade_date, avg(close) OVER (PARTITION BY ticker ORDER BY trade_date ROWS 2 PRECEDING) / avg(close) OVER (PARTITION BY ticker ORDER BY trade_date ROWS 7 PRECEDING) - 1 AS g FROM bars), l AS (SELECT ticker, arg_max(g, trade_date) AS s FROM a GROUP BY 1)
SELECT 'technical' AS agent, ticker AS subject, round(s, 6) AS statistic FROM l WHERE abs(s) >= 0.005"""))
def technical(spark, d):
    return research.technical_findings(plain(spark, d)).withColumn("statistic", F.round("statistic", 6))


@query("w31_agents_liquidity", sql("bars", RETURNS + f""",
z AS (SELECT ticker, x, lag((volume - avg(volume) OVER (PARTITION BY ticker)) / nullif(stddev_pop(volume) OVER (PARTITION BY ticker), 0)) OVER ({W}) AS z FROM a)
SELECT 'liquidity' AS agent, ticker AS subject, round(c, 4) AS statistic FROM (SELECT ticker, (avg(x * z) - avg(x) * avg(z)) / nullif(stddev_pop(x) * stddev_pop(z), 0) AS c FROM z WHERE x IS NOT NULL AND z IS NOT NULL GROUP BY 1) WHERE abs(c) >= 0.01""".replace("lag((volume - avg(volume) OVER (PARTITION BY ticker)) / nullif(stddev_pop(volume) OVER (PARTITION BY ticker), 0)) OVER", "lag(v) OVER").replace("FROM a)\nSELECT", "FROM (SELECT *, (volume - avg(volume) OVER (PARTITION BY ticker)) / nullif(stddev_pop(volume) OVER (PARTITION BY ticker), 0) AS v FROM a))\nSELECT")))
def liquidity(spark, d):
    return research.liquidity_findings(plain(spark, d), 0.01).withColumn("statistic", F.round("statistic", 4))


@query("j4_agents_macro", sql("bars macro", f"""
WITH a AS (SELECT ticker, trade_date, {RET.format(n=1)} AS x FROM bars WINDOW w AS ({W})), k AS (SELECT * FROM a WHERE x IS NOT NULL),
m AS (SELECT series_id, observation_date, (value - lag(value) OVER v) / nullif(lag(value) OVER v, 0) AS move FROM macro WINDOW v AS (PARTITION BY series_id ORDER BY observation_date)),
j AS (SELECT s.ticker, s.series_id, s.x, m.move FROM (SELECT k.*, series_id FROM k CROSS JOIN (SELECT DISTINCT series_id FROM macro)) s ASOF JOIN (SELECT * FROM m WHERE move IS NOT NULL) m ON m.series_id = s.series_id AND s.trade_date >= m.observation_date),
c AS (SELECT ticker, series_id, (avg(x * move) - avg(x) * avg(move)) / nullif(stddev_pop(x) * stddev_pop(move), 0) AS c, count(*) AS n FROM j GROUP BY ALL)
SELECT 'macro' AS agent, ticker || '~' || series_id AS subject, round(c, 4) AS statistic FROM c WHERE n >= 4 AND abs(c) >= 0.02"""))
def macro_agent(spark, d):
    return research.macro_findings(plain(spark, d), views.macro(spark, d), 0.02).withColumn("statistic", F.round("statistic", 4))


@query("agents_structure", sql("bars", f"""
WITH a AS (SELECT *, {RET.format(n=1)} AS x FROM bars WINDOW w AS ({W})), k AS (SELECT * FROM a WHERE x IS NOT NULL),
c AS (SELECT a.ticker AS a, b.ticker AS b, (avg(a.x * b.x) - avg(a.x) * avg(b.x)) / nullif(stddev_pop(a.x) * stddev_pop(b.x), 0) AS c FROM k a JOIN k b ON a.trade_date = b.trade_date AND a.ticker < b.ticker GROUP BY ALL)
SELECT 'market_structure' AS agent, a || '~' || b AS subject, round(c, 4) AS statistic FROM c WHERE abs(c) >= 0.01 QUALIFY row_number() OVER (ORDER BY abs(c) DESC, a, b) <= 250"""))
def structure(spark, d):
    return research.structure_findings(market.pair_correlations(plain(spark, d)), 0.01).withColumn("statistic", F.round("statistic", 4))


@query("agents_performance", sql("financials", """
WITH a AS (SELECT ticker, period_end_date, (value - lag(value, 4) OVER w) / nullif(abs(lag(value, 4) OVER w), 0) AS y FROM financials WHERE line_item = 'revenue' WINDOW w AS (PARTITION BY ticker ORDER BY period_end_date)),
n AS (SELECT ticker, y, row_number() OVER (PARTITION BY ticker ORDER BY period_end_date) AS i, count(*) OVER (PARTITION BY ticker) AS n FROM a WHERE y IS NOT NULL)
SELECT 'financial_performance' AS agent, ticker AS subject, round(s, 6) AS statistic FROM (SELECT ticker, avg(y) FILTER (i > n // 2) - avg(y) FILTER (i <= n // 2) AS s FROM n WHERE n >= 4 GROUP BY 1) WHERE abs(s) >= 0.05"""))
def performance_agent(spark, d):
    g = features.fundamentals(views.financials(spark, d), "revenue")
    return research.performance_findings(g).withColumn("statistic", F.round("statistic", 6))


@query("a22_financial_coverage", sql("financials sectors", "SELECT s.ticker, count(DISTINCT f.line_item) AS n_items, max(f.period_end_date) AS latest, 5 - count(DISTINCT f.line_item) AS missing FROM sectors s LEFT JOIN financials f USING (ticker) GROUP BY s.ticker"))
def a22(spark, d):
    f = views.financials(spark, d).groupBy("ticker").agg(F.size(F.collect_set("line_item")).cast("long").alias("n_items"), F.max("period_end_date").alias("latest"))
    return views.sectors(spark, d).select("ticker").join(f, "ticker", "left").select("ticker", F.coalesce("n_items", F.lit(0)).alias("n_items"), "latest", (5 - F.coalesce("n_items", F.lit(0))).alias("missing"))


@query("a25_committee_rates", sql("decisions", "SELECT horizon, count(*) AS n, round(avg(CAST(sign(expected_return) = sign(realized_return) AS DOUBLE)), 6) AS agree_rate, round(avg(CAST(abs(expected_return) >= 0.05 AS DOUBLE)), 6) AS decisive_rate FROM decisions GROUP BY 1"))
def a25(spark, d):
    return reporting.committee_rates(views.decisions(spark, d), "horizon").select("horizon", "n", r("agree_rate"), r("decisive_rate"))


@query("a36_status_counts", "SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def a36(spark, d):
    return reporting.status_counts(table(spark, d, "orders").withColumnsRenamed({"o_orderstatus": "status", "o_orderpriority": "priority"}), ["status", "priority"])


@query("a39_directional_audit", sql("decisions", "SELECT horizon, count(*) FILTER (expected_return > 0 AND realized_return > 0) AS up_up, count(*) FILTER (expected_return > 0 AND realized_return <= 0) AS up_down, count(*) FILTER (expected_return <= 0 AND realized_return > 0) AS down_up, count(*) FILTER (expected_return <= 0 AND realized_return <= 0) AS down_down FROM decisions GROUP BY 1"))
def a39(spark, d):
    return reporting.directional_audit(views.decisions(spark, d), "horizon")


@query("a40_inventory", "SELECT count(*) AS n, min(ts) AS first, max(ts) AS last, count(*) - count(DISTINCT (user_id, event_type, CAST(ts AS DATE))) AS repeats FROM events")
def a40(spark, d):
    return reporting.inventory(table(spark, d, "events"), "ts", [F.col("user_id"), F.col("event_type"), F.to_date("ts")])


@query("w25_average_gap", sql("bars", f"""
SELECT ticker, trade_date, round(avg(close) OVER (PARTITION BY ticker ORDER BY trade_date ROWS 2 PRECEDING) / nullif(avg(close) OVER (PARTITION BY ticker ORDER BY trade_date ROWS 7 PRECEDING), 0) - 1, 6) AS gap FROM bars QUALIFY row_number() OVER ({W}) >= 8"""))
def w25(spark, d):
    b = plain(spark, d).withColumn("gap", features.average_gap(3, 8))
    return b.where("gap is not null").select("ticker", "trade_date", r("gap"))


@query("w25_w29_running_drawdown", sql("bars", f"SELECT ticker, trade_date, round(close / max(close) OVER ({W}) - 1, 9) AS drawdown, round(min(close / peak - 1) OVER ({W}), 9) AS worst FROM (SELECT *, max(close) OVER ({W}) AS peak FROM bars)"))
def w29(spark, d):
    run = features.by().rowsBetween(Window.unboundedPreceding, 0)
    b = plain(spark, d).withColumn("d", F.col("adj") / F.max("adj").over(run) - 1)
    return b.select("ticker", "trade_date", r("d", 9).alias("drawdown"), F.round(F.min("d").over(run), 9).alias("worst"))


@query("w33_ranking", "SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer QUALIFY rank <= 10")
def w33(spark, d):
    w = Window.partitionBy("c_mktsegment").orderBy(F.col("c_acctbal").desc(), "c_custkey")
    return table(spark, d, "customer").withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 10").select("c_mktsegment", "c_custkey", "rank")


@query("j7_common_dates", sql("bars", "SELECT trade_date FROM bars WHERE ticker = 'Brand#1' INTERSECT SELECT trade_date FROM bars WHERE ticker = 'Brand#2' INTERSECT SELECT trade_date FROM bars WHERE ticker = 'Brand#3'"))
def j7(spark, d):
    b = views.bars(spark, d)
    one = lambda t: b.where(F.col("ticker") == t).select("trade_date")
    return one("Brand#1").intersect(one("Brand#2")).intersect(one("Brand#3"))


@query("j3_bucket_at", sql("bars macro", """
WITH k AS (SELECT series_id, observation_date, CASE WHEN value > 200000 THEN 2 WHEN value > 150000 THEN 1 ELSE 0 END AS bucket FROM macro WHERE series_id = '2-HIGH')
SELECT b.ticker, b.trade_date, k.bucket FROM (SELECT ticker, trade_date, '2-HIGH' AS series_id FROM bars) b ASOF LEFT JOIN k ON k.series_id = b.series_id AND b.trade_date >= k.observation_date"""))
def j3(spark, d):
    k = views.macro(spark, d).where("series_id = '2-HIGH'").withColumn("bucket", F.when(F.col("value") > 200_000, 2).when(F.col("value") > 150_000, 1).otherwise(0))
    b = views.bars(spark, d).select("ticker", "trade_date", F.lit("2-HIGH").alias("series_id"))
    return asof.as_of(b, k, ["series_id"], "trade_date", "observation_date", "bucket").select("ticker", "trade_date", "bucket")


@query("j16_semi_anti", sql("bars", "SELECT ticker, count(*) AS n FROM bars WHERE ticker IN (SELECT p_brand FROM part WHERE p_size > 49) AND ticker NOT IN (SELECT p_brand FROM part WHERE p_size = 1 AND p_type = 'ECONOMY') GROUP BY 1"))
def j16(spark, d):
    p, b = table(spark, d, "part").withColumnRenamed("p_brand", "ticker"), views.bars(spark, d)
    return b.join(p.where("p_size > 49"), "ticker", "left_semi").join(p.where("p_size = 1 and p_type = 'ECONOMY'"), "ticker", "left_anti").groupBy("ticker").agg(F.count("*").alias("n"))


@query("j18_alias_first_match", "SELECT c_custkey, arg_min(alias, pos) AS alias FROM (SELECT c_custkey, a.alias, a.pos FROM customer JOIN (VALUES ('build', 1), ('mach', 2), ('furn', 3), ('auto', 4), ('u', 5)) AS a(alias, pos) ON contains(lower(c_mktsegment), a.alias)) GROUP BY 1")
def j18(spark, d):
    names = ["build", "mach", "furn", "auto", "u"]
    hit = F.filter(F.array(*map(F.lit, names)), lambda a: F.lower("c_mktsegment").contains(a))
    return table(spark, d, "customer").select("c_custkey", F.get(hit, F.lit(0)).alias("alias")).where("alias is not null")


@query("t4_t5_set_operations", "SELECT 'only_a' AS part, count(*) AS n FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') UNION ALL SELECT 'both', count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def t5(spark, d):
    o = table(spark, d, "orders")
    a, b = (o.where(F.col("o_orderstatus") == s).select("o_custkey") for s in ("O", "F"))
    return a.subtract(b).agg(F.count("*").alias("n")).select(F.lit("only_a").alias("part"), "n").unionByName(a.intersect(b).agg(F.count("*").alias("n")).select(F.lit("both").alias("part"), "n"))


@query("t8_first_of_each", "SELECT user_id, list(event_type ORDER BY first)::VARCHAR AS kinds FROM (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY ALL) GROUP BY 1")
def t8(spark, d):
    e = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"))
    kinds = F.transform(F.array_sort(F.collect_list(F.struct("first", "event_type"))), lambda x: x["event_type"])
    return e.groupBy("user_id").agg(F.concat(F.lit("["), F.array_join(kinds, ", "), F.lit("]")).alias("kinds"))


@query("s2_event_details_json", sql("corporate_events", "SELECT ticker, event_date, event_type, split_ratio, dividend_amount FROM corporate_events WHERE event_date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'"))
def s2(spark, d):
    e = views.corporate_events(spark, d).where("event_date between date'1996-01-01' and date'1998-12-31'")
    raw = e.select("ticker", "event_date", "event_type", F.to_json(F.struct("split_ratio", "dividend_amount")).alias("details_json"))
    return raw.select("ticker", "event_date", "event_type", F.inline(F.array(F.from_json("details_json", "struct<split_ratio: double, dividend_amount: double>"))))


@query("s14_superseded_items", sql("financials", """
WITH n AS (SELECT ticker, period_end_date, line_item, value * 2 AS value FROM financials WHERE line_item = 'revenue' AND period_end_date >= DATE '2000-01-01')
SELECT * FROM n UNION ALL SELECT ticker, period_end_date, line_item, value FROM financials WHERE NOT (line_item = 'revenue' AND period_end_date >= DATE '2000-01-01') AND NOT (line_item = 'net_income' AND period_end_date >= DATE '2000-01-01')"""))
def s14(spark, d):
    f = views.financials(spark, d).select("ticker", "period_end_date", "line_item", "value")
    late = f.where("period_end_date >= date'2000-01-01'")
    return storage.upsert(f, late.where("line_item = 'revenue'").withColumn("value", F.col("value") * 2), ["ticker", "period_end_date", "line_item"], late.where("line_item = 'net_income'"))


@query("s17_news_upsert", "SELECT source, lang, count(*) AS n FROM (SELECT DISTINCT source, lang, split_part(coalesce(text, ''), chr(10), 1) AS headline FROM documents) GROUP BY ALL")
def s17(spark, d):
    n = table(spark, d, "documents").select("source", "lang", F.substring_index(F.coalesce("text", F.lit("")), "\n", 1).alias("headline"))
    return n.dropDuplicates(["source", "lang", "headline"]).groupBy("source", "lang").agg(F.count("*").alias("n"))


@query("s23_lineage_trace", "SELECT l_partkey, arg_max(l_orderkey, (l_shipdate, l_orderkey, l_linenumber, l_suppkey)) AS l_orderkey, count(*) AS revisions FROM lineitem GROUP BY 1")
def s23(spark, d):
    li = table(spark, d, "lineitem")
    last = F.max(F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey"))
    return li.groupBy("l_partkey").agg(last.alias("m"), F.count("*").alias("revisions")).select("l_partkey", "m.l_orderkey", "revisions")


@query("f12_f6_eligible", sql("decisions", "SELECT horizon, count(*) AS n FROM decisions WHERE confidence > 0 AND decided_on <= DATE '1999-06-30' AND decided_on > DATE '1999-05-31' AND horizon IN ('SWING', 'INVESTMENT') GROUP BY 1"))
def f12(spark, d):
    e = views.decisions(spark, d).where("confidence > 0 and decided_on <= date'1999-06-30' and datediff(date'1999-06-30', decided_on) < 30")
    return e.where(F.array_contains(F.array(F.lit("SWING"), F.lit("INVESTMENT")), F.col("horizon"))).groupBy("horizon").agg(F.count("*").alias("n"))


@query("d22_similar_cases", """
WITH s AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS before FROM events WHERE event_type = 'error'),
c AS (SELECT s.user_id, before, event_id, row_number() OVER (PARTITION BY s.user_id, before ORDER BY ts DESC, event_id DESC) AS k FROM s JOIN events e ON e.user_id = s.user_id AND CAST(e.ts AS DATE) < before)
SELECT user_id, before, coalesce(string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY k) FILTER (k <= 5), '') AS cases FROM s LEFT JOIN c USING (user_id, before) GROUP BY ALL""")
def d22(spark, d):
    """For every day on which a user met an error, the five newest events of any kind on days before it."""
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    subjects = e.where("event_type = 'error'").select("user_id", F.col("day").alias("before")).distinct()
    found = agents.cases_before(subjects, e.withColumn("case", F.col("event_id").cast("string")), "user_id", "day", ["ts", "event_id"], "case")
    return found.select("user_id", "before", F.array_join("cases", ",").alias("cases"))


@query("d15_monitoring", sql("decisions", "SELECT warning, count(*) AS n FROM (SELECT unnest([x for x in [CASE WHEN confidence < 0.1 THEN 'low_confidence' END, CASE WHEN expected_return < -0.15 THEN 'negative_view' END, CASE WHEN abs(expected_return - realized_return) > 0.3 THEN 'large_miss' END] if x IS NOT NULL]) AS warning FROM decisions) GROUP BY 1"))
def d15(spark, d):
    q = views.decisions(spark, d)
    tests = {"low_confidence": F.col("confidence") < 0.1, "negative_view": F.col("expected_return") < -0.15, "large_miss": F.abs(F.col("expected_return") - F.col("realized_return")) > 0.3}
    return q.select(F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in tests.items()]))).alias("warning")).groupBy("warning").agg(F.count("*").alias("n"))


@query("d20_constraint_violations", """SELECT rule, count(*) AS n FROM (SELECT 'duplicate_line' AS rule FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'missing_order' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'bad_discount' FROM lineitem WHERE l_discount < 0 OR l_discount > 0.1) GROUP BY 1""")
def d20(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    dup = li.groupBy("l_orderkey", "l_linenumber").count().where("count > 1").select(F.lit("duplicate_line").alias("rule"))
    lost = li.join(o, "l_orderkey", "left_anti").select(F.lit("missing_order").alias("rule"))
    bad = li.where("l_discount < 0 or l_discount > 0.1").select(F.lit("bad_discount").alias("rule"))
    return dup.unionByName(lost).unionByName(bad).groupBy("rule").agg(F.count("*").alias("n"))


@query("d4_candidates", sql("bars", """
WITH l AS (SELECT ticker, arg_max(close, trade_date) AS price, avg(close) AS fair_value, count(*) AS n FROM bars GROUP BY 1)
SELECT ticker, round(fair_value / price - 1, 3) AS expected_return, round(0.5 * least(2 / 3.0::DOUBLE, 1) + 0.2 * least(n / 252.0::DOUBLE, 1) + 0.15 + 0.15 * least(2 / 3.0::DOUBLE, 1), 4) AS confidence FROM l WHERE fair_value > price"""))
def d4(spark, d):
    l = views.bars(spark, d).groupBy("ticker").agg(F.max_by("close", "trade_date").alias("price"), F.avg("close").alias("fair_value"), F.count("*").alias("n_bars"))
    c = research.candidates(l.withColumns({"n_models": F.lit(2), "n_macro": F.lit(3), "n_periods": F.lit(2)}))
    return c.select("ticker", F.round(F.col("fair_value") / F.col("price") - 1, 3).alias("expected_return"), "confidence")


@query("d7_country_risk", sql("macro", """
WITH m AS (SELECT series_id, round((arg_max(value, observation_date) - arg_min(value, observation_date)) / nullif(arg_min(value, observation_date), 0), 6) AS move, count(*) AS n FROM macro GROUP BY 1),
r AS (SELECT o_orderpriority AS series_id, count(*) FILTER (o_orderstatus = 'O' AND o_totalprice > 499000) AS down, count(*) FILTER (o_orderstatus = 'P' AND o_totalprice > 490000) AS negative FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '2001-08-01' - 180 AND DATE '2001-08-01' GROUP BY 1)
SELECT series_id, move, CASE WHEN down > 0 THEN 'CRISIS' WHEN (n >= 2 AND abs(move) >= 0.05) OR negative > 0 THEN 'DETERIORATING' ELSE 'NORMAL' END AS severity FROM m LEFT JOIN r USING (series_id)"""))
def d7(spark, d):
    """All series as currencies; orders stand for rating announcements, dear ones for downgrades and poor outlooks."""
    o, dear = table(spark, d, "orders"), F.col("o_totalprice")
    ratings = o.select(
        F.col("o_orderpriority").alias("series_id"), F.to_date("o_orderdate").alias("announced_at"), F.when((F.col("o_orderstatus") == "O") & (dear > 499_000), "downgrade").otherwise("affirm").alias("action"),
        F.when((F.col("o_orderstatus") == "P") & (dear > 490_000), "negative").otherwise("stable").alias("outlook"),
    )
    return research.country_risk(views.macro(spark, d), ratings, "2001-08-01", "series_id").withColumn("move", F.round("move", 6))


@query("d14_thesis_survival", sql("decisions", """
WITH x AS (SELECT o_custkey AS ticker, o_orderkey AS id, CAST(o_orderdate AS DATE) AS day, o_orderpriority AS catalyst, o_orderstatus AS doubt FROM orders),
o AS (SELECT ticker, list(DISTINCT catalyst) AS c, list(DISTINCT doubt) AS x, max(day) AS last FROM x WHERE day < DATE '1998-01-01' GROUP BY 1),
n AS (SELECT ticker, list(DISTINCT catalyst) AS c, list(DISTINCT doubt) AS x, max({'day': day, 'id': id}).id % 4 AS a FROM x WHERE day >= DATE '1998-01-01' GROUP BY 1),
k AS (SELECT ticker, count(*) AS broken FROM x JOIN decisions ON decision_id = id WHERE day < DATE '1998-01-01' AND expected_return * realized_return < 0 AND confidence >= 0.95 GROUP BY 1),
r AS (SELECT o.ticker, n.a, coalesce(broken, 0) AS broken, len(list_filter(n.x, lambda e: NOT list_contains(o.x, e))) AS fresh, last + 1000 < DATE '2000-01-01' AS overdue,
  array_to_string(list_sort(list_filter(o.c, lambda e: list_contains(n.c, e))), ',') AS remaining, array_to_string(list_sort(list_filter(o.c, lambda e: NOT list_contains(n.c, e))), ',') AS lapsed FROM o LEFT JOIN n USING (ticker) LEFT JOIN k USING (ticker))
SELECT ticker, CASE WHEN a IS NULL THEN 'EXPIRED' WHEN broken > 0 AND a < 2 THEN 'BROKEN' WHEN broken > 0 OR fresh > 0 OR overdue THEN 'WEAKENING' ELSE 'ALIVE' END AS status, CAST(broken AS INTEGER) AS broken, remaining, lapsed FROM r"""))
def d14(spark, d):
    """A thesis per customer: orders before a day against orders since, resting on their decisions; sure ones proven wrong are retired."""
    split = F.lit("1998-01-01").cast("date")
    x = table(spark, d, "orders").select(F.col("o_custkey").alias("ticker"), "o_orderkey", F.to_date("o_orderdate").alias("day"), "o_orderpriority", "o_orderstatus")
    views_of = [F.collect_set("o_orderpriority").alias("catalysts"), F.collect_set("o_orderstatus").alias("contradictions")]
    known = F.concat(F.lit("k"), "o_orderkey")
    o = x.where(F.col("day") < split).groupBy("ticker").agg(*views_of, F.collect_set(known).alias("knowledge_ids"), F.date_add(F.max("day"), 1000).alias("review_on"))
    action = F.element_at(F.array(*map(F.lit, ("EXIT", "REDUCE_POSITION", "HOLD", "BUY"))), (F.max_by("o_orderkey", F.struct("day", "o_orderkey")) % 4 + 1).cast("int"))
    n = x.where(F.col("day") >= split).groupBy("ticker").agg(*views_of, action.alias("action"))
    wrong = views.decisions(spark, d).where("expected_return * realized_return < 0 and confidence >= 0.95").select(F.concat(F.lit("k"), "decision_id").alias("knowledge_id"))
    t = research.thesis(o, n, wrong, "2000-01-01")
    return t.select("ticker", "status", F.size("broken").alias("broken"), F.array_join("remaining", ",").alias("remaining"), F.array_join("lapsed", ",").alias("lapsed"))


@query("s23_trace_chain", """
WITH o AS (SELECT 'order:' || o_orderkey AS node, 'customer:' || o_custkey AS parent FROM orders), c AS (SELECT 'customer:' || c_custkey AS node, 'nation:' || c_nationkey AS parent FROM customer), n AS (SELECT 'nation:' || n_nationkey AS node, 'region:' || n_regionkey AS parent FROM nation),
e AS (SELECT * FROM o UNION SELECT * FROM c UNION SELECT * FROM n)
SELECT node, parent AS ancestor, 1 AS distance FROM e UNION ALL SELECT a.node, b.parent, 2 FROM e a JOIN e b ON b.node = a.parent UNION ALL SELECT a.node, c.parent, 3 FROM e a JOIN e b ON b.node = a.parent JOIN e c ON c.node = b.parent""")
def s23_chain(spark, d):
    """From each order back to the customer, nation and region it came from."""
    link = lambda t, kind, key, to, other: table(spark, d, t).select(F.concat(F.lit(kind + ":"), key).alias("node"), F.concat(F.lit(to + ":"), other).alias("parent"))
    edges = link("orders", "order", "o_orderkey", "customer", "o_custkey").unionByName(link("customer", "customer", "c_custkey", "nation", "c_nationkey")).unionByName(link("nation", "nation", "n_nationkey", "region", "n_regionkey"))
    return graph.ancestors(edges)
