"""Queries over integrity checks, monitoring and keyed upserts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import integrity, storage
from ..plans import views
from ..plans.views import sql, table
from .registry import query


@query("f11_look_ahead", sql("bars macro corporate_events", """
SELECT record, count(*) AS n, min(dated_on) AS first FROM (SELECT 'price' AS record, trade_date AS dated_on FROM bars UNION ALL SELECT 'macro', observation_date FROM macro UNION ALL SELECT 'corporate_event', event_date FROM corporate_events UNION ALL SELECT 'news', CAST(ts AS DATE) FROM events)
WHERE dated_on > DATE '1998-01-01' GROUP BY 1"""))
def f11(spark, d):
    found = integrity.later_than("1998-01-01", {"price": (views.bars(spark, d), "ticker", "trade_date"), "macro": (views.macro(spark, d), "series_id", "observation_date"), "corporate_event": (views.corporate_events(spark, d), "ticker", "event_date"), "news": (table(spark, d, "events"), "event_id", "ts")})
    return found.groupBy("record").agg(F.count("*").alias("n"), F.min("dated_on").alias("first"))


@query("f11_time_leak", sql("decisions", "SELECT count(*) > 0 AS succeeded, count(*) AS records, CASE WHEN count(*) > 0 THEN -0.3::DOUBLE ELSE 0 END AS confidence_delta FROM decisions WHERE decided_on > DATE '1997-06-30'"))
def f11_leak(spark, d):
    return integrity.attack(integrity.leaked(views.decisions(spark, d), "1997-06-30", "decided_on"))


@query("d16_bundle_consistency", """
WITH a AS (SELECT o_custkey AS bundle_id, o_orderkey AS artifact, CAST(o_orderdate AS DATE) AS as_of, o_orderpriority AS mode, nullif(o_orderstatus, 'P') AS commit, o_orderkey % 7 AS run_id FROM orders),
m AS (SELECT bundle_id, max(as_of) AS as_of, max(mode) AS mode, max(commit) AS commit, max(run_id) AS run_id FROM a WHERE bundle_id % 4 <> 0 GROUP BY 1)
SELECT a.bundle_id, artifact, unnest([x for x in [CASE WHEN m.bundle_id IS NULL THEN 'no_manifest' END, CASE WHEN a.as_of <> m.as_of THEN 'as_of' END, CASE WHEN a.mode <> m.mode THEN 'mode' END, CASE WHEN a.commit <> m.commit THEN 'commit' END, CASE WHEN a.run_id <> m.run_id THEN 'run_id' END,
  CASE WHEN m.as_of > a.as_of + 300 THEN 'newer_than_requested' END, CASE WHEN date_diff('day', a.as_of, m.as_of) > 0 THEN 'clock' END] if x IS NOT NULL]) AS problem FROM a LEFT JOIN m USING (bundle_id)""")
def d16(spark, d):
    o = table(spark, d, "orders")
    a = o.select(F.col("o_custkey").alias("bundle_id"), F.col("o_orderkey").alias("artifact"), F.to_date("o_orderdate").alias("as_of"), F.col("o_orderpriority").alias("mode"), F.nullif("o_orderstatus", F.lit("P")).alias("commit"), (F.col("o_orderkey") % 7).alias("run_id"))
    a = a.withColumns({"completed_at": F.col("as_of").cast("timestamp"), "last_requested": F.date_add("as_of", 300)})
    m = a.where("bundle_id % 4 <> 0").groupBy("bundle_id").agg(F.max("as_of").alias("as_of"), F.max("mode").alias("mode"), F.max("commit").alias("commit"), F.max("run_id").alias("run_id"), F.max("completed_at").alias("generated_at"))
    return integrity.bundle_problems(m, a)


@query("d19_decision_routes", "SELECT event_type AS source_id, CASE WHEN event_type <> 'error' THEN 'prices' END AS records, CASE WHEN event_type <> 'error' THEN 'memory,research' END AS consumers, event_type = 'error' AS unrouted FROM (SELECT DISTINCT event_type FROM events)")
def d19(spark, d):
    s = table(spark, d, "events").select(F.col("event_type").alias("source_id"), F.lit("IMPLEMENTED").alias("status"))
    routes = s.where("source_id <> 'error'").select("source_id").distinct().select("source_id", F.lit("prices").alias("records"), F.lit("memory,research").alias("consumers"))
    return integrity.decision_routes(s, routes)


@query("d20_artifact_violations", """
WITH v AS (SELECT 'missing:l_comment_code' AS rule, l_orderkey, l_linenumber FROM lineitem WHERE nullif(l_returnflag, 'N') IS NULL UNION ALL SELECT 'range:l_discount', l_orderkey, l_linenumber FROM lineitem WHERE l_discount < 0.01 OR l_discount > 0.09
  UNION ALL SELECT 'rule:ships_first', l_orderkey, l_linenumber FROM lineitem WHERE NOT (l_quantity <= 48) UNION ALL SELECT 'repeated_key', l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1)
SELECT rule, count(*) AS n, min(l_orderkey || '|' || l_linenumber) AS first FROM v GROUP BY 1""")
def d20_rules(spark, d):
    li = table(spark, d, "lineitem").withColumn("l_comment_code", F.nullif("l_returnflag", F.lit("N")))
    v = integrity.violations(li, ["l_orderkey", "l_linenumber"], ["l_comment_code"], {"l_discount": (0.01, 0.09)}, {"ships_first": F.col("l_quantity") <= 48})
    return v.groupBy("rule").agg(F.count("*").alias("n"), F.min("subject").alias("first"))


@query("d20_coverage", "SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def d20_coverage(spark, d):
    return integrity.uncovered(table(spark, d, "customer"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("d15_all_warnings", sql("bars decisions corporate_events", """
WITH held AS (SELECT DISTINCT ticker FROM bars WHERE substr(ticker, 7)::INT % 2 = 0), q AS (SELECT 'Brand#' || CAST(11 + decision_id % 45 AS VARCHAR) AS ticker, decision_id, horizon, decided_on, decided_on + 28 AS valid_until FROM decisions),
k AS (SELECT 'k' || decision_id AS knowledge_id, ticker, CASE decision_id % 3 WHEN 0 THEN 'RETIRED' WHEN 1 THEN 'MONITORING' ELSE 'ACTIVE' END AS status, CASE WHEN decision_id % 2 = 0 THEN decided_on END AS retired_on FROM q),
u AS (SELECT 'MACRO_RISK_INCREASED' AS category, 'CRITICAL' AS severity, NULL AS ticker UNION ALL SELECT 'PORTFOLIO_CONCENTRATION', 'WARNING', 'Brand#12' UNION ALL SELECT 'PORTFOLIO_CONCENTRATION', 'WARNING', NULL
UNION ALL SELECT 'BROKEN_THESIS', 'CRITICAL', ticker FROM k WHERE status = 'RETIRED' AND (retired_on IS NULL OR DATE '1998-01-01' - retired_on <= 14)
UNION ALL SELECT 'CATALYST_EXPIRED', 'INFO', ticker FROM corporate_events JOIN held USING (ticker) WHERE DATE '1998-01-01' - event_date BETWEEN 0 AND 7
UNION ALL SELECT 'LIQUIDITY_DETERIORATION', 'WARNING', ticker FROM (SELECT ticker FROM bars GROUP BY 1 HAVING avg(close * volume) < 250000) JOIN held USING (ticker)
UNION ALL SELECT 'REVIEW_REQUIRED', 'WARNING', ticker FROM q JOIN held USING (ticker) WHERE horizon = 'INVESTMENT' AND valid_until <= DATE '1998-01-01' UNION ALL SELECT 'REVIEW_REQUIRED', 'INFO', ticker FROM k JOIN held USING (ticker) WHERE status = 'MONITORING')
SELECT category, severity, ticker, count(*) AS n FROM u GROUP BY ALL"""))
def d15_all(spark, d):
    bars, as_of = views.bars(spark, d), "1998-01-01"
    held = bars.where(F.substring("ticker", 7, 9).cast("int") % 2 == 0).select("ticker").distinct()
    q = views.decisions(spark, d).select(F.concat(F.lit("Brand#"), 11 + F.col("decision_id") % 45).alias("ticker"), "decision_id", "horizon", "decided_on", F.date_add("decided_on", 28).alias("valid_until"))
    status = F.when(F.col("decision_id") % 3 == 0, "RETIRED").when(F.col("decision_id") % 3 == 1, "MONITORING").otherwise("ACTIVE")
    k = q.select(F.concat(F.lit("k"), "decision_id").alias("knowledge_id"), "ticker", F.array("ticker").alias("assets"), status.alias("status"), F.when(F.col("decision_id") % 2 == 0, F.col("decided_on")).alias("retired_on"))
    thin = bars.groupBy("ticker").agg(F.avg(F.col("close") * F.col("volume")).alias("traded")).where("traded < 250000")
    country = spark.sql("SELECT 'CRISIS' AS severity")
    concentration = spark.sql("SELECT 'concentrated' AS status, 'concentrated' AS sector_status, 'Brand#12' AS max_ticker")
    out = integrity.monitoring(as_of, held, q.where("horizon = 'INVESTMENT'"), k, k.select("ticker", "knowledge_id"), views.corporate_events(spark, d), thin, country, concentration)
    return out.groupBy("category", "severity", "ticker").agg(F.count("*").alias("n"))


@query("s3_macro_series", sql("macro", "SELECT series_id, observation_date, value FROM macro WHERE series_id = '3-MEDIUM' AND observation_date BETWEEN DATE '1995-01-01' AND DATE '1996-12-31'"))
def s3(spark, d):
    return views.macro(spark, d).where("series_id = '3-MEDIUM' and observation_date between date'1995-01-01' and date'1996-12-31'")


@query("s12_upsert_macro", sql("macro", "SELECT series_id, observation_date, CASE WHEN observation_date >= DATE '1997-01-01' THEN value + 1 ELSE value END AS value FROM macro"))
def s12(spark, d):
    m = views.macro(spark, d)
    late = m.where("observation_date >= date'1997-01-01'").withColumn("value", F.col("value") + 1)
    return storage.upsert(m.where("observation_date < date'1997-06-01'"), late, ["series_id", "observation_date"])


@query("s13_upsert_events", sql("corporate_events", "SELECT ticker, event_date, event_type, split_ratio, CASE WHEN event_type = 'DIVIDEND' AND event_date >= DATE '1996-01-01' THEN round(dividend_amount * 2, 4) ELSE dividend_amount END AS dividend_amount FROM corporate_events"))
def s13(spark, d):
    e = views.corporate_events(spark, d)
    new = e.where("event_type = 'DIVIDEND' and event_date >= date'1996-01-01'").withColumn("dividend_amount", F.round(F.col("dividend_amount") * 2, 4))
    return storage.upsert(e, new, ["ticker", "event_date", "event_type"])


@query("s15_s16_upsert_dimensions", "SELECT p_brand AS ticker, 'S' || CAST(p_brand[7:]::INT % 5 AS VARCHAR) AS sector, CASE WHEN p_brand[7:]::INT % 2 = 0 THEN 0.5::DOUBLE END AS weight FROM (SELECT DISTINCT p_brand FROM part)")
def s15(spark, d):
    """New members carry a weight the old table has no column for."""
    s = views.sectors(spark, d)
    new = s.where(F.substring("ticker", 7, 9).cast("int") % 2 == 0).withColumn("weight", F.lit(0.5))
    return storage.upsert(s, new, ["ticker"])
