"""Research decisions: actions, readiness, theses, reviews, lifecycles, agents' findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.stats import change, clamp, pearson, ratio
from .features import by, back, ret

#: Fixed: days a decision stands per horizon, observations a horizon needs, penalties.
VALID_DAYS, LEAST_BARS = {"MICRO": 3, "SWING": 28, "INVESTMENT": 183}, {"MICRO": 60, "SWING": 120, "INVESTMENT": 252}
RED_FLAGS = ("no automated access", "scraping is prohibited", "no scraping", "may not copy", "prohibits automated")
GREEN_FLAGS = ("open data", "public api", "creative commons", "free to use", "api documentation")


def actions(predictions: DataFrame) -> DataFrame:
    """Action, score, validity and invalidation level of predictions (expected_return, expected_risk, confidence, reference_price, horizon, as_of)."""
    score = F.col("expected_return") * F.col("confidence") / F.greatest(F.col("expected_risk"), F.lit(1e-9))
    act = F.when(F.col("confidence") < 0.60, "ABSTAIN").when(F.col("expected_return") <= 0, "AVOID").when(score >= 1.0, F.when(F.col("reference_price").isNull(), "ABSTAIN").otherwise("BUY_CANDIDATE")).otherwise("WATCH")
    days: Column = F.lit(None)
    for horizon, n in VALID_DAYS.items():
        days = F.when(F.col("horizon") == horizon, n).otherwise(days)
    out = predictions.withColumns({"score": score, "action": act, "valid_until": F.date_add("as_of", days.cast("int"))})
    return out.withColumn("invalidation", F.when(F.col("action") == "BUY_CANDIDATE", F.col("reference_price") * (1 - clamp(F.col("expected_risk"), 0.02, 0.25))))


def readiness(rows: DataFrame) -> DataFrame:
    """Blockers per ticker and horizon from one wide row (n_bars, stale_days, n_macro, gap, liquid)."""
    need: Column = F.lit(0)
    for horizon, n in LEAST_BARS.items():
        need = F.when(F.col("horizon") == horizon, n).otherwise(need)
    tests = {"too_few_bars": F.col("n_bars") >= need, "stale_price": F.col("stale_days") <= 7, "too_little_macro": F.col("n_macro") >= 3, "fair_value_gap": F.coalesce(F.abs("gap") <= 0.20, F.lit(True)), "illiquid": F.col("liquid")}
    blockers = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in tests.items()]))
    return rows.withColumn("blockers", blockers).withColumn("ready", F.size("blockers") == 0)


def legality(sources: DataFrame) -> DataFrame:
    """Verdict on a source from its robots rule, its terms and how it is read."""
    corpus = F.lower(F.coalesce("terms", F.lit("")))
    has = lambda flags: F.exists(F.array(*map(F.lit, flags)), lambda f: corpus.contains(f))
    red, green = has(RED_FLAGS), has(GREEN_FLAGS)
    verdict = (
        F.when(F.col("robots_allows") == F.lit(False), "BLOCKED").when(red & ~green, "BLOCKED").when(F.col("access_method") == "HTML_SCRAPE", "AMBIGUOUS")
        .when(red | F.col("robots_allows").isNull(), "AMBIGUOUS").otherwise("ALLOWED")
    )
    return sources.withColumn("verdict", verdict)


def thesis(original: DataFrame, current: DataFrame, retired: DataFrame, as_of: str) -> DataFrame:
    """Status of each thesis: broken assumptions, new contradictions, catalysts that remain.
    original/current: ticker, catalysts, contradictions, (knowledge_ids, review_on | action). Without a current view the
    lists of the comparison are empty and the thesis has expired."""
    now = current.select("ticker", F.col("catalysts").alias("c_now"), F.col("contradictions").alias("x_now"), "action")
    # each assumption meets the retired knowledge by its id: neither list is gathered whole
    used = original.select("ticker", F.explode("knowledge_ids").alias("knowledge_id")).join(retired.select("knowledge_id").distinct(), "knowledge_id", "left_semi")
    gone = used.groupBy("ticker").agg(F.collect_set("knowledge_id").alias("gone"))
    r = original.join(now, "ticker", "left").join(gone, "ticker", "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<string>")))
    listed = lambda c: F.coalesce(F.array_sort(c), F.array().cast("array<string>"))
    r = r.withColumns(
        {
            "broken": F.array_sort("gone"), "new_contradictions": listed(F.array_except("x_now", "contradictions")),
            "remaining": listed(F.array_intersect("catalysts", "c_now")), "lapsed": listed(F.array_except("catalysts", "c_now")), "overdue": F.coalesce(F.lit(as_of).cast("date") > F.col("review_on"), F.lit(False)),
        }
    )
    some = F.size("broken") > 0
    status = F.when(F.col("action").isNull(), "EXPIRED").when(some & F.col("action").isin("EXIT", "REDUCE_POSITION"), "BROKEN").when(some | (F.size("new_contradictions") > 0) | F.col("overdue"), "WEAKENING").otherwise("ALIVE")
    return r.select("ticker", status.alias("status"), "broken", "new_contradictions", "remaining", "lapsed", "overdue")


def country_risk(currency: DataFrame, ratings: DataFrame, as_of: str, by: str, floor: float = 0.05, lookback: int = 180) -> DataFrame:
    """A row per value of `by` (the currency or country): severity from the currency's whole move and from recent rating actions.
    currency: by, observation_date, value; ratings: by, announced_at, action, outlook. Without recent ratings the move alone decides."""
    c = currency.groupBy(by).agg(change(F.max_by("value", "observation_date"), F.min_by("value", "observation_date")).alias("move"), F.count("*").alias("n"))
    recent = F.col("announced_at").between(F.date_sub(F.lit(as_of).cast("date"), lookback), F.lit(as_of).cast("date"))
    a = ratings.groupBy(by).agg(F.count_if(recent & (F.col("action") == "downgrade")).alias("downgrades"), F.count_if(recent & (F.col("outlook") == "negative")).alias("negative"))
    severity = F.when(F.col("downgrades") > 0, "CRISIS").when(((F.col("n") >= 2) & (F.abs("move") >= floor)) | (F.col("negative") > 0), "DETERIORATING").otherwise("NORMAL")
    return c.join(a, by, "left").select(by, "move", severity.alias("severity"))


def candidates(rows: DataFrame) -> DataFrame:
    """Undervalued tickers and how complete the evidence is (n_models, n_bars, n_macro, n_periods)."""
    part = lambda c, n: F.least(F.col(c) / n, F.lit(1.0))
    confidence = 0.50 * part("n_models", 3) + 0.20 * part("n_bars", 252) + 0.15 * part("n_macro", 3) + 0.15 * part("n_periods", 3)
    out = rows.where((F.col("price") > 0) & (F.col("fair_value") > F.col("price")))
    return out.withColumns({"expected_return": F.round(F.col("fair_value") / F.col("price") - 1, 4), "confidence": F.round(confidence, 4)})


def blended(predictions: DataFrame, fair_weight: float = 0.20, carry_weight: float = 0.10, risk_free: float = 0.125) -> DataFrame:
    """Expected return with the fair-value gap and the earnings-yield carry mixed in, each bounded."""
    implied = clamp(F.try_divide("fair_value", "price") - 1, -1.0, 2.0)
    mixed = F.when(implied.isNull(), F.col("expected_return")).otherwise((1 - fair_weight) * F.col("expected_return") + fair_weight * implied)
    carry = F.when(F.col("pe") > 0, clamp(1 / F.col("pe") - risk_free, -0.5, 0.5))
    return predictions.withColumn("expected_return", F.when(carry.isNull(), mixed).otherwise((1 - carry_weight) * mixed + carry_weight * carry))


def combined(horizons: DataFrame, weights: dict[str, float]) -> DataFrame:
    """One view per ticker: horizons weighted by horizon weight and confidence."""
    w: Column = F.lit(0.0)
    for horizon, x in weights.items():
        w = F.when(F.col("horizon") == horizon, x).otherwise(w)
    r = horizons.withColumn("_w", w * F.col("confidence"))
    return r.groupBy("ticker").agg(ratio(F.sum(F.col("_w") * F.col("expected_return")), F.sum("_w")).alias("expected_return"), ratio(F.sum(F.col("_w") * F.col("expected_risk")), F.sum("_w")).alias("expected_risk"), F.sum("_w").alias("weight"))


def evaluated(decisions: DataFrame, bars: DataFrame, benchmark: DataFrame, as_of: str, cost_bps: float = 20.0) -> DataFrame:
    """Outcome of decisions whose validity has ended: first price on or after both dates, less costs and the benchmark."""
    from .asof import first_after

    due = decisions.where(F.col("valid_until") <= F.lit(as_of).cast("date"))
    r = first_after(due, bars, ["ticker"], "as_of", "trade_date", "adj", "entry")
    r = first_after(r, bars, ["ticker"], "valid_until", "trade_date", "adj", "exit")
    # the benchmark is one series: only the days of decisions, a calendar, meet it in one task
    days = due.select(F.explode(F.array("as_of", "valid_until")).alias("_day")).distinct().withColumn("_all", F.lit(0))
    level = first_after(days, benchmark.withColumn("_all", F.lit(0)), ["_all"], "_day", "trade_date", "level").drop("_all")
    for day, name in (("as_of", "b_entry"), ("valid_until", "b_exit")):
        r = r.join(level.select(F.col("_day").alias(day), F.col("level").alias(name)), day, "left")
    cost = cost_bps / 10_000
    r = r.withColumns({"realized_return": change(F.col("exit"), F.col("entry")) - cost, "benchmark_return": change(F.col("b_exit"), F.col("b_entry")) - cost})
    status = F.when(F.col("entry").isNull() | F.col("exit").isNull(), "INSUFFICIENT_DATA").otherwise("EVALUATED")
    return r.withColumns({"excess_return": F.col("realized_return") - F.col("benchmark_return"), "status": status}).withColumn("hit", F.col("excess_return") > 0)


def counterfactual(evidence: DataFrame) -> DataFrame:
    """Confidence-weighted return of each ticker without one evidence category at a time: sums minus sums, no re-aggregation per category."""
    each = evidence.groupBy("ticker", "category").agg(F.sum("confidence").alias("w"), F.sum(F.col("confidence") * F.col("expected_return")).alias("x"))
    t = Window.partitionBy("ticker")
    return each.select("ticker", "category", ratio(F.sum("x").over(t), F.sum("w").over(t)).alias("all"), F.try_divide(F.sum("x").over(t) - F.col("x"), F.nullif(F.round(F.sum("w").over(t) - F.col("w"), 9), F.lit(0.0))).alias("without"))


def attribution(evidence: DataFrame) -> DataFrame:
    """Share of a ticker's weighted return that each category brings."""
    each = evidence.groupBy("ticker", "category").agg(F.sum(F.col("confidence") * F.col("expected_return")).alias("part"), F.sum("confidence").alias("w"))
    return each.select("ticker", "category", F.try_divide("part", F.sum("w").over(Window.partitionBy("ticker"))).alias("contribution"))


def decayed(live: DataFrame, least: int = 10, drop: float = 0.20) -> DataFrame:
    """Patterns whose live outcomes lag their history: rows (pattern_id, actual, hit_rate, expectancy)."""
    a = live.where("actual is not null").groupBy("pattern_id", "hit_rate", "expectancy").agg(F.count("*").alias("n"), F.avg((F.col("actual") > 0).cast("double")).alias("live_hit_rate"), F.avg("actual").alias("live_expectancy"))
    bad = (F.col("live_hit_rate") < F.col("hit_rate") - drop) | ((F.col("live_expectancy") > 0) != (F.col("expectancy") > 0))
    return a.withColumn("flagged", (F.col("n") >= least) & bad)


def retire(performance: DataFrame, least: int = 3) -> DataFrame:
    """Knowledge whose realised sign disagrees with the expected one in most of at least `least` records."""
    r = performance.groupBy("knowledge_id").agg(F.count("*").alias("n"), F.count_if((F.col("realized") > 0) != (F.col("expected") > 0)).alias("against"))
    return r.withColumn("retire", (F.col("n") >= least) & (F.col("against") * 2 > F.col("n")))


def live_matches(features: DataFrame, conds: DataFrame, as_of: str) -> DataFrame:
    """Rules whose every condition holds on the last known value at `as_of`, and how far values clear thresholds."""
    last = features.where((F.col("trade_date") <= F.lit(as_of).cast("date")) & F.col("value").isNotNull()).groupBy("ticker", "feature_id").agg(F.max_by("value", "trade_date").alias("value"))
    r = conds.join(last, ["ticker", "feature_id"], "left")
    met = ((F.col("op") == ">") & (F.col("value") > F.col("threshold"))) | ((F.col("op") == "<") & (F.col("value") < F.col("threshold")))
    margin = F.abs(F.try_divide(F.col("value") - F.col("threshold"), F.abs("threshold")))
    out = r.groupBy("ticker", "rule_id").agg(F.count("*").alias("n"), F.count_if(met).alias("met"), F.avg(margin).alias("margin"))
    return out.where("n = met").select("ticker", "rule_id", (1 / (1 + F.coalesce("margin", F.lit(0.0)))).alias("quality"))


# ---- agents: each gives findings (agent, subject, statistic) -------------------------------------------------------


def technical_findings(bars: DataFrame, least: float = 0.005) -> DataFrame:
    """Short over long moving average on the last day."""
    r = bars.withColumn("gap", F.try_divide(F.avg("adj").over(back(3)), F.avg("adj").over(back(8))) - 1).withColumn("n", F.row_number().over(by()))
    last = r.where("n >= 8").groupBy("ticker").agg(F.max_by("gap", "trade_date").alias("statistic"))
    return last.where(F.abs("statistic") >= least).select(F.lit("technical").alias("agent"), F.col("ticker").alias("subject"), "statistic")


def liquidity_findings(bars: DataFrame, least: float = 0.5) -> DataFrame:
    """Yesterday's volume z-score against today's return."""
    whole = Window.partitionBy("ticker")
    z = F.try_divide(F.col("volume") - F.avg("volume").over(whole), F.nullif(F.stddev_pop("volume").over(whole), F.lit(0.0)))
    r = bars.withColumns({"r": ret(1), "z": z}).withColumn("z1", F.lag("z", 1).over(by()))
    out = r.groupBy("ticker").agg(pearson(F.col("z1"), F.col("r")).alias("statistic"))
    return out.where(F.abs("statistic") >= least).select(F.lit("liquidity").alias("agent"), F.col("ticker").alias("subject"), "statistic")


def structure_findings(correlations: DataFrame, least: float = 0.5, top: int = 250) -> DataFrame:
    """The strongest pairs; a report of bounded length."""
    r = correlations.where(F.abs("correlation") >= least).orderBy(F.abs("correlation").desc(), "a", "b").limit(top)
    return r.select(F.lit("market_structure").alias("agent"), F.concat_ws("~", "a", "b").alias("subject"), F.col("correlation").alias("statistic"))


def macro_findings(bars: DataFrame, series: DataFrame, least: float = 0.5) -> DataFrame:
    """Last macro change at each trading day against the day's return."""
    from .asof import as_of_row

    w = Window.partitionBy("series_id").orderBy("observation_date")
    moves = series.withColumn("move", change(F.col("value"), F.lag("value").over(w))).where("move is not null")
    days = bars.withColumn("r", ret(1)).where("r is not null").select("ticker", "trade_date", "r")
    names = F.broadcast(series.agg(F.collect_set("series_id").alias("_all")))  # one row
    spread = days.crossJoin(names).withColumn("series_id", F.explode("_all")).drop("_all")
    r = as_of_row(spread, moves, ["series_id"], "trade_date", "observation_date", "move")
    out = r.where("move is not null").groupBy("ticker", "series_id").agg(pearson(F.col("move"), F.col("r")).alias("statistic"), F.count("*").alias("n")).where("n >= 4")
    return out.where(F.abs("statistic") >= least).select(F.lit("macro").alias("agent"), F.concat_ws("~", "ticker", "series_id").alias("subject"), "statistic")


def performance_findings(growth: DataFrame, least: float = 0.05) -> DataFrame:
    """Mean growth of the later half of the periods less that of the earlier half."""
    w = Window.partitionBy("ticker")
    r = growth.where("yoy is not null").withColumns({"i": F.row_number().over(w.orderBy("period_end_date")), "n": F.count("*").over(w)}).where("n >= 4")
    late = F.col("i") > F.floor(F.col("n") / 2)
    out = r.groupBy("ticker").agg((F.avg(F.when(late, F.col("yoy"))) - F.avg(F.when(~late, F.col("yoy")))).alias("statistic"))
    return out.where(F.abs("statistic") >= least).select(F.lit("financial_performance").alias("agent"), F.col("ticker").alias("subject"), "statistic")
