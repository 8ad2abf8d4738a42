"""Decision records, calibration, portfolio figures, capital flows, concentration caps."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.stats import ratio

#: Fixed: limits of the portfolio layer.
MAX_POSITION, MAX_SECTOR, MAX_CLUSTER, CORRELATED, MIN_TRADED, CONCENTRATED, EPS = 0.25, 0.40, 0.40, 0.70, 1_000_000.0, 0.25, 1e-9


def performance(records: DataFrame, min_sample: int = 30) -> DataFrame:
    """Per horizon: hit rate and excess return with its lower bound, drawdown of the compounded decisions."""
    r = records.withColumn("excess", F.col("realized_return") - F.col("benchmark_return"))
    w = Window.partitionBy("horizon").orderBy("decided_on", "decision_id").rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("_log", F.sum(F.log1p("realized_return")).over(w))
    r = r.withColumn("_dd", F.exp(F.col("_log") - F.greatest(F.lit(0.0), F.max("_log").over(w))) - 1)
    n = F.count("excess")
    return r.groupBy("horizon").agg(
        F.count("*").alias("decisions"), F.avg((F.col("excess") > 0).cast("double")).alias("hit_rate"), F.avg("realized_return").alias("mean_realized"), F.avg("excess").alias("mean_excess"),
        F.percentile("excess", F.lit(0.5)).alias("median_excess"), (F.avg("excess") - 1.645 * F.stddev_samp("excess") / F.sqrt(n)).alias("excess_lower_95"),
        F.least(F.lit(0.0), F.min("_dd")).alias("max_drawdown"), F.abs(F.avg("expected_return") - F.avg("realized_return")).alias("calibration_error"),
        F.when(n >= min_sample, "sufficient").otherwise("insufficient_sample").alias("sample_status"),
    )


def reliability(records: DataFrame, bins: int = 10) -> DataFrame:
    """Count, mean confidence and hit rate per confidence bin; empty bins stay."""
    spark = records.sparkSession
    b = F.least(F.floor(F.col("confidence") * bins + 1e-12), F.lit(bins - 1)).cast("long")
    hit = (F.col("realized_return") - F.col("benchmark_return") > 0).cast("double")
    each = records.groupBy("horizon", b.alias("bin")).agg(F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence"), F.avg(hit).alias("hit_rate"))
    grid = records.select("horizon").distinct().crossJoin(spark.range(bins).withColumnRenamed("id", "bin"))
    return grid.join(each, ["horizon", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def calibration(records: DataFrame) -> DataFrame:
    """Brier score and expected calibration error per horizon."""
    hit = (F.col("realized_return") - F.col("benchmark_return") > 0).cast("double")
    brier = records.groupBy("horizon").agg(F.count("*").alias("n"), F.avg((F.col("confidence") - hit) ** 2).alias("brier"))
    ece = reliability(records).where("n > 0").groupBy("horizon").agg((F.sum(F.col("n") * F.abs(F.col("mean_confidence") - F.col("hit_rate"))) / F.sum("n")).alias("ece"))
    return brier.join(ece, "horizon")


def illiquid(universe: DataFrame, bars: DataFrame, least: float = MIN_TRADED) -> DataFrame:
    """Universe members without bars or with too little mean traded value."""
    traded = bars.groupBy("ticker").agg(F.avg(F.col("close") * F.col("volume")).alias("traded"))
    return universe.join(traded, "ticker", "left").where(F.coalesce("traded", F.lit(0.0)) < least)


def construct(scores: DataFrame, by: list[str], max_position: float = MAX_POSITION, multiplier: float = 1.0) -> DataFrame:
    """Weights in proportion to positive scores, capped per position; the rest is cash."""
    w = Window.partitionBy(*by)
    rows = scores.where("score > 0").withColumn("_t", F.sum("score").over(w))
    return rows.withColumn("weight", F.least(ratio(F.col("score"), F.col("_t")), F.lit(max_position), F.col("max_position")) * multiplier).drop("_t")


def validate_portfolio(positions: DataFrame, by: list[str]) -> DataFrame:
    """Concentration, sector exposure and downside of weights (ticker, sector, weight, expected_risk)."""
    order = Window.partitionBy(*by).orderBy(F.col("weight").desc(), "ticker")
    rows = positions.withColumn("_r", F.row_number().over(order))
    whole = rows.groupBy(*by).agg(
        F.sum("weight").alias("invested"), F.sum(F.col("weight") ** 2).alias("herfindahl"), F.max("weight").alias("max_weight"), F.min_by("ticker", "_r").alias("max_ticker"),
        F.sum(F.when(F.col("_r") <= 3, F.col("weight"))).alias("top_3"), ratio(F.sum(F.col("weight") * F.col("expected_risk")), F.sum("weight")).alias("downside"),
    )
    sector = positions.groupBy(*by, "sector").agg(F.sum("weight").alias("w")).groupBy(*by).agg(F.max("w").alias("max_sector_weight"))
    out = whole.join(sector, by)
    return out.withColumns({"status": F.when(F.col("herfindahl") > CONCENTRATED, "concentrated").otherwise("diversified"), "sector_status": F.when(F.col("max_sector_weight") > MAX_SECTOR, "concentrated").otherwise("diversified")})


def capital_flows(positions: DataFrame, by: list[str]) -> DataFrame:
    """Which cash and which weaker holdings fund which demand.

    Demand by rank and supply (cash first, then the weakest holding) are laid
    end to end on one axis; a flow is where two intervals overlap. What no
    demand takes goes to cash. positions: ticker, rank, current, target.
    """
    d = F.col("target") - F.col("current")
    w_demand = Window.partitionBy(*by).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    w_supply = Window.partitionBy(*by).orderBy(F.col("rank").desc()).rowsBetween(Window.unboundedPreceding, 0)
    cash = positions.groupBy(*by).agg(F.greatest(F.lit(0.0), 1 - F.sum("current")).alias("amount"))
    demand = positions.where(d > EPS).withColumn("need", d).withColumn("hi", F.sum("need").over(w_demand)).withColumn("lo", F.col("hi") - F.col("need")).select(*by, F.col("ticker").alias("to_ticker"), "lo", "hi")
    supply = positions.where(-d > EPS).withColumn("amount", -d).withColumn("s_hi", F.sum("amount").over(w_supply)).withColumn("s_lo", F.col("s_hi") - F.col("amount"))
    supply = supply.join(cash.select(*by, F.col("amount").alias("_cash")), by).select(*by, F.col("ticker").alias("from_ticker"), (F.col("s_lo") + F.col("_cash")).alias("s_lo"), (F.col("s_hi") + F.col("_cash")).alias("s_hi"))
    supply = supply.unionByName(cash.where(F.col("amount") > EPS).select(*by, F.lit(None).cast("string").alias("from_ticker"), F.lit(0.0).alias("s_lo"), F.col("amount").alias("s_hi")))
    amount = F.least("hi", "s_hi") - F.greatest("lo", "s_lo")
    flows = demand.join(supply, by).where(amount > EPS).select(*by, "from_ticker", "to_ticker", amount.alias("amount"))
    top = demand.groupBy(*by).agg(F.max("hi").alias("_d"))
    idle = supply.where("from_ticker is not null").join(top, by, "left").withColumn("amount", F.col("s_hi") - F.greatest("s_lo", F.coalesce("_d", F.lit(0.0))))
    return flows.unionByName(idle.where(F.col("amount") > EPS).select(*by, "from_ticker", F.lit(None).cast("string").alias("to_ticker"), "amount"))


def concentration_caps(targets: DataFrame, by: str, correlations: DataFrame | None = None, max_sector: float = MAX_SECTOR, max_cluster: float = MAX_CLUSTER) -> DataFrame:
    """Weights after sector and correlated-cluster caps, granted greedily from the largest on.

    Order decides, so each portfolio is one fold over its positions, whose
    number is bounded by what a portfolio may hold.
    """
    rows = targets.withColumn("_near", F.lit(None).cast("array<string>"))
    if correlations is not None:
        both = correlations.where(F.col("correlation") >= CORRELATED)
        near = both.select(F.col("a").alias("ticker"), F.col("b").alias("o")).unionByName(both.select(F.col("b").alias("ticker"), F.col("a").alias("o"))).groupBy("ticker").agg(F.collect_set("o").alias("_near"))
        rows = targets.join(near, "ticker", "left").select(*targets.columns, "_near")

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["weight", "ticker"], ascending=[False, True])
        used: dict[str, float] = {}
        given: dict[str, float] = {}
        out = []
        for ticker, sector, weight, near_ in zip(part["ticker"], part["sector"], part["weight"], part["_near"]):
            w = float(weight)
            if w > EPS:
                if sector is not None:
                    w = min(w, max(0.0, max_sector - used.get(sector, 0.0)))
                    used[sector] = used.get(sector, 0.0) + w
                cluster = sum(given.get(o, 0.0) for o in (near_ if near_ is not None else ()))
                if w > EPS and cluster > EPS:
                    w = min(w, max(0.0, max_cluster - cluster))
                given[ticker] = w
            out.append(w)
        return part.drop(columns="_near").assign(capped=out)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in targets.schema) + ", capped double"
    return rows.groupBy(by).applyInPandas(fold, schema)


def macro_overlay(series: DataFrame, factors: DataFrame) -> DataFrame:
    """Score of the last change of each factor's first usable series. factors: factor, position, series_id, weight, direction."""
    w = Window.partitionBy("series_id").orderBy(F.col("observation_date").desc())
    last = series.withColumn("_r", F.row_number().over(w)).where("_r <= 2").groupBy("series_id").agg(F.max(F.when(F.col("_r") == 1, F.col("value"))).alias("now"), F.max(F.when(F.col("_r") == 2, F.col("value"))).alias("before"))
    usable = factors.join(last.where("before is not null"), "series_id").groupBy("factor").agg(F.min_by(F.struct("weight", "direction", "now", "before"), "position").alias("f")).select("factor", "f.*").where("before <> 0")
    signal = F.signum(F.col("now") - F.col("before")) * F.col("direction")
    s = usable.agg(F.count("*").alias("factors"), F.sum("weight").alias("available"), ratio(F.sum(F.col("weight") * signal), F.sum("weight")).alias("score"))
    decision = F.when(F.col("score").isNull(), "insufficient_data").when(F.col("score") > 0.25, "supportive").when(F.col("score") >= -0.25, "cautious").otherwise("defensive")
    multiplier = F.when(F.col("score").isNull() | (F.col("score") > 0.25), 1.0).when(F.col("score") >= -0.25, 0.75).otherwise(0.5)
    return s.select("factors", "available", "score", decision.alias("decision"), multiplier.alias("exposure_multiplier"))


def weighted_view(knowledge: DataFrame, keys: list[str]) -> DataFrame:
    """Confidence-weighted return and risk; confidence is the smaller of mean and maximum."""
    k = knowledge.where("confidence > 0")
    t = F.sum("confidence")
    return k.groupBy(*keys).agg(ratio(F.sum(F.col("confidence") * F.col("expected_return")), t).alias("expected_return"), ratio(F.sum(F.col("confidence") * F.col("expected_risk")), t).alias("expected_risk"), F.least(F.avg("confidence"), F.max("confidence")).alias("confidence"))


def quality_gate(checks: dict[str, Column], confidence: Column) -> dict[str, Column]:
    """All checks, the failing ones, and the position cap that confidence allows."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))
    return {"failed_checks": failed, "passed": F.size(failed) == 0, "position_cap": F.least(F.lit(0.05), F.greatest(F.lit(0.01), confidence * 0.05))}
