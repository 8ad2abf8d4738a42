"""Rule mining: conditions on features, their hits, pairs, pruning, robustness.

Everything runs over long tables. A condition's hits are rows (cond_id, ticker,
trade_date, outcome); a pair of conditions is a self-join of hits by ticker and
date, counted in one aggregation instead of one pass per candidate.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed: threshold quantiles, least sample, pruning levels, cap per ticker.
QUANTILES, LEAST, MAX_OVERLAP, MAX_CORRELATION, CAP = (0.2, 0.8), 30, 0.85, 0.8, 500


def long_features(wide: DataFrame, names: list[str]) -> DataFrame:
    return wide.select("ticker", "trade_date", *names).unpivot(["ticker", "trade_date"], names, "feature_id", "value")


def conditions(features: DataFrame, quantiles=QUANTILES) -> DataFrame:
    """Per ticker and feature: below its low quantile, above its high one."""
    q = features.where("value is not null").groupBy("ticker", "feature_id").agg(*[F.percentile("value", F.lit(x)).alias(f"_q{k}") for k, x in enumerate(quantiles)])
    low = q.select("ticker", "feature_id", F.lit("<").alias("op"), F.col("_q0").alias("threshold"))
    high = q.select("ticker", "feature_id", F.lit(">").alias("op"), F.col("_q1").alias("threshold"))
    return low.unionByName(high).withColumn("cond_id", F.concat_ws(":", "feature_id", "op"))


def hits(features: DataFrame, conds: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Dates on which a condition strictly holds, with the outcome there. Null values never match."""
    rows = features.join(conds, ["ticker", "feature_id"])
    met = ((F.col("op") == ">") & (F.col("value") > F.col("threshold"))) | ((F.col("op") == "<") & (F.col("value") < F.col("threshold")))
    return rows.where(met).join(outcomes.where("outcome is not null"), ["ticker", "trade_date"]).select("ticker", "cond_id", "feature_id", "trade_date", "outcome")


def singles(found: DataFrame, least: int = LEAST) -> DataFrame:
    out = found.groupBy("ticker", "cond_id").agg(F.count("*").alias("n"), F.avg("outcome").alias("expectancy"), F.avg((F.col("outcome") > 0).cast("double")).alias("hit_rate"))
    return out.where(F.col("n") >= least)


def pairs(found: DataFrame, least: int = LEAST) -> DataFrame:
    """Two conditions on different features that hold together, with their joint outcomes."""
    b = found.select("ticker", "trade_date", F.col("cond_id").alias("second"), F.col("feature_id").alias("f2"))
    both = found.join(b, ["ticker", "trade_date"]).where("cond_id < second and feature_id <> f2")
    out = both.groupBy("ticker", F.col("cond_id").alias("first"), "second").agg(F.count("*").alias("n"), F.avg("outcome").alias("expectancy"), F.avg((F.col("outcome") > 0).cast("double")).alias("hit_rate"))
    return out.where(F.col("n") >= least)


def overlaps(found: DataFrame) -> DataFrame:
    """Jaccard index of the dates of every two conditions of a ticker."""
    size = found.groupBy("ticker", "cond_id").agg(F.count("*").alias("n"))
    b = found.select("ticker", "trade_date", F.col("cond_id").alias("second"))
    both = found.join(b, ["ticker", "trade_date"]).where("cond_id < second").groupBy("ticker", F.col("cond_id").alias("first"), "second").agg(F.count("*").alias("both"))
    out = both.join(size.select("ticker", F.col("cond_id").alias("first"), F.col("n").alias("n1")), ["ticker", "first"]).join(size.select("ticker", F.col("cond_id").alias("second"), F.col("n").alias("n2")), ["ticker", "second"])
    return out.select("ticker", "first", "second", (F.col("both") / (F.col("n1") + F.col("n2") - F.col("both"))).alias("jaccard"))


def keep_first(candidates: DataFrame, alike: DataFrame, key: str = "cond_id", order: str = "priority") -> DataFrame:
    """Greedy pruning: walk a ticker's candidates by priority and drop each one that is alike
    a kept one. The fold is over candidates of a ticker, which CAP bounds."""
    near = alike.select("ticker", F.col("first").alias(key), F.col("second").alias("other")).unionByName(alike.select("ticker", F.col("second").alias(key), F.col("first").alias("other")))
    listed = candidates.join(near.groupBy("ticker", key).agg(F.collect_set("other").alias("_near")), ["ticker", key], "left")

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values([order, key])
        kept: set[str] = set()
        mask = []
        for name, near_ in zip(part[key], part["_near"]):
            ok = near_ is None or not (set(near_) & kept)
            mask.append(ok)
            if ok:
                kept.add(name)
        return part[mask].drop(columns="_near")

    return listed.groupBy("ticker").applyInPandas(fold, candidates.schema)


def regime_profile(found: DataFrame, regimes: DataFrame, least: int = 10) -> DataFrame:
    """Expectancy per regime bucket, and a tag per rule and dimension."""
    rows = found.join(regimes.where("bucket is not null"), "trade_date")
    each = rows.groupBy("ticker", "cond_id", "dimension", "k", "bucket").agg(F.count("*").alias("n"), F.avg("outcome").alias("expectancy"))
    known = F.col("n") >= least
    up, down = F.count_if(known & (F.col("expectancy") > 0)), F.count_if(known & (F.col("expectancy") <= 0))
    tag = F.when(F.count_if(known) == 0, "insufficient").when(down == 0, "unconditional").when(up == 0, "failing").when(up == 1, "regime_specific").otherwise("sensitive")
    return each.groupBy("ticker", "cond_id", "dimension", "k").agg(F.count_if(known).alias("buckets"), up.alias("positive"), F.min(F.when(known, F.col("expectancy"))).alias("worst"), tag.alias("tag"))


def threshold_variants(features: DataFrame, conds: DataFrame, outcomes: DataFrame, deltas=(-0.25, -0.1, 0.1, 0.25), least: int = 10) -> DataFrame:
    """Does the sign survive thresholds moved by shares of the feature's deviation? All variants in one pass."""
    spread = features.where("value is not null").groupBy("ticker", "feature_id").agg(F.stddev_pop("value").alias("sd"))
    moved = conds.join(spread, ["ticker", "feature_id"]).withColumn("delta", F.explode(F.array(F.lit(0.0), *map(F.lit, deltas))))
    moved = moved.withColumn("threshold", F.col("threshold") + F.col("delta") * F.col("sd"))
    rows = features.join(moved, ["ticker", "feature_id"])
    met = ((F.col("op") == ">") & (F.col("value") > F.col("threshold"))) | ((F.col("op") == "<") & (F.col("value") < F.col("threshold")))
    each = rows.where(met).join(outcomes.where("outcome is not null"), ["ticker", "trade_date"]).groupBy("ticker", "cond_id", "delta").agg(F.count("*").alias("n"), F.avg("outcome").alias("e"))
    base = F.max(F.when(F.col("delta") == 0, F.col("e"))).over(Window.partitionBy("ticker", "cond_id"))
    each = each.withColumn("same", F.when((F.col("delta") != 0) & (F.col("n") >= least), (F.col("e") > 0) == (base > 0)))
    return each.groupBy("ticker", "cond_id").agg(F.count("same").alias("checks"), F.count_if("same").alias("agreeing"))


def baselines(bars_with_returns: DataFrame) -> DataFrame:
    """Unconditional, momentum and mean-reversion figures of `outcome` per ticker (past return in `past`)."""
    kinds = F.array_compact(F.array(F.lit("buy_and_hold"), F.when(F.col("past") > 0, "momentum"), F.when(F.col("past") < 0, "mean_reversion")))
    rows = bars_with_returns.where("outcome is not null").withColumn("name", F.explode(kinds))
    out = rows.groupBy("ticker", "name").agg(F.count("*").alias("n"), F.avg("outcome").alias("mean_outcome"), F.avg((F.col("outcome") > 0).cast("double")).alias("hit_rate"), F.stddev_pop("outcome").alias("stdev"))
    return out.where("n >= 2")
