"""Distributions of outcomes, and the tests that rules must pass."""

from __future__ import annotations

import math
import random
import statistics

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from ..functions.stats import ratio

#: Fixed: cost levels in basis points, the default level, Euler's constant.
COST_GRID, DEFAULT_COST, EULER = (0.0, 5.0, 10.0, 20.0, 50.0, 100.0), 20.0, 0.5772156649015329


def distribution(rows: DataFrame, keys: list[str], outcome: str = "outcome") -> DataFrame:
    """Sample figures of outcomes per group in one aggregation; groups of fewer than two drop."""
    o = F.col(outcome)
    low = F.least(o, F.lit(0.0))
    lost = F.sum(F.when(o < 0, o))
    out = rows.where(o.isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("sample_count"), F.avg((o > 0).cast("double")).alias("hit_rate"), F.avg(o).alias("expectancy"), F.percentile(o, F.lit(0.5)).alias("median_outcome"),
        F.stddev_pop(o).alias("stdev"), F.sqrt(F.avg(low * low)).alias("downside_deviation"), F.when(lost != 0, ratio(F.coalesce(F.sum(F.when(o > 0, o)), F.lit(0.0)), -lost)).alias("profit_factor"),
    )
    return out.where("sample_count >= 2")


def stability(rows: DataFrame, keys: list[str], day: str, outcome: str = "outcome", buckets: int = 4) -> DataFrame:
    """Share of equal date-ordered buckets (the last takes the rest) whose mean has the sign of the whole."""
    whole = Window.partitionBy(*keys)
    r = rows.where(F.col(outcome).isNotNull()).withColumns({"_i": F.row_number().over(whole.orderBy(day)) - 1, "_n": F.count("*").over(whole)})
    size = F.floor(F.col("_n") / buckets)
    r = r.where(F.col("_n") >= 2 * buckets).withColumn("_b", F.least(F.floor(F.col("_i") / size), F.lit(buckets - 1)))
    each = r.groupBy(*keys, "_b").agg(F.avg(outcome).alias("_m"), F.sum(outcome).alias("_s"))
    each = each.withColumn("_w", F.sum("_s").over(whole) >= 0)
    return each.groupBy(*keys).agg((F.count_if((F.col("_m") >= 0) == F.col("_w")) / buckets).alias("stability"))


def numbered(rows: DataFrame, order: list[str], parts: int | None = None) -> DataFrame:
    """Add `_r`, the row number over the whole table in this order, and `_part`, the range it lies in.

    Rows are dealt into ranges and numbered within; the sizes of the ranges before are added. No task holds more than a range."""
    from ..plans.stage import written

    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(rows.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))  # one row per range
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.withColumn("_k", own).join(F.broadcast(before), "_part").withColumn("_r", F.col("_k") + F.col("_before")).drop("_k", "_before")


def _fdr_of_all(rows: DataFrame, p: str, alpha: float, dependent: bool) -> DataFrame:
    from ..plans.stage import written

    r = written(numbered(rows, [p, *[c for c in rows.columns if c != p]]), "ranks")
    size = r.agg(F.count("*").alias("_m"), (F.sum(1.0 / F.col("_r")) if dependent else F.lit(1.0)).alias("_c"))
    r = r.join(F.broadcast(size))  # one row
    raw = F.col(p) * F.col("_m") * F.col("_c") / F.col("_r")
    last = r.agg(F.coalesce(F.max(F.when(F.col(p) <= F.col("_r") / F.col("_m") * alpha / F.col("_c"), F.col("_r"))), F.lit(0)).alias("_last"))
    lows = r.groupBy("_part").agg(F.min(raw).alias("_low"))  # one row per range
    after = lows.select("_part", F.min("_low").over(Window.partitionBy(F.lit(0)).orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)).alias("_after"))
    r = r.join(F.broadcast(last)).join(F.broadcast(after), "_part")
    here = F.min(raw).over(Window.partitionBy("_part").orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, 0))
    return r.withColumns({"accepted": F.col("_r") <= F.col("_last"), "q_value": F.least(F.lit(1.0), here, F.col("_after"))}).select(*rows.columns, "accepted", "q_value")


def fdr_mask(rows: DataFrame, p: str, alpha: float, within: list[str] | None = None, dependent: bool = False) -> DataFrame:
    """Benjamini-Hochberg (or, for dependent tests, Benjamini-Yekutieli) acceptance and adjusted values.

    All tests together are ranked range by range, those `within` a key in one window a key."""
    if not within:
        return _fdr_of_all(rows, p, alpha, dependent)
    base = Window.partitionBy(*within)
    order = base.orderBy(p, *[c for c in rows.columns if c != p])
    r = rows.withColumns({"_r": F.row_number().over(order), "_m": F.count("*").over(base)})
    r = r.withColumn("_c", F.sum(1.0 / F.col("_r")).over(base) if dependent else F.lit(1.0))
    last = F.max(F.when(F.col(p) <= F.col("_r") / F.col("_m") * alpha / F.col("_c"), F.col("_r"))).over(base)
    q = F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") * F.col("_c") / F.col("_r")).over(base.orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, 0)))
    return r.withColumns({"accepted": F.col("_r") <= F.coalesce(last, F.lit(0)), "q_value": q}).drop("_r", "_m", "_c")


def family_key(feature: Column, ticker: Column, target: Column, regime: Column) -> Column:
    """The family of a rule: its feature without window, ticker, target and whether a regime limits it."""
    base = F.coalesce(F.regexp_replace(feature, r"_\d+d(?=:)", ""), F.lit("no_condition"))
    return F.concat_ws("|", ticker, base, target, F.when(regime.isNotNull(), "regime").otherwise("no_regime"))


def bonferroni(p: Column, size: Column) -> Column:
    return F.least(F.lit(1.0), p * F.greatest(F.lit(1), size))


def cost_grid(rows: DataFrame, keys: list[str], outcome: str = "outcome", grid=COST_GRID) -> DataFrame:
    """Net expectancy and hit rate at each cost level; the level is exploded before the aggregation, which combines map-side."""
    net = F.col(outcome) - F.col("cost_bps") / 10_000
    levels = rows.where(F.col(outcome).isNotNull()).withColumn("cost_bps", F.explode(F.array(*map(F.lit, grid))))
    out = levels.groupBy(*keys, "cost_bps").agg(F.count("*").alias("n"), F.avg(net).alias("net_expectancy"), F.avg((net > 0).cast("double")).alias("net_hit_rate"))
    return out.withColumn("survives", F.col("net_expectancy") > 0)


def walk_forward(rows: DataFrame, key: str, day: str, outcome: str, matched: str, folds: int = 4, train: int = 30, least: int = 10) -> DataFrame:
    """Per key: out-of-sample figures over expanding folds and whether the rule survives.

    Folds are arithmetic on the row number: no fold is materialised.
    """
    whole = Window.partitionBy(key)
    r = rows.withColumns({"_i": F.row_number().over(whole.orderBy(day)) - 1, "_n": F.count("*").over(whole)})
    size = F.greatest(F.lit(1), F.floor((F.col("_n") - train) / folds))
    fold = F.when((F.col("_i") >= train) & (F.col("_n") >= train + folds), F.floor((F.col("_i") - train) / size))
    r = r.withColumn("_f", F.when(fold < folds, fold)).where(F.col(matched) & F.col(outcome).isNotNull())
    out = r.groupBy(key).agg(F.count("*").alias("n"), F.avg(outcome).alias("expectancy"), F.count("_f").alias("oos_n"), F.avg(F.when(F.col("_f").isNotNull(), F.col(outcome))).alias("oos_expectancy"), F.countDistinct("_f").alias("folds"))
    return out.withColumn("survived", (F.col("oos_n") >= least) & ((F.col("oos_expectancy") > 0) == (F.col("expectancy") > 0)))


def purged_end(train_end: int, test_start: int, horizon: int, embargo: int) -> int:
    return min(train_end, max(0, test_start - horizon - embargo))


# ---- seeded procedures; a group is one rule's outcomes -------------------------------------------------------------


def block_bootstrap_p(values: list[float], iterations: int = 1000, seed: int = 42) -> float:
    """Two-sided sign p-value by circular blocks of about the cube root of n."""
    n = len(values)
    if n < 5:
        return 1.0
    rng, block = random.Random(seed), min(n, max(2, round(n ** (1 / 3))))
    x = np.asarray(values, float)
    need = -(-n // block)
    sums = np.concatenate(([0.0], np.cumsum(np.concatenate((x, x)))))  # sum of any circular block
    length = np.full(need, block)
    length[-1] = n - (need - 1) * block
    means = np.empty(iterations)
    for i in range(iterations):  # one resample at a time: memory does not grow with their number
        start = np.array([rng.randrange(n) for _ in range(need)])
        means[i] = (sums[start + length] - sums[start]).sum() / n
    opposite = int(((means <= 0) != (x.mean() <= 0)).sum())
    return min(1.0, 2 * min(opposite, iterations - opposite) / iterations)


def bootstrap_interval(values: list[float], iterations: int = 1000, seed: int = 42, alpha: float = 0.05) -> tuple[float, float, float]:
    """Percentile interval of the mean and its sign p-value by independent resampling."""
    n, rng = len(values), random.Random(seed)
    x = np.asarray(values, float)
    means = np.empty(iterations)
    for i in range(iterations):
        means[i] = x[np.array([rng.randrange(n) for _ in range(n)])].mean()
    opposite = int(((means <= 0) != (x.mean() <= 0)).sum())
    means.sort()
    return float(means[max(0, int(alpha / 2 * iterations))]), float(means[min(iterations - 1, int((1 - alpha / 2) * iterations))]), min(1.0, 2 * min(opposite, iterations - opposite) / iterations)


def deflated_sharpe(values: list[float], trials: int, variance: float = 1.0) -> float | None:
    """Probability that the mean over deviation beats the best of `trials` noise runs."""
    n = len(values)
    if n < 5:
        return None
    x = np.asarray(values, float)
    d = x - x.mean()
    m2 = (d**2).mean()
    sharpe = x.mean() / math.sqrt(m2) if m2 > 0 else 0.0
    skew, kurt = ((d**3).mean() / m2**1.5, (d**4).mean() / m2**2) if m2 > 0 else (0.0, 3.0)
    normal = statistics.NormalDist()
    best = 0.0
    if trials > 1 and variance > 0:
        best = math.sqrt(variance) * ((1 - EULER) * normal.inv_cdf(1 - 1 / trials) + EULER * normal.inv_cdf(1 - 1 / (trials * math.e)))
    spread = max(1e-9, 1 - skew * sharpe + (kurt - 1) / 4 * sharpe**2)
    return normal.cdf((sharpe - best) * math.sqrt(n - 1) / math.sqrt(spread))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    f, c, d = 1.0, 1.0, 0.0
    for k in range(300):
        m = k // 2
        term = 1.0 if k == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if k % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / max(1 + term * d, 1e-300) if 1 + term * d > 0 else 1 / (1 + term * d or 1e-300)
        c = 1 + term / c if abs(c) > 1e-300 else 1e300
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1) / a if a else 0.0


def t_test_p(mean: float, deviation: float, n: int) -> float | None:
    """Two-sided p-value of a one-sample t statistic."""
    if n < 2 or deviation <= 0:
        return None
    t = mean / (deviation / math.sqrt(n))
    v = n - 1
    return incomplete_beta(v / 2, 0.5, v / (v + t * t))


def t_test(mean: Column, deviation: Column, n: Column) -> Column:
    """`t_test_p` over aggregated rows; one call per rule, not per outcome."""

    def p(mean: pd.Series, deviation: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if s is None or s != s else t_test_p(m, s, int(k)) for m, s, k in zip(mean, deviation, n)], dtype=float)

    return F.pandas_udf(p, DoubleType())(mean, deviation, n)


def tested(rows: DataFrame, key: str, outcome: str = "outcome", trials: int = 100, iterations: int = 1000) -> DataFrame:
    """Bootstrap interval and p-values, block p-value, deflated Sharpe ratio and t-test per rule."""

    def test(part: pd.DataFrame) -> pd.DataFrame:
        x = part.sort_values(["_d"])[outcome].tolist()
        if len(x) < 2:
            return pd.DataFrame(columns=["k"])
        low, high, p = bootstrap_interval(x, iterations)
        return pd.DataFrame({"k": [part["_k"].iloc[0]], "n": [len(x)], "ci_low": [low], "ci_high": [high], "p_bootstrap": [p], "p_block": [block_bootstrap_p(x, iterations)], "deflated_sharpe": [deflated_sharpe(x, trials)], "p_t": [t_test_p(statistics.fmean(x), statistics.stdev(x), len(x))]})

    kept = rows.where(F.col(outcome).isNotNull()).select(F.col(key).alias("_k"), F.col("trade_date").alias("_d"), outcome)
    out = kept.groupBy("_k").applyInPandas(test, "k string, n long, ci_low double, ci_high double, p_bootstrap double, p_block double, deflated_sharpe double, p_t double")
    return out.withColumnRenamed("k", key)


#: Shares of a Poisson variable of mean 1 up to each value.
POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(16)])


def poisson_weights(ids: np.ndarray, iterations: int, seed: int) -> np.ndarray:
    """How often each row stands in each resample, by a hash of its id and the resample: rows x iterations."""
    with np.errstate(over="ignore"):
        h = ids.astype(np.uint64)[:, None] ^ (np.arange(1, iterations + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))[None, :]
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
        h ^= h >> np.uint64(31)
    return np.searchsorted(POISSON, (h >> np.uint64(11)).astype(float) * 2.0**-53, side="right")


def poisson_bootstrap(rows: DataFrame, keys: list[str], row_id: list[str], outcome: str = "outcome", iterations: int = 1000, seed: int = 42, alpha: float = 0.05) -> DataFrame:
    """Per key: n, mean, percentile interval of the mean and its two-sided sign p-value.

    Each row enters each resample a Poisson number of times that follows from its `row_id` and the seed, so a
    resample is a sum over rows: tasks add up `iterations` pairs of sums a key, which are combined. Nothing is
    gathered by key, and the result does not depend on how rows are dealt. `row_id` tells the rows of a key apart."""
    known = rows.where(F.col(outcome).isNotNull()).select(*keys, F.xxhash64(*keys, *row_id).alias("_id"), F.col(outcome).cast("double").alias("_x"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in known.select(*keys).schema)

    def add_up(batches):
        sums: dict[tuple, np.ndarray] = {}
        for part in batches:
            for key, g in part.groupby(keys, dropna=False):
                total = sums.setdefault(key, np.zeros((2, iterations)))
                for at in range(0, len(g), 1024):
                    w = poisson_weights(g["_id"].to_numpy()[at : at + 1024].view(np.uint64), iterations, seed)
                    total += w.sum(axis=0), (w * g["_x"].to_numpy()[at : at + 1024, None]).sum(axis=0)
            if len(sums) >= 256:
                yield frame(sums)
                sums = {}
        yield frame(sums)

    def frame(sums):
        out = pd.DataFrame(list(sums), columns=keys)
        return out.assign(weight=[v[0].tolist() for v in sums.values()], total=[v[1].tolist() for v in sums.values()])

    parts = known.mapInPandas(add_up, f"{kinds}, weight array<double>, total array<double>")
    each = parts.select(*keys, F.posexplode(F.arrays_zip("weight", "total")).alias("i", "s")).groupBy(*keys, "i").agg(F.sum("s.weight").alias("w"), F.sum("s.total").alias("t"))
    base = known.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("_x").alias("mean"))
    same = F.lit(True)
    for k in keys:
        same = same & base[k].eqNullSafe(each[k])
    both = base.join(each, same).select(*[base[k] for k in keys], "n", "mean", F.try_divide("t", "w").alias("m"))
    opposite = F.count_if((F.col("m") <= 0) != (F.col("mean") <= 0))
    out = both.groupBy(*keys).agg(F.first("n").alias("n"), F.first("mean").alias("mean"), F.percentile("m", F.lit(alpha / 2)).alias("low"), F.percentile("m", F.lit(1 - alpha / 2)).alias("high"), opposite.alias("_o"))
    return out.withColumn("p_value", F.least(F.lit(1.0), 2 * F.least(F.col("_o"), iterations - F.col("_o")) / iterations)).drop("_o")
