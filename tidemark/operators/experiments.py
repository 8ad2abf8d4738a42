"""Experiments on one return series per key, or on an aligned pair of series.

The statistic of a single series is its mean, of a pair its correlation. What
has a closed form is column algebra over row numbers; seeded resampling runs
in one grouped function, whose group is one key's history.
"""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .outcomes import incomplete_beta, t_test


def numbered(rows: DataFrame, key: str, day: str) -> DataFrame:
    """Rows with position `_i` (from 0) and length `_n` of their series."""
    w = Window.partitionBy(key)
    return rows.withColumns({"_i": F.row_number().over(w.orderBy(day)) - 1, "_n": F.count("*").over(w)})


def k_fold(rows: DataFrame, key: str, day: str, value: str, folds: int = 3) -> DataFrame:
    """t statistic of the fold means; the last fold takes the rest."""
    r = numbered(rows, key, day).where(F.col("_n") >= 2 * folds)
    fold = F.least(F.floor(F.col("_i") / F.floor(F.col("_n") / folds)), F.lit(folds - 1))
    each = r.groupBy(key, fold.alias("_f")).agg(F.avg(value).alias("m"), F.count("*").alias("c"))
    out = each.groupBy(key).agg(F.count("*").alias("folds"), F.avg("m").alias("mean"), F.stddev_samp("m").alias("sd"), F.sum("c").alias("n"))
    return out.select(key, "n", "folds", F.try_divide(F.col("mean"), F.col("sd") / F.sqrt("folds")).alias("statistic"), t_test(F.col("mean"), F.col("sd"), F.col("folds")).alias("p_value"))


def rolling_hac(rows: DataFrame, key: str, day: str, value: str, window: int = 5) -> DataFrame:
    """Mean of rolling means over its Newey-West error with Bartlett weights.

    Autocovariances are sums of products with shifted copies along one ordered
    window per key: no self-join."""
    by = Window.partitionBy(key).orderBy(day)
    whole = Window.partitionBy(key)
    span = by.rowsBetween(1 - window, 0)
    r = rows.withColumns({"_m": F.avg(value).over(span), "_c": F.count(value).over(span)}).where(F.col("_c") == window)
    r = r.withColumns({"_x": F.col("_m") - F.avg("_m").over(whole), "_k": F.count("*").over(whole)}).where("_k >= 2")
    lag = F.least(F.col("_k") - 1, F.lit(max(1, window - 1)))
    parts = r.withColumns({f"_l{j}": F.lag("_x", j).over(by) for j in range(1, max(2, window))})
    sums = parts.groupBy(key).agg(F.first("_k").alias("k"), F.first(lag).alias("lag"), F.avg("_m").alias("mean"), F.sum(F.col("_x") ** 2).alias("g0"), *[F.sum(F.col("_x") * F.col(f"_l{j}")).alias(f"g{j}") for j in range(1, max(2, window))])
    variance: Column = F.col("g0") / F.col("k")
    for j in range(1, max(2, window)):
        variance = variance + F.when(F.lit(j) <= F.col("lag"), 2 * (1 - F.lit(j) / (F.col("lag") + 1)) * F.coalesce(F.col(f"g{j}"), F.lit(0.0)) / F.col("k")).otherwise(0.0)
    error = F.sqrt(F.greatest(variance, F.lit(0.0)) / F.col("k"))
    return sums.select(key, F.col("k").alias("windows"), "mean", F.when(error > 0, F.col("mean") / error).otherwise(0.0).alias("statistic"))


def halves(rows: DataFrame, key: str, day: str, value: str) -> DataFrame:
    """Mean before and after the midpoint, and whether the sign holds."""
    r = numbered(rows, key, day).where("_n >= 6")
    late = F.col("_i") >= F.floor(F.col("_n") / 2)
    out = r.groupBy(key).agg(F.avg(F.when(~late, F.col(value))).alias("in_sample"), F.avg(F.when(late, F.col(value))).alias("out_of_sample"), F.count(F.when(late, 1)).alias("n_out"))
    return out.withColumn("same_sign", (F.col("in_sample") <= 0) == (F.col("out_of_sample") <= 0))


def trailing(rows: DataFrame, key: str, day: str, value: str, fractions=(0.5, 0.75, 1.0)) -> DataFrame:
    """Mean over the last part of the series for several parts, and how many flip the sign of the whole."""
    r = numbered(rows, key, day).where("_n >= 6").withColumn("fraction", F.explode(F.array(*map(F.lit, fractions))))
    r = r.where(F.col("_i") >= F.col("_n") - F.greatest(F.lit(3), F.floor(F.col("_n") * F.col("fraction"))))
    each = r.groupBy(key, "fraction").agg(F.avg(value).alias("mean"))
    full = F.max(F.when(F.col("fraction") == 1.0, F.col("mean"))).over(Window.partitionBy(key))
    each = each.withColumn("flip", (F.col("mean") <= 0) != (full <= 0))
    return each.groupBy(key).agg(F.count("*").alias("settings"), F.count_if("flip").alias("sign_flips"), F.max(F.when(F.col("fraction") == 1.0, F.col("mean"))).alias("full_mean"))


def resampled(rows: DataFrame, key: str, day: str, value: str, iterations: int = 200, block: int = 5, seed: int = 42) -> DataFrame:
    """Block-bootstrap tail, and the sign-flip permutation p-value, of a series' mean."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        x = part.sort_values("_d")["_v"].to_numpy(float)
        n = len(x)
        if n < 6:
            return pd.DataFrame(columns=["k"])
        b = max(1, min(block, n // 2))
        rng = random.Random(seed)
        starts = np.array([[rng.randrange(n - b + 1) for _ in range(-(-n // b))] for _ in range(iterations)])
        means = np.sort(x[(starts[:, :, None] + np.arange(b)).reshape(iterations, -1)[:, :n]].mean(axis=1))
        full = x.mean()
        worst = means[min(iterations - 1, max(0, round((iterations - 1) * (0.05 if full >= 0 else 0.95))))]
        signs = np.array([[rng.choice((-1.0, 1.0)) for _ in range(n)] for _ in range(iterations)])
        p = float((np.abs((signs * x).mean(axis=1)) >= abs(full)).mean())
        return pd.DataFrame({"k": [part["_k"].iloc[0]], "n": [n], "mean": [full], "tail": [worst], "tail_holds": [bool((full <= 0) == (worst <= 0))], "permutation_p": [p]})

    kept = rows.where(F.col(value).isNotNull()).select(F.col(key).alias("_k"), F.col(day).alias("_d"), F.col(value).alias("_v"))
    return kept.groupBy("_k").applyInPandas(run, "k string, n long, mean double, tail double, tail_holds boolean, permutation_p double").withColumnRenamed("k", key)


def partial_lead_lag(returns: DataFrame, lags=(1, 2, 3, 5), least: int = 60) -> DataFrame:
    """Leader's lagged return against follower's, market and own lag partialled out.

    The market is the mean over tickers by date. Both sides are residuals of
    least squares on the controls (the Frisch-Waugh-Lovell theorem), so a pair
    needs one correlation; a group is one follower and lag."""
    market = F.avg("r").over(Window.partitionBy("trade_date"))
    by = Window.partitionBy("ticker").orderBy("trade_date")
    rows = returns.withColumns({"m": market, "own": F.lag("r", 1).over(by)})
    lagged = rows.select("ticker", "trade_date", *[F.lag("r", k).over(by).alias(f"x{k}") for k in lags])
    leaders = lagged.select(F.col("ticker").alias("leader"), "trade_date", F.inline(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"x{k}").alias("x")) for k in lags]))).where("x is not null")
    pairs = leaders.join(rows.where("own is not null").withColumnRenamed("ticker", "follower"), "trade_date").where("leader <> follower")

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for leader, p in part.groupby("leader", sort=True):
            if len(p) < least:
                continue
            z = np.column_stack((np.ones(len(p)), p["m"], p["own"]))
            yx = p[["r", "x"]].to_numpy(float)
            res = yx - z @ np.linalg.lstsq(z, yx, rcond=None)[0]
            s = (res**2).sum(axis=0)
            if s.min() <= 1e-18:
                continue
            c = float(np.clip((res[:, 0] * res[:, 1]).sum() / math.sqrt(s[0] * s[1]), -1, 1))
            v = len(p) - z.shape[1] - 1
            t = c * math.sqrt(v / max(1 - c * c, 1e-12))
            out.append((leader, part["follower"].iloc[0], int(part["lag"].iloc[0]), len(p), c, incomplete_beta(v / 2, 0.5, v / (v + t * t))))
        return pd.DataFrame(out, columns=["leader", "follower", "lag", "n", "partial", "p"])

    return pairs.select("leader", "follower", "lag", "r", "x", "m", "own").groupBy("follower", "lag").applyInPandas(fit, "leader string, follower string, lag int, n long, partial double, p double")


def replicated(edges_a: DataFrame, edges_b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Edges found in both samples with one sign."""
    b = edges_b.select(*keys, F.col(value).alias("_b"))
    return edges_a.join(b, keys).where(F.signum(value) == F.signum("_b")).drop("_b")


def chronological_cut(rows: DataFrame, day: str, fraction: float) -> Column:
    """The date that many calendar days through the sample, as a one-row subquery value."""
    ends = rows.agg(F.min(day).alias("a"), F.max(day).alias("b")).first()
    return F.lit(ends["a"]) + F.expr(f"make_interval(0, 0, 0, {int((ends['b'] - ends['a']).days * fraction)})")


def ward(points: np.ndarray, clusters: int) -> np.ndarray:
    """Agglomerative clustering by least growth of within-cluster variance; labels by the first member.

    Chains of nearest neighbours end in pairs that are nearest to each other; merging those in any order gives
    the same tree, so time and memory grow with the square of the points."""
    n = len(points)
    x = np.asarray(points, float)
    squares = (x * x).sum(axis=1)
    cost = np.maximum(0.0, squares[:, None] + squares[None, :] - 2 * x @ x.T) / 2
    np.fill_diagonal(cost, np.inf)
    size, merges, chain = np.ones(n), [], []
    alive = np.ones(n, bool)
    for _ in range(n - 1):
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        while True:
            a = chain[-1]
            b = int(np.argmin(cost[a]))
            if len(chain) > 1 and cost[a, chain[-2]] <= cost[a, b]:
                b = chain[-2]
                break
            chain.append(b)
        del chain[-2:]
        a, b = min(a, b), max(a, b)
        merges.append((cost[a, b], len(merges), a, b))
        total = size[a] + size[b] + size
        grown = ((size[a] + size) * cost[a] + (size[b] + size) * cost[b] - size * cost[a, b]) / total
        alive[b] = False
        grown[~alive] = np.inf
        grown[a] = np.inf
        cost[a], cost[:, a] = grown, grown
        cost[b], cost[:, b] = np.inf, np.inf
        size[a] += size[b]
    parent = np.arange(n)
    for _, _, a, b in sorted(merges)[: max(0, n - clusters)]:
        roots = []
        for k in (a, b):
            while parent[k] != k:
                k = parent[k]
            roots.append(k)
        parent[max(roots)] = min(roots)
    for k in range(n):
        parent[k] = parent[parent[k]]
    return np.unique(parent, return_inverse=True)[1]


def clustered(features: DataFrame, names: list[str], clusters: int) -> DataFrame:
    """Tickers in clusters of robustly scaled features. Medians and ranges are aggregates; the
    clustering of the universe's tickers, of bounded number, is one group."""
    scale = features.agg(*[F.percentile(n, F.lit(q)).alias(f"{n}_{k}") for n in names for k, q in enumerate((0.25, 0.5, 0.75))])
    scaled = features.crossJoin(F.broadcast(scale)).select("ticker", *[F.coalesce(F.try_divide(F.col(n) - F.col(f"{n}_1"), F.col(f"{n}_2") - F.col(f"{n}_0")), F.lit(0.0)).alias(n) for n in names])

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("ticker")
        return pd.DataFrame({"ticker": part["ticker"], "cluster": ward(part[names].to_numpy(), clusters)})

    return scaled.withColumn("_g", F.lit(0)).groupBy("_g").applyInPandas(fit, "ticker string, cluster int")


