"""Market-level operators: breadth, regimes, correlations, path analogs, backtests."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.stats import bucket, mid_rank, pearson, ratio
from ..plans.stage import written
from .features import by, back, ret

#: Fixed: regime thresholds.
BULLISH, BEARISH, ELEVATED, HIGH = 0.03, -0.03, 0.015, 0.025
DIMENSIONS = ("volatility", "trend", "turnover", "breadth", "dispersion", "correlation")


def breadth(bars: DataFrame) -> DataFrame:
    """One row: how many tickers rose, fell, traded above their mean volume, on their last day."""
    rows = bars.withColumns({"r": ret(1), "past": F.avg("volume").over(by().rowsBetween(-20, -1))})
    last = rows.groupBy("ticker").agg(
        F.count("*").alias("n"), F.max_by("r", F.when(F.col("r").isNotNull(), F.col("trade_date"))).alias("r"), F.max_by("volume", "trade_date").alias("v"), F.max_by("past", "trade_date").alias("past")
    )
    known = F.col("n") >= 2
    up, down = F.count_if(known & (F.col("r") > 0)), F.count_if(known & (F.col("r") < 0))
    return last.agg(
        F.count("*").alias("universe"), F.count_if(known).alias("with_price"), up.alias("advancers"), down.alias("decliners"), F.count_if(known & (F.col("r") == 0)).alias("unchanged"),
        ratio(up, down).alias("advance_decline_ratio"), (F.avg(F.when(known, F.col("r"))) * 100).alias("average_return_pct"),
        F.count_if(known & (F.col("past") > 0) & (F.col("v") > F.col("past"))).alias("above_average_volume"), F.count_if(known & (F.col("past") > 0) & ~(F.col("v") > F.col("past"))).alias("below_average_volume"),
    )


def regime(bars: DataFrame, lookback: int = 20) -> DataFrame:
    """One row: trend and volatility of the equal-weighted market over its last days."""
    daily = bars.withColumn("r", ret(1)).where("r is not null").groupBy("trade_date").agg(F.avg("r").alias("m"))
    recent = daily.orderBy(F.col("trade_date").desc()).limit(lookback)
    s = recent.agg(F.count("*").alias("days"), (F.product(1 + F.col("m")) - 1).alias("c"), F.stddev_pop("m").alias("v"))
    s = s.withColumns({"c": F.col("c"), "v": F.when(F.col("days") > 1, F.col("v")).otherwise(0.0)})
    trend = F.when(F.col("c") >= BULLISH, "bullish").when(F.col("c") <= BEARISH, "bearish").otherwise("neutral")
    level = F.when(F.col("v") >= HIGH, "high").when(F.col("v") >= ELEVATED, "elevated").otherwise("low")
    return s.select("days", (F.col("c") * 100).alias("cumulative_return_pct"), (F.col("v") * 100).alias("daily_volatility_pct"), trend.alias("trend"), level.alias("volatility"))


def regime_buckets(bars: DataFrame, dimensions=DIMENSIONS, k: int = 3, lookback: int = 120) -> DataFrame:
    """(trade_date, dimension, k, value, bucket): each market measure in buckets of its trailing percentile.

    The market series has one row per date, so its single ordered window is small
    at any number of tickers; everything per ticker is aggregated before it.
    """
    rows = bars.withColumns({"r": ret(1), "r20": ret(20), "turnover": F.col("close") * F.col("volume")})
    day = rows.groupBy("trade_date").agg(
        F.avg("r").alias("m"), F.avg("r20").alias("trend"), F.sum("turnover").alias("turnover"),
        F.round(ratio(F.count_if(F.col("r") > 0).cast("double"), F.count("r")), 9).alias("breadth"), F.when(F.count("r") > 1, F.stddev_pop("r")).alias("dispersion"),
    )
    if "correlation" in dimensions:
        day = day.join(mean_correlation(bars).select("trade_date", F.round("mean_correlation", 9).alias("correlation")), "trade_date", "left")
    by = Window.orderBy("trade_date")
    day = day.withColumn("volatility", F.when(F.count("m").over(by.rowsBetween(-19, 0)) == 20, F.stddev_pop("m").over(by.rowsBetween(-19, 0))))
    tall = day.select("trade_date", *dimensions).unpivot(["trade_date"], list(dimensions), "dimension", "value")
    past = F.collect_list("value").over(Window.partitionBy("dimension").orderBy("trade_date").rowsBetween(1 - lookback, -1))
    percentile = F.when(F.size(past) == lookback - 1, mid_rank(F.col("value"), past))
    return tall.withColumn("percentile", percentile).select("trade_date", "dimension", F.lit(k).alias("k"), "value", bucket(F.col("percentile"), k).alias("bucket"))


def sector_leaders(bars: DataFrame, sectors: DataFrame) -> DataFrame:
    total = bars.groupBy("ticker").agg(F.sum("volume").alias("total_volume")).join(sectors, "ticker")
    order = Window.partitionBy("sector").orderBy(F.col("total_volume").desc(), "ticker")
    return total.withColumn("r", F.row_number().over(order)).where("r = 1").select("sector", F.col("ticker").alias("leader"), "total_volume")


def price_stats(bars: DataFrame) -> DataFrame:
    """The last day of each ticker with its momentum, annual volatility, range and averages."""
    rows = bars.withColumns({"r": ret(1), "c20": F.lag("adj", 20).over(by()), "sma20": F.avg("adj").over(back(20)), "sma50": F.avg("adj").over(back(50)), "high_252d": F.max("high").over(back(252)), "low_252d": F.min("low").over(back(252))})
    whole = Window.partitionBy("ticker")
    rows = rows.withColumns({"annual_volatility": F.stddev_samp("r").over(whole) * F.sqrt(F.lit(252.0)), "last": F.max("trade_date").over(whole)}).where(F.col("trade_date") == F.col("last"))
    trend = F.when((F.col("adj") > F.col("sma20")) & (F.col("sma20") > F.col("sma50")), "up").when((F.col("adj") < F.col("sma20")) & (F.col("sma20") < F.col("sma50")), "down").otherwise("flat")
    momentum = F.try_divide(F.col("adj") - F.col("c20"), F.col("c20"))
    return rows.select("ticker", "trade_date", "close", momentum.alias("momentum_20d"), "annual_volatility", "high_252d", "low_252d", "sma20", "sma50", trend.alias("trend"))


def pair_correlations(bars: DataFrame) -> DataFrame:
    """Correlation of daily returns of every pair of tickers over their common dates.

    The join is by date: its size is the square of the tickers of a day, not of
    the history, and sums combine before the shuffle by pair."""
    rows = bars.withColumn("x", ret(1)).where("x is not null").select("ticker", "trade_date", "x")
    other = rows.select(F.col("ticker").alias("b"), "trade_date", F.col("x").alias("y"))
    pairs = rows.withColumnRenamed("ticker", "a").join(other, "trade_date").where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"), pearson(F.col("x"), F.col("y")).alias("correlation"))


def mean_correlation(bars: DataFrame, days: int = 60, least: int = 20) -> DataFrame:
    """Per date the mean, over pairs of tickers that trade on it, of their return correlation over the last
    `days` market days (pairs with `least` common ones). Six running sums per pair; the join is by date, so
    its size is the square of the tickers of a day."""
    rows = bars.withColumn("x", ret(1)).where("x is not null").select("ticker", "trade_date", "x")
    calendar = rows.select("trade_date").distinct().withColumn("pos", F.row_number().over(Window.orderBy("trade_date")))  # one row per day
    rows = rows.join(calendar, "trade_date")
    pairs = rows.withColumnRenamed("ticker", "a").join(rows.select(F.col("ticker").alias("b"), "pos", F.col("x").alias("y")), "pos").where("a < b")
    last = Window.partitionBy("a", "b").orderBy("pos").rangeBetween(1 - days, 0)
    c = pairs.select("trade_date", F.when(F.count("*").over(last) >= least, pearson(F.col("x"), F.col("y"), last)).alias("c"))
    return c.groupBy("trade_date").agg(F.count("c").alias("pairs"), F.avg("c").alias("mean_correlation")).where("pairs > 0")


def lead_lag(bars: DataFrame, lags=(1, 2, 3, 5)) -> DataFrame:
    """Correlation of each ticker's return with each other's `lag` positions before."""
    rows = bars.withColumn("y", ret(1)).where("y is not null").select("ticker", "trade_date", "y")
    wide = rows.select("ticker", "trade_date", *[F.lag("y", n).over(by()).alias(f"x{n}") for n in lags])
    before = wide.select(F.col("ticker").alias("leader"), "trade_date", F.inline(F.array(*[F.struct(F.lit(n).alias("lag"), F.col(f"x{n}").alias("x")) for n in lags]))).where("x is not null")
    pairs = before.join(rows.withColumnRenamed("ticker", "follower"), "trade_date").where("leader <> follower")
    return pairs.groupBy("leader", "follower", "lag").agg(F.count("*").alias("n"), pearson(F.col("x"), F.col("y")).alias("correlation"))


def worst_window(bars: DataFrame, days: int) -> DataFrame:
    """The run of `days` daily returns with the smallest sum per ticker; the first of equals."""
    rows = bars.withColumn("r", ret(1)).where("r is not null")
    ahead = by().rowsBetween(0, days - 1)
    rows = rows.withColumns({"total": F.round(F.sum("r").over(ahead), 6), "n": F.count("*").over(ahead)}).where(F.col("n") == days)
    best = F.min(F.struct("total", "trade_date"))
    return rows.groupBy("ticker").agg(best.alias("b")).select("ticker", F.col("b.trade_date").alias("starts_on"), F.col("b.total").alias("worst_sum"))


def backtest(bars: DataFrame, signal: str | None = None, cost_bps: float = 10.0, tail: float = 0.3) -> DataFrame:
    """Per ticker: sign of yesterday's signal as position, turnover costs, figures over the last part."""
    rows = bars.withColumn("r", ret(1))
    rows = rows.withColumn("position", F.coalesce(F.signum(F.lag(F.col(signal) if signal else F.col("r"), 1).over(by())), F.lit(0.0))).where("r is not null")
    rows = rows.withColumn("net", F.col("position") * F.col("r") - F.abs(F.col("position") - F.coalesce(F.lag("position", 1).over(by()), F.lit(0.0))) * cost_bps / 10_000)
    whole = Window.partitionBy("ticker")
    rows = rows.withColumns({"i": F.row_number().over(by()), "n": F.count("*").over(whole)}).where(F.col("i") > F.floor(F.col("n") * (1 - tail)))
    active = F.col("position") != 0
    return rows.groupBy("ticker").agg(
        F.count("*").alias("days"), F.round(F.sum("net"), 4).alias("net_return"), F.round(F.try_divide(F.avg("net"), F.nullif(F.stddev_pop("net"), F.lit(0.0))) * F.sqrt(F.lit(250.0)), 4).alias("sharpe"),
        F.round(ratio(F.count_if(active & (F.col("net") > 0)).cast("double"), F.count_if(active)), 6).alias("hit_rate"),
    )


def liquidity_proxies(bars: DataFrame) -> DataFrame:
    rows = bars.withColumns({"r": ret(1), "turnover": F.col("close") * F.col("volume"), "lr": F.ln(F.try_divide(F.col("adj"), F.lag("adj", 1).over(by())))})
    w = back(20)
    return rows.withColumns(
        {
            "median_turnover_20d": F.when(F.count("turnover").over(w) >= 10, F.percentile("turnover", F.lit(0.5)).over(w)),
            "log_return_stdev_20d": F.when(F.count("lr").over(w) >= 10, F.stddev_samp("lr").over(w)),
            "amihud": ratio(F.abs("r"), F.col("turnover")),
        }
    )


def analogs(bars: DataFrame, length: int = 20, ahead: int = 10, k: int = 5) -> DataFrame:
    """Per ticker, past stretches of returns most like the last one: mean-centred
    distance, greedily without overlap, with the compounded return after each.
    A group is one ticker's history, bounded by its trading days."""
    rows = bars.withColumn("r", ret(1)).where("r is not null").select("ticker", "trade_date", "r")

    def pick(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("trade_date")
        r, days = part["r"].to_numpy(float), part["trade_date"].to_numpy()
        out = []
        if len(r) >= 2 * length + ahead:
            w = np.lib.stride_tricks.sliding_window_view(r, length)
            w = w - w.mean(axis=1, keepdims=True)
            distance = np.sqrt(((w[: len(r) - 2 * length - ahead + 1] - w[-1]) ** 2).sum(axis=1))
            taken: list[int] = []
            for i in np.argsort(distance, kind="stable"):
                if all(abs(i - j) >= length for j in taken):
                    taken.append(int(i))
                    after = float(np.prod(1 + r[i + length : i + length + ahead]) - 1)
                    out.append((part["ticker"].iloc[0], len(taken), days[i], round(float(distance[i]), 6), round(after, 4)))
                    if len(taken) == k:
                        break
        return pd.DataFrame(out, columns=["ticker", "rank", "starts_on", "distance", "forward_return"])

    return rows.groupBy("ticker").applyInPandas(pick, "ticker string, rank int, starts_on date, distance double, forward_return double")


def bands_for(least: float, recall: float, bits: int) -> int:
    """Bands of so many signs that find a pair of correlation `least` with this probability."""
    same = (1 - np.arccos(least) / np.pi) ** bits
    return max(1, int(np.ceil(np.log(1 - recall) / np.log(1 - same))))


def strong_pairs(series: DataFrame, least: float = 0.8, overlap: float = 0.9, recall: float = 0.999, bits: int = 12, seed: int = 7, lags: tuple[int, ...] = (0,)) -> DataFrame:
    """Pairs of series whose correlation over common days is at least `least` in size: a, b, lag, n, correlation.
    Their common days must be at least the share `overlap` of the days of either.

    series: id, day, value. With lag 0 pairs are unordered (a < b); with a lag, a's value so many of its own
    positions before meets b's of the day. Candidates come from signs of random projections of the standardised series
    (days without a value count as its mean): two series whose signs agree in all `bits` of one of the
    bands meet in a join, all others never do; each candidate is then verified on its common days. As many
    bands are used as `recall` at `least` and at the smallest overlap needs; other pairs are found more surely. A sign turned over counts as agreement too,
    so that negative correlations are found. A series is one task's work, of one value a day."""
    n_bands = bands_for(least * overlap, recall, bits)
    place = Window.partitionBy("id").orderBy("day")
    known = series.where("value is not null").select("id", "day", F.col("value").cast("double").alias("value"))
    moves = sorted({0, *lags})
    wide = known.withColumns({f"x{k}": F.lag("value", k).over(place) if k else F.col("value") for k in moves})
    shifted = wide.select("id", "day", F.inline(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"x{k}").alias("x")) for k in moves]))).where("x is not null")

    def signs(part: pd.DataFrame) -> pd.DataFrame:
        x = part["x"].to_numpy(float)
        sd = x.std()
        if len(x) < 2 or not sd > 0:
            return pd.DataFrame({"id": pd.Series(dtype=object), "lag": pd.Series(dtype="int32"), "bands": pd.Series(dtype=object)})
        z, total = (x - x.mean()) / sd, np.zeros(n_bands * bits)
        for day, v in zip(part["day"], z):
            total += v * np.random.default_rng([seed, day.toordinal()]).standard_normal(n_bands * bits)
        sign = (total > 0).reshape(n_bands, bits)
        sign ^= sign[:, :1]  # a series and its negative have one code
        return pd.DataFrame({"id": [part["id"].iloc[0]], "lag": [int(part["lag"].iloc[0])], "bands": [(sign @ (1 << np.arange(bits))).tolist()]})

    codes = written(shifted.groupBy("id", "lag").applyInPandas(signs, "id string, lag int, bands array<long>"), "signs").select("id", "lag", F.posexplode("bands").alias("band", "code"))
    other = codes.where("lag = 0").select(F.col("id").alias("b"), "band", "code")
    wanted = F.col("lag").isin(*lags) & F.when(F.col("lag") == 0, F.col("id") < F.col("b")).otherwise(F.col("id") != F.col("b"))
    pairs = written(codes.join(other, ["band", "code"]).where(wanted).select(F.col("id").alias("a"), "b", "lag").distinct(), "candidates")
    left = pairs.join(shifted.withColumnRenamed("id", "a"), ["a", "lag"])
    both = left.join(known.select(F.col("id").alias("b"), "day", F.col("value").alias("y")), ["b", "day"])
    out = both.groupBy("a", "b", "lag").agg(F.count("*").alias("n"), pearson(F.col("x"), F.col("y")).alias("correlation"))
    days = known.groupBy("id").agg(F.count("*").alias("days"))
    out = out.where(F.abs("correlation") >= least).join(days.select(F.col("id").alias("a"), F.col("days").alias("_a")), "a").join(days.select(F.col("id").alias("b"), F.col("days").alias("_b")), "b")
    return out.where(F.col("n") + F.col("lag") >= overlap * F.greatest("_a", "_b")).select("a", "b", "lag", "n", "correlation")
