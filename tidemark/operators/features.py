"""Feature series over daily bars: price, volume, cross-sectional, fundamental, macro.

Inputs are long tables. Price windows are positional, per ticker by date, on
the adjusted close `adj`; highs and lows are raw. One window specification
per frame serves all features of that frame, so one shuffle by ticker and one
sort feed the lot. A value that cannot be computed is null.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..functions.stats import change, mid_rank, pearson, ratio

#: Fixed: window grids.
PRICE_WINDOWS, VOLUME_WINDOWS, CROSS_WINDOWS, REGIME_LOOKBACK = (1, 3, 5, 10, 20, 60), (5, 10, 20), (5, 10, 20), 120


def by() -> WindowSpec:
    """Rows of a ticker by date."""
    return Window.partitionBy("ticker").orderBy("trade_date")


def back(n: int, last: int = 0):
    """The n rows up to `last` rows before or at the current one."""
    return by().rowsBetween(last - n + 1, last)


def average_gap(short: int, long: int, price: str = "adj") -> Column:
    """Short over long trailing mean, less one; null until the long one is full or where it is zero."""
    return F.when(F.row_number().over(by()) >= long, F.try_divide(F.avg(price).over(back(short)), F.avg(price).over(back(long))) - 1)


def ret(n: int, price: str = "adj") -> Column:
    return change(F.col(price), F.lag(price, n).over(by()))


def full(x: Column, n: int) -> Column:
    """x where n rows exist up to this one."""
    return F.when(F.row_number().over(by()) >= n, x)


def with_adjusted(bars: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """Bars with `adj`; without events the close itself."""
    if events is None:
        return bars.withColumn("adj", F.col("close"))
    from .adjust import split_adjusted

    return split_adjusted(bars, events)


def price_features(bars: DataFrame, windows=PRICE_WINDOWS) -> DataFrame:
    """return_n, acceleration_n, distance_high_n, distance_low_n, volatility_n in one pass."""
    out = bars.withColumns({f"return_{n}d": ret(n) for n in windows} | {"ret1": ret(1)})
    more: dict[str, Column] = {}
    for n in windows:
        more[f"acceleration_{n}d"] = F.col(f"return_{n}d") - F.lag(f"return_{n}d", n).over(by())
        more[f"distance_high_{n}d"] = full(change(F.col("adj"), F.max("high").over(back(n))), n)
        more[f"distance_low_{n}d"] = full(change(F.col("adj"), F.min("low").over(back(n))), n)
        if n > 1:
            more[f"volatility_{n}d"] = F.when(F.count("ret1").over(back(n)) == n, F.stddev_pop("ret1").over(back(n)))
    return out.withColumns(more)


def percentile_in_past(column: str, lookback: int = REGIME_LOOKBACK) -> Column:
    """Mid-rank of the current value among the lookback - 1 rows before; null unless all are known."""
    past = F.collect_list(column).over(by().rowsBetween(1 - lookback, -1))
    return F.when(F.size(past) == lookback - 1, mid_rank(F.col(column), past))


def volume_features(bars: DataFrame, windows=VOLUME_WINDOWS) -> DataFrame:
    """Relative volume, z-score, acceleration, price-volume correlation, percentile per window."""
    out = bars.withColumns({"ret1": ret(1), "v": F.col("volume").cast("double")})
    first: dict[str, Column] = {}
    for n in windows:
        before = by().rowsBetween(-n, -1)
        known, mean, deviation = F.count("v").over(before) >= 2, F.avg("v").over(before), F.stddev_pop("v").over(before)
        first[f"relative_volume_{n}d"] = F.when(known, ratio(F.col("v"), mean))
        first[f"turnover_anomaly_{n}d"] = F.when(known & (deviation > 1e-9), ratio(F.col("v") - mean, deviation))
        first[f"price_volume_correlation_{n}d"] = F.when(F.count("ret1").over(back(n)) == n, pearson(F.col("ret1"), F.col("v"), back(n)))
        first[f"volume_percentile_{n}d"] = full(mid_rank(F.col("v"), F.collect_list("v").over(by().rowsBetween(1 - n, -1))), n)
    out = out.withColumns(first)
    return out.withColumns({f"volume_acceleration_{n}d": F.col(f"relative_volume_{n}d") - F.lag(f"relative_volume_{n}d", n).over(by()) for n in windows})


def mid_rank_in(column: str, *keys: str) -> Column:
    """Mid-rank of a value within its group, itself included."""
    group, ordered = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(column)
    equal = F.count(column).over(Window.partitionBy(*keys, column))
    return F.when(F.col(column).isNotNull(), (F.rank().over(ordered) - 1 - (F.count("*").over(group) - F.count(column).over(group)) + 0.5 * equal) / F.count(column).over(group))


def cross_sectional(bars: DataFrame, sectors: DataFrame, windows=CROSS_WINDOWS) -> DataFrame:
    """Market and sector percentile, relative strength, dispersion of each window's return by date."""
    out = bars.join(sectors, "ticker", "left").withColumns({f"return_{n}d": ret(n) for n in windows})
    day, group = Window.partitionBy("trade_date"), Window.partitionBy("trade_date", "sector")
    more: dict[str, Column] = {}
    for n in windows:
        r = f"return_{n}d"
        more[f"market_percentile_{n}d"] = mid_rank_in(r, "trade_date")
        more[f"sector_percentile_{n}d"] = mid_rank_in(r, "trade_date", "sector")
        more[f"relative_strength_{n}d"] = F.col(r) - F.avg(r).over(day)
        more[f"relative_strength_sector_{n}d"] = F.col(r) - F.avg(r).over(group)
        more[f"dispersion_{n}d"] = F.when(F.count(r).over(day) > 1, F.stddev_pop(r).over(day))
    return out.withColumns(more)


def rank_change(percentiles: DataFrame, n: int, value: str = "percentile") -> DataFrame:
    """Change of a percentile over n positions of the shared calendar (dates without a value are null)."""
    place = Window.orderBy("trade_date")
    days = percentiles.select("trade_date").distinct().withColumn("pos", F.row_number().over(place))  # one row per trading day
    own = percentiles.join(F.broadcast(days), "trade_date")
    before = own.select("ticker", (F.col("pos") + n).alias("pos"), F.col(value).alias("before"))
    return own.join(before, ["ticker", "pos"], "left").withColumn("rank_change", F.col(value) - F.col("before")).drop("before", "pos")


def market_wide(bars: DataFrame) -> DataFrame:
    """Per date: volume concentration, breadth, mean return, dispersion.

    Sums run over whole numbers and decimals, so that no result depends on the order of rows."""
    exact = F.col("ret1").cast("decimal(18,9)")
    day = bars.withColumn("ret1", ret(1)).groupBy("trade_date").agg(
        F.sum(F.col("volume").cast("decimal(19,0)") * F.col("volume").cast("decimal(19,0)")).cast("double").alias("squares"), F.sum("volume").cast("double").alias("total"), F.count("ret1").alias("n"), F.count_if(F.col("ret1") > 0).alias("up"),
        F.sum(exact).cast("double").alias("s"), F.sum(exact * exact).cast("double").alias("s2"), F.count("*").alias("n_bars"),
    )
    mean = ratio(F.col("s"), F.col("n"))
    spread = F.sqrt(F.greatest(F.lit(0.0), ratio(F.col("s2"), F.col("n")) - mean * mean))
    return day.select("trade_date", ratio(F.col("squares"), F.col("total") * F.col("total")).alias("volume_hhi"), ratio(F.col("up"), F.col("n")).alias("breadth"), mean.alias("mean_return"), F.when(F.col("n") > 1, spread).alias("dispersion"), "n_bars")


def fundamentals(items: DataFrame, item: str, filing_lag_days: int = 45) -> DataFrame:
    """Year and quarter growth, trailing mean and acceleration of one line item, by period type."""
    w = Window.partitionBy("ticker", "period_type").orderBy("period_end_date")
    rows = items.where(F.col("line_item") == item)
    year = F.when(F.col("period_type") == "ANNUAL", F.lag("value", 1).over(w)).otherwise(F.lag("value", 4).over(w))
    rows = rows.withColumn("yoy", F.try_divide(F.col("value") - year, F.abs(year)))
    return rows.withColumns(
        {
            "qoq": F.try_divide(F.col("value") - F.lag("value", 1).over(w), F.abs(F.lag("value", 1).over(w))),
            "trailing_mean": F.when(F.row_number().over(w) >= 2, F.avg("value").over(w.rowsBetween(-3, 0))),
            "yoy_acceleration": F.col("yoy") - F.lag("yoy", 1).over(w),
            "known_on": F.date_add("period_end_date", filing_lag_days),
        }
    )


def earlier_counts(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value, how many earlier ones are smaller, and how many equal: merge counting, level by level."""
    n = len(values)
    rank = np.unique(values, return_inverse=True)[1].astype(np.int64)
    less, same = np.zeros(n, np.int64), np.zeros(n, np.int64)
    at, span, width = np.arange(n), 1, int(rank.max()) + 2 if n else 1
    while span < n:
        keys = at // (2 * span) * width
        right = at // span % 2 == 1
        left = np.sort(keys[~right] + rank[~right])
        first, low, high = (np.searchsorted(left, k, side) for k, side in ((keys[right], "left"), (keys[right] + rank[right], "left"), (keys[right] + rank[right], "right")))
        less[right] += low - first
        same[right] += high - low
        span *= 2
    return less, same


def macro_features(series: DataFrame) -> DataFrame:
    """Change, acceleration and percentile among all earlier values of each series.

    The percentile is counted by merging: time a little above, memory in proportion to the length of a series."""
    w = Window.partitionBy("series_id").orderBy("observation_date")
    rows = series.withColumn("change", change(F.col("value"), F.lag("value", 1).over(w)))
    rows = rows.withColumn("acceleration", F.col("change") - F.lag("change", 1).over(w))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def count(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("observation_date", kind="stable").reset_index(drop=True)
        known = np.flatnonzero(part["value"].notna())
        less, same = earlier_counts(part["value"].to_numpy(float)[known])
        before = np.arange(len(known))
        rank = np.full(len(part), np.nan)
        rank[known] = np.where(before == 0, 0.5, (less + 0.5 * same) / np.maximum(before, 1))
        return part.assign(percentile=rank)

    counted = rows.groupBy("series_id").applyInPandas(count, f"{kinds}, percentile double")
    return counted.withColumn("percentile", F.nanvl("percentile", F.lit(None).cast("double")))
