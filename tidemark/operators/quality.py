"""Data-quality rules, leakage checks, point-in-time filters, calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed: days until an observation of a source is public.
PUBLICATION_LAG = {"worldbank": 30, "undata": 30, "capmas": 30, "egypt_nsdp": 30, "fred": 0}
#: Fixed: yearly holidays (month, day).
FIXED_HOLIDAYS = ((1, 7), (1, 25), (4, 25), (5, 1), (6, 30), (7, 23), (10, 6))


def bar_issues(bars: DataFrame, order: str = "trade_date") -> DataFrame:
    """One row per broken rule: ticker, trade_date, severity, rule. `order` is the
    arrival order of a ticker's bars, against which dates are checked."""
    w = Window.partitionBy("ticker").orderBy(order)
    rows = bars.withColumns({"_close": F.lag("close").over(w), "_day": F.lag("trade_date").over(w), "_n": F.row_number().over(Window.partitionBy("ticker", "trade_date").orderBy(order))})
    o, h, low, c, v = (F.col(x) for x in ("open", "high", "low", "close", "volume"))
    rules = [
        ("error", "non_positive_price", F.least(o, h, low, c) <= 0), ("error", "high_below_low", h < low), ("error", "high_below_body", h < F.greatest(o, c)),
        ("error", "low_above_body", low > F.least(o, c)), ("error", "negative_volume", v < 0), ("warning", "zero_volume", v == 0),
        ("warning", "extreme_move", (F.col("_close") > 0) & (F.abs(F.try_divide(c, F.col("_close")) - 1) > 0.5)),
        ("error", "duplicate_date", F.col("_n") > 1), ("error", "out_of_order", F.col("trade_date") < F.col("_day")),
    ]
    found = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(s).alias("severity"), F.lit(r).alias("rule"))) for s, r, test in rules]))
    return rows.select("ticker", "trade_date", F.inline(found))


def knowable(observations: DataFrame, as_of: str, source: str = "source", day: str = "observation_date") -> DataFrame:
    """Observations public at `as_of`, by their source's publication lag."""
    lag: Column = F.lit(0)
    for name, days in PUBLICATION_LAG.items():
        lag = F.when(F.col(source) == name, days).otherwise(lag)
    return observations.where(F.date_add(F.col(day), lag) <= F.lit(as_of).cast("date"))


def sealed(table: DataFrame, day: str, cutoff: DataFrame) -> DataFrame:
    """Rows up to the one date of `cutoff` (a single row with column `cutoff`)."""
    return table.crossJoin(F.broadcast(cutoff)).where(F.col(day) <= F.col("cutoff")).drop("cutoff")


def train_cutoff(days: DataFrame, day: str, fraction: float) -> DataFrame:
    """The date at index int(n * fraction) - 1 of the distinct dates, n - 2 at most."""
    distinct = days.select(day).distinct()
    n = distinct.agg(F.count("*").alias("n"))
    place = distinct.withColumn("i", F.row_number().over(Window.orderBy(day)) - 1).crossJoin(F.broadcast(n))
    at = F.greatest(F.lit(0), F.least(F.floor(F.col("n") * fraction).cast("int") - 1, F.col("n") - 2))
    return place.where(F.col("i") == at).select(F.col(day).alias("cutoff"))


def trading_day(day: str, holidays: DataFrame | None = None) -> Column:
    """Not Friday or Saturday, and no fixed holiday; movable ones are an anti-join."""
    fixed = F.lit(False)
    for month, d in FIXED_HOLIDAYS:
        fixed = fixed | ((F.month(day) == month) & (F.dayofmonth(day) == d))
    return ~F.weekday(F.col(day)).isin(4, 5) & ~fixed


def leakage(series: DataFrame, key: str, day: str, as_of: str) -> DataFrame:
    """Per key: dates not ascending in arrival order `seq`, and dates after `as_of`."""
    w = Window.partitionBy(key).orderBy("seq")
    rows = series.withColumn("_p", F.lag(day).over(w))
    return rows.groupBy(key).agg(F.count_if(F.col(day) <= F.col("_p")).alias("not_ascending"), F.count_if(F.col(day) > F.lit(as_of).cast("date")).alias("future_dated"))


def gaps(bars: DataFrame, least: int = 5) -> DataFrame:
    """Runs of missing weekdays between two bars of a ticker."""
    w = Window.partitionBy("ticker").orderBy("trade_date")
    rows = bars.select("ticker", "trade_date", F.lag("trade_date").over(w).alias("previous"))
    inside = F.filter(F.sequence(F.date_add("previous", 1), F.date_sub("trade_date", 1)), lambda d: F.weekday(d) < 5)
    missing = F.when(F.datediff("trade_date", "previous") > 1, F.size(inside)).otherwise(0)
    return rows.withColumn("missing", missing).where(F.col("missing") >= least).select("ticker", F.col("previous").alias("after"), F.col("trade_date").alias("before"), "missing")
