"""Forward-looking targets over daily bars, per ticker by date.

A horizon of h rows must exist in full, or the value is null; the barrier
target alone takes what is left near the end of the series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.stats import change
from .features import by

#: Fixed: horizons in trading days, exceedance levels, (up, down, days) barriers.
HORIZONS, LEVELS, BARRIERS = (5, 10, 20, 60), (0.02, 0.05), ((0.05, -0.03, 20), (0.10, -0.05, 20))


def ahead(h: int):
    return by().rowsBetween(1, h)


def forward(h: int) -> Column:
    return change(F.lead("adj", h).over(by()), F.col("adj"))


def forward_targets(bars: DataFrame, horizons=HORIZONS) -> DataFrame:
    """forward_return, mfe, mae, max_drawdown, positive and exceeds flags per horizon."""
    out = bars.withColumns({f"forward_return_{h}d": forward(h) for h in horizons})
    more: dict[str, Column] = {}
    for h in horizons:
        whole = F.lead("adj", h).over(by()).isNotNull()
        more[f"mfe_{h}d"] = F.when(whole, change(F.max("high").over(ahead(h)), F.col("adj")))
        more[f"mae_{h}d"] = F.when(whole, change(F.min("low").over(ahead(h)), F.col("adj")))
        more[f"positive_{h}d"] = F.when(whole, (F.col(f"forward_return_{h}d") > 0).cast("double"))
        for level in LEVELS:
            more[f"exceeds_{int(level * 100)}pct_{h}d"] = F.when(whole, (F.col(f"forward_return_{h}d") > level).cast("double"))
        path = F.collect_list("adj").over(ahead(h))
        start = F.struct(F.col("adj").alias("peak"), F.lit(0.0).alias("worst"))
        fold = F.aggregate(path, start, lambda a, p: F.struct(F.greatest(a["peak"], p).alias("peak"), F.least(a["worst"], F.coalesce(F.try_divide(p - F.greatest(a["peak"], p), F.greatest(a["peak"], p)), F.lit(0.0))).alias("worst")))
        more[f"max_drawdown_{h}d"] = F.when(whole & (F.col("adj") > 0), fold["worst"])
    return out.withColumns(more)


def relative_targets(bars: DataFrame, sectors: DataFrame, horizons=HORIZONS) -> DataFrame:
    """Forward return less its mean by date over the market and over the sector."""
    out = bars.join(sectors, "ticker", "left").withColumns({f"forward_return_{h}d": forward(h) for h in horizons})
    day, group = Window.partitionBy("trade_date"), Window.partitionBy("trade_date", "sector")
    more = {}
    for h in horizons:
        r = F.col(f"forward_return_{h}d")
        more[f"vs_market_{h}d"] = r - F.avg(r).over(day)
        more[f"vs_sector_{h}d"] = r - F.avg(r).over(group)
    return out.withColumns(more)


def triple_barrier(bars: DataFrame, up: float, down: float, days: int) -> Column:
    """1, -1 or 0 by the barrier first touched; both on one day count as none;
    null on the last row only."""
    path = F.collect_list(F.struct("high", "low")).over(ahead(days))
    top, floor = F.col("adj") * (1 + up), F.col("adj") * (1 + down)
    touched = F.filter(path, lambda x: (x["high"] >= top) | (x["low"] <= floor))
    first = F.get(touched, F.lit(0))
    both = (first["high"] >= top) & (first["low"] <= floor)
    return F.when(F.size(path) == 0, None).when(F.size(touched) == 0, F.lit(0.0)).when(both, F.lit(0.0)).when(first["high"] >= top, F.lit(1.0)).otherwise(F.lit(-1.0))
