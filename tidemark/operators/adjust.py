"""Close prices adjusted for splits and dividends."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def split_adjusted(bars: DataFrame, events: DataFrame) -> DataFrame:
    """Bars with `adj`: the close over the product of the ratios of later splits.

    Splits and bars share one ordered pass per ticker, so there is no range join.
    """
    cut = events.where("split_ratio > 0").groupBy("ticker", F.col("event_date").alias("trade_date")).agg(F.product("split_ratio").alias("ratio"))
    marked = bars.join(cut, ["ticker", "trade_date"], "full_outer")
    later = Window.partitionBy("ticker").orderBy(F.col("trade_date").desc()).rowsBetween(Window.unboundedPreceding, -1)
    factor = F.coalesce(F.product("ratio").over(later), F.lit(1.0))
    return marked.withColumn("adj", F.col("close") / factor).where("close is not null").drop("ratio")


def adjusted(bars: DataFrame, events: DataFrame) -> DataFrame:
    """Bars with `adj` for mixed chains: newest event first, a dividend's factor
    from the already adjusted close before it. One ticker's history is one
    group; it is bounded by the number of trading days."""
    own = events.groupBy(F.col("ticker").alias("t")).agg(F.collect_list(F.struct("event_date", "split_ratio", "dividend_amount")).alias("events"))
    rows = bars.join(own, bars["ticker"] == own["t"], "left").drop("t")

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("trade_date", kind="stable").reset_index(drop=True)
        price = part["close"].to_numpy(float).copy()
        days = pd.to_datetime(part["trade_date"]).to_numpy()
        listed = part["events"].iloc[0]
        chain = sorted(({} if listed is None else {k: e for k, e in enumerate(listed)}).values(), key=lambda e: e["event_date"], reverse=True)
        for e in chain:
            upto = int(days.searchsorted(pd.Timestamp(e["event_date"]).to_datetime64()))
            split, cash = e["split_ratio"], e["dividend_amount"]
            if split is not None and split == split:
                factor = 1 / split if split > 0 else None
            elif cash is not None and cash == cash and upto and price[upto - 1] > 0:
                factor = max(0.0, (price[upto - 1] - cash) / price[upto - 1])
            else:
                factor = None
            if factor is not None:
                price[:upto] *= factor
        return part.drop(columns="events").assign(adj=price)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in bars.schema) + ", adj double"
    return rows.groupBy("ticker").applyInPandas(fold, schema)
