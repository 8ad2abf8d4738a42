"""Findings of research agents over whole price histories: drift after events, agreement of analogs, cases before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import asof

#: Fixed: least shift of the mean return, returns on each side of an event; analogs and the share that must agree.
LEAST_SHIFT, LEAST_SIDE, LEAST_ANALOGS, AGREEMENT = 0.002, 3, 4, 0.7


def event_drift(bars: DataFrame, events: DataFrame, price: str = "adj", least_shift: float = LEAST_SHIFT, least_side: int = LEAST_SIDE) -> DataFrame:
    """Events after which a ticker's mean daily return differs from the one before, over its whole history.

    bars: ticker, trade_date, `price`; events: ticker, event_date, event_type. A return belongs to the later of its two
    days and counts as before when it is not later than the event. Sums run along each ticker once; an event reads them as
    of its date, so the work does not grow with events times days. Sums are decimal: they do not depend on
    the order of rows. Returns next to a missing or zero price are left out. Repeated events give repeated rows."""
    line = Window.partitionBy("ticker").orderBy("trade_date")
    upto, whole = line.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("ticker")
    p = bars.select("ticker", "trade_date", F.col(price).alias("p"))
    p = p.withColumn("x", F.try_divide(F.col("p") - F.lag("p").over(line), F.lag("p").over(line)).cast("decimal(18,9)"))
    sums = F.struct(F.count("x").over(upto).alias("n"), F.sum("x").over(upto).alias("s"), F.count("x").over(whole).alias("all_n"), F.sum("x").over(whole).alias("all_s"), F.count("*").over(whole).alias("bars"))
    e = asof.as_of(events.select("ticker", "event_date", "event_type"), p.withColumn("sums", sums), ["ticker"], "event_date", "trade_date", "sums")
    n, after = F.col("sums.n"), F.col("sums.all_n") - F.col("sums.n")
    before_mean = F.try_divide(F.coalesce("sums.s", F.lit(0)).cast("double"), n)
    after_mean = F.try_divide((F.col("sums.all_s") - F.coalesce("sums.s", F.lit(0))).cast("double"), after)
    out = e.where((n >= least_side) & (after >= least_side) & (F.col("sums.bars") >= 2 * least_side + 1))
    out = out.select("ticker", "event_date", "event_type", n.alias("n_before"), after.alias("n_after"), (after_mean - before_mean).alias("shift"))
    return out.where(F.abs("shift") >= least_shift).withColumn("direction", F.when(F.col("shift") > 0, "upward").otherwise("downward"))


def analog_agreement(analogs: DataFrame, least: int = LEAST_ANALOGS, agreement: float = AGREEMENT) -> DataFrame:
    """Tickers whose analogs (ticker, forward_return; at most a few each) mostly went one way: n, agreement, direction, mean_return."""
    up = F.count_if(F.col("forward_return") > 0)
    a = analogs.groupBy("ticker").agg(F.count("*").alias("n"), up.alias("up"), F.avg("forward_return").alias("mean_return"))
    share = F.greatest("up", F.col("n") - F.col("up")) / F.col("n")
    direction = F.when(F.col("up") >= F.col("n") - F.col("up"), "positive").otherwise("negative")
    return a.where(F.col("n") >= least).select("ticker", "n", share.alias("agreement"), direction.alias("direction"), "mean_return").where(F.col("agreement") >= agreement)


def cases_before(subjects: DataFrame, events: DataFrame, entity: str, day: str, order: list[str], case: str, k: int = 5) -> DataFrame:
    """Each subject (entity, before) with the newest `k` cases of its entity on days before it, newest first (`cases`).

    Each event carries itself and the k - 1 events before it; the last event of a day stands for the day, and a subject reads it
    as of the day before its cut-off. Nothing is joined by range and no history is gathered."""
    line = Window.partitionBy(entity).orderBy(day, *order).rowsBetween(1 - k, 0)
    e = events.select(entity, day, *order, case).withColumn("_cases", F.reverse(F.collect_list(case).over(line)))
    last = e.groupBy(entity, day).agg(F.max_by("_cases", F.struct(*order)).alias("cases"))
    cut = subjects.select(entity, "before").withColumn("_cut", F.date_sub("before", 1))
    found = asof.as_of(cut, last, [entity], "_cut", day, "cases").drop("_cut")
    return found.withColumn("cases", F.coalesce("cases", F.array().cast(e.schema["_cases"].dataType)))
