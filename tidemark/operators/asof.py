"""As-of and interval joins.

The as-of joins merge both sides into one stream per key and carry the last
(or next) known value along it: one shuffle by key and a running window, with
no range join whose size depends on the gaps. Left rows come back once each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _merged(left: DataFrame, right: DataFrame, on: list[str], lt: str, rt: str, value: Column, right_first: bool) -> DataFrame:
    a = left.select(*on, F.col(lt).alias("_t"), F.lit(1 if right_first else 0).alias("_side"), F.lit(None).cast(right.select(value).schema[0].dataType).alias("_v"), F.struct(*left.columns).alias("_row"))
    b = right.select(*on, F.col(rt).alias("_t"), F.lit(0 if right_first else 1).alias("_side"), value.alias("_v"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"))
    return a.unionByName(b)


def as_of(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, value: str, name: str | None = None) -> DataFrame:
    """Left rows with the last non-null `value` of the right dated at or before them."""
    rows = _merged(left, right, on, left_time, right_time, F.col(value), True)
    w = Window.partitionBy(*on).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_found", F.last("_v", ignorenulls=True).over(w)).where("_row is not null").select("_row.*", F.col("_found").alias(name or value))


def as_of_row(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, value: str, name: str | None = None) -> DataFrame:
    """As `as_of`, but the last right row counts even if its value is null."""
    wrapped = right.withColumn("_w", F.struct(F.col(value).alias("v")))
    return as_of(left, wrapped, on, left_time, right_time, "_w", "_w").withColumn(name or value, F.col("_w.v")).drop("_w")


def lagged_as_of(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, value: str, lag: int, name: str | None = None) -> DataFrame:
    """The value `lag` positions of the right series before the as-of position, nulls not skipped;
    a lag of zero or less is the plain as-of."""
    if lag <= 0:
        return as_of(left, right, on, left_time, right_time, value, name)
    moved = right.withColumn("_lagged", F.lag(value, lag).over(Window.partitionBy(*on).orderBy(right_time)))
    return as_of_row(left, moved, on, left_time, right_time, "_lagged", name or value)


def first_after(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, value: str, name: str | None = None) -> DataFrame:
    """Left rows with the first non-null `value` of the right dated at or after them."""
    rows = _merged(left, right, on, left_time, right_time, F.col(value), False)
    w = Window.partitionBy(*on).orderBy(F.desc("_t"), F.desc("_side")).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_found", F.last("_v", ignorenulls=True).over(w)).where("_row is not null").select("_row.*", F.col("_found").alias(name or value))


def near(left: DataFrame, right: DataFrame, on: str, left_day: str, right_day: str, days: int, how: str = "left_semi") -> DataFrame:
    """Left rows that have (left_semi) or lack (left_anti) a right row within `days` days.

    Right days are dealt into cells of 2 * days + 1; a left day looks into the
    two cells its interval can touch, so the join stays an equi-join.
    """
    size = 2 * days + 1
    number = lambda c: F.datediff(F.col(c), F.lit("1970-01-01").cast("date"))
    cells = right.select(F.col(on).alias("_k"), F.col(right_day).alias("_d"), F.floor(number(right_day) / size).alias("_cell")).distinct()
    cells = cells.groupBy("_k", "_cell").agg(F.collect_set("_d").alias("_days"))  # at most `size` days each
    at = [F.floor((number(left_day) + shift) / size) for shift in (-days, days)]
    rows = left
    for n, cell in enumerate(at):
        c = cells.select(F.col("_k").alias(f"_k{n}"), F.col("_cell").alias(f"_cell{n}"), F.col("_days").alias(f"_days{n}"))
        rows = rows.join(c, (F.col(on) == F.col(f"_k{n}")) & (cell == F.col(f"_cell{n}")), "left")
    close = F.lit(False)
    for n in range(2):
        close = close | F.coalesce(F.exists(f"_days{n}", lambda d: F.abs(F.datediff(F.col(left_day), d)) <= days), F.lit(False))
    return rows.where(close if how == "left_semi" else ~close).select(*left.columns)


def around(prices: DataFrame, events: DataFrame, on: str, price_day: str, event_day: str, value: str, days: int, least: int = 3) -> DataFrame:
    """Per event: mean of `value` over `days` days before and after, where each side has `least` rows.

    Days are dealt into cells of 2 * days + 1; an event meets the two cells
    its interval can touch, so that a price meets near events only.
    """
    size = 2 * days + 1
    cell = lambda c, by=0: F.floor((F.datediff(F.col(c), F.lit("1970-01-01").cast("date")) + by) / size)
    shift = F.datediff(F.col(price_day), F.col(event_day))
    e = events.withColumn("_cell", F.explode(F.array_distinct(F.array(cell(event_day, -days), cell(event_day, days)))))
    p = prices.withColumnRenamed(on, "_k").withColumn("_at", cell(price_day))
    rows = e.join(p, (F.col(on) == F.col("_k")) & (F.col("_cell") == F.col("_at")) & shift.between(-days, days)).withColumn("_s", shift)
    out = rows.groupBy(on, event_day).agg(
        F.count(F.when(F.col("_s") < 0, F.col(value))).alias("n_before"), F.count(F.when(F.col("_s") > 0, F.col(value))).alias("n_after"),
        F.avg(F.when(F.col("_s") < 0, F.col(value))).alias("before"), F.avg(F.when(F.col("_s") > 0, F.col(value))).alias("after"),
    )
    return out.where((F.col("n_before") >= least) & (F.col("n_after") >= least)).withColumn("shift", F.col("after") - F.col("before"))
