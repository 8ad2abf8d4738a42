"""Statistics as column expressions, with the nulls and guards of the domain.

`None` means "not computable" throughout: never NaN, never zero.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

#: A variance at or below this share of the squared mean counts as zero.
FLAT = 1e-12


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(a, b)


def change(now: Column, before: Column) -> Column:
    """Relative change; null without a base."""
    return F.try_divide(now - before, before)


def over(x: Column, w: WindowSpec | None) -> Column:
    return x.over(w) if w is not None else x


def pearson(x: Column, y: Column, w: WindowSpec | None = None) -> Column:
    """Correlation over pairs where both are known; null for fewer than two or a flat side."""
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    n, sx, sy = over(F.count(F.when(a.isNotNull() & b.isNotNull(), 1)), w), over(F.stddev_pop(a), w), over(F.stddev_pop(b), w)
    flat = (sx <= FLAT * F.abs(over(F.avg(a), w))) | (sy <= FLAT * F.abs(over(F.avg(b), w))) | (sx == 0) | (sy == 0)
    return F.when((n < 2) | flat, F.lit(None)).otherwise(F.try_divide(over(F.covar_pop(a, b), w), sx * sy))


def mid_rank(x: Column, population: Column) -> Column:
    """Share of the array below x plus half the share equal; 0.5 for an empty array."""
    below = F.size(F.filter(population, lambda v: v < x))
    equal = F.size(F.filter(population, lambda v: v == x))
    return F.when(x.isNull(), None).when(F.size(population) == 0, F.lit(0.5)).otherwise((below + 0.5 * equal) / F.size(population))


def bucket(percentile: Column, k: int) -> Column:
    """Bucket of a percentile in [0, 1]; null stays null."""
    return F.when(percentile.isNotNull(), F.least(F.lit(k - 1), F.floor(percentile * k))).cast("int")


def clamp(x: Column, low: float, high: float) -> Column:
    """x within bounds; null stays null (`least` and `greatest` alone would skip it)."""
    return F.when(x.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), x)))


def mean_known(*parts: Column) -> Column:
    """Mean of the arguments that are not null; null if none is."""
    known = F.array_compact(F.array(*parts))
    total = F.aggregate(known, F.lit(0.0), lambda a, v: a + v)
    return F.when(F.size(known) > 0, total / F.size(known))
