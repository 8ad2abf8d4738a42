"""Review boards, gap reports, maturity, taxonomy, provenance edges, capability ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.stats import clamp, ratio

#: Fixed: horizons that each kind of event can move.
IMPACT = {"large_price_move": ("MICRO", "SWING"), "stock_split": ("MICRO",), "dividend": ("SWING", "INVESTMENT"), "company_news": ("MICRO", "SWING"), "macro_news": ("SWING", "INVESTMENT")}


def reviewed(rows: DataFrame, reviewers: dict[str, Column]) -> DataFrame:
    """Approved only if every reviewer approves; an undecided one counts against."""
    no = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in reviewers.items()]))
    return rows.withColumn("rejected_by", no).withColumn("approved", F.size("rejected_by") == 0)


def challenged(rows: DataFrame, attacks: dict[str, tuple[Column, float]]) -> DataFrame:
    """Confidence after the deltas of the attacks that succeed, within [0, 1]."""
    total: Column = F.lit(0.0)
    for hit, delta in attacks.values():
        total = total + F.when(F.coalesce(hit, F.lit(False)), F.lit(delta)).otherwise(0.0)
    return rows.withColumn("confidence_after", clamp(F.col("confidence") + total, 0.0, 1.0))


def gap_report(layers: DataFrame, key: str, flags: list[str]) -> DataFrame:
    """Share of keys that each data layer covers, layers as rows."""
    tall = layers.select(key, *[F.col(c).cast("double").alias(c) for c in flags]).unpivot([key], flags, "layer", "has")
    return tall.groupBy("layer").agg(F.avg(F.coalesce("has", F.lit(0.0))).alias("coverage"), F.count_if(F.coalesce("has", F.lit(0.0)) == 0).alias("missing"))


def maturity(levels: DataFrame, key: str, level: str) -> DataFrame:
    """A system is as mature as its least mature part."""
    return levels.groupBy(key).agg(F.min(level).alias("level"), F.min_by("part", F.struct(level, "part")).alias("weakest"))


def impact(events: DataFrame) -> DataFrame:
    """Events with the horizons of their subtype; unknown subtypes have none."""
    out: Column = F.array().cast("array<string>")
    for subtype, horizons in IMPACT.items():
        out = F.when(F.col("subtype") == subtype, F.array(*map(F.lit, horizons))).otherwise(out)
    return events.withColumn("impact_horizons", out)


def event_edges(events: DataFrame) -> DataFrame:
    """Typed edges from each event to its entities and its source."""
    e = events.select(F.col("event_id").alias("src"), F.explode("entities").alias("dst"), F.lit("AFFECTS").alias("kind"))
    return e.unionByName(events.select(F.col("event_id").alias("src"), F.col("source").alias("dst"), F.lit("REPORTED_BY").alias("kind")).distinct())


def found_by_label(nodes: DataFrame, text: str) -> DataFrame:
    return nodes.where(F.lower("label").contains(text.lower()))


def ranked_methods(methods: DataFrame, key: str, weights: dict[str, float]) -> DataFrame:
    """Methods of each target by weighted score; ties by name."""
    score: Column = F.lit(0.0)
    for name, w in weights.items():
        score = score + F.lit(w) * F.coalesce(name, F.lit(0.0))
    order = Window.partitionBy(key).orderBy(F.col("score").desc(), "method")
    return methods.withColumn("score", F.round(score, 9)).withColumn("rank", F.row_number().over(order).cast("long"))


def portfolio_summary(positions: DataFrame, by: list[str]) -> DataFrame:
    w = F.sum("weight")
    return positions.groupBy(*by).agg(F.count("*").alias("positions"), w.alias("invested"), F.greatest(F.lit(0.0), 1 - w).alias("cash"), ratio(F.sum(F.col("weight") * F.col("expected_return")), w).alias("expected_return"), ratio(F.sum(F.col("weight") * F.col("expected_risk")), w).alias("expected_risk"))


def status_counts(rows: DataFrame, statuses: list[str]) -> DataFrame:
    """Counts by each combination of the statuses, each subset of them and the whole, in one pass."""
    return rows.cube(*statuses).agg(F.count("*").alias("n"))


def inventory(rows: DataFrame, time: str, keys: list[Column], by: list[str] | None = None) -> DataFrame:
    """Rows, first and last time and rows that repeat a key, for the whole table or per value of `by`."""
    kept = rows.select(*(by or []), F.col(time).alias("_t"), F.struct(*keys).alias("_k"))
    each = kept.groupBy(*(by or []), "_k").agg(F.count("*").alias("n"), F.min("_t").alias("first"), F.max("_t").alias("last"))
    return each.groupBy(*(by or [])).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.min("first").alias("first"), F.max("last").alias("last"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeats"))


def committee_rates(views: DataFrame, by: str, expected: str = "expected_return", realized: str = "realized_return", decisive: float = 0.05) -> DataFrame:
    """How often views agree in sign with what came, and how often they are decisive."""
    share = lambda test: F.avg(test.cast("double"))
    return views.groupBy(by).agg(F.count("*").alias("n"), share(F.signum(expected) == F.signum(realized)).alias("agree_rate"), share(F.abs(expected) >= decisive).alias("decisive_rate"))


def directional_audit(views: DataFrame, by: str, expected: str = "expected_return", realized: str = "realized_return") -> DataFrame:
    """Views by the sign expected and the sign realised; not above zero counts as down, unknown as neither."""
    up = lambda c: F.col(c) > 0
    sides = {"up_up": up(expected) & up(realized), "up_down": up(expected) & ~up(realized), "down_up": ~up(expected) & up(realized), "down_down": ~up(expected) & ~up(realized)}
    return views.groupBy(by).agg(*[F.count_if(test).alias(name) for name, test in sides.items()])
