"""Source accounting: run metrics, reputation, promotion, alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.stats import clamp, mean_known, ratio

#: Fixed: stages, runs and composite needed for each next stage, latency target, alert levels.
STAGES, MIN_RUNS, MIN_COMPOSITE = ("candidate", "quarantine", "evaluation", "trusted", "core"), (1, 5, 20, 100), (0.0, 0.0, 0.70, 0.85)
LATENCY_TARGET, DOWN_AFTER, STALE = 5.0, 3, 0.3


def metrics(runs: DataFrame) -> DataFrame:
    """Counters per source in one aggregation, and the failures in a row at its end."""
    w = Window.partitionBy("source_id").orderBy(F.col("occurred_at").desc(), F.col("run_id").desc()).rowsBetween(Window.unboundedPreceding, 0)
    r = runs.withColumn("_ok_after", F.count_if("succeeded").over(w))
    return r.groupBy("source_id").agg(
        F.count("*").alias("runs_total"), F.count_if("succeeded").alias("runs_succeeded"), F.sum("records_expected").cast("long").alias("expected"), F.sum("records_produced").cast("long").alias("produced"),
        F.avg("confidence").alias("accuracy"), F.avg("latency_seconds").alias("latency"), F.count_if("materialized").alias("materialized_total"), F.count_if(F.col("_ok_after") == 0).alias("consecutive_failures"),
    )


def reputation(m: DataFrame) -> DataFrame:
    """Dimensions in [0, 1] and their mean over those that were measured."""
    latency = F.when(F.col("latency") <= LATENCY_TARGET, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - (F.col("latency") - LATENCY_TARGET) / (9 * LATENCY_TARGET)))
    out = m.withColumns({"availability": ratio(F.col("runs_succeeded"), F.col("runs_total")), "usefulness": ratio(F.col("materialized_total"), F.col("runs_total")), "coverage": clamp(ratio(F.col("produced"), F.col("expected")), 0.0, 1.0), "latency_score": latency})
    return out.withColumn("composite", mean_known(F.col("availability"), F.col("usefulness"), F.col("accuracy"), F.col("coverage"), F.col("latency_score")))


def promotion(rep: DataFrame, stage: str = "stage", health: str = "health") -> DataFrame:
    """The stage each source should have now: down demotes one, enough runs and reputation promote one."""
    at = F.array_position(F.array(*map(F.lit, STAGES)), F.col(stage)).cast("int")
    following = F.least(at, F.lit(4))
    runs, composite = F.element_at(F.array(*map(F.lit, MIN_RUNS)), following), F.element_at(F.array(*map(F.lit, MIN_COMPOSITE)), following)
    target = (
        F.when(F.coalesce("runs_total", F.lit(0)) == 0, 1).when((F.col(health) == "down") & (at > 1), at - 1).when(at == 5, 5)
        .when((F.col("runs_total") >= runs) & ((composite == 0) | (F.col("composite") >= composite)), at + 1).otherwise(at)
    )
    return rep.withColumn("recommended", F.element_at(F.array(*map(F.lit, STAGES)), target.cast("int")))


def alerts(runs: DataFrame) -> DataFrame:
    """(source_id, run_id, kind, severity): what each run should raise, by its own facts and those before it."""
    w = Window.partitionBy("source_id").orderBy("occurred_at", "run_id")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    r = runs.withColumns({"_had": F.coalesce(F.max(F.col("records_produced") > 0).over(before), F.lit(False)), "_i": F.row_number().over(w)})
    r = r.withColumn("_ok", F.coalesce(F.max(F.when(F.col("succeeded"), F.col("_i"))).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    failing = F.col("_i") - F.col("_ok")
    empty = F.col("succeeded") & (F.col("records_produced") == 0)
    rules: list[tuple[str, str, Column]] = [
        ("fetch_failure", "warning", ~F.col("succeeded")), ("layout_change", "warning", empty & F.col("_had")), ("zero_yield", "warning", empty & ~F.col("_had")),
        ("staleness", "warning", F.col("confidence") < STALE), ("consecutive_failures", "critical", failing >= DOWN_AFTER),
    ]
    found = F.array_compact(F.array(*[F.when(ok, F.struct(F.lit(k).alias("kind"), F.lit(s).alias("severity"))) for k, s, ok in rules]))
    return r.select("source_id", "run_id", F.inline(found))


def batch_quality(batches: DataFrame) -> DataFrame:
    """Coverage, completeness, validity and confidence of parsed batches (produced, expected, warnings, errors, reliability)."""
    coverage = F.when(F.col("expected") > 0, F.least(F.lit(1.0), F.col("produced") / F.col("expected"))).otherwise((F.col("produced") > 0).cast("double"))
    complete = F.when(F.col("produced") == 0, (F.col("warnings") == 0).cast("double")).otherwise(F.col("produced") / (F.col("produced") + F.col("warnings")))
    valid = F.when(F.col("produced") == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.col("errors") / F.col("produced")))
    out = batches.withColumns({"coverage": coverage, "completeness": complete, "validity": valid})
    return out.withColumn("confidence", (F.col("coverage") + F.col("completeness") + F.col("validity") + F.col("reliability") + 1.0) / 5)
