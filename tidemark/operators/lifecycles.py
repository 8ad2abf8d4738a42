"""Lifecycles: allowed steps, claims that climb stages on evidence, hypotheses before ordered gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed: to which states each state may change.
PATTERN = {
    "DISCOVERED": ("VALIDATING", "REJECTED"), "VALIDATING": ("VALIDATED", "REJECTED"), "VALIDATED": ("ACTIVE", "WEAKENING", "RETIRED", "REJECTED"),
    "ACTIVE": ("WEAKENING", "RETIRED", "REJECTED"), "WEAKENING": ("VALIDATED", "ACTIVE", "RETIRED", "REJECTED"), "REJECTED": (), "RETIRED": (),
}
EVENT = {
    "PENDING": ("CONFIRMED", "CORROBORATED", "DISPUTED", "RETRACTED", "ARCHIVED"), "CONFIRMED": ("CORROBORATED", "DISPUTED", "RETRACTED", "SUPERSEDED", "ARCHIVED"),
    "CORROBORATED": ("DISPUTED", "RETRACTED", "SUPERSEDED", "ARCHIVED"), "DISPUTED": ("CORROBORATED", "RETRACTED", "SUPERSEDED", "ARCHIVED"), "RETRACTED": ("ARCHIVED",), "SUPERSEDED": ("ARCHIVED",), "ARCHIVED": (),
}
GENE = {"PROPOSED": ("PROMOTED", "RETIRED"), "PROMOTED": ("MONITORING", "RETIRED", "REPLACED"), "MONITORING": ("RETIRED", "REPLACED"), "RETIRED": (), "REPLACED": ()}
KNOWLEDGE = {"PROMOTED": ("MONITORING", "RETIRED"), "MONITORING": ("RETIRED",), "RETIRED": ()}
SOURCE = {"candidate": ("quarantine",), "quarantine": ("evaluation", "candidate"), "evaluation": ("trusted", "quarantine"), "trusted": ("core", "evaluation"), "core": ("trusted",)}
STEPS = {"pattern": PATTERN, "event": EVENT, "gene": GENE, "knowledge": KNOWLEDGE, "source": SOURCE}
#: Fixed: stages of a claim, gates of a hypothesis, each in order; evidence that cannot validate.
CLAIM_STAGES = ("HYPOTHESIS", "EXPERIMENT", "VALIDATION", "SHADOW_FUND", "INVESTMENT_PROOF", "PROMOTED")
GATES = ("OBSERVATION", "HYPOTHESIS", "DATA_COLLECTION", "EXPERIMENT", "STATISTICAL_VALIDATION", "STRESS_TEST", "BACKTEST", "PEER_VALIDATION")
NO_EVIDENCE = "paper"


def illegal_steps(history: DataFrame, key: str, order: str, status: str, kind: str) -> DataFrame:
    """Changes of state that the lifecycle does not allow: key, order, from, to. Staying is no change."""
    allowed = [f"{a}>{b}" for a, bs in STEPS[kind].items() for b in bs]
    w = Window.partitionBy(key).orderBy(order)
    r = history.withColumn("_p", F.lag(status).over(w)).where(F.col("_p").isNotNull() & (F.col("_p") != F.col(status)))
    return r.where(~F.concat_ws(">", "_p", status).isin(*allowed)).select(key, order, F.col("_p").alias("from"), F.col(status).alias("to"))


def claim_stages(evidence: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Where each claim stands after its evidence: key, stage, version, refused.

    evidence: key, `order` (unique within a claim), stage, evidence_type, passed. A record counts if it is for the claim's
    stage or the next one and is no paper; passing it lifts the claim to that stage, failing it (or a null result) rejects the
    claim. A rejected or promoted claim takes nothing more. Others are refused. The version starts at 1 and
    grows with each record taken.

    The first lift to each stage is a minimum over the claim after the lift before it, and all else follows from these
    few times: windows over one partitioning, no history is gathered into one value."""
    last, whole = len(CLAIM_STAGES) - 1, Window.partitionBy(key)
    number = F.array_position(F.array(*map(F.lit, CLAIM_STAGES)), F.coalesce("stage", F.lit(""))).cast("int") - 1
    r = evidence.select(F.col(key), F.struct(*order).alias("_o"), number.alias("_k"), F.coalesce("passed", F.lit(False)).alias("_ok"), (F.coalesce("evidence_type", F.lit("")) != NO_EVIDENCE).alias("_fit"))
    for k in range(1, last + 1):
        later = F.lit(True) if k == 1 else F.coalesce(F.col("_o") > F.col(f"_t{k - 1}"), F.lit(False))
        r = r.withColumn(f"_t{k}", F.min(F.when(F.col("_fit") & F.col("_ok") & (F.col("_k") == k) & later, F.col("_o"))).over(whole))
    at = sum((F.coalesce(F.col(f"_t{k}") < F.col("_o"), F.lit(False)).cast("int") for k in range(1, last + 1)), F.lit(0))
    r = r.withColumn("_at", at).withColumn("_taken", F.col("_fit") & (F.col("_at") < last) & F.col("_k").isin(*range(last + 1)) & ((F.col("_k") == F.col("_at")) | (F.col("_k") == F.col("_at") + 1)))
    r = r.withColumn("_end", F.min(F.when(F.col("_taken") & ~F.col("_ok"), F.col("_o"))).over(whole))
    r = r.withColumn("_taken", F.col("_taken") & F.coalesce(F.col("_o") <= F.col("_end"), F.lit(True)))
    reached = F.max(F.when(F.col("_taken") & F.col("_ok"), F.col("_k")))
    out = r.groupBy(key).agg(F.coalesce(reached, F.lit(0)).alias("_k"), F.max(F.col("_end").isNotNull()).alias("_rejected"), (F.count_if("_taken") + 1).alias("version"), F.count_if(~F.col("_taken")).alias("refused"))
    stage = F.when(F.col("_rejected"), "REJECTED").otherwise(F.get(F.array(*map(F.lit, CLAIM_STAGES)), F.col("_k")))
    return out.select(key, stage.alias("stage"), "version", "refused")


def gate_states(results: DataFrame, key: str, order: list[str]) -> DataFrame:
    """What each hypothesis faces next: key, passed, next_gate, status, skipped.

    results: key, gate, `order`, passed; the last result of a gate counts, unknown gates do not. The next gate is the first in order
    that is not passed: failed there is REJECTED, not tried IN_PROGRESS, none left VALIDATED. `skipped` counts gates
    passed beyond it."""
    names = F.array(*map(F.lit, GATES))
    last = results.where(F.col("gate").isin(*GATES)).groupBy(key, "gate").agg(F.max_by(F.coalesce("passed", F.lit(False)), F.struct(*order)).alias("ok"))
    g = last.groupBy(key).agg(F.collect_set(F.when(F.col("ok"), F.col("gate"))).alias("good"), F.collect_set(F.when(~F.col("ok"), F.col("gate"))).alias("bad"))
    every = results.select(key).distinct().join(g, key, "left").withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("good", "bad")})
    ahead = F.get(F.filter(names, lambda n: ~F.array_contains("good", n)), F.lit(0))
    through = F.when(F.col("next_gate").isNull(), F.lit(len(GATES))).otherwise(F.array_position(names, F.col("next_gate")) - 1)
    r = every.withColumn("next_gate", ahead).withColumn("passed", through.cast("int"))
    status = F.when(F.col("next_gate").isNull(), "VALIDATED").when(F.array_contains("bad", F.col("next_gate")), "REJECTED").otherwise("IN_PROGRESS")
    return r.select(key, "passed", "next_gate", status.alias("status"), (F.size("good") - F.col("passed")).alias("skipped"))
