"""Checks of what is published and of what a study was allowed to know. Each check gives the rows that fail."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed: days that a broken thesis and a passed catalyst stay in the report; seconds two clocks may differ.
THESIS_DAYS, CATALYST_DAYS, SKEW_SECONDS = 14, 7, 600


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def later_than(as_of: str, tables: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """(record, subject, dated_on) of everything in a snapshot that is dated after it.
    tables: record kind -> (rows, subject column, date column)."""
    day = F.lit(as_of).cast("date")
    return union([df.where(F.to_date(F.col(on)) > day).select(F.lit(kind).alias("record"), F.col(subject).cast("string").alias("subject"), F.to_date(F.col(on)).alias("dated_on")) for kind, (df, subject, on) in tables.items()])


def leaked(hypotheses: DataFrame, as_of: str, created: str = "created_at") -> DataFrame:
    """Hypotheses that are younger than the snapshot they claim to come from."""
    return hypotheses.where(F.to_date(F.col(created)) > F.lit(as_of).cast("date"))


def attack(found: DataFrame, loss: float = -0.3) -> DataFrame:
    """One row: whether any record was found, how many, and what that costs in confidence."""
    return found.agg((F.count("*") > 0).alias("succeeded"), F.count("*").alias("records"), F.when(F.count("*") > 0, F.lit(loss)).otherwise(F.lit(0.0)).alias("confidence_delta"))


def bundle_problems(manifests: DataFrame, artifacts: DataFrame, skew_seconds: int = SKEW_SECONDS) -> DataFrame:
    """(bundle_id, artifact, problem) where the parts of a bundle disagree with its manifest.

    manifests: bundle_id, as_of, mode, generated_at, commit, run_id. artifacts: bundle_id, artifact,
    as_of, mode, completed_at, commit, run_id, last_requested (the last day the run was asked for).
    A null on the side of the artifact is not compared, nor is a null as_of of the manifest."""
    names = ("as_of", "mode", "commit", "run_id", "generated_at")
    m = manifests.select("bundle_id", *[F.col(c).alias(f"_m_{c}") for c in names])
    differ = lambda c: F.col(c).isNotNull() & F.col(f"_m_{c}").isNotNull() & (F.col(c) != F.col(f"_m_{c}"))
    # what the manifest must state: its absence there is a difference
    states = lambda c: F.col(c).isNotNull() & ~F.col(c).eqNullSafe(F.col(f"_m_{c}"))
    tests = {
        "as_of": differ("as_of"), "mode": states("mode"), "commit": states("commit"), "run_id": states("run_id"),
        "newer_than_requested": F.col("_m_as_of") > F.col("last_requested"),
        "clock": F.abs(F.unix_timestamp("completed_at") - F.unix_timestamp("_m_generated_at")) > skew_seconds,
    }
    rows = artifacts.join(m.withColumn("_has", F.lit(True)), "bundle_id", "left")
    failed = F.array_compact(F.array(*[F.when(F.col("_has") & c, F.lit(n)) for n, c in tests.items()], F.when(F.col("_has").isNull(), F.lit("no_manifest"))))
    return rows.select("bundle_id", "artifact", F.explode(failed).alias("problem"))


def decision_routes(sources: DataFrame, routes: DataFrame) -> DataFrame:
    """Records and consumers of each implemented source; null consumers mark one that has no route.
    sources: source_id, status. routes: source_id, records, consumers."""
    live = sources.where("status = 'IMPLEMENTED'").select("source_id").distinct()
    return live.join(routes, "source_id", "left").select("source_id", "records", "consumers", F.col("consumers").isNull().alias("unrouted"))


def violations(rows: DataFrame, key: list[str], required: list[str] = (), ranges: dict[str, tuple[float, float]] | None = None, rules: dict[str, Column] | None = None) -> DataFrame:
    """(rule, key as text) of every row that lacks a required field, repeats a key, leaves a range or breaks a rule.
    A rule that is null for a row does not fail it."""
    tests = {f"missing:{c}": F.col(c).isNull() for c in required}
    tests |= {f"range:{c}": (F.col(c) < low) | (F.col(c) > high) for c, (low, high) in (ranges or {}).items()}
    tests |= {f"rule:{n}": ~c for n, c in (rules or {}).items()}
    name = F.concat_ws("|", *[F.col(c).cast("string") for c in key])
    each = rows.select(F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in tests.items()]))).alias("rule"), name.alias("subject")) if tests else None
    twice = rows.groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1").select(F.lit("repeated_key").alias("rule"), name.alias("subject"))
    return twice if each is None else each.unionByName(twice)


def uncovered(expected: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Expected keys that no row has."""
    return expected.select(*key).distinct().join(rows.select(*key).distinct(), key, "left_anti")


def monitoring(as_of: str, held: DataFrame, decisions: DataFrame, knowledge: DataFrame, support: DataFrame, events: DataFrame, illiquid: DataFrame, country: DataFrame, concentration: DataFrame) -> DataFrame:
    """(category, severity, ticker, detail) of all six kinds of warning.

    held: ticker. decisions: ticker, valid_until. knowledge: knowledge_id, status, retired_on, assets
    (array). support: ticker, knowledge_id. events: ticker, event_date, event_type. illiquid: ticker.
    country: severity. concentration: status, sector_status, max_ticker. Broken theses are
    looked for in all knowledge, the others among what is held."""
    day = F.lit(as_of).cast("date")
    row = lambda category, severity, ticker, detail: [F.lit(category).alias("category"), (severity if isinstance(severity, Column) else F.lit(severity)).alias("severity"), ticker.cast("string").alias("ticker"), detail.cast("string").alias("detail")]
    tickers, none = held.select("ticker").distinct(), F.lit(None)
    retired = knowledge.where((F.col("status") == "RETIRED") & (F.col("retired_on").isNull() | (F.datediff(day, "retired_on") <= THESIS_DAYS)))
    past = F.datediff(day, "event_date")
    watched = support.join(knowledge.where("status = 'MONITORING'").select("knowledge_id"), "knowledge_id").join(tickers, "ticker", "left_semi")
    return union(
        [
            country.where("severity <> 'NORMAL'").select(*row("MACRO_RISK_INCREASED", F.when(F.col("severity") == "CRISIS", "CRITICAL").otherwise("WARNING"), none, F.col("severity"))),
            concentration.where("status = 'concentrated'").select(*row("PORTFOLIO_CONCENTRATION", "WARNING", F.col("max_ticker"), F.lit("position"))),
            concentration.where("sector_status = 'concentrated'").select(*row("PORTFOLIO_CONCENTRATION", "WARNING", none, F.lit("sector"))),
            retired.select("knowledge_id", F.explode("assets").alias("ticker")).select(*row("BROKEN_THESIS", "CRITICAL", F.col("ticker"), F.col("knowledge_id"))),
            events.join(tickers, "ticker", "left_semi").where((past >= 0) & (past <= CATALYST_DAYS)).select(*row("CATALYST_EXPIRED", "INFO", F.col("ticker"), F.col("event_type"))),
            illiquid.join(tickers, "ticker", "left_semi").select(*row("LIQUIDITY_DETERIORATION", "WARNING", F.col("ticker"), none)),
            decisions.join(tickers, "ticker", "left_semi").where(F.col("valid_until") <= day).select(*row("REVIEW_REQUIRED", "WARNING", F.col("ticker"), F.lit("decision"))),
            watched.select(*row("REVIEW_REQUIRED", "INFO", F.col("ticker"), F.col("knowledge_id"))),
        ]
    )
