"""Events derived from bars, macro series, filings and news, and their register."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed: event subtypes of filings, move thresholds.
CORPORATE = {"EARNINGS": "earnings", "DIVIDEND": "dividend", "SPLIT": "stock_split", "STOCK_SPLIT": "stock_split", "MERGER": "merger_acquisition", "ACQUISITION": "merger_acquisition", "CAPITAL_INCREASE": "capital_increase", "MANAGEMENT_CHANGE": "management_change", "GUIDANCE": "guidance_update", "BUYBACK": "share_buyback", "DELISTING": "delisting"}
PRICE_MOVE, MACRO_MOVE, BOOST, PENALTY = 0.03, 0.01, 0.5, 0.2
TERMINAL = ("RETRACTED", "SUPERSEDED", "ARCHIVED")


def fingerprint(kind: Column, subtype: Column, entities: Column, day: Column, discriminator: Column | None = None) -> Column:
    """Content identity: equal facts get equal ids, whatever the source."""
    parts = [kind, subtype, F.array_join(F.array_sort(F.array_distinct(entities)), ","), day.cast("string")] + ([discriminator] if discriminator is not None else [])
    return F.concat(F.lit("event_"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 20))


def _shaped(rows: DataFrame, kind: str, subtype: Column, entities: Column, day: str, source: Column, confidence: float, severity: Column, value: Column, discriminator: Column | None = None) -> DataFrame:
    return rows.select(
        fingerprint(F.lit(kind), subtype, entities, F.col(day), discriminator).alias("event_id"), F.lit(kind).alias("event_type"), subtype.alias("subtype"), entities.alias("entities"),
        F.col(day).alias("event_date"), source.alias("source"), F.lit(confidence).alias("confidence"), severity.alias("severity"), value.alias("value"),
    )


def _moves(rows: DataFrame, key: str, day: str, value: str, threshold: float) -> tuple[DataFrame, Column]:
    before = F.lag(value).over(Window.partitionBy(key).orderBy(day))
    rows = rows.withColumn("pct_move", F.try_divide(F.col(value) - before, before)).where(F.abs("pct_move") >= threshold)
    return rows, F.when(F.abs("pct_move") >= 2 * threshold, "HIGH").otherwise("MEDIUM")


def from_prices(bars: DataFrame, threshold: float = PRICE_MOVE) -> DataFrame:
    rows, severity = _moves(bars, "ticker", "trade_date", "close", threshold)
    return _shaped(rows, "market", F.lit("large_price_move"), F.array("ticker"), "trade_date", F.lit("price_history"), 1.0, severity, F.col("pct_move"))


def from_macro(series: DataFrame, threshold: float = MACRO_MOVE) -> DataFrame:
    rows, severity = _moves(series, "series_id", "observation_date", "value", threshold)
    subtype = F.when(F.col("series_id") == "EGP_USD", "currency_move").when(F.col("series_id") == "BRENT_USD", "commodity_price_move").otherwise("unknown")
    return _shaped(rows, "macroeconomic", subtype, F.array("series_id"), "observation_date", F.lit("macro_series"), 1.0, severity, F.col("pct_move"))


def from_filings(filings: DataFrame) -> DataFrame:
    subtype: Column = F.lit("unknown")
    for raw, name in CORPORATE.items():
        subtype = F.when(F.upper("event_type") == raw, name).otherwise(subtype)
    return _shaped(filings, "corporate", subtype, F.array("ticker"), "event_date", F.lit("corporate_events"), 1.0, F.lit("MEDIUM"), F.coalesce("dividend_amount", "split_ratio"))


def from_news(news: DataFrame) -> DataFrame:
    """News with tickers name them; news without speak of the market."""
    named = F.size(F.coalesce("tickers", F.array().cast("array<string>"))) > 0
    entities = F.when(named, F.col("tickers")).otherwise(F.array(F.lit("MARKET")))
    return _shaped(news, "news", F.when(named, "company_news").otherwise("macro_news"), entities, "published_at", F.col("source"), 0.6, F.lit("LOW"), F.lit(None).cast("double"), F.col("headline"))


def merge_report(state: dict | None, report: dict) -> dict:
    """One step of the register: first report confirms; another source that agrees
    corroborates, one that contradicts disputes; the same source again, or an event
    that has ended, changes nothing."""
    meta = {k: v for k, v in (report["metadata"] or {}).items()}
    if report.get("action") in ("RETRACTED", "SUPERSEDED") and state is not None:
        return state if state["status"] in TERMINAL else state | {"status": report["action"], "version": state["version"] + 1}
    if state is None:
        return {"status": "CONFIRMED", "confidence": report["confidence"], "sources": [report["source"]], "metadata": meta, "disputed": [], "version": 1}
    if state["status"] in TERMINAL or report["source"] in state["sources"]:
        return state
    clash = sorted(k for k in meta if k in state["metadata"] and state["metadata"][k] != meta[k])
    if clash:
        confidence, status = max(0.0, min(state["confidence"], report["confidence"]) - PENALTY), "DISPUTED"
    else:
        confidence, status = min(1.0, state["confidence"] + (1 - state["confidence"]) * BOOST), "DISPUTED" if state["status"] == "DISPUTED" else "CORROBORATED"
    return {"status": status, "confidence": confidence, "sources": [*state["sources"], report["source"]], "metadata": {**meta, **state["metadata"]}, "disputed": sorted({*state["disputed"], *clash}), "version": state["version"] + 1}


REGISTER = "event_id string, status string, confidence double, sources array<string>, disputed array<string>, metadata string, version int"


def registered(key: str, state: dict) -> dict:
    return {"event_id": key, "status": state["status"], "confidence": round(state["confidence"], 9), "sources": state["sources"], "disputed": state["disputed"], "metadata": json.dumps(state["metadata"], sort_keys=True), "version": state["version"]}


def register(reports: DataFrame) -> DataFrame:
    """Batch twin of the stateful stream: reports (event_id, seq, source, confidence, metadata
    map, action) folded in order of seq. A group is the reports of one fact; repeats of
    one source and content collapse before the shuffle by fact."""
    first = reports.groupBy("event_id", "source", "confidence", "action", F.to_json("metadata").alias("metadata")).agg(F.min("seq").alias("seq"))

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        state = None
        for r in part.sort_values("seq").to_dict("records"):
            state = merge_report(state, r | {"metadata": json.loads(r["metadata"]) if r["metadata"] else {}})
        return pd.DataFrame([registered(part["event_id"].iloc[0], state)])

    return first.groupBy("event_id").applyInPandas(fold, REGISTER)


def representative(events: DataFrame, keys: list[str]) -> DataFrame:
    """Per key and subtype the gravest event: severity, confidence, date, id."""
    rank = F.when(F.col("severity") == "CRITICAL", 4).when(F.col("severity") == "HIGH", 3).when(F.col("severity") == "MEDIUM", 2).otherwise(1)
    return events.groupBy(*keys, "subtype").agg(F.max(F.struct(rank.alias("rank"), "confidence", "event_date", "event_id")).alias("m")).select(*keys, "subtype", "m.*")


def event_risk(representatives: DataFrame, keys: list[str], most: float = 0.3) -> DataFrame:
    """Capped sum of severity penalties weighted by confidence."""
    penalty = F.element_at(F.array(*map(F.lit, (0.02, 0.05, 0.12, 0.25))), F.col("rank"))
    return representatives.groupBy(*keys).agg(F.least(F.lit(most), F.sum(penalty * F.col("confidence"))).alias("event_risk"))
