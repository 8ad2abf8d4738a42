"""Daily state of a paper fund: drift, rebalance, costs, average cost, value."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Fixed: rebalance band and trading cost.
BAND, COST = 0.01, 0.0010
SCHEMA = "fund string, day date, nav double, cash double, turnover double, costs double, drawdown double, positions int"


def advance(state: dict | None, prices: dict[str, float], targets: dict[str, float]) -> tuple[dict, dict]:
    """One day: revalue the holdings, trade those beyond the band, pay costs.

    state: cash, units, cost (average), peak. Tickers without a price keep theirs."""
    s = state or {"cash": 1.0, "units": {}, "cost": {}, "last": {}, "peak": 1.0}
    last = {**s["last"], **{t: p for t, p in prices.items() if p and p > 0}}
    units, cost = dict(s["units"]), dict(s["cost"])
    nav = s["cash"] + sum(u * last.get(t, 0.0) for t, u in units.items())
    cash, turnover, paid = s["cash"], 0.0, 0.0
    for t in sorted({*units, *targets}):
        price = last.get(t)
        if not price:
            continue
        move = targets.get(t, 0.0) * nav - units.get(t, 0.0) * price
        if abs(move) <= BAND * nav and targets.get(t, 0.0) > 0:
            continue
        held = units.get(t, 0.0)
        units[t] = held + move / price
        if move > 0:
            cost[t] = (held * cost.get(t, 0.0) + move) / units[t] if units[t] else 0.0
        fee = abs(move) * COST
        cash, turnover, paid = cash - move - fee, turnover + abs(move), paid + fee
    units = {t: u for t, u in units.items() if abs(u) > 1e-12}
    nav = cash + sum(u * last.get(t, 0.0) for t, u in units.items())
    peak = max(s["peak"], nav)
    after = {"cash": cash, "units": units, "cost": {t: cost[t] for t in units if t in cost}, "last": last, "peak": peak}
    return after, {"nav": nav, "cash": cash, "turnover": turnover, "costs": paid, "drawdown": nav / peak - 1, "positions": len(units)}


def _days(key: str, rows: pd.DataFrame, state: dict | None):
    out = []
    for day, part in rows.groupby("day", sort=True):
        state, row = advance(state, dict(zip(part["ticker"], part["price"])), {t: w for t, w in zip(part["ticker"], part["target"]) if w == w and w})
        out.append({"fund": key, "day": day, **row})
    return state, out


def nav_history(rows: DataFrame) -> DataFrame:
    """Batch: rows (fund, day, ticker, price, target) folded per fund by day."""

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_days(part["fund"].iloc[0], part, None)[1])

    return rows.groupBy("fund").applyInPandas(fold, SCHEMA)


def nav_stream(rows: DataFrame) -> DataFrame:
    """Stream: the same fold with the fund's state kept between batches; days must arrive in order."""

    def step(key: tuple, parts, state: GroupState):
        before = json.loads(state.get[0]) if state.exists else None
        after, out = _days(key[0], pd.concat(list(parts)), before)
        state.update((json.dumps(after),))
        yield pd.DataFrame(out)

    return rows.groupBy("fund").applyInPandasWithState(step, SCHEMA, "state string", "append", GroupStateTimeout.NoTimeout)
