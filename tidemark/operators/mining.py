"""Search for rules over all features of a ticker, and the gates a rule passes.

`panel` lays every series out long by position: own features, those of the
sector leader, market series. `candidates` proposes rules per ticker (its
history bounds the group); from there on everything is joins and aggregations:
a rule is a set of condition rows, it matches on the dates where as many of its
conditions hold as it has, and all rules and all their variants are matched in
one pass.

Rules: `single` (one condition at each quantile), `pair` and `triple` (medians,
above), `regime` (a single with a market series above its median), `lead_lag`
(a market or leader series above its median some positions before). A rule
whose dates overlap a kept one of its kind too much is dropped.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import outcomes

#: Fixed: quantiles, lags in positions, shares of thresholds, holdout share.
QUANTILES, LAGS, DELTAS, HOLDOUT = (0.3, 0.5, 0.7), (1, 3, 5, 10, 20, 60), (-0.25, -0.10, 0.10, 0.25), 0.15
CONDITIONS = "ticker string, rule_id string, kind string, n_conditions int, place int, feature_id string, op string, threshold double, lag int"


@dataclass(frozen=True)
class Search:
    least: int = 30
    correlated: float = 0.8
    overlap: float = 0.85
    most: int = 500
    each: int | None = None
    headroom: int = 2
    pairs: bool = True
    triples: bool = True
    regimes: bool = True
    lead_lag: bool = True


def panel(own: DataFrame, market: DataFrame | None = None, leaders: DataFrame | None = None) -> DataFrame:
    """(ticker, trade_date, pos, days, feature_id, role, value): each series as last known on each day of the ticker.

    own: ticker, trade_date, feature_id, value. market: trade_date, feature_id,
    value. leaders: like own, under the follower's ticker and the follower's days
    or others; only days of the ticker stay.
    """
    calendar = own.select("ticker", "trade_date").distinct()
    place = Window.partitionBy("ticker")
    calendar = calendar.withColumns({"pos": F.row_number().over(place.orderBy("trade_date")) - 1, "days": F.count("*").over(place)})
    rows = own.withColumn("role", F.lit("own"))
    if market is not None:
        rows = rows.unionByName(calendar.select("ticker", "trade_date").join(market, "trade_date").withColumn("role", F.lit("market")).select(*rows.columns))
    if leaders is not None:
        rows = rows.unionByName(leaders.withColumn("role", F.lit("leader")).select(*rows.columns))
    known = F.last("value", ignorenulls=True).over(Window.partitionBy("ticker", "role", "feature_id").orderBy("trade_date"))
    return rows.join(calendar, ["ticker", "trade_date"]).withColumn("value", known)


def research_end(days: Column, holdout: float = HOLDOUT) -> Column:
    """Positions below it belong to research, the others to the final holdout."""
    return F.floor(days * (1.0 - holdout))


def _propose(values: dict[tuple[str, str], np.ndarray], raw: dict[tuple[str, str], np.ndarray], known: np.ndarray, days: int, s: Search):
    """Rules of one ticker as (kind, [(feature, op, threshold, lag)]). Arrays run over research days; `raw` over all."""
    quantile = lambda k, q: round(float(np.nanquantile(raw[k], q)), 6)
    enough = {k for k, v in raw.items() if (~np.isnan(v)).sum() >= s.least}
    own: list[tuple[str, str]] = []
    for k in values:
        if k[0] != "own" or k not in enough:
            continue
        for j in own:
            both = ~np.isnan(raw[k]) & ~np.isnan(raw[j])
            x, y = raw[k][both], raw[j][both]
            if len(x) > 1 and x.std() > 0 and y.std() > 0 and abs(np.corrcoef(x, y)[0, 1]) >= s.correlated:
                break
        else:
            own.append(k)

    def mask(k, op, threshold, lag=0):
        v = values[k]
        if lag:
            v = np.concatenate((np.full(min(lag, len(v)), np.nan), v[:-lag]))
        with np.errstate(invalid="ignore"):
            return v > threshold if op == ">" else v < threshold

    class Kept:
        def __init__(self):
            self.rows = np.zeros((0, days), np.float32)

        def takes(self, m: np.ndarray) -> bool:
            if (m & known).sum() < s.least:
                return False
            both = self.rows @ m.astype(np.float32)
            union = self.rows.sum(axis=1) + m.sum() - both
            if ((union > 0) & (both >= s.overlap * union)).any():
                return False
            self.rows = np.vstack((self.rows, m.astype(np.float32)))
            return True

    found = Counter()
    # lead-lag rules have a total of their own
    room = lambda kind: found[kind] < (s.each or s.most) and (kind == "lead_lag" or found.total() - found["lead_lag"] < s.most)
    singles, kept = [], Kept()
    for k in own:
        for t in sorted({quantile(k, q) for q in QUANTILES}):
            for op in (">", "<"):
                if room("single") and kept.takes(m := mask(k, op, t)):
                    singles.append(((k[1], op, t, 0), m))
                    found["single"] += 1
                    yield "single", [singles[-1][0]]
    middle = [((k[1], ">", quantile(k, 0.5), 0), mask(k, ">", quantile(k, 0.5))) for k in own]
    pairs, kept = [], Kept()
    for (a, x), (b, y) in combinations(middle, 2) if s.pairs else []:
        if room("pair") and kept.takes(x & y):
            pairs.append(([a, b], x & y))
            found["pair"] += 1
            yield "pair", [a, b]
    kept = Kept()
    for conds, m in pairs if s.triples else []:
        if (m & known).sum() < s.least * s.headroom:
            continue
        for c, y in middle:
            if room("triple") and c not in conds and kept.takes(m & y):
                found["triple"] += 1
                yield "triple", [*conds, c]
    regimes = [k for k in values if k[0] == "market" and k in enough] if s.regimes else []
    for c, m in singles:
        for k in regimes:
            t = quantile(k, 0.5)
            if room("regime") and (m & mask(k, ">", t) & known).sum() >= s.least:
                found["regime"] += 1
                yield "regime", [c, (k[1], ">", t, 0)]
    for k in [k for k in values if k[0] != "own" and k in enough] if s.lead_lag else []:
        kept, t = Kept(), quantile(k, 0.5)
        for lag in LAGS:
            if room("lead_lag") and kept.takes(mask(k, ">", t, lag)):
                found["lead_lag"] += 1
                yield "lead_lag", [(k[1], ">", t, lag)]


def candidates(rows: DataFrame, targets: DataFrame, search: Search = Search(), holdout: float = HOLDOUT) -> DataFrame:
    """Condition rows of every proposed rule. rows: a `panel`; targets: ticker, trade_date, outcome.

    Thresholds come from each series as a whole, matches from research days
    only. At most `most` rules a ticker (and as many lead-lag ones), in order of
    kind and of feature name: the search's own limit. With `each`, a kind has at most so
    many, so that no kind takes the room of another."""
    s = search
    both = rows.join(targets.select("ticker", "trade_date", "outcome"), ["ticker", "trade_date"], "left")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        days = int(part["days"].iloc[0])
        end = int(np.floor(days * (1.0 - holdout)))
        out = np.full(days, np.nan)
        out[part["pos"].to_numpy()] = part["outcome"].to_numpy(float)
        raw = {}
        for key, g in part.groupby(["role", "feature_id"], sort=True):
            v = np.full(days, np.nan)
            v[g["pos"].to_numpy()] = g["value"].to_numpy(float)
            raw[key] = v
        raw = {k: raw[k] for k in sorted(raw, key=lambda k: (k[0] != "own", k))}
        ticker, found = part["ticker"].iloc[0], []
        for kind, conds in _propose({k: v[:end] for k, v in raw.items()}, raw, ~np.isnan(out[:end]), end, s):
            name = "&".join(f"{f}{op}{t:g}" + (f"@{lag}" if lag else "") for f, op, t, lag in conds)
            found += [(ticker, f"{kind}:{name}", kind, len(conds), i, f, op, t, lag) for i, (f, op, t, lag) in enumerate(conds)]
        return pd.DataFrame(found, columns=[c.split()[0] for c in CONDITIONS.split(", ")])

    return both.groupBy("ticker").applyInPandas(run, CONDITIONS)


#: Positions in one bitmap.
PAGE = 1 << 15


def condition_days(conditions: DataFrame, rows: DataFrame) -> DataFrame:
    """Bitmaps of the positions on which each condition holds: its columns, page, days and bitmap.

    conditions: distinct ticker, feature_id, op, threshold, lag. A condition with a lag reads that many positions before."""
    series = rows.select("ticker", "feature_id", F.col("pos").alias("_p"), "days", "value").where("value is not null").distinct()
    met = F.when(F.col("op") == ">", F.col("value") > F.col("threshold")).otherwise(F.col("value") < F.col("threshold"))
    hits = conditions.join(series, ["ticker", "feature_id"]).where(met).withColumn("pos", F.col("_p") + F.col("lag")).where("pos < days")
    page = F.expr(f"cast(pos div {PAGE} as int)").alias("page")
    return hits.groupBy(*conditions.columns, page).agg(F.first("days").alias("days"), F.expr(f"bitmap_construct_agg(pos % {PAGE})").alias("bitmap"))


def positions(bitmap: Column, page: Column, days: Column) -> Column:
    """The set positions of a bitmap, from its bytes that are not zero."""
    last = F.least(days - page * PAGE, F.lit(PAGE)) - 1
    byte = lambda k: F.conv(F.hex(F.substring(bitmap, k + 1, F.lit(1))), 16, 10).cast("int")
    bits = lambda k: F.filter(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.when(F.getbit(byte(k), i) == 1, page * PAGE + k * 8 + i)), lambda x: x.isNotNull())
    return F.flatten(F.transform(F.filter(F.sequence(F.lit(0), F.floor(last / 8).cast("int")), lambda k: byte(k) != 0), bits))


def matched(rules: DataFrame, rows: DataFrame, targets: DataFrame, keys: tuple[str, ...] = ("rule_id",)) -> DataFrame:
    """(ticker, keys, pos, days, outcome) of each day on which every condition of a rule holds; unknown outcomes drop.

    `keys` names a rule variant. Each distinct condition is looked up once, as a bitmap of its days; a rule is
    the conjunction of the bitmaps of its conditions, so series are never joined to rules."""
    what = ["ticker", "feature_id", "op", "threshold", "lag"]
    days = condition_days(rules.select(*what).distinct(), rows)
    both = rules.join(days, what).groupBy("ticker", *keys, "page").agg(F.count("*").alias("_n"), F.first("n_conditions").alias("_of"), F.first("days").alias("days"), F.bitmap_and_agg("bitmap").alias("_b"))
    whole = both.where("_n = _of").select("ticker", *keys, "days", F.explode(positions(F.col("_b"), F.col("page"), F.col("days").cast("int"))).alias("pos"))
    calendar = rows.select("ticker", "pos", "trade_date").distinct()
    known = calendar.join(targets.where("outcome is not null"), ["ticker", "trade_date"])
    return whole.join(known.drop("trade_date"), ["ticker", "pos"])


def clustered(found: DataFrame, block: int) -> DataFrame:
    """(ticker, rule_id, blocks, block_error): standard error of a rule's mean outcome with days of one block of
    positions taken as one draw. Outcomes of neighbouring days share most of their window, so that single days
    overstate what is known; rules that occur in one block only have no error."""
    keys = ["ticker", "rule_id"]
    each = found.groupBy(*keys, F.floor(F.col("pos") / block).alias("_b")).agg(F.count("*").alias("n"), F.sum("outcome").alias("s"))
    whole = each.groupBy(*keys).agg(F.count("*").alias("blocks"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum(F.col("s") * F.col("n")).alias("sn"), F.sum(F.col("n") * F.col("n")).alias("nn"))
    mean = F.col("s") / F.col("n")
    left = F.greatest(F.col("ss") - 2 * mean * F.col("sn") + mean * mean * F.col("nn"), F.lit(0.0))
    error = F.when(F.col("blocks") > 1, F.sqrt(left * F.col("blocks") / (F.col("blocks") - 1)) / F.col("n"))
    return whole.select(*keys, "blocks", error.alias("block_error"))


def discovered(rules: DataFrame, found: DataFrame, alpha: float = 0.05, holdout: float = HOLDOUT, pool: Column | None = None, block: int | None = None) -> DataFrame:
    """Rules with their research figures, family-corrected p-values and false-discovery control over
    all rules together, or over those of one `pool`, an expression over the ticker. With `block`, the test
    takes the days of so many positions as one draw (see `clustered`)."""
    first = rules.where("place = 0").select("ticker", "rule_id", "kind", "n_conditions", outcomes.family_key(F.concat_ws(":", "feature_id", "op"), F.col("ticker"), F.lit("target"), F.when(F.col("kind") == "regime", F.lit("r"))).alias("family"))
    first = first.withColumn("family_size", F.count("*").over(Window.partitionBy("family")))
    research = found.where(F.col("pos") < research_end(F.col("days"), holdout))
    d = outcomes.distribution(research, ["ticker", "rule_id"])
    n = F.col("sample_count")
    p = outcomes.t_test(F.col("expectancy"), F.col("stdev") * F.sqrt(n / (n - 1)), n)
    if block:
        d = d.join(clustered(research, block), ["ticker", "rule_id"])
        p = outcomes.t_test(F.col("expectancy"), F.col("block_error") * F.sqrt("blocks"), F.col("blocks"))
    d = d.join(first, ["ticker", "rule_id"]).withColumn("p", F.round(outcomes.bonferroni(F.coalesce(p, F.lit(1.0)), F.col("family_size")), 9))
    judged = outcomes.fdr_mask(d.select("p", "ticker", "rule_id", (F.lit(0) if pool is None else pool).alias("_pool")), "p", alpha, ["_pool"]).drop("p", "_pool")
    return d.join(judged, ["ticker", "rule_id"])


def walk_forward(found: DataFrame, folds: int = 4, train: int = 30, least: int = 10, holdout: float = HOLDOUT) -> DataFrame:
    """Out-of-sample figures over expanding folds of the research days, and whether the sign holds."""
    end = research_end(F.col("days"), holdout)
    r = found.where(F.col("pos") < end)
    size = F.greatest(F.lit(1), F.floor((end - train) / folds))
    fold = F.when((F.col("pos") >= train) & (end >= train + folds), F.floor((F.col("pos") - train) / size))
    r = r.withColumn("_f", F.when(fold < folds, fold))
    late = F.when(F.col("_f").isNotNull(), F.col("outcome"))
    out = r.groupBy("ticker", "rule_id").agg(F.avg("outcome").alias("research_expectancy"), F.count("_f").alias("oos_n"), F.avg(late).alias("oos_expectancy"), F.countDistinct("_f").alias("folds"))
    return out.withColumn("survived", (F.col("oos_n") >= least) & ((F.col("oos_expectancy") > 0) == (F.col("research_expectancy") > 0)))


def variants(rules: DataFrame, rows: DataFrame, deltas=DELTAS) -> DataFrame:
    """Condition rows of each rule and of its neighbours: the first threshold moved by shares of the
    series' deviation, and the first feature with another window, all named in `variant`."""
    spread = rows.where("value is not null").select("ticker", "feature_id", "pos", "value").distinct().groupBy("ticker", "feature_id").agg(F.stddev_pop("value").alias("_sd"))
    base = F.regexp_replace("feature_id", r"_\d+d$", "")
    names = rows.where("role = 'own'").select("ticker", F.col("feature_id").alias("_other")).distinct().withColumn("_base", F.regexp_replace("_other", r"_\d+d$", ""))
    head, rest = rules.where("place = 0"), rules.where("place > 0")
    moved = head.join(spread, ["ticker", "feature_id"]).where("_sd > 0").withColumn("_d", F.explode(F.array(*map(F.lit, deltas))))
    moved = moved.withColumns({"threshold": F.col("threshold") + F.col("_d") * F.col("_sd"), "variant": F.format_string("threshold%+.2f", "_d")})
    windowed = head.where((F.col("lag") == 0) & F.col("feature_id").rlike(r"_\d+d$")).withColumn("_base", base)
    sibling = windowed.join(names, ["ticker", "_base"]).where("_other <> feature_id").withColumns({"variant": F.concat(F.lit("lookback:"), "_other"), "feature_id": F.col("_other")})
    columns = [*rules.columns, "variant"]
    heads = head.withColumn("variant", F.lit("base")).select(*columns).unionByName(moved.select(*columns)).unionByName(sibling.select(*columns))
    tails = rest.join(heads.select("ticker", "rule_id", "variant"), ["ticker", "rule_id"]).select(*columns)
    return heads.unionByName(tails)


def robust(rules: DataFrame, rows: DataFrame, targets: DataFrame, other_targets: DataFrame | None = None, least: int = 10, cost_bps: float = outcomes.DEFAULT_COST, holdout: float = HOLDOUT) -> DataFrame:
    """Whether every neighbour of a rule keeps its sign, and the rule survives costs.

    other_targets: ticker, trade_date, outcome, horizon; the rule is also held
    against each of these horizons. Neighbours below `least` matches do not count;
    without any that counts a rule does not pass."""
    research = lambda d: d.where(F.col("pos") < research_end(F.col("days"), holdout))
    each = research(matched(variants(rules, rows), rows, targets, ("rule_id", "variant"))).groupBy("ticker", "rule_id", "variant").agg(F.count("*").alias("n"), F.avg("outcome").alias("e"))
    if other_targets is not None:
        days = research(matched(rules, rows, rows.select("ticker", "trade_date").distinct().withColumn("outcome", F.lit(0.0)))).drop("outcome")
        calendar = rows.select("ticker", "pos", "trade_date").distinct()
        more = days.join(calendar, ["ticker", "pos"]).join(other_targets.where("outcome is not null"), ["ticker", "trade_date"])
        each = each.unionByName(more.groupBy("ticker", "rule_id", F.concat(F.lit("horizon:"), F.col("horizon").cast("string")).alias("variant")).agg(F.count("*").alias("n"), F.avg("outcome").alias("e")))
    base = F.max(F.when(F.col("variant") == "base", F.col("e"))).over(Window.partitionBy("ticker", "rule_id"))
    each = each.withColumn("_base", base).withColumn("same", F.when((F.col("variant") != "base") & (F.col("n") >= least), (F.col("e") > 0) == (F.col("_base") > 0)))
    out = each.groupBy("ticker", "rule_id").agg(F.count("same").alias("checks"), F.count_if("same").alias("agreeing"), (F.first("_base") - cost_bps / 10_000).alias("net_expectancy"))
    return out.withColumn("robust", F.coalesce((F.col("checks") > 0) & (F.col("checks") == F.col("agreeing")) & (F.col("net_expectancy") > 0), F.lit(False)))


def beats(mean: Column, baseline: Column, cost_bps: float = outcomes.DEFAULT_COST) -> Column:
    return mean - cost_bps / 10_000 > baseline


def held_out(found: DataFrame, validated: DataFrame, least: int = 5, holdout: float = HOLDOUT) -> DataFrame:
    """The one look at the last days: enough matches there, and the sign of the validation figure."""
    late = found.where(F.col("pos") >= research_end(F.col("days"), holdout)).groupBy("ticker", "rule_id").agg(F.count("*").alias("holdout_n"), F.avg("outcome").alias("holdout_expectancy"))
    out = validated.join(late, ["ticker", "rule_id"], "left").withColumn("holdout_n", F.coalesce("holdout_n", F.lit(0)))
    return out.withColumn("passed", F.coalesce((F.col("holdout_n") >= least) & ((F.col("holdout_expectancy") > 0) == (F.col("oos_expectancy") > 0)), F.lit(False)))


def lifecycle(rules: DataFrame, rows: DataFrame, targets: DataFrame, other_targets: DataFrame | None = None, alpha: float = 0.05, folds: int = 4, train: int = 30, least_oos: int = 10, holdout: float = HOLDOUT, pool: Column | None = None, block: int | None = None) -> DataFrame:
    """Each rule's status after all gates: TESTED (not significant), REJECTED (with the gate) or VALIDATED.

    The gates in order: walk-forward, robustness, the buy-and-hold mean of the ticker plus costs,
    the holdout. Only the last one reads the last days."""
    from ..plans.stage import written

    found = written(matched(rules, rows, targets), "matched")
    d = written(discovered(rules, found, alpha, holdout, pool, block), "discovered")
    w = walk_forward(found, folds, train, least_oos, holdout)
    kept = written(rules.join(d.where("accepted").select("ticker", "rule_id"), ["ticker", "rule_id"], "left_semi"), "accepted")
    hold = targets.where("outcome is not null").groupBy("ticker").agg(F.avg("outcome").alias("baseline"))
    all_of = d.select("ticker", "rule_id", "kind", "n_conditions", "sample_count", "expectancy", "p", "accepted").join(w.drop("research_expectancy"), ["ticker", "rule_id"], "left")
    all_of = all_of.join(robust(kept, rows, targets, other_targets, holdout=holdout), ["ticker", "rule_id"], "left").join(hold, "ticker", "left")
    all_of = held_out(found, all_of, max(5, least_oos // 2), holdout)
    status = (
        F.when(~F.col("accepted"), "TESTED").when(~F.coalesce("survived", F.lit(False)), "REJECTED:walk_forward").when(~F.coalesce("robust", F.lit(False)), "REJECTED:robustness")
        .when(~F.coalesce(beats(F.col("oos_expectancy"), F.col("baseline")), F.lit(False)), "REJECTED:baseline").when(~F.col("passed"), "REJECTED:holdout").otherwise("VALIDATED")
    )
    return all_of.select("ticker", "rule_id", "kind", "n_conditions", "sample_count", "expectancy", "p", "oos_n", "oos_expectancy", "checks", "agreeing", "holdout_n", "holdout_expectancy", status.alias("status"))


def all_baselines(rows: DataFrame, sectors: DataFrame, items: DataFrame) -> DataFrame:
    """Figures of doing without a rule, per ticker: every day, days after a rise or a fall, against the mean of
    the sector on the day, days on which a year's revenue growth ends (the first traded one from then on), and over
    all tickers together (ticker `*`). rows: ticker, trade_date, outcome, past."""
    from .asof import first_after
    from .features import fundamentals

    known = rows.where("outcome is not null")
    kinds = F.array_compact(F.array(F.lit("buy_and_hold"), F.when(F.col("past") > 0, "momentum"), F.when(F.col("past") < 0, "mean_reversion")))
    each = known.select("ticker", F.explode(kinds).alias("name"), "outcome").unionByName(known.select(F.lit("*").alias("ticker"), F.lit("unconditional_market").alias("name"), "outcome"))
    own = known.join(sectors, "ticker")
    apart = F.col("outcome") - F.avg("outcome").over(Window.partitionBy("sector", "trade_date"))
    each = each.unionByName(own.select("ticker", F.lit("sector_relative").alias("name"), apart.alias("outcome")))
    grown = fundamentals(items, "revenue").where("yoy > 0").select("ticker", "period_end_date")
    first = first_after(grown, rows.select("ticker", "trade_date", F.struct("outcome").alias("o")), ["ticker"], "period_end_date", "trade_date", "o")
    each = each.unionByName(first.select("ticker", F.lit("revenue_growth").alias("name"), F.col("o.outcome").alias("outcome")).where("outcome is not null"))
    out = each.groupBy("ticker", "name").agg(F.count("*").alias("n"), F.avg("outcome").alias("mean_outcome"), F.avg((F.col("outcome") > 0).cast("double")).alias("hit_rate"), F.stddev_pop("outcome").alias("stdev"))
    return out.where("n >= 2")


# ---- panels with a known answer ------------------------------------------------------------------------------------

#: Which controls hold a planted relation, and the shares of panels that accept a suite.
CONTROLS = {"momentum": True, "mean_reversion": True, "lead_lag": True, "pure_noise": False, "shuffled_returns": False, "shuffled_timestamps": False, "shuffled_bars": False, "random_predictor": False}
RECOVERED, FALSE_RATE = 0.5, 0.4
#: Days of a panel, and of the blocks that its tests take as one draw.
LENGTH, BLOCK = 240, 10


def control_panels(bars: DataFrame, length: int = LENGTH) -> DataFrame:
    """(panel, ticker, leads, k, move): the bars dealt into panels of two tickers (three, where they are odd) and of
    `length` days or somewhat more; the ticker with the larger volume leads. k numbers the days of a panel from 0;
    move is the ticker's own logarithmic return there, centred and scaled to a deviation of 0.8 %."""
    line = Window.partitionBy("ticker").orderBy("trade_date")
    slices = F.greatest(F.lit(1), F.floor(F.count("*").over(Window.partitionBy("ticker")) / length))
    rows = bars.withColumns({"_at": F.row_number().over(line) - 1, "_of": slices, "_r": F.log(F.col("close") / F.lag("close").over(line))})
    rows = rows.withColumn("_slice", F.least(F.floor(F.col("_at") / length), F.col("_of") - 1))
    every = Window.orderBy("ticker").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    names = bars.groupBy("ticker").agg(F.sum("volume").alias("_volume"))
    pair = F.least(F.floor((F.row_number().over(Window.orderBy("ticker")) - 1) / 2), F.greatest(F.floor(F.count("*").over(every) / 2) - 1, F.lit(0)))
    names = names.withColumn("_pair", pair)
    names = names.withColumn("leads", F.row_number().over(Window.partitionBy("_pair").orderBy(F.desc("_volume"), "ticker")) == 1)
    rows = rows.join(names, "ticker")
    own = Window.partitionBy("ticker", "_slice")
    spread = F.stddev_pop("_r").over(own)
    move = F.coalesce(F.when(spread > 0, (F.col("_r") - F.avg("_r").over(own)) / spread * 0.008), F.lit(0.0))
    return rows.select(F.concat_ws("/", "_pair", "_slice").alias("panel"), "ticker", "leads", (F.col("_at") - F.col("_slice") * length).alias("k"), move.alias("move"))


def control_bars(bars: DataFrame, length: int = LENGTH) -> DataFrame:
    """Bars (ticker, trade_date, close, adj, high, low) of every control on every panel; ticker is
    `control|panel|ticker|L or F`. Draws are hashes of panel, ticker, control and day: the same on any cluster.

    Planted: blocks of rising and falling days, one alternating by day, a follower that repeats its leader's
    move of three days before. Shuffled: the block series by days or by pairs of days, the table's own moves
    by days. The others are independent draws."""
    base = control_panels(bars, length)

    def draw(name: str, k: Column, who: Column) -> Column:
        u = lambda salt: (F.pmod(F.xxhash64(F.lit(salt), F.lit(name), "panel", who, k), F.lit(1 << 40)) + 0.5) / float(1 << 40)
        return F.sqrt(-2 * F.log(u("radius"))) * F.cos(2 * np.pi * u("angle"))

    def blocks(name: str, size: int, drift: float, noise: float, k: Column | None = None, who: Column | None = None) -> Column:
        k = F.col("k") if k is None else k
        return F.when(F.floor(k / size) % 2 == 0, drift).otherwise(-drift) + noise * draw(name, k, F.col("ticker") if who is None else who)

    either = lambda lead, follow: F.when(F.col("leads"), lead).otherwise(follow)
    noise = lambda name: 0.008 * draw(name, F.col("k"), F.col("ticker"))
    lead = lambda k: blocks("lead_lag", 10, 0.012, 0.0003, k, F.lit("leader"))
    trend = lambda name: either(blocks(name, 10, 0.010, 0.0005), blocks(name, 13, 0.008, 0.0006))
    moves = {
        "momentum": trend("momentum"), "mean_reversion": either(blocks("mean_reversion", 1, 0.010, 0.0005), blocks("mean_reversion", 1, 0.008, 0.0006)),
        "lead_lag": either(lead(F.col("k")), F.when(F.col("k") >= 3, lead(F.col("k") - 3)).otherwise(0.0) + 0.00005 * draw("lead_lag", F.col("k"), F.col("ticker"))),
        "pure_noise": noise("pure_noise"), "shuffled_returns": trend("shuffled_returns"), "shuffled_timestamps": trend("shuffled_timestamps"), "shuffled_bars": F.col("move"), "random_predictor": noise("random_predictor"),
    }
    rows = base.select("panel", "ticker", "leads", "k", F.explode(F.array(*[F.struct(F.lit(n).alias("control"), m.alias("move")) for n, m in moves.items()])).alias("_m")).select("panel", "ticker", "leads", "k", "_m.*")
    piece = F.when(F.col("control").isin("shuffled_returns", "shuffled_bars"), F.col("k")).when(F.col("control") == "shuffled_timestamps", F.floor(F.col("k") / 2))
    order = F.when(piece.isNotNull(), F.xxhash64("control", "panel", "ticker", piece))
    series = Window.partitionBy("control", "panel", "ticker")
    rows = rows.withColumn("day", F.row_number().over(series.orderBy(order, "k")) - 1)
    step = F.when(F.col("day") > 0, F.log1p("move")).otherwise(0.0)
    rows = rows.withColumn("close", 100 * F.exp(F.sum(step).over(series.orderBy("day"))))
    name = F.concat_ws("|", "control", "panel", "ticker", F.when(F.col("leads"), "L").otherwise("F"))
    return rows.select(name.alias("ticker"), F.date_add(F.lit("2020-01-01").cast("date"), F.col("day").cast("int")).alias("trade_date"), "close", F.col("close").alias("adj"), (F.col("close") * 1.002).alias("high"), (F.col("close") * 0.998).alias("low"))


def control_suite(bars: DataFrame, length: int = LENGTH) -> DataFrame:
    """(control, panel, tested, validated, rate, accepted): every control of every panel goes through the whole search
    in one job, each its own pool of tests. Followers also see the series of their leader."""
    from . import features, targets
    from ..plans.stage import written

    names = [f"return_{n}d" for n in (1, 3, 5, 10)] + ["volatility_10d", "distance_high_10d"]
    wide = features.price_features(control_bars(bars, length), (1, 3, 5, 10)).withColumn("outcome", targets.forward(5)).select("ticker", "trade_date", "outcome", *names)
    wide = written(wide, "controls")
    own = wide.unpivot(["ticker", "trade_date"], names, "feature_id", "value")
    pool = F.substring_index("ticker", "|", 2)
    follows = wide.where(F.col("ticker").endswith("|F")).select(pool.alias("_pool"), F.col("ticker").alias("_ticker")).distinct()
    lead = own.where(F.col("ticker").endswith("|L") & F.col("feature_id").isin("return_1d", "return_5d")).withColumn("_pool", pool).join(follows, "_pool")
    lead = lead.select(F.col("_ticker").alias("ticker"), "trade_date", F.concat(F.lit("leader_"), "feature_id").alias("feature_id"), "value")
    rows, goal = written(panel(own, leaders=lead), "panel"), wide.select("ticker", "trade_date", "outcome")
    across = F.substring_index("ticker", "|", 1).isin("lead_lag", "random_predictor")
    alone = Search(least=15, most=40, triples=False, regimes=False)
    led = Search(least=15, correlated=0.999, most=60, pairs=False, triples=False, regimes=False)
    rules = written(candidates(rows.where(~across), goal, alone).unionByName(candidates(rows.where(across), goal, led)), "rules")
    out = lifecycle(rules, rows, goal, alpha=0.10, folds=3, train=40, least_oos=8, pool=pool, block=BLOCK)
    each = F.split("ticker", r"\|")
    counts = out.groupBy(each[0].alias("control"), each[1].alias("panel")).agg(F.count("*").alias("tested"), F.count_if(F.col("status") == "VALIDATED").alias("validated"))
    # a panel without any rule to test counts as one in which nothing was found
    panels = wide.select(each[0].alias("control"), each[1].alias("panel")).distinct()
    counts = written(panels.join(counts, ["control", "panel"], "left").fillna(0, ["tested", "validated"]), "counts")
    return counts.join(accepted_suite(counts).drop("panels"), "control")


def accepted_suite(results: DataFrame) -> DataFrame:
    """results: control, panel, validated. A planted relation must be found on more than half of the panels,
    none may be found on more than two in five of the others."""
    positive = F.col("control").isin(*[n for n, planted in CONTROLS.items() if planted])
    rate = results.groupBy("control").agg(F.count("*").alias("panels"), F.avg((F.col("validated") > 0).cast("double")).alias("rate"))
    return rate.withColumn("accepted", F.when(positive, F.col("rate") > RECOVERED).otherwise(F.col("rate") <= FALSE_RATE))
