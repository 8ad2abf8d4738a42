"""Rule search and its gates against plain loops over dates."""

import datetime
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import mining

DAY0 = datetime.date(2020, 1, 1)


@pytest.fixture(scope="module")
def small(spark):
    rng = np.random.default_rng(5)
    days, own, market, target = 120, [], [], []
    for t in ("A", "B"):
        base = rng.normal(0, 1, days)
        series = {"f_5d": base, "f_20d": base * 0.2 + rng.normal(0, 1, days), "g": rng.normal(0, 1, days), "twin": base * 2 + 0.001}
        series["g"][::17] = np.nan
        for name, v in series.items():
            own += [(t, DAY0 + datetime.timedelta(days=i), name, None if np.isnan(x) else float(x)) for i, x in enumerate(v)]
        target += [(t, DAY0 + datetime.timedelta(days=i), float(0.02 * base[i] + rng.normal(0, 0.01)) if i < days - 5 else None) for i in range(days)]
    m = rng.normal(0, 1, days)
    market = [(DAY0 + datetime.timedelta(days=i), "breadth", float(x)) for i, x in enumerate(m)]
    own_df = spark.createDataFrame(own, "ticker string, trade_date date, feature_id string, value double")
    rows = mining.panel(own_df, spark.createDataFrame(market, "trade_date date, feature_id string, value double"))
    targets = spark.createDataFrame(target, "ticker string, trade_date date, outcome double")
    return rows, targets


def by_hand(rows, targets, s, holdout):
    """All rules by sets of positions."""
    r = rows.toPandas()
    t = targets.toPandas()
    out = {}
    for ticker, part in r.groupby("ticker"):
        days = int(part["days"].iloc[0])
        end = int(days * (1 - holdout))
        dates = dict(zip(part["trade_date"], part["pos"]))
        known = {dates[d] for d, o in zip(t[t.ticker == ticker].trade_date, t[t.ticker == ticker].outcome) if o is not None and o == o and dates[d] < end}
        series = {(role, f): dict(zip(g["pos"], g["value"])) for (role, f), g in part.groupby(["role", "feature_id"])}
        names = sorted(k for k in series if k[0] == "own")
        value = lambda k, i: series[k].get(i, float("nan"))
        kept = []
        for k in names:
            x = np.array([value(k, i) for i in range(days)])
            if all(abs(np.corrcoef(*np.array([(a, b) for a, b in zip(x, [value(j, i) for i in range(days)]) if a == a and b == b]).T)[0, 1]) < s.correlated for j in kept):
                kept.append(k)
        q = lambda k, p: round(float(np.quantile([v for v in series[k].values() if v == v], p)), 6)
        when = lambda k, op, th, lag=0: {i for i in range(end) if i - lag >= 0 and (value(k, i - lag) > th if op == ">" else value(k, i - lag) < th)}
        found = []
        room = lambda kind: len(found) < s.most and sum(k == kind for k, _ in found) < (s.each or s.most)

        def takes(pool, m):
            if len(m & known) < s.least or any(len(m & o) >= s.overlap * len(m | o) for o in pool):
                return False
            pool.append(m)
            return True

        pool, singles = [], []
        for k in kept:
            for th in sorted({q(k, p) for p in mining.QUANTILES}):
                for op in "><":
                    m = when(k, op, th)
                    if room("single") and takes(pool, m):
                        singles.append(([(k[1], op, th, 0)], m))
                        found.append(("single", singles[-1][0]))
        med = [((k[1], ">", q(k, 0.5), 0), when(k, ">", q(k, 0.5))) for k in kept]
        pool, pairs = [], []
        for (a, x), (b, y) in combinations(med, 2):
            if room("pair") and takes(pool, x & y):
                pairs.append(([a, b], x & y))
                found.append(("pair", [a, b]))
        pool = []
        for conds, m in pairs:
            for c, y in med:
                if room("triple") and c not in conds and len(m & known) >= s.least * s.headroom and takes(pool, m & y):
                    found.append(("triple", [*conds, c]))
        for conds, m in singles:
            c = ("breadth", ">", q(("market", "breadth"), 0.5), 0)
            if room("regime") and len(m & known & when(("market", "breadth"), ">", c[2])) >= s.least:
                found.append(("regime", [*conds, c]))
        pool = []
        for lag in mining.LAGS:
            m = when(("market", "breadth"), ">", q(("market", "breadth"), 0.5), lag)
            if sum(k == "lead_lag" for k, _ in found) < (s.each or s.most) and takes(pool, m):
                found.append(("lead_lag", [("breadth", ">", q(("market", "breadth"), 0.5), lag)]))
        out[ticker] = found
    return out


@pytest.mark.parametrize("most, each", [(500, None), (7, None), (500, 4)])
def test_candidates_equal_plain_sets(small, most, each):
    rows, targets = small
    s = mining.Search(least=10, most=most, each=each)
    got: dict = {}
    for r in sorted(mining.candidates(rows, targets, s).collect(), key=lambda r: r["place"]):
        got.setdefault(r["ticker"], {}).setdefault((r["kind"], r["rule_id"]), []).append((r["feature_id"], r["op"], r["threshold"], r["lag"]))
    for ticker, found in by_hand(rows, targets, s, mining.HOLDOUT).items():
        assert sorted((k, sorted(c)) for (k, _), c in got[ticker].items()) == sorted((k, sorted(c)) for k, c in found)
    if most == 500 and not each:
        assert {k for t in got.values() for k, _ in t} == {"single", "pair", "triple", "regime", "lead_lag"}


def test_matches_gates_and_variants(spark, small):
    rows, targets = small
    rules = spark.createDataFrame(
        [("A", "r1", "single", 1, 0, "f_5d", ">", 0.2, 0), ("A", "r2", "pair", 2, 0, "f_5d", ">", 0.0, 0), ("A", "r2", "pair", 2, 1, "g", "<", 0.0, 0), ("B", "r3", "lead_lag", 1, 0, "breadth", ">", 0.0, 3)], mining.CONDITIONS
    )
    p, t = rows.toPandas(), targets.toPandas()
    value = {(r.ticker, r.feature_id, r.pos): r.value for r in p.itertuples()}
    at = {(r.ticker, r.trade_date): r.pos for r in p.itertuples()}
    outcome = {(r.ticker, at[(r.ticker, r.trade_date)]): r.outcome for r in t.itertuples() if r.outcome == r.outcome}

    def days(rid, tests):
        ticker = "B" if rid == "r3" else "A"
        return {i for i in range(120) if (ticker, i) in outcome and all((v := value.get((ticker, f, i - lag))) is not None and v == v and (v > th if op == ">" else v < th) for f, op, th, lag in tests)}

    tests = {"r1": [("f_5d", ">", 0.2, 0)], "r2": [("f_5d", ">", 0.0, 0), ("g", "<", 0.0, 0)], "r3": [("breadth", ">", 0.0, 3)]}
    found = mining.matched(rules, rows, targets)
    got: dict = {}
    for r in found.collect():
        got.setdefault(r["rule_id"], {})[r["pos"]] = r["outcome"]
        assert r["outcome"] == outcome[(r["ticker"], r["pos"])]
    assert {k: set(v) for k, v in got.items()} == {k: days(k, v) for k, v in tests.items()}

    end = int(120 * 0.85)
    sd = np.std([value[("A", "f_5d", i)] for i in range(120)])
    for r in mining.robust(rules, rows, targets, targets.withColumn("horizon", F.lit(7))).collect():
        ticker, base = r["ticker"], tests[r["rule_id"]]
        mean = lambda s: np.mean([outcome[(ticker, i)] for i in s if i < end]) if any(i < end for i in s) else None  # noqa: E731, B023
        b = mean(days(r["rule_id"], base))
        first = base[0]
        spread = sd if first[0] == "f_5d" else np.std([value[("B", "breadth", i)] for i in range(120)])
        others = [days(r["rule_id"], [(first[0], first[1], first[2] + d * spread, first[3]), *base[1:]]) for d in mining.DELTAS]
        others += [days(r["rule_id"], [("f_20d", *first[1:]), *base[1:]])] * (first[0] == "f_5d") + [days(r["rule_id"], base)]
        counted = [s for s in others if sum(i < end for i in s) >= 10]
        assert r["checks"] == len(counted) and r["agreeing"] == sum((mean(s) > 0) == (b > 0) for s in counted)
        assert r["net_expectancy"] == pytest.approx(b - 0.002)

    wf = {r["rule_id"]: r for r in mining.walk_forward(found).collect()}
    for rid, v in got.items():
        size = max(1, (end - 30) // 4)
        late = [o for i, o in v.items() if 30 <= i < end and (i - 30) // size < 4]
        assert wf[rid]["oos_n"] == len(late) and wf[rid]["oos_expectancy"] == pytest.approx(np.mean(late))
        assert wf[rid]["survived"] == (len(late) >= 10 and (np.mean(late) > 0) == (np.mean([o for i, o in v.items() if i < end]) > 0))
    for r in mining.held_out(found, mining.walk_forward(found)).collect():
        late = [o for i, o in got[r["rule_id"]].items() if i >= end]
        assert r["holdout_n"] == len(late) and r["passed"] == (len(late) >= 5 and (np.mean(late) > 0) == (r["oos_expectancy"] > 0))


def test_planted_relation_is_validated_and_empty_input_gives_none(spark, small):
    rows, targets = small
    rules = mining.candidates(rows, targets, mining.Search(least=10))
    out = mining.lifecycle(rules, rows, targets).toPandas()
    assert len(out) and set(out["status"].str.split(":").str[0]) <= {"TESTED", "REJECTED", "VALIDATED"}
    strong = out[out["rule_id"].str.startswith("single:f_5d>")]
    assert (strong["status"] != "TESTED").sum() >= 3
    assert mining.candidates(rows.where("false"), targets).count() == 0


def test_suite_rates(spark):
    r = spark.createDataFrame([("momentum", "0", 3), ("momentum", "1", 0), ("lead_lag", "0", 1), ("pure_noise", "0", 0), ("pure_noise", "1", 1), ("random_predictor", "0", 0)], "control string, panel string, validated long")
    assert {x["control"]: x["accepted"] for x in mining.accepted_suite(r).collect()} == {"momentum": False, "lead_lag": True, "pure_noise": False, "random_predictor": True}


@pytest.fixture(scope="module")
def three(spark):
    """Bars of three tickers: 61, 130 and 70 days; C trades most."""
    rng = np.random.default_rng(3)
    rows = [(t, DAY0 + datetime.timedelta(days=i), float(50 + rng.random()), v) for t, n, v in (("A", 61, 10), ("B", 130, 40), ("C", 70, 90)) for i in range(n)]
    return spark.createDataFrame(rows, "ticker string, trade_date date, close double, volume long")


def test_control_panels_deal_every_day_once(three):
    p = mining.control_panels(three, 60).toPandas()
    assert len(p) == 61 + 130 + 70
    # an odd ticker joins the last pair; a rest shorter than a panel joins the one before
    sizes = p.groupby(["panel", "ticker"]).k.agg(["count", "max"])
    assert {k: tuple(v) for k, v in sizes.T.items()} == {("0/0", "A"): (61, 60), ("0/0", "B"): (60, 59), ("0/1", "B"): (70, 69), ("0/0", "C"): (70, 69)}
    assert set(p[p.leads].ticker) == {"C"}
    # own moves: centred returns of the panel's days, 0.8 % deviation
    closes = np.array([r.close for r in three.where("ticker = 'A'").orderBy("trade_date").collect()])
    x = np.diff(np.log(closes))
    assert p[p.ticker == "A"].sort_values("k").move.to_numpy() == pytest.approx(np.concatenate(([0.0], (x - x.mean()) / x.std() * 0.008)))


def test_control_bars_hold_what_they_plant(three):
    b = mining.control_bars(three, 60).toPandas()
    assert len(b) == 261 * len(mining.CONTROLS) and not b.duplicated(["ticker", "trade_date"]).any() and (b.close > 0).all()
    b["day"] = [(d - DAY0).days for d in b.trade_date]
    moves = {name: g.sort_values("day").close.pct_change().to_numpy()[1:] for name, g in b.groupby("ticker")}
    lead, follow = moves["lead_lag|0/0|C|L"], moves["lead_lag|0/0|A|F"]
    assert np.abs(follow[3:60] - lead[:57]).max() < 0.001
    reversal = moves["mean_reversion|0/1|B|F"]
    assert (np.sign(reversal[1:]) == -np.sign(reversal[:-1])).all()
    trend = moves["momentum|0/0|C|L"]
    assert [np.sign(trend[k - 1]) for k in range(1, 70)] == [1 if k // 10 % 2 == 0 else -1 for k in range(1, 70)]
    p = mining.control_panels(three, 60).toPandas()
    own = np.sort(p[(p.ticker == "B") & (p.panel == "0/1")].move)
    shuffled = np.sort(moves["shuffled_bars|0/1|B|F"])
    assert len(own) == len(shuffled) + 1 and all(np.abs(own - m).min() < 1e-9 for m in shuffled)  # the first day's move starts the series
    assert (np.diff(np.sign(moves["shuffled_timestamps|0/0|C|L"])) != 0).sum() > 10 > (np.diff(np.sign(trend)) != 0).sum()
    assert mining.control_bars(three.where("false"), 60).count() == 0
    again = mining.control_bars(three.repartition(5), 60).toPandas()
    assert again.sort_values(["ticker", "trade_date"]).close.to_numpy() == pytest.approx(b.sort_values(["ticker", "trade_date"]).close.to_numpy())


def test_clustered_errors(spark):
    rng = np.random.default_rng(8)
    rows = [("A", r, int(p), float(rng.normal(0.1, 1))) for r in ("x", "y") for p in sorted(rng.choice(90, 40, replace=False))] + [("A", "one", p, 1.0) for p in range(4)]
    got = {r.rule_id: r for r in mining.clustered(spark.createDataFrame(rows, "ticker string, rule_id string, pos int, outcome double"), 7).collect()}
    for rule in ("x", "y"):
        mine = [(p // 7, o) for _, r, p, o in rows if r == rule]
        mean, names = np.mean([o for _, o in mine]), sorted({b for b, _ in mine})
        left = sum(sum(o - mean for c, o in mine if c == b) ** 2 for b in names)
        assert got[rule].blocks == len(names) and got[rule].block_error == pytest.approx(np.sqrt(left * len(names) / (len(names) - 1)) / len(mine))
    assert got["one"].blocks == 1 and got["one"].block_error is None


def test_suite_accepts_itself(spark):
    """The planted relations are found, hardly anything else is: on four tickers of the table."""
    from tidemark.queries.market import plain

    names = [f"Brand#{i}" for i in (11, 12, 13, 14)]
    out = mining.control_suite(plain(spark, "/root/testdata/sf0.001").where(F.col("ticker").isin(names)), 150).toPandas()
    assert set(out.control) == set(mining.CONTROLS) and out.groupby("control").panel.nunique().min() >= 2
    verdict = out.groupby("control").agg(rate=("rate", "first"), accepted=("accepted", "first"))
    assert verdict.accepted.all(), verdict
    hits = out.assign(hit=out.validated > 0).groupby("control").hit.mean()
    assert hits.to_dict() == pytest.approx(verdict.rate.to_dict())


def test_positions_of_pages(spark):
    """Bitmaps over several pages give back every position."""
    wanted = [0, 1, 7, 8, 63, 32767, 32768, 40000, 65535, 65536, 70000]
    rows = spark.createDataFrame([("A", "f", "own", p, 70001, 1.0) for p in wanted] + [("A", "f", "own", 5, 70001, -1.0)], "ticker string, feature_id string, role string, pos int, days int, value double")
    conditions = spark.createDataFrame([("A", "f", ">", 0.0, 0)], "ticker string, feature_id string, op string, threshold double, lag int")
    days = mining.condition_days(conditions, rows)
    got = days.select(F.explode(mining.positions(F.col("bitmap"), F.col("page"), F.col("days"))).alias("pos"))
    assert sorted(r.pos for r in got.collect()) == wanted
