"""Hand-computed cases."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import stats, text
from tidemark.operators import adjust, asof, decisions, events, features, graph, market, outcomes, quality, rules, storage, targets, valuation
from tidemark.sources import parsers
from tidemark.streaming import events as streams
from tidemark.streaming import fund

D = dt.date


def day(n):
    return D(2024, 1, 1) + dt.timedelta(days=n)


def bars(spark, closes, ticker="A", volume=None, spread=0.0):
    rows = [(ticker, day(k), float(c), c * (1 + spread), c * (1 - spread), float(c), int(volume[k] if volume else 100)) for k, c in enumerate(closes)]
    return features.with_adjusted(spark.createDataFrame(rows, "ticker string, trade_date date, open double, high double, low double, close double, volume long"))


def column(df, name, order="trade_date"):
    return [r[name] for r in df.orderBy(order).select(order, name).collect()]


def test_returns_and_windows(spark):
    f = features.price_features(bars(spark, [10, 11, 12.1, 0, 5]), (1, 3))
    assert column(f, "return_1d") == pytest.approx([None, 0.1, 0.1, -1.0, None]) and column(f, "return_3d") == pytest.approx([None, None, None, -1.0, (5 - 11) / 11])
    assert column(f, "volatility_3d") == pytest.approx([None, None, None, np.std([0.1, 0.1, -1.0]), None])
    assert column(f, "distance_high_3d")[:3] == [None, None, 0.0]


def test_relative_volume_excludes_today(spark):
    f = features.volume_features(bars(spark, [1, 2, 3, 4], volume=[100, 200, 300, 900]), (2,))
    assert column(f, "relative_volume_2d") == [None, None, 2.0, 3.6]


def test_mid_rank(spark):
    row = spark.createDataFrame([(2.0, [1.0, 2.0, 2.0, 3.0]), (2.0, []), (None, [1.0])], "x double, p array<double>").select(stats.mid_rank(F.col("x"), F.col("p")).alias("m"))
    assert [r.m for r in row.collect()] == [0.5, 0.5, None]


def test_flat_series_have_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, 4.0)], "x double, y double")
    assert df.agg(stats.pearson(F.col("x"), F.col("y")).alias("r")).first().r is None


def test_split_halves_prior_closes(spark):
    b = bars(spark, [10, 20, 12]).drop("adj")
    e = spark.createDataFrame([("A", day(2), 2.0, None)], "ticker string, event_date date, split_ratio double, dividend_amount double")
    assert column(adjust.split_adjusted(b, e), "adj") == [5.0, 10.0, 12.0] == column(adjust.adjusted(b, e), "adj")


def test_dividend_uses_the_adjusted_close_before_it(spark):
    b = bars(spark, [10, 20, 12, 12]).drop("adj")
    e = spark.createDataFrame([("A", day(1), None, 1.0), ("A", day(3), 2.0, None)], "ticker string, event_date date, split_ratio double, dividend_amount double")
    assert column(adjust.adjusted(b, e), "adj") == pytest.approx([10 / 2 * (5 - 1) / 5, 10.0, 6.0, 12.0])


def test_barriers(spark):
    f = bars(spark, [100, 106, 90, 100, 100]).withColumn("b", targets.triple_barrier(None, 0.05, -0.03, 2))
    assert column(f, "b") == [1.0, -1.0, 1.0, 0.0, None]
    wide = bars(spark, [100, 100, 100], spread=0.1).withColumn("b", targets.triple_barrier(None, 0.05, -0.03, 2))
    assert column(wide, "b") == [0.0, 0.0, None]


def test_drawdown_starts_from_the_entry(spark):
    assert column(targets.forward_targets(bars(spark, [100, 90, 120, 60]), (3,)), "max_drawdown_3d") == [pytest.approx(-0.5), None, None, None]


def test_no_leakage_into_features(spark):
    rng = random.Random(1)
    closes = [100 * (1 + rng.uniform(-0.05, 0.05)) for _ in range(80)]
    names = ["return_5d", "volatility_5d", "distance_high_5d"]
    a = features.price_features(bars(spark, closes), (5,)).orderBy("trade_date").select(*names).limit(60).collect()
    b = features.price_features(bars(spark, closes[:60] + [1.0] * 20), (5,)).orderBy("trade_date").select(*names).limit(60).collect()
    assert a == b


def test_as_of_joins(spark):
    left = spark.createDataFrame([("k", day(n)) for n in (0, 2, 3, 9)], "k string, t date")
    right = spark.createDataFrame([("k", day(1), 1.0), ("k", day(2), None), ("k", day(3), 3.0)], "k string, u date, v double")
    assert column(asof.as_of(left, right, ["k"], "t", "u", "v"), "v", "t") == [None, 1.0, 3.0, 3.0]
    assert column(asof.as_of_row(left, right, ["k"], "t", "u", "v"), "v", "t") == [None, None, 3.0, 3.0]
    assert column(asof.lagged_as_of(left, right, ["k"], "t", "u", "v", 1), "v", "t") == [None, 1.0, None, None]
    assert column(asof.first_after(left, right, ["k"], "t", "u", "v"), "v", "t") == [1.0, 3.0, 3.0, None]


@pytest.mark.parametrize("days", [0, 1, 3])
def test_near_matches_all_distances(spark, days):
    rng = random.Random(days)
    a, b = sorted({rng.randrange(200) for _ in range(40)}), sorted({rng.randrange(200) for _ in range(15)})
    left, right = spark.createDataFrame([("k", day(x)) for x in a], "k string, t date"), spark.createDataFrame([("k", day(x)) for x in b], "k string, u date")
    hit = {day(x) for x in a if any(abs(x - y) <= days for y in b)}
    assert {r.t for r in asof.near(left, right, "k", "t", "u", days).collect()} == hit
    assert {r.t for r in asof.near(left, right, "k", "t", "u", days, "left_anti").collect()} == {day(x) for x in a} - hit


def test_upsert_and_history(spark):
    prior = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "id int, x string, y double")
    new = spark.createDataFrame([(2, "B"), (3, "c")], "id int, x string")
    gone = spark.createDataFrame([(1,)], "id int")
    assert sorted(map(tuple, storage.upsert(prior, new, ["id"]).collect())) == [(1, "a", 1.0), (2, "B", None), (3, "c", None)]
    assert sorted(r.id for r in storage.upsert(prior, new, ["id"], gone).collect()) == [2, 3]
    again = storage.upsert(storage.upsert(prior, new, ["id"]), new, ["id"])
    assert sorted(map(tuple, again.collect())) == [(1, "a", 1.0), (2, "B", None), (3, "c", None)]


def test_quality_rules(spark):
    rows = [("A", day(0), 1.0, 2.0, 1.0, 1.5, 10, 0), ("A", day(0), 1.0, 2.0, 1.0, 1.5, 0, 1), ("A", day(2), 3.0, 2.0, 2.5, 3.0, -1, 2), ("A", day(1), 3.0, 3.0, 3.0, 3.0, 5, 3)]
    b = spark.createDataFrame(rows, "ticker string, trade_date date, open double, high double, low double, close double, volume long, seq int")
    got = {(r.trade_date, r.rule) for r in quality.bar_issues(b, "seq").collect()}
    assert got == {(day(0), "duplicate_date"), (day(0), "zero_volume"), (day(2), "high_below_low"), (day(2), "high_below_body"), (day(2), "negative_volume"), (day(2), "extreme_move"), (day(1), "out_of_order")}


def test_trading_calendar(spark):
    days = spark.createDataFrame([(D(2026, 1, 7),), (D(2026, 1, 8),), (D(2026, 1, 9),), (D(2026, 1, 10),), (D(2026, 1, 11),)], "d date")
    assert [r.t for r in days.select("d", quality.trading_day("d").alias("t")).orderBy("d").collect()] == [False, True, False, False, True]


def report(source, confidence=0.6, action=None, **meta):
    return {"source": source, "confidence": confidence, "metadata": meta, "action": action}


def test_register_rules():
    s = events.merge_report(None, report("a", x="1"))
    assert s["status"] == "CONFIRMED" and events.merge_report(s, report("a", x="2")) == s
    two = events.merge_report(s, report("b", x="1", y="2"))
    assert two["status"] == "CORROBORATED" and two["confidence"] == pytest.approx(0.8) and two["metadata"] == {"x": "1", "y": "2"}
    clash = events.merge_report(s, report("b", 0.5, x="9"))
    assert clash["status"] == "DISPUTED" and clash["confidence"] == pytest.approx(0.3) and clash["disputed"] == ["x"] and clash["metadata"]["x"] == "1"
    ended = events.merge_report(two, report("c", action="RETRACTED"))
    assert ended["status"] == "RETRACTED" and events.merge_report(ended, report("d", x="1")) == ended


def test_stream_register_equals_batch(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"e{rng.randrange(6)}", k, f"s{rng.randrange(3)}", 0.5, {"k": str(rng.randrange(2))}, "RETRACTED" if k % 29 == 28 else None) for k in range(60)]
    df = spark.createDataFrame(rows, streams.REPORT)
    for k in range(3):
        df.where(f"seq >= {k * 20} and seq < {k * 20 + 20}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(streams.REPORT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streams.register_stream(source).writeStream.format("memory").queryName("register").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    last = {}
    for r in spark.sql("select * from register").collect():
        if r.event_id not in last or r.version > last[r.event_id].version:
            last[r.event_id] = r
    batch = {r.event_id: r for r in events.register(df).collect()}
    assert {k: (r.status, r.version, r.metadata) for k, r in last.items()} == {k: (r.status, r.version, r.metadata) for k, r in batch.items()}


def test_stream_windows_with_watermark(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").write.parquet(str(tmp_path / "in"))
    source = streams.timed(spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in")), "ts")
    out = streams.windowed(source, "ts", ["event_type"], {"n": F.count("*")}, "1 day")
    q = out.writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(n) as n from windows").first().n == spark.read.parquet(str(tmp_path / "in")).count()


def test_stream_upsert_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id int, x string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    streams.upsert_batches(source, str(tmp_path / "out"), ["id"], str(tmp_path / "cp")).awaitTermination()
    df.withColumn("x", F.upper("x")).where("id = 2").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    streams.upsert_batches(source, str(tmp_path / "out"), ["id"], str(tmp_path / "cp")).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out/v=1")).collect())) == [(1, "a"), (2, "B")]


def test_fund_day():
    s, row = fund.advance(None, {"A": 10.0}, {"A": 0.5})
    assert row["turnover"] == 0.5 and row["costs"] == pytest.approx(0.0005) and row["nav"] == pytest.approx(0.9995)
    s, row = fund.advance(s, {"A": 10.05}, {"A": 0.5})
    assert row["turnover"] == 0  # within the band
    s, row = fund.advance(s, {"A": 5.0}, {})
    assert row["positions"] == 0 and row["cash"] == pytest.approx(row["nav"]) and row["drawdown"] < -0.2


def test_fdr(spark):
    p = spark.createDataFrame([(k, x) for k, x in enumerate([0.001, 0.008, 0.039, 0.041, 0.042, 0.06, 0.074, 0.205])], "k int, p double")
    got = outcomes.fdr_mask(p, "p", 0.05).orderBy("k").collect()
    assert [r.accepted for r in got] == [True, True, False, False, False, False, False, False]
    assert got[2].q_value == pytest.approx(0.042 * 8 / 5)


def test_distribution_and_stability(spark):
    x = [0.1, -0.05, 0.2, -0.1, 0.05, 0.0, 0.1, 0.1]
    df = spark.createDataFrame([("r", day(k), v) for k, v in enumerate(x)], "k string, trade_date date, outcome double")
    r = outcomes.distribution(df, ["k"]).first()
    assert r.hit_rate == 5 / 8 and r.profit_factor == pytest.approx(0.55 / 0.15) and r.downside_deviation == pytest.approx(np.sqrt(np.mean(np.minimum(x, 0) ** 2)))
    assert outcomes.stability(df, ["k"], "trade_date").first().stability == 1.0


def test_seeded_tests_find_signal_only():
    rng = random.Random(0)
    drift, noise = [0.02 + rng.gauss(0, 0.01) for _ in range(120)], [rng.gauss(0, 0.01) for _ in range(120)]
    assert outcomes.block_bootstrap_p(drift) < 0.01 < 0.05 < outcomes.block_bootstrap_p([x - np.mean(noise) for x in noise])
    assert outcomes.bootstrap_interval(drift)[0] > 0 and outcomes.deflated_sharpe(drift, 10) > 0.9 > outcomes.deflated_sharpe(noise, 10)
    assert outcomes.block_bootstrap_p(drift) == outcomes.block_bootstrap_p(drift) and outcomes.block_bootstrap_p([1.0]) == 1.0
    assert outcomes.t_test_p(0.5, 1, 20) == pytest.approx(0.03754, abs=1e-5)


def test_walk_forward_and_purge(spark):
    df = spark.createDataFrame([("r", day(k), 0.01, True) for k in range(50)], "k string, trade_date date, outcome double, hit boolean")
    r = outcomes.walk_forward(df, "k", "trade_date", "outcome", "hit").first()
    assert (r.n, r.oos_n, r.folds, r.survived) == (50, 20, 4, True) and outcomes.purged_end(40, 40, 10, 2) == 28


def test_rules_mine_a_planted_signal(spark):
    rng = random.Random(3)
    x = [rng.gauss(0, 1) for _ in range(300)]
    f = spark.createDataFrame([("A", day(k), "f", v) for k, v in enumerate(x)], "ticker string, trade_date date, feature_id string, value double")
    o = spark.createDataFrame([("A", day(k), (0.05 if v > 0.8 else 0.0) + rng.gauss(0, 0.01)) for k, v in enumerate(x)], "ticker string, trade_date date, outcome double")
    got = {r.cond_id: r.expectancy for r in rules.singles(rules.hits(f, rules.conditions(f), o)).collect()}
    assert got["f:>"] > 0.04 and abs(got["f:<"]) < 0.01


def test_greedy_pruning_keeps_the_first(spark):
    c = spark.createDataFrame([("A", x, p) for x, p in (("a", 1), ("b", 2), ("c", 3))], "ticker string, cond_id string, priority int")
    alike = spark.createDataFrame([("A", "a", "b"), ("A", "b", "c")], "ticker string, first string, second string")
    assert sorted(r.cond_id for r in rules.keep_first(c, alike).collect()) == ["a", "c"]


def test_weakest_holding_is_displaced_first(spark):
    rows = [("b", "new", 1, 0.0, 0.3), ("b", "mid", 2, 0.4, 0.4), ("b", "weak", 3, 0.5, 0.2)]
    p = spark.createDataFrame(rows, "book string, ticker string, rank int, current double, target double")
    got = {(r.from_ticker, r.to_ticker): round(r.amount, 9) for r in decisions.capital_flows(p, ["book"]).collect()}
    assert got == {(None, "new"): 0.1, ("weak", "new"): 0.2, ("weak", None): 0.1}


def test_concentration_caps(spark):
    t = spark.createDataFrame([("b", "A", "S", 0.3), ("b", "B", "S", 0.2), ("b", "C", "T", 0.25)], "book string, ticker string, sector string, weight double")
    got = {r.ticker: round(r.capped, 9) for r in decisions.concentration_caps(t, "book").collect()}
    assert got == {"A": 0.3, "B": 0.1, "C": 0.25}
    near = spark.createDataFrame([("A", "C", 0.9)], "a string, b string, correlation double")
    assert {r.ticker: round(r.capped, 9) for r in decisions.concentration_caps(t, "book", near).collect()} == {"A": 0.3, "B": 0.1, "C": 0.1}


def test_fair_value(spark):
    facts = spark.createDataFrame([("A", "Banks", 2.0, 1.0, 10.0, 100.0, 0.05), ("B", None, 1.0, None, 10.0, None, None)], "ticker string, sector string, eps double, dividend double, shares double, equity double, g_eps double")
    a, b = valuation.fair_values(facts).orderBy("ticker").collect()
    g = 0.5 * 0.05 + 0.5 * 0.04
    assert a.pe == 18.0 and a.pb == 10.0 and a.dcf is None and a.ddm == pytest.approx(1.0 * (1 + 0.7 * g) / (0.195 - 0.04), abs=1e-4)
    assert set(a.included) <= {"pe", "pb", "ddm", "residual_income"} and a.bear_case <= a.fair_value <= a.bull_case
    assert b.fair_value is None


def test_graph(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "node string")
    assert {(r.node, r.hop) for r in graph.within(e, seeds, 2).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert {r.node: r.path for r in graph.shortest_paths(e, seeds, 5).collect()}["d"] == ["a", "b", "c", "d"]
    assert graph.subgraph(e, seeds, 2).count() == 2


def test_regime_thresholds(spark):
    r = market.regime(bars(spark, [100 * 1.002**k for k in range(30)]))
    assert (r.first().trend, r.first().volatility) == ("bullish", "low")


def body(spark, text, **more):
    names = ", ".join(f"{k} string" for k in more)
    return spark.createDataFrame([(text, *more.values())], f"body string{', ' + names if names else ''}")


def test_series_and_bar_layouts(spark):
    got = parsers.fred(body(spark, "DATE,X\n2024-01-01,1.5\n2024-01-02,.\nbad,3\n")).collect()
    assert [tuple(r) for r in got] == [("X", D(2024, 1, 1), 1.5)] and parsers.rejected(body(spark, "DATE,X\n2024-01-01,1.5\n2024-01-02,.\n")).count() == 1
    got = parsers.stooq(body(spark, "Date,Open,High,Low,Close,Volume\n2024-01-01,1,2,0.5,1.5,\n", ticker="A")).first()
    assert (got.close, got.volume) == (1.5, 0)


def test_json_layouts(spark):
    got = parsers.world_bank(body(spark, '[{"page":1},[{"indicator":{"id":"GDP"},"date":"2020","value":1.0},{"indicator":{"id":"GDP"},"date":"2021","value":null}]]')).collect()
    assert [tuple(r) for r in got] == [("GDP", D(2020, 12, 31), 1.0)]
    got = parsers.un_sdg(body(spark, '{"data":[{"series":"S1","timePeriodStart":2019.0,"value":"2.5"},{"series":"S2","timePeriodStart":2019.0,"value":"1"}]}'), {"S1": "one"}).collect()
    assert [tuple(r) for r in got] == [("one", D(2019, 12, 31), 2.5)]
    got = parsers.periods(body(spark, '[{"series":"c","year":2024,"month":2,"value":1},{"series":"c","year":2024,"quarter":3,"value":2},{"series":"c","year":2023,"value":3}]')).collect()
    assert {r.observation_date for r in got} == {D(2024, 2, 29), D(2024, 9, 30), D(2023, 12, 31)}
    got = parsers.gdelt(body(spark, '{"articles":[{"url":"u","title":"b","seendate":"20240102T000000Z"},{"url":"u","title":"a","seendate":"20240101T000000Z"}]}')).collect()
    assert [(r.url, r.headline, r.published_at) for r in got] == [("u", "a", D(2024, 1, 1))]


def test_feeds(spark):
    rss = '<rss><channel><item><title><![CDATA[A & B]]></title><link>http://x/1</link><pubDate>Mon, 01 Jan 2024 10:00:00 +0000</pubDate></item><item><title>no date</title></item></channel></rss>'
    atom = '<feed><entry><title>C &lt;d&gt;</title><link href="http://x/2"/><updated>2024-01-02T00:00:00Z</updated></entry></feed>'
    assert [(r.headline, r.link, r.published_at) for r in parsers.rss(body(spark, rss)).collect()] == [("A & B", "http://x/1", D(2024, 1, 1))]
    assert [(r.headline, r.link, r.published_at) for r in parsers.rss(body(spark, atom)).collect()] == [("C <d>", "http://x/2", D(2024, 1, 2))]


def test_html_layouts(spark):
    page = '<table><tr><th>Date</th><th>Close</th></tr><tr><td>2024-01-01</td><td>1&nbsp;5</td></tr></table><a class=x href="/f.pdf">Annual <b>report</b></a>'
    cells = {(r.row, r.col): r.text for r in parsers.html_tables(body(spark, page, id="d"), "id").collect()}
    assert cells == {(0, 0): "Date", (0, 1): "Close", (1, 0): "2024-01-01", (1, 1): "1 5"}
    assert [tuple(r) for r in parsers.links(body(spark, page)).select("href", "text").collect()] == [("/f.pdf", "Annual report")]
    assert spark.range(1).select(parsers.visible_text(F.lit("<script>x</script><p>a  b</p>")).alias("t")).first().t == "a b"


def test_numbers_and_periods(spark):
    got = spark.createDataFrame([("1,234.5",), ("(12.5)",), ("3.2K",), ("4M",), ("-",), ("1.5B",), ("x",)], "t string").select(parsers.number(F.col("t")).alias("n"))
    assert [r.n for r in got.collect()] == [1234.5, -12.5, 3200.0, 4e6, None, 1.5e9, None]
    got = spark.createDataFrame([("Q1/25",), ("Jan/25",), ("2025",), ("3Q25",), ("x",)], "t string").select(parsers.period_end(F.col("t")).alias("d"))
    assert [r.d for r in got.collect()] == [D(2025, 3, 31), D(2025, 1, 31), D(2025, 12, 31), D(2025, 9, 30), None]
    w = spark.range(1).select(parsers.date_windows("2024-01-01", "2024-01-10", 4).alias("w")).first().w
    assert [(x.start, x.end) for x in w] == [(D(2024, 1, 1), D(2024, 1, 4)), (D(2024, 1, 5), D(2024, 1, 8)), (D(2024, 1, 9), D(2024, 1, 10))]


def test_scale_duplicates_collapse(spark):
    rows = [("A", day(0), "x", 1, 5.0), ("A", day(0), "x", 2, 5000.0), ("A", day(0), "y", 1, 5.0), ("A", day(0), "y", 2, 7.0)]
    got = {r.line_item: (r.value, r.conflict) for r in parsers.one_line_item(spark.createDataFrame(rows, "ticker string, period_end_date date, line_item string, seq int, value double")).collect()}
    assert got == {"x": (5000.0, False), "y": (7.0, True)}


def test_text_rules(spark):
    got = spark.createDataFrame([("Profit falls on Losses",), ("Record growth",), ("Board meets",)], "t string").select(text.sentiment(F.col("t")).alias("s"), text.tokens(F.col("t")).alias("w")).collect()
    assert [r.s for r in got] == ["negative", "positive", "neutral"] and got[2].w == ["board", "meets"]
