from datetime import date

import pytest
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, LessThanOrEqual

from tidemark.sources import provider


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('provider')}"
    bars = [(t, date(2024, 1, d), 1.0, 2.0, 0.5, float(d), d * 10) for t in ("Brand#1", "a b/c", "Z") for d in range(1, 11)] + [("Z", date(2024, 2, 1), None, None, None, None, None)]
    provider.publish(spark.createDataFrame(bars, provider.TABLES["bars"][2]), path, "bars")
    provider.publish(spark.createDataFrame([("GDP", date(2024, 1, 1), 1.5), ("CPI", date(2024, 1, 2), 2.5)], provider.TABLES["macro"][2]), path, "macro")
    provider.publish(spark.createDataFrame([("Z", date(2024, 1, 3), "SPLIT", 2.0, None), ("Z", date(2024, 1, 9), "DIVIDEND", None, 0.4)], provider.TABLES["corporate_events"][2]), path, "corporate_events")
    provider.publish(spark.createDataFrame([("wire", date(2024, 1, 3), 'a "quoted", headline', "Z|Q"), ("wire", date(2024, 1, 4), "other", None), ("blog", date(2024, 1, 5), "x", "ZZ")], provider.TABLES["news"][2]), path, "news")
    provider.register(spark)
    return path


def test_four_methods(spark, folder):
    got = provider.price_history(spark, folder, "Brand#1", "2024-01-03", "2024-01-05").collect()
    assert sorted(tuple(r) for r in got) == [("Brand#1", date(2024, 1, d), 1.0, 2.0, 0.5, float(d), d * 10) for d in (3, 4, 5)]
    assert provider.price_history(spark, folder, "a b/c", "2024-01-01", "2024-12-31").count() == 10
    assert [r["close"] for r in provider.price_history(spark, folder, "Z", "2024-02-01", "2024-02-01").collect()] == [None]
    assert provider.price_history(spark, folder, "none", "2024-01-01", "2024-12-31").count() == 0
    assert [(r["event_type"], r["split_ratio"]) for r in provider.corporate_events(spark, folder, "Z", "2024-01-01", "2024-01-05").collect()] == [("SPLIT", 2.0)]
    assert [r["value"] for r in provider.macro_series(spark, folder, "CPI", "2024-01-01", "2024-01-02").collect()] == [2.5]
    assert [(r["headline"], r["tickers"]) for r in provider.news(spark, folder, "Z", "2024-01-01", "2024-01-31").collect()] == [('a "quoted", headline', ["Z", "Q"])]
    assert {tuple(r["tickers"]) for r in provider.news(spark, folder, None, "2024-01-01", "2024-01-31").collect()} == {("Z", "Q"), (), ("ZZ",)}


def test_reader_prunes_files_and_takes_bounds(spark, folder):
    r = provider.ProviderSource({"table": "bars", "path": folder}).reader(None)
    assert {p.key for p in r.partitions()} == {"Brand#1", "a b/c", "Z"}
    left = list(r.pushFilters([EqualTo(("ticker",), "Z"), In(("ticker",), ("Z", "Q")), GreaterThan(("trade_date",), date(2024, 1, 8)), LessThanOrEqual(("trade_date",), date(2024, 1, 9)), IsNotNull(("close",))]))
    assert left == [IsNotNull(("close",))]
    parts = r.partitions()
    assert [p.key for p in parts] == ["Z"]
    assert [b.column("trade_date").to_pylist() for b in r.read(parts[0])] == [[date(2024, 1, 9)]]


def test_plan_shows_no_filter_left_above_the_scan(spark, folder):
    df = provider.price_history(spark, folder, "Z", "2024-01-03", "2024-01-05")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "2024-01-03" not in plan.split("BatchScan")[0] and df.count() == 3
