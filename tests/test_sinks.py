import pytest
from pyspark.sql import functions as F

from tidemark.queries import QUERIES
from tidemark.sources import parsers, sinks


def test_archive_and_replay(spark, tmp_path):
    for k, name in enumerate(("a.csv", "b.csv", "copy.csv")):
        (tmp_path / name).write_text("DATE,X\n2024-01-01,1\n" if k != 1 else "DATE,Y\n2024-01-01,2\n")
    docs = sinks.archive(spark, str(tmp_path), "*.csv")
    assert docs.count() == 3 and docs.select("document_id").distinct().count() == 2
    assert sorted(r.series_id for r in sinks.replay(docs, parsers.fred).collect()) == ["X", "Y"]


def test_export_counts(spark, tmp_path):
    assert sinks.export({"t": spark.range(7)}, str(tmp_path)) == {"t": 7}
    assert spark.read.json(str(tmp_path / "t")).count() == 7


def test_publish_is_all_or_nothing(spark, tmp_path):
    check = {"t": lambda df: df.where("id < 0")}
    sinks.publish({"t": spark.range(3)}, str(tmp_path), check)
    with pytest.raises(ValueError):
        sinks.publish({"t": spark.range(5).select((F.col("id") - 1).alias("id"))}, str(tmp_path), check)
    assert sinks.published(spark, str(tmp_path), "t").count() == 3


def test_views(spark):
    sinks.expose(spark, QUERIES, "/root/testdata/sf0.001", ["a12_market_breadth", "t1_top_k"])
    assert spark.sql("select universe from a12_market_breadth").count() == 1
