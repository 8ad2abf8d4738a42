"""Logical views of the market domain over the raw tables, for Spark and as SQL.

`bars` has one row per brand and ship date; the other views build on it or on
orders, documents and the dimension tables. CTES holds the same definitions in
portable SQL, for oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .stage import written

#: Fixed: columns of a bar.
BAR = ("ticker", "trade_date", "open", "high", "low", "close", "volume")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars per brand; first and last trade by order keys, ties by price."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    price = F.try_divide("l_extendedprice", "l_quantity")
    trades = lines.join(part, lines["l_partkey"] == part["p_partkey"]).select(
        F.col("p_brand").alias("ticker"), F.to_date("l_shipdate").alias("trade_date"), price.alias("price"), "l_quantity",
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", price.alias("price")).alias("seq"),
    )
    return trades.groupBy("ticker", "trade_date").agg(
        F.min("seq")["price"].alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max("seq")["price"].alias("close"), F.sum("l_quantity").cast("long").alias("volume"),
    )


def shared_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bars, written once for plans that read them more than once."""
    return written(bars(spark, sf_dir), "bars")


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    brand = table(spark, sf_dir, "part").select(F.col("p_brand").alias("ticker")).distinct()
    return brand.withColumn("sector", F.concat(F.lit("S"), F.regexp_extract("ticker", r"(\d+)", 1).cast("int") % 5))


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily mean order price per priority class."""
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(F.col("o_orderpriority").alias("series_id"), F.to_date("o_orderdate").alias("observation_date")).agg(F.round(F.avg("o_totalprice"), 4).alias("value"))


def corporate_events(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """Splits and dividends on fixed day numbers of each ticker's bars (`of`, if at hand)."""
    n = F.datediff("trade_date", F.lit("1995-01-01").cast("date"))
    rows = (bars(spark, sf_dir) if of is None else of).select("ticker", F.col("trade_date").alias("event_date"), "close", n.alias("n")).where("n % 97 = 0 or n % 389 = 0")
    return rows.select(
        "ticker", "event_date", F.when(F.col("n") % 389 == 0, "SPLIT").otherwise("DIVIDEND").alias("event_type"),
        F.when(F.col("n") % 389 == 0, F.lit(2.0)).alias("split_ratio"), F.when(F.col("n") % 389 != 0, F.round(F.col("close") * 0.01, 4)).alias("dividend_amount"),
    )


def financials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly line items per brand in long form."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    end = F.last_day(F.add_months(F.trunc("l_shipdate", "quarter"), 2))
    q = lines.groupBy(F.col("p_brand").alias("ticker"), end.alias("period_end_date")).agg(
        F.round(F.sum("l_extendedprice"), 2).alias("revenue"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount") * 4)), 2).alias("operating_income"),
        F.round(F.sum(F.col("l_extendedprice") * (0.5 - F.col("l_discount"))), 2).alias("net_income"), F.sum("l_quantity").alias("shares_outstanding"),
        F.round(F.sum("p_retailprice") * 10, 2).alias("total_equity"),
    )
    items = ["revenue", "operating_income", "net_income", "shares_outstanding", "total_equity"]
    return q.unpivot(["ticker", "period_end_date"], items, "line_item", "value").withColumn("period_type", F.lit("QUARTERLY"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collector runs: the event stream seen as a run log of five sources."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("run_id"), F.col("event_type").alias("source_id"), F.col("ts").alias("occurred_at"), ((F.col("event_id") % 7) != 0).alias("succeeded"),
        (F.col("event_id") % 11).cast("int").alias("records_expected"), (F.col("event_id") % 5).cast("int").alias("records_produced"),
        F.when(F.col("event_id") % 3 != 0, F.round(F.col("value") % 1, 4)).alias("confidence"), (F.col("event_id") % 13 + 1.0).alias("latency_seconds"),
        ((F.col("event_id") % 7 != 0) & (F.col("event_id") % 2 == 0)).alias("materialized"),
    )


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as dated decisions with an outcome."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("decision_id"), F.element_at(F.array(F.lit("MICRO"), F.lit("SWING"), F.lit("INVESTMENT")), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("horizon"),
        F.to_date("o_orderdate").alias("decided_on"), F.round((F.col("o_orderkey") % 101) / 100.0, 2).alias("confidence"),
        F.round((F.col("o_custkey") % 41 - 20) / 100.0, 2).alias("expected_return"), F.round((F.col("o_orderkey") % 61 - 28) / 200.0, 4).alias("realized_return"),
        F.round((F.col("o_custkey") % 21 - 10) / 200.0, 4).alias("benchmark_return"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier - nation - region and customer - nation links of a property graph."""
    nation, supplier = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    a = nation.select(F.concat(F.lit("nation:"), "n_nationkey").alias("src"), F.concat(F.lit("region:"), "n_regionkey").alias("dst"), F.lit("LOCATED_IN").alias("kind"))
    b = supplier.select(F.concat(F.lit("supplier:"), "s_suppkey").alias("src"), F.concat(F.lit("nation:"), "s_nationkey").alias("dst"), F.lit("BASED_IN").alias("kind"))
    return a.unionByName(b)


CTES = {
    "bars": """bars AS (
  SELECT ticker, trade_date, min(seq).price AS open, max(price) AS high, min(price) AS low, max(seq).price AS close, CAST(sum(l_quantity) AS BIGINT) AS volume
  FROM (SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS trade_date, l_extendedprice / nullif(l_quantity, 0) AS price, l_quantity,
               {'a': l_orderkey, 'b': l_linenumber, 'c': l_partkey, 'd': l_suppkey, 'price': l_extendedprice / nullif(l_quantity, 0)} AS seq
        FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY ticker, trade_date)""",
    "sectors": "sectors AS (SELECT DISTINCT p_brand AS ticker, 'S' || CAST(CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INTEGER) % 5 AS VARCHAR) AS sector FROM part)",
    "macro": "macro AS (SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS observation_date, round(avg(o_totalprice), 4) AS value FROM orders GROUP BY ALL)",
    "corporate_events": """corporate_events AS (
  SELECT ticker, trade_date AS event_date, CASE WHEN n % 389 = 0 THEN 'SPLIT' ELSE 'DIVIDEND' END AS event_type,
         CASE WHEN n % 389 = 0 THEN 2.0::DOUBLE END AS split_ratio, CASE WHEN n % 389 <> 0 THEN round(close * 0.01::DOUBLE, 4) END AS dividend_amount
  FROM (SELECT *, trade_date - DATE '1995-01-01' AS n FROM bars) WHERE n % 97 = 0 OR n % 389 = 0)""",
    "financials": """quarters AS (
  SELECT p_brand AS ticker, CAST(date_trunc('quarter', l_shipdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS period_end_date,
         round(sum(l_extendedprice), 2) AS revenue, round(sum(l_extendedprice * (1 - l_discount * 4)), 2) AS operating_income,
         round(sum(l_extendedprice * (0.5::DOUBLE - l_discount)), 2) AS net_income, sum(l_quantity) AS shares_outstanding, round(sum(p_retailprice) * 10, 2) AS total_equity
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
financials AS (
  SELECT ticker, period_end_date, line_item, value, 'QUARTERLY' AS period_type
  FROM (UNPIVOT quarters ON revenue, operating_income, net_income, shares_outstanding, total_equity INTO NAME line_item VALUE value))""",
    "runs": """runs AS (
  SELECT event_id AS run_id, event_type AS source_id, ts AS occurred_at, event_id % 7 <> 0 AS succeeded, CAST(event_id % 11 AS INTEGER) AS records_expected,
         CAST(event_id % 5 AS INTEGER) AS records_produced, CASE WHEN event_id % 3 <> 0 THEN round(value % 1, 4) END AS confidence,
         event_id % 13 + 1.0::DOUBLE AS latency_seconds, event_id % 7 <> 0 AND event_id % 2 = 0 AS materialized FROM events)""",
    "decisions": """decisions AS (
  SELECT o_orderkey AS decision_id, ['MICRO', 'SWING', 'INVESTMENT'][CAST(o_orderkey % 3 + 1 AS INTEGER)] AS horizon, CAST(o_orderdate AS DATE) AS decided_on,
         round((o_orderkey % 101) / 100.0::DOUBLE, 2) AS confidence, round((o_custkey % 41 - 20) / 100.0::DOUBLE, 2) AS expected_return,
         round((o_orderkey % 61 - 28) / 200.0::DOUBLE, 4) AS realized_return, round((o_custkey % 21 - 10) / 200.0::DOUBLE, 4) AS benchmark_return FROM orders)""",
    "edges": """edges AS (
  SELECT 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS dst, 'LOCATED_IN' AS kind FROM nation
  UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'BASED_IN' FROM supplier)""",
}
NEEDS = {"corporate_events": ("bars",)}


def sql(names: str, body: str, recursive: bool = False) -> str:
    """`body` with the named views as common table expressions before it."""
    order: list[str] = []
    for name in names.split():
        order += [n for n in (*NEEDS.get(name, ()), name) if n not in order]
    head = ",\n".join(CTES[n] for n in order)
    body = body.strip()
    joined = f"{head},\n{body[5:].strip()}" if body[:5].upper() == "WITH " else f"{head}\n{body}"
    return f"WITH {'RECURSIVE ' if recursive else ''}{joined}"
