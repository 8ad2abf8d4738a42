"""Fair values from statement items, as column algebra over one row per ticker."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.stats import clamp

#: Fixed: model weights; sector multiples (pe, ev_ebitda, pb).
WEIGHTS = {"dcf": 0.30, "ddm": 0.10, "residual_income": 0.15, "earnings_power": 0.15, "ev_ebitda": 0.10, "pe": 0.10, "pb": 0.10}
MULTIPLES = {"Banks": (9.0, 7.0, 1.0), "Real Estate": (12.0, 9.0, 1.5), "Technology": (20.0, 14.0, 3.0), "Telecommunications": (10.0, 7.0, 1.5), "Materials": (9.0, 7.0, 1.2)}
OTHER = (11.0, 8.5, 1.3)
#: Fixed: items that add up over quarters.
FLOWS = ("revenue", "cost_of_revenue", "gross_profit", "operating_income", "net_income", "net_income_attributable", "operating_cash_flow", "free_cash_flow", "ebitda", "dividend_per_share", "eps_basic", "eps_diluted")
YEARS = 5


@dataclass(frozen=True)
class Assumptions:
    risk_free: float = 0.125
    premium: float = 0.07
    beta: float = 1.0
    wacc: float = 0.16
    growth: float = 0.04
    tax: float = 0.225

    @property
    def equity_cost(self) -> float:
        return self.risk_free + self.beta * self.premium


def trailing_year(items: DataFrame) -> DataFrame:
    """Long items of the last four quarters as one value each: flows that all four have add up,
    shares average, everything else takes the last known value."""
    quarters = items.where(F.upper("period_type") == "QUARTERLY")
    ends = quarters.select("ticker", "period_end_date").distinct().withColumn("r", F.row_number().over(Window.partitionBy("ticker").orderBy(F.col("period_end_date").desc()))).where("r <= 4")
    recent = quarters.join(ends, ["ticker", "period_end_date"])
    value = (
        F.when(F.first("line_item").isin(*FLOWS) & (F.count("value") == 4), F.sum("value"))
        .when(F.first("line_item") == "shares_outstanding", F.avg("value"))
        .otherwise(F.max_by("value", F.when(F.col("value").isNotNull(), F.col("period_end_date"))))
    )
    full = ends.groupBy("ticker").agg(F.count("*").alias("q"), F.max("period_end_date").alias("period_end_date")).where("q = 4").drop("q")
    return recent.groupBy("ticker", "line_item").agg(value.alias("value")).join(full, "ticker")


def statement_rows(items: DataFrame, as_of: str, days: int = 1100) -> DataFrame:
    """Long rows (ticker, seq, period_end_date, line_item, value) of what is known of the last `days` days at `as_of`.

    With four quarters a ticker has its annual periods and, last, the year they
    make up; with fewer all its periods in order. Snapshots are no periods. seq
    orders the rows of a ticker."""
    day = F.lit(as_of).cast("date")
    known = items.where(F.upper("period_type").isin("ANNUAL", "QUARTERLY") & F.col("period_end_date").between(F.date_sub(day, days), day)).withColumn("period_type", F.upper("period_type"))
    year = trailing_year(known)
    whole = year.select("ticker").distinct().withColumn("_year", F.lit(True))
    own = known.join(whole, "ticker", "left").where((F.col("period_type") == "ANNUAL") | F.col("_year").isNull())
    seq = lambda last: F.struct(F.lit(last).alias("year"), F.col("period_end_date").alias("day")).alias("seq")
    return own.select("ticker", seq(0), "period_end_date", "line_item", "value").unionByName(year.select("ticker", seq(1), "period_end_date", "line_item", "value"))


def facts(items: DataFrame, sectors: DataFrame, as_of: str, stale_days: int = 550) -> DataFrame:
    """What `fair_values` reads, one row per ticker whose last period is at most `stale_days` old: the last
    known value of each item, the mean operating income of the last three periods, and the mean of the
    last three relative changes between neighbouring periods."""
    names = ["revenue", "eps_diluted", "eps_basic", "free_cash_flow", "dividend_per_share", "shares_outstanding", "cash_and_equivalents", "total_debt", "total_equity", "operating_income", "ebitda"]
    rows = statement_rows(items, as_of)
    wide = rows.groupBy("ticker", "seq").pivot("line_item", names).agg(F.last("value")).withColumn("eps", F.coalesce("eps_diluted", "eps_basic"))
    grown = ("revenue", "eps", "free_cash_flow")
    w = Window.partitionBy("ticker").orderBy("seq")
    change = lambda c: F.when(F.lag(c).over(w) != 0, (F.col(c) - F.lag(c).over(w)) / F.abs(F.lag(c).over(w)))
    wide = wide.withColumns({f"_g_{c}": change(c) for c in grown} | {"_back": F.row_number().over(Window.partitionBy("ticker").orderBy(F.col("seq").desc()))})
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))
    recent = lambda c: F.slice(F.sort_array(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("seq", F.col(c).alias("v")))), False), 1, 3)
    mean = lambda c: F.try_divide(F.aggregate(c, F.lit(0.0), lambda t, x: t + x["v"]), F.size(c))
    out = wide.groupBy("ticker").agg(
        F.max("seq")["day"].alias("last_period"), *[last(c).alias(n) for c, n in (("revenue", "revenue"), ("eps", "eps"), ("free_cash_flow", "free_cash_flow"), ("dividend_per_share", "dividend"), ("shares_outstanding", "shares"), ("cash_and_equivalents", "cash"), ("total_debt", "debt"), ("total_equity", "equity"), ("ebitda", "ebitda"))],
        F.avg(F.when(F.col("_back") <= 3, F.col("operating_income"))).alias("ebit"), *[recent(f"_g_{c}").alias(f"_r_{c}") for c in grown],
    )
    out = out.withColumns({f"g_{c}": mean(f"_r_{c}") for c in grown}).drop(*[f"_r_{c}" for c in grown])
    return out.where(F.datediff(F.lit(as_of).cast("date"), "last_period") <= stale_days).join(sectors.select("ticker", "sector"), "ticker", "left")


def multiples(sector: Column) -> tuple[Column, Column, Column]:
    out = []
    for k in range(3):
        c: Column = F.lit(OTHER[k])
        for name, values in reversed(MULTIPLES.items()):
            c = F.when(F.lower(F.coalesce(sector, F.lit(""))).contains(name.lower()), values[k]).otherwise(c)
        out.append(c)
    return tuple(out)


def fair_values(facts: DataFrame, a: Assumptions = Assumptions()) -> DataFrame:
    """facts: ticker, sector, revenue, eps, free_cash_flow, dividend, shares, cash, debt,
    equity, ebit (mean), ebitda, and g_revenue, g_eps, g_free_cash_flow. Null where fewer
    than three models agree within a factor of three of their median."""
    ke, g = a.equity_cost, a.growth
    have = {f.name for f in facts.schema}
    col = lambda n: F.col(n) if n in have else F.lit(None).cast("double")
    rate = lambda n: 0.5 * F.coalesce(clamp(col(n), -0.2, 0.2), F.lit(g)) + 0.5 * g
    g_eps, g_fcf = rate("g_eps"), rate("g_free_cash_flow")
    shares = F.when(col("shares") > 0, col("shares"))
    net_cash = F.coalesce(col("cash"), F.lit(0.0)) - F.coalesce(col("debt"), F.lit(0.0))
    bank = F.lower(F.coalesce(col("sector"), F.lit(""))).contains("bank")
    pe, ev, pb = multiples(col("sector"))
    eps, equity, div = col("eps"), F.when(col("equity") != 0, col("equity")), col("dividend")
    fcf = [col("free_cash_flow") * F.pow(1 + g_fcf, F.lit(y)) for y in range(1, YEARS + 1)]
    pv = sum((x / (1 + a.wacc) ** y for y, x in enumerate(fcf, 1)), F.lit(0.0))
    dcf = (pv + fcf[-1] * (1 + g) / (a.wacc - g) / (1 + a.wacc) ** YEARS + net_cash) / shares
    book, income = equity / shares, F.lit(0.0)
    for y in range(1, YEARS + 1):
        e = eps * F.pow(1 + g_eps, F.lit(y))
        income = income + (e - ke * book) / (1 + ke) ** y
        book = book + e - F.coalesce(div, F.lit(0.0))
    last = eps * F.pow(1 + g_eps, F.lit(YEARS))
    residual = equity / shares + income + (last - ke * book) * 0.5 / (ke - g) / (1 + ke) ** YEARS
    models = {
        "dcf": F.when(~bank, dcf), "ddm": F.when(div > 0, div * (1 + 0.7 * g_eps) / (ke - g)), "residual_income": residual,
        "earnings_power": F.when(~bank, (col("ebit") * (1 - a.tax) / a.wacc + net_cash) / shares), "ev_ebitda": F.when(~bank & (col("ebitda") > 0), (col("ebitda") * ev + net_cash) / shares),
        "pe": F.when(eps > 0, eps * pe), "pb": F.when(equity > 0, equity / shares * pb),
    }
    rows = facts.withColumns({f"m_{n}": c for n, c in models.items()})
    listed = F.filter(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"m_{n}").alias("v"), F.lit(w).alias("w")) for n, w in WEIGHTS.items()]), lambda m: m["v"] > 0)
    rows = rows.withColumn("_all", listed).withColumn("_sorted", F.array_sort(F.transform("_all", lambda m: m["v"])))
    half, n = F.floor(F.size("_sorted") / 2).cast("int"), F.size("_sorted")
    middle = F.when(n == 0, None).when(n % 2 == 1, F.get("_sorted", half)).otherwise((F.get("_sorted", half - 1) + F.get("_sorted", half)) / 2)
    rows = rows.withColumn("_mid", middle).withColumn("_in", F.filter("_all", lambda m: m["v"].between(F.col("_mid") / 3, F.col("_mid") * 3)))
    total = lambda f: F.aggregate("_in", F.lit(0.0), lambda s, m: s + f(m))
    ok = (F.size("_all") >= 3) & (F.size("_in") >= 3)
    fair = F.when(ok, total(lambda m: m["w"] * m["v"]) / total(lambda m: m["w"]))
    rows = rows.withColumn("fair_value", fair)
    bear = F.greatest(F.array_min(F.transform("_in", lambda m: m["v"])), F.col("fair_value") * 0.6)
    bull = F.least(F.array_max(F.transform("_in", lambda m: m["v"])), F.col("fair_value") * 1.6)
    return rows.select("ticker", *[F.round(f"m_{n}", 4).alias(n) for n in WEIGHTS], F.round("fair_value", 4).alias("fair_value"), F.when(ok, F.round(bear, 4)).alias("bear_case"), F.when(ok, F.round(bull, 4)).alias("bull_case"), F.when(ok, F.array_sort(F.transform("_in", lambda m: m["name"]))).alias("included"))


def metrics(facts: DataFrame, price: str = "close") -> DataFrame:
    """Market value, enterprise value and their ratios."""
    cap = F.col(price) * F.col("shares")
    ev = cap + F.coalesce("debt", F.lit(0.0)) - F.coalesce("cash", F.lit(0.0))
    return facts.select("ticker", cap.alias("market_cap"), ev.alias("enterprise_value"), F.when(F.col("ebitda") > 0, ev / F.col("ebitda")).alias("ev_ebitda"), F.when(F.col("equity") > 0, cap / F.col("equity")).alias("price_to_book"))
