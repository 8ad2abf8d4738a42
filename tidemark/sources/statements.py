"""Financial statements and indicators in provider layouts, to long rows.

As in `parsers`, a parser takes raw documents in `body` and gives one row per
value; what does not parse gives no row. Statement rows are (ticker,
period_end_date, period_type, statement_type, line_item, value, currency).
Text, JSON and script layouts need no Python; HTML tables go through
`parsers.html_tables`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .parsers import html_tables, period_end, visible_text

INCOME, BALANCE, CASH, KEY = "INCOME_STATEMENT", "BALANCE_SHEET", "CASH_FLOW", "KEY_METRICS"
ROW = ("ticker", "period_end_date", "period_type", "statement_type", "line_item", "value", "currency")

#: Fixed: labels of an earnings summary table.
SUMMARY = {
    "Revenues": (INCOME, "revenue"), "Revenue": (INCOME, "revenue"), "Gross Profit": (INCOME, "gross_profit"), "EBITDA": (INCOME, "ebitda"), "EBIT": (INCOME, "operating_income"),
    "Operating Profit": (INCOME, "operating_income"), "Net Profit": (INCOME, "net_income"), "Reported Net Income": (INCOME, "net_income"), "Recurring Net Income": (KEY, "recurring_net_income"),
}
#: Fixed: columns of a table with one row a year.
YEARLY = {
    "Assets": (BALANCE, "total_assets"), "Liabilities": (BALANCE, "total_liabilities"), "BookValue": (BALANCE, "total_equity"), "Revenue": (INCOME, "revenue"), "GrossProfit": (INCOME, "gross_profit"),
    "NetProfit": (INCOME, "net_income"), "NetProfitToShareholders": (INCOME, "net_income_attributable"), "EPS": (INCOME, "eps_basic"), "EBITDA": (INCOME, "ebitda"), "OCF": (CASH, "operating_cash_flow"),
    "FCF": (CASH, "free_cash_flow"), "SharesOutstanding": (BALANCE, "shares_outstanding"), "TotalDebt": (BALANCE, "total_debt"),
    "P/E": ("VALUATION", "historical_pe"), "P/BV": ("VALUATION", "historical_pb"), "ClosingPrice": ("VALUATION", "historical_closing_price"),
}
#: Fixed: records of an embedded statement object; of these, the ones stated once more in thousands keep the larger value.
EMBEDDED = {
    "Total Assets": "total_assets", "Total Liabilities": "total_liabilities", "Total Owners' Equity & Minority Interest Equity": "total_equity", "Net Income or Loss": "net_income", "Gross Profit": "gross_profit",
    "Net Cash Flow from (Used In) Operating Activities": "operating_cash_flow", "Net Change In Cash & Cash Equivalents": "cash_and_equivalents_change",
    "Net Cash Flow from (Used In) Investing Activities": "investing_cash_flow", "Net Cash Flow from (Used In) Financing Activities": "financing_cash_flow",
}
STOCKS = ("total_assets", "total_liabilities", "total_equity")
#: Fixed: first words of rows in fiscal-year tables.
FISCAL = {
    "revenue": "revenue", "gross profit": "gross_profit", "operating income": "operating_income", "net income": "net_income", "earnings per share": "eps_basic", "cash & investments": "cash_and_equivalents",
    "total debt": "total_debt", "operating cash flow": "operating_cash_flow", "free cash flow": "free_cash_flow", "ebitda": "ebitda", "total equity": "total_equity", "shareholders equity": "total_equity",
    "total shareholders equity": "total_equity", "dividend per share": "dividend_per_share", "dividends per share": "dividend_per_share",
}
#: Fixed: fields of a market snapshot.
SNAPSHOT = {"market_cap": "MarketCap", "market_pe": "PE", "market_eps": "EPS", "market_dividend_per_share": "Dividend", "market_dividend_yield": "Yield", "market_beta": "Beta", "market_revenue": "Revenue"}
#: Fixed: figures of press releases: item, statement, the words of its name, the words that may lead to the figure, its form.
#: A figure without leading words stands before its name.
HIGHLIGHTS = (
    ("revenue", INCOME, "total revenue", ("to",), "EGP bn"), ("ebitda", INCOME, "ebitda", ("to",), "EGP bn"),
    ("net_income", INCOME, "net profit", ("reached", "was"), "EGP bn"), ("free_cash_flow", CASH, "fcff", ("to",), "EGP bn"),
    ("revenue_growth_yoy", KEY, "total revenue", ("grew",), "%"), ("ebitda_growth_yoy", KEY, "ebitda", ("rose",), "%"),
    ("net_margin", KEY, "net margin", (), "%"), ("net_debt_to_ebitda", KEY, "net debt/ebitda", ("stood at",), "x"),
)
SENTENCE = (("revenue", INCOME, "revenue", ("of",), "USD million"), ("ebitda", INCOME, "ebitda", ("of",), "USD million"), ("net_income_attributable", INCOME, "net profit attributable to shareholders", ("of",), "USD million"))
#: Fixed: what one unit of a scaled amount is worth.
SCALES = {"bn": 1e9, "million": 1e6}


def group(text: Column, pattern: str, k: int = 1) -> Column:
    """Group k of the first match, null without one."""
    return F.nullif(F.regexp_extract(text, pattern, k), F.lit(""))


def bare(text: Column) -> Column:
    """A number without separators."""
    return F.replace(F.trim(text), F.lit(","), F.lit("")).try_cast("double")


def named(table: dict, key: Column, part: int | None = None) -> Column:
    """The entry of a small table of fixed values, null where there is none."""
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(v if part is None else v[part]))]
    return F.try_element_at(F.create_map(*pairs), key)


def quarter_end(quarter: Column, year: Column) -> Column:
    return F.last_day(F.make_date(year.try_cast("int"), quarter.try_cast("int") * 3, F.lit(1)))


def month_day(text: Column) -> Column:
    """`31 March 2025` and `Mar 31, 2025` as a date."""
    return F.coalesce(*[F.to_date(F.try_to_timestamp(text, F.lit(f))) for f in ("d MMMM yyyy", "MMM d, yyyy")])


def words_of(text: Column) -> Column:
    """The words of a line, without blanks around and without commas or the like at their ends."""
    return F.filter(F.transform(F.split(text, r"\s+"), lambda w: F.rtrim(w, F.lit(",;:"))), lambda w: w != "")


def spot(words: Column, phrase: str, start: Column) -> Column:
    """Where a phrase begins among words, at `start` (from 1) or later; null if nowhere."""
    parts = phrase.split(" ")
    places = F.when(start <= F.size(words), F.sequence(start, F.size(words)))
    return F.array_min(F.filter(places, lambda i: F.slice(words, i, len(parts)) == F.array(*map(F.lit, parts))))


def figure(words: Column, at: Column, form: str) -> Column:
    """The figure whose first word is at `at`: `EGP 7.5 bn` or `EGP 7.5bn` in whole units, `12%`, `1.4x`."""
    here, after, last = (F.get(words, at + k) for k in (-1, 0, 1))
    if " " not in form:
        return F.when(F.endswith(here, F.lit(form)), bare(F.rtrim(here, F.lit(form))))
    currency, scale = form.split(" ")
    amount = F.when(F.endswith(after, F.lit(scale)), bare(F.regexp_replace(after, scale + "$", ""))).when(last == scale, bare(after))
    return F.when(here == currency.lower(), amount) * SCALES[scale]


def told(words: Column, name: str, leads: tuple[str, ...], form: str) -> Column:
    """The figure that a sentence gives for a name. A share follows its leading word and that one the name at once; an amount may stand further on."""
    at = spot(words, name, F.lit(1))
    end = at + len(name.split(" "))
    if not leads:
        return figure(words, at - 1, form)
    found = []
    for lead in leads:
        place = spot(words, lead, end)
        near = place if " " in form else F.when(place == end, place)
        found.append(figure(words, near + len(lead.split(" ")), form))
    return F.coalesce(*found)


def earnings_table(docs: DataFrame) -> DataFrame:
    """`EGP mn 1Q25 1Q24 YoY Change` and rows of label, two numbers and a change: the later
    quarter's column, in millions; the first row of an item counts. docs: ticker, body.

    Lines are taken apart into words: a head is a unit of two words and two quarters; a row is a label, all words before the
    first that begins with a digit, then two decimal numbers and one more figure."""
    lines = docs.select("ticker", F.posexplode(F.split("body", r"\r?\n")).alias("_at", "line")).select("ticker", "_at", F.filter(F.split("line", r"\s+"), lambda w: w != "").alias("w"))
    when = lambda w: F.when(w.rlike("^[1-4]Q[0-9]{2}$"), quarter_end(F.substring(w, 1, 1), F.lit(2000) + F.substring(w, 3, 2).try_cast("int")))
    tail = F.array_join(F.slice("w", 5, 9), " ")
    is_head = (F.get("w", F.lit(0)) == "EGP") & (F.get("w", F.lit(1)) == "mn") & tail.isin("YoY Change", "Chg %", "Chg%")
    heads = lines.where(is_head).select("ticker", "_at", when(F.get("w", F.lit(2))).alias("a"), when(F.get("w", F.lit(3))).alias("b")).where("a is not null and b is not null")
    heads = heads.groupBy("ticker").agg(F.min_by(F.struct("a", "b"), "_at").alias("h")).select("ticker", "h.*")
    first = F.array_min(F.filter(F.sequence(F.lit(1), F.size("w")), lambda i: F.get("w", i - 1).rlike("^[0-9]")))
    number = lambda k: F.when(F.contains(F.get("w", F.col("k") - 1 + k), F.lit(".")), bare(F.get("w", F.col("k") - 1 + k)))
    change = F.array_join(F.slice("w", F.col("k") + 2, F.lit(9)), "")
    rows = lines.where(F.size("w") > 3).withColumn("k", first).where("k > 1").withColumns({"x": number(0), "y": number(1)})
    rows = rows.where(F.col("x").isNotNull() & F.col("y").isNotNull() & F.regexp_replace(change, "(%|pp)+$", "").try_cast("double").isNotNull())
    label = F.array_join(F.slice("w", F.lit(1), F.greatest(F.col("k") - 1, F.lit(0))), " ")
    rows = rows.select("ticker", "_at", named(SUMMARY, label, 1).alias("line_item"), named(SUMMARY, label, 0).alias("statement_type"), "x", "y").where("line_item is not null").join(heads, "ticker")
    value = F.when(F.col("b") >= F.col("a"), F.col("y")).otherwise(F.col("x")) * 1e6
    best = rows.groupBy("ticker", F.greatest("a", "b").alias("period_end_date"), "line_item").agg(F.min_by(F.struct("statement_type", value.alias("value")), "_at").alias("r"))
    return best.select("ticker", "period_end_date", F.lit("QUARTERLY").alias("period_type"), "r.statement_type", "line_item", "r.value", F.lit("EGP").alias("currency"))


def press_highlights(docs: DataFrame, metrics=HIGHLIGHTS) -> DataFrame:
    """Figures of a press release, from the first sentence that states them. The period is `ended 31 March 2025`,
    `Q1 2025` or `FY 2025`. docs: ticker, body (HTML)."""
    t = docs.select("ticker", visible_text(F.col("body")).alias("t"))
    day = month_day(F.initcap(F.array_join(F.slice(F.split(group(F.col("t"), r"(?i)\bended\s+((?:on\s+)?\d{1,2}\s+[a-z]+\s+20\d{2})"), r"\s+"), -3, 3), " ")))
    quarter = quarter_end(group(F.col("t"), r"(?i)\bQ([1-4])\s*20\d{2}\b"), group(F.col("t"), r"(?i)\bQ[1-4]\s*(20\d{2})\b"))
    year = F.make_date(group(F.col("t"), r"(?i)\bFY\s*(20\d{2})\b").try_cast("int"), F.lit(12), F.lit(31))
    whole = day.isNull() & quarter.isNull()
    sentences = F.transform(F.split(F.lower("t"), r"\.(?=\s|$)"), words_of)
    first = lambda name, leads, form: F.get(F.filter(F.transform(F.col("s"), lambda w: told(w, name, leads, form)), lambda v: v.isNotNull()), F.lit(0))
    unit = lambda form: form.split(" ")[0]
    found = F.array(*[F.struct(F.lit(item).alias("line_item"), F.lit(kind).alias("statement_type"), first(name, leads, form).alias("value"), F.lit(unit(form)).alias("currency")) for item, kind, name, leads, form in metrics])
    rows = t.withColumn("s", sentences).select("ticker", F.coalesce(day, quarter, year).alias("period_end_date"), F.when(whole, "ANNUAL").otherwise("QUARTERLY").alias("period_type"), F.inline(found))
    return rows.where("period_end_date is not null and value is not null").select(*ROW)


def indicator_groups(docs: DataFrame, series: dict[tuple[int, str], str]) -> DataFrame:
    """{state: true, data: [{filterTranslations: [{locale, name}], data: [{year, month | quarter, value}]}]}; the
    indicator is in the URL, `series` names (indicator, English name) pairs. docs: url, body."""
    shape = "struct<state: boolean, data: array<struct<filterTranslations: array<struct<locale: string, name: string>>, data: array<struct<year: string, month: string, quarter: string, value: string>>>>>"
    indicator = group(F.col("url"), r"[?&]IndicatorId=(\d+)")
    rows = docs.select(indicator.alias("_i"), F.from_json("body", shape).alias("b")).where("b.state").select("_i", F.inline("b.data"))
    english = F.get(F.filter("filterTranslations", lambda x: x["locale"] == "en"), F.lit(0))["name"]
    rows = rows.select(F.concat_ws("|", "_i", english).alias("_key"), F.inline("data"))
    month = F.coalesce(F.col("month").try_cast("int"), F.col("quarter").try_cast("int") * 3, F.lit(12))
    name = named({f"{i}|{n}": s for (i, n), s in series.items()}, F.col("_key")) if series else F.lit(None).cast("string")
    day = F.last_day(F.make_date(F.col("year").try_cast("int"), F.when(month.between(1, 12), month), F.lit(1)))
    return rows.select(name.alias("series_id"), day.alias("observation_date"), F.col("value").try_cast("double").alias("value")).where("series_id is not null and observation_date is not null and value is not null")


def cells(docs: DataFrame, key: str) -> DataFrame:
    """Rows of all HTML tables as arrays: key, table, row, c."""
    t = html_tables(docs, key)
    return t.groupBy(key, "table", "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "text"))), lambda x: x["text"]).alias("c"))


def aggregate_rows(docs: DataFrame, series: dict[str, tuple[str, str]], key: str = "doc") -> DataFrame:
    """Table rows of label, unit, period (`Q1/25`, `Jan/25`), value in millions. series: label -> (series, unit);
    a row of another unit is dropped. docs: key, body."""
    c = lambda k: F.get("c", F.lit(k))
    rows = cells(docs, key).select(key, named(series, c(0), 0).alias("series_id"), named(series, c(0), 1).alias("_unit"), c(1).alias("unit"), period_end(F.regexp_replace(c(2), r"/20(\d\d)$", "/$1")).alias("observation_date"), (bare(c(3)) * 1e6).alias("value"))
    return rows.where("unit = _unit and observation_date is not null and value is not null").select(key, "series_id", "observation_date", "value")


def sector_of_url(url: Column) -> Column:
    """The path element after the exchange's, in words."""
    return F.initcap(F.trim(F.replace(group(url, r"(?i)egx-egyptian-stock-exchange/([a-z0-9-]+)/"), F.lit("-"), F.lit(" "))))


def yearly_table(docs: DataFrame, tickers: list[str]) -> DataFrame:
    """`# ticker=X`, a header with Year, one line a year; unknown columns are left out. Quoted fields
    may hold separators. docs: body (and url for the sector)."""
    ticker = F.upper(F.trim(group(F.col("body"), r"^# ticker=([^\r\n]*)")))
    field = F.lit(r'"[^"]*"|[^,]+|(?<=,)(?=,|$)|^(?=,)')
    split = lambda c: F.transform(F.regexp_extract_all(c, field, 0), lambda x: F.trim(F.replace(x, F.lit('"'), F.lit(""))))
    text = F.split(F.regexp_replace("body", r"\r", ""), "\n")
    rows = docs.select(ticker.alias("ticker"), split(F.get(text, F.lit(1))).alias("_head"), F.posexplode(text).alias("_line", "_text")).where("_line > 1 and trim(_text) <> ''")
    rows = rows.where(F.col("ticker").isin(*[t.upper() for t in tickers]) & F.array_contains("_head", "Year"))
    rows = rows.withColumn("_f", split(F.col("_text"))).withColumn("_year", F.get("_f", (F.array_position("_head", "Year") - 1).cast("int")).try_cast("int")).where("_year is not null")
    rows = rows.select("ticker", "_year", F.inline(F.arrays_zip("_head", "_f")))
    out = rows.select("ticker", F.make_date("_year", F.lit(12), F.lit(31)).alias("period_end_date"), F.lit("ANNUAL").alias("period_type"), named(YEARLY, F.col("_head"), 0).alias("statement_type"), named(YEARLY, F.col("_head"), 1).alias("line_item"), bare(F.col("_f")).alias("value"), F.lit("EGP").alias("currency"))
    return out.where("line_item is not null and value is not null and period_end_date is not null")


def embedded_object(docs: DataFrame, marker: str = "midata.financialStatement =") -> DataFrame:
    """A statement object in a page's script: periods > sections > records > values by year. A value stated
    twice about a thousand apart is one value in two scales and the larger stands; otherwise the last record
    wins and `conflict` marks it. docs: ticker, body. Items of a balance sheet are one per date, whatever the period."""
    shape = "struct<currency: string, periods: array<struct<label: string, sections: array<struct<label: string, records: array<struct<label: string, values: map<string, string>>>>>>>>"
    raw = F.when(F.contains("body", F.lit(marker)), F.substring_index(F.col("body"), marker, -1))
    o = docs.select("ticker", F.from_json(F.trim(raw), shape, {"allowSingleQuotes": "true"}).alias("o"))
    r = o.select("ticker", F.coalesce("o.currency", F.lit("EGP")).alias("currency"), F.posexplode("o.periods").alias("_p", "p"))
    r = r.select("ticker", "currency", "_p", F.col("p.label").alias("period"), F.posexplode("p.sections").alias("_s", "s"))
    r = r.select("ticker", "currency", "_p", "period", "_s", F.col("s.label").alias("section"), F.posexplode("s.records").alias("_r", "r"))
    r = r.select("ticker", "currency", "_p", "period", "_s", "section", "_r", named(EMBEDDED, F.col("r.label")).alias("line_item"), F.posexplode("r.values").alias("_v", "year", "value"))
    annual = F.contains("period", F.lit("Fourth Quarter"))
    month = F.when(F.contains("period", F.lit("First Quarter")), 3).when(F.contains("period", F.lit("Second Quarter")), 6).when(F.contains("period", F.lit("Third Quarter")), 9).otherwise(12)
    kind = F.when(F.contains("section", F.lit("Balance")), BALANCE).when(F.contains("section", F.lit("Cash")), CASH).otherwise(INCOME)
    r = r.select(
        "ticker", "currency", "line_item", F.struct("_p", "_s", "_r", "_v").alias("_seq"), F.last_day(F.make_date(F.col("year").try_cast("int"), month, F.lit(1))).alias("period_end_date"),
        F.when(annual, "ANNUAL").otherwise("QUARTERLY").alias("period_type"), kind.alias("statement_type"), F.col("value").try_cast("double").alias("value"),
    ).where("line_item is not null and period_end_date is not null and value is not null")
    a, record = F.abs("value"), F.struct("period_type", "statement_type", "value", "currency")
    one = r.groupBy("ticker", "period_end_date", "line_item", F.when(~F.col("line_item").isin(*STOCKS), F.col("period_type")).alias("_type")).agg(
        F.count("*").alias("n"), F.max(a).alias("hi"), F.min(F.when(a > 0, a)).alias("lo"), F.max_by(record, a).alias("large"), F.max_by(record, "_seq").alias("last")
    )
    scaled = F.coalesce((F.col("n") > 1) & F.try_divide("hi", "lo").between(900.0, 1100.0), F.lit(False))
    one = one.withColumns({"r": F.when(scaled, F.col("large")).otherwise(F.col("last")), "conflict": (F.col("n") > 1) & ~scaled})
    return one.select("ticker", "period_end_date", "r.period_type", "r.statement_type", "line_item", "r.value", "r.currency", "conflict")


def fiscal_tables(docs: DataFrame) -> DataFrame:
    """HTML tables whose first row holds `FY ...` columns and whose second row their dates. Parentheses
    are negative; a dash or a share is no value. docs: ticker, body."""
    rows = cells(docs, "ticker")
    whole = Window.partitionBy("ticker", "table")
    first = lambda k: F.max(F.when(F.col("_k") == k, F.col("c"))).over(whole)
    rows = rows.withColumn("_k", F.row_number().over(whole.orderBy("row"))).withColumns({"_head": first(1), "_dates": first(2)}).where("_k > 2")
    rows = rows.select("ticker", F.lower(F.regexp_replace(F.trim(F.get("c", F.lit(0))), r"\s+", " ")).alias("_label"), F.inline(F.slice(F.arrays_zip("_head", "_dates", "c"), 2, 1 << 20)))
    item = F.coalesce(*[F.when((F.col("_label") == k) | F.col("_label").startswith(k + " "), v) for k, v in sorted(FISCAL.items(), key=lambda kv: -len(kv[0]))])
    day = month_day(F.concat(group(F.col("_dates"), r"([A-Z][a-z]{2})\s+\d{1,2},\s*\d{4}"), F.lit(" "), group(F.col("_dates"), r"(\d{1,2},)\s*\d{4}"), F.lit(" "), group(F.col("_dates"), r"\d{1,2},\s*(\d{4})")))
    value = F.when(~F.trim("c").endswith("%"), bare(F.replace(F.replace(F.col("c"), F.lit("("), F.lit("-")), F.lit(")"), F.lit(""))))
    kind = F.when(item.isin("cash_and_equivalents", "total_debt", "total_equity"), BALANCE).when(item.isin("operating_cash_flow", "free_cash_flow"), CASH).otherwise(INCOME)
    out = rows.where(F.upper(F.trim("_head")).startswith("FY ")).select("ticker", day.alias("period_end_date"), F.lit("ANNUAL").alias("period_type"), kind.alias("statement_type"), item.alias("line_item"), value.alias("value"), F.lit("EGP").alias("currency"))
    return out.where("line_item is not null and period_end_date is not null and value is not null").distinct()


def market_snapshot(docs: DataFrame, tickers: list[str]) -> DataFrame:
    """{updatedAt, stock: {Symbol, MarketCap, ...}}: one row per known field; missing shares are value over price. docs: body."""
    s = docs.select(F.to_date(F.substring(F.get_json_object("body", "$.updatedAt"), 1, 10)).alias("period_end_date"), F.from_json(F.get_json_object("body", "$.stock"), "map<string, string>").alias("m")).where("m is not null and period_end_date is not null")
    n = lambda f: bare(F.try_element_at("m", F.lit(f)))
    shares = F.coalesce(n("Shares"), F.when(n("LastPrice") > 0, n("MarketCap") / n("LastPrice")))
    facts = F.array(*[F.struct(F.lit(item).alias("line_item"), n(f).alias("value")) for item, f in SNAPSHOT.items()], F.struct(F.lit("shares_outstanding").alias("line_item"), shares.alias("value")))
    rows = s.select(F.upper(F.try_element_at("m", F.lit("Symbol"))).alias("ticker"), "period_end_date", F.inline(facts))
    rows = rows.where(F.col("ticker").isin(*[t.upper() for t in tickers]) & F.col("value").isNotNull())
    return rows.select("ticker", "period_end_date", F.lit("SNAPSHOT").alias("period_type"), F.lit("MARKET_FUNDAMENTALS").alias("statement_type"), "line_item", "value", F.lit("EGP").alias("currency"))


def market_history(docs: DataFrame, tickers: list[str]) -> DataFrame:
    """{symbol, history: [{time, open, high, low, close, volume}]} to bars; incomplete entries drop. docs: body."""
    items = F.from_json(F.get_json_object("body", "$.history"), "array<struct<time: string, open: string, high: string, low: string, close: string, volume: string>>")
    rows = docs.select(F.upper(F.get_json_object("body", "$.symbol")).alias("ticker"), F.inline(items))
    prices = [F.col(c).try_cast("double").alias(c) for c in ("open", "high", "low", "close")]
    rows = rows.where(F.col("ticker").isin(*[t.upper() for t in tickers])).select("ticker", F.to_date(F.try_to_timestamp("time", F.lit("yyyy-MM-dd"))).alias("trade_date"), *prices, F.col("volume").try_cast("double").cast("long").alias("volume"))
    return rows.na.drop()
