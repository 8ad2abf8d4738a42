"""Statement layouts against rows written down by hand."""

import datetime
import json

from tidemark.sources import statements as s

D = datetime.date


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_earnings_table_takes_the_later_quarter_and_the_first_row(spark):
    text = "Intro\nEGP mn 1Q25 1Q26 YoY Change\nRevenue 1,000.5 1,200.0 20.0%\nGross Profit 10.0 12.0 +20%\nRevenues 1.0 2.0 1%\nMargin x 1.0 2.0 1pp\nUnknown Label 1.0 2.0 3%\nNet Profit 5.0 4.0 -20.0%\n"
    docs = spark.createDataFrame([("AAA", text), ("BBB", "no header\nRevenue 1.0 2.0 3%"), ("CCC", None), ("DDD", text.replace("1Q25 1Q26", "4Q25 3Q25").replace("YoY Change", "Chg %"))], "ticker string, body string")
    got = rows(s.earnings_table(docs), "ticker", "period_end_date", "line_item", "value")
    a = [("gross_profit", 12e6), ("net_income", 4e6), ("revenue", 1200e6)]
    d = [("gross_profit", 10e6), ("net_income", 5e6), ("revenue", 1000.5e6)]
    assert got == [("AAA", D(2026, 3, 31), *x) for x in a] + [("DDD", D(2025, 12, 31), *x) for x in d]


def test_press_highlights(spark):
    one = "<p>For the period ended 30 June 2025. Total revenue grew 30% YoY to EGP 50.5 bn. EBITDA rose 12% YoY to EGP 20 bn with a 15% net margin.</p><script>EBITDA to EGP 1 bn</script>Net profit reached EGP 7.5bn. Net debt/EBITDA stood at 1.4x"
    two = "FY 2024 results: Revenue of USD 3,250.7 million, EBITDA of USD 210.1 million, and net profit attributable to shareholders of USD 1,100 million"
    docs = spark.createDataFrame([("A", one), ("B", "Total revenue to EGP 1 bn without a period"), ("C", None)], "ticker string, body string")
    assert rows(s.press_highlights(docs), "period_end_date", "period_type", "line_item", "value") == sorted(
        (D(2025, 6, 30), "QUARTERLY", k, v) for k, v in {"revenue": 50.5e9, "ebitda": 20e9, "net_income": 7.5e9, "revenue_growth_yoy": 30.0, "ebitda_growth_yoy": 12.0, "net_margin": 15.0, "net_debt_to_ebitda": 1.4}.items()
    )
    got = s.press_highlights(spark.createDataFrame([("B", two), ("C", two.replace("FY 2024", "Q3 2024"))], "ticker string, body string"), s.SENTENCE)
    want = [("ebitda", 210.1e6), ("net_income_attributable", 1100e6), ("revenue", 3250.7e6)]
    assert [(t, d, k, i, round(v)) for t, d, k, i, v in rows(got, "ticker", "period_end_date", "period_type", "line_item", "value")] == [("B", D(2024, 12, 31), "ANNUAL", i, round(v)) for i, v in want] + [("C", D(2024, 9, 30), "QUARTERLY", i, round(v)) for i, v in want]


def test_indicator_groups(spark):
    body = json.dumps({"state": True, "data": [{"filterTranslations": [{"locale": "ar", "name": "x"}, {"locale": "en", "name": "Total"}], "data": [{"year": 2024, "month": 2, "value": "1.5"}, {"year": "2024", "quarter": 3, "value": 2}, {"year": 2023, "value": 3}, {"year": 2024, "month": 13, "value": 9}, {"year": "x", "value": 1}]}, {"filterTranslations": [{"locale": "en", "name": "Other"}], "data": [{"year": 2020, "value": 1}]}]})
    docs = spark.createDataFrame([("http://x/?a=1&IndicatorId=7", body), ("http://x/", body), ("http://x/?IndicatorId=7", body.replace("true", "false")), ("http://x/?IndicatorId=7", "{broken")], "url string, body string")
    assert rows(s.indicator_groups(docs, {(7, "Total"): "cpi"}), "series_id", "observation_date", "value") == [("cpi", D(2023, 12, 31), 3.0), ("cpi", D(2024, 2, 29), 1.5), ("cpi", D(2024, 9, 30), 2.0)]


def test_aggregate_rows(spark):
    html = "<table><tr><td>Reserves</td><td>Mill. $</td><td>Jan/25</td><td>1,234.5</td></tr><tr><td>Debt</td><td>Mill. $</td><td>Q3/2024</td><td>10</td></tr><tr><td>Debt</td><td>LE</td><td>Q1/24</td><td>10</td></tr><tr><td>Reserves</td></tr></table>"
    got = s.aggregate_rows(spark.createDataFrame([(1, html), (2, None)], "doc int, body string"), {"Reserves": ("res", "Mill. $"), "Debt": ("debt", "Mill. $")})
    assert rows(got, "series_id", "observation_date", "value") == [("debt", D(2024, 9, 30), 10e6), ("res", D(2025, 1, 31), 1234.5e6)]


def test_yearly_table_and_sector(spark):
    body = '# ticker=abc\nYear,Revenue,Ignored,EPS,FCF\n2023,"1,000",5,,2.5\n2024,7,5,0.5,n/a\nbad,1,1,1,1\n'
    docs = spark.createDataFrame([(body,), (body.replace("abc", "zzz"),), ("Year,Revenue\n2024,1",), ("# ticker=abc\nRevenue\n1",)], "body string")
    assert rows(s.yearly_table(docs, ["ABC"]), "ticker", "period_end_date", "statement_type", "line_item", "value") == [
        ("ABC", D(2023, 12, 31), "CASH_FLOW", "free_cash_flow", 2.5), ("ABC", D(2023, 12, 31), "INCOME_STATEMENT", "revenue", 1000.0), ("ABC", D(2024, 12, 31), "INCOME_STATEMENT", "eps_basic", 0.5), ("ABC", D(2024, 12, 31), "INCOME_STATEMENT", "revenue", 7.0),
    ]
    u = spark.createDataFrame([("https://h/egx-egyptian-stock-exchange/real-estate/abc.csv",), ("https://h/x",)], "url string")
    assert [r[0] for r in u.select(s.sector_of_url(u["url"])).collect()] == ["Real Estate", None]


def test_embedded_object(spark):
    o = {"currency": None, "periods": [
        {"label": "First Quarter", "sections": [{"label": "Income", "records": [{"label": "Gross Profit", "values": {"2024": 5, "2023": None, "x": 1}}, {"label": "Other", "values": {"2024": 1}}]}, {"label": "Balance Sheet", "records": [{"label": "Total Assets", "values": {"2024": 2000}}]}]},
        {"label": "Fourth Quarter", "sections": [{"label": "Balance Sheet", "records": [{"label": "Total Assets", "values": {"2024": 7}}]}, {"label": "Cash", "records": [{"label": "Net Change In Cash & Cash Equivalents", "values": {"2024": -3}}]}]},
        {"label": "Annual", "sections": [{"label": "Balance Sheet", "records": [{"label": "Total Assets", "values": {"2024": 7000}}]}]},
        {"label": "First Quarter", "sections": [{"label": "Balance Sheet", "records": [{"label": "Total Assets", "values": {"2024": 2500}}]}]},
    ]}
    page = "<script>var a = {}; midata.financialStatement = " + json.dumps(o).replace('"', "'") + "; midata.other = {'a': 1};</script>"
    docs = spark.createDataFrame([("A", page), ("B", "no object"), ("C", None), ("D", "midata.financialStatement = {broken")], "ticker string, body string")
    assert rows(s.embedded_object(docs), "ticker", "period_end_date", "period_type", "statement_type", "line_item", "value", "currency", "conflict") == [
        ("A", D(2024, 3, 31), "QUARTERLY", "BALANCE_SHEET", "total_assets", 2500.0, "EGP", True), ("A", D(2024, 3, 31), "QUARTERLY", "INCOME_STATEMENT", "gross_profit", 5.0, "EGP", False),
        ("A", D(2024, 12, 31), "ANNUAL", "CASH_FLOW", "cash_and_equivalents_change", -3.0, "EGP", False), ("A", D(2024, 12, 31), "QUARTERLY", "BALANCE_SHEET", "total_assets", 7000.0, "EGP", False),
    ]


def test_fiscal_tables(spark):
    html = "<table><tr><th>Fiscal Year</th><th>TTM</th><th>FY 2024</th><th>FY 2023</th></tr><tr><th>Period Ending</th><th>Mar '25 Mar 31, 2025</th><th>Dec '24 Dec 31, 2024</th><th>Dec '23 Dec 31, 2023</th></tr><tr><td>Revenue Revenue Growth</td><td>9</td><td>1,200.5</td><td>-</td></tr><tr><td>Net Income</td><td>1</td><td>(30)</td><td>12%</td></tr><tr><td>Total Debt</td><td>1</td><td>5</td></tr><tr><td>Mystery</td><td>1</td><td>5</td><td>5</td></tr></table><table><tr><td>FY 2024</td></tr></table>"
    got = s.fiscal_tables(spark.createDataFrame([("A", html), ("B", None)], "ticker string, body string"))
    assert rows(got, "period_end_date", "statement_type", "line_item", "value") == [(D(2024, 12, 31), "BALANCE_SHEET", "total_debt", 5.0), (D(2024, 12, 31), "INCOME_STATEMENT", "net_income", -30.0), (D(2024, 12, 31), "INCOME_STATEMENT", "revenue", 1200.5)]


def test_market_snapshot_and_history(spark):
    snap = json.dumps({"updatedAt": "2025-05-01T10:00:00", "stock": {"Symbol": "aa", "MarketCap": "1,000", "PE": 7, "EPS": "", "Beta": None, "LastPrice": 4}})
    hist = json.dumps({"symbol": "aa", "history": [{"time": "2025-01-02", "open": 1, "high": "2", "low": 1, "close": 1.5, "volume": "10.0"}, {"time": "bad", "open": 1, "high": 2, "low": 1, "close": 1, "volume": 1}, {"time": "2025-01-03", "open": 1}]})
    docs = spark.createDataFrame([(snap,), (hist,), ("{broken",), (None,), (snap.replace("aa", "zz"),)], "body string")
    assert rows(s.market_snapshot(docs, ["AA"]), "ticker", "period_end_date", "line_item", "value") == [("AA", D(2025, 5, 1), k, v) for k, v in (("market_cap", 1000.0), ("market_pe", 7.0), ("shares_outstanding", 250.0))]
    assert rows(s.market_history(docs, ["AA"]), "ticker", "trade_date", "open", "high", "low", "close", "volume") == [("AA", D(2025, 1, 2), 1.0, 2.0, 1.0, 1.5, 10)]
