"""Raw documents to typed rows: CSV, JSON, RSS and HTML layouts of data providers.

A parser takes a DataFrame with the raw text in `body` (and whatever columns
should travel along) and returns one row per record. Lines and elements that do
not parse give no row; `rejected` counts them where a layout has lines.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY_FORMATS = ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd")


def any_day(text: Column) -> Column:
    """The first of the usual feed formats that fits, as a date; a weekday before it is ignored."""
    bare = F.regexp_replace(text, r"^\w+, ", "")
    return F.coalesce(*[F.to_date(F.try_to_timestamp(bare, F.lit(f))) for f in DAY_FORMATS])


def lines(docs: DataFrame) -> DataFrame:
    """Each line of each document with its number (from 0) and comma-separated fields."""
    cells = docs.select("*", F.posexplode(F.split("body", r"\r?\n")).alias("line", "_text")).where("trim(_text) <> ''").drop("body")
    return cells.withColumn("f", F.split("_text", ",")).drop("_text")


def number(text: Column) -> Column:
    """A number with separators, parentheses for negatives, K, M, B for scale; a dash or a dot is null."""
    t = F.upper(F.regexp_replace(F.trim(text), r"[,\s$%]", ""))
    scale = F.when(t.endswith("K"), 1e3).when(t.endswith("M"), 1e6).when(t.endswith("B"), 1e9).otherwise(1.0)
    sign = F.when(t.startswith("("), -1.0).otherwise(1.0)
    return F.try_to_number(F.nullif(F.regexp_extract(t, r"^\(?([-+]?\d*\.?\d+)[KMB]?\)?$", 1), F.lit("")), F.lit("S999999999999999D999999")).cast("double") * scale * sign


def fred(docs: DataFrame) -> DataFrame:
    """DATE,<SERIES> lines; a single dot is missing."""
    head = docs.withColumn("series_id", F.trim(F.regexp_extract("body", r"(?i)^[^,\n]+,([^\r\n,]+)", 1)))
    rows = lines(head).where("line > 0").select("series_id", F.to_date(F.try_to_timestamp(F.get("f", F.lit(0)), F.lit("yyyy-MM-dd"))).alias("observation_date"), F.get("f", F.lit(1)).try_cast("double").alias("value"))
    return rows.where("observation_date is not null and value is not null")


def rejected(docs: DataFrame) -> DataFrame:
    """Lines of a two-column series layout that gave no observation."""
    rows = lines(docs).where("line > 0")
    bad = F.to_date(F.try_to_timestamp(F.get("f", F.lit(0)), F.lit("yyyy-MM-dd"))).isNull() | F.get("f", F.lit(1)).try_cast("double").isNull()
    return rows.where(bad).select("line", F.array_join("f", ",").alias("text"))


def stooq(docs: DataFrame) -> DataFrame:
    """Date,Open,High,Low,Close,Volume lines; a blank volume is zero. docs: ticker, body."""
    f = lambda k: F.get("f", F.lit(k))
    rows = lines(docs).where("line > 0").select(
        "ticker", F.to_date(F.try_to_timestamp(f(0), F.lit("yyyy-MM-dd"))).alias("trade_date"), *[f(k).try_cast("double").alias(n) for k, n in enumerate(("open", "high", "low", "close"), 1)],
        F.coalesce(F.nullif(F.trim(f(5)), F.lit("")).try_cast("double").cast("long"), F.lit(0).cast("long")).alias("volume"),
    )
    return rows.where("trade_date is not null and close is not null")


def world_bank(docs: DataFrame) -> DataFrame:
    """[meta, [observation, ...]]; a year is its last day."""
    items = F.from_json(F.get_json_object("body", "$[1]"), "array<struct<indicator: struct<id: string>, countryiso3code: string, date: string, value: double>>")
    rows = docs.select(F.inline(items))
    return rows.where("value is not null and date rlike '^[0-9]{4}$'").select(F.col("indicator.id").alias("series_id"), F.make_date(F.col("date").cast("int"), F.lit(12), F.lit(31)).alias("observation_date"), "value")


def un_sdg(docs: DataFrame, series: dict[str, str]) -> DataFrame:
    """{data: [...]} with a whitelist of series codes and their names."""
    items = F.from_json(F.get_json_object("body", "$.data"), "array<struct<series: string, timePeriodStart: double, value: string>>")
    name = F.element_at(F.create_map(*[F.lit(x) for kv in series.items() for x in kv]), F.col("series")) if series else F.lit(None).cast("string")
    rows = docs.select(F.inline(items)).where(F.col("series").isin(*series))
    return rows.select(name.alias("series_id"), F.make_date(F.col("timePeriodStart").cast("int"), F.lit(12), F.lit(31)).alias("observation_date"), F.col("value").try_cast("double").alias("value")).where("value is not null")


def periods(docs: DataFrame) -> DataFrame:
    """[{series, year, month | quarter, value}] with each period's last day; a whole year ends in December."""
    items = F.from_json("body", "array<struct<series: string, year: int, month: int, quarter: int, value: double>>")
    rows = docs.select(F.inline(items)).where("value is not null and year is not null")
    month = F.coalesce("month", F.col("quarter") * 3, F.lit(12))
    return rows.select(F.col("series").alias("series_id"), F.last_day(F.make_date("year", month, F.lit(1))).alias("observation_date"), "value")


def period_end(text: Column) -> Column:
    """`Q1/25`, `Jan/25`, `2025` and `1Q25` as the last day of the period."""
    quarter = F.coalesce(F.nullif(F.regexp_extract(text, r"(?i)^Q([1-4])/\d{2}$", 1), F.lit("")), F.nullif(F.regexp_extract(text, r"(?i)^([1-4])Q\d{2}$", 1), F.lit("")))
    year = 2000 + F.regexp_extract(text, r"(\d{2})$", 1).try_cast("int")
    by_quarter = F.last_day(F.make_date(year, quarter.try_cast("int") * 3, F.lit(1)))
    by_month = F.last_day(F.to_date(F.try_to_timestamp(F.concat(F.lit("1 "), F.initcap(text)), F.lit("d MMM/yy"))))
    by_year = F.make_date(F.nullif(F.regexp_extract(text, r"^(\d{4})$", 1), F.lit("")).try_cast("int"), F.lit(12), F.lit(31))
    return F.when(quarter.isNotNull(), by_quarter).when(text.rlike(r"^\d{4}$"), by_year).otherwise(by_month)


def rss(docs: DataFrame) -> DataFrame:
    """RSS 2.0 items and Atom entries: headline, link, published_at."""
    body = F.regexp_replace(F.regexp_replace("body", r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"), r"<(/?)(?:\w+:)(\w+)", "<$1$2")
    entry = F.regexp_extract_all(body, F.lit(r"(?is)<(?:item|entry)\b[^>]*>(.*?)</(?:item|entry)>"), 1)
    rows = docs.withColumn("e", F.explode(entry)).drop("body")
    tag = lambda n: F.trim(F.regexp_extract("e", rf"(?is)<{n}\b[^>]*>(.*?)</{n}>", 1))
    link = F.coalesce(F.nullif(tag("link"), F.lit("")), F.nullif(F.regexp_extract("e", r'(?is)<link\b[^>]*href="([^"]*)"', 1), F.lit("")))
    day = F.coalesce(*[any_day(F.nullif(tag(n), F.lit(""))) for n in ("pubDate", "published", "updated", "date")])
    unescaped = tag("title")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        unescaped = F.replace(unescaped, F.lit(entity), F.lit(sign))
    out = rows.select(*[c for c in rows.columns if c != "e"], unescaped.alias("headline"), link.alias("link"), day.alias("published_at"))
    return out.where("headline <> '' and published_at is not null")


def gdelt(docs: DataFrame) -> DataFrame:
    """{articles: [...]}: one row per URL, the first seen."""
    items = F.from_json(F.get_json_object("body", "$.articles"), "array<struct<url: string, title: string, seendate: string, domain: string>>")
    rows = docs.select(F.inline(items)).where("url is not null and title is not null")
    rows = rows.select("url", F.col("title").alias("headline"), F.col("domain").alias("source"), F.to_date(F.try_to_timestamp("seendate", F.lit("yyyyMMdd'T'HHmmss'Z'"))).alias("published_at"))
    return rows.groupBy("url").agg(F.min_by(F.struct("headline", "source", "published_at"), F.struct("published_at", "headline")).alias("r")).select("url", "r.*")


def date_windows(start: str, end: str, days: int) -> Column:
    """Consecutive windows of at most `days` days that cover a range."""
    starts = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.make_interval(days=F.lit(days)))
    return F.transform(starts, lambda d: F.struct(d.alias("start"), F.least(F.date_add(d, days - 1), F.lit(end).cast("date")).alias("end")))


def zipped_arrays(docs: DataFrame) -> DataFrame:
    """{t: [epoch], o, h, l, c, v}: parallel arrays to bars. docs: ticker, body."""
    body = F.from_json("body", "struct<t: array<long>, o: array<double>, h: array<double>, l: array<double>, c: array<double>, v: array<double>>")
    z = F.arrays_zip("b.t", "b.o", "b.h", "b.l", "b.c", "b.v")
    rows = docs.select("ticker", body.alias("b")).select("ticker", F.explode(z).alias("z"))
    return rows.select("ticker", F.to_date(F.timestamp_seconds("z.t")).alias("trade_date"), F.col("z.o").alias("open"), F.col("z.h").alias("high"), F.col("z.l").alias("low"), F.col("z.c").alias("close"), F.col("z.v").cast("long").alias("volume")).where("close is not null")


def one_line_item(rows: DataFrame, low: float = 900.0, high: float = 1100.0) -> DataFrame:
    """Records of one (ticker, period, item) that differ by about a thousand are one value in
    two scales: keep the larger; else the last one wins and the row is flagged. rows: seq, value."""
    a = F.abs("value")
    out = rows.where("value is not null").groupBy("ticker", "period_end_date", "line_item").agg(F.max(a).alias("hi"), F.min(a).alias("lo"), F.max_by("value", a).alias("large"), F.max_by("value", "seq").alias("last"), F.countDistinct("value").alias("n"))
    scaled = (F.col("n") > 1) & F.try_divide("hi", "lo").between(low, high)
    return out.select("ticker", "period_end_date", "line_item", F.when(scaled, F.col("large")).otherwise(F.col("last")).alias("value"), ((F.col("n") > 1) & ~scaled).alias("conflict"))


def find_column(header: list[str], hints: tuple[str, ...]) -> int | None:
    """The first column whose name holds a hint, in order of the hints."""
    low = [h.strip().lower() for h in header]
    return next((k for hint in hints for k, name in enumerate(low) if hint in name), None)


class _Tables(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables, self.cell = [], None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables and self.tables[-1]:
            self.cell = []

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None:
            self.tables[-1][-1].append(" ".join("".join(self.cell).split()))
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


def html_tables(docs: DataFrame, key: str) -> DataFrame:
    """Cells of every table: key, table, row, col, text."""

    def read(parts):
        for part in parts:
            out = []
            for k, body in zip(part[key], part["body"]):
                p = _Tables()
                p.feed(body or "")
                out += [(k, t, r, c, x) for t, rows in enumerate(p.tables) for r, cells in enumerate(rows) for c, x in enumerate(cells)]
            yield pd.DataFrame(out, columns=[key, "table", "row", "col", "text"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "body").mapInPandas(read, f"`{key}` {kind}, table int, row int, col int, text string")


def links(docs: DataFrame, body: str = "body") -> DataFrame:
    """href targets and their texts, without Python."""
    pair = F.regexp_extract_all(body, F.lit(r'(?is)<a\b[^>]*?href\s*=\s*["\']?([^"\'\s>]+)["\']?[^>]*>(.*?)</a>'), 0)
    rows = docs.select(*[c for c in docs.columns if c != body], F.posexplode(pair).alias("position", "_a"))
    target = F.regexp_extract("_a", r'(?is)href\s*=\s*["\']?([^"\'\s>]+)', 1)
    text = F.trim(F.regexp_replace(F.regexp_replace("_a", r"(?s)<[^>]*>", " "), r"\s+", " "))
    return rows.select(*[c for c in rows.columns if c != "_a"], target.alias("href"), text.alias("text"))


def visible_text(html: Column) -> Column:
    """Markup and scripts out, white space folded."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


#: Fixed: entities that occur in card layouts, `&` last, and phrases of a headline in the order in which they are tried.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
HEADLINE_WORDS = (
    ("STOCK_SPLIT", ("stock split", "share split")), ("CAPITAL_INCREASE", ("capital increase", "rights issue")), ("BUYBACK", ("buyback", "treasury shares")),
    ("MANAGEMENT_CHANGE", ("management change", "board appoints", "appoints new ceo", "resignation")), ("DELISTING", ("delisting", "delisted")), ("MERGER", ("merge",)), ("ACQUISITION", ("acquisition", "to acquire")),
    ("DIVIDEND", ("dividend",)), ("GUIDANCE", ("guidance",)), ("EARNINGS", ("quarterly results", "annual results", "financial results", "net income", "earnings", "نتائج الأعمال", "نتائج اعمال", "القوائم المالية", "صافي الربح")),
    ("DIVIDEND", ("توزيع نقدي", "توزيعات نقدية")), ("CAPITAL_INCREASE", ("زيادة رأس المال",)), ("STOCK_SPLIT", ("تجزئة السهم",)), ("ACQUISITION", ("استحواذ",)), ("MERGER", ("اندماج",)),
)


def headline_event(text: Column) -> Column:
    """The kind of corporate event a headline names, or null."""
    low, out = F.lower(text), F.lit(None).cast("string")
    for kind, phrases in reversed(HEADLINE_WORDS):
        out = F.when(F.exists(F.array(*map(F.lit, phrases)), lambda p: low.contains(p)), kind).otherwise(out)
    return out


def plain_text(html: Column) -> Column:
    """Tags out, entities decoded, runs of white space one blank."""
    out = F.regexp_replace(html, r"<[^>]*>", " ")
    for entity, sign in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(out, r"[\x20\x09-\x0D]+", " "))


def disclosure_cards(docs: DataFrame, tickers: DataFrame, exchange: str = "egx.com.eg", by_text: bool = True) -> DataFrame:
    """Bulletin pages (url, body) of cards: published_at, ticker, headline, source_url, event_type, text.

    A page is cut where a card's title begins. The title names the headline, the next paragraph the text, the muted line the day. A
    card needs a day and, in title or text, a code with `.CA` whose ticker is among `tickers` (ticker, upper
    case); others give no row. The source is an attachment on the host of the exchange, else the page. event_type follows
    from the phrases of headline and text, or of the headline alone (`by_text` false, where texts are foreign to the headline), and
    is null where none fits. A null body has no cards."""
    cut = F.split(F.col("body"), r'(?i)<h5\s+class="card-title"\s*>')
    rows = docs.select("url", F.explode(F.slice(cut, 2, 1_000_000)).alias("card"))
    after = F.regexp_extract("card", r"(?is)</h5\s*>(.*)$", 1)
    block = F.regexp_extract(after, r'(?is)<p\s+class="card-text"\s*>(.*?)</p>', 1)
    day = plain_text(F.regexp_extract(after, r'(?is)<small\s+class="text-muted"\s*>(.*?)</small>', 1))
    rows = rows.select("url", plain_text(F.substring_index("card", "</h5>", 1)).alias("headline"), block.alias("block"), plain_text(block).alias("text"), F.to_date(F.try_to_timestamp(F.substring_index(day, " ", 1), F.lit("yyyy-MM-dd"))).alias("published_at"))
    both = F.concat_ws(" ", "headline", "text")
    rows = rows.withColumn("ticker", F.upper(F.regexp_extract(both, r"(?i)\b([A-Z][A-Z0-9]{1,9})\.CA\b", 1)))
    own = F.regexp_extract("block", rf"""(?i)href=["'](https?://(?:www\.)?{re.escape(exchange)}/[^"']+)""", 1)
    rows = rows.where("published_at is not null").withColumn("source_url", F.when(own != "", plain_text(own)).otherwise(F.col("url"))).withColumn("event_type", headline_event(both if by_text else F.col("headline")))
    return rows.join(tickers.select("ticker").distinct(), "ticker", "left_semi").select("published_at", "ticker", "headline", "source_url", "event_type", "text")
