"""URL filters by a temporal list join, in DataFrame operations only.

Dated list entries say when a pattern was added to or removed from a list.
They become validity intervals, gathered per pattern into one timeline; every
capture asks the timelines of its own keys for what was active at the moment
it was fetched (an as-of join: equal key, from <= fetched < to). A capture's
keys are its host, each parent domain, each path prefix and each word of the
URL. Among active entries the most specific decides: prefix, host, domain,
word, then the longer pattern; allow beats block.

A timeline is one row, so a hot host joins one row however long its history.
Timelines of at most `broadcast_rows` rows are broadcast; more join by key,
where the adaptive plan splits hot keys.

Null or odd URLs have no keys and match nothing. A null fetch date matches
nothing. Entries with a null in list, kind, pattern or date are ignored; of
entries of one list and pattern on one date a removal wins. Repeated captures
give repeated results. Extra columns of either table are ignored, whatever
their names. Empty lists leave every verdict at none; no captures, no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged

BROADCAST_ROWS = 200_000
#: Fixed: specificity of each kind of pattern.
RANK = {"prefix": 4, "host": 3, "domain": 2, "word": 1}


def intervals(entries: DataFrame) -> DataFrame:
    """list, effect (block or allow), kind, pattern, active from, to (null: still active)."""
    rows = entries.select(
        entries["list"].cast("string").alias("list"), F.lower(entries["effect"].cast("string")).alias("effect"), F.lower(entries["kind"].cast("string")).alias("kind"),
        F.lower(entries["pattern"].cast("string")).alias("pattern"), (F.lower(entries["action"].cast("string")) == "add").alias("on"), entries["at"].cast("date").alias("at"),
    ).where("list is not null and kind is not null and pattern is not null and at is not null")
    key = ["list", "effect", "kind", "pattern"]
    rows = rows.groupBy(*key, "at").agg(F.min(F.coalesce("on", F.lit(False))).alias("on"))
    by = Window.partitionBy(*key).orderBy("at")
    rows = rows.withColumn("was", F.lag("on").over(by)).where("was is null or was <> on")
    return rows.withColumn("to", F.lead("at").over(by)).where("on").select(*key, F.col("at").alias("from"), "to")


def timelines(entries: DataFrame) -> DataFrame:
    """One row per key: its intervals."""
    rank = F.coalesce(*[F.when(F.col("kind") == k, F.lit(r)) for k, r in RANK.items()])
    item = F.struct(F.col("from").alias("from"), F.col("to").alias("to"), rank.alias("rank"), F.length("pattern").alias("size"), (F.col("effect") == "allow").cast("int").alias("allow"), F.col("list").alias("list"))
    return intervals(entries).where(rank.isNotNull()).groupBy(F.concat_ws(":", "kind", "pattern").alias("key")).agg(F.array_sort(F.collect_list(item)).alias("line"))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))


def keys_of(url: Column) -> Column:
    """Every key that a list could name this URL by."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    path = F.rtrim(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://[^/?#]+(/[^?#]*)", 1), F.lit("/"))
    parts = F.split(path, "/")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("domain:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    prefixes = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.concat(F.lit("prefix:"), host, F.array_join(F.slice(parts, 1, i), "/")))
    prefixes = F.when(F.size(parts) >= 2, prefixes).otherwise(F.array().cast("array<string>"))
    words = F.transform(F.filter(F.split(F.lower(url), "[^a-z0-9]+"), lambda w: w != ""), lambda w: F.concat(F.lit("word:"), w))
    every = F.array_distinct(F.concat(F.array(F.concat(F.lit("host:"), host)), domains, prefixes, words))
    return F.when(F.coalesce(host, F.lit("")) == "", F.array().cast("array<string>")).otherwise(every)


def judge(captures: DataFrame, entries: DataFrame, broadcast_rows: int = BROADCAST_ROWS, page_id: str = "page_id", url: str = "url", fetched: str = "fetched_on") -> DataFrame:
    """One row per capture: page_id, url, host, fetched_on, verdict (block, allow,
    none), n_active, list and active_since of the deciding entry."""
    rows = captures.select(captures[page_id].cast("long").alias("page_id"), captures[url].cast("string").alias("url"), captures[fetched].cast("date").alias("fetched_on"))
    own = ["page_id", "url", "fetched_on"]
    rows = rows.groupBy(*own).agg(F.count("*").alias("copies"))
    lines = staged(timelines(entries), "timelines")
    if lines.count() <= broadcast_rows:
        lines = F.broadcast(lines)
    asked = rows.withColumn("key", F.explode_outer(keys_of(F.col("url")))).join(lines, "key", "left")
    live = F.filter(F.coalesce("line", F.array().cast(lines.schema["line"].dataType)), lambda x: (x["from"] <= F.col("fetched_on")) & (x["to"].isNull() | (F.col("fetched_on") < x["to"])))
    asked = asked.withColumn("live", live)
    top = F.array_max(F.transform("live", lambda x: F.struct(x["rank"].alias("rank"), x["size"].alias("size"), x["allow"].alias("allow"), x["list"].alias("list"), x["from"].alias("since"))))
    best = asked.groupBy(*own, "copies").agg(F.max(top).alias("top"), F.sum(F.size("live")).cast("long").alias("n_active"))
    verdict = F.when(F.col("top").isNull(), "none").when(F.col("top.allow") == 1, "allow").otherwise("block")
    again = best.withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return again.select("page_id", "url", F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"), "fetched_on", verdict.alias("verdict"), "n_active", F.col("top.list").alias("list"), F.col("top.since").alias("active_since"))


# ---- the registered query's lists and dates, by rule ---------------------------------------------------------------


def sample_captures(pages: DataFrame) -> DataFrame:
    """The pages with a fetch date drawn from the page_id."""
    return pages.select("page_id", "url", F.expr("date_add(DATE'2021-01-01', cast(pmod(page_id * 37, 1461) as int))").alias("fetched_on"))


def sample_entries(pages: DataFrame) -> DataFrame:
    """Dated entries for the hosts at hand, by the md5 of the host, and three words."""
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host <> ''").distinct()
    hosts = hosts.withColumn("n", F.conv(F.substring(F.md5("host"), 1, 4), 16, 10).cast("int"))
    day = lambda text: F.expr(f"date_add(DATE'2021-01-01', {text})")
    made = [
        ("hosts", "block", "host", F.col("host"), "add", "n % 700", "n % 2 = 0"),
        ("hosts", "block", "host", F.col("host"), "remove", "n % 700 + 30 + n % 400", "n % 2 = 0"),
        ("hosts", "block", "host", F.col("host"), "add", "n % 700 + 700", "n % 4 = 0"),
        ("domains", "block", "domain", F.regexp_extract("host", r"([^.]+\.[^.]+\.[^.]+)$", 1), "add", "n % 900", "n % 3 = 0"),
        ("paths", "allow", "prefix", F.concat("host", F.lit("/en")), "add", "400", "n % 5 < 2"),
        ("paths", "allow", "prefix", F.concat("host", F.lit("/en")), "remove", "1100", "n % 5 < 2"),
    ]
    out = None
    for name, effect, kind, pattern, action, at, where in made:
        part = hosts.where(where).select(F.lit(name).alias("list"), F.lit(effect).alias("effect"), F.lit(kind).alias("kind"), pattern.alias("pattern"), F.lit(action).alias("action"), day(at).alias("at"))
        out = part if out is None else out.unionByName(part)
    words = hosts.sparkSession.sql("SELECT 'words' AS list, 'block' AS effect, 'word' AS kind, pattern, 'add' AS action, at FROM VALUES ('spam', DATE'2021-06-01'), ('pills', DATE'2022-01-15'), ('casino', DATE'2021-01-01') AS t(pattern, at)")
    return out.unionByName(words).where("pattern <> ''")


ORACLE = r"""
WITH p AS (
  SELECT page_id, url, DATE '2021-01-01' + CAST((page_id * 37) % 1461 AS INTEGER) AS fetched_on,
         lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)) AS host,
         rtrim(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://[^/?#]+(/[^?#]*)', 1), '/') AS path,
         row_number() OVER () AS rid
  FROM pages),
h AS (SELECT DISTINCT host, CAST('0x' || substr(md5(host), 1, 4) AS INTEGER) AS n FROM p WHERE host <> ''),
e AS (
  SELECT 'hosts' AS list, 'block' AS effect, 'host' AS kind, host AS pattern, TRUE AS on_, DATE '2021-01-01' + n % 700 AS dt FROM h WHERE n % 2 = 0
  UNION ALL SELECT 'hosts', 'block', 'host', host, FALSE, DATE '2021-01-01' + (n % 700 + 30 + n % 400) FROM h WHERE n % 2 = 0
  UNION ALL SELECT 'hosts', 'block', 'host', host, TRUE, DATE '2021-01-01' + (n % 700 + 700) FROM h WHERE n % 4 = 0
  UNION ALL SELECT 'domains', 'block', 'domain', regexp_extract(host, '([^.]+\.[^.]+\.[^.]+)$', 1), TRUE, DATE '2021-01-01' + n % 900 FROM h WHERE n % 3 = 0
  UNION ALL SELECT 'paths', 'allow', 'prefix', host || '/en', TRUE, DATE '2021-01-01' + 400 FROM h WHERE n % 5 < 2
  UNION ALL SELECT 'paths', 'allow', 'prefix', host || '/en', FALSE, DATE '2021-01-01' + 1100 FROM h WHERE n % 5 < 2
  UNION ALL SELECT 'words', 'block', 'word', w, TRUE, d FROM (VALUES ('spam', DATE '2021-06-01'), ('pills', DATE '2022-01-15'), ('casino', DATE '2021-01-01')) AS t(w, d)),
d AS (SELECT list, effect, kind, pattern, dt, bool_and(on_) AS on_ FROM e WHERE pattern <> '' GROUP BY ALL),
c AS (SELECT *, lag(on_) OVER (PARTITION BY list, effect, kind, pattern ORDER BY dt) AS was FROM d),
i AS (SELECT *, lead(dt) OVER (PARTITION BY list, effect, kind, pattern ORDER BY dt) AS til FROM c WHERE was IS NULL OR was <> on_),
a AS (SELECT list, effect, kind, pattern, dt, til,
        CASE kind WHEN 'prefix' THEN 4 WHEN 'host' THEN 3 WHEN 'domain' THEN 2 ELSE 1 END AS rank FROM i WHERE on_),
k AS (
  SELECT rid, 'host' AS kind, host AS pattern FROM p WHERE host <> ''
  UNION SELECT rid, 'domain', array_to_string(string_split(host, '.')[CAST(g AS BIGINT):], '.') FROM p, unnest(range(1, len(string_split(host, '.')) + 1)) AS t(g) WHERE host <> ''
  UNION SELECT rid, 'prefix', host || array_to_string(string_split(path, '/')[1:CAST(g AS BIGINT)], '/') FROM p, unnest(range(2, len(string_split(path, '/')) + 1)) AS t(g) WHERE host <> ''
  UNION SELECT rid, 'word', w FROM (SELECT rid, unnest(regexp_split_to_array(lower(url), '[^a-z0-9]+')) AS w FROM p WHERE host <> '') WHERE w <> ''),
m AS (
  SELECT p.rid, a.*, row_number() OVER (PARTITION BY p.rid ORDER BY rank DESC, length(a.pattern) DESC, (effect = 'allow') DESC, list DESC, dt DESC) AS best,
         count(*) OVER (PARTITION BY p.rid) AS n_active
  FROM p JOIN k ON k.rid = p.rid JOIN a ON a.kind = k.kind AND a.pattern = k.pattern AND a.dt <= p.fetched_on AND (a.til IS NULL OR p.fetched_on < a.til))
SELECT p.page_id, p.url, p.host, CAST(p.fetched_on AS VARCHAR) AS fetched_on, coalesce(m.effect, 'none') AS verdict, coalesce(m.n_active, 0) AS n_active, m.list, CAST(m.dt AS VARCHAR) AS active_since
FROM p LEFT JOIN m ON m.rid = p.rid AND m.best = 1
"""
