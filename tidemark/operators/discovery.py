"""Finding and judging sources: site maps, interface links, lasting addresses, archives, likely domains, verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls

#: Fixed: endings tried for a name without a known domain, days of archive that score fully, scores of thin archives.
LOCAL_ENDINGS, ENDINGS = {"EG": (".com.eg", ".gov.eg")}, (".com", ".org", ".net")
FULL_SPAN_DAYS, ONE_DAY_SCORE, ONE_POINT_SCORE = 365, 0.2, 0.4
#: Fixed: how grave a verdict is.
GRAVITY = {"PASS": 0, "BLOCKED": 1, "PARTIAL": 2, "FAIL": 3}
#: Fixed: types of feeds, links to documents that make a page a repository.
FEED_TYPES, LEAST_DOCUMENTS = ("application/rss+xml", "application/atom+xml", "application/feed+json"), 3


def sitemap_urls(maps: DataFrame, page: str = "page_url", body: str = "body") -> DataFrame:
    """Addresses that site maps name, each once a map: page, url, read_as. Relative entries are resolved against
    the map's own address; entries without a scheme and a host give no row. A null body has none."""
    entry = F.explode(F.regexp_extract_all(F.col(body), F.lit(r"(?is)<loc\b[^>]*>(.*?)</loc>"), 1))
    rows = maps.select(F.col(page).alias("page"), entry.alias("loc"))
    rows = rows.withColumn("loc", F.regexp_replace("loc", r"^\s+|\s+$", "")).where("loc <> ''").withColumn("url", urls.resolved(F.col("page"), F.col("loc")))
    return rows.where(F.col("url").rlike("^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+")).select("page", "url", urls.read_as(F.col("url")).alias("read_as")).distinct()


def api_links(links: DataFrame, page: str = "page_url", href: str = "href") -> DataFrame:
    """Links to descriptions of programming interfaces, each target once a page: page, url."""
    known = F.exists(F.array(*map(F.lit, urls.API_MARKS)), lambda m: F.lower(F.col(href)).contains(m))
    return links.where(known).select(F.col(page).alias("page"), urls.resolved(F.col(page), F.col(href)).alias("url")).distinct()


def page_candidates(pages: DataFrame, page: str = "page_url", html: str = "html") -> DataFrame:
    """Sources that pages lead to: page, url, method, read_as; each target once a page and method.

    FEED: alternate links of a feed type. DATASET: links to structured files. API: links to interface descriptions.
    REPOSITORY: the page itself, where at least three of its links are PDF files. Links are resolved against
    the page; attributes may stand in any order. A null html has no links. Nothing is gathered by host."""
    p = pages.select(F.col(page).alias("page"), F.col(html).alias("body"))
    attribute = lambda of, name: F.regexp_extract(of, rf"""(?is)\b{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", 0)
    bare = lambda of, name: F.regexp_replace(F.regexp_replace(attribute(of, name), r"(?is)^\w+\s*=\s*", ""), r"""^["']|["']$""", "")
    tags = p.select("page", F.explode(F.regexp_extract_all("body", F.lit(r"(?is)<(?:a|link)\s[^>]*>"), 0)).alias("tag"))
    found = tags.select("page", F.lower(F.substring("tag", 2, 1)).alias("kind"), bare(F.col("tag"), "href").alias("href"), F.lower(bare(F.col("tag"), "rel")).alias("rel"), F.lower(bare(F.col("tag"), "type")).alias("type")).where("href <> ''")
    target = urls.resolved(F.col("page"), F.col("href"))
    anchor = F.col("kind") == "a"
    row = lambda test, method, how: F.when(test, F.struct(F.lit(method).alias("method"), how.alias("read_as")))
    of_path = urls.read_as(F.col("href"))
    kinds = [
        row((F.col("kind") == "l") & F.col("rel").contains("alternate") & F.col("type").isin(*FEED_TYPES), "FEED", F.lit("RSS_FEED")),
        row(anchor & (of_path != "HTML_SCRAPE"), "DATASET", of_path),
        row(anchor & F.exists(F.array(*map(F.lit, urls.API_MARKS)), lambda m: F.lower(F.col("href")).contains(m)), "API", F.lit("JSON_API")),
    ]
    direct = found.select("page", target.alias("url"), F.inline(F.array_compact(F.array(*kinds)))).distinct()
    documents = found.where(anchor & F.lower(F.substring_index("href", "?", 1)).endswith(".pdf")).groupBy("page").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_DOCUMENTS)
    return direct.unionByName(documents.select("page", F.col("page").alias("url"), F.lit("REPOSITORY").alias("method"), F.lit("PDF_DOWNLOAD").alias("read_as")))


def stability(targets: DataFrame, probes: DataFrame) -> DataFrame:
    """How lasting each address looks: url, score, n_probes, insufficient.

    targets: url; probes: url, reachable, status. The score is the mean of the shape and of the share of the
    commonest status among reachable probes; without any probe the shape alone, with probes but none reachable 0.
    Fewer than two probes are insufficient, except where probes only failed. Probes are counted per address and status first, so that an
    address with very many of them is no large group."""
    ok = F.coalesce(F.col("reachable"), F.lit(False)) & F.col("status").isNotNull()
    counts = probes.groupBy("url", F.when(ok, F.col("status")).alias("_s")).agg(F.count("*").alias("n"))
    known = F.col("_s").isNotNull()
    seen = counts.groupBy("url").agg(F.sum("n").alias("n_probes"), F.sum(F.when(known, F.col("n"))).alias("good"), F.max(F.when(known, F.col("n"))).alias("mode"))
    rows = targets.select("url").distinct().join(seen, "url", "left").withColumn("shape", urls.shape_score(F.col("url")))
    score = F.when(F.col("n_probes").isNull(), F.col("shape")).when(F.col("good").isNull(), 0.0).otherwise((F.col("shape") + F.col("mode") / F.col("good")) / 2)
    n = F.coalesce("n_probes", F.lit(0))
    return rows.select("url", F.round(score, 6).alias("score"), n.alias("n_probes"), ((n == 0) | ((n < 2) & F.col("good").isNotNull())).alias("insufficient"))


def archive_span(targets: DataFrame, snapshots: DataFrame, closest: DataFrame) -> DataFrame:
    """What an archive holds of each address: url, score, n_snapshots, earliest, latest.

    targets: url; snapshots: url, stamp (yyyyMMdd and more digits; others are left out); closest: url, day (null: none).
    Known stamps decide by the days they span, one point alone scores the fixed share."""
    day = F.to_date(F.try_to_timestamp(F.substring("stamp", 1, 8), F.lit("yyyyMMdd")))
    s = snapshots.select("url", day.alias("day")).where("day is not null").groupBy("url").agg(F.count("*").alias("n"), F.min("day").alias("first"), F.max("day").alias("last"))
    c = closest.where("day is not null").groupBy("url").agg(F.max("day").alias("point"))
    rows = targets.select("url").distinct().join(s, "url", "left").join(c, "url", "left")
    span = F.datediff("last", "first")
    score = F.when(span > 0, F.least(F.lit(1.0), span / FULL_SPAN_DAYS)).when(span == 0, ONE_DAY_SCORE).when(F.col("point").isNotNull(), ONE_POINT_SCORE).otherwise(0.0)
    n = F.coalesce("n", F.when(F.col("point").isNotNull(), 1).otherwise(0)).cast("long")
    return rows.select("url", F.round(score, 6).alias("score"), n.alias("n_snapshots"), F.coalesce("first", "point").alias("earliest"), F.coalesce("last", "point").alias("latest"))


def candidate_domains(orgs: DataFrame) -> DataFrame:
    """Domains to try for each organisation, in order: org_id, position (from 0), domain, origin.

    orgs: org_id, name, country, hints (array; null or empty: guessed from the name without parentheses)."""
    bare = F.regexp_replace(F.lower(F.regexp_replace(F.coalesce("name", F.lit("")), r"\([^)]*\)", "")), "[^a-z0-9]", "")
    known = F.array_distinct(F.coalesce("hints", F.array().cast("array<string>")))
    endings = F.array(*map(F.lit, ENDINGS))
    for country, own in LOCAL_ENDINGS.items():
        endings = F.when(F.col("country") == country, F.array(*map(F.lit, own + ENDINGS))).otherwise(endings)
    guessed = F.transform(endings, lambda e: F.struct(F.concat(bare, e).alias("domain"), F.lit("heuristic").alias("origin")))
    hinted = F.transform(known, lambda h: F.struct(h.alias("domain"), F.lit("hint").alias("origin")))
    listed = orgs.select("org_id", F.posexplode(F.when(F.size(known) > 0, hinted).otherwise(guessed)).alias("position", "d"))
    return listed.select("org_id", "position", "d.domain", "d.origin")


def verdicts(evidence: DataFrame, dimensions: dict[str, int], by: str) -> DataFrame:
    """One verdict per value of `by` and declared dimension: by, dimension, n, failed, verdict.

    evidence: by, dimension, ok (null: not decided yet). A single failure fails a dimension; fewer decided records
    than the dimension asks for block it; undecided ones beside them make it partial."""
    asked = evidence.sparkSession.createDataFrame(list(dimensions.items()), "dimension string, least long")
    n = evidence.groupBy(by, "dimension").agg(F.count("ok").alias("n"), F.count_if(~F.col("ok")).alias("failed"), F.count_if(F.col("ok").isNull()).alias("open"))
    every = evidence.select(by).distinct().withColumn("d", F.explode(F.array(*map(F.lit, dimensions)))).select(by, F.col("d").alias("dimension"))
    rows = every.join(n, [by, "dimension"], "left").fillna(0, ["n", "failed", "open"]).join(F.broadcast(asked), "dimension")
    verdict = F.when(F.col("failed") > 0, "FAIL").when(F.col("n") < F.col("least"), "BLOCKED").when(F.col("open") > 0, "PARTIAL").otherwise("PASS")
    return rows.select(by, "dimension", "n", "failed", verdict.alias("verdict"))


def worst(checks: DataFrame, by: str) -> DataFrame:
    """The gravest verdict of each value of `by`, the checks that have it, and whether the whole can be relied on
    (no: something fails; partially: something is blocked; yes otherwise)."""
    grave = F.element_at(F.create_map(*[F.lit(x) for kv in GRAVITY.items() for x in kv]), F.col("verdict"))
    named = lambda v: F.array_join(F.array_sort(F.collect_set(F.when(F.col("verdict") == v, F.col("dimension")))), ",")
    rows = checks.groupBy(by).agg(F.max_by("verdict", grave).alias("overall"), named("FAIL").alias("failing"), named("BLOCKED").alias("blocked"))
    return rows.withColumn("reliable", F.when(F.col("failing") != "", "no").when(F.col("blocked") != "", "partially").otherwise("yes"))
