import datetime
import random
import statistics
from collections import Counter
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from tidemark.functions import urls
from tidemark.operators import agents, discovery, research
from tidemark.queries import QUERIES
from tidemark.sources import parsers

D = datetime.date


def test_links_resolve_like_the_standard_library(spark):
    pages = ["http://h.example/a/b/c.html?q=1#f", "https://h.example:81", "http://h.example/", "http://h.example/a/b/"]
    links = ["", "x.csv", "/x/y.json?z=1", "//o.example/p", "?k=v", "#top", "../up.xml", "../../../far", "./here", "a/./b/../c", "https://t.example/q", "mailto:a@b.example", "..", ".", "x/..", "/a/../b", "d/?u=/../v"]
    rows = [(p, l) for p in pages for l in links]
    df = spark.createDataFrame(rows, "page string, link string").select("page", "link", urls.resolved(F.col("page"), F.col("link")).alias("url"))
    wrong = [(r.page, r.link, r.url, urljoin(r.page, r.link)) for r in df.collect() if r.url != urljoin(r.page, r.link)]
    assert not wrong


def test_sitemaps_name_each_address_once(spark):
    body = "<urlset><url><loc> /a.CSV?x=1 </loc></url><LOC>http://o.example/b</LOC><loc></loc><loc>#f</loc><loc>\n/a.CSV?x=1</loc><loc>mailto:x</loc><loc>c.xls</loc></urlset>"
    got = discovery.sitemap_urls(spark.createDataFrame([("http://h.example/s/map.xml", body), ("http://h.example/none.xml", None)], "page_url string, body string"))
    assert {(r.url, r.read_as) for r in got.collect()} == {
        ("http://h.example/a.CSV?x=1", "CSV_DOWNLOAD"), ("http://o.example/b", "HTML_SCRAPE"), ("http://h.example/s/c.xls", "CSV_DOWNLOAD"), ("http://h.example/s/map.xml#f", "XBRL"),
    }


def test_interface_links(spark):
    rows = [("http://h.example/d/", "api-docs/v1"), ("http://h.example/d/", "API-docs/v1"), ("http://h.example/d/", "about"), ("http://h.example/d/", None), ("http://h.example/d/", "/OpenAPI.json")]
    got = discovery.api_links(spark.createDataFrame(rows, "page_url string, href string"))
    assert {r.url for r in got.collect()} == {"http://h.example/d/api-docs/v1", "http://h.example/d/API-docs/v1", "http://h.example/OpenAPI.json"}


def test_stability_equals_plain_counting(spark):
    rng = random.Random(3)
    names = ["http://h.example/a.csv", "http://h.example/b?token=1", "http://h.example/" + "0f" * 14, "http://h.example/c", "http://h.example/d.json?sid=2", "http://h.example/never"]
    probes = [(rng.choice(names[:-1]), rng.choice([True, True, False, None]), rng.choice([200, 200, 404, None])) for _ in range(60)] + [("http://h.example/once", True, 200), ("http://h.example/down", False, 200)]
    targets = [(u,) for u in names + ["http://h.example/once", "http://h.example/down", names[0]]]

    def shape(u):
        u = u.lower()
        s = 0.5 - 0.4 * any(m in u for m in urls.SESSION_MARKS) + 0.3 * any(e in u for e in urls.LASTING_ENDINGS)
        return min(1, max(0, s - 0.2 * ("0f" * 12 in u)))

    want = {}
    for (u,) in targets:
        own = [p for p in probes if p[0] == u]
        good = [s for _, ok, s in own if ok and s is not None]
        if not own:
            want[u] = (round(shape(u), 6), 0, True)
        elif not good:
            want[u] = (0.0, len(own), False)
        else:
            want[u] = (round((shape(u) + Counter(good).most_common(1)[0][1] / len(good)) / 2, 6), len(own), len(own) < 2)
    got = discovery.stability(spark.createDataFrame(targets, "url string"), spark.createDataFrame(probes, "url string, reachable boolean, status int")).collect()
    assert len(got) == len(want) and all((pytest.approx(r.score, abs=2e-6), r.n_probes, r.insufficient) == want[r.url] for r in got)


def test_archive_spans(spark):
    s = [("a", "20200101"), ("a", "20200703120000"), ("b", "20200101"), ("b", "202001012359"), ("c", "x"), ("c", None), ("e", "20100101"), ("e", "20200101")]
    c = [("a", D(2019, 1, 1)), ("c", D(2021, 5, 5)), ("d", None)]
    got = discovery.archive_span(spark.createDataFrame([(u,) for u in "abcdea"], "url string"), spark.createDataFrame(s, "url string, stamp string"), spark.createDataFrame(c, "url string, day date"))
    rows = {r.url: (r.score, r.n_snapshots, r.earliest, r.latest) for r in got.collect()}
    assert rows == {
        "a": (round(184 / 365, 6), 2, D(2020, 1, 1), D(2020, 7, 3)), "b": (0.2, 2, D(2020, 1, 1), D(2020, 1, 1)), "c": (0.4, 1, D(2021, 5, 5), D(2021, 5, 5)),
        "d": (0.0, 0, None, None), "e": (1.0, 2, D(2010, 1, 1), D(2020, 1, 1)),
    }


def test_candidate_domains(spark):
    rows = [(1, "Nile (NL) Co. É", "EG", None), (2, "X", "US", []), (3, "Y", "EG", ["y.example", "y.example", "z.example"]), (4, None, None, None)]
    got = discovery.candidate_domains(spark.createDataFrame(rows, "org_id int, name string, country string, hints array<string>"))
    by = {}
    for r in sorted(got.collect(), key=lambda r: (r.org_id, r.position)):
        by.setdefault(r.org_id, []).append((r.domain, r.origin))
    assert [d for d, _ in by[1]] == ["nileco.com.eg", "nileco.gov.eg", "nileco.com", "nileco.org", "nileco.net"] and [d for d, _ in by[2]] == ["x.com", "x.org", "x.net"]
    assert by[3] == [("y.example", "hint"), ("z.example", "hint")] and [d for d, _ in by[4]] == [".com", ".org", ".net"]


def test_the_worst_verdict_decides(spark):
    asked = {"a": 1, "b": 2, "c": 1}
    rows = [("all", "a", True), ("all", "b", True), ("all", "b", True), ("all", "c", True), ("part", "a", True), ("part", "b", True), ("part", "c", True), ("open", "a", True), ("open", "a", None), ("open", "b", True), ("open", "b", True), ("open", "c", True), ("bad", "a", False), ("bad", "a", True), ("bad", "c", None)]
    got = discovery.worst(discovery.verdicts(spark.createDataFrame(rows, "by string, dimension string, ok boolean"), asked, "by"), "by")
    assert {r.by: (r.overall, r.failing, r.blocked, r.reliable) for r in got.collect()} == {"all": ("PASS", "", "", "yes"), "part": ("BLOCKED", "", "b", "partially"), "open": ("PARTIAL", "", "", "yes"), "bad": ("FAIL", "a", "b,c", "no")}


CARD = '<h5 class="card-title">{}</h5> <p class="card-text">{}</p><i></i><p class="card-text mb-1"><small class="text-muted">{}</small></p>'


def test_disclosure_cards(spark):
    cards = [
        ("Net income &amp; more", 'About (abc.CA)<br>x <a href="http://egx.com.eg/f?a=1&amp;b=2">f</a>', "2024-02-03 10:00"), ("ZZZ.CA appoints", "unknown ticker", "2024-02-03"), ("No code", "text", "2024-02-03"),
        ("ABC.CA bad day", "x", "3 Feb"), ("ABC.CA tells", "نتائج الأعمال", "2024-02-04"), ("ABC.CA plain", "", "2024-02-05"),
    ]
    page = "<html>" + "\n".join(CARD.format(*c) for c in cards)
    docs = spark.createDataFrame([("http://p.example/1", page), ("http://p.example/2", "<p>none</p>"), ("http://p.example/3", None)], "url string, body string")
    got = parsers.disclosure_cards(docs, spark.createDataFrame([("ABC",), ("ABC",)], "ticker string")).orderBy("published_at").collect()
    assert [(str(r.published_at), r.headline, r.source_url, r.event_type) for r in got] == [
        ("2024-02-03", "Net income & more", "http://egx.com.eg/f?a=1&b=2", "EARNINGS"), ("2024-02-04", "ABC.CA tells", "http://p.example/1", "EARNINGS"), ("2024-02-05", "ABC.CA plain", "http://p.example/1", None),
    ]
    assert all(r.ticker == "ABC" for r in got)


def test_bulletin_query_names_the_kind_by_headline(spark, tmp_path):
    texts = ["amergeb", "stock split", "\u00a0\nnet income\u3000", "rights issue", "to acquire", "Merger &amp; <b>\ndividend </p>", "", None]
    rows = [(k, t) for k, t in zip((4349, 5189, 0, 1, 2, 3, 14, 9), texts)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["s35_disclosure_cards"](spark, str(tmp_path)).collect()
    kinds = ("STOCK_SPLIT", "CAPITAL_INCREASE", "MANAGEMENT_CHANGE", "EARNINGS", None)
    size = {k: len(f"(TK{k % 23}.CA) " + " ".join((t or "").split()) + (" " if t else "") + "file") for k, t in rows}
    want = {(f"id={k}&", kinds[k % 5], size[k]) for k, _ in rows if k % 9 != 4 and k % 23 < 20}
    assert {(r.source_url.split("?")[1].split("v=")[0], r.event_type, r.n_body) for r in got} == want and len(want) == len(got)


def test_drift_equals_plain_means(spark):
    rng = random.Random(8)
    day = lambda k: D(2024, 1, 1) + datetime.timedelta(k)
    bars = {t: [(t, day(k), None if rng.random() < 0.05 else round(100 * rng.uniform(0.9, 1.1), 2)) for k in sorted(rng.sample(range(60), n))] for t, n in (("a", 40), ("b", 25), ("c", 6), ("d", 7))}
    events = [(t, day(rng.randrange(-2, 62)), rng.choice(["SPLIT", "DIVIDEND"])) for t in "abcde" for _ in range(12)]
    events += events[:2]
    want = []
    for t, at, kind in events:
        b = bars.get(t, [])
        x = [(d1, round((q - p) / p, 9)) for (_, _, p), (_, d1, q) in zip(b, b[1:]) if p is not None and q is not None]
        before, after = [v for d, v in x if d <= at], [v for d, v in x if d > at]
        if len(b) >= 7 and len(before) >= 3 and len(after) >= 3 and abs(statistics.fmean(after) - statistics.fmean(before)) >= 0.002:
            shift = statistics.fmean(after) - statistics.fmean(before)
            want.append((t, at, kind, len(before), len(after), round(shift, 6), "upward" if shift > 0 else "downward"))
    frame = spark.createDataFrame([r for b in bars.values() for r in b], "ticker string, trade_date date, adj double")
    got = agents.event_drift(frame, spark.createDataFrame(events, "ticker string, event_date date, event_type string")).collect()
    assert sorted((*r[:5], round(r.shift, 6), r.direction) for r in got) == sorted(want) and len(want) > 10


def test_analogs_must_agree(spark):
    rows = [("a", 0.1)] * 4 + [("a", -0.1)] + [("b", 0.1)] * 3 + [("b", -0.1)] * 2 + [("c", 0.1)] * 3 + [("d", 0.0)] * 4 + [("e", 0.1)] * 2 + [("e", -0.3)] * 5
    got = agents.analog_agreement(spark.createDataFrame(rows, "ticker string, forward_return double")).collect()
    assert {r.ticker: (r.n, round(r.agreement, 4), r.direction) for r in got} == {"a": (5, 0.8, "positive"), "d": (4, 1.0, "negative"), "e": (7, round(5 / 7, 4), "negative")}


def test_cases_before_a_day(spark):
    rng = random.Random(5)
    events = [(rng.choice("xyz"), D(2024, 1, rng.randrange(1, 20)), k, f"e{k}") for k in range(80)]
    subjects = [(u, D(2024, 1, d)) for u in "xyzw" for d in (1, 2, 9, 25)]
    want = {(u, b): [c for *_, c in sorted((e for e in events if e[0] == u and e[1] < b), key=lambda e: (e[1], e[2]), reverse=True)[:5]] for u, b in subjects}
    got = agents.cases_before(spark.createDataFrame(subjects, "u string, before date"), spark.createDataFrame(events, "u string, day date, k int, c string"), "u", "day", ["k"], "c").collect()
    assert {(r.u, r.before): r.cases for r in got} == want and len(got) == len(want)


def test_thesis_states(spark):
    o = [("broken", ["c1", "c2"], ["x"], ["k1", "k2"], None), ("held", ["c1"], [], ["k1"], D(2030, 1, 1)), ("doubted", ["c1"], [], ["k9"], None), ("late", ["c1"], ["x"], [], D(2024, 1, 1)), ("well", ["c1"], ["x"], None, None), ("gone", ["c1"], [], ["k1"], None)]
    n = [("broken", ["c2"], ["x"], "EXIT"), ("held", ["c1"], [], "HOLD"), ("doubted", ["c1"], ["y"], "HOLD"), ("late", [], ["x"], "HOLD"), ("well", ["c1"], [], "BUY")]
    kind = "ticker string, catalysts array<string>, contradictions array<string>"
    got = research.thesis(spark.createDataFrame(o, kind + ", knowledge_ids array<string>, review_on date"), spark.createDataFrame(n, kind + ", action string"), spark.createDataFrame([("k1",), ("k1",), ("k2",)], "knowledge_id string"), "2024-06-01")
    rows = {r.ticker: r for r in got.collect()}
    assert {t: r.status for t, r in rows.items()} == {"broken": "BROKEN", "held": "WEAKENING", "doubted": "WEAKENING", "late": "WEAKENING", "well": "ALIVE", "gone": "EXPIRED"}
    assert rows["broken"].broken == ["k1", "k2"] and rows["broken"].lapsed == ["c1"] and rows["broken"].remaining == ["c2"] and rows["doubted"].new_contradictions == ["y"] and rows["late"].overdue


def test_pages_lead_to_sources(spark):
    html = """<link rel="alternate stylesheet" type='application/atom+xml' href="/f.atom"><LINK HREF=g.json TYPE=text/css rel=alternate><a data-x="1" href="d.csv?x=1">d</a><a href='d.csv?x=1'>d</a>
    <a href="a.pdf">1</a><a href="b.PDF?x">2</a><a href="a.pdf">3</a><a href="docs/api/v2.json">j</a><a name="n">n</a><a href="">e</a><abbr href="z.csv">z</abbr>"""
    pages = [("http://h.example/p/q", html), ("http://h.example/two", '<a href="a.pdf">1</a><a href="b.pdf">2</a>'), ("http://h.example/none", None), ("http://h.example/empty", "")]
    got = discovery.page_candidates(spark.createDataFrame(pages, "page_url string, html string")).collect()
    assert sorted(tuple(r) for r in got) == sorted([
        ("http://h.example/p/q", "http://h.example/f.atom", "FEED", "RSS_FEED"), ("http://h.example/p/q", "http://h.example/p/d.csv?x=1", "DATASET", "CSV_DOWNLOAD"), ("http://h.example/p/q", "http://h.example/p/docs/api/v2.json", "DATASET", "JSON_API"),
        ("http://h.example/p/q", "http://h.example/p/docs/api/v2.json", "API", "JSON_API"), ("http://h.example/p/q", "http://h.example/p/q", "REPOSITORY", "PDF_DOWNLOAD"),
    ])
