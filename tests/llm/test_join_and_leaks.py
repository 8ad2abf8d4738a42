import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import decontam, ngram_join

WORDS = [f"w{k}" for k in range(400)]


def shingle_set(t):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or "")).replace("\x0b", " ").replace("\x0c", " ")
    w = [x for x in w.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if x]
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_join(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    links, root = Counter(), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (find(i), links[i]) for i in ids}


def near_copies(seed, bases, copies):
    rng, rows = random.Random(seed), []
    for b in range(bases):
        base = [rng.choice(WORDS) for _ in range(rng.randrange(30, 120))]
        for c in range(copies):
            w = list(base)
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            rows.append((b * 1000 + c, " ".join(w)))
    return rows


def test_join_matches_brute_force(spark):
    rows = near_copies(1, 30, 8) + [(90_000, "a b c"), (90_001, "A  b\nc"), (90_002, None), (90_003, "")]
    got = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert {r.doc_id: (r.class_id, r.n_links) for r in got.collect()} == brute_join(rows)


def test_join_in_blocks_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 7)
    rows = near_copies(2, 2, 60)
    got = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: (r.class_id, r.n_links) for r in got.collect()} == brute_join(rows)


def test_different_texts_under_one_id_both_keep_their_links(spark):
    base = [f"w{k}" for k in range(200)]
    texts = [" ".join(base), " ".join(base[:-1]), " ".join(base[:-2])]
    docs = spark.createDataFrame([(1, texts[0]), (1, texts[1]), (2, texts[2])], "doc_id long, text string").repartition(2)
    got = sorted((r.doc_id, r.class_id, r.class_size, r.n_links) for r in ngram_join.ngram_join(docs).collect())
    assert got == [(1, 1, 3, 2), (1, 1, 3, 2), (2, 1, 3, 2)]


def test_rows_of_one_id_lose_no_text(spark):
    a, b = [f"w{k}" for k in range(150)], [f"v{k}" for k in range(150)]
    text = {"A": " ".join(a), "A2": " ".join(a[:-1]), "B": " ".join(b), "B2": " ".join(b[1:])}
    make = lambda rows: spark.createDataFrame([(i, text[t]) for i, t in rows], "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.class_id, r.class_size, r.n_links) for r in ngram_join.ngram_join(make([(7, "A"), (7, "B"), (13, "A2"), (14, "B2")])).collect())
    assert got == [(7, 7, 2, 1), (7, 7, 2, 1), (13, 7, 2, 1), (14, 7, 2, 1)]
    kept = lambda rows: sorted(((r.doc_id, r.text) for r in ngram_join.one_of_each(make(rows)).collect()), key=str)
    assert kept([(3, "A"), (7, "A2"), (7, "B")]) == [(3, text["A"]), (7, text["B"])]
    assert kept([(7, "A"), (7, "B"), (13, "A2"), (14, "B2")]) == [(7, text["B"]), (7, text["A"])]
    assert kept([(5, "A"), (5, "A"), (6, "A2"), (None, "A"), (None, "B"), (None, "B"), (None, "B2")])[0] == (5, text["A"])
    rows = kept([(5, "A"), (5, "A"), (6, "A2"), (None, "A"), (None, "B"), (None, "B"), (None, "B2")])
    assert len(rows) == 2 and rows[1][0] is None and rows[1][1] in (text["B"], text["B2"])


def test_banding_reaches_the_recall():
    bands, rows = ngram_join.banding(0.8, 0.9995)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9995 and bands * rows <= 256


def test_components_of_long_chains(spark):
    edges = [(k + 1, k) for k in range(200)] + [(1000 + k, 1000) for k in range(1, 50)] + [(5001, 5000), (5000, 4999)]
    got = {r.node: r.root for r in ngram_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(1, 201)) and all(got[1000 + k] == 1000 for k in range(1, 50)) and got[5001] == got[5000] == 4999


def test_join_edge_cases(spark, awkward, empty):
    rows = ngram_join.ngram_join(awkward).collect()
    assert len(rows) == awkward.count()
    two = [r for r in rows if r.doc_id == 2]
    assert all(r.class_id == 1 and r.n_links == 2 for r in two)
    assert ngram_join.ngram_join(empty).count() == 0
    kept = ngram_join.one_of_each(awkward)
    assert kept.columns == awkward.columns and {r.doc_id for r in kept.collect()} == {1, 3, 4, 5, None, 6, 7, 8, 9}
    assert kept.count() == 9
    assert ngram_join.one_of_each(empty).count() == 0


# ---- decontamination -----------------------------------------------------------------------------------------------


def folded(t):
    return " ".join("".join(c.lower() if c.isalnum() else " " for c in t or "").split())


def substring_distance(p, t):
    row = list(range(len(p) + 1))
    best = row[-1]
    for c in t:
        diagonal, row[0] = row[0], 0
        for i in range(1, len(p) + 1):
            diagonal, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, diagonal + (p[i - 1] != c))
        best = min(best, row[-1])
    return best


def brute_leaks(text, items):
    out, t = set(), folded(text)
    for item, body in items:
        p = folded(body)
        if len(p) < decontam.SHORT:
            if p and f" {p} " in f" {t} ":
                out.add(item)
            continue
        starts = [0] if len(p) <= decontam.UNIT else [*range(0, len(p) - decontam.UNIT, decontam.UNIT // 2), len(p) - decontam.UNIT]
        for s in starts:
            u = p[s : s + decontam.UNIT]
            if substring_distance(u, t) <= decontam.budget(len(u), decontam.Q, decontam.RATE):
                out.add(item)
    return out


def edited(rng, s, n):
    s = list(s)
    for _ in range(n):
        k = rng.randrange(len(s))
        s[k : k + 1] = rng.choice(["", "q", "zz", s[k].upper()])
    return "".join(s)


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(9)
    prose = lambda n: " ".join("".join(rng.choice("aeiourstlnmé") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    items = [(k, prose(rng.randrange(8, 60)).capitalize() + ".") for k in range(25)] + [(25, "tiny"), (26, None), (27, "is Five!"), (28, "--")]
    docs = []
    for i in range(90):
        body = prose(rng.randrange(5, 80))
        if i % 3 == 0:
            item = items[rng.randrange(25)][1]
            body = f"{prose(6)}\n{edited(rng, item, rng.randrange(0, 12))} {body}"
        elif i % 3 == 1:
            item = items[rng.randrange(25)][1]
            body = f"{body} {item.upper().replace(' ', '!! ')}"
        if i % 10 == 0:
            body = rng.choice(["Tiny", "x tiny, y", "tinyness", "That is five?", "this five"])
        docs.append((i, body))
    return docs, items


def test_leaks_match_brute_force(spark, planted):
    docs, items = planted
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: set(r["items"]) for r in decontam.find_leaks(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), bench).collect()}
    expected = {i: brute_leaks(t, items) for i, t in docs}
    assert got == expected and sum(map(bool, expected.values())) >= 40


def test_leaks_in_slices_agree(spark, planted):
    docs, items = planted
    d, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    a = {r.doc_id: r for r in decontam.find_leaks(d, bench).collect()}
    b = {r.doc_id: r for r in decontam.find_leaks(d, bench, slice_chars=2500).collect()}
    assert a == b


@pytest.mark.parametrize("slice_chars", [2_000_000, 60])
def test_rows_are_judged_by_their_text(spark, slice_chars):
    passages = [" ".join(f"{c}ora{k}{c}u" for k in range(9)) for c in "bdfg"]
    bench = spark.createDataFrame([(1, passages[0]), (None, passages[1]), (3, passages[2]), (4, "short one")], "item_id long, text string")
    clean, high = "nothing to be seen here at all by anyone who looks", "".join(map(chr, range(0x20000, 0x20040)))
    rows = [(5, passages[0]), (5, clean), (None, "x " + passages[1]), (None, clean), (6, "a short one"), (6, f"{passages[2]} {passages[0]}"), (7, high), (8, "a shorter one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r["items"]) for r in decontam.find_leaks(docs, bench, slice_chars=slice_chars).collect()), key=str)
    assert got == sorted([(5, [1]), (5, []), (None, [None]), (None, []), (6, [4]), (6, [1, 3]), (7, []), (8, [])], key=str)
    kept = decontam.without_leaks(docs, bench, slice_chars=slice_chars).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(5, clean), (None, clean), (7, high), (8, "a shorter one")], key=str)
    other = spark.createDataFrame([(1, "".join(map(chr, range(0x20000 + 50000, 0x20040 + 50000))))], "item_id long, text string")
    assert not any(r.contaminated for r in decontam.find_leaks(docs, other).collect())


def test_every_occurrence_of_a_short_unit_is_a_span(spark):
    item = "these forty folded letters stand for it"
    docs = spark.createDataFrame([(1, f"{item}, {item} and more. {item}")], "doc_id long, text string")
    r = decontam.find_leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).first()
    assert [(s.start, s.end) for s in r.spans] == [(0, 39), (41, 80), (91, 130)]


def test_spans_point_at_the_passage(spark):
    item = "Seven quick brown foxes jumped over the extremely lazy sleeping dog yesterday."
    text = "Élan 😀 — before. " + item.upper() + " after"
    r = decontam.find_leaks(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(4, item)], "item_id long, text string")).first()
    s = r.spans[0]
    assert (s.item, s.edits) == (4, 0) and folded(text[s.start : s.end]) == folded(item)


def test_leak_edge_cases(spark, awkward, empty):
    bench = spark.createDataFrame([(1, None), (None, "text of some row without id that has words and more"), (3, "")], "item_id long, text string")
    assert not any(r.contaminated for r in decontam.find_leaks(awkward, bench).collect())
    assert decontam.find_leaks(awkward, bench.where("false")).count() == awkward.count()
    assert decontam.find_leaks(empty, bench).count() == 0
    kept = decontam.without_leaks(awkward, spark.createDataFrame([(1, "plain words here and there and more of them")], "item_id long, text string"))
    assert kept.columns == awkward.columns and {r.doc_id for r in kept.collect()} == {3, 4, 5, None, 6, 7, 8, 9}


def test_gram_hashes_agree_with_windows():
    codes = np.random.default_rng(0).integers(0, 60, 500).astype(np.uint16)
    for q in (5, 8, 12):
        g = decontam.grams(codes, q)
        seen = defaultdict(set)
        for k in range(len(codes) - q + 1):
            seen[tuple(codes[k : k + q])].add(int(g[k]))
        assert len(g) == len(codes) - q + 1 and all(len(v) == 1 for v in seen.values()) and len({next(iter(v)) for v in seen.values()}) == len(seen)
