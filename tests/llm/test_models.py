import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import lm_score, quality
from tidemark.llm.common import table

BLANKS = r"[^\x20\x09-\x0D]+"
LOW = {c: c + 32 for c in range(65, 91)}


def brute_base(rows):
    tok = [(i, re.findall(BLANKS, (t or "").translate(LOW))) for i, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in tok]
    counts, ends = Counter(), 0
    for (_, w), h in zip(tok, held):
        if not h:
            counts.update(w)
            ends += 1
    total, distinct = sum(counts.values()) + ends, len(counts) + (ends > 0)
    floor = math.log10(total + distinct + 1)
    out = []
    for (i, w), h in zip(tok, held):
        base = sum(math.log10(counts[x] + 1) - floor for x in w) + math.log10(ends + 1) - floor
        out.append((i, h, len(w) + 1, sum(counts[x] > 0 for x in w) + (ends > 0), total, base))
    return out


def same(got, expected):
    key = lambda r: (str(r[0]), r[2], round(r[5], 6))
    a, b = sorted(got, key=key), sorted(expected, key=key)
    assert [r[:5] for r in a] == [r[:5] for r in b]
    assert [r[5] for r in a] == pytest.approx([r[5] for r in b], rel=1e-9)


def test_base_scores_and_held_out_gain(spark, sf):
    docs = table(spark, sf, "documents").repartition(3)
    rows = lm_score.lm_score(docs).collect()
    same([tuple(r[:6]) for r in rows], brute_base([(r.doc_id, r.text) for r in docs.collect()]))
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_rare_words_join(spark, sf):
    docs = table(spark, sf, "documents").limit(80)
    rows = lm_score.lm_score(docs, most_words=5).collect()  # almost every word takes the join
    same([tuple(r[:6]) for r in rows], brute_base([(r.doc_id, r.text) for r in docs.collect()]))


def test_scores_do_not_depend_on_how_rows_are_split(spark, sf, monkeypatch):
    monkeypatch.setattr(lm_score, "GROUP_WINDOWS", 500)
    docs = spark.createDataFrame(table(spark, sf, "documents").where("length(text) < 3000").limit(60).collect())
    of = lambda d: {r.doc_id: r.score for r in lm_score.lm_score(d).collect()}
    assert of(docs.repartition(1)) == pytest.approx(of(docs.repartition(5, "doc_id")), rel=1e-5)


def test_lm_edge_cases(spark, awkward, empty):
    rows = lm_score.lm_score(awkward).collect()
    same([tuple(r[:6]) for r in rows], brute_base([(r.doc_id, r.text) for r in awkward.collect()]))
    two = [r.score for r in rows if r.doc_id == 2]
    assert two[0] == two[1]
    assert lm_score.lm_score(empty).count() == 0
    assert zlib.crc32(b"1") % 7 == 2  # held out, so nothing is learnt
    r = lm_score.lm_score(spark.createDataFrame([(1, "no training rows")], "doc_id long, text string")).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (4, 0, 0, 0.0) and math.isfinite(r.score)


def test_all_windows_train_in_more_than_one_round(spark, sf, monkeypatch):
    seen, once = [], lm_score.trained_round
    monkeypatch.setattr(lm_score, "trained_round", lambda windows, *a: seen.append(windows.count()) or once(windows, *a))
    lm_score.lm_score(table(spark, sf, "documents").limit(30))
    assert len(seen) >= 2 and len(set(seen)) == 1


@pytest.mark.parametrize("copies", [1, 6100])
def test_training_windows_cover_the_texts(spark, copies):
    path = lm_score.multi_ranks()
    text = " ".join(f"word{k % 700} and{k}" for k in range(10_000 if copies == 1 else 60))
    docs = spark.createDataFrame([(1_000_000 + k, text) for k in range(copies)] + [(3, "")], "doc_id long, text string").repartition(2)
    found = lm_score.gather(docs, path, lm_score.FOLDS, -1).where("window is not null").collect()
    assert len({r.deal for r in found}) == len(found)
    b = lm_score.Batch([text])
    ids, _ = lm_score.encode_words(path, b, *b.words())
    windows = lm_score.covering(np.tile(ids, copies), np.array([*range(0, len(ids) * copies + 1, len(ids)), len(ids) * copies]))
    assert Counter(lm_score.unpacked([r.window])[0].tobytes() for r in found) == Counter(w.tobytes() for w in windows)
    predicted = windows[:, 1:][windows[:, 1:] != -2]
    ends = np.flatnonzero(predicted == lm_score.END)
    texts = [x[x >= 0].tolist() for x in np.split(predicted, ends + 1)[:-1]]
    assert sorted(map(len, texts)) == [0] + [len(ids)] * copies and all(x in ([], ids.tolist()) for x in texts)


def test_neighbours_of_all_windows_are_counted(spark):
    rng = np.random.default_rng(4)
    windows = rng.integers(0, 300, (9000, lm_score.WIDTH + 1)).astype(np.int32)  # more than the warm-up takes
    windows[:, -1] = -2
    windows[-1, :3] = 300, 301, 302  # ids of the last window only
    frame = spark.createDataFrame([(bytearray(w.astype(np.uint16).tobytes()),) for w in windows], "window binary").repartition(3)
    got = lm_score.profiles(frame, 303, np.arange(303))
    expected = np.zeros((303, 606))
    body = windows[:, :-1]
    for shift in (1, 2):
        np.add.at(expected, (body[:, shift:], body[:, :-shift]), 1)
        np.add.at(expected, (body[:, :-shift], 303 + body[:, shift:]), 1)
    assert (got == expected).all() and got[300].any()


def test_every_known_id_is_classed_by_its_neighbours():
    n = 20_000
    profile = np.zeros((n, 8), np.float32)
    profile[np.arange(n), np.arange(n) % 8] = 1
    v = lm_score.Vocabulary(np.arange(n, 0, -1), 5, np.ones(n, bool), profile, classes=17)
    assert all(len(set(v.cls[k:n:8])) == 1 for k in range(8))


def test_mixture_is_fit_on_all_training_rows(spark, monkeypatch):
    rows = [(k, "a b a c" if k else "rare words only here") for k in range(1, 40)] + [(0, "rare words only here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    seen, once = [], lm_score.best_mixture
    monkeypatch.setattr(lm_score, "best_mixture", lambda scored, rare, floor: seen.append((scored.where("fit is not null").count(), rare.where("not held_out").count())) or once(scored, rare, floor))
    lm_score.lm_score(docs, most_words=1)
    held = sum(zlib.crc32(str(k).encode()) % 7 == 2 for k, _ in rows)
    assert seen[0][0] > 0 and seen[0][1] == 4 * (len(rows) - held)


@pytest.fixture(scope="module")
def small():
    rng = np.random.default_rng(0)
    v = lm_score.Vocabulary(rng.integers(0, 50, 300), 20, rng.random(300) < 0.5, None, classes=12, frequent=64)
    return v, lm_score.initial(v), rng


def test_gradient_is_the_slope(small):
    v, w, rng = small
    w = {k: m.astype(float) for k, m in w.items()}
    ids = rng.integers(0, 300, (4, lm_score.WIDTH + 1))
    x, target, on = lm_score.vectors(ids[:, :-1], v), v.cls[ids[:, 1:]], np.ones((4, lm_score.WIDTH))
    _, g = lm_score.gradient(w, x, 0, target, on)
    for name in w:
        at = np.unravel_index(np.abs(g[name]).argmax(), w[name].shape)
        old, two = w[name][at], []
        for step in (1e-5, -1e-5):
            w[name][at] = old + step
            two.append(lm_score.gradient(w, x, 0, target, on)[0])
        w[name][at] = old
        assert g[name][at] == pytest.approx((two[0] - two[1]) / 2e-5, rel=1e-4)


@pytest.mark.parametrize("scale", [1, 40])  # 40: scores whose exponentials overflow
def test_parts_of_a_batch_add_up_to_its_gradient(small, scale):
    v, w, rng = small
    w = {k: m * np.float32(scale) for k, m in w.items()}
    ids = rng.integers(0, 300, (6, lm_score.WIDTH + 1))
    x, target, on = lm_score.vectors(ids[:, :-1], v), v.cls[ids[:, 1:]], rng.random((6, lm_score.WIDTH)) < 0.8
    loss, g = lm_score.gradient(w, x, 0, target, on)
    logits = lm_score.forward(w, x, 0)[0].astype(float)
    top = logits.max(axis=2)
    plain = top + np.log(np.exp(logits - top[..., None]).sum(axis=2)) - np.take_along_axis(logits, target[..., None], axis=2)[..., 0]
    assert loss == pytest.approx(np.minimum(plain, -np.log(1e-30))[on].mean(), rel=1e-3)
    parts = [lm_score.gradient(w, x[k : k + 2], 0, target[k : k + 2], on[k : k + 2], int(on.sum())) for k in (0, 2, 4)]
    assert sum(p[0] for p in parts) == pytest.approx(loss, rel=1e-4)
    for name in g:
        assert np.isfinite(g[name]).all() and np.allclose(sum(p[1][name] for p in parts), g[name], rtol=1e-3, atol=1e-5 * max(1, np.abs(g[name]).max()))


def test_arrays_kept_from_part_to_part_do_not_leak(small):
    v, w, rng = small
    ids = rng.integers(0, 300, (7, lm_score.WIDTH + 1))
    x, target, on = lm_score.vectors(ids[:, :-1], v), v.cls[ids[:, 1:]], rng.random((7, lm_score.WIDTH)) < 0.8
    loss, g = lm_score.gradient(w, x, 0, target, on)
    added, to_ids, kept, got = {n: np.zeros_like(m) for n, m in w.items()}, np.empty((x.size, lm_score.DIM), np.float32), {}, 0.0
    for lo, hi in ((0, 4), (4, 6), (6, 7)):  # each smaller than the one before
        got += lm_score.add_slopes(w, x[lo:hi], target[lo:hi], on[lo:hi], int(on.sum()), added, to_ids[lo * lm_score.WIDTH : hi * lm_score.WIDTH], kept)
    lm_score.add_rows(added["e"], x.reshape(-1), to_ids)
    assert got == pytest.approx(loss, rel=1e-5) and len(kept) == len({id(m) for m in kept.values()})
    assert all(np.allclose(added[n], g[n], rtol=1e-3, atol=1e-5 * max(1, np.abs(g[n]).max())) for n in g)


def test_attention_is_causal_and_scoring_agrees(small):
    v, w, rng = small
    x = rng.integers(0, v.vectors, (3, lm_score.WIDTH))
    a, _ = lm_score.forward(w, x, 0)
    y = x.copy()
    y[:, 20:] = rng.integers(0, v.vectors, (3, lm_score.WIDTH - 20))
    b, _ = lm_score.forward(w, y, 0)
    assert np.allclose(a[:, :20], b[:, :20], atol=1e-5) and not np.allclose(a[:, 20:], b[:, 20:])
    assert np.allclose(lm_score.Tables(w, v).scores(x, 8).reshape(3, -1, v.classes), lm_score.forward(w, x, 8)[0], atol=1e-4)


def test_word_probabilities_match_a_plain_walk(small):
    """Each id once, in the window with most before it; words by the chain rule and a beginning after."""
    v, w, rng = small
    words = [rng.integers(0, 300, n) for n in rng.integers(1, 4, 60)]
    ids, at = np.concatenate(words), np.concatenate(([0], np.cumsum([len(x) for x in words])))
    got, ends = lm_score.word_log_probs(lm_score.Tables(w, v), v, ids.astype(np.int32), at, np.array([0, 25, 25, 60]))
    lead = lm_score.WIDTH - lm_score.STRIDE
    plain = []
    for first, last in ((0, 25), (25, 25), (25, 60)):
        own = [*ids[at[first] : at[last]], v.end]
        stream = [-2] * (lead + 1) + own
        lp, begin = [], []
        for k in range(len(own)):
            window = k // lm_score.STRIDE * lm_score.STRIDE
            x = np.array(stream[window : window + lm_score.WIDTH] + [-2] * lm_score.WIDTH)[: lm_score.WIDTH]
            logits, _ = lm_score.forward(w, lm_score.vectors(x[None], v), 0)
            p = np.exp(logits[0, k - window + lead])
            p /= p.sum()
            lp.append(np.log(p[v.cls[own[k]]]) + v.within[own[k]])
            begin.append(np.log(p[: v.starting].sum()))
        for j in range(first, last):
            s, e = at[j] - at[first], at[j + 1] - at[first]
            plain.append(sum(lp[s:e]) - begin[s] + begin[e])
        plain.append(("end", lp[-1] - begin[-1]))
    assert got == pytest.approx([x for x in plain if not isinstance(x, tuple)], abs=2e-3)
    assert ends == pytest.approx([x[1] for x in plain if isinstance(x, tuple)], abs=2e-3)


def test_words_have_probabilities_that_sum_to_one(small):
    """Over the first ids of a word, given that a word begins."""
    v, w, _ = small
    starting = [i for i in range(301) if v.cls[i] < v.starting]
    logits, _ = lm_score.forward(w, np.zeros((1, lm_score.WIDTH), int), 0)
    p = np.exp(logits[0, 5]) / np.exp(logits[0, 5]).sum()
    assert sum(p[v.cls[i]] * math.exp(v.within[i]) for i in starting) / p[: v.starting].sum() == pytest.approx(1, abs=1e-4)


# ---- quality -------------------------------------------------------------------------------------------------------


def test_quality_finds_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    fit, rest = labels.where("doc_id % 2 = 0"), {r.doc_id: r.quality for r in labels.where("doc_id % 2 = 1").collect()}
    kept = {r.doc_id: r.kept for r in quality.weigh(docs, fit).collect()}
    good = [kept[i] for i, q in rest.items() if q == 1]
    bad = [kept[i] for i, q in rest.items() if q == 0]
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.15


def test_ratios_match_plain_counts(spark):
    rows = [(1, "good words here"), (2, "bad!! words"), (3, "good good good")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    raw, target = quality.counts(df, [1], 1 << 12)
    f = [quality.features([t], 1 << 12)[0] for _, t in rows]
    assert raw.tolist() == np.bincount(np.concatenate(f), minlength=1 << 12).tolist() and target.tolist() == np.bincount(f[0], minlength=1 << 12).tolist()


@pytest.mark.parametrize("k", [1, 2, 17, 500, 1000])
def test_kth_largest(spark, k):
    rng = np.random.default_rng(k)
    values = quality.ordered(rng.normal(0, 1e3, 1000))
    df = spark.createDataFrame([(int(x),) for x in values], "v long")
    assert quality.kth_largest(df, "v", k) == sorted(values.tolist(), reverse=True)[k - 1]
    assert quality.kth_largest(df, "v", 0) is None and quality.kth_largest(df, "v", 1001) is None


def test_ordered_keeps_the_order_of_doubles():
    x = np.array([-np.inf, -1e300, -2.5, -0.0, 0.0, 1e-300, 3.0, np.inf])
    assert (np.diff(quality.ordered(x).astype(object)) >= 0).all()


def test_gumbel_noise_is_gumbel():
    g = quality.gumbel(np.arange(200_000), 1)
    assert g.mean() == pytest.approx(0.5772, abs=0.02) and g.var() == pytest.approx(math.pi**2 / 6, abs=0.05)


def test_quality_edge_cases(spark, awkward, empty):
    labels = spark.createDataFrame([(1, 1, None), (7, 0, 1), (None, 1, 0), (8, None, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.weigh(awkward, labels).collect()
    assert len(rows) == awkward.count() and all(not r.kept and r.weight is None for r in rows if r.doc_id in (3, 4, 5))
    assert quality.weigh(empty, labels).count() == 0 and quality.keep_good(awkward, labels).columns == awkward.columns
    assert all(r.kept == (r.n_grams > 0) for r in quality.weigh(awkward, labels.where("false")).collect())


# ---- pipeline ------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, sf):
    import corpus_pipeline as p

    from .test_exact_and_packing import check_packed, normal
    from .test_join_and_leaks import brute_join, brute_leaks

    docs, columns = table(spark, sf, "documents"), ["doc_id", "text", "lang", "source", "n_chars"]
    before = docs.collect()
    kept = {r.doc_id for r in quality.weigh(docs, table(spark, sf, "labels")).collect() if r.kept}
    expected = [r for r in before if r.doc_id in kept]
    seen: dict = {}
    for r in sorted(expected, key=lambda r: (-len(r.text), r.doc_id)):
        seen.setdefault(normal(r.text), r)
    expected = list(seen.values())
    classes = brute_join([(r.doc_id, r.text) for r in expected])
    expected = [r for r in expected if classes[r.doc_id][0] == r.doc_id]
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    texts = {r.doc_id: r.text for r in expected}
    short = {i: t for i, t in texts.items() if len(t) < 1500}
    leaks = {i for i, t in short.items() if brute_leaks(t, items)}
    for name, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    got = {r.doc_id for r in docs.collect()}
    assert got <= set(texts) and {i for i in got if i in short} == set(short) - leaks
    check_packed(p.STAGES[-1][1](spark, docs, sf).collect(), [(r.doc_id, r.text) for r in docs.collect()], 2048)


@pytest.mark.parametrize("span, k", [(quality.SPAN, None), (0.5, 40)])
def test_selection_matches_brute_force(spark, sf, span, k):
    docs, labels = table(spark, sf, "documents").limit(120), table(spark, sf, "labels")
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    marks = {r.doc_id: (r.quality == 1, not r.toxic) for r in labels.collect() if r.quality is not None}
    found = {i: quality.features([t], 1 << 10)[0].tolist() for i, t in rows}
    raw, target = Counter(), Counter()
    for i, f in found.items():
        raw.update(f)
        if marks.get(i) == (True, True):
            target.update(f)
    n, m, mass = sum(raw.values()), sum(target.values()), 1024
    ratio = {b: math.log((target[b] + mass * c / n) / (m + mass)) - math.log(c / n) for b, c in raw.items()}
    weight = {i: span * sum(ratio[b] for b in f) / len(f) for i, f in found.items() if f}
    noise = {i: float(quality.gumbel(np.array([i]), 1)[0]) for i in weight}
    if k is None:
        judged = [(w, marks[i][0]) for i, w in weight.items() if i in marks]
        ws = sorted(w for w, _ in judged)
        cuts = [-math.inf, *((a + b) / 2 for a, b in zip(ws, ws[1:])), ws[-1]]
        loss = lambda c: sum(quality.BAD_LOSS if good and w < c else 1.0 if not good and w >= c else 0.0 for w, good in judged)
        cut = min(cuts, key=loss) if not all(g for _, g in judged) else -math.inf
        size = sum(w >= cut for w in weight.values())
    else:
        size = k
    best = set(sorted(weight, key=lambda i: -(weight[i] + noise[i]))[:size])
    got = {r.doc_id: r for r in quality.weigh(docs, labels, buckets=1 << 10, span=span, k=k).collect()}
    assert {i: r.weight for i, r in got.items() if r.weight is not None} == pytest.approx(weight, rel=1e-6, abs=1e-9)
    assert {i for i, r in got.items() if r.kept} == best and len(best) == size
    assert {r.doc_id for r in quality.keep_good(docs, labels, buckets=1 << 10, span=span, k=k).collect()} == best
    if k:
        assert best != set(sorted(weight, key=weight.get)[-k:])  # chance matters
