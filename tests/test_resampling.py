"""Resampling, clustering and order statistics against plain definitions."""

import math
import random

import numpy as np
import pytest

from tidemark.operators import experiments, features, outcomes


def test_block_bootstrap_equals_dense_form():
    rng = random.Random(1)
    for n in (5, 17, 200):
        x = [rng.gauss(0.1, 1) for _ in range(n)]
        r, block = random.Random(42), min(n, max(2, round(n ** (1 / 3))))
        need, opposite, it = -(-n // block), 0, 300
        for _ in range(it):
            starts = [r.randrange(n) for _ in range(need)]
            sample = [x[(s + k) % n] for s in starts for k in range(block)][:n]
            opposite += (sum(sample) / n <= 0) != (sum(x) / n <= 0)
        assert outcomes.block_bootstrap_p(x, it, 42) == min(1.0, 2 * min(opposite, it - opposite) / it)


@pytest.mark.parametrize("parts", [1, 5])
def test_poisson_bootstrap_equals_plain_sums(spark, parts):
    rng = random.Random(2)
    rows = [(rng.choice(["A", "B", None]), k, rng.choice([None, rng.gauss(0.2, 1)])) for k in range(900)]
    df = spark.createDataFrame(rows, "ticker string, k int, outcome double").repartition(parts)
    got = {r["ticker"]: r for r in outcomes.poisson_bootstrap(df, ["ticker"], ["k"], iterations=200, seed=7).collect()}
    ids = {(r["ticker"], r["k"]): r["id"] for r in df.selectExpr("ticker", "k", "xxhash64(ticker, k) as id").collect()}
    for t in ("A", "B", None):
        own = [(ids[t, k], x) for a, k, x in rows if a == t and x is not None]
        w = outcomes.poisson_weights(np.array([i for i, _ in own]).view(np.uint64), 200, 7)
        x = np.array([v for _, v in own])
        means = (w * x[:, None]).sum(axis=0) / w.sum(axis=0)
        opposite = int(((means <= 0) != (x.mean() <= 0)).sum())
        assert got[t]["n"] == len(own) and math.isclose(got[t]["mean"], x.mean())
        assert math.isclose(got[t]["low"], np.quantile(means, 0.025), abs_tol=1e-9) and math.isclose(got[t]["high"], np.quantile(means, 0.975), abs_tol=1e-9)
        assert got[t]["p_value"] == min(1.0, 2 * min(opposite, 200 - opposite) / 200)
        assert abs((got[t]["high"] - got[t]["low"]) / (2 * 1.96 * x.std() / math.sqrt(len(x))) - 1) < 0.25


def test_poisson_weights_have_mean_and_variance_one():
    w = outcomes.poisson_weights(np.arange(4000, dtype=np.uint64), 100, 3)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02


def plain_ward(points, clusters):
    groups = [[k] for k in range(len(points))]
    centre = lambda g: points[g].mean(axis=0)
    while len(groups) > clusters:
        pairs = [(len(a) * len(b) / (len(a) + len(b)) * float(((centre(a) - centre(b)) ** 2).sum()), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j]
        _, i, j = min(pairs)
        groups[i] = sorted(groups[i] + groups.pop(j))
    return {tuple(sorted(g)) for g in groups}


def test_ward_equals_plain_merging():
    rng = np.random.default_rng(5)
    for n, clusters in ((1, 1), (2, 1), (12, 3), (40, 5), (40, 1), (7, 9)):
        points = rng.normal(size=(n, 3))
        label = experiments.ward(points, clusters)
        assert {tuple(np.flatnonzero(label == c)) for c in set(label.tolist())} == plain_ward(points, clusters)
        assert label[0] == 0
    big = experiments.ward(np.concatenate([rng.normal(c, 0.01, (300, 2)) for c in (0, 5, 9)]), 3)
    assert [len(set(big[k * 300 : (k + 1) * 300].tolist())) for k in range(3)] == [1, 1, 1] and len(set(big.tolist())) == 3


def test_earlier_counts_equal_a_scan():
    rng = random.Random(3)
    for n in (0, 1, 2, 33, 500):
        v = [rng.choice([rng.random(), 0.5, -1.0]) for _ in range(n)]
        less, same = features.earlier_counts(np.array(v))
        assert less.tolist() == [sum(a < v[i] for a in v[:i]) for i in range(n)]
        assert same.tolist() == [sum(a == v[i] for a in v[:i]) for i in range(n)]
