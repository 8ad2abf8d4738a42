import random
from collections import Counter, defaultdict
from datetime import date, timedelta

import numpy as np
import pyarrow.parquet as pq
import pytest

from tidemark.operators import graph, market


def test_ancestors_of_a_dag_with_diamonds_and_a_cycle(spark):
    rng = random.Random(4)
    rows = [(f"n{k}", f"n{rng.randrange(k)}") for k in range(1, 60) for _ in range(rng.choice([1, 1, 2, 3]))] + [("n5", None), ("n5", "n5"), ("x", "y"), ("y", "x")]
    up = defaultdict(set)
    for n, p in rows:
        if p is not None and p != n:
            up[n].add(p)
    want = set()
    for n in up:
        seen, step, d = {n}, {n}, 0
        while step:
            d += 1
            step = {p for k in step for p in up.get(k, ())} - seen
            seen |= step
            want |= {(n, p, d) for p in step}
    got = graph.ancestors(spark.createDataFrame(rows + rows[:9], "node string, parent string")).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def above(rows, depth=50):
    """(node, ancestor): least distance, by plain steps."""
    up = defaultdict(set)
    for n, p in rows:
        up[n].add(p)
    want = {}
    for n in up:
        step, d = {n}, 0
        while step and d < depth:
            d += 1
            step = {p for k in step for p in up.get(k, ()) if p != n and (n, p) not in want}
            want |= {(n, p): d for p in step}
    return want


@pytest.mark.parametrize(("wide", "depth"), [(100_000, 50), (12, 50), (100_000, 4), (1, 3)])
def test_wide_nodes_long_chains_and_cycles_keep_all_ancestors(spark, wide, depth):
    rng = random.Random(9)
    rows = {(k, rng.randrange(k)) for k in range(1, 50) for _ in range(rng.choice([1, 2, 2, 3]))} | {(60, 61), (61, 62), (62, 60), (63, 62), (64, 63), (64, 5)} | {(70, k) for k in range(40)} | {(71, 70)}
    got = graph.ancestors(spark.createDataFrame(sorted(rows), "node long, parent long"), depth, wide).collect()
    assert {(r.node, r.ancestor): r.distance for r in got} == above(rows, depth) and len(got) == len(above(rows, depth))


def test_ancestors_found_are_not_read_again_in_every_round(spark, monkeypatch):
    read = []

    def counted(df, name):
        for f in df.inputFiles():
            if "/ancestors-" in f:
                t = pq.read_table(f.removeprefix("file://"))
                read.append(sum(len(m) for m in t["above"].to_pylist()) if "above" in t.column_names else t.num_rows)
        return written(df, name)

    written = graph.written
    monkeypatch.setattr(graph, "written", counted)
    rows = [(n, p) for n in range(2, 1500) for p in {n // 2, n // 3} - {0}]
    got = graph.ancestors(spark.createDataFrame(rows, "node long, parent long")).collect()
    assert {(r.node, r.ancestor): r.distance for r in got} == above(rows) and len(got) == len(above(rows))
    assert sum(read) < 3 * len(got)


def test_genes_mutate_and_merge(spark):
    schema = "gene_id string, version int, generation int, status string, parents array<string>, children array<string>"
    genes = spark.createDataFrame([("a", 1, 0, "PROMOTED", [], []), ("b", 3, 2, "PROMOTED", ["z"], ["y"]), ("c", 1, 1, "PROMOTED", [], [])], schema)
    births = spark.createDataFrame([("m", ["a"], "mutation"), ("k", ["b", "a", "a"], "merge"), ("bad", ["a", "none"], ""), ("c", ["a"], ""), ("orphan", [], "")], "child_id string, parents array<string>, notes string")
    revisions, rejected = graph.descend(genes, births)
    got = {(r["gene_id"], r["version"]): (r["generation"], r["status"], r["parents"], r["children"]) for r in revisions.collect()}
    assert got == {
        ("m", 1): (1, "PROMOTED", ["a"], []), ("k", 1): (3, "PROMOTED", ["b", "a"], []),
        ("a", 2): (0, "REPLACED", [], ["k", "m"]), ("b", 4): (2, "REPLACED", ["z"], ["y", "k"]),
    }
    assert {r["child_id"]: r["reason"] for r in rejected.collect()} == {"bad": "unknown parent", "c": "the gene exists", "orphan": "no parent"}


def test_leader_shares(spark):
    rng = random.Random(1)
    rows = [(f"l{int(rng.paretovariate(1)) % 150}", f"f{rng.randrange(40)}") for _ in range(900)] + [("a", "b"), ("b", "a"), ("b", "a")]
    r = graph.leader_shares(spark.createDataFrame(rows, "src string, dst string")).first()
    counts = sorted(Counter(a for a, _ in rows).values(), reverse=True)
    for share in (1, 5, 10):
        k = max(1, int(np.ceil(len(counts) * share / 100)))
        assert r[f"top_{share}pct_share"] == pytest.approx(sum(counts[:k]) / len(rows))
    assert (r["edges"], r["median_leader"], r["max_out_degree"], r["reciprocal_pairs"]) == (len(rows), np.median(counts), counts[0], 1)
    assert r["max_in_degree"] == max(Counter(b for _, b in rows).values()) and r["nodes"] == len({x for e in rows for x in e})


def test_permutation_null_tells_a_hub_from_chance(spark):
    hub = [(f"n{k}", "hub") for k in range(40)]
    even = [(f"n{k}", f"n{(k + 7) % 40}") for k in range(40)]
    p = {name: graph.permuted_max_in_degree(spark.createDataFrame(e, "src string, dst string"), 99).first() for name, e in (("hub", hub), ("even", even))}
    assert p["hub"]["observed"] == 40 and p["hub"]["p_value"] == 0.01 and p["hub"]["permutations"] == 99
    assert p["even"]["observed"] == 1 and p["even"]["p_value"] == 1.0 and 2 < p["even"]["null_mean"] < 5
    again = graph.permuted_max_in_degree(spark.createDataFrame(hub, "src string, dst string").repartition(7), 99).first()
    assert again == p["hub"]


def test_strong_pairs_reach_their_recall(spark):
    rng = np.random.default_rng(3)
    days = [date(2024, 1, 1) + timedelta(k) for k in range(260)]
    common = rng.normal(size=(8, 260))
    series = {f"s{k:02d}": (1 if k % 3 else -1) * (common[k % 8] + rng.normal(scale=0.5, size=260)) for k in range(64)}
    rows = [(n, d, None if rng.random() < 0.02 else float(v)) for n, x in series.items() for d, v in zip(days, x)] + [("flat", d, 1.0) for d in days]
    df = spark.createDataFrame(rows, "id string, day date, value double")
    value = defaultdict(dict)
    for n, d, v in rows:
        if v is not None:
            value[n][d] = v
    want = {}
    for a in series:
        for b in series:
            if a < b:
                both = [d for d in days if d in value[a] and d in value[b]]
                c = np.corrcoef([value[a][d] for d in both], [value[b][d] for d in both])[0, 1]
                if abs(c) >= 0.7:
                    want[a, b] = (len(both), c)
    got = {(r["a"], r["b"]): (r["n"], r["correlation"]) for r in market.strong_pairs(df, 0.7, recall=0.99).collect()}
    assert len(want) > 150 and any(c < 0 for _, c in want.values())
    assert set(got) <= set(want) and len(got) >= 0.98 * len(want)
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in got)


def test_strong_pairs_with_a_lag(spark):
    rng = np.random.default_rng(8)
    days = [date(2024, 1, 1) + timedelta(k) for k in range(200)]
    x = rng.normal(size=200)
    rows = [("lead", d, float(v)) for d, v in zip(days, x)] + [("follow", days[k], float(x[k - 3])) for k in range(3, 200)] + [("noise", d, float(v)) for d, v in zip(days, rng.normal(size=200))]
    got = market.strong_pairs(spark.createDataFrame(rows, "id string, day date, value double"), 0.9, lags=(1, 3)).collect()
    assert [(r["a"], r["b"], r["lag"], r["n"]) for r in got] == [("lead", "follow", 3, 197)] and got[0]["correlation"] > 0.999


def test_bands_grow_with_recall():
    assert market.bands_for(0.8, 0.99, 8) < market.bands_for(0.8, 0.999, 8) < market.bands_for(0.6, 0.999, 8)
