import random
import re
from collections import defaultdict
from itertools import permutations

import pytest

from tidemark.llm import filter_audit


def brute(rows, labels):
    """rows: (doc_id, source, text). Every order is applied to every document, step by step."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, _, t in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    fails = []
    for i, _, t in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        found = ""
        found += "A" * (len(words) < 200)
        found += "B" * (100 * len(set(words)) < 50 * len(words))
        found += "C" * (100 * len(re.findall("[A-Z]", t)) > 2 * len(t))
        found += "D" * any(c in t for c in "#$%&*|")
        found += "E" * (i is not None and i > least[t])
        fails.append(set(found))
    parts = defaultdict(list)
    for k, (_, s, _) in enumerate(rows):
        parts[s or ""].append(k)
    out, shapley = {}, defaultdict(int)
    for part, members in parts.items():
        for order in map("".join, permutations("ABCDE")):
            left = list(members)
            for step, f in enumerate(order, 1):
                lost = [k for k in left if f in fails[k]]
                removed = set(members) - set(left)
                left = [k for k in left if f not in fails[k]]
                shapley[part, f] += len(lost)
                out[part, order, step] = [
                    len(left), len(lost), sum(f in fails[k] for k in removed), sum(fails[k] == {f} for k in members),
                    sum(rows[k][0] in good for k in lost), sum(rows[k][0] in toxic for k in lost),
                ]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def collected(df):
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert df.columns == ["part", "filter_order", "step", *names]
    rows = df.collect()
    out = {(r.part, r.filter_order, r.step): tuple(r[n] for n in names) for r in rows}
    assert len(out) == len(rows)
    return out


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, n long, mask int")


def test_audit_matches_brute_force(spark):
    rng = random.Random(5)
    pool = ["%s%d" % (rng.choice("abCDeé"), k) for k in range(400)]
    texts = [None, "", " \t", "A" * 30, "# " * 300]
    for _ in range(60):
        words = [rng.choice(pool[: rng.choice((3, 90, 400))]) for _ in range(rng.choice((5, 150, 199, 200, 201, 500)))]
        texts.append(" ".join(words).lower() if rng.random() < 0.7 else "\n".join(words) + rng.choice(["", " $", "|"]))
    rows = [(rng.choice([None, *range(90)]), rng.choice(["x", "y", None, ""]), rng.choice(texts)) for _ in range(400)]
    rows += rows[:40] + [(7, "hot", "one text")] * 50 + [(k, "hot", "one text") for k in range(80)]
    labels = [(rng.choice([None, *range(100)]), rng.choice([0, 1, None]), rng.choice([0, 1, None]), 0, 0) for _ in range(120)]
    docs = spark.createDataFrame([(*r, 1, 0) for r in rows], "doc_id long, source string, text string, n long, mask int").repartition(5)
    want = brute(rows, [x[:3] for x in labels])
    assert {bits for _, v in want.items() for bits in [v[3] > 0]} == {True, False}
    assert collected(filter_audit.audit(docs, labels_of(spark, labels))) == want


def test_audit_of_awkward_rows(spark, awkward, empty):
    from .conftest import AWKWARD

    docs = awkward.withColumnRenamed("lang", "source")
    none = labels_of(spark, [])
    want = brute([(i, g, t) for i, t, g in AWKWARD], [])
    assert collected(filter_audit.audit(docs, none)) == want
    assert filter_audit.audit(empty.withColumnRenamed("lang", "source"), none).count() == 0


def test_orders_are_all_permutations():
    steps = filter_audit.orders()
    assert len({o for o, *_ in steps}) == 120 and len(steps) == 600
    assert all(bin(before).count("1") == step - 1 and not before & bit for _, step, before, bit in steps)


@pytest.mark.parametrize("name", ["xxhash64", "sha2"])
def test_plan_has_no_python(spark, sf, name):
    d = lambda t: spark.read.parquet(f"{sf}/{t}.parquet")
    plan = filter_audit.alike_rows(d("documents"), d("labels"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and name in plan
