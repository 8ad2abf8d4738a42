import random

import pytest

from tidemark.operators import lifecycles
from tidemark.queries import research

SF = "/root/testdata/sf0.001"


def climbed(records):
    """Stage, version and refusals of one claim, record by record."""
    stages, at, version, refused, ended = lifecycles.CLAIM_STAGES, 0, 1, 0, None
    for stage, kind, passed in records:
        k = stages.index(stage) if stage in stages else None
        if ended or kind == "paper" or k is None or k not in (at, at + 1):
            refused += 1
            continue
        version += 1
        if not passed:
            ended = "REJECTED"
        else:
            at = k
            ended = stages[k] if k == len(stages) - 1 else None
    return ("REJECTED" if ended == "REJECTED" else stages[at]), version, refused


def test_claims_climb_like_a_plain_loop(spark):
    rng = random.Random(4)
    rows = []
    for claim in range(150):
        k = 0
        for n in range(rng.randrange(1, 25)):
            k = min(5, max(0, k + rng.choice([0, 0, 1, 1, 1, 2, -1])))
            stage = rng.choice([None, "ELSEWHERE"]) if rng.random() < 0.05 else lifecycles.CLAIM_STAGES[k]
            rows.append((claim, n, stage, rng.choice(["paper", "run", "run", None]), rng.choice([True] * 12 + [False, None])))
    want = {c: climbed([r[2:] for r in rows if r[0] == c]) for c in range(150)}
    got = lifecycles.claim_stages(spark.createDataFrame(rows, "claim int, n int, stage string, evidence_type string, passed boolean"), "claim", ["n"])
    assert {r.claim: (r.stage, r.version, r.refused) for r in got.collect()} == want
    assert {"REJECTED", "PROMOTED", "HYPOTHESIS"} <= {w[0] for w in want.values()}


def test_claim_query_equals_a_plain_loop(spark):
    by = {}
    for r in research.claim_records(spark, SF).collect():
        by.setdefault(r.l_orderkey, []).append(r)
    want = {k: climbed([(r.stage, r.evidence_type, r.passed) for r in sorted(v, key=lambda r: tuple(r[c] for c in research.CLAIM_ORDER))]) for k, v in by.items()}
    assert {r.l_orderkey: (r.stage, r.version, r.refused) for r in research.r3_claims(spark, SF).collect()} == want


def test_gates_in_order(spark):
    g = lifecycles.GATES
    rows = [("all", n, 1, True) for n in g] + [("fails", n, 1, n != g[3]) for n in g] + [("waits", g[0], 1, True), ("waits", g[2], 1, True)] + [("again", g[0], 1, False), ("again", g[0], 2, True)] + [("odd", "x", 1, True), ("null", g[0], 1, None)]
    got = lifecycles.gate_states(spark.createDataFrame(rows, "h string, gate string, n int, passed boolean"), "h", ["n"]).collect()
    assert {r.h: (r.passed, r.next_gate, r.status, r.skipped) for r in got} == {
        "all": (8, None, "VALIDATED", 0), "fails": (3, g[3], "REJECTED", 4), "waits": (1, g[1], "IN_PROGRESS", 1), "again": (1, g[1], "IN_PROGRESS", 0), "odd": (0, g[0], "IN_PROGRESS", 0), "null": (0, g[0], "REJECTED", 0),
    }


@pytest.mark.parametrize("kind", sorted(lifecycles.STEPS))
def test_every_pair_of_states(spark, kind):
    steps = lifecycles.STEPS[kind]
    pairs = [(a, b) for a in steps for b in steps]
    rows = [(k, n, s) for k, pair in enumerate(pairs) for n, s in enumerate(pair)]
    got = lifecycles.illegal_steps(spark.createDataFrame(rows, "k int, n int, s string"), "k", "n", "s", kind).collect()
    assert {(r["from"], r["to"]) for r in got} == {(a, b) for a, b in pairs if a != b and b not in steps[a]}
