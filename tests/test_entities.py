import math
import random
import re

import pytest

from tidemark.functions.text import STOP
from tidemark.operators import entities
from tidemark.queries import QUERIES

WORDS = ["nile", "delta", "cement", "food", "red", "sea", "bank", "steel", "Company", "Holding", "of", "é"]


def words(name):
    return {w for w in re.split(r"[\W_]+", (name or "").lower()) if w and w not in STOP}


def made(rng, n, most):
    return [(k, " ".join(rng.choices(WORDS, k=rng.randrange(most))) if rng.random() > 0.03 else None) for k in range(n)]


@pytest.fixture(scope="module")
def names():
    rng = random.Random(6)
    return made(rng, 120, 4), made(rng, 300, 6)


@pytest.mark.parametrize("hot", [0, 40, entities.HOT])
def test_legal_matches_equal_brute_force(spark, names, hot):
    companies, registry = names
    got = entities.legal_matches(spark.createDataFrame(companies, "company_id long, name string"), spark.createDataFrame(registry, "entity_id long, legal_name string"), hot).collect()
    assert len(got) == len(companies)
    for r in got:
        q = words(r.name)
        fits = [(-len(q) / len(words(n)), k, n) for k, n in registry if q and q <= words(n)]
        if fits:
            share, k, n = min(fits)
            assert (r.entity_id, r.legal_name, r.rejection_reason) == (k, n, None) and math.isclose(r.confidence, -share)
        else:
            assert r.entity_id is None and r.confidence is None and ("no significant" in r.rejection_reason) == (not q)


@pytest.mark.parametrize("least", [0.3, 0.6, 1.0])
def test_similar_names_equal_brute_force(spark, names, least):
    companies, registry = names
    got = entities.similar_names(spark.createDataFrame(companies, "company_id long, name string"), spark.createDataFrame(registry, "entity_id long, legal_name string"), least).collect()
    asked, known = {}, {}
    for k, n in companies:
        asked.setdefault(frozenset(words(n)), []).append(k)
    for k, n in registry:
        known.setdefault(frozenset(words(n)), k)
    sets = {s for s in (*asked, *known) if s}
    weight = {w: math.log(1 + len(sets) / sum(w in s for s in sets)) for s in sets for w in s}
    total = lambda s: sum(weight[w] for w in s)
    want = {(min(ids), known[k], len(ids)): total(q & k) / total(q | k) for q, ids in asked.items() for k in known if q and k and total(q & k) / total(q | k) >= least - 1e-12}
    assert {(r.company_id, r.entity_id, r.companies) for r in got} == set(want) and len(got) == len(want)
    assert all(math.isclose(r.similarity, want[r.company_id, r.entity_id, r.companies]) for r in got)


def test_claims(spark):
    companies = spark.createDataFrame([("A",), ("B",), ("C",)], "company_id string")
    proposals = spark.createDataFrame([("A", "x", "a1"), ("A", "y", "a2"), ("A", "z", "a3"), ("B", "y", "b2"), ("B", "z", "b3")], "company_id string, source string, hostname string")
    probes = spark.createDataFrame([("a1", False, "404"), ("a2", True, None), ("a3", True, None), ("b2", False, "timeout")], "hostname string, reachable boolean, reason string")
    got = {(r.company_id, r.source): (r.value, r.status, r.confidence, r.rejection_reason) for r in entities.website_claims(companies, proposals, probes, ["x", "y", "z"]).collect()}
    nothing = "the strategy proposed nothing"
    assert got == {
        ("A", "x"): ("a1", "REFUTED", 1.0, "404"), ("A", "y"): ("a2", "CONFIRMED", 0.8333, None), ("A", "z"): ("a3", "UNVERIFIED", 0.6667, None),
        ("B", "x"): (None, "NOT_FOUND", 0.0, nothing), ("B", "y"): ("b2", "REFUTED", 0.8333, "timeout"), ("B", "z"): ("b3", "UNVERIFIED", 0.6667, None),
        ("C", "x"): (None, "NOT_FOUND", 0.0, nothing), ("C", "y"): (None, "NOT_FOUND", 0.0, nothing), ("C", "z"): (None, "NOT_FOUND", 0.0, nothing),
    }


def test_legal_claims_and_rates(spark):
    m = entities.legal_matches(spark.createDataFrame([(1, "Nile Food"), (2, "Delta")], "company_id long, name string"), spark.createDataFrame([(7, "Nile Food Holding"), (8, "Nile Food Bank")], "entity_id long, legal_name string"))
    claims = entities.legal_claims(m, "registry")
    got = {r.company_id: r for r in claims.collect()}
    assert (got[1].value, got[1].status, got[1].confidence) == ("Nile Food Holding", "CONFIRMED", 1.0)
    assert (got[2].value, got[2].status, got[2].confidence) == (None, "NOT_FOUND", 0.0)
    rates = entities.resolution_rates(claims.selectExpr("*", "'legal_name' as attribute")).collect()
    assert {(r.source, r.companies, r.resolved) for r in rates} == {("registry", 1, 1), (None, 1, 0)}


def test_names_in_parts_come_once_per_row_and_parts_are_not_broadcast(spark, tmp_path):
    rows = [(1, "red bolt", "SMALL"), (1, "red bolt", "SMALL"), (2, "small gear", "RED bolt"), (3, "red bolt", None), (4, None, "red bolt"), (5, "", "gear small")]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_type string").write.parquet(str(tmp_path / "part.parquet"))
    got = QUERIES["j17_name_containment"](spark, str(tmp_path))
    assert sorted((r.p_partkey, r.name) for r in got.collect()) == [(1, "red bolt"), (1, "red bolt"), (2, "red bolt"), (2, "small gear"), (5, "small gear")]
    large = spark.range(200_000).selectExpr("id as p_partkey", "concat('red ', id % 64) as p_name", "concat('t', id % 6) as p_type")
    large.write.parquet(str(tmp_path / "large" / "part.parquet"))
    plan = QUERIES["j17_name_containment"](spark, str(tmp_path / "large"))._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan
