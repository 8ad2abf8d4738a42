import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import encoders, exact_dedup, packing


def normal(t):
    return "".join(c for c in (t or "") if c not in " \t\n\x0b\x0c\r")


def brute_dedup(rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[normal(t)].append((i, t or ""))
    out = []
    for body, members in groups.items():
        best = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))
        out += [(i, best[0], len(members), hashlib.sha256(body.encode()).hexdigest()) for i, _ in members]
    return sorted(out, key=str)


def test_dedup_matches_brute_force(spark, awkward):
    from .conftest import AWKWARD

    got = exact_dedup.exact_dedup(awkward).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == brute_dedup(AWKWARD)
    for key in {r.text_sha256 for r in got}:
        assert sum(r.kept for r in got if r.text_sha256 == key) == 1


@pytest.mark.parametrize("bits", [1, 150])  # one nearly full filter, three slices
def test_dedup_is_exact_however_full_the_filter(spark, bits):
    rng = random.Random(3)
    rows = [(i, "x" * rng.randrange(200) + " " * rng.randrange(3)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = exact_dedup.exact_dedup(df, bits_per_row=bits, max_bits=1 << 15).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == brute_dedup(rows)
    kept = exact_dedup.keep_first(df, bits_per_row=bits, max_bits=1 << 15).collect()
    assert sorted(r.doc_id for r in kept) == sorted({k for _, k, *_ in brute_dedup(rows)})


def test_filter_lets_unique_rows_pass(spark):
    df = spark.range(2000).selectExpr("id as doc_id", "cast(id % 1900 as string) as text")
    marked, *_ = exact_dedup.groups_of(exact_dedup.keyed(df), 16, 1 << 20)
    rows = marked.selectExpr("doc_id", "_maybe").collect()
    assert all(r._maybe for r in rows if r.doc_id < 100 or r.doc_id >= 1900)
    assert sum(r._maybe for r in rows) < 200 + 300


def test_keep_first_keeps_columns(spark, awkward, empty):
    kept = exact_dedup.keep_first(awkward)
    assert kept.columns == awkward.columns
    assert sorted(normal(r.text) for r in kept.collect()) == sorted({normal(r.text) for r in awkward.collect()})
    assert exact_dedup.keep_first(empty).count() == 0 and exact_dedup.exact_dedup(empty).count() == 0


def hf():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=80), st.lists(st.sampled_from(["<|endoftext|>", "<|endoftext", "|>", " ", "a", "\n", "é"]), max_size=12).map("".join)))
def test_ids_equal_the_json_tokenizer(text):
    test_ids_equal_the_json_tokenizer.t = getattr(test_ids_equal_the_json_tokenizer, "t", None) or hf()
    assert encoders.ids_of(encoders.default_ranks(), text).tolist() == test_ids_equal_the_json_tokenizer.t.encode(text, add_special_tokens=False).ids


def test_ids_equal_on_odd_texts():
    t = hf()
    for text in ("<|endoftext|>", "a b c　d", "  \n\n  x", "x" * 3000, "ab" * 2000, "\U0001f600é中" * 300, "don't we'LL 3.14 __x__"):
        assert encoders.ids_of(encoders.default_ranks(), text).tolist() == t.encode(text, add_special_tokens=False).ids


def check_packed(rows, docs, max_len):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= max_len
    path, total = encoders.default_ranks(), 0
    for i, text in docs:
        ids = np.append(encoders.ids_of(path, text or ""), np.uint32(0)).astype("<u4")
        parts = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(len(parts))) and sum(r.length for r in parts) == len(ids)
        assert len(parts) == 1 or all(r.length == max_len for r in parts[1:])
        for r in parts:
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        total += len(ids)
    return len(by_sequence), total


def test_packing_round_trip(spark):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice(["alpha", "beta", "x", "né"]) for _ in range(rng.randrange(0, 700)))) for i in range(300)] + [(1000, None), (1001, "")]
    rows = packing.pack(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), max_len=256).collect()
    sequences, total = check_packed(rows, docs, 256)
    assert sequences <= -(-total // 256) + 2


def test_packing_edge_cases(spark, awkward, empty):
    assert packing.pack(empty).count() == 0
    special = spark.createDataFrame([(1, "a <|endoftext|> b")], "doc_id long, text string")
    ids = np.array([*hf().encode("a <|endoftext|> b", add_special_tokens=False).ids, 0], "<u4")
    assert [(r.length, r.ids_crc32) for r in packing.pack(special).collect()] == [(len(ids), zlib.crc32(ids.tobytes()))]
    rows = packing.pack(awkward).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    assert sum(r.doc_id == 2 for r in rows) == 2 and sum(r.doc_id is None for r in rows) == 1


def brute_fullest(lengths, cap):
    best = 0
    for mask in range(1 << len(lengths)):
        s = sum(x for k, x in enumerate(lengths) if mask >> k & 1)
        best = max(best, s if s <= cap else 0)
    return best


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=10), st.integers(0, 60))
def test_fullest_is_the_best_subset(lengths, cap):
    counts = defaultdict(int)
    for x in lengths:
        counts[x] += 1
    found = packing.fullest(counts, cap, sorted(counts, reverse=True))
    assert sum(x * m for x, m in found) == brute_fullest(lengths, cap)
    assert all(m <= counts[x] for x, m in found)


def test_plan_places_everything():
    rng = random.Random(1)
    histogram = defaultdict(int)
    for _ in range(5000):
        histogram[rng.randrange(1, 2049)] += 1
    plan = packing.plan(histogram, 2048)
    placed = defaultdict(int)
    for times, pattern in plan:
        assert sum(x * m for x, m in pattern) <= 2048
        for x, m in pattern:
            placed[x] += m * times
    assert placed == histogram
    assert sum(t for t, _ in plan) <= sum(k * v for k, v in histogram.items()) / 2048 * 1.02
