import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import subwords

PIECES = ["'s", "'r", "e", "'", "re", "ve", "'l", "l", "!", "''", "!!", "1", "é", "́", "̣", "a", "b", "the", "ing", "<|endoftext|>", "<|", "|>", "A", "İ", "ß", "中", "文", "ᄀ", "ᅡ", "ᆨ", "가", " ", " ", "　", " ", "\x1c", "٣", "😀", "word"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(subwords.default_words())
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture
def small_window(monkeypatch):
    monkeypatch.setattr(subwords, "FIRST_WINDOW", 3)


def by_tree(text, leaf):
    s = subwords.subwords(subwords.default_words())
    leaves = s.leaves(text, leaf)
    assert "".join(leaves) == text
    return s.tree([(t, s.whole(t)) for t in leaves]).tolist()


def test_tree_equals_whole_encoding(library, small_window):
    rng = random.Random(2)
    for _ in range(1500):
        some = rng.sample(PIECES, rng.randrange(2, len(PIECES)))
        text = "".join(rng.choice(some) for _ in range(rng.randrange(120)))
        assert by_tree(text, rng.choice([1, 3, 17])) == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PIECES) | st.characters(exclude_categories=["Cs"]), max_size=60), st.sampled_from([1, 2, 9]))
def test_tree_equals_whole_encoding_of_any_text(parts, leaf):
    text = "".join(parts)
    whole = Tokenizer.from_file(subwords.default_words()).encode(text, add_special_tokens=False).ids
    assert by_tree(text, leaf) == whole
    assert subwords.subwords(subwords.default_words()).texts([text])[0].tolist() == whole


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["'", "'s", "re", "<|endoftext|>", "x"]) | st.characters(max_codepoint=0x180), max_size=30))
def test_words_by_pieces_equal_whole_encoding(parts):
    text = "".join(parts)
    s = subwords.subwords(subwords.default_words())
    assert s.split is not None
    assert s.texts([text])[0].tolist() == s.whole(text).tolist()


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 3000, "." * 5001, "'s" * 2500, "́" * 4000, "e" + "̣́" * 2000, "<|endoftext|>" * 300, "ᄀ" * 3000])
def test_long_runs(library, text):
    assert by_tree(text, 100) == library.encode(text, add_special_tokens=False).ids


def test_contractions_are_single_tokens(library):
    """An edge inside a contraction cannot occur, which the join relies on."""
    assert all(len(library.encode(c, add_special_tokens=False).ids) == 1 for c in ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d"))


def test_query_matches_library(spark, awkward, empty, library, sf):
    rng = random.Random(8)
    runs = ["".join(rng.choice("abcdeéxyz'!1") for _ in range(n)) for n in (300, 4000)]
    extra = spark.createDataFrame([(100 + k, t, "x", 1) for k, t in enumerate([*runs, *runs, " ".join(runs), "<|startoftext|>" + runs[1] + "<|endoftext|>"])], "doc_id long, text string, ids string, row int")
    docs = awkward.select("doc_id", "text", "word", "row").withColumnRenamed("word", "ids").unionByName(extra.withColumn("row", extra.row.cast("string")))
    want = []
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    for leaf in (100, subwords.LEAF):
        for both in (subwords.encode(docs, leaf=leaf, decoded=True), subwords.decode(subwords.encode(docs, leaf=leaf))):
            got = subwords.digests(both)
            assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert subwords.digests(subwords.decode(subwords.encode(empty))).count() == 0


def test_round_trip_of_a_table(spark, sf, library):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in subwords.decode(subwords.encode(spark.read.parquet(f"{sf}/documents.parquet"))).collect()}
    assert len(got) == len(rows)
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert got[r.doc_id].ids == ids and got[r.doc_id].text == library.decode(ids, skip_special_tokens=False)
