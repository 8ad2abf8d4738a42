import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import pytest

from tidemark.llm import spelling


def brute_counts(rows):
    out = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                p = h % len(run)
                run = run[:p] + run[p + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(counts):
    near = defaultdict(list)
    for a, b in combinations(counts, 2):
        if one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, n in counts.items():
        if near[w]:
            best = min(near[w], key=lambda v: (-counts[v], v))
            if counts[best] >= 5 * n:
                form[w] = best
    out = set()
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(near[w]), counts[form[w]] if w in form else None))
    return out


def rows_of(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def made_words(rng, k):
    """Families of words around common stems, with repeated letters so that edits can stand in several places."""
    out = set()
    stems = ["aaaaaa", "abcabcab", "éèàüöß", "runnning", "internation"]
    while len(out) < k:
        w = list(rng.choice(stems) + "".join(rng.choice("abé") for _ in range(rng.randrange(4))))
        for _ in range(rng.randrange(3)):
            p = rng.randrange(len(w))
            kind = rng.randrange(3)
            w[p : p + (kind > 0)] = [rng.choice("abcé")] * (kind < 2)
        out.add("".join(w))
    return sorted(out)


def test_automaton_numbers_words_and_is_minimal():
    rng = random.Random(1)
    words = made_words(rng, 400)
    a = spelling.Automaton(words)
    assert [a.number(w) for w in words] == list(range(len(words)))
    assert a.number("zzz") == -1 and a.number(words[0][:2]) == -1
    ends = {}
    for w in words:  # as many states as there are distinct sets of endings
        for k in range(len(w) + 1):
            ends.setdefault(w[:k], set()).add(w[k:])
    assert len(a.steps) == len({frozenset(e) for e in ends.values()})


def test_near_is_complete_on_one_group():
    rng = random.Random(4)
    words = made_words(rng, 300)
    a = spelling.Automaton(words)
    for w in words:
        got = [words[k] for s in (True, False) for k in a.near(w, 0, s)]
        assert sorted(got) == [v for v in words if one_edit(w, v)]


@pytest.mark.parametrize("most, chunk", [(spelling.MOST, spelling.CHUNK), (3, 50), (1, 1)])
def test_variants_match_brute_force(spark, most, chunk):
    rng = random.Random(3)
    words = made_words(rng, 250)
    rows = []
    for i in range(60):
        text = [rng.choice("abcdefgh") + "x"] + [w.upper() if rng.random() < 0.1 else w for w in rng.choices(words, [1 + (k % 17) ** 3 for k in range(len(words))], k=300)]
        rows.append((rng.choice([None, i]), rng.choice([" ", "1", "-×", "\n"]).join(text)))
    rows += [(None, None), (3, ""), *rows[:2]]
    docs = spark.createDataFrame([(*r, "w", 1) for r in rows], "doc_id long, text string, word string, n int").repartition(4)
    want = brute(brute_counts(rows))
    assert len(want) > 100 and any(r[1] for r in want) and any(r[1] and r[1] != r[2] for r in want)
    assert rows_of(spelling.variants(docs, most=most, chunk=chunk)) == want


def test_variants_of_awkward_and_given_rows(spark, awkward, empty, sf):
    from .conftest import AWKWARD

    assert rows_of(spelling.variants(awkward)) == brute(brute_counts([r[:2] for r in AWKWARD]))
    assert spelling.variants(empty).count() == 0
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert rows_of(spelling.variants(docs)) == brute(brute_counts([(r.doc_id, r.text) for r in docs.collect()]))


def test_long_words(spark):
    base = "".join(random.Random(3).choice("abcd") for _ in range(3000))
    other = base[:2000] + "é" + base[2001:]
    rows = [(k, f"{base} {base} {base[:-1]}" + f" {other}" * (k == 0)) for k in range(5)] + [(9, f"{other} " * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(spelling.variants(docs)) == brute(brute_counts(rows))


def test_full_groups_are_cut(spark):
    words = spark.createDataFrame([(f"{p}{k:03d}".translate(str.maketrans("0123456789", "abcdefghij")), 5) for p in ("stemword", "wordstem") for k in range(1000)], "word string, n long")
    rows = spelling.groups(words, 50)
    sizes = [(r.size, r.width) for r in rows.groupBy("g").agg({"*": "count", "hi": "max", "lo": "max"}).selectExpr("`count(1)` as size", "`max(hi)` - `max(lo)` as width").collect()]
    assert all(size <= 50 or width == 1 for size, width in sizes)
