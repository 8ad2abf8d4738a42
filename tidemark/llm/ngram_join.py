"""Similarity join of documents by the Jaccard index of their word n-grams.

1. Each whole text becomes its set of hashed five-word shingles (a shorter
   text with words is one shingle) and a MinHash signature. `banding`
   chooses bands and rows so that a pair at the threshold shares a band with
   at least the target recall.
2. Texts with one shingle set are one class from here on; only its
   representative (smallest doc_id, then text) goes on, under a number of the
   set's own, as one doc_id may stand on different texts.
3. Band hashes shuffle, without texts. A bucket of several representatives
   gives a star of edges to its smallest one, never its pairs. Connected
   stars bound where links can be: components.
4. Shingle sets shuffle once per component. A component too large for a task
   is dealt into blocks by hash; a task then holds two blocks. Within a task the
   pairs of different sets are verified exactly on the full sets, by counting
   shared shingles in matrix products; no pair becomes a row, only per-document
   link counts and a spanning forest leave the task. Counting the links of
   every document costs a component of n different sets n * n / 2 verifications
   (about 10 ns each), split into tasks of at most 2 * BLOCK_SETS sets.
5. The forests connect into final classes.

Words are runs of non-blanks, ASCII letters in lower case. A text without
words (null, empty, blank) is its own class with no links. A row is its doc_id
and its text: rows of one doc_id are told apart by text, and a null doc_id is
an id like others that comes last (the class_id is null where a class has no
other). Rows equal in both count as copies. Extra columns are ignored. An
empty table gives no rows. n_links counts the other documents at or over the
threshold, copies included.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, release, staged, text_key, text_of
from .exact_dedup import among, marked
from .nptext import U64, Batch, chunks, mix, shingles

SIZE, THRESHOLD, RECALL = 5, 0.8, 0.9995
#: A task's block: at most so many sets and shingles, unless one set is larger.
BLOCK_SETS, BLOCK_SHINGLES = 1000, 400_000
_MEAN = U64(0xA5A5F00D12345677)


@functools.cache
def banding(threshold: float = THRESHOLD, recall: float = RECALL, most: int = 256) -> tuple[int, int]:
    """The most rows per band whose bands reach the recall within `most` hashes,
    unless fewer rows need fewer than half the hashes."""
    best = None
    for rows in range(1, most + 1):
        miss = 1 - threshold**rows
        bands = max(1, math.ceil(math.log(1 - recall) / math.log(miss))) if miss > 0 else 1
        if bands * rows > most:
            break
        best = (bands, rows)
    return best


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240607)
    return rng.integers(1, 1 << 32, n, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, np.uint32)


def set_rows(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted by text, and where each text's begin."""
    b = Batch(texts, lower=True)
    starts, ends = b.words()
    owner = b.text_of(starts)
    h = b.hashes(starts, ends)
    n = np.bincount(owner, minlength=len(texts))
    sh, so = shingles(h, owner, size)
    for t in np.flatnonzero((n > 0) & (n < size)):
        own = h[owner == t]
        acc = np.zeros(1, U64)
        with np.errstate(over="ignore"):
            for w in own:
                acc = acc * U64(0xD6E8FEB86659FD93) + w
        sh, so = np.append(sh, mix(acc)), np.append(so, t)
    order = np.lexsort((sh, so))
    sh, so = sh[order], so[order]
    new = np.ones(len(sh), bool)
    new[1:] = (sh[1:] != sh[:-1]) | (so[1:] != so[:-1])
    sh, so = sh[new], so[new]
    return sh, np.searchsorted(so, np.arange(len(texts) + 1))


def signatures(sh: np.ndarray, at: np.ndarray, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Two set keys and the band hashes of each set; sets without shingles get zeros."""
    full = np.flatnonzero(at[1:] > at[:-1])
    begin = at[:-1][full]
    n = len(at) - 1
    keys, out = np.zeros((n, 2), U64), np.zeros((n, bands), U64)
    if not len(full):
        return keys, out
    with np.errstate(over="ignore"):
        keys[full, 0] = np.add.reduceat(mix(sh ^ _MEAN), begin)
        keys[full, 1] = np.bitwise_xor.reduceat(mix(sh + _MEAN), begin)
        x = (sh >> U64(32)).astype(np.uint32)
        a, c = _permutations(bands * rows)
        for band in range(bands):
            acc = np.full(len(full), U64(band + 1))
            for k in range(band * rows, band * rows + rows):
                v = x * a[k] + c[k]
                v ^= v >> np.uint32(15)
                v *= np.uint32(0x2C1B3C6D)
                acc = acc * U64(0xD6E8FEB86659FD93) + np.minimum.reduceat(v, begin)
            out[full, band] = mix(acc)
    return keys, out


def signed(docs: DataFrame, size: int, bands: int, rows: int, doc_id: str, text: str) -> DataFrame:
    def sign(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in chunks(texts):
                sh, at = set_rows(texts[lo:hi], size)
                keys, out = signatures(sh, at, bands, rows)
                signed64 = out.view(np.int64).reshape(-1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(signed64) + 1, bands, dtype=np.int32)), pa.array(signed64))
                columns = [batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(np.diff(at)), *(pa.array(keys[:, k].view(np.int64)) for k in (0, 1)), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", "n", "k1", "k2", "bands"])

    body = text_of(docs, text)
    rows_ = docs.select(docs[doc_id].cast("long").alias("doc_id"), body.alias("text"), text_key(body).alias("key"))
    return rows_.mapInArrow(sign, "doc_id long, key binary, n long, k1 long, k2 long, bands array<long>")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of an undirected graph given as edges (a, b).

    Alternating large and small stars: each round is a few shuffles of the
    edges, which stay linear; about log(diameter) rounds. The minima are written
    before they are joined back, so that the adaptive plan can split the edges
    of a node with very many.
    """
    edges = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = staged(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "low")
        large = staged(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct(), "large")
        floor = staged(large.groupBy("a").agg(F.min("b").alias("m")), "floor")
        small = large.join(floor, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        after = staged(small, "edges")
        # finished when every node hangs directly on a node that hangs on nothing
        tall = after.join(after.select(F.col("a").alias("b")).distinct(), "b", "left_semi").limit(1).count()
        twice = after.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
        release(edges, low, large, floor)
        edges = after
        if not tall and not twice:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def verify(ids: np.ndarray, block: np.ndarray, copies: np.ndarray, sets: list[np.ndarray], pair: tuple[int, int], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each set to sets of the other block (all sets if the blocks are
    one), counted in copies, and the smallest id of its component here."""
    n = len(ids)
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    who = np.repeat(np.arange(n), size)
    _, col, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[col] > 1
    renum = np.cumsum(times > 1) - 1
    who, col = who[shared], renum[col[shared]]
    width = int((times > 1).sum())
    order = np.argsort(col, kind="stable")
    who, col = who[order], col[order]
    common = np.zeros((n, n), np.float32)
    step = max(1, min(4096, 8_000_000 // max(n, 1)))
    for lo in range(0, width, step):
        i, j = np.searchsorted(col, (lo, lo + step))
        part = np.zeros((n, min(step, width - lo)), np.float32)
        part[who[i:j], col[i:j] - lo] = 1
        common += part @ part.T
    union = size[:, None] + size[None, :] - common
    linked = common >= threshold * union - 1e-6
    np.fill_diagonal(linked, False)
    if pair[0] != pair[1]:
        linked &= block[:, None] != block[None, :]
    links = linked @ copies
    rank = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
    label = rank.astype(np.int64)
    while True:  # smallest label over the links, with pointer jumps
        near = np.where(linked, label[None, :], n).min(axis=1, initial=n)
        new = np.minimum(label, near)
        back = np.empty(n, np.int64)
        back[rank] = new
        new = np.minimum(new, back[new])
        if (new == label).all():
            break
        label = new
    sorted_ids = ids[np.argsort(ids, kind="stable")]
    return links, sorted_ids[label]


def classified(docs: DataFrame, size: int, threshold: float, recall: float, doc_id: str, text: str) -> DataFrame:
    """One row per document: doc_id, key (of its text), the row that leads its class
    (lead_id, lead_key; null for texts without words), class_size, n_links, n_copies, n_shingles."""
    spark = docs.sparkSession
    ready(spark)
    bands, rows = banding(threshold, recall)
    sig = staged(signed(docs, size, bands, rows, doc_id, text), "signed")
    least = F.min(F.struct(F.isnull("doc_id").alias("nil"), "doc_id", "key", "n", "bands")).alias("m")
    sets = sig.where("n > 0").groupBy("k1", "k2").agg(least, F.count("*").alias("copies"))
    sets = staged(sets.select(F.monotonically_increasing_id().alias("set"), "k1", "k2", F.col("m.doc_id").alias("rep"), "m.key", F.col("m.n").alias("n"), "copies", F.col("m.bands").alias("bands")), "sets")
    banded = sets.select("set", F.posexplode("bands").alias("band", "h"))
    stars = staged(banded.groupBy("band", "h").agg(F.min("set").alias("b"), F.max("set").alias("top")).where("b < top").select("band", "h", "b"), "stars")
    edges = banded.join(stars, ["band", "h"]).select(F.col("set").alias("a"), "b").where("a > b")
    comp = components(edges)
    comp = comp.unionByName(comp.select(F.col("root").alias("node"), "root").distinct())
    member = staged(comp.select(F.col("node").alias("set"), F.col("root").alias("comp")).join(sets.select("set", "rep", "key", "n", "copies"), "set"), "members")
    release(stars)
    weight = member.groupBy("comp").agg(F.count("*").alias("sets"), F.sum("n").alias("all"))
    nb = F.greatest(F.lit(1), F.ceil(F.col("sets") / BLOCK_SETS), F.ceil(F.col("all") / BLOCK_SHINGLES)).cast("int")
    weight = staged(weight.select("comp", nb.alias("nb")), "weights")
    dealt = member.drop("n").join(weight, "comp").withColumn("block", F.pmod(F.xxhash64("set"), F.col("nb")).cast("int"))
    # the texts of the members, shingled again: far fewer than all
    body = text_of(docs, text)
    body = docs.select(docs[doc_id].cast("long").alias("id"), body.alias("text"), text_key(body).alias("own"))
    held = among(body, ("id", "own"), member.select(F.col("rep").alias("id"), F.col("key").alias("own")))
    held = held.join(dealt, F.col("id").eqNullSafe(F.col("rep")) & (F.col("own") == F.col("key")))

    def shingled(batches):
        seen: set[int] = set()  # rows equal in id and text
        for batch in batches:
            fresh = np.ones(len(batch), bool)
            for k, s in enumerate(batch.column(0).to_pylist()):
                fresh[k] = s not in seen
                seen.add(s)
            batch = batch.filter(pa.array(fresh))
            texts = batch.column(1).to_pylist()
            for lo, hi in chunks(texts):
                sh, at = set_rows(texts[lo:hi], size)
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(sh.view(np.int64)))
                own = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([own.column(0), *own.columns[2:], lists], names=["set", "comp", "copies", "nb", "block", "grams"])

    held = held.select("set", "text", "comp", "copies", "nb", "block").mapInArrow(shingled, "set long, comp long, copies long, nb int, block int, grams array<long>")
    held = staged(held, "grams")
    pairs_of = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    pairs_of = pairs_of.select("comp", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "set", "block", "copies", "grams")

    def pairs(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.drop_duplicates("set")
        ids = part["set"].to_numpy(np.int64)
        links, low = verify(ids, part["block"].to_numpy(), part["copies"].to_numpy(np.int64), [np.asarray(g, np.int64) for g in part["grams"]], (key[1], key[2]), threshold)
        return pd.DataFrame({"set": ids, "links": links.astype(np.int64), "low": low})

    found = staged(pairs_of.groupBy("comp", "lo", "hi").applyInPandas(pairs, "set long, links long, low long"), "links")
    release(held, member, weight)
    links = found.groupBy("set").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("set").alias("a"), F.col("low").alias("b")))
    classes = sets.select("set", "k1", "k2", "rep", "key", "copies").join(links, "set", "left").join(roots.select(F.col("node").alias("set"), "root"), "set", "left")
    classes = staged(classes.select("k1", "k2", "rep", "key", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "set").alias("root")), "classes")
    lead = F.min(F.struct(F.isnull("rep").alias("nil"), "rep", "key")).alias("lead")
    sizes = classes.groupBy("root").agg(F.sum("copies").alias("class_size"), lead)
    joined = classes.drop("rep", "key").join(sizes, "root").select("k1", "k2", "copies", "links", "class_size", F.col("lead.rep").alias("lead_id"), F.col("lead.key").alias("lead_key"))
    named = staged(joined, "classed")
    release(sets, found, classes)
    keyed = sig.select("doc_id", "key", "n", "k1", "k2")
    out = keyed.where("n > 0").join(named, ["k1", "k2"]).select("doc_id", "key", "lead_id", "lead_key", "class_size", (F.col("links") + F.col("copies") - 1).alias("n_links"), (F.col("copies") - 1).alias("n_copies"), F.col("n").alias("n_shingles"))
    nothing = [F.lit(0).cast("long").alias(c) for c in ("n_links", "n_copies")]
    alone = keyed.where("n = 0").select("doc_id", "key", F.col("doc_id").alias("lead_id"), F.lit(None).cast("binary").alias("lead_key"), F.lit(1).cast("long").alias("class_size"), *nothing, F.col("n").alias("n_shingles"))
    return out.unionByName(alone)


def ngram_join(docs: DataFrame, size: int = SIZE, threshold: float = THRESHOLD, recall: float = RECALL, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id (the smallest doc_id of its class,
    through links), class_size, n_links, n_copies, n_shingles."""
    rows = classified(docs, size, threshold, recall, doc_id, text)
    return rows.select("doc_id", F.col("lead_id").alias("class_id"), "class_size", "n_links", "n_copies", "n_shingles")


def one_of_each(docs: DataFrame, size: int = SIZE, threshold: float = THRESHOLD, recall: float = RECALL, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that lead their class, with all columns: one row of each class, and
    every text without words. Of rows equal in doc_id and text any one leads."""
    found = classified(docs, size, threshold, recall, doc_id, text).where("lead_key is not null")
    leads = F.col("doc_id").eqNullSafe(F.col("lead_id")) & (F.col("key") == F.col("lead_key"))
    found = staged(found.groupBy("doc_id", "key").agg(F.first(leads).alias("leads"), F.count("*").alias("times")).where("not leads or times > 1"), "dropped")
    body = text_of(docs, text)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[doc_id].cast("long").alias("doc_id"), text_key(body).alias("key"))
    rows = marked(rows, ("doc_id", "key"), found)
    some, other = rows.where("_maybe"), found.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "leads")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))
    clear = some.join(other, same, "left_anti").select("row")
    kept = rows.where("not _maybe").select("row").unionByName(clear)
    if found.where("leads").limit(1).count():
        again = some.join(other.where("leads"), same, "left_semi")
        kept = kept.unionByName(again.groupBy("doc_id", "key").agg(F.first("row").alias("row")).select("row"))
    return kept.select("row.*")
