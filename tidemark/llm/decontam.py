"""Benchmark decontamination by the q-gram lemma.

Texts are folded: lower case, every run of other than letters and digits one
space. A benchmark item longer than `unit` is cut into overlapping units; an
alignment of a unit of w characters with at most e edits shares at least
w + 1 - q(e + 1) of its q-grams with the text, on diagonals no more than e
apart. So shared q-grams are counted per unit in overlapping bands of
diagonals; only bands that reach the bound are verified, by an alignment
confined to the band. Nothing within the budget is missed.

Items of fewer than `short` folded characters leave no room for edits: they
are searched exactly, as whole words. An item without letters and digits is
no text and is not searched.

The benchmark is broadcast in slices of at most `slice_chars` characters, one
at a time; each further slice is one more pass over the documents, and the
matches of a text meet again by the text, never by doc_id.

Null text is empty and matches nothing. Equal items are reported each, an item
without id as null. Null item texts are skipped, an empty benchmark matches
nothing. Repeated rows give repeated results; what a row gets depends on its
text alone, so rows of one or no doc_id do not touch each other. Extra columns
are ignored by `find_leaks` and kept by `without_leaks`. An empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, staged, text_key, text_of
from .exact_dedup import marked
from .nptext import U64, chunks, mix

Q, UNIT, RATE, SHORT, SLICE_CHARS = 8, 100, 0.1, 32, 2_000_000
_R = U64(0x9E3779B97F4A7C15)
GAP = 0x110000  # no code point
#: Characters searched at once; each takes about 150 bytes meanwhile.
CHUNK = 1_000_000
_fold: list[np.ndarray] = []


def folded_code(c: int) -> int:
    s = chr(c)
    low = s.lower()
    return (ord(low) if len(low) == 1 else c) if s.isalnum() else 32


def fold_table() -> np.ndarray:
    """Folded code of each of the first 65536 code points; 32 for what parts words."""
    if not _fold:
        _fold.append(np.fromiter(map(folded_code, range(65536)), np.uint32, 65536))
    return _fold[0]


def fold(texts: list[str], gap: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded codes of the texts one after another, each followed by `gap`
    separators; the code point each came from; where each text begins (and the end)."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    raw = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = fold_table()[np.minimum(raw, 65535)]
    high = np.flatnonzero(raw > 65535)
    if len(high):
        points, which = np.unique(raw[high], return_inverse=True)
        codes[high] = np.fromiter(map(folded_code, points.tolist()), np.uint32, len(points))[which]
    begin = np.concatenate(([0], np.cumsum(lengths)))
    blank = codes == 32
    keep = ~blank
    keep[1:] |= ~blank[:-1]  # the first blank of a run stays
    keep[begin[:-1][lengths > 0]] &= ~blank[begin[:-1][lengths > 0]]
    place = np.flatnonzero(keep)
    at = np.searchsorted(place, begin)
    own = np.repeat(np.arange(len(texts)), np.diff(at))
    out = np.full(len(place) + gap * len(texts), GAP, np.uint32)
    target = np.arange(len(place)) + gap * own
    out[target] = codes[place]
    source = np.zeros(len(out), np.int64)
    source[target] = place - begin[own]
    return out, source, at + gap * np.arange(len(texts) + 1)


def grams(codes: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the q codes from each position on."""
    with np.errstate(over="ignore"):
        g, width, power = codes.astype(U64) + U64(1), 1, _R
        out, done = None, 0
        rest = q
        while rest:
            if rest & 1:
                if out is None:
                    out = g.copy()
                else:
                    n = len(codes) - done - width + 1
                    out = out[: max(n, 0)] * power + g[done : done + max(n, 0)]
                done += width
            rest >>= 1
            if rest:
                n = len(g) - width
                g = g[: max(n, 0)] * power + g[width : width + max(n, 0)]
                width, power = width * 2, power * power
        return out[: max(len(codes) - q + 1, 0)]


def budget(w: int, q: int, rate: float) -> int:
    """Edits allowed to a unit: the rate, or as many as leave a bound of 1."""
    return max(0, min(int(rate * w), w // q - 1))


def one(codes: np.ndarray) -> str:
    return codes.astype("<u4").tobytes().decode("utf-32-le")


class Index:
    """Units of some benchmark items and the postings of their q-grams; short items for exact search."""

    def __init__(self, items: list[tuple[int | None, str]], q: int, unit: int, rate: float, short: int):
        self.q, self.units, self.item = q, [], []
        exact: dict[str, list[int | None]] = {}
        for item, text in items:
            codes, _, at = fold([text])
            codes = codes[: at[-1]]
            if len(codes) and codes[-1] == 32:
                codes = codes[:-1]
            if len(codes) < max(short, q):
                if len(codes):
                    exact.setdefault(f" {one(codes)} ", []).append(item)
                continue
            starts = [0] if len(codes) <= unit else [*range(0, len(codes) - unit, unit // 2), len(codes) - unit]
            for s in starts:
                self.units.append(codes[s : s + unit])
                self.item.append(item)
        self.exact = ahocorasick.Automaton() if exact else None
        for words, owners in exact.items():
            self.exact.add_word(words, (len(words) - 2, owners))
        if exact:
            self.exact.make_automaton()
        self.edits = np.array([budget(len(u), q, rate) for u in self.units], np.int64)
        self.bound = np.array([len(u) + 1 - q * (e + 1) for u, e in zip(self.units, self.edits)], np.int64)
        g = [grams(u, q) for u in self.units]
        flat = np.concatenate(g) if g else np.zeros(0, U64)
        unit_of = np.repeat(np.arange(len(g)), [len(x) for x in g]).astype(np.int64)
        pos = np.concatenate([np.arange(len(x)) for x in g]) if g else np.zeros(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.unit_of, self.pos = unit_of[order], pos[order]
        self.grams, self.first, self.times = np.unique(flat[order], return_index=True, return_counts=True)
        self.bits = max(16, min(24, int(len(flat) * 24).bit_length()))
        self.table = np.zeros(1 << self.bits, bool)
        self.table[self.slot(self.grams)] = True
        self.width = 1 << max(4, int(self.edits.max(initial=0) + 1).bit_length())

    def slot(self, g: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((g ^ (g >> U64(29))) * U64(0xBF58476D1CE4E5B9)) >> U64(64 - self.bits)

    def candidates(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(unit, first diagonal of the band) of the bands that reach the bound."""
        g = grams(codes, self.q)
        where = np.flatnonzero(self.table[self.slot(g)])
        if not len(where) or not len(self.grams):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        found = np.minimum(np.searchsorted(self.grams, g[where]), len(self.grams) - 1)
        hit = self.grams[found] == g[where]
        where, found = where[hit], found[hit]
        n = self.times[found]
        begin = np.cumsum(n) - n
        posting = np.arange(n.sum()) - np.repeat(begin - self.first[found], n)
        unit = self.unit_of[posting]
        diagonal = np.repeat(where, n) - self.pos[posting] + 4096  # never negative: units are shorter
        band = diagonal // self.width
        every = np.concatenate((unit << 40 | band, unit << 40 | (band - 1)))
        key, which, count = np.unique(every, return_inverse=True, return_counts=True)
        unit = key >> 40
        enough = count >= self.bound[unit]
        # within a band, the hits of one alignment lie on e + 1 neighbouring diagonals
        mine = np.flatnonzero(enough[which])
        renum = np.cumsum(enough) - 1
        key, unit = key[enough], unit[enough]
        first = (key & ((1 << 40) - 1)) * self.width
        row = renum[which[mine]]
        lane = np.concatenate((diagonal, diagonal))[mine] - first[row]
        hits = np.bincount(row * 2 * self.width + lane, minlength=len(key) * 2 * self.width).reshape(len(key), 2 * self.width)
        run = np.concatenate((np.zeros((len(key), 1), np.int64), hits.cumsum(axis=1)), axis=1)
        stop = np.minimum(np.arange(2 * self.width) + self.edits[unit][:, None] + 1, 2 * self.width)
        dense = (np.take_along_axis(run, stop, axis=1) - run[:, :-1]).max(axis=1, initial=0) >= self.bound[unit]
        return unit[dense], first[dense] - 4096

    def verify(self, codes: np.ndarray, unit: np.ndarray, diagonal: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fewest edits of each unit within its band, and the codes it covers."""
        edits, begin, end = np.full(len(unit), 1 << 20), np.zeros(len(unit), np.int64), np.zeros(len(unit), np.int64)
        lengths = np.array([len(self.units[u]) for u in unit], np.int64)
        for w in np.unique(lengths):
            for some in np.array_split(np.flatnonzero(lengths == w), max(1, int((lengths == w).sum()) // 512)):
                pattern = np.stack([self.units[u] for u in unit[some]])
                slack = int(self.edits[unit[some]].max())
                width = 2 * self.width + 2 * slack
                base = diagonal[some] - slack
                lane = np.arange(width, dtype=np.int64)
                at = base[:, None] + lane
                # cost and start in one number, so that a minimum carries both
                best = np.where((at >= 0) & (at <= len(codes)), np.maximum(at, 0), (1 << 20 << 36))
                one = 1 << 36
                for i in range(w):
                    j = at + i
                    inside = (j >= 0) & (j < len(codes))
                    here = np.where(inside, codes[np.clip(j, 0, max(len(codes) - 1, 0))], GAP)
                    step = best + np.where(here == pattern[:, i : i + 1], 0, one)
                    step[:, :-1] = np.minimum(step[:, :-1], best[:, 1:] + one)
                    best = np.minimum.accumulate(step - lane * one, axis=1) + lane * one
                last = best.argmin(axis=1)
                value = best[np.arange(len(some)), last]
                edits[some], begin[some], end[some] = value >> 36, value & (one - 1), base + last + w
        return edits, begin, end


    def short_spans(self, codes: np.ndarray, source: np.ndarray) -> Iterator[tuple[int | None, int, int, int]]:
        """Short items that stand in one folded text as whole words."""
        if self.exact and len(codes):
            for last, (size, owners) in self.exact.iter(f" {one(codes)}{'' if codes[-1] == 32 else ' '}"):
                for item in owners:  # `last` is the blank after it, one further than in codes
                    yield item, int(source[last - 1 - size]), int(source[last - 2]) + 1, 0


def slices(benchmark: DataFrame, item: str, text: str, most: int) -> Iterator[list[tuple[int | None, str]]]:
    """The items in slices; the driver holds one at a time."""
    held: list[tuple[int | None, str]] = []
    size = 0
    rows = benchmark.select(benchmark[item].cast("long").alias("item"), benchmark[text].cast("string").alias("text")).where("text is not null")
    for key, body in rows.distinct().orderBy("item", "text").toLocalIterator():
        if held and size + len(body) > most:
            yield held
            held, size = [], 0
        held.append((key, body))
        size += len(body)
    yield held


SCHEMA = "doc_id long, key binary, items array<long>, edits long, spans array<struct<item: long, start: long, end: long, edits: long>>"


def by_place(span: tuple) -> tuple:
    return span[1], span[2], span[0] is None, span[0] or 0, span[3]


def settled(found: list[tuple[int, int | None, int, int, int]]) -> list[tuple[int | None, int, int, int]]:
    """Of overlapping matches (unit, item, start, end, edits) of one unit the one with fewest edits."""
    out, taken = set(), {}
    for unit, item, start, end, edits in sorted(found, key=lambda f: (f[0], f[4], f[2], f[3])):
        if all(end <= s or e <= start for s, e in taken.setdefault(unit, [])):
            taken[unit].append((start, end))
            out.add((item, start, end, edits))
    return sorted(out, key=by_place)


def searched(rows: DataFrame, items: list, q: int, unit: int, rate: float, short: int) -> DataFrame:
    """One pass over rows (doc_id, text, key) for one slice of the benchmark."""
    shared = rows.sparkSession.sparkContext.broadcast(items)

    def search(batches):
        index = Index(shared.value, q, unit, rate, short)
        for batch in batches:
            texts, spans = batch.column(1).to_pylist(), []
            for lo, hi in chunks(texts, CHUNK):
                near: list[list] = [[] for _ in range(hi - lo)]
                codes, source, at = fold(texts[lo:hi], gap=unit + 2 * index.width)
                if len(index.units):
                    u, d = index.candidates(codes)
                    edits, begin, end = index.verify(codes, u, d)
                    good = edits <= index.edits[u]
                    for k, e, b, z in zip(u[good].tolist(), edits[good].tolist(), begin[good].tolist(), end[good].tolist()):
                        t = int(np.searchsorted(at, b, side="right")) - 1
                        last = max(b, z - 1)
                        while last > b and codes[last] == GAP:
                            last -= 1
                        near[t].append((k, index.item[k], int(source[b]), int(source[last]) + 1, e))
                for t in range(hi - lo):
                    own = settled(near[t]) if near[t] else []
                    if index.exact:
                        stop = at[t + 1] - unit - 2 * index.width
                        own = sorted({*own, *index.short_spans(codes[at[t] : stop], source[at[t] : stop])}, key=by_place)
                    spans.append(own)
            items_of = [sorted({s[0] for s in x}, key=lambda i: (i is None, i or 0)) for x in spans]
            kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("item", "start", "end", "edits")]))
            listed = pa.array([[dict(zip(("item", "start", "end", "edits"), s)) for s in x] for x in spans], kind)
            columns = [batch.column(0), batch.column(2), pa.array(items_of, pa.list_(pa.int64())), pa.array([min((s[3] for s in x), default=None) for x in spans], pa.int64()), listed]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", "items", "edits", "spans"])

    return rows.mapInArrow(search, SCHEMA)


def leaks(docs: DataFrame, benchmark: DataFrame, q: int, unit: int, rate: float, short: int, slice_chars: int, doc_id: str, text: str, item: str, item_text: str) -> DataFrame:
    """`find_leaks` with the key of the text."""
    ready(docs.sparkSession)
    body = text_of(docs, text)
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), body.alias("text"), text_key(body).alias("key"))
    parts = slices(benchmark, item, item_text, slice_chars)
    first = next(parts)
    second = next(parts, None)
    if second is None:
        return searched(rows, first, q, unit, rate, short)
    every = None
    for items in (some for group in ((first, second), parts) for some in group):
        hits = searched(rows, items, q, unit, rate, short).where("size(items) > 0")
        hits = staged(hits.groupBy("key").agg(*[F.first(c).alias(c) for c in ("items", "edits", "spans")]), "leaks")  # equal texts have equal matches
        every = hits if every is None else every.unionByName(hits)
    order = "(a, b) -> CASE WHEN struct(a.start, a.end, a.item IS NULL, a.item, a.edits) < struct(b.start, b.end, b.item IS NULL, b.item, b.edits) THEN -1 WHEN a = b THEN 0 ELSE 1 END"
    merged = staged(every.groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.min("edits").alias("edits"), F.expr(f"array_sort(array_distinct(flatten(collect_list(spans))), {order})").alias("spans")), "leaks")
    none = {c: F.array().cast(merged.schema[c].dataType) for c in ("items", "spans")}
    return rows.select("doc_id", "key").join(merged, "key", "left").select("doc_id", "key", F.coalesce("items", none["items"]).alias("items"), "edits", F.coalesce("spans", none["spans"]).alias("spans"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, q: int = Q, unit: int = UNIT, rate: float = RATE, short: int = SHORT, slice_chars: int = SLICE_CHARS, doc_id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document: contaminated, items (sorted), edits (fewest of any
    match, null without one) and spans in code points: for each unit and band of
    diagonals the best alignment, without those that a better one of the unit overlaps."""
    rows = leaks(docs, benchmark, q, unit, rate, short, slice_chars, doc_id, text, item, item_text)
    return rows.select("doc_id", (F.size("items") > 0).alias("contaminated"), "items", "edits", "spans")


def without_leaks(docs: DataFrame, benchmark: DataFrame, q: int = Q, unit: int = UNIT, rate: float = RATE, short: int = SHORT, slice_chars: int = SLICE_CHARS, doc_id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents without a benchmark passage, with all columns. Only rows
    that a Bloom filter of leaking texts lets through are joined."""
    bad = leaks(docs, benchmark, q, unit, rate, short, slice_chars, doc_id, text, item, item_text)
    bad = staged(bad.where("size(items) > 0").select("key").distinct(), "leaked")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), text_key(text_of(docs, text)).alias("key"))
    rows = marked(rows, ("key",), bad)
    clear = rows.where("_maybe").join(bad, "key", "left_anti")
    return rows.where("not _maybe").select("row").unionByName(clear.select("row")).select("row.*")
