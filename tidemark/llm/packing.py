"""Best-fit packing by minimum bin slack.

Token lengths are whole numbers up to the sequence length, so the whole
corpus packs as a histogram of at most `max_len` counts. Per sequence a
bitset subset-sum finds the fullest combination of the lengths left around
the longest one; it is taken as often as the counts allow, which uses up a
length each time. The plan is therefore a bounded list of patterns however
many documents there are, and pieces find their place by rank within their
length: no group is ever gathered.

Null text is empty. An empty text is one piece holding only the end id. The
string of an added token of the tokenizer file is that token.
Repeated rows are packed as often as they occur. An empty table gives no
rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ready, staged, text_of
from .encoders import default_ranks, ids_of

MAX_LEN = 2048
END_ID = 0


def cut(total: int, max_len: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of a document's pieces: the first takes what is over."""
    if total <= max_len:
        return np.zeros(1, np.int64), np.array([total], np.int64)
    head = total % max_len
    edges = np.arange(head, total + 1, max_len, dtype=np.int64)
    edges = np.concatenate(([0], edges)) if head else edges
    return edges[:-1], np.diff(edges)


def fullest(counts: dict[int, int], cap: int, descending: list[int]) -> list[tuple[int, int]]:
    """(length, times) of the available combination with the largest sum up to cap."""
    reach, room, steps = 1, (1 << (cap + 1)) - 1, []
    for length in descending:
        left = min(counts[length], cap // length) if length <= cap else 0
        chunk = 1
        while left > 0:
            chunk = min(chunk, left)
            steps.append((length, chunk, reach))
            reach |= (reach << (length * chunk)) & room
            left -= chunk
            chunk *= 2
        if reach >> cap & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for length, chunk, before in reversed(steps):
        if not before >> at & 1:
            at -= length * chunk
            used[length] = used.get(length, 0) + chunk
    return list(used.items())


def plan(histogram: dict[int, int], max_len: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(sequences, [(length, times in each)]) until every piece is placed."""
    counts = {k: v for k, v in histogram.items() if v}
    out = []
    while counts:
        descending = sorted(counts, reverse=True)
        anchor = descending[0]
        counts[anchor] -= 1
        rest = fullest(counts, max_len - anchor, descending)
        counts[anchor] += 1
        pattern = dict(rest)
        pattern[anchor] = pattern.get(anchor, 0) + 1
        times = min(counts[k] // m for k, m in pattern.items())
        for k, m in pattern.items():
            counts[k] -= m * times
            if not counts[k]:
                del counts[k]
        out.append((times, sorted(pattern.items(), reverse=True)))
    return out


def runs(patterns: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """For each length, which ranks go to which sequences and offsets."""
    rows, taken, sequence = [], {}, 0
    for times, pattern in patterns:
        offset = 0
        for length, each in pattern:
            first = taken.get(length, 0)
            rows.append((length, first, each, sequence, offset))
            taken[length] = first + each * times
            offset += length * each
        sequence += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return {"key": table[:, 0] << 44 | table[:, 1], "first": table[:, 1], "each": table[:, 2], "sequence": table[:, 3], "offset": table[:, 4]}


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def pieces(docs: DataFrame, ranks_path: str | None = None, max_len: int = MAX_LEN, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode each whole document once and cut it; `part` and `nth` number the
    pieces of one length within one input split."""
    path = ranks_path or default_ranks()

    def encode(batches):
        part, seen = TaskContext.get().partitionId(), np.zeros(max_len + 1, np.int64)
        for batch in batches:
            out = []
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.append(ids_of(path, body), np.uint32(END_ID)).astype("<u4")
                for k, (start, length) in enumerate(zip(*map(np.ndarray.tolist, cut(len(ids), max_len)))):
                    out.append((key, k, start, length, zlib.crc32(ids[start : start + length].tobytes()), part, int(seen[length])))
                    seen[length] += 1
            columns = list(zip(*out)) or [[]] * 7
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), text_of(docs, text).alias("text")).mapInArrow(encode, PIECES)


def pack(docs: DataFrame, ranks_path: str | None = None, max_len: int = MAX_LEN, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece with its sequence and its place there."""
    spark = docs.sparkSession
    ready(spark)
    cuts = staged(pieces(docs, ranks_path, max_len, doc_id, text), "pieces")
    by_part = cuts.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most max_len rows
    places = spark.sparkContext.broadcast(runs(plan(histogram, max_len)))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_part.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = cuts.join(offsets, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))

    def place(batches):
        p = places.value
        for batch in batches:
            length, rank = batch.column(3).to_numpy(zero_copy_only=False), batch.column(5).to_numpy(zero_copy_only=False)
            at = np.searchsorted(p["key"], length << 44 | rank, side="right") - 1
            over, slot = np.divmod(rank - p["first"][at], np.maximum(p["each"][at], 1))
            columns = [*batch.columns[:5], pa.array(p["sequence"][at] + over, pa.int64()), pa.array(p["offset"][at] + slot * length, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
