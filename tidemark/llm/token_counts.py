"""Token counts of sections by offset mapping.

Each whole text is encoded once. Its tokens tile its bytes, so a section, a
code point span of the text, is joined to the tokens by two binary searches
on their offsets. A token that crosses a section's edge is allocated by the
rule named:

    start   the section holding its first byte gets it (whole counts)
    middle  the section holding its middle byte gets it (whole counts)
    split   each section gets the share of its bytes (fractions)

Sections may overlap or leave gaps; each is counted for itself. Without a
section column the sections are the lines, each with its line feed. Null or
empty text has one empty section with no tokens; an empty table gives no
rows; a null or empty section list gives none for that row. Repeated rows
give repeated results. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, text_of
from .encoders import default_ranks, encoder, ids_of

RULES = ("start", "middle", "split")


def lines(text: str) -> np.ndarray:
    """Code point spans of the lines of a text, line feeds included."""
    at, ends = -1, []
    while (at := text.find("\n", at + 1)) >= 0:
        ends.append(at + 1)
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    return np.column_stack(([0, *ends[:-1]], ends)).astype(np.int64)


def allocate(edges: np.ndarray, spans: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each byte span, and how many tokens cross into it from before.
    edges: the tokens' starts and, last, the end of the text."""
    begin, end = spans[:, 0], np.maximum(spans[:, 0], spans[:, 1])
    starts = edges[:-1]
    crossing = (begin < end) & (begin > 0) & ~np.isin(begin, starts) & (begin < edges[-1])
    if rule == "split":
        ordinal = np.arange(len(edges), dtype=float)
        return np.interp(end, edges, ordinal) - np.interp(begin, edges, ordinal), crossing.astype(np.int64)
    mark = starts if rule == "start" else (starts + edges[1:] - 1) // 2
    return (np.searchsorted(mark, end) - np.searchsorted(mark, begin)).astype(float), crossing.astype(np.int64)


def token_counts(docs: DataFrame, sections: str | None = None, rule: str = "start", ranks_path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per section: doc_id, section (from 0), begin, end, n_tokens, n_crossing.

    sections: a column of array<struct<begin: long, end: long>> in code points.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    ready(docs.sparkSession)
    path = ranks_path or default_ranks()
    spans = F.expr(f"transform(`{sections}`, s -> array(cast(s.begin as long), cast(s.end as long)))") if sections else F.lit(None).cast("array<array<bigint>>")

    def count(batches):
        lengths = encoder(path)[1]
        for batch in batches:
            out = []
            for key, body, own in zip(*(c.to_pylist() for c in batch.columns)):
                where = lines(body) if not sections else np.array(own or [], np.int64).reshape(-1, 2)
                raw = np.frombuffer(body.encode(), np.uint8)
                points = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
                where = np.clip(where, 0, len(points) - 1)
                edges = np.concatenate(([0], np.cumsum(lengths[ids_of(path, body)], dtype=np.int64)))
                n, crossing = allocate(edges, points[where], rule)
                out.append((key, where, n, crossing))
            size = [len(w) for _, w, _, _ in out]
            stack = lambda k, t: np.concatenate([x[k] for x in out]) if out else np.zeros(0, t)
            where = np.concatenate([x[1] for x in out]) if out else np.zeros((0, 2), np.int64)
            section = np.concatenate([np.arange(k) for k in size]) if out else np.zeros(0, np.int64)
            keys = pa.array([x[0] for x in out], pa.int64()).take(pa.array(np.repeat(np.arange(len(out)), size)))
            columns = [keys, pa.array(section, pa.int32()), pa.array(where[:, 0]), pa.array(where[:, 1]), pa.array(stack(2, float), pa.float64()), pa.array(stack(3, np.int64), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "section", "begin", "end", "n_tokens", "n_crossing"])

    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), text_of(docs, text).alias("text"), spans.alias("spans"))
    return rows.mapInArrow(count, "doc_id long, section int, begin long, end long, n_tokens double, n_crossing long")
