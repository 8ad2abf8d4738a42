"""How five filters interact, from a histogram of failure masks.

Each text gets a mask with one bit per filter it fails:

    A  fewer than 200 words (runs without space and U+0009 to U+000D)
    B  100 * distinct words < 50 * words
    C  100 * letters A-Z > 2 * code points
    D  any of # $ % & * |
    E  the same text stands under a smaller doc_id

A to D follow from the text alone. For E, rows of one text, part and label
fold into one row with their count, their smallest doc_id and how often that
stands there; the smallest of a text's rows then tells how many of them fail.
So no single row is joined back to its text; a text that fills a third of the
table is a few rows after the first partial aggregation.

Masks of a part are counted in 32 cells. Every figure of all orders of the
filters is a sum over those cells, so the 120 orders never touch documents.

Null text is empty (fails A only, and E as a copy of other empty texts). A
null part is the empty string. A row with a null doc_id never fails E, makes
no other row fail it and has no labels. Repeated rows count as often as they
occur; rows that share the smallest doc_id of their text pass E. A document is
good (toxic) if any of its label rows says 1. An empty table gives no rows.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, staged, text_of

FILTERS = "ABCDE"
LEAST_WORDS = 200
SIGNS = "[#$%&*|]"


def orders() -> list[tuple[str, int, int, int]]:
    """(order, step, bits of the filters before it, bit of its own filter) for every order."""
    out = []
    for order in map("".join, permutations(FILTERS)):
        before = 0
        for step, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            out.append((order, step, before, bit))
            before |= bit
    return out


def text_mask(text: Column) -> Column:
    """Bits of the filters A to D."""
    words = F.array_remove(F.split(text, BLANK), "")
    n = F.size(words)
    bits = [
        n < LEAST_WORDS,
        F.size(F.array_distinct(words)) * F.lit(100).cast("long") < n * F.lit(50).cast("long"),
        F.regexp_count(text, F.lit("[A-Z]")) * F.lit(100).cast("long") > F.char_length(text) * F.lit(2).cast("long"),
        text.rlike(SIGNS),
    ]
    return sum((F.when(b, 1 << k).otherwise(0) for k, b in enumerate(bits)), F.lit(0))


def labelled(labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """One row per labelled document: good and toxic, by any of its rows."""
    says = lambda c: F.max(F.when(labels[c] == 1, 1).otherwise(0))
    one = labels.where(labels[doc_id].isNotNull()).groupBy(labels[doc_id].cast("long").alias("label_id"))
    return one.agg(says("quality").alias("good"), says("toxic").alias("toxic"))


def alike_rows(docs: DataFrame, labels: DataFrame, part: str = "source", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows that agree in text, part and labels as one: n, unnamed (of them without doc_id), low (smallest doc_id) and low_n (rows under it)."""
    body = docs.select(docs[doc_id].cast("long").alias("doc_id"), F.coalesce(docs[part].cast("string"), F.lit("")).alias("part"), text_of(docs, text).alias("text"))
    rows = body.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("sha"), text_mask(F.col("text")).alias("mask"))
    times = rows.groupBy("doc_id", "part", "sha", "mask").agg(F.count("*").alias("n"))
    # rows without doc_id match no label; their keys spread by text
    match = (F.coalesce("doc_id", F.xxhash64("sha")) == F.col("label_id")) & F.col("doc_id").isNotNull()
    known = times.join(labelled(labels, doc_id), match, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})
    unnamed = F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0))
    return known.groupBy("sha", "mask", "part", "good", "toxic").agg(F.sum("n").alias("n"), unnamed.alias("unnamed"), F.min("doc_id").alias("low"), F.min_by("n", "doc_id").alias("low_n"))


def mask_cells(docs: DataFrame, labels: DataFrame, part: str = "source", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Cells by part and mask: n, good and toxic documents."""
    alike = staged(alike_rows(docs, labels, part, doc_id, text), "alike")
    first = alike.groupBy("sha").agg(F.min("low").alias("first"))
    passing = F.col("unnamed") + F.when(F.col("low") == F.col("first"), F.col("low_n")).otherwise(0)
    both = F.array(F.struct(F.col("mask"), F.col("passing").alias("n")), F.struct((F.col("mask") + (1 << 4)).alias("mask"), (F.col("n") - F.col("passing")).alias("n")))
    rows = alike.join(first, "sha").withColumn("passing", passing).select("part", "good", "toxic", F.inline(both))
    counts = {"n": F.sum("n"), "good": F.sum(F.col("n") * F.col("good")), "toxic": F.sum(F.col("n") * F.col("toxic"))}
    return rows.groupBy("part", "mask").agg(*[c.alias(name) for name, c in counts.items()])


def audit(docs: DataFrame, labels: DataFrame, part: str = "source", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per part, order of the filters and step; see the columns below."""
    cells = mask_cells(docs, labels, part, doc_id, text)
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # at most 32 a part
    steps = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(b).alias("before"), F.lit(k).alias("bit")) for o, s, b, k in orders()])
    rows = parts.select("part", "cells", F.inline(steps))

    def total(value: str, where: str) -> Column:
        return F.expr(f"aggregate(cells, 0L, (s, c) -> s + if({where}, {value}, 0L))")

    fails, gone = "(c.mask & bit) != 0", "(c.mask & before) != 0"
    out = {
        "kept": ("c.n", "(c.mask & (before | bit)) = 0"), "removed": ("c.n", f"{fails} and not {gone}"), "redundant": ("c.n", f"{fails} and {gone}"), "unique_fails": ("c.n", "c.mask = bit"),
        "good_lost": ("c.good", f"{fails} and not {gone}"), "toxic_lost": ("c.toxic", f"{fails} and not {gone}"),
        # among the filters that a document fails, each comes first in an equal share of the 120 orders
        "shapley": ("c.n * (120 div bit_count(c.mask))", fails),
    }
    return rows.select("part", "filter_order", "step", *[total(value, where).alias(name) for name, (value, where) in out.items()])


ORACLE = r"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
m AS (
  SELECT doc_id, part, CAST(len(ws) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(ws)) < 50 * len(ws) AS INT)
         + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS INT) + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT)
         + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), FALSE) AS INT) AS mask
  FROM w),
l AS (SELECT doc_id AS label_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
c AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM m LEFT JOIN l ON doc_id = label_id GROUP BY 1, 2),
f(x, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (
  SELECT p.x || q.x || r.x || s.x || u.x AS filter_order, [p.b, q.b, r.b, s.b, u.b] AS bits
  FROM f p, f q, f r, f s, f u WHERE p.b + q.b + r.b + s.b + u.b = 31 AND len(list_distinct([p.b, q.b, r.b, s.b, u.b])) = 5),
st AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0) AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
e AS (
  SELECT part, filter_order, step, bit, n, good, toxic, mask, (mask & bit) <> 0 AS fails, (mask & CAST(before AS INT)) <> 0 AS gone FROM c, st),
r AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN fails AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN fails AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN fails AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
  FROM e GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM r
"""
