"""Exact dedup by two-pass Bloom filtering, in DataFrame operations only.

Pass one sets the two Bloom cells of every hash and keeps, as bitmaps, the
cells set more than once. Pass two tests each row against those bitmaps: a
row with a cell of its own cannot repeat and passes straight through; only
the others shuffle, as narrow keys, for the exact comparison by SHA-256.

The bitmaps hold `bits_per_row` bits a row. Where that exceeds `max_bits` (a
broadcast of max_bits / 8 bytes), rows are written once in slices by hash and
the passes go slice by slice, each with bitmaps of its own, so the test stays
as sharp and no broadcast grows, at any number of rows. Results are the same.

Null text counts as empty; empty texts are equal to each other. A null
doc_id is kept only if its group has no other row as long. Of rows that
agree in doc_id and text one is kept. An empty table gives no rows. Extra
columns pass through `keep_first` untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, release, staged, text_of

BITS_PER_ROW = 16
MAX_BITS = 1 << 27
PAGE = 1 << 15  # bits in one bitmap row


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, BLANK + "+", "")


def cells(h: Column, bits: int) -> list[Column]:
    return [F.pmod(h, F.lit(bits)), F.pmod(F.xxhash64(h, F.lit(2)), F.lit(bits))]


def bits_for(rows: int, bits_per_row: int = BITS_PER_ROW, max_bits: int = MAX_BITS) -> int:
    bits = PAGE
    while bits < rows * bits_per_row and bits < max_bits:
        bits *= 2
    return bits


def cell_bitmaps(keys: DataFrame, bits: int, least: int = 1) -> DataFrame:
    """Bitmaps of the Bloom cells that at least so many of the hashes `h` set."""
    cell = keys.select(F.explode(F.array(*cells(F.col("h"), bits))).alias("cell"))
    often = cell.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return often.groupBy(F.expr(f"cell div {PAGE}").alias("page")).agg(F.expr(f"bitmap_construct_agg(cell % {PAGE})").alias("bitmap"))


def with_maybe(rows: DataFrame, h: str, bitmaps: DataFrame, bits: int) -> DataFrame:
    """Add `_maybe`: whether all cells of the row's hash are in the bitmaps."""
    both = None
    for k, cell in enumerate(cells(F.col(h), bits)):
        page = F.broadcast(bitmaps.select(F.col("page").alias(f"_page{k}"), F.col("bitmap").alias(f"_bitmap{k}")))
        rows = rows.withColumn(f"_cell{k}", cell)
        rows = rows.join(page, F.expr(f"_cell{k} div {PAGE}") == F.col(f"_page{k}"), "left")
        byte = f"conv(hex(substring(_bitmap{k}, cast(_cell{k} % {PAGE} div 8 as int) + 1, 1)), 16, 10)"
        bit = F.coalesce(F.expr(f"(cast({byte} as int) & shiftleft(1, cast(_cell{k} % 8 as int))) != 0"), F.lit(False))
        both = bit if both is None else both & bit
    return rows.withColumn("_maybe", both).drop(*[f"_{n}{k}" for k in range(2) for n in ("cell", "page", "bitmap")])


def among(rows: DataFrame, columns: tuple[str, ...], ids: DataFrame) -> DataFrame:
    """Rows whose columns are in a Bloom filter of those of `ids` (16 MB at most), so that the join
    after it shuffles few texts; a filter that is full lets more through, the join decides."""
    return marked(rows, columns, ids).where("_maybe").drop("_maybe")


def marked(rows: DataFrame, columns: tuple[str, ...], ids: DataFrame) -> DataFrame:
    """Rows with `_maybe`: whether the Bloom filter of `ids` holds them."""
    keys = staged(ids.select(F.xxhash64(*columns).alias("h")), "filter")
    bits = bits_for(keys.count())
    bitmaps = staged(cell_bitmaps(keys, bits), "bitmaps")
    release(keys)
    return with_maybe(rows.withColumn("_h", F.xxhash64(*columns)), "_h", bitmaps, bits).drop("_h")


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    body = text_of(docs, text)
    keys = docs.select(docs[doc_id].cast("long").alias("doc_id"), F.char_length(body).cast("long").alias("len"), normalised(body).alias("body"))
    return staged(keys.select("doc_id", "len", F.unhex(F.sha2("body", 256)).alias("sha"), F.xxhash64("body").alias("h")), "keys")


def sliced(rows: DataFrame, h: str, slices: int) -> list[DataFrame]:
    """Rows in slices by hash: as they are, or written once, each slice in a folder of its own."""
    if slices == 1:
        return [rows]
    parts = staged(rows.withColumn("_slice", F.pmod(F.xxhash64(F.lit(3), h), F.lit(slices)).cast("int")), "slices", "_slice")
    return [parts.where(F.col("_slice") == k).drop("_slice") for k in range(slices)]


def each_slice(parts: list[DataFrame], bitmaps: list[DataFrame], of, name: str) -> DataFrame:
    """`of(slice, its bitmaps)` for all slices together; several are written one after another, so
    that one broadcast stands at a time."""
    out = None
    for part, cells_ in zip(parts, bitmaps):
        made = of(part, cells_)
        made = made if len(parts) == 1 else staged(made, name)
        out = made if out is None else out.unionByName(made)
    return out


def groups_of(keys: DataFrame, bits_per_row: int, max_bits: int) -> tuple[DataFrame, DataFrame, list[DataFrame], int]:
    """Rows marked `_maybe`, per repeated text its best row and size, and the bitmaps of each slice."""
    n = keys.count()
    bits = bits_for(n, bits_per_row, max_bits)
    parts = sliced(keys, "h", max(1, -(-n * bits_per_row // max_bits)))
    bitmaps = [staged(cell_bitmaps(part, bits, 2), "bitmaps") for part in parts]
    marked = each_slice(parts, bitmaps, lambda part, cells_: with_maybe(part, "h", cells_, bits), "marked")
    alike = marked.where("_maybe").groupBy("sha", "doc_id", "len").agg(F.count("*").alias("times"))
    best = F.max(F.struct("len", F.expr("~doc_id").alias("low"), "doc_id"))
    groups = alike.groupBy("sha").agg(best.alias("best"), F.sum("times").alias("group_size"))
    groups = staged(groups.select("sha", F.col("best.doc_id").alias("keep_id"), F.col("best.len").alias("keep_len"), "group_size"), "groups")
    return marked, groups, bitmaps, bits


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits_per_row: int = BITS_PER_ROW, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: keep_id, group_size, kept, text_sha256."""
    marked, groups, _, _ = groups_of(keyed(docs, doc_id, text), bits_per_row, max_bits)
    sha = F.lower(F.hex("sha")).alias("text_sha256")
    single = marked.where("not _maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha)
    alike = marked.where("_maybe").groupBy("sha", "doc_id", "len").agg(F.count("*").alias("times"))
    nth = alike.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    first = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("len") == F.col("keep_len")) & (F.col("nth") == 1)
    return single.unionByName(nth.join(groups, "sha").select("doc_id", "keep_id", "group_size", first.alias("kept"), sha))


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits_per_row: int = BITS_PER_ROW, max_bits: int = MAX_BITS) -> DataFrame:
    """The documents that stay, with all their columns. Texts of rows that
    cannot repeat never shuffle."""
    _, groups, bitmaps, bits = groups_of(keyed(docs, doc_id, text), bits_per_row, max_bits)
    names = docs.columns
    body = text_of(docs, text)
    rows = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), docs[doc_id].cast("long").alias("_id"), F.char_length(body).cast("long").alias("_len"), normalised(body).alias("_body"))
    rows = rows.select("row", "_id", "_len", F.xxhash64("_body").alias("_h"), F.unhex(F.sha2("_body", 256)).alias("_sha"))

    def stay(part: DataFrame, cells_: DataFrame) -> DataFrame:
        found = with_maybe(part, "_h", cells_, bits)
        best = (F.col("_sha") == F.col("sha")) & F.col("_id").eqNullSafe(F.col("keep_id")) & (F.col("_len") == F.col("keep_len"))
        kept = found.where("_maybe").join(groups.drop("group_size"), best, "left_semi")
        kept = kept.groupBy("_sha").agg(F.first("row").alias("row")).select("row")
        return found.where("not _maybe").select("row").unionByName(kept)

    return each_slice(sliced(rows, "_h", len(bitmaps)), bitmaps, stay, "kept").select("row.*")


ORACLE = r"""
WITH k AS (
  SELECT doc_id, length(coalesce(text, '')) AS len,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept,
       text_sha256
FROM k
WINDOW w AS (PARTITION BY text_sha256 ORDER BY len DESC, doc_id NULLS LAST
             ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""
