"""Quality selection by importance resampling.

Two generative models over hashed n-grams are counted: one of target text
(labelled good and not toxic), one of all text. A document's weight is the
ratio of its probabilities under the two, taken per n-gram and scaled to
`span` n-grams so that long texts weigh no more than short ones. Gumbel
noise drawn from the doc_id makes the k largest keys a sample without
replacement in proportion to the weights; k is given, or else the number of
documents whose weight passes the cut that separates labelled good from bad
rows best. The weights of whole documents spread far wider than the noise (as
does any ratio of n-gram models), so at the fitted k the sample is nearly the
cut itself and clean documents stay; a smaller `span` lets chance weigh more.

Features are word runs and sign runs, and pairs of them; a run that repeats
one of the two before it becomes one `again` mark. Counts cover all rows. The
labels are a bounded sample: the `max_labels` rows of smallest hash.

Null, empty or blank texts have no features: their weight is null, they are
rejected. Null doc_ids share one noise value. Repeated rows get equal
results; rows tied with the k-th all stay. Without labelled target rows
every text with features is kept. Extra columns are ignored by `weigh` and
kept by `keep_good`. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from .common import ready, staged, text_of
from .nptext import U64, Batch, chunks, mix

BUCKETS, SMOOTHING, SPAN, MAX_LABELS, BAD_LOSS = 1 << 16, 1.0, 256.0, 20_000, 3.0
_AGAIN, _FIRST, _PAIR = U64(0x1234567), U64(7), U64(0xD6E8FEB86659FD93)


def features(texts: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text number of each n-gram."""
    b = Batch(texts)
    starts, ends = b.pieces()
    owner, h = b.text_of(starts), b.hashes(starts, ends)
    again = np.zeros(len(h), bool)
    for k in (1, 2):
        again[k:] |= (h[k:] == h[:-k]) & (owner[k:] == owner[:-k])
    h = np.where(again, _AGAIN, h)
    first = np.ones(len(h), bool)
    first[1:] = owner[1:] != owner[:-1]
    before = np.roll(h, 1)
    before[first] = _FIRST
    with np.errstate(over="ignore"):
        pair = mix(before * _PAIR + h)
    return (np.concatenate((h, pair)) % U64(buckets)).astype(np.int64), np.concatenate((owner, owner))


def label_sample(labels: DataFrame, most: int) -> DataFrame:
    """doc_id, good, mild (not toxic) of at most `most` labelled rows."""
    rows = labels.where("doc_id is not null and quality is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality").cast("int") == 1).alias("good"), (F.coalesce(F.col("toxic").cast("int"), F.lit(0)) == 0).alias("mild")
    )
    rows = rows.groupBy("doc_id").agg(F.min("good").alias("good"), F.min("mild").alias("mild"))
    return staged(rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most), "labels")


def counts(docs: DataFrame, target: list[int], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """N-gram counts of all rows and of the target rows."""
    ids = docs.sparkSession.sparkContext.broadcast(np.array(sorted(target), np.int64))

    def count(batches):
        both = np.zeros((2, buckets), np.int64)
        for batch in batches:
            texts, keys = batch.column(1).to_pylist(), batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False)
            good = np.isin(keys, ids.value)
            for lo, hi in chunks(texts):
                f, owner = features(texts[lo:hi], buckets)
                both[0] += np.bincount(f, minlength=buckets)
                both[1] += np.bincount(f[good[lo:hi][owner]], minlength=buckets)
        some = np.flatnonzero(both[0])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(both[0][some]), pa.array(both[1][some])], names=["bucket", "n", "t"])

    rows = docs.mapInArrow(count, "bucket long, n long, t long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).toPandas()
    out = np.zeros((2, buckets))
    out[:, rows["bucket"].to_numpy()] = rows[["n", "t"]].to_numpy().T
    return out[0], out[1]


def ratios(raw: np.ndarray, target: np.ndarray, smoothing: float) -> np.ndarray:
    """log p(target) - log p(all) of each bucket; the target is smoothed towards all."""
    if not target.sum() or not raw.sum():
        return np.zeros(len(raw))
    share = raw / raw.sum()
    mass = smoothing * len(raw)
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.log((target + mass * share) / (target.sum() + mass)) - np.log(share)
    return np.where(raw > 0, out, 0.0)


def ordered(key: np.ndarray) -> np.ndarray:
    """Doubles as longs of the same order."""
    bits = key.view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))


def gumbel(ids: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        u = ((mix(ids.astype(np.int64).view(U64) * U64(2) + U64(seed)) >> U64(11)).astype(float) + 0.5) / 2.0**53
    return -np.log(-np.log(u))


def best_cut(weight: np.ndarray, good: np.ndarray, bad_loss: float = BAD_LOSS) -> float:
    """The weight that splits labelled rows with the least loss; losing a good
    row counts `bad_loss` times a bad one that passes."""
    order = np.argsort(weight, kind="stable")
    w, g = weight[order], good[order]
    if not len(w) or g.all():
        return -np.inf
    loss = np.concatenate(([0.0], np.cumsum(np.where(g, bad_loss, 0.0)))) + np.concatenate((np.cumsum((~g)[::-1])[::-1], [0]))
    k = int(np.argmin(loss))
    if k == 0:
        return -np.inf
    return float((w[k - 1] + w[k]) / 2) if k < len(w) else float(w[-1])


def kth_largest(rows: DataFrame, column: str, k: int) -> int | None:
    """Exactly the k-th largest long, by four histograms of 16 bits each."""
    if k <= 0:
        return None
    prefix, left = 0, k
    flipped = F.col(column).bitwiseXOR(F.lit(-(1 << 63)))  # unsigned order
    rows = rows.select(flipped.alias("u"))
    for depth in range(4):
        shift = 48 - 16 * depth
        digit = F.shiftrightunsigned("u", shift).bitwiseAND(F.lit(0xFFFF))
        if depth:
            rows = rows.where(F.shiftrightunsigned("u", shift + 16) == F.lit(prefix))
        histogram = sorted(((r["d"], r["n"]) for r in rows.groupBy(digit.alias("d")).agg(F.count("*").alias("n")).collect()), reverse=True)  # at most 65536 rows
        for d, n in histogram:
            if left <= n:
                prefix = prefix << 16 | d
                break
            left -= n
        else:
            return None
    value = prefix ^ (1 << 63)
    return value - (1 << 64) if value >= 1 << 63 else value


def scores(texts: list[str], ids: np.ndarray, ratio: np.ndarray, span: float, seed: int) -> tuple[np.ndarray, ...]:
    """N-grams, summed log ratio, weight and key of each text."""
    total, n = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    for lo, hi in chunks(texts):
        f, owner = features(texts[lo:hi], len(ratio))
        total[lo:hi] = np.bincount(owner, ratio[f], minlength=hi - lo)
        n[lo:hi] = np.bincount(owner, minlength=hi - lo)
    weight = span * total / np.maximum(n, 1)
    return n, total, weight, weight + gumbel(ids, seed)


def fitted(docs: DataFrame, labels: DataFrame, buckets: int, smoothing: float, span: float, max_labels: int, seed: int, k: int | None, doc_id: str, text: str):
    """The broadcast ratios, the scored documents, and the key of the k-th."""
    spark = docs.sparkSession
    ready(spark)
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), text_of(docs, text).alias("text"))
    marks = label_sample(labels, max_labels)
    target = [r["doc_id"] for r in marks.where("good and mild").select("doc_id").collect()]
    ratio = spark.sparkContext.broadcast(ratios(*counts(rows, target, buckets), smoothing))

    def score(batches):
        for batch in batches:
            keys = batch.column(0)
            n, total, weight, noisy = scores(batch.column(1).to_pylist(), keys.fill_null(0).to_numpy(zero_copy_only=False), ratio.value, span, seed)
            empty = n == 0
            yield pa.RecordBatch.from_arrays([keys, pa.array(n), pa.array(total), pa.array(weight, mask=empty), pa.array(noisy, mask=empty), pa.array(ordered(noisy), mask=empty)], names=["doc_id", "n_grams", "log_ratio", "weight", "key", "rank_key"])

    scored = staged(rows.mapInArrow(score, "doc_id long, n_grams long, log_ratio double, weight double, key double, rank_key long"), "weights")
    if k is not None:
        k = min(k, scored.where("rank_key is not null").count())
        return ratio, scored, kth_largest(scored.where("rank_key is not null"), "rank_key", k)
    judged = scored.where("weight is not null").join(F.broadcast(marks), "doc_id").groupBy("doc_id", "good").agg(F.max("weight").alias("weight")).toPandas()
    cut = best_cut(judged["weight"].to_numpy(float), judged["good"].to_numpy(bool))
    k = scored.where(F.col("weight") >= F.lit(cut)).count()
    return ratio, scored, kth_largest(scored.where("rank_key is not null"), "rank_key", k)


def weigh(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING, span: float = SPAN, max_labels: int = MAX_LABELS, seed: int = 1, k: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_grams, log_ratio (summed), weight, key, kept."""
    _, scored, floor = fitted(docs, labels, buckets, smoothing, span, max_labels, seed, k, doc_id, text)
    kept = F.coalesce(F.col("rank_key") >= F.lit(floor), F.lit(False)) if floor is not None else F.lit(False)
    return scored.select("doc_id", "n_grams", "log_ratio", "weight", "key", kept.alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING, span: float = SPAN, max_labels: int = MAX_LABELS, seed: int = 1, k: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that are kept, with all columns. Each is scored again where it is
    read, so that no text shuffles."""
    ratio, _, floor = fitted(docs, labels, buckets, smoothing, span, max_labels, seed, k, doc_id, text)
    if floor is None:
        return docs.where("false")

    def passes(ids: pd.Series, texts: pd.Series) -> pd.Series:
        n, _, _, noisy = scores(texts.tolist(), ids.to_numpy(np.int64), ratio.value, span, seed)
        return pd.Series((n > 0) & (ordered(noisy) >= floor))

    return docs.where(F.pandas_udf(passes, BooleanType())(F.coalesce(docs[doc_id].cast("long"), F.lit(0)), text_of(docs, text)))
