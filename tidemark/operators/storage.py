"""Append-only versions, keyed upserts, change capture, content identity, provider fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest(revisions: DataFrame, key: list[str], version: str = "version") -> DataFrame:
    """The last revision of each key, by partial aggregation: no sort of histories."""
    rest = [c for c in revisions.columns if c not in key]
    best = revisions.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(version)).alias("_r"))
    return best.select(*key, "_r.*").select(*revisions.columns)


def revision_changes(revisions: DataFrame, key: list[str], fields: list[str], version: str = "version") -> DataFrame:
    """For each revision, which fields differ from the one before (all, for the first)."""
    w = Window.partitionBy(*key).orderBy(version)
    before = {f: F.lag(f).over(w) for f in fields}
    rows = revisions.withColumns({f"_b_{f}": c for f, c in before.items()} | {"_first": F.row_number().over(w) == 1})
    changed = F.array_compact(F.array(*[F.when(F.col("_first") | ~F.col(f).eqNullSafe(F.col(f"_b_{f}")), F.lit(f)) for f in fields]))
    return rows.withColumn("changed", changed).drop("_first", *[f"_b_{f}" for f in fields])


def _winner(columns: list[str], kinds: dict[str, str], order: list[str]) -> Column:
    """What decides between rows of one key: `order`, then a hash of the values, so that ties never depend on arrival."""
    plain = [c for c in columns if "map<" not in kinds[c]]
    return F.struct(*order, F.xxhash64(*plain).alias("_h"))


def one_each(rows: DataFrame, key: list[str], order: list[str] | None = None) -> DataFrame:
    """One row per key: the largest by `order`; equal ones by a hash of their values."""
    rest = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), _winner(rows.columns, dict(rows.dtypes), order or [])).alias("_r"))
    return best.select(*key, "_r.*").select(*rows.columns)


def upsert(prior: DataFrame, new: DataFrame, key: list[str], superseded: DataFrame | None = None, order: list[str] | None = None) -> DataFrame:
    """The merged table: a new row replaces the prior one of its key; prior keys in `superseded` go.
    Columns of either side may be missing in the other. Of several new rows of a key the largest by `order` wins."""
    kept = prior.join(superseded.select(*key).distinct(), key, "left_anti") if superseded is not None else prior
    both = kept.withColumn("_o", F.lit(0)).unionByName(new.withColumn("_o", F.lit(1)), allowMissingColumns=True)
    return one_each(both, key, ["_o", *(order or [])]).drop("_o")


def merge_partitions(spark: SparkSession, path: str, batch: DataFrame, key: list[str], by: list[str], order: list[str] | None = None) -> int:
    """Upsert a batch into a Parquet folder laid out by the columns `by`, rewriting only the partitions it touches.

    `by` belongs to the key, so that a row never changes its partition. Partitions without a new row are
    neither read nor written: what is written grows with the batch, not with the table. Merging a batch again
    changes nothing. Returns the number of partitions rewritten; their list (one row per partition that
    the batch touches) is all that the driver holds."""
    from ..plans.stage import written

    if not set(by) <= set(key):
        raise ValueError("the partition columns must belong to the key")
    new = written(one_each(batch, key, order), "batch")
    touched = new.select(*by).distinct().collect()
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if touched and where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        prior = spark.read.parquet(path)
        prior = prior.select(*[F.col(c).cast(dict(new.dtypes)[c]) if c in by else F.col(c) for c in prior.columns])
        parts = F.lit(False)
        for r in touched:
            same = F.lit(True)
            for c in by:
                same = same & F.col(c).eqNullSafe(F.lit(r[c]))
            parts = parts | same
        simple = F.col(by[0]).isin([r[by[0]] for r in touched]) if len(by) == 1 and all(r[by[0]] is not None for r in touched) else parts
        new = written(upsert(prior.where(simple), new, key), "merged")
    new.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    return len(touched)


def changes(prior: DataFrame, new: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """Keys of `new` with kind insert, update or same."""
    old = prior.select(*key, F.struct(*[F.col(f).cast("string") for f in fields]).alias("_old"))
    now = new.select(*key, F.struct(*[F.col(f).cast("string") for f in fields]).alias("_new"))
    kind = F.when(F.col("_old").isNull(), "insert").when(F.col("_old").eqNullSafe(F.col("_new")), "same").otherwise("update")
    return now.join(old, key, "left").select(*key, kind.alias("kind"))


def record_steps(steps: DataFrame, key: list[str], order: str, step: str) -> DataFrame:
    """A history without entries equal to the one before."""
    w = Window.partitionBy(*key).orderBy(order)
    return steps.withColumn("_b", F.lag(step).over(w)).where(~F.col(step).eqNullSafe(F.col("_b"))).drop("_b")


def identity(prefix: str, digits: int, *parts: str | Column) -> Column:
    """prefix + the first hex digits of the SHA-256 of the parts joined by a pipe."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, digits))


def first_provider(sources: list[DataFrame], key: list[str]) -> DataFrame:
    """Per key all rows of the first source that has any."""
    both = None
    for k, source in enumerate(sources):
        part = source.withColumn("_p", F.lit(k))
        both = part if both is None else both.unionByName(part)
    return both.withColumn("_m", F.min("_p").over(Window.partitionBy(*key))).where("_p = _m").drop("_p", "_m")


def constituents(snapshots: DataFrame, as_of: str) -> DataFrame:
    """Members of each index's latest snapshot at `as_of`, one row per ticker (last index wins)."""
    rows = snapshots.where(F.col("as_of_date") <= F.lit(as_of).cast("date"))
    rows = rows.withColumn("_m", F.max("as_of_date").over(Window.partitionBy("index"))).where("as_of_date = _m")
    return rows.groupBy("ticker").agg(F.max_by("index", "index").alias("index"), F.max_by("as_of_date", "index").alias("as_of_date"))


def classified(rows: DataFrame, collected: DataFrame, fallback: DataFrame, key: str = "ticker", value: str = "sector") -> DataFrame:
    """The collected class, else the fallback one."""
    a, b = collected.select(key, F.col(value).alias("_a")), fallback.select(key, F.col(value).alias("_b"))
    return rows.join(a, key, "left").join(b, key, "left").withColumn(value, F.coalesce("_a", "_b")).drop("_a", "_b")


def implied_dividends(bars: DataFrame, eps: float = 1e-6) -> DataFrame:
    """Steps of adjusted over raw close between two bars, as the dividend they imply."""
    w = Window.partitionBy("ticker").orderBy("trade_date")
    rows = bars.withColumn("f", F.try_divide("adj", "close")).withColumns({"f0": F.lag("f").over(w), "c0": F.lag("close").over(w)})
    step = F.try_divide(F.col("f0"), F.col("f"))
    return rows.where(F.abs(F.col("f") - F.col("f0")) > eps).select("ticker", F.col("trade_date").alias("event_date"), (F.col("c0") * (1 - step)).alias("dividend_amount"))
