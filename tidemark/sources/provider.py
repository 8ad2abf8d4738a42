"""The market data contract as a Spark data source over one file set per key.

A provider folder holds one folder per table, laid out as Spark writes CSV with
a header by `partitionBy(key)`. Each file is a partition of the scan. Equality on the key decides
which files are listed at all, bounds on the day which rows leave the reader; both are pushed down.

    provider.register(spark)
    provider.price_history(spark, path, "Brand#11", "1998-01-01", "1998-12-31")
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from datetime import date
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

#: Fixed: per table the key, the day and the columns.
TABLES = {
    "bars": ("ticker", "trade_date", "ticker string, trade_date date, open double, high double, low double, close double, volume long"),
    "corporate_events": ("ticker", "event_date", "ticker string, event_date date, event_type string, split_ratio double, dividend_amount double"),
    "macro": ("series_id", "observation_date", "series_id string, observation_date date, value double"),
    "news": ("source", "published_at", "source string, published_at date, headline string, tickers string"),
}
FORMAT = "tidemark_provider"


class FilePart(InputPartition):
    def __init__(self, key: str, path: str):
        super().__init__(path)
        self.key, self.path = key, path


class ProviderReader(DataSourceReader):
    def __init__(self, folder: str, key: str, day: str):
        self.folder, self.key, self.day = folder, key, day
        self.keys: set | None = None
        self.first, self.last = date.min, date.max

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if column == (self.key,) and isinstance(f, (EqualTo, In)):
                found = {value} if isinstance(f, EqualTo) else set(value)
                self.keys = found if self.keys is None else self.keys & found
            elif column == (self.day,) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                step = 1 if isinstance(f, GreaterThan) else -1 if isinstance(f, LessThan) else 0
                bound = date.fromordinal(min(max(value.toordinal() + step, 1), date.max.toordinal()))
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    self.first = max(self.first, bound)
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.last = min(self.last, bound)
            else:
                yield f

    def partitions(self) -> list[FilePart]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(self.folder)
        mark, out = f"{self.key}=", []
        for info in files.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            above = info.path.rsplit("/", 2)[-2]
            if info.type == fs.FileType.File and info.base_name.endswith(".csv") and above.startswith(mark):
                name = unquote(above[len(mark) :])
                if self.keys is None or name in self.keys:
                    out.append(FilePart(name, info.path))
        return out or [FilePart("", "")]

    def read(self, partition: FilePart) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyarrow import csv, fs

        if not partition.path or self.first > self.last:
            return
        files, _ = fs.FileSystem.from_uri(self.folder)
        with files.open_input_stream(partition.path) as stream:
            values = csv.ConvertOptions(column_types=self.kinds(), strings_can_be_null=True, quoted_strings_can_be_null=False)
            for batch in csv.open_csv(stream, parse_options=csv.ParseOptions(newlines_in_values=True), convert_options=values):
                batch = batch.append_column(self.key, pa.array([partition.key] * len(batch), pa.string()))
                day = batch.column(self.day)
                inside = pc.and_(pc.greater_equal(day, pa.scalar(self.first)), pc.less_equal(day, pa.scalar(self.last)))
                yield batch.filter(inside).select(self.names)

    def kinds(self):
        import pyarrow as pa

        of = {"string": pa.string(), "date": pa.date32(), "double": pa.float64(), "long": pa.int64()}
        return {name: of[kind] for name, kind in self.columns.items() if name != self.key}


class ProviderSource(DataSource):
    """spark.read.format("tidemark_provider").option("table", ...).load(folder)"""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return TABLES[self.options["table"]][2]

    def reader(self, schema) -> ProviderReader:
        table = self.options["table"]
        key, day, columns = TABLES[table]
        made = ProviderReader(f"{self.options['path'].rstrip('/')}/{table}", key, day)
        made.columns = dict(c.split() for c in columns.split(", "))
        made.names = list(made.columns)
        return made


def register(spark: SparkSession) -> None:
    """Make the format known to the session and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ProviderSource)


def publish(table: DataFrame, path: str, name: str) -> None:
    """Write a table in the layout that the source reads."""
    key, _, columns = TABLES[name]
    names = [c.split()[0] for c in columns.split(", ")]
    table.select(*names).repartition(key).write.mode("overwrite").option("header", "true").option("escape", '"').partitionBy(key).csv(f"{path}/{name}")


def scan(spark: SparkSession, path: str, table: str, key: str | None, start: str, end: str) -> DataFrame:
    of, day, _ = TABLES[table]
    rows = spark.read.format(FORMAT).option("table", table).load(path)
    rows = rows.where((F.col(day) >= F.lit(start).cast("date")) & (F.col(day) <= F.lit(end).cast("date")))
    return rows if key is None else rows.where(F.col(of) == key)


def price_history(spark: SparkSession, path: str, ticker: str, start: str, end: str) -> DataFrame:
    return scan(spark, path, "bars", ticker, start, end)


def corporate_events(spark: SparkSession, path: str, ticker: str, start: str, end: str) -> DataFrame:
    return scan(spark, path, "corporate_events", ticker, start, end)


def macro_series(spark: SparkSession, path: str, series_id: str, start: str, end: str) -> DataFrame:
    return scan(spark, path, "macro", series_id, start, end)


def news(spark: SparkSession, path: str, ticker: str | None, start: str, end: str) -> DataFrame:
    """News of a span, of all tickers or of those whose list (parted by a pipe) names this one; `tickers` as an array."""
    rows = scan(spark, path, "news", None, start, end).withColumn("tickers", F.array_remove(F.split(F.coalesce("tickers", F.lit("")), r"\|"), ""))
    return rows if ticker is None else rows.where(F.array_contains("tickers", ticker))
