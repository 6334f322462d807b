"""Catalogue tables as Parquet folders: scans, appends, partition and whole rewrites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.schema import BUCKETED, CLUSTERED, PARTITIONS, TABLES, conform, schema
from offerlens.session import durable
from offerlens.sources.buckets import BucketTable

BUCKETS = 64


class Tables:
    """The tables below one folder. Keyed tables that batches merge into are dealt to
    ``buckets`` by key (a bucket should come to one file of a usual size)."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def bucketed(self, table: str) -> BucketTable | None:
        if table not in BUCKETED:
            return None
        return BucketTable(self.spark, self.path(table), schema(table), BUCKETED[table], self.buckets, CLUSTERED.get(table, BUCKETED[table]))

    def path(self, table: str) -> str:
        if table not in TABLES:
            raise KeyError(table)
        return f"{self.root}/{table}"

    def _files(self, path: str):
        """The path as an object of its file system, and that file system."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, table: str) -> bool:
        """Whether the table is stored. A swap that was broken off between its two
        renames is taken back first."""
        if (dealt := self.bucketed(table)) is not None:
            return dealt.exists()
        at, files = self._files(self.path(table))
        if files.exists(at):
            return True
        old, _ = self._files(self.path(table) + "__old")
        return files.exists(old) and files.rename(old, at)

    def read(self, table: str) -> DataFrame:
        """The stored rows; none before the first write. The schema is given, so no
        file is opened to infer it and partition folders prune."""
        if (dealt := self.bucketed(table)) is not None:
            return dealt.read()
        if not self.exists(table):
            return self.spark.createDataFrame([], schema(table))
        return self.spark.read.schema(schema(table)).parquet(self.path(table)).select(*schema(table).fieldNames())

    def read_touched(self, table: str, batch: DataFrame) -> tuple[DataFrame, list[int]]:
        """Of a bucketed table the buckets that the keys of ``batch`` fall in, and their
        numbers. No other bucket is opened."""
        dealt = self.bucketed(table)
        if dealt is None:
            raise ValueError(f"{table} has no buckets")
        buckets = dealt.touched(batch)
        return dealt.read(buckets), buckets

    def replace_touched(self, df: DataFrame, table: str, buckets: list[int]) -> None:
        """Swap in new rows for these buckets; all others stay as they are."""
        if buckets:
            self.bucketed(table).write(conform(df, table), buckets)

    def _writer(self, df: DataFrame, table: str, mode: str):
        rows = conform(df, table)
        parts = PARTITIONS.get(table, [])
        order = CLUSTERED.get(table, [])
        if parts:
            # Few files per partition folder; a large folder is split over tasks.
            rows = rows.hint("rebalance", *parts)
        elif order:
            rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
        writer = rows.write.mode(mode)
        return writer.partitionBy(*parts) if parts else writer

    def append(self, df: DataFrame, table: str) -> None:
        if table in BUCKETED:
            raise ValueError(f"{table} is keyed: merge into it or replace it")
        self._writer(df, table, "append").parquet(self.path(table))

    def replace_partitions(self, df: DataFrame, table: str) -> None:
        """Overwrite the partitions the rows fall in, leave all others."""
        if table not in PARTITIONS:
            raise ValueError(f"{table} has no partitions")
        staged = durable(conform(df, table))
        self._writer(staged, table, "overwrite").option("partitionOverwriteMode", "dynamic").parquet(self.path(table))

    def replace(self, df: DataFrame, table: str) -> None:
        """Swap in a new version of the whole table, which may derive from the stored
        one: it is written beside it, then two renames exchange them. Until then
        readers see the old version, and a failed write leaves it untouched."""
        if (dealt := self.bucketed(table)) is not None:
            dealt.write(conform(df, table))
            return
        new, old, here = self.path(table) + "__new", self.path(table) + "__old", self.path(table)
        stored = self.exists(table)
        self._writer(df, table, "overwrite").option("partitionOverwriteMode", "static").parquet(new)
        (at, files), (next_at, _), (old_at, _) = self._files(here), self._files(new), self._files(old)
        files.delete(old_at, True)
        if stored and not files.rename(at, old_at) or not files.rename(next_at, at):
            raise OSError(f"{here} can't be swapped")
        files.delete(old_at, True)
        self.spark.catalog.refreshByPath(here)

    def partitions(self, table: str) -> list:
        """Values of the table's partition column, from its folders' names alone."""
        (column,) = PARTITIONS[table]
        at, files = self._files(self.path(table))
        if not self.exists(table):
            return []
        names = [s.getPath().getName() for s in files.listStatus(at)]
        return sorted(n.split("=", 1)[1] for n in names if n.startswith(f"{column}="))

    def drop_partitions(self, table: str, values: list) -> None:
        """Delete whole partition folders; no row is read."""
        (column,) = PARTITIONS[table]
        for value in values:
            at, files = self._files(f"{self.path(table)}/{column}={value}")
            files.delete(at, True)
        self.spark.catalog.refreshByPath(self.path(table))

    def scan_history(self, first_day, last_day=None) -> DataFrame:
        """History between two days; only the months between are read."""
        first = F.lit(first_day).cast("date")
        rows = self.read("variant_daily_history").filter(
            (F.col("record_month") >= F.date_format(first, "yyyy-MM")) & (F.col("record_date") >= first))
        if last_day is not None:
            last = F.lit(last_day).cast("date")
            rows = rows.filter((F.col("record_month") <= F.date_format(last, "yyyy-MM")) & (F.col("record_date") <= last))
        return rows
