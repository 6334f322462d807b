"""The catalogue laid out for its star join: items, variants and snapshots bucketed alike.

All three tables are bucketed and sorted by (product, part), so that variants meet their
item and their snapshot bucket by bucket and no join moves a row. A product usually has
one part. One with more than ``widest`` variants is dealt over as many parts as that takes,
by the hash of the variant; its item row is stored once a part, which adds at most one row
for each ``widest`` variants. So no bucket gathers a huge product.

What depends on all variants of a product (``siblings``, its active variants) is counted
when the tables are written. A snapshot without variant goes by its own key.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.operators.search import Search, search_flags, search_totals
from offerlens.session import cleaned_shuffles, session_settings

HOME = ("product_uid", "part")
TABLES = ("items", "variants", "snapshots")
# Tables dealt by (product, part) also serve joins on these and the variant.
CO_LOCATED = {"spark.sql.requireAllClusterKeysForCoPartition": "false"}


@contextmanager
def co_located(spark: SparkSession) -> Iterator[None]:
    """Plans made inside join bucketed tables on more keys than those of the buckets."""
    with session_settings(spark, CO_LOCATED):
        yield


class Star:
    """Three tables of one layout in the session's catalogue, named by a common prefix."""

    def __init__(self, spark: SparkSession, prefix: str):
        self.spark, self.prefix = spark, prefix

    def name(self, table: str) -> str:
        return f"{self.prefix}_{table}"

    def _read(self, table: str) -> DataFrame:
        return self.spark.read.table(self.name(table))

    @property
    def items(self) -> DataFrame:
        """One row per product and part."""
        return self._read("items")

    @property
    def variants(self) -> DataFrame:
        return self._read("variants")

    @property
    def snapshots(self) -> DataFrame:
        """``product_uid`` is the variant's product, or the snapshot's own key where there
        is no such variant."""
        return self._read("snapshots")

    def plain(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Items, variants and snapshots in the shape that every operator takes."""
        items = self.items.filter(F.col("part") == 0).drop("part", "siblings")
        return items, self.variants.drop("part"), self.snapshots.drop(*HOME)

    def write(self, root: str, items: DataFrame, variants: DataFrame, snapshots: DataFrame, buckets: int = 64, widest: int = 100_000) -> Star:
        """Store the three tables below ``root``. Keys are unique in each of them: items by
        product, variants and snapshots by variant; a variant names its product."""
        def part(parts):
            return F.pmod(F.xxhash64("variant_uid"), F.coalesce(parts, F.lit(1))).cast("int")

        # Few products are that wide: at most one in ``widest`` variants.
        wide = variants.groupBy("product_uid").agg(F.ceil(F.count("*") / widest).cast("int").alias("_parts")).filter(F.col("_parts") > 1)
        own = variants.drop("part").join(wide, "product_uid", "left").withColumn("part", part(F.col("_parts"))).drop("_parts")
        self._store(own, "variants", root, buckets)

        placed = self.variants.select("variant_uid", F.col("product_uid").alias("_home"), F.col("part").alias("_part"))
        found = snapshots.drop("product_uid", "part").join(placed, "variant_uid", "left")
        found = found.withColumns({"product_uid": F.coalesce("_home", "variant_uid"), "part": F.coalesce("_part", F.lit(0))})
        self._store(found.drop("_home", "_part"), "snapshots", root, buckets)

        sizes = self.variants.groupBy("product_uid").agg((F.max("part") + 1).alias("_parts"), F.count_if("is_active").alias("siblings"))
        counted = items.drop("part", "siblings").join(sizes, "product_uid", "left").withColumns({
            "siblings": F.coalesce("siblings", F.lit(0)),
            "part": F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))})
        self._store(counted.drop("_parts"), "items", root, buckets)
        return self

    def _store(self, rows: DataFrame, table: str, root: str, buckets: int) -> None:
        order = [*HOME, *[c for c in ("variant_uid",) if c in rows.columns]]
        # Dealt as the buckets are, each bucket is written by one task into one file.
        dealt = rows.repartition(buckets, *HOME)
        stored = dealt.write.mode("overwrite").option("compression", "zstd").option("path", f"{root}/{table}")
        with cleaned_shuffles(self.spark):
            stored.bucketBy(buckets, *HOME).sortBy(*order).saveAsTable(self.name(table))

    def drop(self) -> None:
        """Take the names out of the catalogue; the files stay."""
        for table in TABLES:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name(table)}")


def count_stored(star: Star, searches: dict[str, Search]) -> DataFrame:
    """(kind, total) of several searches in one pass over the stored star. Evaluate it
    inside ``co_located``: then no join shuffles."""
    many = F.col("siblings") > 1
    items = search_flags(star.items.withColumn("many", many), [*HOME, "many"], "item", searches)
    variants = search_flags(star.variants, [*HOME, "variant_uid"], "variant", searches)
    snapshots = search_flags(star.snapshots, [*HOME, "variant_uid"], "snapshot", searches)
    rows = variants.join(items, [*HOME]).join(snapshots, [*HOME, "variant_uid"], "left")
    return search_totals(rows, searches)
