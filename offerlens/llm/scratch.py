"""Written tables between the steps of a job, in the shared checkpoint folder.

Like a checkpoint a written table cuts lineage, so a lost executor repeats one step at
most. It is pressed by column, and a step that is done with it drops it; the shuffle
files of the step that wrote it go at once, not when the driver next collects garbage.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from offerlens.session import checkpoint_folder, cleaned_shuffles


class Scratch:
    """One folder of written tables."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{checkpoint_folder(spark)}/{name}-{os.urandom(8).hex()}"
        self._places: dict[int, tuple[DataFrame, str]] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        place = f"{self.root}/{len(self._places)}-{os.urandom(4).hex()}"
        with cleaned_shuffles(self.spark):
            df.write.option("compression", "zstd").parquet(place)
        kept = self.spark.read.schema(df.schema).parquet(place)
        self._places[id(kept)] = kept, place
        return kept

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that ``keep`` gave; nothing may read them afterwards."""
        for table in tables:
            _, place = self._places.pop(id(table))
            at = self.spark._jvm.org.apache.hadoop.fs.Path(place)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
