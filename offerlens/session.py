"""Session settings and durable cut points.

Operators never build a session; callers pass DataFrames. ``build_session`` is a
convenience for tests, the bench and notebooks.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# AQE re-plans joins from measured shuffle sizes and splits skewed partitions;
# the byte limit on Arrow batches keeps pages of any size out of one huge batch.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def build_session(app: str = "offerlens", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@contextmanager
def session_settings(spark: SparkSession, settings: Mapping[str, str]) -> Iterator[None]:
    """Settings for what starts inside, taken back afterwards."""
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one only
    for a local master that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="offerlens-checkpoint-")
    sc.setCheckpointDir(folder)
    return folder


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Kinds of columns that Parquet does not hold.
_UNSTORED = ("void", "interval", "geometry", "geography")


@contextmanager
def cleaned_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the actions inside are removed as each of them ends."""
    with session_settings(spark, {_CLEANUP: "true"}):
        yield


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from there, so that a lost
    executor neither recomputes nor changes what later steps read. It is written by
    column and pressed, which takes a fraction of a checkpoint of rows, and the shuffle
    files that led to it go at once. What a table cannot hold is checkpointed."""
    spark = df.sparkSession
    folder = checkpoint_folder(spark)
    names = [c.lower() for c in df.columns]
    plain = names and len(set(names)) == len(names) and not any(k in kind for _, kind in df.dtypes for k in _UNSTORED)
    if not plain:
        return df.checkpoint(eager=True)
    place = f"{folder}/kept-{os.urandom(8).hex()}"
    with cleaned_shuffles(spark):
        df.write.option("compression", "zstd").parquet(place)
    return spark.read.schema(df.schema).parquet(place)


_METHOD_SIZE = "spark.sql.codegen.hugeMethodLimit"


def compiled(df: DataFrame) -> DataFrame:
    """``df``, in a session whose generated methods are such that the JVM compiles them: it
    leaves methods of more than 8000 bytes to its interpreter, and a chain of wide
    projections is one method. Beyond this limit they are split instead. It stays set for
    the caller, who runs what is made of ``df``; a limit of the caller's own stays too."""
    conf = df.sparkSession.conf
    if conf.get(_METHOD_SIZE, "65535") == "65535":
        conf.set(_METHOD_SIZE, "8000")
    return df


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores when the files give fewer tasks than there are cores,
    as one unsplittable file does; dealt in turns, so that no key gathers. Larger
    inputs are left as they are scanned."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
