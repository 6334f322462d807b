"""Shop rankings over a stream of browse events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from offerlens.operators.ordered import number_rows
from offerlens.operators.ranking import top_shops, windowed_counts
from offerlens.sources.tables import Tables


def timed(events: DataFrame, at: str = "browsed_at", late: str = "1 hour", key: str | None = None) -> DataFrame:
    """Events with a watermark on a real timestamp; with ``key`` a redelivered
    event counts once while it is within the watermark."""
    marked = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return marked.dropDuplicatesWithinWatermark([key]) if key else marked


def sliding_counts(events: DataFrame, length: str = "24 hours", slide: str = "1 hour", late: str = "1 hour", key: str | None = None) -> DataFrame:
    """Counts per shop of the trailing hours, one window per slide, appended when a
    window is complete."""
    return windowed_counts(timed(events, late=late, key=key), length, slide)


def daily_counts(events: DataFrame, late: str = "1 hour", key: str | None = None) -> DataFrame:
    return windowed_counts(timed(events, late=late, key=key), "1 day", None)


def ranked_windows(counts: DataFrame) -> DataFrame:
    """Rank positions inside each window; a stream cannot rank, a batch of it can."""
    order = [F.col("browse_count").desc(), F.col("shop_code").asc()]
    return number_rows(counts, ["start", "end"], order, "rank_position")


def start_live(
    events: DataFrame, place: str, checkpoint: str, length: str = "24 hours", slide: str = "1 hour", late: str = "1 hour", key: str | None = None, **trigger,
) -> StreamingQuery:
    """Append the counts of each complete trailing window to a folder, from which
    ``live_windows`` reads. The file sink commits a batch once, so one that runs twice
    leaves the same rows."""
    return (
        sliding_counts(events, length, slide, late, key).writeStream.format("parquet").outputMode("append").option("path", place)
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )


def live_windows(counts: DataFrame, shops: DataFrame, limit: int = 20) -> DataFrame:
    """The top shops of the last complete window; at most 100 rows are held and named."""
    last = counts.agg(F.max("end").alias("_last"))  # one row
    recent = counts.join(F.broadcast(last), F.col("end") == F.col("_last")).select("shop_code", "browse_count")
    return top_shops(recent, shops, limit)


def start_rankings(events: DataFrame, tables: Tables, checkpoint: str, late: str = "1 hour", key: str | None = None, **trigger) -> StreamingQuery:
    """Keep the ranking table of each day. The complete count of a day replaces its
    partition: a day leaves the windows once, when it is complete, so no later batch
    brings rows of it, and a batch that runs twice leaves the same rows."""
    def write(batch: DataFrame, _: int) -> None:
        days = batch.select(F.to_date("start").alias("ranking_date"), "shop_code", "browse_count", F.col("end").alias("created_at"))
        order = [F.col("browse_count").desc(), F.col("shop_code").asc()]
        tables.replace_partitions(number_rows(days, ["ranking_date"], order, "rank_position"), "shop_rankings")

    return (
        daily_counts(events, late, key).writeStream.outputMode("append").option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).foreachBatch(write).start()
    )
