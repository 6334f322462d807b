"""What is kept and what is dropped, by age, volume and views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.fixed import (
    EVENT_RETENTION_DAYS, EXTENSION_ITEM_CAP, EXTENSION_PRUNE_EXTRA, EXTENSION_PRUNE_MONTHS,
    HISTORY_RETENTION_DAYS,
)
from offerlens.functions.keys import months_before
from offerlens.operators.ordered import number_rows


def keep_history(history: DataFrame, as_of: Column, days: int = HISTORY_RETENTION_DAYS) -> DataFrame:
    """Rows within the horizon. On a month-partitioned table the month bound lets
    whole partitions go unread; only the boundary month is filtered by day."""
    first = F.date_sub(as_of.cast("date"), days)
    kept = history.filter(F.col("record_date") >= first)
    if "record_month" in history.columns:
        kept = kept.filter(F.col("record_month") >= F.date_format(first, "yyyy-MM"))
    return kept


def keep_events(events: DataFrame, as_of: Column, days: int = EVENT_RETENTION_DAYS) -> DataFrame:
    return events.filter(F.col("browsed_at") >= as_of - F.make_dt_interval(days=F.lit(days)))


def items_to_prune(
    items: DataFrame, as_of: Column, cap: int = EXTENSION_ITEM_CAP, extra: int = EXTENSION_PRUNE_EXTRA,
    most: int | None = None,
) -> DataFrame:
    """Keys of the items to deactivate: if the active extension items exceed the
    cap, the least viewed and oldest of those first seen over two months ago and
    not collected by the server: ``excess + extra`` of them, or ``most`` if the caller
    limits a run."""
    ext = items.filter(F.col("seen_in_ext") & F.col("is_active"))
    excess = ext.agg((F.count("*") - cap).alias("_excess"))
    old = ext.filter(~F.col("in_server_crawl") & (F.col("ext_first_seen") < months_before(as_of, EXTENSION_PRUNE_MONTHS)))
    order = [F.col("ext_view_count"), F.col("ext_first_seen"), F.col("product_uid")]
    numbered = number_rows(old.select("product_uid", "ext_view_count", "ext_first_seen"), [], order, "_place")
    last = F.col("_excess") + extra if most is None else F.least(F.col("_excess") + extra, F.lit(most))
    return numbered.join(F.broadcast(excess), (F.col("_excess") > 0) & (F.col("_place") <= last)).select("product_uid")


def prune_items(items: DataFrame, as_of: Column, **limits: int) -> DataFrame:
    """Items with the pruned ones set inactive."""
    gone = items_to_prune(items, as_of, **limits).withColumn("_gone", F.lit(True))
    return (
        items.join(gone, "product_uid", "left")
        .withColumn("is_active", F.when(F.col("_gone"), F.lit(False)).otherwise(F.col("is_active")))
        .select(*items.columns)
    )
