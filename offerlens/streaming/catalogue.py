"""Continuous merge of offers into the catalogue tables, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from offerlens.functions.keys import record_date
from offerlens.operators import history as H
from offerlens.operators import merge as M
from offerlens.fixed import HISTORY_RETENTION_DAYS
from offerlens.operators.retention import keep_events, keep_history
from offerlens.session import durable
from offerlens.sources import browse
from offerlens.sources.offers import item_batch, with_keys
from offerlens.sources.tables import Tables

ORDER = ("fetched_at", "seq")


def merge_offers(tables: Tables, offers: DataFrame, batch_id: int, zone: str = "UTC") -> None:
    """Shops, items, variants, snapshots, history — in this order, each from the
    same durable batch. A repeated batch leaves the same tables: texts and flags by
    nature, views because an item knows the last batch it took in, snapshots and
    history because they are keyed and compared with what is stored. Batch ids are
    those of one stream or job series per catalogue. Of each keyed table only the
    buckets that the batch's keys fall in are read and written, of the history only
    the months."""
    batch = durable(with_keys(offers))
    stored, buckets = tables.read_touched("shops", batch)
    tables.replace_touched(_stamped(M.merge_shops(stored, batch, ORDER), stored, batch, ["shop_code"], "first_seen_at"), "shops", buckets)

    kept, buckets = tables.read_touched("items", batch)
    stored = kept.drop("product_uid")
    items = M.merge_items_once(stored, item_batch(batch), batch_id, ORDER)
    # New rows are active; a merge never reactivates a pruned item. What a user
    # has viewed joins the server's own collection.
    items = items.withColumns({
        "product_uid": F.concat("shop_code", F.lit(":"), "item_code"), "is_active": F.coalesce("is_active", F.lit(True)),
        "in_server_crawl": F.col("in_server_crawl") | F.col("seen_in_ext"),
    })
    tables.replace_touched(_stamped(items, kept, batch, ["shop_code", "item_code"], "created_at"), "items", buckets)

    # A listing shows items, not which variants they have.
    own = batch.filter(F.col("source") != "list")
    kept, buckets = tables.read_touched("variants", own)
    variants = M.merge_variants(kept.drop("variant_uid", "product_uid"), own, ORDER)
    variants = with_keys(variants).withColumn("is_active", F.coalesce("is_active", F.lit(True)))
    tables.replace_touched(_stamped(variants, kept, own, ["shop_code", "item_code", "variant_code"], "created_at"), "variants", buckets)

    seen = H.with_hash(batch.filter(F.col("source") != "list"))
    snapshots, buckets = tables.read_touched("variant_snapshots", own)
    shaped = seen.select("variant_uid", *[c for c in snapshots.columns if c in seen.columns and c != "variant_uid"], *[c for c in ORDER if c not in snapshots.columns])
    after, written = H.upsert_snapshots(snapshots.drop("updated_at"), shaped, ORDER)
    written = durable(written)
    history = tables.read("variant_daily_history")
    months = H.touched_months(history, written, ORDER, zone)
    tables.replace_partitions(months, "variant_daily_history")
    # Snapshots last: until they are replaced a repeated batch still finds the
    # stored hashes it was compared with.
    times = snapshots.select("variant_uid", F.col("updated_at").alias("_was"))
    fresh = written.groupBy("variant_uid").agg(F.max("fetched_at").alias("_now"))
    after = after.join(times, "variant_uid", "left").join(fresh, "variant_uid", "left")
    tables.replace_touched(after.withColumn("updated_at", F.coalesce("_now", "_was")).drop("_was", "_now"), "variant_snapshots", buckets)


def _stamped(rows: DataFrame, stored: DataFrame, batch: DataFrame, keys: list[str], first: str) -> DataFrame:
    """``rows`` with the time of the first and of the last offer of each key. Times are
    those of the offers, so a repeated batch gives the same."""
    times = batch.groupBy(*keys).agg(F.min("fetched_at").alias("_low"), F.max("fetched_at").alias("_high"))
    before = stored.select(*keys, F.col(first).alias("_first"), F.col("updated_at").alias("_last"))
    out = rows.drop(first, "updated_at").join(times, keys, "left").join(before, keys, "left")
    return out.withColumns({first: F.least("_first", "_low"), "updated_at": F.greatest("_last", "_high")}).drop("_low", "_high", "_first", "_last")


def merge_browse_batch(tables: Tables, payloads: DataFrame, batch_id: int, at: str = "received_at", zone: str = "UTC") -> None:
    """One micro-batch of browse payloads: offers into the catalogue, events into
    the event table. Of the event table only the touched days are rewritten, and an
    event that is stored already replaces itself."""
    parsed = durable(browse.parse_events(payloads))
    offers = browse.event_offers(parsed, keep=(at, "event_id")).withColumnRenamed(at, "fetched_at").withColumn(
        "seq", F.struct(F.col("event_id"), F.col("variant_place")))
    merge_offers(tables, offers, batch_id, zone)

    rows = browse.event_rows(parsed, at, keep=("event_id",)).withColumn("browse_date", record_date("browsed_at"))
    days = [r[0] for r in rows.select("browse_date").distinct().collect()]  # few; they prune the scan as literals
    stored = tables.read("user_browse_events").filter(F.col("browse_date").isin(*days) if days else F.lit(False))
    fresh = rows.dropDuplicates(["event_id"])
    kept = stored.join(fresh.select("event_id"), "event_id", "left_anti")
    tables.replace_partitions(kept.unionByName(fresh.select(*kept.columns)), "user_browse_events")


def start_browse(stream: DataFrame, tables: Tables, checkpoint: str, at: str = "received_at", late: str = "1 hour", zone: str = "UTC", **trigger) -> StreamingQuery:
    """Merge a stream of (event_id, payload, received_at). An event delivered again
    within the watermark is dropped before the merge."""
    once = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark(["event_id"])
    return (
        once.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(lambda df, batch_id: merge_browse_batch(tables, df, batch_id, at, zone)).start()
    )


def trim_events(tables: Tables, as_of, days: int = 7) -> None:
    """Event retention: folders of days before the cutoff go unread, and only the day
    of the cutoff itself is filtered and rewritten."""
    first = tables.spark.range(1).select(F.date_format(as_of - F.make_dt_interval(days=F.lit(days)), "yyyy-MM-dd").alias("d")).first()["d"]
    tables.drop_partitions("user_browse_events", [d for d in tables.partitions("user_browse_events") if d < first])
    if first in tables.partitions("user_browse_events"):
        edge = tables.read("user_browse_events").filter(F.col("browse_date") == F.lit(first).cast("date"))
        kept = durable(keep_events(edge, as_of, days))
        if kept.isEmpty():
            tables.drop_partitions("user_browse_events", [first])
        else:
            tables.replace_partitions(kept, "user_browse_events")


def trim_history(tables: Tables, as_of, days: int = HISTORY_RETENTION_DAYS) -> None:
    """History retention: whole months before the horizon are dropped, the month it
    falls in is rewritten."""
    month = tables.spark.range(1).select(F.date_format(F.date_sub(as_of.cast("date"), days), "yyyy-MM").alias("m")).first()["m"]
    tables.drop_partitions("variant_daily_history", [m for m in tables.partitions("variant_daily_history") if m < month])
    if month in tables.partitions("variant_daily_history"):
        edge = tables.read("variant_daily_history").filter(F.col("record_month") == month)
        kept = durable(keep_history(edge, as_of, days))
        if kept.isEmpty():
            tables.drop_partitions("variant_daily_history", [month])
        else:
            tables.replace_partitions(kept, "variant_daily_history")
