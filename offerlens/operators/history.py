"""Current snapshot and day-grain history of variants."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.fixed import HISTORY_DAYS_RANGE
from offerlens.functions.keys import content_hash, record_date
from offerlens.functions.price import offer_value
from offerlens.operators.ordered import latest_per_key, number_rows, previous_row

KEY = "variant_uid"


def with_hash(observations: DataFrame) -> DataFrame:
    return observations.withColumn("content_hash", content_hash(observations.columns))


def latest_snapshot(observations: DataFrame, order: Sequence[str], key: str = KEY) -> DataFrame:
    """The whole last row per variant, NULL measures included."""
    return latest_per_key(observations, [key], order)


def changed_only(
    observations: DataFrame, order: Sequence[str], key: str = KEY, compare: str = "content_hash",
) -> DataFrame:
    """Rows that differ from the row before them. The stored row a write is
    compared with equals the previous distinct row, so one pass over the ordered
    observations gives what one-by-one writing would keep."""
    seen = previous_row(observations, [key], [F.col(c) for c in order], [compare], "_before")
    differs = F.col("_before").isNull() | ~F.col("_before")[compare].eqNullSafe(F.col(compare))
    return seen.filter(differs).drop("_before")


def daily_history(observations: DataFrame, order: Sequence[str], zone: str = "UTC", key: str = KEY) -> DataFrame:
    """Last write of the day per variant."""
    dated = observations.withColumn("record_date", record_date("fetched_at", zone))
    return latest_per_key(dated, [key, "record_date"], order)


def skip_unchanged(batch: DataFrame, snapshots: DataFrame, key: str = KEY) -> DataFrame:
    """Batch rows (one per key) whose hash is not the stored one."""
    stored = snapshots.select(F.col(key).alias("_key"), F.col("content_hash").alias("_hash"))
    joined = batch.join(stored, batch[key] == stored["_key"], "left")
    return joined.filter(~F.col("_hash").eqNullSafe(F.col("content_hash"))).select(*batch.columns)


def _over(current: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    kept = current.join(batch.select(*keys), keys, "left_anti")
    return kept.select(*current.columns).unionByName(batch.select(*current.columns))


def upsert_snapshots(
    snapshots: DataFrame, batch: DataFrame, order: Sequence[str], key: str = KEY, skip: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(new snapshots, rows written to history). With ``skip`` only rows that
    differ from the stored state, or from the batch row before them, count; so a
    batch gives the same as its rows one by one."""
    if skip:
        stored = snapshots.select(F.col(key).alias("_key"), F.col("content_hash").alias("_hash"))
        ordered = previous_row(batch, [key], [F.col(c) for c in order], ["content_hash"], "_before")
        joined = ordered.join(stored, ordered[key] == stored["_key"], "left")
        before = F.when(F.col("_before").isNotNull(), F.col("_before")["content_hash"]).otherwise(F.col("_hash"))
        written = joined.filter(~before.eqNullSafe(F.col("content_hash"))).select(*batch.columns)
    else:
        written = batch
    last = latest_per_key(written, [key], order)
    return _over(snapshots, last, [key]), written


def upsert_history(history: DataFrame, written: DataFrame, order: Sequence[str], zone: str = "UTC", key: str = KEY) -> DataFrame:
    """One row per (variant, day); the last write of a day replaces earlier ones."""
    return _over(history, daily_history(written, order, zone, key), [key, "record_date"])


def touched_months(history: DataFrame, written: DataFrame, order: Sequence[str], zone: str = "UTC", key: str = KEY) -> DataFrame:
    """Only the months a batch touches, rewritten, for a partition overwrite. The
    months are few, so they are looked up once and reach the scan as literals."""
    fresh = daily_history(written, order, zone, key).withColumn("record_month", F.date_format("record_date", "yyyy-MM"))
    months = [r[0] for r in fresh.select("record_month").distinct().collect()]
    stored = history.filter(F.col("record_month").isin(*months)) if months else history.limit(0)
    return _over(stored, fresh.select(*[c for c in stored.columns if c in fresh.columns]), [key, "record_date"])


# Queries over the history ---------------------------------------------------


def _days(days: int) -> int:
    low, high = HISTORY_DAYS_RANGE
    if not low <= days <= high:
        raise ValueError(f"days lies in {low}..{high}")
    return days


def window_of_days(history: DataFrame, days: int, as_of: Column) -> DataFrame:
    """Both ends included, so up to days + 1 dates."""
    return history.filter(F.col("record_date") >= F.date_sub(as_of.cast("date"), _days(days)))


def between_dates(history: DataFrame, start=None, end=None) -> DataFrame:
    if start is not None:
        history = history.filter(F.col("record_date") >= F.lit(start).cast("date"))
    if end is not None:
        history = history.filter(F.col("record_date") <= F.lit(end).cast("date"))
    return history


def variant_history(history: DataFrame, variant: str, days: int, as_of: Column, key: str = KEY) -> DataFrame:
    return window_of_days(history.filter(F.col(key) == variant), days, as_of).orderBy("record_date")


def batch_history(history: DataFrame, ids: Sequence[str], days: int, as_of: Column, key: str = KEY) -> DataFrame:
    """One row per requested id in request order with its dated rows as an array.
    A variant has one row per day, so an array never exceeds days + 1 entries."""
    if not 1 <= len(ids) <= 20:
        raise ValueError("1 to 20 ids")
    spark = history.sparkSession
    wanted = spark.createDataFrame([(i, v) for i, v in enumerate(ids)], f"_place int, {key} string")
    rows = window_of_days(history.filter(F.col(key).isin(*ids)), days, as_of)
    arrays = history_arrays(rows, key)
    return (
        wanted.join(arrays, key, "left")
        .select("_place", key, F.lit(days).alias("days"), F.coalesce("history", F.array()).alias("history"))
        .orderBy("_place")
        .drop("_place")
    )


def history_arrays(history: DataFrame, key: str = KEY) -> DataFrame:
    """Dated rows of each variant as one array in date order. The input holds one
    row per variant and day, which bounds an array by the days kept."""
    shown = [c for c in ("record_date", "price", "point_rate", "point_back_percent", "coupon_yen", "coupon_percent",
                         "shipping_days_min", "shipping_days_max") if c in history.columns]
    return history.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*shown))).alias("history"))


CHANGE_COLUMNS = ("price", "coupon_yen", "coupon_percent", "point_rate")


def display_changes(history: DataFrame, key: str = KEY) -> DataFrame:
    """Changed-only view of a newest-first list: a row stays if it differs from
    the next newer one; the newest always stays."""
    newest_first = [F.col("record_date").desc()]
    seen = previous_row(history, [key], newest_first, list(CHANGE_COLUMNS), "_newer")
    same = F.col("_newer").isNotNull()
    for c in CHANGE_COLUMNS:
        same = same & F.col("_newer")[c].eqNullSafe(F.col(c))
    return seen.filter(~same).drop("_newer")


def priced_history(
    history: DataFrame, multiplier: float = 4.0, start=None, end=None, changes_only: bool = False,
    key: str = KEY, mode: str = "chart",
) -> DataFrame:
    """Points, coupon and net price of each dated row."""
    rows = display_changes(history, key) if changes_only else history
    rows = between_dates(rows, start, end)
    value = offer_value(multiplier=multiplier, mode=mode)
    priced = rows.withColumn("_value", value)
    return priced.select(
        key,
        "record_date",
        F.coalesce(F.col("price"), F.lit(0)).alias("price"),
        F.col("_value.total_points").alias("points"),
        F.col("_value.price_minus_points").alias("price_minus_points"),
        F.col("_value.effective_coupon").alias("coupon"),
        F.col("_value.effective_price").alias("effective_price"),
    )


def calculate_points(snapshots: DataFrame, multiplier: float = 4.0, key: str = KEY, variant: str | None = None) -> DataFrame:
    """Server-side point calculation with the inputs it used."""
    rows = snapshots if variant is None else snapshots.filter(F.col(key) == variant)
    value = offer_value(multiplier=multiplier, mode="server")
    back = F.coalesce(F.col("point_back_percent").cast("double"), F.lit(0.0))
    return rows.withColumn("_value", value).select(
        key,
        F.lit(float(multiplier)).alias("point_multiplier"),
        F.coalesce(F.col("price"), F.lit(0)).alias("price"),
        F.coalesce(F.col("coupon_yen"), F.lit(0)).alias("coupon_yen"),
        F.coalesce(F.col("coupon_percent").cast("double"), F.lit(0.0)).alias("coupon_percent"),
        F.coalesce(F.col("point_rate").cast("double"), F.lit(0.0)).alias("plus_x_up"),
        F.when(back == 0, F.lit(1)).otherwise(back.cast("int")).alias("point_back_flag"),
        F.col("_value.effective_coupon").alias("effective_coupon"),
        F.col("_value.total_points").alias("total_points"),
        F.col("_value.price_minus_points").alias("price_minus_points"),
        F.col("_value.effective_price").alias("price_minus_points_coupon"),
    )


def history_chunks(history: DataFrame, size: int = 1000, key: str = KEY) -> DataFrame:
    """Arrays for any number of rows per key: fixed-size chunks in date order."""
    placed = number_rows(history, [key], [F.col("record_date")], "_n")
    chunked = placed.withColumn("chunk", F.floor((F.col("_n") - 1) / size).cast("int"))
    return chunked.groupBy(key, "chunk").agg(
        F.array_sort(F.collect_list(F.struct("record_date", "price"))).alias("history")
    )
