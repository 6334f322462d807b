"""Shop popularity from browse events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlens.fixed import RANKING_HOURS_RANGE, RANKING_TARGET_PRIORITY, Marketplace
from offerlens.functions.keys import hours_before
from offerlens.operators.join import held, join_shops
from offerlens.operators.merge import add_ranked_targets
from offerlens.operators.ordered import number_rows


def browse_counts(events: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    low, high = RANKING_HOURS_RANGE
    if not low <= hours <= high:
        raise ValueError(f"hours lies in {low}..{high}")
    recent = events.filter(F.col("browsed_at") >= hours_before(as_of, hours))
    return recent.groupBy("shop_code").agg(F.count("*").alias("browse_count"))


def _order() -> list[Column]:
    return [F.col("browse_count").desc(), F.col("shop_code").asc()]


def live_ranking(events: DataFrame, shops: DataFrame, as_of: Column, limit: int = 20, hours: int = 24) -> DataFrame:
    """Top shops of the trailing hours."""
    return top_shops(browse_counts(events, as_of, hours), shops, limit)


def top_shops(counts: DataFrame, shops: DataFrame, limit: int = 20) -> DataFrame:
    """Counted shops cut to the top first; at most 100 rows are then held, numbered and
    named."""
    if not 1 <= limit <= 100:
        raise ValueError("limit lies in 1..100")
    top = held(counts.orderBy(*_order()).limit(limit))
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(*_order())))
    return join_shops(ranked, shops.select("shop_code", "shop_name"), page_side=True).select(
        "rank", "shop_code", "shop_name", "browse_count"
    )


def rank_all(counts: DataFrame, ranking_date: Column) -> DataFrame:
    """Rank positions of all shops of one day, the rows of the ranking table."""
    return number_rows(counts, [], _order(), "rank_position").select(
        ranking_date.alias("ranking_date"), "shop_code", "browse_count", "rank_position"
    )


def rank_per_day(events: DataFrame) -> DataFrame:
    """Ranking rows for every calendar day in the events."""
    counts = events.groupBy(F.to_date("browsed_at").alias("ranking_date"), "shop_code").agg(
        F.count("*").alias("browse_count")
    )
    return number_rows(counts, ["ranking_date"], _order(), "rank_position")


def daily_ranking(rankings: DataFrame, shops: DataFrame, limit: int = 20, date: str | None = None) -> DataFrame:
    """Stored ranking of a day (the latest by default). A missing position falls
    back to the place in the list."""
    if date is None:
        last = rankings.agg(F.max("ranking_date").alias("_last"))
        # One row: a maximum.
        rows = rankings.join(F.broadcast(last), F.col("ranking_date") == F.col("_last")).drop("_last")
    else:
        rows = rankings.filter(F.col("ranking_date") == F.lit(date).cast("date"))
    order = [F.col("rank_position").asc_nulls_first(), F.col("shop_code").asc()]
    top = held(rows.orderBy(*order).limit(limit))
    place = F.row_number().over(Window.orderBy(*order))
    ranked = top.withColumn("rank", F.coalesce(F.nullif(F.col("rank_position"), F.lit(0)), place).cast("bigint"))
    return join_shops(ranked, shops.select("shop_code", "shop_name"), page_side=True).select(
        "rank", "shop_code", "shop_name", "browse_count"
    )


def with_share(top: DataFrame) -> DataFrame:
    """Share of the leader in whole percent, half up, of a top list (≤ 100 rows)."""
    most = F.max("browse_count").over(Window.partitionBy())
    return top.withColumn("share", F.floor(F.col("browse_count") * 100.0 / most + 0.5).cast("bigint"))


def windowed_counts(events: DataFrame, length: str = "24 hours", slide: str | None = "1 hour") -> DataFrame:
    """Counts per shop in sliding (or tumbling) windows; batch or stream."""
    frame = F.window("browsed_at", length, slide) if slide else F.window("browsed_at", length)
    return (
        events.groupBy(frame.alias("window"), "shop_code")
        .agg(F.count("*").alias("browse_count"))
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "shop_code", "browse_count")
    )


def top_shop_targets(
    targets: DataFrame, rankings: DataFrame, at: Column, n: int = 3, market: Marketplace = Marketplace()
) -> DataFrame:
    """The top n of the latest ranking become active shop targets of high priority."""
    last = rankings.agg(F.max("ranking_date").alias("_last"))
    latest = rankings.join(F.broadcast(last), F.col("ranking_date") == F.col("_last"))
    top = latest.orderBy("rank_position", "shop_code").limit(n)
    wanted = top.select(
        F.lit("shop").alias("target_type"),
        F.col("shop_code").alias("target_value"),
        F.concat(F.lit(f"{market.search_base}?sid="), F.col("shop_code")).alias("base_url"),
        F.lit(True).alias("is_active"),
        F.lit(RANKING_TARGET_PRIORITY).alias("priority"),
        F.lit("auto_ranking").alias("added_by"),
        at.alias("updated_at"),
    )
    return add_ranked_targets(targets, wanted)
