"""Schemas of the thirteen catalogue tables, as DDL text per table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from offerlens.fixed import ADDED_BY, JOB_STATUSES, JOB_TYPES, SLICE_STATUSES, SOURCES, TARGET_TYPES

_STATE = """price BIGINT, point_rate DECIMAL(5,1), point_back_percent DECIMAL(5,1), coupon_yen BIGINT, coupon_percent DECIMAL(5,1),
 {text}shipping_days_min SMALLINT, shipping_days_max SMALLINT, image_url STRING, extra1_key STRING, extra1_value STRING,
 extra2_key STRING, extra2_value STRING, content_hash STRING, fetched_at TIMESTAMP, source STRING"""

TABLES = {
    "shops": "shop_code STRING, shop_name STRING, shop_url STRING, first_seen_at TIMESTAMP, updated_at TIMESTAMP",
    "items": """product_uid STRING, shop_code STRING, item_code STRING, api_item_code STRING, canonical_url STRING, item_name STRING,
 catchcopy STRING, genre_id STRING, seen_in_api BOOLEAN, seen_in_list BOOLEAN, seen_in_detail BOOLEAN, seen_in_ext BOOLEAN,
 ext_first_seen TIMESTAMP, ext_view_count BIGINT, in_server_crawl BOOLEAN, is_active BOOLEAN, merge_batch BIGINT, created_at TIMESTAMP,
 updated_at TIMESTAMP""",
    "variants": """variant_uid STRING, product_uid STRING, shop_code STRING, item_code STRING, variant_code STRING, jan_code STRING,
 variant_name STRING, selector_values STRING, is_active BOOLEAN, created_at TIMESTAMP, updated_at TIMESTAMP""",
    "variant_snapshots": "variant_uid STRING, " + _STATE.format(text="shipping_text_raw STRING, ") + ", updated_at TIMESTAMP",
    "variant_daily_history": "variant_uid STRING, record_date DATE, " + _STATE.format(text="") + ", record_month STRING",
    "crawl_targets": """id BIGINT, target_type STRING, target_value STRING, base_url STRING, is_active BOOLEAN, priority SMALLINT,
 added_by STRING, last_crawled_at TIMESTAMP, created_at TIMESTAMP, updated_at TIMESTAMP""",
    "price_range_slices": """id BIGINT, crawl_target_id BIGINT, min_price BIGINT, max_price BIGINT, estimated_count BIGINT,
 last_crawled_at TIMESTAMP, status STRING, created_at TIMESTAMP, updated_at TIMESTAMP""",
    "crawl_jobs": """id BIGINT, job_type STRING, target_url STRING, params_json STRING, product_uid STRING, status STRING, attempts INT,
 max_attempts INT, locked_by STRING, locked_at TIMESTAMP, started_at TIMESTAMP, error_message STRING, result_summary STRING,
 created_at TIMESTAMP, scheduled_at TIMESTAMP, completed_at TIMESTAMP""",
    "user_browse_events": "event_id BIGINT, user_id STRING, variant_uid STRING, product_uid STRING, shop_code STRING, page_url STRING, browsed_at TIMESTAMP, browse_date DATE",
    "shop_rankings": "ranking_date DATE, shop_code STRING, browse_count BIGINT, rank_position BIGINT, created_at TIMESTAMP",
    "list_observations": """product_uid STRING, observed_price BIGINT, price_range STRING, point_count BIGINT, point_base_multiplier INT,
 point_shop_multiplier INT, point_up_multiplier INT, point_deal_multiplier INT, point_item_multiplier INT, point_total_multiplier INT,
 is_point_back BOOLEAN, point_back_rate DECIMAL(5,1), point_text_raw STRING, coupon_discount BIGINT, coupon_type STRING,
 coupon_text_raw STRING, shipping_cost BIGINT, delivery_text STRING, delivery_days INT, is_free_shipping BOOLEAN,
 review_score DECIMAL(3,2), review_count BIGINT, shop_code STRING, shop_name STRING, shop_url_code STRING, item_name STRING,
 item_subtitle STRING, image_url STRING, genre_ids STRING, variant_id STRING, has_multi_sku BOOLEAN, is_pr BOOLEAN,
 is_super_deal BOOLEAN, is_shop39 BOOLEAN, is_sold_out BOOLEAN, data_source STRING, list_url STRING, observed_at TIMESTAMP,
 observed_date DATE""",
    "detail_observations": """product_uid STRING, item_name STRING, shop_name STRING, shop_url_code STRING, price_min BIGINT,
 price_max BIGINT, review_count BIGINT, review_rating DECIMAL(4,2), is_39_shop BOOLEAN, is_super_deal BOOLEAN, inventory_type STRING,
 coupon_yen BIGINT, coupon_percent DECIMAL(5,1), variant_count INT, variant_data_json STRING, ancestor_genre_id STRING,
 r_category_id STRING, data_source STRING, detail_url STRING, observed_at TIMESTAMP, observed_date DATE""",
    "crawl_stats": """stat_date DATE, job_type STRING, total_jobs BIGINT, success_count BIGINT, fail_count BIGINT, skip_count BIGINT,
 avg_duration_ms BIGINT, items_found BIGINT, items_updated BIGINT""",
}

# Folder partitions: history by month, observations and events by day.
PARTITIONS = {
    "variant_daily_history": ["record_month"], "user_browse_events": ["browse_date"], "shop_rankings": ["ranking_date"],
    "list_observations": ["observed_date"], "detail_observations": ["observed_date"], "crawl_stats": ["stat_date"],
}
# Range order of the written files, for the readers' min/max statistics. It ends in
# a unique column, so that one value with many rows still spreads over files.
CLUSTERED = {"variant_snapshots": ["price", "variant_uid"], "variants": ["jan_code", "variant_uid"], "items": ["product_uid"]}
# Tables that batches merge into by key: the keys whose hash deals rows to buckets. A
# merge rewrites the buckets its batch falls in.
BUCKETED = {"shops": ["shop_code"], "items": ["product_uid"], "variants": ["variant_uid"], "variant_snapshots": ["variant_uid"]}
KEYS = {
    "shops": ["shop_code"], "items": ["product_uid"], "variants": ["variant_uid"], "variant_snapshots": ["variant_uid"],
    "variant_daily_history": ["variant_uid", "record_date"], "crawl_targets": ["target_type", "target_value"],
    "shop_rankings": ["ranking_date", "shop_code"], "crawl_stats": ["stat_date", "job_type"], "crawl_jobs": ["id"],
}
# Allowed words of the coded columns.
WORDS = {
    ("variant_snapshots", "source"): SOURCES, ("variant_daily_history", "source"): SOURCES, ("crawl_targets", "target_type"): TARGET_TYPES,
    ("crawl_targets", "added_by"): ADDED_BY, ("price_range_slices", "status"): SLICE_STATUSES, ("crawl_jobs", "job_type"): JOB_TYPES,
    ("crawl_jobs", "status"): JOB_STATUSES, ("list_observations", "coupon_type"): ("exact", "percentage"),
    ("list_observations", "data_source"): ("html", "json", "both"), ("detail_observations", "data_source"): ("json", "html"),
}


def schema(table: str) -> StructType:
    return StructType.fromDDL(TABLES[table])


# Partition columns that follow from another column.
DERIVED = {
    "observed_date": ("observed_at", lambda c: F.to_date(c)), "browse_date": ("browsed_at", lambda c: F.to_date(c)),
    "record_month": ("record_date", lambda c: F.date_format(c, "yyyy-MM")),
}


def conform(df: DataFrame, table: str) -> DataFrame:
    """Columns of the table in order and type; missing ones are NULL, but partition
    columns are derived, and it is an error if they can't be."""
    have = set(df.columns)
    for part in PARTITIONS.get(table, []):
        source, rule = DERIVED.get(part, (None, None))
        if part not in have:
            if source not in have:
                raise ValueError(f"{table} needs {part}" + (f" or {source}" if source else ""))
            df = df.withColumn(part, rule(F.col(source)))
            have.add(part)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(table).fields
    ])


def bad_words(df: DataFrame, table: str) -> DataFrame:
    """Rows with a word outside the allowed ones."""
    wrong = F.lit(False)
    for (name, column), words in WORDS.items():
        if name == table:
            wrong = wrong | (F.col(column).isNotNull() & ~F.col(column).isin(*words))
    return df.filter(wrong)
