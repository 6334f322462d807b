"""Fixed values that results depend on, and the marketplace's own addresses."""

from __future__ import annotations

from dataclasses import dataclass

# Query parameters that only track visits (compared in lower case).
TRACKING_PARAMS = (
    "rafcid", "scid", "s-id", "l-id", "ref", "iasid",
    "noel", "tag", "force-hierarchical", "pf", "wsc_i_is", "wsc_i_is_c",
)
VARIANT_PARAM = "variantId"
DEFAULT_VARIANT = "default"

# The measures of a snapshot, in the order of its table.
MEASURES = (
    "price", "point_rate", "point_back_percent", "coupon_yen", "coupon_percent",
    "shipping_text_raw", "shipping_days_min", "shipping_days_max", "image_url",
    "extra1_key", "extra1_value", "extra2_key", "extra2_value",
)
HISTORY_MEASURES = tuple(m for m in MEASURES if m != "shipping_text_raw")

# Allowed words of the coded columns.
SOURCES = ("api", "list", "detail", "extension")
JOB_TYPES = ("api_discovery", "list_scrape", "detail_scrape")
JOB_STATUSES = ("pending", "running", "done", "failed", "skipped")
SLICE_STATUSES = ("pending", "in_progress", "done", "needs_split")
TARGET_TYPES = ("genre", "shop", "keyword")
ADDED_BY = ("manual", "auto_ranking", "extension", "auto_discovery")

# Limits and periods.
DEFAULT_MULTIPLIER = 4.0
MULTIPLIER_RANGE = (1.0, 100.0)
HISTORY_DAYS_RANGE = (1, 730)
HISTORY_PRESETS = (1, 7, 30, 90, 365, 730)
HISTORY_RETENTION_DAYS = 730
EVENT_RETENTION_DAYS = 7
EXTENSION_ITEM_CAP = 5_000_000
EXTENSION_PRUNE_EXTRA = 1_000
EXTENSION_PRUNE_MOST = 50_000
EXTENSION_PRUNE_MONTHS = 2
STALE_JOB_MINUTES = 60
API_PAGE_SIZE, API_MAX_PAGE = 30, 100
API_SLICE_CAP = API_PAGE_SIZE * API_MAX_PAGE
LIST_PAGE_SIZE, LIST_MAX_PAGE = 45, 150
DEFAULT_MAX_PRICE = 10_000_000
RANKING_HOURS_RANGE = (1, 168)
RANKING_TARGET_PRIORITY = 100
DISCOVERY_TARGET_PRIORITY = 10

# Notes appended to repaired jobs.
STALE_NOTE = " | Reset from stale running state"
EXHAUSTED_NOTE = " | Max attempts exceeded"

# Signs of a blocked page, and marks of a good one.
BLOCK_SIGNS = (
    "Access Denied", "cf-browser-verification", "challenge-platform",
    "_sec_cpt", "Just a moment",
)
LIST_STATE_MARK = "__INITIAL_STATE__"
LIST_PAGE_MARKS = ("item-list",)
DETAIL_STATE_MARK = "item-page-app-data"
SHORT_PAGE_CHARS = 1000

# Names in the listing state document.
STATE_SEARCH_KEY = "ichibaSearch"

# Words of the shown and parsed texts.
FREE_SHIPPING = "送料無料"
SHIPPING_INCLUDED = "送料込み"
FREE_SHIPPING_SIGNS = ("送料無料", "送料込")

# Header rows of the two CSV exports.
CHART_CSV_HEADER = ("日付", "販売価格", "ポイント", "価格-ポイント", "クーポン", "価格-ポイント-クーポン")
TABLE_CSV_HEADER = ("取得日時", "価格", "ポイント(pt)", "価格-ポイント", "クーポン", "価格-ポイント-クーポン")

# Thresholds of the completeness audit.
FILL_PASS, FILL_WARN = 0.5, 0.1
MIN_ITEMS_PER_GENRE = 100
OBSERVATION_FIELDS_PASS = 5
JOB_PASS_PERCENT, JOB_WARN_PERCENT = 80.0, 50.0
SPARSE_LIST_COLUMNS = ("coupon_discount", "coupon_type", "delivery_text", "delivery_days", "shipping_cost")
SPARSE_DETAIL_COLUMNS = ("coupon_yen", "coupon_percent", "r_category_id")
SNAPSHOT_THRESHOLDS = (
    ("price", 0.9), ("point_rate", 0.3), ("coupon", 0.01), ("shipping_text_raw", 0.3),
    ("shipping_days_min", 0.01), ("image_url", 0.8), ("extra1_key", 0.1),
)
REQUIRED_FIELDS = (
    "product_uid", "shop_code", "item_code", "item_name", "canonical_url",
    "list_price", "point_count", "point_text_raw", "shipping_cost", "review_score",
    "review_count", "variant_exists", "image_url", "detail_price_min",
    "variant_data_json", "variant_count", "is_39_shop",
)
FIELD_GROUPS = (
    ("IDENTITY", ("product_uid", "shop_code", "item_code", "item_name", "canonical_url")),
    ("PRICING", ("api_price", "list_price", "detail_price_min")),
    ("POINTS", ("point_count", "point_base_multiplier", "point_text_raw")),
    ("COUPONS", ("list_coupon", "detail_coupon")),
    ("SHIPPING", ("shipping_cost", "is_free_shipping", "delivery_text")),
    ("REVIEWS", ("review_score", "review_count")),
    ("VARIANTS & JAN", ("variant_exists", "jan_code", "variant_data_json", "variant_count")),
    ("FLAGS", ("is_super_deal", "is_39_shop")),
    ("IMAGES", ("image_url",)),
    ("GENRE", ("genre_id",)),
)


@dataclass(frozen=True)
class Marketplace:
    """Addresses and page marks of the marketplace whose pages are read. They are
    data of the caller, so the defaults name no real site."""

    search_base: str = "https://search.example.com/search/mall/"
    shop_base: str = "https://www.example.com/"
    item_host: str = "item.example.com"
    title_tag: str = ""
    page_mark: str = "example"
