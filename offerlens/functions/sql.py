"""The expressions as temporary SQL functions, which Spark inlines into queries."""

from __future__ import annotations

from pyspark.sql import SparkSession

from offerlens.fixed import MULTIPLIER_RANGE

# A multiplier outside its range counts as the nearest one in it, as in ``price``.
_HELD = f"least(greatest(multiplier, {float(MULTIPLIER_RANGE[0])}D), {float(MULTIPLIER_RANGE[1])}D)"
_POINTS = f"floor(coalesce(price, 0D) * ({_HELD} + coalesce(point_rate, 0D)) / 100)"
_COUPON = "greatest(coalesce(coupon_yen, 0L), floor(coalesce(price, 0D) * coalesce(coupon_percent, 0D) / 100))"
_BACK = "floor(coalesce(price, 0D) * coalesce(point_back_percent, 0D) / 100)"
_FLAG = "CASE WHEN coalesce(point_back_percent, 0D) = 0 THEN 1 ELSE CAST(point_back_percent AS INT) END"
_NET_ARGS = "price DOUBLE, point_rate DOUBLE, point_back_percent DOUBLE, coupon_yen BIGINT, coupon_percent DOUBLE, multiplier DOUBLE"
_WHOLE = "CAST(coalesce(price, 0D) AS BIGINT)"

# name → (arguments, type, body)
FUNCTIONS = {
    "ol_coupon_value": ("price DOUBLE, coupon_yen BIGINT, coupon_percent DOUBLE", "BIGINT", _COUPON),
    "ol_points": ("price DOUBLE, point_rate DOUBLE, multiplier DOUBLE", "BIGINT", _POINTS),
    "ol_net_server": (_NET_ARGS, "BIGINT", f"{_WHOLE} - {_POINTS} * {_FLAG} - {_COUPON}"),
    "ol_net_client": (_NET_ARGS, "BIGINT", f"{_WHOLE} - {_POINTS} - {_BACK} - {_COUPON}"),
    "ol_net_chart": (_NET_ARGS, "BIGINT", f"{_WHOLE} - {_POINTS} - {_COUPON}"),
    "ol_clamp_multiplier": ("multiplier DOUBLE", "DOUBLE", _HELD),
    "ol_product_uid": ("shop_code STRING, item_code STRING", "STRING", "concat(shop_code, ':', item_code)"),
    "ol_variant_uid": ("shop_code STRING, item_code STRING, variant_code STRING", "STRING",
                       "concat(shop_code, ':', item_code, ':', coalesce(nullif(variant_code, ''), 'default'))"),
    "ol_valid_jan": ("code STRING", "STRING", r"CASE WHEN code RLIKE '^[0-9]{12,13}$' THEN code END"),
    "ol_price_from_text": ("shown STRING", "BIGINT",
                           "try_cast(nullif(regexp_replace(translate(shown, '０１２３４５６７８９', '0123456789'), '[^0-9]', ''), '') AS BIGINT)"),
    "ol_free_shipping": ("shown STRING", "BOOLEAN", "coalesce(contains(shown, '送料無料') OR contains(shown, '送料込'), false)"),
    "ol_record_date": ("at TIMESTAMP_NTZ, zone STRING", "DATE", "to_date(convert_timezone('UTC', zone, at))"),
    "ol_yen": ("amount BIGINT", "STRING", "coalesce(concat('¥', format_number(amount, 0)), '---')"),
    "ol_shown_points": ("amount BIGINT", "STRING", "coalesce(concat(format_number(amount, 0), 'pt'), '---')"),
    "ol_page_count": ("total BIGINT, per_page INT", "BIGINT", "ceil(total / per_page)"),
    "ol_single_price": ("price_max BIGINT, price_min BIGINT", "BIGINT", "coalesce(nullif(price_max, 0), nullif(price_min, 0))"),
}


def register(spark: SparkSession) -> list[str]:
    for name, (args, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    return list(FUNCTIONS)
