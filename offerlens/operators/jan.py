"""Offers of one barcode (JAN), cheapest first after points and coupons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.functions.price import offer_value
from offerlens.operators.join import join_shops
from offerlens.operators.ordered import number_rows
from offerlens.operators.search import RESULT_COLUMNS


def jan_offers(
    items: DataFrame, variants: DataFrame, snapshots: DataFrame, jan: str | None = None,
    multiplier: float = 4.0, mode: str = "chart", home: tuple[str, ...] = (),
) -> DataFrame:
    """Active variants that carry a JAN, with their net price. ``home`` names columns that
    all three tables are stored by: the product and what else places a row."""
    own = variants.filter(F.col("is_active"))
    own = own.filter(F.col("jan_code") == jan) if jan else own.filter(F.col("jan_code").isNotNull() & (F.col("jan_code") != ""))
    place = [c for c in home if c != "product_uid"]
    live = items.filter(F.col("is_active")).select("product_uid", *place, "shop_code", "item_code", "item_name", "canonical_url")
    rows = (
        own.select("variant_uid", "product_uid", *place, "variant_code", "jan_code", "variant_name")
        .join(live, ["product_uid", *place])
        .join(snapshots, ["variant_uid", *home], "left")
    )
    value = offer_value(multiplier=multiplier, mode=mode)
    return rows.withColumn("_value", value).select(
        "*",
        F.col("_value.total_points").alias("total_points"),
        F.col("_value.effective_coupon").alias("effective_coupon"),
        F.col("_value.effective_price").alias("effective_price"),
    ).drop("_value")


def ranked_by_jan(offers: DataFrame, by: str = "effective_price") -> DataFrame:
    """Position of every offer within its JAN, 1 = cheapest. One JAN may hold a
    large share of all offers; see ``ordered``."""
    return number_rows(offers, ["jan_code"], [F.col(by), F.col("variant_uid")], "position")


def cheapest_per_jan(offers: DataFrame, by: str = "effective_price") -> DataFrame:
    """The cheapest offer of every JAN and the number of offers: one partial
    aggregate, no sort of any group."""
    shown = F.struct("variant_uid", "shop_code", "price", by)
    best = offers.groupBy("jan_code").agg(
        F.min_by(shown, F.struct(by, "variant_uid")).alias("_best"), F.count("*").alias("offers")
    )
    return best.select("jan_code", "_best.*", "offers")


def cheapest_by_jan(items, variants, snapshots, shops, jan: str, multiplier: float = 4.0, order_by: str = "effective_price") -> DataFrame:
    """All offers of one JAN with shop names, sorted by net price (or 'price')."""
    offers = join_shops(jan_offers(items, variants, snapshots, jan, multiplier), shops)
    extra = ["total_points", "effective_coupon", "effective_price"]
    return offers.select(*[c for c in RESULT_COLUMNS if c in offers.columns], *extra).orderBy(
        F.col(order_by).asc_nulls_first(), "variant_uid"
    )
