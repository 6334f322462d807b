"""Completeness audit of the merged catalogue, each table in one pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.fixed import (
    FIELD_GROUPS, FILL_PASS, FILL_WARN, MIN_ITEMS_PER_GENRE, OBSERVATION_FIELDS_PASS, REQUIRED_FIELDS,
    SLICE_STATUSES, SNAPSHOT_THRESHOLDS,
)
from offerlens.operators.ordered import latest_per_key


def verdict(rate: Column, high: Column | float, low: Column | float) -> Column:
    return F.when(rate >= high, F.lit("PASS")).when(rate >= low, F.lit("WARN")).otherwise(F.lit("FAIL"))


def _long(counts: DataFrame, names: Sequence[str]) -> DataFrame:
    """One-row wide counts → one row per name."""
    pairs = F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).alias("filled")) for n in names])
    return counts.select("total", F.explode(pairs).alias("p")).select("p.field", "p.filled", "total")


def filled_counts(df: DataFrame, tests: Mapping[str, Column]) -> DataFrame:
    """field, filled, total for any number of tests in one scan."""
    counts = df.agg(F.count("*").alias("total"), *[F.count_if(t).alias(n) for n, t in tests.items()])
    return _long(counts, list(tests))


def fill_rates(
    df: DataFrame, columns: Sequence[str], flags: Sequence[str] = (), positive: Sequence[str] = (), sparse: Sequence[str] = (),
) -> DataFrame:
    """Fill rate and verdict per column. Flags count their true values and always
    pass; ``positive`` columns count values above zero; sparse ones never fail."""
    tests = {}
    for c in columns:
        tests[c] = F.col(c) if c in flags else F.col(c) > 0 if c in positive else F.col(c).isNotNull()
    rows = filled_counts(df, tests)
    rate = F.when(F.col("total") > 0, F.col("filled") / F.col("total")).otherwise(F.lit(0.0))
    passed = F.col("field").isin(*flags) if flags else F.lit(False)
    spared = (F.col("field").isin(*sparse) if sparse else F.lit(False)) & (rate < FILL_WARN)
    return rows.select(
        "field", "filled", "total", rate.alias("rate"),
        F.when(passed | spared, F.lit("PASS")).otherwise(verdict(rate, FILL_PASS, FILL_WARN)).alias("status"),
    )


def snapshot_fill(snapshots: DataFrame, thresholds=SNAPSHOT_THRESHOLDS) -> DataFrame:
    """Snapshot measures against a threshold each; anything above zero warns."""
    tests = {}
    for name, _ in thresholds:
        tests[name] = (
            F.col("coupon_yen").isNotNull() | F.col("coupon_percent").isNotNull() if name == "coupon" else F.col(name).isNotNull()
        )
    rows = filled_counts(snapshots, tests)
    limit = reduce(lambda e, t: e.when(F.col("field") == t[0], F.lit(t[1])), thresholds[1:],
                   F.when(F.col("field") == thresholds[0][0], F.lit(thresholds[0][1])))
    rate = F.when(F.col("total") > 0, F.col("filled") / F.col("total")).otherwise(F.lit(0.0))
    status = F.when(rate >= limit, F.lit("PASS")).when(rate > 0, F.lit("WARN")).otherwise(F.lit("FAIL"))
    return rows.select("field", "filled", "total", rate.alias("rate"), limit.alias("threshold"), status.alias("status"))


def source_counts(df: DataFrame, column: str = "source") -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("rows"))


def api_coverage(snapshots: DataFrame) -> DataFrame:
    """Price, image and points of the snapshots that came from the API."""
    tests = {c: F.col(c).isNotNull() for c in ("price", "image_url", "point_rate")}
    rows = filled_counts(snapshots.filter(F.col("source") == "api"), tests)
    need = F.when(F.col("field") == "price", F.lit(0.9)).when(F.col("field") == "image_url", F.lit(0.8)).otherwise(F.lit(0.5))
    rate = F.when(F.col("total") > 0, F.col("filled") / F.col("total")).otherwise(F.lit(0.0))
    status = F.when(F.col("total") == 0, F.lit("FAIL")).when(rate > need, F.lit("PASS")).otherwise(F.lit("WARN"))
    return rows.select("field", "filled", "total", rate.alias("rate"), status.alias("status"))


def genre_coverage(items: DataFrame, least: int = MIN_ITEMS_PER_GENRE) -> DataFrame:
    counts = items.filter(F.col("seen_in_api")).groupBy("genre_id").agg(F.count("*").alias("items"))
    return counts.withColumn("status", F.when(F.col("items") >= least, F.lit("PASS")).otherwise(F.lit("WARN")))


def stage_counts(items: DataFrame) -> DataFrame:
    """Items by the combination of stages that saw them."""
    return items.groupBy("seen_in_api", "seen_in_list", "seen_in_detail").agg(F.count("*").alias("items"))


def items_in_both(items: DataFrame, list_obs: DataFrame, detail_obs: DataFrame, key: str = "product_uid") -> DataFrame:
    """Number of items with both kinds of observation."""
    rows = items.select(key).join(list_obs.select(key), key, "left_semi").join(detail_obs.select(key), key, "left_semi")
    return rows.agg(F.count("*").alias("items"))


def history_span(history: DataFrame) -> DataFrame:
    """Dates, first, last and rows. The dates are folded to one row each first, so
    no task counts distinct values over all rows."""
    days = history.groupBy("record_date").agg(F.count("*").alias("n"))
    return days.agg(
        F.count("*").alias("dates"), F.min("record_date").alias("first_date"), F.max("record_date").alias("last_date"),
        F.sum("n").alias("total_records"),
    )


def slice_status(slices: DataFrame, targets: DataFrame) -> DataFrame:
    """Slices per genre and status."""
    joined = slices.join(targets.select(F.col("id").alias("crawl_target_id"), F.col("target_value").alias("genre_id")), "crawl_target_id")
    return joined.groupBy("genre_id").agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in SLICE_STATUSES], F.count("*").alias("total")
    ).withColumn("verdict", F.when(F.col("done") > 0, F.lit("PASS")).otherwise(F.lit("WARN")))


def item_counts(list_obs: DataFrame, detail_obs: DataFrame, variants: DataFrame, key: str = "product_uid") -> DataFrame:
    """Distinct items that meet each client need. Every table folds to one row of
    flags per item, then the flags are counted."""
    def folded(df, tests):
        per_item = df.groupBy(key).agg(*[F.bool_or(F.coalesce(t, F.lit(False))).alias(n) for n, t in tests.items()])
        counts = per_item.agg(F.count("*").alias("total"), *[F.count_if(F.col(n)).alias(n) for n in tests])
        return _long(counts, list(tests)).select(F.col("field").alias("need"), F.col("filled").alias("items"))

    c = F.col
    listed = folded(list_obs, {
        "points": c("point_count").isNotNull() & c("point_base_multiplier").isNotNull(),
        "coupon": c("coupon_discount").isNotNull(),
        "shipping": c("shipping_cost").isNotNull() | c("is_free_shipping"),
        "reviews": c("review_score").isNotNull() & c("review_count").isNotNull(),
    })
    detailed = folded(detail_obs, {"variant_detail": c("variant_data_json").isNotNull() & (c("variant_count") > 0)})
    coded = folded(variants, {"jan": c("jan_code").isNotNull() & (c("jan_code") != "")})
    return listed.unionByName(detailed).unionByName(coded)


def complete_products(items: DataFrame, variants: DataFrame, snapshots: DataFrame, list_obs: DataFrame) -> DataFrame:
    """Number of items with a name, a price and image on their first variant, and
    a price on some listing."""
    first = variants.groupBy("product_uid").agg(F.min("variant_uid").alias("variant_uid"))
    good = snapshots.filter(F.col("price").isNotNull() & F.col("image_url").isNotNull()).select("variant_uid")
    priced = list_obs.filter(F.col("observed_price").isNotNull()).select("product_uid")
    rows = (
        items.filter(F.col("item_name").isNotNull()).select("product_uid")
        .join(first.join(good, "variant_uid", "left_semi"), "product_uid", "left_semi")
        .join(priced, "product_uid", "left_semi")
    )
    return rows.agg(F.count("*").alias("items"))


def first_variant(variants: DataFrame) -> DataFrame:
    """One variant per item, the first by key."""
    return variants.groupBy("product_uid").agg(F.min("variant_uid").alias("variant_uid"))


def filled_fields(observations: DataFrame, columns: Sequence[str], least: int = OBSERVATION_FIELDS_PASS) -> DataFrame:
    """Number of non-null fields of each row, and whether it is enough."""
    count = reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in columns])
    return observations.withColumn("fields_filled", count).withColumn(
        "status", F.when(F.col("fields_filled") >= least, F.lit("PASS")).otherwise(F.lit("WARN"))
    )


def _truthy(name: str) -> Column:
    return F.coalesce(F.col(name) != "", F.lit(False))


def field_checks(
    items: DataFrame, variants: DataFrame, snapshots: DataFrame, list_obs: DataFrame, detail_obs: DataFrame,
) -> DataFrame:
    """One row per item with a boolean per required or optional field, from the
    item's latest snapshot, listing and detail observation."""
    here = lambda name: F.col(name).isNotNull()
    tests = {
        "s": {"price": here("price"), "image_url": _truthy("image_url")},
        "l": {**{n: here(n) for n in ("observed_price", "point_count", "point_base_multiplier", "coupon_discount", "shipping_cost", "review_score", "review_count")},
              **{n: _truthy(n) for n in ("point_text_raw", "delivery_text", "image_url")}},
        "d": {"price_min": here("price_min"), "coupon": here("coupon_yen") | here("coupon_percent"), "variant_count": here("variant_count"),
              "variant_data": _truthy("variant_data_json") | F.coalesce(F.col("variant_count") == 0, F.lit(False))},
    }

    def last(rows, part, order):
        """Only what is asked of a row goes into the fold, not its texts."""
        flags = rows.select("product_uid", *order, *[t.alias(f"{part}_{n}") for n, t in tests[part].items()])
        return latest_per_key(flags, ["product_uid"], order).drop(*order).withColumn(f"{part}_here", F.lit(True))

    priced = snapshots.select("variant_uid", "fetched_at", "price", "image_url").join(variants.select("variant_uid", "product_uid"), "variant_uid")
    snap = last(priced, "s", ["fetched_at", "variant_uid"])
    seen = last(list_obs, "l", ["observed_at", "seq"])
    detail = last(detail_obs, "d", ["observed_at", "seq"])
    own = variants.groupBy("product_uid").agg(F.bool_or(_truthy("jan_code")).alias("v_jan"), F.lit(True).alias("has_variant"))
    rows = items.select("product_uid", "shop_code", "item_code", "item_name", "canonical_url", "genre_id")
    for part in (snap, seen, detail, own):
        rows = rows.join(part, "product_uid", "left")
    yes = lambda name: F.coalesce(F.col(name), F.lit(False))
    tests = {
        "product_uid": _truthy("product_uid"), "shop_code": _truthy("shop_code"), "item_code": _truthy("item_code"),
        "item_name": _truthy("item_name"), "canonical_url": _truthy("canonical_url"),
        "api_price": yes("s_price"), "list_price": yes("l_observed_price"), "detail_price_min": yes("d_price_min"),
        "point_count": yes("l_point_count"), "point_base_multiplier": yes("l_point_base_multiplier"),
        "point_text_raw": yes("l_point_text_raw"),
        "list_coupon": yes("l_coupon_discount"), "detail_coupon": yes("d_coupon"),
        "shipping_cost": yes("l_shipping_cost"), "is_free_shipping": yes("l_here"), "delivery_text": yes("l_delivery_text"),
        "review_score": yes("l_review_score"), "review_count": yes("l_review_count"),
        "variant_exists": yes("has_variant"), "jan_code": yes("v_jan"),
        "variant_data_json": yes("d_variant_data"), "variant_count": yes("d_variant_count"),
        "is_super_deal": yes("l_here"), "is_39_shop": yes("d_here"),
        "image_url": yes("s_image_url") | yes("l_image_url"), "genre_id": _truthy("genre_id"),
    }
    return rows.select(F.col("product_uid").alias("uid"), *[t.alias(n) for n, t in tests.items()])


def required_audit(checks: DataFrame) -> DataFrame:
    """Missing required fields of each item, and whether it is complete."""
    named = F.array(*[F.struct(F.lit(n).alias("n"), F.col(n).alias("ok")) for n in REQUIRED_FIELDS])
    missing = F.transform(F.filter(named, lambda f: ~f["ok"]), lambda f: f["n"])
    return checks.select("uid", missing.alias("missing"), (F.size(missing) == 0).alias("complete"))


def field_totals(checks: DataFrame) -> DataFrame:
    """Items with each field, and the field's group."""
    names = [n for _, group in FIELD_GROUPS for n in group]
    rows = filled_counts(checks, {n: F.col(n) for n in names})
    group = None
    for label, fields in FIELD_GROUPS:
        hit = F.col("field").isin(*fields)
        group = F.when(hit, F.lit(label)) if group is None else group.when(hit, F.lit(label))
    return rows.select(group.alias("field_group"), "field", "filled", "total")


def group_totals(checks: DataFrame) -> DataFrame:
    return field_totals(checks).groupBy("field_group").agg(
        F.sum("filled").alias("filled"), F.sum("total").alias("total")
    )


def overall_score(checks: DataFrame) -> DataFrame:
    sums = field_totals(checks).agg(F.sum("filled").alias("filled"), F.sum("total").alias("total"))
    return sums.withColumn("score", F.col("filled") * 100.0 / F.col("total"))


def report(checks: DataFrame) -> DataFrame:
    """Summary of any frame with a PASS/WARN/FAIL status."""
    sums = checks.agg(
        F.count_if(F.col("status") == "PASS").alias("passed"),
        F.count_if(F.col("status") == "WARN").alias("warnings"),
        F.count_if(F.col("status") == "FAIL").alias("failed"),
    )
    total = F.col("passed") + F.col("warnings") + F.col("failed")
    return sums.withColumn("score", F.when(total > 0, F.col("passed") * 100.0 / total)).withColumn("ok", F.col("failed") == 0)


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row count of each table, as one frame."""
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("table_name"), "rows") for n, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def tiered_sample(items: DataFrame, n: int, tiers: Sequence[Column]) -> DataFrame:
    """n items, filled from the first tier, then the next, newest first in each."""
    tier = None
    for i, cond in enumerate(tiers):
        tier = F.when(cond, F.lit(i)) if tier is None else tier.when(cond, F.lit(i))
    ranked = items.withColumn("tier", tier).filter(F.col("tier").isNotNull())
    return ranked.orderBy("tier", F.col("updated_at").desc(), "product_uid").limit(n)


def missing_detail_tiers() -> list[Column]:
    """API and listing seen, listing seen, anything; never with a detail page."""
    bare = ~F.col("seen_in_detail")
    return [F.col("seen_in_api") & F.col("seen_in_list") & bare, F.col("seen_in_list") & bare, bare]


def best_covered_tier(items: DataFrame, n: int) -> DataFrame:
    """n newest items of the best stage coverage there is: all three stages, else
    two, else any. Unlike a tiered sample, one tier only."""
    stages = sum((F.col(c).cast("int") for c in ("seen_in_list", "seen_in_detail")), F.col("seen_in_api").cast("int"))
    level = F.when(stages == 3, F.lit(0)).when(stages >= 2, F.lit(1)).otherwise(F.lit(2))
    ranked = items.withColumn("tier", level)
    best = ranked.agg(F.min("tier").alias("_best"))
    return (
        ranked.join(F.broadcast(best), F.col("tier") == F.col("_best")).drop("_best")
        .orderBy(F.col("updated_at").desc(), "product_uid").limit(n)
    )


_SUMMARY = "array<struct<variantId:string,jan:string,price:bigint,name:string,soldOut:boolean,stock:bigint,deliveryMsg:string>>"


def variant_json_coverage(detail_obs: DataFrame, column: str = "variant_data_json") -> DataFrame:
    """Variants, and those with JAN, price and stock, in each row's JSON array."""
    parsed = F.from_json(F.col(column), _SUMMARY)
    count = lambda cond: F.size(F.filter(parsed, cond)).cast("bigint")
    return detail_obs.select(
        "*",
        F.when(parsed.isNotNull(), F.size(parsed).cast("bigint")).alias("variants"),
        F.when(parsed.isNotNull(), count(lambda v: F.coalesce(v["jan"] != "", F.lit(False)))).alias("with_jan"),
        F.when(parsed.isNotNull(), count(lambda v: F.coalesce(v["price"] != 0, F.lit(False)))).alias("with_price"),
        F.when(parsed.isNotNull(), count(lambda v: v["stock"].isNotNull())).alias("with_stock"),
    )
