"""The stored star: joins without a shuffle, wide products in parts, odd rows."""

import pytest
from pyspark.sql import functions as F

from offerlens.operators import search as S
from offerlens.session import session_settings
from offerlens.sources.star import HOME, Star, co_located, count_stored

ROWS = 3000


@pytest.fixture(scope="module")
def tables(spark):
    """A third of all variants belongs to one product; one snapshot has no variant, one
    variant no snapshot, one item no variant."""
    n = F.col("id")
    product = F.when(n % 3 == 0, F.lit("s:0")).otherwise(F.concat(F.lit("s:"), (n % 400).cast("string")))
    variants = spark.range(ROWS).select(
        F.concat(product, F.lit(":"), n.cast("string")).alias("variant_uid"), product.alias("product_uid"),
        F.when(n % 5 != 0, (n % 50).cast("string")).alias("jan_code"), (n % 6 != 0).alias("is_active"))
    snapshots = variants.filter("variant_uid not like '%:1'").select("variant_uid").unionByName(
        spark.createDataFrame([("lost:1:1",)], "variant_uid string")).select(
        "variant_uid", (F.pmod(F.xxhash64("variant_uid"), F.lit(900))).alias("price"), F.lit(10).alias("coupon_yen"),
        F.lit(None).cast("double").alias("coupon_percent"))
    items = spark.range(401).select(F.concat(F.lit("s:"), F.col("id").cast("string")).alias("product_uid"),
                                    F.concat(F.lit("Name "), F.col("id").cast("string")).alias("item_name"), (F.col("id") % 7 != 3).alias("is_active"))
    return items, variants, snapshots


@pytest.fixture(scope="module")
def star(spark, tables, tmp_path_factory):
    made = Star(spark, "star_test").write(str(tmp_path_factory.mktemp("star")), *tables, buckets=8, widest=100)
    yield made
    made.drop()


SEARCHES = {
    "all": {}, "priced": {"price_max": 500}, "coupon": {"want_coupon": True}, "jan": {"want_jan": True},
    "many": {"want_variants": True}, "name": {"q": "name 1", "price_min": 3}, "closed": {"active_only": False, "want_variants": True},
}


def searches():
    return {k: S.Search(**v) for k, v in SEARCHES.items()}


def totals(df):
    return {r.kind: r.total for r in df.collect()}


def test_counts_equal_plain_ones(spark, tables, star):
    with co_located(spark):
        got = totals(count_stored(star, searches()))
    assert got == totals(S.count_searches(*tables, searches()))
    # Joins one by one, by the other way through the library.
    assert got == {k: s.count(*tables).first()["total"] for k, s in searches().items()}


def test_joins_move_no_rows(spark, star):
    with session_settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}), co_located(spark):
        plan = count_stored(star, searches())._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("SortMergeJoin"):]
    assert plan.count("SortMergeJoin") == 2 and "Exchange" not in below
    assert plan.count("Exchange") == 1 and "Exchange SinglePartition" in plan
    assert below.count("Bucketed: true") == 3
    with session_settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        plain = count_stored(star, searches())._jdf.queryExecution().executedPlan().toString()
    assert plain.count("Exchange hashpartitioning") >= 1  # without the setting rows are moved


def test_wide_product_is_dealt_over_parts(spark, tables, star):
    parts = {r.part: r["count"] for r in star.variants.filter("product_uid = 's:0'").groupBy("part").count().collect()}
    wide = tables[1].filter("product_uid = 's:0'").count()
    assert wide >= ROWS / 3 and len(parts) == -(-wide // 100) and sum(parts.values()) == wide and max(parts.values()) < 200
    copies = {r.product_uid: r["count"] for r in star.items.groupBy("product_uid").count().collect()}
    assert copies.pop("s:0") == len(parts) and set(copies.values()) == {1} and len(copies) == 400
    assert star.items.filter("product_uid = 's:400'").first()["siblings"] == 0
    assert star.variants.count() == ROWS
    lost = star.snapshots.filter("variant_uid = 'lost:1:1'").first()
    assert (lost.product_uid, lost.part) == ("lost:1:1", 0) and star.snapshots.count() == tables[2].count()


def test_plain_tables_are_those_written(tables, star):
    for given, stored in zip(tables, star.plain()):
        kept = stored.select(*given.columns)
        assert set(stored.columns) == set(given.columns)
        assert kept.exceptAll(given).isEmpty() and given.exceptAll(kept).isEmpty()


def test_one_file_per_bucket(spark, star):
    files = star.variants.select(F.input_file_name().alias("f")).distinct().count()
    assert files <= 8


def test_empty_star(spark, tables, tmp_path):
    empty = Star(spark, "star_empty").write(str(tmp_path), *[t.limit(0) for t in tables], buckets=4)
    with co_located(spark):
        assert set(totals(count_stored(empty, searches())).values()) == {0}
    assert set(HOME) <= set(empty.items.columns)
    empty.drop()
