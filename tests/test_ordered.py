"""The distributed ways for huge groups give the same rows as plain windows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from offerlens.operators import history as H
from offerlens.operators import jan as J
from offerlens.operators import product as D
from offerlens.operators import ranking as R
from offerlens.operators.ordered import first_page, latest_per_key, number_rows, page_rows, previous_row


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows has one key, and one value of it is frequent too."""
    rng = random.Random(5)
    rows = []
    for i in range(6000):
        key = "hot" if i % 3 == 0 else None if i % 97 == 0 else f"k{rng.randrange(300)}"
        rows.append((key, 7 if rng.random() < 0.4 else rng.randrange(50), i, rng.choice([None, 1, 2])))
    return spark.createDataFrame(rows, "k string, v int, id int, m int").repartition(5).cache()


ORDER = lambda: [F.col("v"), F.col("id")]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("parts", [2, 7, 40])
def test_positions(skewed, parts):
    plain = skewed.withColumn("position", F.row_number().over(Window.partitionBy("k").orderBy(*ORDER())).cast("bigint"))
    assert rows(number_rows(skewed, ["k"], ORDER(), parts=parts)) == rows(plain)


def test_global_positions(skewed):
    plain = skewed.withColumn("position", F.row_number().over(Window.orderBy(*ORDER())).cast("bigint"))
    assert rows(number_rows(skewed, [], ORDER(), parts=9)) == rows(plain)


@pytest.mark.parametrize("parts", [2, 7, 40])
def test_previous(skewed, parts):
    plain = skewed.withColumn("previous", F.lag(F.struct("m")).over(Window.partitionBy("k").orderBy(*ORDER())))
    assert rows(previous_row(skewed, ["k"], ORDER(), ["m"], parts=parts)) == rows(plain)


def test_latest(skewed):
    plain = skewed.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy(F.col("v").desc(), F.col("id").desc()))).filter("n = 1").drop("n")
    assert rows(latest_per_key(skewed, ["k"], ["v", "id"])) == rows(plain)


def test_pages_near_and_far_are_the_same(skewed):
    order = ORDER()
    everything = skewed.orderBy(*order).collect()
    assert first_page(skewed, order, 50).collect() == everything[:50]
    for page in (1, 7, 120):
        assert page_rows(skewed, order, page, 50).collect() == everything[50 * (page - 1) : 50 * page]
    assert page_rows(skewed, order, 500, 50).collect() == []
    with pytest.raises(ValueError):
        page_rows(skewed, order, 0, 50)


def test_changed_rows_of_a_hot_variant(skewed):
    given = skewed.select(F.coalesce("k", F.lit("none")).alias("variant_uid"), "v", "id", F.col("m").alias("content_hash"))
    plain = rows(H.changed_only(given, ["v", "id"]))
    # One by one: a row counts if it differs from the last one that counted.
    want, last = [], {}
    for r in sorted(given.collect(), key=lambda r: (r.v, r.id)):
        if r.variant_uid not in last or last[r.variant_uid] != r.content_hash:
            want.append(tuple(r))
        last[r.variant_uid] = r.content_hash
    assert plain == sorted(want, key=repr)


def test_jan_ranks_and_cheapest_agree(skewed):
    offers = skewed.select(F.coalesce("k", F.lit("none")).alias("jan_code"), F.col("v").cast("bigint").alias("effective_price"),
                           F.col("id").cast("string").alias("variant_uid"), F.lit("s").alias("shop_code"), F.col("v").alias("price"))
    ranked = J.ranked_by_jan(offers)
    first = ranked.filter("position = 1").select("jan_code", "variant_uid")
    assert rows(first) == rows(J.cheapest_per_jan(offers).select("jan_code", "variant_uid"))


def test_all_shops_are_ranked(skewed):
    counts = skewed.groupBy(F.coalesce("k", F.lit("none")).alias("shop_code")).agg(F.count("*").alias("browse_count"))
    day = F.lit("2024-01-01").cast("date")
    plain = counts.withColumn("n", F.row_number().over(Window.orderBy(F.col("browse_count").desc(), "shop_code")))
    got = R.rank_all(counts, day).select("shop_code", "browse_count", F.col("rank_position").cast("int"))
    assert rows(got) == rows(plain)


def test_one_key_in_a_tiny_file_is_spread(spark, tmp_path):
    """Few bytes may hold very many rows of one key; they meet in no single task."""
    path = str(tmp_path / "one_key")
    spark.range(200_000).select(F.lit("k").alias("k"), F.col("id")).coalesce(1).write.parquet(path)
    got = number_rows(spark.read.parquet(path), ["k"], [F.col("id")], parts=8)
    assert got.agg(F.max("position"), F.sum(F.col("position") - F.col("id"))).first()[:] == (200_000, 200_000)
    assert got.groupBy("k", F.floor((F.col("position") - 1) / 60_000).alias("p")).count().count() == 4


def test_products_with_many_variants_come_in_parts(spark):
    made = spark.range(2500).select(
        F.when(F.col("id") < 2300, F.lit("s:big")).otherwise(F.concat(F.lit("s:"), F.col("id").cast("string"))).alias("product_uid"),
        F.lpad(F.col("id").cast("string"), 5, "0").alias("variant_code"), F.col("id").cast("string").alias("variant_uid"),
        F.lit("j").alias("jan_code"), F.lit("n").alias("variant_name"), F.struct(F.col("id").alias("price")).alias("snapshot"))
    nested = D.nested_products(made, per_row=500).collect()
    big = sorted((r.part, [v.variant_code for v in r.variants]) for r in nested if r.product_uid == "s:big")
    assert [len(v) for _, v in big] == [500, 500, 500, 500, 300]
    assert sum((v for _, v in big), []) == [f"{i:05d}" for i in range(2300)]
    assert len(nested) == 205


def test_latest_sends_each_row_once(spark):
    """The fold's buffer holds the row, not the row and its order beside it."""
    df = spark.createDataFrame([(1, 2, "a"), (1, 3, "b"), (2, None, "c"), (2, None, "d")], "k int, v int, t string")
    folded = latest_per_key(df, ["k"], ["v"])
    assert rows(folded) == [(1, 3, "b"), (2, None, "d")]
    assert "max_by" not in folded._jdf.queryExecution().optimizedPlan().toString()
    mapped = df.withColumn("m", F.create_map("t", "v"))
    assert sorted(r["k"] for r in latest_per_key(mapped, ["k"], ["v"]).collect()) == [1, 2]


def test_kept_rows_are_pressed_and_shuffles_go(spark, tmp_path):
    """Rows cut off durably are a table by column; what a table cannot hold still works."""
    import os

    from offerlens.session import checkpoint_folder, durable

    before = set(os.listdir(checkpoint_folder(spark).removeprefix("file:")))
    df = spark.range(1000).select(F.col("id"), F.lit("the same long text over and over").alias("t")).repartition(4, "id")
    kept = durable(df)
    new = set(os.listdir(checkpoint_folder(spark).removeprefix("file:"))) - before
    assert [n for n in new if n.startswith("kept-")]
    assert kept.dtypes == df.dtypes and kept.count() == 1000
    odd = durable(df.select("id", F.lit(None).alias("nothing")))
    assert odd.dtypes[1][1] == "void" and odd.count() == 1000
