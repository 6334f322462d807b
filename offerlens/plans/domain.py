"""Catalogue views over the star tables, so that every operator runs on data of
any scale. Each function reads whole tables; nothing is sampled."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.functions.url import product_uid, variant_uid
from offerlens.operators.ordered import latest_per_key
from offerlens.session import checkpoint_folder, spread

ITEM_URL = "https://item.example.com/"


class Domain:
    """Lazy views of one folder of tables. ``observations`` is one row per
    collected offer; the other tables derive from it as the merges would."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def stream(self, name: str) -> DataFrame:
        """A table replayed as a stream of its files."""
        path = f"{self.folder}/{name}.parquet"
        return self.spark.readStream.schema(self.spark.read.parquet(path).schema).parquet(f"{path[:-8]}*.parquet")

    def scratch(self, name: str) -> str:
        """A new folder for a query that stores tables or states, in the shared one."""
        return f"{checkpoint_folder(self.spark)}/{name}-{os.urandom(8).hex()}"

    def lines(self) -> DataFrame:
        """Line items for work that costs CPU per row."""
        return spread(self.table("lineitem"))

    # observations ----------------------------------------------------------
    # Order that is total up to rows equal in every column used.
    ORDER = ("fetched_at", "seq", "l_linenumber", "quantity", "price", "coupon_percent", "point_rate", "l_suppkey",
             "l_returnflag", "l_linestatus")

    def raw(self, grain: str = "catalogue") -> DataFrame:
        """The numbers of each observation. Folds run on these few columns; texts
        are derived from what is left."""
        return self.lines().select(
            "l_suppkey", "l_partkey", "l_linenumber", "l_returnflag", "l_linestatus",
            F.col("l_shipdate").alias("fetched_at"), F.col("l_orderkey").alias("seq"), F.col("l_quantity").cast("bigint").alias("quantity"),
            F.floor(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
            F.round(F.col("l_tax") * 100).alias("point_rate"), F.round(F.col("l_discount") * 100).alias("coupon_percent"),
        )

    @staticmethod
    def dress(raw: DataFrame, grain: str) -> DataFrame:
        """Raw observations with keys, texts and the other measures. The grain is
        the variant, or the part alone (few variants, long histories)."""
        shop, item = F.col("l_suppkey").cast("string"), F.col("l_partkey").cast("string")
        line, flag = F.col("l_linenumber"), F.col("l_returnflag")
        code, none = line.cast("string"), F.lit(None).cast("string")
        return raw.withColumns({
            "variant_uid": variant_uid(shop, item, code) if grain == "catalogue" else item,
            "product_uid": product_uid(shop, item), "shop_code": shop, "item_code": item, "variant_code": code,
            "jan_code": F.lpad(item, 13, "0"),
            "point_back_percent": F.when((F.col("l_linestatus") == "F") & (line == 7), F.lit(10.0)),
            "coupon_yen": F.when(flag == "R", F.col("quantity") * 10),
            "shipping_text_raw": F.when(line % 3 == 0, F.lit("送料無料")).when(line % 3 == 1, F.lit("送料 550円")),
            "shipping_days_min": F.when(F.col("l_linestatus") == "O", F.lit(1)), "shipping_days_max": line,
            "image_url": F.concat(F.lit("https://img.example.com/"), item, F.lit(".jpg")),
            "extra1_key": none, "extra1_value": none, "extra2_key": none, "extra2_value": none,
            "source": F.when(flag == "A", F.lit("api")).when(flag == "N", F.lit("list")).otherwise(F.lit("detail")),
        })

    _KEYS = {"catalogue": ("l_suppkey", "l_partkey", "l_linenumber"), "part": ("l_partkey",)}
    _RAW = ("l_suppkey", "l_partkey", "l_linenumber", "l_returnflag", "l_linestatus", "seq", "quantity")

    def observations(self, grain: str = "catalogue") -> DataFrame:
        return self.dress(self.raw(grain), grain)

    def snapshots(self, grain: str = "catalogue") -> DataFrame:
        """The last observation of each variant."""
        keys = self._KEYS[grain]
        last = latest_per_key(self.raw(grain), keys, [c for c in self.ORDER if c not in keys])
        rows = self.dress(last, grain).drop(*self._RAW)
        return rows.drop("product_uid", "shop_code", "item_code", "variant_code", "jan_code") if grain == "catalogue" else rows

    def history(self) -> DataFrame:
        """Last observation of each day per part."""
        dated = self.raw("part").withColumn("record_date", F.to_date("fetched_at"))
        last = latest_per_key(dated, ["l_partkey", "record_date"], self.ORDER)
        return self.dress(last, "part").drop(*self._RAW)

    def as_of(self) -> Column:
        """Latest observation time, as a scalar subquery: results do not depend on
        the clock."""
        return self.table("lineitem").agg(F.max("l_shipdate")).scalar()

    def events_as_of(self) -> Column:
        return self.table("events").agg(F.max("ts")).scalar()

    # catalogue -------------------------------------------------------------
    def shops(self) -> DataFrame:
        s = self.table("supplier")
        code = F.col("s_suppkey").cast("string")
        return s.select(
            code.alias("shop_code"), F.col("s_name").alias("shop_name"),
            F.concat(F.lit("https://www.example.com/"), code, F.lit("/")).alias("shop_url"),
        )

    def items(self) -> DataFrame:
        """Folded on the numeric keys: one partial aggregate over four columns."""
        flag = F.col("l_returnflag")
        seen = self.table("lineitem").groupBy("l_suppkey", "l_partkey").agg(
            F.max(flag == "A").alias("seen_in_api"), F.max(flag == "N").alias("seen_in_list"),
            F.max(flag == "R").alias("seen_in_detail"), F.max("l_shipdate").alias("updated_at"),
        )
        parts = self.table("part").select("p_partkey", "p_name", "p_type")
        shop, item = F.col("l_suppkey").cast("string"), F.col("l_partkey").cast("string")
        return seen.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
            product_uid(shop, item).alias("product_uid"), shop.alias("shop_code"), item.alias("item_code"),
            F.col("p_name").alias("item_name"),
            F.concat(F.lit(ITEM_URL), shop, F.lit("/"), item, F.lit("/")).alias("canonical_url"),
            F.col("p_type").alias("genre_id"), "seen_in_api", "seen_in_list", "seen_in_detail",
            (F.col("l_partkey") % 11 != 0).alias("is_active"), "updated_at",
        )

    def variants(self) -> DataFrame:
        rows = self.table("lineitem").select("l_suppkey", "l_partkey", "l_linenumber").distinct()
        shop, item = F.col("l_suppkey").cast("string"), F.col("l_partkey").cast("string")
        code = F.col("l_linenumber").cast("string")
        return rows.select(
            variant_uid(shop, item, code).alias("variant_uid"), product_uid(shop, item).alias("product_uid"),
            code.alias("variant_code"),
            F.when(F.col("l_partkey") % 7 != 0, F.lpad(item, 13, "0")).alias("jan_code"),
            F.concat(F.lit("No. "), code).alias("variant_name"),
            (F.col("l_linenumber") != 6).alias("is_active"),
        )

    def list_observations(self) -> DataFrame:
        li = self.lines().filter(F.col("l_returnflag") == "N")
        shop, item = F.col("l_suppkey").cast("string"), F.col("l_partkey").cast("string")
        line = F.col("l_linenumber")
        count = F.floor(F.col("l_extendedprice") / F.col("l_quantity") / 100)
        return li.select(
            product_uid(shop, item).alias("product_uid"),
            F.floor(F.col("l_extendedprice") / F.col("l_quantity")).alias("observed_price"),
            count.alias("point_count"),
            F.when(line != 5, F.lit(1)).alias("point_base_multiplier"),
            F.concat(count.cast("string"), F.lit("ポイント")).alias("point_text_raw"),
            F.when(F.col("l_discount") > 0.05, F.col("l_quantity").cast("bigint")).alias("coupon_discount"),
            F.when(F.col("l_discount") > 0.05, F.lit("exact")).alias("coupon_type"),
            F.when(line % 2 == 0, F.lit(0)).when(line % 3 == 0, F.lit(550)).alias("shipping_cost"),
            F.when(F.col("l_linestatus") == "O", F.lit("翌日お届け")).alias("delivery_text"),
            (line % 2 == 0).alias("is_free_shipping"),
            F.when(F.col("l_tax") > 0.0, F.col("l_tax") * 50).alias("review_score"),
            F.when(F.col("l_tax") > 0.0, F.col("l_quantity").cast("bigint")).alias("review_count"),
            shop.alias("shop_code"),
            F.concat(F.lit("https://img.example.com/"), item, F.lit(".jpg")).alias("image_url"),
            (F.col("l_discount") >= 0.1).alias("is_super_deal"),
            F.when(line == 7, F.lit("html")).otherwise(F.lit("json")).alias("data_source"),
            F.col("l_shipdate").alias("observed_at"),
            F.struct("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus").alias("seq"),
        )

    def detail_observations(self) -> DataFrame:
        li = self.lines().filter(F.col("l_returnflag") == "R")
        shop, item = F.col("l_suppkey").cast("string"), F.col("l_partkey").cast("string")
        line = F.col("l_linenumber")
        return li.select(
            product_uid(shop, item).alias("product_uid"),
            F.floor(F.col("l_extendedprice") / F.col("l_quantity")).alias("price_min"),
            F.floor(F.col("l_extendedprice") / F.col("l_quantity")).alias("price_max"),
            F.when(F.col("l_discount") > 0.05, F.col("l_quantity").cast("bigint") * 10).alias("coupon_yen"),
            F.when(F.col("l_discount") > 0.08, F.round(F.col("l_discount") * 100)).alias("coupon_percent"),
            F.when(line != 4, F.lit("[]")).alias("variant_data_json"),
            F.when(line != 3, line - 1).alias("variant_count"),
            F.col("l_shipdate").alias("observed_at"),
            F.struct("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus").alias("seq"),
        )

    # events, jobs, targets --------------------------------------------------
    def browse_events(self, events: DataFrame | None = None) -> DataFrame:
        e = (self.table("events") if events is None else events).filter(F.col("event_type").isin("view", "click"))
        return e.select(
            "event_id", F.col("user_id").cast("string").alias("user_id"),
            F.get_json_object("props", "$.k").alias("shop_code"), F.col("ts").alias("browsed_at"),
        )

    def jobs(self) -> DataFrame:
        o = self.table("orders")
        status, kind = F.col("o_orderstatus"), F.col("o_orderpriority")
        return o.select(
            F.col("o_orderkey").alias("id"),
            F.when(kind == "1-URGENT", F.lit("api_discovery")).when(kind == "2-HIGH", F.lit("list_scrape"))
            .otherwise(F.lit("detail_scrape")).alias("job_type"),
            F.concat(F.lit(ITEM_URL), (F.col("o_custkey") % 10).cast("string"), F.lit("/"), F.col("o_custkey").cast("string"), F.lit("/")).alias("target_url"),
            F.when(status == "F", F.lit("done")).when(status == "O", F.lit("pending")).otherwise(F.lit("running")).alias("status"),
            (F.col("o_orderkey") % 5).cast("int").alias("attempts"),
            F.lit(3).alias("max_attempts"),
            F.when(status == "P", F.lit("worker")).alias("locked_by"),
            F.when((status == "P") & (F.col("o_orderkey") % 2 == 0), F.col("o_orderdate")).alias("locked_at"),
            F.when(status != "O", F.col("o_orderdate")).alias("started_at"),
            F.when(F.col("o_orderkey") % 3 == 0, F.lit("timeout")).alias("error_message"),
            F.col("o_orderdate").alias("created_at"),
            F.lit(None).cast("timestamp_ntz").alias("scheduled_at"),
            F.when(status == "F", F.col("o_orderdate") + F.make_dt_interval(secs=F.col("o_orderkey") % 60)).alias("completed_at"),
        )

    def jobs_as_of(self) -> Column:
        return self.table("orders").agg(F.max("o_orderdate")).scalar()

    def genre_edges(self) -> DataFrame:
        """Root 0 → regions (100 + key) → nations (1000 + key)."""
        top = self.table("region").select(F.lit(0).alias("parent_id"), (F.col("r_regionkey") + 100).alias("child_id"))
        low = self.table("nation").select((F.col("n_regionkey") + 100).alias("parent_id"), (F.col("n_nationkey") + 1000).alias("child_id"))
        return top.unionByName(low)

    def targets(self) -> DataFrame:
        """Every shop as a target, and every part type as a genre target."""
        s = self.table("supplier").select(
            F.col("s_suppkey").alias("id"), F.lit("shop").alias("target_type"), F.col("s_suppkey").cast("string").alias("target_value"),
            (F.col("s_nationkey") % 3 != 0).alias("is_active"), (F.col("s_nationkey") * 5).cast("int").alias("priority"),
            F.lit("manual").alias("added_by"),
        )
        g = self.table("part").groupBy("p_type").agg((F.min("p_partkey") + 1_000_000_000).alias("id")).select(
            "id", F.lit("genre").alias("target_type"), F.col("p_type").alias("target_value"),
            F.lit(True).alias("is_active"), F.lit(10).alias("priority"), F.lit("manual").alias("added_by"),
        )
        return s.unionByName(g)
