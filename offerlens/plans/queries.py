"""Registered queries: every operator over the star tables' catalogue views."""

from __future__ import annotations

from functools import reduce
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.fixed import SPARSE_DETAIL_COLUMNS, SPARSE_LIST_COLUMNS
from offerlens.functions import display as Y
from offerlens.functions import text as X
from offerlens.functions import url as U
from offerlens.functions.keys import content_hash, genre_path, id_list, record_date, source_flags
from offerlens.functions import sql as SQL
from offerlens.functions.price import offer_value
from offerlens.functions.url import product_uid
from offerlens.operators import history as H
from offerlens.operators import jan as J
from offerlens.operators import jobs as B
from offerlens.operators import merge as M
from offerlens.operators import planning as P
from offerlens.operators import product as D
from offerlens.operators import quality as Q
from offerlens.operators import ranking as R
from offerlens.operators import retention as K
from offerlens.operators import search as S
from offerlens.operators.ordered import first_page, latest_per_key, number_rows
from offerlens.plans import documents as T
from offerlens.plans.domain import Domain
from offerlens.session import durable, session_settings
from offerlens.sources import api_json, browse, detail_pages, list_pages, offers
from offerlens.sources.csv_export import write_csv
from offerlens.sources.star import HOME, Star, co_located, count_stored
from offerlens.sources.tables import Tables
from offerlens.streaming import rankings as L
from offerlens.streaming.catalogue import trim_events, trim_history
from offerlens.streaming.views import STATE_STORE, start_views, view_counts

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Callable[[Domain], DataFrame]) -> Callable[[Domain], DataFrame]:
    REGISTRY[fn.__name__] = lambda spark, folder: fn(Domain(spark, folder))
    return fn


def shown(df: DataFrame) -> DataFrame:
    """Dates and times as text, so that results compare across engines."""
    out = []
    for name, kind in df.dtypes:
        if kind == "date":
            out.append(F.date_format(name, "yyyy-MM-dd").alias(name))
        elif kind.startswith("timestamp"):
            out.append(F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)


# price and JAN comparison -----------------------------------------------------


@query
def jan_cheapest_all(d: Domain) -> DataFrame:
    offers = J.jan_offers(d.items(), d.variants(), d.snapshots(), mode="server")
    return J.cheapest_per_jan(offers)


@query
def jan_ranked_all(d: Domain) -> DataFrame:
    offers = J.jan_offers(d.items(), d.variants(), d.snapshots()).select("jan_code", "variant_uid", "effective_price")
    return J.ranked_by_jan(offers)


@query
def jan_offers_one(d: Domain) -> DataFrame:
    rows = J.cheapest_by_jan(d.items(), d.variants(), d.snapshots(), d.shops(), "0000000000012")
    return shown(rows.drop("extra1_key", "extra1_value", "extra2_key", "extra2_value"))


@query
def jan_effective_modes(d: Domain) -> DataFrame:
    snaps = d.snapshots().select("variant_uid", "price", "point_rate", "point_back_percent", "coupon_yen", "coupon_percent")
    rows = snaps.withColumns({m: offer_value(mode=m) for m in ("server", "client", "chart")})
    return rows.select(
        "variant_uid",
        F.col("server.effective_coupon").alias("coupon"),
        F.col("server.total_points").alias("server_points"),
        F.col("client.total_points").alias("client_points"),
        F.col("client.point_back_amount").alias("client_back"),
        F.col("server.price_minus_points").alias("server_less_points"),
        *[F.col(f"{m}.effective_price").alias(f"{m}_net") for m in ("server", "client", "chart")],
    )


@query
def sql_net_prices(d: Domain) -> DataFrame:
    """Net prices by the SQL functions, for multipliers inside and outside their range."""
    SQL.register(d.spark)
    rows = d.snapshots().withColumn("multiplier", F.explode(F.array(F.lit(-5.0), F.lit(4.0), F.lit(250.0))))
    args = "CAST(price AS DOUBLE), CAST(point_rate AS DOUBLE), CAST(point_back_percent AS DOUBLE), CAST(coupon_yen AS BIGINT), CAST(coupon_percent AS DOUBLE), multiplier"
    return rows.select(
        "variant_uid", "multiplier", F.expr("ol_points(CAST(price AS DOUBLE), CAST(point_rate AS DOUBLE), multiplier)").alias("points"),
        *[F.expr(f"ol_net_{mode}({args})").alias(f"{mode}_net") for mode in ("server", "client", "chart")],
    )


@query
def point_calculation(d: Domain) -> DataFrame:
    return H.calculate_points(d.snapshots())


# search ------------------------------------------------------------------------


def _gappy(d: Domain) -> tuple[DataFrame, DataFrame]:
    """Items with names in mixed case, and snapshots some of which have no price."""
    upper = F.when(F.col("item_code").cast("long") % 3 == 0, F.upper("item_name")).otherwise(F.col("item_name"))
    price = F.when(~F.col("variant_uid").endswith(":5"), F.col("price"))
    return d.items().withColumn("item_name", upper), d.snapshots().withColumn("price", price)


def _search(d: Domain, search: S.Search | None, sort_by: str, page: int = 1, per_page: int = 50, gaps: bool = False) -> DataFrame:
    items, snapshots = _gappy(d) if gaps else (d.items(), d.snapshots())
    rows, _ = S.search_products(items, d.variants(), snapshots, d.shops(), search, sort_by, page, per_page)
    return shown(rows.drop("extra1_key", "extra1_value", "extra2_key", "extra2_value"))


@query
def search_price_asc(d: Domain) -> DataFrame:
    return _search(d, None, "price_asc")


@query
def search_price_desc(d: Domain) -> DataFrame:
    return _search(d, None, "price_desc", page=3)


@query
def search_updated(d: Domain) -> DataFrame:
    return _search(d, None, "updated", gaps=True)


@query
def search_effective(d: Domain) -> DataFrame:
    return _search(d, S.Search(want_jan=True), "effective", per_page=100, gaps=True)


@query
def search_effective_unpriced(d: Domain) -> DataFrame:
    """Offers without price come last by net price."""
    return _search(d, S.Search(shop_code="7"), "effective", per_page=100, gaps=True).select("variant_uid", "price", "effective_price")


@query
def search_name(d: Domain) -> DataFrame:
    return _search(d, S.Search(q="Ring"), "name", per_page=100, gaps=True)


@query
def search_filters(d: Domain) -> DataFrame:
    search = S.Search(want_jan=True, want_coupon=True, price_min=1000, price_max=1500, shipping_max_days=1)
    return _search(d, search, "price_asc", per_page=100)


@query
def search_updated_24h(d: Domain) -> DataFrame:
    return _search(d, S.Search(updated_since=S.Search.updated_24h(d.as_of())), "price_asc", per_page=100)


@query
def search_shop_jan(d: Domain) -> DataFrame:
    rows = _search(d, S.Search(shop_code="7", want_jan=True), "price_desc", per_page=100)
    return rows.unionByName(_search(d, S.Search(jan="0000000000012"), "price_asc", per_page=100))


@query
def search_multi_variant(d: Domain) -> DataFrame:
    return _search(d, S.Search(want_variants=True), "price_asc", per_page=100)


@query
def variant_counts(d: Domain) -> DataFrame:
    return S.multi_variant_items(d.variants())


def _counted() -> dict[str, S.Search]:
    return {
        "coupon": S.Search(want_coupon=True).sorted_by("price_asc"), "jan": S.Search(want_jan=True),
        "variants": S.Search(want_variants=True), "name": S.Search(q="widget", price_max=2000),
    }


@query
def search_count(d: Domain) -> DataFrame:
    items, variants, snaps = d.items(), d.variants(), d.snapshots()
    unfiltered = snaps.agg(F.count("price").alias("total")).select(F.lit("all").alias("kind"), "total")
    filtered = S.count_searches(items, variants, snaps, _counted())
    return unfiltered.unionByName(filtered).withColumn("pages", S.page_count(F.col("total"), 50))


def _star(d: Domain) -> Star:
    place = d.scratch("star")
    # Products here have up to seven variants: those with more than four take two parts.
    return Star(d.spark, place.rsplit("/", 1)[-1].replace("-", "_")).write(place, d.items(), d.variants(), d.snapshots(), buckets=16, widest=4)


@query
def search_count_stored(d: Domain) -> DataFrame:
    """The same counts over the stored star, whose joins move no rows."""
    star = _star(d)
    with co_located(d.spark):
        unfiltered = star.snapshots.agg(F.count("price").alias("total")).select(F.lit("all").alias("kind"), "total")
        found = durable(unfiltered.unionByName(count_stored(star, _counted())))
    star.drop()
    return found.withColumn("pages", S.page_count(F.col("total"), 50))


@query
def jan_cheapest_stored(d: Domain) -> DataFrame:
    """The cheapest offer of every JAN over the stored star: one shuffle, of partial
    aggregates."""
    star = _star(d)
    with co_located(d.spark):
        found = durable(J.cheapest_per_jan(J.jan_offers(star.items, star.variants, star.snapshots, mode="server", home=HOME)))
    star.drop()
    return found


@query
def search_keyset_page(d: Domain) -> DataFrame:
    """Page 2 by key: the rows after the last one of page 1, found as its 50th."""
    narrow = S.Search().sorted_by("price_asc").narrow(d.items(), d.variants(), d.snapshots(), keep=("price",))
    last = first_page(narrow, S.sort_order("price_asc"), 50).select("price", "variant_uid").collect()[-1]
    return S.after_key(narrow, last["price"], last["variant_uid"], 50).select("variant_uid", "product_uid", "price")


@query
def search_keyset_orders(d: Domain) -> DataFrame:
    """Page 2 by key in the other orders, on a catalogue with offers without prices
    and names that differ in case alone."""
    items, snapshots = _gappy(d)
    # Each table is folded once for all orders, and each order's rows once for both pages.
    items = durable(items.select("product_uid", "is_active", "item_name"))
    variants = durable(d.variants().select("variant_uid", "product_uid", "is_active"))
    snapshots = durable(snapshots.select("variant_uid", "price", "point_rate", "point_back_percent", "coupon_yen", "coupon_percent", "fetched_at"))
    pages = []
    for sort_by, column in (("price_desc", "price"), ("updated", "fetched_at"), ("name", "item_name"), ("effective", "effective_price")):
        rows = durable(S.sorted_rows(S.Search(), sort_by, items, variants, snapshots))
        last = first_page(rows, S.sort_order(sort_by), 50).select(column, "variant_uid").collect()[-1]
        page = S.after_key(rows, last[column], last["variant_uid"], 50, sort_by=sort_by)
        pages.append(page.select(F.lit(sort_by).alias("sort_by"), "variant_uid", "product_uid"))
    return reduce(DataFrame.unionAll, pages)


@query
def search_far_page(d: Domain) -> DataFrame:
    """The last full page of all offers by price, cut out of distributed positions."""
    pages = S.Search().sorted_by("price_asc").count(d.items(), d.variants(), d.snapshots()).first()["total"] // 50
    return _search(d, None, "price_asc", page=max(1, pages))


# product detail -----------------------------------------------------------------


@query
def product_detail_rows(d: Domain) -> DataFrame:
    rows = D.product_rows(d.items(), d.variants(), d.snapshots(), d.shops())
    snap = F.col("snapshot")
    return rows.select(
        "product_uid", "shop_name", "item_name", "canonical_url", "variant_uid", "variant_code", "jan_code",
        snap["price"].alias("price"), snap["point_rate"].alias("point_rate"), snap["coupon_yen"].alias("coupon_yen"),
        snap["coupon_percent"].alias("coupon_percent"), snap["source"].alias("source"),
    )


@query
def product_detail_nested(d: Domain) -> DataFrame:
    nested = D.nested_products(D.product_rows(d.items(), d.variants(), d.snapshots(), d.shops()), per_row=1000)
    codes = F.array_join(F.transform("variants", lambda v: v["variant_code"]), ",")
    prices = F.array_join(F.transform("variants", lambda v: v["snapshot"]["price"].cast("string")), ",")
    return nested.select("product_uid", "shop_name", "part", codes.alias("codes"), prices.alias("prices"))


@query
def product_jan(d: Domain) -> DataFrame:
    return D.product_jan(d.variants(), chosen="3")


# snapshot and history -------------------------------------------------------------

_STATE = ("variant_uid", "price", "point_rate", "point_back_percent", "coupon_yen", "coupon_percent", "shipping_text_raw",
          "shipping_days_min", "shipping_days_max", "fetched_at", "source")


@query
def snapshot_latest(d: Domain) -> DataFrame:
    return shown(d.snapshots("part").select(*_STATE))


def _daily(d: Domain) -> DataFrame:
    return d.history()


@query
def daily_history(d: Domain) -> DataFrame:
    return shown(_daily(d).select(*[c for c in _STATE if c != "shipping_text_raw"], "record_date"))


@query
def change_log(d: Domain) -> DataFrame:
    """What one-by-one writing with the unchanged-content test would store."""
    # The rows are shuffled whole, so they hold what is asked of them and no more.
    obs = H.with_hash(d.observations("part")).select("variant_uid", "content_hash", *d.ORDER, "coupon_yen", "source")
    written = H.changed_only(obs, d.ORDER).drop("content_hash")
    return shown(H.daily_history(written, d.ORDER).select("variant_uid", "record_date", "price", "coupon_yen", "coupon_percent", "point_rate", "source"))


@query
def change_log_coarse(d: Domain) -> DataFrame:
    """The same on prices in steps of 2000, where most rows repeat the one before."""
    obs = d.observations("part").withColumns({
        "price": F.floor(F.col("price") / 2000), **{m: F.lit(None) for m in ("point_rate", "point_back_percent", "coupon_yen", "coupon_percent",
        "shipping_text_raw", "shipping_days_min", "shipping_days_max")}})
    order = ("fetched_at", "seq", "l_linenumber", "quantity", "price", "l_suppkey", "l_returnflag")
    written = H.changed_only(H.with_hash(obs), order)
    return shown(written.select("variant_uid", "fetched_at", "price"))


@query
def snapshot_upsert(d: Domain) -> DataFrame:
    """Older half of the observations as stored state, the newer half as a batch."""
    half = F.lit("1999-01-01").cast("timestamp_ntz")
    obs = H.with_hash(d.observations("part")).select("variant_uid", "content_hash", *d.ORDER, "coupon_yen")
    stored = H.latest_snapshot(obs.filter(F.col("fetched_at") < half), d.ORDER)
    after, _ = H.upsert_snapshots(stored, obs.filter(F.col("fetched_at") >= half), d.ORDER)
    return shown(after.select("variant_uid", "price", "coupon_yen", "coupon_percent", "point_rate", "fetched_at"))


@query
def snapshot_batch_upsert(d: Domain) -> DataFrame:
    """Batch form without the unchanged test, and its history rows per day."""
    half = F.lit("1999-01-01").cast("timestamp_ntz")
    obs = H.with_hash(d.observations("part"))
    old, new = obs.filter(F.col("fetched_at") < half), obs.filter(F.col("fetched_at") >= half)
    _, written = H.upsert_snapshots(H.latest_snapshot(old, d.ORDER), new, d.ORDER, skip=False)
    history = H.upsert_history(H.daily_history(old, d.ORDER), written, d.ORDER)
    return shown(history.groupBy("record_date").agg(F.count("*").alias("rows"), F.sum("price").alias("price_sum")))


@query
def history_window(d: Domain) -> DataFrame:
    rows = H.window_of_days(_daily(d), 90, d.as_of())
    return shown(rows.select("variant_uid", "record_date", "price", "point_rate", "coupon_yen", "coupon_percent"))


@query
def history_one(d: Domain) -> DataFrame:
    rows = H.variant_history(_daily(d), "12", 730, d.as_of())
    return shown(rows.select("variant_uid", "record_date", "price", "point_rate", "coupon_yen", "coupon_percent"))


@query
def batch_history(d: Domain) -> DataFrame:
    rows = H.batch_history(_daily(d), ["12", "5", "no such", "77"], 365, d.as_of())
    flat = rows.select("variant_uid", "days", F.size("history").alias("entries"), F.explode_outer("history").alias("h"))
    return shown(flat.select("variant_uid", "days", "entries", F.col("h.record_date").alias("record_date"), F.col("h.price").alias("price")))


@query
def history_arrays(d: Domain) -> DataFrame:
    rows = H.history_arrays(_daily(d))
    entry = F.transform("history", lambda h: F.concat(F.date_format(h["record_date"], "yyyy-MM-dd"), F.lit("="), h["price"].cast("string")))
    return rows.select("variant_uid", F.array_join(entry, ",").alias("entries"))


@query
def display_changes(d: Domain) -> DataFrame:
    return shown(H.display_changes(_daily(d)).select("variant_uid", "record_date", "price", "coupon_yen", "coupon_percent", "point_rate"))


@query
def priced_history_changes(d: Domain) -> DataFrame:
    return shown(H.priced_history(_daily(d), start="1998-01-01", end="2000-12-31", changes_only=True))


@query
def display_changes_coarse(d: Domain) -> DataFrame:
    """Daily rows in steps of 2000, where many repeat the next newer one."""
    steps = _daily(d).withColumns({"price": F.floor(F.col("price") / 2000), **{c: F.lit(None).cast("double") for c in ("coupon_yen", "coupon_percent", "point_rate")}})
    return shown(H.display_changes(steps).select("variant_uid", "record_date", "price"))


# stored tables -----------------------------------------------------------------------


@query
def history_stored(d: Domain) -> DataFrame:
    """History written by month and scanned between two days: other months go unread."""
    tables = Tables(d.spark, d.scratch("history"))
    tables.append(_daily(d), "variant_daily_history")
    rows = tables.scan_history("1997-03-10", "1998-08-20")
    return shown(rows.select("variant_uid", "record_date", "price", "coupon_yen", *[F.col(c).cast("double").alias(c) for c in ("point_rate", "coupon_percent")]))


@query
def history_trimmed(d: Domain) -> DataFrame:
    """Retention on the stored history: old months are dropped as folders."""
    tables = Tables(d.spark, d.scratch("history"))
    tables.append(_daily(d), "variant_daily_history")
    trim_history(tables, d.as_of())
    kept = tables.read("variant_daily_history")
    return shown(kept.groupBy("variant_uid").agg(F.count("*").alias("rows"), F.min("record_date").alias("first_date")))


@query
def events_trimmed(d: Domain) -> DataFrame:
    """Retention on stored events: old days are dropped as folders."""
    tables = Tables(d.spark, d.scratch("events"))
    tables.append(d.browse_events(), "user_browse_events")
    trim_events(tables, d.events_as_of())
    return shown(tables.read("user_browse_events").select("event_id", "user_id", "shop_code", "browsed_at"))


@query
def observations_stored(d: Domain) -> DataFrame:
    """Listing observations appended in two batches, which share the days of their runs
    (one run a quarter: thousands of days with few rows each are no table of this kind)."""
    tables = Tables(d.spark, d.scratch("observations"))
    rows = d.list_observations().withColumn("observed_at", F.date_trunc("quarter", "observed_at"))
    odd = F.col("seq.l_orderkey") % 2 == 1
    for batch in (rows.filter(odd), rows.filter(~odd)):
        tables.append(batch, "list_observations")
    days = tables.read("list_observations").groupBy("observed_date").agg(
        F.count("*").alias("rows"), F.sum("observed_price").alias("prices"), F.count("coupon_discount").alias("coupons"),
        F.count_if("is_free_shipping").alias("free"), F.max("shop_code").alias("last_shop"))
    return shown(days)


@query
def history_exported(d: Domain) -> DataFrame:
    """The priced history as CSV files, read back by place of the columns."""
    place = d.scratch("csv")
    write_csv(H.priced_history(_daily(d)), place, "chart")
    names = ("record_date", "price", "points", "price_minus_points", "coupon", "effective_price")
    back = d.spark.read.option("header", True).csv(place).toDF(*names)
    return back.select(names[0], *[F.col(c).cast("bigint").alias(c) for c in names[1:]])


# merges ---------------------------------------------------------------------------


def _item_batch(d: Domain) -> DataFrame:
    """Item records as four sources would send them; texts are missing at times."""
    c, line = F.col, F.col("l_linenumber")
    source = F.when(line == 7, F.lit("extension")).when(c("l_returnflag") == "A", F.lit("api")).when(
        c("l_returnflag") == "N", F.lit("list")).otherwise(F.lit("detail"))
    rows = d.table("lineitem").select(
        c("l_suppkey").cast("string").alias("shop_code"), c("l_partkey").cast("string").alias("item_code"),
        source.alias("source"), c("l_shipdate").alias("fetched_at"),
        F.when(line % 2 == 0, F.concat(F.lit("name "), line.cast("string"))).alias("item_name"),
        F.when(line % 3 == 0, F.concat(F.lit("copy "), line.cast("string"))).alias("catchcopy"),
        F.when(c("l_returnflag") != "N", c("l_returnflag")).alias("genre_id"),
        F.when(c("l_returnflag") == "A", F.concat(c("l_suppkey").cast("string"), F.lit(":"), c("l_partkey").cast("string"))).alias("api_item_code"),
        F.concat(F.lit("https://item.example.com/"), line.cast("string"), F.lit("/")).alias("canonical_url"),
        F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_returnflag").alias("seq"),
    )
    return rows.withColumns(source_flags())


_ITEM_SHOWN = ("shop_code", "item_code", "api_item_code", "canonical_url", "item_name", "catchcopy", "genre_id", "seen_in_api",
               "seen_in_list", "seen_in_detail", "seen_in_ext", "ext_first_seen", "ext_view_count", "in_server_crawl")


@query
def merge_items_fold(d: Domain) -> DataFrame:
    return shown(M.merge_items(None, _item_batch(d)).select(*_ITEM_SHOWN))


@query
def merge_items_two_batches(d: Domain) -> DataFrame:
    """Merging two batches in order gives what merging them at once gives."""
    half = F.lit("1999-01-01").cast("timestamp_ntz")
    batch = _item_batch(d)
    first = M.merge_items(None, batch.filter(F.col("fetched_at") < half))
    return shown(M.merge_items(first, batch.filter(F.col("fetched_at") >= half)).select(*_ITEM_SHOWN))


@query
def merge_shops_coalesce(d: Domain) -> DataFrame:
    c = F.col
    batch = d.table("lineitem").select(
        c("l_suppkey").cast("string").alias("shop_code"),
        F.when(c("l_linenumber") % 2 == 0, F.concat(F.lit("shop "), c("l_linenumber").cast("string"))).alias("shop_name"),
        F.lit(None).cast("string").alias("shop_url"),
        F.struct("l_shipdate", "l_orderkey", "l_linenumber").alias("seq"),
    )
    stored = d.shops()
    return M.merge_shops(stored, batch)


@query
def merge_variants_coalesce(d: Domain) -> DataFrame:
    c = F.col
    obs = d.table("lineitem").select(
        c("l_suppkey").cast("string").alias("shop_code"), c("l_partkey").cast("string").alias("item_code"),
        c("l_linenumber").cast("string").alias("variant_code"),
        F.when(c("l_returnflag") == "R", F.lpad(c("l_partkey").cast("string"), 13, "0")).alias("jan_code"),
        F.when(c("l_returnflag") != "A", F.concat(F.lit("name "), c("l_returnflag"))).alias("variant_name"),
        F.lit(None).cast("string").alias("selector_values"),
        F.struct("l_shipdate", "l_orderkey", "l_returnflag").alias("seq"),
    )
    return M.merge_variants(None, obs).drop("selector_values")


@query
def merge_stored_buckets(d: Domain) -> DataFrame:
    """The items of both batches by stored buckets: the second batch reads and rewrites
    the buckets that its keys fall in."""
    half = F.lit("1999-01-01").cast("timestamp_ntz")
    tables = Tables(d.spark, d.scratch("buckets"), buckets=16)
    keyed = _item_batch(d).withColumn("product_uid", product_uid("shop_code", "item_code"))
    for batch in (keyed.filter(F.col("fetched_at") < half), keyed.filter(F.col("fetched_at") >= half)):
        stored, buckets = tables.read_touched("items", batch)
        kinds = dict(stored.dtypes)
        folded = M.merge_items(stored.drop("product_uid"), batch.withColumn("ext_first_seen", F.col("ext_first_seen").cast(kinds["ext_first_seen"])))
        tables.replace_touched(folded.withColumn("product_uid", product_uid("shop_code", "item_code")), "items", buckets)
    return shown(tables.read("items").select(*_ITEM_SHOWN))


@query
def mark_for_crawl(d: Domain) -> DataFrame:
    """Items of shops with browse events join the server's own collection."""
    viewed = d.browse_events().select(F.concat("shop_code", F.lit(":"), "shop_code").alias("product_uid"))
    items = d.items().select("product_uid", F.col("seen_in_detail").alias("in_server_crawl"))
    return M.mark_for_crawl(items, viewed)


@query
def merge_targets_manual(d: Domain) -> DataFrame:
    """Shops added by hand to the stored ones, new ones among them."""
    stored = d.targets().withColumn("base_url", F.lit(None).cast("string"))
    named = d.table("customer").select(F.explode(F.array(F.col("c_nationkey").cast("string"), F.concat(F.lit("n"), F.col("c_nationkey")))).alias("target_value"))
    wanted = named.groupBy("target_value").agg(F.count("*").cast("int").alias("priority")).select(F.lit("shop").alias("target_type"), "target_value", F.concat(F.lit("u"), "target_value").alias("base_url"), "priority",
             F.lit(None).cast("bigint").alias("id"))
    merged = M.add_targets(stored.filter("target_type = 'shop'"), wanted)
    return merged.select("target_type", "target_value", "is_active", "priority", "added_by", "base_url")


@query
def merge_targets_greatest(d: Domain) -> DataFrame:
    """The top shops of the latest ranking become targets."""
    stored = d.targets().withColumns({"base_url": F.lit(None).cast("string"), "updated_at": F.lit(None).cast("timestamp_ntz")})
    ranked = R.rank_per_day(d.browse_events())
    merged = R.top_shop_targets(stored, ranked, d.events_as_of())
    return shown(merged.select("target_type", "target_value", "is_active", "priority", "added_by", "base_url", "updated_at"))


@query
def merge_targets_discovered(d: Domain) -> DataFrame:
    stored = d.targets().withColumn("last_crawled_at", F.lit(None).cast("timestamp_ntz"))
    wanted = d.table("nation").select(
        F.lit("genre").alias("target_type"), F.col("n_name").alias("target_value"), F.lit(True).alias("is_active"),
        F.lit(10).alias("priority"), F.lit("auto_discovery").alias("added_by"),
    ).unionByName(d.table("part").select(
        F.lit("genre").alias("target_type"), F.col("p_type").alias("target_value"), F.lit(True).alias("is_active"),
        F.lit(10).alias("priority"), F.lit("auto_discovery").alias("added_by"),
    ).distinct()).withColumn("last_crawled_at", d.as_of())
    merged = M.add_discovered_targets(stored, wanted)
    return shown(merged.select("target_type", "target_value", "is_active", "priority", "added_by", "last_crawled_at"))


@query
def targets_deactivated(d: Domain) -> DataFrame:
    gone = M.deactivate_targets(d.targets(), [1, 5, 7])
    return M.touch_targets(gone.withColumn("last_crawled_at", F.lit(None).cast("timestamp_ntz")),
                           gone.filter("target_type = 'shop' and is_active"), d.as_of()).select(
        "target_type", "target_value", "is_active", F.date_format("last_crawled_at", "yyyy-MM-dd").alias("last_crawled_at"))


@query
def targets_listed(d: Domain) -> DataFrame:
    rows = B.listed_targets(d.targets().withColumn("created_at", F.lit("2024-01-01")), "shop")
    return number_rows(rows, [], [F.col("priority").desc(), F.col("created_at"), F.col("id")], "place").select("place", "id", "priority")


# ranking ----------------------------------------------------------------------------


@query
def ranking_live(d: Domain) -> DataFrame:
    return R.live_ranking(d.browse_events(), d.shops(), d.events_as_of(), limit=20, hours=24)


@query
def ranking_daily_all(d: Domain) -> DataFrame:
    return shown(R.rank_per_day(d.browse_events()))


@query
def ranking_daily_latest(d: Domain) -> DataFrame:
    stored = R.rank_per_day(d.browse_events()).withColumn(
        "rank_position", F.when(F.col("rank_position") % 4 != 0, F.col("rank_position")))
    return R.daily_ranking(stored, d.shops(), limit=50)


@query
def ranking_full(d: Domain) -> DataFrame:
    counts = R.browse_counts(d.browse_events(), d.events_as_of(), 168)
    return shown(R.rank_all(counts, d.events_as_of().cast("date")))


@query
def ranking_share(d: Domain) -> DataFrame:
    return R.with_share(R.live_ranking(d.browse_events(), d.shops(), d.events_as_of(), limit=100, hours=168))


@query
def ranking_sliding(d: Domain) -> DataFrame:
    events = d.browse_events().withColumn("browsed_at", F.col("browsed_at").cast("timestamp_ntz"))
    return shown(R.windowed_counts(events))


# streams -----------------------------------------------------------------------------


@query
def stream_live_ranking(d: Domain) -> DataFrame:
    """The events replayed as a stream into trailing windows; the last complete one ranked."""
    place = d.scratch("live")
    L.start_live(d.browse_events(d.stream("events")), f"{place}/counts", f"{place}/state", key="event_id").awaitTermination()
    return L.live_windows(d.spark.read.parquet(f"{place}/counts"), d.shops())


@query
def stream_daily_ranking(d: Domain) -> DataFrame:
    """The events replayed as a stream into the ranking table of each complete day; the
    second run of the stream finds nothing new."""
    place = d.scratch("daily")
    tables = Tables(d.spark, f"{place}/tables")
    for _ in range(2):
        L.start_rankings(d.browse_events(d.stream("events")), tables, f"{place}/state", key="event_id").awaitTermination()
    return shown(tables.read("shop_rankings").select("ranking_date", "shop_code", "browse_count", "rank_position"))


@query
def stream_view_counts(d: Domain) -> DataFrame:
    """Views per shop from keyed states, each tenth event being delivered twice."""
    place = d.scratch("views")
    events = d.table("events")
    events.unionByName(events.filter(F.col("event_id") % 10 == 0)).write.parquet(f"{place}/events.parquet")
    again = Domain(d.spark, place)
    with session_settings(d.spark, STATE_STORE):
        start_views(again.browse_events(again.stream("events")), f"{place}/runs", f"{place}/state", idle_hours=12).awaitTermination()
    return shown(view_counts(d.spark.read.parquet(f"{place}/runs")))


# retention ---------------------------------------------------------------------------


@query
def retention_history(d: Domain) -> DataFrame:
    kept = K.keep_history(_daily(d), d.as_of())
    return shown(kept.groupBy("variant_uid").agg(F.count("*").alias("rows"), F.min("record_date").alias("first_date")))


@query
def retention_events(d: Domain) -> DataFrame:
    return shown(K.keep_events(d.browse_events(), d.events_as_of()))


def _extension_items(d: Domain) -> DataFrame:
    li = d.table("lineitem").withColumn("ext", F.col("l_linenumber") == 7)
    return li.groupBy("l_suppkey", "l_partkey").agg(
        F.max("ext").alias("seen_in_ext"),
        F.min(F.when(F.col("ext"), F.col("l_shipdate"))).alias("ext_first_seen"),
        F.count_if("ext").alias("ext_view_count"),
        F.max((F.col("l_linenumber") == 1)).alias("in_server_crawl"),
    ).select(F.concat(F.col("l_suppkey").cast("string"), F.lit(":"), F.col("l_partkey").cast("string")).alias("product_uid"),
             "seen_in_ext", "ext_first_seen", "ext_view_count", "in_server_crawl",
             (F.col("l_partkey") % 11 != 0).alias("is_active"))


@query
def retention_items(d: Domain) -> DataFrame:
    return K.prune_items(_extension_items(d), d.as_of(), cap=100, extra=20).select("product_uid", "seen_in_ext", "is_active")


# jobs ----------------------------------------------------------------------------------


@query
def new_jobs_anti(d: Domain) -> DataFrame:
    # The first shops' item addresses, some of which already have an open job.
    found = d.table("customer").select(
        F.concat(F.lit("https://item.example.com/"), (F.col("c_custkey") % 10).cast("string"), F.lit("/"), F.col("c_custkey").cast("string"), F.lit("/")).alias("target_url"),
        F.concat((F.col("c_custkey") % 10).cast("string"), F.lit(":"), F.col("c_custkey").cast("string")).alias("product_uid"),
    )
    return B.new_jobs(found.unionByName(found), d.jobs())


@query
def next_job_batch(d: Domain) -> DataFrame:
    return shown(B.next_batch(d.jobs(), d.jobs_as_of(), 500).select("id", "target_url", "status", "attempts", "started_at"))


@query
def job_table_after_batch(d: Domain) -> DataFrame:
    return B.take_batch(d.jobs(), d.jobs_as_of(), 500).groupBy("job_type", "status", "attempts").agg(F.count("*").alias("jobs"))


@query
def stale_jobs_repair(d: Domain) -> DataFrame:
    rows = B.repair_stale(d.jobs(), d.jobs_as_of(), 60)
    return shown(rows.select("id", "status", "locked_by", "locked_at", "error_message", "attempts"))


@query
def job_stats(d: Domain) -> DataFrame:
    return B.job_stats(d.jobs())


@query
def job_stats_ended(d: Domain) -> DataFrame:
    """Jobs that all ended, by type with few, some and many that failed or were skipped."""
    tenth, kind = F.col("id") % 10, F.col("job_type")
    ended = F.when((kind == "api_discovery") & (tenth >= 1) | (kind == "list_scrape") & (tenth >= 3) | (tenth >= 6), F.lit("done")).when(
        tenth % 2 == 0, F.lit("failed")).otherwise(F.lit("skipped"))
    return B.job_stats(d.jobs().withColumn("status", ended))


@query
def job_daily_stats(d: Domain) -> DataFrame:
    return shown(B.daily_job_stats(d.jobs()))


# planning --------------------------------------------------------------------------------


def _priced_genres(d: Domain) -> DataFrame:
    li = d.table("lineitem").select("l_partkey", F.floor(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    return li.join(d.table("part").select("p_partkey", F.col("p_type").alias("genre_id")), F.col("l_partkey") == F.col("p_partkey"))


@query
def price_slices(d: Domain) -> DataFrame:
    return P.price_slices(_priced_genres(d), cap=3000)


@query
def price_slices_fine(d: Domain) -> DataFrame:
    """A small cap: many levels, and single prices that cannot be split."""
    return P.price_slices(_priced_genres(d), cap=5)


@query
def discovery_ranges(d: Domain) -> DataFrame:
    slices = P.price_slices(_priced_genres(d), cap=3000)
    ids = d.targets().filter("target_type = 'genre'").select(F.col("id").alias("crawl_target_id"), F.col("target_value").alias("genre_id"))
    stored = slices.join(ids, "genre_id").withColumn("status", F.lit("pending"))
    marked = P.mark_split(stored, stored.filter("estimated_count > 2000"))
    return P.discovery_ranges(d.targets(), marked)


@query
def slice_status(d: Domain) -> DataFrame:
    slices = P.price_slices(_priced_genres(d), cap=500)
    ids = d.targets().filter("target_type = 'genre'").select(F.col("id").alias("crawl_target_id"), F.col("target_value").alias("genre_id"))
    status = F.when(F.col("estimated_count") == 0, F.lit("done")).when(F.col("estimated_count") < 200, F.lit("in_progress")).otherwise(F.lit("pending"))
    return Q.slice_status(slices.join(ids, "genre_id").withColumn("status", status).drop("genre_id"), d.targets())


@query
def page_frontier(d: Domain) -> DataFrame:
    totals = d.table("part").groupBy(F.col("p_type").alias("genre_id"), F.col("p_brand").alias("keyword")).agg(
        F.count("*").alias("total_found"), F.min(F.floor("p_retailprice")).alias("min_price"), F.max(F.floor("p_retailprice")).alias("max_price"))
    return P.page_frontier(totals, page_size=10).select("genre_id", "keyword", "page", "url")


@query
def api_page_chain(d: Domain) -> DataFrame:
    totals = d.table("lineitem").groupBy(F.col("l_suppkey").alias("shop")).agg(F.ceil(F.count("*") / 30).alias("page_count"))
    return P.api_pages(totals).select("shop", "page")


@query
def shop_frontier(d: Domain) -> DataFrame:
    return P.shop_frontier(d.targets().withColumn("created_at", F.lit("2024-01-01")))


@query
def genre_closure(d: Domain) -> DataFrame:
    """All genres below the root by their depth, with edges that lead back up."""
    edges = d.genre_edges()
    back = edges.filter("parent_id >= 100").select(F.col("child_id").alias("parent_id"), F.col("parent_id").alias("child_id"))
    return P.genre_closure(edges.unionByName(back), 0)


@query
def genre_frontier(d: Domain) -> DataFrame:
    one = P.genre_frontier(d.genre_edges(), 0, 1).withColumn("depth", F.lit(1))
    return one.unionByName(P.genre_frontier(d.genre_edges(), 0, 3).withColumn("depth", F.lit(3)))


# quality ----------------------------------------------------------------------------------

_LIST_CHECKED = ("observed_price", "point_count", "point_base_multiplier", "point_text_raw", "coupon_discount", "coupon_type",
                 "shipping_cost", "delivery_text", "is_free_shipping", "review_score", "review_count", "shop_code", "image_url",
                 "is_super_deal")


@query
def quality_fill(d: Domain) -> DataFrame:
    return Q.fill_rates(d.list_observations(), _LIST_CHECKED, flags=("is_free_shipping", "is_super_deal"), sparse=SPARSE_LIST_COLUMNS)


@query
def quality_fill_detail(d: Domain) -> DataFrame:
    return Q.fill_rates(d.detail_observations(), ("price_min", "price_max", "variant_count", "variant_data_json", "coupon_yen", "coupon_percent"),
                        positive=("variant_count",), sparse=SPARSE_DETAIL_COLUMNS)


@query
def quality_snapshots(d: Domain) -> DataFrame:
    return Q.snapshot_fill(d.snapshots())


@query
def quality_api(d: Domain) -> DataFrame:
    return Q.api_coverage(d.snapshots())


@query
def quality_genres(d: Domain) -> DataFrame:
    return Q.genre_coverage(d.items())


@query
def quality_sources(d: Domain) -> DataFrame:
    return Q.source_counts(d.snapshots())


@query
def quality_stages(d: Domain) -> DataFrame:
    return Q.stage_counts(d.items())


@query
def quality_both(d: Domain) -> DataFrame:
    return Q.items_in_both(d.items(), d.list_observations(), d.detail_observations())


@query
def quality_history_span(d: Domain) -> DataFrame:
    return shown(Q.history_span(_daily(d)))


@query
def quality_needs(d: Domain) -> DataFrame:
    return Q.item_counts(d.list_observations(), d.detail_observations(), d.variants())


@query
def quality_complete(d: Domain) -> DataFrame:
    return Q.complete_products(d.items(), d.variants(), d.snapshots(), d.list_observations())


@query
def quality_latest_fields(d: Domain) -> DataFrame:
    latest = latest_per_key(d.list_observations(), ["product_uid"], ["observed_at", "seq"])
    rows = Q.filled_fields(latest, ("observed_price", "point_count", "point_text_raw", "coupon_discount", "coupon_type", "shipping_cost",
                                    "delivery_text", "is_free_shipping", "review_score", "review_count", "is_super_deal", "data_source"))
    return rows.select("product_uid", "fields_filled", "status")


@query
def latest_snapshot_per_item(d: Domain) -> DataFrame:
    snaps = d.snapshots().join(d.variants().select("variant_uid", "product_uid"), "variant_uid")
    latest = latest_per_key(snaps.select("product_uid", "fetched_at", "variant_uid", "price", "source"), ["product_uid"], ["fetched_at", "variant_uid"])
    return shown(latest)


def _checks(d: Domain) -> DataFrame:
    return Q.field_checks(d.items(), d.variants(), d.snapshots(), d.list_observations(), d.detail_observations())


@query
def quality_required(d: Domain) -> DataFrame:
    rows = Q.required_audit(_checks(d))
    return rows.select("uid", F.array_join("missing", ",").alias("missing"), "complete")


@query
def quality_score(d: Domain) -> DataFrame:
    return Q.overall_score(_checks(d))


@query
def quality_groups(d: Domain) -> DataFrame:
    return Q.group_totals(_checks(d))


@query
def quality_report(d: Domain) -> DataFrame:
    parts = quality_fill(d).select("status").unionByName(quality_snapshots(d).select("status")).unionByName(quality_api(d).select("status"))
    return Q.report(parts)


@query
def quality_tables(d: Domain) -> DataFrame:
    tables = {
        "shops": d.shops(), "items": d.items(), "variants": d.variants(), "variant_snapshots": d.snapshots(), "variant_daily_history": d.history(),
        "crawl_targets": d.targets(), "price_range_slices": P.price_slices(_priced_genres(d), cap=500), "crawl_jobs": d.jobs(),
        "user_browse_events": d.browse_events(), "shop_rankings": R.rank_per_day(d.browse_events()),
        "list_observations": d.list_observations(), "detail_observations": d.detail_observations(), "crawl_stats": B.daily_job_stats(d.jobs()),
    }
    return Q.table_counts(tables)


@query
def tiered_sample(d: Domain) -> DataFrame:
    return Q.tiered_sample(d.items(), 60, Q.missing_detail_tiers()).select("product_uid", "tier")


@query
def best_covered_sample(d: Domain) -> DataFrame:
    return Q.best_covered_tier(d.items(), 25).select("product_uid", "tier")


# ingest: documents that Spark derives from the tables, read back ---------------------


@query
def api_ingest(d: Domain) -> DataFrame:
    rows = api_json.api_offers(T.api_documents(d), genre_context="genre", keep=("fetched_at",))
    return shown(rows.select("shop_code", "shop_name", "shop_url", "item_code", "api_item_code", "canonical_url", "item_name", "catchcopy",
                             "genre_id", "variant_code", "price", "point_rate", "shipping_text_raw", "image_url", "extra1_key",
                             "extra1_value", "extra2_key", "extra2_value", "source", "fetched_at"))


@query
def api_paging(d: Domain) -> DataFrame:
    pages = api_json.api_pages(T.api_documents(d)).select("seq", "total_count", "page_count")
    return P.api_pages(pages)


_LIST_SHOWN = ("product_uid", "canonical_url", "url_variant_id", "item_name", "item_subtitle", "observed_price", "price_range", "variant_id",
               "is_sold_out", "image_url", "genre_ids", "leaf_genre_id", "shop_name", "shop_url", "point_count", "point_base_multiplier",
               "point_shop_multiplier", "point_up_multiplier", "point_total_multiplier", "is_point_back", "point_back_rate", "point_text_raw",
               "coupon_discount", "coupon_type", "coupon_text_raw", "shipping_cost", "delivery_text", "is_free_shipping", "review_score",
               "review_count", "is_super_deal", "is_shop39", "has_multi_sku", "data_source")


@query
def list_ingest(d: Domain) -> DataFrame:
    return list_pages.observations(list_pages.list_rows(T.list_documents(d))).select(*_LIST_SHOWN)


@query
def list_totals(d: Domain) -> DataFrame:
    """Stated totals of each listing page and the pages that follow from them."""
    totals = list_pages.page_totals(T.list_documents(d)).filter(F.col("total_found").isNotNull())
    paged = totals.withColumn("pages", F.size(P.page_numbers(F.col("total_found"), F.col("page_size"), 150)))
    return paged.groupBy("total_found", "page_size", "pages").agg(F.count("*").alias("documents"))


_OFFER_SHOWN = ("shop_code", "item_code", "canonical_url", "item_name", "variant_code", "jan_code", "variant_name", "price", "point_rate",
                "point_back_percent", "coupon_yen", "coupon_percent", "shipping_text_raw", "shipping_days_min", "shipping_days_max",
                "image_url", "extra1_key", "extra1_value", "extra2_key", "extra2_value")


@query
def detail_ingest(d: Domain) -> DataFrame:
    parsed = detail_pages.parse_pages(T.detail_documents(d))
    return detail_pages.detail_offers(parsed).select(*_OFFER_SHOWN, "shop_name", "shop_url", "genre_id", "selector_values")


@query
def detail_observed(d: Domain) -> DataFrame:
    parsed = detail_pages.parse_pages(T.detail_documents(d))
    rows = detail_pages.detail_observations(parsed)
    return rows.select("product_uid", "item_name", "shop_name", "shop_url_code", "price_min", "price_max", "review_count", "review_rating",
                       "is_39_shop", "is_super_deal", "inventory_type", "coupon_yen", "coupon_percent", "variant_count", "variant_data_json",
                       "ancestor_genre_id", "data_source")


@query
def variant_json_summary(d: Domain) -> DataFrame:
    parsed = detail_pages.parse_pages(T.detail_documents(d))
    rows = Q.variant_json_coverage(detail_pages.detail_observations(parsed))
    return rows.groupBy("data_source", "variants", "with_jan", "with_price", "with_stock").agg(F.count("*").alias("rows"))


@query
def browse_ingest(d: Domain) -> DataFrame:
    rows = browse.event_offers(browse.parse_events(T.browse_documents(d)), keep=("event_id",))
    return rows.select("event_id", "shop_code", "item_code", "canonical_url", "item_name", "variant_code", "jan_code", "price", "point_rate",
                       "coupon_yen", "image_url", "source", "variant_place")


@query
def browse_event_rows(d: Domain) -> DataFrame:
    return shown(browse.event_rows(browse.parse_events(T.browse_documents(d)), "ts", keep=("event_id",)))


@query
def browse_rejected(d: Domain) -> DataFrame:
    rows = browse.rejected(browse.parse_events(T.browse_documents(d)))
    return rows.select("event_id", F.col("p.page_url").alias("page_url"))


@query
def feeds_to_catalogue(d: Domain) -> DataFrame:
    """Four feeds, one item table: the merge over the union of all sources."""
    seen = list_pages.observations(list_pages.list_rows(T.list_documents(d), keep=("observed_at",))).withColumnRenamed("observed_at", "fetched_at")
    feeds = offers.union_offers(
        api_json.api_offers(T.api_documents(d), genre_context="genre", keep=("fetched_at",)),
        list_pages.list_offers(seen, keep=("fetched_at",)),
        detail_pages.detail_offers(detail_pages.parse_pages(T.detail_documents(d), keep=("observed_at",)), keep=("observed_at",)).withColumnRenamed("observed_at", "fetched_at"),
        browse.event_offers(browse.parse_events(T.browse_documents(d)), keep=("ts",)).withColumnRenamed("ts", "fetched_at"),
    )
    batch = offers.item_batch(feeds).withColumn("seq", F.col("fetched_at"))
    items = M.merge_items(None, batch)
    return items.groupBy("seen_in_api", "seen_in_list", "seen_in_detail", "seen_in_ext", "in_server_crawl").agg(
        F.count("*").alias("items"), F.sum("ext_view_count").alias("views"))


# expressions over whole tables -----------------------------------------------------------


@query
def url_canonical(d: Domain) -> DataFrame:
    return d.table("pages").select("page_id", U.canonical_url("url").alias("canonical"), U.clean_tracking("url", ("utm_source", "ref")).alias("cleaned"),
                                   U.query_value("url", "page").alias("page"), U.url_variant_id("url").alias("variant_id"))


@query
def url_codes(d: Domain) -> DataFrame:
    codes = U.shop_item_code("url")
    return d.table("pages").select(
        "page_id", codes["shop_code"].alias("shop_code"), codes["item_code"].alias("item_code"), U.store_code("url").alias("store"),
        U.product_uid(codes["shop_code"], codes["item_code"]).alias("product_uid"),
        U.variant_uid(codes["shop_code"], codes["item_code"], F.lit("")).alias("variant_uid"),
        U.parse_api_item_code(U.product_uid(codes["shop_code"], codes["item_code"]))["item_code"].alias("api_item"),
        U.shop_url(codes["shop_code"]).alias("shop_url"),
    )


@query
def page_class(d: Domain) -> DataFrame:
    rows = d.table("pages").select("page_id", list_pages.page_class().alias("as_list"), detail_pages.page_class().alias("as_detail"))
    return rows


@query
def page_titles(d: Domain) -> DataFrame:
    title = F.nullif(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1), F.lit(""))
    return d.table("pages").select("page_id", X.title_name(title).alias("name"))


@query
def text_round_trip(d: Domain) -> DataFrame:
    """Point, coupon and shipping texts built from the lines and read back."""
    up, qty, line = F.round(F.col("l_tax") * 100).cast("int"), F.col("l_quantity").cast("bigint"), F.col("l_linenumber")
    none = F.lit(None).cast("int")
    rows = d.lines().select(
        X.point_text(qty * 100, line == 7, F.lit(20.0), F.when(line != 6, F.lit(1)), none, up, none, none).alias("point_text"),
        X.coupon_text(qty * 50, F.when(line % 3 == 0, F.lit("exact")).when(line % 3 == 1, F.lit("percentage"))).alias("coupon_text"),
        F.when(line == 1, F.lit("翌日配送")).when(line == 2, F.lit("３日以内に発送")).otherwise(F.concat(line.cast("string"), F.lit("～9日"))).alias("ship_text"),
    )
    read = rows.withColumns({"pt": X.card_points("point_text"), "cp": X.card_coupon("coupon_text"), "sd": X.shipping_days("ship_text"),
                             "pr": X.point_rate_from_text("point_text")})
    return read.groupBy(
        "point_text", "coupon_text", "ship_text", F.col("pt.point_count").alias("point_count"), F.col("pt.point_total_multiplier").alias("total_multiplier"),
        F.col("pt.is_point_back").alias("is_point_back"), F.col("cp.coupon_discount").alias("coupon_discount"), F.col("cp.coupon_type").alias("coupon_type"),
        F.col("sd.shipping_days_min").alias("days_min"), F.col("sd.shipping_days_max").alias("days_max"),
        F.col("pr.point_rate").alias("rate"), F.col("pr.point_back_percent").alias("back"),
        X.price_from_text("coupon_text").alias("digits"),
    ).agg(F.count("*").alias("rows"))


@query
def content_hashes(d: Domain) -> DataFrame:
    snaps = d.snapshots("part")
    return snaps.select("variant_uid", content_hash(snaps.columns).alias("content_hash"))


@query
def record_dates(d: Domain) -> DataFrame:
    """Events per local calendar day, nine hours ahead of UTC."""
    return shown(d.browse_events().groupBy(record_date("browsed_at", "Asia/Tokyo").alias("record_date")).agg(F.count("*").alias("events")))


@query
def display_columns(d: Domain) -> DataFrame:
    snaps = d.snapshots("part")
    return snaps.select(
        "variant_uid", Y.yen("price").alias("yen"), Y.points(F.floor(F.col("price") / 25)).alias("points"),
        Y.truncated("image_url", 28).alias("short_url"), Y.shown_date("fetched_at").alias("shown_date"), Y.age("fetched_at", d.as_of()).alias("age"),
        Y.shipping_range("shipping_days_min", "shipping_days_max").alias("shipping"), X.is_free_shipping("shipping_text_raw").alias("free_shipping"),
    )


# single expressions over the tables --------------------------------------------------------


@query
def genre_paths(d: Domain) -> DataFrame:
    path = F.concat(F.lit("/0/"), F.col("p_size"), F.lit("/"), F.col("p_partkey"))
    ids = genre_path(path)
    return d.table("part").select("p_partkey", F.array_join(ids.cast("array<string>"), ",").alias("ids"), F.element_at(ids, -1).alias("leaf"))


@query
def search_url_shops(d: Domain) -> DataFrame:
    url = U.search_url(shop_code=F.col("s_suppkey").cast("string"), page=F.lit(3))
    return d.table("supplier").select("s_suppkey", U.shop_from_search_url(url).alias("shop_code"))


@query
def id_lists(d: Domain) -> DataFrame:
    given = F.concat_ws(", ", "l_orderkey", "l_partkey", F.when(F.col("l_linenumber") != 7, F.col("l_suppkey").cast("string")).otherwise(F.lit("x")))
    return d.table("lineitem").select("l_orderkey", "l_linenumber", F.array_join(id_list(given).cast("array<string>"), "|").alias("ids"))


@query
def multipliers_held(d: Domain) -> DataFrame:
    """Net prices under multipliers of which many lie outside the range."""
    c = F.col
    value = offer_value(F.lit(2000), F.lit(1.0), F.lit(0.0), F.lit(0), F.lit(0.0), multiplier=(c("l_quantity") - 20) * 5)
    return d.table("lineitem").select("l_orderkey", "l_linenumber", value["total_points"].alias("points"), value["effective_price"].alias("net"))


@query
def coupon_fragments(d: Domain) -> DataFrame:
    """Coupons that only a piece of JSON in the page names."""
    kind = F.when(F.col("l_linenumber") % 2 == 0, F.lit("exact")).otherwise(F.lit("percentage"))
    text = F.concat(F.lit('{"coupon": {"discount": '), F.col("l_quantity").cast("bigint"), F.lit(', "discountType": "'), kind, F.lit('"}}'))
    found = X.page_coupon(F.array().cast("array<string>"), text)
    return d.table("lineitem").select("l_orderkey", "l_linenumber", found["coupon_yen"].alias("yen"), found["coupon_percent"].alias("percent"))
