"""Stored tables, exports and streams; a repeated batch changes nothing."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from offerlens import schema as C
from offerlens.operators import history as H
from offerlens.operators import ranking as R
from offerlens.operators import retention as K
from offerlens.sources import browse
from offerlens.sources.csv_export import write_csv
from offerlens.sources.offers import as_offers, union_offers
from offerlens.sources.tables import Tables
from offerlens.streaming import catalogue, rankings

FOLDER = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_schemas(spark):
    assert len(C.TABLES) == 13
    assert all(C.schema(t).fields for t in C.TABLES)
    assert all(set(c) <= set(C.schema(t).fieldNames()) for m in (C.PARTITIONS, C.CLUSTERED, C.KEYS) for t, c in m.items())
    bad = C.bad_words(spark.createDataFrame([("genre", "manual"), ("x", "manual"), ("shop", "robot")], "target_type string, added_by string"), "crawl_targets")
    assert bad.count() == 2


def test_history_table_prunes_and_replaces_months(spark, tmp_path):
    tables = Tables(spark, str(tmp_path))
    assert tables.read("variant_daily_history").count() == 0
    days = [dt.date(2024, m, d) for m in (1, 2, 3) for d in (1, 15)]
    df = spark.createDataFrame([("v", d, i) for i, d in enumerate(days)], "variant_uid string, record_date date, price int").withColumn(
        "record_month", F.date_format("record_date", "yyyy-MM"))
    tables.append(df, "variant_daily_history")
    scan = tables.scan_history("2024-02-10", "2024-03-05")
    assert [r.price for r in scan.orderBy("record_date").collect()] == [3, 4]
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(record_month" in plan
    tables.replace_partitions(df.filter("record_month = '2024-02'").withColumn("price", F.lit(99)), "variant_daily_history")
    assert [r.price for r in tables.read("variant_daily_history").orderBy("record_date").collect()] == [0, 1, 99, 99, 4, 5]
    kept = K.keep_history(tables.read("variant_daily_history"), F.lit("2024-03-20").cast("timestamp"), 40)
    assert [r.price for r in kept.orderBy("record_date").collect()] == [99, 4, 5]
    tables.replace(tables.read("variant_daily_history").filter("price < 50"), "variant_daily_history")
    assert tables.read("variant_daily_history").count() == 4


def test_csv_export(spark, tmp_path):
    history = spark.createDataFrame([("v", dt.date(2024, 1, d), 1000 * d, 0.0, 0, 10.0) for d in (2, 1)],
                                    "variant_uid string, record_date date, price int, point_rate double, coupon_yen int, coupon_percent double")
    priced = H.priced_history(history)
    for layout, first, head in (("chart", "2024-01-01", "日付"), ("table", "2024-01-02", "取得日時")):
        out = str(tmp_path / layout)
        write_csv(priced, out, layout, single=True)
        (name,) = [f for f in os.listdir(out) if f.endswith(".csv")]
        lines = open(os.path.join(out, name), encoding="utf-8").read().splitlines()
        assert lines[0].startswith("﻿" + head) and lines[0].endswith("価格-ポイント-クーポン")
        assert lines[1].split(",")[0] == first and len(lines) == 3
    assert "2024-01-01,1000,40,960,100,860" in open(os.path.join(str(tmp_path / "chart"), [f for f in os.listdir(tmp_path / "chart") if f.endswith(".csv")][0])).read()
    write_csv(priced, str(tmp_path / "many"), by="variant_uid")
    assert os.path.isdir(tmp_path / "many" / "variant_uid=v")


def payloads(spark, low, high):
    made = []
    for i in range(low, high):
        event = {"user_id": f"u{i % 3}", "page_url": f"https://item.example.com/s{i % 2}/i{i % 5}/", "item_name": f"n{i % 4}", "price": 100 + (i // 10) % 3, "coupon_yen": 5}
        if i % 4 == 0:
            event["variants"] = [{"variant_code": "a", "price": 10 + i // 20}, {"variant_code": "b", "price": 20}]
        made.append((i, json.dumps(event), dt.datetime(2024, 1, 1) + dt.timedelta(hours=2 * i)))
    return spark.createDataFrame(made, "event_id long, payload string, received_at timestamp")


STABLE = {
    "shops": ["shop_code", "shop_name"], "items": ["product_uid", "item_name", "seen_in_ext", "ext_first_seen", "ext_view_count", "in_server_crawl", "is_active"],
    "variants": ["variant_uid", "jan_code"], "variant_snapshots": ["variant_uid", "price", "coupon_yen", "content_hash", "fetched_at", "source"],
    "variant_daily_history": ["variant_uid", "record_date", "price", "fetched_at"], "user_browse_events": ["event_id", "user_id", "variant_uid", "browsed_at"],
}


def state(tables):
    return {t: rows(tables.read(t).select(*c)) for t, c in STABLE.items()}


@pytest.fixture(scope="module")
def streamed(spark, tmp_path_factory):
    """A stream of three files, one of them with events of the file before."""
    root = tmp_path_factory.mktemp("stream")
    source = str(root / "in")
    payloads(spark, 0, 40).coalesce(1).write.mode("append").parquet(source)
    payloads(spark, 30, 80).coalesce(1).write.mode("append").parquet(source)
    payloads(spark, 80, 120).coalesce(1).write.mode("append").parquet(source)
    tables = Tables(spark, str(root / "tables"))
    stream = spark.readStream.schema("event_id long, payload string, received_at timestamp").option("maxFilesPerTrigger", 1).parquet(source)
    catalogue.start_browse(stream, tables, str(root / "cp"), late="2 days").awaitTermination()
    return tables


def test_stream_equals_batch(spark, streamed):
    offers = browse.event_offers(browse.parse_events(payloads(spark, 0, 120)), keep=("received_at", "event_id"))
    seen = H.with_hash(offers.withColumns({"variant_uid": F.concat_ws(":", "shop_code", "item_code", "variant_code"), "fetched_at": F.col("received_at"), "seq": F.struct("event_id", "variant_place")}))
    order = ["fetched_at", "seq"]
    changed = H.changed_only(seen, order)
    want = H.latest_snapshot(changed, order).select("variant_uid", "price", "coupon_yen", "content_hash", "fetched_at", "source")
    got = state(streamed)
    assert got["variant_snapshots"] == rows(want)
    assert got["variant_daily_history"] == rows(H.daily_history(changed, order).select("variant_uid", "record_date", "price", "fetched_at"))
    views = {r[0]: r[4] for r in got["items"]}
    assert sum(views.values()) == 120 and views["s0:i0"] == 12 and len(got["user_browse_events"]) == 120
    assert all(r[2] and r[5] and r[6] for r in got["items"])


def test_repeated_batch_changes_nothing(spark, streamed):
    before = state(streamed)
    last = max(r.merge_batch for r in streamed.read("items").select("merge_batch").collect())
    catalogue.merge_browse_batch(streamed, payloads(spark, 80, 120), last)
    assert state(streamed) == before
    catalogue.merge_browse_batch(streamed, payloads(spark, 120, 130), last + 1)
    assert sum(r.ext_view_count for r in streamed.read("items").collect()) == 130


def test_event_retention(spark, streamed):
    catalogue.trim_events(streamed, F.lit("2024-01-12").cast("timestamp"), 7)
    assert streamed.read("user_browse_events").agg(F.min("browsed_at").alias("m")).first().m >= dt.datetime(2024, 1, 5)


def stream_of_events(spark):
    kind = spark.read.parquet(f"{FOLDER}/events.parquet").schema
    e = spark.readStream.schema(kind).parquet(f"{FOLDER}/events*.parquet").filter("event_type in ('view', 'click')")
    return e.select("event_id", F.get_json_object("props", "$.k").alias("shop_code"), F.col("ts").alias("browsed_at"))


def test_sliding_stream_equals_batch(spark):
    flow = rankings.sliding_counts(stream_of_events(spark), key="event_id")
    q = flow.writeStream.format("memory").queryName("sliding").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = spark.read.parquet(f"{FOLDER}/events.parquet").filter("event_type in ('view', 'click')").select(
        F.get_json_object("props", "$.k").alias("shop_code"), F.col("ts").cast("timestamp").alias("browsed_at"))
    want = R.windowed_counts(batch)
    got = spark.table("sliding")
    done = got.agg(F.max("end").alias("e")).first().e
    assert rows(got) == rows(want.filter(F.col("end") <= F.lit(done)))
    ranked = rankings.ranked_windows(got)
    assert ranked.filter("rank_position = 1").count() == got.select("start").distinct().count()


def test_daily_ranking_stream(spark, tmp_path):
    tables = Tables(spark, str(tmp_path / "t"))
    rankings.start_rankings(stream_of_events(spark), tables, str(tmp_path / "cp")).awaitTermination()
    batch = spark.read.parquet(f"{FOLDER}/events.parquet").filter("event_type in ('view', 'click')").select(
        F.get_json_object("props", "$.k").alias("shop_code"), F.col("ts").alias("browsed_at"))
    want = R.rank_per_day(batch).select("ranking_date", "shop_code", "browse_count", "rank_position")
    got = tables.read("shop_rankings").select("ranking_date", "shop_code", "browse_count", "rank_position")
    done = got.agg(F.max("ranking_date").alias("d")).first().d
    assert rows(got) == rows(want.filter(F.col("ranking_date") <= F.lit(done))) and got.count() > 0


def test_stored_merge_stamps_rows_and_keeps_listings_out_of_variants(spark, tmp_path):
    tables = Tables(spark, str(tmp_path))

    def offers(day, *sources):
        parts = []
        for k, source in enumerate(sources):
            row = spark.createDataFrame([(dt.datetime(2024, 5, day), k)], "fetched_at timestamp, seq long")
            values = {"shop_code": F.lit("s"), "item_code": F.lit(f"i{k}"), "item_name": F.lit("n"), "price": F.lit(5)}
            parts.append(as_offers(row, source, values, keep=("fetched_at", "seq")))
        return union_offers(*parts)

    catalogue.merge_offers(tables, offers(3, "list", "detail"), 0)
    catalogue.merge_offers(tables, offers(9, "list", "api"), 1)
    assert [r.variant_uid for r in tables.read("variants").collect()] == ["s:i1:default"]
    for table, first in (("shops", "first_seen_at"), ("items", "created_at"), ("variants", "created_at")):
        assert {(r[first].day, r.updated_at.day) for r in tables.read(table).collect()} == {(3, 9)}
    assert all(r.updated_at is not None for r in tables.read("variant_snapshots").collect())


def test_only_touched_months_are_read(spark, tmp_path):
    tables = Tables(spark, str(tmp_path))
    days = spark.range(300).select(F.lit("v").alias("variant_uid"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("record_date"), F.col("id").alias("price"))
    tables.append(days, "variant_daily_history")  # the month is derived
    assert len(tables.partitions("variant_daily_history")) == 10
    seen = spark.createDataFrame([("v", 7, dt.datetime(2024, 3, 4), 1)], "variant_uid string, price long, fetched_at timestamp, seq long")
    stored = tables.read("variant_daily_history").select("variant_uid", "record_date", "price", "fetched_at", "record_month")
    months = H.touched_months(stored, seen, ["fetched_at", "seq"])
    assert {"2024-03"} == {r.record_month for r in months.select("record_month").distinct().collect()} and months.count() == 31
    plan = months._jdf.queryExecution().executedPlan().toString()
    assert "record_month" in plan and "= 2024-03" in plan.split("PartitionFilters:")[1].split("]")[0]
    catalogue.trim_history(tables, F.lit("2024-10-20").cast("timestamp"), 60)
    assert tables.partitions("variant_daily_history") == ["2024-08", "2024-09", "2024-10"]
    assert tables.read("variant_daily_history").agg(F.min("record_date")).first()[0] == dt.date(2024, 8, 21)


def test_observations_fall_on_their_day(spark, tmp_path):
    tables = Tables(spark, str(tmp_path))
    seen = spark.createDataFrame([("s:i", 4, dt.datetime(2024, 2, d, 23)) for d in (1, 2)], "product_uid string, observed_price long, observed_at timestamp")
    tables.append(seen, "list_observations")
    assert tables.partitions("list_observations") == ["2024-02-01", "2024-02-02"]
    with pytest.raises(ValueError):
        tables.append(seen.drop("observed_at"), "detail_observations")


def files_of(table):
    """Every data file of a bucketed table's version, by bucket."""
    out = {}
    for path in table.read().inputFiles():
        out.setdefault(int(path.split("bucket=")[1].split("/")[0]), set()).add(path)
    return out


def test_merges_read_and_write_touched_buckets_only(spark, tmp_path):
    tables = Tables(spark, str(tmp_path), buckets=8)

    def offers(items, day):
        row = spark.createDataFrame([(dt.datetime(2024, 5, day), i) for i in items], "fetched_at timestamp, seq long")
        code = F.concat(F.lit("i"), F.col("seq").cast("string"))
        return as_offers(row, "api", {"shop_code": F.lit("s"), "item_code": code, "item_name": F.lit(f"n{day}"), "price": F.lit(day)}, keep=("fetched_at", "seq"))

    catalogue.merge_offers(tables, offers(range(200), 1), 0)
    names = ("items", "variants", "variant_snapshots")
    before = {t: files_of(tables.bucketed(t)) for t in names}
    assert all(set(f) == set(range(8)) for f in before.values())
    # A batch of one item reads and writes one bucket of each table.
    seen, touched = tables.read_touched("items", spark.createDataFrame([("s:i7",)], "product_uid string"))
    assert len(touched) == 1 and {p.split("bucket=")[1].split("/")[0] for p in seen.inputFiles()} == {str(touched[0])}
    catalogue.merge_offers(tables, offers([7], 2), 1)
    for t in names:
        after = files_of(tables.bucketed(t))
        changed = [b for b in after if after[b] != before[t][b]]
        assert len(changed) == 1, t
        written = [n for n in os.listdir(tmp_path / t / "v2") if n.startswith("bucket=")]
        assert written == [f"bucket={changed[0]}"]
    assert {(r.item_code, r.item_name) for r in tables.read("items").collect()} == {(f"i{i}", "n2" if i == 7 else "n1") for i in range(200)}
    assert tables.read("variant_snapshots").filter("price = 2").count() == 1 and tables.read("variant_snapshots").count() == 200


def test_bucket_versions(spark, tmp_path):
    table = Tables(spark, str(tmp_path), buckets=4).bucketed("shops")
    rows_of = lambda *codes: C.conform(spark.createDataFrame([(c, c) for c in codes], "shop_code string, shop_name string"), "shops")
    assert not table.exists() and table.read().count() == 0
    assert table.write(rows_of(*"abcdefgh")) == 1
    held = table.read()
    (bucket,) = table.touched(rows_of("a"))
    # A reader of the last version goes on reading it while the next is written.
    assert table.write(table.read([bucket]).withColumn("shop_name", F.lit("new")), [bucket]) == 2
    assert {r.shop_name for r in held.collect()} == set("abcdefgh")
    assert {r.shop_code for r in table.read().filter("shop_name = 'new'").collect()} == {r.shop_code for r in table.read([bucket]).collect()}
    # Rows outside the named buckets, and a version that another writer has made, are errors.
    other = next(c for c in "bcdefgh" if table.touched(rows_of(c)) != [bucket])
    with pytest.raises(ValueError):
        table.write(rows_of("a", other), [bucket])
    assert table.manifest()["version"] == 2 and table.read().count() == 8
    with pytest.raises(Exception):
        table._commit(table.manifest())
    # A bucket without rows leaves the manifest; folders no manifest names are deleted.
    gone = table.read([bucket]).count()
    table.write(table.read([bucket]).limit(0), [bucket])
    assert bucket not in table.manifest()["holds"] and table.read().count() == 8 - gone
    table.write(rows_of("z"))
    table.write(rows_of("y"))
    assert len(table.versions()) == 2 and sorted(n for n in os.listdir(tmp_path / "shops") if n.startswith("v")) == ["v4", "v5"]


def test_view_runs_of_items(spark, tmp_path):
    """Three batches: redelivered events count once, an item away for longer than the idle
    time opens a new run, and runs add up."""
    from offerlens.session import session_settings
    from offerlens.streaming.views import STATE_STORE, start_views, view_counts

    kind = "event_id long, shop_code string, browsed_at timestamp"
    start = dt.datetime(2024, 1, 1)

    def batch(*events):
        made = [(i, shop, start + dt.timedelta(hours=h)) for i, shop, h in events]
        spark.createDataFrame(made, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    batch((1, "a", 0), (1, "a", 0), (2, "a", 0.5), (3, "b", 1), (4, None, 1))
    batch((5, "c", 10), (6, "c", 12), (6, "c", 12))
    batch((7, "a", 60), (8, "a", 61), (9, "c", 90))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with session_settings(spark, STATE_STORE):
        start_views(stream, str(tmp_path / "runs"), str(tmp_path / "cp"), idle_hours=24).awaitTermination()
    written = spark.read.parquet(str(tmp_path / "runs"))
    got = {r["item"]: (r.first_seen, r.last_seen, r.views) for r in view_counts(written).collect()}
    at = lambda h: start + dt.timedelta(hours=h)
    assert got == {"a": (at(0), at(61), 4), "b": (at(1), at(1), 1), "c": (at(10), at(12), 2)}  # the last hour isn't complete
    assert {r["item"]: r.n for r in written.groupBy("item").agg(F.countDistinct("run_start").alias("n")).collect()} == {"a": 2, "b": 1, "c": 1}
