"""Merge rules, repeated merges, and the pieces without a table of their own."""

import random

import pytest
from pyspark.sql import functions as F

from offerlens.operators import history as H
from offerlens.operators import jobs as B
from offerlens.operators import merge as M
from offerlens.operators import planning as P
from offerlens.operators import quality as Q
from offerlens.operators import search as S

ITEM = ("shop_code string, item_code string, api_item_code string, canonical_url string, item_name string, catchcopy string, genre_id string, "
        "seen_in_api boolean, seen_in_list boolean, seen_in_detail boolean, seen_in_ext boolean, ext_first_seen int, ext_view_count bigint, "
        "in_server_crawl boolean, seq int")


def batch(spark, seed, n=200, start=0):
    rng = random.Random(seed)
    pick = lambda *v: rng.choice(v)
    rows = [("s", f"i{rng.randrange(20)}", pick(None, "a", "b"), "u", pick(None, "x", "y"), pick(None, "c"), pick(None, "1", "2"), pick(True, False),
             pick(True, False), pick(True, False), pick(True, False), pick(None, start + i), pick(0, 1), pick(True, False), start + i) for i in range(n)]
    return spark.createDataFrame(rows, ITEM)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def one_by_one(given):
    """What upserts in order would leave."""
    table = {}
    for r in given:
        old = table.setdefault((r.shop_code, r.item_code), {})
        for c, rule in M.ITEM_RULES.items():
            new, had = r[c], old.get(c)
            if rule == M.LATEST:
                old[c] = new if new is not None else had
            elif rule == M.FIRST:
                old[c] = had if had is not None else new
            elif rule == M.ANY:
                old[c] = bool(had) or bool(new)
            else:
                old[c] = (had or 0) + new
    return sorted(((*k, *(v[c] for c in M.ITEM_RULES)) for k, v in table.items()), key=repr)


def test_item_merge_equals_one_by_one(spark):
    a, b = batch(spark, 1), batch(spark, 2, start=1000)
    both = a.unionByName(b)
    want = one_by_one(sorted(both.collect(), key=lambda r: r.seq))
    shown = ["shop_code", "item_code", *M.ITEM_RULES]
    assert rows(M.merge_items(None, both).select(*shown)) == want
    assert rows(M.merge_items(M.merge_items(None, a), b).select(*shown)) == want


def test_item_merge_once_can_be_repeated(spark):
    stored = M.merge_items(None, batch(spark, 1)).withColumns({"merge_batch": F.lit(1).cast("bigint"), "is_active": F.lit(True)})
    fresh = batch(spark, 2, start=1000)
    once = M.merge_items_once(stored, fresh, 2)
    assert rows(M.merge_items_once(once, fresh, 2)) == rows(once)
    shown = ["shop_code", "item_code", *M.ITEM_RULES]
    assert rows(once.select(*shown)) == rows(M.merge_items(stored, fresh).select(*shown))


STATE = "variant_uid string, price int, coupon_yen int, fetched_at int, seq int"


def test_snapshot_batches_equal_their_union(spark):
    rng = random.Random(9)
    made = [(f"v{rng.randrange(6)}", rng.choice([None, 1, 2]), rng.choice([None, 5]), i, i) for i in range(300)]
    obs = H.with_hash(spark.createDataFrame(made, STATE))
    order = ["fetched_at", "seq"]
    table, count = obs.limit(0), 0
    for low in range(0, 300, 100):
        part = obs.filter((F.col("seq") >= low) & (F.col("seq") < low + 100))
        table, new = H.upsert_snapshots(table, part, order)
        count += new.count()
    last, want = {}, 0
    for uid, price, coupon, at, seq in made:
        if uid not in last or last[uid][:2] != (price, coupon):
            want, last[uid] = want + 1, (price, coupon, at)
    assert count == want
    assert {r.variant_uid: (r.price, r.coupon_yen, r.fetched_at) for r in table.collect()} == last
    again, new = H.upsert_snapshots(table, H.latest_snapshot(obs, order), order)
    assert new.count() == 0 and rows(again) == rows(table)


def test_targets(spark):
    kind = "id long, target_type string, target_value string, base_url string, is_active boolean, priority int, added_by string, last_crawled_at string, updated_at string"
    stored = spark.createDataFrame([(1, "shop", "a", "old", False, 120, "manual", None, None), (2, "genre", "g", None, True, 5, "manual", "t0", None)], kind)
    wanted = spark.createDataFrame([("shop", "a", None, 7), ("shop", "b", "new", 3)], "target_type string, target_value string, base_url string, priority int")
    got = {r.target_value: r for r in M.add_targets(stored, wanted).collect()}
    assert (got["a"].base_url, got["a"].priority, got["a"].is_active, got["a"].id) == ("old", 7, True, 1)
    assert (got["b"].base_url, got["b"].priority, got["b"].added_by) == ("new", 3, "manual") and got["g"].priority == 5
    ranked = spark.createDataFrame([("shop", "a", "u", True, 100, "auto_ranking", "t1"), ("shop", "c", "u", True, 100, "auto_ranking", "t1")],
                                   "target_type string, target_value string, base_url string, is_active boolean, priority int, added_by string, updated_at string")
    got = {r.target_value: r for r in M.add_ranked_targets(stored, ranked).collect()}
    assert (got["a"].priority, got["a"].added_by, got["a"].base_url, got["a"].updated_at) == (120, "manual", "old", "t1")
    assert (got["c"].priority, got["c"].added_by, got["c"].base_url) == (100, "auto_ranking", "u")


def slices_by_recursion(prices, cap):
    out = []

    def go(lo, hi):
        n = sum(lo <= p <= hi for p in prices)
        if n <= cap or lo == hi:
            out.append((lo, hi, n, n > cap))
        else:
            mid = (lo + hi) // 2
            go(lo, mid)
            go(mid + 1, hi)

    go(1, max(prices))
    return sorted(out)


@pytest.mark.parametrize("cap", [1, 10, 200, 100_000])
def test_price_slices_equal_recursion(spark, cap):
    rng = random.Random(cap)
    prices = [rng.choice([7, 7, 7, rng.randrange(1, 20), rng.randrange(1, 3_000_000)]) for _ in range(800)]
    df = spark.createDataFrame([("g", p) for p in prices] + [("h", 5), ("h", None)], "genre_id string, price bigint")
    got = P.price_slices(df, cap=cap)
    assert rows(got.filter("genre_id = 'g'").drop("genre_id")) == sorted(slices_by_recursion(prices, cap), key=repr)
    # Slices lie side by side from 1 to the highest price and hold all rows.
    mine = sorted(got.filter("genre_id = 'g'").collect(), key=lambda r: r.min_price)
    assert mine[0].min_price == 1 and mine[-1].max_price == max(prices)
    assert all(a.max_price + 1 == b.min_price for a, b in zip(mine, mine[1:]))
    assert sum(r.estimated_count for r in mine) == len(prices)


def test_frontiers(spark):
    df = spark.createDataFrame([("a", 0, False), ("b", 0, True), ("c", 46, True), ("d", 999_999, True), ("e", None, False)], "genre_id string, total_found int, has boolean")
    pages = P.page_frontier(df, most=150, has_rows=F.col("has")).groupBy("genre_id").count().collect()
    assert {r.genre_id: r["count"] for r in pages} == {"b": 150, "c": 2, "d": 150}
    # Without a limit known totals stay whole, and unknown ones are no pages or an error.
    whole = P.page_frontier(df).groupBy("genre_id").count().collect()
    assert {r.genre_id: r["count"] for r in whole} == {"c": 2, "d": 22223}
    with pytest.raises(ValueError):
        P.page_frontier(df, has_rows=F.col("has"))
    edges = spark.createDataFrame([(0, 1), (0, 2), (1, 11), (11, 111)], "parent_id int, child_id int")
    depth = lambda d: sorted(r.genre_id for r in P.genre_frontier(edges, 0, d).collect())
    assert [depth(d) for d in (0, 1, 2, 3, 9)] == [[0], [1, 2], [2, 11], [2, 111], [2, 111]]


def test_genre_closure_ends_on_cycles(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 1), (3, 0), (0, 3), (5, 6), (0, 1)], "parent_id int, child_id int")
    assert {r.genre_id: r.depth for r in P.genre_closure(edges, 0).collect()} == {0: 0, 1: 1, 2: 2, 3: 1}
    long = spark.range(40).selectExpr("cast(id as int) as parent_id", "cast(id + 1 as int) as child_id")
    assert P.genre_closure(long, 0).agg(F.max("depth")).first()[0] == 40
    assert [tuple(r) for r in P.genre_closure(edges, 9).collect()] == [(9, 0)]


def test_new_jobs_and_repair(spark):
    jobs = spark.createDataFrame([("detail_scrape", "u1", "pending"), ("detail_scrape", "u2", "done"), ("list_scrape", "u3", "running")],
                                 "job_type string, target_url string, status string")
    found = spark.createDataFrame([("u1", "p1"), ("u2", "p2"), ("u2", "p1"), ("u3", "p3")], "target_url string, product_uid string")
    assert sorted((r.target_url, r.product_uid) for r in B.new_jobs(found, jobs).collect()) == [("u2", "p1"), ("u3", "p3")]


def test_keyset_pages_cover_everything(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(f"v{i:03d}", rng.choice([None, 1, 2, 3])) for i in range(97)], "variant_uid string, price int")
    for down in (False, True):
        want = df.orderBy(*S.sort_order("price_desc" if down else "price_asc")).collect()
        got, page = [], want[:10]
        while page:
            got += page
            page = S.after_key(df, page[-1].price, page[-1].variant_uid, 10, down).collect()
        assert got == want


@pytest.mark.parametrize("sort_by,column,kind,values", [
    ("updated", "fetched_at", "string", [None, "2024-01-01", "2024-01-02"]), ("effective", "effective_price", "int", [None, 5, 6]),
    ("name", "item_name", "string", [None, "étui", "Etui", "ETUI", "lamp", "Lamp"])])
def test_keyset_pages_cover_everything_in_all_orders(spark, sort_by, column, kind, values):
    rng = random.Random(9)
    df = spark.createDataFrame([(f"v{i:03d}", rng.choice(values)) for i in range(61)], f"variant_uid string, {column} {kind}")
    want = df.orderBy(*S.sort_order(sort_by)).collect()
    got, page = [], want[:9]
    while page:
        got += page
        page = S.after_key(df, page[-1][column], page[-1].variant_uid, 9, sort_by=sort_by).collect()
    assert got == want
    with pytest.raises(ValueError):
        S.after_key(df, None, "v", 9, sort_by="colour")


def test_names_without_regard_to_case_and_accents(spark):
    df = spark.createDataFrame([("Étui Rouge",), ("etui",), ("ﾃﾞﾆﾑ",), ("デニム パンツ",), ("50% off",)], "item_name string")
    hits = lambda c: sorted(r.item_name for r in df.filter(c).collect())
    assert hits(S.name_contains("item_name", "ÉTUI")) == ["etui", "Étui Rouge"]
    assert "デニム パンツ" in hits(S.name_contains("item_name", "デニム"))
    assert hits(S.name_contains("item_name", "0%", None)) == ["50% off"]
    assert hits(S.name_like("item_name", "e_ui")) == ["etui"]


def test_report_and_variant_json(spark):
    df = spark.createDataFrame([("PASS",), ("PASS",), ("WARN",), ("FAIL",)], "status string")
    r = Q.report(df).first()
    assert (r.passed, r.warnings, r.failed, r.score, r.ok) == (2, 1, 1, 50.0, False)
    text = '[{"variantId":"1","jan":"49","price":10,"stock":0},{"variantId":"2","jan":null,"price":null,"stock":null}]'
    v = Q.variant_json_coverage(spark.createDataFrame([(text,), (None,)], "variant_data_json string")).orderBy(F.desc_nulls_last("variants")).collect()
    assert tuple(v[0])[1:] == (2, 1, 1, 1) and tuple(v[1])[1:] == (None, None, None, None)
