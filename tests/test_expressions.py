"""Fixed cases and independent recomputation of the column expressions."""

import math
import random
from urllib.parse import parse_qs, urlencode, urlparse

import pytest
from pyspark.sql import functions as F

from offerlens.fixed import TRACKING_PARAMS
from offerlens.functions import display as Y
from offerlens.functions import keys as K
from offerlens.functions import price as P
from offerlens.functions import sql as Q
from offerlens.functions import text as X
from offerlens.functions import url as U


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def best_coupon(price, yen, percent):
    """The rule by hand, in whole yen."""
    return max(yen or 0, math.floor((price or 0) * (percent or 0.0) / 100))


@pytest.mark.parametrize("mode", P.MODES)
def test_net_price_has_its_laws(spark, mode):
    """Laws that hold for any offer, on seeded ones: no reductions leave the price; the
    larger coupon counts; points grow with the multiplier; net is what is left."""
    rng = random.Random(29)
    rows = [(i, rng.randrange(1, 80_000), rng.randrange(0, 15) / 2, rng.choice([None, 0.0, 8.0, 25.0]), rng.choice([None, 0, rng.randrange(1, 900)]), rng.choice([None, 0.0, rng.randrange(1, 60) / 2]))
            for i in range(200)] + [(900, None, 4.5, None, 70, 0.0), (901, 12_345, 0.0, None, None, None)]
    df = spark.createDataFrame(rows, "n int, price int, point_rate double, point_back_percent double, coupon_yen int, coupon_percent double")
    low, high, under = (df.select("*", P.offer_value(multiplier=m, mode=mode).alias("v")).orderBy("n").collect() for m in (1.0, 6.0, -5.0))
    assert [r.v for r in under] == [r.v for r in low]  # a multiplier outside its range counts as the nearest in it
    for a, b in zip(low, high):
        price, coupon = a.price or 0, best_coupon(a.price, a.coupon_yen, a.coupon_percent)
        assert a.v.effective_coupon == b.v.effective_coupon == coupon
        assert a.v.total_points <= b.v.total_points and a.v.effective_price >= b.v.effective_price
        assert a.v.price_minus_points == price - a.v.total_points
        if not a.point_back_percent and not a.point_rate and not coupon:
            assert a.v.total_points == price // 100 and a.v.effective_price == price - a.v.total_points
        if not a.point_back_percent and a.price is not None:
            assert a.v.effective_price == price - a.v.total_points - coupon


def test_sql_functions_agree_with_columns(spark):
    Q.register(spark)
    rng = random.Random(3)
    rows = [(rng.choice([None, rng.randrange(0, 50000)]), rng.choice([None, rng.randrange(0, 20) / 2]), rng.choice([None, 0.0, 20.0, 12.5]),
             rng.choice([None, rng.randrange(0, 500)]), rng.choice([None, rng.randrange(0, 60) / 2])) for _ in range(300)]
    df = spark.createDataFrame(rows, "price int, point_rate double, point_back_percent double, coupon_yen bigint, coupon_percent double")
    df.createOrReplaceTempView("p")
    for mode in P.MODES:
        got = spark.sql(f"SELECT ol_net_{mode}(price, point_rate, point_back_percent, coupon_yen, coupon_percent, 4D) AS v FROM p").collect()
        want = df.select(P.net_price(mode).alias("v")).collect()
        assert got == want
    texts = spark.sql("SELECT ol_price_from_text('¥7,650') a, ol_valid_jan('4577700012345') b, ol_valid_jan('x') c, ol_variant_uid('s','i','') d, "
                      "ol_free_shipping('送料込み / x') e, ol_record_date(timestamp_ntz'2024-01-01 20:00:00','Asia/Tokyo') f, ol_clamp_multiplier(200D) g").first()
    assert (texts.a, texts.b, texts.c, texts.d, texts.e, str(texts.f), texts.g) == (7650, "4577700012345", None, "s:i:default", True, "2024-01-02", 100.0)


def expected_url(url, drop_variant=True):
    parts = urlparse(url)
    params = parse_qs(parts.query, keep_blank_values=False)
    if drop_variant:
        params.pop("variantId", None)
    kept = {k: v for k, v in params.items() if k.lower() not in TRACKING_PARAMS}
    out = f"{parts.scheme}://{(parts.hostname or '').lower()}{parts.path.rstrip('/')}/"
    return out + ("?" + urlencode(kept, doseq=True) if kept else "")


def urls():
    rng = random.Random(11)
    names = ["rafcid", "SCID", "variantId", "a", "b", "s-id", "日本", "x y", "a", "%41", "l-id", "p~q", ""]
    values = ["1", "", "a b", "a+b", "%E3%83%9F%E3%83%AB%E3%82%AF", "~*", "x=y", "%zz", "日本語", "a/b", "%26"]
    out = ["https://item.example.com/shop/123/", "http://HOST.example.com:8080/a//b///?x=1#frag?y=2", "https://user:pw@h.example.com/p;v=1?a=1",
           "", "no scheme at all", "//h/p?a=1", "https://h", "https://h?variantId=9", "mailto:x?y=1", "https://h/a;b/c;d?x", "  https://h/p?q=1 ",
           "https://h/p\n/q?a=\t1"]
    for _ in range(400):
        query = "&".join(f"{rng.choice(names)}={rng.choice(values)}" if rng.random() < 0.85 else rng.choice(names) for _ in range(rng.randrange(0, 6)))
        out.append(f"https://It{rng.randrange(3)}.Example.com{rng.choice(['', ':443'])}/s{rng.randrange(5)}/{rng.randrange(99)}{rng.choice(['', '/', '//'])}"
                   + (f"?{query}" if query else "") + rng.choice(["", "#top", "#"]))
    return out


def test_urls_follow_the_rule(spark):
    given = urls()
    df = spark.createDataFrame([(u,) for u in given], "u string")
    rows = df.select("u", U.canonical_url("u").alias("c"), U.clean_tracking("u").alias("t"), U.url_variant_id("u").alias("v")).collect()
    for r in rows:
        assert r.c == expected_url(r.u), r.u
        assert r.t == expected_url(r.u, False), r.u
        assert r.v == (parse_qs(urlparse(r.u).query).get("variantId") or [None])[0]


def test_codes_and_search_urls(spark):
    rng = random.Random(41)
    made = [(f"kura{rng.randrange(99)}", f"{rng.choice('abz')}{rng.randrange(10_000)}", rng.choice(["", "v1", "大-2"])) for _ in range(40)]
    df = spark.createDataFrame(made, "shop string, item string, variant string")
    url = F.concat(F.lit("https://shop.example.net/"), "shop", F.lit("/"), "item", F.lit("/?q=1"))
    for r in df.select("*", U.shop_item_code(url).alias("pair"), U.store_code(url).alias("store"), U.parse_api_item_code(F.concat("shop", F.lit(":"), "item")).alias("api"),
                       U.variant_uid(F.col("shop"), F.col("item"), F.nullif("variant", F.lit(""))).alias("uid"),
                       U.shop_from_search_url(F.concat(F.lit("https://s.example.net/mall/?p=3&sid="), "shop")).alias("sid"), U.search_url(shop_code=F.col("shop")).alias("search"),
                       U.search_url(genre_id="77001", keyword=F.col("item"), min_price=0, max_price=8_800, page=5, sort="4").alias("wide")).collect():
        assert tuple(r.pair) == tuple(r.api) == (r.shop, r.item) and r.store == r.sid == r.shop
        assert r.uid == f"{r.shop}:{r.item}:{r.variant or 'default'}"
        base = "https://search.example.com/search/mall/"
        assert r.search == f"{base}?sid={r.shop}" and r.wide == f"{base}{r.item}/77001/?min=0&max=8800&s=4&p=5"
    assert one(spark, U.shop_item_code(F.lit("https://shop.example.net/lonely"))) is None
    assert one(spark, U.parse_api_item_code(F.lit("bare"))) == ("", "bare")
    assert one(spark, U.search_url(genre_id="77001", page=1)) == "https://search.example.com/search/mall/-/77001/"


def test_built_texts_read_back(spark):
    """What the builders write, the readers understand."""
    rng = random.Random(43)
    rows = [(rng.randrange(1, 40_000), rng.random() < 0.4, rng.randrange(2, 40) / 2, rng.randrange(1, 4), rng.choice([None, rng.randrange(1, 9)]), rng.choice([None, rng.randrange(1, 9)]),
             rng.randrange(1, 5_000), rng.choice(["exact", "percentage"])) for _ in range(120)]
    df = spark.createDataFrame(rows, "points int, back boolean, rate double, base int, shop int, up int, off int, kind string")
    none = F.lit(None).cast("int")
    text = X.point_text(F.col("points"), F.col("back"), F.col("rate"), F.col("base"), F.col("shop"), F.col("up"), none, none)
    for r in df.select("*", text.alias("text"), X.card_points(text).alias("p"), X.card_coupon(X.coupon_text(F.col("off"), F.col("kind"))).alias("c"),
                       X.price_from_text(F.concat(F.lit("税込 "), F.format_number("points", 0), F.lit(" 円"))).alias("price")).collect():
        assert r.p[0] == r.points == r.price and tuple(r.c) == (r.off, r.kind)
        if r.back:
            assert tuple(r.p)[1:3] == (True, r.rate)
        else:
            more = (r.shop or 0) + (r.up or 0)
            assert tuple(r.p)[1:5] == (False, None, r.base, more or None) and r.p[5] == r.base + more
    assert one(spark, X.point_text(none, F.lit(False), none, F.lit(2), none, none, none, none)) is None
    assert one(spark, X.coupon_text(none, F.lit("exact"))) is None


def test_texts_by_hand(spark):
    for text, want in (("〜 6,410 円", 6410), ("", None), ("応相談", None), ("９０７円", 907)):
        assert one(spark, X.price_from_text(F.lit(text))) == want
    for text, want in (("翌日着", (1, 1)), ("4日以内に出荷", (1, 4)), ("3～9日で出荷", (3, 9)), ("翌日 2～7日", (2, 7)), ("近日", (None, None))):
        assert one(spark, X.shipping_days(F.lit(text))) == want
    best = X.best_point_rate(F.array(F.lit("12ポイント(2倍)"), F.lit("44ポイント(2倍+5倍UP)"), F.lit("18%ポイントバック"), F.lit("")))
    assert one(spark, best) == (7.0, 18.0)
    assert one(spark, X.page_coupon(F.array(F.lit("310円OFF"), F.lit("2,050円クーポン 6%")), F.lit(""))) == (2050, 6.0)
    assert one(spark, X.page_coupon(F.array().cast("array<string>"), F.lit('{"coupon": {"discount": 640, "discountType": "exact"'))) == (640, None)
    for title, want in (("〔市〕急須 : 朝市", "急須"), ("急須 : 赤 : 朝市", "急須 : 赤"), ("急須", "急須"), (" 急須 :朝市", "急須")):
        assert one(spark, X.title_name(F.lit(title), "〔市〕")) == want
    for code, want in (("4577700012345", "4577700012345"), ("457770001234", "457770001234"), ("45777", None), ("45777000x2345", None)):
        assert one(spark, X.valid_jan(F.lit(code))) == want


def attrs(*pairs):
    return F.array(*[F.struct(F.lit(t).alias("title"), F.lit(v).alias("value")) for t, v in pairs])


@pytest.mark.parametrize("pairs,want", [
    ((("ブランド名", "Nami"), ("カラー", "藍")), ("ブランド", "Nami", "カラー", "藍")),
    ((("メーカー型番", "Q-7"),), ("メーカー", "Q-7", "review_rating", "2.5")),
    ((("ブランド", "Nami"), ("メーカー型番", "Q-7")), ("ブランド", "Nami", "型番", "Q-7")),
    ((("ブランド", ""), ("シリーズ名", "浜"), ("型番", "-")), ("シリーズ", "浜", "review_rating", "2.5")),
    ((("重さ", "2kg"),), ("review_count", "6", "review_rating", "2.5")),
])
def test_extra_fields(spark, pairs, want):
    assert tuple(one(spark, X.extra_fields(attrs(*pairs), F.lit("6"), F.lit("2.5")))) == want


def test_page_class(spark):
    pad = "x" * 2000
    cases = [("short", "short"), (pad, "ok"), ("Just a moment" + pad, "blocked"), (pad * 3 + "access denied", "blocked"),
             ("Access Denied __INITIAL_STATE__" + pad, "ok")]
    from offerlens.sources.list_pages import page_class

    got = spark.createDataFrame([(h,) for h, _ in cases], "html string").select(page_class().alias("c")).collect()
    assert [r.c for r in got] == [c for _, c in cases]


def test_display_and_keys(spark):
    ts = lambda s: F.lit(s).cast("timestamp_ntz")
    now = ts("2024-05-01 12:00:00")
    for at, want in (("2024-05-01 11:59:30", "たった今"), ("2024-05-01 11:18:00", "42分前"), ("2024-05-01 06:00:00", "6時間前"), ("2024-04-28 11:00:00", "3日前")):
        assert one(spark, Y.age(ts(at), now)) == want
    assert one(spark, Y.yen(F.lit(12345))) == "¥12,345" and one(spark, Y.yen(F.lit(None).cast("int"))) == "---"
    assert one(spark, Y.points(F.lit(1234))) == "1,234pt"
    assert one(spark, Y.truncated(F.lit("abcdef"), 3)) == "abc..." and one(spark, Y.truncated(F.lit(None).cast("string"), 3)) == ""
    n = F.lit(None).cast("int")
    assert [one(spark, Y.shipping_range(a, b)) for a, b in ((F.lit(1), F.lit(3)), (F.lit(2), F.lit(2)), (n, F.lit(4)), (F.lit(5), n), (n, n))] == ["1〜3日", "2日", "4日", "5日", "---"]
    assert str(one(spark, K.record_date(ts("2024-01-01 16:00:00"), "Asia/Tokyo"))) == "2024-01-02"
    assert one(spark, K.id_list(F.lit("1, 2,3"))) == [1, 2, 3]
    assert one(spark, K.id_list(F.lit("1,x"))) is None and one(spark, K.id_list(F.lit(""))) is None
    assert one(spark, K.id_list(F.lit(",".join(map(str, range(21)))))) is None
    a = spark.createDataFrame([(5, 5.0)], "price int, point_rate double")
    b = spark.createDataFrame([(5, "5")], "price bigint, point_rate string").withColumn("point_rate", F.col("point_rate").cast("decimal(5,1)"))
    c = spark.createDataFrame([(5, None)], "price int, point_rate double")
    h = [df.select(K.content_hash(df.columns).alias("h")).first().h for df in (a, b, c)]
    assert h[0] == h[1] != h[2] and len(h[0]) == 64
    assert one(spark, P.clamp_multiplier(0.5)) == 1.0
    assert math.isclose(one(spark, P.clamp_multiplier(7.5)), 7.5)


def test_an_address_taken_apart_once_gives_the_same_parts(spark):
    urls = [None, "", "https://item.example.com/a/b/?variantId=7&x=1&x=2&utm_source=q#f", "//host/a/b", "/a/b;c/?variantId=", "HTTP://U:P@H.example.com:80/a/b;c",
            "https://item.example.com/a", "  https://item.example.com//a//b//?q=%E3%81%82+z&variantId=%20", "not an address", "https://h/a/b?variantId=1&variantId=2"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    got = df.select(U.item_address("u").alias("a"), U.canonical_url("u").alias("c"), U.url_variant_id("u").alias("v"), U.shop_item_code("u").alias("s")).collect()
    for r in got:
        a = r.a or (None, None, None)
        assert (a[0], a[1], a[2]) == (r.c, r.v, r.s)


def test_addresses_by_steps_are_those_of_the_expression(spark):
    """Columns made in steps hold what the one expression gives, odd addresses included."""
    import random

    from pyspark.sql import functions as F

    from offerlens.functions import url as U

    r = random.Random(3)
    names = ["rafcid", "SCID", "variantId", "variant%49d", "variantid", "color", "a", "ta%67", "tag", "ref+", "x", "", "%zz", "é", "pf"]
    values = ["1", "", "a%20b", "a+b", "x=y", "%E3%81", "é", "*~", "%", "1&&", "a;b"]

    def query():
        return "&".join(r.choice(names) + r.choice(["=", "=", "", "=="]) + r.choice(values) for _ in range(r.randint(0, 4)))

    urls = [r.choice(["https://", "HTTP://", "//", "", " ftp+x://", "1a://"]) + r.choice(["ITEM.example.com:443", "u@h.com", "", "a:b@c:80"])
            + r.choice(["/a/b", "/a/b/", "//a//b;x", "", "/a;b/c;d", "/é/ü"]) + r.choice(["", "?", "?" + query(), "?" + query(), "#f?x=1"]) for _ in range(3000)]
    df = spark.createDataFrame([(i, u) for i, u in enumerate([*urls, None, ""])], "i int, url string")
    steps = U.with_clean_address(U.with_item_address(df, "a", "url"), "c", "url")
    assert steps.columns == ["i", "url", "a", "c"]
    both = steps.select("url", "a", U.item_address("url").alias("b"), "c", U.clean_tracking("url").alias("d"))
    assert both.count() == 3002
    assert both.filter(~(F.col("a").eqNullSafe(F.col("b")) & F.col("c").eqNullSafe(F.col("d")))).collect() == []
