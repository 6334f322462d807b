"""Reading numbers out of page texts and writing them back, as native columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.fixed import BLOCK_SIGNS, FREE_SHIPPING_SIGNS, SHIPPING_INCLUDED, SHORT_PAGE_CHARS

# Patterns of the shown texts.
POINT_COUNT = r"([\d,]+)\s*ポイント"
POINT_BACK = r"(\d+(?:\.\d+)?)\s*%\s*ポイントバック"
CARD_BASE, CARD_UP = r"\((\d+)倍", r"\+(\d+)倍(?:UP|up|アップ)"
PAGE_BASE = r"\((\d+(?:\.\d+)?)\s*倍"
PAGE_UP = r"\+(\d+(?:\.\d+)?)\s*倍\s*(?:UP|up|アップ)"
PAGE_PLAIN = r"\+?\s*(\d+(?:\.\d+)?)\s*倍"
CARD_YEN_OFF, CARD_PERCENT_OFF = r"([\d,]+)\s*円OFF", r"(\d+)\s*%OFF"
PAGE_YEN, PAGE_PERCENT = r"(\d[\d,]*)\s*円", r"(\d+(?:\.\d+)?)\s*%"
COUPON_JSON = r'"coupon"\s*:\s*\{\s*"discount"\s*:\s*(\d+)\s*,\s*"discountType"\s*:\s*"(\w+)"'
DAYS_WITHIN, DAYS_RANGE = r"(\d+)\s*日以内", r"(\d+)\s*[～~-]\s*(\d+)\s*日"
JAN = r"^\d{12,13}$"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _ascii_digits(text) -> Column:
    """Full-width digits count as digits."""
    return F.translate(_col(text), "０１２３４５６７８９", "0123456789")


def found(text, pattern: str, group: int = 1) -> Column:
    """One group of the first match, NULL without a match."""
    return F.nullif(F.regexp_extract(_col(text), pattern, group), F.lit(""))


def whole(text) -> Column:
    return F.replace(_col(text), F.lit(","), F.lit("")).try_cast("bigint")


def price_from_text(text) -> Column:
    return F.nullif(F.regexp_replace(_ascii_digits(text), r"[^0-9]", ""), F.lit("")).try_cast("bigint")


def let(value: Column, body) -> Column:
    """Bind a value once for use at several places of an expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """A further column whose value is worked out once a row. A filter or a projection
    above would repeat the work: the optimizer writes a column's expression into each place
    that asks for it, and moves filters below it. It does neither below an explode."""
    rest = [f"`{c}`" for c in df.columns if c != name]
    return df.withColumn("_once", value).select(*rest, F.explode(F.array("_once")).alias(name))


def _or_zero(col: Column) -> Column:
    return F.coalesce(col, F.lit(0))


def card_points(text) -> Column:
    """Point text of a listing card → count, point back, multipliers."""
    def read(t):
        return F.struct(
            whole(found(t, POINT_COUNT)).alias("n"), found(t, POINT_BACK).try_cast("double").alias("back"),
            found(t, CARD_BASE).try_cast("int").alias("base"), found(t, CARD_UP).try_cast("int").alias("up"))

    def shaped(r):
        plain = r["back"].isNull()
        total = _or_zero(r["base"]) + _or_zero(r["up"])
        return F.struct(
            r["n"].alias("point_count"), r["back"].isNotNull().alias("is_point_back"), r["back"].alias("point_back_rate"),
            F.when(plain, r["base"]).alias("point_base_multiplier"), F.when(plain, r["up"]).alias("point_up_multiplier"),
            F.when(plain & (total > 0), total).alias("point_total_multiplier"))

    return let(let(_ascii_digits(text), read), shaped)


def point_rate_from_text(text) -> Column:
    """(rate, back) of one point text of a detail page; point back wins."""
    def read(t):
        number = lambda pattern: found(t, pattern).try_cast("double")
        return F.struct(number(POINT_BACK).alias("back"), (_or_zero(number(PAGE_BASE)) + _or_zero(number(PAGE_UP))).alias("sum"),
                        number(PAGE_PLAIN).alias("plain"))

    def shaped(r):
        rate = F.when(r["sum"] != 0, r["sum"]).otherwise(r["plain"])
        return F.struct(F.when(r["back"].isNull() & (rate > 0), rate).alias("point_rate"), r["back"].alias("point_back_percent"))

    return let(let(_ascii_digits(text), read), shaped)


def best_point_rate(texts) -> Column:
    """Highest rate and highest point back over an array of texts."""
    return let(F.transform(texts, point_rate_from_text), lambda read: F.struct(
        F.array_max(F.transform(read, lambda r: r["point_rate"])).alias("point_rate"),
        F.array_max(F.transform(read, lambda r: r["point_back_percent"])).alias("point_back_percent"),
    ))


def card_coupon(text) -> Column:
    def read(t):
        return F.struct(whole(found(t, CARD_YEN_OFF)).alias("yen"), found(t, CARD_PERCENT_OFF).try_cast("bigint").alias("percent"))

    def shaped(r):
        kind = F.when(r["yen"].isNotNull(), F.lit("exact")).when(r["percent"].isNotNull(), F.lit("percentage"))
        return F.struct(F.coalesce(r["yen"], r["percent"]).alias("coupon_discount"), kind.alias("coupon_type"))

    return let(let(_ascii_digits(text), read), shaped)


def page_coupon(texts, html) -> Column:
    """Highest fixed and percentage coupon over the page's coupon texts and an
    embedded coupon object."""
    html = _col(html)
    # The pattern is only tried on pages that name a coupon object at all.
    embedded = F.when(html.contains('"coupon"'), F.struct(
        found(html, COUPON_JSON, 2).alias("kind"), found(html, COUPON_JSON, 1).try_cast("bigint").alias("amount")))

    def shaped(e):
        yen = F.array_max(F.transform(texts, lambda t: whole(found(_ascii_digits(t), PAGE_YEN))))
        percent = F.array_max(F.transform(texts, lambda t: found(_ascii_digits(t), PAGE_PERCENT).try_cast("double")))
        return F.struct(
            F.greatest(yen, F.when(e["kind"] == "exact", e["amount"])).try_cast("int").alias("coupon_yen"),
            F.greatest(percent, F.when(e["kind"] == "percentage", e["amount"].try_cast("double"))).alias("coupon_percent"))

    return let(embedded, shaped)


def _grouped(number: Column) -> Column:
    return F.format_number(number, 0)


def point_text(count, is_back, back_rate, base, shop, up, deal, item) -> Column:
    """'780ポイント(1倍+9倍UP)' or '2,520ポイント(20%ポイントバック)'."""
    count = _col(count)
    back = _col(back_rate).try_cast("double")
    back_shown = F.when(back == F.floor(back), F.floor(back).cast("string")).otherwise(back.cast("string"))
    extra = [_col(x).try_cast("int") for x in (shop, up, deal, item)]
    extra_sum = sum((F.when(x > 0, x).otherwise(F.lit(0)) for x in extra[1:]), F.when(extra[0] > 0, extra[0]).otherwise(F.lit(0)))
    inner = F.concat(
        F.coalesce(F.concat(_col(base).try_cast("int").cast("string"), F.lit("倍")), F.lit("")),
        F.when(extra_sum > 0, F.concat(F.lit("+"), extra_sum.cast("string"), F.lit("倍UP"))).otherwise(F.lit("")),
    )
    head = F.concat(_grouped(count), F.lit("ポイント"))
    return (
        F.when(count.isNull(), F.lit(None).cast("string"))
        .when(
            F.coalesce(_col(is_back), F.lit(False)) & F.coalesce(back != 0, F.lit(False)),
            F.concat(head, F.lit("("), back_shown, F.lit("%ポイントバック)")),
        )
        .when(inner != "", F.concat(head, F.lit("("), inner, F.lit(")")))
        .otherwise(head)
    )


def coupon_text(discount, kind) -> Column:
    discount, kind = _col(discount), _col(kind)
    plain = discount.cast("string")
    return (
        F.when(discount.isNull(), F.lit(None).cast("string"))
        .when(kind == "percentage", F.concat(plain, F.lit("%OFFクーポンあり")))
        .when(kind == "exact", F.concat(_grouped(discount), F.lit("円OFFクーポンあり")))
        .otherwise(F.concat(plain, F.lit("クーポンあり")))
    )


def shipping_days(text) -> Column:
    """翌日 → 1..1, N日以内 → 1..N, a～b日 → a..b; the last rule that matches wins."""
    def read(t):
        return F.struct(
            found(t, DAYS_RANGE, 1).try_cast("int").alias("low"), found(t, DAYS_RANGE, 2).try_cast("int").alias("high"),
            found(t, DAYS_WITHIN).try_cast("int").alias("within"), F.when(t.contains("翌日"), F.lit(1)).alias("next"))

    return let(let(_ascii_digits(text), read), lambda r: F.struct(
        F.coalesce(r["low"], F.when(r["within"].isNotNull(), F.lit(1)), r["next"]).alias("shipping_days_min"),
        F.coalesce(r["high"], r["within"], r["next"]).alias("shipping_days_max")))


def sku_shipping_text(included, cost, message) -> Column:
    postage = F.when(_col(included), F.lit(SHIPPING_INCLUDED)).when(
        _col(cost) != 0, F.concat(F.lit("送料 "), _col(cost).cast("string"), F.lit("円"))
    )
    return F.nullif(F.concat_ws(" / ", postage, F.nullif(_col(message), F.lit(""))), F.lit(""))


def delivery_days(longest) -> Column:
    """(min, max) days from the usual delivery time; at least one day."""
    longest = _col(longest).try_cast("int")
    return F.struct(
        F.when(longest.isNotNull(), F.lit(1)).alias("shipping_days_min"), longest.alias("shipping_days_max")
    )


def is_free_shipping(text) -> Column:
    text = _col(text)
    return F.coalesce(text.contains(FREE_SHIPPING_SIGNS[0]) | text.contains(FREE_SHIPPING_SIGNS[1]), F.lit(False))


def valid_jan(text) -> Column:
    text = _col(text)
    return F.when(text.rlike(JAN), text)


def variant_name(selector_values) -> Column:
    return F.nullif(F.array_join(_col(selector_values), " / "), F.lit(""))


def title_name(title, site_tag: str = "") -> Column:
    """Item name from a page title: without the site's tag and the ': shop' end."""
    text = F.trim(_col(title))
    if site_tag:
        text = F.replace(text, F.lit(site_tag), F.lit(""))
    head, last = F.substring_index(text, ":", -1), F.length(F.substring_index(text, ":", -1))
    has_shop = text.contains(":") & (F.length(F.trim(head)) > 0)
    return F.trim(F.when(has_shop, F.left(text, F.length(text) - last - 1)).otherwise(text))


def extra_fields(attributes, review_count, review_rating) -> Column:
    """Two extra (key, value) pairs from an array of (title, value) attributes:
    brand or maker, then model number or colour; series, then reviews, fill gaps."""
    count, rating = _col(review_count).cast("string"), _col(review_rating).cast("string")

    def pair(key, value):
        return F.struct(key.alias("key"), value.alias("value"))

    def word(title, pairs):
        """Key of the first word the title holds."""
        expr = F.when(title.contains(pairs[0][0]), F.lit(pairs[0][1]))
        for text, key in pairs[1:]:
            expr = expr.when(title.contains(text), F.lit(key))
        return expr

    def tagged(a):
        return F.struct(
            word(a["title"], (("ブランド", "ブランド"), ("メーカー", "メーカー"))).alias("one"),
            word(a["title"], (("型番", "型番"), ("カラー", "カラー"))).alias("two"),
            word(a["title"], (("シリーズ", "シリーズ"),)).alias("series"), a["value"].alias("value"))

    def chosen(rows):
        maker = F.get(F.filter(rows, lambda r: r["one"].isNotNull()), F.lit(0))
        series = F.get(F.filter(rows, lambda r: r["series"].isNotNull()), F.lit(0))
        # The attribute taken for the first pair is not looked at for the second.
        place = F.array_position(F.transform(rows, lambda r: r["one"].isNotNull()), True).cast("int")
        model = F.get(F.filter(rows, lambda r, i: r["two"].isNotNull() & (i != place - 1)), F.lit(0))
        return F.struct(
            F.when(maker.isNotNull(), pair(maker["one"], maker["value"])).when(series.isNotNull(), pair(series["series"], series["value"])).alias("first"),
            F.when(model.isNotNull(), pair(model["two"], model["value"])).alias("second"))

    def shaped(c):
        reviews = F.when(count.try_cast("double") != 0, pair(F.lit("review_count"), count))
        stars = F.when(rating.try_cast("double") != 0, pair(F.lit("review_rating"), rating))
        return let(F.struct(F.coalesce(c["first"], reviews).alias("a"), F.coalesce(c["second"], stars).alias("b")), lambda p: F.struct(
            p["a"]["key"].alias("extra1_key"), p["a"]["value"].alias("extra1_value"),
            p["b"]["key"].alias("extra2_key"), p["b"]["value"].alias("extra2_value")))

    usable = F.filter(F.coalesce(attributes, F.array().cast("array<struct<title:string,value:string>>")),
                      lambda a: (a["value"] != "-") & (a["value"] != ""))
    return let(let(F.transform(usable, tagged), chosen), shaped)


def page_class(
    html, state_mark: str, any_marks=(), all_marks=(), scan_chars: int | None = None, short_chars: int = SHORT_PAGE_CHARS
) -> Column:
    """'short', 'ok' or 'blocked' for one page. Block signs are looked for in the whole
    page, or in its first ``scan_chars`` where the caller says so."""

    html = _col(html)
    lowered = F.lower(html)
    good = html.contains(state_mark)
    for mark in any_marks:
        good = good | lowered.contains(mark)
    if all_marks:
        both = F.lit(True)
        for mark in all_marks:
            both = both & (html.contains(mark) if mark == "itemprop" else lowered.contains(mark))
        good = good | both
    head = lowered if scan_chars is None else F.lower(F.substring(html, 1, scan_chars))
    blocked = F.lit(False)
    for sign in BLOCK_SIGNS:
        blocked = blocked | head.contains(sign.lower())
    return (
        F.when(F.length(html) < short_chars, F.lit("short"))
        .when(good, F.lit("ok"))
        .when(blocked, F.lit("blocked"))
        .otherwise(F.lit("ok"))
    )
