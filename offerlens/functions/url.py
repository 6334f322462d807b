"""URL and key expressions. All are native columns; a malformed URL gives NULL
parts, never an error."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.fixed import DEFAULT_VARIANT, TRACKING_PARAMS, VARIANT_PARAM, Marketplace
from offerlens.functions.text import let, once

_ESCAPED_NAME = r"%[^=&]*="
_URL = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/]*))?(.*)"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _pieces(url: Column) -> Column:
    """(scheme, address, path, query) of a URL. Addresses of the usual form are cut
    by position; the pattern is the rule for all others."""
    def cut(u):
        front = F.substring_index(F.substring_index(u, "#", 1), "?", 1)
        query = F.substring(F.substring_index(u, "#", 1), F.length(front) + 2, F.length(u))
        return let(F.struct(front.alias("f"), query.alias("q")), usual)

    def usual(s):
        rest = F.substring(s["f"], F.instr(s["f"], "://") + 3, F.length(s["f"]))
        address = F.substring_index(rest, "/", 1)
        return F.when(
            s["f"].rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"),
            F.struct(
                F.substring_index(s["f"], "://", 1).alias("scheme"), address.alias("address"),
                F.substring(rest, F.length(address) + 1, F.length(rest)).alias("path"), s["q"].alias("query")),
        ).otherwise(F.struct(
            F.regexp_extract(s["f"], _URL, 1).alias("scheme"), F.regexp_extract(s["f"], _URL, 2).alias("address"),
            F.regexp_extract(s["f"], _URL, 3).alias("path"), s["q"].alias("query")))

    return let(F.translate(F.ltrim(url), "\t\r\n", ""), cut)


def _host(address: Column) -> Column:
    plain = F.when(address.contains("@"), F.substring_index(address, "@", -1)).otherwise(address)
    return F.lower(F.when(plain.contains(":"), F.regexp_replace(plain, r":\d*$", "")).otherwise(plain))


def _path(path: Column) -> Column:
    return F.when(path.contains(";"), F.regexp_replace(path, r";[^/]*$", "")).otherwise(path)


def scheme(url) -> Column:
    return F.lower(_pieces(_col(url))["scheme"])


def host(url) -> Column:
    return _host(_pieces(_col(url))["address"])


def path(url) -> Column:
    return _path(_pieces(_col(url))["path"])


def _decode(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), F.replace(text, F.lit("+"), F.lit(" ")))


def _encode(text: Column) -> Column:
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def query_pairs(url) -> Column:
    """Array of (k, v) in order; parameters without a value are left out."""
    return _pairs(_pieces(_col(url))["query"])


def _pairs(query: Column) -> Column:
    raw = F.split(query, "&")
    valued = F.filter(raw, lambda p: F.instr(p, "=").between(1, F.length(p) - 1))
    return F.transform(
        valued,
        lambda p: let(F.instr(p, "="), lambda at: F.struct(
            _decode(F.substring(p, F.lit(1), at - 1)).alias("k"),
            _decode(F.substring(p, at + 1, F.length(p))).alias("v"),
        )),
    )


def _rebuilt(url, drop: Iterable[str], drop_exact: Iterable[str]) -> Column:
    return let(_pieces(_col(url)), lambda u: let(_pairs(u["query"]), lambda pairs: _joined(u, pairs, drop, drop_exact)))


def _joined(u: Column, pairs: Column, drop: Iterable[str], drop_exact: Iterable[str]) -> Column:
    """An address from its pieces and the parameters that stay."""
    dropped = F.array(*[F.lit(d) for d in drop])
    exact = F.array(*[F.lit(d) for d in drop_exact]) if drop_exact else F.array().cast("array<string>")

    def kept(names):
        return F.filter(names, lambda k: ~F.array_contains(dropped, F.lower(k)) & ~F.array_contains(exact, k))

    names = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    grouped = F.flatten(
        F.transform(
            kept(names),
            lambda k: F.transform(
                F.filter(pairs, lambda p: p["k"] == k),
                lambda p: F.concat(_encode(k), F.lit("="), _encode(p["v"])),
            ),
        )
    )
    return _address_text(u, F.when(u["query"] != "", F.nullif(F.array_join(grouped, "&"), F.lit(""))))


def _address_text(u: Column, query: Column) -> Column:
    base = F.concat(F.lower(u["scheme"]), F.lit("://"), _host(u["address"]), F.rtrim(_path(u["path"]), F.lit("/")), F.lit("/"))
    return F.concat(base, F.coalesce(F.concat(F.lit("?"), query), F.lit("")))


# Steps of an address in a frame.
_STEPS = ("_u", "_front", "_left", "_parts")


def _cut_up(df: DataFrame, url, tracking: Iterable[str], exact: Iterable[str]) -> tuple[DataFrame, Column]:
    """The pieces of a URL ``_u``, its path's ``_parts`` and what is ``_left`` of its query,
    and the address without the dropped parameters. A step is a column, so that the next
    one reads its value: lambdas, which are interpreted, are left to queries that keep
    several parameters or escape a name."""
    bare = F.substring_index(F.translate(F.ltrim(_col(url)), "\t\r\n", ""), "#", 1)
    step, f = df.withColumn("_u", bare).withColumn("_front", F.substring_index("_u", "?", 1)), F.col("_front")
    rest = F.substring(f, F.instr(f, "://") + 3, F.length(f))
    address = F.substring_index(rest, "/", 1)
    step = step.withColumn("_u", F.when(
        f.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"),
        F.struct(F.substring_index(f, "://", 1).alias("scheme"), address.alias("address"),
                 F.substring(rest, F.length(address) + 1, F.length(rest)).alias("path"),
                 F.substring("_u", F.length(f) + 2, F.length("_u")).alias("query")),
    ).otherwise(F.struct(
        F.regexp_extract(f, _URL, 1).alias("scheme"), F.regexp_extract(f, _URL, 2).alias("address"),
        F.regexp_extract(f, _URL, 3).alias("path"), F.substring("_u", F.length(f) + 2, F.length("_u")).alias("query"))))
    u, left = F.col("_u"), F.col("_left")
    query = u["query"]
    names = "|".join([f"(?i:{'|'.join(re.escape(t) for t in tracking)})", *[re.escape(t) for t in exact]])
    plain = F.regexp_replace(query, rf"(?:^|(?<=&))(?:{names})=[^&]*", "")
    # A name with an escape may spell a dropped one.
    step = step.withColumn("_left", F.when(query == "", query).when(query.rlike(_ESCAPED_NAME), query).otherwise(F.trim(plain, F.lit("&"))))
    step = step.withColumn("_parts", F.array_remove(F.split(_path(u["path"]), "/"), ""))
    at = F.instr(left, "=")
    single = F.when(at.between(1, F.length(left) - 1), F.concat(
        _encode(_decode(F.substring(left, F.lit(1), at - 1))), F.lit("="), _encode(_decode(F.substring(left, at + 1, F.length(left))))))
    many = u.withField("query", left)
    return step, F.when(
        left == "", _address_text(u, F.lit(None).cast("string"))
    ).when(
        left.contains("&") | left.rlike(_ESCAPED_NAME), let(many, lambda m: let(_pairs(m["query"]), lambda pairs: _joined(m, pairs, tracking, exact)))
    ).otherwise(_address_text(u, single))


def with_clean_address(df: DataFrame, name: str, url, tracking: Iterable[str] = TRACKING_PARAMS) -> DataFrame:
    """``clean_tracking`` as a further column."""
    step, text = _cut_up(df, url, tracking, ())
    return step.withColumn(name, text).drop(*_STEPS)


def with_item_address(df: DataFrame, name: str, url, tracking: Iterable[str] = TRACKING_PARAMS) -> DataFrame:
    """``item_address`` as a further column, worked out once a row."""
    step, text = _cut_up(df, url, tracking, (VARIANT_PARAM,))
    query, parts = F.col("_u.query"), F.col("_parts")
    variant = F.when(query.rlike(_ESCAPED_NAME), _first_value(_pairs(query), VARIANT_PARAM)).when(
        query.contains(VARIANT_PARAM), _decode(F.nullif(F.regexp_extract(query, rf"(?:^|&){VARIANT_PARAM}=([^&]+)", 1), F.lit(""))))
    codes = F.when(F.size(parts) >= 2, F.struct(F.get(parts, F.lit(0)).alias("shop_code"), F.get(parts, F.lit(1)).alias("item_code")))
    return once(step, name, F.struct(text.alias("canonical_url"), variant.alias("url_variant_id"), codes.alias("codes"))).drop(*_STEPS)


def canonical_url(url, tracking: Iterable[str] = TRACKING_PARAMS) -> Column:
    return _rebuilt(url, tracking, (VARIANT_PARAM,))


def clean_tracking(url, tracking: Iterable[str] = TRACKING_PARAMS) -> Column:
    return _rebuilt(url, tracking, ())


def query_value(url, name: str) -> Column:
    """First value of one query parameter, or NULL."""
    return _first_value(query_pairs(url), name)


def _first_value(pairs: Column, name: str) -> Column:
    return F.get(F.filter(pairs, lambda p: p["k"] == name), F.lit(0))["v"]


def url_variant_id(url) -> Column:
    return query_value(url, VARIANT_PARAM)


def path_parts(url) -> Column:
    return _parts(path(url))


def _parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda p: p != "")


def shop_item_code(url) -> Column:
    """(shop_code, item_code) from the first two path parts, NULL if there are
    fewer than two."""
    return _codes(path_parts(url))


def _codes(parts: Column) -> Column:
    return let(parts, lambda parts: F.when(
        F.size(parts) >= 2,
        F.struct(F.get(parts, F.lit(0)).alias("shop_code"), F.get(parts, F.lit(1)).alias("item_code")),
    ))


def item_address(url, tracking: Iterable[str] = TRACKING_PARAMS) -> Column:
    """``canonical_url``, ``url_variant_id`` and the ``codes`` of a URL, taken apart
    once; each is what the function of its name gives."""
    def whole(u, pairs):
        return F.struct(
            _joined(u, pairs, tracking, (VARIANT_PARAM,)).alias("canonical_url"),
            _first_value(pairs, VARIANT_PARAM).alias("url_variant_id"), _codes(_parts(_path(u["path"]))).alias("codes"))

    return let(_pieces(_col(url)), lambda u: let(_pairs(u["query"]), lambda pairs: whole(u, pairs)))


def store_code(url) -> Column:
    return shop_item_code(url)["shop_code"]


def shop_from_search_url(url) -> Column:
    return query_value(url, "sid")


def product_uid(shop_code, item_code) -> Column:
    return F.concat(_col(shop_code), F.lit(":"), _col(item_code))


def variant_uid(shop_code, item_code, variant_code) -> Column:
    code = F.coalesce(F.nullif(_col(variant_code), F.lit("")), F.lit(DEFAULT_VARIANT))
    return F.concat(_col(shop_code), F.lit(":"), _col(item_code), F.lit(":"), code)


def parse_api_item_code(code) -> Column:
    """'shop:item' → (shop, item); a code without colon → ('', code)."""
    code = _col(code)
    has_shop = F.instr(code, ":") > 0
    return F.struct(
        F.when(has_shop, F.regexp_extract(code, r"^([^:]*):", 1)).otherwise(F.lit("")).alias("shop_code"),
        F.when(has_shop, F.regexp_extract(code, r"(?s)^[^:]*:(.*)$", 1)).otherwise(code).alias("item_code"),
    )


def shop_url(code, market: Marketplace = Marketplace()) -> Column:
    return F.concat(F.lit(market.shop_base), _col(code), F.lit("/"))


def _given(value) -> Column:
    if value is None:
        return F.lit(None).cast("string")
    return value.cast("string") if isinstance(value, Column) else F.lit(str(value))


def search_url(
    genre_id=None, keyword=None, shop_code=None, min_price=None, max_price=None,
    page=1, sort=None, market: Marketplace = Marketplace(),
) -> Column:
    """Search address from plain values or columns; NULL parts are left out."""
    genre, word, shop = (F.nullif(_given(v), F.lit("")) for v in (genre_id, keyword, shop_code))
    number = _given(page).cast("int")
    middle = (
        F.when(word.isNotNull() & genre.isNotNull(), F.concat(word, F.lit("/"), genre, F.lit("/")))
        .when(genre.isNotNull(), F.concat(F.lit("-/"), genre, F.lit("/")))
        .when(word.isNotNull(), F.concat(word, F.lit("/")))
        .otherwise(F.lit(""))
    )
    params = F.concat_ws(
        "&",
        F.concat(F.lit("sid="), _encode(shop)),
        F.concat(F.lit("min="), _given(min_price)),
        F.concat(F.lit("max="), _given(max_price)),
        F.concat(F.lit("s="), _encode(_given(sort))),
        F.when(number > 1, F.concat(F.lit("p="), number.cast("string"))),
    )
    return F.concat(
        F.lit(market.search_base), middle, F.when(params != "", F.concat(F.lit("?"), params)).otherwise(F.lit(""))
    )
