"""Hashes, dates, source flags and small JSON columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from offerlens.fixed import MEASURES

_TYPES = {
    "price": "bigint", "coupon_yen": "bigint", "shipping_days_min": "int", "shipping_days_max": "int",
    "point_rate": "decimal(5,1)", "point_back_percent": "decimal(5,1)", "coupon_percent": "decimal(5,1)",
}


def content_hash(columns: list[str]) -> Column:
    """SHA-256 over the measures in name order, nulls kept; a measure the frame
    does not have counts as NULL. Rates are brought to one decimal first, so that
    5 and 5.0 hash alike."""
    have = set(columns)
    fields = []
    for name in sorted(MEASURES):
        value = F.col(name) if name in have else F.lit(None)
        fields.append(value.cast(_TYPES.get(name, "string")).alias(name))
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)


def record_date(ts, zone: str = "UTC") -> Column:
    """Calendar day of a UTC time in the given zone."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    if zone == "UTC":
        return F.to_date(ts)
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), ts.cast("timestamp_ntz")))


def hours_before(as_of: Column, hours: int) -> Column:
    return as_of - F.make_dt_interval(hours=F.lit(hours))


def minutes_before(as_of: Column, minutes: int) -> Column:
    return as_of - F.make_dt_interval(mins=F.lit(minutes))


def months_before(as_of: Column, months: int) -> Column:
    return as_of - F.make_ym_interval(months=F.lit(months))


def source_flags(source: str = "source", at: str = "fetched_at") -> dict[str, Column]:
    """Columns an item row takes from the source that saw it."""
    src = F.col(source)
    ext = src == "extension"
    return {
        "seen_in_api": src == "api",
        "seen_in_list": src == "list",
        "seen_in_detail": src == "detail",
        "seen_in_ext": ext,
        "ext_first_seen": F.when(ext, F.col(at)),
        "ext_view_count": F.when(ext, F.lit(1)).otherwise(F.lit(0)).cast("bigint"),
        "in_server_crawl": src.isin("api", "list", "detail"),
    }


def selector_json(selector_values, attributes) -> Column:
    return F.to_json(F.struct(selector_values.alias("selectorValues"), attributes.alias("attributes")))


def id_list(text, most: int = 20) -> Column:
    """Comma list → array of ids; NULL if an entry is no number, the list is empty
    or it is too long."""
    text = F.col(text) if isinstance(text, str) else text
    parts = F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p != "")
    ids = F.transform(parts, lambda p: p.try_cast("bigint"))
    good = (F.size(ids) >= 1) & (F.size(ids) <= most) & ~F.exists(ids, lambda i: i.isNull())
    return F.when(good, ids)


def genre_path(path: Column | str) -> Column:
    """Genre ids of a path such as "/0/12/345", from the root down; a part that is no
    number is NULL."""
    path = F.col(path) if isinstance(path, str) else path
    return F.transform(F.filter(F.split(path, "/"), lambda p: p != ""), lambda p: p.try_cast("bigint"))
