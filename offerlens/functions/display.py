"""Display columns: yen, points, short text, dates, ages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NONE_SHOWN = "---"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def yen(value) -> Column:
    value = _col(value)
    return F.coalesce(F.concat(F.lit("¥"), F.format_number(value, 0)), F.lit(NONE_SHOWN))


def points(value) -> Column:
    value = _col(value)
    return F.coalesce(F.concat(F.format_number(value, 0), F.lit("pt")), F.lit(NONE_SHOWN))


def truncated(text, most: int) -> Column:
    text = F.coalesce(_col(text), F.lit(""))
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def shown_date(ts) -> Column:
    return F.coalesce(F.date_format(_col(ts), "yyyy/MM/dd HH:mm"), F.lit(NONE_SHOWN))


def age(ts, as_of) -> Column:
    minutes = F.timestamp_diff("MINUTE", _col(ts), _col(as_of))
    hours, days = F.floor(minutes / 60), F.floor(minutes / 1440)
    return (
        F.when(minutes.isNull(), F.lit(NONE_SHOWN))
        .when(minutes < 1, F.lit("たった今"))
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit("分前")))
        .when(minutes < 1440, F.concat(hours.cast("string"), F.lit("時間前")))
        .otherwise(F.concat(days.cast("string"), F.lit("日前")))
    )


def shipping_range(low, high) -> Column:
    low, high = _col(low).cast("string"), _col(high).cast("string")
    return (
        F.when(low.isNull() & high.isNull(), F.lit(NONE_SHOWN))
        .when(low.isNotNull() & high.isNotNull() & (low != high), F.concat(low, F.lit("〜"), high, F.lit("日")))
        .otherwise(F.concat(F.coalesce(low, high), F.lit("日")))
    )
