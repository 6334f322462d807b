"""Joins to small tables whose size is looked at before they are sent around."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


MOST_KEYS = 1000


def pick(table: DataFrame, key: str, few: DataFrame) -> DataFrame:
    """Rows of a table with the keys of a page. The page's keys (at most 1000, which
    is checked) become an IN list, so they reach the table's files as a filter."""
    keys = [r[0] for r in few.select(key).distinct().limit(MOST_KEYS + 1).collect()]
    if len(keys) > MOST_KEYS:
        raise ValueError(f"a page has at most {MOST_KEYS} keys")
    return table.filter(F.col(key).isin(*keys))


def held(few: DataFrame) -> DataFrame:
    """A page of rows, run once and kept as local rows."""
    rows = few.limit(MOST_KEYS + 1).collect()
    if len(rows) > MOST_KEYS:
        raise ValueError(f"a page has at most {MOST_KEYS} rows")
    return few.sparkSession.createDataFrame(rows, few.schema)


def join_shops(rows: DataFrame, shops: DataFrame, page_side: bool = False) -> DataFrame:
    """Left join to shops on shop_code, unique there. No hint is given: Spark
    broadcasts shops only while they are below its size threshold, and otherwise
    splits the hot shop's partition. ``page_side`` says that the left rows are a
    held page, whose shops alone are read then."""
    names = shops.select("shop_code", *[c for c in ("shop_name", "shop_url") if c in shops.columns])
    return rows.join(F.broadcast(pick(names, "shop_code", rows)) if page_side else names, "shop_code", "left")
