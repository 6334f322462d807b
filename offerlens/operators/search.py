"""Filtered, sorted, paged product search."""

from __future__ import annotations

from copy import copy
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.functions.keys import hours_before
from offerlens.functions.price import offer_value
from offerlens.operators.join import held, join_shops, pick
from offerlens.operators.ordered import first_page, page_rows

# Columns of a search result.
RESULT_COLUMNS = (
    "variant_uid", "product_uid", "shop_code", "shop_name", "shop_url", "item_code", "item_name",
    "canonical_url", "variant_code", "jan_code", "variant_name", "price", "point_rate",
    "point_back_percent", "coupon_yen", "coupon_percent", "shipping_text_raw", "shipping_days_min",
    "shipping_days_max", "image_url", "extra1_key", "extra1_value", "extra2_key", "extra2_value", "fetched_at",
)
SORTS = ("price_asc", "price_desc", "updated", "name", "effective")


NAME_COLLATION = "UNICODE_CI_AI"


# Order → column, whether it falls, whether offers without a value come first.
_ORDERS = {
    "price_asc": ("price", False, True), "price_desc": ("price", True, False), "updated": ("fetched_at", True, False),
    "name": ("item_name", False, True), "effective": ("effective_price", False, False),
}


def _compared(sort_by: str, value: Column) -> Column:
    return F.collate(value, NAME_COLLATION) if sort_by == "name" else value


def sort_order(sort_by: str) -> list[Column]:
    """Every order ends in the variant's key, so that pages never overlap."""
    if sort_by not in _ORDERS:
        raise ValueError(f"sort_by must be one of {SORTS}")
    column, falls, empty_first = _ORDERS[sort_by]
    value = _compared(sort_by, F.col(column))
    first = (value.desc_nulls_first() if empty_first else value.desc_nulls_last()) if falls else (
        value.asc_nulls_first() if empty_first else value.asc_nulls_last())
    return [first, F.col("variant_uid").asc()]


def name_contains(column: str, text: str, collation: str | None = NAME_COLLATION) -> Column:
    """Substring test; by default without regard to case and accents."""
    if collation is None:
        return F.col(column).contains(text)
    return F.collate(F.col(column), collation).contains(F.collate(F.lit(text), collation))


def name_like(column: str, pattern: str) -> Column:
    """Pattern test in which % and _ keep their meaning."""
    return F.col(column).ilike(f"%{pattern}%")


def has_jan() -> Column:
    return F.col("jan_code").isNotNull() & (F.col("jan_code") != "")


def has_coupon() -> Column:
    return (F.col("coupon_yen") > 0) | (F.col("coupon_percent") > 0)


def _all(conditions: list[Column]) -> Column | None:
    return reduce(lambda a, b: a & b, conditions) if conditions else None


def multi_variant_items(variants: DataFrame) -> DataFrame:
    """Items with more than one active variant."""
    return (
        variants.filter(F.col("is_active"))
        .groupBy("product_uid")
        .agg(F.count("*").alias("variant_count"))
        .filter(F.col("variant_count") > 1)
    )


class Search:
    """Predicates split by the table they read, so that the count and the page
    join only what the given filters need."""

    def __init__(
        self, q=None, jan=None, shop_code=None, want_jan=False, want_coupon=False, want_variants=False,
        updated_since: Column | None = None, price_min=None, price_max=None, shipping_max_days=None,
        collation: str | None = NAME_COLLATION, active_only: bool = True, require_price: bool = False,
    ):
        self.item, self.variant, self.snapshot = [], [], []
        self.want_variants = want_variants
        if active_only:
            self.item.append(F.col("is_active"))
            self.variant.append(F.col("is_active"))
        if q:
            self.item.append(name_contains("item_name", q, collation))
        if shop_code:
            self.item.append(F.col("shop_code") == shop_code)
            self.variant.append(F.col("product_uid").startswith(f"{shop_code}:"))
        if jan:
            self.variant.append(F.col("jan_code") == jan)
        if want_jan:
            self.variant.append(has_jan())
        if want_coupon:
            self.snapshot.append(has_coupon())
        if updated_since is not None:
            self.snapshot.append(F.col("fetched_at") >= updated_since)
        if price_min is not None:
            self.snapshot.append(F.col("price") >= price_min)
        if price_max is not None:
            self.snapshot.append(F.col("price") <= price_max)
        if shipping_max_days is not None:
            self.snapshot.append(F.col("shipping_days_min").isNotNull() & (F.col("shipping_days_min") <= shipping_max_days))
        if require_price:
            self.snapshot.append(F.col("price").isNotNull())

    def sorted_by(self, sort_by: str) -> Search:
        """With what an order asks of its rows: a price to sort by price, a time to sort
        by time. Other orders also show offers that have none."""
        out = copy(self)
        need = {"price_asc": ["price"], "price_desc": ["price"], "updated": ["fetched_at"]}.get(sort_by, [])
        out.snapshot = [*self.snapshot, *[F.col(c).isNotNull() for c in need]]
        return out

    @staticmethod
    def updated_24h(as_of: Column) -> Column:
        return hours_before(as_of, 24)

    def narrow(self, items: DataFrame, variants: DataFrame, snapshots: DataFrame, keep=()) -> DataFrame:
        """Matching variants with only the columns a sort or count needs."""
        def cut(df, conditions):
            cond = _all(conditions)
            return df if cond is None else df.filter(cond)

        snaps = cut(snapshots, self.snapshot).select("variant_uid", *[c for c in keep if c in snapshots.columns])
        kept_items = cut(items, self.item)
        if self.want_variants:
            kept_items = kept_items.join(multi_variant_items(variants), "product_uid", "left_semi")
        wanted = [c for c in keep if c in items.columns and c not in snapshots.columns]
        rows = cut(variants, self.variant).select("variant_uid", "product_uid")
        how = "inner" if self.snapshot else "left"
        rows = rows.join(snaps, "variant_uid", how)
        if self.item or self.want_variants or wanted:
            rows = rows.join(kept_items.select("product_uid", *wanted), "product_uid")
        return rows

    def count(self, items, variants, snapshots) -> DataFrame:
        return self.narrow(items, variants, snapshots).agg(F.count("*").alias("total"))


def search_flags(df: DataFrame, key: list[str], part: str, searches: dict[str, Search]) -> DataFrame:
    """The keys of each row of one table and which searches it meets there."""
    met = {k: _all(getattr(s, part)) for k, s in searches.items()}
    return df.select(*key, *[(F.lit(True) if c is None else F.coalesce(c, F.lit(False))).alias(f"{part}_{k}") for k, c in met.items()])


def search_totals(rows: DataFrame, searches: dict[str, Search]) -> DataFrame:
    """(kind, total) from joined flags; ``many`` tells items of several active variants."""
    totals = []
    for k, s in searches.items():
        met = F.col(f"variant_{k}") & F.col(f"item_{k}")
        if s.snapshot:
            met = met & F.col(f"snapshot_{k}")
        if s.want_variants:
            met = met & F.col("many")
        totals.append(F.struct(F.lit(k).alias("kind"), F.count_if(met).alias("total")))
    return rows.agg(F.array(*totals).alias("t")).select(F.inline("t"))


def count_searches(items: DataFrame, variants: DataFrame, snapshots: DataFrame, searches: dict[str, Search]) -> DataFrame:
    """(kind, total) of several searches in one pass: each table tells which searches
    its rows meet, and one star join counts the rows that meet all of one."""
    rows = search_flags(variants, ["variant_uid", "product_uid"], "variant", searches)
    rows = rows.join(search_flags(items, ["product_uid"], "item", searches), "product_uid")
    rows = rows.join(search_flags(snapshots, ["variant_uid"], "snapshot", searches), "variant_uid", "left")
    if any(s.want_variants for s in searches.values()):
        many = multi_variant_items(variants).select("product_uid", F.lit(True).alias("many"))
        rows = rows.join(many, "product_uid", "left")
    return search_totals(rows, searches)


_SORT_COLUMNS = {
    "price_asc": ("price",), "price_desc": ("price",), "updated": ("fetched_at",), "name": ("item_name",),
    "effective": ("price", "point_rate", "point_back_percent", "coupon_yen", "coupon_percent"),
}


def _with_net(rows: DataFrame, sort_by: str) -> DataFrame:
    """The net price, where rows are sorted by it; offers without price have none."""
    if sort_by != "effective":
        return rows
    net = F.when(F.col("price").isNotNull(), offer_value(mode="server")["effective_price"])
    return rows.withColumn("effective_price", net)


def widen(page: DataFrame, items: DataFrame, variants: DataFrame, snapshots: DataFrame, shops: DataFrame) -> DataFrame:
    """Full result columns for a page of at most 100 variants, whose keys travel to
    the tables."""
    keys = held(page.select("variant_uid", "product_uid"))
    found = items.select("product_uid", "shop_code", "item_code", "item_name", "canonical_url")
    # Each side holds one row per key of the page.
    rows = keys.join(F.broadcast(pick(variants.drop("is_active", "product_uid"), "variant_uid", keys)), "variant_uid", "left")
    rows = rows.join(F.broadcast(pick(snapshots.drop("source"), "variant_uid", keys)), "variant_uid", "left")
    rows = rows.join(F.broadcast(pick(found, "product_uid", keys)), "product_uid", "left")
    wide = join_shops(rows, shops)
    return wide.select(*[c for c in RESULT_COLUMNS if c in wide.columns])


def sorted_rows(search: Search, sort_by: str, items: DataFrame, variants: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Narrow rows of a search that hold what an order sorts by."""
    return _with_net(search.sorted_by(sort_by).narrow(items, variants, snapshots, keep=_SORT_COLUMNS[sort_by]), sort_by)


def search_products(
    items: DataFrame, variants: DataFrame, snapshots: DataFrame, shops: DataFrame, search: Search | None = None,
    sort_by: str = "price_asc", page: int = 1, per_page: int = 50, after: tuple | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(page of wide rows, one-row total). The page is chosen on narrow rows
    first; the wide columns are read for the chosen variants only. ``after`` names the
    last row seen, as (its value in the order, its variant), and takes the place of
    the page number: any page then costs what the first one costs."""
    order = sort_order(sort_by)
    search = (search or Search()).sorted_by(sort_by)
    narrow = sorted_rows(search, sort_by, items, variants, snapshots)
    if after is not None:
        chosen = after_key(narrow, *after, per_page, sort_by=sort_by)
    else:
        chosen = first_page(narrow, order, per_page) if page == 1 else page_rows(narrow, order, page, per_page)
    rows = _with_net(widen(chosen, items, variants, snapshots, shops), sort_by).orderBy(*order)
    return rows, search.count(items, variants, snapshots)


def after_key(narrow: DataFrame, last, last_uid: str, per_page: int, descending: bool = False, sort_by: str | None = None) -> DataFrame:
    """The page after a given (value, variant) in an order, by price unless named: same
    rows as the offset page, at the cost of a first page. ``last`` is None where the
    last row had no value; such rows stand where the order puts them."""
    sort_by = sort_by or ("price_desc" if descending else "price_asc")
    order = sort_order(sort_by)
    column, falls, empty_first = _ORDERS[sort_by]
    empty, later = F.col(column).isNull(), F.col("variant_uid") > last_uid
    if last is None:
        ahead = (empty & later) | (~empty if empty_first else F.lit(False))
    else:
        value, seen = _compared(sort_by, F.col(column)), _compared(sort_by, F.lit(last))
        ahead = (value < seen if falls else value > seen) | ((value == seen) & later)
        ahead = ahead if empty_first else ahead | empty
    return narrow.filter(ahead).orderBy(*order).limit(per_page)


def page_count(total: Column, per_page: int) -> Column:
    return F.ceil(total / F.lit(per_page)).cast("bigint")
