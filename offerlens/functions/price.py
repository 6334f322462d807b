"""Points, coupons and the price left after them (IEEE double, floored)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from offerlens.fixed import DEFAULT_MULTIPLIER, MULTIPLIER_RANGE

MODES = ("server", "client", "chart")


def _num(col: Column | str) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce(col.try_cast("double"), F.lit(0.0))


def clamp_multiplier(multiplier: Column | float) -> Column:
    low, high = MULTIPLIER_RANGE
    value = multiplier if isinstance(multiplier, Column) else F.lit(float(multiplier))
    return F.least(F.greatest(value.try_cast("double"), F.lit(low)), F.lit(high))


def coupon_value(price, coupon_yen, coupon_percent) -> Column:
    """The better of the fixed coupon and the floored percentage coupon."""
    by_percent = F.floor(_num(price) * _num(coupon_percent) / 100)
    return F.greatest(_num(coupon_yen).try_cast("bigint"), by_percent)


def base_points(price, point_rate, multiplier=DEFAULT_MULTIPLIER) -> Column:
    factor = multiplier if isinstance(multiplier, Column) else F.lit(float(multiplier))
    return F.floor(_num(price) * (factor + _num(point_rate)) / 100)


def point_back_factor(point_back_percent) -> Column:
    back = _num(point_back_percent)
    return F.when(back == 0, F.lit(1)).otherwise(back.try_cast("int"))


def offer_value(
    price="price",
    point_rate="point_rate",
    point_back_percent="point_back_percent",
    coupon_yen="coupon_yen",
    coupon_percent="coupon_percent",
    multiplier: Column | float = DEFAULT_MULTIPLIER,
    mode: str = "server",
) -> Column:
    """Struct of coupon, points, point back, price less points and net price.

    ``server`` multiplies the points by the whole point-back percentage;
    ``client`` subtracts the point-back share of the price instead;
    ``chart`` is ``client`` without any point back. A multiplier outside its range
    counts as the nearest one in it.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    multiplier = clamp_multiplier(multiplier)
    whole = _num(price).try_cast("bigint")
    coupon = coupon_value(price, coupon_yen, coupon_percent)
    points = base_points(price, point_rate, multiplier)
    back = F.lit(0).try_cast("bigint")
    if mode == "server":
        points = points * point_back_factor(point_back_percent)
    elif mode == "client":
        back = F.floor(_num(price) * _num(point_back_percent) / 100)
    return F.struct(
        coupon.alias("effective_coupon"),
        points.alias("total_points"),
        back.alias("point_back_amount"),
        (whole - points).alias("price_minus_points"),
        (whole - points - back - coupon).alias("effective_price"),
    )


def net_price(mode: str = "server", multiplier: Column | float = DEFAULT_MULTIPLIER, **columns) -> Column:
    return offer_value(multiplier=multiplier, mode=mode, **columns)["effective_price"]


def single_product_price(price_max, price_min) -> Column:
    """Highest price, else the lowest; zero counts as absent."""
    return F.coalesce(F.nullif(price_max, F.lit(0)), F.nullif(price_min, F.lit(0))).try_cast("int")


def sold_out(condition, quantity) -> Column:
    return F.coalesce(condition == "sold-out", F.lit(False)) | F.coalesce(quantity == 0, F.lit(False))


def multiplier_total(*parts) -> Column:
    """Sum of the point multipliers of a listing; nothing if it is not positive."""
    total = sum((F.coalesce(p, F.lit(0)) for p in parts[1:]), F.coalesce(parts[0], F.lit(0)))
    return F.when(total > 0, total)
