"""What to collect next: price slices, page frontiers, genre frontiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.fixed import API_SLICE_CAP, DEFAULT_MAX_PRICE, LIST_MAX_PAGE, LIST_PAGE_SIZE, Marketplace
from offerlens.functions.url import search_url


def price_bounds(rows: DataFrame, group: str = "genre_id", price: str = "price") -> DataFrame:
    """First range of each group: 1 to its highest price."""
    return rows.groupBy(group).agg(
        F.lit(1).cast("bigint").alias("min_price"),
        F.coalesce(F.max(price).cast("bigint"), F.lit(DEFAULT_MAX_PRICE)).alias("max_price"),
    )


def _descent(price: Column, low: Column, high: Column) -> Column:
    """All ranges (lo, hi) of the halving tree that hold a price, from the whole range
    down to the single price. The group's own bound sets the depth."""
    def pair(lo: Column, hi: Column) -> Column:
        return F.struct(lo.cast("bigint").alias("lo"), hi.cast("bigint").alias("hi"))

    def half(acc, _):
        last = F.element_at(acc, -1)
        # Overflow-free for any two bigints of one sign.
        mid = last["lo"] + F.shiftright(last["hi"] - last["lo"], 1)
        child = pair(F.when(price <= mid, last["lo"]).otherwise(mid + 1), F.when(price <= mid, mid).otherwise(last["hi"]))
        return F.when(last["lo"] < last["hi"], F.concat(acc, F.array(child))).otherwise(acc)

    depth = F.length(F.bin(high - low)) + 1
    return F.aggregate(F.sequence(F.lit(1), depth), F.array(pair(low, high)), half)


def price_slices(
    rows: DataFrame, group: str = "genre_id", price: str = "price", cap: int = API_SLICE_CAP
) -> DataFrame:
    """Halve each group's price range at its middle until every slice holds at
    most ``cap`` rows; a single price above the cap is marked unsplittable.

    The halving points depend on the bounds only, so each distinct price knows its
    ranges: the rows collapse to a price histogram first, then each price's ranges
    are counted in one aggregate, instead of a pass per level.
    """
    priced = rows.filter(F.col(price).isNotNull() & (F.col(price) >= 1))
    histogram = priced.groupBy(group, price).agg(F.count("*").alias("n"))
    bounds = price_bounds(histogram, group, price)
    nodes = (
        histogram.join(bounds, group)
        .select(
            group,
            "n",
            F.posexplode(_descent(F.col(price).cast("bigint"), F.col("min_price"), F.col("max_price"))).alias("depth", "r"),
        )
        .groupBy(group, "depth", F.col("r.lo").alias("min_price"), F.col("r.hi").alias("max_price"))
        .agg(F.sum("n").alias("estimated_count"))
    )
    over = nodes.filter((F.col("estimated_count") > cap) & (F.col("min_price") < F.col("max_price")))
    mid = F.col("min_price") + F.shiftright(F.col("max_price") - F.col("min_price"), 1)
    # Both halves of a split range are slices, also one that holds no row.
    children = over.select(
        group,
        (F.col("depth") + 1).alias("depth"),
        F.explode(
            F.array(
                F.struct(F.col("min_price").alias("lo"), mid.alias("hi")),
                F.struct((mid + 1).alias("lo"), F.col("max_price").alias("hi")),
            )
        ).alias("r"),
    ).select(group, "depth", F.col("r.lo").alias("min_price"), F.col("r.hi").alias("max_price"))
    roots = bounds.select(group, F.lit(0).alias("depth"), "min_price", "max_price")
    keys = [group, "depth", "min_price", "max_price"]
    candidates = roots.unionByName(children).join(nodes, keys, "left")
    leaf = candidates.withColumn("estimated_count", F.coalesce("estimated_count", F.lit(0).cast("bigint"))).filter(
        (F.col("estimated_count") <= cap) | (F.col("min_price") == F.col("max_price"))
    )
    return leaf.select(
        group, "min_price", "max_price", "estimated_count", (F.col("estimated_count") > cap).alias("unsplittable")
    )


def mark_split(slices: DataFrame, split: DataFrame) -> DataFrame:
    """Slices named by (target, range) get status needs_split."""
    keys = ["crawl_target_id", "min_price", "max_price"]
    hit = split.select(*keys).distinct().withColumn("_hit", F.lit(True))
    return (
        slices.join(hit, keys, "left")
        .withColumn("status", F.when(F.col("_hit"), F.lit("needs_split")).otherwise(F.col("status")))
        .select(*slices.columns)
    )


def discovery_ranges(targets: DataFrame, slices: DataFrame) -> DataFrame:
    """Ranges to walk per active genre target: its usable slices by price, else
    one open range from 0."""
    genres = targets.filter((F.col("target_type") == "genre") & F.col("is_active"))
    usable = slices.filter(F.col("status") != "needs_split").select(
        F.col("crawl_target_id").alias("id"), "min_price", "max_price"
    )
    return genres.join(usable, "id", "left").select(
        F.col("target_value").alias("genre_id"),
        F.coalesce("min_price", F.lit(0)).alias("min_price"),
        "max_price",
        F.col("min_price").isNotNull().alias("from_slice"),
    ).orderBy("genre_id", "min_price")


def page_numbers(total: Column, page_size: Column | int, most: int | None = None, has_rows: Column | None = None) -> Column:
    """Array 1..n of pages; NULL where there is nothing. A known total gives all its pages,
    cut at ``most`` where the caller names the marketplace's limit. An unknown total
    (NULL or 0) with rows on the first page means all pages up to that limit, so
    ``has_rows`` needs one."""
    if has_rows is not None and most is None:
        raise ValueError("totals that may be unknown need the number of pages to ask for then (most)")
    size = page_size if isinstance(page_size, Column) else F.lit(page_size)
    known = F.coalesce(total, F.lit(0))
    pages = F.when((known > 0) & (size > 0), F.ceil(known / size))
    if has_rows is not None:
        pages = pages.when(F.coalesce(has_rows, F.lit(False)), F.lit(most))
    pages = pages if most is None else F.least(pages, F.when(pages.isNotNull(), F.lit(most)))
    return F.when(pages >= 1, F.sequence(F.lit(1), pages.cast("int")))


def page_frontier(
    targets: DataFrame, total: str = "total_found", page_size: Column | int = LIST_PAGE_SIZE, most: int | None = None,
    has_rows: Column | None = None, market: Marketplace = Marketplace(),
) -> DataFrame:
    """One row and address per page of each (genre, keyword, shop, range) target."""
    have = set(targets.columns)

    def part(name):
        return F.col(name) if name in have else None

    paged = targets.withColumn("page", F.explode(page_numbers(F.col(total), page_size, most, has_rows)))
    url = search_url(
        part("genre_id"), part("keyword"), part("shop_code"), part("min_price"), part("max_price"),
        F.col("page"), part("sort"), market,
    )
    return paged.withColumn("url", url)


def api_pages(counts: DataFrame, page_count: str = "page_count", most: int | None = None) -> DataFrame:
    """API pages 1..page_count of each row, or up to a limit that the caller names."""
    last = F.col(page_count).cast("int") if most is None else F.least(F.col(page_count), F.lit(most)).cast("int")
    return counts.withColumn("page", F.explode(F.when(last >= 1, F.sequence(F.lit(1), last))))


def shop_frontier(targets: DataFrame, most: int = LIST_MAX_PAGE, market: Marketplace = Marketplace()) -> DataFrame:
    """Base addresses of the active shop targets, highest priority first."""
    shops = targets.filter((F.col("target_type") == "shop") & F.col("is_active"))
    return shops.orderBy(F.col("priority").desc(), F.col("created_at"), F.col("id")).select(
        F.col("target_value").alias("shop_code"),
        "priority",
        search_url(shop_code=F.col("target_value"), market=market).alias("url"),
        F.lit(most).alias("max_pages"),
    )


def genre_frontier(edges: DataFrame, root, depth: int) -> DataFrame:
    """Genres ``depth`` levels under the root; a branch that ends earlier gives its
    last node. One self-join per level, and levels are few."""
    kind = dict(edges.dtypes)["child_id"]
    links = edges.select(F.col("parent_id").alias("_parent"), F.col("child_id").alias("_child"))
    front = edges.sparkSession.range(1).select(F.lit(root).cast(kind).alias("genre_id"))
    for _ in range(depth):
        front = front.join(links, front["genre_id"] == links["_parent"], "left").select(
            F.coalesce("_child", "genre_id").alias("genre_id")
        )
    return front


def genre_closure(edges: DataFrame, root, most: int = 100) -> DataFrame:
    """Every genre below the root with its least ``depth``, whatever the depth of the tree. A
    way that comes back to a genre it has passed ends there, so cycles end; ways of more
    than ``most`` levels are an error."""
    kind = dict(edges.dtypes)["child_id"]
    links = edges.select("parent_id", "child_id").distinct()
    return edges.sparkSession.sql(
        f"""
        WITH RECURSIVE ways(genre_id, depth, passed) MAX RECURSION LEVEL {int(most)} AS (
          SELECT CAST(:root AS {kind}), 0, array(CAST(:root AS {kind}))
          UNION ALL
          SELECT e.child_id, ways.depth + 1, array_append(ways.passed, e.child_id)
          FROM ways JOIN {{edges}} e ON e.parent_id = ways.genre_id WHERE NOT array_contains(ways.passed, e.child_id))
        SELECT genre_id, min(depth) AS depth FROM ways GROUP BY genre_id""",
        args={"root": root}, edges=links,
    )
