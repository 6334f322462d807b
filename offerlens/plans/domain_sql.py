"""The views of ``domain`` as SQL text, for checking results with another engine."""

OBS_COLUMNS = """
  CAST(l_suppkey AS VARCHAR) || ':' || CAST(l_partkey AS VARCHAR) AS product_uid,
  CAST(l_suppkey AS VARCHAR) AS shop_code, CAST(l_partkey AS VARCHAR) AS item_code,
  CAST(l_linenumber AS VARCHAR) AS variant_code,
  lpad(CAST(l_partkey AS VARCHAR), 13, '0') AS jan_code,
  CAST(floor(l_extendedprice / l_quantity) AS BIGINT) AS price,
  round(l_tax * 100) AS point_rate,
  CASE WHEN l_linestatus = 'F' AND l_linenumber = 7 THEN CAST(10.0 AS DOUBLE) END AS point_back_percent,
  CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) * 10 END AS coupon_yen,
  round(l_discount * 100) AS coupon_percent,
  CASE l_linenumber % 3 WHEN 0 THEN '送料無料' WHEN 1 THEN '送料 550円' END AS shipping_text_raw,
  CASE WHEN l_linestatus = 'O' THEN 1 END AS shipping_days_min,
  l_linenumber AS shipping_days_max,
  'https://img.example.com/' || CAST(l_partkey AS VARCHAR) || '.jpg' AS image_url,
  l_shipdate AS fetched_at,
  CASE l_returnflag WHEN 'A' THEN 'api' WHEN 'N' THEN 'list' ELSE 'detail' END AS source,
  l_orderkey AS seq, CAST(l_quantity AS BIGINT) AS quantity, l_suppkey, l_linenumber, l_returnflag, l_linestatus
"""

OBS = f"""obs AS (SELECT
  CAST(l_suppkey AS VARCHAR) || ':' || CAST(l_partkey AS VARCHAR) || ':' || CAST(l_linenumber AS VARCHAR) AS variant_uid,
  {OBS_COLUMNS} FROM lineitem)"""
OBS_PART = f"""obs AS (SELECT CAST(l_partkey AS VARCHAR) AS variant_uid, {OBS_COLUMNS} FROM lineitem)"""

_ORDER = ("fetched_at", "seq", "l_linenumber", "quantity", "price", "coupon_percent", "point_rate", "l_suppkey", "l_returnflag", "l_linestatus")
LAST_FIRST = ", ".join(f"{c} DESC" for c in _ORDER)
FIRST_FIRST = ", ".join(_ORDER)

SNAP = f"""snap AS (SELECT * FROM obs QUALIFY row_number() OVER (PARTITION BY variant_uid ORDER BY {LAST_FIRST}) = 1)"""
DAILY = f"""hist AS (SELECT *, CAST(fetched_at AS DATE) AS record_date FROM obs
  QUALIFY row_number() OVER (PARTITION BY variant_uid, CAST(fetched_at AS DATE) ORDER BY {LAST_FIRST}) = 1)"""

SHOPS = """shops AS (SELECT CAST(s_suppkey AS VARCHAR) AS shop_code, s_name AS shop_name,
  'https://www.example.com/' || CAST(s_suppkey AS VARCHAR) || '/' AS shop_url FROM supplier)"""

ITEMS = """items AS (SELECT
    CAST(l_suppkey AS VARCHAR) || ':' || CAST(l_partkey AS VARCHAR) AS product_uid,
    CAST(l_suppkey AS VARCHAR) AS shop_code, CAST(l_partkey AS VARCHAR) AS item_code, p_name AS item_name,
    'https://item.example.com/' || CAST(l_suppkey AS VARCHAR) || '/' || CAST(l_partkey AS VARCHAR) || '/' AS canonical_url,
    p_type AS genre_id, bool_or(l_returnflag = 'A') AS seen_in_api, bool_or(l_returnflag = 'N') AS seen_in_list,
    bool_or(l_returnflag = 'R') AS seen_in_detail, l_partkey % 11 <> 0 AS is_active, max(l_shipdate) AS updated_at
  FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_suppkey, l_partkey, p_name, p_type)"""

VARIANTS = """variants AS (SELECT DISTINCT
    CAST(l_suppkey AS VARCHAR) || ':' || CAST(l_partkey AS VARCHAR) || ':' || CAST(l_linenumber AS VARCHAR) AS variant_uid,
    CAST(l_suppkey AS VARCHAR) || ':' || CAST(l_partkey AS VARCHAR) AS product_uid,
    CAST(l_linenumber AS VARCHAR) AS variant_code,
    CASE WHEN l_partkey % 7 <> 0 THEN lpad(CAST(l_partkey AS VARCHAR), 13, '0') END AS jan_code,
    'No. ' || CAST(l_linenumber AS VARCHAR) AS variant_name, l_linenumber <> 6 AS is_active FROM lineitem)"""

LIST_OBS = """list_obs AS (SELECT
    CAST(l_suppkey AS VARCHAR) || ':' || CAST(l_partkey AS VARCHAR) AS product_uid,
    CAST(floor(l_extendedprice / l_quantity) AS BIGINT) AS observed_price,
    CAST(floor(l_extendedprice / l_quantity / 100) AS BIGINT) AS point_count,
    CASE WHEN l_linenumber <> 5 THEN 1 END AS point_base_multiplier,
    CAST(CAST(floor(l_extendedprice / l_quantity / 100) AS BIGINT) AS VARCHAR) || 'ポイント' AS point_text_raw,
    CASE WHEN l_discount > 0.05 THEN CAST(l_quantity AS BIGINT) END AS coupon_discount,
    CASE WHEN l_discount > 0.05 THEN 'exact' END AS coupon_type,
    CASE WHEN l_linenumber % 2 = 0 THEN 0 WHEN l_linenumber % 3 = 0 THEN 550 END AS shipping_cost,
    CASE WHEN l_linestatus = 'O' THEN '翌日お届け' END AS delivery_text,
    l_linenumber % 2 = 0 AS is_free_shipping,
    CASE WHEN l_tax > 0.0 THEN l_tax * 50 END AS review_score,
    CASE WHEN l_tax > 0.0 THEN CAST(l_quantity AS BIGINT) END AS review_count,
    CAST(l_suppkey AS VARCHAR) AS shop_code,
    'https://img.example.com/' || CAST(l_partkey AS VARCHAR) || '.jpg' AS image_url,
    l_discount >= 0.1 AS is_super_deal, CASE WHEN l_linenumber = 7 THEN 'html' ELSE 'json' END AS data_source,
    l_shipdate AS observed_at, l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_linestatus
  FROM lineitem WHERE l_returnflag = 'N')"""

DETAIL_OBS = """detail_obs AS (SELECT
    CAST(l_suppkey AS VARCHAR) || ':' || CAST(l_partkey AS VARCHAR) AS product_uid,
    CAST(floor(l_extendedprice / l_quantity) AS BIGINT) AS price_min,
    CAST(floor(l_extendedprice / l_quantity) AS BIGINT) AS price_max,
    CASE WHEN l_discount > 0.05 THEN CAST(l_quantity AS BIGINT) * 10 END AS coupon_yen,
    CASE WHEN l_discount > 0.08 THEN round(l_discount * 100) END AS coupon_percent,
    CASE WHEN l_linenumber <> 4 THEN '[]' END AS variant_data_json,
    CASE WHEN l_linenumber <> 3 THEN l_linenumber - 1 END AS variant_count,
    l_shipdate AS observed_at, l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_linestatus
  FROM lineitem WHERE l_returnflag = 'R')"""

OBS_LAST = "observed_at DESC, l_orderkey DESC, l_linenumber DESC, l_quantity DESC, l_extendedprice DESC, l_discount DESC, l_tax DESC, l_linestatus DESC"

BROWSE = """browse AS (SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, json_extract_string(props, '$.k') AS shop_code,
    ts AS browsed_at FROM events WHERE event_type IN ('view', 'click'))"""
EVENTS_AS_OF = "(SELECT max(ts) FROM events)"

JOBS = """jobs AS (SELECT o_orderkey AS id,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'api_discovery' WHEN '2-HIGH' THEN 'list_scrape' ELSE 'detail_scrape' END AS job_type,
    'https://item.example.com/' || CAST(o_custkey % 10 AS VARCHAR) || '/' || CAST(o_custkey AS VARCHAR) || '/' AS target_url,
    CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'pending' ELSE 'running' END AS status,
    CAST(o_orderkey % 5 AS INTEGER) AS attempts, 3 AS max_attempts,
    CASE WHEN o_orderstatus = 'P' THEN 'worker' END AS locked_by,
    CASE WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 0 THEN o_orderdate END AS locked_at,
    CASE WHEN o_orderstatus <> 'O' THEN o_orderdate END AS started_at,
    CASE WHEN o_orderkey % 3 = 0 THEN 'timeout' END AS error_message,
    o_orderdate AS created_at,
    CASE WHEN o_orderstatus = 'F' THEN o_orderdate + to_seconds(o_orderkey % 60) END AS completed_at FROM orders)"""
JOBS_AS_OF = "(SELECT max(o_orderdate) FROM orders)"

EDGES = """edges AS (SELECT 0 AS parent_id, r_regionkey + 100 AS child_id FROM region
  UNION ALL SELECT n_regionkey + 100, n_nationkey + 1000 FROM nation)"""

TARGETS = """targets AS (SELECT s_suppkey AS id, 'shop' AS target_type, CAST(s_suppkey AS VARCHAR) AS target_value,
    s_nationkey % 3 <> 0 AS is_active, s_nationkey * 5 AS priority, 'manual' AS added_by FROM supplier
  UNION ALL SELECT min(p_partkey) + 1000000000, 'genre', p_type, true, 10, 'manual' FROM part GROUP BY p_type)"""


def price_sql(mode: str, multiplier: float = 4.0) -> dict[str, str]:
    """SQL of the price arithmetic over columns named as in a snapshot."""
    p = "COALESCE(CAST(price AS DOUBLE), 0.0)"
    coupon = (f"greatest(CAST(COALESCE(coupon_yen, 0) AS BIGINT), "
              f"CAST(floor({p} * COALESCE(coupon_percent, 0.0) / 100) AS BIGINT))")
    points = f"CAST(floor({p} * (CAST({multiplier} AS DOUBLE) + COALESCE(point_rate, 0.0)) / 100) AS BIGINT)"
    back = "CAST(0 AS BIGINT)"
    if mode == "server":
        points = (f"({points} * CASE WHEN COALESCE(point_back_percent, 0) = 0 THEN 1 "
                  f"ELSE CAST(trunc(point_back_percent) AS BIGINT) END)")
    if mode == "client":
        back = f"CAST(floor({p} * COALESCE(point_back_percent, 0.0) / 100) AS BIGINT)"
    whole = "COALESCE(CAST(price AS BIGINT), 0)"
    return {
        "coupon": coupon, "points": points, "back": back,
        "less_points": f"({whole} - {points})",
        "net": f"({whole} - {points} - {back} - {coupon})",
    }
