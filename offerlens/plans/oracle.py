"""The registered queries as SQL, written against the star tables on their own."""

from __future__ import annotations

from offerlens.fixed import FIELD_GROUPS, JOB_STATUSES, JOB_TYPES, REQUIRED_FIELDS, SLICE_STATUSES, SNAPSHOT_THRESHOLDS
from offerlens.plans import domain_sql as V

ORACLE: dict[str, str] = {}


def _with(*views: str, body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(views) + "\n" + body


def _ts(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%d %H:%M:%S')"


def _day(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%d')"


S, C, X = V.price_sql("server"), V.price_sql("chart"), V.price_sql("client")

# price and JAN comparison -----------------------------------------------------

_OFFERS = (V.OBS, V.SNAP, V.ITEMS, V.VARIANTS)


def _offers(p: dict[str, str]) -> str:
    return f"""offers AS (SELECT v.jan_code, v.variant_uid, i.shop_code, s.price, s.point_rate, s.coupon_yen, s.coupon_percent,
        {p['points']} AS total_points, {p['coupon']} AS effective_coupon, {p['net']} AS effective_price
      FROM variants v JOIN items i USING (product_uid) LEFT JOIN snap s ON s.variant_uid = v.variant_uid
      WHERE v.is_active AND i.is_active AND v.jan_code IS NOT NULL)"""


ORACLE["jan_cheapest_all"] = _with(*_OFFERS, _offers(S), body="""
  SELECT jan_code, variant_uid, shop_code, price, effective_price, offers FROM (
    SELECT *, count(*) OVER (PARTITION BY jan_code) AS offers,
      row_number() OVER (PARTITION BY jan_code ORDER BY effective_price, variant_uid) AS n FROM offers) WHERE n = 1""")
ORACLE["jan_ranked_all"] = _with(*_OFFERS, _offers(C), body="""
  SELECT jan_code, variant_uid, effective_price,
    row_number() OVER (PARTITION BY jan_code ORDER BY effective_price, variant_uid) AS position FROM offers""")

_WIDE = f"""wide AS (SELECT v.variant_uid, v.product_uid, i.shop_code, h.shop_name, h.shop_url, i.item_code, i.item_name, i.canonical_url,
    v.variant_code, v.jan_code, v.variant_name, s.price, s.point_rate, s.point_back_percent, s.coupon_yen, s.coupon_percent,
    s.shipping_text_raw, s.shipping_days_min, s.shipping_days_max, s.image_url, s.fetched_at AS seen_at, {_ts('s.fetched_at')} AS fetched_at,
    count(*) FILTER (v.is_active) OVER (PARTITION BY v.product_uid) AS siblings
  FROM variants v JOIN items i USING (product_uid) LEFT JOIN shops h ON h.shop_code = i.shop_code
  LEFT JOIN snap s ON s.variant_uid = v.variant_uid WHERE i.is_active)"""
_SEARCH = (V.OBS, V.SNAP, V.ITEMS, V.VARIANTS, V.SHOPS, _WIDE)
_ACTIVE = "split_part(variant_uid, ':', 3) <> '6'"

ORACLE["jan_offers_one"] = _with(*_SEARCH, body=f"""
  SELECT * EXCLUDE (seen_at, siblings), {C['points']} AS total_points, {C['coupon']} AS effective_coupon, {C['net']} AS effective_price
  FROM wide WHERE jan_code = '0000000000012' AND {_ACTIVE}""")
ORACLE["jan_effective_modes"] = _with(V.OBS, V.SNAP, body=f"""
  SELECT variant_uid, {S['coupon']} AS coupon, {S['points']} AS server_points, {X['points']} AS client_points,
    {X['back']} AS client_back, {S['less_points']} AS server_less_points,
    {S['net']} AS server_net, {X['net']} AS client_net, {C['net']} AS chart_net FROM snap""")
ORACLE["point_calculation"] = _with(V.OBS, V.SNAP, body=f"""
  SELECT variant_uid, CAST(4.0 AS DOUBLE) AS point_multiplier, price, COALESCE(coupon_yen, 0) AS coupon_yen, coupon_percent,
    point_rate AS plus_x_up, CAST(COALESCE(point_back_percent, 1) AS INTEGER) AS point_back_flag,
    {S['coupon']} AS effective_coupon, {S['points']} AS total_points, {S['less_points']} AS price_minus_points,
    {S['net']} AS price_minus_points_coupon FROM snap""")

# search ------------------------------------------------------------------------


def _page(where: str, order: str, limit: int, offset: int = 0, price: bool = True) -> str:
    cond = f"{_ACTIVE} AND {where}" + (" AND price IS NOT NULL" if price else "")
    return f"SELECT * EXCLUDE (seen_at, siblings) FROM wide WHERE {cond} ORDER BY {order}, variant_uid LIMIT {limit} OFFSET {offset}"


_UP, _DOWN = "price ASC NULLS FIRST", "price DESC NULLS LAST"
ORACLE["search_price_asc"] = _with(*_SEARCH, body=_page("true", _UP, 50))
ORACLE["search_price_desc"] = _with(*_SEARCH, body=_page("true", _DOWN, 50, 100))
# Names in mixed case and offers without a price.
_GAPS = (V.OBS, V.SNAP.replace("snap AS", "snap0 AS", 1), V.ITEMS.replace("items AS", "items0 AS", 1),
         "snap AS (SELECT * REPLACE (CASE WHEN variant_uid NOT LIKE '%:5' THEN price END AS price) FROM snap0)",
         "items AS (SELECT * REPLACE (CASE WHEN CAST(item_code AS BIGINT) % 3 = 0 THEN upper(item_name) ELSE item_name END AS item_name) FROM items0)",
         V.VARIANTS, V.SHOPS, _WIDE)
_NET = f"net AS (SELECT *, CASE WHEN price IS NOT NULL THEN {S['net']} END AS effective_price FROM wide)"
ORACLE["search_updated"] = _with(*_GAPS, body=_page("seen_at IS NOT NULL", "seen_at DESC NULLS LAST", 50, price=False))
ORACLE["search_effective"] = _with(*_GAPS, _NET, body=_page(
    "jan_code IS NOT NULL", "effective_price ASC NULLS LAST", 100, price=False).replace("FROM wide", "FROM net"))
ORACLE["search_effective_unpriced"] = _with(*_GAPS, _NET, body="SELECT variant_uid, price, effective_price FROM (" + _page(
    "shop_code = '7'", "effective_price ASC NULLS LAST", 100, price=False).replace("FROM wide", "FROM net") + ")")
ORACLE["search_name"] = _with(*_GAPS, body=_page("item_name ILIKE '%ring%'", "lower(item_name) ASC NULLS FIRST", 100, price=False))
ORACLE["search_filters"] = _with(*_SEARCH, body=_page(
    "jan_code IS NOT NULL AND (coupon_yen > 0 OR coupon_percent > 0) AND price BETWEEN 1000 AND 1500 AND shipping_days_min <= 1", _UP, 100))
ORACLE["search_updated_24h"] = _with(*_SEARCH, body=_page(
    "seen_at >= (SELECT max(l_shipdate) FROM lineitem) - INTERVAL 24 HOUR", _UP, 100))
ORACLE["search_shop_jan"] = _with(*_SEARCH, body=f"""SELECT * FROM ({_page("shop_code = '7' AND jan_code IS NOT NULL", _DOWN, 100)})
  UNION ALL SELECT * FROM ({_page("jan_code = '0000000000012'", _UP, 100)})""")
ORACLE["search_multi_variant"] = _with(*_SEARCH, body=_page("siblings > 1", _UP, 100))
ORACLE["variant_counts"] = _with(V.VARIANTS, body="""
  SELECT product_uid, count(*) AS variant_count FROM variants WHERE is_active GROUP BY 1 HAVING count(*) > 1""")
ORACLE["search_count"] = _with(*_SEARCH, body=f"""
  SELECT kind, total, CAST(ceil(total / 50.0) AS BIGINT) AS pages FROM (
    SELECT 'all' AS kind, count(*) AS total FROM snap WHERE price IS NOT NULL
    UNION ALL SELECT 'coupon', count(*) FROM wide WHERE {_ACTIVE} AND price IS NOT NULL AND (coupon_yen > 0 OR coupon_percent > 0)
    UNION ALL SELECT 'jan', count(*) FROM wide WHERE {_ACTIVE} AND jan_code IS NOT NULL
    UNION ALL SELECT 'variants', count(*) FROM wide WHERE {_ACTIVE} AND siblings > 1
    UNION ALL SELECT 'name', count(*) FROM wide WHERE {_ACTIVE} AND item_name ILIKE '%widget%' AND price <= 2000)""")
ORACLE["search_count_stored"] = ORACLE["search_count"]
ORACLE["jan_cheapest_stored"] = ORACLE["jan_cheapest_all"]
ORACLE["search_keyset_page"] = _with(*_SEARCH, body=f"SELECT variant_uid, product_uid, price FROM ({_page('true', _UP, 50, 50)})")

ORACLE["search_keyset_orders"] = _with(*_GAPS, _NET, body=" UNION ALL ".join(
    f"SELECT '{name}' AS sort_by, variant_uid, product_uid FROM ({_page(where, order, 50, 50, price=False).replace('FROM wide', 'FROM net')})"
    for name, where, order in (
        ("price_desc", "price IS NOT NULL", _DOWN), ("updated", "seen_at IS NOT NULL", "seen_at DESC NULLS LAST"),
        ("name", "true", "lower(item_name) ASC NULLS FIRST"), ("effective", "true", "effective_price ASC NULLS LAST"))))
ORACLE["search_far_page"] = _with(*_SEARCH, body=_page("true", _UP, 50).replace(
    "LIMIT 50 OFFSET 0", f"LIMIT 50 OFFSET (SELECT greatest(count(*) // 50 - 1, 0) * 50 FROM wide WHERE {_ACTIVE} AND price IS NOT NULL)"))

# product detail -----------------------------------------------------------------

_PRODUCT = """p AS (SELECT i.product_uid, h.shop_name, i.item_name, i.canonical_url, v.variant_uid, v.variant_code, v.jan_code,
    s.price, nullif(s.point_rate, 0) AS point_rate, s.coupon_yen, nullif(s.coupon_percent, 0) AS coupon_percent, s.source
  FROM items i LEFT JOIN (SELECT * FROM variants WHERE is_active) v USING (product_uid) LEFT JOIN snap s ON s.variant_uid = v.variant_uid
  LEFT JOIN shops h ON h.shop_code = i.shop_code WHERE i.is_active)"""
_DETAIL = (V.OBS, V.SNAP, V.ITEMS, V.VARIANTS, V.SHOPS, _PRODUCT)
ORACLE["product_detail_rows"] = _with(*_DETAIL, body="SELECT * FROM p")
ORACLE["product_detail_nested"] = _with(*_DETAIL, body="""
  SELECT product_uid, shop_name, 0 AS part, COALESCE(string_agg(variant_code, ',' ORDER BY variant_code), '') AS codes,
    COALESCE(string_agg(CAST(price AS VARCHAR), ',' ORDER BY variant_code), '') AS prices FROM p GROUP BY 1, 2""")
ORACLE["product_jan"] = _with(V.VARIANTS, body="""
  SELECT product_uid, COALESCE(max(CASE WHEN variant_code = '3' THEN jan_code END), arg_min(jan_code, variant_code) FILTER (jan_code IS NOT NULL)) AS jan_code
  FROM variants GROUP BY 1""")

# snapshot and history -------------------------------------------------------------

_STATE = f"""variant_uid, price, point_rate, point_back_percent, coupon_yen, coupon_percent, shipping_text_raw, shipping_days_min,
  shipping_days_max, {_ts('fetched_at')} AS fetched_at, source"""
ORACLE["snapshot_latest"] = _with(V.OBS_PART, V.SNAP, body=f"SELECT {_STATE} FROM snap")
ORACLE["daily_history"] = _with(V.OBS_PART, V.DAILY, body=f"""
  SELECT {_STATE.replace('shipping_text_raw, ', '')}, {_day('record_date')} AS record_date FROM hist""")

# Compares the measures themselves instead of a hash over them.
_MEASURED = ("price", "point_rate", "point_back_percent", "coupon_yen", "coupon_percent", "shipping_text_raw", "shipping_days_min",
             "shipping_days_max", "image_url")
_BODY = "struct_pack(" + ", ".join(f"{m} := {m}" for m in _MEASURED) + ")"
_WRITTEN = f"""w AS (SELECT * FROM (SELECT *, {_BODY} AS body, lag({_BODY}) OVER o AS before, row_number() OVER o AS n FROM obs
    WINDOW o AS (PARTITION BY variant_uid ORDER BY {V.FIRST_FIRST})) WHERE n = 1 OR before IS DISTINCT FROM body)"""
ORACLE["change_log"] = _with(V.OBS_PART, _WRITTEN, body=f"""
  SELECT variant_uid, {_day('fetched_at')} AS record_date, price, coupon_yen, coupon_percent, point_rate, source FROM w
  QUALIFY row_number() OVER (PARTITION BY variant_uid, CAST(fetched_at AS DATE) ORDER BY {V.LAST_FIRST}) = 1""")

ORACLE["change_log_coarse"] = _with(V.OBS_PART, body=f"""
  SELECT variant_uid, {_ts('fetched_at')} AS fetched_at, step AS price FROM (
    SELECT *, lag(step) OVER (PARTITION BY variant_uid ORDER BY fetched_at, seq, l_linenumber, quantity, step, l_suppkey, l_returnflag) AS before
    FROM (SELECT *, price // 2000 AS step FROM obs)) WHERE step IS DISTINCT FROM before""")

_HALF = "TIMESTAMP '1999-01-01'"
# The last stored row, then every newer row that differs from the row before it.
_UPSERTED = f"""w AS (SELECT * FROM (SELECT *, {_BODY} AS body, lag({_BODY}) OVER o AS before, row_number() OVER o AS n,
      row_number() OVER (PARTITION BY variant_uid, fetched_at < {_HALF} ORDER BY {V.LAST_FIRST}) AS back FROM obs
    WINDOW o AS (PARTITION BY variant_uid ORDER BY {V.FIRST_FIRST}))
  WHERE (fetched_at < {_HALF} AND back = 1) OR (fetched_at >= {_HALF} AND (n = 1 OR before IS DISTINCT FROM body)))"""
ORACLE["snapshot_upsert"] = _with(V.OBS_PART, _UPSERTED, body=f"""
  SELECT variant_uid, price, coupon_yen, coupon_percent, point_rate, {_ts('fetched_at')} AS fetched_at FROM w
  QUALIFY row_number() OVER (PARTITION BY variant_uid ORDER BY {V.LAST_FIRST}) = 1""")
ORACLE["snapshot_batch_upsert"] = _with(V.OBS_PART, V.DAILY, body=f"""
  SELECT {_day('record_date')} AS record_date, count(*) AS rows, CAST(sum(price) AS BIGINT) AS price_sum FROM hist GROUP BY record_date""")
_AS_OF = "(SELECT max(l_shipdate) FROM lineitem)"
_HCOLS = f"variant_uid, {_day('record_date')} AS record_date, price, point_rate, coupon_yen, coupon_percent"
ORACLE["history_window"] = _with(V.OBS_PART, V.DAILY, body=f"""
  SELECT {_HCOLS} FROM hist WHERE record_date >= CAST({_AS_OF} AS DATE) - 90""")
ORACLE["history_one"] = _with(V.OBS_PART, V.DAILY, body=f"""
  SELECT {_HCOLS} FROM hist WHERE variant_uid = '12' AND record_date >= CAST({_AS_OF} AS DATE) - 730""")
ORACLE["batch_history"] = _with(V.OBS_PART, V.DAILY, body=f"""
  SELECT q.variant_uid, 365 AS days, CAST(count(h.price) OVER (PARTITION BY q.variant_uid) AS INTEGER) AS entries,
    {_day('h.record_date')} AS record_date, h.price
  FROM (VALUES ('12'), ('5'), ('no such'), ('77')) q(variant_uid)
  LEFT JOIN hist h ON h.variant_uid = q.variant_uid AND h.record_date >= CAST({_AS_OF} AS DATE) - 365""")
ORACLE["history_arrays"] = _with(V.OBS_PART, V.DAILY, body=f"""
  SELECT variant_uid, string_agg({_day('record_date')} || '=' || CAST(price AS VARCHAR), ',' ORDER BY record_date) AS entries
  FROM hist GROUP BY 1""")
_CHANGED = """changed AS (SELECT * FROM (SELECT *, struct_pack(a := price, b := coupon_yen, c := coupon_percent, d := point_rate) AS body,
    lead(struct_pack(a := price, b := coupon_yen, c := coupon_percent, d := point_rate)) OVER o AS newer,
    row_number() OVER (PARTITION BY variant_uid ORDER BY record_date DESC) AS back FROM hist
    WINDOW o AS (PARTITION BY variant_uid ORDER BY record_date)) WHERE back = 1 OR newer IS DISTINCT FROM body)"""
ORACLE["display_changes"] = _with(V.OBS_PART, V.DAILY, _CHANGED, body=f"""
  SELECT variant_uid, {_day('record_date')} AS record_date, price, coupon_yen, coupon_percent, point_rate FROM changed""")
ORACLE["priced_history_changes"] = _with(V.OBS_PART, V.DAILY, _CHANGED, body=f"""
  SELECT variant_uid, {_day('record_date')} AS record_date, price, {C['points']} AS points, {C['less_points']} AS price_minus_points,
    {C['coupon']} AS coupon, {C['net']} AS effective_price
  FROM changed WHERE record_date BETWEEN DATE '1998-01-01' AND DATE '2000-12-31'""")
_STEPS = "hist AS (SELECT variant_uid, record_date, price // 2000 AS price, NULL AS coupon_yen, NULL AS coupon_percent, NULL AS point_rate FROM daily)"
ORACLE["display_changes_coarse"] = _with(V.OBS_PART, V.DAILY.replace("hist AS", "daily AS", 1), _STEPS, _CHANGED, body=f"""
  SELECT variant_uid, {_day('record_date')} AS record_date, price FROM changed""")

# stored tables ---------------------------------------------------------------------

ORACLE["history_stored"] = _with(V.OBS_PART, V.DAILY, body=f"""
  SELECT {_HCOLS} FROM hist WHERE record_date BETWEEN DATE '1997-03-10' AND DATE '1998-08-20'""")
ORACLE["observations_stored"] = _with(V.LIST_OBS, body=f"""
  SELECT {_day("date_trunc('quarter', observed_at)")} AS observed_date, count(*) AS rows, CAST(sum(observed_price) AS BIGINT) AS prices, count(coupon_discount) AS coupons,
    count(*) FILTER (is_free_shipping) AS free, max(shop_code) AS last_shop FROM list_obs GROUP BY 1""")
ORACLE["history_exported"] = _with(V.OBS_PART, V.DAILY, body=f"""
  SELECT {_day('record_date')} AS record_date, COALESCE(price, 0) AS price, {C['points']} AS points, {C['less_points']} AS price_minus_points,
    {C['coupon']} AS coupon, {C['net']} AS effective_price FROM hist""")

# merges ---------------------------------------------------------------------------

_BATCH = """b AS (SELECT CAST(l_suppkey AS VARCHAR) AS shop_code, CAST(l_partkey AS VARCHAR) AS item_code,
    CASE WHEN l_linenumber = 7 THEN 'extension' WHEN l_returnflag = 'A' THEN 'api' WHEN l_returnflag = 'N' THEN 'list' ELSE 'detail' END AS source,
    l_shipdate AS fetched_at,
    CASE WHEN l_linenumber % 2 = 0 THEN 'name ' || l_linenumber END AS item_name,
    CASE WHEN l_linenumber % 3 = 0 THEN 'copy ' || l_linenumber END AS catchcopy,
    CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS genre_id,
    CASE WHEN l_returnflag = 'A' THEN l_suppkey || ':' || l_partkey END AS api_item_code,
    'https://item.example.com/' || l_linenumber || '/' AS canonical_url,
    {'a': l_shipdate, 'b': l_orderkey, 'c': l_linenumber, 'd': l_returnflag} AS seq FROM lineitem)"""


def _last(col: str) -> str:
    return f"arg_max({col}, seq) FILTER ({col} IS NOT NULL) AS {col}"


_MERGED = f"""
  SELECT shop_code, item_code, {_last('api_item_code')}, {_last('canonical_url')}, {_last('item_name')}, {_last('catchcopy')}, {_last('genre_id')},
    bool_or(source = 'api') AS seen_in_api, bool_or(source = 'list') AS seen_in_list, bool_or(source = 'detail') AS seen_in_detail,
    bool_or(source = 'extension') AS seen_in_ext, {_ts("min(fetched_at) FILTER (source = 'extension')")} AS ext_first_seen,
    count(*) FILTER (source = 'extension') AS ext_view_count, bool_or(source <> 'extension') AS in_server_crawl
  FROM b GROUP BY 1, 2"""
ORACLE["merge_items_fold"] = _with(_BATCH, body=_MERGED)
ORACLE["merge_items_two_batches"] = _with(_BATCH, body=_MERGED)
ORACLE["merge_shops_coalesce"] = _with(V.SHOPS, """b AS (SELECT CAST(l_suppkey AS VARCHAR) AS shop_code,
    arg_max('shop ' || l_linenumber, {'a': l_shipdate, 'b': l_orderkey, 'c': l_linenumber}) AS shop_name FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY 1)""",
    body="SELECT shop_code, COALESCE(b.shop_name, shops.shop_name) AS shop_name, shop_url FROM shops LEFT JOIN b USING (shop_code)")
ORACLE["merge_variants_coalesce"] = """
  SELECT CAST(l_suppkey AS VARCHAR) AS shop_code, CAST(l_partkey AS VARCHAR) AS item_code, CAST(l_linenumber AS VARCHAR) AS variant_code,
    max(CASE WHEN l_returnflag = 'R' THEN lpad(CAST(l_partkey AS VARCHAR), 13, '0') END) AS jan_code,
    arg_max('name ' || l_returnflag, {'a': l_shipdate, 'b': l_orderkey, 'c': l_returnflag}) FILTER (l_returnflag <> 'A') AS variant_name
  FROM lineitem GROUP BY 1, 2, 3"""
ORACLE["mark_for_crawl"] = _with(V.ITEMS, V.BROWSE, body="""
  SELECT product_uid, seen_in_detail OR product_uid IN (SELECT shop_code || ':' || shop_code FROM browse) AS in_server_crawl FROM items""")
ORACLE["merge_targets_manual"] = _with(V.TARGETS, """t AS (SELECT * FROM targets WHERE target_type = 'shop')""",
    """w AS (SELECT k || c_nationkey AS target_value, CAST(count(*) AS INTEGER) AS priority FROM customer, (VALUES (''), ('n')) v(k) GROUP BY 1)""", body="""
  SELECT 'shop' AS target_type, target_value, CASE WHEN w.priority IS NOT NULL THEN true ELSE t.is_active END AS is_active,
    COALESCE(w.priority, t.priority) AS priority, 'manual' AS added_by,
    CASE WHEN w.priority IS NOT NULL THEN 'u' || target_value END AS base_url FROM t FULL JOIN w USING (target_value)""")
_COUNTS = "counts AS (SELECT CAST(browsed_at AS DATE) AS ranking_date, shop_code, count(*) AS browse_count FROM browse GROUP BY 1, 2)"
_RANKED = """ranked AS (SELECT *, row_number() OVER (PARTITION BY ranking_date ORDER BY browse_count DESC, shop_code) AS rank_position FROM counts)"""
ORACLE["merge_targets_greatest"] = _with(V.TARGETS, V.BROWSE, _COUNTS, _RANKED, """w AS (SELECT shop_code AS target_value FROM ranked
    WHERE ranking_date = (SELECT max(ranking_date) FROM ranked) AND rank_position <= 3)""", body=f"""
  SELECT COALESCE(t.target_type, 'shop') AS target_type, COALESCE(t.target_value, w.target_value) AS target_value,
    CASE WHEN w.target_value IS NOT NULL THEN true ELSE t.is_active END AS is_active,
    CASE WHEN w.target_value IS NOT NULL THEN greatest(COALESCE(t.priority, 100), 100) ELSE t.priority END AS priority,
    COALESCE(t.added_by, 'auto_ranking') AS added_by,
    CASE WHEN t.target_value IS NULL THEN 'https://search.example.com/search/mall/?sid=' || w.target_value END AS base_url,
    CASE WHEN w.target_value IS NOT NULL THEN {_ts(V.EVENTS_AS_OF)} END AS updated_at
  FROM targets t FULL JOIN w ON t.target_type = 'shop' AND t.target_value = w.target_value""")
ORACLE["merge_targets_discovered"] = _with(V.TARGETS, """w AS (SELECT n_name AS target_value FROM nation UNION SELECT p_type FROM part)""", body=f"""
  SELECT COALESCE(t.target_type, 'genre') AS target_type, COALESCE(t.target_value, w.target_value) AS target_value,
    CASE WHEN w.target_value IS NOT NULL THEN true ELSE t.is_active END AS is_active, COALESCE(t.priority, 10) AS priority,
    COALESCE(t.added_by, 'auto_discovery') AS added_by,
    CASE WHEN w.target_value IS NOT NULL AND t.target_value IS NOT NULL THEN {_ts(_AS_OF)} END AS last_crawled_at
  FROM targets t FULL JOIN w ON t.target_type = 'genre' AND t.target_value = w.target_value""")
ORACLE["targets_deactivated"] = _with(V.TARGETS, body=f"""
  SELECT target_type, target_value, is_active AND id NOT IN (1, 5, 7) AS is_active,
    CASE WHEN target_type = 'shop' AND is_active AND id NOT IN (1, 5, 7) THEN {_day(_AS_OF)} END AS last_crawled_at FROM targets""")
ORACLE["targets_listed"] = _with(V.TARGETS, body="""
  SELECT row_number() OVER (ORDER BY priority DESC, id) AS place, id, priority FROM targets WHERE target_type = 'shop' AND is_active""")

# ranking ----------------------------------------------------------------------------


def _live(hours: int, limit: int) -> str:
    return f"""live AS (SELECT row_number() OVER (ORDER BY n DESC, shop_code) AS rank, shop_code, shop_name, n AS browse_count FROM (
      SELECT b.shop_code, s.shop_name, count(*) AS n FROM browse b LEFT JOIN shops s ON s.shop_code = b.shop_code
      WHERE browsed_at >= {V.EVENTS_AS_OF} - INTERVAL {hours} HOUR GROUP BY 1, 2) ORDER BY rank LIMIT {limit})"""


# A stream emits windows that the watermark, an hour behind the last event, has passed.
_DONE = "(SELECT max(browsed_at) - INTERVAL 1 HOUR FROM browse)"
ORACLE["stream_live_ranking"] = _with(V.BROWSE, V.SHOPS, f"""frame AS (SELECT date_trunc('hour', {_DONE}) AS stop)""", f"""live AS (
    SELECT shop_code, count(*) AS browse_count FROM browse, frame
    WHERE shop_code IS NOT NULL AND browsed_at >= stop - INTERVAL 24 HOUR AND browsed_at < stop GROUP BY 1)""", body="""
  SELECT row_number() OVER (ORDER BY browse_count DESC, shop_code) AS rank, shop_code, shop_name, browse_count
  FROM live LEFT JOIN shops USING (shop_code) ORDER BY rank LIMIT 20""")
ORACLE["stream_daily_ranking"] = _with(V.BROWSE, body=f"""
  SELECT {_day('day')} AS ranking_date, shop_code, browse_count, row_number() OVER (PARTITION BY day ORDER BY browse_count DESC, shop_code) AS rank_position
  FROM (SELECT CAST(browsed_at AS DATE) AS day, shop_code, count(*) AS browse_count FROM browse GROUP BY 1, 2) WHERE day + INTERVAL 1 DAY <= {_DONE}""")
ORACLE["stream_view_counts"] = _with(V.BROWSE, body=f"""
  SELECT shop_code AS item, {_ts('min(browsed_at)')} AS first_seen, {_ts('max(browsed_at)')} AS last_seen, count(*) AS views FROM browse
  WHERE shop_code IS NOT NULL AND date_trunc('hour', browsed_at) + INTERVAL 1 HOUR <= {_DONE} GROUP BY 1""")
ORACLE["ranking_live"] = _with(V.BROWSE, V.SHOPS, _live(24, 20), body="SELECT * FROM live")
ORACLE["ranking_daily_all"] = _with(V.BROWSE, _COUNTS, _RANKED, body=f"""
  SELECT {_day('ranking_date')} AS ranking_date, shop_code, browse_count, rank_position FROM ranked""")
ORACLE["ranking_daily_latest"] = _with(V.BROWSE, V.SHOPS, _COUNTS, _RANKED, """l AS (SELECT shop_code, browse_count,
    CASE WHEN rank_position % 4 <> 0 THEN rank_position END AS rank_position FROM ranked WHERE ranking_date = (SELECT max(ranking_date) FROM ranked))""", body="""
  SELECT COALESCE(rank_position, row_number() OVER (ORDER BY rank_position NULLS FIRST, shop_code)) AS rank, shop_code, shop_name, browse_count
  FROM l LEFT JOIN shops USING (shop_code) ORDER BY rank_position NULLS FIRST, shop_code LIMIT 50""")
ORACLE["ranking_full"] = _with(V.BROWSE, body=f"""
  SELECT {_day(V.EVENTS_AS_OF)} AS ranking_date, shop_code, count(*) AS browse_count,
    row_number() OVER (ORDER BY count(*) DESC, shop_code) AS rank_position
  FROM browse WHERE browsed_at >= {V.EVENTS_AS_OF} - INTERVAL 168 HOUR GROUP BY shop_code""")
ORACLE["ranking_share"] = _with(V.BROWSE, V.SHOPS, _live(168, 100), body="""
  SELECT *, CAST(floor(browse_count * 100.0::DOUBLE / max(browse_count) OVER () + 0.5) AS BIGINT) AS share FROM live""")
ORACLE["ranking_sliding"] = _with(V.BROWSE, body=f"""
  SELECT {_ts('s')} AS start, {_ts('s + INTERVAL 24 HOUR')} AS "end", shop_code, count(*) AS browse_count
  FROM (SELECT shop_code, date_trunc('hour', browsed_at) - to_hours(k) AS s FROM browse, range(0, 24) r(k)) GROUP BY s, shop_code""")

# retention ---------------------------------------------------------------------------

ORACLE["retention_history"] = _with(V.OBS_PART, V.DAILY, body=f"""
  SELECT variant_uid, count(*) AS rows, {_day('min(record_date)')} AS first_date FROM hist
  WHERE record_date >= CAST({_AS_OF} AS DATE) - 730 GROUP BY 1""")
ORACLE["retention_events"] = _with(V.BROWSE, body=f"""
  SELECT event_id, user_id, shop_code, {_ts('browsed_at')} AS browsed_at FROM browse WHERE browsed_at >= {V.EVENTS_AS_OF} - INTERVAL 7 DAY""")
ORACLE["history_trimmed"] = ORACLE["retention_history"]
ORACLE["events_trimmed"] = ORACLE["retention_events"]
ORACLE["retention_items"] = f"""WITH e AS (SELECT l_suppkey || ':' || l_partkey AS product_uid, bool_or(l_linenumber = 7) AS seen_in_ext,
    min(l_shipdate) FILTER (l_linenumber = 7) AS first_seen, count(*) FILTER (l_linenumber = 7) AS views, bool_or(l_linenumber = 1) AS in_crawl,
    l_partkey % 11 <> 0 AS is_active FROM lineitem GROUP BY l_suppkey, l_partkey),
  g AS (SELECT product_uid FROM (SELECT product_uid, row_number() OVER (ORDER BY views, first_seen, product_uid) AS n FROM e
      WHERE seen_in_ext AND is_active AND NOT in_crawl AND first_seen < {_AS_OF} - INTERVAL 2 MONTH),
      (SELECT count(*) - 100 AS excess FROM e WHERE seen_in_ext AND is_active)
    WHERE excess > 0 AND n <= excess + 20)
  SELECT product_uid, seen_in_ext, is_active AND product_uid NOT IN (SELECT product_uid FROM g) AS is_active FROM e"""

# jobs ----------------------------------------------------------------------------------

ORACLE["new_jobs_anti"] = _with(V.JOBS, body="""
  SELECT 'detail_scrape' AS job_type, target_url, product_uid, 'pending' AS status FROM (
    SELECT 'https://item.example.com/' || (c_custkey % 10) || '/' || c_custkey || '/' AS target_url, (c_custkey % 10) || ':' || c_custkey AS product_uid FROM customer)
  WHERE target_url NOT IN (SELECT target_url FROM jobs WHERE job_type = 'detail_scrape' AND status IN ('pending', 'running'))""")
_NEXT = """n AS (SELECT id FROM jobs WHERE job_type = 'detail_scrape' AND status = 'pending' AND attempts < max_attempts ORDER BY created_at, id LIMIT 500)"""
ORACLE["next_job_batch"] = _with(V.JOBS, _NEXT, body=f"""
  SELECT id, target_url, 'running' AS status, attempts + 1 AS attempts, {_ts(V.JOBS_AS_OF)} AS started_at FROM jobs JOIN n USING (id)""")
ORACLE["job_table_after_batch"] = _with(V.JOBS, _NEXT, body="""
  SELECT job_type, CASE WHEN n.id IS NULL THEN status ELSE 'running' END AS status, attempts + (n.id IS NOT NULL)::INTEGER AS attempts, count(*) AS jobs
  FROM jobs LEFT JOIN n USING (id) GROUP BY 1, 2, 3""")
_STALE = f"(status = 'running' AND COALESCE(locked_at, started_at) < {V.JOBS_AS_OF} - INTERVAL 60 MINUTE AND attempts < max_attempts)"
_SPENT = "(status IN ('pending', 'running') AND attempts >= max_attempts)"
ORACLE["stale_jobs_repair"] = _with(V.JOBS, body=f"""
  SELECT id, CASE WHEN {_STALE} THEN 'pending' WHEN {_SPENT} THEN 'failed' ELSE status END AS status,
    CASE WHEN NOT {_STALE} THEN locked_by END AS locked_by, CASE WHEN NOT {_STALE} THEN {_ts('locked_at')} END AS locked_at,
    CASE WHEN {_STALE} THEN COALESCE(error_message, '') || ' | Reset from stale running state'
      WHEN {_SPENT} THEN COALESCE(error_message, '') || ' | Max attempts exceeded' ELSE error_message END AS error_message, attempts FROM jobs""")
_STATUS_COUNTS = ", ".join(f"count(id) FILTER (status = '{s}') AS {s}" for s in JOB_STATUSES)
ORACLE["job_stats"] = _with(V.JOBS, f"""c AS (SELECT t.job_type, {_STATUS_COUNTS}, count(id) AS total
    FROM (VALUES {', '.join(f"('{t}')" for t in JOB_TYPES)}) t(job_type) LEFT JOIN jobs USING (job_type) GROUP BY 1)""", body="""
  SELECT *, CASE WHEN total > 0 THEN done * 100.0::DOUBLE / total ELSE 0.0 END AS success_percent,
    CASE WHEN total = 0 THEN 'WARN' WHEN done * 100.0 / total > 80 THEN 'PASS' WHEN done * 100.0 / total > 50 THEN 'WARN' ELSE 'FAIL' END AS verdict FROM c""")
_ENDED = """jobs AS (SELECT * REPLACE (CASE WHEN job_type = 'api_discovery' AND id % 10 >= 1 OR job_type = 'list_scrape' AND id % 10 >= 3 OR id % 10 >= 6
    THEN 'done' WHEN id % 2 = 0 THEN 'failed' ELSE 'skipped' END AS status) FROM started)"""
ORACLE["job_stats_ended"] = ORACLE["job_stats"].replace(V.JOBS, V.JOBS.replace("jobs AS", "started AS", 1) + ",\n" + _ENDED)
ORACLE["job_daily_stats"] = _with(V.JOBS, body=f"""
  SELECT {_day('created_at')} AS stat_date, job_type, count(*) AS total_jobs, count(*) FILTER (status = 'done') AS success_count,
    count(*) FILTER (status = 'failed') AS fail_count, count(*) FILTER (status = 'skipped') AS skip_count,
    CAST(floor(CAST(sum(epoch_ms(completed_at) - epoch_ms(started_at)) AS DOUBLE) / count(completed_at)) AS BIGINT) AS avg_duration_ms
  FROM jobs GROUP BY 1, 2""")

# planning --------------------------------------------------------------------------------


def _slices(cap: int, where: str = "true") -> tuple[str, ...]:
    """Level by level, as the rule is told: count a range, halve it if it is too full."""
    return (
        f"""priced AS (SELECT p_type AS genre_id, CAST(floor(l_extendedprice / l_quantity) AS BIGINT) AS price, count(*) AS c
            FROM lineitem JOIN part ON p_partkey = l_partkey WHERE {where} GROUP BY 1, 2)""",
        """cum AS (SELECT genre_id, price, CAST(sum(c) OVER (PARTITION BY genre_id ORDER BY price) AS BIGINT) AS upto FROM priced)""",
        f"""r AS (SELECT genre_id, CAST(1 AS BIGINT) AS lo, max(price) AS hi, CAST(sum(c) AS BIGINT) AS n FROM priced GROUP BY 1
            UNION ALL SELECT genre_id, lo, hi,
              COALESCE((SELECT max(upto) FROM cum WHERE cum.genre_id = h.genre_id AND price <= hi), 0)
              - COALESCE((SELECT max(upto) FROM cum WHERE cum.genre_id = h.genre_id AND price < lo), 0)
            FROM (SELECT genre_id, CASE k WHEN 0 THEN lo ELSE (lo + hi) // 2 + 1 END AS lo, CASE k WHEN 0 THEN (lo + hi) // 2 ELSE hi END AS hi
              FROM r, range(0, 2) t(k) WHERE n > {cap} AND lo < hi) h)""",
        f"""slices AS (SELECT genre_id, lo AS min_price, hi AS max_price, n AS estimated_count, n > {cap} AS unsplittable FROM r WHERE n <= {cap} OR lo = hi)""",
    )


ORACLE["price_slices"] = _with(*_slices(3000), body="SELECT * FROM slices", recursive=True)
ORACLE["price_slices_fine"] = _with(*_slices(5), body="SELECT * FROM slices", recursive=True)
ORACLE["discovery_ranges"] = _with(*_slices(3000), body="""
  SELECT g.genre_id, COALESCE(min_price, 0) AS min_price, max_price, min_price IS NOT NULL AS from_slice
  FROM (SELECT DISTINCT p_type AS genre_id FROM part) g LEFT JOIN (SELECT * FROM slices WHERE estimated_count <= 2000) s USING (genre_id)""", recursive=True)
ORACLE["slice_status"] = _with(*_slices(500), """st AS (SELECT genre_id, CASE WHEN estimated_count = 0 THEN 'done' WHEN estimated_count < 200
    THEN 'in_progress' ELSE 'pending' END AS status FROM slices)""", body=f"""
  SELECT genre_id, {', '.join(f"count(*) FILTER (status = '{s}') AS {s}" for s in SLICE_STATUSES)}, count(*) AS total,
    CASE WHEN count(*) FILTER (status = 'done') > 0 THEN 'PASS' ELSE 'WARN' END AS verdict FROM st GROUP BY 1""", recursive=True)
ORACLE["page_frontier"] = """
  SELECT genre_id, keyword, page, 'https://search.example.com/search/mall/' || keyword || '/' || genre_id || '/?min=' || lo || '&max=' || hi
    || CASE WHEN page > 1 THEN '&p=' || page ELSE '' END AS url FROM (
    SELECT *, unnest(range(1, CAST(ceil(n / 10.0) AS INTEGER) + 1)) AS page FROM (
      SELECT p_type AS genre_id, p_brand AS keyword, count(*) AS n, CAST(min(floor(p_retailprice)) AS BIGINT) AS lo,
        CAST(max(floor(p_retailprice)) AS BIGINT) AS hi FROM part GROUP BY 1, 2))"""
ORACLE["api_page_chain"] = """
  SELECT shop, unnest(range(1, CAST(ceil(n / 30.0) AS INTEGER) + 1)) AS page FROM (SELECT l_suppkey AS shop, count(*) AS n FROM lineitem GROUP BY 1)"""
ORACLE["shop_frontier"] = _with(V.TARGETS, body="""
  SELECT target_value AS shop_code, priority, 'https://search.example.com/search/mall/?sid=' || target_value AS url, 150 AS max_pages
  FROM targets WHERE target_type = 'shop' AND is_active""")
ORACLE["genre_frontier"] = _with(V.EDGES, """walk AS (SELECT 0 AS genre_id, 0 AS d UNION ALL
    SELECT COALESCE(e.child_id, w.genre_id), w.d + 1 FROM walk w LEFT JOIN edges e ON e.parent_id = w.genre_id WHERE w.d < 3)""",
    body="SELECT genre_id, d AS depth FROM walk WHERE d IN (1, 3)", recursive=True)

# quality ----------------------------------------------------------------------------------

_PASS_WARN = "CASE WHEN rate >= 0.5 THEN 'PASS' WHEN rate >= 0.1 THEN 'WARN' ELSE 'FAIL' END"


def _filled(table: str, tests: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{n}' AS field, count(*) FILTER ({t}) AS filled, count(*) AS total FROM {table}" for n, t in tests.items())


_LIST_TESTS = {c: f"{c} IS NOT NULL" for c in (
    "observed_price", "point_count", "point_base_multiplier", "point_text_raw", "coupon_discount", "coupon_type", "shipping_cost",
    "delivery_text", "review_score", "review_count", "shop_code", "image_url")} | {"is_free_shipping": "is_free_shipping", "is_super_deal": "is_super_deal"}
_FILL = f"""f AS (SELECT *, CAST(filled AS DOUBLE) / total AS rate FROM ({_filled('list_obs', _LIST_TESTS)})),
  fill AS (SELECT *, CASE WHEN field IN ('is_free_shipping', 'is_super_deal') THEN 'PASS'
    WHEN rate < 0.1 AND field IN ('coupon_discount', 'coupon_type', 'delivery_text', 'delivery_days', 'shipping_cost') THEN 'PASS' ELSE {_PASS_WARN} END AS status FROM f)"""
ORACLE["quality_fill"] = _with(V.LIST_OBS, _FILL, body="SELECT * FROM fill")
_DETAIL_TESTS = {c: f"{c} IS NOT NULL" for c in ("price_min", "price_max", "variant_data_json", "coupon_yen", "coupon_percent")} | {"variant_count": "variant_count > 0"}
ORACLE["quality_fill_detail"] = _with(V.DETAIL_OBS, f"f AS (SELECT *, CAST(filled AS DOUBLE) / total AS rate FROM ({_filled('detail_obs', _DETAIL_TESTS)}))", body=f"""
  SELECT *, CASE WHEN rate < 0.1 AND field IN ('coupon_yen', 'coupon_percent', 'r_category_id') THEN 'PASS' ELSE {_PASS_WARN} END AS status FROM f""")
_SNAP_TESTS = {n: "coupon_yen IS NOT NULL OR coupon_percent IS NOT NULL" if n == "coupon" else "false" if n == "extra1_key" else f"{n} IS NOT NULL"
               for n, _ in SNAPSHOT_THRESHOLDS}
_SNAPFILL = f"""sf AS (SELECT *, CAST(filled AS DOUBLE) / total AS rate, CASE field {' '.join(f"WHEN '{n}' THEN {t}::DOUBLE" for n, t in SNAPSHOT_THRESHOLDS)} END AS threshold
    FROM ({_filled('snap', _SNAP_TESTS)})),
  snapfill AS (SELECT *, CASE WHEN rate >= threshold THEN 'PASS' WHEN rate > 0 THEN 'WARN' ELSE 'FAIL' END AS status FROM sf)"""
ORACLE["quality_snapshots"] = _with(V.OBS, V.SNAP, _SNAPFILL, body="SELECT * FROM snapfill")
_API_TESTS = {c: f"{c} IS NOT NULL" for c in ("price", "image_url", "point_rate")}
_API = f"""apis AS (SELECT * FROM snap WHERE source = 'api'), af AS (SELECT *, CAST(filled AS DOUBLE) / total AS rate FROM ({_filled('apis', _API_TESTS)})),
  api AS (SELECT *, CASE WHEN rate > CASE field WHEN 'price' THEN 0.9 WHEN 'image_url' THEN 0.8 ELSE 0.5 END THEN 'PASS' ELSE 'WARN' END AS status FROM af)"""
ORACLE["quality_api"] = _with(V.OBS, V.SNAP, _API, body="SELECT * FROM api")
ORACLE["quality_genres"] = _with(V.ITEMS, body="""
  SELECT genre_id, count(*) AS items, CASE WHEN count(*) >= 100 THEN 'PASS' ELSE 'WARN' END AS status FROM items WHERE seen_in_api GROUP BY 1""")
ORACLE["quality_sources"] = _with(V.OBS, V.SNAP, body="SELECT source, count(*) AS rows FROM snap GROUP BY 1")
ORACLE["quality_stages"] = _with(V.ITEMS, body="SELECT seen_in_api, seen_in_list, seen_in_detail, count(*) AS items FROM items GROUP BY 1, 2, 3")
ORACLE["quality_both"] = _with(V.ITEMS, V.LIST_OBS, V.DETAIL_OBS, body="""
  SELECT count(*) AS items FROM items WHERE product_uid IN (SELECT product_uid FROM list_obs) AND product_uid IN (SELECT product_uid FROM detail_obs)""")
ORACLE["quality_history_span"] = _with(V.OBS_PART, V.DAILY, body=f"""
  SELECT count(DISTINCT record_date) AS dates, {_day('min(record_date)')} AS first_date, {_day('max(record_date)')} AS last_date, count(*) AS total_records FROM hist""")
_NEEDS = {
    "points": ("list_obs", "point_count IS NOT NULL AND point_base_multiplier IS NOT NULL"), "coupon": ("list_obs", "coupon_discount IS NOT NULL"),
    "shipping": ("list_obs", "shipping_cost IS NOT NULL OR is_free_shipping"), "reviews": ("list_obs", "review_score IS NOT NULL AND review_count IS NOT NULL"),
    "variant_detail": ("detail_obs", "variant_data_json IS NOT NULL AND variant_count > 0"), "jan": ("variants", "jan_code IS NOT NULL"),
}
ORACLE["quality_needs"] = _with(V.LIST_OBS, V.DETAIL_OBS, V.VARIANTS, body=" UNION ALL ".join(
    f"SELECT '{n}' AS need, count(DISTINCT product_uid) AS items FROM {t} WHERE {w}" for n, (t, w) in _NEEDS.items()))
ORACLE["quality_complete"] = _with(V.OBS, V.SNAP, V.ITEMS, V.VARIANTS, V.LIST_OBS, body="""
  SELECT count(DISTINCT i.product_uid) AS items FROM items i
  JOIN (SELECT product_uid, min(variant_uid) AS variant_uid FROM variants GROUP BY 1) v ON v.product_uid = i.product_uid
  JOIN snap s ON s.variant_uid = v.variant_uid JOIN list_obs l ON l.product_uid = i.product_uid
  WHERE i.item_name IS NOT NULL AND s.price IS NOT NULL AND s.image_url IS NOT NULL AND l.observed_price IS NOT NULL""")
_LAST_LIST = f"ll AS (SELECT * FROM list_obs QUALIFY row_number() OVER (PARTITION BY product_uid ORDER BY {V.OBS_LAST}) = 1)"
_LAST_DETAIL = f"ld AS (SELECT * FROM detail_obs QUALIFY row_number() OVER (PARTITION BY product_uid ORDER BY {V.OBS_LAST}) = 1)"
_TWELVE = ("observed_price", "point_count", "point_text_raw", "coupon_discount", "coupon_type", "shipping_cost", "delivery_text",
           "is_free_shipping", "review_score", "review_count", "is_super_deal", "data_source")
ORACLE["quality_latest_fields"] = _with(V.LIST_OBS, _LAST_LIST, body=f"""
  SELECT product_uid, n AS fields_filled, CASE WHEN n >= 5 THEN 'PASS' ELSE 'WARN' END AS status FROM (
    SELECT product_uid, {' + '.join(f'({c} IS NOT NULL)::INTEGER' for c in _TWELVE)} AS n FROM ll)""")
_LAST_SNAP = """ls AS (SELECT v.product_uid, s.* EXCLUDE (product_uid) FROM snap s JOIN variants v USING (variant_uid)
    QUALIFY row_number() OVER (PARTITION BY v.product_uid ORDER BY fetched_at DESC, variant_uid DESC) = 1)"""
ORACLE["latest_snapshot_per_item"] = _with(V.OBS, V.SNAP, V.VARIANTS, _LAST_SNAP, body=f"""
  SELECT product_uid, {_ts('fetched_at')} AS fetched_at, variant_uid, price, source FROM ls""")
_FIELD_TESTS = {
    "product_uid": "true", "shop_code": "true", "item_code": "true", "item_name": "COALESCE(i.item_name <> '', false)", "canonical_url": "true",
    "api_price": "ls.price IS NOT NULL", "list_price": "ll.observed_price IS NOT NULL", "detail_price_min": "ld.price_min IS NOT NULL",
    "point_count": "ll.point_count IS NOT NULL", "point_base_multiplier": "ll.point_base_multiplier IS NOT NULL",
    "point_text_raw": "ll.point_text_raw IS NOT NULL", "list_coupon": "ll.coupon_discount IS NOT NULL",
    "detail_coupon": "ld.coupon_yen IS NOT NULL OR ld.coupon_percent IS NOT NULL", "shipping_cost": "ll.shipping_cost IS NOT NULL",
    "is_free_shipping": "ll.product_uid IS NOT NULL", "delivery_text": "ll.delivery_text IS NOT NULL", "review_score": "ll.review_score IS NOT NULL",
    "review_count": "ll.review_count IS NOT NULL", "variant_exists": "w.product_uid IS NOT NULL", "jan_code": "COALESCE(w.j, false)",
    "variant_data_json": "ld.variant_data_json IS NOT NULL OR COALESCE(ld.variant_count = 0, false)", "variant_count": "ld.variant_count IS NOT NULL",
    "is_super_deal": "ll.product_uid IS NOT NULL", "is_39_shop": "ld.product_uid IS NOT NULL",
    "image_url": "ls.image_url IS NOT NULL OR ll.image_url IS NOT NULL", "genre_id": "COALESCE(i.genre_id <> '', false)",
}
_CHECKS = f"""checks AS (SELECT i.product_uid AS uid, {', '.join(f'({t}) AS "{n}"' for n, t in _FIELD_TESTS.items())}
  FROM items i LEFT JOIN ls USING (product_uid) LEFT JOIN ll USING (product_uid) LEFT JOIN ld USING (product_uid)
  LEFT JOIN (SELECT product_uid, bool_or(jan_code IS NOT NULL) AS j FROM variants GROUP BY 1) w USING (product_uid))"""
_AUDIT = (V.OBS, V.SNAP, V.ITEMS, V.VARIANTS, V.LIST_OBS, V.DETAIL_OBS, _LAST_LIST, _LAST_DETAIL, _LAST_SNAP, _CHECKS)
_MISSING = "concat_ws(',', " + ", ".join(f"CASE WHEN NOT \"{n}\" THEN '{n}' END" for n in REQUIRED_FIELDS) + ")"
ORACLE["quality_required"] = _with(*_AUDIT, body=f"SELECT uid, {_MISSING} AS missing, {_MISSING} = '' AS complete FROM checks")
_ALL = [(g, n) for g, names in FIELD_GROUPS for n in names]
_TOTALS = "totals AS (" + " UNION ALL ".join(
    f"SELECT '{g}' AS field_group, count(*) FILTER (\"{n}\") AS filled, count(*) AS total FROM checks" for g, n in _ALL) + ")"
ORACLE["quality_score"] = _with(*_AUDIT, _TOTALS, body="""
  SELECT CAST(sum(filled) AS BIGINT) AS filled, CAST(sum(total) AS BIGINT) AS total, CAST(sum(filled) AS BIGINT) * 100.0::DOUBLE / CAST(sum(total) AS BIGINT) AS score FROM totals""")
ORACLE["quality_groups"] = _with(*_AUDIT, _TOTALS, body="""
  SELECT field_group, CAST(sum(filled) AS BIGINT) AS filled, CAST(sum(total) AS BIGINT) AS total FROM totals GROUP BY 1""")
ORACLE["quality_report"] = _with(V.OBS, V.SNAP, V.LIST_OBS, _FILL, _SNAPFILL, _API, """a AS (SELECT status FROM fill UNION ALL SELECT status FROM snapfill
    UNION ALL SELECT status FROM api)""", body="""
  SELECT count(*) FILTER (status = 'PASS') AS passed, count(*) FILTER (status = 'WARN') AS warnings, count(*) FILTER (status = 'FAIL') AS failed,
    count(*) FILTER (status = 'PASS') * 100.0::DOUBLE / count(*) AS score, count(*) FILTER (status = 'FAIL') = 0 AS ok FROM a""")
ORACLE["quality_tables"] = _with(V.SHOPS, V.ITEMS, V.VARIANTS, V.JOBS, V.BROWSE, V.LIST_OBS, V.DETAIL_OBS, V.TARGETS, *_slices(500), body=" UNION ALL ".join(
    f"SELECT '{n}' AS table_name, count(*) AS rows FROM {t}" for n, t in (
        ("shops", "shops"), ("items", "items"), ("variants", "variants"), ("crawl_jobs", "jobs"), ("user_browse_events", "browse"),
        ("list_observations", "list_obs"), ("detail_observations", "detail_obs"), ("crawl_targets", "targets"), ("price_range_slices", "slices"),
        ("variant_snapshots", "variants"), ("variant_daily_history", "(SELECT DISTINCT l_partkey, CAST(l_shipdate AS DATE) FROM lineitem)"),
        ("shop_rankings", "(SELECT DISTINCT shop_code, CAST(browsed_at AS DATE) FROM browse)"),
        ("crawl_stats", "(SELECT DISTINCT CAST(created_at AS DATE), job_type FROM jobs)"))), recursive=True)
ORACLE["tiered_sample"] = _with(V.ITEMS, body="""
  SELECT product_uid, CASE WHEN seen_in_api AND seen_in_list THEN 0 WHEN seen_in_list THEN 1 ELSE 2 END AS tier FROM items WHERE NOT seen_in_detail
  ORDER BY tier, updated_at DESC, product_uid LIMIT 60""")
ORACLE["best_covered_sample"] = _with(V.ITEMS, """t AS (SELECT *, CASE seen_in_api::INTEGER + seen_in_list::INTEGER + seen_in_detail::INTEGER
    WHEN 3 THEN 0 WHEN 2 THEN 1 ELSE 2 END AS tier FROM items)""", body="""
  SELECT product_uid, tier FROM t WHERE tier = (SELECT min(tier) FROM t) ORDER BY updated_at DESC, product_uid LIMIT 25""")

# ingest ----------------------------------------------------------------------------------

_P = "CAST(floor(l_extendedprice / l_quantity) AS BIGINT)"
_QT = "CAST(l_quantity AS BIGINT)"
_TAX = "CAST(round(l_tax * 100) AS INTEGER)"
_ITEM_URL = "'https://item.example.com/' || l_suppkey || '/' || l_partkey || '/'"
ORACLE["api_ingest"] = f"""
  SELECT CAST(l_suppkey AS VARCHAR) AS shop_code, 'shop ' || l_suppkey AS shop_name, 'http://www.example.com/' || l_suppkey || '/' AS shop_url,
    CAST(l_partkey AS VARCHAR) AS item_code, l_suppkey || ':' || l_partkey AS api_item_code,
    {_ITEM_URL} || CASE n WHEN 0 THEN '?color=a+b' ELSE '' END AS canonical_url, 'item ' || l_partkey AS item_name,
    CASE WHEN l_linenumber % 2 <> 0 THEN 'copy' END AS catchcopy,
    CASE WHEN l_linenumber % 3 = 0 OR l_partkey = 0 THEN 'ctx' ELSE CAST(l_partkey AS VARCHAR) END AS genre_id,
    CASE n WHEN 0 THEN CAST(l_linenumber AS VARCHAR) ELSE 'default' END AS variant_code, {_P} AS price, CAST({_TAX} AS DOUBLE) AS point_rate,
    CASE WHEN l_linenumber % 3 = 0 THEN '送料無料' END AS shipping_text_raw,
    CASE n WHEN 0 THEN 'https://img.example.com/' || l_partkey || '.jpg' ELSE 'https://img.example.com/plain.jpg' END AS image_url,
    CASE WHEN {_QT} % 4 > 0 THEN 'review_count' END AS extra1_key, CASE WHEN {_QT} % 4 > 0 THEN CAST({_QT} % 4 AS VARCHAR) END AS extra1_value,
    CASE WHEN {_QT} % 4 > 0 THEN 'review_average' END AS extra2_key, CASE WHEN {_QT} % 4 > 0 THEN '4.5' END AS extra2_value,
    'api' AS source, {_ts('l_shipdate')} AS fetched_at FROM lineitem, range(0, 2) r(n)"""
ORACLE["api_paging"] = """
  SELECT l_orderkey AS seq, 4 AS total_count, l_linenumber AS page_count, unnest(range(1, l_linenumber + 1)) AS page FROM lineitem"""

_UPS = f"(l_linenumber + {_TAX})"
_COMMA = "format('{{:,}}', {})"
_LISTED = f"""listed AS (
  SELECT l_suppkey || ':' || l_partkey AS product_uid, {_ITEM_URL} AS canonical_url, CASE WHEN l_linenumber <> 5 THEN '9' END AS url_variant_id,
    'item ' || l_partkey AS item_name, 'sub' AS item_subtitle, {_P} AS observed_price, CAST({_P} AS VARCHAR) AS price_range,
    CAST(l_linenumber AS VARCHAR) AS variant_id, l_linenumber = 3 AS is_sold_out, 'https://img.example.com/1.jpg' AS image_url, '/0/5/7' AS genre_ids,
    CAST(l_partkey AS VARCHAR) AS leaf_genre_id, 'shop ' || l_suppkey AS shop_name, 'https://www.example.com/' || l_suppkey || '/' AS shop_url,
    {_QT} * 100 AS point_count, 1 AS point_base_multiplier, l_linenumber AS point_shop_multiplier, {_TAX} AS point_up_multiplier,
    1 + {_UPS} AS point_total_multiplier, l_linenumber = 4 AS is_point_back, CASE WHEN l_linenumber = 4 THEN 20.0::DOUBLE END AS point_back_rate,
    {_COMMA.format(f'{_QT} * 100')} || 'ポイント(' || CASE WHEN l_linenumber = 4 THEN '20%ポイントバック' ELSE '1倍+' || {_UPS} || '倍UP' END || ')' AS point_text_raw,
    CASE WHEN l_linenumber <> 1 THEN {_QT} * 50 END AS coupon_discount,
    CASE WHEN l_linenumber = 1 THEN NULL WHEN l_linenumber % 2 = 0 THEN 'exact' ELSE 'percentage' END AS coupon_type,
    CASE WHEN l_linenumber = 1 THEN NULL WHEN l_linenumber % 2 = 0 THEN {_COMMA.format(f'{_QT} * 50')} || '円OFFクーポンあり'
      ELSE {_QT} * 50 || '%OFFクーポンあり' END AS coupon_text_raw,
    CASE WHEN l_linenumber % 2 = 0 THEN 0 ELSE 550 END AS shipping_cost, '明日' AS delivery_text, l_linenumber % 2 = 0 AS is_free_shipping,
    4.5::DOUBLE AS review_score, {_QT} AS review_count, l_linenumber = 2 AS is_super_deal, true AS is_shop39, l_linenumber = 1 AS has_multi_sku,
    'json' AS data_source FROM lineitem WHERE l_linenumber <= 5
  UNION ALL
  SELECT 's' || l_suppkey || ':' || l_partkey, {_ITEM_URL}, NULL, 'card ' || l_partkey || ' & co', NULL, {_P}, NULL, CAST(l_linenumber AS VARCHAR), false,
    'https://img.example.com/c.jpg', NULL, NULL, 'shop ' || l_suppkey, 'https://www.example.com/s' || l_suppkey || '/', {_QT} * 100,
    CASE WHEN {_QT} % 3 <> 0 THEN 1 END, NULL, CASE WHEN {_QT} % 3 <> 0 THEN CAST({_QT} % 9 AS INTEGER) END,
    CASE WHEN {_QT} % 3 <> 0 THEN CAST(1 + {_QT} % 9 AS INTEGER) END, {_QT} % 3 = 0, CASE WHEN {_QT} % 3 = 0 THEN 20.0 END,
    {_COMMA.format(f'{_QT} * 100')} || 'ポイント(' || CASE WHEN {_QT} % 3 = 0 THEN '20%ポイントバック' ELSE '1倍+' || {_QT} % 9 || '倍UP' END || ')',
    CASE WHEN {_QT} % 2 = 0 THEN {_QT} * 50 ELSE {_QT} END, CASE WHEN {_QT} % 2 = 0 THEN 'exact' ELSE 'percentage' END,
    CASE WHEN {_QT} % 2 = 0 THEN {_COMMA.format(f'{_QT} * 50')} || '円OFFクーポンあり' ELSE {_QT} || '%OFFクーポンあり' END,
    CASE WHEN {_QT} % 2 = 0 THEN 0 END, '明日', {_QT} % 2 = 0, 4.75, {_QT}, false, false, false, 'html' FROM lineitem WHERE l_linenumber > 5)"""
ORACLE["list_ingest"] = _with(_LISTED, body="SELECT * FROM listed")
ORACLE["list_totals"] = f"""
  SELECT {_QT} * 45 AS total_found, 45 AS page_size, CAST(least({_QT}, 150) AS INTEGER) AS pages, count(*) AS documents FROM lineitem
  WHERE l_linenumber <= 5 GROUP BY ALL"""

_RATE = "CAST(1 + round(l_tax * 100) AS DOUBLE)"
_COMMON = f"""CAST(l_suppkey AS VARCHAR) AS shop_code, CAST(l_partkey AS VARCHAR) AS item_code, {_ITEM_URL} AS canonical_url"""
ORACLE["detail_ingest"] = f"""
  SELECT {_COMMON}, 'item ' || l_partkey AS item_name, k || l_partkey AS variant_code,
    CASE WHEN k = 'a' THEN lpad(CAST(l_partkey AS VARCHAR), 13, '4') END AS jan_code, '黒 / ' || k || l_partkey AS variant_name,
    {_P} + CASE k WHEN 'b' THEN 100 ELSE 0 END AS price, CASE WHEN l_linenumber = 1 THEN 5.0 ELSE {_RATE} END AS point_rate,
    CASE WHEN l_linenumber = 2 THEN 30.0::DOUBLE ELSE 20.0 END AS point_back_percent, {_QT} * 1000 AS coupon_yen, 5.0::DOUBLE AS coupon_percent,
    CASE WHEN l_linenumber = 1 AND k = 'a' THEN '送料込み / 明日お届け' WHEN l_linenumber = 1 THEN '送料込み' WHEN l_linenumber = 2 AND k = 'a' THEN '送料 550円 / 明日お届け'
      WHEN l_linenumber = 2 THEN '送料 550円' WHEN k = 'a' THEN '明日お届け' END AS shipping_text_raw,
    CASE k WHEN 'a' THEN 1 END AS shipping_days_min, CASE k WHEN 'a' THEN 3 END AS shipping_days_max,
    CASE WHEN l_linenumber = 1 THEN 'https://img.example.com/v.jpg' ELSE 'https://img.example.com/m.jpg' END AS image_url,
    CASE WHEN l_linenumber = 3 THEN 'review_count' ELSE 'ブランド' END AS extra1_key, CASE WHEN l_linenumber = 3 THEN CAST({_QT} AS VARCHAR) ELSE 'EDW' END AS extra1_value,
    'カラー' AS extra2_key, '黒' AS extra2_value, 'shop ' || l_suppkey AS shop_name, 'https://www.example.com/s' || l_suppkey || '/' AS shop_url,
    CAST(l_partkey AS VARCHAR) AS genre_id,
    '{{"selectorValues":["黒","' || k || l_partkey || '"],"attributes":[{{"title":"ブランド名","value":"' || CASE WHEN l_linenumber = 3 THEN '-' ELSE 'EDW' END
      || '"}},{{"title":"カラー","value":"黒"}}]}}' AS selector_values
  FROM lineitem, (VALUES ('a'), ('b')) t(k) WHERE l_linenumber <= 3
  UNION ALL
  SELECT {_COMMON}, 'item ' || l_partkey, '77', lpad(CAST(l_partkey AS VARCHAR), 13, '0'), NULL, {_P} + 500, {_RATE}, 20.0, {_QT} * 1000, 5.0, '送料込み', NULL, NULL,
    'https://img.example.com/m.jpg', 'review_count', CAST({_QT} AS VARCHAR), 'review_rating', '4.65', 'shop ' || l_suppkey,
    'https://www.example.com/s' || l_suppkey || '/', CAST(l_partkey AS VARCHAR), NULL FROM lineitem WHERE l_linenumber = 4
  UNION ALL
  SELECT {_COMMON}, 'mark ' || l_partkey, '77', lpad(CAST(l_partkey AS VARCHAR), 13, '0'), NULL, {_P}, {_RATE}, 20.0, {_QT} * 1000, 5.0,
    '1～' || l_linenumber || '日以内に発送', 1, l_linenumber, 'https://img.example.com/i.jpg', 'ブランド', 'ブラ', 'メーカー型番', 'M-' || l_partkey,
    NULL, NULL, NULL, NULL FROM lineitem WHERE l_linenumber > 4"""


def _told(code: str, jan: str, price: str, name: str, sold: str, stock: str, msg: str) -> str:
    return (f"""'{{"variantId":"' || {code} || '","jan":' || {jan} || ',"price":' || {price} || ',"name":"' || {name} || '","soldOut":' || {sold} """
            f"""|| ',"stock":' || {stock} || ',"deliveryMsg":' || {msg} || '}}'""")


_JA = """'"' || lpad(CAST(l_partkey AS VARCHAR), 13, '4') || '"'"""
_J0 = """'"' || lpad(CAST(l_partkey AS VARCHAR), 13, '0') || '"'"""
_SUMMARY = f"""CASE WHEN l_linenumber <= 3 THEN '[' || {_told("'a' || l_partkey", _JA, _P, "'黒 / a' || l_partkey", f"CASE WHEN {_QT} = 1 THEN 'true' ELSE 'false' END", f'({_QT} - 1)', "'" + '"明日お届け"' + "'")}
    || ',' || {_told("'b' || l_partkey", "'null'", f'({_P} + 100)', "'黒 / b' || l_partkey", "'true'", _QT, "'null'")} || ']'
  WHEN l_linenumber > 4 THEN '[' || {_told("'77'", _J0, _P, "'mark ' || l_partkey", "'false'", "'null'", '''\'"1～\' || l_linenumber || \'日以内に発送"\'''')} || ']' END"""
ORACLE["detail_observed"] = f"""
  SELECT l_suppkey || ':' || l_partkey AS product_uid, CASE WHEN doc THEN 'item ' ELSE 'mark ' END || l_partkey AS item_name,
    CASE WHEN doc THEN 'shop ' || l_suppkey END AS shop_name, CASE WHEN doc THEN 's' || l_suppkey END AS shop_url_code, {_P} AS price_min,
    {_P} + CASE WHEN doc THEN 500 ELSE 0 END AS price_max, CASE WHEN doc THEN {_QT} END AS review_count, CASE WHEN doc THEN 4.65::DOUBLE END AS review_rating,
    l_linenumber = 4 AS is_39_shop, l_linenumber = 2 AS is_super_deal, CASE WHEN l_linenumber <= 3 THEN 'multiple' ELSE 'single' END AS inventory_type,
    {_QT} * 1000 AS coupon_yen, 5.0::DOUBLE AS coupon_percent, CASE WHEN l_linenumber <= 3 THEN 2 WHEN doc THEN 0 ELSE 1 END AS variant_count,
    {_SUMMARY} AS variant_data_json, CASE WHEN doc THEN CAST(l_partkey AS VARCHAR) END AS ancestor_genre_id,
    CASE WHEN doc THEN 'json' ELSE 'html' END AS data_source FROM (SELECT *, l_linenumber <= 4 AS doc FROM lineitem)"""
ORACLE["variant_json_summary"] = """
  SELECT CASE WHEN l_linenumber <= 4 THEN 'json' ELSE 'html' END AS data_source, CASE WHEN l_linenumber <= 3 THEN 2 WHEN l_linenumber > 4 THEN 1 END AS variants,
    CASE WHEN l_linenumber <> 4 THEN 1 END AS with_jan, CASE WHEN l_linenumber <= 3 THEN 2 WHEN l_linenumber > 4 THEN 1 END AS with_price,
    CASE WHEN l_linenumber <= 3 THEN 2 WHEN l_linenumber > 4 THEN 0 END AS with_stock, count(*) AS rows FROM lineitem GROUP BY 1, 2, 3, 4, 5"""

_EV = """ev AS (SELECT event_id, ts, CAST(user_id AS VARCHAR) AS u, event_type AS kind, json_extract_string(props, '$.k') AS k, CAST(floor(value) AS BIGINT) AS v FROM events)"""
ORACLE["browse_ingest"] = _with(_EV, body="""
  SELECT event_id, k AS shop_code, u AS item_code, 'https://item.example.com/' || k || '/' || u || '/' AS canonical_url, 'item ' || k AS item_name,
    CASE kind WHEN 'purchase' THEN 'v' || (n + 1) WHEN 'click' THEN 'c' WHEN 'view' THEN 'p' ELSE 'default' END AS variant_code,
    lpad(k, 13, CASE kind WHEN 'purchase' THEN '0' ELSE '9' END) AS jan_code, v + CASE WHEN n = 1 THEN 10 ELSE 0 END AS price, 2.0::DOUBLE AS point_rate,
    v % 7 AS coupon_yen, CASE WHEN n = 1 THEN 'https://img.example.com/v2.jpg' ELSE 'https://img.example.com/e.jpg' END AS image_url, 'extension' AS source,
    n AS variant_place FROM ev, range(0, 2) r(n) WHERE kind <> 'error' AND (kind = 'purchase' OR n = 0)""")
ORACLE["browse_event_rows"] = _with(_EV, body=f"""
  SELECT event_id, u AS user_id, k || ':' || u AS product_uid,
    k || ':' || u || ':' || CASE kind WHEN 'purchase' THEN 'v1' WHEN 'click' THEN 'c' WHEN 'view' THEN 'p' ELSE 'default' END AS variant_uid, k AS shop_code,
    'https://item.example.com/' || k || '/' || u || '/' || CASE kind WHEN 'click' THEN '?variantId=c&l-id=q' ELSE '' END AS page_url, {_ts('ts')} AS browsed_at
  FROM ev WHERE kind <> 'error'""")
ORACLE["browse_rejected"] = _with(_EV, body="SELECT event_id, 'https://item.example.com/' || k AS page_url FROM ev WHERE kind = 'error'")
ORACLE["feeds_to_catalogue"] = _with(_EV, body="""
  SELECT seen_in_api, seen_in_list, seen_in_detail, seen_in_ext, seen_in_api OR seen_in_list OR seen_in_detail AS in_server_crawl,
    count(*) AS items, CAST(sum(views) AS BIGINT) AS views FROM (
    SELECT s, i, bool_or(src = 'api') AS seen_in_api, bool_or(src = 'list') AS seen_in_list, bool_or(src = 'detail') AS seen_in_detail,
      bool_or(src = 'ext') AS seen_in_ext, count(*) FILTER (src = 'ext') AS views FROM (
      SELECT CAST(l_suppkey AS VARCHAR) AS s, CAST(l_partkey AS VARCHAR) AS i, unnest(['api', 'detail']) AS src FROM lineitem
      UNION ALL SELECT CASE WHEN l_linenumber <= 5 THEN '' ELSE 's' END || l_suppkey, CAST(l_partkey AS VARCHAR), 'list' FROM lineitem
      UNION ALL SELECT k, u, 'ext' FROM ev WHERE kind <> 'error') GROUP BY 1, 2) GROUP BY 1, 2, 3, 4, 5""")

# expressions --------------------------------------------------------------------------------

_URLS = """u AS (SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host,
    regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path,
    list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda x: regexp_matches(x, '^[^=]*=.+')) AS q FROM pages)"""
_BASE = "scheme || '://' || host || rtrim(path, '/') || '/'"


def _kept(drop: str) -> str:
    kept = f"list_filter(q, lambda x: lower(split_part(x, '=', 1)) NOT IN ({drop}))"
    return f"CASE WHEN len({kept}) > 0 THEN '?' || array_to_string({kept}, '&') ELSE '' END"


ORACLE["url_canonical"] = _with(_URLS, body=f"""
  SELECT page_id, {_BASE} || {_kept("'rafcid', 'scid', 's-id', 'l-id', 'ref', 'iasid', 'noel', 'tag', 'force-hierarchical', 'pf', 'wsc_i_is', 'wsc_i_is_c'")} AS canonical,
    {_BASE} || {_kept("'utm_source', 'ref'")} AS cleaned, split_part(list_filter(q, lambda x: x LIKE 'page=%')[1], '=', 2) AS page, CAST(NULL AS VARCHAR) AS variant_id FROM u""")
ORACLE["url_codes"] = _with(_URLS, """p AS (SELECT page_id, list_filter(string_split(path, '/'), lambda x: x <> '') AS a FROM u),
  c AS (SELECT page_id, CASE WHEN len(a) >= 2 THEN a[1] END AS s, CASE WHEN len(a) >= 2 THEN a[2] END AS i FROM p)""", body="""
  SELECT page_id, s AS shop_code, i AS item_code, s AS store, s || ':' || i AS product_uid, s || ':' || i || ':default' AS variant_uid, i AS api_item,
    'https://www.example.com/' || s || '/' AS shop_url FROM c""")
_SIGNS = " OR ".join(f"contains(head, '{s}')" for s in ("access denied", "cf-browser-verification", "challenge-platform", "_sec_cpt", "just a moment"))
ORACLE["page_class"] = f"""SELECT page_id,
    CASE WHEN length(html) < 1000 THEN 'short' WHEN contains(html, '__INITIAL_STATE__') OR contains(lower(html), 'item-list') THEN 'ok' WHEN {_SIGNS} THEN 'blocked' ELSE 'ok' END AS as_list,
    CASE WHEN length(html) < 1000 THEN 'short' WHEN contains(html, 'item-page-app-data') OR (contains(html, 'itemprop') AND contains(lower(html), 'example')) THEN 'ok'
      WHEN {_SIGNS} THEN 'blocked' ELSE 'ok' END AS as_detail
  FROM (SELECT *, lower(html) AS head FROM pages)"""
ORACLE["page_titles"] = """SELECT page_id, trim(regexp_replace(trim(nullif(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '')), '\\s*:\\s*[^:]+$', '')) AS name FROM pages"""
_COUNT = _COMMA.format("qty * 100")
ORACLE["text_round_trip"] = f"""
  WITH l AS (SELECT CAST(l_quantity AS BIGINT) AS qty, {_TAX} AS up, l_linenumber AS line FROM lineitem),
  t AS (SELECT *, CASE WHEN line = 7 THEN '20%ポイントバック' ELSE CASE WHEN line <> 6 THEN '1倍' ELSE '' END || CASE WHEN up > 0 THEN '+' || up || '倍UP' ELSE '' END END AS inner_text FROM l)
  SELECT {_COUNT} || 'ポイント' || CASE WHEN inner_text <> '' THEN '(' || inner_text || ')' ELSE '' END AS point_text,
    CASE line % 3 WHEN 0 THEN {_COMMA.format('qty * 50')} || '円OFFクーポンあり' WHEN 1 THEN qty * 50 || '%OFFクーポンあり' ELSE qty * 50 || 'クーポンあり' END AS coupon_text,
    CASE line WHEN 1 THEN '翌日配送' WHEN 2 THEN '３日以内に発送' ELSE line || '～9日' END AS ship_text, qty * 100 AS point_count,
    CASE WHEN line = 7 THEN NULL ELSE nullif(CASE WHEN line <> 6 THEN 1 ELSE 0 END + up, 0) END AS total_multiplier, line = 7 AS is_point_back,
    CASE line % 3 WHEN 2 THEN NULL ELSE qty * 50 END AS coupon_discount, CASE line % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'percentage' END AS coupon_type,
    CASE WHEN line <= 2 THEN 1 ELSE line END AS days_min, CASE line WHEN 1 THEN 1 WHEN 2 THEN 3 ELSE 9 END AS days_max,
    CASE WHEN line = 7 THEN NULL ELSE nullif(CAST(CASE WHEN line <> 6 THEN 1 ELSE 0 END + up AS DOUBLE), 0) END AS rate, CASE WHEN line = 7 THEN 20.0::DOUBLE END AS back,
    qty * 50 AS digits, count(*) AS rows FROM t GROUP BY ALL"""


def _json(name: str, value: str, quoted: bool = False) -> str:
    text = f"""'"' || {value} || '"'""" if quoted else f"CAST({value} AS VARCHAR)"
    return f"""'"{name}":' || COALESCE({text}, 'null')"""


_HASHED = " || ',' || ".join([
    _json("coupon_percent", "CAST(coupon_percent AS DECIMAL(5,1))"), _json("coupon_yen", "coupon_yen"), """'"extra1_key":null,"extra1_value":null,"extra2_key":null,"extra2_value":null'""",
    _json("image_url", "image_url", True), _json("point_back_percent", "CAST(point_back_percent AS DECIMAL(5,1))"), _json("point_rate", "CAST(point_rate AS DECIMAL(5,1))"),
    _json("price", "price"), _json("shipping_days_max", "shipping_days_max"), _json("shipping_days_min", "shipping_days_min"), _json("shipping_text_raw", "shipping_text_raw", True)])
ORACLE["content_hashes"] = _with(V.OBS_PART, V.SNAP, body=f"SELECT variant_uid, sha256('{{' || {_HASHED} || '}}') AS content_hash FROM snap")
ORACLE["record_dates"] = _with(V.BROWSE, body=f"SELECT {_day('browsed_at + INTERVAL 9 HOUR')} AS record_date, count(*) AS events FROM browse GROUP BY 1")
ORACLE["display_columns"] = _with(V.OBS_PART, V.SNAP, body=f"""
  SELECT variant_uid, '¥' || {_COMMA.format('price')} AS yen, {_COMMA.format('price // 25')} || 'pt' AS points,
    CASE WHEN length(image_url) > 28 THEN substring(image_url, 1, 28) || '...' ELSE image_url END AS short_url, strftime(fetched_at, '%Y/%m/%d %H:%M') AS shown_date,
    CASE WHEN days = 0 THEN 'たった今' ELSE days || '日前' END AS age,
    CASE WHEN shipping_days_min IS NOT NULL AND shipping_days_min <> shipping_days_max THEN shipping_days_min || '〜' || shipping_days_max || '日' ELSE shipping_days_max || '日' END AS shipping,
    COALESCE(contains(shipping_text_raw, '送料無料'), false) AS free_shipping FROM (SELECT *, date_diff('day', fetched_at, {_AS_OF}) AS days FROM snap)""")


# single expressions over the tables --------------------------------------------------------

ORACLE["genre_paths"] = "SELECT p_partkey, '0,' || p_size || ',' || p_partkey AS ids, p_partkey AS leaf FROM part"
ORACLE["search_url_shops"] = "SELECT s_suppkey, CAST(s_suppkey AS VARCHAR) AS shop_code FROM supplier"
ORACLE["id_lists"] = """SELECT l_orderkey, l_linenumber,
  CASE WHEN l_linenumber <> 7 THEN l_orderkey || '|' || l_partkey || '|' || l_suppkey END AS ids FROM lineitem"""
ORACLE["multipliers_held"] = """SELECT l_orderkey, l_linenumber, points, 2000 - points AS net FROM (
  SELECT *, CAST(floor(2000 * (greatest(least((l_quantity - 20) * 5, 100), 1) + 1.0) / 100) AS BIGINT) AS points FROM lineitem)"""
ORACLE["coupon_fragments"] = """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_quantity AS INTEGER) END AS yen,
  CASE WHEN l_linenumber % 2 = 1 THEN CAST(l_quantity AS DOUBLE) END AS percent FROM lineitem"""


# merges by bucket, SQL functions ----------------------------------------------------

ORACLE["merge_stored_buckets"] = ORACLE["merge_items_fold"]
_AT = [(given, {m: V.price_sql(m, held) for m in ("server", "client", "chart")}) for given, held in ((-5.0, 1.0), (4.0, 4.0), (250.0, 100.0))]
ORACLE["sql_net_prices"] = _with(V.OBS, V.SNAP, body=" UNION ALL ".join(
    f"SELECT variant_uid, CAST({given} AS DOUBLE) AS multiplier, {p['client']['points']} AS points, "
    + ", ".join(f"{p[m]['net']} AS {m}_net" for m in p) + " FROM snap" for given, p in _AT))
ORACLE["genre_closure"] = _with(V.EDGES, """ties AS (SELECT * FROM edges UNION ALL SELECT child_id, parent_id FROM edges WHERE parent_id >= 100)""", """ways AS (
    SELECT 0 AS genre_id UNION SELECT child_id FROM ways JOIN ties ON parent_id = genre_id)""", body="""
  SELECT genre_id, CAST(CASE WHEN genre_id = 0 THEN 0 WHEN genre_id < 1000 THEN 1 ELSE 2 END AS INTEGER) AS depth FROM ways""", recursive=True)
