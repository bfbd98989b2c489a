"""The retail tables of ``stockloom.sources.roles`` as SQL, for comparison in another engine."""

from __future__ import annotations

import re

from stockloom.operators import planning

_DISC = "((2 * CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round(l_discount * 100) AS BIGINT) + 100) // 200)"
_GROSS = "CAST(round(l_extendedprice * 100) AS BIGINT)"
_QTY = "CAST(l_quantity AS BIGINT)"
_KEY = "lpad(CAST({} AS VARCHAR), 7, '0')"
_PART, _LPART = _KEY.format("p_partkey"), _KEY.format("l_partkey")
_STORE_N = "(SELECT count(*) FROM supplier)"
_ITEM = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"


def pick(number: str, values: list[str]) -> str:
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE ({number}) % {len(values)} {whens} END"


_METHOD = pick("o_orderkey", ["standard", "expedited", "overnight", "store_pickup"])
_ORDER = "'ORD-' || lpad(CAST({} AS VARCHAR), 10, '0')"



def _said(note: str, *names: str) -> str:
    """A fixed sentence with SQL names in its gaps."""
    parts = [f"'{part}'" for part in note.split("{}")]
    return " || ".join([x for pair in zip(parts, names) for x in pair] + parts[len(names):])


ROLES = {
    "r_stores": f"""
        SELECT CAST(s_suppkey AS INTEGER) AS store_id, s_name AS store_name, n_name AS city,
               'S' || n_nationkey AS state, r_name AS region,
               {pick('s_suppkey', ['Flagship', 'Urban', 'Outlet'])} AS store_type
        FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey""",
    "r_products": f"""
        SELECT 'PRD-' || {_PART} AS product_id, p_brand || '-' || p_type AS style_id, 'SKU-' || {_PART} AS sku_id,
               p_name AS product_name, p_type AS category, split_part(p_name, ' ', 2) AS subcategory, p_brand AS brand,
               split_part(p_name, ' ', 1) AS color, {pick('p_size', ['XS', 'S', 'M', 'L', 'XL'])} AS size,
               'All Year' AS season, CAST(round(p_retailprice * 100) AS BIGINT) AS msrp_c,
               (2 * CAST(round(p_retailprice * 100) AS BIGINT) * 40 + 100) // 200 AS cost_c,
               p_name || ' by ' || p_brand AS description, '/img/' || {_PART} || '.jpg' AS image_url,
               split_part(p_name, ' ', 2) AS silhouette,
               {pick('p_partkey', ['Wedding Guest', 'Day Event', 'Work', 'Travel'])} AS occasion,
               {pick('p_size', ['Cotton', 'Wool', 'Linen'])} AS material,
               CASE WHEN p_partkey % 10 = 9 THEN 'inactive' ELSE 'active' END AS status
        FROM part""",
    "r_brands": """
        SELECT DISTINCT CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INTEGER) AS brand_id, p_brand AS brand_name FROM part""",
    "r_customers": f"""
        SELECT c_custkey AS customer_id, 'LOY-' || lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS loyalty_id,
               CASE WHEN c_custkey % 7 <> 0 THEN 'customer' || c_custkey || '@example.com' END AS email,
               split_part(c_name, '#', 1) AS first_name, split_part(c_name, '#', 2) AS last_name,
               CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING') THEN 'Bronze' WHEN c_mktsegment = 'FURNITURE'
                    THEN 'Silver' WHEN c_mktsegment = 'MACHINERY' THEN 'Gold' ELSE 'Platinum' END AS tier,
               CAST((c_custkey * 7) % {_STORE_N} AS INTEGER) AS preferred_store_id,
               'Notes on ' || c_name AS stylist_notes,
               CASE WHEN c_acctbal < 2000 THEN 'Low' WHEN c_acctbal < 5000 THEN 'Medium'
                    WHEN c_acctbal < 8000 THEN 'High' ELSE 'VIP' END AS lifetime_value_band
        FROM customer""",
    "r_saved": """
        SELECT event_id AS saved_item_id, user_id AS customer_id,
               'PRD-' || lpad(json_extract_string(props, '$.k'), 7, '0') AS product_id, ts AS saved_at
        FROM events WHERE event_type = 'view'""",
    "r_preferences": """
        SELECT s.customer_id, list_sort(list(DISTINCT size)) AS preferred_sizes,
               list_sort(list(DISTINCT color)) AS preferred_colors, list_sort(list(DISTINCT brand)) AS preferred_brands,
               list_sort(list(DISTINCT occasion)) AS shopping_occasions, max(saved_at) AS updated_at
        FROM r_saved s JOIN r_products USING (product_id) JOIN customer ON c_custkey = s.customer_id
        GROUP BY s.customer_id""",
    "r_inventory": f"""
        SELECT CAST(l_suppkey AS INTEGER) AS store_id, 'SKU-' || {_LPART} AS sku_id,
               CAST(sum({_QTY}) AS INTEGER) AS on_hand_qty,
               CAST(sum(CASE WHEN l_linestatus = 'F' THEN {_QTY} ELSE 0 END) AS INTEGER) AS reserved_qty,
               CAST(sum(CASE WHEN l_linestatus = 'O' THEN {_QTY} ELSE 0 END) AS INTEGER) AS available_qty,
               CAST(sum(CASE WHEN l_returnflag = 'N' THEN {_QTY} ELSE 0 END) AS INTEGER) AS in_transit_qty,
               max(l_shipdate) AS last_updated
        FROM lineitem GROUP BY l_suppkey, l_partkey""",
    "r_relationships": f"""
        SELECT 'PRD-' || {_KEY.format('a.p_partkey')} AS source_product_id,
               'PRD-' || {_KEY.format('b.p_partkey')} AS related_product_id,
               CASE WHEN a.p_brand = b.p_brand THEN 'alternative' ELSE 'complementary' END AS relationship_type,
               a.p_brand || ' with ' || b.p_brand AS relationship_reason
        FROM (SELECT p_partkey, p_brand, unnest([1, 2, 3]) AS step FROM part) a
        JOIN part b ON b.p_partkey = a.p_partkey + a.step""",
    "r_week_sales": f"""
        SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS week_start_date, CAST(l_suppkey AS INTEGER) AS store_id,
               p_brand || '-' || p_type AS style_id, CAST(sum({_QTY}) AS BIGINT) AS u,
               CAST(sum({_GROSS}) AS BIGINT) AS g, CAST(sum({_DISC}) AS BIGINT) AS d,
               CAST(sum({_QTY} * ((2 * CAST(round(p_retailprice * 100) AS BIGINT) * 40 + 100) // 200)) AS BIGINT) AS c,
               CAST(sum(CASE WHEN l_linestatus = 'O' THEN {_QTY} ELSE 0 END) AS BIGINT) AS av
        FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3""",
    "r_weekly": """
        SELECT week_start_date, w.store_id, w.style_id, CAST(u AS INTEGER) AS units_sold, g - d AS net_c, g - d - c AS margin_c,
               (2 * d * 10000 + g) // (2 * g) AS markdown_h, (2 * u * 10000 + u + s.stock) // (2 * (u + s.stock)) AS st_h,
               (2 * s.stock * 100 + u) // (2 * u) AS wos_h
        FROM r_week_sales w JOIN (SELECT store_id, style_id, CAST(sum(av) AS BIGINT) AS stock FROM r_week_sales GROUP BY 1, 2) s
          ON s.store_id = w.store_id AND s.style_id = w.style_id""",
    "r_transactions": f"""
        SELECT o_orderkey AS transaction_id, o_custkey AS customer_id,
               CAST((o_custkey * 7) % {_STORE_N} AS INTEGER) AS store_id, o_orderdate AS transaction_ts,
               {pick('o_orderkey', ['in_store', 'online', 'mobile'])} AS sales_channel,
               {pick('o_orderkey', ['card', 'cash', 'wallet', 'gift_card'])} AS payment_method,
               CAST(round(o_totalprice * 100) AS BIGINT) AS net_c
        FROM orders""",
    "r_items": f"""
        SELECT {_ITEM} AS transaction_item_id, l_orderkey AS transaction_id, 'PRD-' || {_LPART} AS product_id,
               CAST(l_quantity AS INTEGER) AS quantity, (2 * {_GROSS} + {_QTY}) // (2 * {_QTY}) AS price_c,
               {_DISC} AS disc_c, {_GROSS} - {_DISC} AS total_c
        FROM lineitem""",
    "r_returns": f"""
        SELECT {_ITEM} AS return_id, {_ITEM} AS transaction_item_id, o_custkey AS customer_id,
               l_shipdate + INTERVAL 7 DAY AS return_ts,
               {pick('l_partkey + l_suppkey', ['size_issue', 'quality_issue', 'damaged_in_shipping', 'late_delivery', 'changed_mind', 'wrong_item'])} AS reason_code,
               {_GROSS} - {_DISC} AS refund_c
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R'""",
    "r_orders": f"""
        SELECT {_ORDER.format('o_orderkey')} AS order_id, CAST(o_custkey AS VARCHAR) AS customer_id, o_orderdate AS order_date,
               CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'placed' ELSE 'processing' END AS order_status,
               CAST((o_custkey * 3 + 1) % {_STORE_N} AS INTEGER) AS fulfillment_store_id,
               CASE WHEN o_orderpriority <> '1-URGENT' THEN CAST((o_custkey * 7) % {_STORE_N} AS INTEGER) END AS destination_store_id,
               CASE WHEN o_orderpriority = '1-URGENT' THEN 'City-' || o_custkey END AS ship_to_city,
               {_METHOD} AS shipping_method,
               CASE o_orderkey % 4 WHEN 1 THEN 2 WHEN 0 THEN 3 ELSE 1 END AS estimated_delivery_days,
               CAST(o_orderdate AS DATE) + CAST(CASE o_orderkey % 4 WHEN 1 THEN 2 WHEN 0 THEN 3 ELSE 1 END AS INTEGER) AS estimated_delivery_date
        FROM orders""",
    "r_order_lines": f"""
        SELECT {_ORDER.format('l_orderkey')} AS order_id, 'SKU-' || {_LPART} AS sku_id,
               CAST(sum({_QTY}) AS INTEGER) AS quantity, max((2 * {_GROSS} + {_QTY}) // (2 * {_QTY})) AS price_c
        FROM lineitem GROUP BY l_orderkey, l_partkey""",
    "r_req_items": f"""
        SELECT {_ORDER.format('l_orderkey')} AS order_id, l_linenumber * 1000000000::BIGINT + l_partkey AS line_no,
               'SKU-' || {_LPART} AS sku_id, CAST({_QTY} % 10 + 1 AS INTEGER) AS quantity
        FROM lineitem""",
    "r_req_headers": f"""
        SELECT {_ORDER.format('o_orderkey')} AS order_id, o_orderkey AS seq, CAST(o_custkey AS VARCHAR) AS customer_id,
               CASE WHEN o_orderpriority = '1-URGENT' OR (o_orderstatus = 'P' AND o_orderpriority = '5-LOW') THEN NULL
                    WHEN o_orderstatus = 'P' AND o_orderpriority = '4-NOT SPECIFIED' THEN -1
                    ELSE CAST((o_custkey * 7) % {_STORE_N} AS INTEGER) END AS destination_store_id,
               CASE WHEN o_orderpriority = '1-URGENT' THEN 'City-' || o_custkey END AS ship_to_city,
               {_METHOD} AS shipping_method,
               CASE WHEN o_orderkey % 2 = 1 THEN CAST(f.supp AS INTEGER) END AS fulfillment_store_id
        FROM orders JOIN (SELECT l_orderkey, arg_min(l_suppkey, (l_linenumber, l_partkey, l_suppkey)) AS supp
                          FROM lineitem GROUP BY l_orderkey) f ON f.l_orderkey = o_orderkey""",
    "r_core_products": """
        SELECT product_id, sku_id AS sku, CAST(regexp_extract(brand, '([0-9]+)$', 1) AS INTEGER) AS brand_id FROM r_products""",
    "r_styles": f"""
        SELECT style_id, {pick('count(*)', ['core', 'fashion'])} AS core_vs_fashion,
               {pick('count(*)', ['maintain', 'grow', 'optimize'])} AS strategic_priority
        FROM r_products GROUP BY style_id""",
    "r_skus": """
        SELECT sku_id AS sku, style_id, CASE WHEN status = 'inactive' THEN style_id END AS substitute_style_id,
               CASE size WHEN 'XL' THEN style_id WHEN 'XS' THEN brand || '-' || subcategory END AS trade_up_style_id
        FROM r_products""",
    "r_sku_inventory": "SELECT store_id, sku_id AS sku FROM r_inventory",
    "r_sales_summary": f"""
        SELECT DISTINCT strftime(l_shipdate, '%Y-%m') AS period, sku, style_id
        FROM lineitem JOIN r_skus ON sku = 'SKU-' || {_LPART}""",
    "r_style_relationships": """
        SELECT a.style_id AS from_style_id, b.style_id AS to_style_id, length(b.style_id) % 4 AS priority_rank,
               CASE relationship_type WHEN 'alternative' THEN 'alternative' ELSE 'cross_sell' END AS relationship_type
        FROM r_relationships JOIN r_products a ON a.product_id = source_product_id
        JOIN r_products b ON b.product_id = related_product_id""",
    "r_source_orders": f"""
        SELECT o_orderkey AS order_id, o_custkey AS customer_id, (o_custkey * 3) % ({_STORE_N} + 1) AS store_id,
               CASE o_orderstatus WHEN 'F' THEN 'fulfilled' WHEN 'O' THEN 'placed' ELSE 'processing' END AS order_status
        FROM orders""",
    "r_source_items": f"""
        SELECT l_orderkey || '-' || l_linenumber AS order_item_id, l_orderkey AS order_id, 'SKU-' || {_LPART} AS sku,
               CAST(l_quantity AS INTEGER) AS quantity, (2 * {_GROSS} + {_QTY}) // (2 * {_QTY}) AS unit_price
        FROM lineitem""",
    "r_declared_lines": "SELECT order_id, sku_id, quantity, price_c AS unit_price FROM r_order_lines",
    "r_declared_weeks": """
        SELECT week_start_date, store_id, style_id, units_sold, net_c AS net_sales, markdown_h / 100 AS markdown_rate,
               st_h / 100 AS sell_through_pct, wos_h AS weeks_of_supply FROM r_weekly""",
    "r_queries": """
        SELECT 'name:' || p_name AS query_id, p_name AS q, CAST(NULL AS VARCHAR) AS category, CAST(NULL AS VARCHAR) AS occasion
        FROM (SELECT DISTINCT p_name FROM part)
        UNION ALL SELECT 'ask:' || p_name, 'Looking for the ' || split_part(p_name, ' ', 2) || ' in ' || split_part(p_name, ' ', 1)
            || ', medium please', NULL, NULL FROM (SELECT DISTINCT p_name FROM part)
        UNION ALL SELECT 'like:' || p_name, left(p_name, 1) || '_%' || split_part(p_name, ' ', 2), NULL, NULL
            FROM (SELECT DISTINCT p_name FROM part)
        UNION ALL SELECT 'style:' || p_brand || p_type, replace(lower(p_brand), '#', ' ') || ' ' || lower(p_type) || ' large', NULL, NULL
            FROM (SELECT DISTINCT p_brand, p_type FROM part)
        UNION ALL SELECT 'in:' || p_type, 'bolt', p_type, 'Work' FROM (SELECT DISTINCT p_type FROM part)
        UNION ALL SELECT 'type:' || p_type, NULL, p_type, NULL FROM (SELECT DISTINCT p_type FROM part)
        UNION ALL SELECT 'both:' || p_type, NULL, p_type, 'Travel' FROM (SELECT DISTINCT p_type FROM part)
        UNION ALL SELECT 'none:' || n_name, n_name || ' zzzz', NULL, NULL FROM nation""",
    # Shared steps of several queries.
    "x_perf": """
        SELECT p.store_id, s.store_name, p.style_id, c.category, sum(st_h)::BIGINT / (count(*) * 100)::DOUBLE AS avg_sell_through,
               sum(wos_h)::BIGINT / (count(*) * 100)::DOUBLE AS avg_wos
        FROM r_weekly p JOIN r_stores s USING (store_id) JOIN (SELECT DISTINCT style_id, category FROM r_products) c USING (style_id)
        GROUP BY ALL""",
    "x_stock": """
        SELECT store_id, style_id, CAST(sum(available_qty) AS INTEGER) AS stock
        FROM r_inventory JOIN r_products USING (sku_id) GROUP BY ALL""",
    "x_recs": f"""
        SELECT a.action_type, a.priority, a.ps, m.style_id, m.category, a.source AS source_store_id, a.source_name AS source_store_name,
               a.target AS target_store_id, a.target_name AS target_store_name, a.units AS recommended_units, a.rationale
        FROM (
            SELECT style_id, category, list({{'id': p.store_id, 'name': store_name, 'held': coalesce(stock, 0), 'st': avg_sell_through,
                                              'wos': avg_wos}}) AS shops
            FROM x_perf p LEFT JOIN x_stock USING (store_id, style_id) GROUP BY style_id, category) m,
        LATERAL (
            SELECT unnest(list_concat(
                flatten(list_transform(list_filter(shops, lambda t: t.st >= 65 AND t.wos <= 1.5 AND t.held = 0), lambda t:
                    list_transform(list_filter(shops, lambda f: f.id <> t.id AND f.held >= 3), lambda f:
                        {{'action_type': 'transfer', 'priority': 'high', 'ps': 0, 'source': f.id, 'source_name': f.name, 'target': t.id,
                          'target_name': t.name, 'units': least(f.held, 3), 'rationale': {_said(planning.TRANSFER_NOTE, 't.name', 'f.name')}}}))),
                list_transform(list_filter(shops, lambda t: t.st <= 35 AND t.wos >= 5), lambda t:
                    {{'action_type': 'markdown_adjustment', 'priority': 'medium', 'ps': 1, 'source': t.id, 'source_name': t.name,
                      'target': NULL::INTEGER, 'target_name': NULL::VARCHAR, 'units': NULL::INTEGER, 'rationale': {_said(planning.MARKDOWN_NOTE, 't.name')}}}),
                list_transform(list_filter(shops, lambda t: t.st >= 70 AND t.wos <= 1.5), lambda t:
                    {{'action_type': 'reorder', 'priority': 'high', 'ps': 0, 'source': NULL::INTEGER, 'source_name': NULL::VARCHAR,
                      'target': t.id, 'target_name': t.name, 'units': 4, 'rationale': {_said(planning.REORDER_NOTE, 't.name')}}}))) AS a)""",
    "x_routed": """
        SELECT h.order_id, h.seq, h.customer_id, h.destination_store_id, h.ship_to_city, h.shipping_method, h.fulfillment_store_id,
               coalesce(h.fulfillment_store_id, a.store_id) AS store_id
        FROM r_req_headers h LEFT JOIN (
            SELECT f.order_id, arg_max(i.store_id, (i.available_qty, -i.store_id)) AS store_id
            FROM (SELECT order_id, arg_min(sku_id, (line_no, sku_id, quantity)) AS sku_id,
                         arg_min(quantity, (line_no, sku_id, quantity)) AS quantity FROM r_req_items GROUP BY order_id) f
            JOIN r_inventory i ON i.sku_id = f.sku_id AND i.available_qty >= f.quantity GROUP BY f.order_id) a
          ON a.order_id = h.order_id""",
}

# Placing orders one after the other. An order that no store could fill from the opening stock never takes anything and
# has no turn; each other one knows its stores and, line by line, the earlier turns that may have taken from them. The state
# is the list of stores that the turns so far went to, -1 where the stock fell short and -2 where no store held the first item.
ROLES["x_first"] = """
    SELECT order_id, arg_min(sku_id, (line_no, sku_id, quantity)) AS sku_id, arg_min(quantity, (line_no, sku_id, quantity)) AS want
    FROM r_req_items GROUP BY order_id"""
ROLES["x_valid"] = """
    SELECT h.order_id, h.seq, h.fulfillment_store_id AS named, f.sku_id, f.want,
           CASE WHEN h.destination_store_id IS NULL AND h.ship_to_city IS NULL THEN 'no_destination'
                WHEN h.destination_store_id IS NOT NULL AND s.store_id IS NULL THEN 'unknown_store'
                WHEN h.order_id IN (SELECT order_id FROM r_req_items GROUP BY order_id, sku_id HAVING count(*) > 1) THEN 'duplicate_sku'
           END AS reason
    FROM r_req_headers h JOIN x_first f USING (order_id) LEFT JOIN r_stores s ON s.store_id = h.destination_store_id"""
ROLES["x_options"] = """
    SELECT v.order_id, v.seq, v.named, v.want, v.sku_id, i.store_id, i.available_qty AS top
    FROM x_valid v JOIN r_inventory i ON i.sku_id = v.sku_id
    WHERE v.reason IS NULL AND CASE WHEN v.named IS NULL THEN i.available_qty >= v.want ELSE i.store_id = v.named END"""
ROLES["x_able"] = """
    SELECT o.order_id, o.store_id FROM x_options o JOIN r_req_items t USING (order_id)
    LEFT JOIN r_inventory i ON i.store_id = o.store_id AND i.sku_id = t.sku_id
    GROUP BY ALL HAVING bool_and(coalesce(i.available_qty >= t.quantity, false))"""
ROLES["x_turns"] = """
    SELECT order_id, seq, row_number() OVER (ORDER BY seq) AS n FROM x_valid WHERE order_id IN (SELECT order_id FROM x_able)"""
ROLES["x_takes"] = """
    SELECT t.n, t.seq, a.store_id, i.sku_id, i.quantity FROM x_turns t JOIN x_able a USING (order_id) JOIN r_req_items i USING (order_id)"""
ROLES["x_fills"] = """
    SELECT n, store_id, list({'q': quantity, 'a': a, 'p': p}) AS lines FROM (
        SELECT w.n, w.store_id, w.sku_id, w.quantity, v.available_qty AS a, list({'n': e.n, 'q': e.quantity}) FILTER (WHERE e.n IS NOT NULL) AS p
        FROM x_takes w JOIN r_inventory v ON v.store_id = w.store_id AND v.sku_id = w.sku_id
        LEFT JOIN x_takes e ON e.store_id = w.store_id AND e.sku_id = w.sku_id AND e.n < w.n GROUP BY ALL) GROUP BY ALL"""
ROLES["x_levels"] = """
    SELECT o.order_id, o.named, o.want, o.store_id, o.top, list({'n': e.n, 'q': e.quantity}) FILTER (WHERE e.n IS NOT NULL) AS p
    FROM x_options o LEFT JOIN x_takes e ON e.store_id = o.store_id AND e.sku_id = o.sku_id AND e.seq < o.seq GROUP BY ALL"""
ROLES["x_queue"] = """
    SELECT t.n, any_value(v.named) AS named, any_value(v.want) AS want,
           list({'s': v.store_id, 'a': v.top, 'p': v.p, 'ok': f.lines IS NOT NULL, 'lines': f.lines}) AS stores
    FROM x_turns t JOIN x_levels v USING (order_id) LEFT JOIN x_fills f ON f.n = t.n AND f.store_id = v.store_id GROUP BY t.n"""


def _left(units: str, earlier: str, store: str) -> str:
    taken = f"list_transform(list_filter({earlier}, lambda e: s.went[e.n] = {store}), lambda e: e.q)"
    return f"{units} - coalesce(list_sum({taken}), 0)"


ROLES["x_steps"] = f"""
    SELECT 0::BIGINT AS n, CAST([] AS INTEGER[]) AS went
    UNION ALL
    SELECT n, list_append(went, CAST(CASE WHEN named IS NULL AND best.l < want THEN -2 WHEN best.f THEN -best.m ELSE -1 END AS INTEGER)) FROM (
        SELECT k.n, s.went, k.named, k.want, list_sort(list_transform(k.stores, lambda c: {{
                   'l': {_left('c.a', 'c.p', 'c.s')}, 'm': -c.s,
                   'f': c.ok AND len(list_filter(c.lines, lambda l: l.q > {_left('l.a', 'l.p', 'c.s')})) = 0}}), 'DESC')[1] AS best
        FROM x_steps s JOIN x_queue k ON k.n = s.n + 1)"""
ROLES["x_went"] = """
    SELECT generate_subscripts(went, 1) AS n, unnest(went) AS store_id FROM x_steps WHERE n = (SELECT max(n) FROM x_steps)"""
ROLES["x_never"] = f"""
    SELECT order_id, CASE WHEN any_value(named) IS NULL AND max({_left('v.top', 'v.p', 'v.store_id')}) < any_value(want)
                          THEN 'cannot_fulfil' ELSE 'insufficient' END AS outcome
    FROM x_levels v, (SELECT went FROM x_steps WHERE n = (SELECT max(n) FROM x_steps)) s
    WHERE order_id NOT IN (SELECT order_id FROM x_turns) GROUP BY order_id"""
ROLES["x_placed"] = """
    SELECT v.order_id, coalesce(v.reason, CASE WHEN w.store_id >= 0 THEN 'accepted' WHEN w.store_id = -1 THEN 'insufficient'
               WHEN w.store_id = -2 THEN 'cannot_fulfil' END, x.outcome, CASE WHEN v.named IS NULL THEN 'cannot_fulfil' ELSE 'insufficient' END) AS outcome,
           CASE WHEN w.store_id >= 0 THEN w.store_id END AS store_id
    FROM x_valid v LEFT JOIN x_turns t USING (order_id) LEFT JOIN x_went w ON w.n = t.n LEFT JOIN x_never x ON x.order_id = v.order_id"""


# What the recursion reads at every step is computed once.
KEPT = ("x_queue",)


def oracle(body: str) -> str:
    """The query with the retail tables it mentions, directly or through others, put before it."""
    needed: list[str] = []
    seen: set[str] = set()

    def visit(text: str) -> None:
        for name in re.findall(r"\b[rx]_[a-z_]+\b", text):
            if name in ROLES and name not in seen:
                seen.add(name)
                visit(ROLES[name])
                needed.append(name)

    visit(body)
    if not needed:
        return body
    ctes = ",\n".join(f"{n} AS {'MATERIALIZED ' if n in KEPT else ''}({ROLES[n]})" for n in needed)
    recursive = "RECURSIVE " if "x_steps" in seen else ""
    return f"WITH {recursive}{ctes}\n{body}"
