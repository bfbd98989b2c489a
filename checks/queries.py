"""One query per operator over the whole test tables, with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.plain import plain
from checks.role_sql import ROLES, oracle
from stockloom import schemas
from stockloom.functions import derive, text
from stockloom.functions.money import cents, half_up
from stockloom.operators import catalog, constraints, customer, maintain, orders, placement, planning, quality, stock
from stockloom.plans.ranking import numbered
from stockloom.session import scratch_dir
from stockloom.sources import files, split_csv
from stockloom.sources.buckets import BucketTable
from stockloom.sources.roles import Roles
from stockloom.streaming import orders as order_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query; ``sql`` may name the retail tables of ``role_sql``."""

    def register(build: Callable[[Roles], DataFrame]):
        QUERIES[name] = lambda spark, folder: plain(build(Roles(spark, folder)))
        if sql is not None:
            SQL[name] = oracle(sql)
        return build

    return register


def _ts(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')"


_MONEY = "{} / 100.0::DOUBLE"
_RECORD = (
    "product_id, style_id, sku_id, product_name, category, subcategory, brand, color, size, season, "
    "msrp_c / 100.0::DOUBLE AS msrp, cost_c / 100.0::DOUBLE AS cost, description, image_url, silhouette, occasion, "
    "material, status"
)
_DATE = "CAST({} AS VARCHAR)"

# Files and literal tables ------------------------------------------------------------


@query("read_table_csv", f"""
    SELECT customer_id, loyalty_id, email, first_name, last_name, tier, preferred_store_id,
           'He said "fine, thanks", ' || stylist_notes AS stylist_notes, lifetime_value_band FROM r_customers""")
def _read_table_csv(r: Roles) -> DataFrame:
    note = F.concat(F.lit('He said "fine, thanks", '), F.col("stylist_notes"))
    source = r.customers().withColumn("stylist_notes", note)
    path = scratch_dir(r.spark, "csv")
    files.write_csv(source, path)
    return files.read_csv(r.spark, path, source.schema)


@query("read_csv_split", f"""
    SELECT customer_id, loyalty_id, email, first_name, last_name, tier, preferred_store_id,
           'He said' || chr(10) || '"fine, thanks", ' || stylist_notes AS stylist_notes, lifetime_value_band FROM r_customers""")
def _read_csv_split(r: Roles) -> DataFrame:
    """Notes with line breaks, read by as many tasks as the files have splits; a reject would be one row too many."""
    note = F.concat(F.lit('He said\n"fine, thanks", '), F.col("stylist_notes"))
    source = r.customers().withColumn("stylist_notes", note)
    path = scratch_dir(r.spark, "csv")
    files.write_csv(source, path)
    good, rejects = split_csv.read_csv_split(r.spark, path, source.schema)
    return good.unionByName(rejects.select(F.col("record").alias("email")), allowMissingColumns=True)


@query("read_chunked", f"""
    SELECT transaction_id, customer_id, store_id, {_ts('transaction_ts')} AS transaction_ts, sales_channel, payment_method,
           net_c / 100.0::DOUBLE AS gross_amount, 0.0::DOUBLE AS discount_amount, net_c / 100.0::DOUBLE AS net_amount
    FROM r_transactions""")
def _read_chunked(r: Roles) -> DataFrame:
    path = scratch_dir(r.spark, "chunks")
    files.write_csv(r.transactions(), path, max_rows=5_000)
    return files.read_csv(r.spark, f"{path}/part-*.csv", schemas.TRANSACTIONS)


@query("parse_array_literal", """
    SELECT customer_id, array_to_string(preferred_sizes, ';') AS preferred_sizes,
           array_to_string(preferred_brands, ';') AS preferred_brands,
           CAST(len(preferred_brands) AS INTEGER) AS brands FROM r_preferences""")
def _parse_array_literal(r: Roles) -> DataFrame:
    path = scratch_dir(r.spark, "arrays")
    source = r.preferences().drop("updated_at")
    files.write_csv(source, path)
    back = files.read_csv(r.spark, path, source.schema)
    return back.select("customer_id", "preferred_sizes", "preferred_brands", F.size("preferred_brands").alias("brands"))


@query("parse_json_purchases", """
    SELECT transaction_id, string_agg(product_id || '|' || quantity, ';' ORDER BY product_id, quantity) AS purchases
    FROM r_items GROUP BY transaction_id""")
def _parse_json_purchases(r: Roles) -> DataFrame:
    entry = F.struct(F.col("product_id").alias("sku"), F.col("quantity").alias("qty"))
    listed = r.transaction_items().groupBy("transaction_id").agg(F.sort_array(F.collect_list(entry)).alias("p"))
    return listed.select("transaction_id", text.json_purchases(F.to_json("p")).alias("purchases"))


@query("write_chunked", """
    SELECT store_id, CAST(count(*) AS BIGINT) AS row_count, CAST(sum(available_qty) AS BIGINT) AS available
    FROM r_inventory GROUP BY store_id""")
def _write_chunked(r: Roles) -> DataFrame:
    path = scratch_dir(r.spark, "parts")
    files.write_chunked(r.inventory(), path, max_rows=2_000)
    return r.spark.read.parquet(path).groupBy("store_id").agg(
        F.count(F.lit(1)).alias("row_count"), F.sum("available_qty").alias("available")
    )


_TABLES = ("supplier", "part", "customer", "orders", "lineitem", "events", "nation", "region")


@query("row_count_manifest", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS row_count, 1::BIGINT AS file_count FROM {t}" for t in _TABLES))
def _manifest(r: Roles) -> DataFrame:
    return files.manifest({t: r.table(t) for t in _TABLES})


@query("write_manifest", """
    SELECT 'orders' AS table_name, count(*) AS row_count, CAST(ceil(count(*) / 4000.0) AS BIGINT) AS file_count, 7::BIGINT AS seed FROM r_orders
    UNION ALL SELECT 'stores', count(*), 1, 7 FROM r_stores""")
def _write_manifest(r: Roles) -> DataFrame:
    """The manifest as it is read back; the orders are written by one task in files of 4,000 rows."""
    path = scratch_dir(r.spark, "manifest")
    files.write_chunked(r.orders().coalesce(1), f"{path}/orders", max_rows=4_000)
    files.write_chunked(r.stores().coalesce(1), f"{path}/stores", max_rows=4_000)
    files.write_manifest({t: r.spark.read.parquet(f"{path}/{t}") for t in ("orders", "stores")}, path, seed=7)
    return r.spark.read.json(f"{path}/tables").select("table_name", "row_count", "file_count", "seed")


@query("reload_tables", "SELECT store_id, store_name, city, state, region, store_type FROM r_stores")
def _reload(r: Roles) -> DataFrame:
    path = scratch_dir(r.spark, "reload")
    stores = r.stores()
    files.overwrite(stores.withColumn("city", F.lit("old")), path)
    files.overwrite(stores, path)
    return r.spark.read.parquet(path)


@query("inline_rows", """
    SELECT v.kind, count(*) AS products FROM (VALUES ('Work', 'desk'), ('Travel', 'trip')) AS v(occasion, kind)
    JOIN r_products USING (occasion) GROUP BY v.kind""")
def _inline(r: Roles) -> DataFrame:
    schema = "occasion string, kind string"
    literal = files.inline_rows(r.spark, [("Work", "desk"), ("Travel", "trip")], schema)
    return literal.join(r.products(), "occasion").groupBy("kind").agg(F.count(F.lit(1)).alias("products"))


# Lookup, filters, search -------------------------------------------------------------


@query("product_by_id", f"SELECT {_RECORD} FROM r_products WHERE product_id IN (SELECT product_id FROM r_items)")
def _product_by_id(r: Roles) -> DataFrame:
    return catalog.products_by_id(r.products(), r.transaction_items().select("product_id"))


@query("missing_products", """
    SELECT DISTINCT product_id FROM (SELECT 'PRD-' || lpad(CAST(2 * p_partkey AS VARCHAR), 7, '0') AS product_id FROM part)
    WHERE product_id NOT IN (SELECT product_id FROM r_products)""")
def _missing_products(r: Roles) -> DataFrame:
    asked = r.table("part").select(F.concat(F.lit("PRD-"), text.padded(F.col("p_partkey") * 2, 7)).alias("product_id"))
    return catalog.missing_products(r.products(), asked)


@query("optional_filters", f"""
    SELECT {_RECORD} FROM r_products
    WHERE category = 'PROMO' AND occasion = 'Work' AND msrp_c BETWEEN 91000 AND 98000""")
def _optional_filters(r: Roles) -> DataFrame:
    kept = catalog.apply_filters(
        r.products(), category="PROMO", occasion="Work", brand=None, at_least={"msrp": 910}, at_most={"msrp": 980}
    )
    return catalog.product_records(kept)


@query("active_only", "SELECT product_id, status FROM r_products WHERE status = 'active'")
def _active(r: Roles) -> DataFrame:
    return catalog.active_only(r.products()).select("product_id", "status")


@query("ilike_any", """
    SELECT product_id, product_name, style_id FROM r_products
    WHERE product_name ILIKE '%R_D%' OR style_id ILIKE '%R_D%' OR sku_id ILIKE '%R_D%'""")
def _ilike_any(r: Roles) -> DataFrame:
    return r.products().where(catalog.ilike_any("R_D")).select("product_id", "product_name", "style_id")


@query("cast_money", "SELECT product_id, msrp_c / 100.0::DOUBLE AS msrp, cost_c / 100.0::DOUBLE AS cost FROM r_products")
def _cast_money(r: Roles) -> DataFrame:
    return catalog.money_as_double(r.products().select("product_id", "msrp", "cost"), "msrp", "cost")


@query("case_rank", """
    SELECT relationship_type, CASE relationship_type WHEN 'alternative' THEN 0 ELSE 1 END AS type_rank, count(*) AS edges
    FROM r_relationships GROUP BY 1, 2""")
def _case_rank(r: Roles) -> DataFrame:
    ranked = r.relationships().withColumn("type_rank", stock.type_rank(F.col("relationship_type")))
    return ranked.groupBy("relationship_type", "type_rank").agg(F.count(F.lit(1)).alias("edges"))


@query("param_checks", """
    SELECT order_id, CASE WHEN nd THEN 'no_destination' WHEN us THEN 'unknown_store' ELSE 'duplicate_sku' END AS reason FROM (
        SELECT h.order_id, h.destination_store_id IS NULL AND h.ship_to_city IS NULL AS nd,
               h.destination_store_id IS NOT NULL AND s.store_id IS NULL AS us,
               EXISTS (SELECT 1 FROM (SELECT order_id, sku_id FROM r_req_items GROUP BY 1, 2 HAVING count(*) > 1) d
                       WHERE d.order_id = h.order_id) AS dup
        FROM r_req_headers h LEFT JOIN r_stores s ON s.store_id = h.destination_store_id) WHERE nd OR us OR dup""")
def _param_checks(r: Roles) -> DataFrame:
    return placement.request_rejects(r.request_headers(), r.request_items(), r.stores())


_SPOILT = """
    SELECT order_id, CASE WHEN seq % 13 = 0 THEN 'bad_shipping_method' WHEN seq % 11 = 0 THEN 'no_items' WHEN seq % 7 = 0 THEN 'bad_quantity'
               WHEN nd THEN 'no_destination' WHEN us THEN 'unknown_store' WHEN dup THEN 'duplicate_sku' END AS reason FROM (
        SELECT h.order_id, h.seq, h.destination_store_id IS NULL AND h.ship_to_city IS NULL AS nd,
               h.destination_store_id IS NOT NULL AND s.store_id IS NULL AS us,
               EXISTS (SELECT 1 FROM (SELECT order_id, sku_id FROM r_req_items GROUP BY 1, 2 HAVING count(*) > 1) d
                       WHERE d.order_id = h.order_id) AS dup
        FROM r_req_headers h LEFT JOIN r_stores s ON s.store_id = h.destination_store_id)"""


@query("param_reasons", f"SELECT reason, count(*) AS orders, min(order_id) AS first_order, max(order_id) AS last_order FROM ({_SPOILT}) GROUP BY reason")
def _param_reasons(r: Roles) -> DataFrame:
    """All six rules over requests of which some are spoilt: unknown methods, no items, quantities of 0 and above the limit."""
    heads = r.request_headers().withColumn("shipping_method", F.when(F.col("seq") % 13 == 0, "by_drone").otherwise(F.col("shipping_method")))
    seqs = heads.select("order_id", "seq")
    off = F.when(F.col("seq") % 2 == 0, 0).otherwise(placement.MAX_QUANTITY + 1)
    items = r.request_items().join(seqs, "order_id").where("seq % 11 <> 0").withColumn(
        "quantity", F.when(F.col("seq") % 7 == 0, off).otherwise(F.col("quantity")).cast("int")
    ).drop("seq")
    checked = placement.with_request_reason(heads, items, r.stores())
    return checked.groupBy("reason").agg(
        F.count(F.lit(1)).alias("orders"), F.min("order_id").alias("first_order"), F.max("order_id").alias("last_order")
    )


_HITS = """
    SELECT query_id, product_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY category, product_name, color, size, sku_id) AS INTEGER) AS rank
    FROM (SELECT k.query_id, p.* FROM r_queries k JOIN r_products p ON p.status = 'active'
          AND (k.q IS NULL OR p.product_name ILIKE '%' || k.q || '%' OR p.style_id ILIKE '%' || k.q || '%' OR p.sku_id ILIKE '%' || k.q || '%')
          AND (k.category IS NULL OR p.category = k.category) AND (k.occasion IS NULL OR p.occasion = k.occasion))"""
_STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)
_ALIAS = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in text.SIZE_ALIASES.items())
ROLES["x_hits"] = f"SELECT * FROM ({_HITS}) WHERE rank <= 20"
ROLES["x_tokens"] = f"""
    SELECT DISTINCT query_id, q, token FROM (
        SELECT query_id, q, CASE w {_ALIAS} ELSE w END AS token FROM (
            SELECT query_id, q, unnest(string_split(regexp_replace(lower(q), '[^a-z0-9]+', ' ', 'g'), ' ')) AS w
            FROM r_queries WHERE q IS NOT NULL) WHERE w NOT IN ({_STOP})) WHERE token <> ''"""
ROLES["x_shelf"] = """
    SELECT DISTINCT product_id, token FROM (
        SELECT product_id, unnest(string_split(regexp_replace(lower(concat_ws(' ', product_name, style_id, sku_id, category, subcategory,
            brand, color, size, occasion, material)), '[^a-z0-9]+', ' ', 'g'), ' ')) AS token FROM r_products WHERE status = 'active')
    WHERE token NOT IN ('', 's', 'm', 'l', 'xl')
    UNION ALL SELECT product_id, lower(size) FROM r_products WHERE status = 'active' AND lower(size) IN ('s', 'm', 'l', 'xl')"""
ROLES["x_scored"] = """
    SELECT * FROM (SELECT m.query_id, m.product_id, m.matched,
               10 * m.matched + CASE WHEN contains(lower(p.product_name), lower(m.q)) THEN 20 ELSE 0 END
               + CASE WHEN contains(lower(m.q), lower(p.product_name)) THEN 10 ELSE 0 END AS score,
               CAST(row_number() OVER (PARTITION BY m.query_id ORDER BY score DESC, p.product_name, p.color, p.size, p.sku_id) AS INTEGER) AS rank
        FROM (SELECT t.query_id, t.q, s.product_id, count(*) AS matched, any_value(n.n) AS n
              FROM x_tokens t JOIN x_shelf s USING (token)
              JOIN (SELECT query_id, count(*) AS n FROM x_tokens GROUP BY 1) n ON n.query_id = t.query_id
              GROUP BY 1, 2, 3) m JOIN r_products p USING (product_id) WHERE m.matched >= 2 OR m.n <= 2) WHERE rank <= 20"""


@query("substring_hits", "SELECT query_id, product_id, rank FROM x_hits")
def _substring_hits(r: Roles) -> DataFrame:
    return catalog.substring_hits(r.products(), r.search_queries())


@query("token_search", "SELECT query_id, product_id, matched, score, rank FROM x_scored")
def _token_search(r: Roles) -> DataFrame:
    return catalog.token_hits(r.products(), r.search_queries())


@query("product_search", f"""
    SELECT query_id, phase, rank, {_RECORD} FROM (
        SELECT query_id, product_id, rank, 1 AS phase FROM x_hits
        UNION ALL SELECT query_id, product_id, rank, 2 FROM x_scored WHERE query_id NOT IN (SELECT query_id FROM x_hits))
    JOIN r_products USING (product_id)""")
def _product_search(r: Roles) -> DataFrame:
    products = r.products()
    return catalog.search(products, r.search_queries(), index=catalog.stored_index(products))


@query("catalogue_order", f"""
    SELECT {_RECORD} FROM r_products WHERE status = 'active' AND occasion = 'Travel'
    ORDER BY category, product_name, color, size, sku_id LIMIT 20""")
def _catalogue_order(r: Roles) -> DataFrame:
    return catalog.substring_search(r.products(), occasion="Travel", limit=20)


# Stock -------------------------------------------------------------------------------

_STOCK_SQL = f"""
    SELECT p.product_id, s.store_id, s.store_name, s.city, s.state, s.region, s.store_type, i.sku_id, i.on_hand_qty,
           i.reserved_qty, i.available_qty, i.in_transit_qty, {_ts('i.last_updated')} AS last_updated
    FROM r_inventory i JOIN r_stores s USING (store_id) JOIN r_products p USING (sku_id)"""


@query("product_inventory", _STOCK_SQL)
def _product_inventory(r: Roles) -> DataFrame:
    return stock.inventory_for_products(r.inventory(), r.stores(), r.products(), ordered=False)


@query("inventory_order", """
    SELECT row_number() OVER (ORDER BY product_id, available_qty DESC NULLS LAST, in_transit_qty DESC NULLS LAST, store_id) AS position,
           product_id, store_id
    FROM r_inventory i JOIN r_stores s USING (store_id) JOIN r_products p USING (sku_id)""")
def _inventory_order(r: Roles) -> DataFrame:
    """The sorted report as its rows lie: positions come from the partitions, not from another sort."""
    return numbered(stock.inventory_for_products(r.inventory(), r.stores(), r.products())).select("position", "product_id", "store_id")


@query("product_inventory_at_store", _STOCK_SQL + " WHERE i.store_id = 7")
def _product_inventory_at_store(r: Roles) -> DataFrame:
    return stock.inventory_for_products(r.inventory(), r.stores(), r.products(), store_id=7)


@query("total_inventory", "SELECT sku_id, CAST(sum(available_qty) AS INTEGER) AS total_available_qty FROM r_inventory GROUP BY 1")
def _total_inventory(r: Roles) -> DataFrame:
    return stock.total_inventory(r.inventory())


@query("style_inventory", "SELECT store_id, style_id, stock AS style_available_qty FROM x_stock")
def _style_inventory(r: Roles) -> DataFrame:
    return stock.style_inventory(r.inventory(), r.products())


_RELATED = """
    SELECT source_product_id, e.id AS related_product_id, e.kind AS relationship_type, e.why AS relationship_reason, p.sku_id AS related_sku_id,
           p.product_name AS related_product_name, p.category AS related_category, p.color AS related_color, p.size AS related_size,
           p.msrp_c / 100.0::DOUBLE AS related_msrp, p.image_url AS related_image_url, e.here AS related_available_qty_in_origin_store,
           -e.minus_total AS related_total_available_qty, CAST(place AS INTEGER) AS rank
    FROM (SELECT source_product_id, unnest(best) AS e, unnest(range(1, len(best) + 1)) AS place
          FROM (SELECT source_product_id, list_sort(list({{'last': relationship_type <> 'alternative', 'minus_here': -coalesce(here, 0),
                           'minus_total': -coalesce(total, 0), 'id': related_product_id, 'kind': relationship_type, 'why': relationship_reason,
                           'here': here}}))[:{limit}] AS best
                FROM r_relationships JOIN r_products ON product_id = related_product_id
                LEFT JOIN (SELECT sku_id, CAST(sum(available_qty) AS INTEGER) AS total,
                                  CAST(sum(available_qty) FILTER ({origin}) AS INTEGER) AS here FROM r_inventory GROUP BY sku_id) USING (sku_id)
                WHERE {kind} GROUP BY source_product_id))
    JOIN r_products p ON p.product_id = e.id"""


@query("related_products", _RELATED.format(origin="store_id = 3", kind="true", limit=10))
def _related(r: Roles) -> DataFrame:
    return stock.related(r.relationships(), r.products(), r.inventory(), origin_store=3)


@query("related_alternatives", _RELATED.format(origin="false", kind="relationship_type = 'complementary'", limit=2))
def _related_kind(r: Roles) -> DataFrame:
    return stock.related(r.relationships(), r.products(), r.inventory(), relation_type="complementary", limit=2)


_IMBALANCE = """
    SELECT sku_id, style_id, product_name, category, gap.id AS shortage_store_id, gap.name AS shortage_store_name,
           gap.n AS shortage_available_qty, spare.id AS surplus_store_id, spare.name AS surplus_store_name, spare.n AS surplus_available_qty
    FROM (SELECT sku_id, gap, unnest(list_filter(shelf, lambda h: h.n > 0)) AS spare
          FROM (SELECT sku_id, shelf, unnest(list_filter(shelf, lambda h: h.n = 0)) AS gap
                FROM (SELECT sku_id, list({{'id': store_id, 'name': store_name, 'n': available_qty}}) AS shelf
                      FROM r_inventory JOIN r_stores USING (store_id) GROUP BY sku_id)))
    JOIN r_products p USING (sku_id) WHERE {cond}
    ORDER BY surplus_available_qty DESC, style_id, sku_id, shortage_store_id, surplus_store_id LIMIT {limit}"""


@query("inventory_imbalance", _IMBALANCE.format(cond="true", limit=25))
def _imbalance(r: Roles) -> DataFrame:
    return stock.imbalance(r.inventory(), r.stores(), r.products())


@query("inventory_imbalance_category", _IMBALANCE.format(cond="p.category = 'PROMO'", limit=100))
def _imbalance_category(r: Roles) -> DataFrame:
    return stock.imbalance(r.inventory(), r.stores(), r.products(), category="PROMO", limit=100)


@query("dim_lookup", f"""
    SELECT store_type, p.category, count(*) AS rows, CAST(sum(available_qty) AS BIGINT) AS available
    FROM r_inventory JOIN r_stores USING (store_id) JOIN r_products p USING (sku_id) GROUP BY 1, 2""")
def _dim_lookup(r: Roles) -> DataFrame:
    joined = stock.stock_by_store(r.inventory(), r.stores()).join(r.products().select("sku_id", "category"), "sku_id")
    return joined.groupBy("store_type", "category").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("available_qty").alias("available")
    )


# Planning ----------------------------------------------------------------------------

_WEEKLY = """
    SELECT CAST(week_start_date AS VARCHAR) AS week_start_date, store_id, store_name, c.category, w.style_id, units_sold,
           net_c / 100.0::DOUBLE AS net_sales, margin_c / 100.0::DOUBLE AS gross_margin, markdown_h / 100.0::DOUBLE AS markdown_rate,
           st_h / 100.0::DOUBLE AS sell_through_pct, wos_h / 100.0::DOUBLE AS weeks_of_supply
    FROM r_weekly w JOIN r_stores USING (store_id) JOIN (SELECT DISTINCT style_id, category FROM r_products) c USING (style_id)"""


@query("weekly_performance", _WEEKLY)
def _weekly(r: Roles) -> DataFrame:
    return planning.weekly_performance(r.weekly_performance(), r.stores(), r.products(), ordered=False)


@query("weekly_order", """
    SELECT row_number() OVER (ORDER BY w.week_start_date DESC, store_id, w.style_id, c.category) AS position, store_id, w.style_id, c.category
    FROM r_weekly w JOIN r_stores USING (store_id) JOIN (SELECT DISTINCT style_id, category FROM r_products) c USING (style_id)""")
def _weekly_order(r: Roles) -> DataFrame:
    rows = planning.weekly_performance(r.weekly_performance(), r.stores(), r.products())
    return numbered(rows).select("position", "store_id", "style_id", "category")


@query("weekly_performance_filtered", _WEEKLY + """
    WHERE c.category = 'ECONOMY' AND store_id = 2 AND week_start_date BETWEEN DATE '1996-01-01' AND DATE '1999-06-30'""")
def _weekly_filtered(r: Roles) -> DataFrame:
    return planning.weekly_performance(
        r.weekly_performance(), r.stores(), r.products(), category="ECONOMY", store_id=2,
        week_from=date(1996, 1, 1), week_to=date(1999, 6, 30),
    )


@query("avg_performance", "SELECT * FROM x_perf")
def _avg_performance(r: Roles) -> DataFrame:
    return planning.avg_performance(r.weekly_performance(), r.stores(), r.products())


_RECS = """
    SELECT action_type, priority, style_id, category, source_store_id, source_store_name, target_store_id, target_store_name,
           recommended_units, rationale FROM x_recs WHERE {cond}"""
_RECS_TOP = _RECS + """
    ORDER BY ps, action_type, style_id, source_store_id NULLS LAST, target_store_id NULLS LAST, category LIMIT {limit}"""


@query("rec_transfer", _RECS_TOP.format(cond="action_type = 'transfer'", limit=100))
def _rec_transfer(r: Roles) -> DataFrame:
    return planning.transfers(r.weekly_performance(), r.stores(), r.products(), r.inventory(), limit=100)


@query("rec_markdown", _RECS.format(cond="action_type = 'markdown_adjustment'"))
def _rec_markdown(r: Roles) -> DataFrame:
    return planning.markdowns(r.weekly_performance(), r.stores(), r.products())


@query("rec_reorder", _RECS.format(cond="action_type = 'reorder'"))
def _rec_reorder(r: Roles) -> DataFrame:
    return planning.reorders(r.weekly_performance(), r.stores(), r.products())


@query("planning_recommendations", _RECS_TOP.format(cond="true", limit=100))
def _recommendations(r: Roles) -> DataFrame:
    return planning.recommendations(r.weekly_performance(), r.stores(), r.products(), r.inventory(), limit=100)


@query("planning_recommendations_category", _RECS_TOP.format(cond="category = 'LARGE'", limit=25))
def _recommendations_category(r: Roles) -> DataFrame:
    return planning.recommendations(
        r.weekly_performance(), r.stores(), r.products(), r.inventory(), category="LARGE"
    )


@query("distinct_style_category", "SELECT DISTINCT style_id, category FROM r_products")
def _distinct(r: Roles) -> DataFrame:
    return planning.style_categories(r.products())


# Customers ---------------------------------------------------------------------------

ROLES["x_recent"] = f"""
    SELECT customer_id, max(transaction_ts) AS last_ts,
           string_agg(transaction_id || '|' || {_ts('transaction_ts')} || '|' || CAST(CAST(net_c AS DECIMAL(20,0)) / 100 AS DECIMAL(12,2)), ';'
                      ORDER BY transaction_ts DESC, transaction_id DESC) AS recent
    FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY transaction_ts DESC, transaction_id DESC) AS rn
          FROM r_transactions) WHERE rn <= 5 GROUP BY customer_id"""
ROLES["x_saved_items"] = f"""
    SELECT customer_id, count(*) AS n,
           string_agg(concat_ws('|', s.product_id, {_ts('saved_at')}, product_name, category, color, size), ';'
                      ORDER BY saved_at DESC, saved_item_id DESC) AS items
    FROM r_saved s JOIN r_products p USING (product_id) GROUP BY customer_id"""
ROLES["x_returns"] = """
    SELECT customer_id, count(*) AS n, (2 * sum(refund_c)::BIGINT + count(*)) // (2 * count(*)) AS avg_c,
           sum(refund_c)::BIGINT AS sum_c, mode() WITHIN GROUP (ORDER BY reason_code) AS reason
    FROM r_returns GROUP BY customer_id"""


def _dec(column: str) -> str:
    """Whole cents printed with two decimals."""
    return f"({column} // 100) || '.' || lpad(CAST({column} % 100 AS VARCHAR), 2, '0')"


ROLES["x_recent"] = ROLES["x_recent"].replace(
    "CAST(CAST(net_c AS DECIMAL(20,0)) / 100 AS DECIMAL(12,2))", _dec("net_c")
)
_HISTORY = f"n || '|' || {_dec('avg_c')} || '|' || {_dec('sum_c')} || '|' || reason"


@query("customer_recent_purchases", f"""
    SELECT customer_id, {_ts('last_ts')} AS last_purchase_ts, recent AS recent_purchases FROM x_recent""")
def _recent(r: Roles) -> DataFrame:
    return customer.recent_purchases(r.transactions())


@query("recent_rank", f"""
    SELECT * FROM (SELECT customer_id, transaction_id, CAST(row_number() OVER (PARTITION BY customer_id ORDER BY transaction_ts DESC, transaction_id DESC) AS INTEGER) AS rn
    FROM r_transactions) WHERE rn <= 5""")
def _recent_rank(r: Roles) -> DataFrame:
    order = [F.col("transaction_ts").desc(), F.col("transaction_id").desc()]
    ranked = catalog.top_k(r.transactions(), ["customer_id"], order, 5, rank="rn")
    return ranked.select("customer_id", "transaction_id", "rn")


@query("max_ts", f"SELECT customer_id, {_ts('max(transaction_ts)')} AS last_purchase_ts FROM r_transactions GROUP BY customer_id")
def _max_ts(r: Roles) -> DataFrame:
    return r.transactions().groupBy("customer_id").agg(F.max("transaction_ts").alias("last_purchase_ts"))


@query("customer_saved_items", """
    SELECT customer_id, 1 AS saved_items_page, n AS saved_item_count, items AS saved_items FROM x_saved_items""")
def _saved(r: Roles) -> DataFrame:
    return customer.saved_items_summary(r.saved_items(), r.sale_products())


@query("customer_saved_items_paged", f"""
    SELECT customer_id, CAST((rn - 1) // 10 + 1 AS INTEGER) AS saved_items_page, any_value(total) AS saved_item_count,
           string_agg(concat_ws('|', product_id, {_ts('saved_at')}, product_name, category, color, size), ';'
                      ORDER BY saved_at DESC, saved_item_id DESC) AS saved_items
    FROM (SELECT s.*, product_name, category, color, size, count(*) OVER (PARTITION BY customer_id) AS total,
                 row_number() OVER (PARTITION BY customer_id ORDER BY saved_at DESC, saved_item_id DESC) AS rn
          FROM r_saved s JOIN r_products p USING (product_id)) GROUP BY customer_id, 2""")
def _saved_paged(r: Roles) -> DataFrame:
    return customer.saved_items_summary(r.saved_items(), r.sale_products(), page_size=10)


@query("customer_return_history", f"""
    SELECT customer_id, n AS total_returns, avg_c / 100.0::DOUBLE AS avg_refund_amount, sum_c / 100.0::DOUBLE AS total_refund_amount,
           {_HISTORY} AS return_history_summary FROM x_returns""")
def _returns(r: Roles) -> DataFrame:
    return customer.return_history(r.returns())


@query("mode_reason", """
    SELECT customer_id, mode() WITHIN GROUP (ORDER BY reason_code) AS top_reason FROM r_returns GROUP BY customer_id""")
def _mode(r: Roles) -> DataFrame:
    return r.returns().groupBy("customer_id").agg(F.mode("reason_code", True).alias("top_reason"))


@query("round_avg_sum", """
    SELECT reason_code, ((2 * sum(refund_c)::BIGINT + count(*)) // (2 * count(*))) AS avg_cents, sum(refund_c)::BIGINT AS sum_cents
    FROM r_returns GROUP BY reason_code""")
def _round_avg_sum(r: Roles) -> DataFrame:
    sums = r.returns().groupBy("reason_code").agg(
        F.sum(cents(F.col("refund_amount"))).alias("sum_cents"), F.count(F.lit(1)).alias("n")
    )
    return sums.select("reason_code", half_up(F.col("sum_cents"), F.col("n")).alias("avg_cents"), "sum_cents")


_PROFILE_SQL = f"""
    SELECT c.customer_id, loyalty_id, email, first_name, last_name, tier, preferred_store_id,
           array_to_string(preferred_sizes, ';') AS preferred_sizes, array_to_string(preferred_colors, ';') AS preferred_colors,
           array_to_string(preferred_brands, ';') AS preferred_brands, array_to_string(shopping_occasions, ';') AS shopping_occasions,
           coalesce(recent, '') AS recent_purchases, coalesce(items, '') AS saved_items,
           coalesce({_HISTORY.replace("n ||", "h.n ||", 1)}, '0|0.00|0.00|-') AS return_history_summary, stylist_notes, lifetime_value_band, 1 AS saved_items_page
    FROM r_customers c LEFT JOIN r_preferences p USING (customer_id) LEFT JOIN x_recent USING (customer_id)
    LEFT JOIN x_saved_items USING (customer_id) LEFT JOIN x_returns h USING (customer_id)"""


def _profiles(r: Roles) -> DataFrame:
    return customer.customer_360(
        r.customers(), r.preferences(), customer.recent_purchases(r.transactions()),
        customer.saved_items_summary(r.saved_items(), r.sale_products()), customer.return_history(r.returns()),
    )


@query("customer_360", _PROFILE_SQL)
def _customer_360(r: Roles) -> DataFrame:
    return _profiles(r)


@query("refresh_views", _PROFILE_SQL)
def _refresh(r: Roles) -> DataFrame:
    return customer.refresh(
        scratch_dir(r.spark, "views"), r.customers(), r.preferences(), r.transactions(), r.saved_items(),
        r.sale_products(), r.returns(),
    )


@query("refresh_incremental", _PROFILE_SQL)
def _refresh_incremental(r: Roles) -> DataFrame:
    """Three loads instead of one, split by row: two of about half the rows and a small one of few customers."""
    stored = customer.StoredProfiles(r.spark, scratch_dir(r.spark, "profiles"))
    tables = {"transaction_id": r.transactions(), "saved_item_id": r.saved_items(), "return_id": r.returns()}

    def turn(key: str) -> Column:
        few = F.pmod(F.crc32(F.col("customer_id").cast("string")), F.lit(50)) == 0
        return F.when(few & (F.pmod(F.xxhash64(key), F.lit(3)) == 0), 3).otherwise(F.pmod(F.xxhash64(key), F.lit(2)) + 1)

    for batch in (1, 2, 3):
        transactions, saved, returns = (t.where(turn(key) == batch) for key, t in tables.items())
        stored.load(transactions, saved, r.sale_products(), returns, batch)
    transactions, saved, returns = tables.values()
    return stored.profiles(r.customers(), r.preferences(), (transactions, saved, r.sale_products(), returns))


# Orders ------------------------------------------------------------------------------


@query("order_total", "SELECT order_id, CAST(sum(quantity * price_c) AS BIGINT) AS total_cents FROM r_order_lines GROUP BY order_id")
def _order_total(r: Roles) -> DataFrame:
    return orders.order_totals(r.order_lines())


@query("order_summary", f"""
    SELECT o.order_id, customer_id, {_ts('order_date')} AS order_date, order_status, fulfillment_store_id,
           f.store_name AS fulfillment_store_name, destination_store_id, d.store_name AS destination_store_name, ship_to_city,
           shipping_method, estimated_delivery_days, CAST(estimated_delivery_date AS VARCHAR) AS estimated_delivery_date,
           coalesce(t.c, 0) / 100.0::DOUBLE AS total_amount
    FROM r_orders o JOIN r_stores f ON f.store_id = fulfillment_store_id LEFT JOIN r_stores d ON d.store_id = destination_store_id
    LEFT JOIN (SELECT order_id, CAST(sum(quantity * price_c) AS BIGINT) AS c FROM r_order_lines GROUP BY 1) t ON t.order_id = o.order_id""")
def _order_summary(r: Roles) -> DataFrame:
    return orders.order_summary(r.orders(), r.stores(), r.order_lines())


@query("order_lines", """
    SELECT order_id, sku_id, quantity, price_c / 100.0::DOUBLE AS unit_price, (quantity * price_c) / 100.0::DOUBLE AS line_total
    FROM r_order_lines""")
def _order_lines(r: Roles) -> DataFrame:
    return orders.order_lines(r.order_lines(), ordered=False)


@query("order_lines_order", """
    SELECT row_number() OVER (ORDER BY order_id, sku_id) AS position, order_id, sku_id FROM r_order_lines""")
def _order_lines_order(r: Roles) -> DataFrame:
    return numbered(orders.order_lines(r.order_lines())).select("position", "order_id", "sku_id")


@query("route_order", "SELECT order_id, store_id FROM x_routed")
def _route(r: Roles) -> DataFrame:
    return placement.route(r.request_headers(), r.request_items(), r.inventory()).select("order_id", "store_id")


@query("check_availability", """
    SELECT i.order_id, count(*) AS items, bool_and(coalesce(v.available_qty >= i.quantity, false)) AS available
    FROM r_req_items i JOIN x_routed h USING (order_id) LEFT JOIN r_inventory v ON v.store_id = h.store_id AND v.sku_id = i.sku_id
    GROUP BY i.order_id""")
def _check(r: Roles) -> DataFrame:
    inventory, items = r.inventory(), r.request_items()
    routed = placement.route(r.request_headers(), items, inventory)
    return placement.check_availability(routed, items, inventory)


_AS_OF = "TIMESTAMP '2026-01-31 22:15:00'"
ROLES["x_eta"] = """
    SELECT order_id, store_id, CASE WHEN destination_store_id = store_id THEN 1 WHEN shipping_method IN ('store_pickup', 'overnight') THEN 1
           WHEN shipping_method = 'expedited' THEN 2 ELSE 3 END AS days FROM x_routed"""


@query("delivery_eta", """
    SELECT order_id, days AS estimated_delivery_days, CAST(DATE '2026-01-31' + days AS VARCHAR) AS estimated_delivery_date FROM x_eta""")
def _eta(r: Roles) -> DataFrame:
    routed = placement.route(r.request_headers(), r.request_items(), r.inventory())
    return placement.with_eta(routed, F.expr(_AS_OF)).select(
        "order_id", "estimated_delivery_days", "estimated_delivery_date"
    )


@query("price_order", """
    SELECT order_id, line_no, sku_id, quantity, msrp_c / 100.0::DOUBLE AS unit_price FROM r_req_items LEFT JOIN r_products USING (sku_id)""")
def _price(r: Roles) -> DataFrame:
    return placement.price_items(r.request_items(), r.products()).select(
        "order_id", "line_no", "sku_id", "quantity", "unit_price"
    )


@query("reserve_inventory", f"""
    SELECT v.store_id, v.sku_id, on_hand_qty, CAST(reserved_qty + coalesce(t.q, 0) AS INTEGER) AS reserved_qty,
           CAST(CASE WHEN t.q IS NULL THEN available_qty ELSE on_hand_qty - (reserved_qty + t.q) END AS INTEGER) AS available_qty, in_transit_qty,
           CASE WHEN t.q IS NULL THEN {_ts('last_updated')} ELSE '2026-01-31 22:15:00.000000' END AS last_updated
    FROM r_inventory v LEFT JOIN (
        SELECT h.store_id, i.sku_id, sum(i.quantity) AS q FROM x_routed h JOIN r_req_items i USING (order_id) GROUP BY 1, 2) t
      ON t.store_id = v.store_id AND t.sku_id = v.sku_id""")
def _reserve(r: Roles) -> DataFrame:
    inventory, items = r.inventory(), r.request_items()
    routed = placement.route(r.request_headers(), items, inventory)
    wanted = items.join(routed.select("order_id", "store_id"), "order_id")
    return placement.apply_reservations(inventory, wanted, F.expr(_AS_OF))


@query("stock_rejects", """
    SELECT order_id, CASE WHEN store_id IS NULL THEN 'cannot_fulfil' WHEN NOT enough THEN 'insufficient' ELSE 'unknown_sku' END AS reason
    FROM (SELECT h.order_id, any_value(h.store_id) AS store_id, bool_and(coalesce(v.available_qty >= i.quantity, false)) AS enough,
                 bool_and(p.sku_id IS NOT NULL) AS sold
          FROM x_routed h JOIN r_req_items i USING (order_id) LEFT JOIN r_inventory v ON v.store_id = h.store_id AND v.sku_id = i.sku_id
          LEFT JOIN r_products p ON p.sku_id = i.sku_id GROUP BY h.order_id) WHERE store_id IS NULL OR NOT enough OR NOT sold""")
def _stock_rejects(r: Roles) -> DataFrame:
    inventory, items = r.inventory(), r.request_items()
    routed = placement.route(r.request_headers(), items, inventory)
    return placement.stock_rejects(routed, items, inventory, r.products())


@query("place_orders", """
    SELECT order_id, outcome, store_id AS fulfillment_store_id FROM x_placed""")
def _place_orders(r: Roles) -> DataFrame:
    placed = placement.place_orders(
        r.request_headers(), r.request_items(), r.inventory(), r.products(), r.stores(), F.expr(_AS_OF)
    )
    won = placed.orders.select("order_id", F.lit("accepted").alias("outcome"), "fulfillment_store_id")
    lost = placed.rejects.select(
        "order_id", F.col("reason").alias("outcome"), F.lit(None).cast("int").alias("fulfillment_store_id")
    )
    return won.unionByName(lost)


@query("place_orders_lines", """
    SELECT i.order_id, i.sku_id, i.quantity, msrp_c / 100.0::DOUBLE AS unit_price
    FROM x_placed p JOIN r_req_items i USING (order_id) JOIN r_products USING (sku_id) WHERE outcome = 'accepted'""")
def _place_orders_lines(r: Roles) -> DataFrame:
    return placement.place_orders(
        r.request_headers(), r.request_items(), r.inventory(), r.products(), r.stores(), F.expr(_AS_OF)
    ).lines


@query("place_orders_inventory", f"""
    SELECT v.store_id, v.sku_id, on_hand_qty, CAST(reserved_qty + coalesce(t.q, 0) AS INTEGER) AS reserved_qty,
           CAST(available_qty - coalesce(t.q, 0) AS INTEGER) AS available_qty, in_transit_qty,
           CASE WHEN t.q IS NULL THEN {_ts('last_updated')} ELSE '2026-01-31 22:15:00.000000' END AS last_updated
    FROM r_inventory v LEFT JOIN (
        SELECT p.store_id, i.sku_id, sum(i.quantity) AS q FROM x_placed p
        JOIN r_req_items i USING (order_id) WHERE outcome = 'accepted' GROUP BY 1, 2) t ON t.store_id = v.store_id AND t.sku_id = v.sku_id""")
def _place_orders_inventory(r: Roles) -> DataFrame:
    placed = placement.place_orders(
        r.request_headers(), r.request_items(), r.inventory(), r.products(), r.stores(), F.expr(_AS_OF)
    )
    return placed.inventory


@query("place_orders_stream", """
    SELECT order_id, store_id AS fulfillment_store_id, days AS estimated_delivery_days,
           CAST(DATE '2026-01-31' + days AS VARCHAR) AS estimated_delivery_date
    FROM (SELECT p.order_id, p.store_id, CASE WHEN h.destination_store_id = p.store_id OR shipping_method IN ('store_pickup', 'overnight') THEN 1
                      WHEN shipping_method = 'expedited' THEN 2 ELSE 3 END AS days
          FROM x_placed p JOIN r_req_headers h USING (order_id) WHERE outcome = 'accepted')""")
def _place_orders_stream(r: Roles) -> DataFrame:
    """All requests arrive in one micro-batch, as several files."""
    state, inbox = scratch_dir(r.spark, "intake"), scratch_dir(r.spark, "inbox")
    requests = r.request_headers().join(r.request_items(), "order_id").withColumn("placed_at", F.expr(_AS_OF))
    requests.write.parquet(inbox)
    order_stream.start_inventory(r.inventory(), state)
    source = r.spark.readStream.schema(requests.schema).parquet(inbox)
    order_stream.place_orders_stream(source, r.products(), r.stores(), state).awaitTermination()
    return r.spark.read.parquet(f"{state}/orders").select(
        "order_id", "fulfillment_store_id", "estimated_delivery_days", "estimated_delivery_date"
    )


# Maintenance -------------------------------------------------------------------------


SQL_UPSERT = """
    SELECT store_id, sku_id, available_qty, CAST(0 AS INTEGER) AS changed FROM r_inventory WHERE reserved_qty <> on_hand_qty
    UNION ALL SELECT store_id, sku_id, 0, 1 FROM r_inventory WHERE reserved_qty = on_hand_qty
    UNION ALL SELECT -1, sku_id, 5, 1 FROM r_products"""


@query("upsert", SQL_UPSERT)
def _upsert(r: Roles) -> DataFrame:
    return _upserted(r, maintain.upsert)


@query("upsert_stored", SQL_UPSERT)
def _upsert_stored(r: Roles) -> DataFrame:
    """The same updates put into a stored table, bucket by bucket."""

    def stored(base: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
        table = BucketTable(r.spark, scratch_dir(r.spark, "positions"), keys, base.schema, 32)
        table.replace(base)
        maintain.upsert_stored(table, updates, 1)
        return table.read()

    return _upserted(r, stored)


def _upserted(r: Roles, put) -> DataFrame:
    inventory = r.inventory()
    base = inventory.select("store_id", "sku_id", "available_qty", F.lit(0).alias("changed"))
    gone = inventory.where(F.col("reserved_qty") == F.col("on_hand_qty")).select(
        "store_id", "sku_id", F.lit(0).alias("available_qty"), F.lit(1).alias("changed")
    )
    fresh = r.products().select(
        F.lit(-1).alias("store_id"), "sku_id", F.lit(5).alias("available_qty"), F.lit(1).alias("changed")
    )
    return put(base, gone.unionByName(fresh), ["store_id", "sku_id"])


@query("conditional_update", """
    SELECT customer_id, CASE WHEN lower(first_name) = 'customer' AND lower(last_name) LIKE '%5' THEN 121 ELSE preferred_store_id END
           AS preferred_store_id FROM r_customers""")
def _conditional_update(r: Roles) -> DataFrame:
    named = (F.lower("first_name") == "customer") & F.lower("last_name").endswith("5")
    done = maintain.conditional_update(r.customers(), named, {"preferred_store_id": F.lit(121)})
    return done.select("customer_id", "preferred_store_id")


@query("update_from", """
    SELECT w.store_id, style_id, CAST(week_start_date AS VARCHAR) AS week_start_date,
           CASE WHEN w.store_id < 50 THEN s.region ELSE 'unset' END AS region
    FROM r_weekly w LEFT JOIN r_stores s ON s.store_id = w.store_id""")
def _update_from(r: Roles) -> DataFrame:
    base = r.weekly_performance().select("store_id", "style_id", "week_start_date", F.lit("unset").alias("region"))
    source = r.stores().where(F.col("store_id") < 50)
    return maintain.update_from(base, source, ["store_id"], ["region"])


@query("insert_select", """
    SELECT store_id, sku_id, available_qty FROM r_inventory
    UNION ALL SELECT -1, min(sku_id), 0 FROM r_products WHERE lower(color) = 'red' AND size = 'M'""")
def _insert_select(r: Roles) -> DataFrame:
    picked = r.products().where((F.lower("color") == "red") & (F.col("size") == "M")).select(
        F.lit(-1).alias("store_id"), "sku_id", F.lit(0).alias("available_qty")
    )
    base = r.inventory().select("store_id", "sku_id", "available_qty")
    return maintain.insert_select(base, picked, ["store_id", "sku_id"], [F.col("sku_id")])


def _slots(index: int) -> str:
    arms = []
    for region, places in derive.REGION_SLOTS.items():
        values = ", ".join(f"'{p[index]}'" for p in places)
        arms.append(f"WHEN reg = '{region}' THEN ([{values}])[slot + 1]")
    last = arms.pop().split("THEN", 1)[1]
    return f"CASE {' '.join(arms)} ELSE {last} END"


# Regions of the test tables are renamed so that four of five have slots of their own.
_REGION_NAMES = {
    "AFRICA": "Northeast", "AMERICA": "Southeast", "ASIA": "Midwest", "EUROPE": "Southwest",
}
_REGION_CASE = "CASE region " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _REGION_NAMES.items()) + " ELSE region END"
ROLES["x_places"] = f"""
    SELECT store_id, CASE WHEN store_id = 56 THEN 'Northeast' ELSE reg END AS region,
           CASE WHEN store_id = 56 THEN 'Boston' ELSE {_slots(0)} END AS city,
           CASE WHEN store_id = 56 THEN 'MA' ELSE {_slots(1)} END AS state_code,
           CASE WHEN store_id = 56 THEN 'Boylston Street' ELSE {_slots(2)} END AS street
    FROM (SELECT store_id, {_REGION_CASE} AS reg, store_id % 6 AS slot FROM r_stores)"""
_PLACE_COLUMNS = """
    SELECT store_id, region, city, state_code, (100 + store_id) || ' ' || street AS street_address,
           lpad(CAST(10000 + (store_id * 37) % 89999 AS VARCHAR), 5, '0') AS postal_code,
           city || ' - ' || street || ' Location' AS store_name"""


def _regional_stores(r: Roles) -> DataFrame:
    names = F.create_map(*[F.lit(x) for pair in _REGION_NAMES.items() for x in pair])
    return r.stores().withColumn("region", F.coalesce(F.try_element_at(names, F.col("region")), F.col("region")))


@query("store_location_map", _PLACE_COLUMNS + " FROM x_places")
def _store_locations(r: Roles) -> DataFrame:
    return maintain.store_locations(_regional_stores(r))


@query("relocate_stores", _PLACE_COLUMNS + ", store_type FROM x_places JOIN (SELECT store_id, store_type FROM r_stores) USING (store_id)")
def _relocate(r: Roles) -> DataFrame:
    return maintain.relocate_stores(_regional_stores(r).withColumnRenamed("state", "state_code"))


@query("email_backfill", """
    SELECT customer_id, coalesce(email, 'customer' || customer_id || '@example.com') AS email FROM r_customers""")
def _email_backfill(r: Roles) -> DataFrame:
    return maintain.email_backfill(r.customers()).select("customer_id", "email")


@query("query_rejects", """
    SELECT query_id, q, reason FROM (
        SELECT CASE WHEN length(q) <> 3 THEN query_id END AS query_id, q,
               CASE WHEN length(q) = 3 THEN 'missing_query_id' WHEN length(q) < 2 THEN 'q_too_short' END AS reason
        FROM (SELECT DISTINCT p_name || n AS query_id, left(p_name, n) AS q FROM part, (SELECT unnest([1, 2, 3, 4]) AS n)))
    WHERE reason IS NOT NULL""")
def _query_rejects(r: Roles) -> DataFrame:
    """First letters of every product name as queries; those of three letters have lost their id."""
    size = F.explode(F.array(*[F.lit(n) for n in (1, 2, 3, 4)]))
    cut = r.table("part").select("p_name", size.alias("n")).select(
        F.concat("p_name", F.col("n").cast("string")).alias("query_id"), F.expr("left(p_name, n)").alias("q")
    ).distinct()
    asked = cut.withColumn("query_id", F.when(F.length("q") != 3, F.col("query_id")))
    return catalog.query_rejects(asked).select("query_id", "q", "reason")


# Data quality ------------------------------------------------------------------------


def _sales_tables(r: Roles) -> dict[str, DataFrame]:
    return {
        "stores": r.stores(), "brands": r.brands(), "products": r.sale_products(), "customers": r.customers(),
        "customer_preferences": r.preferences(), "saved_items": r.saved_items(), "transactions": r.transactions(),
        "transaction_items": r.transaction_items(), "returns": r.returns(),
    }


_SALES_ROLES = {
    "stores": "r_stores", "brands": "r_brands", "products": "r_products", "customers": "r_customers", "customer_preferences": "r_preferences",
    "saved_items": "r_saved", "transactions": "r_transactions", "transaction_items": "r_items", "returns": "r_returns",
}


@query("dq_row_counts", " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {t}" for n, t in _SALES_ROLES.items()))
def _dq_row_counts(r: Roles) -> DataFrame:
    return quality.row_counts(_sales_tables(r))


_DUPLICATES = {
    "customers.customer_id": ("r_customers", "customer_id"), "customers.loyalty_id": ("r_customers", "loyalty_id"),
    "customers.email": ("r_customers", "email"), "transactions.transaction_id": ("r_transactions", "transaction_id"),
    "transaction_items.line": ("r_items", "transaction_id, product_id"), "inventory.key": ("r_inventory", "store_id, sku_id"),
    "weekly.key": ("r_weekly", "week_start_date, store_id, style_id"),
}


@query("dq_duplicates", " UNION ALL ".join(
    f"SELECT '{n} duplicates' AS check_name, count(*) AS duplicate_keys FROM (SELECT {k} FROM {t} GROUP BY {k} HAVING count(*) > 1)"
    for n, (t, k) in _DUPLICATES.items()))
def _dq_duplicates(r: Roles) -> DataFrame:
    tables = {
        "r_customers": r.customers(), "r_transactions": r.transactions(), "r_items": r.transaction_items(),
        "r_inventory": r.inventory(), "r_weekly": r.weekly_performance(),
    }
    return quality.duplicates({n: (tables[t], k.split(", ")) for n, (t, k) in _DUPLICATES.items()})


@query("having_duplicates", """
    SELECT transaction_id, product_id, count(*) AS copies FROM r_items GROUP BY 1, 2 HAVING count(*) > 1""")
def _having(r: Roles) -> DataFrame:
    return quality.repeated_keys(r.transaction_items(), ["transaction_id", "product_id"])


@query("dq_date_range", f"""
    SELECT {_ts('min(transaction_ts)')} AS min_transaction_ts, {_ts('max(transaction_ts)')} AS max_transaction_ts,
           count(*) FILTER (year(transaction_ts) NOT BETWEEN 1996 AND 1999) AS out_of_range_rows FROM r_transactions""")
def _dq_date_range(r: Roles) -> DataFrame:
    return quality.date_range(r.transactions(), "transaction_ts", date(1996, 1, 1), date(1999, 12, 31))


@query("min_max", f"SELECT sales_channel, {_ts('min(transaction_ts)')} AS first_ts, {_ts('max(transaction_ts)')} AS last_ts FROM r_transactions GROUP BY 1")
def _min_max(r: Roles) -> DataFrame:
    return r.transactions().groupBy("sales_channel").agg(
        F.min("transaction_ts").alias("first_ts"), F.max("transaction_ts").alias("last_ts")
    )


def _orphan_sql(name: str, child: str, key: str, parent: str, parent_key: str) -> str:
    return (
        f"SELECT '{name}' AS check_name, count(*) AS orphan_rows FROM {child} x WHERE x.{key} IS NOT NULL AND NOT EXISTS "
        f"(FROM {parent} y WHERE y.{parent_key} = x.{key})"
    )


@query("dq_orphans", " UNION ALL ".join([
    _orphan_sql("transactions.customers", "r_transactions", "customer_id", "r_customers", "customer_id"),
    _orphan_sql("items.transactions", "r_items", "transaction_id", "r_transactions", "transaction_id"),
    _orphan_sql("returns.items", "r_returns", "transaction_item_id", "r_items", "transaction_item_id"),
    _orphan_sql("returns.first_customers", "r_returns", "customer_id", "r_preferences", "customer_id"),
    _orphan_sql("orders.destination", "r_req_headers", "destination_store_id", "r_stores", "store_id"),
]))
def _dq_orphans(r: Roles) -> DataFrame:
    return quality.orphans({
        "transactions.customers": (r.transactions(), "customer_id", r.customers(), "customer_id"),
        "items.transactions": (r.transaction_items(), "transaction_id", r.transactions(), "transaction_id"),
        "returns.items": (r.returns(), "transaction_item_id", r.transaction_items(), "transaction_item_id"),
        "returns.first_customers": (r.returns(), "customer_id", r.preferences(), "customer_id"),
        "orders.destination": (r.request_headers(), "destination_store_id", r.stores(), "store_id"),
    }, optional=("orders.destination",))


@query("orphan_keys", """
    SELECT customer_id AS key_value, count(*) AS child_rows FROM r_returns
    WHERE customer_id NOT IN (SELECT customer_id FROM r_preferences) GROUP BY 1""")
def _orphan_keys(r: Roles) -> DataFrame:
    return quality.orphan_keys(r.returns(), "customer_id", r.preferences(), "customer_id")


_COVERED = {
    "email": "text", "preferred_sizes": "array", "preferred_colors": "array", "preferred_brands": "array",
    "shopping_occasions": "array", "lifetime_value_band": "value",
}


_LACKS = {"text": "coalesce({0}, '') = ''", "array": "coalesce(len({0}), 0) = 0", "value": "{0} IS NULL"}


@query("dq_field_coverage", "SELECT count(*) AS total_customers, " + ", ".join(
    f"count(*) FILTER ({_LACKS[kind].format(c)}) AS missing_{c}" for c, kind in _COVERED.items()
) + " FROM r_customers LEFT JOIN r_preferences USING (customer_id)")
def _dq_field_coverage(r: Roles) -> DataFrame:
    return quality.field_coverage(_profiles(r), _COVERED)


def _count_sql(checks: dict[str, tuple[str, str]]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{n}' AS check_name, count(*) FILTER (WHERE NOT ({c})) AS violations FROM {t}" for n, (t, c) in checks.items()
    )


def _in(column: str) -> str:
    return f"{column} IN ({', '.join(repr(v) for v in quality.DOMAINS[column])})"


@query("dq_domain", _count_sql({
    "customers_tier": ("r_customers", _in("tier")), "customers_lifetime_value_band": ("r_customers", _in("lifetime_value_band")),
    "transactions_sales_channel": ("r_transactions", _in("sales_channel")),
    "transactions_payment_method": ("r_transactions", _in("payment_method")), "returns_reason_code": ("r_returns", _in("reason_code")),
    "products_status": ("r_products", _in("status")), "orders_order_status": ("r_orders", _in("order_status")),
    "orders_shipping_method": ("r_orders", _in("shipping_method")),
    "relationships_relationship_type": ("r_relationships", _in("relationship_type")),
}))
def _dq_domain(r: Roles) -> DataFrame:
    return quality.union_rows([
        quality.domain_check(r.customers(), "customers", ["tier", "lifetime_value_band"]),
        quality.domain_check(r.transactions(), "transactions", ["sales_channel", "payment_method"]),
        quality.domain_check(r.returns(), "returns", ["reason_code"]),
        quality.domain_check(r.products(), "products", ["status"]),
        quality.domain_check(r.orders(), "orders", ["order_status", "shipping_method"]),
        quality.domain_check(r.relationships(), "relationships", ["relationship_type"]),
    ])


@query("dq_range", _count_sql({
    "items_quantity": ("r_items", "quantity >= 1"),
    "inventory_on_hand_qty": ("r_inventory", "on_hand_qty >= 0"), "inventory_reserved_qty": ("r_inventory", "reserved_qty >= 0"),
    "inventory_available_qty": ("r_inventory", "available_qty >= 0 AND available_qty <= 60"),
    "weekly_sell_through_pct": ("r_weekly", "st_h BETWEEN 0 AND 10000"), "weekly_markdown_rate": ("r_weekly", "markdown_h BETWEEN 0 AND 10000"),
    "weekly_weeks_of_supply": ("r_weekly", "wos_h BETWEEN 0 AND 5000"),
}))
def _dq_range(r: Roles) -> DataFrame:
    return quality.union_rows([
        quality.range_check(r.transaction_items(), "items", {"quantity": (1, None)}),
        quality.range_check(
            r.inventory(), "inventory",
            {"on_hand_qty": (0, None), "reserved_qty": (0, None), "available_qty": (0, 60)},
        ),
        quality.range_check(
            r.weekly_performance(), "weekly",
            {"sell_through_pct": (0, 100), "markdown_rate": (0, 100), "weeks_of_supply": (0, 50)},
        ),
    ])


@query("dq_row_identity", _count_sql({
    "inventory_stock": ("r_inventory", "available_qty = on_hand_qty - reserved_qty"),
    "inventory_transit": ("r_inventory", "in_transit_qty <= available_qty"),
    "relationships_self": ("r_relationships", "source_product_id <> related_product_id"),
}))
def _dq_row_identity(r: Roles) -> DataFrame:
    rules = {"stock": quality.stock_identity(), "transit": F.col("in_transit_qty") <= F.col("available_qty")}
    return quality.union_rows([
        quality.identity_check(r.inventory(), "inventory", rules),
        quality.identity_check(r.relationships(), "relationships", {"self": quality.no_self_edge()}),
    ])


ROLES["x_sizes"] = """
    SELECT (SELECT count(*) FROM r_items) AS i, (SELECT count(*) FROM r_transactions) AS t, (SELECT count(*) FROM r_returns) AS x,
           (SELECT count(*) FROM r_preferences) AS p, (SELECT count(*) FROM r_customers) AS c"""


_DECLARED = {
    "core_stores": ("r_stores", Roles.stores), "brands": ("r_brands", Roles.brands),
    "core_products": ("r_core_products", Roles.core_products), "customers": ("r_customers", Roles.customers),
    "customer_preferences": ("r_preferences", Roles.preferences), "saved_items": ("r_saved", Roles.saved_items),
    "transactions": ("r_transactions", Roles.transactions), "transaction_items": ("r_items", Roles.transaction_items),
    "returns": ("r_returns", Roles.returns), "styles": ("r_styles", Roles.styles), "skus": ("r_skus", Roles.skus),
    "sku_inventory": ("r_sku_inventory", Roles.sku_inventory), "sales_summary": ("r_sales_summary", Roles.sales_summary),
    "customer_profiles": ("r_customers", Roles.customers),
    "style_relationships": ("r_style_relationships", Roles.style_relationships),
    "source_orders": ("r_source_orders", Roles.source_orders), "source_order_items": ("r_source_items", Roles.source_order_items),
    "products": ("r_products", Roles.products), "stores": ("r_stores", Roles.stores),
    "inventory": ("r_inventory", Roles.inventory), "relationships": ("r_relationships", Roles.relationships),
    "orders": ("r_orders", Roles.orders), "order_lines": ("r_declared_lines", Roles.order_lines),
    "weekly_performance": ("r_declared_weeks", Roles.weekly_performance),
}


def _declared(r: Roles) -> dict[str, DataFrame]:
    return {name: build(r) for name, (_, build) in _DECLARED.items()}


def _broken(rule: str, condition: str, table: str) -> str:
    return f"SELECT '{rule}' AS rule, count(*) FILTER ({condition}) AS violations FROM {_DECLARED[table][0]}"


@query("constraint_keys", " UNION ALL ".join(
    f"SELECT '{t}({', '.join(k)})' AS rule, count(*) AS violations FROM (SELECT {', '.join(k)} FROM {_DECLARED[t][0]} "
    f"WHERE ({' || '.join(k)}) IS NOT NULL GROUP BY ALL HAVING count(*) > 1)"
    for t, keys in constraints.KEYS.items() for k in keys))
def _constraint_keys(r: Roles) -> DataFrame:
    return constraints.audit_keys(_declared(r))


@query("constraint_references", " UNION ALL ".join(
    _broken(f"{t}.{c} -> {p}.{k}", f"{c} NOT IN (SELECT {k} FROM {_DECLARED[p][0]})", t) for t, c, p, k in constraints.REFERENCES))
def _constraint_references(r: Roles) -> DataFrame:
    return constraints.audit_references(_declared(r))


_ROW_RULES = " UNION ALL ".join([
    *[_broken(f"{t}.{c} in codes", f"NOT list_contains({list(codes)}, {c})", t) for (t, c), codes in constraints.CODES.items()],
    *[_broken(f"{t}.{c} in bounds", f"{c} < {low} OR {c} > {'1e18' if high is None else high}", t)
      for (t, c), (low, high) in constraints.BOUNDS.items()],
    _broken("inventory stock adds up", "on_hand_qty <> reserved_qty + available_qty", "inventory"),
    _broken("relationships no self edge", "source_product_id = related_product_id", "relationships"),
])


@query("load_audited", _ROW_RULES + "".join(f" UNION ALL SELECT '{n} rows', count(*) FROM {t}" for n, (t, _) in _DECLARED.items()))
def _load_audited(r: Roles) -> DataFrame:
    """All declared tables written once, with their row counts and broken rules counted on the way."""
    return constraints.load_audited(_declared(r), scratch_dir(r.spark, "load"))


@query("constraint_rows", _ROW_RULES)
def _constraint_rows(r: Roles) -> DataFrame:
    return constraints.audit_rows(_declared(r))


@query("dq_expected_volume", """
    SELECT *, row_count / per_count::DOUBLE AS ratio, row_count / per_count::DOUBLE BETWEEN low AND high AS within_band FROM (
        SELECT 'transaction_items' AS table_name, 'transactions' AS per_table, 1.5::DOUBLE AS low, 2.2::DOUBLE AS high, i AS row_count, t AS per_count FROM x_sizes
        UNION ALL SELECT 'returns', 'transaction_items', 0.05, 0.18, x, i FROM x_sizes
        UNION ALL SELECT 'customer_preferences', 'customers', 1.0, 1.0, p, c FROM x_sizes)""")
def _dq_expected_volume(r: Roles) -> DataFrame:
    return quality.expected_volume(_sales_tables(r))


@query("dq_amount_rollup", """
    SELECT t.transaction_id, net_c AS gross, CAST(0 AS BIGINT) AS discount, net_c AS net, coalesce(lg, 0) AS lines_gross,
           coalesce(ld, 0) AS lines_discount, coalesce(ln, 0) AS lines_net
    FROM r_transactions t LEFT JOIN (
        SELECT transaction_id, CAST(sum(quantity * price_c) AS BIGINT) AS lg, CAST(sum(disc_c) AS BIGINT) AS ld, CAST(sum(total_c) AS BIGINT) AS ln
        FROM r_items GROUP BY 1) l USING (transaction_id)
    WHERE net_c <> coalesce(lg, 0) OR coalesce(ld, 0) <> 0 OR net_c <> coalesce(ln, 0)""")
def _dq_amount_rollup(r: Roles) -> DataFrame:
    return quality.amount_rollup(r.transactions(), r.transaction_items())


@query("dq_line_totals", """
    SELECT transaction_item_id, quantity * price_c - disc_c AS expected_cents FROM r_items WHERE quantity * price_c - disc_c <> total_c""")
def _dq_line_totals(r: Roles) -> DataFrame:
    return quality.line_totals(r.transaction_items()).select("transaction_item_id", "expected_cents")


@query("conditional_sum", """
    SELECT store_id, CAST(sum(CASE WHEN available_qty = 0 THEN 1 ELSE 0 END) AS BIGINT) AS empty_skus FROM r_inventory GROUP BY 1""")
def _conditional_sum(r: Roles) -> DataFrame:
    return r.inventory().groupBy("store_id").agg(F.sum(F.when(F.col("available_qty") == 0, 1).otherwise(0)).alias("empty_skus"))


# Derived columns ---------------------------------------------------------------------


@query("calendar_dim", """
    SELECT CAST(d AS VARCHAR) AS calendar_date, CAST(month(d) AS INTEGER) AS month, dayname(d) AS day_of_week, isodow(d) >= 6 AS is_weekend,
           d = DATE '2025-11-28' AS is_black_friday, d = DATE '2025-12-01' AS is_cyber_monday
    FROM (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS d FROM (
        SELECT CAST(min(o_orderdate) AS DATE) AS lo, CAST(max(o_orderdate) AS DATE) AS hi FROM orders))""")
def _calendar(r: Roles) -> DataFrame:
    bounds = r.table("orders").agg(
        F.min("o_orderdate").cast("date").alias("start_date"), F.max("o_orderdate").cast("date").alias("end_date")
    )
    return derive.calendar_dim(bounds)


_SHIFTED = "CAST(o_orderdate AS DATE) + CAST(DATE '2025-12-31' - DATE '2001-08-01' AS INTEGER)"


def _orders_by_day(r: Roles) -> DataFrame:
    """Orders moved so that they end with the season."""
    day = F.date_add(F.col("o_orderdate").cast("date"), (date(2025, 12, 31) - date(2001, 8, 1)).days)
    return r.table("orders").select("o_orderkey", day.alias("day"))


@query("demand_weight", f"""
    SELECT o_orderkey, (CASE WHEN month(d) = 11 THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END) * (CASE WHEN month(d) = 12 THEN 1.65::DOUBLE ELSE 1.0::DOUBLE END)
         * (CASE WHEN d = DATE '2025-11-28' THEN 6.0::DOUBLE ELSE 1.0::DOUBLE END) * (CASE WHEN d = DATE '2025-12-01' THEN 4.0::DOUBLE ELSE 1.0::DOUBLE END)
         * (CASE WHEN isodow(d) >= 5 THEN 1.35::DOUBLE ELSE 1.0::DOUBLE END) AS weight
    FROM (SELECT o_orderkey, {_SHIFTED} AS d FROM orders)""")
def _demand_weight(r: Roles) -> DataFrame:
    return _orders_by_day(r).select("o_orderkey", derive.demand_weight(F.col("day")).alias("weight"))


@query("promo_multiplier", f"""
    SELECT o_orderkey, (CASE WHEN d IN (DATE '2025-11-28', DATE '2025-12-01') THEN 1.8 WHEN month(d) = 12 THEN 1.25 ELSE 1.0 END)::DOUBLE AS multiplier,
           least(0.52::DOUBLE, greatest(0.0::DOUBLE, o_orderkey % 100 / 100.0::DOUBLE - 0.1::DOUBLE)) AS rate
    FROM (SELECT o_orderkey, {_SHIFTED} AS d FROM orders)""")
def _promo(r: Roles) -> DataFrame:
    raw = (F.col("o_orderkey") % 100).cast("double") / F.lit(100.0) - F.lit(0.1)
    return _orders_by_day(r).select(
        "o_orderkey", derive.promo_multiplier(F.col("day")).alias("multiplier"), derive.promo_rate(raw).alias("rate")
    )


_RISKS = {"ECONOMY": "Tops", "SMALL": "Bottoms", "MEDIUM": "Footwear", "PROMO": "Beauty", "STANDARD": "Kids"}
_RISK_CASE = "CASE category " + " ".join(
    f"WHEN '{a}' THEN {derive.CATEGORY_RETURN_FACTOR[b]}::DOUBLE" for a, b in _RISKS.items()) + " END"


@query("return_risk", f"""
    SELECT transaction_item_id, CASE WHEN f IS NOT NULL THEN least(0.65::DOUBLE, 0.5::DOUBLE * f * ch) END AS risk FROM (
        SELECT transaction_item_id, {_RISK_CASE} AS f, (CASE sales_channel WHEN 'in_store' THEN 0.9 WHEN 'online' THEN 1.2 ELSE 1.1 END)::DOUBLE AS ch
        FROM r_items JOIN r_products USING (product_id) JOIN r_transactions USING (transaction_id))""")
def _return_risk(r: Roles) -> DataFrame:
    names = F.create_map(*[F.lit(x) for pair in _RISKS.items() for x in pair])
    joined = (
        r.transaction_items().select("transaction_item_id", "transaction_id", "product_id")
        .join(r.products().select("product_id", "category"), "product_id")
        .join(r.transactions().select("transaction_id", "sales_channel"), "transaction_id")
    )
    risk = derive.return_risk(0.5, F.try_element_at(names, F.col("category")), F.col("sales_channel"))
    return joined.select("transaction_item_id", risk.alias("risk"))


@query("line_pricing", f"""
    SELECT transaction_item_id, g AS gross_cents, d AS discount_cents, g - d AS total_cents FROM (
        SELECT transaction_item_id, quantity * price_c AS g, (2 * quantity * price_c * (transaction_id % 5200) + 10000) // 20000 AS d FROM r_items)""")
def _line_pricing(r: Roles) -> DataFrame:
    priced = derive.line_pricing(F.col("quantity"), F.col("unit_price"), F.col("transaction_id") % 5200)
    return r.transaction_items().withColumns(priced).select("transaction_item_id", *priced)


@query("email_handle", """
    SELECT customer_id, replace(lower(left(first_name, 1) || last_name || '&co'), '&', 'and') || customer_id || '@' || 'example.org' AS email
    FROM r_customers""")
def _email_handle(r: Roles) -> DataFrame:
    address = derive.email_handle(
        F.col("first_name"), F.concat("last_name", F.lit("&co")), F.col("customer_id"), F.lit("example.org")
    )
    return r.customers().select("customer_id", address.alias("email"))


@query("preferred_store", "SELECT customer_id, (customer_id * 7) % (SELECT count(*) FROM supplier) + 1 AS store_id FROM r_customers")
def _preferred_store(r: Roles) -> DataFrame:
    return r.customers().select(
        "customer_id", derive.preferred_store(F.col("customer_id"), r.store_count()).alias("store_id")
    )


_REGION_LIST = ", ".join(f"'{n}'" for n in derive.REGION_SLOTS)


@query("store_directory", f"""
    SELECT store_id, 'Store-' || CASE WHEN store_id < 1000 THEN lpad(CAST(store_id AS VARCHAR), 3, '0') ELSE CAST(store_id AS VARCHAR) END
           || ' (' || region || ') - ' || city || ', ' || street AS store_name, region FROM (
        SELECT store_id, CASE WHEN store_id = 56 THEN 'Northeast' ELSE reg END AS region,
               CASE WHEN store_id = 56 THEN 'Boston' ELSE {_slots(0)} END AS city,
               CASE WHEN store_id = 56 THEN 'Boylston Street' ELSE {_slots(2)} END AS street
        FROM (SELECT store_id, ([{_REGION_LIST}])[(store_id - 1) % 5 + 1] AS reg, (store_id - 1) % 6 AS slot
              FROM (SELECT store_id + 1 AS store_id FROM r_stores)))""")
def _store_directory(r: Roles) -> DataFrame:
    return derive.store_directory(r.stores().select((F.col("store_id") + 1).alias("store_id")))


@query("transfer_flag", "SELECT store_id, sku_id, on_hand_qty > 3 AS available_for_transfer FROM r_inventory")
def _transfer_flag(r: Roles) -> DataFrame:
    return r.inventory().select(
        "store_id", "sku_id", derive.transfer_flag(F.col("on_hand_qty")).alias("available_for_transfer")
    )


@query("self_reference_null", """
    SELECT source_product_id, related_product_id, nullif(b.style_id, a.style_id) AS substitute_style_id FROM r_relationships
    JOIN r_products a ON a.product_id = source_product_id JOIN r_products b ON b.product_id = related_product_id""")
def _self_reference(r: Roles) -> DataFrame:
    products = r.products()

    def style(role: str) -> DataFrame:
        return products.select(F.col("product_id").alias(f"{role}_product_id"), F.col("style_id").alias(f"{role}_style"))

    joined = r.relationships().join(style("source"), "source_product_id").join(style("related"), "related_product_id")
    other = derive.self_reference_null(F.col("source_style"), F.col("related_style"))
    return joined.select("source_product_id", "related_product_id", other.alias("substitute_style_id"))


@query("scalar_functions", f"""
    SELECT customer_id, coalesce(email, '') AS email_or_blank, least(preferred_store_id, 3) AS least_store,
           concat('c', email, '!') AS skip_null, 'c' || email || '!' AS keep_null, lpad(CAST(customer_id AS VARCHAR), 5, '0') AS padded,
           lower(tier) AS tier_lower, ([10, 20, 30])[customer_id % 3 + 1] AS picked, customer_id % 3 AS remainder,
           CAST(CAST(TIMESTAMP '2025-12-31 23:59:59' AS DATE) + CAST(customer_id % 40 AS INTEGER) AS VARCHAR) AS shifted_day
    FROM r_customers""")
def _scalars(r: Roles) -> DataFrame:
    key = F.col("customer_id")
    return r.customers().select(
        "customer_id", F.coalesce("email", F.lit("")).alias("email_or_blank"),
        F.least("preferred_store_id", F.lit(3)).alias("least_store"),
        text.concat_skip_null(F.lit("c"), F.col("email"), F.lit("!")).alias("skip_null"),
        F.concat(F.lit("c"), "email", F.lit("!")).alias("keep_null"), text.padded(key, 5).alias("padded"),
        F.lower("tier").alias("tier_lower"),
        F.element_at(F.array(F.lit(10), F.lit(20), F.lit(30)), (key % 3 + 1).cast("int")).alias("picked"),
        (key % 3).alias("remainder"),
        F.date_add(F.expr("TIMESTAMP '2025-12-31 23:59:59'").cast("date"), (key % 40).cast("int")).alias("shifted_day"),
    )


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """The planning report."""
    return QUERIES["planning_recommendations"](spark, folder)
