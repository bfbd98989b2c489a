"""The declared constraints of all tables and one audit per kind.

``tables`` maps the names below to DataFrames; rules of tables that are not given are left out.
Every declared rule gives one row, also where nothing breaks it. As in a database, NULL passes
references, domains, bounds and row rules, and rows with a NULL in a key repeat nothing.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from stockloom.operators.quality import DOMAINS, count_repeated, no_self_edge, row_rules, stock_identity, union_rows

# Primary and unique keys per table.
KEYS = {
    "core_stores": [("store_id",)],
    "brands": [("brand_id",), ("brand_name",)],
    "core_products": [("product_id",), ("sku",)],
    "customers": [("customer_id",), ("loyalty_id",), ("email",)],
    "customer_preferences": [("customer_id",)],
    "saved_items": [("saved_item_id",)],
    "transactions": [("transaction_id",)],
    "transaction_items": [("transaction_item_id",)],
    "returns": [("return_id",)],
    "styles": [("style_id",)],
    "skus": [("sku",)],
    "sku_inventory": [("store_id", "sku")],
    "sales_summary": [("period", "sku")],
    "customer_profiles": [("customer_id",)],
    "style_relationships": [("from_style_id", "to_style_id", "relationship_type")],
    "source_orders": [("order_id",)],
    "source_order_items": [("order_item_id",)],
    "products": [("product_id",), ("sku_id",)],
    "stores": [("store_id",)],
    "inventory": [("store_id", "sku_id")],
    "relationships": [("source_product_id", "related_product_id", "relationship_type")],
    "orders": [("order_id",)],
    "order_lines": [("order_id", "sku_id")],
    "weekly_performance": [("week_start_date", "store_id", "style_id")],
}

# References as (table, column, parent table, parent column).
REFERENCES = [
    ("core_products", "brand_id", "brands", "brand_id"),
    ("customers", "preferred_store_id", "core_stores", "store_id"),
    ("customer_preferences", "customer_id", "customers", "customer_id"),
    ("saved_items", "customer_id", "customers", "customer_id"),
    ("saved_items", "product_id", "core_products", "product_id"),
    ("transactions", "customer_id", "customers", "customer_id"),
    ("transactions", "store_id", "core_stores", "store_id"),
    ("transaction_items", "transaction_id", "transactions", "transaction_id"),
    ("transaction_items", "product_id", "core_products", "product_id"),
    ("returns", "transaction_item_id", "transaction_items", "transaction_item_id"),
    ("returns", "customer_id", "customers", "customer_id"),
    ("skus", "style_id", "styles", "style_id"),
    ("skus", "substitute_style_id", "styles", "style_id"),
    ("skus", "trade_up_style_id", "styles", "style_id"),
    ("sku_inventory", "sku", "skus", "sku"),
    ("sales_summary", "sku", "skus", "sku"),
    ("sales_summary", "style_id", "styles", "style_id"),
    ("style_relationships", "from_style_id", "styles", "style_id"),
    ("style_relationships", "to_style_id", "styles", "style_id"),
    ("source_orders", "customer_id", "customers", "customer_id"),
    ("source_orders", "store_id", "core_stores", "store_id"),
    ("source_order_items", "order_id", "source_orders", "order_id"),
    ("source_order_items", "sku", "skus", "sku"),
    ("inventory", "store_id", "stores", "store_id"),
    ("inventory", "sku_id", "products", "sku_id"),
    ("relationships", "source_product_id", "products", "product_id"),
    ("relationships", "related_product_id", "products", "product_id"),
    ("orders", "fulfillment_store_id", "stores", "store_id"),
    ("orders", "destination_store_id", "stores", "store_id"),
    ("order_lines", "order_id", "orders", "order_id"),
    ("order_lines", "sku_id", "products", "sku_id"),
    ("weekly_performance", "store_id", "stores", "store_id"),
]

# Allowed codes per table and column.
CODES = {
    ("customers", "tier"): DOMAINS["tier"],
    ("customers", "lifetime_value_band"): DOMAINS["lifetime_value_band"],
    ("transactions", "sales_channel"): DOMAINS["sales_channel"],
    ("transactions", "payment_method"): DOMAINS["payment_method"],
    ("returns", "reason_code"): DOMAINS["reason_code"],
    ("styles", "core_vs_fashion"): DOMAINS["core_vs_fashion"],
    ("styles", "strategic_priority"): DOMAINS["strategic_priority"],
    ("customer_profiles", "tier"): DOMAINS["tier"],
    ("style_relationships", "relationship_type"): ("cross_sell",),
    ("source_orders", "order_status"): ("pending", "placed", "fulfilled", "cancelled"),
    ("products", "status"): DOMAINS["status"],
    ("relationships", "relationship_type"): DOMAINS["relationship_type"],
    ("orders", "order_status"): DOMAINS["order_status"],
    ("orders", "shipping_method"): DOMAINS["shipping_method"],
}

# Least and largest value per table and column; None leaves a side open.
BOUNDS = {
    ("transaction_items", "quantity"): (1, None),
    ("style_relationships", "priority_rank"): (1, None),
    ("source_order_items", "quantity"): (1, None),
    ("source_order_items", "unit_price"): (0, None),
    ("inventory", "on_hand_qty"): (0, None),
    ("inventory", "reserved_qty"): (0, None),
    ("inventory", "available_qty"): (0, None),
    ("inventory", "in_transit_qty"): (0, None),
    ("orders", "estimated_delivery_days"): (0, None),
    ("order_lines", "quantity"): (1, None),
    ("order_lines", "unit_price"): (0, None),
    ("weekly_performance", "units_sold"): (0, None),
    ("weekly_performance", "net_sales"): (0, None),
    ("weekly_performance", "markdown_rate"): (0, 100),
    ("weekly_performance", "sell_through_pct"): (0, 100),
    ("weekly_performance", "weeks_of_supply"): (0, None),
}


LOADS = 4  # tables written at a time


def audit_keys(tables: dict[str, DataFrame]) -> DataFrame:
    """Per declared key the number of its values that occur more than once: ``rule, violations``."""
    parts = []
    for table, keys in KEYS.items():
        for key in keys if table in tables else ():
            repeated = count_repeated(tables[table].dropna("any", subset=list(key)), list(key), "violations")
            parts.append(repeated.select(F.lit(f"{table}({', '.join(key)})").alias("rule"), "violations"))
    return union_rows(parts)


def audit_references(tables: dict[str, DataFrame]) -> DataFrame:
    """Per declared reference the number of rows whose parent is missing: ``rule, violations``.

    Rows are counted per key before the join, so a hot key meets its parent as one row; a parent
    that is there twice counts once.
    """
    parts = []
    for table, column, parent, parent_column in REFERENCES:
        if table in tables and parent in tables:
            carried = tables[table].where(F.col(column).isNotNull()).groupBy(F.col(column).alias("key")).agg(
                F.count(F.lit(1)).alias("n")
            )
            known = tables[parent].select(F.col(parent_column).alias("key"))
            lost = carried.join(known, "key", "left_anti").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations"))
            parts.append(lost.select(F.lit(f"{table}.{column} -> {parent}.{parent_column}").alias("rule"), "violations"))
    return union_rows(parts)


def _within(column: str, low: int | None, high: int | None) -> Column:
    value = F.col(column)
    above = value >= low if low is not None else F.lit(True)
    return above & (value <= high) if high is not None else above


def declared_rules() -> dict[str, dict[str, Column]]:
    """Per table its declared domains, bounds and row rules by name."""
    rules: dict[str, dict[str, Column]] = {}
    for (table, column), codes in CODES.items():
        rules.setdefault(table, {})[f"{table}.{column} in codes"] = F.col(column).isin(*codes)
    for (table, column), (low, high) in BOUNDS.items():
        rules.setdefault(table, {})[f"{table}.{column} in bounds"] = _within(column, low, high)
    rules["inventory"]["inventory stock adds up"] = stock_identity()
    rules["relationships"]["relationships no self edge"] = no_self_edge()
    return rules


def audit_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows that break a declared domain, bound or row rule, in one pass per table: ``rule, violations``."""
    return union_rows([row_rules(tables[t], checks, "rule") for t, checks in declared_rules().items() if t in tables])


def load_audited(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Writes tables as Parquet under ``path`` and audits their rows while they are written: ``rule, violations``.

    The counts ride on the write as observed metrics, so neither a table's source nor its files are read again: the
    rules of :func:`audit_rows` and, per table, its rows as the rule ``<table> rows``. What is written does not depend
    on the findings. A few tables are written at a time: cores that one table's last tasks leave idle work on the next.
    """
    spark, declared = next(iter(tables.values())).sparkSession, declared_rules()

    def load(name: str) -> list[tuple[str, int]]:
        checks = declared.get(name, {})
        metrics = [F.count(F.when(~cond, 1)).alias(f"c{i}") for i, cond in enumerate(checks.values())]
        seen = Observation(f"load-{name}")
        tables[name].observe(seen, F.count(F.lit(1)).alias("rows"), *metrics).write.mode("overwrite").parquet(f"{path}/{name}")
        counts = seen.get
        return [(f"{name} rows", counts["rows"]), *[(rule, counts[f"c{i}"]) for i, rule in enumerate(checks)]]

    with ThreadPoolExecutor(LOADS) as pool:
        loads = [pool.submit(inheritable_thread_target(spark)(load), name) for name in tables]
    found = [row for done in loads for row in done.result()]
    return spark.createDataFrame(found, "rule string, violations bigint")
