"""Reports over placed orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom.functions.money import cents


def order_totals(lines: DataFrame) -> DataFrame:
    """Amount of each order, in cents."""
    return lines.groupBy("order_id").agg(
        F.sum(F.col("quantity") * cents(F.col("unit_price"))).alias("total_cents")
    )


def order_summary(orders: DataFrame, stores: DataFrame, lines: DataFrame) -> DataFrame:
    """Order headers with both store names and the total amount.

    Lines are totalled per order before they meet the headers.
    """

    def names(role: str) -> DataFrame:
        return stores.select(F.col("store_id").alias(f"{role}_store_id"), F.col("store_name").alias(f"{role}_store_name"))

    joined = (
        orders.join(names("fulfillment"), "fulfillment_store_id")
        .join(names("destination"), "destination_store_id", "left")
        .join(order_totals(lines), "order_id", "left")
    )
    return joined.select(
        "order_id", "customer_id", "order_date", "order_status", "fulfillment_store_id", "fulfillment_store_name",
        "destination_store_id", "destination_store_name", "ship_to_city", "shipping_method",
        "estimated_delivery_days", "estimated_delivery_date",
        (F.coalesce("total_cents", F.lit(0)).cast("double") / F.lit(100.0)).alias("total_amount"),
    )


def order_lines(lines: DataFrame, ordered: bool = True) -> DataFrame:
    """Order lines with their total, in SKU order within each order.

    ``ordered=False`` spares the global sort of a result that goes to a table.
    """
    priced = lines.select(
        "order_id", "sku_id", "quantity", F.col("unit_price").cast("double").alias("unit_price"),
        (F.col("quantity") * F.col("unit_price")).cast("double").alias("line_total"),
    )
    return priced.orderBy("order_id", "sku_id") if ordered else priced
