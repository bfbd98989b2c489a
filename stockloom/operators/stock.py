"""Stock by product and store, related products, imbalance between stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.operators.catalog import apply_filters
from stockloom.plans.topk import bounded, first_rows, top_k

RELATION_TYPES = ("alternative", "complementary")
_STORE_COLUMNS = ("store_name", "city", "state", "region", "store_type")
_STOCK_COLUMNS = ("on_hand_qty", "reserved_qty", "available_qty", "in_transit_qty", "last_updated")


def total_inventory(inventory: DataFrame) -> DataFrame:
    """Units available over all stores, per SKU."""
    return inventory.groupBy("sku_id").agg(F.sum("available_qty").cast("int").alias("total_available_qty"))


def style_inventory(inventory: DataFrame, products: DataFrame) -> DataFrame:
    """Units available per store and style."""
    styled = inventory.select("store_id", "sku_id", "available_qty").join(products.select("sku_id", "style_id"), "sku_id")
    return styled.groupBy("store_id", "style_id").agg(F.sum("available_qty").cast("int").alias("style_available_qty"))


def stock_by_store(inventory: DataFrame, stores: DataFrame) -> DataFrame:
    """Inventory rows with the attributes of their store."""
    return inventory.join(stores.select("store_id", *_STORE_COLUMNS), "store_id")


def inventory_order() -> list[Column]:
    return [
        F.col("product_id").asc_nulls_last(), F.col("available_qty").desc_nulls_last(),
        F.col("in_transit_qty").desc_nulls_last(), F.col("store_id").asc_nulls_last(),
    ]


def inventory_for_products(
    inventory: DataFrame, stores: DataFrame, products: DataFrame, ids: DataFrame | None = None,
    store_id: int | None = None, ordered: bool = True,
) -> DataFrame:
    """Stock of the asked products in every store, or in one store.

    ``ids`` holds ``product_id``; without it every product is reported. Products are cut to
    the asked ones first, so the inventory meets a short list. ``ordered=False`` spares the
    global sort of a result that goes to a table.
    """
    asked = products.select("product_id", "sku_id")
    if ids is not None:
        asked = asked.join(ids.select("product_id").distinct(), "product_id", "left_semi")
    kept = apply_filters(inventory, store_id=store_id)
    rows = stock_by_store(kept.join(asked, "sku_id"), stores)
    columns = ["product_id", "store_id", *_STORE_COLUMNS, "sku_id", *_STOCK_COLUMNS]
    report = rows.select(*columns)
    return report.orderBy(*inventory_order()) if ordered else report


def type_rank(relation_type: Column) -> Column:
    """Alternatives sort before every other relation."""
    return F.when(relation_type == "alternative", 0).otherwise(1)


def related(
    relationships: DataFrame, products: DataFrame, inventory: DataFrame, ids: DataFrame | None = None,
    relation_type: str | None = None, origin_store: int | None = None, limit: int = 10,
) -> DataFrame:
    """Related products of every asked product with stock at the origin store and in total."""
    bounded("limit", limit, 50)
    if relation_type is not None and relation_type not in RELATION_TYPES:
        raise ValueError(f"relation_type must be one of {RELATION_TYPES}")
    edges = apply_filters(relationships, relationship_type=relation_type)
    if ids is not None:
        known = products.select("product_id").join(ids.select("product_id").distinct(), "product_id", "left_semi")
        edges = edges.join(known.withColumnRenamed("product_id", "source_product_id"), "source_product_id", "left_semi")
    target = products.select(
        F.col("product_id").alias("related_product_id"), F.col("sku_id").alias("related_sku_id"),
        F.col("product_name").alias("related_product_name"), F.col("category").alias("related_category"),
        F.col("color").alias("related_color"), F.col("size").alias("related_size"),
        F.col("msrp").cast("double").alias("related_msrp"), F.col("image_url").alias("related_image_url"),
    )
    # One pass over the stock gives both figures per SKU. A store holds a SKU once, so the
    # sum over the origin store is that row's quantity, and NULL where it has no row.
    at_origin = F.lit(None).cast("int") if origin_store is None else F.when(
        F.col("store_id") == origin_store, F.col("available_qty")
    )
    held = inventory
    if ids is not None:
        asked_skus = edges.select("related_product_id").join(target, "related_product_id")
        held = held.join(asked_skus.select(F.col("related_sku_id").alias("sku_id")).distinct(), "sku_id", "left_semi")
    stock = held.groupBy(F.col("sku_id").alias("related_sku_id")).agg(
        F.sum(at_origin).cast("int").alias("related_available_qty_in_origin_store"),
        F.sum("available_qty").cast("int").alias("total_qty"),
    )
    rows = (
        edges.join(target, "related_product_id")
        .join(stock, "related_sku_id", "left")
        .withColumn("related_total_available_qty", F.coalesce("total_qty", F.lit(0)))
    )
    order = [
        type_rank(F.col("relationship_type")),
        F.coalesce("related_available_qty_in_origin_store", F.lit(0)).desc(),
        F.col("related_total_available_qty").desc(),
        F.col("related_product_id"),
        F.col("relationship_type"),
    ]
    return top_k(rows, ["source_product_id"], order, limit).select(
        "source_product_id", "related_product_id", "relationship_type", "relationship_reason", "related_sku_id",
        "related_product_name", "related_category", "related_color", "related_size", "related_msrp",
        "related_image_url", "related_available_qty_in_origin_store", "related_total_available_qty", "rank",
    )


def imbalance(
    inventory: DataFrame, stores: DataFrame, products: DataFrame, category: str | None = None, limit: int = 25
) -> DataFrame:
    """The largest surpluses of SKUs that some other store has run out of.

    The report lists pairs of an empty store and a stocked store, largest surplus first. The
    pairs of a SKU grow with the square of its stores, so they are never listed in full:

    1. One aggregation finds, per SKU, its largest quantity and whether a store is empty. A
       SKU with both has at least one pair, so the first ``limit`` SKUs by (largest
       quantity, style, SKU) hold every pair of the report.
    2. Within those SKUs only the first ``limit`` empty stores and the first ``limit``
       stocked stores can be part of the first ``limit`` pairs.
    """
    bounded("limit", limit, 100)
    slim, open_stores = inventory.select("store_id", "sku_id", "available_qty"), stores.select("store_id")
    catalogue = apply_filters(products.select("sku_id", "style_id", "product_name", "category"), category=category)
    qty = F.col("available_qty")
    per_sku = (
        slim.join(open_stores, "store_id", "left_semi").groupBy("sku_id")
        .agg(F.max(qty).alias("largest"), F.max(F.when(qty == 0, 1).otherwise(0)).alias("short"))
        .where((F.col("short") == 1) & (F.col("largest") > 0))
    )
    heads = (
        per_sku.join(catalogue, "sku_id")
        .orderBy(F.col("largest").desc(), "style_id", "sku_id")
        .limit(limit)
        .drop("largest", "short")
    )
    # At most `limit` rows, hence safe to broadcast.
    rows = slim.where(qty >= 0).join(F.broadcast(heads), "sku_id").join(open_stores, "store_id", "left_semi")
    # Quantities sort descending; empty stores all tie at zero, so each side orders by store.
    sides = top_k(
        rows.withColumn("side", F.when(qty == 0, "short").otherwise("surplus")),
        ["sku_id", "side"], [qty.desc(), F.col("store_id")], limit,
    )
    store = F.struct("store_id", "available_qty")
    by_sku = sides.groupBy("sku_id", "style_id", "product_name", "category").agg(
        F.collect_list(F.when(F.col("side") == "short", store)).alias("shorts"),
        F.collect_list(F.when(F.col("side") == "surplus", store)).alias("surpluses"),
    )
    pairs = (
        by_sku.withColumn("short", F.explode("shorts"))
        .withColumn("surplus", F.explode("surpluses"))
        .select(
            "sku_id", "style_id", "product_name", "category",
            F.col("short.store_id").alias("shortage_store_id"),
            F.col("short.available_qty").alias("shortage_available_qty"),
            F.col("surplus.store_id").alias("surplus_store_id"),
            F.col("surplus.available_qty").alias("surplus_available_qty"),
        )
    )
    order = [
        F.col("surplus_available_qty").desc(), F.col("style_id"), F.col("sku_id"),
        F.col("shortage_store_id"), F.col("surplus_store_id"),
    ]
    report = first_rows(pairs, order, limit)
    named = F.broadcast(report)
    for role in ("shortage", "surplus"):
        names = stores.select(
            F.col("store_id").alias(f"{role}_store_id"), F.col("store_name").alias(f"{role}_store_name")
        )
        named = F.broadcast(names.join(named, f"{role}_store_id"))
    return named.select(
        "sku_id", "style_id", "product_name", "category", "shortage_store_id", "shortage_store_name",
        "shortage_available_qty", "surplus_store_id", "surplus_store_name", "surplus_available_qty",
    ).orderBy(*order)
