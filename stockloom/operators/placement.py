"""Placing a batch of orders against an inventory snapshot.

Requests come as two tables:

* headers ``order_id, seq, customer_id, destination_store_id, ship_to_city, shipping_method,
  fulfillment_store_id``, where ``seq`` is the order of arrival and unique;
* items ``order_id, line_no, sku_id, quantity``, where the smallest ``line_no`` is the first item.

Within a batch every order is routed and filled from the stock that the accepted orders before it left
over, and a rejected order takes nothing. :func:`route` and the checks look at one order at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.operators.settlement import REPLAY_ROWS, order_lines, settle_lines
from stockloom.session import scratch_dir, written

# Shipping methods and the largest quantity of one item.
SHIPPING_METHODS = ("standard", "expedited", "overnight", "store_pickup")
MAX_QUANTITY = 10


@dataclass(frozen=True)
class Placement:
    """Outcome of a batch: accepted orders and lines, units taken per position, the new inventory, rejected orders."""

    orders: DataFrame
    lines: DataFrame
    taken: DataFrame
    inventory: DataFrame
    rejects: DataFrame


def best_stores(inventory: DataFrame) -> DataFrame:
    """Per SKU the store with most units available, the lowest number among equals.

    The best store that can serve a quantity is the best store overall, if it can serve it,
    so one row per SKU answers every request.
    """
    best = F.max(F.struct(F.col("available_qty").alias("qty"), (-F.col("store_id")).alias("neg"))).alias("best")
    return inventory.groupBy("sku_id").agg(best).select(
        "sku_id", (-F.col("best.neg")).alias("best_store_id"), F.col("best.qty").alias("best_qty")
    )


def order_content(items: DataFrame) -> DataFrame:
    """Per order its first item, the copies of its most repeated SKU and whether a quantity is off.

    Lines are dealt by order once: both aggregations stay in their tasks.
    """
    per_sku = items.repartition("order_id").groupBy("order_id", "sku_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.when(F.col("quantity").between(1, MAX_QUANTITY), 0).otherwise(1)).alias("bad"),
        F.min(F.struct("line_no", "sku_id", "quantity")).alias("head"),
    )
    first = per_sku.groupBy("order_id").agg(
        F.max("n").alias("copies"), F.max("bad").alias("bad_quantity"), F.min("head").alias("head")
    )
    return first.select(
        "order_id", "copies", "bad_quantity", F.col("head.sku_id").alias("first_sku"),
        F.col("head.quantity").alias("first_quantity"),
    )


def first_items(items: DataFrame) -> DataFrame:
    """Per order its first item, in one aggregation: nothing is grouped by SKU."""
    first = items.groupBy("order_id").agg(F.min(F.struct("line_no", "sku_id", "quantity")).alias("head"))
    return first.select("order_id", F.col("head.sku_id").alias("first_sku"), F.col("head.quantity").alias("first_quantity"))


def with_store(requests: DataFrame, inventory: DataFrame) -> DataFrame:
    """Adds ``store_id``: the store asked for, else the best one for the first item."""
    best = best_stores(inventory).withColumnRenamed("sku_id", "first_sku")
    able = F.when(F.col("best_qty") >= F.col("first_quantity"), F.col("best_store_id"))
    return (
        requests.join(best, "first_sku", "left")
        .withColumn("store_id", F.coalesce("fulfillment_store_id", able))
        .drop("best_store_id", "best_qty")
    )


def route(headers: DataFrame, items: DataFrame, inventory: DataFrame) -> DataFrame:
    """Headers with ``store_id``, NULL where no store has enough of the first item."""
    routed = with_store(headers.join(first_items(items), "order_id", "left"), inventory)
    return routed.select(*headers.columns, "store_id")


def check_lines(routed: DataFrame, items: DataFrame, inventory: DataFrame) -> DataFrame:
    """Each item of a routed order with the store's units and whether they suffice."""
    lines = items.join(routed.select("order_id", "seq", "store_id"), "order_id")
    stock = inventory.select("store_id", "sku_id", "available_qty")
    return lines.join(stock, ["store_id", "sku_id"], "left").withColumn(
        "enough", F.coalesce(F.col("available_qty") >= F.col("quantity"), F.lit(False))
    )


def check_availability(routed: DataFrame, items: DataFrame, inventory: DataFrame) -> DataFrame:
    """Whether each order could be filled on its own: every item in stock at the store."""
    return check_lines(routed, items, inventory).groupBy("order_id").agg(
        F.count(F.lit(1)).alias("items"), F.min(F.col("enough").cast("int")).cast("boolean").alias("available")
    )


def delivery_days(method: Column, destination: Column, store: Column) -> Column:
    """Days until delivery; one when the order ships from its destination store."""
    by_method = F.when(method.isin("store_pickup", "overnight"), 1).when(method == "expedited", 2).otherwise(3)
    return F.when(destination == store, 1).otherwise(by_method)


def with_eta(routed: DataFrame, as_of: Column) -> DataFrame:
    """Adds delivery days and date, counted from the UTC date of ``as_of``."""
    days = delivery_days(F.col("shipping_method"), F.col("destination_store_id"), F.col("store_id"))
    return routed.withColumn("estimated_delivery_days", days).withColumn(
        "estimated_delivery_date", F.date_add(as_of.cast("date"), F.col("estimated_delivery_days"))
    )


def price_items(items: DataFrame, products: DataFrame) -> DataFrame:
    """Items with the current price of their SKU; NULL where the SKU is unknown."""
    prices = products.select("sku_id", F.col("msrp").alias("unit_price"))
    return items.join(prices, "sku_id", "left")


def reserved_units(accepted: DataFrame, as_of: Column) -> DataFrame:
    """``store_id, sku_id, quantity, stamp``: units taken of each position and the latest ``as_of``.

    Sums and latest times of parts are those of the whole, so the rows of several batches can be put together.
    """
    return accepted.groupBy("store_id", "sku_id").agg(F.sum("quantity").cast("int").alias("quantity"), F.max(as_of).alias("stamp"))


def apply_reservations(inventory: DataFrame, accepted: DataFrame, as_of: Column) -> DataFrame:
    """Inventory after reserving ``store_id, sku_id, quantity`` rows, stamped with the latest ``as_of`` of a position."""
    stamp = as_of.cast(inventory.schema["last_updated"].dataType)
    taken = reserved_units(accepted, stamp).withColumnRenamed("quantity", "taken")
    joined = inventory.join(taken, ["store_id", "sku_id"], "left")
    reserved = F.col("reserved_qty") + F.col("taken")
    changed = F.col("taken").isNotNull()
    return joined.select(
        "store_id", "sku_id", "on_hand_qty",
        F.when(changed, reserved).otherwise(F.col("reserved_qty")).alias("reserved_qty"),
        F.when(changed, F.col("on_hand_qty") - reserved).otherwise(F.col("available_qty")).alias("available_qty"),
        "in_transit_qty",
        F.when(changed, F.col("stamp")).otherwise(F.col("last_updated")).alias("last_updated"),
    )


def with_request_reason(headers: DataFrame, items: DataFrame, stores: DataFrame) -> DataFrame:
    """Headers with their content and the first rule they break in ``reason``, if any."""
    known = stores.select(F.col("store_id").alias("destination_store_id"), F.lit(1).alias("known"))
    checked = headers.join(order_content(items), "order_id", "left").join(known, "destination_store_id", "left")
    method = F.coalesce(F.col("shipping_method").isin(*SHIPPING_METHODS), F.lit(False))
    reason = (
        F.when(~method, "bad_shipping_method")
        .when(F.col("copies").isNull(), "no_items")
        .when(F.col("bad_quantity") == 1, "bad_quantity")
        .when(F.col("destination_store_id").isNull() & F.col("ship_to_city").isNull(), "no_destination")
        .when(F.col("destination_store_id").isNotNull() & F.col("known").isNull(), "unknown_store")
        .when(F.col("copies") > 1, "duplicate_sku")
    )
    return checked.withColumn("reason", reason).drop("known", "copies", "bad_quantity")


def request_rejects(headers: DataFrame, items: DataFrame, stores: DataFrame) -> DataFrame:
    """Orders that break a rule before stock is looked at."""
    checked = with_request_reason(headers, items, stores)
    return checked.select("order_id", "reason").where(F.col("reason").isNotNull())


def sold_lines(routed: DataFrame, items: DataFrame, inventory: DataFrame, products: DataFrame) -> DataFrame:
    """Checked lines that also tell whether the catalogue knows the SKU."""
    known = products.select("sku_id", F.lit(True).alias("sold"))
    checked = check_lines(routed, items, inventory).join(known, "sku_id", "left")
    return checked.withColumn("sold", F.coalesce("sold", F.lit(False)))


def stock_reasons(routed: DataFrame, lines: DataFrame) -> DataFrame:
    content = lines.groupBy("order_id").agg(
        F.bool_and("enough").alias("enough"), F.bool_and("sold").alias("sold")
    )
    reason = (
        F.when(F.col("store_id").isNull(), "cannot_fulfil")
        .when(~F.col("enough"), "insufficient")
        .when(~F.col("sold"), "unknown_sku")
    )
    joined = routed.select("order_id", "store_id").join(content, "order_id", "left")
    return joined.select("order_id", reason.alias("reason")).where(F.col("reason").isNotNull())


def stock_rejects(routed: DataFrame, items: DataFrame, inventory: DataFrame, products: DataFrame) -> DataFrame:
    """Orders the opening stock cannot fill, whatever the other orders take."""
    return stock_reasons(routed, sold_lines(routed, items, inventory, products))


def place_orders(
    headers: DataFrame, items: DataFrame, inventory: DataFrame, products: DataFrame, stores: DataFrame,
    as_of: Column, replay_rows: int = REPLAY_ROWS,
) -> Placement:
    """Routes, checks, prices and reserves a batch of orders in arrival order; each order is all or nothing.

    ``as_of`` is the time of placing, the same for all or a column of ``headers``: dates count from an
    order's own time, and a stock row carries the time of the last accepted order on it.
    """
    base = scratch_dir(headers.sparkSession, "placement")
    # Both tables are used several times below; written out, each input is read once.
    timed = headers.withColumn("__placed", as_of.cast("timestamp"))
    checked = with_request_reason(timed, items, stores).drop("first_sku", "first_quantity")
    checked = written(checked, f"{base}/checked")
    able = checked.where(F.col("reason").isNull()).drop("reason")
    prices = products.select("sku_id", F.col("msrp").alias("unit_price"), F.lit(True).alias("sold"))
    wanted = items.join(able.select("order_id"), "order_id", "left_semi").join(prices, "sku_id", "left")
    wanted = wanted.select("order_id", "line_no", "sku_id", "quantity", "unit_price", F.coalesce("sold", F.lit(False)).alias("sold"))
    lines = written(order_lines(able.select("order_id", "seq", "fulfillment_store_id"), wanted), f"{base}/lines")
    outcome = settle_lines(lines, inventory, replay_rows)
    won, lost = outcome.where(F.col("reason").isNull()), outcome.where(F.col("reason").isNotNull())
    taken = able.join(won.select("order_id", "store_id"), "order_id")
    orders = with_eta(taken, F.col("__placed")).select(
        "order_id", "customer_id", F.col("__placed").alias("order_date"), F.lit("placed").alias("order_status"),
        F.col("store_id").alias("fulfillment_store_id"), "destination_store_id", "ship_to_city", "shipping_method",
        "estimated_delivery_days", "estimated_delivery_date",
    )
    own = lines.where("copy = 1").select("order_id", "sku_id", "quantity", "unit_price")
    accepted = own.join(taken.select("order_id", "store_id", "__placed"), "order_id")
    sold = accepted.select("order_id", "sku_id", "quantity", "unit_price")
    rejects = checked.where(F.col("reason").isNotNull()).select("order_id", "reason").unionByName(lost.select("order_id", "reason"))
    units = reserved_units(accepted, F.col("__placed"))
    return Placement(orders, sold, units, apply_reservations(inventory, units, F.col("stamp")), rejects)


def split_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Headers and items of a table of requests.

    A request is either one row with ``items array<struct<sku_id, quantity>>`` or one row per
    item with ``line_no, sku_id, quantity``, which suits orders of any length.
    """
    if "items" in requests.columns:
        items = requests.select("order_id", F.posexplode("items").alias("line_no", "item")).select(
            "order_id", "line_no", "item.sku_id", "item.quantity"
        )
        return requests.drop("items"), items
    item = ["line_no", "sku_id", "quantity"]
    return requests.drop(*item).distinct(), requests.select("order_id", *item)
