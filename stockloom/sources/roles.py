"""Retail tables read out of a TPC-H-like star schema.

Each method gives one retail table. Everything is a projection, an equality join or an
aggregation with map-side combine over whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stockloom.functions.money import cents_of_double, from_cents, half_up
from stockloom.functions.text import padded


def _pick(number: Column, values: list[str]) -> Column:
    """The value at the remainder of a number."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values) + 1).cast("int"))


class Roles:
    """Retail tables over the parquet files of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # Dimensions -----------------------------------------------------------------

    def stores(self) -> DataFrame:
        nation, region = self.table("nation"), self.table("region")
        joined = (
            self.table("supplier")
            .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
            .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        )
        return joined.select(
            F.col("s_suppkey").cast("int").alias("store_id"), F.col("s_name").alias("store_name"),
            F.col("n_name").alias("city"), F.concat(F.lit("S"), F.col("n_nationkey").cast("string")).alias("state"),
            F.col("r_name").alias("region"),
            _pick(F.col("s_suppkey"), ["Flagship", "Urban", "Outlet"]).alias("store_type"),
        )

    def store_count(self) -> Column:
        return self.table("supplier").agg(F.count(F.lit(1))).scalar()

    def products(self) -> DataFrame:
        key, noun = padded(F.col("p_partkey"), 7), F.split("p_name", " ")
        msrp = cents_of_double(F.col("p_retailprice"))
        return self.table("part").select(
            F.concat(F.lit("PRD-"), key).alias("product_id"),
            F.concat("p_brand", F.lit("-"), "p_type").alias("style_id"),
            F.concat(F.lit("SKU-"), key).alias("sku_id"),
            F.col("p_name").alias("product_name"), F.col("p_type").alias("category"),
            noun[1].alias("subcategory"), F.col("p_brand").alias("brand"), noun[0].alias("color"),
            _pick(F.col("p_size"), ["XS", "S", "M", "L", "XL"]).alias("size"),
            F.lit("All Year").alias("season"),
            from_cents(msrp, 10).alias("msrp"),
            from_cents(half_up(msrp * 40, F.lit(100)), 10).alias("cost"),
            F.concat("p_name", F.lit(" by "), "p_brand").alias("description"),
            F.concat(F.lit("/img/"), key, F.lit(".jpg")).alias("image_url"),
            noun[1].alias("silhouette"),
            _pick(F.col("p_partkey"), ["Wedding Guest", "Day Event", "Work", "Travel"]).alias("occasion"),
            _pick(F.col("p_size"), ["Cotton", "Wool", "Linen"]).alias("material"),
            F.when(F.col("p_partkey") % 10 == 9, "inactive").otherwise("active").alias("status"),
        )

    def brands(self) -> DataFrame:
        """Brands by the number in their name."""
        number = F.regexp_extract("p_brand", "([0-9]+)$", 1).cast("int")
        return self.table("part").select(number.alias("brand_id"), F.col("p_brand").alias("brand_name")).distinct()

    def sale_products(self) -> DataFrame:
        """Products under the column names the sales tables use."""
        return self.products().select(
            "product_id", F.col("sku_id").alias("sku"), "product_name", "category", "color",
            F.col("size").alias("size_code"), F.col("msrp").alias("list_price"),
        )

    def customers(self) -> DataFrame:
        key, name, balance = F.col("c_custkey"), F.split("c_name", "#"), F.col("c_acctbal")
        tier = (
            F.when(F.col("c_mktsegment").isin("AUTOMOBILE", "BUILDING"), "Bronze")
            .when(F.col("c_mktsegment") == "FURNITURE", "Silver")
            .when(F.col("c_mktsegment") == "MACHINERY", "Gold")
            .otherwise("Platinum")
        )
        band = F.when(balance < 2000, "Low").when(balance < 5000, "Medium").when(balance < 8000, "High").otherwise("VIP")
        address = F.concat(F.lit("customer"), key.cast("string"), F.lit("@example.com"))
        return self.table("customer").select(
            key.alias("customer_id"), F.concat(F.lit("LOY-"), padded(key, 10)).alias("loyalty_id"),
            F.when(key % 7 != 0, address).alias("email"), name[0].alias("first_name"), name[1].alias("last_name"),
            tier.alias("tier"), ((key * 7) % self.store_count()).cast("int").alias("preferred_store_id"),
            F.concat(F.lit("Notes on "), F.col("c_name")).alias("stylist_notes"), band.alias("lifetime_value_band"),
        )

    def preferences(self) -> DataFrame:
        viewed = self.saved_items().join(
            self.products().select("product_id", "size", "color", "brand", "occasion"), "product_id"
        )
        known = self.table("customer").select(F.col("c_custkey").alias("customer_id"))

        def distinct(column: str, name: str) -> Column:
            return F.array_sort(F.collect_set(column)).alias(name)

        sets = viewed.groupBy("customer_id").agg(
            distinct("size", "preferred_sizes"), distinct("color", "preferred_colors"),
            distinct("brand", "preferred_brands"), distinct("occasion", "shopping_occasions"),
            F.max("saved_at").alias("updated_at"),
        )
        return sets.join(known, "customer_id", "left_semi")

    # Stock and planning -----------------------------------------------------------

    def inventory(self) -> DataFrame:
        qty = F.col("l_quantity").cast("int")

        def units(condition: Column | None = None) -> Column:
            value = qty if condition is None else F.when(condition, qty).otherwise(0)
            return F.sum(value).cast("int")

        stock = self.table("lineitem").groupBy("l_suppkey", "l_partkey").agg(
            units().alias("on_hand_qty"), units(F.col("l_linestatus") == "F").alias("reserved_qty"),
            units(F.col("l_linestatus") == "O").alias("available_qty"),
            units(F.col("l_returnflag") == "N").alias("in_transit_qty"),
            F.max("l_shipdate").alias("last_updated"),
        )
        return stock.select(
            F.col("l_suppkey").cast("int").alias("store_id"),
            F.concat(F.lit("SKU-"), padded(F.col("l_partkey"), 7)).alias("sku_id"),
            "on_hand_qty", "reserved_qty", "available_qty", "in_transit_qty", "last_updated",
        )

    def relationships(self) -> DataFrame:
        """The next three products of the catalogue; same brand gives an alternative."""
        part = self.table("part")
        source = part.select(
            "p_partkey", "p_brand", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("step")
        )
        target = part.select(F.col("p_partkey").alias("to_key"), F.col("p_brand").alias("to_brand"))
        edges = source.join(target, F.col("p_partkey") + F.col("step") == F.col("to_key"))
        kind = F.when(F.col("p_brand") == F.col("to_brand"), "alternative").otherwise("complementary")
        return edges.select(
            F.concat(F.lit("PRD-"), padded(F.col("p_partkey"), 7)).alias("source_product_id"),
            F.concat(F.lit("PRD-"), padded(F.col("to_key"), 7)).alias("related_product_id"),
            kind.alias("relationship_type"),
            F.concat("p_brand", F.lit(" with "), "to_brand").alias("relationship_reason"),
        )

    def weekly_performance(self) -> DataFrame:
        """Sales per week, store and style.

        Lines meet their product first and are summed per week after the map-side combine; the
        stock of a store and style is the sum over its weeks, so lines are read once.
        """
        gross = cents_of_double(F.col("l_extendedprice"))
        discount = half_up(gross * cents_of_double(F.col("l_discount")), F.lit(100))
        part = self.table("part").select(
            F.col("p_partkey").alias("l_partkey"), F.concat("p_brand", F.lit("-"), "p_type").alias("style_id"),
            half_up(cents_of_double(F.col("p_retailprice")) * 40, F.lit(100)).alias("cost"),
        )
        qty = F.col("l_quantity").cast("bigint")
        line = self.table("lineitem").join(part, "l_partkey").select(
            F.date_trunc("week", "l_shipdate").cast("date").alias("week_start_date"),
            F.col("l_suppkey").cast("int").alias("store_id"), "style_id", qty.alias("qty"), gross.alias("gross"),
            discount.alias("disc"), (qty * F.col("cost")).alias("spent"),
            F.when(F.col("l_linestatus") == "O", qty).otherwise(0).alias("av"),
        )
        weekly = line.groupBy("week_start_date", "store_id", "style_id").agg(
            *[F.sum(c).alias(c) for c in ("qty", "gross", "disc", "spent", "av")]
        )
        # A store and style has one row per week, a bounded window.
        full = weekly.withColumn("stock", F.sum("av").over(Window.partitionBy("store_id", "style_id")))
        units, net = F.col("qty"), F.col("gross") - F.col("disc")
        return full.select(
            "week_start_date", "store_id", "style_id", units.cast("int").alias("units_sold"),
            from_cents(net).alias("net_sales"), from_cents(net - F.col("spent")).alias("gross_margin"),
            from_cents(half_up(F.col("disc") * 10_000, F.col("gross")), 5).alias("markdown_rate"),
            from_cents(half_up(units * 10_000, units + F.col("stock")), 5).alias("sell_through_pct"),
            from_cents(half_up(F.col("stock") * 100, units), 10).alias("weeks_of_supply"),
        )

    # Sales ------------------------------------------------------------------------

    def transactions(self) -> DataFrame:
        amount = F.col("o_totalprice").cast("decimal(12,2)")
        return self.table("orders").select(
            F.col("o_orderkey").alias("transaction_id"), F.col("o_custkey").alias("customer_id"),
            ((F.col("o_custkey") * 7) % self.store_count()).cast("int").alias("store_id"),
            F.col("o_orderdate").alias("transaction_ts"),
            _pick(F.col("o_orderkey"), ["in_store", "online", "mobile"]).alias("sales_channel"),
            _pick(F.col("o_orderkey"), ["card", "cash", "wallet", "gift_card"]).alias("payment_method"),
            amount.alias("gross_amount"), F.lit(0).cast("decimal(12,2)").alias("discount_amount"),
            amount.alias("net_amount"),
        )

    def transaction_items(self) -> DataFrame:
        gross, qty = cents_of_double(F.col("l_extendedprice")), F.col("l_quantity").cast("bigint")
        discount = half_up(gross * cents_of_double(F.col("l_discount")), F.lit(100))
        return self.table("lineitem").select(
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("transaction_item_id"),
            F.col("l_orderkey").alias("transaction_id"),
            F.concat(F.lit("PRD-"), padded(F.col("l_partkey"), 7)).alias("product_id"),
            qty.cast("int").alias("quantity"), from_cents(half_up(gross, qty), 10).alias("unit_price"),
            from_cents(discount, 10).alias("discount_amount"), from_cents(gross - discount, 10).alias("line_total"),
        )

    def returns(self) -> DataFrame:
        reasons = [
            "size_issue", "quality_issue", "damaged_in_shipping", "late_delivery", "changed_mind", "wrong_item",
        ]
        gross = cents_of_double(F.col("l_extendedprice"))
        refund = gross - half_up(gross * cents_of_double(F.col("l_discount")), F.lit(100))
        item = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
        joined = self.table("lineitem").where(F.col("l_returnflag") == "R").join(
            self.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey"
        )
        return joined.select(
            item.alias("return_id"), item.alias("transaction_item_id"), F.col("o_custkey").alias("customer_id"),
            (F.col("l_shipdate") + F.expr("INTERVAL 7 DAYS")).alias("return_ts"),
            _pick(F.col("l_partkey") + F.col("l_suppkey"), reasons).alias("reason_code"),
            from_cents(refund, 10).alias("refund_amount"),
        )

    def saved_items(self) -> DataFrame:
        key = F.get_json_object("props", "$.k").cast("bigint")
        return self.table("events").where(F.col("event_type") == "view").select(
            F.col("event_id").alias("saved_item_id"), F.col("user_id").alias("customer_id"),
            F.concat(F.lit("PRD-"), padded(key, 7)).alias("product_id"), F.col("ts").alias("saved_at"),
        )

    # Orders -----------------------------------------------------------------------

    def orders(self) -> DataFrame:
        status = F.when(F.col("o_orderstatus") == "F", "delivered").when(
            F.col("o_orderstatus") == "O", "placed"
        ).otherwise("processing")
        days = F.when(F.col("o_orderkey") % 4 == 1, 2).when(F.col("o_orderkey") % 4 == 0, 3).otherwise(1)
        return self.table("orders").select(
            self._order_id(F.col("o_orderkey")), F.col("o_custkey").cast("string").alias("customer_id"),
            F.col("o_orderdate").alias("order_date"), status.alias("order_status"),
            ((F.col("o_custkey") * 3 + 1) % self.store_count()).cast("int").alias("fulfillment_store_id"),
            F.when(F.col("o_orderpriority") != "1-URGENT", ((F.col("o_custkey") * 7) % self.store_count()).cast("int"))
            .alias("destination_store_id"),
            F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("City-"), F.col("o_custkey").cast("string")))
            .alias("ship_to_city"),
            self._method(), days.alias("estimated_delivery_days"),
            F.date_add(F.col("o_orderdate").cast("date"), days).alias("estimated_delivery_date"),
        )

    @staticmethod
    def _order_id(key: Column) -> Column:
        return F.concat(F.lit("ORD-"), padded(key, 10)).alias("order_id")

    @staticmethod
    def _method() -> Column:
        return _pick(F.col("o_orderkey"), ["standard", "expedited", "overnight", "store_pickup"]).alias("shipping_method")

    def order_lines(self) -> DataFrame:
        gross, qty = cents_of_double(F.col("l_extendedprice")), F.col("l_quantity").cast("bigint")
        lines = self.table("lineitem").groupBy("l_orderkey", "l_partkey").agg(
            F.sum(qty).cast("int").alias("quantity"), F.max(half_up(gross, qty)).alias("price")
        )
        return lines.select(
            self._order_id(F.col("l_orderkey")),
            F.concat(F.lit("SKU-"), padded(F.col("l_partkey"), 7)).alias("sku_id"), "quantity",
            from_cents(F.col("price"), 10).alias("unit_price"),
        )

    def request_items(self) -> DataFrame:
        return self.table("lineitem").select(
            self._order_id(F.col("l_orderkey")),
            (F.col("l_linenumber").cast("bigint") * 1_000_000_000 + F.col("l_partkey")).alias("line_no"),
            F.concat(F.lit("SKU-"), padded(F.col("l_partkey"), 7)).alias("sku_id"),
            (F.col("l_quantity").cast("int") % 10 + 1).alias("quantity"),
        )

    def request_headers(self) -> DataFrame:
        """Requests; odd orders name the store of their first line, even ones leave it open.

        Urgent orders ship to a city. Pending ones of low priority name no destination, and
        those of unstated priority name a store that does not exist.
        """
        first = self.table("lineitem").groupBy("l_orderkey").agg(
            F.min(F.struct("l_linenumber", "l_partkey", "l_suppkey")).alias("first")
        )
        key, urgent = F.col("o_orderkey"), F.col("o_orderpriority") == "1-URGENT"
        pending = F.col("o_orderstatus") == "P"
        home = ((F.col("o_custkey") * 7) % self.store_count()).cast("int")
        destination = (
            F.when(urgent | (pending & (F.col("o_orderpriority") == "5-LOW")), F.lit(None).cast("int"))
            .when(pending & (F.col("o_orderpriority") == "4-NOT SPECIFIED"), F.lit(-1))
            .otherwise(home)
        )
        joined = self.table("orders").join(first, key == F.col("l_orderkey"))
        return joined.select(
            self._order_id(key), key.alias("seq"), F.col("o_custkey").cast("string").alias("customer_id"),
            destination.alias("destination_store_id"),
            F.when(urgent, F.concat(F.lit("City-"), F.col("o_custkey").cast("string"))).alias("ship_to_city"),
            self._method(),
            F.when(key % 2 == 1, F.col("first.l_suppkey").cast("int")).alias("fulfillment_store_id"),
        )

    # Styles and source orders -------------------------------------------------------

    def core_products(self) -> DataFrame:
        """Sale products with the number of their brand."""
        number = F.regexp_extract("brand", "([0-9]+)$", 1).cast("int")
        return self.products().select("product_id", F.col("sku_id").alias("sku"), number.alias("brand_id"))

    def styles(self) -> DataFrame:
        counted = self.products().groupBy("style_id").agg(F.count(F.lit(1)).alias("n"))
        return counted.select(
            "style_id", F.col("n").cast("int").alias("planned_cc_count"),
            _pick(F.col("n"), ["core", "fashion"]).alias("core_vs_fashion"),
            _pick(F.col("n"), ["maintain", "grow", "optimize"]).alias("strategic_priority"),
        )

    def skus(self) -> DataFrame:
        """Extra small sizes trade up to a style by noun that nobody sells."""
        trade_up = F.when(F.col("size") == "XL", F.col("style_id")).when(
            F.col("size") == "XS", F.concat("brand", F.lit("-"), "subcategory")
        )
        return self.products().select(
            F.col("sku_id").alias("sku"), "style_id", "size",
            F.when(F.col("status") == "inactive", F.col("style_id")).alias("substitute_style_id"),
            trade_up.alias("trade_up_style_id"),
        )

    def sku_inventory(self) -> DataFrame:
        return self.inventory().select("store_id", F.col("sku_id").alias("sku"), F.col("on_hand_qty").alias("on_hand_units"))

    def sales_summary(self) -> DataFrame:
        monthly = self.table("lineitem").groupBy(
            F.date_format("l_shipdate", "yyyy-MM").alias("period"), "l_partkey"
        ).agg(F.sum(F.col("l_quantity").cast("bigint")).cast("int").alias("units_sold"))
        sku = F.concat(F.lit("SKU-"), padded(F.col("l_partkey"), 7)).alias("sku")
        return monthly.select("period", sku, "units_sold").join(self.skus().select("sku", "style_id"), "sku")

    def style_relationships(self) -> DataFrame:
        """Styles of related products; pairs of one style repeat."""
        source = self.products().select(F.col("product_id").alias("source_product_id"), F.col("style_id").alias("from_style_id"))
        target = self.products().select(F.col("product_id").alias("related_product_id"), F.col("style_id").alias("to_style_id"))
        joined = self.relationships().join(source, "source_product_id").join(target, "related_product_id")
        kind = F.when(F.col("relationship_type") == "alternative", "alternative").otherwise("cross_sell")
        return joined.select(
            "from_style_id", "to_style_id", kind.alias("relationship_type"),
            (F.length("to_style_id") % 4).alias("priority_rank"),
        )

    def source_orders(self) -> DataFrame:
        status = F.when(F.col("o_orderstatus") == "F", "fulfilled").when(F.col("o_orderstatus") == "O", "placed")
        return self.table("orders").select(
            F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"),
            ((F.col("o_custkey") * 3) % (self.store_count() + 1)).cast("int").alias("store_id"),
            status.otherwise("processing").alias("order_status"),
        )

    def source_order_items(self) -> DataFrame:
        gross, qty = cents_of_double(F.col("l_extendedprice")), F.col("l_quantity").cast("bigint")
        return self.table("lineitem").select(
            F.concat_ws("-", "l_orderkey", "l_linenumber").alias("order_item_id"), F.col("l_orderkey").alias("order_id"),
            F.concat(F.lit("SKU-"), padded(F.col("l_partkey"), 7)).alias("sku"), qty.cast("int").alias("quantity"),
            from_cents(half_up(gross, qty), 10).alias("unit_price"),
        )

    # Search -----------------------------------------------------------------------

    def search_queries(self) -> DataFrame:
        """Queries made of the catalogue's own words, with and without filters."""
        part, nation = self.table("part"), self.table("nation")
        none = F.lit(None).cast("string")
        names = part.select("p_name").distinct()
        styles = part.select("p_brand", "p_type").distinct()
        types = part.select("p_type").distinct()
        word = F.split("p_name", " ")

        def ask(df: DataFrame, prefix: str, key: Column, q: Column, category: Column, occasion: Column) -> DataFrame:
            return df.select(
                F.concat(F.lit(prefix), key).alias("query_id"), q.alias("q"), category.alias("category"),
                occasion.alias("occasion"),
            )

        name, brand, kind = F.col("p_name"), F.col("p_brand"), F.col("p_type")
        parts = [
            ask(names, "name:", name, name, none, none),
            ask(names, "ask:", name,
                F.concat(F.lit("Looking for the "), word[1], F.lit(" in "), word[0], F.lit(", medium please")), none, none),
            ask(names, "like:", name, F.concat(F.substring(word[0], 1, 1), F.lit("_%"), word[1]), none, none),
            ask(styles, "style:", F.concat(brand, kind),
                F.concat(F.replace(F.lower(brand), F.lit("#"), F.lit(" ")), F.lit(" "), F.lower(kind), F.lit(" large")), none, none),
            ask(types, "in:", kind, F.lit("bolt"), kind, F.lit("Work")),
            ask(types, "type:", kind, none, kind, none),
            ask(types, "both:", kind, none, kind, F.lit("Travel")),
            ask(nation, "none:", F.col("n_name"), F.concat("n_name", F.lit(" zzzz")), none, none),
        ]
        result = parts[0]
        for p in parts[1:]:
            result = result.unionByName(p)
        return result
