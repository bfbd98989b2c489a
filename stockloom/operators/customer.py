"""Customer profiles: recent purchases, saved items, returns and the joined view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockloom.functions.money import cents, from_cents, half_up
from stockloom.plans.ranking import ordered_positions
from stockloom.plans.topk import top_k
from stockloom.sources.buckets import BUCKETS, BucketTable

# The columns of the profile.
PROFILE_COLUMNS = (
    "customer_id", "loyalty_id", "email", "first_name", "last_name", "tier", "preferred_store_id",
    "preferred_sizes", "preferred_colors", "preferred_brands", "shopping_occasions", "recent_purchases",
    "saved_items", "return_history_summary", "stylist_notes", "lifetime_value_band",
)
DEFAULT_PAGE = 10_000


def recent_purchases(transactions: DataFrame, k: int = 5) -> DataFrame:
    """Last purchase time and the ``k`` most recent transactions of each customer.

    Rows are cut to ``k`` per customer before they are gathered. Rank 1 is always kept, so
    the latest time survives the cut.
    """
    slim = transactions.select("customer_id", "transaction_id", "transaction_ts", "net_amount")
    order = [F.col("transaction_ts").desc_nulls_last(), F.col("transaction_id").desc()]
    recent = top_k(slim, ["customer_id"], order, k)
    gathered = recent.groupBy("customer_id").agg(
        F.max("transaction_ts").alias("last_purchase_ts"),
        F.sort_array(F.collect_list(F.struct("transaction_ts", "transaction_id", "net_amount")), asc=False).alias("p"),
    )
    listed = F.transform("p", lambda p: F.struct(p["transaction_id"], p["transaction_ts"], p["net_amount"]))
    return gathered.select("customer_id", "last_purchase_ts", listed.alias("recent_purchases"))


_SAVED_FIELDS = ("product_id", "saved_at", "product_name", "category", "color", "size_code")


def saved_items_summary(saved: DataFrame, products: DataFrame, page_size: int = DEFAULT_PAGE) -> DataFrame:
    """Number and ordered list of the saved items of each customer, newest first.

    The key is ``(customer_id, saved_items_page)``: page 1 has the newest ``page_size`` items, page 2 the next, and so
    on, each with the count of all. The page size is a matter of layout that keeps a row to a
    bounded length; no item is left out. Items are placed by range, so a customer of any size
    spreads over many tasks.
    """
    return pages_of(with_attributes(saved, products), page_size)


def with_attributes(saved: DataFrame, products: DataFrame) -> DataFrame:
    """Saved items with the attributes of their product; items of unknown products are left out."""
    attributes = products.select("product_id", "product_name", "category", "color", "size_code")
    items = saved.select("saved_item_id", "customer_id", "product_id", "saved_at").join(attributes, "product_id")
    return items.select("saved_item_id", "customer_id", *_SAVED_FIELDS)


def pages_of(items: DataFrame, page_size: int = DEFAULT_PAGE) -> DataFrame:
    """Saved items with their attributes as numbered pages per customer."""
    order = [F.col("saved_at").desc(), F.col("saved_item_id").desc()]
    placed = ordered_positions(items, ["customer_id"], order, "position")
    page = (F.call_function("div", F.col("position") - 1, F.lit(page_size)) + 1).cast("int")
    pages = _gather(placed.withColumn("saved_items_page", page), ["customer_id", "saved_items_page"])
    totals = placed.groupBy("customer_id").agg(F.count(F.lit(1)).alias("saved_item_count"))
    return pages.drop("saved_item_count").join(totals, "customer_id").select(
        "customer_id", "saved_items_page", "saved_item_count", "saved_items"
    )


def _gather(items: DataFrame, keys: list[str]) -> DataFrame:
    entry = F.struct("saved_at", "saved_item_id", *[f for f in _SAVED_FIELDS if f != "saved_at"])
    listed = items.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("saved_item_count"), F.sort_array(F.collect_list(entry), asc=False).alias("s")
    )
    return listed.select(
        *keys, "saved_item_count",
        F.transform("s", lambda s: F.struct(*[s[f].alias(f) for f in _SAVED_FIELDS])).alias("saved_items"),
    )


def return_history(returns: DataFrame) -> DataFrame:
    """Count, mean and total refund and the most frequent reason per customer.

    Tied reasons resolve to the first in text order. Money is summed in cents.
    """
    return _history_of(return_counts(returns))


def return_counts(returns: DataFrame) -> DataFrame:
    """Returns, refunds and cents per customer and reason: sums that can be added to."""
    return returns.groupBy("customer_id", "reason_code").agg(
        F.count(F.lit(1)).alias("n"), F.sum(cents(F.col("refund_amount"))).alias("refund_cents"), F.count("refund_amount").alias("refunds")
    )


def _history_of(counts: DataFrame) -> DataFrame:
    """The return history from counts per reason."""
    # The largest count wins, then the first reason in text order; a missing reason is none.
    named = F.when(F.col("reason_code").isNotNull(), F.struct((-F.col("n")).alias("fewer"), "reason_code"))
    totals = counts.groupBy("customer_id").agg(
        F.sum("n").alias("total_returns"), F.sum("refund_cents").alias("refund_cents"), F.sum("refunds").alias("refunds"),
        F.min(named).alias("top"),
    )
    amounts = totals.select(
        "customer_id", "total_returns",
        from_cents(half_up(F.col("refund_cents"), F.col("refunds"))).alias("avg_refund_amount"),
        from_cents(F.col("refund_cents"), 20).alias("total_refund_amount"),
        F.col("top.reason_code").alias("top_reason"),
    )
    summary = F.struct("total_returns", "avg_refund_amount", "total_refund_amount", "top_reason")
    return amounts.withColumn("return_history_summary", summary).drop("top_reason")


def customer_360(
    customers: DataFrame, preferences: DataFrame, recent: DataFrame, saved: DataFrame, history: DataFrame
) -> DataFrame:
    """One profile per customer from the three summaries and the preferences.

    Missing lists become empty and a missing return history becomes zeros. The key is
    ``(customer_id, saved_items_page)``, as in the saved items; page 1 is there for every customer, so
    whatever counts customers reads page 1.
    """
    joined = (
        customers.join(
            preferences.select(
                "customer_id", "preferred_sizes", "preferred_colors", "preferred_brands", "shopping_occasions"
            ),
            "customer_id", "left",
        )
        .join(recent.select("customer_id", "recent_purchases"), "customer_id", "left")
        .join(saved.select("customer_id", "saved_items_page", "saved_items"), "customer_id", "left")
        .join(history.select("customer_id", "return_history_summary"), "customer_id", "left")
    )

    def empty(column: str):
        return F.array().cast(joined.schema[column].dataType)

    nothing = F.struct(
        F.lit(0).cast("bigint").alias("total_returns"),
        F.lit(0).cast("decimal(12,2)").alias("avg_refund_amount"),
        F.lit(0).cast("decimal(20,2)").alias("total_refund_amount"),
        F.lit(None).cast("string").alias("top_reason"),
    )
    filled = joined.withColumns(
        {
            "recent_purchases": F.coalesce("recent_purchases", empty("recent_purchases")),
            "saved_items": F.coalesce("saved_items", empty("saved_items")),
            "saved_items_page": F.coalesce("saved_items_page", F.lit(1)),
            "return_history_summary": F.coalesce("return_history_summary", nothing),
        }
    )
    return filled.select(*PROFILE_COLUMNS, "saved_items_page")


def refresh(
    path: str, customers: DataFrame, preferences: DataFrame, transactions: DataFrame, saved: DataFrame,
    products: DataFrame, returns: DataFrame,
) -> DataFrame:
    """Writes the three summaries under ``path`` and returns the profile view over them."""
    spark = customers.sparkSession
    parts = {
        "customer_recent_purchases": recent_purchases(transactions),
        "customer_saved_items_summary": saved_items_summary(saved, products),
        "customer_return_history_summary": return_history(returns),
    }
    for name, df in parts.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    stored = [spark.read.parquet(f"{path}/{name}") for name in parts]
    return customer_360(customers, preferences, *stored)


class StoredProfiles:
    """The customer summaries as stored state that new rows are merged into.

    Three tables in customer buckets: the ``k`` latest purchases of a customer, the saved items with their product attributes,
    and the returns counted per reason. Each holds all that its summary needs, so a load of new rows rewrites the
    buckets of its customers and no others, and the result is that of a refresh over all rows.
    """

    def __init__(self, spark: SparkSession, path: str, k: int = 5, buckets: int = BUCKETS):
        self.spark, self.path, self.k, self.buckets = spark, path, k, buckets

    def _table(self, name: str, like: DataFrame) -> BucketTable:
        return BucketTable(self.spark, f"{self.path}/{name}", ["customer_id"], like.schema, self.buckets)

    def _heads(self, transactions: DataFrame) -> DataFrame:
        slim = transactions.select("customer_id", "transaction_id", "transaction_ts", "net_amount")
        return top_k(slim, ["customer_id"], [F.col("transaction_ts").desc_nulls_last(), F.col("transaction_id").desc()], self.k).drop("rank")

    def _counts(self, counts: DataFrame) -> DataFrame:
        return counts.groupBy("customer_id", "reason_code").agg(*[F.sum(c).alias(c) for c in ("n", "refund_cents", "refunds")])

    def load(self, transactions: DataFrame, saved: DataFrame, products: DataFrame, returns: DataFrame, batch: int) -> dict[str, list[int]]:
        """Merges a batch of new rows; returns the buckets written per table.

        Batches are numbered from 1, in order. One that was broken off is applied again and leaves out what it had done.
        """
        merges = {
            "purchases": (self._heads(transactions), lambda old, new: self._heads(old.unionByName(new))),
            "items": (with_attributes(saved, products), lambda old, new: old.unionByName(new)),
            "reasons": (return_counts(returns), lambda old, new: self._counts(old.unionByName(new))),
        }
        return {name: self._table(name, new).apply(new, batch, merge) for name, (new, merge) in merges.items()}

    def profiles(self, customers: DataFrame, preferences: DataFrame, like: tuple[DataFrame, DataFrame, DataFrame, DataFrame]) -> DataFrame:
        """The profile view over the stored state. ``like`` has transactions, saved items, products and returns, of which only the schemas matter."""
        transactions, saved, products, returns = like
        heads = self._table("purchases", self._heads(transactions)).read()
        items = self._table("items", with_attributes(saved, products)).read()
        reasons = self._table("reasons", return_counts(returns)).read()
        return customer_360(customers, preferences, recent_purchases(heads, self.k), pages_of(items), _history_of(reasons))
