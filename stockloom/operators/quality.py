"""Data-quality audits; each returns rows that describe what it found."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockloom.functions.money import cents

# Expected row-count ratios between tables (numerator, denominator, low, high).
VOLUME_BANDS = (
    ("transaction_items", "transactions", 1.5, 2.2),
    ("returns", "transaction_items", 0.05, 0.18),
    ("customer_preferences", "customers", 1.0, 1.0),
)

# Allowed codes per column.
DOMAINS = {
    "tier": ("Bronze", "Silver", "Gold", "Platinum"),
    "lifetime_value_band": ("Low", "Medium", "High", "VIP"),
    "sales_channel": ("in_store", "online", "mobile"),
    "payment_method": ("card", "cash", "wallet", "gift_card"),
    "reason_code": (
        "size_issue", "quality_issue", "damaged_in_shipping", "late_delivery", "changed_mind", "wrong_item",
    ),
    "status": ("active", "inactive"),
    "order_status": ("placed", "processing", "shipped", "delivered", "cancelled"),
    "shipping_method": ("standard", "expedited", "overnight", "store_pickup"),
    "relationship_type": ("alternative", "complementary"),
    "core_vs_fashion": ("core", "fashion"),
    "strategic_priority": ("maintain", "grow", "optimize"),
}


def union_rows(parts: list[DataFrame]) -> DataFrame:
    """All rows of tables that share their column names."""
    return reduce(DataFrame.unionByName, parts)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Number of rows per table."""
    return union_rows(
        [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table_name"), "row_count")
         for n, df in tables.items()]
    )


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def count_repeated(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """One row with the number of keys that occur more than once: a repeated key has exactly one second row.

    Rows are sorted, so a task holds no table of all its keys; of a hot key two rows leave a task.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*keys))
    second = df.select(*keys).withColumn("__place", place).where(F.col("__place") == 2)
    return second.agg(F.count(F.lit(1)).alias(name))


def duplicates(checks: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Number of repeated keys per check."""
    return union_rows(
        [count_repeated(df, keys, "duplicate_keys").select(F.lit(f"{name} duplicates").alias("check_name"), "duplicate_keys")
         for name, (df, keys) in checks.items()]
    )


def date_range(df: DataFrame, ts: str, start, end) -> DataFrame:
    """First and last time and the number of rows outside the days from start to end."""
    day = F.col(ts).cast("date")
    outside = F.when((day < F.lit(start).cast("date")) | (day > F.lit(end).cast("date")), 1).otherwise(0)
    return df.agg(
        F.min(ts).alias(f"min_{ts}"), F.max(ts).alias(f"max_{ts}"), F.sum(outside).alias("out_of_range_rows")
    )


def orphan_keys(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child keys without a parent, with the rows that carry them; a NULL key has no parent."""
    counted = child.groupBy(F.col(key).alias("key_value")).agg(F.count(F.lit(1)).alias("child_rows"))
    keys = parent.select(F.col(parent_key).alias("key_value"))
    return counted.join(keys, "key_value", "left_anti")


def orphans(checks: dict[str, tuple[DataFrame, str, DataFrame, str]], optional: tuple[str, ...] = ()) -> DataFrame:
    """Child rows without a parent per check; NULL for a child table without rows.

    Child rows are counted per key first, so a hot key joins as one row. For checks named in
    ``optional`` a NULL key is allowed.
    """
    parts = []
    for name, (child, key, parent, parent_key) in checks.items():
        counted = child.groupBy(F.col(key).alias("__k")).agg(F.count(F.lit(1)).alias("n"))
        keys = parent.select(F.col(parent_key).alias("__k"), F.lit(1).alias("found"))
        missing = F.col("found").isNull()
        if name in optional:
            missing = missing & F.col("__k").isNotNull()
        summed = counted.join(keys, "__k", "left").agg(
            F.sum(F.when(missing, F.col("n")).otherwise(0)).alias("orphan_rows")
        )
        parts.append(summed.select(F.lit(name).alias("check_name"), "orphan_rows"))
    return union_rows(parts)


def missing(column: str, dtype: str) -> Column:
    """True where a value is absent: NULL, empty text or an empty array."""
    value = F.col(column)
    if dtype == "array":
        return value.isNull() | (F.size(value) == 0)
    if dtype == "text":
        return value.isNull() | (value == "")
    return value.isNull()


def field_coverage(profiles: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Number of customers and, per field, how many lack it; of a profile with several pages page 1 counts."""
    if "saved_items_page" in profiles.columns:
        profiles = profiles.where("saved_items_page = 1")
    return profiles.agg(
        F.count(F.lit(1)).alias("total_customers"),
        *[F.sum(F.when(missing(c, d), 1).otherwise(0)).alias(f"missing_{c}") for c, d in fields.items()],
    )


def row_rules(df: DataFrame, checks: dict[str, Column], label: str = "check_name") -> DataFrame:
    """Violation counts of several row checks in one pass over a table; a condition that is NULL passes."""
    columns = {f"c{i}": F.count(F.when(~cond, 1)).alias(f"c{i}") for i, cond in enumerate(checks.values())}
    listed = [F.struct(F.lit(n).alias(label), F.col(c).alias("violations")) for n, c in zip(checks, columns)]
    return df.agg(*columns.values()).select(F.inline(F.array(*listed)))


def domain_check(df: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """Rows whose code lies outside the allowed ones, per column; NULL passes, as in a CHECK."""
    return row_rules(df, {f"{table}_{c}": F.col(c).isin(*DOMAINS[c]) for c in columns})


def range_check(df: DataFrame, table: str, bounds: dict[str, tuple]) -> DataFrame:
    """Rows outside numeric bounds ``{column: (low, high)}``; ``None`` leaves a side open."""
    checks = {}
    for column, (low, high) in bounds.items():
        cond = F.lit(True)
        if low is not None:
            cond = cond & (F.col(column) >= low)
        if high is not None:
            cond = cond & (F.col(column) <= high)
        checks[f"{table}_{column}"] = cond
    return row_rules(df, checks)


def identity_check(df: DataFrame, table: str, rules: dict[str, Column]) -> DataFrame:
    """Rows that break a rule between their own columns."""
    return row_rules(df, {f"{table}_{n}": c for n, c in rules.items()})


def stock_identity() -> Column:
    return F.col("available_qty") == F.col("on_hand_qty") - F.col("reserved_qty")


def no_self_edge() -> Column:
    return F.col("source_product_id") != F.col("related_product_id")


def expected_volume(tables: dict[str, DataFrame], bands: tuple = VOLUME_BANDS) -> DataFrame:
    """Row-count ratios between tables and whether they lie in their band."""
    named = row_counts({n: tables[n] for n in sorted({t for b in bands for t in b[:2]})})
    # One row with a map of all counts: a handful of entries, one per table.
    counts = named.agg(F.map_from_entries(F.collect_list(F.struct("table_name", "row_count"))).alias("rows"))
    band = F.array(
        *[F.struct(F.lit(a).alias("table_name"), F.lit(b).alias("per_table"), F.lit(lo).alias("low"), F.lit(hi).alias("high"))
          for a, b, lo, hi in bands]
    )
    listed = counts.select("rows", F.explode(band).alias("b")).select("b.*", "rows")
    measured = listed.select(
        "table_name", "per_table", "low", "high",
        F.try_element_at("rows", F.col("table_name")).alias("row_count"),
        F.try_element_at("rows", F.col("per_table")).alias("per_count"),
    )
    ratio = F.when(F.col("per_count") > 0, F.col("row_count").cast("double") / F.col("per_count").cast("double"))
    return measured.withColumn("ratio", ratio).withColumn(
        "within_band", F.coalesce(F.col("ratio").between(F.col("low"), F.col("high")), F.lit(False))
    )


def line_totals(items: DataFrame) -> DataFrame:
    """Items whose total is not quantity times price less discount, compared in cents."""
    expected = F.col("quantity") * cents(F.col("unit_price")) - cents(F.col("discount_amount"))
    return items.withColumn("expected_cents", expected).where(F.col("expected_cents") != cents(F.col("line_total")))


def amount_rollup(transactions: DataFrame, items: DataFrame) -> DataFrame:
    """Transactions whose gross, discount or net differs from their lines, in cents.

    Lines are totalled per transaction before the join.
    """
    lines = items.groupBy("transaction_id").agg(
        F.sum(F.col("quantity") * cents(F.col("unit_price"))).alias("lines_gross"),
        F.sum(cents(F.col("discount_amount"))).alias("lines_discount"),
        F.sum(cents(F.col("line_total"))).alias("lines_net"),
    )
    header = transactions.select(
        "transaction_id", cents(F.col("gross_amount")).alias("gross"),
        cents(F.col("discount_amount")).alias("discount"), cents(F.col("net_amount")).alias("net"),
    )
    joined = header.join(lines, "transaction_id", "left").fillna(0, ["lines_gross", "lines_discount", "lines_net"])
    return joined.where(
        (F.col("gross") != F.col("lines_gross")) | (F.col("discount") != F.col("lines_discount"))
        | (F.col("net") != F.col("lines_net"))
    )
