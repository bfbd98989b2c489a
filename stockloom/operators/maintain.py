"""Table maintenance as DataFrame operators: upserts, updates, store locations, back-fills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.functions.derive import FIXED_STORE, REGION_SLOTS, region_slots
from stockloom.functions.text import concat_skip_null, padded
from stockloom.sources.buckets import BucketTable


def _single(updates: DataFrame, keys: list[str]) -> DataFrame:
    """The update rows; the job fails if a key occurs twice.

    Keys are counted with map-side combine, and only repeated ones would reach the check.
    """
    row = F.struct(*updates.columns)
    counted = updates.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.first(row).alias("__row"))
    message = F.concat_ws(" ", F.lit("duplicate key in update:"), *[F.col(k).cast("string") for k in keys])
    checked = F.when(F.col("__n") > 1, F.raise_error(message).cast(counted.schema["__row"].dataType)).otherwise(
        F.col("__row")
    )
    return counted.select(checked.alias("__row")).select("__row.*")


def upsert(
    base: DataFrame, updates: DataFrame, keys: list[str], columns: list[str] | None = None
) -> DataFrame:
    """Rows of ``base`` with the rows of ``updates`` put in by key.

    A matched row takes every non-key column of the update, or only ``columns``; an unmatched
    update is added as it is. A key that occurs twice among the updates fails the job.
    """
    fresh = _single(updates.select(*base.columns), keys)
    if columns is None:
        return base.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh)
    changed = update_from(base, fresh, keys, columns)
    added = fresh.join(base.select(*keys), keys, "left_anti")
    return changed.unionByName(added)


def upsert_stored(table: BucketTable, updates: DataFrame, batch: int, columns: list[str] | None = None) -> list[int]:
    """:func:`upsert` into a stored table by its keys; only buckets of an updated key are read and written again."""
    return table.apply(updates.select(*table.columns), batch, lambda base, fresh: upsert(base, fresh, table.keys, columns))


def conditional_update(df: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """Sets columns where the condition is true; where it is false or NULL the row stays."""
    return df.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def update_from(base: DataFrame, source: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Overwrites ``columns`` with those of the matching source row, also with NULLs."""
    incoming = source.select(*keys, F.struct(*columns).alias("__new"))
    joined = base.join(incoming, keys, "left")
    hit = F.col("__new").isNotNull()
    updated = joined.withColumns({c: F.when(hit, F.col(f"__new.{c}")).otherwise(F.col(c)) for c in columns})
    return updated.select(*base.columns)


def insert_select(base: DataFrame, source: DataFrame, keys: list[str], pick: list[Column], limit: int = 1) -> DataFrame:
    """Upserts the first ``limit`` rows of a query, in a stated order, into ``base``."""
    return upsert(base, source.orderBy(*pick).limit(limit).select(*base.columns), keys)


def email_backfill(customers: DataFrame) -> DataFrame:
    """Gives customers without an address one made from their id."""
    address = concat_skip_null(F.lit("customer"), F.col("customer_id"), F.lit("@example.com"))
    return conditional_update(customers, F.col("email").isNull(), {"email": address})


def assign_preferred_store(customers: DataFrame, first_name: str, last_name: str, store_id: int) -> DataFrame:
    """Sets the home store of every customer of a name, in any case."""
    named = (F.lower("first_name") == first_name.lower()) & (F.lower("last_name") == last_name.lower())
    return conditional_update(customers, named, {"preferred_store_id": F.lit(store_id)})


def store_locations(stores: DataFrame) -> DataFrame:
    """Place, street address, postal code and display name of each store.

    The place is looked up by region and store number; unknown regions use the last one.
    """
    last = list(REGION_SLOTS)[-1]
    keyed = stores.select(
        "store_id", "region",
        F.when(F.col("region").isin(*REGION_SLOTS), F.col("region")).otherwise(F.lit(last)).alias("slot_region"),
        (F.col("store_id") % 6).cast("int").alias("slot"),
    )
    # Thirty literal rows.
    placed = keyed.join(F.broadcast(region_slots(stores.sparkSession)), ["slot_region", "slot"])
    fixed = F.col("store_id") == FIXED_STORE["store_id"]

    def pick(column: str) -> Column:
        return F.when(fixed, F.lit(FIXED_STORE[column])).otherwise(F.col(column))

    postal = padded(F.lit(10_000) + (F.col("store_id") * 37) % 89_999, 5)
    named = placed.withColumns({c: pick(c) for c in ("region", "city", "state", "street")})
    return named.select(
        "store_id", "region", "city", F.col("state").alias("state_code"),
        concat_skip_null(F.lit(100) + F.col("store_id"), F.lit(" "), F.col("street")).alias("street_address"),
        postal.alias("postal_code"),
        concat_skip_null(F.col("city"), F.lit(" - "), F.col("street"), F.lit(" Location")).alias("store_name"),
    )


def relocate_stores(stores: DataFrame) -> DataFrame:
    """Stores with the columns of :func:`store_locations` written over their own."""
    places = store_locations(stores)
    known = stores
    for column in ("street_address", "postal_code"):
        if column not in stores.columns:
            known = known.withColumn(column, F.lit(None).cast("string"))
    columns = [c for c in places.columns if c != "store_id"]
    return update_from(known, places, ["store_id"], columns)
