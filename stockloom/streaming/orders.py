"""Order intake as a stream: every micro-batch is placed against the stock the last one left.

The stock is a snapshot and what the batches since took of it: batch ``n`` writes only the positions it touched, to
``taken/batch=n``. Every ``COMPACT`` batches the sums are folded into a new snapshot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stockloom import schemas
from stockloom.operators.placement import apply_reservations, place_orders, split_requests

COMPACT = 32  # batches between two snapshots: what a batch reads besides the snapshot stays bounded
_TAKEN = "store_id int, sku_id string, quantity int, stamp timestamp"


def inventory_version(spark: SparkSession, state: str, version: int, compact: int = COMPACT) -> DataFrame:
    """The stock after the first ``version`` batches."""
    start = version - version % compact
    base = spark.read.schema(schemas.INVENTORY).parquet(f"{state}/inventory/version={start}")
    if start == version:
        return base
    taken = spark.read.schema(_TAKEN).parquet(*[f"{state}/taken/batch={n}" for n in range(start, version)])
    return apply_reservations(base, taken, F.col("stamp"))


def start_inventory(inventory: DataFrame, state: str) -> None:
    """Writes the opening stock as version 0."""
    inventory.write.mode("overwrite").parquet(f"{state}/inventory/version=0")


def place_batch(
    batch: DataFrame, batch_id: int, products: DataFrame, stores: DataFrame, state: str, as_of: Column, compact: int = COMPACT
) -> None:
    """Places one batch of requests against version ``batch_id`` of the stock.

    Writes the batch's orders, lines, rejects and touched positions, and a snapshot where one is due. It reads only what
    earlier batches wrote, so placing a batch again writes the same rows over the same folders.
    """
    spark = batch.sparkSession
    headers, items = split_requests(batch)
    placed = place_orders(headers, items, inventory_version(spark, state, batch_id, compact), products, stores, as_of)
    for name in ("orders", "lines", "rejects", "taken"):
        getattr(placed, name).write.mode("overwrite").parquet(f"{state}/{name}/batch={batch_id}")
    if (batch_id + 1) % compact == 0:
        taken = spark.read.schema(_TAKEN).parquet(*[f"{state}/taken/batch={n}" for n in range(batch_id + 1 - compact, batch_id + 1)])
        base = inventory_version(spark, state, batch_id + 1 - compact, compact)
        apply_reservations(base, taken, F.col("stamp")).write.mode("overwrite").parquet(f"{state}/inventory/version={batch_id + 1}")


def place_orders_stream(
    requests: DataFrame, products: DataFrame, stores: DataFrame, state: str, compact: int = COMPACT, **trigger
) -> StreamingQuery:
    """Runs a stream of order requests, each stamped ``placed_at``, into ``state``.

    Requests have either form of :func:`split_requests`; the rows of one order must arrive in
    the same file. Every order is dated by its own stamp. A replayed batch takes effect once.
    """

    def place(batch: DataFrame, batch_id: int) -> None:
        place_batch(batch, batch_id, products, stores, state, F.col("placed_at"), compact)

    writer = requests.writeStream.foreachBatch(place).option("checkpointLocation", f"{state}/checkpoint")
    return writer.trigger(**(trigger or {"availableNow": True})).start()
