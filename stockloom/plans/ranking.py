"""Positions and running totals inside groups of any size.

A plain window sends a whole group to one task. The helpers here split a group into
order-preserving chunks, total the chunks, and add each chunk's offset back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockloom.session import checkpoint_root, scratch_dir, written

_CHUNK = "__chunk"


def running_totals(
    df: DataFrame, keys: list[str], order: str, values: dict[str, Column], span: int
) -> DataFrame:
    """Totals of ``values`` over the earlier rows of each group, excluding the row itself.

    ``order`` is an integer column, unique within a group; ``span`` consecutive order
    values form one chunk, so a chunk never holds more than ``span`` rows.
    """
    chunk_keys = [*keys, _CHUNK]
    inputs = df.withColumn(_CHUNK, F.call_function("div", F.col(order).cast("bigint"), F.lit(span)))
    for name, value in values.items():
        inputs = inputs.withColumn(f"__v_{name}", value)
    totals = inputs.groupBy(*chunk_keys).agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in values])
    before = Window.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *chunk_keys, *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in values]
    )
    inside = Window.partitionBy(*chunk_keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    joined = inputs.join(offsets, chunk_keys)
    for name in values:
        local = F.coalesce(F.sum(f"__v_{name}").over(inside), F.lit(0))
        joined = joined.withColumn(name, local + F.col(f"__o_{name}"))
    drop = [_CHUNK, *[f"__v_{n}" for n in values], *[f"__o_{n}" for n in values]]
    return joined.drop(*drop)


def numbered(ordered: DataFrame, position: str = "position") -> DataFrame:
    """The rows of a sorted table with their 1-based position, however many partitions hold them.

    A global sort leaves the ranges of its keys in the order of the partitions, so a row's position is its place in its
    partition plus the rows of the partitions before. Only one count per partition is gathered. The sorted
    rows are written first: their partitions are part of the result.
    """
    spark = ordered.sparkSession
    # The upper bits of the id are the partition, the lower ones the place in it.
    mark = F.monotonically_increasing_id()
    rows = written(ordered.withColumn(_CHUNK, mark), scratch_dir(spark, "numbered"))
    part = F.call_function("shiftright", F.col(_CHUNK), F.lit(33)).cast("int")
    counts = rows.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    place = F.col(_CHUNK).bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return rows.withColumn("__part", part).join(offsets, "__part").withColumn(position, place + F.col("__o")).drop(_CHUNK, "__part", "__o")


def ordered_positions(df: DataFrame, keys: list[str], order: list[Column], position: str) -> DataFrame:
    """1-based position of each row within its group, for groups too large for one task.

    Rows are ranged over partitions on key and order together, so one group spreads over
    many tasks. The ranged rows are checkpointed: the partition number is part of the
    result and must not change if a task is rerun.
    """
    checkpoint_root(df.sparkSession)
    ranged = (
        df.repartitionByRange(*[F.col(k) for k in keys], *order)
        .withColumn(_CHUNK, F.spark_partition_id())
        .checkpoint()
    )
    chunk_keys = [*keys, _CHUNK]
    before = Window.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(*chunk_keys)
        .agg(F.count(F.lit(1)).alias("__n"))
        .select(*chunk_keys, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    )
    inside = Window.partitionBy(*chunk_keys).orderBy(*order)
    return (
        ranged.join(offsets, chunk_keys)
        .withColumn(position, F.row_number().over(inside) + F.col("__o"))
        .drop(_CHUNK, "__o")
    )
