"""Expressions and shapes that several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed by the contracts: a word is a run of anything but space, tab, newline, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"

# Cells per group when a group is cut for ranking: each holds 1/4096 of the group's rows.
CELL_DIGITS = 3


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def seeded(seed: int, *values: Column) -> Column:
    """A repeatable hex key that scatters rows; nulls count as empty."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(v.cast("string"), F.lit("")) for v in values]))


def cell_of(key: Column) -> Column:
    """The cell of a hex key: keys of a smaller cell sort before keys of a larger one."""
    return F.substring(key, 1, CELL_DIGITS)


def running_before(
    df: DataFrame, groups: list[str], key: str, ties: list[str], name: str, value: Column | None = None
) -> DataFrame:
    """Sum of ``value`` over the rows before each row of its group, ordered by the hex column ``key``, then ``ties``.

    Without ``value`` it is the 0-based position. A group is cut into cells of its key. Cells are
    totalled with partial sums, their offsets come from a window over at most 4096 rows per
    group, and only rows of one cell are sorted together, so a group of any size spreads over
    many tasks. Null groups are groups.
    """
    by = [*groups, "__cell"]
    amount = F.lit(1) if value is None else value
    split = df.withColumns({"__cell": cell_of(F.col(key)), "__v": amount.cast("bigint")})
    totals = split.groupBy(*by).agg(F.sum("__v").alias("__n"))
    earlier = Window.partitionBy(*groups).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*by).orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, -1)
    summed = split.withColumn("__inside", F.coalesce(F.sum("__v").over(inside), F.lit(0)))
    condition = F.lit(True)
    for c in by:
        condition = condition & F.col(f"r.{c}").eqNullSafe(F.col(f"o.{c}"))
    return summed.alias("r").join(offsets.alias("o"), condition).select(
        *[F.col(f"r.{c}") for c in df.columns], (F.col("o.__before") + F.col("r.__inside")).cast("bigint").alias(name)
    )
