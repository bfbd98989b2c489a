"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom.session import scratch_dir, written

MAX_ROUNDS = 50  # rounds grow with the logarithm of the nodes; beyond this something is wrong


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node that is not itself the smallest of its component.

    Each round hangs the larger neighbours of a node, and then the smaller ones, on the
    smallest neighbour. Minima are partial sums and the joins on hub nodes are inner joins that
    split when skewed; no neighbour list is gathered. Rounds are written and read again.
    Self links and repeated links do no harm; nodes must not be null.
    """
    spark = edges.sparkSession
    up, down = F.greatest(a, b), F.least(a, b)
    now = edges.where(F.col(a) != F.col(b)).select(up.alias("v"), down.alias("m")).distinct()
    now = written(now, scratch_dir(spark, "stars"))
    mark = None
    for _ in range(MAX_ROUNDS):
        both = now.unionByName(now.select(F.col("m").alias("v"), F.col("v").alias("m")))
        low = both.groupBy("v").agg(F.min("m").alias("low")).select("v", F.least("v", "low").alias("low"))
        large = both.join(low, "v").where("m > v").select(F.col("m").alias("v"), F.col("low").alias("m")).distinct()
        least = large.groupBy("v").agg(F.min("m").alias("low"))
        joined = large.join(least, "v")
        small = joined.where("m <> low").select(F.col("m").alias("v"), F.col("low").alias("m")).unionByName(
            least.select("v", F.col("low").alias("m"))
        ).distinct()
        now = written(small, scratch_dir(spark, "stars"))
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            return now.select(F.col("v").alias("node"), F.col("m").alias("root"))
        mark = tuple(seen)
    raise RuntimeError(f"no components after {MAX_ROUNDS} rounds")
