"""Connected components of a link table, in a number of joins that grows with the logarithm of the nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom.session import scratch_dir, written

MAX_ROUNDS = 60  # far above the rounds any table needs; beyond it something is wrong


def component_roots(links: DataFrame) -> DataFrame:
    """``node, root`` for the nodes of ``a, b`` links that are not the smallest of their component.

    Alternates two contractions until the links no longer change: every node hands its larger neighbours to its
    smallest one, then its smaller ones. Minima combine before the shuffle and neighbours are never gathered in a
    list, so a node with very many links is only a skewed join key. Each contraction is
    written and read again. Links are integers and not null; loops and repeats do no harm.
    """
    spark = links.sparkSession

    def kept(df: DataFrame) -> DataFrame:
        return written(df.where("hi <> lo").distinct(), scratch_dir(spark, "components"))

    def digest(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).first())

    now = kept(links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")))
    seen = digest(now)
    for _ in range(MAX_ROUNDS):
        if not seen[0]:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        # A node's smallest neighbour or itself; its larger neighbours move there.
        ends = now.select(F.col("hi").alias("node"), F.col("lo").alias("other")).unionByName(
            now.select(F.col("lo").alias("node"), F.col("hi").alias("other"))
        )
        least = ends.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("m"))
        upper = ends.join(least, "node").where("other > node").select(F.col("other").alias("hi"), F.col("m").alias("lo"))
        large = kept(upper)
        # The smaller neighbours of a node, and the node, move to the smallest of them.
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        lower = large.join(least, "hi").select(F.explode(F.array(F.col("hi"), F.col("lo"))).alias("hi"), F.col("m").alias("lo"))
        now = kept(lower)
        last, seen = seen, digest(now)
        if seen == last:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    raise RuntimeError(f"no components after {MAX_ROUNDS} rounds")
