"""Packing into optimal length buckets with token-budget batches.

Bucket boundaries come from dynamic programming over the histogram of all lengths: they give the
least total padding when every document is padded to the longest of its bucket. Inside a
bucket, documents in seeded order fill batches of as many rows as the token budget allows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.llm.common import running_before, seeded, word_count
from stockloom.session import scratch_dir, written

BUCKETS = 16
TOKEN_BUDGET = 32_768
SEED = 11
EXACT_BITS = 10  # lengths below 2**10 have a histogram bin each, longer ones 2**9 bins per octave


def length_bin(length: Column) -> Column:
    """Histogram bin of a length: the length itself when short, rounded down to ten leading bits when long.

    Rounding keeps the histogram below ``2**10 + 2**9`` bins per further doubling, whatever the data.
    """
    shift = F.greatest(F.length(F.bin(length)) - EXACT_BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", length, shift), shift)


def optimal_bounds(tops: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Indexes of the last bin of each bucket, padding least; ties go to the smallest indexes.

    The cost of a bucket is its longest length times its rows, which meets the quadrangle
    inequality, so the best split of each prefix moves right with the prefix.
    """
    n = len(tops)
    total = np.concatenate([[0], np.cumsum(counts.astype(np.int64))])
    best = tops.astype(np.int64) * total[1:]  # one bucket for bins 0..j
    splits = []
    for k in range(1, min(buckets, n)):
        now, split = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64)
        stack = [(k, n - 1, k - 1, n - 2)]
        while stack:
            low, high, first, last = stack.pop()
            if low > high:
                continue
            mid = (low + high) // 2
            i = np.arange(first, min(last, mid - 1) + 1)
            costs = best[i] + tops[mid] * (total[mid + 1] - total[i + 1])
            at = int(np.argmin(costs))
            now[mid], split[mid] = costs[at], i[at]
            stack += [(low, mid - 1, first, int(i[at])), (mid + 1, high, int(i[at]), last)]
        splits.append(split)
        best = now
    ends = [n - 1]
    for split in reversed(splits):
        ends.append(int(split[ends[-1]]))
    return ends[::-1]


def pack(
    docs: DataFrame, length: Column | None = None, buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET,
    seed: int = SEED,
) -> DataFrame:
    """Bucket, batch and slot of every document.

    ``length`` defaults to the words of ``text``; null lengths and texts count as 0. Returns ``doc_id, length,
    bucket`` (0 is the shortest), ``padded`` (the longest length of the bucket), ``batch`` (from 0 within the
    bucket) and ``slot`` (from 0 within the batch). A batch holds ``token_budget // padded`` rows, at least one:
    a document longer than the budget has a batch to itself. Every row is placed, repeated
    rows too; with fewer bins than ``buckets`` each bin is a bucket; an empty table gives no rows.
    """
    spark = docs.sparkSession
    own = word_count(F.col("text")) if length is None else F.coalesce(length, F.lit(0)).cast("bigint")
    sized = written(
        docs.select("doc_id", own.alias("length")).withColumns({
            "__bin": length_bin(F.col("length")), "__key": seeded(seed, F.col("doc_id"), F.col("length")),
        }),
        scratch_dir(spark, "pack"),
    )
    bins = (
        sized.groupBy("__bin").agg(F.max("length").alias("top"), F.count(F.lit(1)).alias("n")).orderBy("__bin").collect()
    )
    if bins:
        tops = np.array([b.top for b in bins], np.int64)
        ends = optimal_bounds(tops, np.array([b.n for b in bins], np.int64), buckets)
    else:
        tops, ends = np.array([0]), [0]
    bounds = [int(tops[e]) for e in ends]
    bucket = F.lit(len(bounds) - 1)
    for i in range(len(bounds) - 2, -1, -1):
        bucket = F.when(F.col("length") <= bounds[i], i).otherwise(bucket)
    padded = F.element_at(F.array(*[F.lit(b) for b in bounds]), F.col("bucket") + 1).cast("bigint")
    rows = F.greatest(F.call_function("div", F.lit(token_budget), F.greatest("padded", F.lit(1))), F.lit(1))
    placed = running_before(sized.withColumn("bucket", bucket), ["bucket"], "__key", ["doc_id"], "__at")
    return (
        placed.withColumn("padded", padded).withColumn("__rows", rows)
        .select(
            "doc_id", "length", "bucket", "padded",
            F.call_function("div", F.col("__at"), F.col("__rows")).alias("batch"),
            (F.col("__at") % F.col("__rows")).alias("slot"),
        )
    )
