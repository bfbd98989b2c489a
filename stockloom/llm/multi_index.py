"""Approximate nearest neighbours with an inverted multi-index.

The two halves of the unit vectors are quantised separately; a pair of centroids is a cell of the
index and lists the vectors nearest to both. A query walks the pairs in order of summed
distance with a heap until it has met its share of all vectors, and the entries met are
reranked by exact cosine. Equal vectors are one entry that keeps its smallest ids.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.plans.topk import top_k
from stockloom.session import scratch_dir, written

CENTROIDS = 64  # per half; 64 x 64 cells
SAMPLE = 20_000  # vectors the centroids and the share are fitted on
TRIALS = 256  # sample vectors whose true neighbours set the share
RECALL = 0.95  # of those neighbours that the walk has to meet
LEAST = 2_000  # entries a walk meets at least, if there are as many
ENTRY_CHUNK, QUERY_CHUNK = 16_384, 4_096  # sides of a block of the rerank


@dataclass
class Index:
    """Centroids of both halves and the share of all entries that a query has to meet."""

    width: int
    centroids: tuple[np.ndarray, np.ndarray]
    share: float

    def distances(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of both halves to their centroids."""
        half = self.width // 2
        return tuple(
            (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)
            for x, c in zip((units[:, :half], units[:, half:]), self.centroids)
        )

    def cells(self, units: np.ndarray) -> np.ndarray:
        first, second = self.distances(units)
        return first.argmin(1) * len(self.centroids[1]) + second.argmin(1)


def walk(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, wanted: int) -> list[tuple[int, int]]:
    """Centroid pairs by summed distance until the cells met hold ``wanted`` entries; empty cells are passed over."""
    one, two = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    a, b = first[one].tolist(), second[two].tolist()
    heap, met, found = [(a[0] + b[0], 0, 0)], 0, []
    upto = [0] * len(a)  # pairs (i, j) with j < upto[i] have been met or wait in the heap
    upto[0] = 1
    while heap and met < wanted:
        _, i, j = heapq.heappop(heap)
        here = int(sizes[one[i], two[j]])
        if here:
            found.append((int(one[i]), int(two[j])))
            met += here
        if j + 1 < len(b) and upto[i] == j + 1 and (i == 0 or upto[i - 1] > j + 1):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
            upto[i] = j + 2
        if i + 1 < len(a) and upto[i + 1] == j:
            heapq.heappush(heap, (a[i + 1] + b[j], i + 1, j))
            upto[i + 1] = j + 1
    return found


def _centroids(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    centre = x[np.random.default_rng(3).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = ((centre * centre).sum(1) - 2 * x @ centre.T).argmin(1)
        counts = np.bincount(near, minlength=k)
        sums = np.zeros_like(centre)
        np.add.at(sums, near, x)
        centre[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centre


def fit(units: np.ndarray, k: int = CENTROIDS, recall: float = RECALL) -> Index:
    """Centroids from sample vectors, and the share of entries that holds ``recall`` of the true neighbours there."""
    width, half = units.shape[1], units.shape[1] // 2
    k = max(1, min(k, len(units) // 8))
    index = Index(width, (_centroids(units[:, :half], k), _centroids(units[:, half:], k)), 1.0)
    own = units[:TRIALS]
    scores = own @ units.T
    scores[np.arange(len(own)), np.arange(len(own))] = -np.inf
    near = np.argsort(-scores, axis=1)[:, : min(5, len(units) - 1)]
    cells = index.cells(units)
    sizes = np.bincount(cells, minlength=k * k)
    first, second = index.distances(own)
    order = np.argsort((first[:, :, None] + second[:, None, :]).reshape(len(own), -1), axis=1, kind="stable")
    place = np.empty_like(order)
    place[np.arange(len(own))[:, None], order] = np.arange(k * k)
    met = np.cumsum(sizes[order], axis=1)
    needs = met[np.arange(len(own))[:, None], place[np.arange(len(own))[:, None], cells[near]]] / len(units)
    index.share = float(np.quantile(needs, recall)) if needs.size else 1.0
    return index


def _clean(embedding: Column, width: int) -> Column:
    """Digest and bytes of a usable vector; null for one that takes no part."""

    def pack(vectors: pa.Array) -> pa.Array:
        keys, raws = [], []
        for v in vectors:
            values = v.as_py()
            usable = values is not None and len(values) == width and None not in values
            x = np.array(values, np.float64) if usable else None
            if usable and np.isfinite(x).all() and x.any():
                x = x + 0.0  # no negative zeros
                raws.append(x.tobytes())
                keys.append(xxhash.xxh3_128_digest(raws[-1]))
            else:
                raws.append(None)
                keys.append(None)
        return pa.StructArray.from_arrays([pa.array(keys, pa.binary()), pa.array(raws, pa.binary())], ["key", "vec"])

    pack.__annotations__ = {"vectors": pa.Array, "return": pa.Array}
    return F.arrow_udf(pack, "struct<key: binary, vec: binary>").asNondeterministic()(embedding)


def _matrix(raw, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() if hasattr(x, "as_py") else x for x in raw), np.float64).reshape(-1, width)


def _unit(x: np.ndarray) -> np.ndarray:
    # Scaled first, so that squares of very large or small components stay finite.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _rerank(left: pd.DataFrame, right: pd.DataFrame, width: int, k: int) -> pd.DataFrame:
    """The ``k`` best entries of a block for every query that walked one of their cells."""
    out = pd.DataFrame({"query": pd.Series(dtype=object), "key": pd.Series(dtype=object), "low": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
    if not len(left) or not len(right):
        return out
    entries = right.sort_values(["second", "low"], kind="stable").reset_index(drop=True)
    units, queries = _unit(_matrix(entries["vec"], width)), _unit(_matrix(left["vec"], width))
    seconds, low = entries["second"].to_numpy(), entries["low"].to_numpy()
    masks = np.array([np.frombuffer(m, np.uint8) for m in left["cells"]])
    best_score = np.full((len(left), k), -np.inf)
    best_at = np.full((len(left), k), -1)
    starts = np.flatnonzero(np.r_[True, seconds[1:] != seconds[:-1]])
    for start, end in zip(starts, np.r_[starts[1:], len(seconds)]):
        asked = np.flatnonzero(masks[:, seconds[start]])
        if not len(asked):
            continue
        scores = np.concatenate([best_score[asked], queries[asked] @ units[start:end].T], axis=1)
        at = np.concatenate([best_at[asked], np.broadcast_to(np.arange(start, end), (len(asked), end - start))], axis=1)
        ids = np.where(at >= 0, low[at], np.iinfo(np.int64).max)
        order = np.lexsort((ids, -scores), axis=1)[:, :k]
        best_score[asked] = np.take_along_axis(scores, order, 1)
        best_at[asked] = np.take_along_axis(at, order, 1)
    row, col = np.nonzero(best_at >= 0)
    at = best_at[row, col]
    return pd.DataFrame({
        "query": left["query"].to_numpy()[row], "key": entries["key"].to_numpy()[at], "low": low[at], "score": best_score[row, col],
    })


def search(
    vectors: DataFrame, is_query: Column, k: int = 5, centroids: int = CENTROIDS, recall: float = RECALL, sample: int = SAMPLE,
    report: dict | None = None,
) -> DataFrame:
    """The ``k`` nearest rows found for each query row: ``query_id, rank, vec_id, score``.

    Takes ``vec_id, embedding``; queries are rows of the table and never find themselves. The score is the
    cosine in double precision, ties go to the smaller id. Vectors that are null, zero, of
    another than the most common width, or hold null or non-finite components take no part, nor
    do rows with a null id; a row given twice counts once. All entries are met, and the result
    is exact, where there are no more than ``LEAST``. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    own = vectors.select("vec_id", "embedding", is_query.alias("asks")).where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    common = own.where(F.size("embedding") > 0).groupBy(F.size("embedding").alias("w")).count().orderBy(F.desc("count"), "w").first()
    width = common["w"] if common else 2
    points = written(
        own.select("vec_id", "asks", _clean(F.col("embedding"), width).alias("p")).where("p.key IS NOT NULL").select("vec_id", "asks", "p.*"),
        scratch_dir(spark, "vectors"),
    )
    once = points.select("key", "vec_id").distinct()
    first = top_k(once, ["key"], [F.col("vec_id")], k + 1, "__rank")
    entries = points.groupBy("key").agg(F.min("vec_id").alias("low"), F.first("vec").alias("vec"))
    entries = written(entries, scratch_dir(spark, "entries"))
    total = entries.count()
    drawn = entries.select("key", "vec").orderBy("key").limit(sample).collect()
    if drawn:
        index = fit(_unit(_matrix([r.vec for r in drawn], width)), centroids, recall)
    else:
        index = Index(width, (np.zeros((1, width // 2)), np.zeros((1, width - width // 2))), 1.0)
    seconds = len(index.centroids[1])

    def cell(raw: pa.Array) -> pa.Array:
        return pa.array(index.cells(_unit(_matrix(raw, width))), pa.int64()) if len(raw) else pa.array([], pa.int64())

    cell.__annotations__ = {"raw": pa.Array, "return": pa.Array}
    listed = written(entries.withColumn("cell", F.arrow_udf(cell, "bigint")("vec")), scratch_dir(spark, "cells"))
    sizes = np.zeros((len(index.centroids[0]), seconds), np.int64)
    for r in listed.groupBy("cell").count().collect():
        sizes[divmod(r["cell"], seconds)] = r["count"]
    wanted = max(LEAST, int(np.ceil(index.share * total)))
    if report is not None:
        report |= {"entries": total, "share": index.share, "wanted": wanted}

    def route(raw: pa.Array) -> pa.Array:
        """Per query, the cells it walks: first centroid and a byte per second centroid."""
        rows = []
        if len(raw):
            one, two = index.distances(_unit(_matrix(raw, width)))
            for a, b in zip(one, two):
                met: dict[int, np.ndarray] = {}
                for i, j in walk(a, b, sizes, wanted):
                    met.setdefault(i, np.zeros(seconds, np.uint8))[j] = 1
                rows.append([{"first": i, "cells": m.tobytes()} for i, m in met.items()])
        return pa.array(rows, pa.list_(pa.struct([("first", pa.int64()), ("cells", pa.binary())])))

    route.__annotations__ = {"raw": pa.Array, "return": pa.Array}
    asks = points.where("asks").select(F.col("vec_id").alias("query_id"), F.col("key").alias("query")).distinct()
    asking = asks.select("query").distinct().join(entries.select(F.col("key").alias("query"), "vec"), "query")
    n_asking = asking.count()
    in_first = sizes.sum(1).tolist()
    chunks = F.element_at(F.array(*[F.lit(max(1, -(-n // ENTRY_CHUNK))) for n in in_first]), (F.col("first") + 1).cast("int"))
    query_chunks = max(1, -(-n_asking // QUERY_CHUNK))
    routed = (
        asking.withColumn("met", F.explode(F.arrow_udf(route, "array<struct<first: bigint, cells: binary>>")("vec")))
        .select("query", "vec", "met.*")
        .withColumns({"part": F.explode(F.sequence(F.lit(0), chunks - 1)), "block": F.pmod(F.xxhash64("query"), F.lit(query_chunks)).cast("int")})
    )
    holders = (
        listed.withColumns({"first": F.call_function("div", F.col("cell"), F.lit(seconds)), "second": F.col("cell") % seconds})
        .withColumns({"part": F.pmod(F.xxhash64("key"), chunks).cast("int"), "block": F.explode(F.sequence(F.lit(0), F.lit(query_chunks - 1)))})
        .select("key", "low", "vec", "first", "second", "part", "block")
    )
    keys = ["first", "part", "block"]

    def rerank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _rerank(left, right, width, k + 1)

    near = routed.groupBy(*keys).cogroup(holders.groupBy(*keys)).applyInPandas(
        rerank, "query binary, key binary, low bigint, score double"
    )
    best = top_k(near, ["query"], [F.desc("score"), F.col("low")], k + 1, "__rank").drop("__rank", "low")
    found = best.join(first.select("key", "vec_id"), "key").join(asks, "query").where("vec_id <> query_id")
    ranked = top_k(found, ["query_id"], [F.desc("score"), F.col("vec_id")], k)
    return ranked.select("query_id", "rank", "vec_id", F.greatest(F.least("score", F.lit(1.0)), F.lit(-1.0)).alias("score"))
