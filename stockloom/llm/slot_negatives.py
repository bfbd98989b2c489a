"""Hard-negative mining by slot-decomposed selection.

A positive with score ``p`` allows negatives between a lower and an upper share of ``p``. The upper limits of
an anchor's positives, in descending order, cut the scores into disjoint slots. Every task keeps the
first ``k`` negatives of each slot, tasks are merged slot by slot, and the window of a positive is
answered by the slots from its own limit downwards: their merged first ``k``, cut at the lower limit.
Overlapping windows share their slots, so nothing is selected twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.plans.topk import top_k
from stockloom.session import scratch_dir, written

POSITIVES, NEGATIVES = 5, 10
LOW, HIGH, UNIT = 30, 90, 100  # LOW * positive <= UNIT * negative <= HIGH * positive
SCALE = 256
ANCHORS = 16_384  # anchors of one round: what a round broadcasts does not grow with the table
ROWS = 4_096  # rows scored at once in a task
CELLS = 2_097_152  # scores held at once in a task
EXACT = 2.0**53  # integers up to here are exact in double precision


def components(vector: Column, scale: int = SCALE) -> Column:
    """Integer components ``floor(scale * x)`` as bytes of doubles; null for a vector with a null or non-finite one."""

    def pack(vectors: pa.Array) -> pa.Array:
        out = []
        for v in vectors:
            values = v.as_py()
            usable = values is not None and len(values) > 0 and None not in values
            x = np.floor(float(scale) * np.array(values, np.float64)) + 0.0 if usable else None
            out.append(x.tobytes() if usable and np.isfinite(x).all() else None)
        return pa.array(out, pa.binary())

    pack.__annotations__ = {"vectors": pa.Array, "return": pa.Array}
    return F.arrow_udf(pack, "binary").asNondeterministic()(vector)


def products(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Integer inner products: in double precision where that is exact, else with integers of any size."""
    most = max(np.abs(rows).max(initial=0), 1.0) * max(np.abs(anchors).max(initial=0), 1.0)
    if most * rows.shape[1] < EXACT:
        return (rows @ anchors.T).astype(np.int64)
    whole = [[int(x) for x in r] for r in rows], [[int(x) for x in a] for a in anchors]
    exact = [[sum(x * y for x, y in zip(r, a)) for a in whole[1]] for r in whole[0]]
    return np.array(exact, np.int64).reshape(len(rows), len(anchors))  # OverflowError beyond 64 bits


def _matrix(raw: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.float64).reshape(-1, width)


def _scored(batches: Iterator[pa.RecordBatch], anchors: np.ndarray, width: int) -> Iterator[tuple]:
    """Blocks of ids, labels and scores, a column for each anchor."""
    step = max(1, min(ROWS, CELLS // max(len(anchors), 1)))
    for batch in batches:
        for start in range(0, batch.num_rows, step):
            part = batch.slice(start, step)
            ids, labels, raw = (part.column(c) for c in ("vec_id", "label", "vec"))
            yield ids.to_numpy(), labels.to_numpy(), products(_matrix(raw.to_pylist(), width), anchors)


class _Kept:
    """The first ``k`` rows of every key met so far, by falling score and rising id."""

    def __init__(self, k: int):
        self.k, self.parts, self.size, self.limit = k, [], 0, 4 * CELLS // 32

    def add(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if len(key):
            self.parts.append((key, score, ids))
            self.size += len(key)
            if self.size > self.limit:
                self.cut()
                self.limit = max(self.limit, 2 * self.size)

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            return (np.zeros(0, np.int64),) * 3
        key, score, ids = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((ids, -score, key))
        key, score, ids = key[order], score[order], ids[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        place = np.arange(len(key)) - np.repeat(first, np.diff(np.r_[first, len(key)]))
        use = place < self.k
        self.parts, self.size = [(key[use], score[use], ids[use])], int(use.sum())
        return self.parts[0]


def _lead(scores: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """``allowed`` without what lies below the ``k``-th best score of its column; ties with that one stay."""
    if len(scores) <= k:
        return allowed
    masked = np.where(allowed, scores, np.iinfo(np.int64).min)
    return allowed & (scores >= np.partition(masked, len(scores) - k, axis=0)[len(scores) - k])


def limits(scores: list[int], low: int = LOW, high: int = HIGH, unit: int = UNIT) -> tuple[list[int], list[int], list[int]]:
    """Descending distinct upper limits of an anchor's positives, and the slot and lower limit of each positive."""
    upper = [high * p // unit for p in scores]
    edges = sorted(set(upper), reverse=True)
    return edges, [edges.index(u) for u in upper], [-(-low * p // unit) for p in scores]


def _round(points: DataFrame, anchors: pd.DataFrame, width: int, positives: int, k: int, low: int, high: int, unit: int) -> DataFrame:
    """The answers of one round of anchors: two passes over the rows, each with a bounded broadcast."""
    spark = points.sparkSession
    own = _matrix(list(anchors["vec"]), width)
    shared = spark.sparkContext.broadcast((own, anchors["vec_id"].to_numpy(np.int64), anchors["label"].to_numpy(np.int64)))
    found = "anchor bigint, slot bigint, id bigint, score bigint"

    def answer(kept: _Kept, slots: int) -> Iterator[pa.RecordBatch]:
        key, score, ids = kept.cut()
        yield pa.RecordBatch.from_arrays(
            [pa.array(key // slots), pa.array(key % slots), pa.array(ids), pa.array(score)], ["anchor", "slot", "id", "score"]
        )

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, names, groups = shared.value
        kept = _Kept(positives)
        for ids, labels, scores in _scored(batches, vectors, width):
            allowed = (labels[:, None] == groups[None, :]) & (ids[:, None] != names[None, :])
            row, anchor = np.nonzero(_lead(scores, allowed, positives))
            kept.add(anchor, scores[row, anchor], ids[row])
        yield from answer(kept, 1)

    best = top_k(points.mapInArrow(near, found), ["anchor"], [F.desc("score"), F.col("id")], positives, "place")
    lists = best.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", "score", "id"))).alias("p")).collect()
    count = len(anchors)
    edges = np.full((count, positives), np.iinfo(np.int64).min)
    floor = np.full(count, np.iinfo(np.int64).max)
    asked = []
    for r in lists:
        scores = [p["score"] for p in r.p]
        cuts, slots, lows = limits(scores, low, high, unit)
        edges[r.anchor, : len(cuts)] = cuts
        floor[r.anchor] = min(lows)
        asked += [
            (r.anchor, int(anchors["vec_id"].iloc[r.anchor]), p["id"], p["score"], s, least)
            for p, s, least in zip(r.p, slots, lows)
        ]
    if not asked:
        asked_schema = "anchor bigint, anchor_id bigint, positive_id bigint, positive_score bigint, slot bigint, least bigint"
        return spark.createDataFrame([], asked_schema).select(
            "anchor_id", "positive_id", F.lit(0).alias("rank"), F.col("slot").alias("negative_id"), "positive_score",
            F.col("least").alias("negative_score"),
        )
    windows = spark.sparkContext.broadcast((edges, floor))

    def hard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, _, groups = shared.value
        cuts, least = windows.value
        kept = _Kept(k)
        for ids, labels, scores in _scored(batches, vectors, width):
            row, anchor = np.nonzero((labels[:, None] != groups[None, :]) & (scores <= cuts[None, :, 0]) & (scores >= least[None, :]))
            score = scores[row, anchor]
            slot = (score[:, None] <= cuts[anchor]).sum(1) - 1  # the lowest limit it does not pass
            kept.add(anchor * positives + slot, score, ids[row])
        yield from answer(kept, positives)

    slots = top_k(points.mapInArrow(hard, found), ["anchor", "slot"], [F.desc("score"), F.col("id")], k, "place")
    # Scores fall from slot to slot, so the slots of an anchor in order are one descending list.
    falling = F.sort_array(F.collect_list(F.struct("slot", "place", "id", "score"))).alias("all")
    merged = slots.groupBy("anchor").agg(falling)
    wanted = spark.createDataFrame(
        asked, "anchor bigint, anchor_id bigint, positive_id bigint, positive_score bigint, own bigint, least bigint"
    )
    suffix = F.slice(F.filter("all", lambda n: n["slot"] >= F.col("own")), 1, k)
    inside = F.filter(suffix, lambda n: n["score"] >= F.col("least"))
    return (
        wanted.join(merged, "anchor")
        .select("anchor_id", "positive_id", "positive_score", F.posexplode(inside).alias("at", "n"))
        .select(
            "anchor_id", "positive_id", (F.col("at") + 1).alias("rank"), F.col("n.id").alias("negative_id"),
            "positive_score", F.col("n.score").alias("negative_score"),
        )
    )


def mine(
    vectors: DataFrame, is_anchor: Column, label: Column | str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES,
    low: int = LOW, high: int = HIGH, unit: int = UNIT, scale: int = SCALE, anchors_at_once: int = ANCHORS,
) -> DataFrame:
    """Hard negatives of every anchor and positive: ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Takes ``vec_id, embedding`` and a label. A component ``x`` counts as ``floor(scale * x)``; a score is the
    integer inner product with the anchor, higher first, ties to the smaller id. An anchor's positives are its
    first ``positives`` other rows of the same label; per positive, the first ``negatives`` rows of another label with
    ``low * positive <= unit * negative <= high * positive`` are returned, fewer where there are fewer.

    Rows with a null id, label or vector, an empty vector, a null or non-finite component or another than the most
    common width take no part. A row given twice counts once; rows of an anchor's own id are never its
    positives. An empty table and one without anchors give no rows; other columns are not read. Sums beyond
    2**53 are taken with integers of any size; a score beyond 64 bits ends the job with an error.

    Anchors come in rounds of ``anchors_at_once``, the only data that is broadcast; each round reads all rows twice.
    """
    spark = vectors.sparkSession
    given = vectors.select("vec_id", "embedding", (F.col(label) if isinstance(label, str) else label).cast("bigint").alias("label"), is_anchor.alias("asks"))
    usable = given.where("vec_id IS NOT NULL AND label IS NOT NULL").select(
        F.col("vec_id").cast("bigint").alias("vec_id"), "label", F.coalesce("asks", F.lit(False)).alias("asks"), components(F.col("embedding"), scale).alias("vec")
    ).where("vec IS NOT NULL")
    points = written(usable.distinct(), scratch_dir(spark, "negatives"))
    common = points.groupBy(F.octet_length("vec").alias("w")).count().orderBy(F.desc("count"), "w").first()
    width = common["w"] // 8 if common else 1
    points = points.where(F.octet_length("vec") == 8 * width)
    asking = points.where("asks").select("vec_id", "label", "vec")
    rounds = max(1, -(-asking.count() // anchors_at_once))
    turn = F.pmod(F.xxhash64("vec_id", "label", "vec"), F.lit(rounds))
    answers = []
    for i in range(rounds):
        rows = asking.where(turn == i).collect()
        chosen = pd.DataFrame([(r.vec_id, r.label, bytes(r.vec)) for r in sorted(rows)], columns=["vec_id", "label", "vec"])
        part = _round(points.select("vec_id", "label", "vec"), chosen, width, positives, negatives, low, high, unit)
        # Written where more rounds follow, so that broadcasts and plans of a round end with it.
        answers.append(part if rounds == 1 else written(part, scratch_dir(spark, "negatives-round")))
    out = answers[0]
    for part in answers[1:]:
        out = out.unionByName(part)
    return out
