"""Token search without listing pairs of query and product.

Queries come in rounds of a bounded number that are broadcast; products stay where they are. A task holds a chunk of
products as postings per token, scores a query against its chunk in memory and hands on only its first ``limit`` products.
Before that, the heads of the tokens' postings, in the order that breaks ties, give every query a bar: the
``limit``-th best product found there. What falls short of the bar is not handed on at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.plans.topk import top_k
from stockloom.session import scratch_dir, written

ASKS = 20_000  # queries of one round
CHUNK = 65_536  # products scored at once in a task
# Points for a shared token, for a name that contains the query, for a query that contains the name.
TOKEN_POINTS, NAME_POINTS, QUERY_POINTS = 10, 20, 10
TIE_ORDER = ("product_name", "color", "size", "sku_id")

_FOUND = (
    "ask bigint, product_id string, product_name string, color string, size string, sku_id string, matched int, score int"
)


def needed(n: Column) -> Column:
    """Tokens that must be shared: two, but one where the query has fewer than three."""
    return F.when(n >= 3, 2).otherwise(1)


def score_of(matched: Column, name: Column, text: Column) -> Column:
    """Points of a product; ``name`` and ``text`` in lower case, a null name has no bonus."""
    return (
        matched * TOKEN_POINTS + F.when(F.contains(name, text), NAME_POINTS).otherwise(0) + F.when(F.contains(text, name), QUERY_POINTS).otherwise(0)
    ).cast("int")


def _first_nulls(value: str | None) -> tuple:
    return (value is not None, value or "")


class _Chunk:
    """Products of a task as postings per token, numbered in the order that breaks ties."""

    def __init__(self, table: pa.Table, tokens: pa.Array, filters: list[str]):
        columns = [table.column(c).to_pylist() for c in TIE_ORDER]
        order = sorted(range(table.num_rows), key=lambda i: tuple(_first_nulls(c[i]) for c in columns))
        self.table = table.take(pa.array(order, pa.int64()))
        self.keys = [tuple(_first_nulls(c[i]) for c in columns) for i in order]
        self.names = self.table.column("lower_name").combine_chunks().dictionary_encode()
        self.filters = [np.array(self.table.column(c).to_pylist(), object) for c in filters]
        held = self.table.column("held").combine_chunks()
        code = pc.fill_null(pc.index_in(held.flatten(), value_set=tokens), -1).to_numpy(zero_copy_only=False)
        row = pc.list_parent_indices(held).to_numpy(zero_copy_only=False)
        row, code = row[code >= 0], code[code >= 0]
        by = np.argsort(code, kind="stable")
        self.rows, self.starts = row[by], np.searchsorted(code[by], np.arange(len(tokens) + 1))

    def best(self, ask: dict, codes: list[int], limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, shared tokens and scores of the chunk's first ``limit`` products for a query, none beyond its bar."""
        parts = [self.rows[self.starts[c] : self.starts[c + 1]] for c in codes]
        rows, matched = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.int64), return_counts=True)
        use = matched >= (2 if len(codes) >= 3 else 1)
        for column, wanted in zip(self.filters, ask["wanted"]):
            if wanted is not None:
                use &= column[rows] == wanted
        rows, matched = rows[use], matched[use]
        base, bonus = matched * TOKEN_POINTS, NAME_POINTS + QUERY_POINTS
        floor = ask["bar"][0] if ask["bar"] else 0
        if len(rows) > limit:
            floor = max(floor, np.partition(base, len(base) - limit)[len(base) - limit])
        use = base + bonus >= floor
        rows, matched, base = rows[use], matched[use], base[use]
        names, at = np.unique(self.names.indices.fill_null(-1).to_numpy(zero_copy_only=False)[rows], return_inverse=True)
        points = np.zeros(len(names), np.int64)
        for i, n in enumerate(names.tolist()):
            if n >= 0:
                name = self.names.dictionary[n].as_py()
                points[i] = NAME_POINTS * (ask["text"] in name) + QUERY_POINTS * (name in ask["text"])
        score = base + points[at]
        first = np.lexsort((rows, -score))[:limit]
        if ask["bar"]:
            first = np.array([i for i in first if (-score[i], self.keys[rows[i]]) <= (-ask["bar"][0], ask["bar"][1])], np.int64)
        return rows[first], matched[first], score[first]


def _scored(shelf: DataFrame, asks: list[dict], limit: int, filters: list[str]) -> DataFrame:
    """The first products of every task's chunks for one round of queries."""
    vocabulary = sorted({t for a in asks for t in a["tokens"]})
    code = {t: i for i, t in enumerate(vocabulary)}
    shared = shelf.sparkSession.sparkContext.broadcast((vocabulary, [[code[t] for t in a["tokens"]] for a in asks], asks))

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        waiting, size = [], 0
        for batch in batches:
            waiting.append(batch)
            size += batch.num_rows
            if size >= CHUNK:
                yield pa.Table.from_batches(waiting)
                waiting, size = [], 0
        if size:
            yield pa.Table.from_batches(waiting)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, codes, wanted = shared.value
        tokens = pa.array(words, pa.string())
        for table in chunks(batches):
            chunk = _Chunk(table, tokens, filters)
            found = [chunk.best(a, c, limit) for a, c in zip(wanted, codes)]
            row = np.concatenate([f[0] for f in found]).astype(np.int64)
            asked = np.repeat([a["ask"] for a in wanted], [len(f[0]) for f in found]).astype(np.int64)
            own = chunk.table.select(["product_id", *TIE_ORDER]).take(pa.array(row))
            numbers = [pa.array(np.concatenate([f[i] for f in found]).astype(np.int32)) for i in (1, 2)]
            out = pa.table([pa.array(asked), *own.columns, *numbers], ["ask", "product_id", *TIE_ORDER, "matched", "score"])
            yield from out.combine_chunks().to_batches(max_chunksize=10_000)

    return shelf.mapInArrow(search, _FOUND)


def _bars(shelf: DataFrame, asks: DataFrame, limit: int, filters: list[str]) -> DataFrame:
    """Per query, the ``limit``-th best of the products that lead its tokens' postings: ``ask, bar``."""
    order = [F.col(c) for c in TIE_ORDER]
    probes = asks.withColumn("token", F.explode("tokens"))
    listed = shelf.withColumn("token", F.explode("held")).join(probes.select("token").distinct(), "token", "left_semi")
    heads = top_k(listed, ["token"], order, limit, rank="place").drop("place")
    met = heads.join(probes.select("ask", "text", "tokens", *[f"w_{c}" for c in filters], "token"), "token")
    for c in filters:
        met = met.where(F.col(f"w_{c}").isNull() | (F.col(f"w_{c}") == F.col(c)))
    matched = F.size(F.array_intersect("held", "tokens"))
    scored = met.dropDuplicates(["ask", "product_id"]).withColumn("matched", matched).where(F.col("matched") >= needed(F.size("tokens")))
    scored = scored.withColumn("score", score_of(F.col("matched"), F.col("lower_name"), F.col("text")))
    last = top_k(scored, ["ask"], [F.desc("score"), *order], limit, rank="place").where(F.col("place") == limit)
    return last.select("ask", F.struct("score", *TIE_ORDER).alias("bar"))


def best_products(shelf: DataFrame, asks: DataFrame, limit: int, filters: list[str], at_once: int = ASKS) -> DataFrame:
    """The first ``limit`` products of every query: ``ask, product_id, matched, score, rank``.

    ``shelf`` has ``product_id``, the columns of ``TIE_ORDER``, ``filters`` and ``held`` (an array of distinct tokens); ``asks`` has
    ``ask`` (a unique number), ``text`` (lower case), ``tokens`` (distinct) and ``w_`` columns for the filters, where null asks for
    nothing. Neither is read more than twice in a round.
    """
    spark = shelf.sparkSession
    base = scratch_dir(spark, "tokens")
    held = written(shelf.withColumn("lower_name", F.lower("product_name")), f"{base}/shelf")
    known = written(asks.where(F.size("tokens") > 0), f"{base}/asks")
    barred = written(known.join(_bars(held, known, limit, filters), "ask", "left"), f"{base}/barred")
    rounds = max(1, -(-known.count() // at_once))
    order = [F.col("score").desc(), *[F.col(c) for c in TIE_ORDER]]
    answers = None
    for i in range(rounds):
        rows = barred.where(F.pmod(F.xxhash64("ask"), F.lit(rounds)) == i).collect()
        if not rows:
            continue
        block = [
            {"ask": r.ask, "text": r.text, "tokens": list(r.tokens), "wanted": [r[f"w_{c}"] for c in filters],
             "bar": r.bar and (r.bar.score, tuple(_first_nulls(r.bar[c]) for c in TIE_ORDER))}
            for r in rows
        ]
        part = top_k(_scored(held, block, limit, filters), ["ask"], order, limit).select("ask", "product_id", "matched", "score", "rank")
        part = part if rounds == 1 else written(part, f"{base}/round={i}")
        answers = part if answers is None else answers.unionByName(part)
    if answers is None:
        return spark.createDataFrame([], "ask bigint, product_id string, matched int, score int, rank int")
    return answers
