"""Sharding by balanced label propagation.

Documents of one group (by default: equal texts) are linked. Every round lets linked documents
move to the shard that holds most of their group, as far as the quotas of the shards allow: into
free room, or in exchange for others, also around cycles of full shards. Rounds go on until nothing moves; then
documents without links fill the shards up to the quotas, so row counts differ by one at most.
Documents of one group in one shard are interchangeable, so rounds work on counts per group
and shard, however large a group is.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockloom.llm.common import running_before, seeded
from stockloom.session import scratch_dir, written

SHARDS = 16
PATIENCE = 6  # rounds without a move, each with other ties, after which nothing moves any more
SHAKES = 24  # rounds in which groups may also gather in a shard that holds less of them
SEED = 5


def quotas(rows: int, shards: int) -> list[int]:
    """Rows of each shard; they differ by one at most."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def _cycle(arcs: set[tuple[int, int]]) -> list[tuple[int, int]]:
    """The arcs of one cycle; none if there is no cycle."""
    after: dict[int, list[int]] = {}
    for s, t in sorted(arcs):
        after.setdefault(s, []).append(t)
    done: set[int] = set()
    for start in sorted(after):
        path = [start]
        while path:
            t = next((t for t in after.get(path[-1], ()) if t not in done), None)
            if t is None:
                done.add(path.pop())
            elif t in path:
                round_ = [*path[path.index(t):], t]
                return list(zip(round_, round_[1:]))
            else:
                path.append(t)
    return []


def allowed_moves(demand: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """How many of the wanted moves between shards may happen at once without passing a quota.

    Opposite moves exchange places; the rest use free room, which every move out enlarges, or exchange
    places around longer cycles. What is left would pass a quota.
    """
    free = list(room)
    moves = {(s, t): min(n, demand.get((t, s), 0)) for (s, t), n in demand.items()}
    changed = True
    while changed:
        changed = False
        for (s, t), wanted in sorted(demand.items(), key=lambda d: (-d[1], d[0])):
            more = min(wanted - moves[s, t], free[t])
            if more > 0:
                moves[s, t] += more
                free[t] -= more
                free[s] += more
                changed = True
    while ring := _cycle({m for m, wanted in demand.items() if wanted > moves[m]}):
        most = min(demand[m] - moves[m] for m in ring)
        for m in ring:
            moves[m] += most
    return moves


def _table(spark, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def propagate(cells: DataFrame, room: list[int], rounds: int | None, seed: int, report: list[dict] | None = None) -> DataFrame:
    """Moves the counts ``link, shard, n`` of linked documents; ``room`` is what each shard may still take.

    A group's wish is the shard that holds most of it and not it alone, ties by a digest of the round;
    documents in shards that hold less of the group move there. Full shards are wished for too, their
    places are exchanged. After a round without a move the next one lets every group wish for
    any of its shards, at most ``SHAKES`` times, which frees places that no exchange reached; the one after that asks only for
    shards with room. Which groups go first where room is short is seeded by the round. A round is written
    and read again, so the lineage stays short. Moves of the other rounds bring more of a group together, so it
    ends: after ``PATIENCE`` rounds without a move, or ``rounds`` in all where they are given.
    """
    spark = cells.sparkSession
    shards = len(room)
    held = {r["shard"]: r["n"] for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    whole = F.element_at(F.array(*[F.lit(n + held.get(s, 0)) for s, n in enumerate(room)]), F.col("shard") + 1)
    idle = shakes = 0
    for round_ in itertools.count() if rounds is None else range(rounds):
        open_ = [s for s in range(shards) if room[s] > 0 and idle % 3 == 2] or list(range(shards))
        tie = seeded(seed + round_, F.col("link"), F.col("shard"))
        shake = idle % 3 == 1 and shakes < SHAKES
        shakes += shake
        order = F.struct(F.lit(0).alias("n") if shake else F.col("n"), tie.alias("tie"), "shard")
        target = F.col("shard").isin(open_) & (F.col("n") < whole)
        best = cells.groupBy("link").agg(F.max(F.when(target, order)).alias("best"))
        wishes = cells.join(best, "link").withColumn(
            "to", F.when(order < F.col("best"), F.col("best.shard")).otherwise(F.col("shard"))
        ).select("link", "shard", "n", "to")
        wishes = written(wishes, scratch_dir(spark, "wishes"))
        asked = wishes.where("shard <> to").groupBy("shard", "to").agg(F.sum("n").alias("n")).collect()
        moves = allowed_moves({(r["shard"], r["to"]): r["n"] for r in asked}, room)
        if report is not None:
            report.append({"round": round_, "asked": sum(r["n"] for r in asked), "moved": sum(moves.values())})
        if not sum(moves.values()):
            idle += 1
            if idle == PATIENCE or not asked and idle > 1:
                break
            continue
        idle = 0
        room = [
            r - sum(n for (_, t), n in moves.items() if t == s) + sum(n for (f, _), n in moves.items() if f == s)
            for s, r in enumerate(room)
        ]
        limits = _table(spark, [(s, t, n) for (s, t), n in moves.items()], "f int, t int, most bigint")
        queue = wishes.where("shard <> to").withColumn("key", seeded(seed + round_, F.col("link")))
        ranked = running_before(queue, ["shard", "to"], "key", ["link"], "before", F.col("n"))
        going = ranked.join(limits, (F.col("shard") == F.col("f")) & (F.col("to") == F.col("t"))).select(
            "link", "shard", "to", F.greatest(F.least("n", F.col("most") - F.col("before")), F.lit(0)).alias("n")
        )
        changes = (
            wishes.select("link", "shard", "n")
            .unionByName(going.select("link", "shard", (-F.col("n")).alias("n")))
            .unionByName(going.select("link", F.col("to").alias("shard"), "n"))
        )
        cells = written(
            changes.groupBy("link", "shard").agg(F.sum("n").alias("n")).where("n > 0"), scratch_dir(spark, "cells")
        )
    return cells


def _fill(position: Column, room: list[int]) -> Column:
    """The shard of the ``position``-th document, filling the shards' room in turn."""
    shard, upto = F.lit(len(room) - 1), sum(room)
    for s in range(len(room) - 1, 0, -1):
        upto -= room[s]
        shard = F.when(position < upto, s - 1).otherwise(shard)
    return shard


def shard(
    docs: DataFrame, link: Column | None = None, shards: int = SHARDS, rounds: int | None = None, seed: int = SEED,
    report: list[dict] | None = None,
) -> DataFrame:
    """A shard and a gapless slot for every document, few links cut, row counts at most one apart.

    Takes ``doc_id, text``; ``link`` is the key of a document's group (default: its text; a null key links with
    nothing). Returns ``doc_id, size`` (UTF-8 bytes plus 1), ``text_crc32, link, shard, slot``. A null text counts
    as no bytes. Repeated rows are rows of their own, an empty text is a text like any other, an
    empty table gives no rows. A group above a shard's quota is split over as many as it needs.
    Rounds go on until nothing moves, or up to ``rounds`` of them. ``report`` receives the wanted and the made moves of each round.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    own = F.when(F.col("text").isNotNull(), F.concat_ws(":", F.md5(text), F.octet_length(text))) if link is None else link
    base = written(
        docs.select(
            "doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"),
            own.cast("string").alias("link"),
        ).withColumn("key", seeded(seed, F.col("doc_id"), F.col("text_crc32"), F.col("size"))),
        scratch_dir(spark, "shards"),
    )
    groups = base.where("link IS NOT NULL").groupBy("link").agg(F.count(F.lit(1)).alias("of")).where("of > 1")
    split = written(base.join(groups, "link", "left").select(*base.columns, "of"), scratch_dir(spark, "linked"))
    linked = split.where("of IS NOT NULL").drop("of")
    ties = ["doc_id", "size"]
    quota = quotas(split.count(), shards)

    start = running_before(linked, [], "key", ties, "at").withColumn("shard", (F.col("at") % shards).cast("int"))
    cells = written(start.groupBy("link", "shard").agg(F.count(F.lit(1)).alias("n")), scratch_dir(spark, "cells"))

    def left(state: DataFrame) -> list[int]:
        held = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        return [q - held.get(s, 0) for s, q in enumerate(quota)]

    cells = propagate(cells, left(cells), rounds, seed, report)
    # A group's documents are dealt in seeded order to the shards that its counts name.
    until = F.sum("n").over(Window.partitionBy("link").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0))
    ranges = cells.withColumn("upto", until).groupBy("link").agg(F.sort_array(F.collect_list(F.struct("upto", "shard"))).alias("to"))
    inside = running_before(linked, ["link"], "key", ties, "at").join(ranges, "link")
    placed = inside.withColumn("shard", F.filter("to", lambda r: r["upto"] > F.col("at"))[0]["shard"]).drop("at", "to")
    free = running_before(split.where("of IS NULL").drop("of"), [], "key", ties, "at")
    filled = free.withColumn("shard", _fill(F.col("at"), left(cells)).cast("int")).drop("at")
    whole = written(placed.select(*base.columns, "shard").unionByName(filled.select(*base.columns, "shard")), scratch_dir(spark, "placed"))
    return running_before(whole, ["shard"], "key", ties, "slot").select("doc_id", "size", "text_crc32", "link", "shard", "slot")
