"""Mixing overlapping sources to target weights by a min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to). Word
capacity is routed from patterns to source quotas; each further pass over a pattern costs more
than the one before, so repeats are used only where a quota cannot be met without. Then
documents are chosen inside each pattern in seeded order.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.llm.common import running_before, seeded, word_count
from stockloom.session import scratch_dir, written

WEIGHTS = (5, 2, 1)
PASS_COSTS = (0, 1)  # of the first and second pass over a document; more entries allow more passes
SEED = 7
# Patterns and sources the driver solves for: aggregates, not documents. Beyond it the mix is refused.
MAX_PATTERNS = 200_000


def water_fill(sizes: Sequence[int], weights: Sequence[float], total: float, limit: float) -> list[float]:
    """Shares of ``total`` by weight, none above ``limit`` times its size; the excess is reshared by weight."""
    order = sorted(range(len(sizes)), key=lambda i: (limit * sizes[i] / weights[i], i))
    shares, left, weight = [0.0] * len(sizes), total, float(sum(weights))
    for at, i in enumerate(order):
        if limit * sizes[i] * weight > left * weights[i]:
            for j in order[at:]:
                shares[j] = left * weights[j] / weight
            break
        shares[i] = float(limit * sizes[i])
        left, weight = left - shares[i], weight - weights[i]
    return shares


def connected(members: dict) -> dict:
    """A part for every pattern: patterns that share sources, also through others, have the same one."""
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for p, names in members.items():
        for s in names:
            root[find(("s", s))] = find(("p", p))
    return {p: find(("p", p)) for p in members}


def min_cost_words(sizes: dict, members: dict, quotas: dict, costs: Sequence[int]) -> dict:
    """Words to take of each pattern: quotas met as far as capacity goes, at the least repetition cost.

    Costs rise from pass to pass and lie on patterns alone, so the flow is grown pass by pass: all that
    the first pass can carry, then what a further pass adds. A path never takes words back from a pattern, it only
    shifts them between its sources. Each pass is a maximal flow, grown in phases of shortest paths.
    """
    patterns = [p for p in sizes if sizes[p] > 0 and members[p]]
    number = {s: i for i, s in enumerate(sorted({s for p in patterns for s in members[p]}))}
    holds = [[number[s] for s in members[p]] for p in patterns]
    need = [0] * len(number)
    for s, i in number.items():
        need[i] = max(quotas.get(s, 0), 0)
    flow: list[dict[int, int]] = [{} for _ in number]  # words of each source by pattern
    taken = [0] * len(patterns)
    for turn in range(1, len(sorted(costs)) + 1):
        while _phase([turn * sizes[p] - taken[i] for i, p in enumerate(patterns)], holds, need, flow, taken):
            pass
    words = dict(zip(patterns, taken))
    return {p: words.get(p, 0) for p in sizes}


def _phase(room: list[int], holds: list[list[int]], need: list[int], flow: list[dict[int, int]], taken: list[int]) -> bool:
    """Fills all shortest paths from patterns with room to sources in need; False if there is none."""
    level_p = [0 if n > 0 else -1 for n in room]
    level_s = [-1] * len(need)
    front, depth, met = [p for p, n in enumerate(room) if n > 0], 0, False
    while front and not met:
        reached = []
        for p in front:
            for s in holds[p]:
                if level_s[s] < 0:
                    level_s[s] = depth
                    reached.append(s)
                    met = met or need[s] > 0
        front, depth = [], depth + 1
        for s in reached if not met else ():
            for p in flow[s]:
                if level_p[p] < 0:
                    level_p[p] = depth
                    front.append(p)
    if not met:
        return False
    ways = [iter(own) for own in holds]
    backs: list = [None] * len(need)
    for start in [p for p, n in enumerate(room) if n > 0]:
        path: list[int] = [start]  # pattern, source, pattern, source, ...
        while path and room[start] > 0:
            last = path[-1]
            if len(path) % 2:  # at a pattern
                s = next((s for s in ways[last] if level_s[s] == level_p[last]), None)
                if s is None:
                    level_p[last] = -2
                    path.pop()
                else:
                    path.append(s)
                continue
            if need[last] > 0:
                amount = min([room[start], need[last], *[flow[path[i]][path[i + 1]] for i in range(1, len(path) - 1, 2)]])
                for i in range(0, len(path), 2):
                    p, s = path[i], path[i + 1]
                    flow[s][p] = flow[s].get(p, 0) + amount
                    if i:
                        before = flow[path[i - 1]]
                        before[p] -= amount
                        if not before[p]:
                            del before[p]
                need[last] -= amount
                room[start] -= amount
                taken[start] += amount
                # Start anew: what this path used up is no way any more.
                path = [start]
                ways[start] = iter(holds[start])
                continue
            if backs[last] is None:
                backs[last] = iter(list(flow[last]))
            p = next((p for p in backs[last] if level_p[p] == level_s[last] + 1 and flow[last].get(p, 0) > 0), None)
            if p is None:
                level_s[last] = -2
                path.pop()
            else:
                path.append(p)
    return True


def rounded(rests: dict, parts: dict) -> dict:
    """Whether each pattern takes its boundary document, so that every connected part comes near its sum.

    ``rests`` has, per pattern, the words missing before and those over after that document. The
    error made so far in a part is carried on; of equal ones the document is taken.
    """
    error: dict = defaultdict(int)
    takes = {}
    for p in sorted(rests):
        short, over = rests[p]
        now = error[parts[p]]
        takes[p] = abs(now + over) <= abs(now - short)
        error[parts[p]] += over if takes[p] else -short
    return takes


def mix(
    docs: DataFrame,
    sources: Column | None = None,
    size: Column | None = None,
    weights: Sequence[float] = WEIGHTS,
    share: float = 1.5,
    costs: Sequence[int] = PASS_COSTS,
    seed: int = SEED,
    row: Column | None = None,
) -> DataFrame:
    """How many words the mix takes of each document.

    ``sources`` is the array of sources of a document (default: its ``source`` column, null a source of
    its own); an element may be null, repeats count once. Sources in code-point order, null
    last, weigh ``weights`` in rotation and share ``share`` times all words; no target exceeds as many passes as
    ``costs`` has entries times its source's words, the excess goes to the others by weight.

    ``row`` is an identity that the result hands back as ``row``, for tables in which ids repeat or are null.

    Returns ``doc_id, sources, size, target_sizes, targets`` (arrays parallel to ``sources``) and ``taken``, a
    multiple of ``size`` up to the number of passes. Inside a pattern every document gets the
    full passes of the pattern's words; the rest goes to documents in seeded order, the last one if
    that brings the patterns that share sources nearer to their sum (for one alone: if at least half of it fits). Null and empty texts have size 0 and take 0, a document
    without sources takes 0, an empty table gives no rows; repeated rows are rows of their own.
    """
    spark = docs.sparkSession
    given = F.array("source") if sources is None else sources
    names = F.array_sort(F.array_distinct(F.transform(given, lambda s: F.coalesce(F.concat(F.lit("s"), s), F.lit("~")))))
    narrow = docs.select(
        "doc_id", names.alias("__names"), (word_count(F.col("text")) if size is None else size).alias("size"),
        *([] if row is None else [row.alias("row")]),
    )
    sized = written(
        narrow.withColumns({
            "__pattern": F.array_join("__names", "\\u0000"),
            "__key": seeded(seed, F.col("doc_id")),
        }),
        scratch_dir(spark, "mix"),
    )
    patterns = sized.groupBy("__pattern").agg(F.sum("size").alias("n"), F.first("__names").alias("names"))
    rows = patterns.orderBy("__pattern").limit(MAX_PATTERNS + 1).collect()
    if len(rows) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns; group the sources first")
    of_source: dict = defaultdict(int)
    for r in rows:
        for s in r.names or ():
            of_source[s] += r.n
    order = sorted(of_source)  # "s" + name before "~", which stands for null
    weight = [weights[i % len(weights)] for i in range(len(order))]
    whole = sum(r.n for r in rows if r.names)
    shares = water_fill([of_source[s] for s in order], weight, share * whole, len(costs)) if order else []
    target = dict(zip(order, shares))
    members = {r["__pattern"]: r.names for r in rows if r.names}
    words = min_cost_words(
        {r["__pattern"]: r.n for r in rows if r.names}, members, {s: round(t) for s, t in target.items()}, costs
    )
    plan = [
        (r["__pattern"], words.get(r["__pattern"], 0) // max(r.n, 1), words.get(r["__pattern"], 0) % max(r.n, 1),
         [of_source[s] for s in r.names or ()], [target[s] for s in r.names or ()])
        for r in rows
    ]
    planned = spark.createDataFrame(
        plan, "__p string, __passes bigint, __rest bigint, target_sizes array<bigint>, targets array<double>"
    )
    own = [] if row is None else ["row"]
    ordered = running_before(sized, ["__pattern"], "__key", ["doc_id", "size", *own], "__before", F.col("size"))
    placed = written(ordered.join(planned, F.col("__pattern").eqNullSafe(F.col("__p"))), scratch_dir(spark, "mix-order"))
    after = F.col("__before") + F.col("size")
    boundary = (F.col("__before") < F.col("__rest")) & (after > F.col("__rest"))
    # At most one document of a pattern lies across the end of its words.
    edges = placed.where(boundary).select("__pattern", (F.col("__rest") - F.col("__before")).alias("short"), (after - F.col("__rest")).alias("over"))
    takes = rounded({r["__pattern"]: (r.short, r.over) for r in edges.collect()}, connected(members))
    last = spark.createDataFrame([(p,) for p, up in takes.items() if up], "__last string")
    chosen = placed.join(last, F.col("__pattern") == F.col("__last"), "left")
    extra = (F.col("__rest") > 0) & ((after <= F.col("__rest")) | (boundary & F.col("__last").isNotNull()))
    return chosen.select(
        "doc_id",
        F.transform("__names", lambda s: F.when(s != "~", F.substr(s, F.lit(2), F.char_length(s)))).alias("sources"),
        "size", "target_sizes", "targets", (F.col("size") * (F.col("__passes") + extra.cast("int"))).alias("taken"),
        *own,
    )
