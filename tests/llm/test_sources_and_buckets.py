"""Mixing, packing and sharding against enumeration and their laws."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from stockloom.llm import label_shards, length_buckets, mixing_flow

DOCS = "doc_id bigint, text string, source string, size string, shard string, bucket string"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", "y", "z") for i, t, s in rows], DOCS)


def test_shares_never_pass_their_limit():
    draw = random.Random(2)
    for _ in range(200):
        sizes = [draw.randint(0, 50) for _ in range(draw.randint(1, 7))]
        weights = [mixing_flow.WEIGHTS[i % 3] for i in range(len(sizes))]
        shares = mixing_flow.water_fill(sizes, weights, 1.5 * sum(sizes), 2)
        assert abs(sum(shares) - 1.5 * sum(sizes)) < 1e-6
        free = [s / w for s, w, n in zip(shares, weights, sizes) if s < 2 * n - 1e-9]
        assert all(s <= 2 * n + 1e-9 for s, n in zip(shares, sizes))
        assert not free or max(free) - min(free) < 1e-6  # all below their limit share alike by weight


def _cost(sizes, taken, costs):
    return sum(sum(c * min(max(t - i * n, 0), n) for i, c in enumerate(costs)) for n, t in zip(sizes, taken))


def test_flow_is_maximal_and_cheapest():
    draw = random.Random(8)
    for _ in range(150):
        patterns = {p: draw.randint(1, 3) for p in range(draw.randint(1, 3))}
        sources = "ab"[: draw.randint(1, 2)]
        members = {p: tuple(s for s in sources if draw.random() < 0.7) for p in patterns}
        quotas = {s: draw.randint(0, 6) for s in sources}
        got = mixing_flow.min_cost_words(patterns, members, quotas, (0, 1))
        best = None
        ways = [
            [x for x in itertools.product(*[range(quotas[s] + 1 if s in members[p] else 1) for s in sources]) if sum(x) <= 2 * n]
            for p, n in patterns.items()
        ]
        for way in itertools.product(*ways):
            if all(sum(w[i] for w in way) <= quotas[s] for i, s in enumerate(sources)):
                taken = [sum(w) for w in way]
                key = (-sum(taken), _cost(patterns.values(), taken, (0, 1)))
                best = key if best is None else min(best, key)
        taken = [got[p] for p in patterns]
        assert (-sum(taken), _cost(patterns.values(), taken, (0, 1))) == best


def test_mix_meets_targets_and_repeats_itself(spark):
    draw = random.Random(4)
    rows = [(i, "w " * draw.randint(0, 40), draw.choice(["a", "b", "b", "b", "é", None])) for i in range(600)] + [(900, None, "a"), (5, "w " * 3, "b")]
    docs = _docs(spark, rows)
    out = mixing_flow.mix(docs).collect()
    assert sorted(map(str, out)) == sorted(map(str, mixing_flow.mix(docs.repartition(3)).collect()))
    assert len(out) == len(rows)
    taken = {}
    for r in out:
        assert r.taken in (0, r.size, 2 * r.size)
        taken.setdefault((r.sources[0], r.targets[0], r.target_sizes[0]), []).append(r)
    for (_, target, size), own in taken.items():
        assert sum(r.size for r in own) == size
        assert abs(sum(r.taken for r in own) - target) <= max(r.size for r in own)
    assert mixing_flow.mix(docs.limit(0)).count() == 0


def test_mix_routes_overlapping_sources(spark):
    rows = [(i, "w w", "x") for i in range(40)]
    docs = _docs(spark, rows)
    sources = F.when(F.col("doc_id") < 20, F.array(F.lit("a"), F.lit("b"))).when(F.col("doc_id") < 30, F.array(F.lit("b"))).otherwise(F.array().cast("array<string>"))
    out = {r.doc_id: r for r in mixing_flow.mix(docs, sources=sources, share=1.0).collect()}
    assert out[0].target_sizes == [40, 60] and out[35].taken == 0 and out[35].targets == []
    # 60 words in all: 5/7 to a and 2/7 to b, so only the documents of a are needed twice.
    assert sum(r.taken for r in out.values()) == 60
    assert all(out[i].taken <= 2 for i in range(20, 30))


def test_bounds_are_optimal():
    draw = np.random.default_rng(6)
    for _ in range(80):
        tops = np.unique(draw.integers(0, 40, draw.integers(1, 9)))
        counts = draw.integers(1, 9, len(tops))
        for k in (1, 2, 3, 20):
            def cost(ends):
                return sum(tops[e] * counts[s:e + 1].sum() for s, e in zip([0, *[x + 1 for x in ends[:-1]]], ends))
            best = min(cost([*c, len(tops) - 1]) for c in itertools.combinations(range(len(tops) - 1), min(k, len(tops)) - 1))
            ends = length_buckets.optimal_bounds(tops, counts, k)
            assert ends[-1] == len(tops) - 1 and len(ends) == min(k, len(tops)) and cost(ends) == best


def test_batches_keep_the_budget(spark):
    draw = random.Random(7)
    rows = [(i, "w " * draw.choice([0, 1, 5, 9, 30, 200]), "s") for i in range(500)] + [(800, None, "s"), (801, "w " * 3000, None), (3, "w", "s")]
    out = length_buckets.pack(_docs(spark, rows), buckets=4, token_budget=1000).collect()
    assert len(out) == len(rows)
    batches, tops = {}, {}
    for r in out:
        batches.setdefault((r.bucket, r.padded, r.batch), []).append(r.slot)
        tops[r.bucket] = max(tops.get(r.bucket, 0), r.length)
    for (bucket, padded, _), slots in batches.items():
        assert sorted(slots) == list(range(len(slots))) and padded == tops[bucket]
        assert len(slots) == 1 or len(slots) * padded <= 1000 or padded == 0
    for bucket in tops:  # only the last batch of a bucket may be short
        sizes = [len(s) for (b, _, n), s in sorted(batches.items()) if b == bucket]
        assert len(set(sizes[:-1])) <= 1
    assert length_buckets.pack(_docs(spark, rows).limit(0)).count() == 0


def test_long_lengths_share_bins(spark):
    rows = spark.range(0, 5000, 7).select((F.col("id") * F.col("id")).alias("n"))
    for r in rows.select("n", length_buckets.length_bin(F.col("n")).alias("b")).collect():
        assert r.b <= r.n and (r.n < 1024 and r.b == r.n or r.n >= 1024 and r.n - r.b < r.n / 512)


def test_moves_never_pass_a_quota():
    draw = random.Random(9)
    for _ in range(200):
        k = draw.randint(1, 5)
        room = [draw.randint(0, 6) for _ in range(k)]
        demand = {(s, t): draw.randint(0, 9) for s in range(k) for t in range(k) if s != t and draw.random() < 0.6}
        moves = label_shards.allowed_moves(demand, room)
        for s in range(k):
            net = sum(n for (_, t), n in moves.items() if t == s) - sum(n for (f, _), n in moves.items() if f == s)
            assert net <= room[s]
        assert all(0 <= n <= demand[m] for m, n in moves.items())


def test_shards_are_even_and_groups_together(spark):
    draw = random.Random(11)
    rows = [(i, f"group {draw.randint(0, 60)}", "s") for i in range(300)] + [(400 + i, f"own {i}", "s") for i in range(250)]
    rows += [(700 + i, "hot", "s") for i in range(200)] + [(990 + i, None, "s") for i in range(5)] + [(996, "", "s"), (997, "", "s"), (2, "group 1", "s")]
    report = []
    out = label_shards.shard(_docs(spark, rows), shards=4, report=report).collect()
    assert len(out) == len(rows) and report[-1]["moved"] == 0
    by_shard, by_link = {}, {}
    for r in out:
        by_shard.setdefault(r.shard, []).append(r.slot)
        if r.link is not None:
            by_link.setdefault(r.link, []).append(r.shard)
    sizes = [len(by_shard[s]) for s in range(4)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    hot = max(by_link.values(), key=len)
    assert len(hot) == 200 and len(set(hot)) <= 2  # larger than a quota of 189
    assert sum(len(set(s)) > 1 for s in by_link.values()) <= 4


def test_shards_of_copies_only_and_of_nothing(spark):
    rows = [(i, f"t{i % 3}", "s") for i in range(90)]
    out = label_shards.shard(_docs(spark, rows), shards=4).collect()
    counts = [sum(r.shard == s for r in out) for s in range(4)]
    assert max(counts) - min(counts) <= 1
    assert label_shards.shard(_docs(spark, rows).limit(0)).count() == 0


def test_full_shards_exchange_documents(spark):
    ring = {(0, 1): 2, (1, 2): 3, (2, 0): 2, (2, 1): 1}
    assert label_shards.allowed_moves(ring, [0, 0, 0]) == {(0, 1): 2, (1, 2): 3, (2, 0): 2, (2, 1): 1}
    for alone in (1, 5, 15):
        rows = [(i, f"group {i % 240}", "s") for i in range(720)] + [(1000 + i, f"own {i}", "s") for i in range(alone)]
        out = label_shards.shard(_docs(spark, rows)).collect()
        by_shard, by_link = [0] * label_shards.SHARDS, {}
        for r in out:
            by_shard[r.shard] += 1
            by_link.setdefault(r.link, set()).add(r.shard)
        assert len(out) == len(rows) and max(by_shard) - min(by_shard) <= 1
        assert sum(len(s) > 1 for s in by_link.values()) <= label_shards.SHARDS


def test_flow_of_many_patterns_ends():
    draw = random.Random(12)
    sources = [f"s{i}" for i in range(60)]
    for n in (4000, 8000):
        members = {p: tuple(draw.sample(sources, draw.randint(1, 4))) for p in range(n)}
        sizes = {p: draw.randint(1, 1000) for p in range(n)}
        held = {s: sum(sizes[p] for p in members if s in members[p]) for s in sources}
        quotas = {s: int(held[s] * draw.choice([0.1, 0.5, 1.2])) for s in sources}
        words = mixing_flow.min_cost_words(sizes, members, quotas, (0, 1))
        assert all(0 <= words[p] <= 2 * sizes[p] for p in sizes)
        assert sum(words.values()) <= sum(quotas.values())
        if sum(words.values()) < sum(quotas.values()):
            assert sum(w == 2 * sizes[p] for p, w in words.items()) > 0


def test_boundary_documents_carry_their_error():
    assert mixing_flow.rounded({"a": (1, 1), "b": (1, 1), "c": (5, 1)}, {"a": 0, "b": 0, "c": 1}) == {"a": True, "b": False, "c": True}
    assert mixing_flow.rounded({"a": (1, 3)}, {"a": 0}) == {"a": False}
