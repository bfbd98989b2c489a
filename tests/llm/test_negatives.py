"""Hard negatives against plain lists."""

import numpy as np
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from stockloom.llm import slot_negatives

VECTORS = "vec_id bigint, embedding array<float>, label int, score double, anchor string, slot int"


def _table(spark, rows):
    return spark.createDataFrame([(i, v, l, 0.0, "x", 1) for i, v, l in rows], VECTORS)


def _brute(rows, anchors, positives=5, negatives=10):
    usable = {}
    for i, v, l in rows:
        if i is not None and v and l is not None and None not in v and np.isfinite(v).all() and len(v) == 4:
            usable[(i, tuple(int(np.floor(256.0 * float(np.float32(x)))) for x in v), l)] = None
    out = set()
    for a, x, la in usable:
        if not anchors(a):
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y)), i, l) for i, y, l in usable if i != a)
        for s, p, _ in [r for r in scored if r[2] == la][:positives]:
            inside = [r for r in scored if r[2] != la and 30 * -s <= 100 * -r[0] <= 90 * -s]
            out |= {(a, p, n + 1, r[1], -s, -r[0]) for n, r in enumerate(inside[:negatives])}
    return out


def _mined(df, **options):
    rows = slot_negatives.mine(df, F.col("vec_id") % 10 == 0, **options).collect()
    got = {(r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in rows}
    assert len(got) == len(rows)
    return got


def test_windows_equal_plain_lists(spark):
    draw = np.random.default_rng(5)
    for width in (0.02, 0.6):  # small components make ties, zero and negative scores
        rows = [(i, (draw.normal(size=4) * width).tolist(), int(draw.integers(0, 3))) for i in range(240)]
        rows += [rows[3], rows[10], (500, None, 1), (510, [0.1] * 4, None), (520, [None] * 4, 1), (530, [float("inf")] * 4, 1)]
        rows += [(None, [0.5] * 4, 1), (540, [], 1), (550, [0.5] * 3, 1), (560, rows[20][1], rows[20][2]), (570, [0.0] * 4, 7)]
        want = _brute(rows, lambda i: i % 10 == 0)
        assert len(want) > 100
        assert _mined(_table(spark, rows)) == want
        assert _mined(_table(spark, rows).repartition(7), anchors_at_once=6) == want


def test_slots_keep_their_first_rows():
    draw = np.random.default_rng(6)
    batches = [list(range(0, 90)), list(range(90, 300))]
    kept = slot_negatives._Kept(3)
    kept.limit = 20
    key, score = draw.integers(0, 4, 300), draw.integers(0, 9, 300)
    for b in batches:
        kept.add(key[b], score[b], np.array(b))
    got = list(zip(*[x.tolist() for x in kept.cut()]))
    want = [(k, s, i) for k in range(4) for s, i in [(-a, b) for a, b in sorted((-score[j], j) for j in range(300) if key[j] == k)[:3]]]
    assert got == want
    assert slot_negatives.limits([100, 50, 100, -7]) == ([90, 45, -7], [0, 1, 0, 2], [30, 15, 30, -2])


def test_empty_tables_and_missing_partners(spark):
    assert _mined(_table(spark, [])) == set()
    assert _mined(_table(spark, [(1, [1.0] * 4, 0), (2, [1.0] * 4, 0)])) == set()
    assert _mined(_table(spark, [(0, [1.0] * 4, 0), (2, [1.0] * 4, 1)])) == set()  # no positive
    assert _mined(_table(spark, [(0, [1.0] * 4, 0), (2, [1.0] * 4, 0)])) == set()  # no negative


def test_large_components_stay_exact(spark):
    rows = [(0, [3e6, 1.0, 0.0, 0.0], 0), (1, [2e5, 7.0, 0.0, 0.0], 0), (2, [1e5, 3.0, 0.0, 0.0], 1), (3, [9e4, 0.0, 5.0, 0.0], 1)]
    want = _brute(rows, lambda i: i == 0)
    assert len(want) == 2 and _mined(_table(spark, rows)) == want
    with pytest.raises(PythonException):
        _mined(_table(spark, [(0, [3e30] * 4, 0), (1, [3e30] * 4, 0)]))
