"""Random inputs against direct models in plain Python."""

import random
import re
from decimal import Decimal

from pyspark.sql import functions as F

from stockloom import schemas
from stockloom.functions.text import SIZE_ALIASES, SIZE_TOKENS, STOPWORDS
from stockloom.operators import catalog, planning

WORDS = ["red", "blue", "bolt", "gear", "rod", "wide", "a.b", "x%y"]


def _catalogue(rng, count):
    """Every third product shares one name and color."""
    rows = []
    for i in range(count):
        name = "Red Bolt" if i % 3 == 0 else " ".join(rng.choice(WORDS).title() for _ in range(rng.choice([1, 2, 3])))
        color = "Red" if i % 3 == 0 else rng.choice(["Blue", "Green"])
        rows.append((
            f"P{i:03d}", f"ST-{i % 5}", f"K{i:03d}", name, rng.choice(["Tools", "Parts"]), "sub", "Acme", color,
            rng.choice(["S", "M", "XL", "9"]), "any", Decimal(1), Decimal(1), "", "", "", rng.choice(["Work", "Home"]), "Iron",
            rng.choice(["active"] * 5 + ["inactive"]),
        ))
    return rows


def _queries(rng):
    texts = ["red bolt", "Red", "medium red bolt", "the rod", "b_lt", "%%", "lu%g", "a.b", "st-3", "k00", "x\\%y", "extra large gear",
             "blue wide rod iron", "zz", "acme xl", "find red bolt please"]
    out = [(f"q{i}", t, rng.choice([None, None, "Tools"]), rng.choice([None, None, "Work"])) for i, t in enumerate(texts)]
    return out + [("n0", None, "Parts", None), ("n1", None, None, "Home"), ("n2", None, "Tools", "Work"), ("n3", None, None, None),
                  ("d0", "red bolt", None, None), ("d1", "red bolt", None, None)]


def _like(q):
    out, i = "", 0
    while i < len(q):
        if q[i] == "\\" and i + 1 < len(q):
            i += 1
            out += re.escape(q[i])
        else:
            out += {"%": ".*", "_": "."}.get(q[i], re.escape(q[i]))
        i += 1
    return re.compile(f".*{out}.*", re.I | re.S)


def _substring_model(rows, queries, limit):
    got = {}
    for qid, q, cat, occ in queries:
        hits = [r for r in rows if r[17] == "active" and (cat is None or r[4] == cat) and (occ is None or r[15] == occ)
                and (q is None or any(_like(q).fullmatch(t) for t in (r[3], r[1], r[2])))]
        hits.sort(key=lambda r: (r[4], r[3], r[7], r[8], r[2]))
        if hits:
            got[qid] = [r[0] for r in hits[:limit]]
    return got


def _words(text):
    return re.sub("[^a-z0-9]+", " ", text.lower()).split()


def _token_model(rows, queries, limit, strict=False):
    got = {}
    for qid, q, cat, occ in queries:
        if q is None:
            continue
        tokens = []
        for w in _words(q):
            t = SIZE_ALIASES.get(w, w)
            if w not in STOPWORDS and t and t not in tokens:
                tokens.append(t)
        scored = []
        for r in rows:
            if r[17] != "active" or (strict and ((cat and r[4] != cat) or (occ and r[15] != occ))):
                continue
            held = set(_words(" ".join([r[3], r[1], r[2], r[4], r[5], r[6], r[7], r[8], r[15], r[16]])))
            n = sum(r[8].lower() == t if t in SIZE_TOKENS else t in held for t in tokens)
            if n and (n >= 2 or len(tokens) <= 2):
                score = 10 * n + 20 * (q.lower() in r[3].lower()) + 10 * (r[3].lower() in q.lower())
                scored.append((-score, r[3], r[7], r[8], r[2], r[0]))
        if scored:
            got[qid] = [s[-1] for s in sorted(scored)[:limit]]
    return got


def _lists(hits):
    got = {}
    for r in hits.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.product_id)
    return got


def test_search_against_a_direct_model(spark):
    rng = random.Random(3)
    rows, queries = _catalogue(rng, 90), _queries(rng)
    products = spark.createDataFrame(rows, schemas.PRODUCTS)
    asked = spark.createDataFrame(queries, "query_id string, q string, category string, occasion string")
    for limit in (4, 100):
        assert _lists(catalog.substring_hits(products, asked, limit)) == _substring_model(rows, queries, limit)
        assert _lists(catalog.token_hits(products, asked, limit)) == _token_model(rows, queries, limit)
    assert _lists(catalog.token_hits(products, asked, 5, strict_filters=True)) == _token_model(rows, queries, 5, strict=True)


def test_search_one(spark):
    rows = _catalogue(random.Random(4), 30)
    products = spark.createDataFrame(rows, schemas.PRODUCTS)
    for q in ("bolt", "the bolt in red", "zz"):
        query = [("x", q, None, None)]
        want = _substring_model(rows, query, 6) or _token_model(rows, query, 6)
        assert [r.product_id for r in catalog.search_one(products, q, limit=6).collect()] == want.get("x", [])


def test_recommendations_against_all_pairs(spark):
    rng = random.Random(8)
    stores = list(range(24))
    cats = {f"s{i}": ["a", "b"] if i % 2 else ["a"] for i in range(4)}
    perf = {(s, st): (rng.choice([30, 65, 70, 90]), rng.choice([0, 1.5, 5, 6])) for s in stores for st in cats if rng.random() < 0.9}
    stock = {(s, st): rng.choice([0, 0, 2, 3, 8]) for s in stores for st in cats if rng.random() < 0.8}
    weekly = spark.createDataFrame(
        [(s, st, Decimal(a), Decimal(str(w))) for (s, st), (a, w) in perf.items()],
        "store_id int, style_id string, sell_through_pct decimal(5,2), weeks_of_supply decimal(6,2)",
    )
    # A second category comes from another SKU of the style that no store holds.
    prods = spark.createDataFrame([(f"{st}{c}", st, c) for st, cs in cats.items() for c in cs], "sku_id string, style_id string, category string")
    inv = spark.createDataFrame([(s, f"{st}a", n) for (s, st), n in stock.items()], "store_id int, sku_id string, available_qty int")
    dims = spark.createDataFrame([(s, f"n{s}") for s in stores], "store_id int, store_name string")
    rows = [(s, st, c, a, w) for (s, st), (a, w) in perf.items() for c in cats[st]]
    full = []
    for s, st, c, a, w in rows:
        if a >= 70 and w <= 1.5:
            full.append((0, "reorder", st, 99, s, c, 4))
        if a <= 35 and w >= 5:
            full.append((1, "markdown_adjustment", st, s, 99, c, None))
        if a >= 65 and w <= 1.5 and stock.get((s, st), 0) == 0:
            for s2, st2, _, _, _ in rows:
                if st2 == st and s2 != s and stock.get((s2, st), 0) >= 3:
                    full.append((0, "transfer", st, s2, s, c, min(stock[(s2, st)], 3)))
    full.sort(key=lambda r: r[:6])
    assert len(full) > 100
    for limit in (1, 13, 60, 100):
        report = planning.recommendations(weekly, dims, prods, inv, limit=limit).collect()
        got = [(0 if r.priority == "high" else 1, r.action_type, r.style_id, 99 if r.source_store_id is None else r.source_store_id,
                99 if r.target_store_id is None else r.target_store_id, r.category, r.recommended_units) for r in report]
        assert got == full[:limit]
    only = planning.transfers(weekly, dims, prods, inv, limit=50)
    assert [(r.source_store_id, r.target_store_id) for r in only.collect()] == [r[3:5] for r in full if r[1] == "transfer"][:50]
