"""The stored gram index and the token search that lists no pairs."""

import random

import shop
from pyspark.sql import functions as F

from stockloom.operators import catalog, token_search
from stockloom.operators.gram_index import GramIndex
from stockloom.session import scratch_dir


def _texts(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "text string")


def _matches(spark, index, queries):
    return {(r.q, r.text) for r in index.matches(spark.createDataFrame([(q,) for q in queries], "q string")).collect()}


def test_an_index_grows_by_batches(spark):
    draw = random.Random(3)
    texts = sorted({"".join(draw.choice("abé -") for _ in range(draw.randint(0, 9))) for _ in range(120)})
    queries = ["a", "ab", "bé", "a-b", "ab a", "É", "zz", "a_b", "b%a", "%a%", "-", "abab"]
    import re

    def like(q, t):
        pattern = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in q)
        return re.search(pattern, t, re.I | re.S) is not None

    index = GramIndex(spark, scratch_dir(spark, "index"))
    assert not index.built() and _matches(spark, index, queries) == set()
    index.extend(_texts(spark, texts[:70] + [None, texts[0]]))
    assert _matches(spark, index, queries) == {(q, t) for q in queries for t in texts[:70] if like(q, t)}
    # A batch that was broken off before its texts were written does not count and is written over.
    _texts(spark, ["abab"]).withColumn("gram", F.lit("aba")).withColumn("bucket", F.lit(1)).write.partitionBy("bucket").parquet(f"{index.path}/grams/batch=1")
    index.extend(_texts(spark, texts[50:]))
    assert _matches(spark, index, queries) == {(q, t) for q in queries for t in texts if like(q, t)}
    assert sorted(r.text for r in index.texts().collect()) == texts
    before = index.texts().inputFiles()
    assert _matches(spark, GramIndex(spark, index.path), ["ab"]) and index.texts().inputFiles() == before


def test_a_second_search_reads_the_stored_index(spark):
    products, root = shop.products(spark), scratch_dir(spark, "root")
    asked = spark.createDataFrame([("x", "a", None, None), ("y", "dress", None, None)], "query_id string, q string, category string, occasion string")
    first = catalog.stored_index(products, root)
    files = first._read("grams", "gram string, text string, bucket int").inputFiles()
    again = catalog.stored_index(products.repartition(3), root)
    assert again.path == first.path and again._read("grams", "gram string, text string, bucket int").inputFiles() == files
    hits = [sorted(map(str, catalog.substring_hits(products, asked, 20, i).collect())) for i in (None, first)]
    assert hits[0] == hits[1] and hits[0]
    other = catalog.stored_index(products.withColumn("product_name", F.concat("product_name", F.lit(" new"))), root)
    assert other.path != first.path


def test_token_search_in_chunks_and_rounds(spark, monkeypatch):
    """Bars, rounds and many tasks do not change the answer, and no task hands on more than the limit."""
    draw = random.Random(4)
    words = ["red", "blue", "dress", "coat", "silk", "long", "s", "xl"]
    rows = [
        (f"p{i}", draw.choice([None, " ".join(draw.sample(words[:6], draw.randint(1, 3)))]), draw.choice(["red", "blue", None]), draw.choice(["S", "XL", "9"]),
         f"k{i}", draw.choice(["A", "B"]), draw.sample(words, draw.randint(0, 5)))
        for i in range(400)
    ]
    shelf = spark.createDataFrame(rows, "product_id string, product_name string, color string, size string, sku_id string, category string, held array<string>")
    asks = [(i, " ".join(t), t, draw.choice([None, "A", "Z"])) for i, t in enumerate(draw.sample(words, draw.randint(0, 4)) for _ in range(40))]
    asked = spark.createDataFrame(asks, "ask bigint, text string, tokens array<string>, w_category string")
    want = set()
    for ask, text, tokens, category in asks:
        scored = []
        for pid, name, color, size, sku, cat, held in rows:
            m = len(set(tokens) & set(held))
            if m >= (2 if len(tokens) >= 3 else 1) and category in (None, cat):
                low = None if name is None else name.lower()
                score = 10 * m + (20 if low is not None and text in low else 0) + (10 if low is not None and low in text else 0)
                scored.append((-score, (name is not None, name or ""), (color is not None, color or ""), size, sku, pid, m))
        want |= {(ask, r[5], r[6], -r[0], n + 1) for n, r in enumerate(sorted(scored)[:7])}
    assert len(want) > 100
    for parts, at_once in ((1, 1000), (6, 9)):
        got = token_search.best_products(shelf.repartition(parts), asked, 7, ["category"], at_once).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    held = shelf.repartition(5).withColumn("lower_name", F.lower("product_name"))
    bars = {r.ask: r.bar for r in token_search._bars(held, asked.where(F.size("tokens") > 0), 7, ["category"]).collect()}
    block = [{"ask": a, "text": x, "tokens": t, "wanted": [c], "bar": bars.get(a) and (bars[a].score, tuple(token_search._first_nulls(bars[a][k]) for k in token_search.TIE_ORDER))}
             for a, x, t, c in asks if t]
    handed = token_search._scored(held, block, 7, ["category"]).groupBy("ask").count().collect()
    assert max(r["count"] for r in handed) <= 5 * 7
