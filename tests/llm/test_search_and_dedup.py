"""Nearest neighbours, near-duplicates, language and personal data against brute force."""

import math
import random

import brute
import numpy as np
from pyspark.sql import functions as F

from stockloom.llm import bayes_dedup, components, multi_index, pii_boost, queries, string_kernel

VECTORS = "vec_id bigint, embedding array<float>, label int, score double, rank string"


def _nearest(rows, k=5):
    usable = {}
    for i, v in rows:
        if i is not None and v is not None and None not in v and len(v) == 8 and np.isfinite(v).all() and np.any(v):
            usable.setdefault((i, tuple(np.float32(v).tolist())), np.float32(v).astype(float))
    out = {}
    for (i, _), x in usable.items():
        if i % 50 == 0:
            near = sorted((-(x @ y) / math.sqrt((x @ x) * (y @ y)), j) for (j, _), y in usable.items() if j != i)
            out.setdefault(i, near[:k])
    return out


def _vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, 0.0, "x") for i, v in rows], VECTORS)


def test_small_tables_are_searched_exactly(spark):
    draw = np.random.default_rng(1)
    rows = [(i, draw.normal(size=8).tolist()) for i in range(300)]
    rows += [(i, rows[50][1]) for i in range(300, 360)] + [(400, None), (450, [0.0] * 8), (500, [float("nan")] + [1.0] * 7), (550, [None] * 8)]
    rows += [(600, [1.0, 2.0]), (650, []), (None, [1.0] * 8), (3, rows[3][1])]
    got = {}
    for r in multi_index.search(_vectors(spark, rows), F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    want = _nearest(rows)
    assert got.keys() == want.keys()
    for q, near in want.items():
        assert [got[q][i + 1][0] for i in range(len(near))] == [j for _, j in near], q
        assert all(abs(got[q][i + 1][1] + s) < 1e-9 for i, (s, _) in enumerate(near))


def test_few_candidates_and_none(spark):
    rows = [(0, [1.0] * 8), (7, [1.0] * 7 + [2.0])]
    out = multi_index.search(_vectors(spark, rows), F.col("vec_id") % 50 == 0).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in out] == [(0, 1, 7)]
    assert multi_index.search(_vectors(spark, []), F.col("vec_id") % 50 == 0).count() == 0


def test_recall_beyond_the_exact_size(spark):
    draw = np.random.default_rng(2)
    x = draw.normal(size=(6000, 8)).astype(np.float32)
    report = {}
    found = multi_index.search(_vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)]), F.col("vec_id") % 50 == 0, report=report).collect()
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    hits = 0
    for q in range(0, 6000, 50):
        s = unit @ unit[q]
        s[q] = -9
        hits += len({r.vec_id for r in found if r.query_id == q} & set(np.argsort(-s)[:5].tolist()))
    assert hits / 600 >= 0.9 and report["wanted"] < 6000


def test_walk_meets_cells_in_order_of_distance():
    draw = np.random.default_rng(3)
    for _ in range(50):
        a, b, sizes = draw.random(6), draw.random(5), draw.integers(0, 4, (6, 5))
        cells = multi_index.walk(a, b, sizes, 20)
        order = sorted((a[i] + b[j], i, j) for i in range(6) for j in range(5) if sizes[i, j])
        assert [(i, j) for _, i, j in order[: len(cells)]] == cells
        assert sum(sizes[c] for c in cells) >= min(20, sizes.sum())


TEXTS = "doc_id bigint, text string, key string, n string, component_id string"


def _edited(draw, words, share):
    return [draw.choice(["q", "r", "s"]) + str(draw.randint(0, 99)) if draw.random() < share else w for w in words]


def test_components_equal_all_pairs(spark):
    draw = random.Random(12)
    rows = []
    for g in range(25):
        base = [f"w{draw.randint(0, 400)}" for _ in range(draw.randint(3, 90))]
        for _ in range(draw.randint(1, 8)):
            rows.append((len(rows), " ".join(_edited(draw, base, draw.choice([0, 0.02, 0.05, 0.08, 0.12])))))
    hub = [f"h{i}" for i in range(80)]
    rows += [(1000 + i, " ".join(_edited(draw, hub, 0.06))) for i in range(120)]
    rows += [(2000, None), (2001, ""), (2002, " \n"), (2003, "One"), (2004, "one"), (2005, "One two"), (2006, "\xa0"), (2007, "one")]
    docs = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], TEXTS)
    for span in (2, 5):
        got = bayes_dedup.near_duplicates(docs, words=span).collect()
        want = brute.near_components(rows, span, 80)
        assert {r.doc_id: r.component_id for r in got} == want
        assert all(r.n_shingles == len(brute.shingles(t, span)) for r in got for i, t in rows if i == r.doc_id)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_repeated_rows_null_ids_and_no_rows(spark):
    rows = [(5, "a b c d"), (5, "a b c d"), (2, "A b c d"), (None, "a b c d"), (None, None), (None, "only here")]
    docs = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], TEXTS)
    out = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1, r.kept) for r in bayes_dedup.near_duplicates(docs, words=2).collect())
    assert out == [(-1, 0, -1, True), (-1, 1, -1, True), (-1, 3, 2, False), (2, 3, 2, True), (5, 3, 2, False), (5, 3, 2, False)]
    assert bayes_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_pruning_keeps_similar_pairs():
    limits = bayes_dedup.least_matches(80, 1e-6)
    assert list(limits) == sorted(limits) and limits[-1] < 0.8 * bayes_dedup.HASHES
    draw = np.random.default_rng(4)
    lost = 0
    for _ in range(3000):
        one = draw.integers(0, 2**32, bayes_dedup.HASHES, dtype=np.uint32)
        two = np.where(draw.random(bayes_dedup.HASHES) < 0.8, one, one + 1)
        lost += not len(bayes_dedup.may_be_similar(one, two[None], 80, 1e-6))
    assert lost == 0
    assert not len(bayes_dedup.may_be_similar(one, (one + 1)[None], 80, 1e-6))


def test_blocks_find_links_between_strays():
    """Classes outside the main component are compared with all the others, once each."""
    import pandas as pd

    words = [f"w{i}" for i in range(100)]
    texts = {"main": words[:60], "far1": words[30:], "far2": words[30:97], "else": words[:10] + words[90:]}
    rows = []
    for key, own in texts.items():
        s = bayes_dedup.shingle_set(" ".join(own), 2)
        sig = bayes_dedup.signature(s)
        rows.append((key.encode(), key.encode(), sig.tobytes(), np.zeros(bayes_dedup.BANDS, np.int64).tobytes(), s.tobytes(), key != "main"))
    frame = pd.DataFrame(rows, columns=["key", "comp", "sig", "bands", "shingles", "stray"])
    block = pd.concat([frame.assign(right=True), frame[frame["stray"]].assign(right=False)])
    assert bayes_dedup.block_links(block.assign(band=0), 80, 1e-6) == [(b"far1", b"far2")]
    assert bayes_dedup.block_links(block.assign(band=7), 80, 1e-6) == []  # left to the earlier band


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (3, 2), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 140)}, 201: 200}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


SYLLABLES = {"aa": "ka ro mi tu ne".split(), "bb": "sch ung ver ie ein".split(), "cc": "ção ê lh nh ou".split()}


def _prose(draw, lang):
    return " ".join("".join(draw.choices(SYLLABLES[lang], k=draw.randint(1, 4))) for _ in range(draw.randint(5, 60)))


def test_language_of_held_out_texts(spark):
    draw = random.Random(5)
    rows = [(i, _prose(draw, lang), lang, "x") for i in range(300) for lang in [draw.choice(list(SYLLABLES))]]
    rows += [(900, None, "aa", "x"), (901, "12 !", "bb", "x"), (902, "漢字", None, "x"), (903, rows[0][1] * 400, rows[0][2], "x"), (None, rows[1][1], rows[1][2], "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score string")
    out = string_kernel.held_out(F.col("doc_id"))
    model = string_kernel.fit(docs.where(~out), sample_rows=90, landmarks=24)
    got = {r.doc_id: r for r in docs.select("doc_id", out.alias("out"), string_kernel.predict(docs, model).alias("p")).select("doc_id", "out", "p.*").collect()}
    assert all(got[i].lang_pred == lang for i, t, lang, _ in rows if i not in (900, 901, 902))
    assert (got[900].lang_pred, got[901].lang_pred) == ("und", "und") and got[902].lang_pred in SYLLABLES
    assert all(0 <= r.score <= 1 for r in got.values())
    assert string_kernel.fit(docs.limit(0)) is None
    nothing = docs.limit(2).select(string_kernel.predict(docs, None).alias("p")).collect()
    assert [r.p.lang_pred for r in nothing] == ["und", "und"]


def test_kernel_counts_shared_grams():
    model = string_kernel.fit_rows([("abcab", "x"), ("bcd", "y"), ("Abc", "x")])
    grams = lambda t: {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    own = [grams(t) for t in ("abcab", "bcd", "abc")]
    got = model.kernel(["abcab", "cdx"])
    order = {t: i for i, t in enumerate(("abcab", "bcd", "abc"))}
    for row, text in enumerate(("abcab", "cdx")):
        for name, i in order.items():
            column = [("abcab", "bcd", "abc").index(n) for n in ("abcab", "bcd", "abc")][i]
            assert abs(got[row, column] - len(grams(text) & own[i]) / math.sqrt(len(grams(text)) * len(own[i]))) < 1e-6


def test_every_label_is_learnt():
    draw = random.Random(7)
    rows = [("".join(chr(0x4E00 + 40 * n + draw.randrange(40)) for _ in range(60)), f"l{n}") for n in range(230) for _ in range(3)]
    model = string_kernel.fit_rows(rows)
    assert len(model.languages) == 230 and model.weights.shape[1] == 230
    assert sum(model.languages[int(x)] == l for x, (_, l) in zip(model.scores([t for t, _ in rows[:300]]).argmax(1), rows)) >= 290


def test_scripts_are_told_apart_by_their_characters():
    draw = random.Random(8)
    starts = {"th": 0xE01, "ko": 0xAC00, "zh": 0x4E00, "el": 0x3B1, "ru": 0x430, "he": 0x5D0, "hi": 0x905, "en": 0x61}
    text = lambda n: "".join(chr(starts[n] + draw.randrange(20)) if draw.random() < 0.8 else " " for _ in range(40))
    model = string_kernel.fit_rows([(text(n), n) for _ in range(12) for n in starts])
    names = [n for _ in range(10) for n in starts]
    assert [model.languages[i] for i in model.scores([text(n) for n in names]).argmax(1)] == names


PARTS = ["a@b.co", "x@", "@", "..", "1.2.3.4", "256.1.1.1", "1.2.3.4.5", "+1 (415) 555-2671", "+1415", "4111 1111 1111 1111", "4111-1111-1111-1112",
         " ", "-", ".", "0", "12", "éà", "😀", "(at)", "b@c_d@e.fg", "\n", "(", ")", "+", "user (at) host (dot) com", "415-555-2671"]


def _personal(spark):
    draw = random.Random(4)
    rows = [(i, "".join(draw.choices(PARTS, k=draw.randint(0, 9)))) for i in range(400)]
    rows += [(901, None), (902, ""), (903, "a." * 9000 + "@b" + ".c" * 9000), (904, "1" * 40_000), (905, "+1 (415) 555-2671 " * 400), (906, "1." * 9000), (0, rows[0][1])]
    return rows, spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id bigint, text string, spans string, base string")


def test_base_spans_equal_plain_patterns(spark):
    rows, docs = _personal(spark)
    texts = dict(rows)
    out = pii_boost.detect(docs.repartition(3)).collect()
    assert len(out) == len(rows)
    for r in out:
        want = brute.base_spans(texts[r.doc_id])
        assert [(s.start, s.kind, s.end) for s in r.base] == want
        assert set(want) <= {(s.start, s.kind, s.end) for s in r.spans}
    assert pii_boost.detect(docs.limit(0)).count() == 0


def test_added_spans_and_redaction(spark):
    draw = random.Random(6)
    prose = lambda: " ".join(draw.choices(["the", "day", "was", "long", "4.0.", "12", "road"], k=30))
    rows = [(i, f"{prose()} +1 ({100 + i}) 555-{1000 + i} {prose()} me{i}@mail.example.org {prose()}") for i in range(200)]
    cases = [
        (900, "Call (415) 555-2671 now"), (901, "write to jane (at) mail (dot) org"), (902, "in 2019-2020 and 12/05/2021 or 10:30"),
        (903, "host 10[.]0[.]0[.]7 up"), (904, None), (905, "[EMAIL] no digits"), (906, "id 1234567890123456 x"),
    ]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows + cases], "doc_id bigint, text string, extra string")
    located = pii_boost.locate(docs).cache()
    model = pii_boost.train(spark, located)
    clean = pii_boost.redact(docs, model)
    assert clean.columns == docs.columns
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert texts[900] == "Call [PHONE] now" and texts[901] == "write to [EMAIL]" and texts[903] == "host [IP] up"
    assert texts[902] == cases[2][1] and texts[904] is None and texts[905] == cases[5][1] and texts[906] == cases[6][1]
    assert all(not brute.base_spans(texts[i]) and "[PHONE]" in texts[i] and "[EMAIL]" in texts[i] for i, _ in rows)
    forms = located.select(F.explode("base").alias("s")).select("s.f", model.column(F.col("s.f")).alias("score")).limit(50).collect()
    assert np.allclose([r.score for r in forms], model.scores(np.array([list(r.f) for r in forms])))


def test_selection_does_not_follow_the_size_of_the_corpus(spark):
    spans = lambda n: "day ".join(f"+1 ({100 + i % 800}) 555-{1000 + i % 9000} " for i in range(n))
    small = [(i, f"road 12 12 12 12 {spans(2)}me{i}@mail.example.org") for i in range(60)]
    clean = ["in 2019-2020 the", "on 2021-05-12 at", "on 12/05/2021, it", "ISBN 978-3-16-148410-0 is"]
    cases = spark.createDataFrame([(i, t) for i, t in enumerate([*clean, "Call (415) 555-2671 now"])], "doc_id bigint, text string")
    models = []
    for copies, length in ((1, 2), (40, 2), (1, 200)):  # the last has more spans of one kind only
        docs = spark.createDataFrame([(i, t.replace(spans(2), spans(length))) for i, t in small], "doc_id bigint, text string")
        located = pii_boost.locate(docs.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))).select(
            (F.col("doc_id") * 1000 + F.col("copy")).alias("doc_id"), "text"))
        models.append(pii_boost.train(spark, located))
        got = {r.doc_id: r.spans for r in pii_boost.select(pii_boost.locate(cases), models[-1]).collect()}
        assert [i for i in got if got[i]] == [len(clean)]
    assert models[0] == models[1]


def test_languages_of_long_texts_are_learnt(spark):
    draw = random.Random(8)
    long = lambda lang: " ".join(_prose(draw, lang) for _ in range(120))
    rows = [(long("aa"), "aa") for _ in range(6)] + [(_prose(draw, "bb"), "bb") for _ in range(20)] + [(long("cc"), "cc") for _ in range(6)]
    assert all((len(t) > string_kernel.SAMPLE_CHARS) == (lang != "bb") for t, lang in rows)
    docs = spark.createDataFrame(rows, "text string, lang string")
    for part in (docs, docs.where("lang <> 'bb'")):
        model = string_kernel.fit(part)
        got = part.select("lang", string_kernel.predict(part, model).alias("p")).collect()
        assert all(r.p.lang_pred == r.lang for r in got)


def test_base_spans_are_counted_by_kind(spark, tmp_path):
    texts = [
        (1, "a@b.c and d@e.f, 10.0.0.1"), (2, "10.0.0.1 10.0.0.2 10.0.0.3"), (3, "+1 415 555 2671, a@b.c"), (4, "nothing"), (5, None),
        (6, "4111 1111 1111 1111"),
    ]
    spark.createDataFrame(texts, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.QUERIES["op4_pii_boost"](spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone) for r in found} == {
        1: (2, 1, 0, 0), 2: (0, 3, 0, 0), 3: (1, 0, 0, 1), 4: (0, 0, 0, 0), 5: (0, 0, 0, 0), 6: (0, 0, 1, 0),
    }
