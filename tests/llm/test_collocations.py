"""Collocations against plain counting."""

import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from stockloom.llm import collocations

DOCS = "text string, lang string, phrase string, n int, k int, bucket int"


def _table(spark, rows):
    return spark.createDataFrame([(t, l, "x", 1, 2, 3) for t, l in rows], DOCS)


def _pieces(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def _brute(rows, least, most=5, top=2000, percent=100):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for w in _pieces(text):
            n[lang] += len(w)
            for k in range(1, most + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    frequent = {p: c for p, c in f.items() if len(p[1]) > 1 and c >= least}
    covered = Counter()
    for (lang, p), c in frequent.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                covered[lang, p[i : i + k]] = max(covered[lang, p[i : i + k]], c)
    found = {}
    for (lang, p), a in frequent.items():
        if not (covered[lang, p] and 100 * covered[lang, p] >= percent * a):
            score, cut = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:cut]], f[lang, p[cut:]]))
    out = set()
    for lang, own in found.items():
        for i, (s, a, p, l, r) in enumerate(sorted(own)[:top]):
            out.add((lang, i + 1, p.decode(), -a, l, r, n[lang], -s))
    return out


def _mined(df, **options):
    rows = [tuple(r) for r in collocations.mine(df, **options).collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


def _corpus(seed, texts):
    draw = random.Random(seed)
    words = ["a", "A", "é", "É", "b\x00", "\x85w", "of", "the", " ", "x-y", "日本", "b", "1,0", "{|}", "'"]
    rows = []
    for _ in range(texts):
        text = "".join(draw.choice(words) + draw.choice([" ", " ", "  ", "\t", " ", ". ", "\n", ";", "\x0b", " "]) for _ in range(draw.randint(0, 60)))
        rows.append((text + draw.choice(["", "New York City hall", "to be or not to be", "a a a a a a a"]), draw.choice(["en", "en", "fr", None, "und"])))
    return rows + [(None, "en"), ("", None), (" . \n", "de"), rows[0], rows[0], ("z " * 3000 + "end", "fr"), ("w" * 100_000, "en")]


def test_phrases_equal_plain_counts(spark):
    rows = _corpus(3, 300)
    want = _brute(rows, 12)
    assert len(want) > 100 and len({w[0] for w in want}) == 3
    assert _mined(_table(spark, rows), least=12) == want
    assert _mined(_table(spark, rows).repartition(5), least=12, top=9, shard=40) == {w for w in want if w[1] <= 9}


def test_other_lengths_and_coverage(spark):
    rows = _corpus(4, 80)
    assert _mined(_table(spark, rows), least=5, most=3, percent=60) == _brute(rows, 5, most=3, percent=60)


def test_nothing_frequent(spark):
    assert _mined(_table(spark, [])) == set()
    assert _mined(_table(spark, [(None, None), ("", "en"), ("a b c", "en")])) == set()
    assert _mined(_table(spark, [("a a", "en")] * 100)) == {("en", 1, "a a", 100, 200, 200, 200, 500)}


def test_blocks_hold_every_word_once():
    rows = _corpus(5, 40)
    texts, langs = pa.array([t for t, _ in rows]), np.arange(len(rows))
    want = [(i, w) for i, (t, _) in enumerate(rows) for p in _pieces(t) for w in p]
    pieces = [p for t, _ in rows for p in _pieces(t) if p]
    for size in (1, 7, 64, 1000, 10**7):
        got, own = [], []
        for block in collocations.blocks(texts, langs, size):
            words = block.words.to_pylist()
            got += [(int(i), words[w]) for i, w in zip(block.lang, block.ids)]
            for p in np.unique(block.piece):
                own.append([words[w] for w in block.ids[block.piece == p]])
        assert got == want and own == pieces
    for start in (0, 5, len(rows) - 8):
        got = [(int(i), w) for b in collocations.blocks(texts.slice(start, 8), langs[start : start + 8]) for i, w in zip(b.lang, b.words.take(pa.array(b.ids)).to_pylist())]
        assert got == [x for x in want if start <= x[0] < start + 8]


def test_tries_find_exactly_their_phrases():
    draw = random.Random(6)
    words = [f"w{i}" for i in range(60)]
    phrases = sorted({(draw.choice("ab"), " ".join(draw.choice(words[: draw.choice([3, 60])]) for _ in range(draw.randint(1, 5)))) for _ in range(3000)})
    trie = collocations.build_trie([l for l, _ in phrases], [p for _, p in phrases])
    texts = [" ".join(draw.choice(words[:4] + ["new"]) for _ in range(50)) for _ in range(40)] + [p for _, p in phrases]
    names = [draw.choice("abc") for _ in texts]
    counts = np.zeros(len(trie["accept"]), np.int64)
    own = [sorted(set(names)), [sorted(set(names)).index(n) for n in names]]
    for block in collocations.blocks(pa.array(texts), np.array(own[1]), 500):
        collocations.count_trie(block, own[0], trie, pa.array(trie["words"], pa.large_string()), counts)
    want = Counter()
    for t, n in zip(texts, names):
        w = t.split(" ")
        want.update((n, " ".join(w[i : i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    got = {phrases[a]: c for a, c in zip(trie["accept"], counts) if a >= 0}
    assert got == {p: want[p] for p in phrases}


def test_large_scores_are_exact(spark):
    a, n, l, r = 10**10 + 7, 10**12 + 39, 10**11 + 3, 3 * 10**10 + 1
    got = spark.range(1).select(F.lit(a).alias("a"), F.lit(n).alias("n"), F.lit(l).alias("l"), F.lit(r).alias("r")).select(collocations.score())
    assert got.first()[0] == 1000 * a * n // (l * r)


def test_texts_are_handed_over_in_short_batches(spark, monkeypatch):
    name, seen, count = "spark.sql.execution.arrow.maxRecordsPerBatch", [], collocations.phrase_counts

    def watched(*args):
        seen.append(int(spark.conf.get(name)))
        return count(*args)

    monkeypatch.setattr(collocations, "phrase_counts", watched)
    before = spark.conf.get(name)
    collocations.mine(_table(spark, [("a b a b", "x")] * 3), 3).count()
    assert seen == [collocations.TEXTS] and spark.conf.get(name) == before


def test_the_time_of_a_trie_does_not_grow_with_the_square_of_its_phrases():
    draw = random.Random(9)
    phrases = set()
    while len(phrases) < 100_000:
        phrases.add(" ".join(f"w{int(12_000 * draw.random() ** 3)}" for _ in range(draw.choice([1, 2, 2, 3, 4]))))
    phrases = sorted(phrases)
    began = time.process_time()
    trie = collocations.build_trie(["x"] * len(phrases), phrases)
    assert time.process_time() - began < 12
    assert sorted(trie["accept"][trie["accept"] >= 0].tolist()) == list(range(len(phrases))) and len(trie["owner"]) < 8 * len(phrases)


def test_many_tries_are_counted_in_few_passes(spark, monkeypatch):
    rows, seen, write = _corpus(7, 120), [], collocations.written

    def watched(df, path):
        seen.append(path.rsplit("/", 1)[1].split("-")[0])
        return write(df, path)

    monkeypatch.setattr(collocations, "written", watched)
    want = _brute(rows, 6)
    assert len(want) > 60
    assert _mined(_table(spark, rows).repartition(3), least=6, shard=10) == want
    assert 1 < seen.count("counts") < 6


def test_buckets_of_any_count_are_summed_exactly():
    draw = np.random.default_rng(8)
    for k, bits in ((1, 16), (2, 16), (2, 30), (5, 26)):
        bucket = np.r_[draw.integers(0, 1 << collocations._bits(k, bits), 3000), np.repeat([0, (1 << collocations._bits(k, bits)) - 1], [4095, 9001])].astype(np.uint32)
        got = Counter()
        for part in np.array_split(draw.permutation(bucket), 3):
            for rows in collocations._pages({k: [part]}, bits):
                for page, own in rows.to_pandas().groupby("page"):
                    found = collocations._total(own, bits, 1)
                    got.update(dict(zip(found["bucket"].tolist(), found["n"].tolist())))
        assert got == Counter(bucket.tolist())
