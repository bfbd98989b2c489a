"""Prefix targets, prefix counts and fertility against plain Python."""

import hashlib
import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from stockloom.llm import fertility, prefix_counts, prefix_targets

TURNS = "conv_id bigint, turn bigint, role string, text string, formatted string"
DOCS = "doc_id bigint, text string, kept string, n_words string"


def _conversations():
    e = prefix_targets.ESCAPE
    return [
        (1, 0, "user", "hi", "x"), (1, 1, "assistant", "a<|im_end|>\nb", "x"), (1, 2, "user", None, "x"),
        (1, 3, "assistant", f"{e}{e}<{e}|</s>[INST", "x"), (1, 4, "user", "tail", "x"),
        (2, 0, "user", "no reply", None), (3, 1, "assistant", "", None), (3, 1, "assistant", "", None),
        (3, 1, None, "tie\nof lines", None), (4, None, "to ol\n<|", "<<SYS>>\n[/INST]<", None), (None, 0, "assistant", "é😀", None),
    ]


def _expected(rows):
    groups = {}
    for conv, turn, role, text, _ in rows:
        groups.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in groups.items():
        turns.sort()
        whole = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        examples = sum(r == "assistant" for _, _, r, _ in turns) + (turns[-1][2] != "assistant")
        out[conv] = (len(turns), sha(whole), len(loss), sha(loss), examples)
    return out


def test_conversations_read_back(spark):
    rows = _conversations()
    got = prefix_targets.digest(prefix_targets.expand(spark.createDataFrame(rows, TURNS))).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.n_examples) for r in got} == _expected(rows)


def test_each_reply_is_the_only_trained_text(spark):
    rows = spark.createDataFrame(_conversations(), TURNS)
    own = prefix_targets.expand(rows).where("conv_id = 1").orderBy("example").collect()
    assert [r.example for r in own] == [0, 1, 2] and own[2].loss_start == own[2].loss_end
    assert own[1].formatted.startswith(own[0].formatted) and own[2].formatted.startswith(own[1].formatted)
    assert own[0].formatted[own[0].loss_start : own[0].loss_end] == f"a<{prefix_targets.ESCAPE}|im_end|>\nb"
    assert prefix_targets.expand(rows.limit(0)).count() == 0


def test_escaping_is_reversible_and_leaves_no_control_string(spark):
    draw = random.Random(3)
    parts = [*prefix_targets.CONTROL, prefix_targets.ESCAPE, "<", "|", "[", "im_end", "\n", "é"]
    texts = ["".join(draw.choices(parts, k=draw.randint(0, 8))) for _ in range(400)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", prefix_targets.escape(F.col("t")).alias("e"))
    for r in rows.withColumn("back", prefix_targets.unescape(F.col("e"))).collect():
        assert r.back == r.t
        assert not any(c in r.e for c in prefix_targets.CONTROL)


@pytest.fixture(scope="module")
def counter():
    return prefix_counts.PrefixCounter()


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: len(own.encode(text, add_special_tokens=False).ids)


PIECES = ["a", "the", " ", "  ", "\n", "\n\n", "'re", "'s", "'ll", "é", "中", "😀", "<|endoftext|>", "<|end", "!", "12", ".", "\t",
          "\xa0", "　", "ing", "HELLO", "    ", "xxxxx", "=====", "\x85", "\x1c"]


def test_counts_equal_the_library_at_every_prefix(counter, library):
    draw = random.Random(1)
    for _ in range(400):
        text = "".join(draw.choices(PIECES, k=draw.randint(0, 10)))
        got = np.cumsum(np.frombuffer(counter.steps_of(text), np.int8).astype(int)).tolist()
        assert got == [library(text[:i]) for i in range(1, len(text) + 1)], repr(text)


def test_long_runs_are_counted_whole(counter, library):
    for text in ("a" * 20_000, " " * 3_000 + "x", "é$" * 3_000, "x" + " " * 200_000, "\n" * 200_000, "a" + " \t\n" * 60_000):
        assert np.frombuffer(counter.steps_of(text), np.int8).astype(int).sum() == library(text)


def test_stored_counts_answer_questions(spark, library):
    texts = [None, "", "the cat\n\n sat <|endoftext|> on é😀", "word " * 300, "word " * 300]
    rows = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], DOCS)
    indexed = prefix_counts.index(rows)
    for r in prefix_counts.answer(indexed, budget=5, chars=9).collect():
        text = texts[r.doc_id] or ""
        prefixes = [library(text[:i]) for i in range(len(text) + 1)] if len(text) < 100 else None
        assert (r.n_bytes, r.n_tokens) == (len(text.encode()), library(text))
        assert r.prefix_tokens == library(text[:9])
        if prefixes:
            assert r.budget_chars == max(i for i, n in enumerate(prefixes) if n <= 5)
    assert prefix_counts.answer(prefix_counts.index(rows.limit(0)), budget=5).count() == 0


def test_fertility_measures(spark):
    texts = [
        None, "", " \n\t", "a b c d e f a b c d e", "one\none\n\n \none \n", "#$ x|<y> & 100%", "é\xa0b\x85c \x1cd", "The day was long and the road was dry. " * 30,
        "thing### word$$$ many%%% thing&&& other*** " * 60, "中文文字" * 40,
    ]
    rows = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate([*texts, texts[3]])], DOCS)
    for r in rows.select("doc_id", fertility.assess(F.col("text")).alias("m")).select("doc_id", "m.*").collect():
        words, chars, symbols, lines, repeats = brute.base_quality([*texts, texts[3]][r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (words, chars, symbols, lines, repeats)
        assert r.base_failed == (words < 10 or 100 * repeats > 20 * words)
        assert not (r.base_failed and r.kept)
    assert rows.limit(0).select(fertility.assess(F.col("text")).alias("m")).count() == 0


def test_repeated_words_match_brute_force():
    draw = random.Random(5)
    for _ in range(300):
        text = " ".join(draw.choices("abc", k=draw.randint(0, 30)))
        assert fertility.repeated_words(text.encode().split()) == brute.base_quality(text)[4]


def test_bands_follow_the_script():
    assert [fertility.script_of(t) for t in ("abc é", "Ωμέγα", "привет", "中文 a", "かな", "한국어", "123")] == [
        "latin", "greek", "cyrillic", "han", "kana", "hangul", "other"]
    band = fertility.BANDS["latin"]
    assert fertility.outside_band(band, 1000, 4.0, 4.0, 0.0, 7.0) == []
    assert fertility.outside_band(band, 1000, 4.0, 1.5, 0.5, 3.0) == ["byte_chars", "fallback", "entropy"]


def test_windows_are_compared_in_words_where_hashes_agree(monkeypatch):
    monkeypatch.setattr(fertility, "_MIX", np.int64(0))  # a window's hash is that of its last word
    rng = random.Random(8)
    for _ in range(200):
        text = " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 40)))
        assert fertility.repeated_words(text.encode().split()) == brute.base_quality(text)[4]


def test_script_of_long_ascii_is_not_looked_up(monkeypatch):
    monkeypatch.setattr(fertility, "_script_table", lambda: pytest.fail("looked up"))
    assert [fertility.script_of(t) for t in ("", "12 3", "abc " * 1000)] == ["other", "other", "latin"]
