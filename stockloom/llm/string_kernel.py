"""Language identification with a string kernel.

The kernel of two texts is the number of n-grams of one to three characters present in both,
over the root of the product of their numbers of n-grams. Landmark texts approximate it
(Nyström), one ridge regression per language separates it, and texts are scored in batches: one
product gives the kernel to all landmarks, a second the scores of all languages.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.plans.topk import top_k

SAMPLE_ROWS = 1600  # labelled texts the model is fitted on, shared equally by the languages
SAMPLE_CHARS = 10_000  # longer texts are chosen where a language lacks shorter ones; all texts are scored whole
LANDMARKS = 256
GRAM_BITS = 21  # n-grams of any characters are told apart by so many bits of a hash
CELLS = 64  # cells of a language's digests, each cut to the quota before the language is
RIDGE = 1e-3
BATCH = 128
UNKNOWN = "und"


_GRAMS = 1 << GRAM_BITS
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _gram_ids(text: str) -> np.ndarray:
    """Ids of all n-grams of a lower-cased text, repeats included: hashes of one to three code points."""
    one = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.uint64) + np.uint64(1)
    two = one[:-1] * _STEP + one[1:]
    three = two[:-1] * _STEP + one[2:]
    x = np.concatenate([one, two, three])
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return (x >> np.uint64(64 - GRAM_BITS)).astype(np.int64)


@dataclass
class Model:
    """A fitted classifier; its size is bounded by the parameters, not by the corpus."""

    languages: list[str]
    column: np.ndarray  # n-gram -> column of the landmark matrix, -1 if no landmark has it
    landmarks: np.ndarray  # landmark x n-gram presence
    sizes: np.ndarray  # n-grams of each landmark
    weights: np.ndarray  # landmark x language
    bias: np.ndarray

    def presence(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Presence of the landmarks' n-grams in each text, and the number of all its n-grams."""
        rows = np.zeros((len(texts), self.landmarks.shape[1]), np.float32)
        sizes = np.ones(len(texts))
        last = np.zeros(_GRAMS, np.int64)
        for i, text in enumerate(texts):
            ids = _gram_ids(text)
            at = np.arange(len(ids))
            last[ids] = at
            own = ids[last[ids] == at]  # each n-gram once
            sizes[i] = max(len(own), 1)
            known = self.column[own]
            rows[i, known[known >= 0]] = 1
        return rows, sizes

    def kernel(self, texts: list[str]) -> np.ndarray:
        rows, sizes = self.presence(texts)
        shared = rows @ self.landmarks.T
        return shared / np.sqrt(sizes[:, None] * self.sizes[None, :])

    def scores(self, texts: list[str]) -> np.ndarray:
        return self.kernel(texts) @ self.weights + self.bias


def fit_rows(rows: list[tuple[str, str]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """A model from ``(text, language)`` rows; None without rows. The order of the rows chooses the landmarks."""
    if not rows:
        return None
    languages = sorted({lang for _, lang in rows})
    turn: dict[str, int] = {}
    order = []
    for i, (_, lang) in enumerate(rows):
        turn[lang] = turn.get(lang, 0) + 1
        order.append((turn[lang], i))
    chosen = [rows[i][0] for _, i in sorted(order)[:landmarks]]
    grams = [np.unique(_gram_ids(t)) for t in chosen]
    vocabulary = np.unique(np.concatenate(grams))
    column = np.full(_GRAMS, -1, np.int32)
    column[vocabulary] = np.arange(len(vocabulary))
    present = np.zeros((len(chosen), len(vocabulary)), np.float32)
    for i, g in enumerate(grams):
        present[i, column[g]] = 1
    model = Model(languages, column, present, np.array([max(len(g), 1) for g in grams], float), None, None)
    values, vectors = np.linalg.eigh(model.kernel(chosen))
    use = values > 1e-8 * values.max()
    lift = vectors[:, use] / np.sqrt(values[use])
    features = np.concatenate([model.kernel([t for t, _ in rows[i : i + BATCH]]) for i in range(0, len(rows), BATCH)]) @ lift
    wanted = np.array([[float(lang == own) for own in languages] for _, lang in rows])
    centre, mean = features.mean(0), wanted.mean(0)
    x = features - centre
    solved = np.linalg.solve(x.T @ x + ridge * len(rows) * np.eye(x.shape[1]), x.T @ (wanted - mean))
    model.weights, model.bias = lift @ solved, mean - centre @ solved
    return model


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """Fits on a bounded sample of the rows ``text, lang``; None if no row has both.

    Every language gets the same number of different texts, those with the smallest digests,
    so copies of one text count once and the sample does not depend on how rows are stored. Texts over
    ``SAMPLE_CHARS`` come after all shorter ones of their language; they are used whole, two at least and
    no more than fit the characters that as many texts of ``SAMPLE_CHARS`` would have. Every label is
    learnt; each has two texts at least where it has two, so the sample grows with the labels beyond ``sample_rows / 2``.
    """
    rows = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang")
    digests = rows.select("lang", F.char_length("text").alias("chars"), F.md5("text").alias("digest")).distinct()
    names = digests.select("lang").distinct().count()
    if not names:
        return None
    quota = max(2, sample_rows // names)
    first = [F.col("chars") > SAMPLE_CHARS, F.col("digest")]
    # Cut per cell of a language's digests first, so that no task ranks what many tasks found for one language.
    cell = F.pmod(F.crc32("digest"), F.lit(CELLS))
    cut = top_k(digests.withColumn("cell", cell), ["lang", "cell"], first, quota).drop("rank", "cell")
    wanted = top_k(cut, ["lang"], first, quota).select("lang", "chars", "digest")
    chosen, held = [], {}
    for r in sorted(wanted.collect(), key=lambda r: (r.lang, r.chars > SAMPLE_CHARS, r.digest)):
        texts, chars = held.get(r.lang, (0, 0))
        if texts < 2 or chars + r.chars <= quota * SAMPLE_CHARS:
            held[r.lang] = (texts + 1, chars + r.chars)
            chosen.append((r.lang, r.digest))
    spark = labelled.sparkSession
    keys = spark.createDataFrame(chosen, "lang string, digest string")
    found = (
        rows.withColumn("digest", F.md5("text")).join(F.broadcast(keys), ["lang", "digest"])
        .groupBy("lang", "digest").agg(F.max("text").alias("text")).collect()
    )
    return fit_rows([(r.text, r.lang) for r in sorted(found, key=lambda r: (r.lang, r.digest))], landmarks, ridge)


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> Column:
    """A struct ``lang_pred, score`` for every whole text of ``docs``.

    Null texts and texts without a letter, and all texts when there is no model, are ``und`` with score
    0. The score is the best language's regression value, cut to 0..1; ties go to the language
    first in code-point order. Only the text is read: repeated rows get equal answers and other
    columns play no part.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def classify(texts: pa.Array) -> pa.Array:
        own = shared.value
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if own is not None:
            for start in range(0, len(texts), BATCH):
                block = [t.as_py() for t in texts.slice(start, BATCH)]
                use = [i for i, t in enumerate(block) if t is not None and any(map(str.isalpha, t))]
                if use:
                    values = own.scores([block[i] for i in use])
                    for i, row in zip(use, values):
                        best = int(np.argmax(row))
                        names[start + i] = own.languages[best]
                        scores[start + i] = float(np.clip(row[best], 0.0, 1.0))
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    classify.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(classify, "struct<lang_pred: string, score: double>").asNondeterministic()(F.col(text))


def held_out(doc_id: Column) -> Column:
    """Rows kept from learning: the checksum of the id as text leaves 1 by 3; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1
