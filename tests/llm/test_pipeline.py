"""The pipeline's stages on the smallest tables."""

import brute
import corpus_pipeline
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"


def test_stages_act_on_what_is_left(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").withColumn("size", F.lit("mine")).withColumn("kept", F.lit(1))
    seen, columns = [docs], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen[-1], FOLDER)
        out.write.parquet(str(tmp_path / name))
        seen.append(spark.read.parquet(str(tmp_path / name)))
    assert [s.columns for s in seen[:-1]] == [columns] * len(corpus_pipeline.STAGES)
    rows = [{r.doc_id: r.text for r in s.collect()} for s in seen[:-1]]
    start, good, once, clean, mixed = rows
    for i, text in start.items():
        words, _, _, _, repeats = brute.base_quality(text)
        assert i not in good or words >= 10 and 100 * repeats <= 20 * words
    want = brute.near_components(list(good.items()), 5, 80)
    assert set(once) == {i for i in want if want[i] == i}
    assert set(clean) == set(once) and all(not brute.base_spans(t) for t in clean.values())
    assert all(clean[i] == once[i] for i in clean if not any(c.isdigit() or c == "@" for c in once[i]))
    assert set(mixed) <= set(clean) and all(mixed[i] == clean[i] for i in mixed)
    copies = seen[4].groupBy("doc_id").count().agg(F.max("count")).first()[0]
    assert copies <= 2 and seen[5].count() == seen[4].count()


def test_stages_take_empty_tables_and_nulls(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    some = [(None, None, None, None, None), (1, None, "en", "s", 4), (2, "", None, None, 0), (2, "", None, None, 0)]
    text = "A quiet road led past the mill and down to the river where boats lay in the sun."
    some += [(5, text, "en", None, 80), (5, text, "en", None, 80), (None, text.upper(), "en", "a", 80)]
    for k, rows in enumerate(([], some)):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, FOLDER)
            out.write.parquet(str(tmp_path / f"{name}{k}"))
            docs = spark.read.parquet(str(tmp_path / f"{name}{k}"))
        assert docs.count() >= 0 and "batch" in docs.columns


def test_rows_are_judged_by_their_own_text(spark):
    """Ids that repeat or are null, and columns with the names the stages use themselves."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, __row int, __id int, __of int, __times int, __copy int, row int"
    text = {k: " ".join(f"{k}{i}" for i in range(30)) for k in "abcd"}
    some = [(5, "a"), (4, "a"), (5, "b"), (None, "c"), (None, "c"), (None, "d"), (5, "b")]
    docs = spark.createDataFrame([(i, text[t], "en", "s", 1, 1, 2, 3, 4, 5, 6) for i, t in some], schema)
    stages = dict(corpus_pipeline.STAGES)
    once = stages["near_duplicates"](spark, docs, FOLDER)
    assert once.columns == docs.columns
    assert sorted((str(r.doc_id), r.text[0]) for r in once.collect()) == [("4", "a"), ("5", "b"), ("None", "c"), ("None", "d")]
    mixed = stages["mixing"](spark, docs, FOLDER)
    assert mixed.columns == docs.columns
    assert 9 <= mixed.count() <= 12 and {tuple(r) for r in mixed.collect()} <= {tuple(r) for r in docs.collect()}
