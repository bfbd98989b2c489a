"""The corpus pipeline: quality, near-duplicates, personal data, mixing and packing of documents.

Every stage takes ``(spark, docs, sf_dir)``. The runner writes what it returns as Parquet and rereads it as the
next stage's documents. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockloom.llm import bayes_dedup, fertility, length_buckets, mixing_flow, pii_boost
from stockloom.session import scratch_dir, written


def _added(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have, whatever columns it has."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or lie outside the fertility bands; every row is judged alone."""
    verdict = _added(docs, "__verdict")
    judged = docs.withColumn(verdict, fertility.assess(F.col("text")))
    return judged.where(F.col(f"{verdict}.kept")).drop(verdict)


def _numbered(docs: DataFrame, label: str) -> tuple[DataFrame, str]:
    """The documents with a number for each row, and its column: ids may be null or repeat. Written, so that the numbers stay."""
    row = _added(docs, "__row")
    return written(docs.withColumn(row, F.monotonically_increasing_id()), scratch_dir(docs.sparkSession, label)), row


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate component, the one with the smallest id; null ids come last.

    Rows are told apart by their place, so a row only goes for its own text, whatever other rows share its id. Rows
    without words are like no other and stay; an empty table stays empty; texts of any length are compared whole.
    """
    rows, row = _numbered(docs, "rows")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(row).alias("row"))
    found = bayes_dedup.near_duplicates(rows.select(rank.alias("doc_id"), "text"))
    gone_row = _added(rows, "__gone")
    gone = found.where("NOT kept").select(F.col("doc_id")["row"].alias(gone_row))
    return rows.join(gone, F.col(row) == F.col(gone_row), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in texts by labels; no row goes. ``n_chars`` follows the text where it is a column."""
    located = written(pii_boost.locate(docs), scratch_dir(spark, "located"))
    clean = pii_boost.redact(docs, pii_boost.train(spark, located))
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        clean = clean.withColumn("n_chars", F.coalesce(F.char_length("text").cast(kind), F.col("n_chars")))
    return clean.select(*[F.col(f"`{c}`") for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Brings sources to their target weights: a document appears as often as the mix takes it, up to twice.

    Documents that the mix does not take go; documents without words are not text to train on and go too. Every row
    is taken for itself, also where ids are null or repeat.
    """
    rows, row = _numbered(docs, "mixed-rows")
    of, times, copy = (_added(rows, name) for name in ("__of", "__times", "__copy"))
    passes = mixing_flow.mix(rows, row=F.col(row)).where("taken > 0").select(
        F.col("row").alias(of), F.call_function("div", F.col("taken"), F.col("size")).cast("int").alias(times)
    )
    joined = rows.join(passes, F.col(row) == F.col(of))
    kept = [F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*kept, F.explode(F.sequence(F.lit(1), F.col(times))).alias(copy)).select(*kept)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length bucket, batch and slot of every row."""
    return length_buckets.pack(docs)


STAGES = [
    ("quality", quality), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixing", mixing),
    ("packing", packing),
]
ORACLE_SQL = None  # tokenisers, signatures and trees have no SQL form; tests compare with plain Python


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), scratch_dir(spark, name))
    return STAGES[-1][1](spark, docs, sf_dir)
