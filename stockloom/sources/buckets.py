"""Keyed tables in bucket folders, of which a change rewrites only the buckets it touches.

A table lies in ``path/bucket=B``, dealt by the hash of its keys. Every row carries the number of the batch that wrote its bucket, so a
batch that is applied again after it was broken off passes over the buckets it had finished.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockloom.session import scratch_dir, written

BUCKETS = 64
_BUCKET, _BATCH = "bucket", "batch"


class BucketTable:
    """A table in a folder, with ``keys`` that deal its rows; ``bucket`` and ``batch`` are columns of its own."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: T.StructType, buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.buckets = spark, path, keys, buckets
        self.columns = schema.names
        self.schema = T.StructType([*schema.fields, T.StructField(_BATCH, T.LongType()), T.StructField(_BUCKET, T.IntegerType())])

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _stored(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path)

    def read(self) -> DataFrame:
        return self._stored().select(*self.columns)

    def _write(self, rows: DataFrame, batch: int, mode: str) -> None:
        dealt = rows.withColumns({_BATCH: F.lit(batch).cast("bigint"), _BUCKET: self.bucket()}).select(*self.schema.names)
        # A bucket is written by a few tasks, so that a large one does not wait for a single task.
        spread = F.pmod(F.xxhash64(*self.keys, F.lit(1)), F.lit(4))
        dealt.repartition(_BUCKET, spread).write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy(_BUCKET).parquet(self.path)

    def replace(self, rows: DataFrame, batch: int = 0) -> None:
        """Writes the whole table."""
        self._write(rows, batch, "static")

    def apply(self, changes: DataFrame, batch: int, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Puts changes into the buckets of their keys; returns the buckets rewritten.

        ``merge`` takes the present rows of those buckets and the changes and gives all rows the buckets
        shall have. Batches are numbered from 1, in order; a bucket that this or a later batch wrote is left as it is.
        """
        dealt = written(changes.withColumn(_BUCKET, self.bucket()), scratch_dir(self.spark, "changes"))
        asked = [r[0] for r in dealt.select(_BUCKET).distinct().collect()]
        stored = self._stored().where(F.col(_BUCKET).isin(asked))
        done = {r[0] for r in stored.groupBy(_BUCKET).agg(F.max(_BATCH).alias("b")).where(F.col("b") >= batch).collect()}
        touched = sorted(set(asked) - done)
        if touched:
            here = F.col(_BUCKET).isin(touched)
            merged = merge(stored.where(here).select(*self.columns), dealt.where(here).drop(_BUCKET))
            # Written apart first: the folders it comes from are the ones to be overwritten.
            self._write(written(merged.select(*self.columns), scratch_dir(self.spark, "merged")), batch, "dynamic")
        return touched
