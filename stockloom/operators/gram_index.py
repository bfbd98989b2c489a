"""A stored inverted index of short character runs, for substring search.

The index holds every text once under each of its runs of up to three characters. It lies in a folder in batches:
``grams/batch=N/bucket=B`` has rows ``gram, text`` dealt by the hash of the gram and sorted, ``counts/batch=N``
the texts per gram, and ``texts/batch=N`` the texts themselves, written last, so a batch without them does not count and
is written over by the next attempt. New texts are a new batch; texts already held are not indexed again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockloom.session import scratch_dir, written

BUCKETS = 32  # folders of one batch; a lookup reads those of its grams
RUN = 3


def _pieces(text: Column, size: int) -> Column:
    """Every run of ``size`` characters of a text."""
    starts = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1))
    none = F.array().cast("array<string>")
    return F.coalesce(F.transform(starts, lambda i: F.substring(text, i, F.lit(size))), none)


def query_grams(q: Column) -> Column:
    """Runs of three characters that any match of ``q`` contains.

    Taken from the longest stretch of ``q`` without wildcards; a stretch shorter than three
    characters stands for itself.
    """
    plain = F.regexp_replace(F.lower(q), r"\\.?", "%")
    longest = F.try_element_at(F.array_sort(F.split(plain, "[%_]"), lambda a, b: F.length(b) - F.length(a)), F.lit(1))
    return F.array_distinct(F.when(F.length(longest) >= RUN, _pieces(longest, RUN)).otherwise(F.array(longest)))


def text_grams(text: Column) -> Column:
    return F.array_distinct(F.concat(F.array(F.lit("")), *[_pieces(text, n) for n in range(1, RUN + 1)]))


def matches_everything(q: Column) -> Column:
    return q.isNull() | F.regexp_like(q, F.lit("^%+$"))


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


class GramIndex:
    """An index in a folder; see the module for its files."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _batches(self) -> int:
        """Complete batches; they are numbered from 0."""
        n = 0
        while self._exists(f"texts/batch={n}/_SUCCESS"):
            n += 1
        return n

    def built(self) -> bool:
        return self._batches() > 0

    def _read(self, table: str, schema: str) -> DataFrame:
        found = self.spark.read.schema(schema).option("basePath", f"{self.path}/{table}")
        paths = [f"{self.path}/{table}/batch={i}" for i in range(self._batches())]
        return found.parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def texts(self) -> DataFrame:
        return self._read("texts", "text string").select("text")

    def extend(self, texts: DataFrame) -> None:
        """Adds texts; nulls, repeats and texts the index holds are passed over."""
        batch = self._batches()
        fresh = texts.select("text").where("text IS NOT NULL").distinct()
        if batch:
            fresh = fresh.join(self.texts(), "text", "left_anti")
        fresh = written(fresh, scratch_dir(self.spark, "texts"))
        rows = fresh.select(F.explode(text_grams(F.col("text"))).alias("gram"), "text").withColumn("bucket", _bucket(F.col("gram")))
        # A frequent gram is spread over several files of its bucket.
        dealt = rows.repartition("bucket", F.pmod(F.xxhash64("text"), F.lit(4))).sortWithinPartitions("bucket", "gram")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/grams/batch={batch}")
        counted = self.spark.read.schema("gram string, text string, bucket int").parquet(f"{self.path}/grams/batch={batch}")
        counted.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{self.path}/counts/batch={batch}")
        fresh.write.mode("overwrite").parquet(f"{self.path}/texts/batch={batch}")

    def matches(self, queries: DataFrame) -> DataFrame:
        """Pairs of a query ``q`` and a text that contains it, each once: ``q, text``.

        Texts and queries meet by equality on the query's rarest gram, and only those pairs are compared in full. A
        query with a gram no text has is dropped at once. Only buckets with such a gram are read.
        """
        grams = queries.select("q").distinct().select("q", F.explode(query_grams(F.col("q"))).alias("gram"))
        totals = self._read("counts", "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
        counted = grams.join(totals, "gram", "left")
        rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("rarest")
        anchored = counted.groupBy("q").agg(rarest).where(F.col("rarest.n") > 0).select("q", F.col("rarest.gram").alias("gram"))
        # A backslash before an ordinary character stands for that character.
        pattern = F.concat(F.lit("%"), F.regexp_replace("q", r"\\([^%_\\])", "$1"), F.lit("%"))
        like = F.call_function("ilike", F.col("text"), F.col("pattern"))
        hit = F.when(F.col("wild"), like).otherwise(F.contains("text", F.lower("q")))
        anchored = written(
            anchored.withColumns({"pattern": pattern, "wild": F.regexp_like("q", F.lit(r"[%_\\]")), "bucket": _bucket(F.col("gram"))}),
            scratch_dir(self.spark, "anchored"),
        )
        wanted = [r.bucket for r in anchored.select("bucket").distinct().collect()]
        stored = self._read("grams", "gram string, text string, bucket int").where(F.col("bucket").isin(wanted))
        return anchored.drop("bucket").join(stored.drop("bucket", "batch"), "gram").where(hit).select("q", "text")
