"""CSV files with line breaks in fields, read by many tasks, with a table of rejected records.

A file is read as physical lines in splits of any size. Whether a line starts a record follows from the number of quotes
before it: odd inside a quoted field, even outside. That number is summed per split, carried from split to split of a file,
and completed inside each split, so no task ever sees a whole file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockloom.session import scratch_dir, written
from stockloom.sources.files import _NOTHING, _decode, _is_nested, _is_string_array

MAX_LINES = 10_000  # physical lines of one record; more mean a quote that is never closed
REJECTS = "file string, line bigint, reason string, record string"


def _records(spark: SparkSession, path: str | list[str], max_lines: int) -> tuple[DataFrame, DataFrame]:
    """``file, line, record`` of every record with the number of its first line, and ``file, line`` of endless ones."""
    base = scratch_dir(spark, "csv")
    text = spark.read.option("lineSep", "\n").text(path)
    lines = written(
        text.select(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value",
            (F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))).alias("quotes"),
            F.monotonically_increasing_id().alias("seq"),
        ),
        f"{base}/lines",
    )
    splits = lines.groupBy("file", "split").agg(F.sum("quotes").alias("q"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select(
        "file", "split", F.coalesce(F.sum("q").over(earlier), F.lit(0)).alias("before"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("above")
    )
    inside = Window.partitionBy("file", "split").orderBy("seq")
    quoted = F.col("before") + F.coalesce(F.sum("quotes").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = lines.join(offsets, ["file", "split"]).select(
        "file", "split", "value", (F.col("above") + F.row_number().over(inside)).alias("line"), (quoted % 2 == 0).alias("starts")
    )
    started = F.max(F.when(F.col("starts"), F.col("line")))
    upto = Window.partitionBy("file", "split").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    placed = written(placed.withColumn("own", started.over(upto)), f"{base}/placed")
    # The first lines of a split may belong to a record that a split before it started.
    last = placed.groupBy("file", "split").agg(F.max("own").alias("last"))
    carried = last.select("file", "split", F.max("last").over(earlier).alias("carried"))
    numbered = placed.join(carried, ["file", "split"]).select("file", F.coalesce("own", "carried").alias("line"), F.col("line").alias("at"), "value")
    sizes = numbered.groupBy("file", "line").agg(F.count(F.lit(1)).alias("n"))
    endless = written(sizes.where(F.col("n") > max_lines).select("file", "line"), f"{base}/endless")
    whole = numbered.join(F.broadcast(endless) if endless.limit(1001).count() <= 1000 else endless, ["file", "line"], "left_anti")
    gathered = whole.groupBy("file", "line").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("v"))
    joined = F.regexp_replace(F.array_join(F.col("v.value"), "\n"), "\r$", "")
    return gathered.select("file", "line", joined.alias("record")), endless


def _fault(field: T.StructField) -> Column:
    """Why a nested column's text cannot be read, or null."""
    value = F.col(f"p.`{field.name}`")
    if _is_string_array(field.dataType):
        return F.when(value.isNotNull() & ~F.regexp_like(value, F.lit(r"(?s)^\s*\{.*\}\s*$")), "bad_array")
    return F.when(value.isNotNull() & F.get_json_object(value, "$").isNull(), "bad_json")


def read_csv_split(
    spark: SparkSession, path: str | list[str], schema: T.StructType | str, max_lines: int = MAX_LINES
) -> tuple[DataFrame, DataFrame]:
    """The rows of CSV files with a header, and what was rejected: ``file, line, reason, record``.

    Reads the layout of :func:`files.read_csv`, with line breaks in quoted fields, in as many tasks as the files have
    splits. Quotes stand around fields and are doubled inside them. A record that does not fit the schema is listed with its
    file, the number of its first line and a reason (``bad_fields``, ``bad_array``, ``bad_json``) and the load goes on; one of more
    than ``max_lines`` lines is ``unclosed_quote``, without its text. Empty lines between records are passed over.
    """
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    records, endless = _records(spark, path, max_lines)
    flat = ", ".join(f"`{f.name}` {'string' if _is_nested(f.dataType) else f.dataType.simpleString()}" for f in schema)
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad", "escape": '"', "nullValue": _NOTHING, "emptyValue": ""}
    parsed = records.where("line > 1 AND record <> ''").withColumn("p", F.from_csv("record", f"{flat}, `__bad` string", options))
    faults = [_fault(f) for f in schema if _is_nested(f.dataType)]
    reason = F.coalesce(F.when(F.col("p.__bad").isNotNull(), "bad_fields"), *faults) if faults else F.when(F.col("p.__bad").isNotNull(), "bad_fields")
    judged = written(parsed.withColumn("reason", reason), scratch_dir(spark, "csv-records"))
    good = judged.where("reason IS NULL").select("p.*").select(*[_decode(f) for f in schema])
    bad = judged.where("reason IS NOT NULL").select("file", "line", "reason", "record")
    return good, bad.unionByName(endless.select("file", "line", F.lit("unclosed_quote").alias("reason"), F.lit(None).cast("string").alias("record")))
