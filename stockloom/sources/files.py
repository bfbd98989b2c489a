"""Readers and writers for the table files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockloom.functions.text import pg_array, to_pg_array

# What an unquoted empty field is read as before it becomes NULL; no file holds this text.
_NOTHING = "\x00NULL"
_STRING_ARRAY = T.ArrayType(T.StringType())


def _is_string_array(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, T.StringType)


def _is_nested(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.ArrayType, T.StructType))


def _decode(field: T.StructField) -> Column:
    if _is_string_array(field.dataType):
        return pg_array(F.col(field.name)).alias(field.name)
    if _is_nested(field.dataType):
        return F.from_json(F.col(field.name), field.dataType, {"mode": "FAILFAST"}).alias(field.name)
    return F.col(field.name)


def _encode(field: T.StructField) -> Column:
    if _is_string_array(field.dataType):
        return to_pg_array(F.col(field.name)).alias(field.name)
    if _is_nested(field.dataType):
        return F.to_json(F.col(field.name), {"ignoreNullFields": "false"}).alias(field.name)
    return F.col(field.name)


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | str, multi_line: bool = False) -> DataFrame:
    """A CSV file, folder or glob with a header as a typed table; a row that does not fit stops the load.

    Array columns arrive as ``{a,b}`` text and other nested columns as JSON text. Quotes
    inside a field are doubled, so the escape character is the quote itself. An empty field is
    NULL, a quoted empty one is empty text. Fields with line breaks need ``multi_line``, which reads
    each file in one task. A glob such as ``transactions_part_*.csv`` reads a chunked table; Spark
    splits the files over tasks.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    flat = T.StructType(
        [T.StructField(f.name, T.StringType() if _is_nested(f.dataType) else f.dataType) for f in schema]
    )
    raw = (
        spark.read.schema(flat)
        .option("header", True)
        .option("escape", '"')
        .option("mode", "FAILFAST")
        .option("nullValue", _NOTHING)
        .option("emptyValue", "")
        .option("multiLine", multi_line)
        .csv(path)
    )
    return raw.select(*[_decode(f) for f in schema])


def write_csv(df: DataFrame, path: str, max_rows: int | None = None, mode: str = "overwrite") -> None:
    """CSV in the layout :func:`read_csv` reads, in files of at most ``max_rows`` rows; white space is kept."""
    writer = df.select(*[_encode(f) for f in df.schema]).write.mode(mode)
    writer = writer.option("header", True).option("escape", '"').option("nullValue", "").option("emptyValue", '""')
    writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    if max_rows:
        writer = writer.option("maxRecordsPerFile", max_rows)
    writer.csv(path)


def write_chunked(df: DataFrame, path: str, max_rows: int, mode: str = "overwrite") -> None:
    """Parquet files of at most ``max_rows`` rows each, every task writing its own."""
    df.write.mode(mode).option("maxRecordsPerFile", max_rows).parquet(path)


def write_bucketed(df: DataFrame, table: str, keys: list[str], buckets: int, mode: str = "overwrite") -> None:
    """A catalog table bucketed on ``keys``; later joins and groupings on them need no shuffle."""
    df.write.mode(mode).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)


def write_by_date(df: DataFrame, path: str, ts: str, partition: str = "event_date", mode: str = "overwrite") -> None:
    """A fact table partitioned by the day of ``ts``, so that date filters prune folders.

    Rows are ranged on the day and on ``ts`` itself first: a busy day is written by several
    tasks and a quiet one by a single task.
    """
    dated = df.withColumn(partition, F.col(ts).cast("date"))
    dated.repartitionByRange(partition, ts).write.mode(mode).partitionBy(partition).parquet(path)


def overwrite(df: DataFrame, path: str) -> None:
    """Replaces the whole table at ``path``, as truncate and load does."""
    df.write.mode("overwrite").parquet(path)


def inline_rows(spark: SparkSession, rows: list[tuple], schema: T.StructType | str) -> DataFrame:
    """A small literal table with a declared schema."""
    return spark.createDataFrame(rows, schema)


def file_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per file: ``table_name, file, row_count``; each table is read once."""
    parts = [
        df.groupBy(F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "file", "row_count"
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """Number of rows and of files per table, also for tables without rows.

    The file names are rows of :func:`file_counts`: a large table has too many for one list.
    """
    names = F.array(*[F.lit(n) for n in tables])
    listed = tables[next(iter(tables))].sparkSession.range(1).select(F.explode(names).alias("table_name"))
    totals = file_counts(tables).groupBy("table_name").agg(
        F.sum("row_count").alias("row_count"), F.count_if(F.col("file") != "").alias("file_count")
    )
    return listed.join(totals, "table_name", "left").fillna(0, ["row_count", "file_count"])


def write_manifest(tables: dict[str, DataFrame], path: str, **scale: int) -> None:
    """Manifest as JSON under ``path``: table totals with the scale settings, and the files."""
    settings = [F.lit(v).alias(k) for k, v in scale.items()]
    manifest(tables).select("*", *settings).write.mode("overwrite").json(f"{path}/tables")
    file_counts(tables).write.mode("overwrite").json(f"{path}/files")
