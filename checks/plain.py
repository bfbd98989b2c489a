"""Result columns in types every engine prints alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TS = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def _text(value: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(value, _TS)
    return value.cast("string")


def _struct_text(value: Column, dtype: T.StructType) -> Column:
    parts = [F.coalesce(_text(value[f.name], f.dataType), F.lit("-")) for f in dtype]
    return F.concat_ws("|", *parts)


def _flat(field: T.StructField) -> Column:
    value, dtype = F.col(field.name), field.dataType
    if isinstance(dtype, T.DecimalType):
        return value.cast("double").alias(field.name)
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return _text(value, dtype).alias(field.name)
    if isinstance(dtype, T.StructType):
        return _struct_text(value, dtype).alias(field.name)
    if isinstance(dtype, T.ArrayType):
        element = dtype.elementType
        if isinstance(element, T.StructType):
            items = F.transform(value, lambda x: _struct_text(x, element))
        else:
            items = F.transform(value, lambda x: _text(x, element))
        return F.array_join(items, ";").alias(field.name)
    return value.alias(field.name)


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles, dates and times as text, nested values as delimited text."""
    return df.select(*[_flat(f) for f in df.schema])
