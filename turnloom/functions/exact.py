"""A text that is equal for equal rows only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def exact_text(schema: T.StructType) -> Column:
    """All columns of ``schema``, each NULL marked and each value with its length before it.

    Strings and binaries are written byte by byte, instants in microseconds, and nested values
    part by part, maps in the order of their entries.
    """
    return F.concat(F.lit(""), *[_part(F.col(f"`{f.name}`"), f.dataType) for f in schema.fields])


def _part(value: Column, kind: T.DataType) -> Column:
    body = _body(value, kind)
    marked = F.concat(F.length(body).cast("string"), F.lit(":"), body)
    return F.when(value.isNull(), F.lit("n")).otherwise(marked)


def _body(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType, T.BinaryType)):
        return F.hex(value.cast("binary"))
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(value).cast("string")
    if isinstance(kind, T.ArrayType):
        parts = F.transform(value, lambda x: _part(x, kind.elementType))
        return F.concat(F.size(value).cast("string"), F.lit(":"), F.array_join(parts, ""))
    if isinstance(kind, T.MapType):
        entry = T.StructType().add("key", kind.keyType).add("value", kind.valueType)
        return _body(F.map_entries(value), T.ArrayType(entry))
    if isinstance(kind, T.StructType):
        return F.concat(F.lit(""), *[_part(value[f.name], f.dataType) for f in kind.fields])
    if isinstance(kind, T.VariantType):
        return F.to_json(value)
    return value.cast("string")
