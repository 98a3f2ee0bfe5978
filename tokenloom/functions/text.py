"""Field resolution and text lengths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The record fields that may hold the text, in order of preference.
LOADER_FIELDS = ("text", "code", "content", "instruction")
PREPARER_FIELDS = (*LOADER_FIELDS, "func_code_string", "whole_func_string")


def resolve_text(df: DataFrame, fields: Sequence[str] = LOADER_FIELDS, out: str = "text") -> DataFrame:
    """First non-empty field of each record; fields the table lacks are passed over.

    The order of preference also covers fields that hold no strings: such a field hides
    the ones after it, and the record then has no text.
    """
    resolved: Column = F.lit(None).cast("string")
    types = {f.name: f.dataType for f in df.schema.fields}
    for name in reversed([f for f in fields if f in types]):
        if isinstance(types[name], T.StringType):
            resolved = F.coalesce(F.nullif(F.col(name), F.lit("")), resolved)
        else:
            resolved = F.when(_truthy(name, types[name]), F.lit(None).cast("string")).otherwise(resolved)
    return df.withColumn(out, resolved)


def _truthy(name: str, kind: T.DataType) -> Column:
    value = F.col(name)
    if isinstance(kind, T.BooleanType):
        return F.coalesce(value, F.lit(False))
    if isinstance(kind, T.NumericType):
        return F.coalesce(value != 0, F.lit(False))
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return F.coalesce(F.size(value) > 0, F.lit(False))
    return value.isNotNull()


def drop_empty_text(df: DataFrame, column: str = "text") -> DataFrame:
    return df.where(F.length(column) > 0)


def text_lengths(df: DataFrame, column: str = "text") -> DataFrame:
    """Characters and UTF-8 bytes of each text."""
    return df.withColumns({"chars": F.length(column).cast("bigint"),
                           "utf8_bytes": F.octet_length(column).cast("bigint")})


def budget_unit(kind: str, column: str = "text") -> Column:
    """What a size budget counts: characters under BPE, bytes under byte-level tokens."""
    return (F.octet_length(column) if kind == "byte_level" else F.length(column)).cast("bigint")
