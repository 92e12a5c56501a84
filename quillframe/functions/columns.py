"""Column kinds and null rules shared by every operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLOATING = (T.FloatType, T.DoubleType)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)
NESTED = (T.ArrayType, T.MapType, T.StructType)


def dtype_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def known(df: DataFrame, names) -> list[str]:
    return [n for n in names if n in df.columns]


def plain(df: DataFrame, name: str) -> Column:
    """The column with NaN read as null."""
    col = F.col(f"`{name}`")
    return F.nanvl(col, F.lit(None)) if isinstance(dtype_of(df, name), FLOATING) else col


def complete(df: DataFrame, names) -> DataFrame:
    """Rows with a value in every named column; the null tests reach a Parquet scan."""
    for name in names:
        col = F.col(f"`{name}`")
        df = df.filter(col.isNotNull() & ~F.isnan(col) if isinstance(dtype_of(df, name), FLOATING) else col.isNotNull())
    return df


def as_double(df: DataFrame, name: str) -> Column:
    return plain(df, name).cast("double")


def finite(col: Column) -> Column:
    """NaN and both infinities become null."""
    return F.when(F.isnan(col) | (F.abs(col) == F.lit(float("inf"))), None).otherwise(col)


def comparable(df: DataFrame, name: str) -> Column:
    """A fixed-width or short stand-in that is equal exactly when the values are equal.

    Long strings shuffle as a SHA-256 digest; negative zero joins zero.
    """
    col, kind = plain(df, name), dtype_of(df, name)
    if isinstance(kind, NESTED):
        return F.sha2(F.to_json(col), 256)
    if isinstance(kind, T.StringType):
        return F.when(F.length(col) > 64, F.concat(F.lit("#"), F.sha2(col, 256))).otherwise(col)
    if isinstance(kind, T.BinaryType):
        return F.sha2(col, 256)
    if isinstance(kind, FLOATING):
        return col + F.lit(0.0).cast(kind)
    return col


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """``part / whole * 100`` rounded half-even; null when ``whole`` is 0."""
    return F.bround(F.try_divide(part.cast("double") * 100, whole.cast("double")), digits)


def sum_or_zero(col: Column) -> Column:
    """pandas' sum: 0 for an all-null group."""
    return F.coalesce(F.sum(col), F.lit(0).cast("double"))
