"""Writing results; each writer keeps the known columns of ``columns``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.functions.columns import NESTED, known


def _chosen(df: DataFrame, columns: Sequence[str] | None) -> DataFrame:
    return df.select(*known(df, columns)) if columns else df


def write_csv(df: DataFrame, path: str, columns: Sequence[str] | None = None, mode: str = "errorifexists") -> None:
    """CSV with a header; nested columns as JSON text."""
    out = _chosen(df, columns)
    nested = {f.name: F.to_json(F.col(f"`{f.name}`")) for f in out.schema if isinstance(f.dataType, NESTED)}
    out = out.withColumns(nested) if nested else out
    out.write.mode(mode).csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_json(df: DataFrame, path: str, columns: Sequence[str] | None = None, mode: str = "errorifexists") -> None:
    """JSON Lines."""
    _chosen(df, columns).write.mode(mode).json(path, ignoreNullFields=False)


def write_parquet(
    df: DataFrame, path: str, columns: Sequence[str] | None = None, mode: str = "errorifexists", partition_by: Sequence[str] = ()
) -> None:
    writer = _chosen(df, columns).write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
