"""The dataset catalog: one record per profiled table, the latest one wins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillframe.operators import profile


def column_profiles(df: DataFrame, dataset_id: str, order_by=None, exact: bool = True) -> DataFrame:
    """Inferred-schema rows of one table, tagged with its id."""
    return profile.infer_schema(df, order_by, exact).select(F.lit(dataset_id).alias("dataset_id"), "*")


def catalog_profiles(tables: dict[str, DataFrame]) -> DataFrame:
    """(dataset_id, position, name, inferred_type, rows, unique_count, cardinality) for many tables.

    The distinct values of all tables are counted in one shuffle per kind of value.
    """
    stats, cells, first = [], [], 0
    for dataset_id, df in tables.items():
        tag = F.lit(dataset_id).alias("dataset_id")
        cell = (F.col("position") + first).alias("cell")
        stats.append(profile.column_stats(df).select(tag, cell, "position", F.col("column").alias("name"), "inferred_type", "rows"))
        cells.append(profile.cells(df, df.columns, first))
        first += len(df.columns)
    rows = reduce(DataFrame.unionByName, stats).join(F.broadcast(profile.distinct_cells(cells)), "cell", "left")  # one row per column
    rows = rows.fillna(0, ["unique_count"]).drop("cell")
    return rows.withColumn("cardinality", profile.cardinality(F.col("unique_count"), F.col("rows")))


def catalog_record(df: DataFrame, dataset_id: str, name: str | None = None, source_type: str = "parquet", size_bytes: int = 0, order_by=None) -> DataFrame:
    """One catalog row: counts, quality score and the column metadata as an array of structs."""
    rows = column_profiles(df, dataset_id, order_by)
    meta = [c for c in rows.columns if c not in ("dataset_id", "rows")]
    shape = rows.groupBy("dataset_id").agg(  # one struct per column
        F.max("rows").alias("row_count"), F.array_sort(F.collect_list(F.struct(*meta))).alias("columns"))
    score = profile.quality_score(df).select("quality_score")
    return shape.crossJoin(F.broadcast(score)).select(  # one row each
        "dataset_id", F.lit(name or dataset_id).alias("name"), F.lit(source_type).alias("source_type"), "row_count",
        F.size("columns").alias("col_count"), "columns", F.lit(size_bytes).cast("bigint").alias("size_bytes"),
        "quality_score", F.current_timestamp().alias("created_at"))


def catalog_list(records: DataFrame) -> DataFrame:
    """The latest record of every dataset."""
    latest = Window.partitionBy("dataset_id").orderBy(F.col("created_at").desc())
    newest = records.withColumn("_r", F.row_number().over(latest)).filter("_r = 1").drop("_r")
    return newest.orderBy("dataset_id")
