"""Summaries of any number of numeric columns in one scan.

Every task keeps counts, extremes and central moments of its rows, batch by batch, and emits them once. What tasks
found is merged by the update formulas for moments about a new centre, so no pass for the means comes first.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillframe.functions.columns import as_double

MOMENTS = ("n", "mean", "m2", "m3", "m4")
STATE = "i int, rows long, n long, mean double, m2 double, m3 double, m4 double, total double, lo double, hi double, negatives long, zeros long"


def merged(a: dict, b: dict) -> dict:
    """The moments of two sets of rows taken together, column by column."""
    n = a["n"] + b["n"]
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        d = np.where((a["n"] > 0) & (b["n"] > 0), b["mean"] - a["mean"], 0.0)
        share = np.where(n > 0, b["n"] / np.maximum(n, 1), 0.0)  # of b
        rest = 1 - share
        mean = np.where(a["n"] > 0, a["mean"] + d * share, b["mean"])
        both = n * share * rest
        m2 = a["m2"] + b["m2"] + d**2 * both
        m3 = a["m3"] + b["m3"] + d**3 * both * (rest - share) + 3 * d * (rest * b["m2"] - share * a["m2"])
        m4 = (a["m4"] + b["m4"] + d**4 * both * (rest**2 - rest * share + share**2)
              + 6 * d**2 * (rest**2 * b["m2"] + share**2 * a["m2"]) + 4 * d * (rest * b["m3"] - share * a["m3"]))
    return {"n": n, "mean": mean, "m2": m2, "m3": m3, "m4": m4}


def _of_batch(x: np.ndarray) -> dict:
    """The state of a batch, given a row of values per column."""
    there = ~np.isnan(x)
    n = there.sum(axis=1)
    whole = bool(there.all())
    with np.errstate(invalid="ignore", over="ignore"):
        total = (x if whole else np.where(there, x, 0.0)).sum(axis=1)
        lo = (x if whole else np.where(there, x, np.inf)).min(axis=1, initial=np.inf)
        hi = (x if whole else np.where(there, x, -np.inf)).max(axis=1, initial=-np.inf)
        mean = np.where(lo == hi, lo, total / np.maximum(n, 1))  # a constant has no spread, whatever rounding does
        d = x - mean[:, None]
        if not whole:
            d[~there] = 0.0
        d2 = d * d
        found = {"n": n, "mean": mean, "m2": d2.sum(axis=1), "m3": (d2 * d).sum(axis=1), "m4": (d2 * d2).sum(axis=1)}
    return found | {"total": total, "lo": lo, "hi": hi, "negatives": (x < 0).sum(axis=1), "zeros": (x == 0).sum(axis=1)}


def by_column(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype("float64", copy=False)


def summaries(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, rows, count, total, mean, std, std_pop, min, max, skewness, kurtosis, negatives, zeros), one row per column.

    NaN counts as null. Skewness and excess kurtosis are those of the population, null for a constant. All but the
    counts are null without values. Columns may have any numeric type.
    """
    size, names = len(columns), F.array(*[F.lit(c) for c in columns]).cast("array<string>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = 0, _of_batch(np.empty((size, 0)))
        for batch in batches:
            found = _of_batch(by_column(batch))
            rows += batch.num_rows
            with np.errstate(invalid="ignore"):
                held = merged(held, found) | {k: held[k] + found[k] for k in ("total", "negatives", "zeros")} | {
                    "lo": np.minimum(held["lo"], found["lo"]), "hi": np.maximum(held["hi"], found["hi"])}
        known = held["n"] > 0
        fields = [pa.array(held[k], pa.float64(), mask=~known if k in ("lo", "hi") else None) for k in ("mean", "m2", "m3", "m4", "total", "lo", "hi")]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(size), pa.int32()), pa.array([rows] * size, pa.int64()), pa.array(held["n"], pa.int64()), *fields,
             pa.array(held["negatives"], pa.int64()), pa.array(held["zeros"], pa.int64())], names=[f.split()[0] for f in STATE.split(", ")])

    if not columns:
        parts = df.sparkSession.createDataFrame([], STATE)
    else:
        none = [F.lit(0).cast(f.split()[1]).alias(f.split()[0]) if f.split()[0] not in ("lo", "hi") else F.lit(None).cast("double").alias(f.split()[0])
                for f in STATE.split(", ")[1:]]
        parts = df.select(*[as_double(df, c).alias(f"x{i}") for i, c in enumerate(columns)]).mapInArrow(run, STATE).unionByName(
            df.sparkSession.range(size).select(F.col("id").cast("int").alias("i"), *none))  # a table without partitions has rows as well
    of = Window.partitionBy("i")  # one row per task
    weight = F.sum("n").over(of)
    parts = parts.withColumn("d", F.when(F.col("n") > 0, F.col("mean") - F.sum(F.col("n") * F.col("mean")).over(of) / weight).otherwise(0.0))
    n, d, m2, m3, m4 = (F.col(c) for c in ("n", "d", "m2", "m3", "m4"))
    one = parts.groupBy("i").agg(
        F.sum("rows").alias("rows"), F.sum("n").alias("n"), F.sum(m2 + n * d * d).alias("m2"),
        F.sum(m3 + 3 * d * m2 + n * d * d * d).alias("m3"), F.sum(m4 + 4 * d * m3 + 6 * d * d * m2 + n * d * d * d * d).alias("m4"),
        *[F.sum(c).alias(c) for c in ("total", "negatives", "zeros")], F.min("lo").alias("min"), F.max("hi").alias("max"))
    some, spread = F.col("n") > 0, F.col("min") != F.col("max")

    def where(test: Column, value: Column, name: str) -> Column:
        return F.when(test, value).alias(name)

    flat = F.when(spread, F.col("m2")).otherwise(0.0)
    return one.select(
        F.get(names, F.col("i")).alias("column"), "rows", F.col("n").alias("count"), where(some, F.col("total"), "total"),
        where(some, F.col("total") / n, "mean"), where(F.col("n") > 1, F.sqrt(flat / (F.greatest(n, F.lit(2)) - 1)), "std"), where(some, F.sqrt(flat / n), "std_pop"),
        "min", "max", where(spread, F.sqrt(n) * F.col("m3") / F.pow("m2", F.lit(1.5)), "skewness"),
        where(spread, n * F.col("m4") / (F.col("m2") * F.col("m2")) - 3, "kurtosis"), "negatives", "zeros")


def co_moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(i, j, rows, n, mx, my, cxx, cyy, cxy) of every pair i <= j over the rows where both are known, in one scan.

    A task centres on the means of its first batch; its sums are turned into moments about its own means, and those of all
    tasks are merged.
    """
    size = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, middle, sums = 0, None, np.zeros((6, size, size))
        for batch in batches:
            x = by_column(batch).T
            there = np.isfinite(x) | np.isinf(x)
            if middle is None and len(x):
                kept = np.isfinite(x)
                middle = np.where(kept, x, 0.0).sum(axis=0) / np.maximum(kept.sum(axis=0), 1)
            rows += len(x)
            if not len(x):
                continue
            with np.errstate(invalid="ignore", over="ignore"):
                x, there = np.where(there, x - middle, 0.0), there.astype("float64")
                sums += np.stack([there.T @ there, x.T @ there, there.T @ x, (x * x).T @ there, there.T @ (x * x), x.T @ x])
        if middle is None:
            return
        i, j = np.triu_indices(size)
        n, sx, sy, sxx, syy, sxy = sums[:, i, j]
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            by = np.maximum(n, 1)
            found = [middle[i] + sx / by, middle[j] + sy / by, sxx - sx * sx / by, syy - sy * sy / by, sxy - sx * sy / by]
        yield pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([rows] * len(i), pa.int64()), pa.array(n), *map(pa.array, found)],
            names=["i", "j", "rows", "n", "mx", "my", "cxx", "cyy", "cxy"])

    wide = df.select(*[as_double(df, c).alias(f"x{i}") for i, c in enumerate(columns)])
    parts = wide.mapInArrow(run, "i int, j int, rows long, n double, mx double, my double, cxx double, cyy double, cxy double")
    of = Window.partitionBy("i", "j")  # one row per task
    for c in "xy":
        parts = parts.withColumn(f"d{c}", F.when(F.col("n") > 0, F.col(f"m{c}") - F.try_divide(F.sum(F.col("n") * F.col(f"m{c}")).over(of), F.sum("n").over(of))).otherwise(0.0))
    n, dx, dy = F.col("n"), F.col("dx"), F.col("dy")
    return parts.groupBy("i", "j").agg(
        F.sum("rows").alias("rows"), F.sum("n").alias("n"), *[F.try_divide(F.sum(n * F.col(m)), F.sum(n)).alias(m) for m in ("mx", "my")],
        F.sum(F.col("cxx") + n * dx * dx).alias("cxx"), F.sum(F.col("cyy") + n * dy * dy).alias("cyy"), F.sum(F.col("cxy") + n * dx * dy).alias("cxy"))
