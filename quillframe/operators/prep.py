"""Cleaning steps: each takes a DataFrame and options and returns a DataFrame."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillframe.functions.columns import (
    FLOATING, TEMPORAL, as_double, comparable, dtype_of, finite, known, numeric_columns, plain,
)
from quillframe.operators import blocks

# Ingestion limits.
SAMPLE_THRESHOLD = 100_000
SAMPLE_SIZE = 50_000
MAX_STRATA = 50
MAX_NAME_LENGTH = 128


def _replace(df: DataFrame, changed: dict[str, Column]) -> DataFrame:
    return df.withColumns(changed) if changed else df


def drop_high_null(df: DataFrame, threshold_pct: float = 80) -> DataFrame:
    """Keep the columns whose share of nulls is at most ``threshold_pct``."""
    shares = blocks.stats_row(df, {c: F.avg(plain(df, c).isNull().cast("int")) * 100 for c in df.columns})
    return df.select(*[c for c in df.columns if (shares[c] or 0.0) <= threshold_pct])


def deduplicate(df: DataFrame, subset: Sequence[str] | None = None, order_by: Sequence | None = None) -> DataFrame:
    """One row per distinct row, or the first row by ``order_by`` per ``subset``.

    The rank filter is applied in every map task first, so a hot key reaches its reducer as
    one candidate per task. Of whole rows, those whose hash is single stay where they are read, and the others are compared.
    """
    if not subset:
        keys = {f"_k{i}": comparable(df, c) for i, c in enumerate(df.columns)}
        if not keys:
            return df.dropDuplicates()
        told = blocks.suspects(df.withColumns(keys), list(keys))
        single, rest = told.filter("NOT _suspect").select(*df.columns), told.filter("_suspect")
        return single.unionByName(rest.dropDuplicates(list(keys) if _has_wide(df) else df.columns).select(*df.columns))
    order = list(order_by or [c for c in df.columns if c not in subset])
    return blocks.top_per(df, list(subset), [F.col(o) if isinstance(o, str) else o for o in order], 1, "_rank").drop("_rank")


def _has_wide(df: DataFrame) -> bool:
    return any(isinstance(f.dataType, (T.MapType, T.BinaryType)) for f in df.schema)


def cast_column(df: DataFrame, name: str, kind: str) -> Column:
    """Cast to ``datetime``, ``numeric``, ``string`` or ``boolean``; bad values become null."""
    col, held = plain(df, name), dtype_of(df, name)
    if kind == "datetime":
        if isinstance(held, TEMPORAL):
            return col
        if isinstance(held, T.NumericType):  # numbers count nanoseconds since 1970
            return F.timestamp_micros((col / 1000).cast("long"))
        return F.try_to_timestamp(col)
    if kind == "numeric":
        return col if isinstance(held, T.NumericType) else F.expr(f"try_cast(`{name}` AS DOUBLE)")
    if kind == "string":
        return col.cast("string")
    if kind == "boolean":
        if isinstance(held, T.BooleanType):
            return col
        return col != 0 if isinstance(held, T.NumericType) else F.length(col.cast("string")) > 0
    raise ValueError(f"unknown type {kind!r}")


def type_cast(df: DataFrame, casts: dict[str, str]) -> DataFrame:
    return _replace(df, {c: cast_column(df, c, kind) for c, kind in casts.items() if c in df.columns})


def outlier_clip(df: DataFrame, method: str = "iqr", columns: Sequence[str] | None = None) -> DataFrame:
    """Clip to the 1.5·IQR fences or to mean ± 3·std. One statistics job, then a projection."""
    cols = known(df, columns) if columns else numeric_columns(df)
    limits: dict[str, tuple[float, float]] = {}
    if method == "iqr":
        for c, (q1, q3) in blocks.quantile_map(df, cols, [0.25, 0.75]).items():
            limits[c] = (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    elif method == "zscore":
        row = blocks.stats_row(df, {f"{n}{i}": f(as_double(df, c)) for i, c in enumerate(cols)
                                    for n, f in (("m", F.avg), ("s", F.stddev_samp))})
        for i, c in enumerate(cols):
            mean, std = row[f"m{i}"], row[f"s{i}"]
            if std and std > 0:
                limits[c] = (mean - 3 * std, mean + 3 * std)
    else:
        raise ValueError(f"unknown method {method!r}")
    return _replace(df, {
        c: F.when(plain(df, c).isNotNull(), F.greatest(F.least(as_double(df, c), F.lit(hi)), F.lit(lo)))
        for c, (lo, hi) in limits.items()
    })


def modes(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """Most frequent value per column, the smallest on ties."""
    counts = blocks.value_counts(df, columns)
    best = counts.groupBy("column").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("value"))
    return {r["column"]: r["value"] for r in best.collect()}


def impute(df: DataFrame, strategy: str = "median") -> DataFrame:
    """Fill numeric nulls with the median (or mean) and string nulls with the mode."""
    nulls = blocks.stats_row(df, {c: F.count_if(plain(df, c).isNull()) for c in df.columns})
    gaps = [c for c in df.columns if nulls[c]]
    numbers = [c for c in gaps if isinstance(dtype_of(df, c), T.NumericType)]
    strings = [c for c in gaps if isinstance(dtype_of(df, c), T.StringType)]
    if strategy == "median":
        fill = {c: q[0] for c, q in blocks.quantile_map(df, numbers, [0.5]).items()}
    else:
        fill = blocks.stats_row(df, {c: F.avg(as_double(df, c)) for c in numbers})
    filled = {c: F.coalesce(as_double(df, c), F.lit(fill[c])) for c in numbers if fill.get(c) is not None}
    if strings:
        common = modes(df, strings)
        filled.update({c: F.coalesce(F.col(c), F.lit(common.get(c, "unknown"))) for c in strings})
    return _replace(df, filled)


def normalize(df: DataFrame, method: str = "minmax", columns: Sequence[str] | None = None) -> DataFrame:
    """Scale to [0, 1], or to zero mean and unit std; constant columns stay as they are."""
    cols = known(df, columns) if columns else numeric_columns(df)
    first, second = {"minmax": (F.min, F.max), "zscore": (F.avg, F.stddev_samp)}[method]
    row = blocks.stats_row(df, {f"{n}{i}": f(as_double(df, c)) for i, c in enumerate(cols)
                                for n, f in (("a", first), ("b", second))})
    scaled = {}
    for i, c in enumerate(cols):
        a, b = row[f"a{i}"], row[f"b{i}"]
        if a is None or b is None:
            continue
        spread = b - a if method == "minmax" else b
        if spread > 0:
            scaled[c] = (as_double(df, c) - F.lit(a)) / F.lit(spread)
    return _replace(df, scaled)


def predicate(df: DataFrame, column: str, operator: str, value: Any) -> Column | None:
    """One filter condition; null for an unknown column or operator."""
    if column not in df.columns:
        return None
    col = F.col(f"`{column}`")  # bare, so that comparisons reach the scan
    number = ~F.isnan(col) if isinstance(dtype_of(df, column), FLOATING) else F.lit(True)  # NaN sorts above all numbers
    tests = {
        "eq": lambda: col == value,
        "ne": lambda: ~col.eqNullSafe(F.lit(value)),  # keeps nulls
        "gt": lambda: (col > value) & number,
        "lt": lambda: col < value,
        "gte": lambda: (col >= value) & number,
        "lte": lambda: col <= value,
        "in": lambda: col.isin(list(value)),
        "contains": lambda: F.coalesce(col.cast("string").rlike(str(value)), F.lit(False)),
    }
    return tests[operator]() if operator in tests else None


def filter_rows(df: DataFrame, conditions: Sequence[dict[str, Any]]) -> DataFrame:
    """AND of the known conditions, as one filter that reaches the scan."""
    tests = [predicate(df, c.get("column"), c.get("operator"), c.get("value")) for c in conditions]
    tests = [t for t in tests if t is not None]
    return df.filter(reduce(lambda a, b: a & b, tests)) if tests else df


def rename_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed({old: new for old, new in mapping.items() if old in df.columns})


def sort_keys(by: Sequence[str], ascending: bool | Sequence[bool] = True) -> list[Column]:
    flags = [ascending] * len(by) if isinstance(ascending, bool) else list(ascending)
    return [F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last() for c, up in zip(by, flags)]


def sort(df: DataFrame, by: str | Sequence[str], ascending: bool | Sequence[bool] = True) -> DataFrame:
    """Order by the known columns, nulls last in both directions."""
    names = [by] if isinstance(by, str) else list(by)
    flags = [ascending] * len(names) if isinstance(ascending, bool) else list(ascending)
    chosen = [(n, f) for n, f in zip(names, flags) if n in df.columns]
    return df.orderBy(*sort_keys([n for n, _ in chosen], [f for _, f in chosen])) if chosen else df


def sample(
    df: DataFrame, n: int | None = None, frac: float | None = None, seed: int = 42, key: Sequence[str] | None = None
) -> DataFrame:
    """``n`` rows, or ``round(frac * rows)`` rows, without replacement and repeatable."""
    if n:
        return blocks.hash_sample(df, n, key, seed)
    if frac:
        total = df.count()
        return blocks.hash_sample(df, round(frac * total), key, seed, total)
    return df


def stratified_sample(
    df: DataFrame,
    key: Sequence[str],
    threshold: int = SAMPLE_THRESHOLD,
    size: int = SAMPLE_SIZE,
    max_strata: int = MAX_STRATA,
    seed: int = 42,
) -> DataFrame:
    """Proportional sample over the first string column with at most ``max_strata`` values.

    Tables up to ``threshold`` rows pass through; without such a column a plain sample is taken.
    """
    total = df.count()
    if total <= threshold:
        return df
    stratum = _first_small_column(df, max_strata)
    if stratum is None:
        return blocks.hash_sample(df, size, key, seed, total)
    groups = df.filter(F.col(stratum).isNotNull()).groupBy(stratum).count().collect()  # at most max_strata rows
    quota = {r[stratum]: min(r["count"], max(1, size * r["count"] // total)) for r in groups}
    held = {r[stratum]: r["count"] for r in groups}
    hashed = df.filter(F.col(stratum).isNotNull()).withColumn("_h", blocks.row_hash(key, seed))
    hashed = _near_quota(hashed, stratum, quota, held)
    lookup = F.create_map(*[F.lit(x) for pair in quota.items() for x in pair])
    largest = max(quota.values())
    ranked = blocks.top_per(hashed, [stratum], [F.col("_h"), *[F.col(k) for k in key]], largest, "_rank")
    return ranked.filter(F.col("_rank") <= lookup[F.col(stratum)]).drop("_h", "_rank")


def _first_small_column(df: DataFrame, limit: int) -> str | None:
    names = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not names:
        return None
    close = blocks.stats_row(df, {n: F.approx_count_distinct(n) for n in names})
    for n in names:  # the estimate only rules out columns far above the limit
        if close[n] <= 2 * limit and df.select(n).filter(F.col(n).isNotNull()).distinct().limit(limit + 1).count() <= limit:
            return n
    return None


def _near_quota(hashed: DataFrame, stratum: str, quota: dict, held: dict) -> DataFrame:
    """Drop rows whose hash is far beyond their stratum's quota; strata left short keep all rows."""
    cut = {g: (q + 10 * q**0.5 + 100) / held[g] for g, q in quota.items() if held[g] > 20 * q + 2000}
    if not cut:
        return hashed

    def passing(cuts):
        bound = F.create_map(*[F.lit(x) for pair in cuts.items() for x in pair])[F.col(stratum)]
        return hashed.filter(bound.isNull() | (blocks.hash_fraction(F.col("_h")) < bound))

    found = {r[stratum]: r["count"] for r in passing(cut).groupBy(stratum).count().collect()}
    cut = {g: c for g, c in cut.items() if found.get(g, 0) >= quota[g]}
    return passing(cut) if cut else hashed


def sanitize(df: DataFrame) -> DataFrame:
    """NaN and infinities become null."""
    return df.select(*[
        (finite(F.col(f"`{f.name}`")) if isinstance(f.dataType, FLOATING) else F.col(f"`{f.name}`")).alias(f.name)
        for f in df.schema
    ])


def clean_name(name: str) -> str:
    return re.sub(r"\W", "_", str(name))[:MAX_NAME_LENGTH]


def sanitize_names(df: DataFrame) -> DataFrame:
    """Word characters only, at most 128; a clash gets a numeric suffix."""
    taken: set[str] = set()
    fresh = []
    for name in df.columns:
        base = candidate = clean_name(name)
        i = 1
        while candidate in taken:
            i += 1
            candidate = f"{base[: MAX_NAME_LENGTH - len(str(i)) - 1]}_{i}"
        taken.add(candidate)
        fresh.append(candidate)
    return df.toDF(*fresh)
