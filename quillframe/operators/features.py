"""Feature columns: date parts, scaling, log transform and label codes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillframe.functions.columns import as_double, dtype_of, known, numeric_columns, string_columns
from quillframe.functions.messages import REASONS
from quillframe.functions.scalars import monday_zero
from quillframe.operators import blocks, profile
from quillframe.operators.prep import cast_column

# Fixed value: more labels than this are not encoded.
MAX_LABELS = 50


def _dates(df: DataFrame, columns: Sequence[str] | None) -> list[str]:
    if columns:
        return known(df, columns)
    return [c for c, t in profile.logical_types(df).items() if t == "datetime"]


def _date_columns(df: DataFrame, columns: Sequence[str]) -> dict[str, Column]:
    when = {c: cast_column(df, c, "datetime") for c in columns}
    filled = blocks.stats_row(df, {c: F.count(w) for c, w in when.items()})
    parts = {"year": F.year, "month": F.month, "dow": monday_zero}
    return {f"{c}_{name}": f(when[c]) for c in columns if filled[c] for name, f in parts.items()}


def date_parts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``_year``, ``_month`` and ``_dow`` (Monday = 0) for datetime columns that hold a value."""
    return df.withColumns(_date_columns(df, _dates(df, columns)))


def _number_stats(df: DataFrame, cols: Sequence[str]) -> dict:
    makers = (("n", F.count), ("m", F.avg), ("s", F.stddev_samp), ("k", F.skewness), ("l", F.min))
    return blocks.stats_row(df, {f"{n}{i}": f(as_double(df, c)) for i, c in enumerate(cols) for n, f in makers})


def _scaled(df: DataFrame, cols: Sequence[str], row: dict) -> dict[str, Column]:
    return {f"{c}_scaled": (as_double(df, c) - F.lit(row[f"m{i}"])) / F.lit(row[f"s{i}"])
            for i, c in enumerate(cols) if row[f"n{i}"] > 1 and (row[f"s{i}"] or 0) > 0}


def _logged(df: DataFrame, cols: Sequence[str], row: dict) -> dict[str, Column]:
    return {f"{c}_log": F.log1p(as_double(df, c)) for i, c in enumerate(cols)
            if row[f"k{i}"] is not None and row[f"k{i}"] > 1 and row[f"l{i}"] > 0}


def zscore_scale(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``_scaled`` = (x − mean) / std for numeric columns that vary."""
    cols = known(df, columns) if columns else numeric_columns(df)
    return df.withColumns(_scaled(df, cols, _number_stats(df, cols)))


def log1p_if_skewed(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``_log`` = ln(1 + x) for positive columns with skewness above 1."""
    cols = known(df, columns) if columns else numeric_columns(df)
    return df.withColumns(_logged(df, cols, _number_stats(df, cols)))


def _label_lists(df: DataFrame, cols: Sequence[str]) -> dict[str, list[str]]:
    """Sorted distinct values of the columns that are low or medium in cardinality and small."""
    if not cols:
        return {}
    close = blocks.stats_row(df, {"_rows": F.count("*"), **{c: F.approx_count_distinct(F.col(f"`{c}`")) for c in cols}})
    labels = {}
    for c in cols:  # the estimate only rules out columns far above the limit
        if close[c] > 2 * MAX_LABELS:
            continue
        found = df.select(F.col(f"`{c}`").cast("string").alias("v")).filter("v IS NOT NULL").distinct().limit(MAX_LABELS + 1).collect()
        high = len(found) > profile.LOW_CARDINALITY and len(found) / max(close["_rows"], 1) > profile.HIGH_CARDINALITY_RATIO
        if 0 < len(found) <= MAX_LABELS and not high:
            labels[c] = sorted(r["v"] for r in found)
    return labels


def _encoded(df: DataFrame, labels: dict[str, list[str]]) -> dict[str, Column]:
    return {
        f"{c}_enc": F.create_map(*[F.lit(x) for i, v in enumerate(values) for x in (v, i)])[F.col(f"`{c}`").cast("string")]
        for c, values in labels.items()
    }


def label_encode(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``_enc`` = place among the sorted distinct values; null stays null."""
    cols = known(df, columns) if columns else string_columns(df)
    return df.withColumns(_encoded(df, _label_lists(df, cols)))


def engineer(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """All feature steps by logical type, and a log of what was added."""
    types = profile.logical_types(df)
    dates = [c for c, t in types.items() if t == "datetime"]
    numbers = [c for c, t in types.items() if t == "numeric"]
    cats = [c for c, t in types.items() if t == "categorical" and isinstance(dtype_of(df, c), T.StringType)]
    row = _number_stats(df, numbers) if numbers else {}
    made = [
        (_date_columns(df, dates), REASONS["made_dates"]),
        (_scaled(df, numbers, row), REASONS["made_scaled"]),
        (_logged(df, numbers, row), REASONS["made_logged"]),
        (_encoded(df, _label_lists(df, cats)), REASONS["made_encoded"]),
    ]
    columns: dict[str, Column] = {}
    log: list[str] = []
    for found, message in made:
        columns.update(found)
        log += [message.format(name) for name in dict.fromkeys(n.rsplit("_", 1)[0] for n in found)]
    return df.withColumns(columns) if columns else df, log
