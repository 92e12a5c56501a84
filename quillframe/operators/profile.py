"""Schema inference, profiling and data-quality reports as one row per column or finding."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillframe.functions.columns import (
    FLOATING, NESTED, TEMPORAL, as_double, comparable, dtype_of, known, numeric_columns, percent, plain, string_columns,
)
from quillframe.functions.messages import REASONS
from quillframe.operators import blocks
from quillframe.operators.summaries import summaries
from quillframe.session import write_out

# Thresholds of the reports.
LOW_CARDINALITY = 10
HIGH_CARDINALITY_RATIO = 0.8
TEXT_LENGTH = 40
TOP_VALUES = 10
SAMPLE_VALUES = 5


# --- logical types --------------------------------------------------------------------


def _typed(df: DataFrame, name: str) -> str | None:
    """Logical type decided by the Spark type alone; None for strings."""
    kind = dtype_of(df, name)
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, TEMPORAL):
        return "datetime"
    if isinstance(kind, T.NumericType):
        return "numeric"
    if isinstance(kind, NESTED):
        return "nested"
    return None if isinstance(kind, T.StringType) else "categorical"


def _string_probe(df: DataFrame, name: str) -> Column:
    """Type of a string column over all its values: datetime if every one parses, text if long."""
    col = F.col(f"`{name}`")
    dates = F.count_if(F.try_to_timestamp(col).isNotNull())
    return (
        F.when(F.count(col) == 0, "categorical")
        .when(dates == F.count(col), "datetime")
        .when(F.avg(F.length(col)) > TEXT_LENGTH, "text")
        .otherwise("categorical")
    )


def logical_types(df: DataFrame) -> dict[str, str]:
    """Logical type of every column (one row collected; no job without string columns)."""
    fixed = {c: _typed(df, c) for c in df.columns}
    probed = blocks.stats_row(df, {c: _string_probe(df, c) for c, t in fixed.items() if t is None})
    return {c: t or probed[c] for c, t in fixed.items()}


def cardinality(unique: Column, rows: Column) -> Column:
    ratio = unique / F.greatest(rows, F.lit(1))
    return (
        F.when(unique <= LOW_CARDINALITY, "low").when(ratio > HIGH_CARDINALITY_RATIO, "high").otherwise("medium")
    )


def _kind(kind: T.DataType) -> str:
    """Columns of one kind share a distinct count."""
    if isinstance(kind, (T.IntegralType, T.BooleanType)):
        return "bigint"
    if isinstance(kind, FLOATING):
        return "double"
    return kind.simpleString() if isinstance(kind, (*TEMPORAL, T.DecimalType)) else "string"


def cells(df: DataFrame, columns: Sequence[str], first: int = 0) -> dict[str, DataFrame]:
    """Per kind: (cell, value) for every non-null value; ``cell`` numbers the columns from ``first``."""
    kinds: dict[str, list[Column]] = {}
    for i, c in enumerate(columns):
        kind = _kind(dtype_of(df, c))
        value = comparable(df, c).cast(kind)
        kinds.setdefault(kind, []).append(F.struct(F.lit(first + i).alias("cell"), value.alias("value")))
    return {k: df.select(F.inline(F.array(*pairs))).filter("value IS NOT NULL") for k, pairs in kinds.items()}


def distinct_cells(tables: Sequence[dict[str, DataFrame]]) -> DataFrame:
    """(cell, unique_count), with one shuffle per kind for all tables together."""
    parts: dict[str, DataFrame] = {}
    for kinds in tables:
        for kind, part in kinds.items():
            parts[kind] = parts[kind].unionByName(part) if kind in parts else part
    counts = [p.distinct().groupBy("cell").agg(F.count("*").alias("unique_count")) for p in parts.values()]
    return reduce(DataFrame.unionByName, counts)


def unique_counts(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """(column, unique_count): distinct non-null values."""
    columns = list(df.columns if columns is None else columns)
    if not columns:
        return df.limit(0).select(F.lit("").alias("column"), F.lit(0).cast("bigint").alias("unique_count"))
    if exact:
        named = F.array(*[F.struct(F.lit(i).alias("cell"), F.lit(c).alias("column")) for i, c in enumerate(columns)])
        names = df.sparkSession.range(1).select(F.inline(named))
        found = names.join(F.broadcast(distinct_cells([cells(df, columns)])), "cell", "left")  # one row per column
        return found.select("column", F.coalesce("unique_count", F.lit(0)).alias("unique_count"))
    one = df.agg(*[F.approx_count_distinct(comparable(df, c)).alias(f"u{i}") for i, c in enumerate(columns)])
    return blocks.rows_per_column(one, [
        {"column": F.lit(c), "unique_count": F.col(f"u{i}")} for i, c in enumerate(columns)])


def sample_values(df: DataFrame, order_by: Sequence[str] | None = None, k: int = SAMPLE_VALUES) -> DataFrame:
    """(column, sample_values): the first ``k`` non-null values, by ``order_by`` if given."""
    keys = [F.col(f"`{c}`") for c in order_by or []]
    cells = []
    for i, c in enumerate(df.columns):
        shown = F.to_json(F.col(f"`{c}`")) if isinstance(dtype_of(df, c), NESTED) else plain(df, c).cast("string")
        cells.append(F.struct(F.lit(i).alias("i"), F.lit(c).alias("column"), shown.alias("value")))
    names = [f"_o{j}" for j in range(len(keys))]
    rows = df.select(*[k.alias(n) for k, n in zip(keys, names)], F.inline(F.array(*cells))).filter("value IS NOT NULL")
    first = blocks.top_per(rows, ["i", "column"], [*names, "value"] if names else [F.lit(0)], k, "_rank")
    return first.groupBy("i", "column").agg(  # at most k values per column
        F.array_sort(F.collect_list(F.struct("_rank", "value"))).alias("_s")).select(
        "column", F.transform("_s", lambda s: s["value"]).alias("sample_values"))


def column_stats(df: DataFrame) -> DataFrame:
    """One row per column: types, nulls and range. Two scans for any number of columns: one for the numbers, one for the rest."""
    fixed = {c: _typed(df, c) for c in df.columns}
    numbers = numeric_columns(df)
    others = [c for c in df.columns if c not in numbers]
    text = [F.col(c).cast("string").alias(c) for c in ("min_val", "max_val")]
    parts = []
    if numbers:
        parts.append(summaries(df, numbers).select(
            "column", "rows", "count", F.lit("numeric").alias("inferred_type"), F.col("min").cast("string").alias("min_val"),
            F.col("max").cast("string").alias("max_val"), F.col("mean").alias("mean_val"), F.col("std").alias("std_val")))
    if others:
        parts.append(_other_stats(df, others, fixed).select(
            "column", "rows", "count", "inferred_type", *text, F.lit(None).cast("double").alias("mean_val"), F.lit(None).cast("double").alias("std_val")))
    if not parts:
        return df.sparkSession.createDataFrame([], f"position int, column string, dtype string, {STAT_FIELDS}")
    nulls = F.col("rows") - F.col("count")
    places = F.create_map(*[F.lit(x) for i, c in enumerate(df.columns) for x in (c, i)])
    kinds = F.create_map(*[F.lit(x) for c in df.columns for x in (c, dtype_of(df, c).simpleString())])
    return reduce(DataFrame.unionByName, parts).select(
        places[F.col("column")].alias("position"), "column", kinds[F.col("column")].alias("dtype"), "inferred_type", "rows", nulls.alias("null_count"),
        F.coalesce(percent(nulls, F.col("rows")), F.lit(0.0)).alias("null_pct"), "min_val", "max_val", "mean_val", "std_val")


STAT_FIELDS = ("inferred_type string, rows bigint, null_count bigint, null_pct double, min_val string, max_val string, "
               "mean_val double, std_val double")


def _other_stats(df: DataFrame, columns: Sequence[str], fixed: dict[str, str | None]) -> DataFrame:
    """(column, rows, count, inferred_type, min_val, max_val) of columns that are no numbers, folded as cells.

    Times are compared as times. Strings are dates if all parse; only then do they have a range.
    """
    kinds = ("date", "timestamp", "timestamp_ntz")
    cells = []
    for i, c in enumerate(columns):
        kind, col = dtype_of(df, c), F.col(f"`{c}`")
        is_text = isinstance(kind, T.StringType)
        times = [(col if kind.typeName() == k else F.lit(None)).cast(k).alias(k) for k in kinds]
        cells.append(F.struct(
            F.lit(i).alias("i"), col.isNotNull().alias("known"), F.length(col if is_text else F.lit(None).cast("string")).alias("length"),
            (F.try_to_timestamp(col) if is_text else F.lit(None).cast("timestamp")).alias("parsed"), *times))
    folded = df.select(F.inline(F.array(*cells))).groupBy("i").agg(
        F.count("*").alias("rows"), F.count_if("known").alias("count"), F.avg("length").alias("length"), F.count("parsed").alias("dates"),
        *[end(k).cast("string").alias(f"{n}_{k}") for k in ("parsed", *kinds) for n, end in (("lo", F.min), ("hi", F.max))])
    of_text = F.when(F.col("count") == 0, "categorical").when(F.col("dates") == F.col("count"), "datetime").when(
        F.col("length") > TEXT_LENGTH, "text").otherwise("categorical")
    named = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("column"), F.lit(fixed[c]).cast("string").alias("fixed")) for i, c in enumerate(columns)])
    found = df.sparkSession.range(1).select(F.inline(named)).join(F.broadcast(folded), "i", "left")  # one row per column
    zero = F.lit(0).cast("long")
    found = found.withColumns({"rows": F.coalesce("rows", zero), "count": F.coalesce("count", zero), "dates": F.coalesce("dates", zero)})
    found = found.withColumn("inferred_type", F.coalesce("fixed", of_text))
    is_date = F.col("fixed").isNull() & (F.col("inferred_type") == "datetime")
    return found.select("column", "rows", "count", "inferred_type", *[
        F.when(is_date, F.col(f"{n}_parsed")).otherwise(F.coalesce(*[f"{n}_{k}" for k in kinds])).alias(f"{end}_val")
        for n, end in (("lo", "min"), ("hi", "max"))])


SCHEMA_FIELDS = (
    "position", "name", "dtype", "inferred_type", "rows", "null_count", "null_pct", "unique_count", "cardinality",
    "sample_values", "min_val", "max_val", "mean_val", "std_val",
)


def infer_schema(df: DataFrame, order_by: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """One row per column: types, nulls, distinct values, samples and range."""
    out = column_stats(df).join(F.broadcast(unique_counts(df, exact=exact)), "column")  # one row per column
    out = out.join(F.broadcast(sample_values(df, order_by)), "column", "left").withColumnRenamed("column", "name")
    return out.withColumn("cardinality", cardinality(F.col("unique_count"), F.col("rows"))).select(*SCHEMA_FIELDS)


# --- nulls, duplicates, quality -------------------------------------------------------


def null_counts(df: DataFrame) -> DataFrame:
    """(column, rows, nulls), one row per column from one aggregation; empty without columns."""
    if not df.columns:
        return df.sparkSession.createDataFrame([], "column string, rows bigint, nulls bigint")
    one = df.agg(F.count("*").alias("rows"), *[F.count(plain(df, c)).alias(f"n{i}") for i, c in enumerate(df.columns)])
    return blocks.rows_per_column(one, [
        {"column": F.lit(c), "rows": F.col("rows"), "nulls": F.col("rows") - F.col(f"n{i}")}
        for i, c in enumerate(df.columns)])


def missing_report(df: DataFrame) -> DataFrame:
    """Columns with nulls (count, %), plus the table's total and completeness on every row."""
    counts = null_counts(df)
    totals = counts.agg(
        F.sum("nulls").alias("total_missing"),
        F.bround((1 - F.sum("nulls") / F.sum("rows")) * 100, 2).alias("completeness_pct"))
    return (
        counts.filter(F.col("nulls") > 0).crossJoin(F.broadcast(totals))  # totals is one row
        .select("column", F.col("nulls").alias("missing_count"), percent(F.col("nulls"), F.col("rows")).alias("missing_pct"),
                "total_missing", "completeness_pct")
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: how many rows equal an earlier row. Only rows whose hash is not single are compared; long strings travel as digests."""
    if not df.columns:
        return df.agg(F.count("*").alias("rows")).withColumn("duplicate_rows", F.greatest(F.col("rows") - 1, F.lit(0)))
    keys = df.select(*[comparable(df, c).alias(f"k{i}") for i, c in enumerate(df.columns)])
    counts = blocks.suspects(keys, keys.columns).filter("_suspect").groupBy(*keys.columns).agg(F.count("*").alias("c"))
    again = counts.agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("duplicate_rows"))
    return df.agg(F.count("*").alias("rows")).crossJoin(F.broadcast(again))  # one row each


# The lexical kinds a raw string column may mix.
STRING_KINDS = {
    "int": r"^[+-]?\d+$",
    "decimal": r"^[+-]?(\d+\.\d*|\.\d+)([eE][+-]?\d+)?$",
    "bool": r"^(?i)(true|false)$",
    "date": r"^\d{4}-\d{2}-\d{2}",
}


def mixed_columns(df: DataFrame) -> DataFrame:
    """One row: string columns whose values fall into more than one lexical kind."""
    flags, kinds = [], []
    for i, c in enumerate(string_columns(df)):
        col = F.col(f"`{c}`")
        tests = [col.rlike(p) for p in STRING_KINDS.values()]
        other = ~(tests[0] | tests[1] | tests[2] | tests[3])
        for j, test in enumerate([*tests, other]):
            flags.append(F.coalesce(F.bool_or(test), F.lit(False)).cast("int").alias(f"f{i}_{j}"))
        kinds.append(F.when(sum((F.col(f"f{i}_{j}") for j in range(1, 5)), F.col(f"f{i}_0")) > 1, 1).otherwise(0))
    if not flags:
        return df.sparkSession.range(1).select(F.lit(0).alias("mixed_columns"))
    return df.agg(*flags).select(sum(kinds[1:], kinds[0]).alias("mixed_columns"))


def quality_score(df: DataFrame, raw_strings: bool = False) -> DataFrame:
    """One row: completeness (40), uniqueness (30), consistency (30) and their sum.

    ``raw_strings`` also counts string columns of mixed lexical kinds; typed columns cannot mix.
    """
    nulls = null_counts(df).agg(F.sum("nulls").alias("nulls"), F.sum("rows").alias("cells"))
    mixed = mixed_columns(df) if raw_strings else df.sparkSession.range(1).select(F.lit(0).alias("mixed_columns"))
    one = F.broadcast(nulls).crossJoin(F.broadcast(mixed)).crossJoin(duplicate_rows(df))  # three single rows
    complete = (1 - F.col("nulls") / F.col("cells")) * 40
    unique = (1 - F.col("duplicate_rows") / F.col("rows")) * 30
    consistent = (1 - F.col("mixed_columns") / F.lit(max(len(df.columns), 1))) * 30
    empty = F.col("rows") == 0
    part = lambda x: F.when(empty, 0.0).otherwise(F.bround(x, 2))
    return one.select(
        part(complete).alias("completeness"), part(unique).alias("uniqueness"),
        part(consistent).alias("consistency"), part(complete + unique + consistent).alias("quality_score"))


def validate_quality(df: DataFrame) -> DataFrame:
    """(severity, column, message, is_valid): null and duplicate findings."""
    nulls = null_counts(df)
    share = percent(F.col("nulls"), F.greatest(F.col("rows"), F.lit(1)))
    by_column = nulls.select(
        F.when(share > 50, "issue").when(share > 20, "warning").alias("severity"), "column",
        F.format_string(REASONS["null_share"], "column", share).alias("message"))
    ratio = F.try_divide(F.col("duplicate_rows"), F.col("rows"))
    repeated = duplicate_rows(df).select(
        F.when(ratio > 0.1, "issue").when(F.col("duplicate_rows") > 0, "warning").alias("severity"),
        F.lit(None).cast("string").alias("column"),
        F.when(ratio > 0.1, F.format_string(REASONS["duplicates_share"], "duplicate_rows", ratio * 100))
        .otherwise(F.format_string(REASONS["duplicates"], "duplicate_rows")).alias("message"))
    found = by_column.unionByName(repeated).filter(F.col("severity").isNotNull())
    valid = found.agg((F.count_if(F.col("severity") == "issue") == 0).alias("is_valid"))
    return found.crossJoin(F.broadcast(valid))  # one row


def quality_warnings(df: DataFrame, raw_strings: bool = False) -> DataFrame:
    """Columns more than 30 % missing, and a table score below 60."""
    missing = missing_report(df).filter(F.col("missing_pct") > 30).select(
        "column", F.format_string(REASONS["missing_share"], "column", F.col("missing_pct").cast("string")).alias("message"))
    score = quality_score(df, raw_strings).filter(F.col("quality_score") < 60).select(
        F.lit(None).cast("string").alias("column"),
        F.format_string(REASONS["score_low"], F.col("quality_score").cast("string")).alias("message"))
    return missing.unionByName(score)


# --- distributions --------------------------------------------------------------------


def value_counts(df: DataFrame, columns: Sequence[str] | None = None, k: int = TOP_VALUES) -> DataFrame:
    """(column, rank, value, n): the ``k`` most frequent values, smallest first on ties."""
    counts = blocks.value_counts(df, string_columns(df) if columns is None else list(columns))
    return blocks.top_per(counts, ["column"], [F.col("n").desc(), F.col("value")], k)


def entropy(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, entropy in bits) over the value frequencies."""
    cols = string_columns(df) if columns is None else list(columns)
    return _entropy_of(blocks.value_counts(df, cols, {c: comparable(df, c) for c in cols}))  # long strings travel as digests


def _entropy_of(counts: DataFrame) -> DataFrame:
    totals = counts.groupBy("column").agg(F.sum("n").alias("total"))
    p = F.col("n") / F.col("total")
    return (
        counts.join(F.broadcast(totals), "column")  # one row per column
        .groupBy("column").agg(F.bround(F.sum(-p * F.log2(p + 1e-10)), 4).alias("entropy"))
    )


def summary_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Numeric columns: count, mean, std, min, 25/50/75/90 %, max."""
    cols = known(df, columns) if columns else numeric_columns(df)
    base = summaries(df, cols).select("column", "count", "mean", "std", "min", "max")
    q = blocks.quantiles(df, cols, [0.25, 0.5, 0.75, 0.9])
    q = q.select("column", *[F.col("q")[i].alias(n) for i, n in enumerate(["p25", "p50", "p75", "p90"])])
    return base.join(F.broadcast(q), "column", "left")  # one row per column


def summary_categories(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """String columns: top ten values, distinct count and null share."""
    cols = known(df, columns) if columns else string_columns(df)
    tops = value_counts(df, cols).groupBy("column").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "value", "n"))),
                    lambda s: F.struct(s["value"], s["n"])).alias("top_values"))
    nulls = null_counts(df.select(*cols)).select("column", percent(F.col("nulls"), F.col("rows")).alias("null_pct"))
    return nulls.join(F.broadcast(unique_counts(df, cols)), "column").join(F.broadcast(tops), "column", "left")


def histogram(df: DataFrame, column: str, max_bins: int, min_bins: int = 1, by_distinct: bool = True) -> DataFrame:
    """(bin, lo, hi, n): equal-width bins, the last closed on the right, empty bins kept."""
    x = as_double(df, column)
    row = blocks.stats_row(df, {"lo": F.min(x), "hi": F.max(x)})
    spark = df.sparkSession
    if row["lo"] is None:
        return spark.createDataFrame([], "bin int, lo double, hi double, n bigint")
    bins = max_bins
    if by_distinct:  # min(max_bins, distinct): only the first max_bins distinct values matter
        distinct = df.select(x.alias("x")).filter("x IS NOT NULL").distinct().limit(max_bins).count()
        bins = min(max_bins, max(min_bins, distinct))
    lo, hi = row["lo"], row["hi"]
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    guess = F.least(F.floor((x - lo) / (hi - lo) * bins), F.lit(bins - 1))
    index = (  # the edges decide where rounding of the guess crossed one
        F.when(x < F.lit(lo) + guess * width, guess - 1)
        .when((x >= F.lit(lo) + (guess + 1) * width) & (guess < bins - 1), guess + 1)
        .otherwise(guess).cast("int"))
    counted = df.filter(x.isNotNull()).groupBy(index.alias("bin")).agg(F.count("*").alias("n"))
    return (
        spark.range(bins).select(F.col("id").cast("int").alias("bin"))
        .join(F.broadcast(counted), "bin", "left")  # at most max_bins rows
        .select("bin", (F.lit(lo) + F.col("bin") * width).alias("lo"),
                F.when(F.col("bin") == bins - 1, F.lit(hi)).otherwise(F.lit(lo) + (F.col("bin") + 1) * width).alias("hi"),
                F.coalesce("n", F.lit(0)).alias("n"))
    )


def distribution(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Numeric columns: skew, excess kurtosis (both population) and five quantiles."""
    cols = known(df, columns) if columns else numeric_columns(df)
    base = summaries(df, cols).select("column", F.bround("skewness", 4).alias("skewness"), F.bround("kurtosis", 4).alias("kurtosis"))
    names = ["p5", "p25", "p50", "p75", "p95"]
    q = blocks.quantiles(df, cols, [0.05, 0.25, 0.5, 0.75, 0.95])
    q = q.select("column", *[F.col("q")[i].alias(n) for i, n in enumerate(names)])
    return base.join(F.broadcast(q), "column", "left")  # one row per column


def distribution_histograms(df: DataFrame, columns: Sequence[str] | None = None, max_bins: int = 20) -> DataFrame:
    """(column, bin, lo, hi, n) for numeric columns: equal-width bins, as many as distinct values but at most ``max_bins``.

    Two passes for any number of columns: one folds equal values and takes the bounds, one counts the bins.
    """
    cols = known(df, columns) if columns else numeric_columns(df)
    values = write_out(blocks.long_form(df, cols).groupBy("column", "value").agg(F.count("*").alias("c")), "value-counts")
    shape = values.groupBy("column").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("distinct"))
    flat = F.col("lo") == F.col("hi")
    shape = shape.select(
        "column", F.least("distinct", F.lit(max_bins)).cast("int").alias("bins"),
        F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    shape = shape.withColumn("width", (F.col("hi") - F.col("lo")) / F.col("bins"))
    x, lo, width, bins = (F.col(c) for c in ("value", "lo", "width", "bins"))
    guess = F.least(F.floor((x - lo) / (F.col("hi") - lo) * bins), bins - 1)
    index = (  # the edges decide where rounding of the guess crossed one
        F.when(x < lo + guess * width, guess - 1)
        .when((x >= lo + (guess + 1) * width) & (guess < bins - 1), guess + 1).otherwise(guess).cast("int"))
    counted = blocks.join_small(values, shape, ["column"]).groupBy("column", index.alias("bin")).agg(F.sum("c").alias("n"))
    edges = shape.withColumn("bin", F.explode(F.sequence(F.lit(0), bins - 1)))  # at most max_bins rows per column
    upper = F.when(F.col("bin") == bins - 1, F.col("hi")).otherwise(lo + (F.col("bin") + 1) * width)
    return edges.join(counted, ["column", "bin"], "left").select(
        "column", "bin", F.bround(lo + F.col("bin") * width, 4).alias("lo"), F.bround(upper, 4).alias("hi"), F.coalesce("n", F.lit(0)).alias("n"))


def distribution_categories(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """String columns: top ten values, distinct count and mode."""
    cats = summary_categories(df, columns)
    return cats.select("column", "top_values", "unique_count", F.try_element_at("top_values", F.lit(1))["value"].alias("mode"))


def profile_table(df: DataFrame) -> DataFrame:
    """One row: rows, columns, cells, missing cells and duplicate rows."""
    nulls = null_counts(df).agg(F.sum("nulls").alias("missing_cells"))
    return duplicate_rows(df).crossJoin(F.broadcast(nulls)).select(  # one row each
        F.col("rows").alias("row_count"), F.lit(len(df.columns)).alias("col_count"),
        (F.col("rows") * len(df.columns)).alias("total_cells"), "missing_cells", "duplicate_rows")


def profile_dataset(df: DataFrame, exact: bool = True) -> DataFrame:
    """One row per column: counts, shape, numeric moments and quantiles, frequent values.

    Without ``exact`` the distinct counts are estimates, and no cells are shuffled for them.
    """
    types = logical_types(df)
    rows = F.col("rows")
    numbers = [c for c, t in types.items() if t == "numeric"]
    cats = [c for c, t in types.items() if t == "categorical"]
    kinds = F.create_map(*[F.lit(x) for c in df.columns for x in (c, types[c])])
    order = F.create_map(*[F.lit(x) for i, c in enumerate(df.columns) for x in (c, i)])
    out = null_counts(df).join(F.broadcast(unique_counts(df, exact=exact)), "column").select(
        order[F.col("column")].alias("position"), F.col("column").alias("name"), kinds[F.col("column")].alias("type"),
        rows.alias("total_count"), F.col("nulls").alias("null_count"), percent(F.col("nulls"), rows).alias("null_pct"),
        "unique_count", (F.col("unique_count") <= 1).alias("is_constant"), (F.col("unique_count") == rows).alias("is_unique"))
    # The tables joined below hold one row per column.
    if numbers:
        some = F.col("count") > 0
        moments = summaries(df, numbers).select(
            "column", "mean", "std", "min", "max", F.bround("skewness", 4).alias("skewness"), F.bround("kurtosis", 4).alias("kurtosis"),
            F.when(some, F.col("negatives") > 0).alias("has_negatives"), F.when(some, F.col("zeros") > 0).alias("has_zeros"))
        q = blocks.quantiles(df, numbers, [0.25, 0.5, 0.75, 0.95])
        q = q.select("column", *[F.col("q")[i].alias(n) for i, n in enumerate(["p25", "p50", "p75", "p95"])])
        moments = moments.join(F.broadcast(q), "column", "left").withColumnRenamed("column", "name")
        out = out.join(F.broadcast(moments), "name", "left")
    if cats:
        counts = write_out(blocks.value_counts(df, cats), "value-counts")
        tops = blocks.top_per(counts, ["column"], [F.col("n").desc(), F.col("value")], TOP_VALUES)
        tops = tops.groupBy("column").agg(
            F.array_sort(F.collect_list(F.struct("rank", "value", "n"))).alias("_t"))
        tops = tops.select("column", F.transform("_t", lambda s: F.struct(s["value"], s["n"])).alias("top_10"))
        tops = tops.join(F.broadcast(_entropy_of(counts)), "column").withColumnRenamed("column", "name")
        out = out.join(F.broadcast(tops), "name", "left").withColumns({
            "top_value": F.try_element_at("top_10", F.lit(1))["value"],
            "top_value_pct": percent(F.try_element_at("top_10", F.lit(1))["n"], F.col("total_count"))})
    return out


def fingerprint(df: DataFrame, content: bool = False) -> DataFrame:
    """SHA-256 of the column names and shape; ``content`` adds an order-free sum of row hashes."""
    names = "[" + ", ".join(f"'{c}'" for c in df.columns) + "]"
    aggregates = [F.count("*").alias("rows")]
    if content:
        aggregates.append(F.sum(F.xxhash64(*df.columns).cast("decimal(20,0)")).alias("content_hash"))
    shape = F.concat(F.lit(f"{names}("), F.col("rows").cast("string"), F.lit(f", {len(df.columns)})"))
    return df.agg(*aggregates).withColumn("fingerprint", F.sha2(shape, 256))


def unique_ratio(df: DataFrame, first: int = 4, exact: bool = True) -> DataFrame:
    """(column, unique_pct) for the first columns: distinct values over rows, one decimal."""
    cols = df.columns[:first]
    rows = null_counts(df.select(*cols))
    return rows.join(F.broadcast(unique_counts(df, cols, exact)), "column").select(
        "column", "unique_count", percent(F.col("unique_count"), F.col("rows"), 1).alias("unique_pct"))
