"""Correlation, outliers and anomalies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillframe.functions.columns import as_double, known, numeric_columns, percent
from quillframe.functions.pvalues import correlation_p
from quillframe.functions.scalars import corr_strength
from quillframe.operators import blocks
from quillframe.operators.summaries import co_moments, summaries
from quillframe.session import write_out

# Fixed values.
MIN_CORRELATION_ROWS = 30
MIN_DEEP_ROWS = 10
MIN_OUTLIER_ROWS = 5
MIN_ANOMALY_ROWS = 10
Z_THRESHOLD = 3.0
IQR_FACTOR = 1.5
LISTED_ANOMALIES = 20

def _cols(df: DataFrame, columns) -> list[str]:
    return known(df, columns) if columns else numeric_columns(df)


def _pair_correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, column_a, column_b, rows, corr) for a <= b in column order, pairwise complete; null where one side is constant."""
    names = F.array(*[F.lit(c) for c in columns]).cast("array<string>")
    found = co_moments(df, columns)

    def spread(squares: str, mean: str) -> Column:
        noise = F.pow(F.col(mean) * 1e-14, F.lit(2)) * F.col("n")  # of rounding around the mean
        return F.when(F.col(squares) > noise, F.col(squares))

    corr = F.nanvl(F.col("cxy") / F.sqrt(spread("cxx", "mx") * spread("cyy", "my")), F.lit(None))
    corr = F.when(F.col("i") == F.col("j"), F.when(spread("cxx", "mx").isNotNull() & (F.col("n") > 1), 1.0)).otherwise(
        F.when(F.abs(corr) > 1, F.signum(corr)).otherwise(corr))
    return found.select(
        F.col("i").alias("a"), F.col("j").alias("b"), F.get(names, F.col("i")).alias("column_a"), F.get(names, F.col("j")).alias("column_b"),
        "rows", corr.alias("corr"))


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None, min_rows: int = MIN_CORRELATION_ROWS) -> DataFrame:
    """Pearson for every ordered pair of numeric columns; empty below ``min_rows`` rows or two columns."""
    cols = _cols(df, columns)
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], "column_a string, column_b string, corr double")
    half = _pair_correlations(df, cols).filter(F.col("rows") >= min_rows)
    swapped = F.struct(F.col("column_b").alias("column_a"), F.col("column_a").alias("column_b"), "corr")
    both = F.when(F.col("a") == F.col("b"), F.array(F.struct("column_a", "column_b", "corr"))).otherwise(
        F.array(F.struct("column_a", "column_b", "corr"), swapped))
    return half.select(F.inline(both))


def top_correlations(df: DataFrame, columns: Sequence[str] | None = None, k: int = 5, min_rows: int = MIN_CORRELATION_ROWS) -> DataFrame:
    """Strongest unordered pairs with a direction and a sentence."""
    cols = _cols(df, columns)
    if not cols:
        return df.sparkSession.createDataFrame([], "column_a string, column_b string, corr double, direction string, text string")
    pairs = _pair_correlations(df, cols).filter((F.col("a") < F.col("b")) & (F.col("rows") >= min_rows) & F.col("corr").isNotNull())
    direction = F.when(F.col("corr") > 0, "positive").otherwise("negative")
    return (
        pairs.orderBy(F.abs("corr").desc(), "a", "b").limit(k)
        .select("column_a", "column_b", "corr", direction.alias("direction"),
                F.format_string("'%s' ↔ '%s': %s (%.2f)", "column_a", "column_b", direction, "corr").alias("text"))
    )


def _with_ranks(pairs: DataFrame) -> DataFrame:
    """Average ranks less the mean rank (``rt``, ``rv``), from running counts over the distinct values of each side."""
    sides = F.array(F.struct(F.lit("t").alias("side"), F.col("t").alias("x")),
                    F.struct(F.lit("v").alias("side"), F.col("v").alias("x")))
    values = (
        pairs.select("column", "c", F.inline(sides))
        .groupBy("column", "side", "x").agg(F.sum("c").alias("c"))
    )
    placed = blocks.positions(values, ["x"], by=["column", "side"])
    ranked = blocks.prefix_scan(placed, F.col("c"), "_upto", ["column", "side"], totals={"n": F.col("c")})
    ranked = ranked.select(
        "column", "side", "x", (F.col("_upto") - (F.col("c") - 1) / 2 - (F.col("n") + 1) / 2).alias("rank"))
    of_t = ranked.filter("side = 't'").select("column", F.col("x").alias("t"), F.col("rank").alias("rt"))
    of_v = ranked.filter("side = 'v'").select("column", F.col("x").alias("v"), F.col("rank").alias("rv"))
    return pairs.join(of_t, ["column", "t"]).join(of_v, ["column", "v"])


def spearman(df: DataFrame, target: str, columns: Sequence[str]) -> DataFrame:
    """(column, spearman_r) of average ranks over the complete pairs of each column.

    Equal pairs collapse first and the ranks come from running counts over
    distinct values. The correlation is summed from centred ranks.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("column"), as_double(df, c).alias("v")) for c in columns])
    pairs = (
        df.select(as_double(df, target).alias("t"), F.explode(cells).alias("_c"))
        .select("_c.column", "t", "_c.v").filter("t IS NOT NULL AND v IS NOT NULL")
    )
    joined = _with_ranks(write_out(pairs.groupBy("column", "t", "v").agg(F.count("*").alias("c")), "pairs"))
    weighted = lambda x: F.sum(F.col("c") * x)
    rt, rv = F.col("rt"), F.col("rv")
    return joined.groupBy("column").agg(
        F.try_divide(weighted(rt * rv), F.sqrt(weighted(rt * rt)) * F.sqrt(weighted(rv * rv))).alias("spearman_r"))


def deep_correlation(df: DataFrame, target: str, columns: Sequence[str] | None = None, min_rows: int = MIN_DEEP_ROWS) -> DataFrame:
    """Pearson and Spearman of ``target`` with each column, p-values and strength."""
    cols = [c for c in _cols(df, columns) if c != target]
    t = as_double(df, target)
    pearson = blocks.column_rows(df, cols, lambda c, x: {
        "r": F.nanvl(F.corr(t, x), F.lit(None)), "n": F.count_if(t.isNotNull() & x.isNotNull())})
    pearson = pearson.filter(F.col("n") >= min_rows)
    both = pearson.join(F.broadcast(spearman(df, target, cols)), "column", "left")  # one row per column
    n = F.col("n").cast("double")
    p = correlation_p(F.col("r"), n)
    return (
        both.withColumn("p", p).select(
            "column", F.bround("r", 4).alias("pearson_r"), F.bround("p", 6).alias("pearson_p"),
            F.bround("spearman_r", 4).alias("spearman_r"),
            F.bround(correlation_p(F.col("spearman_r"), n), 6).alias("spearman_p"),
            (F.col("p") < 0.05).alias("significant"), corr_strength(F.col("r")).alias("strength"))
        .orderBy(F.abs("pearson_r").desc_nulls_last(), "column")
    )


def fences(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    quartiles = blocks.quantile_map(df, columns, [0.25, 0.75])
    return {c: (q1 - IQR_FACTOR * (q3 - q1), q3 + IQR_FACTOR * (q3 - q1)) for c, (q1, q3) in quartiles.items()}


def outlier_summary(df: DataFrame, columns: Sequence[str] | None = None, min_rows: int = MIN_OUTLIER_ROWS) -> DataFrame:
    """IQR fences, outlier count and share, and the extremes beyond the fences."""
    bounds = fences(df, _cols(df, columns))

    def fields(c: str, x: Column) -> dict[str, Column]:
        lo, hi = bounds.get(c, (None, None))
        return {"n": F.count(x), "outlier_count": F.count_if((x < lo) | (x > hi)),
                "extreme_low": F.min(F.when(x < lo, x)), "extreme_high": F.max(F.when(x > hi, x))}

    limits = {c: F.create_map(*[F.lit(v) for name, pair in bounds.items() for v in (name, pair[i])]).cast("map<string,double>")[F.col("column")]
              for i, c in enumerate(("lower_fence", "upper_fence"))}
    rows = blocks.column_rows(df, list(bounds), fields).filter(F.col("n") >= min_rows)
    share = percent(F.col("outlier_count"), F.col("n"))
    return rows.withColumns(limits | {"outlier_pct": share}).select(
        "column", "outlier_count", "outlier_pct", "lower_fence", "upper_fence", "extreme_low", "extreme_high")


def false_discovery(df: DataFrame, p: str = "p_value", out: str = "q_value") -> DataFrame:
    """``df``, one row per test, with the smallest false-discovery rate at which each is still a finding (Benjamini-Hochberg).

    Rows without a p-value are no tests and get null.
    """
    tested = F.col(p).isNotNull()
    rising = Window.partitionBy(tested).orderBy(p)  # as many rows as there are columns or pairs that were tested
    rate = F.col(p) * F.count("*").over(Window.partitionBy(tested)) / F.row_number().over(rising)
    from_above = Window.partitionBy(tested).orderBy(F.desc(p))  # equal ones included
    ranked = df.withColumn("_rate", F.when(tested, rate))
    return ranked.withColumn(out, F.when(tested, F.least(F.min("_rate").over(from_above), F.lit(1.0)))).drop("_rate")


def anomalies_zscore(df: DataFrame, column: str, threshold: float = Z_THRESHOLD) -> DataFrame:
    """The rows whose population z-score exceeds ``threshold``, with ``z`` added."""
    x = as_double(df, column)
    row = blocks.stats_row(df, {"m": F.avg(x), "s": F.stddev_pop(x)})
    if not row["s"]:
        return df.withColumn("z", F.lit(None).cast("double")).filter(F.lit(False))
    return df.withColumn("z", (x - F.lit(row["m"])) / F.lit(row["s"])).filter(F.abs("z") > threshold)


def anomalies_iqr(df: DataFrame, column: str) -> DataFrame:
    """The rows outside the 1.5·IQR fences."""
    x = as_double(df, column)
    bounds = fences(df, [column])
    if column not in bounds:
        return df.filter(F.lit(False))
    lo, hi = bounds[column]
    return df.filter((x < lo) | (x > hi))


def anomaly_report(
    df: DataFrame, key: Sequence[str], columns: Sequence[str] | None = None,
    min_rows: int = MIN_ANOMALY_ROWS, listed: int = LISTED_ANOMALIES,
) -> DataFrame:
    """Per column and method: anomaly count, share and the first ``listed`` keys."""
    cols = _cols(df, columns)
    known_by = {r["column"]: r for r in summaries(df, cols).collect()}  # one row per column
    row = {f"{n}{i}": known_by[c][f] for i, c in enumerate(cols) for n, f in (("m", "mean"), ("s", "std_pop"), ("n", "count"))}
    bounds = fences(df, cols)
    marks, sizes = [], {}
    for i, c in enumerate(cols):
        if row[f"n{i}"] < min_rows:
            continue
        x = as_double(df, c)
        sizes[c] = row[f"n{i}"]
        lo, hi = bounds[c]
        z = F.lit(False) if not row[f"s{i}"] else F.abs((x - F.lit(row[f"m{i}"])) / F.lit(row[f"s{i}"])) > Z_THRESHOLD
        for method, test, limit in (("zscore", z, Z_THRESHOLD), ("iqr", (x < lo) | (x > hi), IQR_FACTOR)):
            marks.append(F.when(test, F.struct(F.lit(c).alias("column"), F.lit(method).alias("method"), F.lit(limit).alias("threshold"))))
    if not marks:
        return df.sparkSession.createDataFrame(
            [], "column string, method string, anomaly_count bigint, anomaly_pct double, anomaly_keys array<string>, threshold double")
    names = [f"_k{i}" for i in range(len(key))]
    hits = (
        df.select(*[F.col(k).alias(n) for k, n in zip(key, names)], F.explode(F.array_compact(F.array(*marks))).alias("_a"))
        .select(*names, "_a.column", "_a.method", "_a.threshold")
    )
    rows_of = F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair])
    counts = hits.groupBy("column", "method", "threshold").agg(F.count("*").alias("anomaly_count"))
    first = blocks.top_per(hits, ["column", "method"], [F.col(n) for n in names], listed, "_rank")
    ids = first.groupBy("column", "method").agg(  # at most ``listed`` keys per group
        F.array_sort(F.collect_list(F.struct("_rank", F.concat_ws("/", *names).alias("id")))).alias("_ids"))
    return counts.join(F.broadcast(ids), ["column", "method"]).select(
        "column", "method", "anomaly_count", percent(F.col("anomaly_count"), rows_of[F.col("column")]).alias("anomaly_pct"),
        F.transform("_ids", lambda s: s["id"]).alias("anomaly_keys"), "threshold")
