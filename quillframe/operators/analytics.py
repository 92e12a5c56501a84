"""Business analytics: KPIs, cohorts, funnels, segments, contributions, comparisons, findings."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillframe.functions.columns import as_double, comparable, complete, known, numeric_columns, percent, plain, sum_or_zero
from quillframe.functions.messages import ACTIONS
from quillframe.functions.scalars import month_of, months_apart
from quillframe.operators import blocks, profile, stats, timeseries
from quillframe.operators.prep import cast_column, predicate, sort_keys
from quillframe.operators.summaries import summaries

# Fixed values.
KPI_COLUMNS = 8
CARD_COLUMNS = 4
SEGMENT_METRICS = 3
TOP_GROUPS = 20
QUERY_ROWS = 500
UNKNOWN_STAGE = 999
FALSE_DISCOVERIES = 0.05

AGGREGATES = ("sum", "mean", "count", "min", "max", "median", "std", "nunique")


def _aggregate(df: DataFrame, column: str, func: str) -> Column:
    x = plain(df, column)
    makers = {
        "sum": lambda: sum_or_zero(as_double(df, column)), "mean": lambda: F.avg(as_double(df, column)),
        "count": lambda: F.count(x), "min": lambda: F.min(x), "max": lambda: F.max(x),
        "std": lambda: F.stddev_samp(as_double(df, column)), "nunique": lambda: F.count_distinct(comparable(df, column)),
    }
    if func not in makers:
        raise ValueError(f"unknown aggregate {func!r}; use one of {AGGREGATES}")
    return makers[func]()


def _without_null_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return complete(df, list(keys))


def grouped(df: DataFrame, group_cols: Sequence[str], column: str, func: str) -> DataFrame:
    """(group..., column) for one aggregate; null keys are dropped."""
    rows = _without_null_keys(df, group_cols)
    if func == "median":
        medians = blocks.quantiles(rows, [column], [0.5], by=group_cols)
        keys = rows.select(*group_cols).distinct()
        return keys.join(medians.select(*group_cols, F.col("q")[0].alias(column)), list(group_cols), "left")
    return rows.groupBy(*group_cols).agg(_aggregate(df, column, func).alias(column))


def group_aggregate(df: DataFrame, group_cols: Sequence[str], agg_col: str, agg_func: str = "sum", top_n: int = TOP_GROUPS) -> DataFrame:
    """The ``top_n`` groups by value (nulls last, then keys), with the total number of groups."""
    result = grouped(df, group_cols, agg_col, agg_func)
    total = result.agg(F.count("*").alias("total_groups"))
    best = result.orderBy(F.col(agg_col).desc_nulls_last(), *group_cols).limit(top_n)
    return best.crossJoin(F.broadcast(total))  # one row


def kpis(df: DataFrame, columns: Sequence[str] | None = None, date_col: str | None = None) -> DataFrame:
    """Up to eight numeric columns: total, mean, median, min, max, std, count, null % and growth."""
    cols = (known(df, columns) if columns else numeric_columns(df))[:KPI_COLUMNS]
    out = summaries(df, cols).select("column", "total", F.bround("mean", 4).alias("mean"), "min", "max", "std", "count", "rows")
    null_pct = percent(F.col("rows") - F.col("count"), F.col("rows"))
    out = out.withColumn("null_pct", null_pct).drop("rows").filter(F.col("count") > 0)
    medians = blocks.quantiles(df, cols, [0.5]).select("column", F.col("q")[0].alias("median"))
    out = out.join(F.broadcast(medians), "column", "left")  # one row per column
    if date_col and date_col in df.columns:
        out = out.join(F.broadcast(timeseries.growth_rates(df, date_col, cols)), "column", "left")
    return out


def kpi_cards(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """First four numeric columns: sum, mean, min, max, count."""
    cols = (known(df, columns) if columns else numeric_columns(df))[:CARD_COLUMNS]
    out = summaries(df, cols).select("column", F.col("total").alias("sum"), F.bround("mean", 4).alias("mean"), "min", "max", "count")
    return out.filter(F.col("count") > 0)


def cohort_retention(df: DataFrame, date_col: str, user_col: str, value_col: str) -> DataFrame:
    """(cohort, period_index, users, retention_pct) with every cell of the matrix, missing ones 0.

    Rows collapse to one per user and month before anything is shuffled by user, so a user
    with a third of the table contributes only its active months.
    """
    when = cast_column(df, date_col, "datetime")
    rows = df.select(F.col(user_col).alias("user"), month_of(when).alias("month"), plain(df, value_col).alias("v"))
    active = complete(rows, ["user", "month", "v"]).select("user", "month").distinct()
    first = F.min("month").over(Window.partitionBy("user"))
    aged = active.withColumn("cohort", first).withColumn("period_index", months_apart(F.col("month"), F.col("cohort")))
    counts = aged.groupBy("cohort", "period_index").agg(F.count("*").alias("users"))
    # One map per cohort, with an entry per month of history; the windows see one row per cohort.
    cell = F.struct("period_index", "users")
    cohorts = counts.groupBy("cohort").agg(F.map_from_entries(F.collect_list(cell)).alias("_users"))
    ages = F.array_distinct(F.flatten(F.collect_list(F.map_keys("_users")).over(Window.partitionBy())))
    grid = cohorts.withColumn("_ages", ages).select("cohort", "_users", F.explode("_ages").alias("period_index"))
    users = F.coalesce(F.try_element_at("_users", F.col("period_index")), F.lit(0))
    return grid.select(
        F.date_format("cohort", "yyyy-MM").alias("cohort"), "period_index", users.alias("users"),
        percent(users, F.col("_users")[0], 1).alias("retention_pct"))


def cohort_matrix(df: DataFrame, date_col: str, user_col: str, value_col: str, measure: str = "retention_pct") -> DataFrame:
    """The same cells with one column per period index."""
    tidy = cohort_retention(df, date_col, user_col, value_col)
    return tidy.groupBy("cohort").pivot("period_index").agg(F.first(measure)).orderBy("cohort")


def funnel(df: DataFrame, stage_col: str, value_col: str, stage_order: Sequence[str] | None = None) -> DataFrame:
    """Per stage: total, count, conversion % of the first stage and drop-off %."""
    x = as_double(df, value_col)
    stages = _without_null_keys(df, [stage_col]).groupBy(F.col(stage_col).alias("stage")).agg(
        sum_or_zero(x).alias("total"), F.count(x).alias("count"))
    if stage_order:
        ranks = F.create_map(*[F.lit(v) for i, s in enumerate(stage_order) for v in (s, i)])
        stages = stages.withColumn("_order", F.coalesce(ranks[F.col("stage")], F.lit(UNKNOWN_STAGE)).cast("double"))
    else:
        stages = stages.withColumn("_order", -F.col("total"))
    first = stages.agg(F.min_by("total", F.struct("_order", "stage")).alias("_first"))
    rate = percent(F.col("total"), F.col("_first"), 1)
    return (
        stages.crossJoin(F.broadcast(first))  # one row
        .orderBy("_order", "stage")
        .select("stage", "total", "count", rate.alias("conversion_pct"), F.bround(F.lit(100) - rate, 1).alias("drop_off_pct"))
    )


def segment(df: DataFrame, segment_col: str, metric_cols: Sequence[str] | None = None) -> DataFrame:
    """(segment, row_count, metric, mean, sum, min, max); metrics without a value are omitted."""
    cols = known(df, metric_cols) if metric_cols else numeric_columns(df)[:SEGMENT_METRICS]
    aggregates = [F.count("*").alias("row_count")]
    cells = []
    for i, c in enumerate(cols):
        x = as_double(df, c)
        aggregates += [F.avg(x).alias(f"a{i}"), F.sum(x).alias(f"s{i}"), F.min(x).alias(f"l{i}"),
                       F.max(x).alias(f"h{i}"), F.count(x).alias(f"n{i}")]
        cells.append(F.struct(F.lit(c).alias("metric"), F.col(f"a{i}").alias("mean"), F.col(f"s{i}").alias("sum"),
                              F.col(f"l{i}").alias("min"), F.col(f"h{i}").alias("max"), F.col(f"n{i}").alias("n")))
    out = _without_null_keys(df, [segment_col]).groupBy(F.col(segment_col).cast("string").alias("segment")).agg(*aggregates)
    out = out.select("segment", "row_count", F.inline(F.array(*cells))).filter(F.col("n") > 0).drop("n")
    return out.orderBy(F.col("row_count").desc(), "segment", "metric")


def contribution(df: DataFrame, dim_col: str, metric_col: str, top_n: int = TOP_GROUPS) -> DataFrame:
    """Sum per dimension value and its share of the total; the ``top_n`` largest shares."""
    sums = grouped(df, [dim_col], metric_col, "sum")
    total = sums.agg(F.sum(metric_col).alias("_total"))
    shares = sums.crossJoin(F.broadcast(total))  # one row
    shares = shares.select(dim_col, metric_col, percent(F.col(metric_col), F.col("_total")).alias("pct"))
    return shares.orderBy(F.col("pct").desc_nulls_last(), F.col(metric_col).desc(), dim_col).limit(top_n)


def compare_datasets(a: DataFrame, b: DataFrame, metric_col: str, group_col: str | None = None) -> DataFrame:
    """Rows, columns, common columns and one metric's mean, sum and std on both sides.

    With ``group_col`` the two sides are aggregated first and full-outer joined on the group; null groups are dropped.
    """
    common = sorted(set(a.columns) & set(b.columns))

    def side(df: DataFrame, tag: str) -> DataFrame:
        x = as_double(df, metric_col) if metric_col in df.columns else F.lit(None).cast("double")
        aggregates = [F.count("*").alias(f"{tag}_rows"), F.avg(x).alias(f"{tag}_mean"),
                      F.sum(x).alias(f"{tag}_sum"), F.stddev_samp(x).alias(f"{tag}_std")]
        return complete(df, [group_col]).groupBy(group_col).agg(*aggregates) if group_col else df.agg(*aggregates)

    left, right = side(a, "a"), side(b, "b")
    both = left.join(right, group_col, "full_outer") if group_col else left.crossJoin(F.broadcast(right))  # one row each
    diff = F.bround((F.col("b_mean") - F.col("a_mean")) / F.abs("a_mean") * 100, 2)
    return both.select(
        *([group_col] if group_col else []),
        F.lit(metric_col).alias("metric"), "a_rows", F.lit(len(a.columns)).alias("a_cols"), "b_rows",
        F.lit(len(b.columns)).alias("b_cols"), F.array(*[F.lit(c) for c in common]).cast("array<string>").alias("common_columns"),
        "a_mean", "b_mean", "a_sum", "b_sum", "a_std", "b_std",
        F.when(F.col("a_mean") != 0, diff).alias("mean_diff_pct"))


def query_spec(df: DataFrame, spec: dict[str, Any] | str) -> DataFrame:
    """A declarative question: filter, time range, group, aggregate, having, sort, limit.

    ``spec`` is a dict, or SQL text over a table named ``df``. At most 500 rows come back.
    """
    if isinstance(spec, str):
        return df.sparkSession.sql(spec, df=df).limit(QUERY_ROWS)
    out = df
    for cond in spec.get("filters", []):
        test = predicate(out, cond["column"], cond["operator"], cond.get("value"))
        if test is None:
            raise ValueError(f"unknown column or operator in {cond}")
        out = out.filter(test)
    if span := spec.get("time_range"):
        when = F.col(span["column"])
        if span.get("start") is not None:
            out = out.filter(when >= F.lit(span["start"]).cast(out.schema[span["column"]].dataType))
        if span.get("end") is not None:
            out = out.filter(when < F.lit(span["end"]).cast(out.schema[span["column"]].dataType))
    groups = list(spec.get("group_by", []))
    if metrics := spec.get("metrics"):
        rows = _without_null_keys(out, groups) if groups else out
        plain_metrics = [m for m in metrics if m.get("func") != "median"]
        aggregates = [
            (F.count("*") if m.get("column") in (None, "*") else _aggregate(rows, m["column"], m["func"])).alias(m["alias"])
            for m in plain_metrics
        ] or [F.count("*").alias("_rows")]
        out = rows.groupBy(*groups).agg(*aggregates)
        for m in metrics:
            if m.get("func") == "median":
                median = blocks.quantiles(rows, [m["column"]], [0.5], by=groups).select(*groups, F.col("q")[0].alias(m["alias"]))
                out = out.join(median, groups, "left") if groups else out.join(median, F.lit(True), "left")  # one row each
        out = out.select(*groups, *[m["alias"] for m in metrics])
    elif groups:
        out = _without_null_keys(out, groups).select(*groups).distinct()
    for cond in spec.get("having", []):
        out = out.filter(predicate(out, cond["column"], cond["operator"], cond.get("value")))
    if chosen := spec.get("select"):
        out = out.select(*known(out, chosen))
    if order := spec.get("order_by"):
        out = out.orderBy(*sort_keys([o["column"] for o in order], [o.get("ascending", True) for o in order]))
    return out.limit(min(spec.get("limit", QUERY_ROWS), QUERY_ROWS))


def insight_findings(
    df: DataFrame, columns: Sequence[str] | None = None, date_col: str | None = None, false_discoveries: float = FALSE_DISCOVERIES
) -> DataFrame:
    """Findings from the statistics: correlations, outliers, missing values and trends, ranked, with what to do about them.

    Of the trends of all columns, those are reported of which at most ``false_discoveries`` are expected to be chance.
    """
    cols = known(df, columns) if columns else numeric_columns(df)

    def finding(source, place, category, title, description, data, size, related, about=("column",)):
        return source.select(
            F.array(F.format_string(ACTIONS[category], *about)).alias("action_items"),
            F.lit(place).alias("_place"), size.alias("_size"), F.lit(category).alias("category"), title.alias("title"),
            description.alias("description"), data.alias("supporting_data"), related.alias("related_columns"))

    text = lambda c, digits: F.format_string(f"%.{digits}f", F.col(c))
    pairs = stats.top_correlations(df, cols)
    parts = [finding(
        pairs, 1, "diagnostic", F.concat("column_a", F.lit(" and "), "column_b", F.lit(" move together")), F.col("text"),
        F.create_map(F.lit("corr"), text("corr", 4)), F.abs("corr"), F.array("column_a", "column_b"), ("column_a", "column_b"))]
    out = stats.outlier_summary(df, cols).filter("outlier_count > 0")
    parts.append(finding(
        out, 2, "anomaly", F.concat(F.lit("Outliers in "), "column"),
        F.format_string("%d values (%.2f%%) lie outside the fences of '%s'", "outlier_count", "outlier_pct", "column"),
        F.create_map(F.lit("outlier_count"), F.col("outlier_count").cast("string"), F.lit("outlier_pct"), text("outlier_pct", 2)),
        F.col("outlier_pct"), F.array("column")))
    gaps = profile.missing_report(df)
    parts.append(finding(
        gaps, 3, "descriptive", F.concat(F.lit("Missing values in "), "column"),
        F.format_string("'%s' has %.2f%% missing values", "column", "missing_pct"),
        F.create_map(F.lit("missing_count"), F.col("missing_count").cast("string"), F.lit("missing_pct"), text("missing_pct", 2)),
        F.col("missing_pct"), F.array("column")))
    if date_col:
        long = blocks.long_form(df.withColumn("_time", cast_column(df, date_col, "datetime")), cols, keep=["_time"])
        trends = timeseries.trend(long, "_time", "value", by=["column"])
        trends = stats.false_discovery(trends).filter(F.col("q_value") <= false_discoveries)
        parts.append(finding(
            trends, 4, "predictive", F.concat(F.initcap("direction"), F.lit(" trend in "), "column"),
            F.format_string("'%s' shows a %s %s trend", "column", "strength", "direction"),
            F.create_map(F.lit("slope"), text("slope", 6), F.lit("r_squared"), text("r_squared", 4), F.lit("q_value"), text("q_value", 6)),
            F.col("r_squared"), F.array("column"), ("column", "direction")))
    everything = parts[0]
    for p in parts[1:]:
        everything = everything.unionByName(p)
    # A handful of rows: at most five pairs and three findings per column.
    rank = F.row_number().over(Window.orderBy("_place", F.col("_size").desc(), "title"))
    return everything.select(
        "category", "title", "description", "supporting_data", F.lit(0.8).alias("confidence"), rank.alias("priority"),
        "action_items", "related_columns")
