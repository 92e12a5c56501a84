"""Operators over an ordered series, overall or per key.

Every operator takes ``time`` plus ``key`` columns that make the order total; rows with a null
time or value are dropped. Order, frames and running totals come from ``blocks``, so neither
a long series nor one hot key ends up in a single task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillframe.functions.columns import as_double, complete, numeric_columns
from quillframe.functions.pvalues import correlation_p
from quillframe.operators import blocks
from quillframe.operators.prep import cast_column

# Fixed values.
PERIOD = 7
WINDOWS = (7, 14, 30)
FORECAST_STEPS = 14
LINE_POINTS = 150


def series(df: DataFrame, time: str, value: str, by: Sequence[str] = (), key: Sequence[str] = ()) -> DataFrame:
    """(by..., time, key..., value) without nulls; strings are parsed as timestamps."""
    when = cast_column(df, time, "datetime")
    out = df.select(*by, when.alias("time"), *[k for k in key], as_double(df, value).alias("value"))
    return complete(out, [*by, "time", "value"])


def placed_series(df: DataFrame, time: str, value: str, by: Sequence[str] = (), key: Sequence[str] = ()) -> DataFrame:
    placed = blocks.positions(series(df, time, value, by, key), ["time", *key], by=by)
    return blocks.ordinals(placed, by)


# --- order statistics -----------------------------------------------------------------


def _weighted(df: DataFrame, time: str, value: str, by: Sequence[str]) -> DataFrame:
    """Distinct (time, value) pairs with their count ``c``, first row index ``p``, and per key ``n`` and ``total``.

    Ties in time are ordered by value; equal pairs are one row, however many copies there are.
    """
    pairs = series(df, time, value, by).groupBy(*by, "time", "value").agg(F.count("*").alias("c"))
    placed = blocks.positions(pairs, ["time", "value"], by=by)
    totals = {"n": F.col("c"), "total": F.col("c") * F.col("value")}
    scanned = blocks.prefix_scan(placed, F.col("c"), "_upto", by, totals=totals)
    return scanned.withColumn("p", F.col("_upto") - F.col("c"))


def growth_rate(df: DataFrame, time: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., growth_rate): change of the second half's sum over the first half's, split by row count.

    Rows fold into one per time before they are ordered. Only the time the split falls into is
    looked at again, in value order.
    """
    rows = series(df, time, value, by)
    folded = rows.groupBy(*by, "time").agg(F.count("*").alias("c"), F.sum("value").alias("v"))
    placed = blocks.positions(folded, ["time"], by=by)
    scanned = blocks.prefix_scan(placed, F.col("c"), "_upto", by, totals={"n": F.col("c")})
    scanned = scanned.withColumn("_early", F.floor(F.col("n") / 2) - (F.col("_upto") - F.col("c")))
    split = (F.col("_early") > 0) & (F.col("_early") < F.col("c"))
    border = scanned.filter(split).select(*by, "time", "_early")  # at most one row per key
    ties = blocks.join_small(rows, border, [*by, "time"]).groupBy(*by, "_early", "value").agg(F.count("*").alias("c"))
    ties = blocks.positions(ties, ["value"], by=by)
    ties = blocks.prefix_scan(ties, F.col("c"), "_upto", by)
    taken = F.greatest(F.least(F.col("c"), F.col("_early") - (F.col("_upto") - F.col("c"))), F.lit(0))
    parts = scanned.select(
        *by, "n", F.when(F.col("_early") >= F.col("c"), F.col("v")).alias("a"), F.when(F.col("_early") <= 0, F.col("v")).alias("b"))
    parts = parts.unionByName(ties.select(
        *by, F.lit(0).cast("bigint").alias("n"), (F.col("value") * taken).alias("a"), (F.col("value") * (F.col("c") - taken)).alias("b")))
    halves = parts.groupBy(*by).agg(F.max("n").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    rate = F.bround((F.col("b") - F.col("a")) / F.abs("a") * 100, 2)
    return halves.select(*by, F.when((F.col("n") >= 2) & (F.col("a") != 0), rate).alias("growth_rate"))


def growth_rates(df: DataFrame, time: str, columns: Sequence[str]) -> DataFrame:
    """(column, growth_rate) for several value columns in one ordered pass."""
    long = blocks.long_form(df.withColumn("_time", cast_column(df, time, "datetime")), columns, keep=["_time"])
    return growth_rate(long, "_time", "value", by=["column"])


def trend(df: DataFrame, time: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Regression of the value on its row index: direction, strength, slope, r², p and total change."""
    rows = _weighted(df, time, value, by)
    c, dev = F.col("c"), F.col("value") - F.col("total") / F.col("n")
    middle = (F.col("n") - 1) / 2
    index_sum = c * (F.col("p") - middle) + c * (c - 1) / 2  # sum of centred indexes of the copies
    fit = rows.groupBy(*by).agg(
        F.max("n").alias("n"), F.sum(index_sum * dev).alias("sxy"), F.sum(c * dev * dev).alias("syy"),
        F.min_by("value", "p").alias("first_value"), F.max_by("value", "p").alias("last_value"))
    n = F.col("n").cast("double")
    sxx = n * (n * n - 1) / 12
    fit = fit.filter(F.col("n") >= 3).withColumns({
        "slope": F.col("sxy") / sxx,
        "r": F.when(F.col("syy") > 0, F.col("sxy") / F.sqrt(sxx * F.col("syy"))).otherwise(F.lit(0.0))})
    fit = fit.withColumn("p", correlation_p(F.col("r"), n))
    size, first = F.abs("r"), F.col("first_value")
    change = F.when(first != 0, (F.col("last_value") - first) / F.abs(first) * 100).otherwise(F.lit(0.0))
    return fit.select(
        *by,
        F.when(F.col("slope") > 0, "upward").when(F.col("slope") < 0, "downward").otherwise("flat").alias("direction"),
        F.when(size > 0.7, "strong").when(size > 0.4, "moderate").otherwise("weak").alias("strength"),
        F.bround("slope", 6).alias("slope"), F.bround(F.col("r") * F.col("r"), 4).alias("r_squared"),
        F.bround("p", 6).alias("p_value"), (F.col("p") < 0.05).alias("significant"),
        F.bround(change, 2).alias("pct_change_total"), "first_value", "last_value", F.col("n").alias("data_points"))


# --- frames ---------------------------------------------------------------------------


def _trend_column(window, period: int):
    frame = window.rowsBetween(-(period // 2), (period - 1) // 2)
    return F.when(F.count("value").over(frame) == period, F.avg("value").over(frame))


def _with_season(rows: DataFrame, by: Sequence[str], period: int) -> DataFrame:
    """Add ``seasonal`` (mean detrended value per index modulo the period) and ``residual``."""
    rows = rows.withColumns({"_phase": F.col("_ord") % period, "_detrended": F.col("value") - F.col("trend")})
    season = rows.groupBy(*by, "_phase").agg(F.avg("_detrended").alias("seasonal"))
    return blocks.join_small(rows, season, [*by, "_phase"]).withColumn("residual", F.col("_detrended") - F.col("seasonal"))


def decompose(df: DataFrame, time: str, value: str, period: int = PERIOD, by: Sequence[str] = (), key: Sequence[str] = ()) -> DataFrame:
    """Additive decomposition; series shorter than two periods are left out."""
    placed = placed_series(df, time, value, by, key).filter(F.col("_n") >= 2 * period)
    rows = blocks.blocked(placed, lambda w: {"trend": _trend_column(w, period)}, period, period, by)
    rows = _with_season(rows, by, period)
    return rows.select(*by, "time", *key, F.col("value").alias("observed"), "trend", "seasonal", "residual")


def _reach(span: int) -> int:
    """Rows after which a weight (1−α)^i no longer matters in double precision."""
    decay = 1 - 2 / (span + 1)
    return 0 if decay <= 0 else math.ceil(math.log(1e-17) / math.log(decay))


def _block_rows(spans: Sequence[int]) -> int:
    """Largest block whose scaled weights stay far from the double range."""
    rows = 4096
    for span in spans:
        decay = 1 - 2 / (span + 1)
        if decay > 0:
            rows = min(rows, int(280 * math.log(10) / -math.log(decay)) - _reach(span) - 64)
    return max(rows, 1)


def _ewma_column(window, span: int, block: int):
    """Σ d^(j−i)·x_i over the rows so far, as d^j·Σ x_i·d^(−i), over the weights' sum.

    Exponents count from ``_reach`` rows before the block; older rows weigh less than 1e-17.
    """
    decay = 1 - 2 / (span + 1)
    if decay <= 0:
        return F.col("value")
    exponent = (F.col("_ord") - F.col("_block") * block + _reach(span)).cast("double")
    scaled = F.when(exponent >= 0, F.col("value") * F.pow(F.lit(decay), -exponent))
    upto = window.rowsBetween(Window.unboundedPreceding, 0)
    weights = (1 - F.pow(F.lit(decay), F.col("_ord") + 1)) / (1 - decay)
    return F.sum(scaled).over(upto) * F.pow(F.lit(decay), exponent) / weights


def _moving(placed: DataFrame, spans: Sequence[int], by: Sequence[str], with_ewma: bool, more=None, after: int = 0) -> DataFrame:
    """Add ``sma_w`` (and ``ewma_w``) per span, and ``more(window)``, in one blocked pass."""
    reach = max([*spans, *(_reach(s) for s in spans)]) if with_ewma else max(spans)
    size = _block_rows(spans) if with_ewma else 4096

    def columns(window):
        out = {}
        for w in spans:
            full = F.avg("value").over(window.rowsBetween(-(w - 1), 0))
            out[f"sma_{w}"] = F.when((F.col("_n") >= w) & (F.col("_ord") >= w - 1), full)
            if with_ewma:
                out[f"ewma_{w}"] = F.when(F.col("_n") >= w, _ewma_column(window, w, size))
        return out | (more(window) if more else {})

    return blocks.blocked(placed, columns, reach, after, by, size)


def sma(df: DataFrame, time: str, value: str, windows: Sequence[int] = WINDOWS, by: Sequence[str] = (), key: Sequence[str] = ()) -> DataFrame:
    """Trailing full-window means; null before a window is full or if the series is shorter."""
    rows = _moving(placed_series(df, time, value, by, key), windows, by, with_ewma=False)
    return rows.select(*by, "time", *key, "value", *[f"sma_{w}" for w in windows])


def ewma(df: DataFrame, time: str, value: str, spans: Sequence[int] = WINDOWS, by: Sequence[str] = (), key: Sequence[str] = ()) -> DataFrame:
    """Exponentially weighted means with weights normalised over the rows seen so far."""
    rows = _moving(placed_series(df, time, value, by, key), spans, by, with_ewma=True)
    return rows.select(*by, "time", *key, "value", *[f"ewma_{s}" for s in spans])


def moving_averages(df: DataFrame, time: str, value: str, windows: Sequence[int] = WINDOWS, by: Sequence[str] = (), key: Sequence[str] = ()) -> DataFrame:
    rows = _moving(placed_series(df, time, value, by, key), windows, by, with_ewma=True)
    names = [f"{kind}_{w}" for w in windows for kind in ("sma", "ewma")]
    return rows.select(*by, "time", *key, "value", *names)


def forecast(df: DataFrame, time: str, value: str, steps: int = FORECAST_STEPS, by: Sequence[str] = (), key: Sequence[str] = ()) -> DataFrame:
    """(by..., step, forecast): the last ``min(7, n)`` values in time order, repeated."""
    rows = series(df, time, value, by, key)
    order = [F.col("time").desc(), *[F.col(k).desc() for k in key]]
    if by:
        last = blocks.top_per(rows, by, order, PERIOD, "_r")
    else:
        last = rows.orderBy(*order).limit(PERIOD).withColumn("_r", F.row_number().over(Window.orderBy(*order)))
    last = last.withColumn("_period", F.count("*").over(Window.partitionBy(*by)))  # at most seven rows per key
    step = F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))
    return (
        last.withColumn("step", step).filter(F.col("step") % F.col("_period") == F.col("_period") - F.col("_r"))
        .select(*by, "step", F.col("value").alias("forecast"))
    )


def time_series_report(df: DataFrame, time: str, columns: Sequence[str] | None = None, key: Sequence[str] = ()) -> DataFrame:
    """Decomposition and moving averages of several columns (first three numeric by default), one row per point."""
    cols = list(columns or numeric_columns(df)[:3])
    timed = df.withColumn("_time", cast_column(df, time, "datetime"))
    long = blocks.long_form(timed, cols, keep=["_time", *key]).withColumnRenamed("column", "series")
    placed = placed_series(long, "_time", "value", by=["series"], key=key)
    rows = _moving(placed, WINDOWS, ["series"], with_ewma=True, after=PERIOD,
                   more=lambda w: {"trend": F.when(F.col("_n") >= 2 * PERIOD, _trend_column(w, PERIOD))})
    rows = _with_season(rows, ["series"], PERIOD)
    names = [f"{kind}_{w}" for w in WINDOWS for kind in ("sma", "ewma")]
    return rows.select("series", "time", *key, F.col("value").alias("observed"), "trend", "seasonal", "residual", *names)


def forecasts(df: DataFrame, time: str, columns: Sequence[str], key: Sequence[str] = ()) -> DataFrame:
    """(series, step, forecast) for several columns."""
    timed = df.withColumn("_time", cast_column(df, time, "datetime"))
    long = blocks.long_form(timed, columns, keep=["_time", *key]).withColumnRenamed("column", "series")
    return forecast(long, "_time", "value", by=["series"], key=key)


def downsample(df: DataFrame, order_by: str, columns: Sequence[str], key: Sequence[str] = (), points: int = LINE_POINTS) -> DataFrame:
    """Every ceil(n/points)-th complete row in order; all rows if there are at most ``points``."""
    kept = df.select(order_by, *columns, *[k for k in key if k not in columns and k != order_by])
    kept = complete(kept, [order_by, *columns])
    placed = blocks.ordinals(blocks.positions(kept, [order_by, *key]))
    step = F.greatest(F.ceil(F.col("_n") / points), F.lit(1))
    return placed.filter(F.col("_ord") % step == 0).select(*kept.columns)


def running_total(df: DataFrame, order_by: Sequence[str], value: str, by: Sequence[str] = ()) -> DataFrame:
    """Cumulative ``start`` and ``end`` of the value in order; null adds nothing."""
    names = list(dict.fromkeys([*by, *order_by, value]))
    placed = blocks.positions(df.select(*names), list(order_by), by=by)
    amount = F.coalesce(as_double(placed, value), F.lit(0.0))
    out = blocks.prefix_scan(placed, amount, "end", by=by)
    return out.select(*names, (F.col("end") - amount).alias("start"), "end")
