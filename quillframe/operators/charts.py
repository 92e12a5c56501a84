"""Chart-ready aggregations, chart eligibility over a catalog, and dashboards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillframe.functions.columns import as_double, complete, known, numeric_columns, percent, sum_or_zero
from quillframe.functions.messages import REASONS
from quillframe.operators import analytics, blocks, profile, stats, timeseries

# Row limits of the chart reports.
BAR_ROWS = 30
PIE_ROWS = 12
SCATTER_ROWS = 1000
BUBBLE_ROWS = 500
HEATMAP_COLUMNS = 8
HISTOGRAM_BINS = (5, 30)
RADAR_AXES = 10
TREEMAP_ROWS = 40
WATERFALL_ROWS = 20
FUNNEL_ROWS = 12
CANDLES = 200
SANKEY_LINKS = 50
VIOLIN_POINTS = 50
VIOLIN_MIN = 10
TABLE_ROWS = 200
DASHBOARD_CHARTS = 10


# --- one table per chart kind ---------------------------------------------------------


def _top_sums(df: DataFrame, label: str, value: str, k: int) -> DataFrame:
    sums = complete(df, [label]).groupBy(F.col(label).alias("label")).agg(sum_or_zero(as_double(df, value)).alias("value"))
    return sums.orderBy(F.col("value").desc(), "label").limit(k)


def chart_bar(df: DataFrame, x: str, y: str) -> DataFrame:
    return _top_sums(df, x, y, BAR_ROWS)


def chart_line(df: DataFrame, x: str, y: str, key: Sequence[str] = ()) -> DataFrame:
    """At most about 150 points in x order (also the area chart)."""
    return timeseries.downsample(df, x, [y], key=[*key, *([] if key else [y])])


chart_area = chart_line


def chart_pie(df: DataFrame, label: str, value: str) -> DataFrame:
    """Top twelve labels and their share of those twelve (also the donut chart)."""
    top = _top_sums(df, label, value, PIE_ROWS)
    total = F.sum("value").over(Window.partitionBy())  # twelve rows
    return top.select("label", "value", F.coalesce(percent(F.col("value"), total, 1), F.lit(0.0)).alias("pct"))


chart_donut = chart_pie


def chart_scatter(df: DataFrame, x: str, y: str, key: Sequence[str] = (), seed: int = 42) -> DataFrame:
    names = list(dict.fromkeys([x, y, *key]))
    return blocks.hash_sample(complete(df.select(*names), [x, y]), SCATTER_ROWS, list(key) or None, seed)


def chart_bubble(df: DataFrame, x: str, y: str, size: str, key: Sequence[str] = (), seed: int = 42) -> DataFrame:
    names = list(dict.fromkeys([x, y, size, *key]))
    return blocks.hash_sample(complete(df.select(*names), [x, y, size]), BUBBLE_ROWS, list(key) or None, seed)


def chart_heatmap(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    cols = (known(df, columns) if columns else numeric_columns(df))[:HEATMAP_COLUMNS]
    return stats.correlation_matrix(df, cols, min_rows=0).withColumn("corr", F.bround("corr", 3))


def chart_histogram(df: DataFrame, value: str) -> DataFrame:
    low, high = HISTOGRAM_BINS
    return profile.histogram(df, value, high, low).select("bin", F.bround((F.col("lo") + F.col("hi")) / 2, 4).alias("mid"), "n")


def chart_boxplot(df: DataFrame, value: str, group: str | None = None) -> DataFrame:
    """Five-number summary, overall or per group with at least two values."""
    rows = complete(df, [group]) if group else df
    found = blocks.quantiles(rows, [value], [0.0, 0.25, 0.5, 0.75, 1.0], by=[group] if group else [])
    name = F.col(group).cast("string") if group else F.col("column")
    names = ["min", "q1", "median", "q3", "max"]
    found = found.filter(F.col("n") >= 2) if group else found
    return found.select(name.alias("name"), *[F.col("q")[i].alias(n) for i, n in enumerate(names)])


def chart_radar(df: DataFrame, axes: Sequence[str] | None = None) -> DataFrame:
    """Means scaled across the axes to 0–100, with each axis' maximum."""
    cols = (known(df, axes) if axes else numeric_columns(df))[:RADAR_AXES]
    aggregates = [f(as_double(df, c)).alias(f"{n}{i}") for i, c in enumerate(cols) for n, f in (("m", F.avg), ("h", F.max))]
    rows = blocks.rows_per_column(df.agg(*aggregates), [
        {"axis": F.lit(c), "mean": F.col(f"m{i}"), "axis_max": F.col(f"h{i}")} for i, c in enumerate(cols)])
    every = Window.partitionBy()  # at most ten rows
    lo, hi = F.min("mean").over(every), F.max("mean").over(every)
    scaled = F.when(hi > lo, F.bround((F.col("mean") - lo) / (hi - lo) * 100, 2)).otherwise(F.col("mean"))
    return rows.select("axis", scaled.alias("value"), "axis_max")


def chart_treemap(df: DataFrame, label: str, value: str) -> DataFrame:
    return _top_sums(df, label, value, TREEMAP_ROWS)


def chart_waterfall(df: DataFrame, x: str, y: str, order_by: Sequence[str]) -> DataFrame:
    """First twenty complete rows with the running start and end of each bar."""
    names = list(dict.fromkeys([x, y, *order_by]))
    rows = complete(df.select(*names), [x, y]).orderBy(*order_by).limit(WATERFALL_ROWS)
    upto = Window.orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)  # twenty rows
    end = F.sum(F.col(y).cast("double")).over(upto)
    return rows.select(F.col(x).cast("string").alias("label"), F.col(y).alias("value"), end.alias("end")).select(
        "label", "value", (F.col("end") - F.col("value")).alias("start"), "end")


def chart_funnel(df: DataFrame, stage: str, value: str) -> DataFrame:
    return _top_sums(df, stage, value, FUNNEL_ROWS)


def chart_candlestick(df: DataFrame, date: str, open: str, high: str, low: str, close: str) -> DataFrame:
    """First 200 complete candles in date order."""
    cols = [date, open, high, low, close]
    if len(known(df, cols[1:])) < 4:
        raise ValueError("a candlestick needs open, high, low and close")
    return complete(df.select(*cols), cols).orderBy(*cols).limit(CANDLES)


def ohlc(df: DataFrame, time: str, value: str, every: str = "1 day", key: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """Candles from single values: first, highest, lowest and last value per time window."""
    place = F.struct(F.col(time), *[F.col(k) for k in key])
    return complete(df, [time, value]).groupBy(*by, F.window(time, every).alias("_w")).agg(
        F.min_by(value, place).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"),
        F.max_by(value, place).alias("close")).select(*by, F.col("_w.start").alias("date"), "open", "high", "low", "close")


def chart_gauge(df: DataFrame, value: str) -> DataFrame:
    x = as_double(df, value)
    one = df.agg(F.avg(x).alias("value"), F.min(x).alias("min"), F.max(x).alias("max"))
    return one.select(F.lit(value).alias("label"), "value", "min", "max", percent(F.col("value"), F.col("max"), 0).alias("pct"))


def chart_sankey(df: DataFrame, source: str, target: str, value: str) -> DataFrame:
    """First fifty links in key order, with the summed value."""
    links = complete(df, [source, target]).groupBy(F.col(source).alias("source"), F.col(target).alias("target"))
    return links.agg(sum_or_zero(as_double(df, value)).alias("value")).orderBy("source", "target").limit(SANKEY_LINKS)


def sankey_nodes(links: DataFrame) -> DataFrame:
    """Every name on either side of a link, once."""
    return links.select(F.col("source").alias("name")).union(links.select("target")).distinct()


def chart_violin(df: DataFrame, value: str, group: str | None = None, points: int = VIOLIN_POINTS) -> DataFrame:
    """Gaussian kernel density on an even grid per group of at least ten values, with quartiles.

    Scott's bandwidth; the grid sums are ordinary aggregates, so rows are folded where they
    are read and a large group is never gathered.
    """
    name = F.col(group).cast("string") if group else F.lit(value)
    rows = df.select(name.alias("name"), as_double(df, value).alias("x")).filter("name IS NOT NULL AND x IS NOT NULL")
    shape = rows.groupBy("name").agg(F.count("*").alias("n"), F.stddev_samp("x").alias("s"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    shape = shape.filter((F.col("n") >= VIOLIN_MIN) & (F.col("s") > 0)).select(
        "name", "n", "lo", ((F.col("hi") - F.col("lo")) / (points - 1)).alias("step"),
        (F.col("s") * F.pow(F.col("n"), F.lit(-0.2))).alias("h"))
    at = F.col("lo") + F.col("step") * F.col("point")

    def near(point: int) -> Column:
        u = (F.col("x") - (F.col("lo") + F.col("step") * point)) / F.col("h")
        return F.sum(F.exp(u * u * -0.5)).alias(f"k{point}")

    shaped = blocks.join_small(rows, shape, ["name"]).groupBy("name", "n", "lo", "step", "h")
    sums = shaped.agg(*[near(i) for i in range(points)]).select(
        "name", "n", "lo", "step", "h", F.posexplode(F.array(*[f"k{i}" for i in range(points)])).alias("point", "k"))
    scale = F.col("n") * F.col("h") * (2 * 3.141592653589793) ** 0.5
    curve = sums.select("name", "point", F.bround(at, 4).alias("x"), F.bround(F.col("k") / scale, 6).alias("density"))
    quartiles = blocks.quantiles(rows, ["x"], [0.25, 0.5, 0.75], by=["name"])
    quartiles = quartiles.select("name", *[F.col("q")[i].alias(n) for i, n in enumerate(["q1", "median", "q3"])])
    return curve.join(quartiles, "name")


def chart_table(df: DataFrame, order_by: Sequence[str] = ()) -> DataFrame:
    """First 200 rows as text, nulls shown as empty."""
    first = df.orderBy(*order_by).limit(TABLE_ROWS) if order_by else df.limit(TABLE_ROWS)
    return first.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns])


# --- eligibility over a catalog -------------------------------------------------------

# The chart kinds, the rows each needs (2 if not listed) and intent preferences.
KINDS = (
    "bar", "line", "area", "pie", "donut", "scatter", "bubble", "heatmap", "histogram", "boxplot", "radar",
    "treemap", "waterfall", "funnel", "candlestick", "gauge", "sankey", "violin", "table",
)
MIN_ROWS = {
    "candlestick": 5, "violin": 30, "boxplot": 10, "radar": 3, "sankey": 5, "heatmap": 4, "waterfall": 2, "funnel": 2,
}
INTENT_KINDS = {
    "trend": ["line", "area"],
    "comparison": ["bar", "radar"],
    "distribution": ["histogram", "violin", "boxplot"],
    "correlation": ["scatter", "heatmap"],
    "part-whole": ["pie", "donut", "treemap", "funnel"],
    "ranking": ["bar", "treemap"],
    "flow": ["sankey", "waterfall"],
    "financial": ["candlestick", "line"],
    "kpi": ["gauge"],
    "general": ["bar", "line"],
}


def column_roles(profiles: DataFrame) -> DataFrame:
    """One row per dataset: what the chart rules need to know about its columns, in schema order.

    ``profiles`` has (dataset_id, position, name, inferred_type, unique_count, rows).
    """
    def listed(*kinds: str) -> Column:
        chosen = F.when(F.col("inferred_type").isin(*kinds), F.struct("position", "name", "unique_count"))
        return F.array_sort(F.collect_list(chosen))  # one struct per column

    lists = profiles.groupBy("dataset_id").agg(
        F.max("rows").alias("rows"), listed("numeric").alias("nums"), listed("categorical", "boolean").alias("cats"),
        listed("datetime").alias("dates"))
    small = F.filter("cats", lambda s: s["unique_count"] <= 10)
    item = lambda cols, i, field="name": F.try_element_at(cols, F.lit(i + 1))[field]
    names = F.transform("nums", lambda s: s["name"])
    sizes = F.transform("cats", lambda s: s["unique_count"].cast("string"))
    return lists.select(
        "dataset_id", "rows", F.size("nums").alias("n_num"), F.size("cats").alias("n_cat"), F.size("dates").alias("n_date"),
        *[item("nums", i).alias(f"num{i}") for i in range(4)], *[item("cats", i).alias(f"cat{i}") for i in range(2)],
        item("cats", 0, "unique_count").alias("cat_size"), item("dates", 0).alias("date"),
        item("dates", 0, "unique_count").alias("date_size"), item(small, 0).alias("small_cat"),
        F.array_join(F.slice(names, 1, HEATMAP_COLUMNS), ",").alias("matrix"),
        F.array_join(F.slice(names, 1, RADAR_AXES), ",").alias("axes"),
        F.concat(F.lit("["), F.array_join(sizes, ", "), F.lit("]")).alias("sizes"))


def _rules() -> dict[str, tuple[list, dict, Column | None]]:
    """Per kind: failed tests as (test, reason, alternative), the chosen columns, a warning."""
    n_num, n_cat, n_date = F.col("n_num"), F.col("n_cat"), F.col("n_date")
    value, cat, date = F.col("num0"), F.col("cat0"), F.col("date")
    axis, time_axis = F.coalesce(cat, date), F.coalesce(date, cat)
    axis_size = F.coalesce(F.col("cat_size"), F.col("date_size"))
    group = F.coalesce(cat, F.lit(""))

    def found(text):
        return F.concat(F.lit(text), n_num.cast("string"), F.lit("."))

    def if_numeric(yes, no):
        return F.when(n_num > 0, F.lit(yes)).otherwise(F.lit(no))

    def needs_number(alternative):
        return (n_num == 0, F.lit(REASONS["one_number"]), F.lit(alternative))

    line = (
        [needs_number("table"), (time_axis.isNull(), F.lit(REASONS["time_axis"]), F.lit("scatter"))],
        {"x": time_axis, "y": value}, None)
    cardinalities = F.concat(F.lit(REASONS["small_category"]), F.col("sizes"), F.lit("."))
    pie = ([needs_number("table"), (F.col("small_cat").isNull(), cardinalities, F.lit("bar"))],
           {"label": F.col("small_cat"), "value": value}, None)
    return {
        "bar": ([needs_number("table"), (axis.isNull(), F.lit(REASONS["category_axis"]), F.lit("histogram"))],
                {"x": axis, "y": value},
                F.when(axis_size > 50, F.format_string(REASONS["categories_cut"], axis, axis_size))),
        "line": line,
        "area": line,
        "pie": pie,
        "donut": pie,
        "scatter": ([(n_num < 2, found(REASONS["two_numbers"]), if_numeric("histogram", "table"))],
                    {"x": value, "y": F.col("num1")}, None),
        "bubble": ([(n_num < 3, found(REASONS["three_numbers"]), F.lit("scatter"))],
                   {"x": value, "y": F.col("num1"), "size": F.col("num2")}, None),
        "heatmap": ([(n_num < 2, F.lit(REASONS["matrix"]), F.lit("bar"))],
                    {"matrix": F.col("matrix")}, None),
        "histogram": ([needs_number("bar")], {"value": value}, None),
        "boxplot": ([needs_number("histogram")], {"value": value, "group": group}, None),
        "radar": ([(n_num < 3, found(REASONS["axes"]), if_numeric("bar", "table"))],
                  {"axes": F.col("axes")},
                  F.when(n_num > RADAR_AXES, F.lit(REASONS["axes_cut"]))),
        "treemap": ([((n_num == 0) | (n_cat == 0), F.lit(REASONS["label_and_number"]), F.lit("bar"))],
                    {"label": cat, "value": value, "parent": F.coalesce(F.col("cat1"), F.lit(""))}, None),
        "waterfall": ([((n_num == 0) | axis.isNull(), F.lit(REASONS["number_and_axis"]), F.lit("bar"))],
                      {"x": axis, "y": value}, None),
        "funnel": ([((n_num == 0) | (n_cat == 0), F.lit(REASONS["stage_and_value"]), F.lit("bar")),
                    (F.col("cat_size") > 12, F.format_string(REASONS["stages_many"], cat, F.col("cat_size")), F.lit("bar"))],
                   {"stage": cat, "value": value}, None),
        "candlestick": ([(n_num < 4, found(REASONS["four_numbers"]), F.lit("line"))],
                        {"date": F.coalesce(date, F.lit("")), "open": value, "high": F.col("num1"),
                         "low": F.col("num2"), "close": F.col("num3")}, None),
        "gauge": ([needs_number("table")], {"value": value}, None),
        "sankey": ([((n_cat < 2) | (n_num == 0), F.lit(REASONS["source_and_target"]), F.lit("bar"))],
                   {"source": cat, "target": F.col("cat1"), "value": value}, None),
        "violin": ([needs_number("histogram")], {"value": value, "group": group}, None),
        "table": ([], {}, None),
    }


def chart_eligibility(profiles: DataFrame) -> DataFrame:
    """(dataset_id, kind, is_valid, reason, alternative, columns, warnings) for every dataset and kind."""
    rules = _rules()
    text = F.lit(None).cast("string")
    verdicts = []
    for kind in KINDS:
        tests, columns, warning = rules[kind]
        least = MIN_ROWS.get(kind, 2)
        short = F.format_string(f"{kind} requires ≥{least} rows; dataset has %d.", "rows")
        tests = [(F.col("rows") < least, short, F.lit("table")), *tests]
        reason, alternative = text, text
        for test, why, instead in reversed(tests):
            reason = F.when(test, why).otherwise(reason)
            alternative = F.when(test, instead).otherwise(alternative)
        chosen = F.create_map(*[x for k, v in columns.items() for x in (F.lit(k), v)]) if columns else F.create_map().cast("map<string,string>")
        note = F.array_compact(F.array(warning)) if warning is not None else F.array().cast("array<string>")
        verdicts.append(F.struct(F.lit(kind).alias("kind"), reason.alias("reason"), alternative.alias("alternative"),
                                 chosen.alias("columns"), note.alias("warnings")))
    roles = column_roles(profiles)
    valid = F.col("reason").isNull()
    return roles.select("dataset_id", F.inline(F.array(*verdicts))).select(
        "dataset_id", "kind", valid.alias("is_valid"), F.coalesce("reason", F.lit("")).alias("reason"), "alternative",
        F.when(valid, F.col("columns")).alias("columns"), F.when(valid, F.col("warnings")).alias("warnings"))


def default_kind(roles: DataFrame) -> DataFrame:
    """(dataset_id, default): the kind chosen by column types alone."""
    n_num, n_cat, n_date = F.col("n_num"), F.col("n_cat"), F.col("n_date")
    kind = (
        F.when((n_date > 0) & (n_num > 0), "line").when((n_cat > 0) & (n_num > 0), "bar")
        .when(n_num >= 2, "scatter").when(n_num > 0, "histogram").otherwise("table")
    )
    return roles.select("dataset_id", kind.alias("default"))


def chart_auto_select(profiles: DataFrame) -> DataFrame:
    """(dataset_id, intent, kind): the first eligible preferred kind, else the default by types."""
    wishes = F.array(*[
        F.struct(F.lit(intent).alias("intent"), F.lit(kind).alias("kind"), F.lit(i).alias("priority"))
        for intent, kinds in INTENT_KINDS.items() for i, kind in enumerate(kinds)
    ])
    valid = chart_eligibility(profiles).select("dataset_id", "kind", "is_valid")
    asked = default_kind(column_roles(profiles)).select("dataset_id", "default", F.inline(wishes))
    best = asked.join(valid, ["dataset_id", "kind"]).groupBy("dataset_id", "intent", "default").agg(
        F.min_by("kind", F.when(F.col("is_valid"), F.col("priority"))).alias("kind"))
    return best.select("dataset_id", "intent", F.coalesce("kind", "default").alias("kind"))


def chart_requests(profiles: DataFrame) -> DataFrame:
    """(dataset_id, requested, kind, fallback_reason): an ineligible request becomes its alternative."""
    found = chart_eligibility(profiles)
    return found.select("dataset_id", F.col("kind").alias("requested"),
                        F.when(F.col("is_valid"), F.col("kind")).otherwise(F.coalesce("alternative", F.lit("table"))).alias("kind"),
                        F.when(~F.col("is_valid"), F.col("reason")).alias("fallback_reason"))


# --- dashboard ------------------------------------------------------------------------


def dashboard_charts(df: DataFrame, key: Sequence[str]) -> dict[str, DataFrame]:
    """Up to ten charts the table's column types and row count allow, and its KPI cards.

    A kind that needs more rows than the table has is replaced by the table itself.
    """
    types = profile.logical_types(df)
    num = [c for c, t in types.items() if t == "numeric"]
    cat = [c for c, t in types.items() if t in ("categorical", "boolean")]
    dates = [c for c, t in types.items() if t == "datetime"]
    close = blocks.stats_row(df, {c: F.approx_count_distinct(F.col(f"`{c}`")) for c in cat})
    # The estimate only skips columns far above the limit; the others are counted.
    sizes = {c: complete(df.select(c), [c]).distinct().limit(11).count() for c in cat if close[c] <= 20}
    charts: dict[str, DataFrame] = {}
    if dates and num:
        charts["line"] = chart_line(df, dates[0], num[0], key)
    if cat and num:
        charts["bar"] = chart_bar(df, cat[0], num[0])
    if num:
        charts["histogram"] = chart_histogram(df, num[0])
    if len(num) >= 2:
        charts["scatter"] = chart_scatter(df, num[0], num[1], key)
    if num and any(s <= 8 for s in sizes.values()):
        charts["pie"] = chart_pie(df, next(c for c in cat if sizes.get(c, 11) <= 10), num[0])
    if len(num) >= 2:
        charts["heatmap"] = chart_heatmap(df, num)
    if len(num) >= 3:
        charts["radar"] = chart_radar(df, num)
    rows = df.count()
    enough = {kind: chart for kind, chart in charts.items() if rows >= MIN_ROWS.get(kind, 2)}
    if len(enough) < len(charts):
        enough["table"] = chart_table(df, key)
    charts = dict(list(enough.items())[:DASHBOARD_CHARTS])
    return charts | {"kpis": analytics.kpi_cards(df, num)}


def dashboard_data(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """The same charts as one tidy table: (chart, label, series, value); rows shown as they are have no place in it."""
    shape = {
        "line": lambda t: (t.columns[0], F.lit(t.columns[1]), t.columns[1]),
        "bar": lambda t: ("label", F.lit("sum"), "value"),
        "histogram": lambda t: ("mid", F.lit("frequency"), "n"),
        "scatter": lambda t: (t.columns[0], F.lit(t.columns[1]), t.columns[1]),
        "pie": lambda t: ("label", F.lit("sum"), "value"),
        "heatmap": lambda t: ("column_a", F.col("column_b"), "corr"),
        "radar": lambda t: ("axis", F.lit("average"), "value"),
        "kpis": lambda t: ("column", F.lit("sum"), "sum"),
    }
    out = None
    for name, table in dashboard_charts(df, key).items():
        if name not in shape:
            continue
        label, series, value = shape[name](table)
        part = table.select(F.lit(name).alias("chart"), F.col(f"`{label}`").cast("string").alias("label"),
                            series.alias("series"), F.col(f"`{value}`").cast("double").alias("value"))
        out = part if out is None else out.unionByName(part)
    return out
