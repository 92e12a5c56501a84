"""Hand-computed micro tables: null keys, ties, NaN, closed bins, edge cases."""

import math

import pytest
from pyspark.sql import functions as F

from quillframe.functions import scalars
from quillframe.functions.pvalues import correlation_p, two_sided_p
from quillframe.operators import analytics, charts, features, prep, profile, retrieval, stats, text, timeseries
from quillframe.plans.analyze import ANALYSES, analyze, run_full
from quillframe.plans.steps import register_step, run_steps

NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def mixed(spark):
    return spark.createDataFrame(
        [("a", 1.0), ("a", 3.0), (None, 9.0), ("b", None), ("b", NAN), ("c", 4.0)], "g string, x double")


def test_null_keys_drop_and_empty_groups_sum_to_zero(mixed):
    got = {r["g"]: (r["x"], r["total_groups"]) for r in analytics.group_aggregate(mixed, ["g"], "x").collect()}
    assert got == {"a": (4.0, 3), "b": (0.0, 3), "c": (4.0, 3)}


def test_single_row_group_has_no_std_and_sorts_last(mixed):
    got = [(r["g"], r["x"]) for r in analytics.group_aggregate(mixed, ["g"], "x", "std").collect()]
    assert got == [("a", math.sqrt(2)), ("b", None), ("c", None)]


def test_unknown_aggregate_is_an_error(mixed):
    with pytest.raises(ValueError):
        analytics.group_aggregate(mixed, ["g"], "x", "product")


def test_median_of_a_group_without_values(mixed):
    got = {r["g"]: r["x"] for r in analytics.group_aggregate(mixed, ["g"], "x", "median").collect()}
    assert got == {"a": 2.0, "b": None, "c": 4.0}


def test_nan_counts_as_null(mixed):
    got = {r["column"]: r["missing_count"] for r in profile.missing_report(mixed).collect()}
    assert got == {"g": 1, "x": 2}


def test_sanitize(spark):
    df = spark.createDataFrame([(1.0,), (NAN,), (INF,), (-INF,), (None,)], "x double")
    assert [r["x"] for r in prep.sanitize(df).collect()] == [1.0, None, None, None, None]


def test_smallest_of_tied_modes_and_unknown_for_empty_columns(spark):
    df = spark.createDataFrame([("b", None), ("a", None), (None, None)], "s string, e string")
    assert prep.modes(df, ["s"]) == {"s": "a"}
    got = prep.impute(df).collect()
    assert sorted(r["s"] for r in got) == ["a", "a", "b"] and {r["e"] for r in got} == {"unknown"}


def test_ne_keeps_nulls_and_comparisons_drop_them(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, NAN), (4, 5.0)], "id int, x double")
    ids = lambda op, v: sorted(r["id"] for r in prep.filter_rows(df, [{"column": "x", "operator": op, "value": v}]).collect())
    assert ids("ne", 1.0) == [2, 3, 4]
    assert ids("gt", 0.5) == [1, 4]
    assert ids("gte", 5.0) == [4]
    assert ids("lt", 2.0) == [1]
    assert ids("eq", 1.0) == [1]
    assert ids("in", [1.0, 5.0]) == [1, 4]


def test_filters_reach_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    out = prep.filter_rows(df, [{"column": "l_quantity", "operator": "gt", "value": 45.0}]).select("l_orderkey")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,45.0)" in plan and "l_comment" not in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_contains_is_a_regular_expression(spark):
    df = spark.createDataFrame([("abc",), ("xyz",), (None,)], "s string")
    assert [r["s"] for r in prep.filter_rows(df, [{"column": "s", "operator": "contains", "value": "^a.c$"}]).collect()] == ["abc"]


def test_sort_puts_nulls_last_both_ways(spark):
    df = spark.createDataFrame([(None,), (2,), (1,)], "x int")
    assert [r["x"] for r in prep.sort(df, "x").collect()] == [1, 2, None]
    assert [r["x"] for r in prep.sort(df, ["x"], [False]).collect()] == [2, 1, None]


def test_histogram_closes_the_last_bin_and_keeps_empty_ones(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 0, 1, 10)], "x double")
    got = [(r["bin"], r["lo"], r["hi"], r["n"]) for r in profile.histogram(df, "x", 5, by_distinct=False).orderBy("bin").collect()]
    assert got == [(0, 0.0, 2.0, 3), (1, 2.0, 4.0, 0), (2, 4.0, 6.0, 0), (3, 6.0, 8.0, 0), (4, 8.0, 10.0, 1)]


def test_histogram_of_one_value(spark):
    df = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    got = charts.chart_histogram(df, "x").orderBy("bin").collect()
    assert len(got) == 5 and sum(r["n"] for r in got) == 2


def test_deduplicate_keeps_the_first(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), (None, 5), (None, 6)], "k string, v int")
    assert sorted((str(r["k"]), r["v"]) for r in prep.deduplicate(df, ["k"], ["v"]).collect()) == [("None", 5), ("a", 1)]
    assert prep.deduplicate(df.union(df)).count() == 4


def test_clip_keeps_nulls(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 100)] + [(None,)], "x double")
    assert sorted(str(r["x"]) for r in prep.outlier_clip(df).collect()) == sorted(["1.0", "2.0", "3.0", "4.0", "7.0", "None"])


def test_constant_columns_stay(spark):
    df = spark.createDataFrame([(5.0, 1.0), (5.0, 3.0)], "c double, x double")
    got = prep.normalize(df).orderBy("x").collect()
    assert [(r["c"], r["x"]) for r in got] == [(5.0, 0.0), (5.0, 1.0)]
    assert prep.normalize(df, "zscore").columns == ["c", "x"]


def test_clean_names_get_suffixes(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["a b", "a.b", "a_b"])
    assert prep.sanitize_names(df).columns == ["a_b", "a_b_2", "a_b_3"]
    assert len(prep.clean_name("x" * 200)) == 128


def test_logical_types(spark):
    df = spark.createDataFrame(
        [("2024-01-01", "x" * 50, "u", 1, True, None, [1])],
        "d string, t string, c string, n int, b boolean, e string, a array<int>")
    assert profile.logical_types(df) == {
        "d": "datetime", "t": "text", "c": "categorical", "n": "numeric", "b": "boolean", "e": "categorical", "a": "nested"}


def test_profiles_cope_with_nested_columns(spark):
    df = spark.createDataFrame([(1, ["x"], {"k": "v"}), (2, ["x"], {"k": "w"})], "id int, tags array<string>, attrs map<string,string>")
    got = {r["name"]: (r["inferred_type"], r["unique_count"]) for r in profile.infer_schema(df).collect()}
    assert got == {"id": ("numeric", 2), "tags": ("nested", 1), "attrs": ("nested", 2)}


def test_quality_of_an_empty_table(spark):
    assert profile.quality_score(spark.createDataFrame([], "a int")).first()["quality_score"] == 0.0


def test_cohorts(spark):
    rows = [("u", "2024-01-05", 1.0), ("u", "2024-03-01", 1.0), ("w", "2024-01-31", 1.0), ("z", "2024-02-01", 1.0), ("q", "2024-02-01", None)]
    df = spark.createDataFrame(rows, "user string, d string, v double")
    got = {(r["cohort"], r["period_index"]): (r["users"], r["retention_pct"]) for r in analytics.cohort_retention(df, "d", "user", "v").collect()}
    assert got == {("2024-01", 0): (2, 100.0), ("2024-01", 2): (1, 50.0), ("2024-02", 0): (1, 100.0), ("2024-02", 2): (0, 0.0)}


def test_funnel_starts_at_one_hundred(spark):
    df = spark.createDataFrame([("a", 10.0), ("b", 5.0), ("x", 1.0)], "s string, v double")
    got = [(r["stage"], r["conversion_pct"], r["drop_off_pct"]) for r in analytics.funnel(df, "s", "v", ["b", "a"]).collect()]
    assert got == [("b", 100.0, 0.0), ("a", 200.0, -100.0), ("x", 20.0, 80.0)]


def test_growth_needs_two_rows_and_a_nonzero_start(spark):
    one = spark.createDataFrame([("2024-01-01", 1.0)], "d string, v double")
    zero = spark.createDataFrame([("2024-01-01", 0.0), ("2024-01-02", 5.0)], "d string, v double")
    good = spark.createDataFrame([("2024-01-01", 2.0), ("2024-01-02", 5.0), ("2024-01-03", 1.0), ("bad", 9.0)], "d string, v double")
    assert timeseries.growth_rate(one, "d", "v").first()["growth_rate"] is None
    assert timeseries.growth_rate(zero, "d", "v").first()["growth_rate"] is None
    assert timeseries.growth_rate(good, "d", "v").first()["growth_rate"] == 200.0


def test_trend_needs_three_rows(spark):
    df = spark.createDataFrame([("2024-01-01", 1.0), ("2024-01-02", 2.0)], "d string, v double")
    assert timeseries.trend(df, "d", "v").count() == 0


def test_p_values(spark):
    # Known values of the t distribution: r and n give t = 2.228 with 10 degrees of freedom, and t = 1 with 1.
    t = 2.2281388519649385
    assert two_sided_p(t / math.sqrt(10 + t * t), 12) == pytest.approx(0.05, abs=1e-9)
    assert two_sided_p(1 / math.sqrt(2), 3) == pytest.approx(0.5, abs=1e-9)
    assert two_sided_p(0.0, 50) == pytest.approx(1.0)
    assert two_sided_p(1.0, 50) == 0.0
    # Two degrees of freedom have a closed form: p = 1 - |r|.
    assert two_sided_p(0.3, 4) == pytest.approx(0.7, abs=1e-12)
    far = two_sided_p(0.002, 999_000)
    assert far == pytest.approx(math.erfc(0.002 * math.sqrt(998_998 / (1 - 4e-6)) / math.sqrt(2)), rel=1e-3)
    got = spark.createDataFrame([(0.3, 4.0), (None, 4.0)], "r double, n double").select(correlation_p("r", "n").alias("p")).collect()
    assert got[0]["p"] == pytest.approx(0.7) and got[1]["p"] is None


def test_deep_correlation_of_a_perfect_line(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, (-1.0) ** i) for i in range(12)], "t double, a double, b double")
    got = {r["column"]: r for r in stats.deep_correlation(df, "t").collect()}
    assert (got["a"]["pearson_r"], got["a"]["spearman_r"], got["a"]["strength"], got["a"]["significant"]) == (1.0, 1.0, "very_strong", True)
    assert got["b"]["significant"] is False
    assert stats.deep_correlation(df.limit(9), "t").count() == 0


def test_correlation_needs_thirty_rows(spark):
    df = spark.range(29).select(F.col("id").cast("double").alias("a"), (F.col("id") * 2).alias("b"))
    assert stats.correlation_matrix(df).count() == 0


def test_clamps_and_months(spark):
    df = spark.createDataFrame([("0.7", "3"), ("7", "99"), ("x", "y"), (None, None), ("-1", "0")], "c string, p string")
    got = [(r[0], r[1]) for r in df.select(scalars.clamp_confidence(F.col("c")), scalars.clamp_priority(F.col("p"))).collect()]
    assert got == [(0.7, 3), (1.0, 10), (0.5, 5), (0.5, 5), (0.0, 1)]
    months = spark.sql("select date '2024-03-01' a, date '2023-12-31' b").select(
        scalars.months_apart(F.col("a"), F.col("b")), scalars.monday_zero(F.lit("2024-01-01").cast("date"))).first()
    assert tuple(months) == (3, 0)


def test_parsers(spark):
    df = spark.createDataFrame([("01/02/2024", "1.5"), ("2024-02-01", "x"), ("never", None)], "d string, n string")
    got = df.select(scalars.parse_datetime(F.col("d"), ["dd/MM/yyyy"]).cast("string"), scalars.parse_number("n")).collect()
    assert [tuple(r) for r in got] == [("2024-02-01 00:00:00", 1.5), ("2024-02-01 00:00:00", None), (None, None)]


def test_label_codes_keep_null(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "s string")
    assert [r["s_enc"] for r in features.label_encode(df).collect()] == [1, 0, None, 1]


def test_log_only_for_skewed_positive_columns(spark):
    df = spark.createDataFrame([(1.0, 1.0)] * 20 + [(1000.0, 2.0)], "skewed double, flat double")
    out, log = features.engineer(df)
    assert "skewed_log" in out.columns and log[0].startswith("Z-score scaled")
    assert "skewed_log" not in features.log1p_if_skewed(df.withColumn("skewed", F.col("skewed") - 1)).columns


def test_steps_log_rows_and_errors(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 1.0), (2, None)], "a int, x double")
    steps = [{"processor": "deduplicate"}, {"processor": "nothing"}, {"processor": "filter_rows", "config": {"conditions": [{"column": "a", "operator": "gt", "value": 1}]}}]
    run = run_steps(df, steps, count_rows=True)
    assert run.df.count() == 1
    assert run.log() == [
        {"processor": "deduplicate", "status": "ok", "rows_before": 3, "rows_after": 2},
        {"processor": "nothing", "status": "skipped", "reason": "unknown processor"},
        {"processor": "filter_rows", "status": "ok", "rows_before": 2, "rows_after": 1}]
    bad = [{"processor": "normalize", "config": {"method": "cube"}}]
    with pytest.raises(KeyError):
        run_steps(df, bad)
    assert run_steps(df, bad, on_error="skip").df.count() == 3
    register_step("twice", lambda d: d.union(d))
    assert run_steps(df, [{"processor": "twice"}]).df.count() == 6


def test_analyses_by_name(spark):
    assert set(ANALYSES) == {"kpis", "cohort", "funnel", "group_aggregate", "correlation", "outlier_summary", "profile", "trend", "segment"}
    with pytest.raises(ValueError):
        analyze(spark.range(1), "magic")


def test_full_run_builds_every_part(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    parts = run_full(df, key=["o_orderkey"], date_col="o_orderdate")
    assert all(len(parts[name].take(1)) == 1 for name in parts if name not in ("missing", "anomalies"))


def test_zero_vectors_score_zero_and_ties_go_by_id(spark):
    docs = spark.createDataFrame([(3, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 0.0]), (4, [0.0, 1.0])], "doc_id bigint, embedding array<double>")
    queries = spark.createDataFrame([("q", [5.0, 0.0])], "query_id string, embedding array<double>")
    got = [(r["rank"], r["doc_id"], r["score"]) for r in retrieval.knn_cosine(docs, queries, 3).orderBy("rank").collect()]
    assert got == [(1, 1, 1.0), (2, 3, 1.0), (3, 2, 0.0)]
    assert retrieval.knn_cosine(docs, queries, 50).count() == 4


def test_neighbours_in_several_passes(spark, monkeypatch):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.array(*[F.rand(i) for i in range(4)]).alias("embedding"))
    docs = spark.createDataFrame(docs.toPandas())
    queries = docs.limit(10).withColumnRenamed("doc_id", "query_id")
    whole = retrieval.knn_cosine(docs, queries, 3).orderBy("query_id", "rank").toPandas()
    monkeypatch.setattr(retrieval, "QUERIES_PER_PASS", 4)
    parts = retrieval.knn_cosine(docs, queries, 3).orderBy("query_id", "rank").toPandas()
    assert whole.equals(parts)


def test_insights_name_the_first_missing_key(spark):
    rows = [('{"insights": [{"category": 1, "title": 2, "description": 3}, {"title": 1}]}',), ('{"insights": []}',), ("{}",), (None,)]
    got = [r["reason"] for r in text.validate_insights(spark.createDataFrame(rows, "j string"), "j").collect()]
    assert got == ["Insight [1] missing required key 'category'.", "", "Missing 'insights' key in LLM response.", "LLM response is not valid JSON."]


def test_json_in_answers(spark):
    rows = [('x ```json\n{"a": 1}\n``` y}',), ('{"a": 1, // note\n "b": 2}',), ("no json",), ("[1, 2] tail",), ("{broken",)]
    got = [r["json"] for r in text.extract_json(spark.createDataFrame(rows, "t string"), "t").collect()]
    assert got == ['{"a": 1}', '{"a": 1, \n "b": 2}', None, "[1, 2]", None]


def test_kde_integrates_to_one(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    got = charts.chart_violin(df, "value").orderBy("point").toPandas()
    area = ((got["density"][1:].to_numpy() + got["density"][:-1].to_numpy()) / 2 * got["x"].diff()[1:].to_numpy()).sum()
    assert len(got) == 50 and 0.8 < area <= 1.01
