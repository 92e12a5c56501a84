"""Tables without numbers or strings, wide tables, odd vectors and odd answers."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillframe.operators import analytics, blocks, charts, profile, retrieval, stats, text
from quillframe.plans import analyze


@pytest.fixture(scope="module")
def words(spark):
    return spark.createDataFrame([("a", "x"), ("b", None), ("a", "y")] * 5, "s string, t string").cache()


@pytest.fixture(scope="module")
def numbers(spark):
    return spark.createDataFrame([(i, float(i % 4)) for i in range(20)], "i int, x double").cache()


@pytest.mark.parametrize("run", [
    analytics.kpis, analytics.kpi_cards, stats.outlier_summary, profile.summary_stats, profile.distribution,
    profile.distribution_histograms, stats.top_correlations, stats.correlation_matrix])
def test_no_numeric_columns(words, numbers, run):
    empty = run(words)
    assert empty.count() == 0 and empty.columns == run(numbers, columns=["i", "x"]).columns if run not in (
        stats.top_correlations, stats.correlation_matrix) else empty.count() == 0


@pytest.mark.parametrize("run", [profile.value_counts, profile.entropy, profile.summary_categories, profile.distribution_categories])
def test_no_string_columns(words, numbers, run):
    assert run(numbers).count() == 0 and run(numbers).columns == run(words).columns


def test_other_operators_without_numbers(words):
    assert charts.dashboard_data(words, ["s"]).count() == 0
    assert {r["category"] for r in analytics.insight_findings(words).collect()} == {"descriptive"}
    assert blocks.quantiles(words, [], [0.5], by=["s"]).columns == ["s", "column", "n", "q"]
    assert blocks.quantiles(words, [], [0.5], by=["s"]).count() == 0


def test_full_run_of_a_text_only_table(words):
    parts = analyze.run_full(words, ["s"])
    assert parts["schema"].count() == 2 and parts["kpis"].count() == 0 and parts["summary"].count() == 0
    for part in parts.values():
        part.collect()


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan")


def test_scans_do_not_grow_with_the_columns(spark, tmp_path):
    wide = spark.range(200).select(*[(F.rand(i) * i).alias(f"c{i}") for i in range(60)])
    wide.write.parquet(str(tmp_path / "wide"))
    wide = spark.read.parquet(str(tmp_path / "wide"))
    assert scans(stats.correlation_matrix(wide)) == scans(stats.correlation_matrix(wide.select("c1", "c2"))) == 1
    assert scans(profile.sample_values(wide)) == 1
    assert scans(profile.distribution_histograms(wide)) == scans(profile.distribution_histograms(wide.select("c1")))
    pdf = wide.toPandas()
    got = stats.correlation_matrix(wide).toPandas().pivot(index="column_a", columns="column_b", values="corr")
    np.testing.assert_allclose(got.loc[pdf.columns, pdf.columns].drop(index="c0", columns="c0"), pdf.drop(columns="c0").corr(), atol=1e-9)


def test_correlation_of_constants_gaps_and_large_means(spark):
    rows = [(0.1, 1e9 + i, float(i), None if i % 3 else i * 2.0, float("nan") if i == 4 else -i * 1.0) for i in range(40)]
    df = spark.createDataFrame(rows, "k double, big double, x double, gap double, neg double")
    got = {(r["column_a"], r["column_b"]): r["corr"] for r in stats.correlation_matrix(df).collect()}
    assert got["k", "k"] is None and got["k", "x"] is None and got["x", "x"] == 1.0
    assert got["big", "x"] == pytest.approx(1.0) and got["gap", "x"] == pytest.approx(1.0) and got["x", "neg"] == pytest.approx(-1.0)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "id int, v array<double>")


def test_neighbours_of_null_and_unequal_vectors(spark):
    docs = vectors(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [1.0, 0.0])])
    asked = vectors(spark, [(7, [1.0, 0.1]), (8, None)])
    got = retrieval.knn_cosine(docs, asked.withColumnRenamed("id", "q"), 2, "id", "v", "q", "v")
    assert [(r["q"], r["rank"], r["id"]) for r in got.orderBy("q", "rank").collect()] == [(7, 1, 1), (7, 2, 4)]
    for bad in ([(1, [1.0]), (2, [0.0, 1.0, 0.0])], [(1, [1.0, 0.0, 2.0])]):
        with pytest.raises(Exception, match="does not have 2 numbers"):
            retrieval.knn_cosine(vectors(spark, bad).coalesce(1), asked.withColumnRenamed("id", "q"), 2, "id", "v", "q", "v").collect()


def test_a_task_emits_k_neighbours_per_query(spark):
    rng = np.random.default_rng(1)
    docs = vectors(spark, [(i, [float(x) for x in rng.normal(size=4)]) for i in range(3000)]).repartition(2)
    asked = vectors(spark, [(i, [float(x) for x in rng.normal(size=4)]) for i in range(5)]).withColumnRenamed("id", "q")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = retrieval.knn_cosine(docs, asked, 3, "id", "v", "q", "v")
        found = {(r["q"], r["rank"]): r["id"] for r in got.collect()}
        plan = got._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    d = {r["id"]: np.array(r["v"]) for r in docs.collect()}
    for r in asked.collect():
        q = np.array(r["v"])
        best = sorted(d, key=lambda i: (-round(float(d[i] @ q / np.linalg.norm(d[i]) / np.linalg.norm(q)), 12), i))[:3]
        assert [found[r["q"], k] for k in (1, 2, 3)] == best
    assert "MapInArrow" in plan.toString()


@pytest.mark.parametrize("body,reason", [
    ({"insights": ["a"]}, "Insight [0] missing required key 'category'."), ({"insights": None}, "'insights' must be a list."),
    ({"insights": {}}, "'insights' must be a list."), ({"other": 1}, "Missing 'insights' key in LLM response."),
    ({"insights": []}, ""), ({"insights": [{"category": 1, "title": {"a": 2}, "description": None}]}, ""),
    ({"insights": [{"category": 1, "title": 2}, 5]}, "Insight [0] missing required key 'description'.")])
def test_insights(spark, body, reason):
    df = spark.createDataFrame([(json.dumps(body),)], "j string")
    assert text.validate_insights(df, "j").first()["reason"] == reason


def test_null_groups_do_not_compare(spark):
    a = spark.createDataFrame([("g", 1.0), (None, 2.0)], "g string, x double")
    assert [r["g"] for r in analytics.compare_datasets(a, a, "x", "g").collect()] == ["g"]


def test_dashboard_needs_enough_rows(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0), (2, 1.0, 5.0)], "a int, b double, c double")
    assert set(charts.dashboard_charts(df, ["a"])) == {"histogram", "scatter", "table", "kpis"}
    assert "table" not in {r["chart"] for r in charts.dashboard_data(df, ["a"]).collect()}
