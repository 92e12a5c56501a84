"""Ordered blocks and exact statistics against pandas, with a hot key and tiny size limits."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillframe.operators import blocks, prep, profile, stats, summaries, timeseries


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(7)
    n = 4000
    pdf = pd.DataFrame({
        "id": np.arange(n),
        "key": np.where(rng.random(n) < 0.6, "hot", rng.integers(0, 40, n).astype(str)),
        "t": rng.integers(0, 300, n),
        "x": np.where(rng.random(n) < 0.4, 5.0, rng.normal(0, 100, n).round(3)),
    })
    return pdf, spark.createDataFrame(pdf).repartition(5).cache()


@pytest.mark.parametrize("partitions", ["8"])
def test_positions_number_the_sorted_table(spark, rows, partitions):
    pdf, df = rows
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = blocks.positions(df, ["t", "id"]).toPandas().sort_values("_pos")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert list(got["_pos"]) == list(range(len(pdf)))
    assert list(got["id"]) == list(pdf.sort_values(["t", "id"])["id"])


def test_ordinals_restart_per_key(rows):
    pdf, df = rows
    got = blocks.ordinals(blocks.positions(df, ["t", "id"], by=["key"]), ["key"]).toPandas().set_index("id")
    want = pdf.sort_values(["key", "t", "id"])
    want["ord"] = want.groupby("key").cumcount()
    want["n"] = want.groupby("key")["id"].transform("size")
    want = want.set_index("id")
    assert (got["_ord"] == want["ord"]).all() and (got["_n"] == want["n"]).all()


@pytest.mark.parametrize("how", ["sum", "max"])
def test_prefix_scan(rows, how):
    pdf, df = rows
    placed = blocks.positions(df, ["t", "id"], by=["key"])
    got = blocks.prefix_scan(placed, F.col("x"), "run", ["key"], how, totals={"total": F.col("x")}).toPandas().set_index("id")
    want = pdf.sort_values(["key", "t", "id"]).set_index("id")
    groups = want.groupby("key")["x"]
    expected = groups.cumsum() if how == "sum" else groups.cummax()
    np.testing.assert_allclose(got["run"].loc[expected.index], expected, atol=1e-8)
    np.testing.assert_allclose(got["total"].loc[want.index], groups.transform("sum"), atol=1e-7)


def test_join_small_is_the_same_join_above_the_broadcast_limit(spark, rows):
    _, df = rows
    small = df.groupBy("key").agg(F.count("*").alias("c"))
    a = blocks.join_small(df, small, ["key"]).orderBy("id").toPandas()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        b = blocks.join_small(df, small, ["key"]).orderBy("id").toPandas()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    pd.testing.assert_frame_equal(a, b)


def test_blocked_frames_cross_block_borders(rows):
    pdf, df = rows
    placed = blocks.ordinals(blocks.positions(df, ["t", "id"], by=["key"]), ["key"])
    column = lambda w: {"s": F.sum("x").over(w.rowsBetween(-4, 2))}
    got = blocks.blocked(placed, column, 4, 2, ["key"], block=5).toPandas().set_index("id")
    assert len(got) == len(pdf)
    want = pdf.sort_values(["key", "t", "id"]).set_index("id")
    for _, g in want.groupby("key"):
        x = g["x"].to_numpy()
        expected = [x[max(i - 4, 0):i + 3].sum() for i in range(len(x))]
        np.testing.assert_allclose(got["s"].loc[g.index], expected, atol=1e-8)


PROBS = [0.0, 0.05, 0.25, 0.5, 0.77, 0.9, 1.0]


@pytest.mark.parametrize("by", [[], ["key"]])
def test_quantiles_are_exact(rows, by):
    pdf, df = rows
    got = blocks.quantiles(df, ["x", "t"], PROBS, by).collect()
    groups = {(): pdf} if not by else {(k,): g for k, g in pdf.groupby("key")}
    assert len(got) == 2 * len(groups)
    for r in got:
        g = groups[tuple(r[b] for b in by)]
        assert r["n"] == len(g)
        np.testing.assert_allclose(r["q"], np.quantile(g[r["column"]], PROBS), atol=1e-9)


def test_quantiles_of_close_and_far_values(spark):
    """Neighbouring doubles need every level; the rest spans all magnitudes."""
    rng = np.random.default_rng(3)
    near = [np.float64(1.0)]
    for _ in range(300):
        near.append(np.nextafter(near[-1], 2.0))
    sets = {
        "near": np.array(near + [1.04] * 5), "far": np.concatenate([10.0 ** rng.uniform(-320, 308, 200), -(10.0 ** rng.uniform(-320, 308, 201))]),
        "signs": np.array([-0.0, 0.0, -5e-324, 5e-324, 1.0, -1.0, 0.1, 0.1]), "one": np.array([3.5])}
    rows = [(None if name == "one" else name, float(v)) for name, values in sets.items() for v in values]
    got = {r["g"]: r["q"] for r in blocks.quantiles(spark.createDataFrame(rows, "g string, x double"), ["x"], PROBS, ["g"]).collect()}
    assert set(got) == {"near", "far", "signs", None}
    for name, values in sets.items():  # as a whole column, too
        whole = spark.createDataFrame([(float(v),) for v in values] + [(float("nan"),), (None,)], "x double")
        assert blocks.quantiles(whole, ["x"], PROBS).first()["q"] == got[None if name == "one" else name]
    for name, values in sets.items():
        values, want = np.sort(values), []
        for p in PROBS:
            at = p * (len(values) - 1)
            low, high = values[int(np.floor(at))], values[int(np.ceil(at))]
            want.append(low if low == high or at == int(at) else low + (high - low) * (at - np.floor(at)))
        assert got[None if name == "one" else name] == want


def test_quantiles_need_no_sort_of_values(rows, capsys):
    _, df = rows
    blocks.quantiles(df, ["x", "t"], PROBS, ["key"]).explain()
    assert "rangepartitioning" not in capsys.readouterr().out


def test_quantiles_of_infinities(spark):
    df = spark.createDataFrame([(float(x),) for x in ("inf", "inf", "-inf", "1", "2")], "x double")
    q = blocks.quantiles(df, ["x"], [0.0, 0.25, 0.5, 0.75, 1.0]).first()["q"]
    assert q == [float("-inf"), 1.0, 2.0, float("inf"), float("inf")]


def test_sample_is_exact_repeatable_and_equal_with_and_without_the_prefilter(spark, rows):
    pdf, df = rows
    got = blocks.hash_sample(df, 50, ["id"]).toPandas()
    again = blocks.hash_sample(df.repartition(3), 50, ["id"]).toPandas()
    ranked = df.withColumn("h", blocks.row_hash(["id"], 42)).orderBy("h").limit(50).toPandas()
    assert len(got) == 50
    assert set(got["id"]) == set(again["id"]) == set(ranked["id"])
    assert len(blocks.hash_sample(df, 10_000, ["id"]).toPandas()) == len(pdf)


def test_sample_with_few_distinct_hashes_falls_back(spark):
    df = spark.range(5000).select(F.lit("same").alias("k"), "id")
    assert blocks.hash_sample(df, 10, ["k"]).count() == 10


def test_stratified_sample_keeps_quotas_with_the_prefilter(spark):
    df = spark.range(30_000).select("id", F.when(F.col("id") % 10 == 0, "b").when(F.col("id") == 7, "c").otherwise("a").alias("g"))
    got = {r["g"]: r["count"] for r in prep.stratified_sample(df, ["id"], threshold=100, size=300).groupBy("g").count().collect()}
    assert got == {"a": 269, "b": 30, "c": 1}


def test_stratified_sample_without_a_small_string_column(spark):
    df = spark.range(2000).select("id", F.concat(F.lit("v"), "id").alias("g"))
    assert prep.stratified_sample(df, ["id"], threshold=100, size=300).count() == 300


def test_value_counts_top_k_breaks_ties_by_value(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",), (None,)], "s string")
    got = blocks.top_per(blocks.value_counts(df, ["s"]), ["column"], [F.col("n").desc(), F.col("value")], 2).orderBy("rank").collect()
    assert [(r["value"], r["n"]) for r in got] == [("c", 2), ("a", 1)]


def test_spearman_averages_ties_over_complete_pairs(rows):
    pdf, df = rows
    pdf = pdf.assign(y=np.where(pdf["x"] > 50, np.nan, pdf["x"] ** 2))
    df = df.withColumn("y", F.when(F.col("x") <= 50, F.col("x") * F.col("x")))
    got = {r["column"]: r["spearman_r"] for r in stats.spearman(df, "t", ["x", "y", "id"]).collect()}
    for c in ("x", "y", "id"):
        pair = pdf[["t", c]].dropna().rank()
        assert got[c] == pytest.approx(pair["t"].corr(pair[c]), abs=1e-12)


@pytest.mark.parametrize("n", [2, 3000])
def test_growth_splits_ties_by_value(spark, n):
    rng = np.random.default_rng(n)
    pdf = pd.DataFrame({"d": rng.integers(0, 3, n), "g": rng.integers(0, 2, n), "v": rng.integers(1, 9, n).astype(float)})
    df = spark.createDataFrame(pdf).withColumn("t", F.expr("date_add(date '2024-01-01', cast(d as int))"))
    for by in ([], ["g"]):
        got = {tuple(r[b] for b in by): r["growth_rate"] for r in timeseries.growth_rate(df, "t", "v", by).collect()}
        groups = {(): pdf} if not by else {(k,): x for k, x in pdf.groupby("g")}
        for k, x in groups.items():
            v = x.sort_values(["d", "v"])["v"].to_numpy()
            a, b = v[:len(v) // 2].sum(), v[len(v) // 2:].sum()
            assert (got[k] is None and len(v) < 2) or got[k] == pytest.approx((b - a) / a * 100, abs=0.0051)


def test_trend_with_many_equal_rows(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"t": np.sort(rng.integers(0, 20, 3000)), "v": rng.integers(0, 4, 3000).astype(float)})
    df = spark.createDataFrame(pdf).withColumn("t", F.expr("timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, t)"))
    got = timeseries.trend(df, "t", "v").first()
    y = pdf.sort_values(["t", "v"])["v"].to_numpy()
    x = np.arange(len(y))
    slope = np.polyfit(x, y, 1)[0]
    assert got["slope"] == pytest.approx(slope, abs=1e-6)
    assert got["r_squared"] == pytest.approx(np.corrcoef(x, y)[0, 1] ** 2, abs=1e-4)
    assert (got["first_value"], got["last_value"], got["data_points"]) == (y[0], y[-1], len(y))


@pytest.mark.parametrize("span", [1, 2, 30])
def test_ewma_equals_pandas_over_many_blocks(spark, span):
    rng = np.random.default_rng(5)
    n = 3000 if span != 2 else 6000
    pdf = pd.DataFrame({"i": np.arange(n), "v": rng.normal(1000, 300, n)})
    df = spark.createDataFrame(pdf).withColumn("t", F.expr("date_add(date '2000-01-01', cast(i as int))"))
    got = timeseries.ewma(df, "t", "v", spans=[span]).orderBy("time").toPandas()
    want = pdf["v"].ewm(span=span).mean()
    np.testing.assert_allclose(got[f"ewma_{span}"], want, rtol=1e-11)


@pytest.mark.parametrize("period", [4, 7])
def test_decompose_equals_pandas(spark, period):
    rng = np.random.default_rng(6)
    v = rng.normal(10, 3, 40)
    df = spark.createDataFrame(pd.DataFrame({"i": np.arange(40), "v": v})).withColumn("t", F.expr("date_add(date '2000-01-01', cast(i as int))"))
    got = timeseries.decompose(df, "t", "v", period=period).orderBy("time").toPandas()
    ts = pd.Series(v)
    trend = ts.rolling(window=period, center=True).mean()
    seasonal = (ts - trend).groupby(np.arange(40) % period).transform("mean")
    np.testing.assert_allclose(got["trend"].astype(float), trend, rtol=1e-12)
    np.testing.assert_allclose(got["seasonal"], seasonal, rtol=1e-9)
    np.testing.assert_allclose(got["residual"].astype(float), ts - trend - seasonal, rtol=1e-9, atol=1e-12)


def test_decompose_needs_two_periods(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(13)], "i int, v double").withColumn("t", F.expr("date_add(date '2000-01-01', i)"))
    assert timeseries.decompose(df, "t", "v").count() == 0


@pytest.mark.parametrize("bits", [1 << 15, 1 << 25])
def test_only_rows_with_shared_hashes_are_suspects(spark, monkeypatch, bits):
    monkeypatch.setattr(blocks, "SIEVE_BITS", bits)
    rows = [(i % 900, None if i % 7 == 0 else f"s{i % 900}") for i in range(1000)]
    df = spark.createDataFrame(rows, "a int, b string")
    told = blocks.suspects(df, ["a", "b"])
    counts = {}
    for r in rows:
        counts[r] = counts.get(r, 0) + 1
    assert {(r["a"], r["b"]) for r in told.filter("NOT _suspect").collect()} <= {k for k, n in counts.items() if n == 1}
    assert told.filter("NOT _suspect").count() > (0 if bits == 1 << 15 else 700)
    assert sorted(map(str, prep.deduplicate(df).collect())) == sorted(map(str, df.distinct().collect()))
    assert tuple(profile.duplicate_rows(df).first()) == (1000, 1000 - len(counts))
    assert tuple(profile.duplicate_rows(df.limit(0)).first()) == (0, 0)


def test_rows_without_copies_are_not_shuffled(spark, capsys):
    profile.duplicate_rows(spark.range(500).selectExpr("id", "concat('text ', id) as s")).explain()
    plan = capsys.readouterr().out
    assert "_suspect" not in plan.split("Exchange hashpartitioning(k0")[0][-400:]  # what passes the exchange has been filtered


def test_summaries_take_one_scan(spark, tmp_path, capsys):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({f"c{i}": rng.normal(i, 1 + i, 500) for i in range(60)})
    pdf.loc[::3, "c1"] = np.nan
    pdf["c2"], pdf["c3"] = 0.1, None
    pdf["c3"] = pdf["c3"].astype(float)
    spark.createDataFrame(pdf).repartition(6).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    scans = []
    for columns in (df.columns[:2], df.columns):
        for frame in (summaries.summaries(df, columns), summaries.co_moments(df, columns)):
            capsys.readouterr()
            frame.explain()
            scans.append(capsys.readouterr().out.count("FileScan"))
    assert scans == [1, 1, 1, 1]
    got = {r["column"]: r for r in summaries.summaries(df, df.columns).collect()}
    for c in df.columns:
        x = pdf[c].dropna()
        r = got[c]
        assert (r["rows"], r["count"], r["negatives"], r["zeros"]) == (500, len(x), (x < 0).sum(), (x == 0).sum())
        if not len(x):
            assert (r["mean"], r["std"], r["min"], r["skewness"], r["total"]) == (None,) * 5
            continue
        np.testing.assert_allclose([r["mean"], r["std"], r["min"], r["max"], r["total"]], [x.mean(), x.std() if c != "c2" else 0.0, x.min(), x.max(), x.sum()], rtol=1e-10, atol=1e-12)
        if c == "c2":
            assert r["skewness"] is None and r["kurtosis"] is None
        else:
            d = x - x.mean()
            np.testing.assert_allclose(
                [r["skewness"], r["kurtosis"]], [(d**3).mean() / (d**2).mean()**1.5, (d**4).mean() / (d**2).mean()**2 - 3], rtol=1e-8, atol=1e-10)
    corr = {(r["column_a"], r["column_b"]): r["corr"] for r in stats.correlation_matrix(df).collect()}
    want = pdf.corr()
    for (a, b), r in corr.items():
        assert r is None if {a, b} & {"c2", "c3"} else abs(r - want.loc[a, b]) < 1e-10


def test_summaries_far_from_zero(spark):
    x = 1e9 + np.random.default_rng(1).normal(0, 1e-3, 4000)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": -x})).repartition(7)
    r = summaries.summaries(df, ["x"]).first()
    assert abs(r["std"] / x.std(ddof=1) - 1) < 1e-5  # the means themselves hold no more
    assert abs({(q["column_a"], q["column_b"]): q["corr"] for q in stats.correlation_matrix(df).collect()}["x", "y"] + 1) < 1e-9


def test_false_discovery_rates(spark):
    p = [0.001, 0.03, 0.02, None, 0.5, 0.02, 0.9]
    got = {r["i"]: r["q_value"] for r in stats.false_discovery(spark.createDataFrame(list(enumerate(p)), "i int, p_value double")).collect()}
    known = sorted(x for x in p if x is not None)
    for i, x in enumerate(p):
        want = None if x is None else min(min(y * len(known) / (known.index(y) + known.count(y)) for y in known if y >= x), 1.0)
        assert got[i] is None if want is None else abs(got[i] - want) < 1e-12
