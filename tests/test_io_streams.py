"""Files, the catalog, and request logs as streams."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quillframe.session import scratch_path, scratch_root
from quillframe.sources import catalog, readers, writers
from quillframe.streaming import requests


def test_csv_encodings_and_null_tokens(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("name,n,x,ok\nü,1,1.5,True\nNA,2,N/A,False\n".encode())
    (tmp_path / "b.csv").write_bytes("name,n,x,ok\né,3,2,True\n".encode("latin-1"))
    df = readers.read_csv(spark, str(tmp_path))
    assert dict(df.dtypes) == {"name": "string", "n": "bigint", "x": "double", "ok": "boolean"}
    assert [tuple(r) for r in df.orderBy("n").collect()] == [("ü", 1, 1.5, True), (None, 2, None, False), ("é", 3, 2.0, True)]


def test_json_finds_the_first_list(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"z": 1, "rows": [{"a": 1}, {"a": 2}], "b": [{"a": 9}]}))
    assert sorted(r["a"] for r in readers.read_json(spark, str(tmp_path / "a.json")).collect()) == [1, 2]
    (tmp_path / "l.json").write_text(json.dumps([{"a": 5}, {"a": 6}]))
    assert sorted(r["a"] for r in readers.read_json(spark, str(tmp_path / "l.json")).collect()) == [5, 6]
    (tmp_path / "o.json").write_text(json.dumps({"a": 7}))
    assert [r["a"] for r in readers.read_json(spark, str(tmp_path / "o.json")).collect()] == [7]
    (tmp_path / "s.json").write_text(json.dumps({"v": [1, 2]}))
    assert sorted(r["value"] for r in readers.read_json(spark, str(tmp_path / "s.json")).collect()) == [1, 2]


def test_json_lines_are_found_and_mixed_files_refused(spark, tmp_path):
    (tmp_path / "lines.json").write_text('{"a": 1}\n\n{"a": 2}\n{"a": 3}')
    assert sorted(r["a"] for r in readers.read_json(spark, str(tmp_path / "lines.json")).collect()) == [1, 2, 3]
    for text in ('{"a":\n 1}\n{"a": 2}\n', '{"a": 1}\n{"a": ', "no json"):
        (tmp_path / "mixed.json").write_text(text)
        with pytest.raises(ValueError):
            readers.read_json(spark, str(tmp_path / "mixed.json"))


def test_csv_fields_with_line_breaks(spark, tmp_path):
    rows = [(1, 'a "b",\nc'), (2, "d\n\ne"), (3, None)]
    writers.write_csv(spark.createDataFrame(rows, "id bigint, s string"), str(tmp_path / "out"))
    assert sorted(tuple(r) for r in readers.read_csv(spark, str(tmp_path / "out")).collect()) == rows


def test_api_dump_with_a_path(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"data": {"items": [{"a": 1}, {"a": 2}]}}))
    assert sorted(r["a"] for r in readers.read_api_dump(spark, str(tmp_path / "r.json"), "$.data.items").collect()) == [1, 2]
    assert readers.read_api_dump(spark, str(tmp_path / "r.json")).count() == 1


def test_sql_sources_are_checked():
    assert readers.jdbc_options("jdbc:postgresql://h/d", "select 1")["query"] == "select 1"
    for url, sql in (("jdbc:oracle:thin:@h", "select 1"), ("jdbc:mysql://h/d", "DROP TABLE t"), ("jdbc:mysql://h/d", "select " + "1" * 6000)):
        with pytest.raises(ValueError):
            readers.jdbc_options(url, sql)


def test_csv_keeps_known_columns_and_nested_values(spark, tmp_path):
    df = spark.createDataFrame([(1, ["x", "y"])], "id int, tags array<string>")
    writers.write_csv(df, str(tmp_path / "out"), ["tags", "id", "absent"])
    got = spark.read.csv(str(tmp_path / "out"), header=True, escape='"').first()
    assert tuple(got) == ('["x","y"]', "1")


def test_catalog_lists_the_latest_record(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, s string")
    first = catalog.catalog_record(df, "d", name="old").withColumn("created_at", F.expr("timestamp '2024-01-01 00:00:00'"))
    later = catalog.catalog_record(df.limit(1), "d", name="new").withColumn("created_at", F.expr("timestamp '2024-01-02 00:00:00'"))
    got = catalog.catalog_list(first.unionByName(later)).collect()
    assert [(r["name"], r["row_count"], r["col_count"], [c["name"] for c in r["columns"]]) for r in got] == [("new", 1, 2, ["id", "s"])]


def test_scratch_folder_comes_from_the_session(spark, monkeypatch):
    assert scratch_path(spark, "x").startswith(scratch_root(spark))
    assert scratch_root(spark) == spark.conf.get("spark.checkpoint.dir")


LIMITS = {"q": 2, "default": 1}


@pytest.fixture(scope="module")
def log(spark):
    rows = [(1, "q", "u", "10:00:00"), (2, "q", "u", "10:30:00"), (3, "q", "u", "10:40:00"), (4, "q", "u", "11:40:00"), (5, "other", "u", "10:00:00"),
            (6, "other", "u", "10:59:59"), (7, "q", "w", "10:00:00")]
    return spark.createDataFrame(rows, "id int, e string, c string, t string").withColumn("t", F.expr("to_timestamp('2024-01-01 ' || t)"))


def test_every_request_renews_the_session_and_an_exact_gap_ends_it(log):
    got = {r["id"]: (r["hits"], r["allowed"]) for r in requests.rate_limit(log, "t", "e", "c", ["id"], 3600, LIMITS).collect()}
    assert got == {1: (1, True), 2: (2, True), 3: (3, False), 4: (1, True), 5: (1, True), 6: (2, False), 7: (1, True)}


def test_a_second_run_closes_what_the_first_left_open(spark, log, tmp_path):
    path, out = str(tmp_path / "log"), str(tmp_path / "out")
    log.coalesce(1).write.parquet(path)
    run = lambda: requests.run_available(
        requests.rate_limit_sessions(requests.read_log(spark, path, log.schema), "t", "e", "c", "1 hour", 3599, LIMITS), "t", out)
    first = run().count()
    late = spark.createDataFrame([(99, "end", "end", "2024-02-01 00:00:00")], "id int, e string, c string, t string").withColumn("t", F.to_timestamp("t"))
    late.coalesce(1).write.mode("append").parquet(path)
    whole = run()
    batch = requests.rate_limit_sessions(log, "t", "e", "c", "1 hour", 3599, LIMITS)
    assert first < whole.count() == batch.count()
    assert sorted(tuple(r) for r in whole.select("e", "c", "hits").collect()) == sorted(tuple(r) for r in batch.select("e", "c", "hits").collect())


def test_stream_equals_batch_for_closed_windows(spark, log, tmp_path):
    late = spark.createDataFrame([(99, "end", "end", "2024-02-01 00:00:00")], "id int, e string, c string, t string").withColumn("t", F.to_timestamp("t"))
    path = str(tmp_path / "log")
    log.unionByName(late).coalesce(1).write.parquet(path)
    stream = requests.read_log(spark, path, log.schema)
    got = requests.run_available(requests.rate_limit_sessions(stream, "t", "e", "c", "1 hour", 3599, LIMITS), "t").orderBy("e", "c", "session_start").toPandas()
    want = requests.rate_limit_sessions(log, "t", "e", "c", "1 hour", 3599, LIMITS).orderBy("e", "c", "session_start").toPandas()
    assert got.equals(want) and len(got) == 4


def test_late_rows_are_dropped_by_the_stream(spark, log, tmp_path):
    path = str(tmp_path / "log")
    far = log.withColumn("t", F.expr("t + interval 10 days"))
    # Spark drops rows older than the watermark of the batch before the last one.
    for part in (far, far.withColumn("t", F.expr("t + interval 1 hour")), log, far.withColumn("t", F.expr("t + interval 10 days"))):
        part.coalesce(1).write.mode("append").parquet(path)
    stream = requests.read_log(spark, path, log.schema, maxFilesPerTrigger=1)
    usage = requests.usage_rollup(stream, "t", [], F.col("e") == "q", F.col("id"), "1 day", "1 hour")
    got = requests.run_available(usage, "late").collect()
    assert [(r["calls"], r["succeeded"], r["success_rate"]) for r in got] == [(14, 10, 71.4)]


def test_usage_of_an_empty_log(log):
    got = requests.usage_total(log.limit(0), F.col("e") == "q", F.col("id")).first()
    assert (got["calls"], got["amount"], got["success_rate"]) == (0, 0, 100.0)


def test_decisions_of_a_stream_equal_the_batch_across_a_restart(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, rng.choice("qr"), rng.choice(["u", "v"]), rng.randrange(40_000)) for i in range(300)]
    log = spark.createDataFrame(rows, "id long, e string, c string, s int").withColumn("t", F.expr("timestamp '2024-01-01 00:00:00.0005' + make_interval(0,0,0,0,0,0,s)")).drop("s")
    path, out = str(tmp_path / "log"), str(tmp_path / "out")
    seconds = F.unix_timestamp("t") - F.unix_timestamp(F.lit("2024-01-01 00:00:00"))
    run = lambda: requests.run_available(
        requests.rate_limit_decisions(requests.read_log(spark, path, log.schema), "t", "e", "c", ["id"], "2 hours", 1800, LIMITS), "t", out)
    seen = []
    for low, high in ((0, 15_000), (12_000, 28_000), (25_000, 40_000)):  # each part starts before the last has ended
        part = log.filter((seconds >= low) & (seconds < high) & ~F.col("id").isin([-1, *seen]))
        seen += [r["id"] for r in part.select("id").collect()]
        part.orderBy(F.rand(3)).coalesce(1).write.mode("append").parquet(path)
        first = run().count()
    end = spark.createDataFrame([(9999, "end", "end")], "id long, e string, c string").withColumn("t", F.expr("timestamp '2024-02-01 00:00:00'"))
    end.coalesce(1).write.mode("append").parquet(path)
    got = run()
    want = requests.rate_limit(log, "t", "e", "c", ["id"], 1800, LIMITS)
    assert 0 < first < got.count() == 300
    shown = lambda df: sorted(map(tuple, df.select("id", "e", "c", "t", "hits", "allowed").collect()))
    assert shown(got) == shown(want)
