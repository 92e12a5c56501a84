"""Registered queries on small tables of their own."""

import glob

import pandas as pd
import pytest

from quillframe.sources import readers
from quillframe.streaming import requests
from workload import QUERIES


@pytest.mark.parametrize("values, want", [
    ([1.0] * 20 + [0.0, 1000.0], []),  # not positive
    ([None, None], []),
    ([1.0] * 20 + [1000.0], [0.693147] * 20 + [6.908755]),
    ([1.0, 2.0, 3.0], [None] * 3),  # not skewed
])
def test_log_query_of_columns_that_get_no_log(spark, tmp_path, values, want):
    spark.createDataFrame(list(enumerate(values)), "event_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = QUERIES["log1p_if_skewed"](spark, str(tmp_path))
    assert got.dtypes == [("event_id", "bigint"), ("value", "double"), ("value_log", "double")]
    assert [r["value_log"] for r in got.orderBy("event_id").collect()] == want


@pytest.mark.parametrize("name", ["read_json_list", "read_json_first_list", "read_api_dump_whole"])
def test_files_do_not_grow_with_the_suppliers(spark, tmp_path, monkeypatch, name):
    """300 suppliers, a null one and repeated rows."""
    rows = [(i // 2, 1, float(i % 7), i % 300) for i in range(600)] + [(None, 2, None, None)] * 3
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr("workload.io.scratch_path", lambda spark, label: str(tmp_path / label))
    got = QUERIES[name](spark, str(tmp_path)).collect()
    assert len(glob.glob(str(tmp_path / "*" / "part-*.txt"))) <= 20
    if name == "read_api_dump_whole":
        assert {(r["l_suppkey"], r["items"]) for r in got} == {(None, 3), *((i, 2) for i in range(300))} and len(got) == 301
    else:
        key = lambda r: str((r[0] is None, *r))
        assert sorted((tuple(r[c] for c in ("l_orderkey", "l_linenumber", "l_quantity")) for r in got), key=key) == sorted((r[:3] for r in rows), key=key)


@pytest.mark.parametrize("files", [
    ['{"a": 1,\n"b": [1, 2.5]}', '{"a": 2.5, "c": {"x": null}}'], ['[{"a": 1},\n{"b": "x"}]', "[]"], ["", '{"a": 1}\r\n'],
    [b'\xef\xbb\xbf{"a": 1}'], ['{"a": 1} {"b": 2}'],
])
def test_columns_of_documents_are_those_that_spark_infers(spark, tmp_path, files):
    for i, text in enumerate(files):
        (tmp_path / f"{i}.json").write_bytes(text if isinstance(text, bytes) else text.encode())
    assert readers._document_schema(spark, str(tmp_path)) == spark.read.json(str(tmp_path), multiLine=True).schema


def test_documents_that_are_not_utf8_or_broken_are_left_to_spark(spark, tmp_path):
    (tmp_path / "a.json").write_bytes('{"a": "é"}'.encode("utf-16"))
    assert readers._document_schema(spark, str(tmp_path)) is None
    assert [tuple(r) for r in readers.read_json(spark, str(tmp_path), lines=False).collect()] == [("é",)]
    (tmp_path / "b.json").write_text('{"a": ')
    assert "_corrupt_record" in readers.read_json(spark, str(tmp_path), lines=False).columns


def test_sessions_go_on_and_close(spark):
    """Two callers of one bucket; the earlier session of one goes on, that of the other has ended. Whole numbers stay exact."""
    big = 2**53 + 1
    due = pd.DataFrame({"k0": ["q", "q", "r"], "k1": [big, big, big - 1], "at": [150, 100, 200], "k2": [1, 2, 3]})
    sessions = pd.DataFrame({"k0": ["q", "r", "s"], "k1": [big, big - 1, 1], "at": [95, 90, 99], "hits": [4, 9, 2]})
    counted, left = requests.decided(due, sessions, ["k0", "k1"], ["k2"], 100)
    assert sorted(counted.itertuples(index=False, name=None)) == [("q", big, 100, 2, 5), ("q", big, 150, 1, 6), ("r", big - 1, 200, 3, 1)]
    assert sorted(left.itertuples(index=False, name=None)) == [("q", big, 150, 6), ("r", big - 1, 200, 1), ("s", 1, 99, 2)]


def test_stream_sets_a_timer_per_batch_not_per_request():
    class Handle:
        timers: list = []

        def registerTimer(self, at):
            self.timers.append(at)

    class Waiting:
        def appendValue(self, value):
            assert len(requests._rows_of(value[0])) == 500

    state = requests._Decisions(["k0", "k1"], [], 60)
    state.handle, state.waiting = Handle(), Waiting()
    frame = pd.DataFrame({"bucket": 1, "k0": "q", "k1": range(500), "at": range(1_500, 501_500, 1_000)})
    assert list(state.handleInputRows((1,), iter([frame]), None)) == [] and Handle.timers == [2]
