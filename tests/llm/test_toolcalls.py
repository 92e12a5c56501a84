"""Canonical numbers, the join and the edge rows of tool-call linking."""

import json
import random

from pyspark.sql import functions as F

from quillframe.llm import queries, toolcalls

SCHEMAS = [("go", "x", "number", True)]


def link(spark, calls, results):
    schemas = spark.createDataFrame(SCHEMAS, "name string, param string, type string, required boolean")
    return toolcalls.link(
        spark.createDataFrame(calls, "conv_id int, turn int, call_id string, name string, arguments string, after string, r string, errors int"),
        spark.createDataFrame(results, "conv_id int, turn int, call_id string, content string, c string, depth int"), schemas)


def test_equal_numbers_have_one_form(spark):
    forms = {"1e3": "1000", "1000.0": "1000", "1.0": "1", "-0.0": "0", "-0": "0", "1.50": "1.5", "15e-1": "1.5", "0.00001": "1.0E-5", "1e-5": "1.0E-5",
             "12345678901234567890": "12345678901234567890", "9007199254740993": "9007199254740993", "2E+2": "200", "0.1": "0.1", "-7": "-7"}
    calls = [(1, i, f"c{i}", "go", '{"x":%s,"s":"1.0 and \\"2e3\\" \\\\","l":[%s,true,"%s"]}' % (n, n, n), None, "extra", 5) for i, n in enumerate(forms)]
    got = {r["call_id"]: r["record"] for r in link(spark, calls, []).collect()}
    for i, (n, want) in enumerate(forms.items()):
        assert got[f"c{i}"].startswith('{"arguments":{"l":[%s,true,"%s"],"s":"1.0 and \\"2e3\\" \\\\","x":%s}' % (want, n, want))
        json.loads(got[f"c{i}"])


def test_random_numbers_keep_their_value(spark):
    rng = random.Random(1)
    tokens = [repr(rng.choice([rng.uniform(-1, 1), rng.randrange(-10**6, 10**6), rng.uniform(-1e6, 1e6) * 10.0 ** rng.randrange(-20, 20)])) for _ in range(300)]
    df = spark.createDataFrame([(t, json.dumps({"a": [float(t), t, int(float(t))]})) for t in tokens], "t string, j string")
    for r in df.select("t", "j", toolcalls.canonical_numbers(F.col("j")).alias("c")).collect():
        assert json.loads(r["c"]) == json.loads(r["j"])


def test_calls_and_results_meet_in_a_hash_join(spark, capsys):
    queries.QUERIES["op2_toolcalls"](spark, "/root/testdata/sf0.001").explain()
    plan = capsys.readouterr().out
    assert "ShuffledHashJoin" in plan and "FullOuter" in plan and "SortMergeJoin [call_id" not in plan.split("FullOuter")[0][-200:]


def test_other_columns_long_texts_and_repeated_rows(spark):
    long = "x" * 2_000_000
    calls = [(1, 0, "a", "go", json.dumps({"x": 1, "s": long}), None, "r", 1)] * 3 + [(None, None, "b", None, None, "a", None, None)]
    results = [(1, 1, "a", long + '"1.0"', "c", 2)] * 2 + [(2, 1, None, "lost", None, None)]
    got = {r["call_id"]: r for r in link(spark, calls, results).collect()}
    assert set(got) == {"a", "b"} and (got["a"]["n_calls"], got["a"]["n_results"], got["b"]["depth"]) == (3, 2, 1)
    assert json.loads(got["a"]["record"])["result"] == long + '"1.0"'
    assert link(spark, [], results).count() == 1 and link(spark, calls, []).count() == 2


def test_settled_calls_leave_the_rounds(spark):
    rng = random.Random(3)
    after = {f"n{i}": rng.choice([None, f"n{rng.randrange(i)}" if i else None, f"n{rng.randrange(400)}", "missing"]) for i in range(400)}
    rows = {r["call_id"]: r for r in toolcalls.depths(spark.createDataFrame(list(after.items()), "call_id string, after string")).collect()}
    assert len(rows) == 400
    for call in after:
        seen, at = [call], after[call]
        while at in after and at not in seen:
            seen.append(at)
            at = after[at]
        cyclic = at in after
        assert (rows[call]["depth"], rows[call]["cyclic"]) == (None if cyclic else len(seen) - 1, cyclic)
