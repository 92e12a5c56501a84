"""The registered corpus queries next to their SQL, and the pipeline."""

import duckdb
import pytest

import corpus_pipeline
from check import compare, pandas_of
from quillframe.llm.queries import ORACLE, QUERIES
from quillframe.session import scratch_tables, write_out
from workload.base import TABLES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_matches_its_sql(spark, sql, name):
    assert compare(pandas_of(QUERIES[name](spark, FOLDER)), sql.execute(ORACLE[name]).df()).startswith("ok")


def test_every_operator_has_a_query():
    assert [sum(name.startswith(f"op{n}_") for name in QUERIES) for n in range(1, 14)] == [1] * 13


def test_sharding_query(spark):
    rows = QUERIES["op10_sharding"](spark, FOLDER).collect()
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").selectExpr("doc_id", "octet_length(text) + 1 n", "crc32(cast(text as binary)) c")
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in rows} == {tuple(r) for r in docs.collect()}
    assert {r["law"] for r in rows} == {"rows"} and {r["grown_shard"] for r in rows} == {None}


def test_mixing_query(spark):
    rows = QUERIES["op1_mixing"](spark, FOLDER).collect()
    assert sum(r["size"] for r in rows) == pytest.approx(sum({r["source_size"]: r["source_size"] for r in rows}.values()))
    assert sum(r["taken"] for r in rows) == pytest.approx(sum(r["size"] for r in rows), rel=0.02)


EDGE = [(9000, None, "en", "src0", 0), (9001, "", "en", "src1", 0), (9002, "12 34", None, None, 0), (None, "the of and that is thing", "en", "src0", 1)]


def test_stages(spark):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["detect_language", "drop_near_duplicates", "drop_contaminated", "mix_sources", "deal_shards"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    docs = docs.unionByName(docs.limit(20)).unionByName(spark.createDataFrame(EDGE, docs.schema))
    def written(fn):
        return lambda *args: write_out(fn(*args), "stage")

    stage = {name: written(fn) for name, fn in corpus_pipeline.STAGES}
    known = stage["detect_language"](spark, docs, FOLDER)
    assert known.columns == columns and known.filter("doc_id between 9000 and 9002").count() == 0
    assert known.count() == docs.count() - 3
    single = stage["drop_near_duplicates"](spark, known, FOLDER)
    assert single.columns == columns
    texts = {r["text"]: r["doc_id"] for r in single.collect()}
    assert len(texts) == single.count() <= known.select("text").distinct().count()
    first = {r["text"]: r["id"] for r in known.groupBy("text").agg({"doc_id": "min"}).toDF("text", "id").collect()}
    assert all(first[t] == i for t, i in texts.items())
    clean = stage["drop_contaminated"](spark, single, FOLDER)
    assert clean.columns == columns and 0 < clean.count() < single.count()
    mixed = stage["mix_sources"](spark, clean, FOLDER)
    assert mixed.columns == columns
    assert all(r["n_chars"] == len(r["text"]) for r in mixed.collect())
    shards = stage["deal_shards"](spark, mixed, FOLDER)
    assert shards.columns == [*columns, "shard", "slot"] and shards.count() == mixed.count()


def test_run(spark):
    rows = corpus_pipeline.run(spark, FOLDER)
    sizes = [r["count"] for r in rows.groupBy("shard").count().collect()]
    assert len(sizes) == 16 and max(sizes) - min(sizes) <= 1


def test_stages_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = write_out(stage(spark, docs, FOLDER), name)
        assert docs.count() == 0


def test_results_survive_later_calls(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        a = stage(spark, docs, FOLDER)
        b = stage(spark, docs, FOLDER)
        assert a.count() == b.count() > 0
    one, two = corpus_pipeline.run(spark, FOLDER), corpus_pipeline.run(spark, FOLDER)
    assert one.count() == two.count() > 0


def test_run_removes_what_stages_wrote_for_themselves(spark):
    before = set(scratch_tables())
    corpus_pipeline.run(spark, FOLDER)
    left = {t.rsplit("/", 1)[-1].rsplit("-", 1)[0] for t in scratch_tables() if t not in before}
    assert left <= {"pipeline-mix_sources", "shard-sizes", "shard-plan"}
