"""op10_sharding moves whole documents."""

from pyspark.sql import functions as F

from quillframe.llm import queries, sharding
from quillframe.llm.common import kept_splits

FOLDER = "/root/testdata/sf0.001"


def test_the_query_shards_whole_documents(spark, monkeypatch):
    seen, shard = [], sharding.shard
    monkeypatch.setattr(sharding, "shard", lambda docs, *a: seen.append(docs.columns) or shard(docs, *a))
    queries.QUERIES["op10_sharding"](spark, FOLDER)
    assert seen == [spark.read.parquet(f"{FOLDER}/documents.parquet").columns]


def test_whole_texts_pass_the_exchange(spark, capsys):
    queries.QUERIES["op10_sharding"](spark, FOLDER).explain("formatted")
    out = capsys.readouterr().out
    exchange = out[out.rindex("Exchange\nInput"):].split("\n\n")[0]
    assert "hashpartitioning" in exchange and "text" in exchange.split("Arguments")[0]
    assert "crc32" not in exchange


def test_tables_that_shuffle_are_written_first(spark):
    docs = spark.range(3000).withColumn("k", F.col("id") % 7)
    assert kept_splits(docs, "x") is docs and kept_splits(docs.repartition(5, "k"), "x").inputFiles()
    placed = sharding.shard(docs.repartition(5, "k"), 4)
    assert sorted(r["id"] for r in placed.collect()) == list(range(3000))
    slots = placed.groupBy("shard").agg(F.countDistinct("slot").alias("n"), F.max("slot").alias("m")).collect()
    assert {(r["n"], r["m"]) for r in slots} == {(750, 749)}
