"""Draws, permutations, mixing and sharding."""

import collections
import math

import pytest
from pyspark.sql import functions as F

from quillframe.llm import draws, mixing, sharding
from quillframe.llm.common import part_count, uniform

SCHEMA = "doc_id bigint, text string, source string, shard string, slot int, _id int, size string"
LONG = " ".join(f"w{i}" for i in range(30_000))


def edge_rows():
    rows = [(i, " ".join(["word"] * (i % 40)), f"s{i % 3}", "x", 1, 2, "y") for i in range(300)]
    rows += [(None, "a null id", "s0", None, None, None, None), (1, None, "s1", None, None, None, None), (2, "", None, None, None, None, None)]
    rows += [(3, "  \t\n", "é", None, None, None, None), (4, LONG, "𝄞", None, None, None, None)]
    return rows + [(7, "same row again", "s2", None, None, None, None)] * 40


def test_hypergeometric_matches_its_distribution(spark):
    total, marked, drawn, n = 50, 20, 10, 40_000
    lits = [F.lit(x).cast("long") for x in (total, marked, drawn)]
    rows = spark.range(n).select(draws.hypergeometric(*lits, uniform(1, "id")).alias("k")).groupBy("k").count().collect()
    for row in rows:
        chance = math.comb(marked, row["k"]) * math.comb(total - marked, drawn - row["k"]) / math.comb(total, drawn)
        assert abs(row["count"] - n * chance) < 5 * math.sqrt(n * chance) + 5


def test_binomial_matches_its_distribution(spark):
    n, p, size = 30, 0.3, 40_000
    drawn = draws.binomial(F.lit(n).cast("long"), F.lit(p), uniform(2, "id"))
    for row in spark.range(size).select(drawn.alias("k")).groupBy("k").count().collect():
        chance = math.comb(n, row["k"]) * p ** row["k"] * (1 - p) ** (n - row["k"])
        assert abs(row["count"] - size * chance) < 5 * math.sqrt(size * chance) + 5


@pytest.mark.parametrize("args,want", [((0, 0, 0), 0), ((5, 5, 3), 3), ((5, 0, 3), 0), ((9, 4, 9), 4), ((10**12, 0, 5), 0)])
def test_hypergeometric_without_choice(spark, args, want):
    lits = [F.lit(x).cast("long") for x in args]
    assert spark.range(1).select(draws.hypergeometric(*lits, F.lit(0.999)).alias("k")).first()["k"] == want


def test_large_draws_stay_near_their_mean(spark):
    lits = [F.lit(x).cast("long") for x in (10**10, 10**9, 10**7)]
    mean = spark.range(30).select(draws.hypergeometric(*lits, uniform(3, "id")).alias("k")).agg(F.avg("k")).first()[0]
    assert abs(mean - 10**6) < 1_000


def test_permutation_is_a_bijection_for_every_size(spark):
    rows = spark.range(1, 60).select(F.col("id").alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("id") - 1)).alias("i"))
    points = draws.mirror_points(F.col("n"), 24, 9, F.lit(1))
    rows = rows.withColumn("p", draws.permuted(F.col("i"), F.col("n"), points, F.lit(0)))
    bad = rows.groupBy("n").agg(F.countDistinct("p").alias("d"), F.min("p").alias("a"), F.max("p").alias("b"))
    assert bad.filter("d <> n or a <> 0 or b <> n - 1").count() == 0
    moved = rows.filter("n > 30").agg(F.avg((F.col("p") == F.col("i")).cast("int"))).first()[0]
    assert moved < 0.15


def test_matrix_has_exact_margins(spark):
    sizes = [0, 5, 100, 3, 0, 0, 42, 50]
    table = spark.createDataFrame(list(enumerate(sizes)), "part bigint, n bigint").filter("n > 0")
    capacities = [67, 67, 66]
    rows = {r["part"]: r["counts"] for r in sharding.communication_matrix(table, 8, capacities).collect()}
    assert [sum(rows[i]) for i in range(8)] == sizes
    assert [sum(rows[i][j] for i in range(8)) for j in range(3)] == capacities


@pytest.mark.parametrize("rows", [0, 1, 5, 1000])
def test_shards_are_even_and_gapless(spark, rows):
    placed = sharding.shard(spark.range(rows).withColumnRenamed("id", "doc_id"), 16).collect()
    assert sorted(r["doc_id"] for r in placed) == list(range(rows))
    slots = collections.defaultdict(list)
    for r in placed:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    sizes = [len(slots[i]) for i in range(16)]
    assert max(sizes) - min(sizes) <= 1


def test_shards_mix_neighbours(spark):
    placed = sharding.shard(spark.range(4000), 4).collect()
    for s in range(4):
        order = [r["id"] for r in sorted(placed, key=lambda r: r["slot"]) if r["shard"] == s]
        up = sum(a < b for a, b in zip(order, order[1:]))
        assert 400 < up < 600
        assert 1800 < sum(order) / len(order) < 2200


def test_sharding_edge_rows(spark):
    rows = edge_rows()
    placed = sharding.shard(spark.createDataFrame(rows, SCHEMA), 16)
    assert placed.columns == ["doc_id", "text", "source", "_id", "size", "shard", "slot"]
    got = collections.Counter((r["doc_id"], r["text"], r["_id"]) for r in placed.collect())
    assert got == collections.Counter((r[0], r[1], r[5]) for r in rows)
    assert placed.select("shard", "slot").distinct().count() == len(rows)


def reference_targets(sizes, weights, epochs):
    open_, target, left = dict(weights), {}, float(sum(sizes.values()))
    while open_:
        heavy = sum(open_.values())
        above = [s for s in open_ if left * open_[s] / heavy > epochs * sizes[s]]
        if not above:
            return target | {s: left * w / heavy for s, w in open_.items()}
        for s in above:
            target[s] = float(epochs * sizes[s])
            del open_[s]
        left = sum(sizes.values()) - sum(target.values())
    return target


@pytest.mark.parametrize("sizes", [
    {"a": 1000, "b": 10, "c": 5, "d": 0, "e": 2000, None: 7}, {"a": 0}, {"Z": 1, "a": 100, "é": 100, "𝄞": 3}, {"a": 1, "b": 1, "c": 100_000}])
def test_targets(spark, sizes):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weights = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    want = reference_targets(sizes, weights, 3)
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r["source"]: r["target"] for r in mixing.targets(table, (1, 2, 3), 3).collect()}
    assert got.keys() == want.keys()
    assert all(got[s] == pytest.approx(want[s]) for s in want)


def test_mix_meets_targets_and_epochs(spark):
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.concat_ws(" ", F.array_repeat(F.lit("w"), (F.col("id") % 50).cast("int"))).alias("text"),
        F.when(F.col("id") % 10 < 6, "big").otherwise(F.concat(F.lit("s"), (F.col("id") % 10).cast("string"))).alias("source"))
    taken = mixing.taken_by_row(mixing.mix(docs, block_words=16, shard_blocks=256)).collect()
    assert len(taken) == 3000
    sums = collections.defaultdict(int)
    for r in taken:
        assert 0 <= r["taken"] <= 3 * r["size"]
        sums[r["source"]] += r["taken"]
    for r in taken:
        assert abs(sums[r["source"]] - r["target"]) <= 32
    again = mixing.taken_by_row(mixing.mix(docs.repartition(7), block_words=16, shard_blocks=256))
    assert {(r["doc_id"], r["taken"]) for r in again.collect()} == {(r["doc_id"], r["taken"]) for r in taken}


def test_spans_tile_their_blocks(spark):
    docs = spark.createDataFrame([(i, "x " * (i * 7 % 90), "ab"[i % 2]) for i in range(200)], "doc_id int, text string, source string")
    mixed = mixing.mix(docs, block_words=32, shard_blocks=8)
    blocks = mixed.spans.groupBy("shard", "sid", "draw").agg(F.sum("n").alias("n"), F.countDistinct("block").alias("b")).collect()
    assert all(r["b"] == 1 and r["n"] <= 32 for r in blocks)
    assert sum(r["n"] == 32 for r in blocks) >= len(blocks) - 6
    per_shard = mixed.spans.groupBy("shard").agg(F.countDistinct("sid", "draw").alias("n")).collect()
    assert sorted(r["n"] for r in per_shard)[1:] == [8] * (len(per_shard) - 1)


def test_mix_edge_rows(spark):
    rows = edge_rows()
    mixed = mixing.mix(spark.createDataFrame(rows, SCHEMA))
    taken = mixing.taken_by_row(mixed)
    assert taken.columns == ["doc_id", "text", "source", "shard", "slot", "_id", "size", "source_size", "target", "taken"]
    assert taken.count() == len(rows)
    for r in taken.collect():
        assert r["size"] == len((r["text"] or "").split()) and r["taken"] <= 3 * r["size"]
    docs = mixing.mixed_documents(mixed)
    assert docs.columns == ["doc_id", "text", "source", "shard", "slot", "_id", "size"]
    words = sum(len(r["text"].split()) for r in docs.collect())
    assert words == sum(r["taken"] for r in taken.collect())
    whole = {r["text"] for r in docs.collect()} & {r[1] for r in rows}
    assert "same row again" in whole


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.taken_by_row(mixing.mix(empty)).count() == 0
    assert mixing.mixed_documents(mixing.mix(empty)).count() == 0
    assert sharding.shard(empty, 16).count() == 0


def test_parts_grow_with_the_square_root():
    assert part_count(0) == 2 and part_count(10**6) == 2048 and part_count(4 * 10**6) == 4096
