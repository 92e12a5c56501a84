"""Uniform random shards of exact size, by a hypergeometric communication matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillframe.llm.common import ROW, kept_splits, let, packed, unpacked
from quillframe.llm.draws import mirror_points, permuted, split_counts, summed
from quillframe.session import write_out

SEED = 20_251
FAN_OUT = 16  # children of a node in the tree of parts
SPLIT_BITS = 33  # monotonically_increasing_id keeps the row number in its low 33 bits
ROUNDS = 24  # of a permutation
SLOTS = 256  # slots of a shard that go to one place in the exchange


def communication_matrix(sizes: DataFrame, parts: int, capacities: list[int], seed: int = SEED) -> DataFrame:
    """(part, counts): how many rows of each part go to each shard, as a uniform shuffle would have it.

    ``sizes`` holds (part, n) for parts 0 .. ``parts`` - 1, a power of two. The parts form a tree; in each
    node every child's share of each shard is drawn without replacement from what the node has, so that
    row and column sums are exact at every level and all nodes of a level are drawn in parallel.
    """
    spark = sizes.sparkSession

    def deal(state, piece):
        share = split_counts(summed(piece["sizes"]), state["rest"], seed, piece["part"], F.size(piece["sizes"]))
        return let(share, lambda c: F.struct(
            F.zip_with(state["rest"], c, lambda a, b: a - b).alias("rest"), F.concat(state["out"], F.array(c)).alias("out")))

    every = spark.range(parts).withColumnRenamed("id", "part").join(sizes, "part", "left")
    nodes = every.agg(F.array_sort(F.collect_list(F.struct("part", F.coalesce("n", F.lit(0)).alias("n")))).alias("p")).select(
        F.lit(0).cast("long").alias("part"), F.col("p.n").alias("sizes"), F.lit(capacities).cast("array<bigint>").alias("counts"))
    width = parts  # parts below a node
    while width > 1:
        children = min(FAN_OUT, width)
        width //= children
        piece = F.transform(F.sequence(F.lit(0), F.lit(children - 1)), lambda i: F.struct(
            (F.col("part") * children + i).alias("part"), F.slice("sizes", i * width + 1, F.lit(width)).alias("sizes")))
        nodes = nodes.select("counts", piece.alias("pieces")).withColumn("drawn", F.aggregate(
            "pieces", F.struct(F.col("counts").alias("rest"), F.array().cast("array<array<bigint>>").alias("out")), deal,
            lambda s: s["out"]))
        nodes = nodes.select(F.inline(F.zip_with("pieces", "drawn", lambda p, d: F.struct(
            p["part"].alias("part"), p["sizes"].alias("sizes"), d.alias("counts")))))
        if width > 1:
            nodes = nodes.repartition(F.col("part"))
    return nodes.select("part", "counts")


def shard(docs: DataFrame, shards: int = 16, seed: int = SEED) -> DataFrame:
    """``docs`` with ``shard`` (0 .. ``shards`` - 1) and ``slot`` (0, 1, ... within the shard), in that order within each partition.

    The input's splits are the parts. Their rows are permuted in place, by a keyed permutation of their numbers, and dealt to the
    shards in the counts of ``communication_matrix``; where a part's rows begin in a shard follows from the counts, and a
    second keyed permutation over the shard gives the slot. Then whole rows are exchanged once, to blocks of slots. Shard sizes differ by one
    at most. No part or slot depends on a column's values, so repeated rows, nulls, very long texts and hot keys spread
    like any other rows, and each row has a place of its own. An empty table gives an empty one. Input columns called shard or slot are
    replaced. The same files read in the same splits give the same shards; a table that is more than files read,
    filtered and projected is written first, so that its splits stay.
    """
    docs = kept_splits(docs, "shard-rows")
    place = F.monotonically_increasing_id()
    rows = docs.select(packed(docs), F.shiftright(place, SPLIT_BITS).alias("part"), place.bitwiseAND(F.lit((1 << SPLIT_BITS) - 1)).alias("index"))
    sizes = write_out(rows.groupBy("part").agg(F.count("*").alias("n")), "shard-sizes")
    most, total = sizes.agg(F.coalesce(F.max("part"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    capacities = [total // shards + (i < total % shards) for i in range(shards)]
    matrix = communication_matrix(sizes, 1 << int(most).bit_length(), capacities, seed)

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per split
    starts = [F.coalesce(F.sum(F.col("counts")[i]).over(before), F.lit(0)) for i in range(shards)]
    upto = F.transform(F.sequence(F.lit(0), F.lit(shards)), lambda i: summed(F.slice("counts", F.lit(1), i)))
    plan = matrix.select("part", F.array(*starts).alias("starts"), upto.alias("upto")).join(sizes, "part")
    plan = write_out(plan.withColumn("points", mirror_points(F.col("n"), ROUNDS, seed + 1, F.col("part"))), "shard-plan")
    size = F.array(*[F.lit(max(c, 1)).cast("long") for c in capacities])
    points = docs.sparkSession.range(1).select(F.array(*[
        mirror_points(size[i], ROUNDS, seed + 2, F.lit(i)) for i in range(shards)]).alias("shard_points"))

    # The plan has one row per input split, of 128 MB by default: a millionth of the input. The other side is one row.
    dealt = rows.join(F.broadcast(plan), "part").crossJoin(F.broadcast(points))
    dealt = dealt.withColumn("rank", permuted(F.col("index"), F.col("n"), F.col("points"), F.col("part")))
    dealt = dealt.withColumn("shard", F.size(F.filter("upto", lambda c: c <= F.col("rank"))) - 1)
    at = F.col("rank") - F.get("upto", F.col("shard")) + F.get("starts", F.col("shard"))
    slot = permuted(at, F.get(size, F.col("shard")), F.get("shard_points", F.col("shard")), F.col("shard"))
    placed = dealt.select(ROW, "shard", slot.alias("slot"))
    blocks = F.floor(F.col("slot") / SLOTS)
    return unpacked(placed.repartition("shard", blocks).sortWithinPartitions("shard", "slot"), "shard", "slot")
