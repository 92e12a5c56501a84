"""Mixing sources to target weights: packed blocks, multinomial shard counts, index permutations."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillframe.llm.common import ID, ROW, hash_bucket, numbered, packed, part_count, unpacked, word_count, words
from quillframe.llm.draws import mirror_points, multinomial, permuted
from quillframe.session import write_out

SEED = 4_177
ROUNDS = 24  # of the index permutation
TASK_DRAWS = 1 << 15  # draws that one task permutes


class Mix(NamedTuple):
    rows: DataFrame  # _id, source, size, crc, _row: the input, numbered
    sources: DataFrame  # one row per source: sid, source, source_size, target, blocks, quota
    spans: DataFrame  # shard, sid, draw, epoch, block, _id, first, n: the words each drawn block takes of each row


def targets(sources: DataFrame, weights: Sequence[int], epochs: int) -> DataFrame:
    """(sid, source, source_size, target) for a table (source, source_size) with one row per source.

    Sources in code-point order, null last, weigh ``weights`` in turn and share the summed size; none gets
    more than ``epochs`` times its own. With the sources ordered by cap over weight, the common
    share per weight is the first one that does not exceed the next source's cap.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.lit(list(weights))
    ranked = sources.withColumn("sid", F.row_number().over(order) - 1)
    ranked = ranked.withColumn("weight", F.get(cycle, F.col("sid") % len(weights)).cast("double"))
    ranked = ranked.withColumn("cap", F.col("source_size").cast("double") * epochs)
    ranked = ranked.withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", "sid")
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(
        F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    heavy = F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    ranked = ranked.withColumns({"share": left / heavy, "place": F.row_number().over(by_ratio)})
    fits = F.when(F.col("share") <= F.col("ratio"), F.struct("place", "share"))
    ranked = ranked.withColumn("level", F.min(fits).over(everything)["share"])
    target = F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return ranked.select("sid", "source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame, weights: Sequence[int] = (1, 2, 3), epochs: int = 3, block_words: int = 64, shard_blocks: int = 8192,
    seed: int = SEED,
) -> Mix:
    """Draw a mix of ``docs`` (doc_id, text, source and any others) by ``targets``.

    The rows of a source, in a hashed order, form one stream of words that is cut into blocks of
    ``block_words`` (the last may be shorter). A source's quota is all its blocks for every whole epoch
    its target holds, and blocks for the rest to the nearest. Every output shard has ``shard_blocks`` blocks;
    how many come from each source is drawn as a multinomial. Where the shards together draw a source
    past its quota, the surplus draws go to the sources that are short, so that totals are exact. The n-th draw
    of a source takes the block that its permutation for epoch ``n // blocks`` gives, and the drawn
    blocks are joined to the rows by (source, block). Hence no row is taken more than ``epochs`` times.

    Null texts and texts without words take part with size 0; a null source is a source. Repeated
    rows each have a place in the stream. An empty table gives an empty mix. The order depends on
    doc_id and text alone, so runs agree.
    """
    rows = numbered(docs.select(
        F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), F.crc32("text").alias("crc"),
        F.xxhash64("doc_id").alias("key"), packed(docs)), "mix-rows")
    by_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    found = targets(by_source, weights, epochs)
    size, target = F.col("source_size"), F.col("target")
    whole = F.floor(target / F.greatest(size, F.lit(1))).cast("long")
    blocks = F.ceil(size / block_words).cast("long")
    rest = F.round((target - whole * size) / block_words).cast("long")
    sources = write_out(found.withColumns({"blocks": blocks, "quota": whole * blocks + rest}), "mix-sources")

    drawn = _draws(sources, shard_blocks, seed)
    drawn = drawn.withColumns({"epoch": F.expr("draw div blocks"), "index": F.col("draw") % F.col("blocks")})
    drawn = drawn.withColumn("block", permuted(F.col("index"), F.col("blocks"), F.col("points"), F.col("epoch")))
    pieces = _pieces(rows, sources, block_words, seed)
    spans = drawn.select("shard", "sid", "draw", "epoch", "block").join(pieces, ["sid", "block"])
    return Mix(rows, sources, spans)


def _draws(sources: DataFrame, shard_blocks: int, seed: int) -> DataFrame:
    """(shard, sid, draw, blocks, points): the draws 0 .. quota - 1 of every source, spread over the shards."""
    total = sources.agg(F.coalesce(F.sum("quota"), F.lit(0)).alias("n")).first()["n"]
    shards = max(1, -(-total // shard_blocks))
    wide = sources.agg(F.array_sort(F.collect_list(F.struct("sid", "quota"))).alias("s"))  # one entry per source
    wide = wide.select(F.col("s.quota").alias("quotas"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    wide = wide.repartition(F.col("shard"))
    places = F.least(F.lit(shard_blocks), F.lit(total) - F.col("shard").cast("long") * shard_blocks).cast("long")
    counts = wide.select("shard", F.posexplode(multinomial(places, F.col("quotas"), seed, F.col("shard"))).alias("sid", "n"))
    before = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    counts = write_out(counts.filter(F.col("n") > 0), "mix-counts")

    drawn = counts.groupBy("sid").agg(F.sum("n").alias("drawn"))
    balance = sources.join(drawn, "sid", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    earlier = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    surplus, short = F.greatest(F.col("drawn") - F.col("quota"), F.lit(0)), F.greatest(F.col("quota") - F.col("drawn"), F.lit(0))
    balance = balance.withColumns({"surplus": surplus, "short": short}).withColumns({
        "freed": F.coalesce(F.sum("surplus").over(earlier), F.lit(0)), "filled": F.coalesce(F.sum("short").over(earlier), F.lit(0))})
    points = mirror_points(F.greatest("blocks", F.lit(1)), ROUNDS, seed, F.col("sid"))
    balance = write_out(balance.select("sid", "blocks", "quota", "drawn", "short", "freed", "filled", points.alias("points")), "mix-balance")

    cells = counts.repartition(total // TASK_DRAWS + 1, "shard", "sid")
    every = cells.select("shard", "sid", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("draw"))
    every = every.join(balance.select("sid", "blocks", "quota", "freed", "points"), "sid")
    free = every.filter(F.col("draw") >= F.col("quota"))
    free = free.select("shard", (F.col("freed") + F.col("draw") - F.col("quota")).alias("place"))
    lacking = balance.filter(F.col("short") > 0).select(
        "sid", "blocks", "points", "drawn", "filled", F.explode(F.sequence(F.lit(0).cast("long"), F.col("short") - 1)).alias("i"))
    lacking = lacking.select(
        "sid", "blocks", "points", (F.col("drawn") + F.col("i")).alias("draw"), (F.col("filled") + F.col("i")).alias("place"))
    moved = free.join(lacking, "place").select("shard", "sid", "draw", "blocks", "points")
    return every.filter(F.col("draw") < F.col("quota")).select("shard", "sid", "draw", "blocks", "points").unionByName(moved)


def _pieces(rows: DataFrame, sources: DataFrame, block_words: int, seed: int) -> DataFrame:
    """(sid, block, _id, first, n): the words of each row that lie in each block of its source's stream."""
    light = rows.filter(F.col("size") > 0).select(ID, "source", "size", "crc", "key")
    light = light.join(sources.select("sid", F.col("source").alias("named")), F.col("source").eqNullSafe(F.col("named")))
    light = light.withColumn("part", hash_bucket(part_count(rows.count()), seed, "key", "crc"))
    counts = light.groupBy("sid", "part").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("sid").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("sid", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("sid", "part").orderBy("key", "crc", "size", ID).rowsBetween(Window.unboundedPreceding, 0)
    placed = light.withColumn("upto", F.sum("size").over(inside)).join(starts, ["sid", "part"])
    placed = placed.withColumn("at", F.col("start") + F.col("upto") - F.col("size"))
    first_block = F.expr(f"at div {block_words}")
    last_block = F.expr(f"(at + size - 1) div {block_words}")
    cut = placed.select("sid", ID, "at", "size", F.explode(F.sequence(first_block, last_block)).alias("block"))
    first = F.greatest(F.col("block") * block_words - F.col("at"), F.lit(0))
    last = F.least((F.col("block") + 1) * block_words - F.col("at"), F.col("size"))
    return cut.select("sid", "block", ID, first.alias("first"), (last - first).alias("n"))


def taken_words(mixed: Mix) -> DataFrame:
    """(_id, taken): words the mix takes of every row, repeats counted."""
    return mixed.spans.groupBy(ID).agg(F.sum("n").alias("taken"))


def mixed_documents(mixed: Mix, text: str = "text") -> DataFrame:
    """The mix as documents: one row for each input row and epoch that takes words of it.

    A row that is taken whole keeps its text; of others the taken words are joined by spaces, in
    their order. The columns are those of the input. A row's spans are bounded by its own length.
    """
    spans = mixed.spans.groupBy(ID, "epoch").agg(
        F.sum("n").alias("taken"), F.array_sort(F.collect_list(F.struct("first", "n"))).alias("spans"))
    rows = mixed.rows.select(ID, "size", ROW).join(spans, ID)
    fields = rows.schema[ROW].dataType.fields
    whole = F.col("taken") == F.col("size")
    return rows.select(*[
        F.when(whole, F.col(f"{ROW}.`{f.name}`")).otherwise(_cut(F.col(f"{ROW}.`{f.name}`"), F.col("spans"))).alias(f.name)
        if f.name == text else F.col(f"{ROW}.`{f.name}`") for f in fields])


def _cut(text: Column, spans: Column) -> Column:
    """The words of the spans; the split text is an array of its own so that it is made once."""
    return F.get(F.transform(F.array(words(text)), lambda w: F.array_join(F.flatten(F.transform(
        spans, lambda s: F.slice(w, (s["first"] + 1).cast("int"), s["n"].cast("int")))), " ")), F.lit(0))


def taken_by_row(mixed: Mix) -> DataFrame:
    """The input's columns with size, source_size, target and taken; input columns of these names give way."""
    rows = mixed.rows.join(taken_words(mixed), ID, "left")
    known = mixed.sources.select(F.col("source").alias("named"), "source_size", "target")
    rows = rows.join(known, F.col("source").eqNullSafe(F.col("named")))
    rows = rows.withColumn("taken", F.coalesce("taken", F.lit(0)))
    return unpacked(rows, "size", "source_size", "target", "taken")
