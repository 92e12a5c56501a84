"""Quoted CSV records from files that Spark splits by lines.

A quoted field may hold line breaks, so whether a line starts a record depends on all quotes before it. Seen as a function, a line
takes "outside" or "inside a quoted field" to one of the two, and so does a whole block. One pass finds the function of every
block; a scan over the blocks of a file, one row each, tells in which state each block begins. The second pass cuts blocks into
records; records that cross blocks are put together from their pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillframe.session import write_out

OUTSIDE, INSIDE = 0, 1


@lru_cache(maxsize=16)
def _patterns(sep: bytes, quote: bytes) -> tuple[re.Pattern, re.Pattern]:
    """What, from the start of a field, ends inside a quoted one; and the rest of a quoted field with what follows up to the next separator."""
    s, q = re.escape(sep), re.escape(quote)
    inner = b"[^%b]*+(?:%b%b[^%b]*+)*+" % (q, q, q, q)
    field = b"(?:%b%b%b[^%b]*+|[^%b%b][^%b]*+|)%b" % (q, inner, q, s, q, s, s, s)
    return re.compile(b"(?:%b)*+%b%b\\Z" % (field, q, inner), re.DOTALL), re.compile(b"%b%b[^%b]*+" % (inner, q, s), re.DOTALL)


def line_function(line: bytes, sep: bytes = b",", quote: bytes = b'"') -> tuple[int, int]:
    """The state after a line that starts outside, and after one that starts inside a quoted field.

    A quote opens a field only at its start; two in a row inside are one; others are plain characters.
    """
    opens, rest = _patterns(sep, quote)
    outside = INSIDE if opens.match(line) else OUTSIDE
    closed = rest.match(line)
    if closed is None:
        return outside, INSIDE
    return outside, INSIDE if closed.end() < len(line) and opens.match(line, closed.end() + 1) else OUTSIDE


def _lines(spark: SparkSession, path, quote: str) -> DataFrame:
    """(file, block, line, quoted, valid): the lines of all files, in the order of their block."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line"),
        F.contains("value", F.lit(quote)).alias("quoted"), F.expr("is_valid_utf8(value)").alias("valid"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """Batches cut where the block changes."""
    for batch in batches:
        files, blocks = batch.column("file"), batch.column("block")
        cuts = [0]
        if batch.num_rows > 1:
            moved = pc.or_(pc.not_equal(files[1:], files[:-1]), pc.not_equal(blocks[1:], blocks[:-1]))
            cuts += [i + 1 for i, m in enumerate(moved.to_pylist()) if m] if pc.any(moved).as_py() else []
        for a, b in zip(cuts, [*cuts[1:], batch.num_rows]):
            if b > a:
                yield files[a].as_py(), blocks[a].as_py(), batch.slice(a, b - a)


def _stripped(line: bytes) -> bytes:
    return line[:-1] if line.endswith(b"\r") else line


def _block_functions(lines: DataFrame, sep: bytes, quote: bytes) -> DataFrame:
    """(file, block, zero, one, valid, header): per block the states after it, whether it is UTF-8, and the first record of a file if it lies there."""
    schema = "file string, block long, zero int, one int, valid boolean, header binary"
    arrow = pa.schema([("file", pa.string()), ("block", pa.int64()), ("zero", pa.int32()), ("one", pa.int32()), ("valid", pa.bool_()), ("header", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, valid, head = None, (OUTSIDE, INSIDE), True, None

        def row():
            header = b"\n".join(head[1]) if head and head[2] else None
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*at, *state, valid, header), arrow.types)], schema=arrow)

        for file, block, part in _runs(batches):
            if at != (file, block):
                if at is not None:
                    yield row()
                at, state, valid, head = (file, block), (OUTSIDE, INSIDE), True, [OUTSIDE, [], False] if block == 0 else None
            valid = valid and pc.min(part.column("valid")).as_py()
            quoted = part.column("quoted")
            if head is not None and not head[2]:
                for line in part.column("line").to_pylist():
                    line = _stripped(line)
                    if line or head[1]:
                        head[1].append(line)
                        head[0] = line_function(line, sep, quote)[head[0]]
                        if head[0] == OUTSIDE:
                            head[2] = True
                            break
            for line in part.column("line").filter(quoted).to_pylist():
                change = line_function(_stripped(line), sep, quote)
                state = change[state[0]], change[state[1]]
        if at is not None:
            yield row()

    return lines.mapInArrow(run, schema)


def _block_states(found: DataFrame) -> DataFrame:
    """(file, block, start, stop, latin): the state in which each block begins and ends, from the functions before it.

    A function either gives a constant, keeps the state or turns it; the last constant and the turns since decide.
    """
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    turned = found.withColumn("turns", F.sum(((F.col("zero") == INSIDE) & (F.col("one") == OUTSIDE)).cast("long")).over(upto))
    fixed = F.when(F.col("zero") == F.col("one"), F.struct(F.col("zero").alias("state"), "turns"))
    last = turned.withColumns({"fixed": F.last(fixed, ignorenulls=True).over(before), "past": F.coalesce(F.lag("turns").over(
        Window.partitionBy("file").orderBy("block")), F.lit(0))})
    start = (F.coalesce(F.col("fixed.state"), F.lit(OUTSIDE)) + F.col("past") - F.coalesce(F.col("fixed.turns"), F.lit(0))) % 2
    latin = F.min("valid").over(Window.partitionBy("file"))
    return last.withColumn("start", start.cast("int")).select(
        "file", "block", "start", F.when(F.col("start") == OUTSIDE, F.col("zero")).otherwise(F.col("one")).alias("stop"), (~latin).alias("latin"))


def _cut(lines: DataFrame, sep: bytes, quote: bytes, crossing: bool) -> DataFrame:
    """The records that lie in their block, or, if ``crossing``, the pieces of the others, the first of a header marked ``heading``."""
    schema = "file string, block long, latin boolean, opens boolean, heading boolean, text binary"
    arrow = pa.schema([("file", pa.string()), ("block", pa.int64()), *[(n, pa.bool_()) for n in ("latin", "opens", "heading")], ("text", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, latin, state, held, opens, header = None, False, OUTSIDE, [], True, False

        def batch(key, flag, rows):
            n = len(rows)
            return pa.RecordBatch.from_arrays([
                pa.array([key[0]] * n, pa.string()), pa.array([key[1]] * n, pa.int64()), pa.array([latin] * n, pa.bool_()),
                pa.array([flag] * n, pa.bool_()), pa.array([flag and header] * n, pa.bool_()), pa.array(rows, pa.binary())], schema=arrow)

        for file, block, part in _runs(batches):
            if at != (file, block):
                if held and crossing:
                    yield batch(at, opens, [b"\n".join(held)])
                at, state, held, latin = (file, block), part.column("start")[0].as_py(), [], part.column("latin")[0].as_py()
                opens, header = state == OUTSIDE, block == 0
            whole = []
            for line, quoted in zip(part.column("line").to_pylist(), part.column("quoted").to_pylist()):
                line = _stripped(line)
                if quoted:
                    state = line_function(line, sep, quote)[state]
                if state == INSIDE:
                    held.append(line)
                elif held or not opens:
                    held.append(line)
                    record = b"\n".join(held)
                    if not opens and crossing:
                        yield batch(at, False, [record])
                    elif opens and not header:
                        whole.append(record)
                    held, opens, header = [], True, False
                elif line and header:
                    header = False
                elif line:
                    whole.append(line)
            if whole and not crossing:
                yield batch(at, True, whole)
        if held and crossing:
            yield batch(at, opens, [b"\n".join(held)])

    return lines.mapInArrow(run, schema)


def records(spark: SparkSession, path, sep: str = ",", quote: str = '"', encoding: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(file, block, text) of every record but the headers, and (file, header), the first record of every file.

    ``text`` is the record as it stands, its lines joined by a line feed. Without an ``encoding``, files that are not
    UTF-8 throughout are read as ISO-8859-1. Blank lines are no records. A carriage return at the end of a line belongs to the
    line break. A quote that is never closed takes the rest of its file into one record.
    """
    s, q = sep.encode(), quote.encode()
    lines = _lines(spark, path, quote)
    functions = write_out(_block_functions(lines, s, q), "csv-blocks")
    states = write_out(_block_states(functions), "csv-states")
    # One row per block that Spark reads at once (128 MB by default), so the table is a millionth of the input.
    joined = lines.join(F.broadcast(states), ["file", "block"])
    inside = _cut(joined, s, q, crossing=False).select("file", "block", "latin", "text")

    pieces = write_out(_cut(joined.filter((F.col("start") == INSIDE) | (F.col("stop") == INSIDE)), s, q, crossing=True), "csv-pieces")
    order = Window.partitionBy("file").orderBy("block", "opens").rowsBetween(Window.unboundedPreceding, 0)  # at most two pieces a block
    chained = pieces.withColumn("chain", F.sum(F.col("opens").cast("long")).over(order))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("block", "opens", F.hex("text").alias("text")))), lambda p: p["text"])
    crossed = chained.groupBy("file", "chain").agg(
        F.min("block").alias("block"), F.first("latin").alias("latin"), F.bool_or("heading").alias("heading"), F.unhex(F.array_join(parts, "0A")).alias("text"))

    def decoded(column: str) -> Column:
        if encoding:
            return F.decode(column, encoding)
        return F.when(F.col("latin"), F.decode(column, "ISO-8859-1")).otherwise(F.col(column).cast("string"))

    heads = functions.filter("block = 0").join(states.filter("block = 0").select("file", "latin"), "file").join(
        crossed.filter("heading").select("file", "text"), "file", "left")
    header = F.regexp_replace(decoded("header"), "^\ufeff", "")
    files = heads.withColumn("header", F.coalesce("header", "text")).select("file", header.alias("header"))
    rows = inside.unionByName(crossed.filter("NOT heading").select("file", "block", "latin", "text"))
    return rows.select("file", "block", decoded("text").alias("text")), files
