"""Column helpers and row identities shared by the corpus operators."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillframe.operators import blocks
from quillframe.session import write_out

BLANKS = r"[\x20\x09-\x0D]+"
ITEM_BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ROW, ID = "_row", "_id"  # a whole input row as a struct, and its number


def words(text: Column, breaks: str = BLANKS) -> Column:
    """The words of a text, in order; none for null."""
    return F.coalesce(F.array_remove(F.split(text, breaks), ""), F.array().cast("array<string>"))


def word_count(text: Column, breaks: str = BLANKS) -> Column:
    return F.size(words(text, breaks)).cast("long")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` does that on plain ASCII and is faster than ``translate``."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, for use inside lambda functions."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def uniform(*parts: Column | str | int) -> Column:
    """A repeatable number in [0, 1) from 53 bits of a hash."""
    cols = [F.lit(p) if isinstance(p, int) else F.col(p) if isinstance(p, str) else p for p in parts]
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / float(1 << 53)


def hash_bucket(n: int, *parts: Column | str | int) -> Column:
    cols = [F.lit(p) if isinstance(p, int) else F.col(p) if isinstance(p, str) else p for p in parts]
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("long")


def part_count(rows: int) -> int:
    """A power of two near twice the square root of ``rows``: both the number of parts and the
    rows of a part then grow with the square root of the table."""
    return 1 << max(0, math.ceil(math.log2(2 * math.sqrt(max(rows, 1)))))


def packed(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct, so that none can clash with a column added beside it."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(ROW)


def kept_splits(df: DataFrame, label: str) -> DataFrame:
    """``df``, so that every evaluation has the same rows in the same partitions: written first if it does more than read, filter and project."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    fixed = all(re.match(r"[\s:+-]*(Project|Filter|Relation|LocalRelation|Range|LogicalRDD|Union)\b", x) for x in plan.splitlines() if x.strip())
    return df if fixed else write_out(df, label)


def sieved(df: DataFrame, ids: DataFrame, flag: str) -> DataFrame:
    """``df`` with ``flag``: false where ``_id`` is surely not in ``ids`` (_id)."""
    return blocks.sieved(df, ids, ID, flag)


def numbered(df: DataFrame, label: str) -> DataFrame:
    """``df`` with the row number ``_id``, written once: the numbers stay even if executors are lost."""
    return write_out(df.withColumn(ID, F.monotonically_increasing_id()), label)


def unpacked(df: DataFrame, *added: str) -> DataFrame:
    """Undo ``packed`` and keep the ``added`` columns; an input column of the same name gives way."""
    names = [f.name for f in df.schema[ROW].dataType.fields]
    taken = {a.lower() for a in added}
    return df.select(*[F.col(f"{ROW}.`{n}`") for n in names if n.lower() not in taken], *added)


def hash_sampled(df: DataFrame, by: str, n: int, key: str = "doc_id", slack: float = 10.0) -> DataFrame:
    """Up to ``n`` rows of each value of ``by``: those with the smallest hashes of ``key``; a column ``rank`` orders them.

    Rows whose hash is far beyond the n-th smallest, as the count of the value tells, are dropped where they are
    read, so that the few that are ranked do not grow with the table.
    """
    counts = write_out(df.groupBy(by).agg(F.count("*").alias("_n")), "sample-counts")
    share = (n + slack * math.sqrt(n) + slack) / F.col("_n")
    near = df.join(counts, by).filter(uniform(0, key) < share).drop("_n")
    order = Window.partitionBy(by).orderBy(uniform(0, key), key)
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
