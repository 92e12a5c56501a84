"""Building blocks for ordered and exact-statistics operators on tables of any size.

None of them puts a whole table, or a whole key, into one task:

* ``positions``      row numbers of a globally sorted table; ``ordinals`` restarts them per key
* ``prefix_scan``    running sum or maximum over such a table
* ``blocked``        bounded ROWS frames, computed per block with copied edge rows
* ``quantiles``      exact interpolated quantiles, overall or by group
* ``value_counts``   frequencies of many columns in one shuffle
* ``hash_sample``    exact-size repeatable samples
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillframe.functions.columns import as_double, plain
from quillframe.session import write_out

PARTS = 65_535  # the last part of a bin that quantiles divide
# Aggregates compiled into one loop; a larger loop is no longer optimised by the JVM and is
# several times slower.
AGGREGATES_PER_SCAN = 24
LOW_BITS = 33  # monotonically_increasing_id keeps the row number in its low 33 bits


def join_small(big: DataFrame, small: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join with a table that is usually tiny (one row per group).

    It is written first, so that Spark knows its size: below the session's broadcast threshold it is
    broadcast and the big side is not shuffled; above, it is an ordinary join, which Spark splits where a key is hot.
    """
    return big.join(write_out(small, "small"), list(keys))


SIEVE_BITS = 1 << 25  # 4 MB in all


def sieved(df: DataFrame, keys: DataFrame, key: str, flag: str) -> DataFrame:
    """``df`` with ``flag``: false where its ``key`` is surely not among those of ``keys`` (key).

    The bitmaps behind it have ``SIEVE_BITS`` bits, whatever the size of the tables, so they are broadcast. Where keys are many, more
    rows pass for which only a comparison can tell.
    """
    place = F.pmod(F.xxhash64(key), F.lit(SIEVE_BITS)) + 1
    bits = keys.groupBy(F.bitmap_bucket_number(place).alias("_chunk")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("_bits"))
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    met = df.withColumn("_chunk", F.bitmap_bucket_number(place)).join(F.broadcast(write_out(bits, "sieve")), "_chunk", "left")
    return met.withColumn(flag, F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))).drop("_chunk", "_bits")


def suspects(df: DataFrame, keys: Sequence[str], flag: str = "_suspect") -> DataFrame:
    """``df`` with ``flag``: whether another row may have the same ``keys``. False is certain.

    Only 64-bit hashes are shuffled, and equal ones fold before; rows whose hash is single are told apart where they are read.
    """
    hashed = df.withColumn("_h", F.xxhash64(*keys))
    repeated = hashed.groupBy("_h").agg(F.count("*").alias("_c")).filter("_c > 1").select("_h")
    return sieved(hashed, write_out(repeated, "repeated-hashes"), "_h", flag).drop("_h")


# --- global order ---------------------------------------------------------------------


def positions(df: DataFrame, order_by: Sequence, by: Sequence[str] = ()) -> DataFrame:
    """Add ``_pos``, the 0-based row number in the whole table, and ``_part``, the sorted partition.

    ``order_by`` (with ``by``) must identify a row, so that a hot ``by`` key or a hot
    timestamp is spread over many sorted partitions. The sorted rows are written once, which
    pins the numbering; the driver sees one row count per partition.
    """
    keys = [F.col(b) for b in by] + [F.col(o) if isinstance(o, str) else o for o in order_by]
    ranked = write_out(df.orderBy(*keys).withColumn("_mid", F.monotonically_increasing_id()), "positions")
    ranked = ranked.withColumn("_part", F.shiftright("_mid", LOW_BITS).cast("int"))
    starts, total = [], 0
    for row in sorted(ranked.groupBy("_part").count().collect()):
        starts.append((row["_part"], total))
        total += row["count"]
    offsets = df.sparkSession.createDataFrame(starts, "_part int, _start bigint")
    in_part = F.col("_mid").bitwiseAND(F.lit((1 << LOW_BITS) - 1))
    return (
        ranked.join(F.broadcast(offsets), "_part")  # one row per sorted partition
        .withColumn("_pos", F.col("_start") + in_part)
        .drop("_mid", "_start")
    )


def ordinals(placed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Add ``_ord`` (0-based row number within ``by``) and ``_n`` (rows of that key)."""
    whole = Window.partitionBy(*by)
    spans = placed.groupBy("_part", *by).agg(F.min("_pos").alias("_first"), F.count("*").alias("_rows"))
    # One row per key and sorted partition.
    spans = spans.select("_part", *by, F.min("_first").over(whole).alias("_first"), F.sum("_rows").over(whole).alias("_n"))
    return join_small(placed, spans, ["_part", *by]).withColumn("_ord", F.col("_pos") - F.col("_first")).drop("_first")


def prefix_scan(
    placed: DataFrame, value: Column, out: str, by: Sequence[str] = (), how: str = "sum", totals: dict[str, Column] | None = None
) -> DataFrame:
    """Inclusive running ``sum`` or ``max`` of ``value`` in ``_pos`` order, per ``by``.

    Each sorted partition is scanned on its own; what earlier partitions add is carried in
    through a table with one row per (key, partition). ``totals`` attaches sums per key.
    """
    fold = {"sum": F.sum, "max": F.max}[how]
    totals = totals or {}
    whole = Window.partitionBy(*by)
    placed = placed.withColumn("_v", value)
    here = Window.partitionBy("_part", *by).orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    parts = placed.groupBy("_part", *by).agg(fold("_v").alias("_total"), *[F.sum(c).alias(n) for n, c in totals.items()])
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = parts.select(
        "_part", *by, fold("_total").over(before).alias("_carry"), *[F.sum(n).over(whole).alias(n) for n in totals])
    local = join_small(placed.withColumn("_run", fold("_v").over(here)), carry, ["_part", *by])
    if how == "sum":
        total = F.coalesce("_run", F.lit(0)) + F.coalesce("_carry", F.lit(0))
    else:
        total = F.greatest("_run", "_carry")
    return local.withColumn(out, total).drop("_v", "_run", "_carry")


def blocked(
    placed: DataFrame,
    columns,
    before: int,
    after: int = 0,
    by: Sequence[str] = (),
    block: int = 4096,
    position: str = "_ord",
) -> DataFrame:
    """Add window columns whose frames reach ``before`` rows back and ``after`` rows ahead.

    ``columns(window)`` returns ``{name: Column}``; ``window`` is partitioned into blocks of
    ``block`` rows that also hold copies of the neighbouring rows the frames need.
    """
    pos = F.col(position)
    first = F.greatest(F.floor((pos - after) / block), F.lit(0))
    last = F.floor((pos + before) / block)
    copies = placed.withColumn("_block", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    window = Window.partitionBy(*by, "_block").orderBy(position)
    out = copies
    for name, column in columns(window).items():
        out = out.withColumn(name, column)
    return out.filter(F.floor(pos / block) == F.col("_block")).drop("_block")


# --- statistics -----------------------------------------------------------------------


def rows_per_column(one_row: DataFrame, specs: Sequence[dict[str, Column]]) -> DataFrame:
    """Turn the single row of a wide aggregation into one row per spec (at least one)."""
    structs = [F.struct(*[c.alias(n) for n, c in spec.items()]) for spec in specs]
    return one_row.select(F.inline(F.array(*structs)))


def column_rows(df: DataFrame, columns: Sequence[str], fields) -> DataFrame:
    """(column, fields...) with one row per column; ``fields(name, values)`` gives its aggregates.

    Columns share a scan up to ``AGGREGATES_PER_SCAN`` aggregates. Every column is read once. Without
    columns the table is empty.
    """
    if not columns:
        none = {n: agg.alias(n) for n, agg in fields("", F.lit(None).cast("double")).items()}
        return df.limit(0).agg(*none.values()).select(F.lit("").alias("column"), *none).filter(F.lit(False))
    parts, aggregates, specs = [], [], []

    def close():
        parts.append(rows_per_column(df.agg(*aggregates), specs))

    for i, c in enumerate(columns):
        found = fields(c, as_double(df, c))
        if aggregates and len(aggregates) + len(found) > AGGREGATES_PER_SCAN:
            close()
            aggregates, specs = [], []
        aggregates += [agg.alias(f"{n}_{i}") for n, agg in found.items()]
        specs.append({"column": F.lit(c), **{n: F.col(f"{n}_{i}") for n in found}})
    close()
    return reduce(DataFrame.unionByName, parts)


def stats_row(df: DataFrame, aggregates: dict[str, Column]) -> dict:
    """Run the aggregates over the table in one job and return them as one row."""
    if not aggregates:
        return {}
    named = [a.alias(n) for n, a in aggregates.items()]
    parts = [df.agg(*named[i:i + AGGREGATES_PER_SCAN]) for i in range(0, len(named), AGGREGATES_PER_SCAN)]
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), parts).first().asDict()  # one row each


def long_form(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., column, value double) without nulls, in one pass; empty without columns."""
    if not columns:
        return df.limit(0).select(*keep, F.lit("").alias("column"), F.lit(None).cast("double").alias("value"))
    cells = F.array(*[F.struct(F.lit(c).alias("column"), as_double(df, c).alias("value")) for c in columns])
    return (
        df.select(*keep, F.explode(cells).alias("_cell"))
        .select(*keep, "_cell.column", "_cell.value")
        .filter(F.col("value").isNotNull())
    )


def _lerp(low: Column, high: Column, weight: Column) -> Column:
    return F.when((low == high) | (weight == 0), low).otherwise(low + (high - low) * weight)


def quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact linear-interpolated quantiles: (by..., column, n, q array).

    Radix selection: values fold to counts of bins that keep their order, and only the bins that hold a wanted rank are
    divided further, at most three times; a bin of one value is done at once. No value is sorted or kept, only bins are, of which
    there is a bounded number per column, group and quantile.
    """
    if not by:
        return _column_quantiles(df, columns, probabilities)
    found = _grouped_ranks(df, columns, probabilities, by)

    def value(rank: Column) -> Column:  # the value that holds this 0-based rank
        return F.max(F.when((F.col("_base") <= rank) & (rank < F.col("_base") + F.col("_count")), F.col("_value")))

    ranks = [F.lit(float(p)) * (F.col("_n") - 1) for p in probabilities]
    ends = [end.alias(f"_{name}{i}") for i, r in enumerate(ranks) for name, end in (("low", value(F.floor(r))), ("high", value(F.ceil(r))))]
    parts = [_lerp(F.col(f"_low{i}"), F.col(f"_high{i}"), r - F.floor(r)) for i, r in enumerate(ranks)]
    names = F.array(*[F.lit(c) for c in columns]).cast("array<string>")
    return found.groupBy(*by, "_c", "_n").agg(*ends).select(
        *by, F.get(names, F.col("_c")).alias("column"), F.col("_n").alias("n"), F.array(*parts).cast("array<double>").alias("q"))


def _keys_of(x: np.ndarray) -> np.ndarray:
    """64-bit keys in the order of the values; one for both zeros."""
    bits = (x + 0.0).view(np.uint64)
    negative = bits >> np.uint64(63) == 1
    return np.where(negative, ~bits, bits | np.uint64(1 << 63))


def _value_of(key: int) -> float:
    bits = key & ((1 << 63) - 1) if key >> 63 else ~key & ((1 << 64) - 1)
    return float(np.array([bits], np.uint64).view(np.float64)[0])


def _signed(keys: np.ndarray) -> np.ndarray:
    return (keys ^ np.uint64(1 << 63)).view(np.int64)


def _column_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """Quantiles of whole columns, by 16 bits of the values' keys at a time.

    Tasks count the bins of their batches; the bins to divide, two per column and quantile at most, go to the tasks with the job.
    """
    spark = df.sparkSession
    sizes: dict[int, int] = {}
    done, wanted = [], None
    for level in range(4 if columns else 0):
        open_columns = [i for i in range(len(columns)) if wanted is None or any(c == i for c, _ in wanted)]
        wide = df.select(*[as_double(df, columns[i]).alias(f"x{i}") for i in open_columns])
        counts = _bin_counts(wide, open_columns, level, wanted).withColumn("_bin", F.shiftright("_key", 48 - 16 * level))
        if wanted is not None:
            c, prefix = zip(*wanted)
            n, base = zip(*wanted.values())
            types = {"_c": pa.int32(), "_above": pa.int64(), "_n": pa.int64(), "_base": pa.int64()}
            above = spark.createDataFrame(pa.table([pa.array(v, t) for v, t in zip((c, prefix, n, base), types.values())], names=list(types)))
            counts = counts.withColumn("_above", F.shiftright("_key", 64 - 16 * level)).join(F.broadcast(above), ["_c", "_above"])
        hits = _hit(counts, ["_c"], ["_bin"] if wanted is None else ["_above", "_bin"], probabilities).collect()  # a bounded number
        sizes |= {r["_c"]: r["_n"] for r in hits}
        done += [(r["_c"], r["_base"], r["_base"] + r["_count"], _value_of(r["_lo"] + (1 << 63))) for r in hits if r["_lo"] == r["_hi"]]
        wanted = {(r["_c"], r["_bin"]): (r["_n"], r["_base"]) for r in hits if r["_lo"] < r["_hi"]}
        if not wanted:
            break

    def at(c: int, rank: int) -> float:
        return next(v for i, first, end, v in done if i == c and first <= rank < end)

    def between(c: int, p: float) -> float:
        rank = float(p) * (sizes[c] - 1)
        low, high, weight = at(c, math.floor(rank)), at(c, math.ceil(rank)), rank - math.floor(rank)
        return low if low == high or weight == 0 else low + (high - low) * weight

    known = sorted(sizes)
    found = [[columns[c] for c in known], [sizes[c] for c in known], [[between(c, p) for p in probabilities] for c in known]]
    return spark.createDataFrame(pa.table(
        [pa.array(v, t) for v, t in zip(found, (pa.string(), pa.int64(), pa.list_(pa.float64())))], names=["column", "n", "q"]))


def _bin_counts(wide: DataFrame, places: Sequence[int], level: int, wanted: dict | None) -> DataFrame:
    """(_c, _key, _count, _lo, _hi): per bin of 16 (level + 1) bits its smallest key, its values, and the first and last key seen."""
    shift, size = np.uint64(48 - 16 * level), len(places)
    prefixes = [np.array([p for c, p in wanted or () if c == i], np.int64) for i in places]

    def starts(digits: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.r_[True, digits[1:] != digits[:-1]])

    def binned(keys: np.ndarray):
        keys = np.sort(keys)
        first = starts(keys >> shift)
        ends = np.r_[first[1:], len(keys)]
        return keys[first] >> shift << shift, ends - first, keys[first], keys[ends - 1]

    def bins(keys: np.ndarray, counts: np.ndarray, lows: np.ndarray, highs: np.ndarray):
        order = np.argsort(keys, kind="stable")
        keys, counts, lows, highs = keys[order], counts[order], lows[order], highs[order]
        first = starts(keys)
        return keys[first], np.add.reduceat(counts, first), np.minimum.reduceat(lows, first), np.maximum.reduceat(highs, first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[] for _ in range(size)]
        for batch in batches:
            for i, column in enumerate(batch.columns):
                x = column.to_numpy(zero_copy_only=False)
                keys = _keys_of(x[~np.isnan(x)])
                if wanted is not None:
                    at = _signed(keys) >> np.int64(64 - 16 * level)
                    keys = keys[np.logical_or.reduce([at == p for p in prefixes[i]])]
                if len(keys):
                    held[i].append(binned(keys))
                if len(held[i]) >= 64:
                    held[i] = [bins(*map(np.concatenate, zip(*held[i])))]
        for i, parts in enumerate(held):
            if parts:
                keys, counts, lows, highs = bins(*map(np.concatenate, zip(*parts)))
                for a in range(0, len(keys), 1 << 16):
                    part = slice(a, a + (1 << 16))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(keys[part]), places[i], np.int32)), pa.array(_signed(keys[part])), pa.array(counts[part]),
                         pa.array(_signed(lows[part])), pa.array(_signed(highs[part]))], names=["_c", "_key", "_count", "_lo", "_hi"])

    found = wide.mapInArrow(run, "_c int, _key long, _count long, _lo long, _hi long")
    return found.groupBy("_c", "_key").agg(F.sum("_count").alias("_count"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))


def _grouped_ranks(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], by: Sequence[str]) -> DataFrame:
    """The bins of one value that hold the wanted ranks of each group.

    Bins are sixteenths of a power of two at first, then 65,536 equal parts of what the bin above holds, and in the end single values.
    """
    keys = [*by, "_c"]
    cells = _cells(df, columns, by).withColumn("_b1", _magnitude(F.col("_x")))
    held, wanted, found = [], None, []
    for level in range(1, 5):
        bins = [f"_b{i}" for i in range(1, level + 1)]
        if level > 1:
            cells = _join_same(cells, wanted, [*keys, *bins[:-1]])
            inside = F.col("_x") if level == 4 else F.floor((F.col("_x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * PARTS)
            cells = cells.withColumn(bins[-1], inside).drop("_lo", "_hi")
            held = ["_n", "_base"]
        counts = cells.groupBy(*keys, *bins, *held).agg(F.count("*").alias("_count"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
        hits = write_out(_hit(counts, keys, bins, probabilities), "ranks")
        found.append(hits.filter("_lo = _hi").select(*keys, "_n", "_base", "_count", F.col("_lo").alias("_value")))
        wanted = hits.filter("_lo < _hi").drop("_count")
        if level == 4 or wanted.isEmpty():
            break
        cells = cells.drop(*held)
    return reduce(DataFrame.unionByName, found)


def _cells(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """(by..., _c, _x): the known values with their column's place, negative zero as zero."""
    structs = [F.struct(F.lit(i).alias("_c"), (as_double(df, c) + 0.0).alias("_x")) for i, c in enumerate(columns)]
    if len(structs) == 1:
        cells = df.select(*by, structs[0].alias("_cell"))
    else:
        array = F.array(*structs).cast("array<struct<_c:int,_x:double>>")
        cells = df.select(*by, F.explode(array).alias("_cell"))
    return cells.select(*by, "_cell.*").filter(F.col("_x").isNotNull())


def _magnitude(x: Column) -> Column:
    """A bin number that grows with ``x``: sign, and sixteenths of its power of two."""
    size = F.abs(x)
    bin_ = F.when(size == 0, 0).when(size == float("inf"), 40_000).otherwise(F.floor(F.log2(size) * 16).cast("int") + 20_000)
    return F.when(x < 0, -bin_).otherwise(bin_)


def _join_same(rows: DataFrame, small: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join in which null keys are equal; the columns of ``keys`` come once."""
    renamed = small.select(*[F.col(k).alias(f"_of{k}") if k in keys else F.col(k) for k in small.columns])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of{k}")) for k in keys])
    return rows.join(renamed, same).drop(*[f"_of{k}" for k in keys])


def _hit(counts: DataFrame, keys: Sequence[str], bins: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """The bins that hold a wanted rank, with the rows below them and, at the first level, the rows of the column."""
    above = [*keys, *bins[:-1]]
    upto = F.sum("_count").over(Window.partitionBy(*above).orderBy(bins[-1]).rowsBetween(Window.unboundedPreceding, 0))
    if len(bins) == 1:
        counts = counts.withColumns({"_n": F.sum("_count").over(Window.partitionBy(*above)), "_base": F.lit(0).cast("long")})
    placed = counts.withColumn("_base", F.col("_base") + upto - F.col("_count"))
    ends = [end(F.lit(float(p)) * (F.col("_n") - 1)) for p in probabilities for end in (F.floor, F.ceil)]
    inside = [(F.col("_base") <= r) & (r < F.col("_base") + F.col("_count")) for r in ends]
    return placed.filter(reduce(lambda a, b: a | b, inside))


def quantile_map(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], **options) -> dict[str, list]:
    """Quantiles of a few columns as ``{column: [values]}`` (one small row per column)."""
    if not columns:
        return {}
    return {r["column"]: r["q"] for r in quantiles(df, columns, probabilities, **options).collect()}


def value_counts(df: DataFrame, columns: Sequence[str], values: dict[str, Column] | None = None) -> DataFrame:
    """(column, value, n) for non-null values; equal values collapse before the shuffle."""
    values = values or {}
    if not columns:
        return df.limit(0).select(F.lit("").alias("column"), F.lit("").alias("value"), F.lit(0).cast("bigint").alias("n"))
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), values.get(c, plain(df, c)).cast("string").alias("value")) for c in columns
    ])
    return (
        df.select(F.explode(cells).alias("_cell"))
        .select("_cell.column", "_cell.value")
        .filter(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count("*").alias("n"))
    )


def top_per(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key; Spark keeps only ``k`` rows per key in every map task."""
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


# --- sampling -------------------------------------------------------------------------


def row_hash(columns: Sequence[str], seed: int) -> Column:
    """A repeatable hash of the given columns, as 32 hex digits."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


def hash_fraction(digest: Column) -> Column:
    """Map a digest to [0, 1) in digest order."""
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(16**12)


def hash_sample(df: DataFrame, n: int, key: Sequence[str] | None = None, seed: int = 42, total: int | None = None) -> DataFrame:
    """Exactly ``min(n, rows)`` rows: those with the smallest hashes of ``key``.

    On a large table all rows whose hash is far beyond the n-th smallest are dropped first.
    The candidates that remain are counted, and the filter is left out if they are too few.
    """
    key = list(key or df.columns)
    total = df.count() if total is None else total
    if total <= n:
        return df
    hashed = df.withColumn("_h", row_hash(key, seed))
    if total > 20 * n:
        near = hashed.filter(hash_fraction(F.col("_h")) < (n + 10 * n**0.5 + 100) / total)
        if near.count() >= n:
            hashed = near
    order = [F.col("_h"), *[F.col(k) for k in key]]
    if n <= 100_000:
        return hashed.orderBy(*order).limit(n).drop("_h")
    return positions(hashed, order).filter(F.col("_pos") < n).drop("_h", "_part", "_pos")
