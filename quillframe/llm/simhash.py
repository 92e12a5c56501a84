"""SimHash near-duplicates by bit-sliced comparison inside buckets that share bit blocks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from quillframe.llm.common import ID, ROW, numbered, packed, unpacked
from quillframe.session import write_out

BITS = 64
RADIUS = 2
SHINGLE = 3
SEED = 42
TILE = 4096  # fingerprints of a bucket that meet in one task, twice over
PAIR_BLOCK = 1 << 15  # (fingerprint, word of 64 others) pairs counted together
LOOK_EVERY = 8  # planes between two looks for blocks to abandon


# --- fingerprints ---------------------------------------------------------------------


def fingerprint(text: str | None, shingle: int = SHINGLE, repeats: bool = True) -> int:
    """The majority bits of the XXH64 hashes of all runs of ``shingle`` lower-cased words, as a signed integer.

    A text with fewer words hashes all of them as one run; one without words (or null) has 0. Without
    ``repeats`` every different run counts once.
    """
    w = (text or "").encode().lower().split()  # bytes: A-Z only, and white space below 0x21 only
    if not w:
        return 0
    n = min(shingle, len(w))
    spaced = [x + b" " for x in w]
    columns = [spaced[i:len(w) - n + 1 + i] for i in range(n - 1)] + [w[n - 1:]]
    runs = map(b"".join, zip(*columns, strict=True))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(run, SEED) for run in (runs if repeats else set(runs))], dtype="<u8")
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, repeats: bool = True) -> DataFrame:
    """(_row, fp) for every row of ``docs`` (text and any others); ``_row`` holds all columns but the text."""
    rest = docs.drop("text")
    rows = docs.select(packed(rest), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py(), shingle, repeats) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column(ROW), pa.array(found, pa.int64())], [ROW, "fp"])

    return rows.mapInArrow(run, rows.select(ROW).schema.add("fp", LongType()))


# --- links ----------------------------------------------------------------------------


def _bucket_keys(radius: int) -> list[Column]:
    """Keys of which two fingerprints within ``radius`` share at least one.

    Of radius + 2 blocks of bits at most ``radius`` can differ, so two blocks are equal.
    """
    blocks = radius + 2
    edges = [BITS * i // blocks for i in range(blocks + 1)]

    def block(i):
        return F.shiftrightunsigned("fp", edges[i]).bitwiseAND(F.lit((1 << (edges[i + 1] - edges[i])) - 1))

    return [
        F.lit(t).cast("long") * (1 << 56) + block(a) * (1 << (edges[b + 1] - edges[b])) + block(b)
        for t, (a, b) in enumerate(combinations(range(blocks), 2))]


def _far(counter: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose counter (low plane first) exceeds ``radius`` or has overflowed."""
    more, equal = np.zeros_like(over), ~np.zeros_like(over)
    for i in reversed(range(len(counter))):
        if radius >> i & 1:
            equal = equal & counter[i]
        else:
            more |= equal & counter[i]
            equal = equal & ~counter[i]
    return over | more


def close_lanes(planes: np.ndarray, valid: np.ndarray, fps: np.ndarray, q: np.ndarray, w: np.ndarray, radius: int):
    """For each pair (fps[q], word w of 64 fingerprints): the lanes within ``radius``, where there are any.

    ``planes[b, w]`` holds bit ``b`` of the 64 fingerprints of word ``w``. The distances of all lanes are counted
    at once by a carry-save counter, a plane for each binary digit; pairs of which every lane is
    beyond the radius are dropped before the rest of the planes is read.
    """
    counter = [np.zeros(len(q), np.uint64) for _ in range(radius.bit_length())]
    over, one, ask = np.zeros(len(q), np.uint64), np.uint64(1), fps[q]
    for b in range(BITS):
        carry = planes[b][w] ^ (np.uint64(0) - (ask >> np.uint64(b) & one))
        for i, plane in enumerate(counter):
            counter[i], carry = plane ^ carry, plane & carry
        over |= carry
        if b % LOOK_EVERY == LOOK_EVERY - 1:
            near = ~_far(counter, over, radius) & valid[w]
            keep = np.flatnonzero(near)
            if len(keep) < len(q):
                q, w, ask, over, near = q[keep], w[keep], ask[keep], over[keep], near[keep]
                counter = [plane[keep] for plane in counter]
            if not len(q):
                break
    return q, w, near


def forest(groups: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) links that connect what lies within ``radius`` in each group; members are sorted by group."""
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    sizes = np.diff(np.r_[starts, len(groups)])
    paired = np.repeat(sizes > 1, sizes)
    fps, starts, sizes = fps[paired], None, sizes[sizes > 1]
    n = len(fps)
    if not n:
        return fps, fps
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    within = np.arange(n) - np.repeat(starts, sizes)
    words = -(-sizes // 64)
    first_word = np.r_[0, np.cumsum(words)[:-1]]
    word, lane = np.repeat(first_word, sizes) + within // 64, (within % 64).astype(np.uint64)
    opens = np.flatnonzero(lane == 0)  # the first member of every word
    one = np.uint64(1)
    planes = np.stack([np.bitwise_or.reduceat((fps >> np.uint64(b) & one) << lane, opens) for b in range(BITS)])
    valid = np.bitwise_or.reduceat(one << lane, opens)

    root = np.arange(n)
    later = np.repeat(first_word + words, sizes) - word  # words from the member's own to the last of its group
    upto = np.cumsum(later)
    for begin in range(0, n, PAIR_BLOCK // 128 if later.max() > 128 else PAIR_BLOCK):
        end = min(n, begin + (PAIR_BLOCK // 128 if later.max() > 128 else PAIR_BLOCK))
        q = np.repeat(np.arange(begin, end), later[begin:end])
        w = word[q] + np.arange(len(q)) - np.repeat(upto[begin:end] - later[begin:end] - (upto[begin] - later[begin]), later[begin:end])
        q, w, near = close_lanes(planes, valid, fps, q, w, radius)
        own = w == word[q]
        near[own] &= (~np.uint64(0) - one) << lane[q[own]]  # later lanes only
        hit = np.flatnonzero(near)
        bits = np.unpackbits(near[hit].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        pair, at = np.nonzero(bits)
        _unite(root, q[hit][pair], opens[w[hit][pair]] + at)
    linked = np.flatnonzero(root != np.arange(n))
    return fps[linked], fps[root[linked]]


def _unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give the members that the pairs connect their smallest member as root."""
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root[root] != root).any():
            root[:] = root[root]


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links between the distinct fingerprints ``fps`` (fp) that connect all pairs within ``radius``.

    Fingerprints that share a bucket key meet in a task, sorted by bucket. A bucket of more than ``TILE``
    is dealt into parts, and every two parts meet in a task of their own. Each task
    emits a spanning forest, never all pairs.
    """
    keyed = fps.select("fp", F.explode(F.array(*_bucket_keys(radius))).alias("bucket"))
    heavy = keyed.groupBy("bucket").agg(F.count("*").alias("n")).filter(F.col("n") > TILE)
    heavy = write_out(heavy.select("bucket", F.ceil(F.col("n") / TILE).cast("int").alias("parts")), "heavy-buckets")
    dealt = keyed.join(heavy, "bucket", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tile = F.least("part", "other") * F.col("parts") + F.greatest("part", "other")
    tiles = dealt.select("bucket", tile.cast("int").alias("tile"), "fp").repartition("bucket", "tile")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.uint64)]
        for batch in _and_end(batches):
            if batch is not None:
                new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
                held = [np.concatenate([a, b.view(a.dtype)]) for a, b in zip(held, new, strict=True)]
                if len(held[0]) < PAIR_BLOCK:
                    continue
            if not len(held[0]):
                continue
            changes = np.flatnonzero((held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1])) + 1
            ready = len(held[0]) if batch is None else (changes[-1] if len(changes) else 0)
            if not ready:
                continue
            group = np.zeros(ready, np.int64)
            group[changes[changes < ready]] = 1
            a, b = forest(np.cumsum(group), held[2][:ready], radius)
            held = [x[ready:] for x in held]
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return tiles.sortWithinPartitions("bucket", "tile").mapInArrow(run, "a bigint, b bigint").distinct()


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def components(edges: DataFrame) -> DataFrame:
    """(fp, root): the smallest node reachable from every node of ``edges`` (a, b).

    Each round takes the smallest label among the neighbours and then the label of the label, and is
    written out; it ends when a round changes nothing.
    """
    both = write_out(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = write_out(both.groupBy("a").agg(F.min("b").alias("b")).select(
        F.col("a").alias("fp"), F.least("a", "b").alias("root")), "labels")
    while True:
        seen = both.join(labels.select(F.col("fp").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        nearer = labels.join(seen.withColumnRenamed("a", "fp"), "fp").select(
            "fp", F.col("root").alias("old"), F.least("root", "near").alias("next"))
        nearer = write_out(nearer, "nearer-labels")
        far = nearer.select(F.col("fp").alias("next"), F.col("next").alias("far"))
        jumped = nearer.join(far, "next").select("fp", "old", F.least("next", "far").alias("root"))
        labels = write_out(jumped, "labels")
        if labels.filter(F.col("root") != F.col("old")).limit(1).count() == 0:
            return labels.select("fp", "root")


# --- documents ------------------------------------------------------------------------


class Groups(NamedTuple):
    rows: DataFrame  # _row (all columns but the text), fp
    roots: DataFrame  # fp, root: one row per distinct fingerprint


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, repeats: bool = True) -> Groups:
    """Fingerprint ``docs`` (text and any others) and group the fingerprints within ``radius`` of one another.

    Null, empty and blank texts share the fingerprint 0. Equal fingerprints are compared once. An
    empty table gives no groups; repeated rows share a group.
    """
    rows = write_out(fingerprints(docs, shingle, repeats), "fingerprints")
    distinct = rows.select("fp").distinct()
    linked = components(write_out(links(distinct, radius), "links"))
    roots = distinct.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))
    return Groups(rows, write_out(roots, "roots"))


def report(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, fingerprint (hex), component_id (smallest doc_id of the group)."""
    found = near_duplicates(docs.select("doc_id", "text"), radius, shingle)
    rows = found.rows.select(F.col(f"{ROW}.doc_id").alias("doc_id"), "fp")
    firsts = rows.groupBy("fp").agg(F.min("doc_id").alias("first")).join(found.roots, "fp")
    smallest = firsts.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = firsts.join(smallest, "root").select("fp", "component_id")
    return rows.join(by_fp, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(
    docs: DataFrame, key: str = "doc_id", radius: int = RADIUS, shingle: int = SHINGLE, repeats: bool = True
) -> DataFrame:
    """One row of ``docs`` from each group: that with the smallest ``key`` (null last), the first in order on a tie."""
    rows = numbered(docs.select(packed(docs), F.col(key).alias("key"), F.col("text")), "dedup-rows")
    found = near_duplicates(rows.select(ID, "key", "text"), radius, shingle, repeats)
    light = found.rows.select(f"{ROW}.{ID}", f"{ROW}.key", "fp")
    order = F.struct(F.col("key").isNull().alias("null"), F.col("key").alias("key"), F.col(ID).alias("id"))
    firsts = light.groupBy("fp").agg(F.min(order).alias("first")).join(found.roots, "fp")
    kept = firsts.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.id").alias(ID))
    return unpacked(rows.join(kept, ID, "left_semi"))
