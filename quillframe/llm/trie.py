"""The prefix trie of conversations, by union-find over the common prefixes of sorted neighbours.

A conversation is cut into blocks of 64 turns. A block belongs to the node at which it starts, named by a hash of all
turns before, so the blocks of one name form a trie of bounded depth and conversations of any length split over many rows.
Blocks are sorted by name and turns, numbered, and cut into chunks of equal size. In a chunk, neighbours are joined in
descending order of their common prefix: every join of two components is a branching node. Nodes that reach
beyond their chunk are contracted to one row per chunk and added up by prefix.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quillframe.llm.common import word_count
from quillframe.operators.blocks import ordinals, positions
from quillframe.session import write_out

BLOCK = 64  # turns of a block; one more is kept to tell the children of its last node
CHUNK = 2048  # blocks of a chunk
SPAN = 1024  # blocks summed in one task
KEY = 16  # bytes of a turn's key
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, at, key, words): the turns of each conversation, numbered from 0.

    Turns (conv_id, turn, role, text) go by turn, null first, ties by the MD5 of role and text, which is also the key. Null
    roles and texts read as empty; texts are read whole. Rows without a conv_id belong to no conversation and are left out.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    rows = turns.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), key.alias("key"), word_count(text).alias("words"))
    placed = positions(rows, [F.col("turn").asc_nulls_first(), "key"], by=["conv_id"])
    return ordinals(placed, ["conv_id"]).select("conv_id", F.col("_ord").alias("at"), "key", "words")


def _sums_before(blocks: DataFrame, values: list[str], backwards: bool = False) -> DataFrame:
    """Each of ``values`` summed over the earlier (or later) blocks of the conversation, as before_<value>."""
    rows = blocks.withColumn("span", F.floor(F.col("block") / SPAN))
    at, span = (F.desc("block"), F.desc("span")) if backwards else (F.asc("block"), F.asc("span"))
    inside = Window.partitionBy("conv_id", "span").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    spans = Window.partitionBy("conv_id").orderBy(span).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("conv_id", "span").agg(*[F.sum(v).alias(f"_{v}") for v in values])
    totals = totals.select("conv_id", "span", *[F.sum(f"_{v}").over(spans).alias(f"_{v}") for v in values])
    here = rows.select("*", *[F.sum(v).over(inside).alias(f"before_{v}") for v in values]).join(totals, ["conv_id", "span"])
    zero = F.lit(0)
    return here.select(*blocks.columns, *[
        (F.coalesce(f"before_{v}", zero) + F.coalesce(f"_{v}", zero)).alias(f"before_{v}") for v in values])


def blocks(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """(conv_id, block, root, keys, words): the blocks of all conversations, with the name of the node at which each starts.

    The first block exists even without turns, and one more, empty, after a last block that is full: it is what tells
    that the conversation is a member of the node there.
    """
    block, first = F.floor(F.col("at") / BLOCK), F.col("at") % BLOCK == 0
    rows = turns.withColumn("block", F.explode(F.when(first & (F.col("at") > 0), F.array(block - 1, block)).otherwise(F.array(block))))
    folded = rows.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(F.struct("at", "key", "words"))).alias("t"))
    full = folded.select(
        "conv_id", "block", F.unhex(F.array_join(F.transform("t", lambda t: t["key"]), "")).alias("keys"),
        F.slice(F.transform("t", lambda t: t["words"]), 1, BLOCK).alias("words"))
    lengths = ids.select(F.col("conv_id").cast("long").alias("conv_id")).filter(F.col("conv_id").isNotNull()).distinct().join(
        turns.groupBy("conv_id").agg(F.count("*").alias("n")), "conv_id", "left")
    empty = lengths.filter(F.coalesce("n", F.lit(0)) % BLOCK == 0).select(
        "conv_id", F.floor(F.coalesce("n", F.lit(0)) / BLOCK).alias("block"), F.lit(b"").alias("keys"), F.array().cast("array<bigint>").alias("words"))
    every = write_out(full.unionByName(empty), "trie-blocks")
    several = (F.col("block") > 0) | (F.octet_length("keys") >= BLOCK * KEY)
    digest = F.md5(F.concat(F.col("block").cast("string").cast("binary"), F.lit(b":"), F.substring("keys", 1, BLOCK * KEY)))
    halves = [F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)").alias(f"h{i}") for i in range(2)]
    long = _sums_before(every.filter(several).select("*", *halves), ["h0", "h1"])
    root = F.when(F.col("block") > 0, F.concat_ws(":", "block", F.col("before_h0").cast("string"), F.col("before_h1").cast("string")))
    return long.select("conv_id", "block", F.coalesce(root, F.lit("")).alias("root"), "keys", "words").unionByName(
        every.filter(~several).select("conv_id", "block", F.lit("").alias("root"), "keys", "words"))


# --- chunks ---------------------------------------------------------------------------


def _in_chunks(placed: DataFrame) -> DataFrame:
    """Rows with their chunk; the rows beside a chunk are copied into it, with ``side`` -1 or 1."""
    at, chunk = F.col("_pos") % CHUNK, F.floor(F.col("_pos") / CHUNK)

    def copy(into: Column, side: int, when: Column) -> Column:
        return F.when(when, F.struct(into.alias("chunk"), F.lit(side).alias("side")))

    copies = F.array(copy(chunk, 0, F.lit(True)), copy(chunk + 1, -1, at == CHUNK - 1), copy(chunk - 1, 1, (at == 0) & (chunk > 0)))
    return placed.select("*", F.inline(F.filter(copies, lambda c: c.isNotNull())))


def common_prefix(a: tuple[str, bytes], b: tuple[str, bytes]) -> int:
    """Turns that two blocks have in common at their start; -1 if they start at different nodes."""
    if a[0] != b[0]:
        return -1
    low, high = 0, min(len(a[1]), len(b[1])) // KEY
    while low < high:
        mid = (low + high + 1) // 2
        if a[1][:mid * KEY] == b[1][:mid * KEY]:
            low = mid
        else:
            high = mid - 1
    return low


class Chunk:
    """The rows of a chunk in order: their columns, and the common prefix of each with the rows beside it."""

    def __init__(self, table: pa.Table):
        rows = sorted(table.to_pylist(), key=lambda r: r["_pos"])
        near = [(r["root"], r["keys"]) for r in rows]
        edges = [common_prefix(a, b) for a, b in zip(near, near[1:])]
        own = [i for i, r in enumerate(rows) if r["side"] == 0]
        self.rows = [rows[i] for i in own]
        self.up = [edges[i - 1] if i else -1 for i in own]
        self.down = [*self.up[1:], edges[own[-1]] if own and own[-1] < len(edges) else -1]
        self.size = [len(r["keys"]) // KEY for r in self.rows]
        self.ends = [s <= BLOCK and (s > 0 or r["block"] == 0) for s, r in zip(self.size, self.rows)]
        self.sums = [np.cumsum([0, *r["words"]]) for r in self.rows]
        self.fresh = [int(s[-1] - s[min(max(u, 0), len(s) - 1)]) for s, u in zip(self.sums, self.up)]  # words of nodes found here first
        self.leaf = [int(e and d < s) for e, d, s in zip(self.ends, self.down, self.size)]


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = zip(*rows) if rows else [()] * len(schema.names)
    return pa.table([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def _firsts(table: pa.Table, schema: pa.Schema) -> pa.Table:
    """What each block adds to the trie: words of nodes that no row before it has, leaves, and all its words."""
    chunk = Chunk(table)
    found = [(r["conv_id"], r["block"], f, leaf, int(s[-1])) for r, f, leaf, s in zip(chunk.rows, chunk.fresh, chunk.leaf, chunk.sums)]
    return _table(found, schema)


def forest(up: list[int], size: list[int], convs: list[int]) -> list[dict]:
    """The branching nodes and leaves over neighbouring rows, by union-find over edges in descending depth.

    ``up`` holds each row's common prefix with the one before. A node has its depth, its first and last row, the smallest conversation,
    the children that start in these rows, and its parent's place in the list (None at the top).
    """
    nodes = [{"depth": s, "a": i, "b": i, "least": c, "children": 0, "parent": None, "gone": False} for i, (s, c) in enumerate(zip(size, convs))]
    above = list(range(len(up)))  # union-find over rows; the top of a set is its first row
    top = list(range(len(up)))  # by first row: the node over the whole set

    def find(i):
        while above[i] != i:
            above[i] = i = above[above[i]]
        return i

    for i in sorted(range(1, len(up)), key=lambda i: (-up[i], i)):
        depth = up[i]
        if depth < 0:
            break
        left, right = find(i - 1), find(i)
        x, y = nodes[top[left]], nodes[top[right]]
        if x["depth"] > depth:
            x["parent"] = len(nodes)
            top[left] = len(nodes)
            x = {**x, "depth": depth, "children": int(up[left] <= depth), "parent": None}
            nodes.append(x)
        if y["depth"] > depth:
            y["parent"] = top[left]
            x["children"] += 1
        else:
            y["gone"] = True  # a row equal to the one before it
        x["b"], x["least"] = y["b"], min(x["least"], y["least"])
        above[right] = left
    return nodes


def _name(root: str, keys: bytes, depth: int) -> str:
    return hashlib.md5(f"{root}|{depth}|".encode() + keys[:depth * KEY]).hexdigest()


def _nodes(table: pa.Table, schema: pa.Schema) -> pa.Table:
    """All nodes of a chunk. Those that reach beyond it have a name and hold what this chunk adds."""
    chunk = Chunk(table)
    rows, up, n = chunk.rows, chunk.up, len(chunk.rows)
    found = forest(up, chunk.size, [r["conv_id"] for r in rows])
    words = np.cumsum([0, *[int(s[-1]) + r["later_words"] for s, r in zip(chunk.sums, rows)]])
    fresh = np.cumsum([0, *[f + r["later_fresh"] for f, r in zip(chunk.fresh, rows)]])
    leaves = np.cumsum([0, *[leaf + r["later_leaf"] for leaf, r in zip(chunk.leaf, rows)]])

    def open_at(node, k):
        return (node["a"] == 0 and k <= up[0]) or (node["b"] == n - 1 and k <= chunk.down[-1])

    def described():
        for node in found:
            if node["gone"]:
                continue
            a, b, parent = node["a"], node["b"], node["parent"]
            row, sums = rows[a], chunk.sums[a]
            low = 0 if parent is None else found[parent]["depth"] + 1
            for k in range(low, min(node["depth"], BLOCK) + 1):
                over = node if k > low else None if parent is None else found[parent]
                name = _name(row["root"], row["keys"], k) if open_at(node, k) else None
                over_name = _name(row["root"], row["keys"], k - 1) if over and open_at(over, k - 1) else None
                if not k and row["block"] and name is None:
                    continue  # the last node of the blocks before
                passed = int(sums[max(k - 1, 0)])
                known = int(sums[min(max(up[a], 0), len(sums) - 1)])
                spent = int(words[b + 1] - words[a]) - (b + 1 - a) * passed
                first = int(fresh[b + 1] - fresh[a]) - max(0, passed - known)
                ids = []
                if k == node["depth"]:
                    i = a
                    while i <= b and chunk.size[i] == k:
                        ids += [str(rows[i]["conv_id"])] if chunk.ends[i] else []
                        i += 1
                    children = node["children"]
                else:
                    children = int(up[a] <= k)
                ended = ",".join(ids)
                yield (node["least"], row["block"] * BLOCK + k, over["least"] if over and over_name is None else None, b + 1 - a, children,
                       int(leaves[b + 1] - leaves[a]), spent - first, ended if name else hashlib.sha256(ended.encode()).hexdigest(),
                       name, over_name, bool(k or not row["block"]), row["chunk"])

    return _table(list(described()), schema)


def _by_chunk(placed: DataFrame, work, columns: str) -> DataFrame:
    schema = T._parse_datatype_string(columns)
    arrow = to_arrow_schema(schema)
    return _in_chunks(placed).groupBy("chunk").applyInArrow(lambda table: work(table, arrow), schema)


def _digests(pieces: DataFrame) -> DataFrame:
    """(name, ends_sha256): the SHA-256 of each name's ids, whose pieces come in the order of their chunks, one at a time."""
    schema = T._parse_datatype_string("name string, ends_sha256 string")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, sha, done = None, None, []
        for batch in batches:
            for here, ids in zip(batch.column("name").to_pylist(), batch.column("ends").to_pylist()):
                if here != name:
                    if name is not None:
                        done.append((name, sha.hexdigest()))
                    name, sha = here, hashlib.sha256(ids.encode())
                else:
                    sha.update(("," + ids).encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done)], schema=arrow)
                done = []
        if name is not None:
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([sha.hexdigest()])], schema=arrow)

    return pieces.repartition("name").sortWithinPartitions("name", "chunk").select("name", "ends").mapInArrow(run, schema)


def nodes(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """One row per node of the trie of all conversations: every distinct sequence of their first turns, the root included.

    ``turns`` is as ``sequences`` returns it; ``ids`` (conv_id) also names conversations without turns, members of the root only.
    conv_id is the smallest member, parent_conv_id the parent's (null at the root), n_convs counts members, n_children children,
    n_leaves the childless nodes in the subtree; saved_tokens sums over it (members - 1) times the words of a node's last turn;
    ends_sha256 is the digest of the ids of conversations that end at the node, ascending and comma-joined.
    Equal conversations share all their nodes. Without conversations there are no nodes.
    """
    order = ["keys", "conv_id"]
    placed = positions(blocks(turns, ids), order, by=["root"])
    later = F.col("block") > 0
    heads = placed.filter(~later & (F.octet_length("keys") >= BLOCK * KEY)).select(
        "conv_id", "block", *[F.lit(0).cast("long").alias(c) for c in ("fresh", "leaf", "words")])
    firsts = _by_chunk(placed.filter(later), _firsts, "conv_id long, block long, fresh long, leaf long, words long").unionByName(heads)
    rest = _sums_before(firsts, ["fresh", "leaf", "words"], backwards=True).select(
        "conv_id", "block", *[F.col(f"before_{c}").alias(f"later_{c}") for c in ("fresh", "leaf", "words")])
    known = write_out(rest, "trie-later")
    full = placed.join(known, ["conv_id", "block"], "left").fillna(0, ["later_fresh", "later_leaf", "later_words"])
    found = write_out(
        _by_chunk(full, _nodes, NODE + ", ends string, name string, parent_name string, shown boolean, chunk long"), "trie-nodes")

    shared = found.filter(F.col("name").isNotNull())
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    whole = shared.groupBy("name").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent_name").alias("parent_name"),
        F.first("shown").alias("shown"), *sums)
    ends = _digests(shared.filter(F.col("ends") != "").select("name", "chunk", "ends"))
    whole = write_out(whole.join(ends, "name", "left"), "trie-shared")
    parents = whole.select(F.col("name").alias("parent_name"), F.col("conv_id").alias("_parent"))
    columns = [c.split()[0] for c in NODE.split(", ")]

    def with_parent(rows: DataFrame, ended: Column) -> DataFrame:
        inside = rows.filter(F.col("parent_name").isNull()).withColumn("_parent", F.col("parent_conv_id"))
        crossing = rows.filter(F.col("parent_name").isNotNull()).join(parents, "parent_name")
        return inside.unionByName(crossing).select(
            *[F.col("_parent").alias(c) if c == "parent_conv_id" else F.col(c) for c in columns], ended.alias("ends_sha256"))

    closed = found.filter(F.col("name").isNull() & F.col("shown"))
    crossed = whole.filter("shown").withColumn("parent_conv_id", F.lit(None).cast("long"))
    return with_parent(closed, F.col("ends")).unionByName(
        with_parent(crossed, F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest()))))
