"""Conversation structure repair: the cheapest edits that make the roles of a conversation alternate.

Roles must read, by their initials, as (s?(ua)+)?. Rows stream through tasks sorted by conversation and turn. One pass goes
backwards: it carries four costs, those of finishing from each state, and leaves one byte per row that tells the best
edit in every state. These back pointers are a table in the shared folder. The second pass goes forwards and applies them.
Neither holds more of a conversation than the batch at hand, so its length does not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quillframe.session import write_out

KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3  # costs of the edits
TRUNCATED = 3  # what a truncated row costs where it stays
START, SYSTEM, USER, ASSISTANT = range(4)  # states: nothing yet, or the initial of the row before
GIVEN = (USER, USER, ASSISTANT, USER)  # by state: the role that an inserted or changed row gets, as the state it leads to
NAMES = {USER: "user", ASSISTANT: "assistant"}
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
AT_END = (0, 2 * INSERT, INSERT, 0)  # by state: the cost of ending there
LETTERS = "DIKR"  # in ASCII order, which decides ties
FAR = 1 << 40

EDITED = "turn long, edit string, role string, text string, initial string, fault string, cost long"
DIGESTED = ("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
WORD = r"[^\x20\x09-\x0D]"
ENDED = r"[.!?][\x20\x09-\x0D]*\z"


def step(after: tuple[int, ...], initial: str, truncated: bool) -> tuple[tuple[int, ...], int]:
    """Costs of finishing from each state before a row, given those after it, and the best edits, two bits a state.

    Inserting twice in a row is enough: a third time leads back to a state passed before.
    """
    extra = TRUNCATED if truncated else 0
    found = []
    for q in range(4):
        to = KEPT.get((q, initial))
        found.append((DELETE + after[q], FAR if to is None else KEEP + extra + after[to], REROLE + extra + after[GIVEN[q]]))
    least = [min(f) for f in found]
    once = [INSERT + least[GIVEN[q]] for q in range(4)]
    costs = [min(least[q], once[q], INSERT + once[GIVEN[q]]) for q in range(4)]
    packed = 0
    for q in range(4):
        options = (found[q][0], INSERT + costs[GIVEN[q]], found[q][1], found[q][2])
        packed |= options.index(costs[q]) << 2 * q
    return tuple(costs), packed


def _batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Rows as batches of up to ``size`` rows or about 4 MB of strings."""
    held, weight = [], 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)

    for row in rows:
        held.append(row)
        weight += sum(len(v) for v in row if isinstance(v, str))
        if len(held) >= size or weight >= 1 << 22:
            yield batch()
            held, weight = [], 0
    if held:
        yield batch()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _schema(first: T.StructField, rest: str) -> T.StructType:
    return T.StructType([T.StructField(first.name, first.dataType), *T._parse_datatype_string(rest).fields])


def _prepared(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, digest): nulls in role and text read as empty."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")).withColumn(
        "digest", F.sha2("text", 256))


def pointers(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, truncated, choice): the best edits at the rows that need not be deleted, written once.

    Those are the first rows of each role and text in a conversation, unless blank. Equal rows fold before the shuffle.
    """
    told = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = rows.filter(F.col("text").rlike(WORD)).groupBy("conv_id", "role", "digest").agg(
        F.min(told).alias("at"), F.first(~F.col("text").rlike(ENDED)).alias("truncated"))
    backwards = first.select("conv_id", F.col("at.turn").alias("turn"), "role", "digest", "truncated").repartition("conv_id").sortWithinPartitions(
        "conv_id", F.col("turn").desc_nulls_last(), F.col("role").desc(), F.col("digest").desc())
    kind = _schema(rows.schema["conv_id"], "turn long, role string, digest string, truncated boolean, choice int")
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved():
            conv, costs, known = object(), AT_END, {}
            for row in _rows(batches):
                if row[0] != conv:
                    conv, costs = row[0], AT_END
                at = costs, row[2][:1], row[4]
                if at not in known:  # costs are kept less their minimum, so there are few different ones
                    then, choice = step(*at)
                    known[at] = tuple(c - min(then) for c in then), choice
                costs, choice = known[at]
                yield *row, choice

        yield from _batches(solved(), arrow)

    return write_out(backwards.mapInArrow(run, kind), "repair-pointers")


def edits(turns: DataFrame) -> DataFrame:
    """The edited rows of all conversations in ``turns`` (conv_id, turn, role, text), in order within their partition.

    Each row has its conv_id and turn, the edit (K keep, R rerole, D delete, I insert), the role and text that stay (text null
    where deleted), the initial it had, its first fault (blank, duplicate, truncated) and its cost. Rows of a conversation go
    by turn, nulls first; ties by role, then by the SHA-256 of the text. Repeated rows are duplicates. Null roles and
    texts read as empty; a row with an empty role has no initial, so it cannot stay as it is; null conv_ids are one conversation. Texts are kept whole, however long. Other columns are
    ignored. An empty table gives an empty one. All rows of a conversation stream through one task, as its order demands.
    """
    rows = _prepared(turns)
    best = pointers(rows)
    both = rows.select("conv_id", "turn", "role", "digest", F.lit(1).alias("kind"), "text", F.lit(False).alias("truncated"), F.lit(0).alias("choice")).unionByName(
        best.select("conv_id", "turn", "role", "digest", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("text"), "truncated", "choice"))
    forwards = both.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "digest", "kind")
    kind = _schema(rows.schema["conv_id"], EDITED)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def inserted(conv, state):
            return conv, None, "I", NAMES[GIVEN[state]], "", None, None, INSERT

        def ended(conv, state):
            while AT_END[state]:
                yield inserted(conv, state)
                state = GIVEN[state]

        def edited():
            conv, state, pointer = None, START, None
            for c, turn, role, digest, is_text, text, truncated, choice in _rows(batches):
                if c != conv:
                    yield from ended(conv, state)
                    conv, state = c, START
                if not is_text:
                    pointer = truncated, choice
                    continue
                initial = role[:1]
                if pointer is None:
                    yield c, turn, "D", role, None, initial, "duplicate" if text.strip(" \t\n\v\f\r") else "blank", DELETE
                    continue
                (truncated, choice), pointer = pointer, None
                while (letter := LETTERS[choice >> 2 * state & 3]) == "I":
                    yield inserted(c, state)
                    state = GIVEN[state]
                fault, extra = ("truncated", TRUNCATED) if truncated else (None, 0)
                if letter == "D":
                    yield c, turn, "D", role, None, initial, fault, DELETE
                    continue
                state = KEPT[state, initial] if letter == "K" else GIVEN[state]
                yield c, turn, letter, role if letter == "K" else NAMES[state], text, initial, fault, extra + (KEEP if letter == "K" else REROLE)
            yield from ended(conv, state)

        yield from _batches(edited(), arrow)

    return forwards.mapInArrow(run, kind)


def digests(edited: DataFrame) -> DataFrame:
    """One row per conversation of ``edits``, read in the order in which they come: faults, illegal neighbours, cost,
    the edits' initials and the SHA-256 of the repaired rows."""
    kind = _schema(edited.schema["conv_id"], DIGESTED)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def folded():
            conv, held = None, None
            for c, turn, edit, role, text, initial, fault, cost in _rows(batches):
                if held is None or c != conv:
                    if held is not None:
                        yield conv, *closed(held)
                    conv, held = c, {"sha": hashlib.sha256(), "lines": 0, "audit": [], "cost": 0, "illegal": 0, "before": None,
                                     "blank": 0, "duplicate": 0, "truncated": 0, "low": None, "high": None, "turns": 0}
                held["audit"].append(edit)
                held["cost"] += cost
                if edit != "D":
                    held["sha"].update(("\n" * (held["lines"] > 0) + f"{role}:{text}").encode())
                    held["lines"] += 1
                if edit == "I":
                    continue
                held["illegal"] += held["before"] is not None and held["before"] + initial not in ("su", "ua", "au")
                held["before"] = initial
                if fault:
                    held[fault] += 1
                if turn is not None and turn != held["high"]:
                    held["low"] = turn if held["low"] is None else held["low"]
                    held["high"], held["turns"] = turn, held["turns"] + 1
            if held is not None:
                yield conv, *closed(held)

        def closed(h):
            gaps = 0 if h["low"] is None else h["high"] - h["low"] + 1 - h["turns"]
            return gaps, h["blank"], h["duplicate"], h["truncated"], h["illegal"], h["cost"], "".join(h["audit"]), h["sha"].hexdigest()

        yield from _batches(folded(), arrow)

    return edited.mapInArrow(run, kind)


def report(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """``digests`` of the repaired ``turns`` for every conv_id of ``ids``; zeros and empty strings where it has no rows."""
    told = digests(edits(turns)).withColumnRenamed("conv_id", "_conv")
    every = ids.select("conv_id").distinct().join(told, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return every.select(
        "conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
