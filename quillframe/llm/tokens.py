"""Token counts by byte-pair merging with a heap and a linked list."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from quillframe.llm.common import ROW, packed, unpacked

#: Fixed value: the pattern by which byte-level vocabularies of this kind split text before merging.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
REMEMBERED = 1 << 19  # pieces whose counts a worker keeps; it starts afresh when they are full


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself if it is printable Latin-1, else the next free one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Merger:
    """Counts the tokens of a byte-level vocabulary file (JSON, with merges and added tokens)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.ranks = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.symbols = byte_symbols()
        special = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.pieces = regex.compile(PIECES)
        self.known: dict[str, int] = {}

    def piece(self, text: str) -> int:
        """Symbols of the piece minus merges. A heap holds the adjacent pairs by rank, then place; the
        symbols form a linked list, and pairs whose symbols have changed since are passed over."""
        at = [self.symbols[b] for b in text.encode("utf-8", "surrogatepass")]
        n, ranks = len(at), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, at[i], at[i + 1]) for i in range(n - 1) if (r := ranks.get((at[i], at[i + 1]))) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if j >= n or at[i] != left or at[j] != right:
                continue
            merges += 1
            at[i], at[j] = left + right, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get((at[i], at[k]))) is not None:
                    heapq.heappush(heap, (r, i, at[i], at[k]))
            h = before[i]
            if h >= 0 and (r := ranks.get((at[h], at[i]))) is not None:
                heapq.heappush(heap, (r, h, at[h], at[i]))
        return n - merges

    def count(self, text: str) -> int:
        """Tokens of a text; an added token's string in it is one token."""
        total, known = 0, self.known
        parts = self.special.split(text) if self.special else [text]
        for part in parts:
            for piece in self.pieces.findall(part):
                found = known.get(piece)
                if found is None:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    found = known[piece] = self.piece(piece)
                total += found
        return total + len(parts) - 1


@lru_cache(maxsize=4)
def merger(path: str) -> Merger:
    return Merger(path)


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` (text and any others) with ``n_tokens`` under the vocabulary file at ``path`` on every executor.

    Null and empty texts have none. An input column called n_tokens is replaced.
    """
    rows = docs.select(packed(docs), F.coalesce("text", F.lit("")).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = merger(path).count
        for batch in batches:
            counts = pa.array([count(t.as_py()) for t in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), counts], [ROW, "n_tokens"])

    return unpacked(rows.mapInArrow(run, StructType([rows.schema[ROW]]).add("n_tokens", LongType())), "n_tokens")
