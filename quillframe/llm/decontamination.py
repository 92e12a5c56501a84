"""Benchmark decontamination by winnowing: shared word spans of a guaranteed length are found and extended."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import ITEM_BREAKS, let, lower_ascii, packed, unpacked, word_count, words
from quillframe.session import write_out

SPAN = 10  # words that a document must share with an item
GRAM = 5  # words that are hashed together
SALTS = 16  # tasks that copies of one text are dealt to


class Hits(NamedTuple):
    docs: DataFrame  # text_key, pos, length, window: the windows of items that occur in each text
    windows: DataFrame  # item_id, length, window, mark: the windows of every item


def _grams(w: Column, k: int) -> Column:
    """Hashes of all runs of ``k`` words."""
    starts = F.when(F.size(w) >= k, F.sequence(F.lit(0), F.size(w) - k)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))


def _minima(g: Column, width: int) -> Column:
    """The smallest of every ``width`` neighbours: the fingerprint of each window, in order."""
    if width == 1:
        return g
    starts = F.when(F.size(g) >= width, F.sequence(F.lit(0), F.size(g) - width)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.least(*[F.get(g, i + j) for j in range(width)]))


def _marked(df: DataFrame, lengths: list[int], gram: int) -> DataFrame:
    """Add ``m<length>``, the fingerprint of each window of that many words, to a table with ``w``.

    A window of n words has n - k + 1 grams of k words, and keeps the smallest hash; two windows of the same
    words keep the same one.
    """
    sizes = {n: min(gram, n) for n in lengths}
    df = df.withColumns({f"g{k}": _grams(F.col("w"), k) for k in sorted(set(sizes.values()))})
    return df.withColumns({f"m{n}": _minima(F.col(f"g{k}"), n - k + 1) for n, k in sizes.items()})


def _windows(n: int, wanted: Column | None = None) -> Column:
    """(pos, length, window, mark) of the windows of ``n`` words, or of those whose mark is wanted."""
    marks = F.col(f"m{n}")
    at = F.transform(marks, lambda m, i: F.struct(i.alias("pos"), m.alias("mark")))
    if wanted is not None:
        at = F.filter(at, lambda s: F.array_contains(wanted, s["mark"]))
    return F.transform(at, lambda s: F.struct(
        s["pos"].alias("pos"), F.lit(n).alias("length"),
        F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.get(F.col("w"), s["pos"] + j)), " ").alias("window"),
        s["mark"].alias("mark")))


def find(docs: DataFrame, items: DataFrame, span: int = SPAN, gram: int = GRAM) -> Hits:
    """The windows of ``items`` (item_id, text) that occur in the texts of ``docs`` (text).

    Words are lower-cased (A-Z) runs of letters, digits and characters beyond ASCII. An item's windows are
    its runs of ``span`` words, or the whole item if it has fewer. Fingerprints (the smallest
    gram hash of every window) are joined; a text keeps the same fingerprint for the same words,
    so that every shared window meets. Where one meets, the hit is extended to its whole window and compared word
    by word. Texts are told apart by their MD5; copies are found once.
    Null or empty texts and items have no windows.
    """
    split = items.select(F.col("item_id").cast("string").alias("item_id"), words(lower_ascii(F.col("text")), ITEM_BREAKS).alias("w"))
    split = split.filter(F.size("w") > 0).withColumn("n", F.least(F.size("w"), F.lit(span)))
    lengths = sorted(r["n"] for r in split.select("n").distinct().collect())  # at most ``span`` values
    parts = [
        _marked(split.filter(F.col("n") == n), [n], gram).select("item_id", F.explode(_windows(n)).alias("s"))
        .select("item_id", "s.length", "s.window", "s.mark") for n in lengths]
    empty = items.sparkSession.createDataFrame([], "item_id string, length int, window string, mark bigint")
    windows = write_out(reduce(DataFrame.unionByName, parts, empty).distinct(), "item-windows")

    texts = docs.select(F.md5(F.col("text").cast("binary")).alias("text_key"), F.col("text"))
    if not lengths:
        return Hits(texts.select("text_key", F.lit(0).alias("pos"), F.lit(0).alias("length"), F.col("text").alias("window")).limit(0), windows)
    marked = _marked(texts.withColumn("w", words(lower_ascii(F.col("text")), ITEM_BREAKS)), lengths, gram)
    kept = F.array_distinct(F.concat(*[F.col(f"m{n}") for n in lengths]))
    met = marked.select("text_key", F.explode(kept).alias("mark")).join(windows.select("mark").distinct(), "mark", "left_semi")
    met = write_out(met.groupBy("text_key").agg(F.collect_set("mark").alias("met")), "texts-met")  # bounded by the text

    # The keys met grow with the table, so the texts are always dealt by key; copies of one text go to ``SALTS`` tasks.
    met = met.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    texts = texts.withColumn("salt", F.monotonically_increasing_id() % SALTS)
    near = texts.join(met.hint("merge"), ["text_key", "salt"]).withColumn("w", words(lower_ascii(F.col("text")), ITEM_BREAKS))
    near = _marked(near, lengths, gram)
    found = near.select("text_key", F.explode(F.concat(*[_windows(n, F.col("met")) for n in lengths])).alias("s"))
    found = found.select("text_key", "s.pos", "s.length", "s.window").distinct()
    known = windows.select("length", "window").distinct()
    return Hits(write_out(found.join(known, ["length", "window"], "left_semi"), "window-hits"), windows)


def _covered(spans: Column) -> Column:
    """Words covered by sorted (pos, length) spans."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def add(state, s):
        return let(s["pos"] + s["length"], lambda end: F.struct(
            (state["n"] + F.greatest(end - F.greatest(state["end"], s["pos"]), F.lit(0))).alias("n"),
            F.greatest(state["end"], end).alias("end")))

    return F.aggregate(spans, start, add, lambda s: s["n"])


def report(docs: DataFrame, items: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit if it lies in an occurring window. ``items_sha256`` digests the ids of the items with occurring
    windows, as sorted strings joined by commas; items without an id are left out of it and of the count.
    Null texts have no words; repeated rows are reported as often as they occur; other columns are ignored.
    """
    hits = find(docs, items, span, gram)
    by_text = hits.docs.groupBy("text_key").agg(F.array_sort(F.collect_list(F.struct("pos", "length"))).alias("spans"))
    by_text = by_text.select("text_key", _covered(F.col("spans")).alias("n_hit"))
    pairs = hits.docs.select("text_key", "length", "window").distinct().join(
        hits.windows.select("item_id", "length", "window").filter(F.col("item_id").isNotNull()), ["length", "window"])
    by_items = pairs.select("text_key", "item_id").distinct().groupBy("text_key").agg(
        F.count("*").alias("n_items"), F.sha2(F.array_join(F.array_sort(F.collect_list("item_id")), ","), 256).alias("items_sha256"))
    found = write_out(by_text.join(by_items, "text_key", "left"), "text-hits")
    rows = docs.select(
        "doc_id", F.md5(F.col("text").cast("binary")).alias("text_key"), word_count(F.col("text"), ITEM_BREAKS).alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return rows.join(found, "text_key", "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """``docs`` without the rows whose text holds a window of an item; null texts stay."""
    dirty = write_out(find(docs, items, span, gram).docs.select("text_key").distinct(), "texts-dirty")
    rows = docs.select(packed(docs), F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("")).alias("text_key"))
    return unpacked(rows.join(dirty.hint("merge"), "text_key", "left_anti"))
