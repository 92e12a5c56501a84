"""Quality rules: base rules on each text, and lines that many documents of a host share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import ID, ROW, kept_splits, let, lower_ascii, packed, sieved, word_count, words
from quillframe.operators import blocks
from quillframe.session import write_out

LEAST_DOCS = 10  # of a host; a line in more of them is removed, however large the host is
LEAST_LEFT = 0.75  # of the words; a document that keeps less is rejected
LEAST_WORDS, MOST_REPEATED = 50, 0.5
WORD = r"[^\x20\x09-\x0D]"


def repeated_words(w: Column) -> Column:
    """Words that lie in a run of three words found at least twice."""
    starts = F.when(F.size(w) >= 3, F.sequence(F.lit(0), F.size(w) - 3)).otherwise(F.array().cast("array<int>"))
    runs = F.transform(starts, lambda i: F.struct(F.xxhash64(*[F.get(w, i + j) for j in range(3)]).alias("h"), i.alias("i")))

    def covered(ordered):
        def same(i, j):
            return F.coalesce(F.get(ordered, i)["h"] == F.get(ordered, j)["h"], F.lit(False))

        places = F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), lambda i: same(i, i - 1) | same(i, i + 1))
        starts = F.array_sort(F.transform(places, lambda i: F.get(ordered, i)["i"]))
        state = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(starts, state, lambda s, p: F.struct(
            (s["n"] + p + 3 - F.greatest(s["end"], p)).alias("n"), (p + 3).alias("end")), lambda s: s["n"])

    def count(runs):
        hashes = F.transform(runs, lambda r: r["h"])
        return F.when(F.size(F.array_distinct(hashes)) == F.size(runs), F.lit(0)).otherwise(let(F.sort_array(runs), covered))

    return let(runs, count)


def _host() -> Column:
    return F.coalesce(F.col("source").cast("string"), F.lit(""))


def _line_hash(line: Column) -> Column:
    """The hash of a normalised line: words joined by one space, A-Z lower-cased."""
    return let(words(line), lambda w: F.xxhash64(lower_ascii(F.array_join(w, " "))))


def _hashed(rows: DataFrame) -> DataFrame:
    """(_id, host, text_key, lines) of ``rows`` (_id, host, text): every line with a word as (at, h), its place and hash; written once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.transform(F.split(text, "\n"), lambda s, i: F.when(s.rlike(WORD), F.struct(i.alias("at"), _line_hash(s).alias("h"))))
    found = F.filter(lines, lambda x: x.isNotNull())
    return write_out(rows.select(ID, "host", F.md5(text.cast("binary")).alias("text_key"), found.alias("lines")), "line-hashes")


def common_lines(hashed: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(host, h): lines found in more than ``least_docs`` documents of their host.

    Equal texts of a host count as one document, so that copying a document does not make its lines common.
    Equal (host, line, text) triples fold before the shuffle.
    """
    once = F.array_distinct(F.transform("lines", lambda x: x["h"]))
    seen = hashed.select("host", "text_key", F.explode(once).alias("h")).distinct()
    return seen.groupBy("host", "h").agg(F.count("*").alias("n")).filter(F.col("n") > least_docs).select("host", "h")


def _with_clean(docs: DataFrame, least_docs: int) -> DataFrame:
    """(_row, text, clean, cut): each row of ``docs``, its text, the text without the common lines of its host, and whether that has any.

    Only texts with common lines, and the few that a sieve cannot tell from them, are joined with the places of these lines.
    """
    docs = kept_splits(docs, "quality-rows")
    rows = docs.select(packed(docs), _host().alias("host"), F.col("text"), F.monotonically_increasing_id().alias(ID))
    hashed = _hashed(rows)
    mark = F.xxhash64("host", "h").alias("mark")
    common = write_out(common_lines(hashed, least_docs).select("host", "h", mark), "common-lines")
    lines = hashed.select(ID, "host", F.inline("lines")).select("*", mark)
    places = blocks.sieved(lines, common, "mark", "_maybe").filter("_maybe").join(common.drop("mark").hint("merge"), ["host", "h"])
    places = write_out(places.groupBy(ID).agg(F.collect_list("at").alias("places")), "common-places")  # no more than the text has lines
    told = sieved(rows.select(ROW, ID, "text"), places, "_maybe")
    met = told.filter("_maybe").join(places.hint("merge"), ID, "left")  # places grow with the texts: no broadcast on small tables either

    def rest(lines):
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("places"))
        return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")

    cut = F.col("places").isNotNull()
    clean = F.when(cut, let(F.split("text", "\n"), rest)).otherwise(F.col("text"))
    whole = told.filter("NOT _maybe").select(ROW, "text", F.col("text").alias("clean"), F.lit(False).alias("cut"))
    return whole.unionByName(met.select(ROW, "text", clean.alias("clean"), cut.alias("cut")))


def cleaned(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``docs`` (text, source as host, any others) with the lines of ``common_lines`` removed from the texts.

    All rows, columns and other lines stay as they are and in order; a text whose lines are all removed becomes empty. Null hosts
    count as the empty one. An empty table gives an empty one.
    """
    rows = _with_clean(docs, least_docs)
    return rows.select(*[F.col("clean").alias(c) if c.lower() == "text" else F.col(f"{ROW}.`{c}`") for c in docs.columns])


def judge(docs: DataFrame, least_docs: int = LEAST_DOCS, least_left: float = LEAST_LEFT) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source as host) with the base figures, removed_words and kept.

    Removed are the words that the texts of ``cleaned`` no longer have. A document is rejected if less than ``least_left``
    of its words remain, or by the base rules: fewer than 50 words, or more than half of them in repeated runs of
    three. Null texts have no words; a null source counts as the empty one. Repeated rows are judged alike; other
    columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = _with_clean(docs.select("doc_id", "text", "source"), least_docs)
    rows = rows.select(
        F.col(f"{ROW}.doc_id").alias("doc_id"), text.alias("text"), words(text).alias("w"),
        F.when(F.col("cut"), word_count(F.col("clean"))).alias("n_left"),
        F.filter(F.split(text, "\n"), lambda s: s.rlike(WORD)).alias("rows"))
    n_words = F.size("w").cast("long")
    rows = rows.select(
        "doc_id", F.coalesce("n_left", n_words).alias("n_left"), n_words.alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("rows") - F.size(F.array_distinct("rows"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("w")).cast("long").alias("n_repeat_words"))
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("n_words") - F.col("n_left")).alias("removed_words"), failed.alias("base_failed"),
        (~failed & (F.col("n_left") >= least_left * F.col("n_words"))).alias("kept"))
