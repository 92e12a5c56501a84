"""Secret scans: strong patterns on their own, weak parts only where the parts that complete them lie near."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillframe.llm.common import ID, numbered
from quillframe.session import write_out


def either_case(word: str) -> str:
    """A pattern for an ASCII word in either case; the same in every engine, unlike a flag that folds other letters too."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


SET_TO = r"""["']?\x20*[:=]\x20*["']?"""
ASSIGNED = "(?:" + "|".join(map(either_case, ["password", "passwd", "secret", "token", "api_?key"])) + ")" + SET_TO
ASSIGN = ASSIGNED + r"[A-Za-z0-9+/_.=-]+"
ACCESS = r"AKIA[A-Z0-9]{14,}"  # with less behind the first AKIA of a run, what follows is too short as well
HEX = r"[0-9a-f]{16,}"
LOGIN = "(?:" + "|".join(map(either_case, ["user", "username", "login", "account", "client_?id"])) + ")" + SET_TO + r"[A-Za-z0-9+/_.@=-]{3,}"
KEY = r"[A-Za-z0-9+/_-]{20,}={0,2}"
ENDPOINT = r"""[A-Za-z][A-Za-z0-9+]{1,15}://[^\x00-\x20"'<>\x7F]+"""
LONG_VALUE, SHORT_VALUE = 12, 6  # characters of an assigned value: a secret by itself, a weak candidate

#: Kinds in the order in which spans of one start are listed; the first three are secrets by themselves.
KINDS = ["assign", "access", "hex", "login", "key", "short", "endpoint"]
STRONG = KINDS[:3]
IDENTIFIERS, SECRETS = ["access", "login"], ["assign", "hex", "key", "short"]
SCOPE = 200  # code points between two parts of one credential, at most
BIN = 256


def _matches(text: Column, pattern: str, kind, keep=None) -> Column:
    """Matches as (kind, gap, length): the characters since the match before, and those of the match; kind null if it is none.

    The gaps are what splitting leaves, so all lengths together give every match its place.
    """
    none = F.lit(None).cast("string")

    def described(gap: Column, match: Column) -> Column:
        name = kind(match) if callable(kind) else F.lit(kind) if keep is None else F.when(keep(match), F.lit(kind)).otherwise(none)
        return F.when(match.isNotNull(), F.struct(
            name.alias("kind"), F.char_length(gap).alias("gap"), F.char_length(match).alias("length")))

    found = F.zip_with(F.split(text, pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), described)
    return F.filter(found, lambda m: m.isNotNull())


def _assigned(match: Column) -> Column:
    n = F.char_length(F.regexp_replace(match, "^" + ASSIGNED, ""))
    return F.when(n >= LONG_VALUE, F.lit("assign")).when(n >= SHORT_VALUE, F.lit("short"))


def _mixed(match: Column) -> Column:
    return match.rlike("[0-9]") & match.rlike("[A-Z]") & match.rlike("[a-z]")


def parts(docs: DataFrame) -> DataFrame:
    """(_id, doc_id, parts): the strong and weak parts of every text, as (family, kind, gap, length) in order; written once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    families = [
        _matches(text, ASSIGN, _assigned), _matches(text, ACCESS, "access"), _matches(text, HEX, "hex"), _matches(text, LOGIN, "login"),
        _matches(text, KEY, "key", _mixed), F.when(text.contains("://"), _matches(text, ENDPOINT, "endpoint"))]

    def marked(family: int, found: Column) -> Column:
        return F.transform(F.coalesce(found, F.array()), lambda m: F.struct(
            F.lit(family).alias("family"), m["kind"].alias("kind"), m["gap"].alias("gap"), m["length"].alias("length")))

    every = F.concat(*[marked(i, f) for i, f in enumerate(families)])
    return numbered(docs.select("doc_id", every.alias("parts")), "secret-parts")


def placed(found: DataFrame) -> DataFrame:
    """(_id, part, kind, start, end) of the parts that have a kind, in code points, end exclusive."""
    rows = found.select(ID, F.posexplode("parts").alias("part", "m")).select(ID, "part", "m.*")
    so_far = Window.partitionBy(ID, "family").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("length")).over(so_far)
    return rows.withColumn("end", end).filter(F.col("kind").isNotNull()).select(ID, "part", "kind", (F.col("end") - F.col("length")).alias("start"), "end")


def linked(spans: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak parts of ``spans`` that the parts around them complete, as (_id, kind, start, end).

    A part is around another if at most ``scope`` code points lie between them and they do not overlap. A login needs a
    secret around it, a weak secret an identifier, an endpoint both. A weak part that overlaps a strong one says nothing
    new and is left out. Parts meet in bins of the text; a bin holds a bounded number of parts.
    """
    def bins(first: Column, last: Column) -> Column:
        return F.explode(F.sequence(F.floor(F.greatest(first, F.lit(0)) / BIN), F.floor(last / BIN)))

    weak = spans.filter(~F.col("kind").isin(STRONG)).select(ID, "part", "kind", "start", "end", bins(
        F.col("start") - scope, F.col("end") + scope).alias("bin"))
    around = spans.select(ID, F.col("kind").alias("other"), F.col("start").alias("from"), F.col("end").alias("to"), bins(
        F.col("start"), F.col("end") - 1).alias("bin"))
    apart = (F.col("to") <= F.col("start")) | (F.col("from") >= F.col("end"))
    near = (F.col("from") <= F.col("end") + scope) & (F.col("to") >= F.col("start") - scope)
    met = weak.join(around, [ID, "bin"]).filter(near)
    judged = met.groupBy(ID, "part", "kind", "start", "end").agg(
        F.max(~apart & F.col("other").isin(STRONG)).alias("covered"),
        F.max(apart & F.col("other").isin(IDENTIFIERS)).alias("identified"),
        F.max(apart & F.col("other").isin(SECRETS)).alias("secret"))
    complete = F.when(F.col("kind") == "login", F.col("secret")).when(
        F.col("kind") == "endpoint", F.col("secret") & F.col("identified")).otherwise(F.col("identified"))
    return judged.filter(~F.col("covered") & complete).select(ID, "kind", "start", "end")


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(doc_id, spans) for every row of ``docs`` (doc_id, text): the secrets as (start, end, kind), by start, then kind as in KINDS.

    Whole texts are read, however long; the parts found are rows of their own, so a text with many of them is spread by place.
    Null and empty texts have no spans. Repeated rows, null and repeated doc_ids each give a row of their own; ties in start go
    by kind, then end. Other columns are ignored, whatever their names. An empty table gives an empty one.
    """
    found = parts(docs.select("doc_id", "text"))
    spans = write_out(placed(found), "secret-spans")
    every = spans.filter(F.col("kind").isin(STRONG)).select(ID, "kind", "start", "end").unionByName(linked(spans, scope))
    rank = F.array_position(F.lit(KINDS), F.col("kind"))
    listed = every.groupBy(ID).agg(F.array_sort(F.collect_list(F.struct("start", rank.alias("rank"), "end", "kind"))).alias("spans"))
    listed = listed.select(ID, F.transform("spans", lambda s: F.struct(s["start"], s["end"], s["kind"])).alias("spans"))
    return found.select(ID, "doc_id").join(listed, ID, "left").select(
        "doc_id", F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint,kind:string>>")).alias("spans"))


def listing(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, the number of spans of each strong kind, their digest, and all spans as text."""
    scanned = scan(docs)

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    strong = F.filter("spans", lambda s: s["kind"].isin(STRONG))
    return scanned.select(
        "doc_id", *map(count, STRONG), F.sha2(listing(strong), 256).alias("base_sha256"), listing(F.col("spans")).alias("spans"))
