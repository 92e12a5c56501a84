"""The registered corpus queries and the SQL that those expressible in SQL must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from quillframe.llm import (
    decontamination, langid, mixing, quality, repair, secrets, sharding, simhash, tokens, toolcalls, toxicity, trie, warc)
from quillframe.session import write_out

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def held_out(parts: int, part: int) -> Column:
    """Whether the CRC32 of doc_id as text leaves this remainder; also where there is no doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == part, F.lit(True))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """How many words of each document a mix by source weights 1, 2, 3 takes, at most three epochs."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    mixed = mixing.mix(docs)
    return mixing.taken_by_row(mixed).select("doc_id", "size", "source_size", "target", "taken")


@query
def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """SimHash fingerprints of all documents, and groups of those that differ in two bits at most."""
    return simhash.report(table(spark, folder, "documents"))


@query
def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """A toxicity score for every document, learned from the labels of two thirds of them."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.fit(docs.filter(~held_out(3, 1)), table(spark, folder, "labels"))
    scored = toxicity.score(docs.withColumn("held_out", held_out(3, 1)), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op5_warc(spark: SparkSession, folder: str) -> DataFrame:
    """All pages written to dictionary-compressed archives and read back."""
    return warc.round_trip(table(spark, folder, "pages"))


@query
def op6_language(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document, learned from four fifths of them."""
    docs = table(spark, folder, "documents")
    model = langid.fit(docs.filter(~held_out(5, 0)))
    found = langid.identify(docs.select("doc_id", "text", held_out(5, 0).alias("held_out")), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")


@query
def op7_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every document under a byte-level vocabulary, and whether they exceed a context of 1024."""
    docs = table(spark, folder, "documents").select(
        "doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counted = tokens.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


@query
def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """How much of every document lies in passages of ten words shared with a benchmark item."""
    return decontamination.report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


ORACLE["op8_decontamination"] = r"""
with folded as (
  select doc_id, row_number() over () as rid,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
items as (
  select cast(item_id as varchar) as item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark),
item_windows as (
  select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as win
  from (select item_id, w, least(len(w), 10) as n, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) as i
        from items where len(w) > 0)),
doc_windows as (
  select rid, i, n, array_to_string(w[i:i + n - 1], ' ') as win
  from (select rid, w, n, unnest(generate_series(1, len(w) - n + 1)) as i
        from folded, (select distinct n from item_windows) where len(w) >= n)),
hits as (select d.rid, d.i, d.n, v.item_id from doc_windows d join item_windows v on d.n = v.n and d.win = v.win),
hit_words as (
  select rid, count(distinct p) as n_hit
  from (select distinct rid, unnest(generate_series(i, i + n - 1)) as p from hits) group by rid),
hit_items as (
  select rid, count(*) as n_items, sha256(string_agg(item_id, ',' order by item_id)) as ids
  from (select distinct rid, item_id from hits) group by rid)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       coalesce(ids, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from folded left join hit_words using (rid) left join hit_items using (rid)
"""


@query
def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Base figures of every document, and whether it keeps enough words without its host's common lines."""
    return quality.judge(table(spark, folder, "documents"))


ORACLE["op9_quality"] = r"""
with docs as (
  select doc_id, row_number() over () as rid, coalesce(source, '') as host, coalesce(text, '') as text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w
  from documents),
lines as (
  select rid, host, text, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as n,
         translate(array_to_string(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), ' '),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as norm
  from (select rid, host, text, unnest(string_split(text, chr(10))) as line from docs)),
worded as (select * from lines where n > 0),
dups as (select rid, count(*) - count(distinct line) as n_dup_lines from worded group by rid),
common as (select host, norm from worded group by host, norm having count(distinct text) > 10),
removed as (
  select rid, cast(sum(worded.n) as bigint) as removed_words from worded join common using (host, norm) group by rid),
runs as (
  select rid, i, array_to_string(w[i:i + 2], ' ') as run
  from (select rid, w, unnest(generate_series(1, len(w) - 2)) as i from docs where len(w) >= 3)),
again as (
  select rid, unnest([i, i + 1, i + 2]) as p
  from (select rid, i, count(*) over (partition by rid, run) as c from runs) where c >= 2),
repeated as (select rid, count(distinct p) as n_repeat_words from again group by rid),
rows as (
  select doc_id, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
         cast(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) as bigint) as n_symbols,
         coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
         coalesce(removed_words, 0) as removed_words
  from docs left join dups using (rid) left join removed using (rid) left join repeated using (rid))
select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
       not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and 4 * (n_words - removed_words) >= 3 * n_words as kept
from rows
"""


@query
def op10_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 16 shards whose row counts differ by one at most, shuffled uniformly."""
    placed = sharding.shard(table(spark, folder, "documents"), 16)  # whole rows pass its exchange, texts included
    return placed.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


#: The tools of the derived call log: name, parameter, type, required.
TOOLS = [
    ("search", "text", "string", True), ("search", "limit", "integer", False), ("search", "after", "string", False),
    ("translate", "text", "string", True), ("translate", "limit", "integer", True), ("translate", "after", "string", False),
    ("measure", "text", "string", True), ("measure", "limit", "number", True), ("measure", "after", "string", False),
]


@query
def op2_toolcalls(spark: SparkSession, folder: str) -> DataFrame:
    """Calls and results of all conversations, linked, ordered, validated and serialised.

    The table has plain turns, so the log is derived from it: a user turn is a call whose arguments hold its whole text
    and name the user turn before as the one it needs; an assistant turn is the result for the turn before it.
    The lengths of the texts decide the tool and which calls are flawed.
    """
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    n, quoted = F.char_length("text"), F.to_json(F.array("text"))

    def call(back: int) -> Column:
        return F.concat_ws(":", "conv_id", F.col("turn") - back)

    tool = F.element_at(F.lit(["search", "translate", "measure", "paint"]), (n % 10).cast("int") % 4 + 1)
    limit = F.when(n % 7 == 0, F.lit('"5"')).otherwise(F.col("turn").cast("string"))
    arguments = F.when(n % 17 == 0, F.lit("[1,2]")).otherwise(F.concat(
        F.lit('{ "text" : '), quoted.substr(F.lit(2), F.char_length(quoted) - 2),
        F.when(n % 11 == 0, F.lit("")).otherwise(F.concat(F.lit(', "limit": '), limit)),
        F.lit(', "after": "'), call(2), F.lit('"'),
        F.when(n % 13 == 0, F.lit(', "style": {"b": 1, "a": [true, null]}')).otherwise(F.lit("")), F.lit(" }")))
    calls = turns.filter("role = 'user'").select(
        "conv_id", "turn", call(0).alias("call_id"), tool.alias("name"), arguments.alias("arguments"), call(2).alias("after"))
    results = turns.filter("role = 'assistant'").select("conv_id", "turn", call(1).alias("call_id"), F.col("text").alias("content"))
    schemas = spark.createDataFrame(TOOLS, "name string, param string, type string, required boolean")
    return toolcalls.link(calls, results, schemas)


ORACLE["op2_toolcalls"] = """
with recursive turns as (
  select conv_id, turn, role, coalesce(text, '') as text, length(coalesce(text, '')) as n from conversations),
raw as (
  select conv_id, turn, conv_id || ':' || turn as call_id, conv_id || ':' || (turn - 2) as after,
         (['search', 'translate', 'measure', 'paint'])[(n % 10) % 4 + 1] as name, n,
         case when n % 17 = 0 then '[1,2]' else
           '{"after":"' || conv_id || ':' || (turn - 2) || '"'
           || case when n % 11 = 0 then '' when n % 7 = 0 then ',"limit":"5"' else ',"limit":' || turn end
           || case when n % 13 = 0 then ',"style":{"a":[true,null],"b":1}' else '' end
           || ',"text":' || cast(to_json(text) as varchar) || '}' end as arguments
  from turns where role = 'user'),
calls as (
  select *, count(*) over (partition by call_id) as n_calls
  from raw qualify row_number() over (partition by call_id order by name, arguments) = 1),
results as (
  select conv_id, turn, conv_id || ':' || (turn - 1) as call_id, text as content,
         count(*) over (partition by conv_id, turn) as n_results
  from turns where role = 'assistant' qualify row_number() over (partition by conv_id, turn order by text) = 1),
depths as (
  select call_id, 0 as depth from calls where after not in (select call_id from calls)
  union all
  select c.call_id, d.depth + 1 from calls c join depths d on c.after = d.call_id),
flawed as (
  select *, case when name = 'paint' then ['unknown tool'] when n % 17 = 0 then ['arguments are not an object'] else
    list_sort(list_filter([
      case when n % 11 = 0 and name <> 'search' then 'missing parameter limit' end,
      case when n % 11 <> 0 and n % 7 = 0 then 'not of type ' || case name when 'measure' then 'number' else 'integer' end || ': limit' end,
      case when n % 13 = 0 then 'unknown parameter style' end], lambda e: e is not null)) end as errors
  from calls)
select coalesce(f.conv_id, r.conv_id) as conv_id, coalesce(f.turn, r.turn) as turn, call_id, name,
       case when f.n_calls is null then 'orphan' when r.n_results is null then 'unanswered' else 'linked' end as status,
       coalesce(f.n_calls, 0) as n_calls, coalesce(r.n_results, 0) as n_results, cast(d.depth as bigint) as depth, false as cyclic,
       cast(coalesce(len(errors), 0) as int) as n_errors,
       '{"arguments":' || coalesce(arguments, 'null') || ',"call_id":"' || call_id || '","errors":'
       || coalesce(cast(to_json(errors) as varchar), 'null') || ',"name":' || coalesce('"' || name || '"', 'null')
       || ',"result":' || coalesce(cast(to_json(content) as varchar), 'null') || ',"status":"'
       || case when f.n_calls is null then 'orphan' when r.n_results is null then 'unanswered' else 'linked' end || '"}' as record
from flawed f full join results r using (call_id) left join depths d using (call_id)
"""


def rebuilt(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """Conversations that start with up to three turns of another: the first h of conversation c - c % 20, then their own after
    the first h, with h the CRC32 of c modulo 4."""
    given = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    convs = ids.select("conv_id", (F.col("conv_id") - F.col("conv_id") % 20).alias("base"), given.alias("given"))
    heads = turns.filter((F.col("at") < 3) & (F.col("conv_id") % 20 == 0)).withColumnRenamed("conv_id", "base")
    start = write_out(convs.join(heads, "base").filter(F.col("at") < F.col("given")).select("conv_id", "at", "key", "words"), "trie-heads")
    lengths = convs.join(start.groupBy("conv_id").agg(F.count("*").alias("n")), "conv_id", "left")
    own = turns.join(lengths, "conv_id").filter(F.col("at") >= F.col("given"))
    at = F.col("at") - F.col("given") + F.coalesce("n", F.lit(0))
    return start.unionByName(own.select("conv_id", at.alias("at"), "key", "words"))


@query
def op11_trie(spark: SparkSession, folder: str) -> DataFrame:
    """All nodes of the prefix trie of the conversations, rebuilt so that many share their first turns."""
    turns = write_out(trie.sequences(table(spark, folder, "conversations")), "trie-turns")
    ids = turns.filter("at = 0").select("conv_id")
    return trie.nodes(write_out(rebuilt(turns, ids), "trie-rebuilt"), ids)


ORACLE["op11_trie"] = r"""
with turns as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first) as at, coalesce(role, '') as role, coalesce(text, '') as text
  from conversations),
convs as (select distinct conv_id, conv_id - conv_id % 20 as base from conversations),
given as (
  select conv_id, base, xor(list_reduce(generate_series(0, 8 * length(id) - 1)::bigint[], lambda c, i:
           xor((case when i % 8 = 0 then xor(c, ascii(id[i // 8 + 1])::bigint) else c end) >> 1,
               case when (case when i % 8 = 0 then xor(c, ascii(id[i // 8 + 1])::bigint) else c end) % 2 = 1 then 3988292384 else 0 end),
           4294967295::bigint), 4294967295::bigint) % 4 as h  -- CRC32, bit by bit
  from (select *, conv_id::varchar as id from convs)),
heads as (select c.conv_id, t.at as k, role, text from given c join turns t on t.conv_id = c.base where t.at <= h),
taken as (select conv_id, count(*) as n from heads group by conv_id),
rebuilt as (
  select * from heads
  union all
  select t.conv_id, t.at - h + coalesce(n, 0), role, text from turns t join given using (conv_id) left join taken using (conv_id) where t.at > h),
worded as (
  select conv_id, k, len(regexp_extract_all(text, '[^ 	-
]+')) as w,
         md5(string_agg(md5(length(role) || ':' || role || text), '') over (partition by conv_id order by k)) as path
  from rebuilt),
paths as (select * from worded union all select conv_id, 0, 0, '' from convs),
members as (
  select *, min(conv_id) over (partition by k, path) as first_id, count(*) over (partition by k, path) as n,
         max(k) over (partition by conv_id) as last_k, lag(path) over (partition by conv_id order by k) as parent_path
  from paths),
told as (
  select *, max(last_k) over (partition by k, path) as deepest from members),
summed as (
  select *, sum(w) over deeper as words_below,
         sum(case when conv_id = first_id then w else 0 end) over deeper as own_below,
         max(case when conv_id = first_id and k = deepest then 1 else 0 end) over (partition by conv_id) as leads
  from told window deeper as (partition by conv_id order by k desc)),
nodes as (
  select k as depth, path, first_id as conv_id, any_value(parent_path) as parent_path, any_value(n) as n_convs, sum(leads) as n_leaves,
         sum(words_below) - sum(own_below) as saved_tokens,
         sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (last_k = k), '')) as ends_sha256
  from summed group by k, path, first_id),
children as (select depth - 1 as depth, parent_path as path, count(*) as n_children from nodes where depth > 0 group by all)
select v.conv_id, v.depth, p.conv_id as parent_conv_id, v.n_convs, coalesce(n_children, 0) as n_children, cast(v.n_leaves as bigint) as n_leaves,
       cast(v.saved_tokens as bigint) as saved_tokens, v.ends_sha256
from nodes v left join nodes p on p.depth = v.depth - 1 and p.path = v.parent_path
left join children c on c.depth = v.depth and c.path = v.path
"""

@query
def op12_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in every document: strong patterns, and weak parts that complete each other."""
    return secrets.report(table(spark, folder, "documents"))


def _secrets_sql() -> str:
    """Places come from the pieces between matches; parts of one text are joined by their distance."""
    def family(kind: str, pattern: str) -> str:
        quoted = pattern.replace("'", "''")
        return f"""
  select rid, doc_id, '{kind}' as family, unnest(regexp_extract_all(text, '{quoted}')) as m,
         unnest(string_split_regex(text, '{quoted}')[:len(regexp_extract_all(text, '{quoted}'))]) as gap,
         unnest(generate_series(1, len(regexp_extract_all(text, '{quoted}')))) as i
  from docs"""

    families = {"assign": secrets.ASSIGN, "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+", "login": secrets.LOGIN,
                "key": secrets.KEY, "endpoint": secrets.ENDPOINT}
    prefix = secrets.ASSIGNED.replace("'", "''")
    return f"""
with docs as (select doc_id, row_number() over () as rid, coalesce(text, '') as text from documents),
found as ({" union all ".join(family(k, p) for k, p in families.items())}),
ends as (
  select *, sum(length(gap) + length(m)) over (partition by rid, family order by i) as stop,
         length(regexp_replace(m, '^{prefix}', '')) as n_value
  from found),
spans as (
  select rid, doc_id, cast(stop - length(m) as bigint) as start, cast(stop as bigint) as stop, case
      when family = 'assign' then case when n_value >= 12 then 'assign' when n_value >= 6 then 'short' end
      when family = 'access' then case when length(m) >= 18 then 'access' end
      when family = 'hex' then case when length(m) >= 16 then 'hex' end
      when family = 'key' then case when regexp_matches(m, '[0-9]') and regexp_matches(m, '[A-Z]') and regexp_matches(m, '[a-z]') then 'key' end
      else family end as kind
  from ends),
known as (select *, list_position(['assign', 'access', 'hex', 'login', 'key', 'short', 'endpoint'], kind) as rank from spans where kind is not null),
around as (
  select w.rid, w.kind, w.rank, w.start, w.stop,
         bool_or(o.rank <= 3 and o.start < w.stop and o.stop > w.start) as covered,
         bool_or(o.kind in ('access', 'login') and (o.stop <= w.start or o.start >= w.stop)) as identified,
         bool_or(o.kind in ('assign', 'hex', 'key', 'short') and (o.stop <= w.start or o.start >= w.stop)) as secret
  from known w join known o on w.rid = o.rid and o.start <= w.stop + {secrets.SCOPE} and o.stop >= w.start - {secrets.SCOPE}
  where w.rank > 3 group by all),
every as (
  select rid, kind, rank, start, stop from known where rank <= 3
  union all
  select rid, kind, rank, start, stop from around
  where not covered and case kind when 'login' then secret when 'endpoint' then secret and identified else identified end),
listed as (
  select rid, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access,
         count(*) filter (kind = 'hex') as n_hex,
         string_agg(kind || ':' || start || ':' || stop, ',' order by start, rank) filter (rank <= 3) as strong,
         string_agg(kind || ':' || start || ':' || stop, ',' order by start, rank) as spans
  from every group by rid)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
       sha256(coalesce(strong, '')) as base_sha256, coalesce(spans, '') as spans
from docs left join listed using (rid)
"""


ORACLE["op12_secrets"] = _secrets_sql()


def damaged(turns: DataFrame) -> DataFrame:
    """``turns`` with faults planted by the CRC32 of conv_id and turn: dropped, emptied, cut short, repeated or reroled rows."""
    def told(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    rows = turns.select("conv_id", "turn", told("role").alias("role"), told("text").alias("text"), (
        F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn")).cast("binary")) % 20).alias("fate")).filter("fate != 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(True), F.when(F.col("fate") == 3, 2).otherwise(1)))
    return rows.select(
        "conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


@query
def op13_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Faults of all conversations after damage, and the cheapest edits that repair them."""
    turns = table(spark, folder, "conversations")
    return repair.report(damaged(turns), turns)
