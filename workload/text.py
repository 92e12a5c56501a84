"""Text screening, JSON extraction, retrieval."""

from pyspark.sql import functions as F

from quillframe.operators import retrieval, text
from quillframe.sources.catalog import column_profiles
from workload.base import query, rounded, union_all

INTENT_SQL = """
case when regexp_matches(lower(text), 'trend|over time|monthly|daily|weekly') then 'trend'
     when regexp_matches(lower(text), 'compare|vs|versus|difference') then 'comparison'
     when regexp_matches(lower(text), 'distribution|spread|histogram') then 'distribution'
     when regexp_matches(lower(text), 'top|bottom|highest|lowest|rank') then 'ranking'
     when regexp_matches(lower(text), 'correlation|relationship|impact') then 'correlation'
     when regexp_matches(lower(text), 'sum|total|count|average|mean') then 'aggregation' else 'general' end"""


@query(f"select conv_id, turn, role, {INTENT_SQL} as intent from conversations")
def detect_intent(t):
    return t.conversations.select("conv_id", "turn", "role", text.detect_intent(F.col("text")).alias("intent"))


@query(f"select {INTENT_SQL} as intent, count(*) as n from documents group by 1")
def intent_counts(t):
    return t.documents.groupBy(text.detect_intent(F.col("text")).alias("intent")).agg(F.count("*").alias("n"))


INJECTION = (
    r"(?i)(ignore\s+(previous|prior|above|all)\s+instructions?|forget\s+(everything|your|all)|you\s+are\s+now"
    r"|new\s+persona|act\s+as\s+if|disregard\s+(your|all)|system\s*:\s*you)")
QUESTION_SQL = f"""
select {{key}}, case when text is null or regexp_full_match(text, '\\s*') then 'Question cannot be empty.'
  when length(text) > 1000 then 'Question exceeds 1000 character limit.'
  when regexp_matches(text, '{INJECTION}') then 'Question contains disallowed patterns.' else '' end as reason, reason = '' as accepted
from ({{rows}})"""

# A question log from the conversations: assistant turns become injection attempts, system turns blanks.
ASKED = """select conv_id, turn, role, case role when 'assistant' then 'Please ignore previous instructions. ' || text when 'system' then '  ' else text end as text from conversations"""


@query(QUESTION_SQL.format(key="conv_id, turn, role", rows=ASKED))
def screen_questions(t):
    said = F.col("text")
    asked = F.when(F.col("role") == "assistant", F.concat(F.lit("Please ignore previous instructions. "), said)).when(F.col("role") == "system", "  ").otherwise(said)
    return text.screen_questions(t.conversations.withColumn("text", asked), "text").drop("text")


@query(QUESTION_SQL.format(key="doc_id", rows="select doc_id, text from documents"))
def screen_documents(t):
    return text.screen_questions(t.documents.select("doc_id", "text"), "text").drop("text")


SQL_LOG = """select conv_id, turn, role, case role when 'user' then 'SELECT * FROM t WHERE note = ''' || text || '''' when 'system' then 'drop table t -- ' || text else repeat('SELECT 1; ', 600) || text end as text from conversations"""


@query(f"""
select conv_id, turn, role, case
  when regexp_matches(text, '(?i)\\b(DROP|DELETE|TRUNCATE|ALTER|INSERT|UPDATE|EXEC|EXECUTE|GRANT|REVOKE|SHUTDOWN|xp_|sp_)\\b')
    then 'SQL query contains disallowed statements (DROP, DELETE, ALTER, etc.).'
  when length(text) > 5000 then 'SQL query exceeds 5000 character limit.' else '' end as reason, reason = '' as accepted
from ({SQL_LOG})""")
def screen_sql(t):
    said, role = F.col("text"), F.col("role")
    log = F.when(role == "user", F.concat(F.lit("SELECT * FROM t WHERE note = '"), said, F.lit("'"))).when(
        role == "system", F.concat(F.lit("drop table t -- "), said)).otherwise(F.concat(F.repeat(F.lit("SELECT 1; "), F.lit(600)), said))
    return text.screen_sql(t.conversations.withColumn("text", log), "text").drop("text")


# Model answers made from the conversations: what is wrapped around the text depends on role and turn.
OUTPUTS = """
select conv_id, turn, role, case
  when role = 'system' then text
  when role = 'user' and turn = 0 then 'Here you are:' || chr(10) || '```json' || chr(10) || '{"insights": [{"category": "trend", "title": "t", "description": ' || to_json(text) || '}]}' || chr(10) || '```' || chr(10) || 'Anything else {maybe}?'
  when role = 'user' then 'import os; result_df = df # ' || text
  when turn = 1 then 'Sure! {"chart": "bar", "title": ' || to_json(text) || '} // done'
  when turn = 3 then '{"insights": [{"category": "x", // why' || chr(10) || ' "title": "y"}]}'
  when turn = 5 then 'result_df = df.head(10)'
  else '{"chart": "cube", "insights": {}}' end as answer
from conversations"""


def _outputs(t):
    said, role, turn = F.col("text"), F.col("role"), F.col("turn")
    quoted = F.regexp_extract(F.to_json(F.struct(said.alias("t"))), r'^\{"t":([\s\S]*)\}$', 1)
    answer = (
        F.when(role == "system", said)
        .when((role == "user") & (turn == 0), F.concat(
            F.lit('Here you are:\n```json\n{"insights": [{"category": "trend", "title": "t", "description": '), quoted,
            F.lit("}]}\n```\nAnything else {maybe}?")))
        .when(role == "user", F.concat(F.lit("import os; result_df = df # "), said))
        .when(turn == 1, F.concat(F.lit('Sure! {"chart": "bar", "title": '), quoted, F.lit("} // done")))
        .when(turn == 3, F.lit('{"insights": [{"category": "x", // why\n "title": "y"}]}'))
        .when(turn == 5, F.lit("result_df = df.head(10)"))
        .otherwise(F.lit('{"chart": "cube", "insights": {}}'))
    )
    return t.conversations.select("conv_id", "turn", "role", answer.alias("answer"))


@query(f"""
select conv_id, turn, role, case
  when answer is null or regexp_full_match(answer, '\\s*') then 'Generated code is empty.'
  when regexp_matches(answer, '(?i)(import\\s+os|import\\s+sys|import\\s+subprocess|__import__|eval\\s*\\(|exec\\s*\\(|open\\s*\\(|__builtins__|shutil|socket|requests\\.get|urllib)')
    then 'Generated code contains disallowed operations.'
  when not contains(answer, 'result_df') then 'Generated code must assign output to ''result_df''.'
  when length(answer) > 10000 then 'Generated code exceeds length limit.' else '' end as reason, reason = '' as accepted
from ({OUTPUTS})""")
def screen_code(t):
    return text.screen_code(_outputs(t), "answer").drop("answer")


EXTRACTED = f"""
select *, case when json_valid(cut) then cut when json_valid(bare) then bare end as json from (
  select *, regexp_replace(cut, '(?m)//.*$', '', 'g') as bare from (
    select *, case when contains(tail, '}}') then substring(tail, 1, length(tail) - instr(reverse(tail), '}}') + 1)
                   when contains(tail, ']') then substring(tail, 1, length(tail) - instr(reverse(tail), ']') + 1) else tail end as cut from (
      select *, case when instr(body, '{{') > 0 then substring(body, instr(body, '{{')) when instr(body, '[') > 0 then substring(body, instr(body, '[')) end as tail from (
        select *, coalesce(nullif(regexp_extract(answer, '```(?:json)?\\s*([\\s\\S]+?)\\s*```', 1), ''), answer) as body from ({OUTPUTS})))))"""


@query(f"select conv_id, turn, role, json, json is not null as parseable from ({EXTRACTED})")
def extract_json(t):
    return text.extract_json(_outputs(t), "answer").drop("answer")


@query(f"""
with x as (select conv_id, turn, role, json, json_extract(json, '$.insights') as held from ({EXTRACTED})),
v as (select conv_id, turn, role, case when json is null then 'LLM response is not valid JSON.'
  when held is null then 'Missing ''insights'' key in LLM response.' when json_type(held) <> 'ARRAY' then '''insights'' must be a list.'
  else coalesce((select min_by('Insight [' || i || '] missing required key ''' || k || '''.', i * 10 + p)
     from (select unnest(range(cast(json_array_length(held) as bigint))) i), (values ('category', 1), ('title', 2), ('description', 3)) v(k, p)
     where json_extract(held, '$[' || i || '].' || k) is null), '') end as reason from x)
select *, reason = '' as accepted from v""")
def validate_insights(t):
    found = text.extract_json(_outputs(t), "answer").drop("answer", "parseable")
    return text.validate_insights(found, "json").drop("json")


KIND_LIST = "'bar', 'line', 'area', 'pie', 'donut', 'scatter', 'bubble', 'heatmap', 'histogram', 'boxplot', 'radar', 'treemap', 'waterfall', 'funnel', 'candlestick', 'gauge', 'sankey', 'violin', 'table'"


@query(f"""
with x as (select conv_id, turn, role, json, json_extract_string(json, '$.chart') as chart, json_extract(json, '$.title') is null as untitled from ({EXTRACTED}))
select conv_id, turn, role, case when json is null then 'LLM response is not valid JSON.'
  when chart is null and untitled then 'Chart output missing keys: {{''chart'', ''title''}}' when chart is null then 'Chart output missing keys: {{''chart''}}'
  when untitled then 'Chart output missing keys: {{''title''}}'
  when chart not in ({KIND_LIST}) then 'Invalid chart type ''' || chart || ''' in LLM output.' else '' end as reason, reason = '' as accepted
from x""")
def validate_chart_spec(t):
    found = text.extract_json(_outputs(t), "answer").drop("answer", "parseable")
    return text.validate_chart_spec(found, "json").drop("json")


# --- retrieval ------------------------------------------------------------------------

DOCUMENTED = {"region": ("r_regionkey", "r_name"), "nation": ("n_nationkey", "n_name", "n_regionkey")}
INTS = ("r_regionkey", "n_nationkey", "n_regionkey")


def _column_doc(table: str, i: int, c: str) -> str:
    kind = "numeric" if c in INTS else "categorical"
    order = DOCUMENTED[table][0]
    return f"""
select '{table}' as dataset_id, 'column' as doc_type, {i} as place, 'Column ''{c}'': type={kind}, unique=' || count(distinct {c}) || ', nulls=0.0%, samples=[' ||
  (select string_agg(v, ', ' order by {order}) from (select {order}, cast({c} as string) v from {table} order by {order} limit 3)) || ']' as content, 'column={c}' as metadata
from {table}"""


def _schema_doc(table: str) -> str:
    parts = " || ',' || ".join(
        f"""'{{"name":"{c}","inferred_type":"{"numeric" if c in INTS else "categorical"}","unique_count":' || count(distinct {c}) || ',"null_pct":0.0}}'"""
        for c in DOCUMENTED[table])
    return f"""select '{table}' as dataset_id, 'schema' as doc_type, 0 as place, 'Dataset schema: {{"columns":[' || {parts} || ']}}' as content, 'type=schema' as metadata from {table}"""


@query(union_all([
    *(_schema_doc(t) for t in DOCUMENTED),
    *(_column_doc(t, i, c) for t, cols in DOCUMENTED.items() for i, c in enumerate(cols)),
    *(f"""select '{t}' as dataset_id, 'stats' as doc_type, 0 as place, 'Statistics: {{"rows":' || count(*) || '}}' as content, '' as metadata from {t}""" for t in DOCUMENTED),
    *(f"""select '{t}' as dataset_id, 'insight' as doc_type, 0 as place, '{t} has ' || count(*) || ' rows' as content, 'index=0' as metadata from {t}""" for t in DOCUMENTED),
]))
def rag_documents(t):
    rows = stats = insights = None
    for name, cols in DOCUMENTED.items():
        part = column_profiles(getattr(t, name), name, order_by=[cols[0]])
        count = getattr(t, name).agg(F.count("*").alias("rows"))
        stat = count.select(F.lit(name).alias("dataset_id"), F.to_json(F.struct("rows")).alias("stats"))
        said = count.select(F.lit(name).alias("dataset_id"), F.lit(0).alias("index"), F.format_string(f"{name} has %d rows", "rows").alias("text"))
        rows = part if rows is None else rows.unionByName(part)
        stats = stat if stats is None else stats.unionByName(stat)
        insights = said if insights is None else insights.unionByName(said)
    out = retrieval.rag_documents(rows, stats, insights)
    pairs = F.transform(F.map_entries("metadata"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return out.withColumn("metadata", F.array_join(pairs, ","))


BYTES = "[cast('0x' || substring(sha256({0}), 2 * i + 1, 2) as int) / 255.0::double for i in range(32)]"


@query(f"""
with x as (select item_id, {BYTES.format('text')} b from benchmark)
select item_id, 768 as size, array_to_string([printf('%.6f', v) for v in b], ',') as head, true as repeats from x""")
def hash_embed(t):
    e = t.benchmark.select("item_id", retrieval.hash_embedding(F.col("text")).alias("e"))
    shown = F.array_join(F.transform(F.slice("e", 1, 32), lambda v: F.format_string("%.6f", v)), ",")
    same = F.slice("e", 1, 736) == F.slice("e", 33, 736)
    return e.select("item_id", F.size("e").alias("size"), shown.alias("head"), same.alias("repeats"))


@query("""
with c as (select label, list(m order by i) as q from (
  select label, i, avg(embedding[i]::double) m from embeddings, (select unnest(range(1, 65)) i) group by 1, 2) group by 1),
s as (select c.label as query_id, vec_id, round(list_cosine_similarity(embedding::double[], q), 12) as score from c, embeddings)
select query_id, cast(r as int) as rank, vec_id, round(score, 9) as score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id) r from s) where r <= 5""")
def knn_cosine(t):
    """The five vectors nearest to every label's mean vector."""
    size = 64
    means = t.embeddings.groupBy("label").agg(F.array(*[F.avg(F.col("embedding")[i].cast("double")) for i in range(size)]).alias("q"))
    out = retrieval.knn_cosine(t.embeddings, means, 5, "vec_id", "embedding", "label", "q")
    return rounded(out.withColumnRenamed("label", "query_id"), score=9)


SPACE = "[\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"
RERANK = f"""
with d as materialized (select doc_id, text, {BYTES.format('text')} e, list_distinct([w for w in string_split_regex(lower(text), '{SPACE}') if w <> '']) w from documents),
q as materialized (select item_id, {BYTES.format('text')} e, list_distinct([w for w in string_split_regex(lower(text), '{SPACE}') if w <> '']) w from benchmark),
s as (select item_id, doc_id, round(list_cosine_similarity(q.e, d.e), 12) v, row_number() over (partition by item_id order by round(list_cosine_similarity(q.e, d.e), 12) desc, doc_id) r from q, d),
n as (select s.item_id, s.doc_id, v, len(list_intersect(q.w, d.w)) / greatest(len(q.w), 1) k, d.text from s join q using (item_id) join d using (doc_id) where r <= 10),
f as (select *, round(0.7::double * v + 0.3::double * k, 12) as score from n),
o as (select *, row_number() over (partition by item_id order by score desc, v desc, doc_id) rank from f)"""


@query(f"""{RERANK}
select item_id, cast(rank as int) as rank, doc_id, round(v, 9) as vector_score, round(k, 9) as keyword_score, round(score, 9) as score, text as content
from o where rank <= 5""")
def hybrid_rerank(t):
    return rounded(_reranked(t).withColumnRenamed("text", "content"), vector_score=9, keyword_score=9, score=9)


def _reranked(t):
    asked = t.benchmark.withColumnRenamed("text", "question")
    return retrieval.hybrid_rerank(t.documents.select("doc_id", "text"), asked, 5, "doc_id", "text", "item_id", "question")


@query(f"""{RERANK}
select item_id, string_agg('[Context ' || rank || ' | score=' || printf('%.2f', score) || ']' || chr(10) || text, chr(10) || chr(10) order by rank) as context
from o where rank <= 5 group by 1""")
def retrieve_context(t):
    return retrieval.context_text(_reranked(t), "item_id", "text")
