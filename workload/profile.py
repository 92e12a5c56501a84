"""Profiling and data quality."""

from pyspark.sql import functions as F

from quillframe.operators import profile
from workload.base import (
    GAP_COLUMNS, LINE_NUMBERS, SQL_GAPS, all_rounded, gaps, query, rounded, union_all,
)

CUSTOMER = {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"}
GAP_NAMES = [c.rsplit(" as ", 1)[-1] for c in GAP_COLUMNS]
GAP_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *LINE_NUMBERS]
GAP_STRINGS = ["l_returnflag", "l_linestatus", "l_shipdate"]

CARDINALITY = "case when u <= 10 then 'low' when u / greatest(n, 1) > 0.8 then 'high' else 'medium' end"


def _schema_sql(i: int, c: str, kind: str) -> str:
    numeric = kind != "string"
    stats = f"round(min({c}), 4), round(max({c}), 4), round(avg({c}), 4), round(stddev_samp({c}), 4)" if numeric else "null, null, null, null"
    logical = "'numeric'" if numeric else f"case when avg(length({c})) > 40 then 'text' else 'categorical' end"
    shown = f"printf('%.2f', {c})" if kind == "double" else f"cast({c} as string)"
    return f"""
select {i} as position, '{c}' as name, '{kind}' as dtype, lt as inferred_type, n as rows, n - k as null_count,
  round_even((n - k) / n * 100, 2) as null_pct, u as unique_count, {CARDINALITY} as cardinality, s as samples,
  cast(lo as double) as min_val, cast(hi as double) as max_val, cast(mean as double) as mean_val, cast(std as double) as std_val
from (select count(*) n, count({c}) k, count(distinct {c}) u, {logical} lt from customer),
     (select string_agg(v, ',' order by c_custkey) s from (
        select c_custkey, {shown} v from customer where {c} is not null order by c_custkey limit 5)),
     (select {stats}{" from customer" if numeric else ""}) as x(lo, hi, mean, std)"""


@query(union_all(_schema_sql(i, c, k) for i, (c, k) in enumerate(CUSTOMER.items())))
def infer_schema(t):
    out = profile.infer_schema(t.customer, order_by=["c_custkey"])
    money = F.transform("sample_values", lambda v: F.format_string("%.2f", v.cast("double")))
    samples = F.array_join(F.when(F.col("dtype") == "double", money).otherwise(F.col("sample_values")), ",")
    number = lambda c: F.round(F.when(F.col("inferred_type") == "numeric", F.col(c)).cast("double"), 4).alias(c)
    return out.select(
        "position", "name", "dtype", "inferred_type", "rows", "null_count", "null_pct", "unique_count", "cardinality",
        samples.alias("samples"), number("min_val"), number("max_val"), number("mean_val"), number("std_val"))


@query("""
with d as (select count(*) n, count(distinct (lang, source, text, n_chars)) u from documents)
select 40.0::double as completeness, round_even((1 - (n - u) / n) * 30, 2) as uniqueness, 30.0::double as consistency,
  round_even(40 + (1 - (n - u) / n) * 30 + 30, 2) as quality_score from d""")
def quality_score(t):
    return profile.quality_score(t.documents.drop("doc_id"))


@query("""
with r as (select cast(o_orderkey as string) a, case when o_orderstatus = 'P' then 'unknown' else cast(cast(o_custkey as string) as string) end b,
                  nullif(o_orderpriority, '5-LOW') c from orders),
x as (select count(*) n, sum((c is null)::int) k, count(distinct (a, b, coalesce(c, '?'))) u from r)
select round_even((1 - k / (n * 3)) * 40, 2) as completeness, round_even((1 - (n - u) / n) * 30, 2) as uniqueness,
  round_even((1 - 1 / 3) * 30, 2) as consistency,
  round_even((1 - k / (n * 3)) * 40 + (1 - (n - u) / n) * 30 + (1 - 1 / 3) * 30, 2) as quality_score from x""")
def quality_score_raw(t):
    raw = t.orders.select(
        F.col("o_orderkey").cast("string").alias("a"),
        F.when(F.col("o_orderstatus") == "P", "unknown").otherwise(F.col("o_custkey").cast("string")).alias("b"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("c"))
    return profile.quality_score(raw, raw_strings=True)


def _null_sql(c: str) -> str:
    return f"select '{c}' as c, count(*) as n, count(*) - count({c}) as k from {SQL_GAPS}"


GAP_NULLS = f"({union_all(_null_sql(c) for c in GAP_NAMES)})"


@query(f"""
with x as (select * from {GAP_NULLS})
select c as "column", k as missing_count, round_even(k / n * 100, 2) as missing_pct,
  (select cast(sum(k) as bigint) from x) as total_missing, (select round_even((1 - sum(k) / sum(n)) * 100, 2) from x) as completeness_pct
from x where k > 0""")
def missing_report(t):
    return profile.missing_report(gaps(t))


@query("""
select count(*) as rows, count(*) - count(distinct (lang, source, text, n_chars)) as duplicate_rows from documents""")
def duplicate_rows(t):
    return profile.duplicate_rows(t.documents.drop("doc_id"))


@query(f"""
with x as (select c, round_even(k / n * 100, 2) p from {GAP_NULLS}),
f as (select case when p > 50 then 'issue' else 'warning' end as severity, c as "column",
        '''' || c || ''' is ' || printf('%.1f', p) || '% null' as message from x where p > 20),
d as (select count(*) n, count(*) - count(distinct (l_returnflag, l_linestatus, l_shipdate, l_quantity, l_tax, l_discount, l_extendedprice, l_orderkey, l_partkey, l_suppkey, l_linenumber)) d from {SQL_GAPS})
select *, not exists (select 1 from f where severity = 'issue') as is_valid from f
union all
select case when d / n > 0.1 then 'issue' else 'warning' end, null,
  case when d / n > 0.1 then d || ' duplicate rows (' || printf('%.1f', d / n * 100) || '%)' else d || ' duplicate rows' end,
  not exists (select 1 from f where severity = 'issue') from d where d > 0""")
def validate_quality(t):
    return profile.validate_quality(gaps(t))


@query(f"""
select c as "column", '''' || c || ''' has ' || cast(round_even(k / n * 100, 2) as string) || '% missing values.' as message
from {GAP_NULLS} where round_even(k / n * 100, 2) > 30""")
def quality_warnings(t):
    return profile.quality_warnings(gaps(t))


def _counts_sql(c: str, table: str) -> str:
    return f"select '{c}' as c, cast({c} as string) as v, count(*) as n from {table} where {c} is not null group by 2"


def _top_sql(columns, table) -> str:
    return f"""
select c, v, n, cast(row_number() over (partition by c order by n desc, v) as int) r from ({union_all(_counts_sql(c, table) for c in columns)})"""


EVENT_STRINGS = ["event_type", "props"]


@query(f"""select c as "column", v as value, n, r as rank from ({_top_sql(EVENT_STRINGS, "events")}) where r <= 10""")
def value_counts(t):
    return profile.value_counts(t.events)


@query(f"""
with x as (select c, n, sum(n) over (partition by c) s from ({union_all(_counts_sql(c, "events") for c in EVENT_STRINGS)}))
select c as "column", round_even(sum(-(n / s) * log2(n / s + 1e-10)), 4) as entropy from x group by c""")
def entropy(t):
    return profile.entropy(t.events)


def _summary_sql(c: str) -> str:
    q = ", ".join(f"round(quantile_cont({c}, {p}), 4) as p{int(p * 100)}" for p in (0.25, 0.5, 0.75, 0.9))
    return f"""select '{c}' as "column", count({c}) as count, round(avg({c}), 4) as mean, round(stddev_samp({c}), 4) as std,
  round(min({c}), 4) as min, round(max({c}), 4) as max, {q} from {SQL_GAPS}"""


@query(union_all(_summary_sql(c) for c in GAP_NUMBERS))
def summary_stats(t):
    return all_rounded(profile.summary_stats(gaps(t)), 4)


def _category_sql(columns, table) -> str:
    return f"""
select c as "column", string_agg(v || ':' || n, '|' order by r) as top_values from ({_top_sql(columns, table)}) where r <= 10 group by c"""


def _flat(column):
    return F.array_join(F.transform(column, lambda s: F.concat(s["value"], F.lit(":"), s["n"].cast("string"))), "|")


@query(f"""
with k as (select c, round_even(k / n * 100, 2) p from {GAP_NULLS}),
u as ({union_all(f"select '{c}' c, count(distinct {c}) u from {SQL_GAPS}" for c in GAP_STRINGS)})
select x."column", p as null_pct, u as unique_count, top_values
from ({_category_sql(GAP_STRINGS, SQL_GAPS)}) x join k on k.c = x."column" join u on u.c = x."column" """)
def summary_categories(t):
    return profile.summary_categories(gaps(t)).withColumn("top_values", _flat("top_values"))


def _moments(c: str, table: str) -> str:
    """Population skewness and excess kurtosis from central moments."""
    return f"""select avg(pow({c} - m, 3)) / pow(avg(pow({c} - m, 2)), 1.5) sk, avg(pow({c} - m, 4)) / pow(avg(pow({c} - m, 2)), 2) - 3 ku
  from {table}, (select avg({c}) m from {table})"""


def _distribution_sql(c: str) -> str:
    q = ", ".join(f"round(quantile_cont({c}, {p}), 4) as p{round(p * 100)}" for p in (0.05, 0.25, 0.5, 0.75, 0.95))
    return f"""select '{c}' as "column", (select round_even(sk, 4) from ({_moments(c, SQL_GAPS)})) as skewness,
  (select round_even(ku, 4) from ({_moments(c, SQL_GAPS)})) as kurtosis, {q} from {SQL_GAPS}"""


@query(union_all(_distribution_sql(c) for c in LINE_NUMBERS))
def distribution(t):
    return all_rounded(profile.distribution(gaps(t), LINE_NUMBERS), 4)


def _histogram_sql(c: str, table: str, bins: str, low_digits: int = 4) -> str:
    return f"""
select '{c}' as "column", cast(i as int) as bin, round(lo + i * (hi - lo) / b, {low_digits}) as lo,
  round(lo + (i + 1) * (hi - lo) / b, {low_digits}) as hi, cast(coalesce(n, 0) as bigint) as n
from (select min({c}) lo, max({c}) hi, {bins} b from {table}), lateral (select unnest(range(b)) i)
left join (
  select least(floor(({c} - lo) / (hi - lo) * b), b - 1) g, count(*) n
  from {table}, (select min({c}) lo, max({c}) hi, {bins} b from {table}) where {c} is not null group by 1) on g = i"""


@query(union_all(_histogram_sql(c, SQL_GAPS, f"least(20, count(distinct {c}))") for c in ("l_extendedprice", "l_tax")))
def distribution_histograms(t):
    return profile.distribution_histograms(gaps(t), ["l_extendedprice", "l_tax"])


@query(f"""
select x."column", top_values, u as unique_count, split_part(split_part(top_values, '|', 1), ':', 1) as mode
from ({_category_sql(GAP_STRINGS, SQL_GAPS)}) x
join ({union_all(f"select '{c}' c, count(distinct {c}) u from {SQL_GAPS}" for c in GAP_STRINGS)}) u on u.c = x."column" """)
def distribution_categories(t):
    return profile.distribution_categories(gaps(t)).withColumn("top_values", _flat("top_values"))


def _profile_sql(i: int, c: str) -> str:
    number = c in GAP_NUMBERS
    q = ", ".join(f"round(quantile_cont({c}, {p}), 4) as p{int(p * 100)}" for p in (0.25, 0.5, 0.75, 0.95))
    numeric = (
        f"round(avg({c}), 4) as mean, round(stddev_samp({c}), 4) as std, round(min({c}), 4) as min, round(max({c}), 4) as max, {q}, "
        f"cast(bool_or({c} < 0) as string) as has_negatives, cast(bool_or({c} = 0) as string) as has_zeros, "
        f"(select round_even(sk, 4) from ({_moments(c, SQL_GAPS)})) as skewness, (select round_even(ku, 4) from ({_moments(c, SQL_GAPS)})) as kurtosis" if number else
        "null as skewness, null as kurtosis, null as mean, null as std, null as min, null as max, null as p25, null as p50, null as p75, null as p95, null as has_negatives, null as has_zeros")
    kind = "'numeric'" if number else ("'datetime'" if c == "l_shipdate" else "'categorical'")
    cat = not number and c != "l_shipdate"
    top = (
        f"""(select top_values from ({_category_sql([c], SQL_GAPS)})) as top_10,
        (select v from ({_top_sql([c], SQL_GAPS)}) where r = 1) as top_value,
        (select round_even(n / (select count(*) from lineitem) * 100, 2) from ({_top_sql([c], SQL_GAPS)}) where r = 1) as top_value_pct,
        (select round_even(sum(-(n / s) * log2(n / s + 1e-10)), 4) from (select n, sum(n) over () s from ({_counts_sql(c, SQL_GAPS)}))) as entropy"""
        if cat else "null as top_10, null as top_value, null as top_value_pct, null as entropy")
    return f"""
select {i} as position, '{c}' as name, {kind} as type, count(*) as total_count, count(*) - count({c}) as null_count,
  round_even((count(*) - count({c})) / count(*) * 100, 2) as null_pct, count(distinct {c}) as unique_count,
  count(distinct {c}) <= 1 as is_constant, count(distinct {c}) = count(*) as is_unique, {numeric}, {top} from {SQL_GAPS}"""


@query(union_all(_profile_sql(i, c) for i, c in enumerate(GAP_NAMES)))
def profile_dataset(t):
    out = profile.profile_dataset(gaps(t)).withColumns({
        "top_10": _flat("top_10"), "has_negatives": F.col("has_negatives").cast("string"), "has_zeros": F.col("has_zeros").cast("string")})
    return rounded(out, **{c: 4 for c in ("mean", "std", "min", "max", "p25", "p50", "p75", "p95")})


@query(f"""
select count(*) as row_count, 11 as col_count, count(*) * 11 as total_cells,
  (select cast(sum(k) as bigint) from {GAP_NULLS}) as missing_cells,
  count(*) - count(distinct (l_returnflag, l_linestatus, l_shipdate, l_quantity, l_tax, l_discount, l_extendedprice, l_orderkey, l_partkey, l_suppkey, l_linenumber)) as duplicate_rows
from {SQL_GAPS}""")
def profile_table(t):
    return profile.profile_table(gaps(t))


@query("""
select count(*) as rows, sha256('[''' || 'c_custkey'', ''c_name'', ''c_nationkey'', ''c_acctbal'', ''c_mktsegment''](' || count(*) || ', 5)') as fingerprint
from customer""")
def fingerprint(t):
    return profile.fingerprint(t.customer)


@query(union_all(
    f"""select '{c}' as "column", count(distinct {c}) as unique_count, round_even(count(distinct {c}) / count(*) * 100, 1) as unique_pct from customer"""
    for c in list(CUSTOMER)[:4]))
def unique_ratio(t):
    return profile.unique_ratio(t.customer)
