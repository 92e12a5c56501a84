"""Business analytics."""

from pyspark.sql import functions as F

from quillframe.operators import analytics, timeseries
from quillframe.plans.analyze import analyze
from workload.base import (
    LINE_NUMBERS, SQL_GAPS, all_rounded, day, gaps, query, rounded, sql_p_value, union_all,
)

GROUP_KEYS = ["l_returnflag", "l_linestatus"]


def _group_sql(expr: str, keys: str = "l_returnflag, l_linestatus", table: str = "lineitem", alias: str = "l_extendedprice", digits: int = 2) -> str:
    where = " and ".join(f"{k.strip()} is not null" for k in keys.split(","))
    return f"""
with g as (select {keys}, round({expr}, {digits}) as {alias} from {table} where {where} group by {keys})
select *, (select count(*) from g) as total_groups from g order by {alias} desc nulls last, {keys} limit 20"""


@query(_group_sql("sum(l_extendedprice)"))
def group_aggregate(t):
    return all_rounded(analytics.group_aggregate(t.lineitem, GROUP_KEYS, "l_extendedprice"), 2)


@query(_group_sql("median(l_extendedprice)", "l_suppkey", digits=4))
def group_aggregate_median(t):
    return all_rounded(analytics.group_aggregate(t.lineitem, ["l_suppkey"], "l_extendedprice", "median"), 4)


@query(_group_sql("stddev_samp(l_extendedprice)", "l_suppkey", digits=4))
def group_aggregate_std(t):
    return all_rounded(analytics.group_aggregate(t.lineitem, ["l_suppkey"], "l_extendedprice", "std"), 4)


@query(_group_sql("count(distinct l_partkey)", "l_returnflag, l_suppkey", SQL_GAPS, "l_partkey", 0))
def group_aggregate_nunique(t):
    return analytics.group_aggregate(gaps(t), ["l_returnflag", "l_suppkey"], "l_partkey", "nunique")


@query(_group_sql("coalesce(sum(l_tax), 0)", "l_returnflag, l_quantity", SQL_GAPS, "l_tax", 4))
def group_aggregate_nulls(t):
    return all_rounded(analytics.group_aggregate(gaps(t), ["l_returnflag", "l_quantity"], "l_tax"), 4)


def _kpi_sql(c: str) -> str:
    return f"""
select '{c}' as "column", round(sum({c}), 2) as total, round_even(avg({c}), 4) as mean, round(median({c}), 4) as median, round(min({c}), 4) as min,
  round(max({c}), 4) as max, round(stddev_samp({c}), 4) as std, count({c}) as count,
  round_even((count(*) - count({c})) / count(*) * 100, 2) as null_pct,
  (with r as (select {c} v, row_number() over (order by l_shipdate, {c}) rn, count(*) over () n from {SQL_GAPS} where {c} is not null)
   select round((sum(case when rn > n // 2 then v end) - sum(case when rn <= n // 2 then v end)) / abs(sum(case when rn <= n // 2 then v end)) * 100, 2) from r) as growth_rate
from {SQL_GAPS}"""


@query(union_all(_kpi_sql(c) for c in LINE_NUMBERS))
def kpis(t):
    out = analytics.kpis(gaps(t), LINE_NUMBERS, "l_shipdate")
    return rounded(out, total=2, median=4, min=4, max=4, std=4)


@query(union_all(
    f"""select '{c}' as "column", round(sum({c}), 2) as sum, round_even(avg({c}), 4) as mean, round(min({c}), 4) as min, round(max({c}), 4) as max, count({c}) as count from {SQL_GAPS}"""
    for c in LINE_NUMBERS))
def kpi_cards(t):
    return rounded(analytics.kpi_cards(gaps(t), LINE_NUMBERS), sum=2, min=4, max=4)


COHORTS = """
with a as (select distinct o_custkey u, date_trunc('month', o_orderdate) m from orders),
c as (select u, m, min(m) over (partition by u) c from a),
k as (select c, cast((year(m) - year(c)) * 12 + month(m) - month(c) as int) i, count(*) n from c group by 1, 2),
b as (select c, n as base from k where i = 0),
g as (select c, base, i from b, (select distinct i from k))
select strftime(g.c, '%Y-%m') as cohort, g.i as period_index, coalesce(n, 0) as users, coalesce(round_even(n / base * 100, 1), 0) as retention_pct
from g left join k on k.c = g.c and k.i = g.i"""


@query(COHORTS)
def cohort_retention(t):
    return analytics.cohort_retention(t.orders, "o_orderdate", "o_custkey", "o_totalprice")


PERIODS = range(80)  # months from the first order date to the last, and one for safety


@query(f"""
with k as ({COHORTS})
select cohort, {", ".join(f"coalesce(max(case when period_index = {i} then users end), 0) as p{i}" for i in PERIODS)} from k group by cohort""")
def cohort_matrix(t):
    wide = analytics.cohort_matrix(t.orders, "o_orderdate", "o_custkey", "o_totalprice", "users")
    return wide.select("cohort", *[
        F.coalesce(F.col(str(i)) if str(i) in wide.columns else F.lit(None), F.lit(0)).cast("bigint").alias(f"p{i}") for i in PERIODS])


STAGES = ["signup", "view", "click", "purchase"]


def _funnel_sql(order: str) -> str:
    return f"""
with g as (select event_type as stage, sum(value) as s, count(value) as c from events group by 1),
f as (select *, first_value(s) over (order by {order}, stage) as first from g)
select stage, round(s, 2) as total, c as count, round_even(s / first * 100, 1) as conversion_pct,
  round_even(100 - round_even(s / first * 100, 1), 1) as drop_off_pct from f"""


@query(_funnel_sql("case stage when 'signup' then 0 when 'view' then 1 when 'click' then 2 when 'purchase' then 3 else 999 end"))
def funnel(t):
    return rounded(analytics.funnel(t.events, "event_type", "value", STAGES), total=2)


@query(_funnel_sql("s desc"))
def funnel_by_total(t):
    return rounded(analytics.funnel(t.events, "event_type", "value"), total=2)


def _segment_sql(table: str, seg: str, cols) -> str:
    return union_all(
        f"""select cast({seg} as string) as segment, count(*) as row_count, '{c}' as metric, round(avg({c}), 4) as mean, round(sum({c}), 2) as sum,
  round(min({c}), 2) as min, round(max({c}), 2) as max from {table} where {seg} is not null group by {seg} having count({c}) > 0""" for c in cols)


@query(_segment_sql("customer", "c_mktsegment", ["c_custkey", "c_nationkey", "c_acctbal"]))
def segment(t):
    return rounded(analytics.segment(t.customer, "c_mktsegment"), mean=4, sum=2, min=2, max=2)


@query(_segment_sql(SQL_GAPS, "l_quantity", ["l_tax", "l_discount"]))
def segment_omits_empty(t):
    return rounded(analytics.segment(gaps(t), "l_quantity", ["l_tax", "l_discount"]), mean=4, sum=2, min=2, max=2)


@query("""
with g as (select n_name, sum(o_totalprice) as s from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1),
p as (select n_name, round(s, 2) as o_totalprice, round_even(s / (select sum(s) from g) * 100, 2) as pct from g)
select * from p order by pct desc, o_totalprice desc, n_name limit 20""")
def contribution(t):
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return rounded(analytics.contribution(joined, "n_name", "o_totalprice"), o_totalprice=2)


COMPARED = """
round({a}_mean, 4) as a_mean, round({b}_mean, 4) as b_mean, round({a}_sum, 2) as a_sum, round({b}_sum, 2) as b_sum, round({a}_std, 4) as a_std,
  round({b}_std, 4) as b_std, round(round_even((b_mean - a_mean) / abs(a_mean) * 100, 2), 2) as mean_diff_pct""".format(a="a", b="b")


@query(f"""
select 'acctbal' as metric, a_rows, 3 as a_cols, b_rows, 2 as b_cols, 'acctbal,nation' as common_columns, {COMPARED}
from (select count(*) a_rows, avg(c_acctbal) a_mean, sum(c_acctbal) a_sum, stddev_samp(c_acctbal) a_std from customer),
     (select count(*) b_rows, avg(s_acctbal) b_mean, sum(s_acctbal) b_sum, stddev_samp(s_acctbal) b_std from supplier)""")
def compare_datasets(t):
    out = analytics.compare_datasets(_customers(t), _suppliers(t), "acctbal")
    return all_rounded(out.withColumn("common_columns", F.array_join("common_columns", ",")), 4).withColumns(
        {"a_sum": F.round("a_sum", 2), "b_sum": F.round("b_sum", 2)})


def _customers(t):
    return t.customer.select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("acctbal"), "c_mktsegment")


def _suppliers(t):
    return t.supplier.select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("acctbal"))


@query(f"""
with a as (select c_nationkey nation, count(*) a_rows, avg(c_acctbal) a_mean, sum(c_acctbal) a_sum, stddev_samp(c_acctbal) a_std from customer group by 1),
b as (select s_nationkey nation, count(*) b_rows, avg(s_acctbal) b_mean, sum(s_acctbal) b_sum, stddev_samp(s_acctbal) b_std from supplier group by 1)
select coalesce(a.nation, b.nation) as nation, cast(coalesce(a_rows, 0) as bigint) as a_rows, cast(coalesce(b_rows, 0) as bigint) as b_rows, {COMPARED}
from a full outer join b on a.nation = b.nation""")
def compare_by_group(t):
    out = analytics.compare_datasets(_customers(t), _suppliers(t), "acctbal", "nation")
    out = out.drop("metric", "a_cols", "b_cols", "common_columns").fillna(0, ["a_rows", "b_rows"])
    return all_rounded(out, 4).withColumns({"a_sum": F.round("a_sum", 2), "b_sum": F.round("b_sum", 2)})


def _growth_sql(table: str, time: str, value: str) -> str:
    return f"""
with r as (select {value} v, row_number() over (order by {time}, {value}) rn, count(*) over () n from {table})
select round_even((sum(case when rn > n // 2 then v end) - sum(case when rn <= n // 2 then v end))
  / abs(sum(case when rn <= n // 2 then v end)) * 100, 2) as growth_rate from r"""


@query(_growth_sql("events", "ts", "value"))
def growth_rate(t):
    return timeseries.growth_rate(t.events, "ts", "value")


# --- declarative questions: one per intent --------------------------------------------

SPECS = {
    "query_spec_trend": (
        "orders", {
            "time_range": {"column": "o_orderdate", "start": "1996-01-01", "end": "1998-01-01"},
            "group_by": ["o_orderdate"], "metrics": [{"column": "o_totalprice", "func": "sum", "alias": "revenue"}],
            "order_by": [{"column": "o_orderdate"}], "limit": 500},
        """select strftime(o_orderdate, '%Y-%m-%d') as o_orderdate, round(sum(o_totalprice), 2) as revenue from orders
           where o_orderdate >= timestamp '1996-01-01' and o_orderdate < timestamp '1998-01-01' group by orders.o_orderdate order by orders.o_orderdate limit 500"""),
    "query_spec_comparison": (
        "events", {
            "group_by": ["event_type"], "metrics": [
                {"column": "value", "func": "mean", "alias": "average"}, {"column": "value", "func": "median", "alias": "middle"},
                {"column": "user_id", "func": "nunique", "alias": "users"}, {"column": "*", "func": "count", "alias": "n"}]},
        """select event_type, round(avg(value), 4) as average, round(median(value), 4) as middle, count(distinct user_id) as users, count(*) as n
           from events group by 1"""),
    "query_spec_ranking": (
        "lineitem", {
            "filters": [{"column": "l_returnflag", "operator": "eq", "value": "R"}, {"column": "l_discount", "operator": "gt", "value": 0.02}],
            "group_by": ["l_suppkey"], "metrics": [{"column": "l_extendedprice", "func": "sum", "alias": "revenue"}],
            "having": [{"column": "revenue", "operator": "gt", "value": 1000}],
            "order_by": [{"column": "revenue", "ascending": False}, {"column": "l_suppkey"}], "limit": 10},
        """select l_suppkey, round(sum(l_extendedprice), 2) as revenue from lineitem where l_returnflag = 'R' and l_discount > 0.02
           group by 1 having sum(l_extendedprice) > 1000 order by sum(l_extendedprice) desc, 1 limit 10"""),
    "query_spec_distribution": (
        "lineitem", {
            "group_by": ["l_quantity"], "metrics": [{"column": None, "func": "count", "alias": "n"}],
            "order_by": [{"column": "l_quantity"}]},
        "select l_quantity, count(*) as n from lineitem group by 1"),
    "query_spec_aggregation": (
        "lineitem", {
            "filters": [{"column": "l_linestatus", "operator": "in", "value": ["O"]}],
            "metrics": [{"column": "l_quantity", "func": "sum", "alias": "quantity"}, {"column": "l_tax", "func": "max", "alias": "tax"},
                        {"column": "l_extendedprice", "func": "median", "alias": "price"}]},
        """select round(sum(l_quantity), 2) as quantity, max(l_tax) as tax, round(median(l_extendedprice), 4) as price from lineitem where l_linestatus = 'O'"""),
    "query_spec_sql": (
        "orders", "SELECT o_orderpriority, corr(o_totalprice, o_custkey) AS r, count(*) AS n FROM {df} GROUP BY o_orderpriority",
        "select o_orderpriority, round(corr(o_totalprice, o_custkey), 4) as r, count(*) as n from orders group by 1"),
}


def _register(name, table, spec, sql):
    def run(t):
        out = analytics.query_spec(getattr(t, table), spec)
        out = out.withColumn("o_orderdate", day("o_orderdate")) if "o_orderdate" in out.columns else out
        return rounded(out, **{c: 2 if c in ("revenue", "quantity") else 4 for c, k in out.dtypes if k == "double"})

    query(sql, name)(run)


for _name, (_table, _spec, _sql) in SPECS.items():
    _register(_name, _table, _spec, _sql)


# --- findings -------------------------------------------------------------------------

PAIR_SQL = union_all(
    f"select {i} a, {j} b, '{x}' x, '{y}' y, corr({x}, {y}) r from {SQL_GAPS}"
    for i, x in enumerate(LINE_NUMBERS) for j, y in enumerate(LINE_NUMBERS) if i < j)
OUTLIER_SQL = union_all(
    f"""select '{c}' c, count(*) filter ({c} < q1 - 1.5 * (q3 - q1) or {c} > q3 + 1.5 * (q3 - q1)) k, count({c}) n
from {SQL_GAPS}, (select quantile_cont({c}, 0.25) q1, quantile_cont({c}, 0.75) q3 from {SQL_GAPS})""" for c in LINE_NUMBERS)
MISSING_SQL = union_all(
    f"select '{c}' c, count(*) - count({c}) k, count(*) n from {SQL_GAPS}"
    for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"))


FINDINGS = """
  select 1 as place, abs(r) as size, 'diagnostic' as category, x || ' and ' || y || ' move together' as title,
    '''' || x || ''' ↔ ''' || y || ''': ' || case when r > 0 then 'positive' else 'negative' end || ' (' || printf('%.2f', r) || ')' as description,
    x || ',' || y as related, '{"corr":"' || printf('%.4f', r) || '"}' as supporting,
    'Check whether ''' || x || ''' drives ''' || y || ''' or both follow something else.' as action from p
  union all
  select 2, k / n, 'anomaly', 'Outliers in ' || c, k || ' values (' || printf('%.2f', round_even(k / n * 100, 2)) || '%) lie outside the fences of ''' || c || '''', c,
    '{"outlier_count":"' || k || '","outlier_pct":"' || printf('%.2f', round_even(k / n * 100, 2)) || '"}',
    'Review the rows of ''' || c || ''' beyond the fences before averaging it.' from o where k > 0
  union all
  select 3, k / n, 'descriptive', 'Missing values in ' || c, '''' || c || ''' has ' || printf('%.2f', round_even(k / n * 100, 2)) || '% missing values', c,
    '{"missing_count":"' || k || '","missing_pct":"' || printf('%.2f', round_even(k / n * 100, 2)) || '"}',
    'Fill ''' || c || ''' or leave its empty rows out.' from m where k > 0"""
RANKED_FINDINGS = """
select category, title, description, related, supporting, action, 0.8::double as confidence,
  cast(row_number() over (order by place, size desc, title) as int) as priority from f"""


def _findings(out):
    return out.select(
        "category", "title", "description", F.array_join("related_columns", ",").alias("related"), F.to_json("supporting_data").alias("supporting"),
        F.array_join("action_items", "|").alias("action"), "confidence", "priority")


@query(f"with p as (select * from ({PAIR_SQL}) order by abs(r) desc, a, b limit 5), o as ({OUTLIER_SQL}), m as ({MISSING_SQL}), f as ({FINDINGS}){RANKED_FINDINGS}")
def insight_findings(t):
    return _findings(analytics.insight_findings(gaps(t), LINE_NUMBERS))


#: The line items with a column that grows with the shipping date, beside those that do not.
DATED = ["l_quantity", "l_discount", "l_tax", "l_age"]
SQL_DATED = f"(select l_shipdate, l_quantity, l_discount, l_tax, date_diff('day', date '1992-01-01', cast(l_shipdate as date)) + l_quantity as l_age from {SQL_GAPS})"
DATED_PAIRS = union_all(
    f"select {i} a, {j} b, '{x}' x, '{y}' y, corr({x}, {y}) r from {SQL_DATED}" for i, x in enumerate(DATED) for j, y in enumerate(DATED) if i < j)
DATED_OUTLIERS = union_all(
    f"""select '{c}' c, count(*) filter ({c} < q1 - 1.5 * (q3 - q1) or {c} > q3 + 1.5 * (q3 - q1)) k, count({c}) n
from {SQL_DATED}, (select quantile_cont({c}, 0.25) q1, quantile_cont({c}, 0.75) q3 from {SQL_DATED})""" for c in DATED)
DATED_MISSING = union_all(f"select '{c}' c, count(*) - count({c}) k, count(*) n from {SQL_DATED}" for c in ["l_shipdate", *DATED])
DATED_TRENDS = union_all(
    f"""select '{c}' c, regr_slope(v, i) s, corr(v, i) r, count(*) n
from (select {c} v, row_number() over (order by l_shipdate, {c}) - 1 i from {SQL_DATED} where {c} is not null)""" for c in DATED)


@query(f"""
with p as (select * from ({DATED_PAIRS}) order by abs(r) desc, a, b limit 5), o as ({DATED_OUTLIERS}), m as ({DATED_MISSING}),
t as (select *, round_even({sql_p_value("r", "n")}, 6) as pv, round_even(r * r, 4) as r2, case when s > 0 then 'upward' else 'downward' end as way from ({DATED_TRENDS})),
ranked as (select *, pv * count(*) over () / row_number() over (order by pv) as rate from t),
rated as (select *, least(min(rate) over (order by pv desc), 1.0) as q from ranked),
f as ({FINDINGS}
  union all
  select 4, r2, 'predictive', upper(way[1]) || way[2:] || ' trend in ' || c,
    '''' || c || ''' shows a ' || case when abs(r) > 0.7 then 'strong' when abs(r) > 0.4 then 'moderate' else 'weak' end || ' ' || way || ' trend', c,
    '{{"slope":"' || printf('%.6f', round_even(s, 6)) || '","r_squared":"' || printf('%.4f', r2) || '","q_value":"' || printf('%.6f', q) || '"}}',
    'Plan for ''' || c || ''' going on ' || way || '.' from rated where q <= 0.05){RANKED_FINDINGS}""")
def insight_trends(t):
    age = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")) + F.col("l_quantity")
    dated = gaps(t).select("l_shipdate", "l_quantity", "l_discount", "l_tax", age.alias("l_age"))
    return _findings(analytics.insight_findings(dated, DATED, "l_shipdate"))


# --- the same analyses by name --------------------------------------------------------


@query(_segment_sql("customer", "c_mktsegment", ["c_acctbal"]), name="analyze_segment")
def analyze_by_name(t):
    out = analyze(t.customer, "segment", segment_col="c_mktsegment", metric_cols=["c_acctbal"])
    return rounded(out, mean=4, sum=2, min=2, max=2)
