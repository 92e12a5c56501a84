"""Chart data, chart eligibility over the catalog of all tables, dashboard."""

from pyspark.sql import functions as F

from quillframe.operators import charts
from quillframe.sources.catalog import catalog_profiles
from workload.base import (
    LINE_NUMBERS, SQL_GAPS, SQL_ORDERS, TABLES, all_rounded, day, gaps, instant, plain_orders, query, rounded, sql_instant,
    union_all,
)


def _top(label: str, value: str, table: str, k: int, more: str = "") -> str:
    return f"""
select {label} as label, round(sum({value}), 2) as value{more} from {table} where {label} is not null group by 1 order by sum({value}) desc, 1 limit {k}"""


@query(_top("p_name", "p_retailprice", "part", 30))
def chart_bar(t):
    return rounded(charts.chart_bar(t.part, "p_name", "p_retailprice"), value=2)


@query(f"""
with r as (select ts, value, row_number() over (order by ts, value) - 1 i, count(*) over () n from events)
select {sql_instant("ts")} as ts, value from r where i % greatest(ceil(n / 150), 1) = 0""")
def chart_line(t):
    return charts.chart_line(t.events, "ts", "value").withColumn("ts", instant("ts"))


@query("""
with r as (select o_orderdate, o_totalprice, o_orderkey, row_number() over (order by o_orderdate, o_orderkey) - 1 i, count(*) over () n from orders)
select strftime(r.o_orderdate, '%Y-%m-%d') as o_orderdate, o_totalprice, o_orderkey from r where i % greatest(ceil(n / 150), 1) = 0""")
def chart_area(t):
    out = charts.chart_area(t.orders, "o_orderdate", "o_totalprice", key=["o_orderkey"])
    return out.withColumn("o_orderdate", day("o_orderdate"))


def _pie(label: str, value: str, table: str) -> str:
    return f"""
with x as (select {label} as label, sum({value}) s from {table} group by 1 order by s desc, 1 limit 12)
select label, round(s, 2) as value, round_even(s / sum(s) over () * 100, 1) as pct from x"""


@query(_pie("c_mktsegment", "c_acctbal", "customer"))
def chart_pie(t):
    return rounded(charts.chart_pie(t.customer, "c_mktsegment", "c_acctbal"), value=2)


@query(_pie("p_brand", "p_retailprice", "part"))
def chart_donut(t):
    return rounded(charts.chart_donut(t.part, "p_brand", "p_retailprice"), value=2)


@query(f"""
select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_tax from {SQL_GAPS} where l_tax is not null
order by md5('42|' || l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey), l_orderkey, l_linenumber, l_partkey, l_suppkey limit 1000""")
def chart_scatter(t):
    return charts.chart_scatter(gaps(t), "l_quantity", "l_tax", key=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])


@query("""
select p_partkey, p_size, p_retailprice from part order by md5('42|' || p_partkey), p_partkey limit 500""")
def chart_bubble(t):
    return charts.chart_bubble(t.part, "p_size", "p_retailprice", "p_partkey", key=["p_partkey"])


@query(union_all(
    f"select '{a}' as column_a, '{b}' as column_b, 1.0::double as corr" if a == b else
    f"select '{a}' as column_a, '{b}' as column_b, round_even(corr({a}, {b}), 3) as corr from {SQL_GAPS}"
    for a in LINE_NUMBERS for b in LINE_NUMBERS))
def chart_heatmap(t):
    return charts.chart_heatmap(gaps(t), LINE_NUMBERS)


def _histogram(c: str, table: str) -> str:
    shape = f"(select min({c}) lo, max({c}) hi, least(30, greatest(5, count(distinct {c}))) b from {table})"
    return f"""
select cast(i as int) as bin, round_even(lo + (i + 0.5::double) * (hi - lo) / b, 4) as mid, cast(coalesce(n, 0) as bigint) as n
from {shape}, lateral (select unnest(range(b)) i)
left join (select least(floor(({c} - lo) / (hi - lo) * b), b - 1) g, count(*) n from {table}, {shape} where {c} is not null group by 1) on g = i"""


@query(_histogram("l_extendedprice", "lineitem"))
def chart_histogram(t):
    return charts.chart_histogram(t.lineitem, "l_extendedprice")


def _box(name: str, value: str, table: str, group: str) -> str:
    q = ", ".join(f"round(quantile_cont({value}, {p}), 4) as {n}" for p, n in ((0, "min"), (0.25, "q1"), (0.5, "median"), (0.75, "q3"), (1, "max")))
    return f"select {name} as name, {q} from {table} {group}"


@query(_box("event_type", "value", "events", "group by 1"))
def chart_boxplot(t):
    return all_rounded(charts.chart_boxplot(t.events, "value", "event_type"), 4)


@query(_box("'l_tax'", "l_tax", SQL_GAPS, ""))
def chart_boxplot_overall(t):
    return all_rounded(charts.chart_boxplot(gaps(t), "l_tax"), 4)


@query(f"""
with m as ({union_all(f"select '{c}' as axis, avg({c}) a, max({c}) h from {SQL_GAPS}" for c in LINE_NUMBERS)}),
r as (select min(a) lo, max(a) hi from m)
select axis, round_even((a - lo) / (hi - lo) * 100, 2) as value, h as axis_max from m, r""")
def chart_radar(t):
    return charts.chart_radar(gaps(t), LINE_NUMBERS)


@query(_top("p_name", "p_retailprice", "part", 40))
def chart_treemap(t):
    return rounded(charts.chart_treemap(t.part, "p_name", "p_retailprice"), value=2)


@query(f"""
with f as (select o_orderkey, o_orderdate, o_totalprice from {SQL_ORDERS} order by o_orderkey limit 20)
select o_orderdate as label, o_totalprice as value, round(sum(o_totalprice) over (order by o_orderkey) - o_totalprice, 2) as start,
  round(sum(o_totalprice) over (order by o_orderkey), 2) as "end" from f""")
def chart_waterfall(t):
    return rounded(charts.chart_waterfall(plain_orders(t), "o_orderdate", "o_totalprice", ["o_orderkey"]), start=2, end=2)


@query(_top("event_type", "value", "events", 12))
def chart_funnel(t):
    return rounded(charts.chart_funnel(t.events, "event_type", "value"), value=2)


CANDLES = """
select date_trunc('day', o_orderdate) d, min_by(o_totalprice, (o_orderdate, o_orderkey)) as open, max(o_totalprice) as high,
  min(o_totalprice) as low, max_by(o_totalprice, (o_orderdate, o_orderkey)) as "close" from orders group by 1"""


@query(f"""select strftime(d, '%Y-%m-%d') as date, open, high, low, "close" from ({CANDLES}) order by d limit 200""")
def chart_candlestick(t):
    candles = charts.ohlc(t.orders, "o_orderdate", "o_totalprice", "1 day", key=["o_orderkey"])
    return charts.chart_candlestick(candles, "date", "open", "high", "low", "close").withColumn("date", day("date"))


@query("""
select event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S.%f') as date, min_by(value, (ts, event_id)) as open, max(value) as high,
  min(value) as low, max_by(value, (ts, event_id)) as "close" from events group by event_type, date_trunc('hour', ts)""")
def ohlc(t):
    return charts.ohlc(t.events, "ts", "value", "1 hour", key=["event_id"], by=["event_type"]).withColumn("date", instant("date"))


@query("select 'value' as label, round(avg(value), 4) as value, min(value) as min, max(value) as max, round_even(avg(value) / max(value) * 100, 0) as pct from events")
def chart_gauge(t):
    return rounded(charts.chart_gauge(t.events, "value"), value=4)


LINKS = """
select o_orderpriority as source, c_mktsegment as target, round(sum(o_totalprice), 2) as value
from orders join customer on o_custkey = c_custkey group by 1, 2 order by 1, 2 limit 50"""


def _links(t):
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return charts.chart_sankey(joined, "o_orderpriority", "c_mktsegment", "o_totalprice")


@query(LINKS)
def chart_sankey(t):
    return rounded(_links(t), value=2)


@query(f"select source as name from ({LINKS}) union select target from ({LINKS})")
def sankey_nodes(t):
    return charts.sankey_nodes(_links(t))


@query("""
with s as (select event_type g, count(*) n, stddev_samp(value) * pow(count(*), -0.2::double) h, min(value) lo, (max(value) - min(value)) / 49 step,
             quantile_cont(value, 0.25) q1, median(value) q2, quantile_cont(value, 0.75) q3 from events group by 1),
p as (select *, i, lo + step * i as x from s, (select unnest(range(50)) i))
select g as name, cast(i as int) as point, round_even(x, 4) as x,
  round_even(sum(exp(-0.5::double * pow((value - x) / h, 2))) / (n * h * sqrt(2 * pi())), 6) as density,
  round(q1, 4) as q1, round(q2, 4) as median, round(q3, 4) as q3
from p join events on event_type = g group by g, i, x, n, h, q1, q2, q3""")
def chart_violin(t):
    return rounded(charts.chart_violin(t.events, "value", "event_type"), q1=4, median=4, q3=4)


SHOWN = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


@query(f"""
select {", ".join(f"coalesce(cast({c} as string), '') as {c}" for c in SHOWN)}
from {SQL_GAPS} x order by x.l_orderkey, x.l_linenumber, x.l_partkey, x.l_suppkey, x.l_quantity limit 200""")
def chart_table(t):
    return charts.chart_table(gaps(t), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"])


# --- catalog of all tables ------------------------------------------------------------

# Columns by type, as in the table descriptions; string columns are classified by the SQL.
NUMBERS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey", "n_regionkey"], "customer": ["c_custkey", "c_nationkey", "c_acctbal"],
    "supplier": ["s_suppkey", "s_nationkey", "s_acctbal"], "part": ["p_partkey", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_totalprice"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"],
    "events": ["event_id", "user_id", "value"], "documents": ["doc_id", "n_chars"], "embeddings": ["vec_id", "label"],
    "pages": ["page_id"], "benchmark": ["item_id"], "labels": ["doc_id", "quality", "toxic"], "conversations": ["conv_id", "turn"],
}
STRINGS = {
    "region": ["r_name"], "nation": ["n_name"], "customer": ["c_name", "c_mktsegment"], "supplier": ["s_name"],
    "part": ["p_name", "p_brand", "p_type"], "orders": ["o_orderstatus", "o_orderpriority"], "lineitem": ["l_returnflag", "l_linestatus"],
    "events": ["event_type", "props"], "documents": ["text", "lang", "source"], "pages": ["url", "html"], "benchmark": ["text"],
    "conversations": ["role", "text"],
}
DATES = {"orders": "o_orderdate", "lineitem": "l_shipdate", "events": "ts"}


def _roles_sql(name: str) -> str:
    nums = "[" + ", ".join(f"'{c}'" for c in NUMBERS[name]) + "]"
    strings = STRINGS.get(name, [])
    cats = "[" + ", ".join(
        f"case when avg(length({c})) <= 40 then {{'name': '{c}', 'u': count(distinct {c})}} end" for c in strings) + "]" if strings else "[null::struct(name varchar, u bigint)]"
    date = DATES.get(name)
    return f"""select '{name}' as dataset_id, count(*) as n, {nums} as nums, [x for x in {cats} if x is not null] as cats,
  {f"'{date}'" if date else "null"} as date, {f"count(distinct {date})" if date else "null"} as date_u from {name}"""


ROLES = f"""
select dataset_id, n, len(nums) k, len(cats) c, nums, cats, date, date is not null as d,
  cats[1].name as cat, cats[1].u as cat_u, [x for x in cats if x.u <= 10] as low,
  '[' || array_to_string([cast(x.u as string) for x in cats], ', ') || ']' as sizes from ({union_all(_roles_sql(n) for n in TABLES)})"""


def _rule_sql(kind: str, least: int, *rules: tuple[str, str, str]) -> str:
    every = [(f"n < {least}", f"'{kind} requires ≥{least} rows; dataset has ' || n || '.'", "'table'"), *rules]
    reason = " ".join(f"when {test} then {why}" for test, why, _ in every)
    instead = " ".join(f"when {test} then {alt}" for test, _, alt in every)
    return f"select dataset_id, '{kind}' as kind, case {reason} else '' end as reason, case {instead} end as alternative from roles"


NEED_NUMBER = ("k = 0", "'Needs ≥1 numeric column.'")
LINE_RULES = [(*NEED_NUMBER, "'table'"), ("not d and c = 0", "'Needs a datetime or categorical x-axis.'", "'scatter'")]
PIE_RULES = [(*NEED_NUMBER, "'table'"), ("len(low) = 0", "'Needs a categorical column with ≤10 unique values. Found cardinalities: ' || sizes || '.'", "'bar'")]
RULES = union_all([
    _rule_sql("bar", 2, (*NEED_NUMBER, "'table'"), ("c = 0 and not d", "'Needs a categorical or datetime x-axis.'", "'histogram'")),
    _rule_sql("line", 2, *LINE_RULES),
    _rule_sql("area", 2, *LINE_RULES),
    _rule_sql("pie", 2, *PIE_RULES),
    _rule_sql("donut", 2, *PIE_RULES),
    _rule_sql("scatter", 2, ("k < 2", "'Needs ≥2 numeric columns; found ' || k || '.'", "case when k > 0 then 'histogram' else 'table' end")),
    _rule_sql("bubble", 2, ("k < 3", "'Needs ≥3 numeric columns (x, y, size); found ' || k || '.'", "'scatter'")),
    _rule_sql("heatmap", 4, ("k < 2", "'Needs ≥2 numeric columns for correlation matrix.'", "'bar'")),
    _rule_sql("histogram", 2, (*NEED_NUMBER, "'bar'")),
    _rule_sql("boxplot", 10, (*NEED_NUMBER, "'histogram'")),
    _rule_sql("radar", 3, ("k < 3", "'Needs ≥3 numeric columns for axes; found ' || k || '.'", "case when k > 0 then 'bar' else 'table' end")),
    _rule_sql("treemap", 2, ("k = 0 or c = 0", "'Needs ≥1 categorical and ≥1 numeric column.'", "'bar'")),
    _rule_sql("waterfall", 2, ("k = 0 or (c = 0 and not d)", "'Needs a numeric column and a category/date column.'", "'bar'")),
    _rule_sql("funnel", 2, ("k = 0 or c = 0", "'Needs a stage (categorical) and value (numeric) column.'", "'bar'"),
              ("cat_u > 12", "'Funnel needs ≤12 stages; ''' || cat || ''' has ' || cat_u || '.'", "'bar'")),
    _rule_sql("candlestick", 5, ("k < 4", "'Needs 4 numeric columns (open, high, low, close); found ' || k || '.'", "'line'")),
    _rule_sql("gauge", 2, (*NEED_NUMBER, "'table'")),
    _rule_sql("sankey", 5, ("c < 2 or k = 0", "'Needs 2 categorical columns (source, target) and 1 numeric column.'", "'bar'")),
    _rule_sql("violin", 30, (*NEED_NUMBER, "'histogram'")),
    _rule_sql("table", 2),
])
ELIGIBLE = f"with roles as ({ROLES}), e as ({RULES})"


def _profiles(t):
    return catalog_profiles({name: getattr(t, name) for name in TABLES})


@query(f"""
{ELIGIBLE}
select dataset_id, kind, reason = '' as is_valid, reason, alternative,
  case when reason = '' and kind = 'bar' then coalesce(cat, date) when reason = '' and kind = 'heatmap' then array_to_string(nums[1:8], ',')
       when reason = '' and kind = 'pie' then low[1].name when reason = '' and kind = 'line' then coalesce(date, cat) end as main,
  case when reason = '' and kind = 'bar' and coalesce(cat_u, date_u) > 50
       then '''' || coalesce(cat, date) || ''' has ' || coalesce(cat_u, date_u) || ' categories — top 20 shown.' end as warning
from e join (select dataset_id, cat, date, nums, low, cat_u, u as date_u from roles join (
  select dataset_id i, date_u u from ({union_all(_roles_sql(n) for n in TABLES)})) on i = dataset_id) using (dataset_id)""")
def chart_eligibility(t):
    out = charts.chart_eligibility(_profiles(t))
    keys = {"bar": "x", "line": "x", "heatmap": "matrix", "pie": "label"}
    main = F.lit(None).cast("string")
    for kind, key in keys.items():
        main = F.when(F.col("kind") == kind, F.col("columns")[key]).otherwise(main)
    return out.select("dataset_id", "kind", "is_valid", "reason", "alternative", main.alias("main"), F.try_element_at("warnings", F.lit(1)).alias("warning"))


@query(f"""
{ELIGIBLE},
i(intent, kinds) as (values ('trend', ['line', 'area']), ('comparison', ['bar', 'radar']), ('distribution', ['histogram', 'violin', 'boxplot']),
  ('correlation', ['scatter', 'heatmap']), ('part-whole', ['pie', 'donut', 'treemap', 'funnel']), ('ranking', ['bar', 'treemap']),
  ('flow', ['sankey', 'waterfall']), ('financial', ['candlestick', 'line']), ('kpi', ['gauge']), ('general', ['bar', 'line']))
select roles.dataset_id, intent, coalesce(
    (select min_by(kind, list_position(kinds, kind)) from e where e.dataset_id = roles.dataset_id and reason = '' and list_contains(kinds, kind)),
    case when d and k > 0 then 'line' when c > 0 and k > 0 then 'bar' when k >= 2 then 'scatter' when k > 0 then 'histogram' else 'table' end) as kind
from roles, i""")
def chart_auto_select(t):
    return charts.chart_auto_select(_profiles(t))


@query(f"""
{ELIGIBLE}
select dataset_id, kind as requested, case when reason = '' then kind else coalesce(alternative, 'table') end as kind,
  nullif(reason, '') as fallback_reason from e""")
def chart_requests(t):
    return charts.chart_requests(_profiles(t))


SUMS = union_all(
    f"select 'kpis' as chart, '{c}' as label, 'sum' as series, round(sum({c}), 4) as value from customer" for c in NUMBERS["customer"])
HEAT = union_all(
    f"select 'heatmap' as chart, '{a}' as label, '{b}' as series, 1.0::double as value" if a == b else
    f"select 'heatmap' as chart, '{a}' as label, '{b}' as series, round_even(corr({a}, {b}), 3) as value from customer"
    for a in NUMBERS["customer"] for b in NUMBERS["customer"])
AXES = union_all(f"select '{c}' as axis, avg({c}) a from customer" for c in NUMBERS["customer"])


@query(f"""
select 'bar' as chart, label, 'sum' as series, value from ({_top("c_name", "c_custkey", "customer", 30)})
union all select 'histogram', cast(cast(mid as decimal(20, 4)) as string), 'frequency', n from ({_histogram("c_custkey", "customer")})
union all select 'scatter', cast(c_custkey as string), 'c_nationkey', c_nationkey from (
  select * from customer order by md5('42|' || c_custkey), c_custkey limit 1000)
union all select 'pie', label, 'sum', value from ({_pie("c_mktsegment", "c_custkey", "customer")})
union all {HEAT}
union all select 'radar', axis, 'average', round_even((a - lo) / (hi - lo) * 100, 2) from ({AXES}), (select min(a) lo, max(a) hi from ({AXES}))
union all {SUMS}""")
def dashboard_data(t):
    out = charts.dashboard_data(t.customer, key=["c_custkey"])
    mids = F.when(F.col("chart") == "histogram", F.col("label").cast("decimal(20,4)").cast("string")).otherwise(F.col("label"))
    return rounded(out.withColumn("label", mids), value=4)
