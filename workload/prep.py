"""Cleaning steps."""

from pyspark.sql import functions as F

from quillframe.operators import blocks, prep
from quillframe.plans.steps import run_steps
from quillframe.session import write_out
from workload.base import (
    SQL_GAPS, SQL_ORDERS, all_rounded, gaps, plain_orders, query, rounded,
)

LINE_NAMES = "l_orderkey, l_partkey, l_suppkey, l_linenumber"


@query(f"select * exclude (l_tax) from {SQL_GAPS}")
def drop_high_null(t):
    return prep.drop_high_null(gaps(t), threshold_pct=80)


@query("select distinct lang, source, text from documents")
def deduplicate(t):
    return prep.deduplicate(t.documents.select("lang", "source", "text"))


@query(f"""
select * exclude (rn) from (
  select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) rn from {SQL_ORDERS}) where rn = 1""")
def deduplicate_subset(t):
    return prep.deduplicate(plain_orders(t), subset=["o_custkey"], order_by=["o_orderdate", "o_orderkey"])


@query("""
select o_orderkey, cast(o_custkey as string) as o_custkey,
  case when o_orderstatus = 'P' then null else o_totalprice end as price,
  case when o_orderstatus = 'P' then null else strftime(o_orderdate, '%Y-%m-%d') end as placed,
  o_totalprice <> 0 as paid, length(o_orderpriority) > 0 as ranked
from orders""")
def type_cast(t):
    text = t.orders.select(
        "o_orderkey", "o_custkey",
        F.when(F.col("o_orderstatus") == "P", "bad").otherwise(F.col("o_totalprice").cast("string")).alias("price"),
        F.when(F.col("o_orderstatus") == "P", "bad").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("placed"),
        F.col("o_totalprice").alias("paid"), F.col("o_orderpriority").alias("ranked"))
    out = prep.type_cast(text, {
        "o_custkey": "string", "price": "numeric", "placed": "datetime", "paid": "boolean", "ranked": "boolean", "absent": "numeric"})
    return out.withColumn("placed", F.date_format("placed", "yyyy-MM-dd"))


@query(f"""
with f as (select quantile_cont(l_extendedprice, 0.25) q1, quantile_cont(l_extendedprice, 0.75) q3,
                  quantile_cont(l_discount, 0.25) d1, quantile_cont(l_discount, 0.75) d3 from {SQL_GAPS})
select {LINE_NAMES},
  round(greatest(least(l_extendedprice, q3 + 1.5 * (q3 - q1)), q1 - 1.5 * (q3 - q1)), 4) as l_extendedprice,
  case when l_discount is not null then round(greatest(least(l_discount, d3 + 1.5 * (d3 - d1)), d1 - 1.5 * (d3 - d1)), 4) end as l_discount
from {SQL_GAPS}, f""")
def outlier_clip(t):
    rows = gaps(t).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_discount")
    return all_rounded(prep.outlier_clip(rows, "iqr", ["l_extendedprice", "l_discount"]), 4)


@query("""
with f as (select avg(value) m, stddev_samp(value) s from events)
select event_id, round(greatest(least(value, m + 3 * s), m - 3 * s), 4) as value from events, f""")
def outlier_clip_zscore(t):
    return all_rounded(prep.outlier_clip(t.events.select("event_id", "value"), "zscore", ["value"]), 4)


@query(f"""
with f as (select median(l_discount) d, median(l_tax) x from {SQL_GAPS}),
m as (select l_returnflag v from {SQL_GAPS} where l_returnflag is not null group by 1 order by count(*) desc, 1 limit 1)
select * exclude (d, x, v) replace (round(coalesce(l_discount, d), 4) as l_discount, round(coalesce(l_tax, x), 4) as l_tax,
                                    coalesce(l_returnflag, v) as l_returnflag)
from {SQL_GAPS}, f, m""")
def impute(t):
    return rounded(prep.impute(gaps(t)), l_discount=4, l_tax=4)


@query(f"""
with f as (select avg(l_discount) d, avg(l_tax) x from {SQL_GAPS})
select {LINE_NAMES}, round(coalesce(l_discount, d), 6) as l_discount, round(coalesce(l_tax, x), 6) as l_tax from {SQL_GAPS}, f""")
def impute_mean(t):
    rows = gaps(t).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_discount", "l_tax")
    return rounded(prep.impute(rows, "mean"), l_discount=6, l_tax=6)


@query(f"""
with f as (select min(l_quantity) a, max(l_quantity) b, min(l_extendedprice) c, max(l_extendedprice) d from lineitem)
select {LINE_NAMES}, round((l_quantity - a) / (b - a), 6) as l_quantity, round((l_extendedprice - c) / (d - c), 6) as l_extendedprice
from lineitem, f""")
def normalize(t):
    rows = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return all_rounded(prep.normalize(rows, columns=["l_quantity", "l_extendedprice"]), 6)


@query(f"""
with f as (select avg(l_quantity) a, stddev_samp(l_quantity) b, avg(l_extendedprice) c, stddev_samp(l_extendedprice) d from lineitem)
select {LINE_NAMES}, round((l_quantity - a) / b, 6) as l_quantity, round((l_extendedprice - c) / d, 6) as l_extendedprice
from lineitem, f""")
def normalize_zscore(t):
    rows = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return all_rounded(prep.normalize(rows, "zscore", ["l_quantity", "l_extendedprice"]), 6)


@query(f"""
select * from {SQL_GAPS}
where l_quantity >= 10 and l_quantity < 40 and (l_returnflag <> 'A' or l_returnflag is null)
  and l_linestatus in ('O', 'F') and regexp_matches(l_shipdate, '^199[67]')""")
def filter_rows(t):
    return prep.filter_rows(gaps(t), [
        {"column": "l_quantity", "operator": "gte", "value": 10},
        {"column": "l_quantity", "operator": "lt", "value": 40},
        {"column": "l_returnflag", "operator": "ne", "value": "A"},
        {"column": "l_linestatus", "operator": "in", "value": ["O", "F"]},
        {"column": "l_shipdate", "operator": "contains", "value": "^199[67]"},
        {"column": "absent", "operator": "eq", "value": 1},
        {"column": "l_tax", "operator": "near", "value": 1}])


@query(f"select o_orderkey as order_id, o_custkey as customer, * exclude (o_orderkey, o_custkey) from {SQL_ORDERS}")
def rename_columns(t):
    return prep.rename_columns(plain_orders(t), {"o_orderkey": "order_id", "o_custkey": "customer", "absent": "x"})


@query(f"""
select *, row_number() over (order by l_returnflag desc nulls last, l_discount asc nulls last, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as place from {SQL_GAPS}""")
def sort(t):
    """The order is checked too: rows are numbered as they come out of the sorted table, part by part."""
    keys = ["l_returnflag", "l_discount", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "absent"]
    ordered = prep.sort(gaps(t), keys, [False] + [True] * 8)
    placed = write_out(ordered.withColumn("_at", F.monotonically_increasing_id()), "sorted")
    return blocks.positions(placed, ["_at"]).withColumn("place", F.col("_pos") + 1).drop("_at", "_pos", "_part")


@query("""
select event_id, user_id, event_type, value from events
order by md5('42|' || cast(event_id as string)), event_id limit 1000""")
def sample(t):
    return prep.sample(t.events.select("event_id", "user_id", "event_type", "value"), n=1000, key=["event_id"])


@query("""
select o_orderkey, o_custkey, o_orderstatus from orders
order by md5('42|' || cast(o_orderkey as string)), o_orderkey
limit (select cast(round_even(count(*) * 0.05, 0) as bigint) from orders)""")
def sample_fraction(t):
    return prep.sample(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus"), frac=0.05, key=["o_orderkey"])


@query("""
with g as (select o_orderpriority p, least(count(*), greatest(1, 5000 * count(*) // (select count(*) from orders))) quota
           from orders group by 1),
r as (select o_orderkey, o_orderpriority, row_number() over (
        partition by o_orderpriority order by md5('42|' || cast(o_orderkey as string)), o_orderkey) rn from orders)
select o_orderkey, o_orderpriority from r join g on o_orderpriority = p where rn <= quota""")
def stratified_sample(t):
    rows = t.orders.select("o_orderkey", "o_orderpriority")
    return prep.stratified_sample(rows, key=["o_orderkey"], threshold=1000, size=5000)


@query("select event_id, case when value > 1 then value end as share, ln(greatest(value, 1)) * 0 + 1 as one from events")
def sanitize(t):
    odd = F.when(F.col("value") > 1, F.col("value")).when(F.col("value") > 0.5, float("nan")).when(
        F.col("value") > 0.1, float("inf")).otherwise(float("-inf"))
    return prep.sanitize(t.events.select("event_id", odd.alias("share"), F.lit(1.0).alias("one")))


@query("select o_orderkey as order_key, o_custkey as order_key_2, o_orderstatus as status_, o_totalprice as price_in__ from orders")
def sanitize_names(t):
    rows = t.orders.select(
        F.col("o_orderkey").alias("order key"), F.col("o_custkey").alias("order.key"), F.col("o_orderstatus").alias("status!"),
        F.col("o_totalprice").alias("price in $"))
    return prep.sanitize_names(rows)


STEP_LIST = [
    {"processor": "drop_high_null", "config": {"threshold_pct": 80}},
    {"processor": "filter_rows", "config": {"conditions": [{"column": "l_quantity", "operator": "gt", "value": 5}]}},
    {"processor": "impute", "config": {"strategy": "median"}},
    {"processor": "unheard_of"},
    {"processor": "normalize", "config": {"columns": ["l_quantity"]}},
    {"processor": "rename_columns", "config": {"mapping": {"l_quantity": "quantity"}}},
    {"processor": "sort", "config": {"by": ["l_orderkey", "l_linenumber"]}},
]


@query(f"""
with r as (select * exclude (l_tax) from {SQL_GAPS} where l_quantity > 5),
f as (select median(l_discount) d, min(l_quantity) a, max(l_quantity) b from r),
m as (select l_returnflag v from r where l_returnflag is not null group by 1 order by count(*) desc, 1 limit 1)
select * exclude (d, a, b, v, l_quantity) replace (round(coalesce(l_discount, d), 4) as l_discount, coalesce(l_returnflag, v) as l_returnflag),
  round((l_quantity - a) / (b - a), 6) as quantity
from r, f, m""", name="run_steps")
def steps(t):
    return rounded(run_steps(gaps(t), STEP_LIST).df, l_discount=4, quantity=6)
