"""Feature columns."""

from pyspark.sql import functions as F

from quillframe.operators import features
from workload.base import day, query, rounded

PARTS = "cast(year({0}) as int) as {0}_year, cast(month({0}) as int) as {0}_month, cast(isodow({0}) - 1 as int) as {0}_dow"


@query(f"select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as o_orderdate, {PARTS.format('orders.o_orderdate').replace('as orders.', 'as ')} from orders")
def date_parts(t):
    out = features.date_parts(t.orders.select("o_orderkey", "o_orderdate"))
    return out.withColumn("o_orderdate", day("o_orderdate"))


@query("""
select o_orderkey, o_totalprice, round((o_totalprice - m) / s, 6) as o_totalprice_scaled
from orders, (select avg(o_totalprice) m, stddev_samp(o_totalprice) s from orders)""")
def zscore_scale(t):
    return rounded(features.zscore_scale(t.orders.select("o_orderkey", "o_totalprice"), ["o_totalprice"]), o_totalprice_scaled=6)


@query("select event_id, value, round(ln(1 + value), 6) as value_log from events where (select min(value) from events) > 0")
def log1p_if_skewed(t):
    """Where a value is not positive there are no rows, as in the SQL; where the operator finds no skew, rows without a log."""
    out = features.log1p_if_skewed(t.events.select("event_id", "value"), ["value"])
    if "value_log" not in out.columns:
        positive = t.events.agg(F.min("value").alias("least")).filter("least > 0").select()  # one row or none
        out = out.withColumn("value_log", F.lit(None).cast("double")).crossJoin(F.broadcast(positive))
    return rounded(out, value_log=6)


@query("""
select o_orderkey, o_orderpriority, cast(dense_rank() over (order by o_orderpriority) - 1 as int) as o_orderpriority_enc, o_orderstatus,
  cast(dense_rank() over (order by o_orderstatus) - 1 as int) as o_orderstatus_enc from orders""")
def label_encode(t):
    return features.label_encode(t.orders.select("o_orderkey", "o_orderpriority", "o_orderstatus"))


@query("""
select o_orderkey, strftime(orders.o_orderdate, '%Y-%m-%d') as o_orderdate, o_totalprice, o_orderstatus,
  cast(year(orders.o_orderdate) as int) as o_orderdate_year, cast(month(orders.o_orderdate) as int) as o_orderdate_month, cast(isodow(orders.o_orderdate) - 1 as int) as o_orderdate_dow,
  round((o_orderkey - km) / ks, 6) as o_orderkey_scaled, round((o_totalprice - pm) / ps, 6) as o_totalprice_scaled,
  cast(dense_rank() over (order by o_orderstatus) - 1 as int) as o_orderstatus_enc
from orders, (select avg(o_orderkey) km, stddev_samp(o_orderkey) ks, avg(o_totalprice) pm, stddev_samp(o_totalprice) ps from orders)""")
def engineer_features(t):
    out, _ = features.engineer(t.orders.select("o_orderkey", "o_orderdate", "o_totalprice", "o_orderstatus"))
    return rounded(out.withColumn("o_orderdate", day("o_orderdate")), o_orderkey_scaled=6, o_totalprice_scaled=6)
