"""Ordered series."""

from pyspark.sql import functions as F

from quillframe.operators import timeseries
from workload.base import SQL_DAILY, all_rounded, daily, day, instant, query, rounded, sql_instant, sql_p_value

RANKED = f"(select t, v, row_number() over (order by t) - 1 as i, count(*) over () as n from {SQL_DAILY})"
DAY = "strftime(t, '%Y-%m-%d')"

TREND = f"""
select {{by}} case when s > 0 then 'upward' when s < 0 then 'downward' else 'flat' end as direction,
  case when abs(r) > 0.7 then 'strong' when abs(r) > 0.4 then 'moderate' else 'weak' end as strength,
  round_even(s, 6) as slope, round_even(r * r, 4) as r_squared, round_even({sql_p_value("r", "n")}, 6) as p_value,
  {sql_p_value("r", "n")} < 0.05 as significant, round_even((last - first) / abs(first) * 100, 2) as pct_change_total,
  round(first, 2) as first_value, round(last, 2) as last_value, n as data_points
from (select {{by}} regr_slope(v, i) s, corr(v, i) r, min_by(v, i) as first, max_by(v, i) as last, count(*) n from {{rows}} {{group}})"""


@query(TREND.format(by="", rows=RANKED, group=""))
def trend(t):
    return rounded(timeseries.trend(daily(t), "t", "v"), first_value=2, last_value=2)


EVENTS_RANKED = "(select event_type, value v, row_number() over (partition by event_type order by ts, value) - 1 i from events)"


@query(TREND.format(by="event_type,", rows=EVENTS_RANKED, group="group by event_type"))
def trend_by_key(t):
    return rounded(timeseries.trend(t.events, "ts", "value", by=["event_type"]), first_value=2, last_value=2)


def _decompose_sql(rows: str, by: str, time: str, key: str) -> str:
    over = f"partition by {by} order by i" if by else "order by i"
    frame = "rows between 3 preceding and 3 following"
    part = f"partition by {by}, i % 7" if by else "partition by i % 7"
    lead = f"{by}, " if by else ""
    return f"""
with w as (select *, case when count(v) over ({over} {frame}) = 7 then avg(v) over ({over} {frame}) end as trend from {rows}),
s as (select *, avg(v - trend) over ({part}) as seasonal from w)
select {lead}{time} as time{key}, round(v, 4) as observed, round(trend, 4) as trend, round(seasonal, 4) as seasonal, round(v - trend - seasonal, 4) as residual from s"""


@query(_decompose_sql(RANKED, "", DAY, ""))
def decompose(t):
    return all_rounded(timeseries.decompose(daily(t), "t", "v").withColumn("time", day("time")), 4)


EVENT_SERIES = "(select event_type, ts t, event_id, value v, row_number() over (partition by event_type order by ts, event_id) - 1 i from events)"


@query(_decompose_sql(EVENT_SERIES, "event_type", sql_instant("t"), ", event_id"))
def decompose_by_key(t):
    out = timeseries.decompose(t.events, "ts", "value", by=["event_type"], key=["event_id"])
    return all_rounded(out.withColumn("time", instant("time")), 4)


SMA = ", ".join(
    f"round(case when i >= {w - 1} then avg(v) over (order by i rows between {w - 1} preceding and current row) end, 4) as sma_{w}" for w in (7, 14, 30))


@query(f"select {DAY} as time, round(v, 2) as value, {SMA} from {RANKED}")
def sma(t):
    return all_rounded(timeseries.sma(daily(t), "t", "v").withColumn("time", day("time")), 4).withColumn("value", F.round("value", 2))


def _ewma_rows() -> str:
    """Running numerators and denominators over the daily series, as ``e``."""
    spans = (7, 14, 30)
    first = ", ".join(f"v as num_{s}, 1.0::double as den_{s}" for s in spans)
    decay = {s: f"(1 - 2.0::double / {s + 1})" for s in spans}
    step = ", ".join(f"r.v + {decay[s]} * e.num_{s}, 1 + {decay[s]} * e.den_{s}" for s in spans)
    return f"""
with recursive r as materialized (select * from {RANKED}),
e as (select i, t, v, {first} from r where i = 0
      union all select r.i, r.t, r.v, {step} from e join r on r.i = e.i + 1)"""


EWMA = ", ".join(f"round(num_{s} / den_{s}, 4) as ewma_{s}" for s in (7, 14, 30))


@query(f"{_ewma_rows()} select {DAY} as time, round(v, 2) as value, {EWMA} from e")
def ewma(t):
    out = all_rounded(timeseries.ewma(daily(t), "t", "v").withColumn("time", day("time")), 4)
    return out.withColumn("value", F.round("value", 2))


@query(f"""
with l as (select v, row_number() over (order by t desc) r from {SQL_DAILY} qualify r <= 7), k as (select count(*) p from l)
select cast(s as int) as step, round(v, 2) as forecast from (select unnest(range(14)) s), k, l where s % p = p - r""")
def seasonal_naive_forecast(t):
    return all_rounded(timeseries.forecast(daily(t), "t", "v"), 2)


LONG = "(select o_orderdate t, 'o_totalprice' series, sum(o_totalprice) v from orders group by 1 union all select o_orderdate, 'orders', count(*)::double from orders group by 1)"
LONG_RANKED = f"(select *, row_number() over (partition by series order by t) - 1 i from {LONG})"
REPORT_SMA = ", ".join(
    f"round(case when i >= {w - 1} then avg(v) over (partition by series order by i rows between {w - 1} preceding and current row) end, 4) as sma_{w}" for w in (7, 14, 30))


def _report_ewma() -> str:
    spans = (7, 14, 30)
    decay = {s: f"(1 - 2.0::double / {s + 1})" for s in spans}
    first = ", ".join(f"v as num_{s}, 1.0::double as den_{s}" for s in spans)
    step = ", ".join(f"r.v + {decay[s]} * e.num_{s}, 1 + {decay[s]} * e.den_{s}" for s in spans)
    return f"""r as materialized (select * from {LONG_RANKED}),
e as (select series, i, t, v, {first} from r where i = 0
      union all select r.series, r.i, r.t, r.v, {step} from e join r on r.series = e.series and r.i = e.i + 1)"""


REPORT_EWMA = ", ".join(f"case when count(*) over (partition by series) >= {s} then round(num_{s} / den_{s}, 4) end as ewma_{s}" for s in (7, 14, 30))


@query(f"""
with recursive {_report_ewma()}, d as ({_decompose_sql(LONG_RANKED, "series", DAY, "")})
select d.*, {", ".join(f"sma_{w}, ewma_{w}" for w in (7, 14, 30))}
from d join (select series, {DAY} as time, {REPORT_SMA} from {LONG_RANKED}) using (series, time)
join (select series, {DAY} as time, {REPORT_EWMA} from e) using (series, time)""")
def time_series_report(t):
    rows = t.orders.groupBy(F.col("o_orderdate").alias("t")).agg(F.sum("o_totalprice").alias("o_totalprice"), F.count("*").alias("orders"))
    out = timeseries.time_series_report(rows, "t").withColumn("time", day("time"))
    return all_rounded(out, 4)


@query(f"{_ewma_rows()} select {DAY} as time, round(v, 2) as value, {SMA}, {EWMA} from e")
def moving_averages(t):
    out = all_rounded(timeseries.moving_averages(daily(t), "t", "v").withColumn("time", day("time")), 4)
    return out.withColumn("value", F.round("value", 2))


@query(f"""
with l as (select series, v, row_number() over (partition by series order by t desc) r, count(*) over (partition by series) n from {LONG} qualify r <= 7)
select series, cast(s as int) as step, round(v, 2) as forecast from (select unnest(range(14)) s), l where s % least(n, 7) = least(n, 7) - r""")
def forecasts(t):
    rows = t.orders.groupBy(F.col("o_orderdate").alias("t")).agg(F.sum("o_totalprice").alias("o_totalprice"), F.count("*").alias("orders"))
    return all_rounded(timeseries.forecasts(rows, "t", ["o_totalprice", "orders"]), 2)


@query("""
with l as (select event_type, value, row_number() over (partition by event_type order by ts desc, event_id desc) r from events qualify r <= 7)
select event_type, cast(s as int) as step, value as forecast from (select unnest(range(14)) s), l where s % 7 = 7 - r""")
def forecast_by_key(t):
    return timeseries.forecast(t.events, "ts", "value", by=["event_type"], key=["event_id"])


@query(f"""
with r as (select ts, value, event_id, row_number() over (order by ts, event_id) - 1 i, count(*) over () n from events)
select {sql_instant("ts")} as ts, value, event_id from r where i % greatest(ceil(n / 150), 1) = 0""")
def downsample(t):
    return timeseries.downsample(t.events, "ts", ["value"], key=["event_id"]).withColumn("ts", instant("ts"))


@query("""
select o_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as o_orderdate, o_totalprice,
  round(sum(o_totalprice) over w - o_totalprice, 2) as start, round(sum(o_totalprice) over w, 2) as "end"
from orders window w as (partition by o_custkey order by orders.o_orderdate, o_orderkey rows unbounded preceding)""")
def running_total(t):
    out = timeseries.running_total(t.orders, ["o_orderdate", "o_orderkey"], "o_totalprice", by=["o_custkey"])
    return rounded(out.withColumn("o_orderdate", day("o_orderdate")), start=2, end=2)
