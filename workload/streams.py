"""Request logs: the events table as calls (endpoint = event type, caller = user)."""

from pyspark.sql import functions as F

from quillframe.streaming import requests
from workload.base import Tables, instant, query

LIMITS = {"view": 2, "click": 3, "default": 1}
LIMIT_SQL = "case event_type when 'view' then 2 when 'click' then 3 else 1 end"
WINDOW = 6 * 3600

SESSIONS = f"""
with g as (select *, case when ts - lag(ts) over w < interval {WINDOW} seconds then 0 else 1 end f from events window w as (partition by event_type, user_id order by ts, event_id)),
s as (select *, sum(f) over (partition by event_type, user_id order by ts, event_id rows unbounded preceding) s from g)"""


@query(f"""
{SESSIONS}
select event_id, event_type, user_id, hits, hits <= {LIMIT_SQL} as allowed from (
  select *, cast(row_number() over (partition by event_type, user_id, s order by ts, event_id) as bigint) hits from s)""")
def rate_limit(t):
    return requests.rate_limit(t.events, "ts", "event_type", "user_id", ["event_id"], WINDOW, LIMITS).drop("ts")


@query(f"""
{SESSIONS}
select event_id, event_type, user_id, hits, hits <= {LIMIT_SQL} as allowed from (
  select *, cast(row_number() over (partition by event_type, user_id, s order by ts, event_id) as bigint) hits from s)
where ts <= (select max(ts) - interval 10 minutes from events)""")
def rate_limit_decisions(t):
    """The decision on every request that the watermark has passed once the whole log has been read as a stream."""
    decided = requests.rate_limit_decisions(_stream(t), "ts", "event_type", "user_id", ["event_id"], "10 minutes", WINDOW, LIMITS)
    return requests.run_available(decided, "decisions").drop("ts")


MICROS = "%Y-%m-%d %H:%M:%S.%f"
SESSION_ROWS = f"""
{SESSIONS}, r as (select event_type, user_id, min(ts) a, max(ts) + interval {WINDOW} seconds b, count(*) hits from s group by event_type, user_id, s)
select event_type, user_id, strftime(a, '{MICROS}') as session_start, strftime(b, '{MICROS}') as session_end, hits,
  least(hits, {LIMIT_SQL}) as allowed, hits - least(hits, {LIMIT_SQL}) as refused from r"""


def _sessions(log):
    return requests.rate_limit_sessions(log, "ts", "event_type", "user_id", "10 minutes", WINDOW, LIMITS)


def _shown(sessions):
    return sessions.withColumns({"session_start": instant("session_start"), "session_end": instant("session_end")})


@query(SESSION_ROWS)
def rate_limit_sessions(t):
    return _shown(_sessions(t.events))


def _stream(t: Tables):
    return requests.read_log(t.spark, t.folder, t.events.schema, pathGlobFilter="events.parquet")


@query(f"{SESSION_ROWS} where b <= (select max(ts) - interval 10 minutes from events)")
def rate_limit_stream(t):
    """The sessions the watermark has closed once the whole log has been read as a stream."""
    return _shown(requests.run_available(_sessions(_stream(t)), "sessions"))


def _usage(log):
    return requests.usage_rollup(log, "ts", ["event_type"], F.col("event_type") != "error", F.col("value"), "1 day", "1 hour")


QUANTILES = [f"amount_p{p}" for p in (50, 90, 99)]
USAGE = """
with r as (select event_type, date_trunc('day', ts) d, count(*) as calls, count(*) filter (event_type <> 'error') as succeeded, round(sum(value), 2) as amount,
  min(value) as amount_min, max(value) as amount_max, round(quantile_cont(value, 0.5), 6) as amount_p50,
  round(quantile_cont(value, 0.9), 6) as amount_p90, round(quantile_cont(value, 0.99), 6) as amount_p99 from events group by 1, 2)
select strftime(d, '{micros}') as window_start, strftime(d + interval 1 day, '{micros}') as window_end, event_type, calls, succeeded, calls - succeeded as failed,
  round_even(succeeded / calls * 100, 1) as success_rate, amount, amount_min, amount_max{quantiles} from r"""


def _usage_shown(rows):
    rows = rows.withColumns({"amount": F.round("amount", 2)} | {q: F.round(q, 6) for q in QUANTILES})
    return rows.withColumns({"window_start": instant("window_start"), "window_end": instant("window_end")})


@query(USAGE.format(micros=MICROS, quantiles=", " + ", ".join(QUANTILES)))
def usage_rollup(t):
    return _usage_shown(_usage(t.events))


@query(f"{USAGE.format(micros=MICROS, quantiles='')} where d + interval 1 day <= (select max(ts) - interval 1 hour from events)")
def usage_stream(t):
    """The day windows the watermark has closed once the whole log has been read as a stream; its quantiles are sketches."""
    return _usage_shown(requests.run_available(_usage(_stream(t)), "usage")).drop(*QUANTILES)


@query("""
select count(*) as calls, round(sum(value), 2) as amount, round_even(count(*) filter (event_type <> 'error') / count(*) * 100, 1) as success_rate from events""")
def usage_total(t):
    return requests.usage_total(t.events, F.col("event_type") != "error", F.col("value")).withColumn("amount", F.round("amount", 2))
