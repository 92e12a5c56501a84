"""Correlation, outliers and anomalies."""

from pyspark.sql import functions as F

from quillframe.operators import stats
from workload.base import LINE_NUMBERS, SQL_GAPS, all_rounded, gaps, query, rounded, union_all, sql_p_value


@query(union_all(
    f"select '{a}' as column_a, '{b}' as column_b, 1.0::double as corr" if a == b else
    f"select '{a}' as column_a, '{b}' as column_b, round(corr({a}, {b}), 6) as corr from {SQL_GAPS}"
    for a in LINE_NUMBERS for b in LINE_NUMBERS))
def correlation_matrix(t):
    return rounded(stats.correlation_matrix(gaps(t), LINE_NUMBERS), corr=6)


PAIRS = union_all(
    f"select {i} a, {j} b, '{x}' column_a, '{y}' column_b, corr({x}, {y}) r from {SQL_GAPS}"
    for i, x in enumerate(LINE_NUMBERS) for j, y in enumerate(LINE_NUMBERS) if i < j)


@query(f"""
select column_a, column_b, round(r, 6) as corr, case when r > 0 then 'positive' else 'negative' end as direction,
  '''' || column_a || ''' ↔ ''' || column_b || ''': ' || case when r > 0 then 'positive' else 'negative' end || ' (' || printf('%.2f', r) || ')' as text
from ({PAIRS}) order by abs(r) desc, a, b limit 5""")
def top_correlations(t):
    return rounded(stats.top_correlations(gaps(t), LINE_NUMBERS), corr=6)


def _deep_sql(c: str) -> str:
    return f"""
select '{c}' as "column", round_even(r, 4) as pearson_r, round_even(s, 4) as spearman_r, round_even({sql_p_value("r", "n")}, 6) as pearson_p,
  round_even({sql_p_value("s", "n")}, 6) as spearman_p, {sql_p_value("r", "n")} < 0.05 as significant,
  case when abs(r) >= 0.8 then 'very_strong' when abs(r) >= 0.6 then 'strong' when abs(r) >= 0.4 then 'moderate'
       when abs(r) >= 0.2 then 'weak' else 'negligible' end as strength
from (select corr(x, y) r, corr(rx, ry) s, count(*) n from (select x, y, rank() over (order by x) + (count(*) over (partition by x) - 1) / 2 rx,
             rank() over (order by y) + (count(*) over (partition by y) - 1) / 2 ry
      from (select l_extendedprice x, {c} y from {SQL_GAPS} where {c} is not null)))"""


@query(union_all(_deep_sql(c) for c in ("l_quantity", "l_discount", "l_tax")))
def deep_correlation(t):
    return stats.deep_correlation(gaps(t), "l_extendedprice", LINE_NUMBERS)


def _outlier_sql(c: str) -> str:
    return f"""
select '{c}' as "column", count(*) filter ({c} < lo or {c} > hi) as outlier_count, round_even(count(*) filter ({c} < lo or {c} > hi) / count({c}) * 100, 2) as outlier_pct,
  round(min(lo), 4) as lower_fence, round(min(hi), 4) as upper_fence, round(min({c}) filter ({c} < lo), 4) as extreme_low, round(max({c}) filter ({c} > hi), 4) as extreme_high
from {SQL_GAPS}, (select q1 - 1.5 * (q3 - q1) lo, q3 + 1.5 * (q3 - q1) hi from (select quantile_cont({c}, 0.25) q1, quantile_cont({c}, 0.75) q3 from {SQL_GAPS}))"""


@query(union_all(_outlier_sql(c) for c in LINE_NUMBERS))
def outlier_summary(t):
    return all_rounded(stats.outlier_summary(gaps(t), LINE_NUMBERS), 4)


@query("""
with s as (select avg(value) m, stddev_pop(value) s from events)
select event_id, value, round((value - m) / s, 4) as z from events, s where abs((value - m) / s) > 3""")
def anomalies_zscore(t):
    return rounded(stats.anomalies_zscore(t.events.select("event_id", "value"), "value"), z=4)


IQR_EVENTS = "(select q1 - 1.5 * (q3 - q1) lo, q3 + 1.5 * (q3 - q1) hi from (select quantile_cont(value, 0.25) q1, quantile_cont(value, 0.75) q3 from events))"


@query(f"select event_id, value from events, {IQR_EVENTS} where value < lo or value > hi")
def anomalies_iqr(t):
    return stats.anomalies_iqr(t.events.select("event_id", "value"), "value")


@query(f"""
with h as (
  select 'zscore' as method, 3.0::double as threshold, event_id from events, (select avg(value) m, stddev_pop(value) s from events) where abs((value - m) / s) > 3
  union all select 'iqr', 1.5::double, event_id from events, {IQR_EVENTS} where value < lo or value > hi),
r as (select *, row_number() over (partition by method order by event_id) rn from h)
select 'value' as "column", method, threshold, count(*) as anomaly_count, round_even(count(*) / (select count(*) from events) * 100, 2) as anomaly_pct,
  string_agg(cast(event_id as string), ',' order by event_id) filter (rn <= 20) as anomaly_keys
from r group by method, threshold""")
def anomaly_report(t):
    out = stats.anomaly_report(t.events, ["event_id"], ["value"])
    return out.withColumn("anomaly_keys", F.array_join("anomaly_keys", ","))
