"""Request logs: rate limits by idle session and usage per time window, batch and streaming.

Both take a log with a time, an endpoint and a caller column.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillframe.functions.columns import complete, percent
from quillframe.operators import blocks
from quillframe.session import scratch_path, write_out

# Requests allowed per endpoint before the caller is idle for the window.
LIMITS = {"upload": 10, "query": 60, "insights": 20, "chart": 100, "report": 5, "default": 200}
WINDOW_SECONDS = 3600

LATENCY_QUANTILES = (0.5, 0.9, 0.99)
BUCKETS = 4096  # of callers that share a state in a stream


def as_timestamp(df: DataFrame, time: str) -> DataFrame:
    """Watermarks need an instant; a zoneless timestamp is read in the session's zone."""
    return df.withColumn(time, F.col(time).cast("timestamp"))


def limit_of(endpoint: Column, limits: dict[str, int] | None = None) -> Column:
    limits = limits or LIMITS
    table = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])
    return F.coalesce(table[endpoint], F.lit(limits["default"]))


def rate_limit(
    df: DataFrame, time: str, endpoint: str, caller: str, key: Sequence[str],
    window_seconds: int = WINDOW_SECONDS, limits: dict[str, int] | None = None,
) -> DataFrame:
    """Adds ``hits`` (requests so far in the session) and ``allowed`` to every request.

    A session ends after ``window_seconds`` without a request, so every request renews it. The
    log is sorted once by (endpoint, caller, time, key): a caller with a third of all requests
    is spread over many partitions. Each is scanned on its own; the last request before a partition and the session open there
    come from tables of one row per partition.
    """
    by = [endpoint, caller]
    names = list(dict.fromkeys([*by, time, *key]))
    placed = blocks.positions(complete(df.select(*names), [*by, time]), [time, *key], by=by)
    here = Window.partitionBy("_part").orderBy("_pos")
    request = F.struct(*by, F.unix_micros(F.col(time).cast("timestamp")).alias("_at"))
    ends = placed.groupBy("_part").agg(F.max_by(request, "_pos").alias("_end"))
    carried = ends.select("_part", F.lag("_end").over(Window.orderBy("_part")).alias("_end"))  # one row per sorted partition
    rows = placed.withColumn("_before", F.lag(request).over(here)).join(F.broadcast(carried), "_part")
    before = F.coalesce("_before", "_end")
    same = F.lit(True)
    for b in by:
        same &= F.col(b) == before[b]
    fresh = ~F.coalesce(same & (request["_at"] - before["_at"] < window_seconds * 1_000_000), F.lit(False))
    began = F.max(F.when(fresh, F.col("_pos"))).over(here.rowsBetween(Window.unboundedPreceding, 0))
    scanned = write_out(rows.select(*names, "_part", "_pos", began.alias("_began")), "sessions")
    open_ = scanned.groupBy("_part").agg(F.max("_began").alias("_open"))
    open_ = open_.select("_part", F.max("_open").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_open"))
    scanned = scanned.join(F.broadcast(open_), "_part")
    hits = (F.col("_pos") - F.coalesce("_began", "_open") + 1).alias("hits")
    limit = limit_of(F.col(endpoint), limits)
    return scanned.select(*names, hits).withColumn("allowed", F.col("hits") <= limit)


def _rows_in(frame: pd.DataFrame) -> bytes:
    """A frame as an Arrow stream, the form in which rows wait in a state."""
    table, sink = pa.Table.from_pandas(frame, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _rows_of(rows: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(rows).read_pandas()


def decided(due: pd.DataFrame, sessions: pd.DataFrame | None, by: list[str], order: list[str], window: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """``due`` (by, at, order) in order with ``hits``, and the last time and count (by, at, hits) of every caller.

    ``sessions`` is that second table as the earlier requests left it.
    """
    due = due.sort_values(["at", *order], kind="stable", na_position="first", ignore_index=True)
    rows = due[[*by, "at"]].assign(hits=1)
    carried = 0 if sessions is None else len(sessions)
    if carried:  # an earlier session is a request that counts as many times
        rows = pd.concat([sessions, rows], ignore_index=True)
    rows = rows.sort_values([*by, "at"], kind="stable")
    at, weight = rows["at"].to_numpy(), rows["hits"].to_numpy()
    turns = np.zeros(len(rows) - 1, bool)
    for b in by:
        keys = rows[b].to_numpy()
        turns |= keys[1:] != keys[:-1]
    fresh = np.r_[True, turns | (np.diff(at) >= window)]
    before = np.cumsum(weight) - weight
    rows["hits"] = before + weight - before[fresh][np.cumsum(fresh) - 1]
    new = rows.index >= carried
    counted = due.iloc[rows.index[new] - carried].assign(hits=rows["hits"].to_numpy()[new])
    return counted, rows[np.r_[turns, True]]


class _Decisions(StatefulProcessor):
    """Requests wait until the watermark has passed them, then those of all callers of a bucket are counted in order at once.

    State per bucket: the sessions that another request may still continue, and what waits, which the watermark's delay bounds. A timer
    stands at or before the earliest request that waits.
    """

    def __init__(self, by: list[str], order: list[str], window_seconds: int):
        self.by, self.order, self.window = by, order, window_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sessions = handle.getValueState("sessions", "rows binary")
        self.waiting = handle.getListState("waiting", "rows binary")

    def _wait(self, frame: pd.DataFrame) -> None:
        self.waiting.appendValue((_rows_in(frame),))
        self.handle.registerTimer(-(-int(frame["at"].min()) // 1000))

    def handleInputRows(self, key, rows, timerValues):
        for frame in rows:
            self._wait(frame[[*self.by, "at", *self.order]])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        found = [_rows_of(w[0]) for w in self.waiting.get()] if self.waiting.exists() else []
        if not found:
            return
        rows = pd.concat(found, ignore_index=True)
        due = rows[rows["at"] <= passed]
        if due.empty:
            return
        self.waiting.clear()
        if len(due) < len(rows):
            self._wait(rows[rows["at"] > passed])
        sessions = _rows_of(self.sessions.get()[0]) if self.sessions.exists() else None
        counted, sessions = decided(due, sessions, self.by, self.order, self.window)
        self.sessions.update((_rows_in(sessions[sessions["at"] > passed - self.window]),))
        yield counted[[*self.by, "at", *self.order, "hits"]]

    def close(self) -> None:
        pass


def rate_limit_decisions(
    log: DataFrame, time: str, endpoint: str, caller: str, key: Sequence[str], watermark: str = "10 minutes",
    window_seconds: int = WINDOW_SECONDS, limits: dict[str, int] | None = None,
) -> DataFrame:
    """``rate_limit`` for a stream: ``hits`` and ``allowed`` of every request, as soon as the watermark has passed it.

    Requests that come out of order within the watermark's delay are put in order by (time, ``key``) first, so each gets what the batch
    operator gives it; those that come later are dropped. Endpoints and callers are dealt into ``BUCKETS`` by their hash; a bucket's
    requests pass its state together, in a few calls per batch whatever their number. The state store must be RocksDB (set here).
    """
    log.sparkSession.conf.set(
        "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    names = [endpoint, caller, *[k for k in dict.fromkeys(key) if k not in (endpoint, caller, time)]]
    by, order = ["k0", "k1"], [f"k{i}" for i in range(2, len(names))]
    rows = as_timestamp(complete(log.select(*names, time), [endpoint, caller, time]), time).withWatermark(time, watermark)
    bucket = F.pmod(F.xxhash64(endpoint, caller), F.lit(BUCKETS)).alias("bucket")
    rows = rows.select(bucket, *[F.col(c).alias(k) for k, c in zip([*by, *order], names)], F.unix_micros(time).alias("at"), F.col(time).alias("time"))
    out = T.StructType([*[rows.schema[c] for c in (*by, "at", *order)], T.StructField("hits", T.LongType())])
    counted = rows.groupBy("bucket").transformWithStateInPandas(_Decisions(by, order, window_seconds), out, "Append", "EventTime")
    columns = {**dict(zip(names, [*by, *order])), time: "at"}
    shown = [F.timestamp_micros("at").alias(c) if c == time else F.col(columns[c]).alias(c) for c in [endpoint, caller, time, *names[2:]]]
    return counted.select(*shown, "hits").withColumn("allowed", F.col("hits") <= limit_of(F.col(endpoint), limits))


def rate_limit_sessions(
    log: DataFrame, time: str, endpoint: str, caller: str, watermark: str = "10 minutes",
    window_seconds: int = WINDOW_SECONDS, limits: dict[str, int] | None = None,
) -> DataFrame:
    """Sessions per endpoint and caller with their requests, allowed and refused counts (stream or batch).

    At a gap of exactly the window Spark joins the two sessions. Sessions are merged where they are read, so a
    caller with a large part of the log sends one row per session and partition.
    """
    log.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    log = as_timestamp(log, time)
    if log.isStreaming:
        log = log.withWatermark(time, watermark)
    session = F.session_window(time, f"{window_seconds} seconds")
    counts = log.groupBy(endpoint, caller, session.alias("_s")).agg(F.count("*").alias("hits"))
    allowed = F.least(F.col("hits"), limit_of(F.col(endpoint), limits))
    return counts.select(
        endpoint, caller, F.col("_s.start").alias("session_start"), F.col("_s.end").alias("session_end"), "hits",
        allowed.alias("allowed"), (F.col("hits") - allowed).alias("refused"))


def usage_rollup(
    log: DataFrame, time: str, by: Sequence[str], success: Column, amount: Column, every: str = "1 day", watermark: str = "1 hour",
) -> DataFrame:
    """Per time window: calls, failures, success rate, and the total and quantiles of ``amount``.

    In a stream the quantiles come from a bounded sketch in its state; in a batch they are exact.
    """
    log = as_timestamp(log, time)
    if log.isStreaming:
        log = log.withWatermark(time, watermark)
    rows = log.withColumn("_amount", amount.cast("double")).withColumn("_ok", success)
    sums = [F.count("*").alias("calls"), F.count_if("_ok").alias("succeeded"), F.sum("_amount").alias("amount"),
            F.min("_amount").alias("amount_min"), F.max("_amount").alias("amount_max")]
    if log.isStreaming:
        sketch = F.percentile_approx("_amount", list(LATENCY_QUANTILES), 10_000)
        out = rows.groupBy(F.window(time, every).alias("_w"), *by).agg(*sums, sketch.alias("_q"))
    else:
        keys = ["_w", *by]
        rows = rows.withColumn("_w", F.window(time, every))
        exact = blocks.quantiles(rows, ["_amount"], LATENCY_QUANTILES, by=keys).select(*keys, F.col("q").alias("_q"))
        out = rows.groupBy(*keys).agg(*sums).join(exact, keys, "left")
    names = [f"amount_p{round(q * 100)}" for q in LATENCY_QUANTILES]
    return out.select(
        F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *by, "calls", "succeeded",
        (F.col("calls") - F.col("succeeded")).alias("failed"), percent(F.col("succeeded"), F.col("calls"), 1).alias("success_rate"),
        "amount", "amount_min", "amount_max", *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])


def usage_total(log: DataFrame, success: Column, amount: Column) -> DataFrame:
    """One row over the whole log; the success rate of an empty log is 100."""
    one = log.agg(F.count("*").alias("calls"), F.count_if(success).alias("succeeded"), F.coalesce(F.sum(amount), F.lit(0)).alias("amount"))
    rate = F.coalesce(percent(F.col("succeeded"), F.col("calls"), 1), F.lit(100.0))
    return one.select("calls", "amount", rate.alias("success_rate"))


def read_log(spark: SparkSession, path: str, schema: T.StructType, **options) -> DataFrame:
    """A Parquet folder (or file pattern) as a stream."""
    return spark.readStream.schema(schema).options(**options).parquet(path)


def run_available(stream: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Work off everything that has arrived, in append mode, into a Parquet table; return the table.

    Windows the watermark has not passed stay in the state kept beside ``path``: a later run with the same path
    reads only what has arrived since and closes them. Without a path the table is a new one.
    """
    spark = stream.sparkSession
    path = path or scratch_path(spark, label)
    query = (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state")
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
