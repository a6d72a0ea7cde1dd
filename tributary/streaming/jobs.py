"""Job events: latest state, expiry, active clients, remaining time.

Events carry ``(job_id, ts, status, progress, stage, message, error)``.  ``ts``
must be a timestamp with time zone semantics; cast ``timestamp_ntz`` first,
else a watermark is refused.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tributary.functions.text import client_of

_STATE = ("status", "progress", "stage", "message", "error")
_TERMINAL = ("done", "error")
_LATEST = ("job_id", "at", "status", "terminal", "late")


def latest_state(events: DataFrame, job: Sequence[str] = ("job_id",), ts: str = "ts", tie: Sequence[str] = ()) -> DataFrame:
    """Newest state of each job, and whether it is terminal.

    Works on a table and, in update mode, on a stream: an arg-max with partial
    aggregation, so a job with very many events costs one row per task.
    """
    carried = [c for c in _STATE if c in events.columns]
    return (
        events.groupBy(*job)
        .agg(F.max_by(F.struct(ts, *carried), F.struct(ts, *tie) if tie else F.col(ts)).alias("s"))
        .select(*job, "s.*")
        .withColumn("terminal", F.col("status").isin(*_TERMINAL))
    )


def unexpired(events: DataFrame, now, job: Sequence[str] = ("job_id",), ts: str = "ts", ttl: str = "1 hour") -> DataFrame:
    """Jobs created within ``ttl`` of ``now``: ``(job, created_at)``.

    Later events do not extend a job's life.
    """
    now = F.lit(now).cast("timestamp") if isinstance(now, str) else now
    created = events.groupBy(*job).agg(F.min(ts).alias("created_at"))
    return created.filter(F.col("created_at") >= now - F.expr(f"INTERVAL {ttl}"))


def active_by_client(events: DataFrame, limit: int = 5, tie: Sequence[str] = ()) -> DataFrame:
    """Queued and running jobs per client, and whether the limit is reached.

    The client of a job is the first address of ``forwarded``, else ``peer``,
    of the event that created it.
    """
    rows = events.withColumn("client", client_of(F.col("forwarded"), F.col("peer")))
    order = F.struct("ts", *tie) if tie else F.col("ts")
    per_job = rows.groupBy("job_id").agg(
        F.min_by("client", order).alias("client"), F.max_by("status", order).alias("status")
    )
    active = F.count_if(F.col("status").isin("queued", "running"))
    return per_job.groupBy("client").agg(active.alias("active")).withColumn("limited", F.col("active") >= limit)


def active_total(states: DataFrame) -> DataFrame:
    return states.agg(F.count_if(F.col("status").isin("queued", "running")).alias("active_jobs"))


def remaining_seconds(progress, elapsed, status):
    """Seconds left at the present rate, for jobs still at work."""
    at_work = status.isin("running", "queued") & (progress > 5) & (elapsed > 0)
    return F.when(at_work, F.ceil((100 - progress) / (progress / elapsed)))


def with_remaining(states: DataFrame, elapsed: str = "elapsed") -> DataFrame:
    return states.withColumn(
        "remaining", remaining_seconds(F.col("progress"), F.col(elapsed), F.col("status")).cast("long")
    )


class _Expiry(StatefulProcessor):
    """Keeps a job from its first event until its lifetime is over."""

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.created = handle.getValueState("created", "at bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = min(int(pdf["at"].min()) for pdf in rows)
        if self.created.exists():
            return iter(())
        self.created.update((first,))
        self.handle.registerTimer(first + self.ttl_ms)
        return iter([pd.DataFrame({"job_id": [key[0]], "change": ["created"], "at": [first]})])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        self.created.clear()
        return iter([pd.DataFrame({"job_id": [key[0]], "change": ["expired"], "at": [at]})])

    def close(self) -> None:
        pass


def expiry_stream(events: DataFrame, ttl_seconds: int = 3600, lateness: str = "10 minutes") -> DataFrame:
    """Stream of ``(job_id, change, at)``: jobs created and expired.

    Event-time timers registered at the first sight of a job drive the expiry;
    state is one number per live job.
    """
    rows = events.withWatermark("ts", lateness).select(
        F.col("job_id").cast("string"), "ts", F.unix_millis("ts").alias("at")
    )
    return rows.groupBy("job_id").transformWithStateInPandas(
        statefulProcessor=_Expiry(ttl_seconds * 1000),
        outputStructType="job_id string, change string, at bigint",
        outputMode="Append",
        timeMode="EventTime",
    )


class _Latest(StatefulProcessor):
    """Keeps the newest state of a job until it is closed: terminal and behind the watermark, or out of its lifetime."""

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "at bigint, created bigint, status string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        closed = timerValues.getCurrentWatermarkInMs()
        events = pd.concat(list(rows)).sort_values(["at", "status"], na_position="first")
        late = events["at"] < closed
        if late.any():
            yield events[late].assign(job_id=key[0], terminal=False, late=True)[list(_LATEST)]
        events = events[~late]
        if not len(events):
            return
        last, first = events.iloc[-1], int(events["at"].min())
        held = self.newest.get() if self.newest.exists() else None
        created = first if held is None else min(first, int(held[1]))
        at, status = int(last["at"]), last["status"]
        if held is not None and (int(held[0]), held[2] or "") >= (at, status or ""):
            at, status = int(held[0]), held[2]
        self.newest.update((at, created, status))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer if isinstance(timer, int) else int(timer[0]))
        terminal = status in _TERMINAL
        self.handle.registerTimer(at + 1 if terminal else max(created + self.ttl_ms, at + 1))
        yield pd.DataFrame({"job_id": [key[0]], "at": [at], "status": [status], "terminal": [terminal], "late": [False]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.newest.clear()
        return iter(())

    def close(self) -> None:
        pass


def state_stream(events: DataFrame, ttl_seconds: int = 3600, lateness: str = "10 minutes") -> DataFrame:
    """Stream of ``(job_id, at, status, terminal, late)``: a job's newest state whenever a batch has events of it.

    Unlike :func:`latest_state` in update mode it lets go of jobs: of a terminal one once the
    watermark has passed its end, of any other one when its lifetime is over.  An event
    behind the watermark comes back as ``late``, since its job may be forgotten.
    """
    # A plain number for the time, so Spark hands late rows over instead of dropping them.
    rows = events.withWatermark("ts", lateness).select(
        F.col("job_id").cast("string"), F.unix_millis("ts").alias("at"), F.col("status").cast("string")
    )
    return rows.groupBy("job_id").transformWithStateInPandas(
        statefulProcessor=_Latest(ttl_seconds * 1000),
        outputStructType="job_id string, at bigint, status string, terminal boolean, late boolean",
        outputMode="Append",
        timeMode="EventTime",
    )
