"""Request limits and trailing load."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tributary.session import stage
from tributary.streaming.speculation import ROWS_PER_SCAN, admit, decided

HOUR = 3_600_000_000
CHAT_LIMIT = 20
IMPACT_LIMIT = 10


def rate_limited(
    events: DataFrame,
    key: str,
    limit: int = CHAT_LIMIT,
    window: int = HOUR,
    ts: str = "ts",
    tie: str = "event_id",
    rows_per_scan: int = ROWS_PER_SCAN,
) -> DataFrame:
    """All events with ``accepted``: at most ``limit`` accepted per window.

    Rejected requests do not count, so decisions of one key depend on each
    other in time order.  They are independent across quiet stretches: a slot
    of one window length whose events, with those of the slot before, stay
    within the limit accepts everything whatever came earlier, and whoever
    follows needs only that slot's events.  Slots are counted first (partial
    sums), then only runs of busy slots are scanned in order, each run a unit of its own.
    A run of any length spreads over tasks: its chunks are scanned from assumed beginnings, and
    scanned again where those were wrong (``streaming.speculation``).
    """
    rows = events.withColumn("_at", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn(
        "_slot", F.floor(F.col("_at") / window)
    )
    w = Window.partitionBy(key).orderBy("_slot")
    counted = rows.groupBy(key, "_slot").agg(F.count(F.lit(1)).alias("_n"))
    follows = F.coalesce(F.lag("_slot").over(w) == F.col("_slot") - 1, F.lit(False))
    before = F.when(follows, F.lag("_n").over(w)).otherwise(0)
    flagged = counted.withColumn("_busy", F.col("_n") + before > limit)
    leads = F.coalesce(F.lead("_slot").over(w) == F.col("_slot") + 1, F.lit(False)) & F.coalesce(
        F.lead("_busy").over(w), F.lit(False)
    )
    scanned = flagged.withColumn("_scan", F.col("_busy") | leads)
    starts = F.when(F.col("_scan") & (~F.col("_busy") | ~follows), 1).otherwise(0)
    slots = scanned.withColumn("_start", starts).select(key, "_slot", "_scan", F.sum("_start").over(w).alias("_run"))
    joined = rows.join(slots, [key, "_slot"])
    names = events.columns
    quiet = joined.filter(~F.col("_scan")).select(*names, F.lit(True).alias("accepted"))
    ordered = decided(joined.filter("_scan").select(*names, "_run", "_at"), [key, "_run"], tie, names, limit, window, rows_per_scan)
    return quiet.unionByName(ordered)


class _Limiter(StatefulProcessor):
    """Decides requests in time order; a key's state goes once its last accepted stamp is a window old."""

    def __init__(self, limit: int, window: int) -> None:
        self.limit = limit
        self.window = window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.accepted = handle.getListState("accepted", "at bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        closed = timerValues.getCurrentWatermarkInMs() * 1000
        stamps = deque(int(v[0]) for v in self.accepted.get())
        requests = pd.concat([pdf[["event_id", "at"]] for pdf in rows]).sort_values(["at", "event_id"])
        late = requests["at"] < closed
        verdicts = [not behind and admit(stamps, int(at), self.limit, self.window) for at, behind in zip(requests["at"], late)]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer if isinstance(timer, int) else int(timer[0]))
        if stamps:
            self.accepted.put([(at,) for at in stamps])
            # Timers are milliseconds: the first one at which the last stamp no longer counts.
            self.handle.registerTimer(-(-(stamps[-1] + self.window) // 1000))
        out = requests.assign(key=key[0], accepted=verdicts, late=late)
        yield out[["key", "event_id", "at", "accepted", "late"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.accepted.clear()
        return iter(())

    def close(self) -> None:
        pass


def rate_limit_stream(
    events: DataFrame, key: str, limit: int = CHAT_LIMIT, window: int = HOUR, lateness: str = "10 minutes"
) -> DataFrame:
    """Decisions on a stream of requests: ``(key, event_id, at, accepted, late)``.

    State per key is the list of accepted stamps, at most ``limit`` of them, and is dropped
    by an event-time timer when none of them counts any more.  Requests are decided in time
    order within a micro-batch.  A request behind the watermark is returned as ``late`` and
    not accepted: the stamps it depends on may be gone.
    """
    # The decision's time is a plain number, so Spark hands late rows over instead of dropping them.
    rows = events.withWatermark("ts", lateness).select(
        F.col(key).cast("string").alias("key"), "event_id", F.unix_micros("ts").alias("at")
    )
    return rows.groupBy("key").transformWithStateInPandas(
        statefulProcessor=_Limiter(limit, window),
        outputStructType="key string, event_id bigint, at bigint, accepted boolean, late boolean",
        outputMode="Append",
        timeMode="EventTime",
    )


def trailing_load(
    events: DataFrame,
    key: Sequence[str],
    window: int = HOUR,
    parts: int | None = None,
    ts: str = "ts",
) -> DataFrame:
    """All events with ``load``: events of the key in the trailing window.

    A stamp exactly one window old is outside; events without a time have no load.  An event adds one at its time and takes one
    away a window later; the load is the sum so far.  Sums are taken in two levels: the
    changes per key and time are dealt into ``parts`` ranges (by default as many as Spark
    shuffles into), summed inside each, and added to the totals of the earlier ranges of
    the key.  A key, or one hour of it, with any share of the events spreads over ranges.
    """
    spark = events.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Inside a struct nulls are equal, so events without a key are one group.
    rows = events.withColumn("_key", F.struct(*key)).withColumn("_at", F.unix_micros(F.col(ts).cast("timestamp")))
    steps = F.array(
        F.struct(F.col("_at").alias("at"), F.lit(1).alias("by")), F.struct((F.col("_at") + window).alias("at"), F.lit(-1).alias("by"))
    )
    changes = (
        rows.filter("_at IS NOT NULL").select("_key", F.explode(steps).alias("s"))
        .groupBy("_key", F.col("s.at").alias("_at")).agg(F.sum("s.by").alias("_by"))
        .repartitionByRange(parts, "_key", "_at").withColumn("_part", F.spark_partition_id())
    )
    # Written, since the borders of ranges are drawn from samples: all readers must see the same.
    changes = stage(changes, "load")
    earlier = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    heads = changes.groupBy("_key", "_part").agg(F.sum("_by").alias("_sum")).select(
        "_key", "_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_head")
    )
    inside = Window.partitionBy("_part", "_key").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    loads = changes.withColumn("_run", F.sum("_by").over(inside)).join(heads, ["_part", "_key"]).select(
        "_key", "_at", (F.col("_head") + F.col("_run")).alias("load")
    )
    return rows.join(loads, ["_key", "_at"], "left").select(*events.columns, "load")


def load_stream(events: DataFrame, key: str, window: str = "1 hour", slide: str = "5 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Requests per key in sliding windows, for streams."""
    return (
        events.withWatermark("ts", lateness)
        .groupBy(F.window("ts", window, slide).alias("w"), F.col(key).alias("key"))
        .agg(F.count(F.lit(1)).alias("requests"))
        .select("key", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "requests")
    )
