import random
from bisect import bisect_right
from collections import defaultdict, deque
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tributary.streaming import jobs, limits, speculation

START = datetime(2024, 1, 1)
EVENT = "event_id long, key string, ts timestamp"


def trace(seed=4, n=400, keys=4, gap=700):
    rnd = random.Random(seed)
    at, rows = 0, []
    for i in range(n):
        # bursts and quiet stretches; some stamps are exactly one hour apart
        at += rnd.choice([0, 30, 60, 300, gap, 3600, 9000]) if rnd.random() < 0.3 else rnd.randrange(120)
        rows.append((i, f"k{min(rnd.randrange(keys), rnd.randrange(keys))}", START + timedelta(seconds=at)))
    return rows


def plain_limits(rows, limit, window=3600):
    kept, out = defaultdict(deque), {}
    for i, key, ts in sorted(rows, key=lambda r: (r[2], r[0])):
        stamps = deque(t for t in kept[key] if t > ts - timedelta(seconds=window))
        out[i] = len(stamps) < limit
        if out[i]:
            stamps.append(ts)
        kept[key] = stamps
    return out


@pytest.mark.parametrize("limit", [1, 3, 20])
def test_rate_limit_batch(spark, limit):
    rows = trace(seed=limit)
    df = spark.createDataFrame(rows, EVENT).repartition(5)
    got = {r.event_id: r.accepted for r in limits.rate_limited(df, "key", limit).collect()}
    assert got == plain_limits(rows, limit)


@pytest.mark.parametrize("limit", [1, 2, 7])
def test_one_busy_key_spreads_over_tasks(spark, limit):
    """All requests in one run of one key: many scans, few of them repeated, and the decisions of one ordered pass."""
    rnd = random.Random(limit)
    at, rows = 0, []
    for i in range(3000):
        at += rnd.choice([0, 1, 60, 400, 900])
        rows.append((i, "k", START + timedelta(seconds=at)))
    df = spark.createDataFrame(rows, EVENT).repartition(5)
    seen, plain = [], speculation.stage
    try:
        speculation.stage = lambda frame, label: seen.append((label, plain(frame, label))) or seen[-1][1]
        out = limits.rate_limited(df, "key", limit, rows_per_scan=64)
    finally:
        speculation.stage = plain
    assert {r.event_id: r.accepted for r in out.collect()} == plain_limits(rows, limit)
    chunks = {r["_chunk"]: r["count"] for r in next(f for label, f in seen if label == "requests").groupBy("_chunk").count().collect()}
    assert len(chunks) >= 3000 // 64 and max(chunks.values()) <= 64
    assert sum(label == "rescans" for label, _ in seen) < len(chunks) / 2


def test_chains_of_wrong_starts(spark):
    """A rhythm that carries its phase on for ever: each chunk's end depends on its beginning."""
    rows = [(i, f"k{i % 2}", START + timedelta(seconds=1200 * (i // 2))) for i in range(400)]
    df = spark.createDataFrame(rows, EVENT)
    got = {r.event_id: r.accepted for r in limits.rate_limited(df, "key", 2, rows_per_scan=10).collect()}
    assert got == plain_limits(rows, 2)
    assert limits.rate_limited(df.limit(0), "key", 2).count() == 0


def test_rate_limit_boundary(spark):
    rows = [(0, "k", START), (1, "k", START + timedelta(seconds=3599)), (2, "k", START + timedelta(seconds=3600)), (3, "k", START + timedelta(seconds=3601))]
    df = spark.createDataFrame(rows, EVENT)
    got = {r.event_id: r.accepted for r in limits.rate_limited(df, "key", 1).collect()}
    assert got == {0: True, 1: False, 2: True, 3: False}


@pytest.mark.parametrize("parts", [1, 12])
def test_trailing_load(spark, parts):
    rows = trace(seed=9)
    df = spark.createDataFrame(rows, EVENT)
    want = {
        i: sum(1 for _, k, t in rows if k == key and ts - timedelta(hours=1) < t <= ts) for i, key, ts in rows
    }
    got = {r.event_id: r.load for r in limits.trailing_load(df, ["key"], parts=parts).collect()}
    assert got == want


def test_one_hour_of_one_key_spreads_over_ranges(spark):
    rnd = random.Random(3)
    rows = [(i, "k", START + timedelta(microseconds=rnd.randrange(4_000_000_000))) for i in range(4000)]
    rows += [(4000 + i, "k", START + timedelta(seconds=5)) for i in range(500)]  # many events of one stamp
    df, plain, seen = spark.createDataFrame(rows, EVENT).repartition(5), limits.stage, []
    try:
        limits.stage = lambda frame, label: seen.append(plain(frame, label)) or seen[-1]
        out = limits.trailing_load(df, ["key"], parts=16)
    finally:
        limits.stage = plain
    stamps = sorted(t for _, _, t in rows)
    want = {i: bisect_right(stamps, t) - bisect_right(stamps, t - timedelta(hours=1)) for i, _, t in rows}
    assert {r.event_id: r.load for r in out.collect()} == want
    sizes = [r["count"] for r in seen[0].groupBy("_part").count().collect()]
    assert len(sizes) >= 12 and max(sizes) < 2 * 8000 / 12
    assert limits.trailing_load(df.limit(0), ["key"]).count() == 0
    odd = spark.createDataFrame([(1, None, START), (2, None, START), (3, "k", None), (4, "k", START)], EVENT)
    assert {r.event_id: r.load for r in limits.trailing_load(odd, ["key"]).collect()} == {1: 2, 2: 2, 3: None, 4: 1}


def stream_of(spark, folder, rows, files=3):
    df = spark.createDataFrame(rows, EVENT)
    cut = (len(rows) + files - 1) // files
    for i in range(files):
        lo, hi = i * cut, (i + 1) * cut
        df.filter((F.col("event_id") >= lo) & (F.col("event_id") < hi)).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def drain(df, folder, name, mode="append"):
    q = (
        df.writeStream.outputMode(mode).format("memory").queryName(name)
        .option("checkpointLocation", folder).trigger(availableNow=True).start()
    )
    q.awaitTermination(240)
    assert q.exception() is None
    return df.sparkSession.table(name)


@pytest.fixture()
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(key, before)


def test_rate_limit_stream_equals_batch(spark, tmp_path, rocks):
    rows = trace(seed=11, n=150)
    events = stream_of(spark, str(tmp_path / "in"), rows)
    out = drain(limits.rate_limit_stream(events, "key", 2), str(tmp_path / "state"), "limited")
    assert {r.event_id: r.accepted for r in out.collect()} == plain_limits(rows, 2)


def state_rows(spark, df, folder, name):
    """The stream's output, and the rows of state it is left with."""
    q = (
        df.writeStream.outputMode("append").format("memory").queryName(name)
        .option("checkpointLocation", folder).trigger(availableNow=True).start()
    )
    q.awaitTermination(240)
    assert q.exception() is None
    return spark.table(name).collect(), [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]


def test_idle_keys_and_late_requests(spark, tmp_path, rocks):
    rows = [(i, f"k{i}", START + timedelta(seconds=i)) for i in range(20)]
    rows += [(20 + i, "last", START + timedelta(hours=5, seconds=i)) for i in range(20)]
    rows += [(40, "k1", START + timedelta(minutes=1))] + [(41 + i, "last", START + timedelta(hours=9)) for i in range(19)]
    events = stream_of(spark, str(tmp_path / "in"), rows, files=3)
    out, kept = state_rows(spark, limits.rate_limit_stream(events, "key", 2), str(tmp_path / "state"), "idle")
    assert {r.event_id for r in out} == set(range(60)) and {r.event_id for r in out if r.late} == {40}
    assert not any(r.accepted for r in out if r.late)
    wanted = plain_limits([r for r in rows if r[0] != 40], 2)
    assert {r.event_id: r.accepted for r in out if not r.late} == wanted
    assert max(kept) >= 20 and kept[-1] <= max(kept) / 5, kept


def test_closed_jobs_leave_the_state(spark, tmp_path, rocks):
    rows = [(i, f"j{i % 10}", START + timedelta(seconds=i)) for i in range(20)]
    rows += [(20 + i, "open", START + timedelta(minutes=40)) for i in range(20)]
    rows += [(40, "j1", START + timedelta(seconds=2))] + [(41 + i, "next", START + timedelta(hours=9)) for i in range(19)]
    events = stream_of(spark, str(tmp_path / "in"), rows, files=3).select(
        F.col("key").alias("job_id"), "ts", F.when(F.col("event_id").between(10, 19), "done").otherwise("running").alias("status")
    )
    out, kept = state_rows(spark, jobs.state_stream(events), str(tmp_path / "state"), "closed")
    assert {(r.job_id, r.status) for r in out if not r.late} == {*((f"j{i}", "done") for i in range(10)), ("open", "running"), ("next", "running")}
    assert [(r.job_id, r.status) for r in out if r.late] == [("j1", "running")]
    assert all(r.terminal == (r.status == "done") for r in out)
    assert max(kept) >= 10 and kept[-1] <= max(kept) / 5, kept


def test_expiry_stream(spark, tmp_path, rocks):
    rows = [(0, "a", START), (1, "a", START + timedelta(minutes=50)), (2, "b", START + timedelta(minutes=30)), (3, "c", START + timedelta(hours=3)), (4, "d", START + timedelta(hours=6))]
    events = stream_of(spark, str(tmp_path / "in"), rows, files=5).withColumnRenamed("key", "job_id")
    out = drain(jobs.expiry_stream(events), str(tmp_path / "state"), "expiry")
    got = {(r.job_id, r.change) for r in out.collect()}
    assert {("a", "created"), ("b", "created"), ("c", "created"), ("d", "created"), ("a", "expired"), ("b", "expired")} <= got
    ends = {r.job_id: r["at"] for r in out.filter("change = 'expired'").collect()}
    base = int((START - datetime(1970, 1, 1)).total_seconds() * 1000)
    assert ends["a"] == base + 3_600_000  # the later event did not extend it


def test_load_and_state_streams(spark, tmp_path):
    rows = trace(seed=2, n=60)
    events = stream_of(spark, str(tmp_path / "in"), rows)
    out = drain(limits.load_stream(events, "key", "1 hour", "30 minutes"), str(tmp_path / "s1"), "loads", "update")
    got = {(r.key, r.start): r.requests for r in out.groupBy("key", "start").agg(F.max("requests").alias("requests")).collect()}
    want = defaultdict(int)
    for _, key, ts in rows:
        first = ts - timedelta(seconds=(ts - START).total_seconds() % 1800)
        for s in (first, first - timedelta(minutes=30)):
            want[(key, s)] += 1
    assert got == want
    states = jobs.latest_state(
        events.select(F.col("key").alias("job_id"), "ts", F.when(F.col("event_id") % 3 == 0, "done").otherwise("running").alias("status"), F.col("event_id").alias("progress"))
    )
    shown = drain(states, str(tmp_path / "s2"), "states", "complete")
    newest = {}
    for i, key, ts in rows:
        newest[key] = max(newest.get(key, (ts, i)), (ts, i))
    assert {r.job_id: r.ts for r in shown.collect()} == {k: v[0] for k, v in newest.items()}


def test_jobs_batch(spark):
    rows = [
        ("j1", START, "queued", 0, None, "p"), ("j1", START + timedelta(minutes=5), "running", 40, "1.1.1.1, x", "p"),
        ("j2", START + timedelta(minutes=1), "done", 100, "1.1.1.1", "p"), ("j3", START, "running", 3, None, None),
    ]
    df = spark.createDataFrame(rows, "job_id string, ts timestamp, status string, progress int, forwarded string, peer string")
    states = {r.job_id: (r.status, r.terminal) for r in jobs.latest_state(df).collect()}
    assert states == {"j1": ("running", False), "j2": ("done", True), "j3": ("running", False)}
    assert jobs.active_total(jobs.latest_state(df)).first().active_jobs == 2
    alive = {r.job_id for r in jobs.unexpired(df, "2024-01-01 01:01:00").collect()}
    assert alive == {"j2"}
    assert {r.job_id for r in jobs.unexpired(df, "2024-01-01 01:00:00").collect()} == {"j1", "j2", "j3"}
    timed = spark.createDataFrame([("running", 50, 10), ("running", 5, 10), ("done", 50, 10), ("queued", 30, 0), ("queued", 33, 10)], "status string, progress int, elapsed int")
    assert [r.remaining for r in jobs.with_remaining(timed).collect()] == [10, None, None, None, 21]
    clients = {r.client: (r.active, r.limited) for r in jobs.active_by_client(df.filter("ts > '2024-01-01'").withColumn("forwarded", F.lit("9.9.9.9 , y")), limit=1).collect()}
    assert clients == {"9.9.9.9": (1, True)}
