"""Sessions in event time: the stream against a plain loop, whatever the batches."""

from __future__ import annotations

import datetime as dt
from itertools import groupby

import numpy as np
import pytest
from pyspark.sql import functions as F

from studyloom.streaming import stream

SCHEMA = "user_id long, id long, created_at timestamp, cost double, reset boolean"
START = dt.datetime(2024, 1, 1)


def events(seed, n=300):
    """Bursts and pauses, also of exactly the idle time, equal times, resets next to each other, null costs, a null user."""
    rng = np.random.default_rng(seed)
    rows, now = [], {u: START for u in (1, 2, 3, None)}
    for k in range(n):
        u = [1, 2, 3, None][rng.integers(0, 4)]
        now[u] += dt.timedelta(minutes=int(rng.choice([0, 1, 20, 59, 60, 61, 300])))
        rows.append((u, k, now[u], None if k % 9 == 0 else float(k % 7), bool(rng.random() < 0.15) if k % 5 else None))
    return rows


def plain(rows, idle=dt.timedelta(minutes=60), until=None):
    """All sessions with their end; until: those closed for one who has seen all events up to then."""
    out = []
    key = lambda r: (r[0] is None, r[0] or 0)
    for _, own in groupby(sorted(rows, key=lambda r: (*key(r), r[2], r[1])), key):
        session = None
        for u, _, at, cost, reset in own:
            if session and at - session[2] > idle:
                out.append([*session, "idle"])
                session = None
            if reset:
                if session:
                    out.append([*session, "reset"])
                session = None
            elif session:
                session[2:] = [at, session[3] + 1, session[4] + (cost or 0)]
            else:
                session = [u, at, at, 1, cost or 0.0]
        if session:
            out.append([*session, "idle" if until and until - session[2] > idle else None])
    return sorted(map(tuple, out), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("user_id", "started", "ended", "session_queries", "session_cost", "closed_by").collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_batch_form(spark, seed):
    rows = events(seed)
    assert rows_of(stream.sessions_of(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


@pytest.mark.parametrize("parts,shuffled", [(1, True), (7, False), (12, True)])
def test_stream_is_free_of_batches(spark, tmp_path, parts, shuffled):
    rows = events(5)
    end = max(r[2] for r in rows) + dt.timedelta(days=3)
    rows.sort(key=lambda r: r[2])
    if shuffled:  # inside the lateness
        rng = np.random.default_rng(parts)
        rows.sort(key=lambda r: r[2] + dt.timedelta(minutes=float(rng.uniform(0, 110))))
    folder = tmp_path / "events"
    for k in range(parts):
        some = rows[k * len(rows) // parts : (k + 1) * len(rows) // parts]
        spark.createDataFrame(some, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
    spark.createDataFrame([(99, 10**6, end, 0.0, True)], SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
    read = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))
    got = stream.run_available(stream.sessions(read, lateness="2 hours"), str(tmp_path / "out"))
    assert rows_of(got) == plain(rows, until=end - dt.timedelta(hours=2))


def test_restart_goes_on(spark, tmp_path):
    """A second run with the checkpoint takes up open sessions and gives no row twice."""
    rows = sorted(events(6), key=lambda r: r[2])
    end = rows[-1][2] + dt.timedelta(days=1)
    folder, out = str(tmp_path / "events"), str(tmp_path / "out")
    spark.createDataFrame(rows[:150], SCHEMA).write.parquet(folder)
    read = spark.readStream.schema(SCHEMA).parquet(folder)
    first = rows_of(stream.run_available(stream.sessions(read), out))
    spark.createDataFrame([*rows[150:], (99, 10**6, end, 0.0, True)], SCHEMA).write.mode("append").parquet(folder)
    both = rows_of(stream.run_available(stream.sessions(read), out))
    assert both == plain(rows, until=end - dt.timedelta(hours=1)) and set(first) <= set(both) and len(first) < len(both)


def test_running_totals_see_the_pause(spark, tmp_path):
    rows = [(1, k, START + dt.timedelta(minutes=m), 1.0, None) for k, m in enumerate([0, 30, 60, 200, 210])]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/e")
    read = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/e")
    q = stream.session_totals(read).writeStream.outputMode("update").format("memory").queryName("paused").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("paused").collect()] == [(1, 2, 2.0)]


def test_daily_and_rolling_windows_equal_batches(spark, tmp_path):
    rows = events(7, 400)
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/e")
    spark.createDataFrame([(99, 10**6, START + dt.timedelta(days=400), 0.0, None)], SCHEMA).write.mode("append").parquet(f"{tmp_path}/e")
    read = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/e")
    days = stream.run_available(stream.daily(read), f"{tmp_path}/d")
    flat = spark.createDataFrame(rows, SCHEMA)
    want = flat.groupBy(F.date_trunc("day", "created_at").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("cost"), 2).alias("c"))
    assert sorted((r.day, r.total_queries, r.total_cost) for r in days.collect()) == sorted(map(tuple, want.collect()))
