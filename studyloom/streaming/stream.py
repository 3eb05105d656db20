"""Streaming forms: running session totals, windows over history, retention. The batch forms are in operators.history."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def daily(events: DataFrame, lateness: str = "1 day") -> DataFrame:
    """day, total_queries, total_cost by tumbling days (append: a day comes once it can't change)."""
    w = events.withWatermark("created_at", lateness).groupBy(F.window("created_at", "1 day").alias("w"))
    return w.agg(F.count("*").alias("total_queries"), F.round(F.sum("cost"), 2).alias("total_cost")).select(F.col("w.start").alias("day"), "total_queries", "total_cost")


def rolling(events: DataFrame, span: str = "30 days", slide: str = "1 day", lateness: str = "1 day") -> DataFrame:
    """user_id, until, n: queries of a user in the span up to each slide."""
    w = events.withWatermark("created_at", lateness).groupBy("user_id", F.window("created_at", span, slide).alias("w"))
    return w.agg(F.count("*").alias("n")).select("user_id", F.col("w.end").alias("until"), "n")


def session_totals(events: DataFrame, idle_minutes: int = 60, lateness: str = "1 day") -> DataFrame:
    """user_id, session_queries, session_cost of a user's running session after each batch, for display.

    An event after an idle time begins a new session; the rows of a batch are taken in order of time. What comes in another
    order over batches is counted where it comes; ``sessions`` gives final sessions that don't depend on batches.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, cost, last = state.get if state.exists else (0, 0.0, 0)
        rows = pd.concat(list(frames)).sort_values("created_at", kind="stable")
        for at, c in zip((rows["created_at"].astype("datetime64[us]").astype("int64") // 1000).tolist(), rows["cost"].fillna(0).tolist(), strict=True):
            if n and at - last > idle_minutes * 60_000:
                n, cost = 0, 0.0
            n, cost, last = n + 1, cost + float(c), max(last, at)
        state.update((n, cost, last))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs() + 1) + idle_minutes * 60_000)
        yield pd.DataFrame([(key[0], n, round(cost, 2))], columns=["user_id", "session_queries", "session_cost"])

    return events.withWatermark("created_at", lateness).groupBy("user_id").applyInPandasWithState(update, "user_id long, session_queries long, session_cost double", "n long, cost double, last long", "update", GroupStateTimeout.EventTimeTimeout)


SESSION = "user_id long, started timestamp, ended timestamp, session_queries long, session_cost double, closed_by string"


def sessions(events: DataFrame, idle_minutes: int = 60, lateness: str = "1 hour") -> DataFrame:
    """user_id, started, ended, session_queries, session_cost, closed_by of each closed session, in event time.

    events: user_id, id, created_at (timestamp), cost, reset. Events of a user that are no more than the idle time apart make
    a session; a reset closes it and is none of its queries, and what follows begins a new one. Rows wait until
    the watermark has passed them and are then taken in order of (created_at, id), so the result is free of how
    rows come in batches, as long as none is later than the lateness (later ones are dropped). A session is closed by a reset, or by
    the watermark when it stands an idle time behind the last event: ``reset`` or ``idle``. The state of a user holds the open session's sums
    and the rows of the lateness. Null costs count as none; a null user is a user; null times are dropped.
    """
    idle = idle_minutes * 60_000_000

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, cost, started, ended, waiting = state.get if state.exists else (0, 0.0, 0, 0, "[]")
        rows = json.loads(waiting)
        if not state.hasTimedOut:
            for f in frames:
                at = f["created_at"].astype("datetime64[us]").astype("int64")
                rows += zip(at.tolist(), f["id"].tolist(), f["cost"].fillna(0).astype(float).tolist(), f["reset"].fillna(False).astype(bool).tolist(), strict=True)
        passed, out = state.getCurrentWatermarkMs() * 1000, []
        rows.sort(key=lambda r: (r[0], r[1]))
        for at, _, c, reset in (r for r in rows if r[0] <= passed):
            if n and (reset and at - ended <= idle or at - ended > idle):
                out.append((started, ended, n, cost, "idle" if at - ended > idle else "reset"))
                n, cost = 0, 0.0
            if not reset:
                started = at if not n else started
                n, cost, ended = n + 1, cost + c, at
        rows = [r for r in rows if r[0] > passed]
        if n and passed > ended + idle:
            out.append((started, ended, n, cost, "idle"))
            n, cost = 0, 0.0
        if n or rows:
            state.update((n, cost, started, ended, json.dumps(rows)))
            due = min([r[0] for r in rows] + ([ended + idle] if n else []))
            state.setTimeoutTimestamp(max(due // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame({
                "user_id": [key[0]] * len(out), "started": pd.to_datetime([o[0] for o in out], unit="us"), "ended": pd.to_datetime([o[1] for o in out], unit="us"),
                "session_queries": [o[2] for o in out], "session_cost": [round(o[3], 2) for o in out], "closed_by": [o[4] for o in out],
            })

    rows = events.select("user_id", "id", "created_at", "cost", "reset").withWatermark("created_at", lateness)
    return rows.groupBy("user_id").applyInPandasWithState(update, SESSION, "n long, cost double, started long, ended long, waiting string", "append", GroupStateTimeout.EventTimeTimeout)


def sessions_of(events: DataFrame, idle_minutes: int = 60) -> DataFrame:
    """The batch form of ``sessions``: all sessions, those that nothing has closed yet with closed_by null."""
    order = W.partitionBy("user_id").orderBy("created_at", "id")
    reset, at = F.coalesce("reset", F.lit(False)), F.col("created_at")
    idle = F.expr(f"INTERVAL {idle_minutes} MINUTES")
    rows = events.where("created_at IS NOT NULL").withColumn("reset", reset)
    before, was_reset = F.lag("created_at").over(order), F.lag("reset").over(order)
    rows = rows.withColumn("starts", F.coalesce(was_reset | (at > before + idle), F.lit(True)) | F.col("reset"))
    rows = rows.withColumn("nr", F.sum(F.col("starts").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    after, next_reset = F.lead("created_at").over(order), F.lead("reset").over(order)
    closes = F.when(after > at + idle, "idle").when(next_reset, "reset")
    rows = rows.withColumn("closes", closes).where("NOT reset")
    out = rows.groupBy("user_id", "nr").agg(F.min("created_at").alias("started"), F.max("created_at").alias("ended"), F.count("*").alias("session_queries"), F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 2).alias("session_cost"), F.max("closes").alias("closed_by"))
    return out.drop("nr")


def run_available(stream: DataFrame, folder: str, checkpoint: str | None = None) -> DataFrame:
    """Run a stream over all that is there now, into files under folder, and read them. With the same checkpoint a later call goes on where this one ended, each row once."""
    spark = stream.sparkSession
    sink = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", checkpoint or f"{folder}/checkpoint")
    sink.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def in_batches(events: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str):
    """Run work (as compaction) on each micro-batch, once."""
    return events.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
