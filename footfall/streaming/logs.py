"""Structured Streaming forms of the log operators.

Each takes a streaming (or batch) DataFrame of events ``event_id, ts, user_id, event_type, value`` and
returns one of the same kind. Stateful ones keep one small state per key; a key's rows of a micro-batch, which may come
in several frames and in any order, are put in order of time as a whole. State is given up ``IDLE_MS`` after the key's
last event, by the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATE = "1 hour"
#: Milliseconds without an event after which a key's state is given up.
IDLE_MS = 7 * 86_400_000


def daily_spend(events: DataFrame, zone_hours: int = 8) -> DataFrame:
    """Spend per service and day of a zone ahead of UTC: tumbling windows of a day."""
    day = F.window("ts", "1 day", "1 day", f"{24 - zone_hours} hours")
    return events.withWatermark("ts", LATE).groupBy(day.alias("day"), (F.col("event_id") % 2).alias("service")).agg(F.count("*").alias("calls"), F.sum("value").alias("spent"))


def rolling_rate(events: DataFrame, length_ms: int = 1000) -> DataFrame:
    """``event_id, n``: how many of a service's requests came within ``length_ms`` up to and with each: the greatest is the rate.

    What counts for a request lies in its own stretch of ``length_ms`` or the one before, so every request is sent to its
    own and to the next: a stretch of a service is a key, and its state is as large as the rate.
    """

    def step(_k, rows, state):
        recent, out = list((state or ([],))[0]), []
        for at in rows["ms"].tolist():
            recent = [t for t in recent if t > at - length_ms] + [at]
            out.append(len(recent))
        return pd.DataFrame({"event_id": rows["event_id"], "n": out})[rows["own"].to_numpy()], (recent,)

    at = events.withColumn("ms", F.unix_millis("ts"))
    stretch = F.floor(F.col("ms") / length_ms)
    sent = at.withColumn("d_", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("own", F.col("d_") == 0)
    return _stateful(sent.withColumn("stretch", F.concat_ws(":", F.col("event_id") % 2, stretch + F.col("d_"))), "stretch", "event_id long, n int", "recent array<long>", step)


def session_leases(events: DataFrame, gap: str = "5 minutes") -> DataFrame:
    """Sessions that end ``gap`` after their last heartbeat; a heartbeat behind the watermark revives none."""
    return events.withWatermark("ts", LATE).groupBy(F.session_window("ts", gap).alias("lease"), "user_id").agg(F.count("*").alias("beats"))


def first_submits(events: DataFrame) -> DataFrame:
    """One event per request id (here user and type) within the watermark."""
    return events.withWatermark("ts", LATE).dropDuplicatesWithinWatermark(["user_id", "event_type"])


def latency(events: DataFrame, length: str = "1 hour") -> DataFrame:
    """Outcomes and approximate latency percentiles per window."""
    w = F.window("ts", length).alias("w")
    return events.withWatermark("ts", LATE).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.percentile_approx("value", 0.95, 1000).alias("p95"))


def in_order(frames: Iterator[pd.DataFrame], time: str) -> pd.DataFrame:
    """All rows of a key's frames by time and event: frames are cut by size, not by time, wherever a key's rows exceed one."""
    got = list(frames)
    rows = got[0] if len(got) == 1 else pd.concat(got, ignore_index=True)
    if len(rows) == 1:  # most keys: nothing to sort
        return rows
    return rows.iloc[np.lexsort((rows["event_id"].to_numpy(), rows[time].to_numpy()))].reset_index(drop=True)


def _stateful(events: DataFrame, key: str, schema: str, state: str, step, idle_ms: int = IDLE_MS) -> DataFrame:
    """Runs ``step(key, rows, state or None) -> (output frame, new state)`` over a key's rows of a micro-batch; ``us`` is their time in microseconds."""
    fields = [f.split()[0] for f in schema.split(", ")]

    def run(k: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        rows = in_order(frames, "us")
        out, now = step(k[0], rows, held.get if held.exists else None)
        yield out[fields]
        held.update(now)
        held.setTimeoutTimestamp(max(int(rows["us"].iloc[-1]) // 1000, held.getCurrentWatermarkMs()) + idle_ms)

    return events.withColumn("us", F.unix_micros("ts")).withWatermark("ts", LATE).groupBy(key).applyInPandasWithState(run, schema, state, "append", GroupStateTimeout.EventTimeTimeout)


def budget_gate(events: DataFrame, budget: float) -> DataFrame:
    """R2: ``event_id, verdict``: accepted while a user's cumulative accepted spend stays within the budget."""

    def step(_k, rows, state):
        spent, verdicts = (state or (0.0,))[0], []
        for v in rows["value"]:
            ok = spent + v <= budget
            spent += v if ok else 0.0
            verdicts.append("accepted" if ok else "budget_exhausted")
        return pd.DataFrame({"event_id": rows["event_id"], "verdict": verdicts}), (spent,)

    return _stateful(events, "user_id", "event_id long, verdict string", "spent double", step)


def circuit_breaker(events: DataFrame, limit: int = 3) -> DataFrame:
    """``event_id, streak, open``: failures in a row per user, and whether the breaker is open."""

    def step(_k, rows, state):
        streak, out = (state or (0,))[0], []
        for kind in rows["event_type"]:
            streak = streak + 1 if kind == "error" else 0
            out.append(streak)
        return pd.DataFrame({"event_id": rows["event_id"], "streak": out, "open": [s >= limit for s in out]}), (streak,)

    return _stateful(events, "user_id", "event_id long, streak int, open boolean", "streak int", step)


def cooldowns(events: DataFrame, seconds: float = 1800.0) -> DataFrame:
    """``event_id, held``: does a user's event fall within the cooldown after a failure?"""

    def step(_k, rows, state):
        until, out = (state or (None,))[0], []
        for at, kind in zip(rows["us"].tolist(), rows["event_type"], strict=True):
            out.append(until is not None and at <= until)
            until = at + round(seconds * 1_000_000) if kind == "error" else until
        return pd.DataFrame({"event_id": rows["event_id"], "held": out}), (until,)

    return _stateful(events, "user_id", "event_id long, held boolean", "until long", step)


def cache_reads(events: DataFrame, fresh_seconds: float = 43_200.0) -> DataFrame:
    """``event_id, verdict``: miss, hit or stale by the age of the user's last value."""

    def step(_k, rows, state):
        last, out = (state or (None,))[0], []
        for at in rows["us"].tolist():
            out.append("miss" if last is None else "hit" if at - last <= fresh_seconds * 1_000_000 else "stale")
            last = at
        return pd.DataFrame({"event_id": rows["event_id"], "verdict": out}), (last,)

    return _stateful(events, "user_id", "event_id long, verdict string", "last long", step)


def stage_timeline(events: DataFrame) -> DataFrame:
    """``event_id, stage, since``: a user's stage keeps its start while it stays the same."""

    def step(_k, rows, state):
        stage, since = state or (None, None)
        out = []
        for at, kind in zip(rows["us"].tolist(), rows["event_type"], strict=True):
            if since is None or kind != stage:
                stage, since = kind, at / 1_000_000
            out.append(since)
        return pd.DataFrame({"event_id": rows["event_id"], "stage": rows["event_type"], "since": out}), (stage, since)

    return _stateful(events, "user_id", "event_id long, stage string, since double", "stage string, since double", step)


def page_completeness(events: DataFrame, pages: int = 40) -> DataFrame:
    """``event_id, received, complete``: how many distinct pages of a sequence have come (a page sent again counts once)."""

    def step(_k, rows, state):
        got, out = set((state or ([],))[0]), []
        for page in rows["page"]:
            got.add(int(page))
            out.append(len(got))
        return pd.DataFrame({"event_id": rows["event_id"], "received": out, "complete": [g >= pages for g in out]}), (sorted(got),)

    return _stateful(events.withColumn("page", F.floor("value").cast("long")), "user_id", "event_id long, received int, complete boolean", "got array<long>", step)
