"""Audits of request logs, budgets, sessions, caches, runs, revisions and retention."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.operators import ordered

HOUR_MS, DAY_MS = 3_600_000, 86_400_000
# The quota day begins eight hours ahead of UTC; a lease lives 300 s; a failure cools for 30 s.
QUOTA_OFFSET_MS, LEASE_MS, COOL_MS = 28_800_000, 300_000, 30_000


def _bucket(at: str, span: int = HOUR_MS) -> Column:
    return F.floor(F.col(at) / span)


def dispatch_gaps(log: DataFrame, key: str, start: str, end: str, batch: str, tie: str, bucket_ms: int = HOUR_MS) -> DataFrame:
    """Per key the gaps between dispatches, across batches, and from a response to the next dispatch."""
    rows = ordered.lagged(log, key, [start, tie], [start, end, batch], _bucket(start, bucket_ms))
    gap = F.col(start) - F.col(f"prev.{start}")
    return rows.groupBy(key).agg(
        F.count(gap).alias("gaps"), F.min(gap).alias("least_gap_ms"), F.max(gap).alias("most_gap_ms"),
        F.min(F.when(F.col(batch) != F.col(f"prev.{batch}"), gap)).alias("least_cross_gap_ms"), F.min(F.col(start) - F.col(f"prev.{end}")).alias("least_after_response_ms"),
    )


def rolling_rate(log: DataFrame, key: str, at: str, window_ms: int = 1000) -> DataFrame:
    """Most events of a key in any forward window."""
    return ordered.within_ahead(log.select(key, at), key, at, window_ms, "n").groupBy(key).agg(F.max("n").alias("most_in_window"))


def most_in_flight(log: DataFrame, key: str, start: str, end: str, tie: str, bucket_ms: int = HOUR_MS) -> DataFrame:
    """Most intervals of a key open at once; one that ends as another starts is closed before."""
    steps = F.array(F.struct(F.col(start).alias("moment"), F.lit(1).alias("step")), F.struct(F.col(end).alias("moment"), F.lit(-1).alias("step")))
    moves = log.select(key, F.col(tie).alias("tie_"), F.explode(steps).alias("m")).select(key, "tie_", "m.*")
    return ordered.running(moves, key, ["moment", "step", "tie_"], F.col("step"), "open_", _bucket("moment", bucket_ms)).groupBy(key).agg(F.max("open_").alias("most_in_flight"))


def phase_accounting(log: DataFrame, phase: Column, request: str, outcome: str) -> DataFrame:
    """Reservations, distinct requests and retries per phase and outcome."""
    once = log.groupBy(phase.alias("phase"), outcome, request).agg(F.count("*").alias("n"))  # two steps: no set of requests is gathered
    return once.groupBy("phase", outcome).agg(F.sum("n").alias("n"), F.count("*").alias("confirmed"), F.sum(F.col("n") - 1).alias("retries"))


def daily_spend(log: DataFrame, key: str, at: str, cost: str, offset_ms: int = QUOTA_OFFSET_MS) -> DataFrame:
    """Calls and spend per key and quota day."""
    return log.groupBy(key, F.floor((F.col(at) + offset_ms) / DAY_MS).alias("quota_day")).agg(F.count("*").alias("calls"), F.round(F.sum(cost), 6).alias("spent"))


def budget_gate(log: DataFrame, key: str, day: Column, order: list[str], cost: str, budget: float) -> DataFrame:
    """R2: ``log`` with ``verdict``: a request is accepted if it still fits in its key's day; a refused one spends nothing.

    Whether a request fits hangs on every verdict before it, so a key's day is read as one stream in order; only its
    running spend is kept.
    """
    rows = log.withColumn("day_", day)
    whole = rows.repartition(key, "day_").sortWithinPartitions(key, "day_", *order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, spent = None, 0.0
        for pdf in batches:
            verdicts = []
            for k, d, c in zip(pdf[key].tolist(), pdf["day_"].tolist(), pdf[cost].tolist(), strict=True):
                if (k, d) != now:
                    now, spent = (k, d), 0.0
                fits = c is not None and spent + c <= budget
                spent += c if fits else 0.0
                verdicts.append("accepted" if fits else "daily_budget_exhausted")
            yield pdf.assign(verdict=verdicts)

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return whole.mapInPandas(run, names + ", verdict string").drop("day_")


def failure_streaks(log: DataFrame, key: str, order: str, failed: Column, stop_after: int = 3) -> DataFrame:
    """The longest run of failures of each key that has one, and the row at which it should have stopped."""
    marked = log.select(key, order, failed.alias("failed"))
    breaks = F.count_if(~F.col("failed")).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    streak = F.row_number().over(Window.partitionBy(key, "run_").orderBy(order))
    rows = marked.withColumn("run_", breaks).filter("failed").withColumn("streak", streak.cast("long"))
    return rows.groupBy(key).agg(F.max("streak").alias("longest"), F.min(F.when(F.col("streak") >= stop_after, F.col(order))).alias("stop_at"))


def session_leases(beats: DataFrame, session: str, at: str, tie: str, idle_ms: int = LEASE_MS) -> DataFrame:
    """Leases of a session: a heartbeat after ``idle_ms`` of silence opens a new one, it never revives the old."""
    w = Window.partitionBy(session).orderBy(at, tie)
    fresh = F.when(F.col(at) - F.lag(at).over(w) <= idle_ms, 0).otherwise(1)
    rows = beats.withColumn("fresh_", fresh).withColumn("n", F.sum("fresh_").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(F.col(session).alias("session"), "n").agg(F.count("*").alias("beats"), F.min(at).alias("opened"), (F.max(at) + idle_ms).alias("expires"))


def idempotent_submits(requests: DataFrame, key: list[Column], fingerprint: str, order: str) -> DataFrame:
    """``requests`` with ``verdict``: the first of an id creates, an equal one is replayed, another is a conflict."""
    named = requests.withColumns({f"k{i}_": c for i, c in enumerate(key)})
    keys = [f"k{i}_" for i in range(len(key))]
    firsts = named.groupBy(*keys).agg(F.min(F.struct(order, fingerprint)).alias("first_"))  # map-side; no id is sorted in one place
    same = F.col(fingerprint).eqNullSafe(F.col(f"first_.{fingerprint}"))
    verdict = F.when(F.col(order) == F.col(f"first_.{order}"), "created").when(same, "replayed").otherwise("conflict")
    return named.join(firsts, keys).withColumn("verdict", verdict).drop("first_", *keys)


def cache_freshness(reads: DataFrame, source: str, key: str, at: str, tie: str, fresh_ms: int, deadline: Column | None = None) -> DataFrame:
    """Per source how many reads a fresh value answered, a stale one or none; ``deadline`` of a read vetoes values from before it."""
    prev = F.lag(at).over(Window.partitionBy(source, key).orderBy(at, tie))
    rows = reads.select(source, F.col(at).alias("at_"), prev.alias("prev_"), (deadline if deadline is not None else F.lit(None).cast("long")).alias("deadline_"))
    fresh = (F.col("at_") - F.col("prev_") <= fresh_ms) & (F.col("deadline_").isNull() | (F.col("prev_") >= F.col("deadline_")))
    verdict = F.when(F.col("prev_").isNull(), "miss").when(fresh, "hit").otherwise("stale")
    return rows.groupBy(source, verdict.alias("verdict")).agg(F.count("*").alias("n"))


def cooldowns(log: DataFrame, key: str, at: str, tie: str, failed: Column, hold_ms: int = COOL_MS, bucket_ms: int = HOUR_MS) -> DataFrame:
    """Per key the requests that fall within ``hold_ms`` of a failure before them, and the others."""
    rows = ordered.running(log, key, [at, tie], F.when(failed, F.col(at)), "failed_at", _bucket(at, bucket_ms), "max", own=False)
    since = F.col(at) - F.col("failed_at")
    return rows.groupBy(key).agg(F.count_if(since <= hold_ms).alias("held_back"), F.count_if((since > hold_ms) | since.isNull()).alias("free"))


def latency(log: DataFrame, key: str, start: str, end: str, outcome: str, span_ms: int = HOUR_MS) -> DataFrame:
    """Outcomes and the worst latency per key and span of time."""
    return log.groupBy(key, _bucket(start, span_ms).alias("hour"), outcome).agg(F.count("*").alias("n"), F.max(F.col(end) - F.col(start)).alias("worst_ms"))


def query_coverage(calls: DataFrame, category: Column, reason: str, sequence: str) -> DataFrame:
    """A5: calls of a category by status, and its sequences that completed."""
    done = calls.select(category.alias("category"), F.when(F.col(reason) == "ok", F.col(sequence)).alias("s"), reason)
    per = done.groupBy("category", "s").agg(*[F.count_if(F.col(reason) == r).alias(n) for r, n in (("ok", "ok"), ("timeout", "timed_out"), ("rate_limit", "rate_limited"))])
    return per.groupBy("category").agg(F.sum("ok").alias("ok"), F.sum("timed_out").alias("timed_out"), F.sum("rate_limited").alias("rate_limited"), F.count("s").alias("completed_sequences"))


def keyword_completeness(rows: DataFrame, sequence: str, keyword: str, page: str, name: str, order: Column) -> DataFrame:
    """Pages of every (sequence, keyword), the latest name, and whether no page up to the last is missing."""
    pages = rows.groupBy(sequence, keyword, page).agg(F.count("*").alias("n"), F.max(F.struct(order.alias("o"), name)).alias("latest"))
    return pages.groupBy(sequence, keyword).agg(
        F.count("*").alias("pages"), F.max(page).alias("last_page"), F.sum("n").alias("rows_"), F.max("latest")[name].alias("latest"), (F.count("*") == F.max(page)).alias("complete")
    )


def run_status(calls: DataFrame, run: Column, reason: str, cancelled: str = "rate_limit") -> DataFrame:
    """A run is completed, partial, cancelled or failed by its calls; ``warnings`` counts its other reasons."""
    ok = F.col(reason) == "ok"
    status = F.when(F.bool_and(ok), "completed").when(F.bool_or(ok), "partial").when(F.bool_and(F.col(reason) == cancelled), "cancelled").otherwise("failed")
    return calls.groupBy(run.alias("run")).agg(status.alias("status"), F.count_distinct(F.when(~ok, F.col(reason))).alias("warnings"))


def page_accounting(pages: DataFrame, uses: DataFrame, page_key: Column, use_key: str, failed: Column, cached_above: int) -> DataFrame:
    """How pages were delivered, by the fetches of their key: refused (none), shared (some failed), cache (many) or live."""
    per = uses.groupBy(F.col(use_key).alias("u_")).agg(F.count("*").alias("n_"), F.count_if(failed).alias("bad_"))
    how = F.when(F.col("n_").isNull(), "refused").when(F.col("bad_") > 0, "shared").when(F.col("n_") > cached_above, "cache").otherwise("live")
    keyed = pages.groupBy(page_key.alias("k_")).agg(F.count("*").alias("pages_"))
    return keyed.join(per, F.col("k_") == F.col("u_"), "left").groupBy(how.alias("delivery")).agg(F.sum("pages_").alias("pages"))


def latest_revision(revisions: DataFrame, task: str, revision: str, ties: list[Column], upto: int | None = None) -> DataFrame:
    """The latest revision of every task (or its latest up to a given one)."""
    rows = revisions if upto is None else revisions.filter(F.col(revision) <= upto)
    return rows.withColumn("n_", F.row_number().over(Window.partitionBy(task).orderBy(F.desc(revision), *ties))).filter("n_ = 1").drop("n_")


def superseded_tasks(tasks: DataFrame, session: str, task: str, later: int = 3) -> DataFrame:
    """A task is superseded by the ``later``-th finished task of its session after it."""
    nth = F.lead(task, later).over(Window.partitionBy(session).orderBy(task))
    return tasks.withColumn("third", nth).withColumn("state", F.when(F.col("third").isNotNull(), "superseded").otherwise("kept"))


def retention(tasks: DataFrame, session: str, task: str, active: Column, expired: Column, keep: int) -> DataFrame:
    """``tasks`` with ``decision``: active ones stay, then all beyond the newest ``keep`` of a session go, then those whose session expired."""
    n = F.row_number().over(Window.partitionBy(session).orderBy(F.desc(task)))
    decision = F.when(active, "active").when(F.col("n_") > keep, "superseded").when(expired, "session_expired").otherwise("kept")
    return tasks.withColumn("n_", n).withColumn("decision", decision).drop("n_")


def orphans(stored: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """Keys that are stored but not in the index, with how many rows they hold."""
    return stored.groupBy(key).agg(F.count("*").alias("revisions")).join(index.select(key).distinct(), key, "left_anti")


def stage_clocks(updates: DataFrame, task: str, stage: str, order: list[str]) -> DataFrame:
    """Per task the spells in which its stage stayed the same: number of the update it began at, and updates."""
    w = Window.partitionBy(task).orderBy(*order)
    rows = updates.select(task, stage, F.row_number().over(w).alias("n"), F.lag(stage).over(w).alias("before"))
    began = F.when((F.col("n") == 1) | (F.col(stage) != F.col("before")), F.col("n"))
    started = F.max(began).over(Window.partitionBy(task).orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select(task, stage, started.cast("long").alias("started")).groupBy(task, stage, "started").agg(F.count("*").alias("updates"))


def after_restart(tasks: DataFrame, status: str, unfinished: str, lost: Column) -> DataFrame:
    """``tasks`` with ``state`` after a restart: unfinished ones are interrupted if their worker is lost, else they go on."""
    return tasks.withColumn("state", F.when((F.col(status) == unfinished) & lost, "interrupted").when(F.col(status) == unfinished, "running").otherwise("terminal"))
