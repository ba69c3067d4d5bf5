"""Streaming queries, each run to the end of the ``events`` table and compared with its batch form in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.plans.demo import Registry
from footfall.session import shared_dir
from footfall.streaming import logs, timed

R = Registry()
QUERIES, SQL = R.queries, R.sql


def run_through(spark: SparkSession, sf_dir: str, build, mode: str = "append") -> DataFrame:
    """Reads ``events`` as a stream until it ends and returns what the query wrote to Parquet.

    With mode ``complete`` the last state of every key is written by the batch sink, which overwrites itself.
    """
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    schema = batch.schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.expr("CAST(ts AS TIMESTAMP)")).drop("props")
    out = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    query = build(stream).writeStream.outputMode(mode).option("checkpointLocation", f"{out}/state").trigger(availableNow=True)
    if mode == "complete":
        query = query.foreachBatch(lambda df, _n: df.write.mode("overwrite").parquet(f"{out}/rows")).start()
    else:
        query = query.format("parquet").option("path", f"{out}/rows").start()
    query.awaitTermination()
    return spark.read.parquet(f"{out}/rows")


def run_in_turns(spark: SparkSession, sf_dir: str, build, turns: int = 4) -> DataFrame:
    """`run_through` in several micro-batches: the events are written by time in ``turns`` parts, and the stream goes on over each as it comes in."""
    batch = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.expr("CAST(ts AS TIMESTAMP)")).drop("props")
    out = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    lo, hi = batch.agg(F.min(F.unix_millis("ts")), F.max(F.unix_millis("ts"))).first()
    at = F.least(F.floor((F.unix_millis("ts") - lo) * turns / ((hi or 0) - (lo or 0) + 1)), F.lit(turns - 1))
    for n in range(turns):
        batch.filter(at == n).write.parquet(f"{out}/in/{n}")
        stream = spark.readStream.schema(batch.schema).parquet(f"{out}/in/*")
        query = build(stream).writeStream.outputMode("append").option("checkpointLocation", f"{out}/state").trigger(availableNow=True)
        query.format("parquet").option("path", f"{out}/rows").start().awaitTermination()
    return spark.read.parquet(f"{out}/rows")


def _millis(c: str):
    return F.unix_millis(F.col(c))


@R.add(
    "stream_daily_spend",
    """SELECT CAST(floor((epoch_us(ts) / 1000000.0 + 28800) / 86400.0) AS BIGINT) AS day, event_id % 2 AS service, count(*) AS calls, round(sum(value), 4) AS spent FROM events GROUP BY 1, 2""",
)
def q_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily spend ledger as a stream."""
    rows = run_through(spark, sf_dir, logs.daily_spend, "complete")
    day = F.floor((_millis("day.start") + 28_800_000) / 86_400_000).cast("long")
    return rows.select(day.alias("day"), "service", "calls", F.round("spent", 4).alias("spent"))


@R.add(
    "stream_rolling_rate",
    """
WITH l AS (SELECT event_id % 2 AS service, event_id, ts, CAST(floor(epoch_us(ts) / 1000.0) AS BIGINT) AS ms FROM events)
SELECT service, max(n) AS most FROM (SELECT service, count(*) OVER (PARTITION BY service ORDER BY ms RANGE BETWEEN 599999 PRECEDING AND CURRENT ROW) AS n FROM l) GROUP BY service""",
)
def q_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most requests within any ten minutes, as a stream."""
    rows = run_through(spark, sf_dir, lambda e: logs.rolling_rate(e, 600_000))
    return rows.groupBy((F.col("event_id") % 2).alias("service")).agg(F.max("n").cast("long").alias("most"))


@R.add(
    "stream_sessions",
    """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS fresh, event_id FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT user_id, CAST(floor(epoch_us(min(ts)) / 1000.0) AS BIGINT) AS opened, count(*) AS beats FROM s GROUP BY user_id, n""",
)
def q_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session leases as a stream."""
    rows = run_through(spark, sf_dir, lambda e: logs.session_leases(e, "6 hours"), "complete")
    return rows.select("user_id", _millis("lease.start").alias("opened"), "beats")


@R.add("stream_latency", "SELECT CAST(floor(epoch_us(ts) / 1000000.0 / 3600) AS BIGINT) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def q_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes per hour as a stream."""
    rows = run_through(spark, sf_dir, logs.latency, "complete")
    return rows.select(F.floor(_millis("w.start") / 3_600_000).cast("long").alias("hour"), "event_type", "n")


@R.add(
    "stream_circuit_breaker",
    """
SELECT event_id, CAST(CASE WHEN event_type = 'error' THEN count(*) OVER (PARTITION BY user_id, event_type, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) ELSE 0 END AS INTEGER) AS streak FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS island FROM events)""",
)
def q_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failure streaks as stateful stream processing."""
    return run_through(spark, sf_dir, logs.circuit_breaker).select("event_id", "streak")


@R.add(
    "stream_cooldowns",
    """SELECT event_id, coalesce(epoch_us(ts) - max(CASE WHEN event_type = 'error' THEN epoch_us(ts) END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 1800000000, false) AS held FROM events""",
)
def q_cooldowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cooldowns after failures as stateful stream processing."""
    return run_through(spark, sf_dir, logs.cooldowns)


@R.add(
    "stream_cache_reads",
    """SELECT event_id, CASE WHEN p IS NULL THEN 'miss' WHEN epoch_us(ts) - p <= 43200000000 THEN 'hit' ELSE 'stale' END AS verdict FROM (SELECT *, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)""",
)
def q_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache freshness as stateful stream processing."""
    return run_through(spark, sf_dir, logs.cache_reads)


@R.add(
    "stream_page_completeness",
    """
WITH p AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY user_id, CAST(floor(value) AS BIGINT) ORDER BY ts, event_id) = 1 THEN 1 ELSE 0 END AS fresh FROM events)
SELECT event_id, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS INTEGER) AS received, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) >= 40 AS complete FROM p""",
)
def q_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct pages of a sequence as they come."""
    return run_through(spark, sf_dir, logs.page_completeness)


@R.add(
    "stream_stage_timeline",
    """
SELECT event_id, event_type AS stage, CAST(floor(max(CASE WHEN changed THEN epoch_us(ts) END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) / 1000.0) AS BIGINT) AS since_ms FROM (
  SELECT *, event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS changed FROM events)""",
)
def q_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage starts as stateful stream processing."""
    rows = run_through(spark, sf_dir, logs.stage_timeline)
    return rows.select("event_id", "stage", F.floor(F.round(F.col("since") * 1_000_000) / 1000).cast("long").alias("since_ms"))


@R.add(
    "stream_budget_gate",
    """
WITH RECURSIVE s AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT event_id, user_id, n, value <= 500 AS ok, CASE WHEN value <= 500 THEN value ELSE 0 END AS spent FROM s WHERE n = 1
  UNION ALL SELECT s.event_id, s.user_id, s.n, f.spent + s.value <= 500, CASE WHEN f.spent + s.value <= 500 THEN f.spent + s.value ELSE f.spent END FROM f JOIN s ON s.user_id = f.user_id AND s.n = f.n + 1)
SELECT event_id, CASE WHEN ok THEN 'accepted' ELSE 'budget_exhausted' END AS verdict FROM f""",
)
def q_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2: greedy budget gate as stateful stream processing: a refused request spends nothing."""
    return run_through(spark, sf_dir, lambda e: logs.budget_gate(e, 500.0))


@R.add(
    "stream_first_submits",
    """SELECT user_id, event_type, count(*) AS firsts FROM (SELECT DISTINCT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1) GROUP BY user_id, event_type""",
)
def q_submits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Idempotent submits as stream deduplication: one of all events that come under an id (user and type) gets through."""
    rows = run_through(spark, sf_dir, logs.first_submits)
    return rows.groupBy("user_id", "event_type").agg(F.count("*").alias("firsts"))


@R.add(
    "stream_interruptions",
    """
WITH e AS (SELECT user_id, event_id, event_type, CAST(floor(epoch_us(ts) / 1000.0) AS BIGINT) AS ms FROM events),
n AS (SELECT *, lag(event_type) OVER w AS before, lag(ms) OVER w AS had, lead(ms) OVER w AS nxt FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ms, event_id))
SELECT user_id AS task, event_type AS stage, ms AS since_ms FROM n WHERE before IS DISTINCT FROM event_type OR before = 'purchase' OR ms > had + 86400000
UNION ALL SELECT user_id, 'interrupted', ms + 86400000 FROM n WHERE event_type <> 'purchase' AND (nxt > ms + 86400000 OR nxt IS NULL AND ms + 86400000 < (SELECT max(ms) - 3600000 FROM e))""",
)
def q_interruptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages of tasks and their interruption by a timer after a day of silence, in several micro-batches."""
    return run_in_turns(spark, sf_dir, lambda e: timed.interruptions(e, 86_400_000, ["purchase"]))


@R.add(
    "stream_submissions",
    """
WITH RECURSIVE e AS (SELECT event_id, user_id, event_type, CAST(floor(value) AS BIGINT) % 3 AS fp, CAST(floor(epoch_us(ts) / 1000.0) AS BIGINT) AS ms, row_number() OVER (PARTITION BY user_id, event_type ORDER BY CAST(floor(epoch_us(ts) / 1000.0) AS BIGINT), event_id) AS n FROM events),
f AS (SELECT event_id, user_id, event_type, n, 'created' AS verdict, event_id AS original, fp AS held, ms + 604800000 AS due FROM e WHERE n = 1
  UNION ALL SELECT e.event_id, e.user_id, e.event_type, e.n, CASE WHEN e.ms > due THEN 'created' WHEN e.fp = held THEN 'same' ELSE 'conflict' END, CASE WHEN e.ms > due THEN e.event_id ELSE original END, CASE WHEN e.ms > due THEN e.fp ELSE held END, CASE WHEN e.ms > due THEN e.ms + 604800000 ELSE due END
  FROM f JOIN e ON e.user_id = f.user_id AND e.event_type = f.event_type AND e.n = f.n + 1)
SELECT event_id, verdict, original FROM f""",
)
def q_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submissions under one request id: the first, its repeats and its conflicts, forgotten after a week."""
    ids = lambda e: e.withColumn("request_id", F.concat_ws(":", "user_id", "event_type")).withColumn("print_", F.floor("value").cast("long") % 3)
    return run_in_turns(spark, sf_dir, lambda e: timed.submissions(ids(e), "request_id", "print_"))


@R.add("stream_bounded_cache")
def q_bounded_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of a cache that tasks share, with deadlines of their sources and a bound; eviction has no short SQL, so tests replay it."""
    cols = lambda e: e.withColumns({"shard_": F.col("user_id") % 8, "entry_": F.floor("value").cast("long") % 40, "closes_": F.col("event_type") == "error"})
    return run_in_turns(spark, sf_dir, lambda e: timed.bounded_cache(cols(e), "shard_", "entry_", "user_id", "closes_", 43_200_000, 24))
