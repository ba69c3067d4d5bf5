"""Audits of request logs, pagination, budgets, revisions and retention (batch forms)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from footfall.operators import history, logs
from footfall.plans.demo import Registry, demo

R = Registry()
QUERIES, SQL = R.queries, R.sql
LOG = ("dispatch_log",)

@R.twin(
    "dispatch_gaps", LOG,
    """
SELECT service, count(gap) AS gaps, min(gap) AS least_gap_ms, max(gap) AS most_gap_ms, min(CASE WHEN other THEN gap END) AS least_cross_gap_ms, min(after_response) AS least_after_response_ms FROM (
  SELECT service, start_ms - lag(start_ms) OVER (PARTITION BY service ORDER BY start_ms, event_id) AS gap, user_id <> lag(user_id) OVER (PARTITION BY service ORDER BY start_ms, event_id) AS other,
    start_ms - lag(end_ms) OVER (PARTITION BY service ORDER BY start_ms, event_id) AS after_response FROM {dispatch_log}
) t GROUP BY service""",
)
def q_dispatch_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps between dispatches, across batches, and from response to next."""
    return logs.dispatch_gaps(demo(spark, sf_dir, "dispatch_log"), "service", "start_ms", "end_ms", "user_id", "event_id")


@R.twin(
    "rolling_rate", LOG,
    """
SELECT service, max(n) AS most_in_window FROM (SELECT service, count(*) OVER (PARTITION BY service ORDER BY start_ms RANGE BETWEEN CURRENT ROW AND 599999 FOLLOWING) AS n FROM {dispatch_log}) t GROUP BY service""",
)
def q_rolling_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most events in a forward rolling window (ten minutes here, a second by default)."""
    return logs.rolling_rate(demo(spark, sf_dir, "dispatch_log"), "service", "start_ms", 600_000)


@R.twin(
    "most_in_flight", LOG,
    """
SELECT service, CAST(max(open_) AS BIGINT) AS most_in_flight FROM (
  SELECT service, sum(step) OVER (PARTITION BY service ORDER BY moment, step, event_id ROWS UNBOUNDED PRECEDING) AS open_ FROM (
    SELECT service, event_id, start_ms AS moment, 1 AS step FROM {dispatch_log} UNION ALL SELECT service, event_id, end_ms AS moment, -1 AS step FROM {dispatch_log}) e
) t GROUP BY service""",
)
def q_most_in_flight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most requests in flight at once."""
    return logs.most_in_flight(demo(spark, sf_dir, "dispatch_log"), "service", "start_ms", "end_ms", "event_id")


@R.twin(
    "phase_accounting", LOG,
    """
SELECT user_id % 5 AS phase, outcome, count(*) AS n, count(DISTINCT user_id) AS confirmed, count(*) - count(DISTINCT user_id) AS retries FROM {dispatch_log} GROUP BY user_id % 5, outcome""",
)
def q_phase_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reserved, confirmed, retries and outcomes per phase."""
    return logs.phase_accounting(demo(spark, sf_dir, "dispatch_log"), F.col("user_id") % 5, "user_id", "outcome")


@R.twin(
    "daily_spend", LOG,
    """
SELECT service, CAST(floor((start_ms + 28800000) / 86400000.0) AS BIGINT) AS quota_day, count(*) AS calls, round(sum(value), 6) AS spent FROM {dispatch_log} GROUP BY 1, 2""",
)
def q_daily_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spend per service and day of a zone eight hours ahead."""
    return logs.daily_spend(demo(spark, sf_dir, "dispatch_log"), "service", "start_ms", "value")


@R.twin(
    "budget_gate", LOG,
    """
WITH RECURSIVE s AS (
  SELECT service, CAST(floor(start_ms / 86400000.0) AS BIGINT) AS day, value, row_number() OVER (PARTITION BY service, CAST(floor(start_ms / 86400000.0) AS BIGINT) ORDER BY start_ms, event_id) AS n FROM {dispatch_log}
), f AS (
  SELECT service, day, n, value, value <= 1500 AS ok, CASE WHEN value <= 1500 THEN value ELSE 0 END AS spent FROM s WHERE n = 1
  UNION ALL SELECT s.service, s.day, s.n, s.value, f.spent + s.value <= 1500, CASE WHEN f.spent + s.value <= 1500 THEN f.spent + s.value ELSE f.spent END FROM f JOIN s ON s.service = f.service AND s.day = f.day AND s.n = f.n + 1
)
SELECT service, CASE WHEN ok THEN 'accepted' ELSE 'daily_budget_exhausted' END AS verdict, count(*) AS n, round(sum(value), 6) AS value FROM f GROUP BY 1, 2""",
)
def q_budget_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2: requests accepted while a day's running spend stays in budget."""
    gated = logs.budget_gate(demo(spark, sf_dir, "dispatch_log"), "service", F.floor(F.col("start_ms") / logs.DAY_MS), ["start_ms", "event_id"], "value", 1500.0)
    return gated.groupBy("service", "verdict").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("value"))


@R.twin(
    "failure_streaks", LOG,
    """
SELECT user_id, max(streak) AS longest, min(CASE WHEN streak >= 3 THEN event_id END) AS stop_at FROM (
  SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id, island ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS streak FROM (
    SELECT user_id, event_id, outcome, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, outcome ORDER BY event_id) AS island FROM {dispatch_log}) i WHERE outcome = 'error'
) t GROUP BY user_id""",
)
def q_failure_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive failures and the point at which to stop."""
    return logs.failure_streaks(demo(spark, sf_dir, "dispatch_log"), "user_id", "event_id", F.col("outcome") == "error")


@R.twin(
    "session_leases", LOG,
    """
SELECT user_id AS session, CAST(n AS BIGINT) AS n, count(*) AS beats, min(start_ms) AS opened, max(start_ms) + 21600000 AS expires FROM (
  SELECT user_id, start_ms, sum(fresh) OVER (PARTITION BY user_id ORDER BY start_ms, event_id ROWS UNBOUNDED PRECEDING) AS n FROM (
    SELECT user_id, event_id, start_ms, CASE WHEN start_ms - lag(start_ms) OVER (PARTITION BY user_id ORDER BY start_ms, event_id) <= 21600000 THEN 0 ELSE 1 END AS fresh FROM {dispatch_log}) g
) t GROUP BY user_id, n""",
)
def q_session_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that live until six hours without a heartbeat."""
    return logs.session_leases(demo(spark, sf_dir, "dispatch_log"), "user_id", "start_ms", "event_id", 21_600_000)


@R.twin(
    "idempotent_submits", LOG,
    """
SELECT verdict, count(*) AS n FROM (
  SELECT CASE WHEN event_id = first_value(event_id) OVER w THEN 'created' WHEN outcome = first_value(outcome) OVER w THEN 'replayed' ELSE 'conflict' END AS verdict FROM {dispatch_log}
  WINDOW w AS (PARTITION BY user_id, CAST(floor(start_ms / 86400000.0) AS BIGINT) ORDER BY event_id)
) t GROUP BY verdict""",
)
def q_idempotent_submits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first request of an id creates, an equal one replays, another conflicts."""
    done = logs.idempotent_submits(demo(spark, sf_dir, "dispatch_log"), [F.col("user_id"), F.floor(F.col("start_ms") / logs.DAY_MS)], "outcome", "event_id")
    return done.groupBy("verdict").agg(F.count("*").alias("n"))


@R.twin(
    "cache_freshness", LOG,
    """
SELECT service, verdict, count(*) AS n FROM (
  SELECT service, CASE WHEN prev IS NULL THEN 'miss' WHEN start_ms - prev <= 43200000 THEN 'hit' ELSE 'stale' END AS verdict FROM (
    SELECT service, start_ms, lag(start_ms) OVER (PARTITION BY service, user_id ORDER BY start_ms, event_id) AS prev FROM {dispatch_log}) p
) t GROUP BY service, verdict""",
)
def q_cache_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads answered by a fresh cached value, a stale one or none."""
    return logs.cache_freshness(demo(spark, sf_dir, "dispatch_log"), "service", "user_id", "start_ms", "event_id", 43_200_000)


@R.twin(
    "cooldowns", LOG,
    """
SELECT service, count_if(since <= 1800000) AS held_back, count_if(since > 1800000 OR since IS NULL) AS free FROM (
  SELECT service, start_ms - max(CASE WHEN outcome = 'error' THEN start_ms END) OVER (PARTITION BY service ORDER BY start_ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS since FROM {dispatch_log}
) t GROUP BY service""",
)
def q_cooldowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that fall in the half hour after a failure."""
    return logs.cooldowns(demo(spark, sf_dir, "dispatch_log"), "service", "start_ms", "event_id", F.col("outcome") == "error", 1_800_000)


@R.twin(
    "latency_by_hour", LOG,
    """
SELECT service, CAST(floor(start_ms / 3600000.0) AS BIGINT) AS hour, outcome, count(*) AS n, max(end_ms - start_ms) AS worst_ms FROM {dispatch_log} GROUP BY 1, 2, 3""",
)
def q_latency_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes and latency by hour."""
    return logs.latency(demo(spark, sf_dir, "dispatch_log"), "service", "start_ms", "end_ms", "outcome")


@R.add(
    "pagination_audit",
    """
WITH g AS (SELECT seq, page, list_sort(list_distinct(list(uid))) AS uids, count(*) AS rows_, CASE WHEN seq % 7 <> 0 THEN CASE WHEN (seq + page) % 11 = 0 THEN -1 ELSE max(ord) % 200 END END AS told FROM poi_rows GROUP BY seq, page),
p AS (SELECT * FROM g UNION ALL SELECT seq, max(page) + 1, NULL, 0, CASE WHEN seq % 2 = 0 THEN 90 END FROM g WHERE seq % 3 = 0 GROUP BY seq),
u AS (SELECT seq, uid, min(page) AS first_page FROM poi_rows GROUP BY seq, uid),
o AS (SELECT p.seq, p.page, count(*) AS overlap FROM p JOIN (SELECT DISTINCT seq, page, uid FROM poi_rows) r ON r.seq = p.seq AND r.page = p.page JOIN u ON u.seq = r.seq AND u.uid = r.uid AND u.first_page < p.page GROUP BY p.seq, p.page),
t AS (SELECT *, CASE WHEN told >= 0 THEN told END AS total FROM p),
w AS (
  SELECT t.seq, t.page, total, coalesce(told < 0, FALSE) AS odd, rows_ = 0 AS empty_, CAST(sum(rows_) OVER o_ AS BIGINT) AS returned, coalesce(overlap, 0) AS overlap, row_number() OVER o_ AS n,
    rows_ > 0 AND count(*) OVER (PARTITION BY t.seq, uids ORDER BY t.page) > 1 AS repeated, row_number() OVER o_ > 1 AND total IS DISTINCT FROM lag(total) OVER o_ AS total_changed
  FROM t LEFT JOIN o ON o.seq = t.seq AND o.page = t.page WINDOW o_ AS (PARTITION BY t.seq ORDER BY t.page)
), x AS (SELECT *, CASE WHEN returned > total OR (empty_ AND returned < total) THEN 'pagination_uncertain' WHEN total >= 150 THEN 'possible_truncation' WHEN total_changed OR odd THEN 'pagination_uncertain' END AS warning FROM w),
z AS (SELECT *, last_value(warning IGNORE NULLS) OVER (PARTITION BY seq ORDER BY page ROWS UNBOUNDED PRECEDING) AS last_, max(CASE WHEN total >= 150 THEN 1 ELSE 0 END) OVER (PARTITION BY seq ORDER BY page) AS cut FROM x)
SELECT seq, page, total, returned, overlap, repeated, total_changed, CASE WHEN overlap > 0 OR repeated THEN 'pagination_anomaly' WHEN empty_ OR (total < 150 AND returned >= total) THEN coalesce(last_, 'completed')
  WHEN n >= 7 THEN CASE WHEN cut = 1 THEN 'possible_truncation' ELSE 'page_limit' END END AS stop_reason FROM z""",
    ("poi_rows",),
)
def q_pagination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running returns, overlaps, repeated and empty pages, changed and invalid totals and stop reason of every page fetched."""
    rows = demo(spark, sf_dir, "poi_rows")
    told = F.when(F.col("seq") % 7 != 0, F.when((F.col("seq") + F.col("page")) % 11 == 0, -1).otherwise(F.max("ord") % 200))
    totals = rows.groupBy("seq", "page").agg(told.cast("long").alias("total"))
    empty = rows.filter("seq % 3 = 0").groupBy("seq").agg((F.max("page") + 1).alias("page")).withColumn("total", F.when(F.col("seq") % 2 == 0, 90).cast("long"))
    return history.pagination(rows.select("seq", "page", "uid"), totals.unionByName(empty), last_page=7)


@R.twin(
    "query_coverage", ("routes",),
    """
SELECT facility % 25 AS category, count_if(reason = 'ok') AS ok, count_if(reason = 'timeout') AS timed_out, count_if(reason = 'rate_limit') AS rate_limited, count(DISTINCT CASE WHEN reason = 'ok' THEN origin END) AS completed_sequences FROM {routes} GROUP BY facility % 25""",
)
def q_query_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: query coverage by category and status."""
    return logs.query_coverage(demo(spark, sf_dir, "routes"), F.col("facility") % 25, "reason", "origin")


@R.twin(
    "keyword_completeness", ("poi_rows",),
    """
SELECT seq, tag, count(DISTINCT page) AS pages, max(page) AS last_page, count(*) AS rows_, max_by(name, ord * 100 + page) AS latest, count(DISTINCT page) = max(page) AS complete FROM {poi_rows} GROUP BY seq, tag""",
)
def q_keyword_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and completeness of every sequence and keyword."""
    return logs.keyword_completeness(demo(spark, sf_dir, "poi_rows"), "seq", "tag", "page", "name", F.col("ord") * 100 + F.col("page"))


@R.twin(
    "run_status", ("routes",),
    """
SELECT origin % 100 AS run, CASE WHEN bool_and(reason = 'ok') THEN 'completed' WHEN bool_or(reason = 'ok') THEN 'partial' WHEN bool_and(reason = 'rate_limit') THEN 'cancelled' ELSE 'failed' END AS status, count(DISTINCT CASE WHEN reason <> 'ok' THEN reason END) AS warnings FROM {routes} GROUP BY origin % 100""",
)
def q_run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of a run rolled up from its calls."""
    return logs.run_status(demo(spark, sf_dir, "routes"), F.col("origin") % 100, "reason")


@R.twin(
    "page_accounting", ("routes", "dispatch_log"),
    """
SELECT CASE WHEN d.n IS NULL THEN 'refused' WHEN d.errors > 0 THEN 'shared' WHEN d.n > 70 THEN 'cache' ELSE 'live' END AS delivery, count(*) AS pages
FROM {routes} r LEFT JOIN (SELECT user_id, count(*) AS n, count_if(outcome = 'error') AS errors FROM {dispatch_log} GROUP BY user_id) d ON d.user_id = r.origin % 170 GROUP BY 1""",
)
def q_page_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each page was delivered."""
    return logs.page_accounting(demo(spark, sf_dir, "routes"), demo(spark, sf_dir, "dispatch_log"), F.col("origin") % 170, "user_id", F.col("outcome") == "error", 70)


@R.twin(
    "latest_revision", ("revisions",),
    """
SELECT task, revision, part, price FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY revision DESC, price DESC, part, supp, quantity) AS n FROM {revisions}) t WHERE n = 1""",
)
def q_latest_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest revision of every task."""
    ties = [F.desc("price"), *map(F.col, ("part", "supp", "quantity"))]
    return logs.latest_revision(demo(spark, sf_dir, "revisions"), "task", "revision", ties).select("task", "revision", "part", "price")


@R.twin(
    "superseded_tasks", ("tasks",),
    """
SELECT task, session, third, CASE WHEN third IS NOT NULL THEN 'superseded' ELSE 'kept' END AS state FROM (SELECT task, session, lead(task, 3) OVER (PARTITION BY session ORDER BY task) AS third FROM {tasks} WHERE status = 'F') t""",
)
def q_superseded_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third later finished task of a session supersedes a task."""
    done = demo(spark, sf_dir, "tasks").filter("status = 'F'")
    return logs.superseded_tasks(done, "session", "task").select("task", "session", "third", "state")


@R.twin(
    "retention_decisions", ("tasks",),
    """
SELECT decision, count(*) AS tasks, round(sum(bytes), 2) AS bytes FROM (
  SELECT bytes, CASE WHEN status = 'P' THEN 'active' WHEN least(CASE WHEN n > 5 THEN 0 END, CASE WHEN session % 10 = 0 THEN 1 END) IS NULL THEN 'kept' WHEN n > 5 THEN 'superseded' ELSE 'session_expired' END AS decision
  FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY task DESC) AS n FROM {tasks}) r
) t GROUP BY decision""",
)
def q_retention_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What retention clears and how many bytes it frees."""
    t = logs.retention(demo(spark, sf_dir, "tasks"), "session", "task", F.col("status") == "P", F.col("session") % 10 == 0, 5)
    return t.groupBy("decision").agg(F.count("*").alias("tasks"), F.round(F.sum("bytes"), 2).alias("bytes"))


@R.twin(
    "orphaned_folders", ("tasks", "revisions"),
    """
SELECT r.task, count(*) AS revisions FROM {revisions} r WHERE NOT EXISTS (SELECT 1 FROM {tasks} t WHERE t.task = r.task AND t.status <> 'P') GROUP BY r.task""",
)
def q_orphaned_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored revisions without an index row."""
    index = demo(spark, sf_dir, "tasks").filter("status <> 'P'")
    return logs.orphans(demo(spark, sf_dir, "revisions"), index, "task")


@R.twin(
    "stage_clocks", ("revisions",),
    """
SELECT task, stage, CAST(started AS BIGINT) AS started, count(*) AS updates FROM (
  SELECT task, revision, stage, max(CASE WHEN changed THEN n END) OVER (PARTITION BY task ORDER BY n ROWS UNBOUNDED PRECEDING) AS started FROM (
    SELECT task, revision, stage, n, n = 1 OR stage <> lag(stage) OVER (PARTITION BY task ORDER BY n) AS changed FROM (
      SELECT task, revision, stage, row_number() OVER (PARTITION BY task ORDER BY revision, part, supp, price, quantity, stage) AS n FROM {revisions}) a) b
) t GROUP BY task, stage, started""",
)
def q_stage_clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage keeps its start while it stays the same."""
    return logs.stage_clocks(demo(spark, sf_dir, "revisions"), "task", "stage", ["revision", "part", "supp", "price", "quantity", "stage"])


@R.twin(
    "interrupted_tasks", ("tasks",),
    """
SELECT CASE WHEN status = 'O' AND task % 4 = 0 THEN 'interrupted' WHEN status = 'O' THEN 'running' ELSE 'terminal' END AS state, priority, count(*) AS n FROM {tasks} GROUP BY 1, 2""",
)
def q_interrupted_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unfinished tasks marked after a restart."""
    t = logs.after_restart(demo(spark, sf_dir, "tasks"), "status", "O", F.col("task") % 4 == 0)
    return t.groupBy("state", "priority").agg(F.count("*").alias("n"))


@R.add(
    "request_fingerprints",
    """SELECT o_orderkey AS task, sha256('{"day":"' || strftime(o_orderdate, '%Y-%m-%d') || '","priority":"' || o_orderpriority || '"}') AS fingerprint FROM orders""",
)
def q_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical JSON digest of every request."""
    t = demo(spark, sf_dir, "tasks").select("task", F.date_format("day", "yyyy-MM-dd").alias("day"), "priority")
    return t.select("task", history.digest(["priority", "day"]).alias("fingerprint"))


@R.add(
    "admission_refusals",
    """SELECT coalesce(CASE WHEN o_custkey % 20 <= 0 OR o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN 'task_budget_exhausted' WHEN o_custkey % 20 > o_orderkey % 13 THEN 'budget_too_small' END, 'admitted') AS refusal, count(*) AS n FROM orders GROUP BY 1""",
)
def q_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which ceiling refuses a request before it starts."""
    from footfall.functions.rules import admission

    t = demo(spark, sf_dir, "tasks")
    why = admission(F.col("session") % 20, F.when(F.col("task") % 5 == 0, 1).otherwise(0), F.col("task") % 13, F.lit(None).cast("long"))
    return t.select(F.coalesce(why, F.lit("admitted")).alias("refusal")).groupBy("refusal").agg(F.count("*").alias("n"))


@R.add(
    "interval_merge",
    """
WITH s AS (SELECT service, start_ms AS a, start_ms + 600000 AS b, event_id FROM dispatch_log),
m AS (SELECT *, max(b) OVER (PARTITION BY service ORDER BY a, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM s),
i AS (SELECT *, sum(CASE WHEN prev IS NULL OR a > prev THEN 1 ELSE 0 END) OVER (PARTITION BY service ORDER BY a, event_id ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT service, min(a) AS start_at, max(b) AS end_at, count(*) AS parts FROM i GROUP BY service, island""",
    LOG,
)
def q_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping and touching intervals merged."""
    s = demo(spark, sf_dir, "dispatch_log").select("service", F.col("start_ms").alias("start_at"), (F.col("start_ms") + 600000).alias("end_at"))
    return history.merge_intervals(s, "service", "start_at", "end_at")


@R.add(
    "evenly_spaced_pick",
    """
WITH r AS (SELECT seq, uid, row_number() OVER (PARTITION BY seq ORDER BY uid) - 1 AS i, count(*) OVER (PARTITION BY seq) AS n FROM (SELECT DISTINCT seq, uid FROM poi_rows))
SELECT seq, uid, CAST(i AS INTEGER) AS i FROM r WHERE list_contains(list_transform(range(10), lambda j: CAST(round(j * (n - 1) / 9.0) AS BIGINT)), i)""",
    ("poi_rows",),
)
def q_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten evenly spaced members of every sorted list."""
    rows = demo(spark, sf_dir, "poi_rows").select("seq", "uid").distinct()
    w = Window.partitionBy("seq")
    ranked = rows.select("seq", "uid", (F.row_number().over(w.orderBy("uid")) - 1).alias("i"), F.count("*").over(w).alias("n"))
    picks = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda j: F.round(j * (F.col("n") - 1) / 9.0).cast("int"))
    return ranked.filter(F.array_contains(picks, F.col("i"))).select("seq", "uid", "i")
