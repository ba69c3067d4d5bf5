"""Accuracy of predicted boundaries: confusion, intervals, gates, pairing, sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from footfall.functions import stats
from footfall.functions.rules import issues
from footfall.operators import accuracy
from footfall.plans.demo import Registry, demo

R = Registry()
QUERIES, SQL = R.queries, R.sql

@R.twin(
    "confusion_matrix", ("cases",),
    """
SELECT stratum, count_if(truth AND prediction) AS tp, count_if(NOT truth AND prediction) AS fp, count_if(truth AND NOT prediction) AS fn, count_if(NOT truth AND NOT prediction) AS tn,
  count_if(truth IS NULL) AS undecided, round(count_if(truth = prediction) / CAST(nullif(count(truth), 0) AS DOUBLE), 9) AS accuracy,
  round(count_if(truth AND prediction) / CAST(nullif(count_if(truth), 0) AS DOUBLE), 9) AS recall, round(count_if(truth AND prediction) / CAST(nullif(count_if(prediction AND truth IS NOT NULL), 0) AS DOUBLE), 9) AS precision_
FROM {cases} GROUP BY stratum""",
)
def q_confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-state confusion matrix and rates per stratum."""
    return accuracy.confusion(demo(spark, sf_dir, "cases"), "stratum", "truth", "prediction")


@R.twin(
    "case_labels", ("cases",),
    """
SELECT stratum, label, count(*) AS n FROM (
  SELECT stratum, CASE WHEN truth IS NULL THEN 'undecided' WHEN truth = prediction THEN 'correct' WHEN abs(duration - 900) <= 15 THEN 'within_tolerance' WHEN prediction THEN 'false_inclusion' ELSE 'false_exclusion' END AS label FROM {cases}
) t GROUP BY stratum, label""",
)
def q_case_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case labels with a 15 s tolerance."""
    label = accuracy.case_label(F.col("truth"), F.col("prediction"), F.col("duration"))
    return demo(spark, sf_dir, "cases").groupBy("stratum", label.alias("label")).agg(F.count("*").alias("n"))


@R.add(
    "stratified_wilson",
    """
WITH g AS (SELECT stratum, count(truth) AS n, count(*) FILTER (WHERE truth = prediction) AS ok, count(*) FILTER (WHERE prediction AND NOT truth) AS fi, count(*) FILTER (WHERE truth AND NOT prediction) AS fe
  FROM cases GROUP BY ROLLUP (stratum))
SELECT coalesce(stratum, 'all') AS stratum, n, ok, round(ok / n, 9) AS accuracy,
  round((ok / n + 1.96 ** 2 / (2 * n) - 1.96 * sqrt(ok / n * (1 - ok / n) / n + 1.96 ** 2 / (4.0 * n * n))) / (1 + 1.96 ** 2 / n), 9) AS lower,
  round((ok / n + 1.96 ** 2 / (2 * n) + 1.96 * sqrt(ok / n * (1 - ok / n) / n + 1.96 ** 2 / (4.0 * n * n))) / (1 + 1.96 ** 2 / n), 9) AS upper,
  round(fi / n, 9) AS false_inclusion, round(fe / n, 9) AS false_exclusion FROM g""",
    ("cases",),
)
def q_wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy with a Wilson 95 % interval per stratum and over all."""
    g = demo(spark, sf_dir, "cases").rollup("stratum").agg(
        F.count("truth").alias("n"), F.count_if(F.expr("truth = prediction")).alias("ok"), F.count_if(F.expr("prediction AND NOT truth")).alias("fi"), F.count_if(F.expr("truth AND NOT prediction")).alias("fe")
    )
    lower, upper = stats.wilson(F.col("ok"), F.col("n"))
    n = F.col("n")
    return g.select(F.coalesce("stratum", F.lit("all")).alias("stratum"), "n", "ok", F.round(F.col("ok") / n, 9).alias("accuracy"), F.round(lower, 9).alias("lower"), F.round(upper, 9).alias("upper"), F.round(F.col("fi") / n, 9).alias("false_inclusion"), F.round(F.col("fe") / n, 9).alias("false_exclusion"))


@R.twin(
    "area_weighted_accuracy", ("cases",),
    """
SELECT round(sum(area * ok / n) / sum(area), 9) AS accuracy, CAST(sum(area) AS BIGINT) AS area FROM (
  SELECT stratum, CAST(count_if(truth = prediction) AS DOUBLE) AS ok, count(truth) AS n, CAST(CASE stratum WHEN 'A' THEN 300 WHEN 'N' THEN 500 ELSE 200 END AS BIGINT) AS area FROM {cases} GROUP BY stratum
) t""",
)
def q_area_weighted_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy weighted by the areas of the strata."""
    area = F.when(F.col("stratum") == "A", 300).when(F.col("stratum") == "N", 500).otherwise(200)
    return accuracy.weighted_accuracy(demo(spark, sf_dir, "cases"), "stratum", "truth", "prediction", area.cast("long"))


@R.add(
    "paired_sign_test",
    """
WITH p AS (SELECT stratum, count(*) FILTER (WHERE truth = prediction AND truth <> (duration <= 850)) AS wins, count(*) FILTER (WHERE truth <> prediction AND truth = (duration <= 850)) AS losses FROM cases GROUP BY stratum),
k AS (SELECT stratum, wins, losses, wins + losses AS n, unnest(range(0, least(wins, losses) + 1)) AS i FROM p)
SELECT stratum, wins, losses, round(least(1.0, 2 * sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2)))), 6) AS p_value FROM k GROUP BY stratum, wins, losses""",
    ("cases",),
)
def q_sign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact paired sign test of the prediction against a shifted threshold."""
    p = demo(spark, sf_dir, "cases").groupBy("stratum").agg(F.count_if(F.expr("truth = prediction AND truth <> (duration <= 850)")).alias("wins"), F.count_if(F.expr("truth <> prediction AND truth = (duration <= 850)")).alias("losses"))
    return p.select("stratum", "wins", "losses", F.round(stats.sign_test(F.col("wins"), F.col("losses")), 6).alias("p_value"))


@R.add(
    "acceptance_gate",
    """
WITH g AS (SELECT stratum, count(*) AS n, count(truth) AS decided, avg(CAST(truth = prediction AS DOUBLE)) AS acc FROM cases GROUP BY stratum)
SELECT stratum, array_to_string(list_sort(list_filter([CASE WHEN decided < 0.96 * n THEN 'too_few_decided' END, CASE WHEN acc < 0.9 THEN 'accuracy_below_target' END, CASE WHEN decided < 100 THEN 'small_sample' END], lambda x: x IS NOT NULL)), ',') AS reasons,
  decided < 0.96 * n OR acc < 0.9 OR decided < 100 AS failed FROM g""",
    ("cases",),
)
def q_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acceptance gate with the sorted list of failed tests."""
    g = demo(spark, sf_dir, "cases").groupBy("stratum").agg(F.count("*").alias("n"), F.count("truth").alias("decided"), F.avg(F.expr("CAST(truth = prediction AS DOUBLE)")).alias("acc"))
    bad = issues(("too_few_decided", F.col("decided") < 0.96 * F.col("n")), ("accuracy_below_target", F.col("acc") < 0.9), ("small_sample", F.col("decided") < 100))
    return g.select("stratum", F.concat_ws(",", bad).alias("reasons"), (F.size(bad) > 0).alias("failed"))


@R.twin(
    "macro_by_family", ("cases",),
    """
SELECT family, CASE WHEN count(*) = count(m) THEN round(avg(m), 9) END AS macro, count(*) AS groups_ FROM (
  SELECT stratum AS family, line, avg(CASE WHEN truth = prediction THEN 1.0 WHEN truth IS NOT NULL THEN 0.0 END) AS m FROM {cases} GROUP BY stratum, line
) t GROUP BY family""",
)
def q_macro_by_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of group means per family, null if any group has none."""
    right = F.when(F.col("truth") == F.col("prediction"), 1.0).when(F.col("truth").isNotNull(), 0.0)
    return accuracy.macro_average(demo(spark, sf_dir, "cases"), "stratum", "line", right)


@R.twin(
    "paired_guards", ("cases",),
    """
SELECT stratum, count_if(NOT before_severe AND after_severe) AS new_severe, count_if(before_severe AND NOT after_severe) AS mended, bool_or(after_severe) AS any_severe FROM (
  SELECT stratum, coalesce(duration > 1020 AND prediction, false) AS before_severe, coalesce(duration > 960 AND prediction AND line % 2 = 0, false) AS after_severe FROM {cases}
) t GROUP BY stratum""",
)
def q_paired_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severe errors before and after, new and mended."""
    before, after = F.expr("duration > 1020 AND prediction"), F.expr("duration > 960 AND prediction AND line % 2 = 0")
    return accuracy.paired_guards(demo(spark, sf_dir, "cases"), "stratum", before, after)


@R.twin(
    "group_scores", ("cases",),
    """
SELECT grp, count(*) AS n, count_if(prediction AND NOT truth) AS false_accept, count_if(NOT prediction AND truth) AS missed, count_if(truth IS NULL) AS pending, round(sum(CASE WHEN prediction <> truth THEN abs(duration - 900) / 60.0 ELSE 0 END), 6) AS wrong_minutes FROM (
  SELECT *, 'all' AS grp FROM {cases} UNION ALL SELECT *, 'stratum_' || stratum FROM {cases} UNION ALL SELECT *, 'near_edge' FROM {cases} WHERE abs(duration - 900) <= 60 UNION ALL SELECT *, 'first_line' FROM {cases} WHERE line = 1
) t GROUP BY grp""",
)
def q_group_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by group, one case in many groups."""
    groups = [F.lit("all"), F.concat(F.lit("stratum_"), "stratum"), F.when(F.abs(F.col("duration") - 900) <= 60, "near_edge"), F.when(F.col("line") == 1, "first_line")]
    return accuracy.group_scores(demo(spark, sf_dir, "cases"), groups, "truth", "prediction", "duration")


@R.twin(
    "held_out_quadrants", ("cases", "demand"),
    """
SELECT CASE WHEN d.x >= 0 AND d.y >= 0 THEN 'NE' WHEN d.x < 0 AND d.y >= 0 THEN 'NW' WHEN d.x < 0 THEN 'SW' ELSE 'SE' END AS quadrant, count(*) AS n, count_if(c.truth = c.prediction) AS correct, count_if(c.truth IS NULL) AS invalid
FROM {cases} c JOIN {demand} d ON d.id = c.ord WHERE NOT EXISTS (SELECT 1 FROM {demand} s WHERE s.id % 3 = 0 AND s.id = c.ord)
GROUP BY 1""",
)
def q_held_out_quadrants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out points (no sampled point among them) by quadrant."""
    points = demo(spark, sf_dir, "cases").join(demo(spark, sf_dir, "demand").select(F.col("id").alias("ord"), "x", "y"), "ord")
    seen = demo(spark, sf_dir, "demand").filter("id % 3 = 0").select(F.col("id").alias("ord"))
    return accuracy.quadrant_metrics(accuracy.held_out(points, seen, "ord"), F.col("x"), F.col("y"), "truth", "prediction")


@R.twin(
    "log_stability", ("dispatch_log",),
    """
SELECT service, round(avg(CASE WHEN outcome = 'error' THEN 1.0 ELSE 0.0 END), 9) AS error_share, round(avg(CASE WHEN outcome IN ('view', 'click') THEN 1.0 ELSE 0.0 END), 9) AS valid_share,
  CAST(percentile_disc(0.5) WITHIN GROUP (ORDER BY end_ms - start_ms) AS BIGINT) AS p50_ms, CAST(percentile_disc(0.95) WITHIN GROUP (ORDER BY end_ms - start_ms) AS BIGINT) AS p95_ms, max(end_ms - start_ms) AS max_ms,
  avg(CASE WHEN outcome = 'error' THEN 1.0 ELSE 0.0 END) <= 0.25 AS stable
FROM {dispatch_log} GROUP BY service""",
)
def q_log_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares, nearest-rank latencies and pass flag per service."""
    return accuracy.log_stability(demo(spark, sf_dir, "dispatch_log"), "service", "outcome", F.col("end_ms") - F.col("start_ms"), "error", ("view", "click"), 0.25)


@R.twin(
    "benchmark_summary", ("cases",),
    """
SELECT stratum, line AS budget, count(*) AS runs, count_if(truth IS NULL) AS failed, round(avg(CASE WHEN truth IS NULL THEN 0.0 ELSE 1.0 - abs(duration - 900) / 900.0 END), 9) AS mean_iou, round(min(CASE WHEN truth IS NULL THEN 0.0 ELSE 1.0 - abs(duration - 900) / 900.0 END), 9) AS least_iou,
  round(avg(CASE WHEN prediction THEN 1.0 - abs(duration - 900) / 900.0 END), 9) AS arm_true, round(avg(CASE WHEN NOT prediction THEN 1.0 - abs(duration - 900) / 900.0 END), 9) AS arm_false
FROM {cases} GROUP BY stratum, line""",
)
def q_benchmark_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark summary by set and budget, invalid runs as zero, arms side by side."""
    score = 1.0 - F.abs(F.col("duration") - 900) / 900.0
    return accuracy.benchmark_summary(demo(spark, sf_dir, "cases"), [F.col("stratum"), F.col("line").alias("budget")], F.col("truth").isNotNull(), score, F.col("prediction"))


@R.twin(
    "attribution_loss", ("poi_rows",),
    """
SELECT tag, count(*) AS groups_, count_if(n > 1) AS merged, CAST(sum(CASE WHEN n > 1 THEN n - 1 ELSE 0 END) AS BIGINT) AS lost FROM (SELECT tag, name, count(DISTINCT uid) AS n FROM {poi_rows} GROUP BY tag, name) t GROUP BY tag""",
)
def q_attribution_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many members merged groups lose."""
    return accuracy.attribution_loss(demo(spark, sf_dir, "poi_rows"), "tag", "name", "uid")


@R.twin(
    "recall_by_major", ("poi_rows",),
    """
SELECT coalesce(tag, 'all') AS major, coalesce(name, 'all') AS minor, count(DISTINCT uid) AS fixture, count(DISTINCT CASE WHEN seq % 2 = 0 THEN uid END) AS found, round(count(DISTINCT CASE WHEN seq % 2 = 0 THEN uid END) / CAST(count(DISTINCT uid) AS DOUBLE), 9) AS recall
FROM {poi_rows} GROUP BY ROLLUP (tag, name)""",
)
def q_recall_by_major(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall against the fixture by minor, major and over all."""
    return accuracy.recall(demo(spark, sf_dir, "poi_rows"), "tag", "name", "uid", F.col("seq") % 2 == 0)


@R.twin(
    "transitions", ("cases",),
    """
SELECT truth, before_, count_if(after_ = 'in') AS to_in, count_if(after_ = 'out') AS to_out, count_if(after_ = 'unknown') AS to_unknown FROM (
  SELECT truth, CASE WHEN duration % 7 = 0 THEN 'unknown' WHEN prediction THEN 'in' ELSE 'out' END AS before_, CASE WHEN duration % 11 = 0 THEN 'unknown' WHEN duration <= 880 THEN 'in' ELSE 'out' END AS after_ FROM {cases}
) t GROUP BY truth, before_""",
)
def q_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitions between three states, split by truth."""
    d = F.col("duration")
    before = F.when(d % 7 == 0, "unknown").when(F.col("prediction"), "in").otherwise("out")
    after = F.when(d % 11 == 0, "unknown").when(d <= 880, "in").otherwise("out")
    return accuracy.transitions(demo(spark, sf_dir, "cases"), "truth", before, after)


@R.add(
    "error_attribution",
    """
WITH w AS (SELECT *, abs(duration - 900) <= 60 AS near, duration % 5 = 0 AS stale, line > 5 AS late FROM cases WHERE truth <> prediction)
SELECT ord, line, duration, stratum, array_to_string(list_sort(list_filter([CASE WHEN near THEN 'near_boundary' END, CASE WHEN stale THEN 'stale_sample' END, CASE WHEN late THEN 'late_line' END], lambda x: x IS NOT NULL)), ',') AS labels,
  CASE WHEN stale THEN 'stale_sample' WHEN near THEN 'near_boundary' WHEN late THEN 'late_line' ELSE 'model_error' END AS primary_cause FROM w""",
    ("cases",),
)
def q_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping labels and one primary cause for every wrong case."""
    w = demo(spark, sf_dir, "cases").filter("truth <> prediction")
    near, stale, late = F.expr("abs(duration - 900) <= 60"), F.expr("duration % 5 = 0"), F.expr("line > 5")
    labels = issues(("near_boundary", near), ("stale_sample", stale), ("late_line", late))
    cause = F.when(stale, "stale_sample").when(near, "near_boundary").when(late, "late_line").otherwise("model_error")
    return w.select("ord", "line", "duration", "stratum", F.concat_ws(",", labels).alias("labels"), cause.alias("primary_cause"))


@R.twin(
    "held_out_time_error", ("routes",),
    """
SELECT CASE WHEN NOT endpoint_verified THEN 'endpoint_unverified' WHEN reason <> 'ok' THEN 'upstream_' || reason WHEN n_durations > 1 THEN 'conflicting_endpoint' ELSE 'used' END AS exclusion,
  count(*) AS n, round(avg(abs(duration - distance_m / 1.3)), 6) AS mae, round(avg(duration - distance_m / 1.3), 6) AS bias
FROM (SELECT r.*, k.n_durations FROM {routes} r JOIN (SELECT origin, facility, count(DISTINCT duration) AS n_durations FROM {routes} GROUP BY origin, facility) k ON k.origin = r.origin AND k.facility = r.facility) t GROUP BY 1""",
)
def q_held_out_time_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time error of held-out observations by named exclusion."""
    return accuracy.time_error(demo(spark, sf_dir, "routes"), "origin", "facility", "endpoint_verified", "reason", "duration", F.col("distance_m") / 1.3)


@R.twin(
    "ledger_reconciliation", ("dispatch_log",),
    """
SELECT coalesce(d.phase, e.phase) AS phase, d.declared, e.events, e.retries, coalesce(d.declared = e.events, false) AS agrees FROM
  (SELECT 'p' || (user_id % 5) AS phase, count(DISTINCT event_id) AS declared FROM {dispatch_log} WHERE NOT (user_id % 5 = 3 AND outcome = 'error') GROUP BY 1) d FULL OUTER JOIN
  (SELECT phase, CAST(sum(n) AS BIGINT) AS events, CAST(sum(n - 1) AS BIGINT) AS retries FROM (SELECT 'p' || (user_id % 5) AS phase, user_id, count(*) AS n FROM {dispatch_log} GROUP BY 1, 2) t GROUP BY phase) e ON d.phase = e.phase""",
)
def q_ledger_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared counts against counted events per phase, with retries."""
    log = demo(spark, sf_dir, "dispatch_log").withColumn("phase", F.concat(F.lit("p"), F.col("user_id") % 5))
    # The ledger forgets what came after an error in phase p3.
    declared = log.filter("NOT (phase = 'p3' AND outcome = 'error')").groupBy("phase").agg(F.count("*").alias("declared"))
    return accuracy.reconciled(declared, log, "phase", "user_id")


@R.twin(
    "measurement_status", ("dispatch_log", "facilities"),
    """
SELECT status, count(*) AS points FROM (
  SELECT f.id, CASE WHEN e.n IS NULL THEN 'not_sent' WHEN e.valid > 0 THEN 'valid' WHEN e.errors > 0 THEN 'invalid' ELSE 'reserved' END AS status
  FROM {facilities} f LEFT JOIN (SELECT user_id, count(*) AS n, count_if(outcome = 'purchase') AS valid, count_if(outcome = 'error') AS errors FROM {dispatch_log} GROUP BY user_id) e ON e.user_id = f.id
) t GROUP BY status""",
)
def q_measurement_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurement status of every reference point."""
    done = accuracy.measurement_status(demo(spark, sf_dir, "facilities"), demo(spark, sf_dir, "dispatch_log"), "id", "user_id", F.col("outcome") == "purchase", F.col("outcome") == "error")
    return done.groupBy("status").agg(F.count("*").alias("points"))


@R.twin(
    "reference_gate", ("routes",),
    """
SELECT facility % 10 AS pair, count_if(reason = 'ok') AS ok, count_if(reason = 'timeout') AS timeouts, count_if(reason = 'rate_limit') AS rate_limited, count(*) AS total, count_if(reason = 'ok') >= 0.3 * count(*) AS sufficient FROM {routes} GROUP BY facility % 10""",
)
def q_reference_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome counts and sufficiency per pair."""
    return accuracy.reference_gate(demo(spark, sf_dir, "routes"), F.col("facility") % 10, "reason", 0.3)


@R.twin(
    "risk_enrichment", ("cases",),
    """
SELECT kind, n, errors, round(errors / CAST(n AS DOUBLE), 9) AS rate, round(errors / CAST(sum(errors) OVER () AS DOUBLE), 9) AS capture,
  CASE WHEN sum(n) OVER () = n THEN 'undefined' WHEN sum(errors) OVER () = errors THEN 'infinite' ELSE 'finite' END AS state
FROM (SELECT CASE WHEN abs(duration - 900) <= 45 THEN 'crossing' WHEN abs(duration - 900) <= 200 THEN 'risk' ELSE 'control' END AS kind, count(*) AS n, count_if(truth <> prediction) AS errors FROM {cases} GROUP BY 1) t""",
)
def q_risk_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error rate, capture and enrichment state of risk strata."""
    off = F.abs(F.col("duration") - 900)
    kind = F.when(off <= 45, "crossing").when(off <= 200, "risk").otherwise("control")
    return accuracy.enrichment(demo(spark, sf_dir, "cases"), kind, F.col("truth") != F.col("prediction"))


@R.twin(
    "attempt_ranges", ("routes",),
    """
SELECT CAST(floor(line / 3) AS BIGINT) AS attempts, reason, count(*) AS decisions, min(duration) AS fastest, min_by(origin, duration * 100000000 + origin) AS first_divergence FROM {routes} GROUP BY 1, 2""",
)
def q_attempt_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions by range of attempts and the first that diverges."""
    return accuracy.attempt_ranges(demo(spark, sf_dir, "routes"), F.floor(F.col("line") / 3), "reason", ["duration", "origin"], "origin")


@R.twin(
    "run_summary", ("routes",),
    """
SELECT reason, count_if(endpoint_verified AND reason = 'ok') AS valid, count_if(origin_offset > 20 OR destination_offset > 20) AS offset_invalid, count_if(NOT endpoint_verified) AS unknown, count(*) AS samples FROM {routes} GROUP BY reason""",
)
def q_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid, offset-invalid and unknown samples by reason."""
    return accuracy.run_summary(demo(spark, sf_dir, "routes"), "reason", "endpoint_verified", ["origin_offset", "destination_offset"])


@R.add(
    "largest_remainder",
    """
WITH g AS (SELECT stratum, count(*) AS w FROM cases GROUP BY stratum), q AS (SELECT stratum, 400.0 * w / sum(w) OVER () AS quota FROM g),
f AS (SELECT stratum, floor(quota) AS base, quota - floor(quota) AS frac, 400 - sum(floor(quota)) OVER () AS rest FROM q)
SELECT stratum, CAST(base + CASE WHEN row_number() OVER (ORDER BY frac DESC, stratum) <= rest THEN 1 ELSE 0 END AS BIGINT) AS share FROM f""",
    ("cases",),
)
def q_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A budget of 400 dealt over strata by largest remainders."""
    return stats.largest_remainder(demo(spark, sf_dir, "cases").groupBy("stratum").agg(F.count("*").alias("w")), "stratum", "w", 400)


@R.add(
    "seeded_stratified_sample",
    """
WITH b AS (SELECT *, row_number() OVER (PARTITION BY ix, iy ORDER BY sha256('draw:' || CAST(id AS VARCHAR)), id) AS in_bin FROM demand),
r AS (SELECT *, CASE WHEN abs(ix) + abs(iy) <= 20 THEN 'inner' WHEN abs(ix) + abs(iy) <= 45 THEN 'middle' ELSE 'outer' END AS stratum FROM b WHERE in_bin = 1)
SELECT id, stratum, CAST(place AS INTEGER) AS place FROM (SELECT id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY sha256('draw:' || CAST(id AS VARCHAR)), id) AS place FROM r) WHERE place <= 30""",
    ("demand",),
)
def q_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded sample, one point a bin, 30 a stratum."""
    points = demo(spark, sf_dir, "demand")
    order = [F.sha2(F.concat(F.lit("draw:"), F.col("id").cast("string")), 256), F.col("id")]
    thin = points.withColumn("n", F.row_number().over(Window.partitionBy("ix", "iy").orderBy(*order))).filter("n = 1")
    reach = F.abs("ix") + F.abs("iy")
    ranked = thin.withColumn("stratum", F.when(reach <= 20, "inner").when(reach <= 45, "middle").otherwise("outer"))
    return ranked.withColumn("place", F.row_number().over(Window.partitionBy("stratum").orderBy(*order))).filter("place <= 30").select("id", "stratum", "place")
