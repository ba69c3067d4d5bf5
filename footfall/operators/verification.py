"""Verification of an assessment: plans against ledgers, carried evidence, entrances, spot checks, status roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def retry_eligibility(tasks: DataFrame, revisions: DataFrame, task: str, stage: str, running: Column, finished: str) -> DataFrame:
    """``tasks`` with ``verdict``: nothing to continue, in progress, not needed, or eligible for a retry."""
    per = revisions.groupBy(task).agg(F.max(stage).alias("stage_"))
    verdict = F.when(F.col("stage_").isNull(), "nothing_to_continue").when(running, "in_progress").when(F.col("stage_") == finished, "not_needed").otherwise("eligible")
    return tasks.join(per, task, "left").withColumn("verdict", verdict).drop("stage_")


def stale_retrievals(facilities: DataFrame, group: str, was: Column, now: Column) -> DataFrame:
    """Facilities that a changed boundary lost or took in, by group; any of either makes the retrieval stale."""
    lost, new = F.count_if(was & ~now), F.count_if(now & ~was)
    return facilities.groupBy(group).agg(lost.alias("left_"), new.alias("entered"), ((lost > 0) | (new > 0)).alias("stale"))


def evaluated_majors(requested: DataFrame, rows: DataFrame, major: str, member: str, searches: DataFrame) -> DataFrame:
    """``major, found, complete, evaluated``: every requested major can be evaluated if its searches are complete, also where
    nothing was found (an observed nothing); else only if something of it was.

    ``searches`` has ``major, complete``; a major without a search is not complete.
    """
    found = rows.groupBy(F.col(major).alias("major"), member).agg(F.lit(1).alias("n")).groupBy("major").agg(F.count(member).alias("found"))
    done = searches.groupBy("major").agg(F.bool_and("complete").alias("complete"))
    each = requested.select(F.col(major).alias("major")).distinct().join(found, "major", "left").join(done, "major", "left")
    n, complete = F.coalesce("found", F.lit(0).cast("long")), F.coalesce("complete", F.lit(False))
    return each.select("major", n.alias("found"), complete.alias("complete"), (complete | (n > 0)).alias("evaluated"))


def snapshot_summary(revisions: DataFrame, task: str, stage: str, revision: str, amount: str) -> DataFrame:
    """What may leave a snapshot: counts and scalars by an allow-list, never its rows."""
    per = revisions.groupBy(task, stage).agg(F.count("*").alias("n"), F.max(revision).alias("latest"), F.sum(amount).alias("total"))
    return per.groupBy(task).agg(F.sum("n").alias("revisions"), F.count(stage).alias("stages"), F.max("latest").alias("latest"), F.round(F.sum("total"), 2).alias("total_price"))


def entrance_summary(entrances: DataFrame, barrier: str, unresolved: Column) -> DataFrame:
    """Entrances in all, unresolved ones, those without a barrier, and kinds of barrier."""
    per = entrances.groupBy(barrier).agg(F.count("*").alias("n"), F.count_if(F.coalesce(unresolved, F.lit(False))).alias("bad"))
    return per.agg(F.sum("n").alias("entrances"), F.sum("bad").alias("unresolved"), F.sum(F.when(F.col(barrier).isNull(), F.col("n")).otherwise(0)).alias("open_"), F.count(barrier).alias("kinds"))


def spot_check_outcome(truth: Column, prediction: Column, duration: Column, reach_s: float = 900.0, beyond_s: float = 1500.0, edge_s: float = 60.0) -> Column:
    """How a spot check came out."""
    close = F.abs(duration - reach_s) <= edge_s
    return F.when(duration > beyond_s, "beyond").when(truth.isNull(), "inconclusive").when(truth == prediction, "agree").when(close, "resolved").otherwise("conflict")


def status_counts(rows: DataFrame, group: str, **tests: Column) -> DataFrame:
    """How many rows of a group each named status holds for."""
    return rows.groupBy(group).agg(*[F.count_if(test).alias(name) for name, test in tests.items()])


def plan_against_ledger(plan: DataFrame, ledger: DataFrame, point: str, origin: str, duration: str, reach_s: float = 900.0) -> DataFrame:
    """The points of a plan with the ``label`` that its usable ledger rows give them."""
    within = F.col(duration) <= reach_s
    per = ledger.groupBy(F.col(origin).alias(point)).agg(F.bool_or(within).alias("yes_"), F.bool_or(~within).alias("no_"))
    label = F.when(F.col("yes_").isNull(), "missing").when(F.col("yes_") & F.col("no_"), "conflict").when(F.col("yes_"), "reachable").otherwise("unreachable")
    return plan.join(per, point, "left").withColumn("label", label).drop("yes_", "no_")


def carried_over(previous: DataFrame, entrances: DataFrame, key: str, barrier: str, unresolved: Column) -> DataFrame:
    """Earlier verification with the state its ``entrance`` has now."""
    now = entrances.select(key, barrier, F.lit(True).alias("there_"))
    state = F.when(F.col("there_").isNull(), "entrance_gone").when(F.coalesce(unresolved, F.lit(False)), "unresolved").otherwise("valid")
    return previous.join(now, key, "left").withColumn("entrance", state).drop("there_")


def domain_less(domain: DataFrame, excluded: DataFrame, cell: list[str], cell_m2: int) -> DataFrame:
    """M6: cells and area of a domain that no exclusion covers."""
    left = domain.select(*cell).distinct().join(excluded.select(*cell).distinct(), cell, "left_anti")
    return left.agg(F.count("*").alias("cells"), (F.count("*") * cell_m2).alias("area_m2"))


def boundary_hits(nodes: DataFrame, network: str, at_edge: Column) -> DataFrame:
    """Per network whether, and with how many nodes, it touches the edge of the dataset."""
    return nodes.groupBy(network).agg(F.bool_or(at_edge).alias("hits_boundary"), F.count_if(at_edge).alias("boundary_nodes"))


def verified_outcomes(plan: DataFrame, observations: DataFrame, point: str, origin: str, duration: str, usable: Column, reach_s: float = 900.0) -> DataFrame:
    """M9: every planned point with the outcome of its observations: verified true or false, contradicted, unusable, or not observed."""
    within = F.col(duration) <= reach_s
    per = observations.groupBy(F.col(origin).alias(point)).agg(F.bool_or(usable & within).alias("yes_"), F.bool_or(usable & ~within).alias("no_"))
    outcome = (
        F.when(F.col("yes_").isNull(), "not_observed").when(F.col("yes_") & F.col("no_"), "contradicted").when(F.col("yes_"), "verified_true").when(F.col("no_"), "verified_false").otherwise("unusable")
    )
    return plan.join(per, point, "left").withColumn("outcome", outcome).drop("yes_", "no_")


def with_overrides(cells: DataFrame, outcomes: DataFrame, cell: list[str], verdict: str = "verdict") -> DataFrame:
    """``cells`` with the verdict that verified points in them give, and what it was: both answers in one cell leave it unknown."""
    yes, no = F.bool_or(F.col("outcome") == "verified_true"), F.bool_or(F.col("outcome") == "verified_false")
    per = outcomes.filter(F.col("outcome").isin("verified_true", "verified_false", "contradicted")).groupBy(*cell).agg(yes.alias("y_"), no.alias("n_"), F.bool_or(F.col("outcome") == "contradicted").alias("c_"))
    new = F.when(F.col("y_").isNull(), F.col(verdict)).when(F.col("c_") | (F.col("y_") & F.col("n_")), "unknown").when(F.col("y_"), "covered").otherwise("gap")
    return cells.join(per, cell, "left").withColumn("before", F.col(verdict)).withColumn(verdict, new).drop("y_", "n_", "c_")


def refinement_trigger(**tests: Column) -> Column:
    """M3: the first of the named tests that holds, in their order; null where a cell needs no refinement."""
    return F.coalesce(*[F.when(F.coalesce(test, F.lit(False)), name) for name, test in tests.items()])


def support_points(x: Column, y: Column, size: float) -> Column:
    """the points a square cell is judged by: its middle and the middles of its sides."""
    half = size / 2
    return F.array(*[F.struct((x + dx).cast("double").alias("x"), (y + dy).cast("double").alias("y")) for dx, dy in ((half, half), (half, 0.0), (size, half), (half, size), (0.0, half))])
