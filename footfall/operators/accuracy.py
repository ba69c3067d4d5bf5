"""Accuracy of predictions against three-valued truth, and the accounts of the runs behind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.operators.nearby import within_radius
from footfall.session import checkpointed

# Reach, tolerance of a case, and severity of an error, in seconds.
REACH_S, TOLERANCE_S, SEVERE_S, HEAVY_S = 900, 15, 1020, 960


def _share(part: Column, whole: Column) -> Column:
    return F.round(part / F.nullif(whole, F.lit(0)).cast("double"), 9)


def confusion(cases: DataFrame, group: str, truth: str, prediction: str) -> DataFrame:
    """The three-state confusion matrix of each group with its rates; unknown truth is ``undecided``."""
    t, p = F.col(truth), F.col(prediction)
    counts = cases.groupBy(group).agg(
        F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"), F.count_if(t.isNull()).alias("undecided"), F.count_if(t.isNotNull()).alias("known")
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    rates = [_share(tp + tn, F.col("known")).alias("accuracy"), _share(tp, tp + fn).alias("recall"), _share(tp, tp + fp).alias("precision_")]
    return counts.select(group, "tp", "fp", "fn", "tn", "undecided", *rates)


def case_label(truth: Column, prediction: Column, duration: Column, reach_s: float = REACH_S, tolerance_s: float = TOLERANCE_S) -> Column:
    """The label of a case; a wrong one so close to the reach that the clock may decide is within tolerance."""
    close = F.abs(duration - reach_s) <= tolerance_s
    return F.when(truth.isNull(), "undecided").when(truth == prediction, "correct").when(close, "within_tolerance").when(prediction, "false_inclusion").otherwise("false_exclusion")


def weighted_accuracy(cases: DataFrame, stratum: str, truth: str, prediction: str, area: Column) -> DataFrame:
    """Accuracy of the strata weighed by their areas; null if a stratum has no known truth."""
    per = cases.groupBy(stratum, area.alias("area")).agg(F.count_if(F.col(truth) == F.col(prediction)).alias("ok"), F.count(truth).alias("n"))
    share = F.col("area") * F.col("ok").cast("double") / F.nullif(F.col("n"), F.lit(0))
    mean = F.when(F.count("*") == F.count(share), F.round(F.sum(share) / F.sum("area"), 9))
    return per.agg(mean.alias("accuracy"), F.sum("area").alias("area"))


def macro_average(rows: DataFrame, family: str, group: str, value: Column) -> DataFrame:
    """The mean of the group means of each family; null if any group has none."""
    means = rows.groupBy(F.col(family).alias("family"), group).agg(F.avg(value).alias("m"))
    return means.groupBy("family").agg(F.when(F.count("*") == F.count("m"), F.round(F.avg("m"), 9)).alias("macro"), F.count("*").alias("groups_"))


def paired_guards(pairs: DataFrame, group: str, before: Column, after: Column) -> DataFrame:
    """Severe errors that a change brings or mends, from flags of both sides (null counts as no)."""
    rows = pairs.select(group, F.coalesce(before, F.lit(False)).alias("b"), F.coalesce(after, F.lit(False)).alias("a"))
    return rows.groupBy(group).agg(F.count_if(~F.col("b") & F.col("a")).alias("new_severe"), F.count_if(F.col("b") & ~F.col("a")).alias("mended"), F.bool_or("a").alias("any_severe"))


def group_scores(cases: DataFrame, groups: list[Column], truth: str, prediction: str, duration: str, reach_s: float = REACH_S) -> DataFrame:
    """Scores of named groups, where a case stands in every group that names it (null: it does not)."""
    t, p = F.col(truth), F.col(prediction)
    wrong = F.when(p != t, F.abs(F.col(duration) - reach_s) / 60.0).otherwise(0.0)
    named = cases.withColumn("grp", F.explode(F.array_compact(F.array(*groups))))
    return named.groupBy("grp").agg(F.count("*").alias("n"), F.count_if(p & ~t).alias("false_accept"), F.count_if(~p & t).alias("missed"), F.count_if(t.isNull()).alias("pending"), F.round(F.sum(wrong), 6).alias("wrong_minutes"))


def held_out(points: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """The points of a reference that no sample has touched."""
    return points.join(seen.select(key).distinct(), key, "left_anti")


def quadrant_metrics(points: DataFrame, x: Column, y: Column, truth: str, prediction: str) -> DataFrame:
    """Counts, correct and undecided ones by quadrant around the centre."""
    quadrant = F.concat(F.when(y >= 0, "N").otherwise("S"), F.when(x >= 0, "E").otherwise("W"))
    return points.groupBy(quadrant.alias("quadrant")).agg(F.count("*").alias("n"), F.count_if(F.col(truth) == F.col(prediction)).alias("correct"), F.count_if(F.col(truth).isNull()).alias("invalid"))


def nearest_rank(rows: DataFrame, key: str, value: str, **shares: float) -> DataFrame:
    """Nearest-rank percentiles of each key: the least value that the share of rows does not exceed.

    Rows are counted by value first, so a key is as large in one place as its distinct values, not its rows.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(key, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(key).orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    all_ = F.sum("c").over(Window.partitionBy(key))
    ranked = counts.withColumn("upto", upto).withColumn("all", all_)
    return ranked.groupBy(key).agg(*[F.min(F.when(F.col("upto") >= F.ceil(F.col("all") * share), F.col("v"))).alias(name) for name, share in shares.items()], F.max("v").alias("most"))


def log_stability(log: DataFrame, key: str, outcome: str, latency: Column, bad: str, valid: tuple[str, ...], most_bad: float) -> DataFrame:
    """Shares of failed and valid calls of each key, their latencies, and whether it is stable."""
    rows = log.select(key, outcome, latency.alias("ms"))
    error = F.avg(F.when(F.col(outcome) == bad, 1.0).otherwise(0.0))
    shares = rows.groupBy(key).agg(F.round(error, 9).alias("error_share"), F.round(F.avg(F.when(F.col(outcome).isin(*valid), 1.0).otherwise(0.0)), 9).alias("valid_share"), (error <= most_bad).alias("stable"))
    return shares.join(nearest_rank(rows, key, "ms", p50_ms=0.5, p95_ms=0.95).withColumnRenamed("most", "max_ms"), key)


def benchmark_summary(runs: DataFrame, by: list[Column], valid: Column, score: Column, arm: Column) -> DataFrame:
    """Mean and least score (invalid runs as 0) and the failed ones, with the means of both arms beside each other."""
    whole = F.when(valid, score).otherwise(0.0)
    return runs.groupBy(*by).agg(
        F.count("*").alias("runs"), F.count_if(~valid).alias("failed"), F.round(F.avg(whole), 9).alias("mean_iou"), F.round(F.min(whole), 9).alias("least_iou"),
        F.round(F.avg(F.when(arm, score)), 9).alias("arm_true"), F.round(F.avg(F.when(~arm, score)), 9).alias("arm_false"),
    )


def attribution_loss(rows: DataFrame, group: str, merged_by: str, member: str) -> DataFrame:
    """Per group the merged names, those of several members, and the members that a merge loses."""
    names = rows.select(group, merged_by, member).distinct().groupBy(group, merged_by).agg(F.count("*").alias("n"))
    more = F.col("n") > 1
    return names.groupBy(group).agg(F.count("*").alias("groups_"), F.count_if(more).alias("merged"), F.sum(F.when(more, F.col("n") - 1).otherwise(0)).alias("lost"))


def recall(rows: DataFrame, major: str, minor: str, member: str, found: Column) -> DataFrame:
    """Members of a fixture and those found, by minor, by major and over all."""
    once = rows.groupBy(major, minor, member).agg(F.max(found.cast("int")).alias("hit"))
    spread = F.array(F.struct(F.col(major).alias("major"), F.col(minor).alias("minor")), F.struct(F.col(major).alias("major"), F.lit("all").alias("minor")), F.struct(F.lit("all").alias("major"), F.lit("all").alias("minor")))
    each = once.select(F.explode(spread).alias("g"), member, "hit").groupBy("g", member).agg(F.max("hit").alias("hit"))
    return each.groupBy("g.major", "g.minor").agg(F.count("*").alias("fixture"), F.sum("hit").alias("found"), _share(F.sum("hit"), F.count("*")).alias("recall"))


def transitions(cases: DataFrame, truth: str, before: Column, after: Column, states: tuple[str, ...] = ("in", "out", "unknown")) -> DataFrame:
    """How many cases go from each state to each other, split by truth."""
    return cases.groupBy(truth, before.alias("before_")).agg(*[F.count_if(after == s).alias(f"to_{s}") for s in states])


def time_error(observed: DataFrame, origin: str, destination: str, verified: str, reason: str, duration: str, expected: Column) -> DataFrame:
    """Error of the expected time by the named exclusion of an observation, ``used`` among them."""
    kinds = observed.select(origin, destination, duration).distinct().groupBy(origin, destination).agg(F.count("*").alias("kinds_"))
    why = F.when(~F.col(verified), "endpoint_unverified").when(F.col(reason) != "ok", F.concat(F.lit("upstream_"), F.col(reason))).when(F.col("kinds_") > 1, "conflicting_endpoint").otherwise("used")
    gap = F.col(duration) - expected
    return observed.join(kinds, [origin, destination]).groupBy(why.alias("exclusion")).agg(F.count("*").alias("n"), F.round(F.avg(F.abs(gap)), 6).alias("mae"), F.round(F.avg(gap), 6).alias("bias"))


def reconciled(declared: DataFrame, events: DataFrame, phase: str, request: str) -> DataFrame:
    """Declared counts of each phase (``phase, declared``) against its events and retries; they agree or they do not."""
    per = events.groupBy(phase, request).agg(F.count("*").alias("n")).groupBy(phase).agg(F.sum("n").alias("events"), F.sum(F.col("n") - 1).alias("retries"))
    return declared.join(per, phase, "full").select(phase, "declared", "events", "retries", F.coalesce(F.col("declared") == F.col("events"), F.lit(False)).alias("agrees"))


def measurement_status(points: DataFrame, events: DataFrame, point: str, of_point: str, valid: Column, failed: Column) -> DataFrame:
    """How far the measurement of every reference point came."""
    per = events.groupBy(F.col(of_point).alias(point)).agg(F.bool_or(valid).alias("valid_"), F.bool_or(failed).alias("failed_"))
    status = F.when(F.col("valid_").isNull(), "not_sent").when(F.col("valid_"), "valid").when(F.col("failed_"), "invalid").otherwise("reserved")
    return points.select(point).join(per, point, "left").select(point, status.alias("status"))


def reference_gate(calls: DataFrame, pair: Column, reason: str, least_share: float) -> DataFrame:
    """Outcomes of each pair, and whether enough of its calls are ok."""
    ok = F.count_if(F.col(reason) == "ok")
    return calls.groupBy(pair.alias("pair")).agg(
        ok.alias("ok"), F.count_if(F.col(reason) == "timeout").alias("timeouts"), F.count_if(F.col(reason) == "rate_limit").alias("rate_limited"), F.count("*").alias("total"), (ok >= least_share * F.count("*")).alias("sufficient")
    )


def enrichment(cases: DataFrame, kind: Column, wrong: Column) -> DataFrame:
    """Error rate of each risk stratum, the share of all errors it captures, and whether its enrichment is a number."""
    per = cases.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.count_if(wrong).alias("errors"))
    every = Window.partitionBy()  # one row a stratum
    n, errors = F.sum("n").over(every), F.sum("errors").over(every)
    state = F.when(n == F.col("n"), "undefined").when(errors == F.col("errors"), "infinite").otherwise("finite")
    return per.select("kind", "n", "errors", _share(F.col("errors"), F.col("n")).alias("rate"), _share(F.col("errors"), errors).alias("capture"), state.alias("state"))


def attempt_ranges(decisions: DataFrame, attempt: Column, reason: str, order: list[str], key: str) -> DataFrame:
    """Decisions of each range of attempts by reason, and the first by ``order``."""
    return decisions.groupBy(attempt.alias("attempts"), reason).agg(F.count("*").alias("decisions"), F.min(order[0]).alias("fastest"), F.min(F.struct(*order))[key].alias("first_divergence"))


def run_summary(samples: DataFrame, reason: str, verified: str, offsets: list[str], most_offset: float = 20.0) -> DataFrame:
    """Samples by reason: valid, off their place, unknown."""
    off = F.greatest(*[F.col(c) for c in offsets]) > most_offset
    return samples.groupBy(reason).agg(F.count_if(F.col(verified) & (F.col(reason) == "ok")).alias("valid"), F.count_if(off).alias("offset_invalid"), F.count_if(~F.col(verified)).alias("unknown"), F.count("*").alias("samples"))


#: Points of the sample that a walk's stretches are cut by; it moves their ends and no result.
CUTS = 256


def spaced(points: DataFrame, id_: str, order: Column, spacing: float, most: int | None = None) -> DataFrame:
    """The points that a walk in ``order`` would take, leaving out every point nearer than ``spacing`` to one taken before.

    The walk goes by stretches, each as long as all before it: points near one taken earlier fall out first, so few of the rest
    are near each other, however dense the points. It stops at a stretch's end once ``most`` points are taken: these are
    then the first ``most`` of the whole walk, and perhaps a few more.
    """
    rows = checkpointed(points.select(id_, "x", "y", F.struct(order.alias("o"), F.col(id_).alias("i")).alias("rank")))
    kind = rows.schema["rank"].dataType
    cuts = sorted((r.rank for r in rows.sample(min(1.0, CUTS / max(1, rows.count())), seed=1).select("rank").collect()), key=lambda r: (r.o is not None, r.o, r.i))
    ends = [cuts[2**k - 1] for k in range(len(cuts).bit_length())]
    at = lambda r: F.struct(F.lit(r.o).cast(kind["o"].dataType).alias("o"), F.lit(r.i).cast(kind["i"].dataType).alias("i"))
    taken = None
    for low, high in zip([None, *ends], [*ends, None], strict=True):
        stretch = rows if low is None else rows.filter(F.col("rank") > at(low))
        stretch = stretch if high is None else stretch.filter(F.col("rank") <= at(high))
        if taken is not None:
            close = within_radius(stretch.select(id_, "x", "y"), taken.select("x", "y"), spacing).filter(F.col("distance_m") < spacing).select(id_)
            stretch = stretch.join(close, id_, "left_anti")
        more = _walked(checkpointed(stretch), id_, spacing)
        taken = checkpointed(more if taken is None else taken.unionByName(more))
        if most is not None and taken.count() >= most:
            break
    return points.join(taken.select(id_), id_, "left_semi")


def _walked(rows: DataFrame, id_: str, spacing: float) -> DataFrame:
    """The walk over one stretch (``id_, x, y, rank``), in rounds, all places at once: a point that comes before all its undecided
    neighbours is taken and they are left out, which is what the walk would do."""
    near = within_radius(rows, rows, spacing).filter((F.col(id_) != F.col(f"r_{id_}")) & (F.col("distance_m") < spacing))
    links = checkpointed(near.select(F.col(id_).alias("a"), F.col("rank").alias("ra"), F.col(f"r_{id_}").alias("b"), F.col("r_rank").alias("rb")))
    taken = rows.join(links.select(F.col("a").alias(id_)).distinct(), id_, "left_anti").select(id_)
    while not links.isEmpty():
        first = checkpointed(links.groupBy("a", "ra").agg(F.min("rb").alias("rb")).filter("ra < rb").select("a"))
        taken = taken.unionByName(first.select(F.col("a").alias(id_)))
        out = checkpointed(first.unionByName(links.join(first, "a", "left_semi").select(F.col("b").alias("a"))).distinct())
        left = checkpointed(links.join(out, "a", "left_anti").join(out.select(F.col("a").alias("b")), "b", "left_anti"))
        # A point whose neighbours have all been decided, and that was not left out itself, is taken too.
        alone = links.select("a").distinct().join(out, "a", "left_anti").join(left.select("a").distinct(), "a", "left_anti")
        taken = checkpointed(taken.unionByName(alone.select(F.col("a").alias(id_))))
        links = left
    return rows.join(taken, id_, "left_semi").select(id_, "x", "y")


def spaced_sample(points: DataFrame, id_: str, stratum: str, quota: dict[str, int], spacing: float, road_m: Column, reach_m: float, seed: str) -> DataFrame:
    """``points`` taken for each stratum in turn with its ``place``: in the order of a digest of seed and id, ``spacing`` apart from
    all taken before (of earlier strata too), and no farther than ``reach_m`` from a road (``road_m``; null is too far).

    A stratum that cannot fill its quota fails the job, as a sample that is silently short would.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_).cast("string")), 256)
    usable = checkpointed(points.filter(F.coalesce(road_m <= reach_m, F.lit(False))).withColumn("digest_", digest))
    taken = None
    for name, count in quota.items():  # a handful of strata, each shut out by those before
        if not count:
            continue
        free = usable.filter(F.col(stratum) == name)
        if taken is not None:
            close = within_radius(free.select(id_, "x", "y"), taken.select("x", "y"), spacing).filter(F.col("distance_m") < spacing).select(id_)
            free = free.join(close, id_, "left_anti")
        apart = spaced(checkpointed(free), id_, F.col("digest_"), spacing, count)
        first = checkpointed(apart.orderBy("digest_", id_).limit(count).withColumn("place", F.row_number().over(Window.orderBy("digest_", id_))))  # `count` rows
        if first.count() < count:
            raise ValueError(f"too few candidates in stratum {name}")
        taken = first if taken is None else taken.unionByName(first)
    return (taken if taken is not None else usable.limit(0).withColumn("place", F.lit(0))).drop("digest_")
