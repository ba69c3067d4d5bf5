"""Three-valued rules as Column expressions: TRUE, FALSE and NULL (unknown) stay apart throughout."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from footfall.functions.text import yes

# Fixed values of the walking rules.
THRESHOLD_M, TOLERANCE_M, REACH_S, ENDPOINT_TOLERANCE_M = 1000.0, 100.0, 900.0, 20.0
# Fixed value lists of the walkability classes.
DENIED_HIGHWAY = ("motorway", "motorway_link", "construction", "proposed")
DENIED_FOOT, ALLOWED_FOOT = ("no", "private"), ("yes", "designated", "permissive")
DENIED_ACCESS, CONDITIONAL_ACCESS = ("no", "private"), ("customers", "residents", "destination", "permit")
BLOCKING_BARRIERS, PASSABLE_BARRIERS = ("wall", "fence"), ("bollard", "entrance", "kerb")


def finite(c: Column) -> Column:
    """Neither null, NaN nor infinite, and not negative."""
    return F.coalesce(c.isNotNull() & ~F.isnan(c.cast("double")) & (c >= 0) & (c < F.lit(float("inf"))), F.lit(False))


def distance_within(value: Column, threshold: float = THRESHOLD_M, tolerance: float = TOLERANCE_M, inclusive: bool = True) -> Column:
    """TRUE within, FALSE beyond, NULL inside the tolerance band (but for the threshold itself) or if not finite."""
    band = (F.abs(value - threshold) <= tolerance) & (value != threshold)
    return F.when(finite(value) & ~band, value <= threshold if inclusive else value < threshold)


def category_service(verdict: Column, complete: Column) -> Column:
    """A16 as an aggregate: any TRUE is covered; all FALSE and a complete search is blind; anything else unknown."""
    return F.when(F.coalesce(F.bool_or(verdict), F.lit(False)), "covered").when((F.count("*") == F.count(verdict)) & F.bool_and(complete), "blind").otherwise("unknown")


def number_text(value: Column, lo: float, hi: float, scientific: bool = False) -> Column:
    """A plain (or scientific) decimal string inside a range, as a double; else null."""
    plain = r"[+-]?(\d+(\.\d*)?|\.\d+)"
    form = f"^{plain}([eE][+-]?\\d+)?$" if scientific else f"^{plain}$"
    text = F.trim(value.cast("string"))
    number = text.try_cast("double")
    return F.when(text.rlike(form) & (F.length(text) <= 64) & number.between(lo, hi), number)


def edge_class(highway: Column, foot: Column, access: Column) -> Column:
    """Denied by road class, then by foot, then by access; possible if conditional; else allowed."""
    return (
        F.when(highway.isin(*DENIED_HIGHWAY), "denied")
        .when(foot.isin(*DENIED_FOOT), "denied")
        .when(foot.isin(*ALLOWED_FOOT), "allowed")
        .when(access.isin(*DENIED_ACCESS), "denied")
        .when(access.isin(*CONDITIONAL_ACCESS) | (foot == "unknown"), "possible")
        .otherwise("allowed")
    )


def barrier_class(barrier: Column) -> Column:
    """Null without a barrier, denied or allowed for known kinds, possible for all others."""
    return F.when(barrier.isNull() | barrier.isin("", "no", "none"), None).when(barrier.isin(*BLOCKING_BARRIERS), "denied").when(barrier.isin(*PASSABLE_BARRIERS), "allowed").otherwise("possible")


#: Roads that a bridge may carry on foot.
WALKED_HIGHWAYS = ("footway", "path", "pedestrian", "steps", "residential", "living_street", "service", "unclassified", "tertiary", "secondary", "primary", "cycleway")


def walkable_bridge(bridge: Column, tunnel: Column, foot: Column, access: Column, highway: Column) -> Column:
    """A bridge, not a tunnel, that people may walk: foot says so, or nothing bars them and its road is one that is walked."""
    welcome = F.coalesce(foot.isin(*ALLOWED_FOOT), F.lit(False))
    barred = F.coalesce(foot.isin(*DENIED_FOOT), F.lit(False)) | (F.coalesce(access.isin(*DENIED_ACCESS), F.lit(False)) & ~welcome)
    by_road = F.coalesce(highway.isin(*WALKED_HIGHWAYS), F.lit(False)) & (F.coalesce(foot, F.lit("")) != "use_sidepath")
    return yes(bridge) & ~yes(tunnel) & ~barred & (welcome | by_road)


def usable_route(verified: Column, duration: Column, same_point: Column) -> Column:
    """Endpoint verified, a duration, and no zero duration to another place."""
    return F.coalesce(verified, F.lit(False)) & duration.isNotNull() & ~((duration == 0) & ~same_point)


def sane_duration(duration: Column) -> tuple[Column, Column]:
    """P20: (duration or null, reason or null): negative and non-finite durations become null with a reason."""
    ok = finite(duration)
    return F.when(ok, duration), F.when(duration.isNull(), "missing_duration").when(~ok, "invalid_duration")


def route_layer(usable: Column, strict: Column, offsets_ok: Column, entrance_ok: Column) -> Column:
    """Strict evidence, else endpoint tolerance, else none."""
    return F.when(usable & strict, "strict").when(usable & offsets_ok & entrance_ok, "endpoint_tolerance")


def endpoint_evidence(observed: Column, reason: Column, parsed: Column, mapped: Column, duration: Column) -> tuple[Column, Column]:
    """(status, reason) of strict endpoint evidence."""
    why = F.when(~observed, "missing_observation").otherwise(
        F.coalesce(reason, F.when(~parsed, "endpoints_unverified").when(~mapped, "endpoint_mapping_unconfirmed").when(duration.isNull(), "invalid_duration"))
    )
    status = F.when(why.isNotNull(), "pending").when(duration <= REACH_S, "verified_reachable").otherwise("verified_unreachable")
    return status, why


def admission(new_calls: Column, reusable: Column, task_left: Column, daily_left: Column) -> Column:
    """The ceiling that refuses a retrieval, or null."""
    daily = daily_left.isNotNull()
    return (
        F.when((new_calls <= 0) | (reusable > 0), None)
        .when(task_left <= 0, "task_budget_exhausted")
        .when(daily & (daily_left <= 0), "daily_budget_exhausted")
        .when(new_calls > task_left, "budget_too_small")
        .when(daily & (new_calls > daily_left), "daily_budget_exhausted")
    )


def checkup_status(boundary: Column, facilities: Column, analysis: Column) -> Column:
    """Insufficient if the boundary's quality is, or if a later stage failed; else partial."""
    unusable = reduce(lambda a, b: a | b, [c == "failed" for c in (facilities, analysis)])
    return F.when((boundary == "insufficient") | unusable, "insufficient").otherwise("partial")


def issues(*tests: tuple[str, Column]) -> Column:
    """The sorted names of the tests that hold."""
    return F.array_sort(F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), name) for name, test in tests])))
