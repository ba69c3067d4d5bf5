"""Verdict areas, interval scores and gap zones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.operators.components import connected_components
from footfall.operators.nearby import shared_edges


def verdict_areas(cells: DataFrame, keys: tuple[str, ...] = ("category",), verdict: str = "verdict", area: str = "area_m2") -> DataFrame:
    """A10: covered, gap and unknown area and cell counts per key."""
    def total(v: str) -> Column:
        return F.sum(F.when(F.col(verdict) == v, F.col(area)).otherwise(0.0))

    return cells.groupBy(*keys).agg(
        total("covered").alias("covered_m2"), total("gap").alias("gap_m2"), total("unknown").alias("unknown_m2"),
        F.count(F.when(F.col(verdict) == "covered", 1)).alias("covered_cells"), F.count(F.when(F.col(verdict) == "gap", 1)).alias("gap_cells"), F.count(F.when(F.col(verdict) == "unknown", 1)).alias("unknown_cells"),
    )


def category_scores(areas: DataFrame, domain: str = "domain_m2") -> DataFrame:
    """Coverage interval of each category over a fixed denominator.

    Areas that do not add up to the domain within max(1 m2, a millionth) leave the category unsupported, with a reason.
    """
    off = F.abs(F.col("covered_m2") + F.col("gap_m2") + F.col("unknown_m2") - F.col(domain))
    ok = (F.col(domain) > 0) & (off <= F.greatest(F.lit(1.0), F.abs(F.col(domain)) * 1e-6))

    def pct(part: Column) -> Column:
        return F.when(ok, 100.0 * part / F.col(domain))

    return areas.select(
        "*", ok.alias("supported"),
        pct(F.col("covered_m2")).alias("lower_pct"), pct(F.col("covered_m2") + F.col("unknown_m2")).alias("upper_pct"),
        pct(F.col("covered_m2") + F.col("gap_m2")).alias("assessable_pct"), pct(F.col("unknown_m2")).alias("unknown_pct"),
        F.when(~ok, "areas_do_not_add_up").alias("reason"),
    )


def overall_score(scores: DataFrame, scope: DataFrame, category: str = "category") -> DataFrame:
    """Equal-weight interval over a fixed scope of categories, or why there is none."""
    joined = scope.select(F.col(category).alias("want_")).distinct().join(scores, F.col("want_") == F.col(category), "left")
    missing = F.sort_array(F.collect_set(F.when(F.col("supported").isNull(), F.col("want_"))))
    unsupported = F.sort_array(F.collect_set(F.when(~F.col("supported"), F.col("want_"))))
    out = joined.agg(*[F.avg(c).alias(c) for c in ("lower_pct", "upper_pct", "assessable_pct", "unknown_pct")], missing.alias("m"), unsupported.alias("u"))
    bad = (F.size("m") > 0) | (F.size("u") > 0)
    return out.select(
        *[F.when(~bad, F.col(c)).alias(c) for c in ("lower_pct", "upper_pct", "assessable_pct", "unknown_pct")],
        F.when(F.size("m") > 0, "categories_not_analysed").when(F.size("u") > 0, "category_without_spatial_support").alias("reason"),
        F.concat_ws(",", F.when(F.size("m") > 0, F.col("m")).otherwise(F.col("u"))).alias("categories"),
    )


def gap_zones(gaps: DataFrame, key: str = "category", labelled_m2: float = 2500.0) -> DataFrame:
    """Connected gap cells per key, with area, cells, first cell, nearest facility and rank.

    ``gaps`` has ``key, cell, ix, iy, level, area_m2, nearest_id, nearest_m``; a cell is a zone of its own
    if it shares no edge with another.
    """
    named = gaps.withColumn("node", F.concat_ws("|", key, "cell"))
    edges = shared_edges_by(named, key)
    comps = connected_components(edges, "a", "b")
    zoned = named.join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    zones = zoned.groupBy(key, "component").agg(
        F.sum("area_m2").alias("area_m2"), F.countDistinct("cell").alias("cells"), F.min("cell").alias("first_cell"),
        F.min(F.when(F.col("nearest_m").isNotNull(), F.struct("nearest_m", "nearest_id"))).alias("near"),
    )
    order = Window.partitionBy(key).orderBy(F.desc("area_m2"), "component")
    return zones.select(key, F.row_number().over(order).alias("rank"), "area_m2", "cells", "first_cell", F.col("near.nearest_id").alias("nearest_id"), F.col("near.nearest_m").alias("nearest_m"), (F.col("area_m2") >= labelled_m2).alias("labelled"))


def shared_edges_by(cells: DataFrame, key: str) -> DataFrame:
    """`shared_edges` within each value of ``key``: the key takes part in the unit edge."""
    span = F.when(F.col("level") == 0, 2).otherwise(1)
    base = cells.select(F.col(key).alias("g"), F.col("node").alias("c"), (F.col("ix") * span).alias("u"), (F.col("iy") * span).alias("v"), span.alias("s"))
    step = base.select("g", "c", "u", "v", "s", F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("k"))
    ends = [("h", "u + k", "v"), ("h", "u + k", "v + s"), ("v", "u", "v + k"), ("v", "u + s", "v + k")]
    sides = F.array(*[F.struct(F.lit(o).alias("o"), F.expr(p).alias("p"), F.expr(q).alias("q")) for o, p, q in ends])
    units = step.select("g", "c", F.explode(sides).alias("e")).select("g", "c", "e.*")
    return units.groupBy("g", "o", "p", "q").agg(F.min("c").alias("a"), F.max("c").alias("b")).filter("a <> b").select("a", "b").distinct()


def union_gap_area(gaps: DataFrame) -> DataFrame:
    """Gap area with every cell counted once, 0 without gaps; a 25 m cell inside a 50 m gap is counted with it."""
    cells = gaps.select("level", "ix", "iy", "area_m2").dropDuplicates(["level", "ix", "iy"])
    big = cells.filter("level = 0").select(F.col("ix").alias("px"), F.col("iy").alias("py"))
    parent = (F.floor(F.col("ix") / 2) == F.col("px")) & (F.floor(F.col("iy") / 2) == F.col("py"))
    small = cells.filter("level = 1").join(big, parent, "left_anti")
    return cells.filter("level = 0").unionByName(small).agg(F.coalesce(F.sum("area_m2"), F.lit(0.0)).alias("gap_m2"), F.count("*").alias("cells"))


def composite_gaps(gaps: DataFrame, least: int = 2) -> DataFrame:
    """Cells that are a gap for at least ``least`` categories."""
    return gaps.groupBy("level", "ix", "iy").agg(F.countDistinct("category").alias("categories")).filter(F.col("categories") >= least)
