"""Cells and rasters: clusters, shares, overlap of cell sets, strata, orders of candidates, reports by category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.functions.geo import segment_distance
from footfall.operators.components import connected_components
from footfall.session import checkpointed, spread


def _square(c: str, size: float) -> Column:
    return F.floor(F.col(c) / size)


def grid_clusters(points: DataFrame, size: float, id_: str, category: str) -> DataFrame:
    """Points of a ground grid as clusters: count, centroid, first member, kinds."""
    per = points.groupBy(_square("x", size).alias("cx"), _square("y", size).alias("cy"), category).agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.min(id_).alias("first"))
    return per.groupBy("cx", "cy").agg(
        F.sum("n").alias("n"), F.round(F.sum("sx") / F.sum("n"), 6).alias("mx"), F.round(F.sum("sy") / F.sum("n"), 6).alias("my"), F.min("first").alias("first_id"), F.count(category).alias("categories")
    )


def service_raster(points: DataFrame, size: float, weight: Column, covered: Column, gap: Column, value: Column) -> DataFrame:
    """Weighted shares of covered and gap points and the weighted mean of a value, by raster cell."""
    rows = points.select(_square("x", size).alias("gi"), _square("y", size).alias("gj"), weight.alias("w"), covered.alias("c"), gap.alias("g"), value.alias("v"))
    total = F.sum("w")
    share = lambda flag: F.round(F.sum(F.when(F.col(flag), F.col("w")).otherwise(0.0)) / total, 9)
    return rows.groupBy("gi", "gj").agg(share("c").alias("covered"), share("g").alias("gap"), F.round(F.sum(F.col("w") * F.col("v")) / total, 6).alias("mean_value"))


def cell_set_metrics(predicted: DataFrame, true: DataFrame, cell: list[str]) -> DataFrame:
    """Overlap of two sets of cells, false and missed ones."""
    both = predicted.select(*cell).distinct().withColumn("p", F.lit(1)).join(true.select(*cell).distinct().withColumn("t", F.lit(1)), cell, "full")
    p, t = F.col("p").isNotNull(), F.col("t").isNotNull()
    return both.agg((F.count_if(p & t) / F.nullif(F.count("*"), F.lit(0)).cast("double")).alias("iou"), F.count_if(p & ~t).alias("false_cells"), F.count_if(t & ~p).alias("missed_cells"), F.count("*").alias("cells"))


def _labelled(cells: DataFrame, steps: list[tuple[int, int]]) -> DataFrame:
    """``cells`` (``ix, iy``) with ``label``: the least of the cells that steps lead to (as struct ix, iy)."""
    near = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in steps]))
    other = cells.withColumn("d", near).select((F.col("ix") + F.col("d.a")).alias("ix"), (F.col("iy") + F.col("d.b")).alias("iy"), F.struct("ix", "iy").alias("src"))
    edges = other.join(cells.select("ix", "iy"), ["ix", "iy"]).select("src", F.struct("ix", "iy").alias("dst"))
    named = cells.withColumn("node", F.struct("ix", "iy")).join(connected_components(edges), "node", "left")
    return named.select(*cells.columns, F.coalesce("component", "node").alias("label"))


def shape_topology(cells: DataFrame) -> DataFrame:
    """``components, holes``: parts of a set of cells (``ix, iy``) that sides join, and parts of the rest that it closes in.

    The rest is labelled within the set's box and a frame of one cell about it, corners joining: what the frame reaches is
    outside, every other part is a hole. The box bounds the work, as it does a raster's.
    """
    own = checkpointed(cells.select(F.col("ix").cast("long").alias("ix"), F.col("iy").cast("long").alias("iy")).distinct())
    box = own.agg(*[f(c).alias(f"{n}{c}") for f, n in ((F.min, "lo_"), (F.max, "hi_")) for c in ("ix", "iy")]).filter("lo_ix IS NOT NULL")
    rows = box.withColumn("ix", F.explode(F.sequence(F.col("lo_ix") - 1, F.col("hi_ix") + 1)))
    every = rows.withColumn("iy", F.explode(F.sequence(F.col("lo_iy") - 1, F.col("hi_iy") + 1)))
    frame = (F.col("ix") < F.col("lo_ix")) | (F.col("ix") > F.col("hi_ix")) | (F.col("iy") < F.col("lo_iy")) | (F.col("iy") > F.col("hi_iy"))
    rest = checkpointed(every.select("ix", "iy", frame.alias("frame")).join(own, ["ix", "iy"], "left_anti"))
    parts = _labelled(own, [(1, 0), (0, 1)]).agg(F.count_distinct("label").alias("components"))
    closed = _labelled(rest, [(1, 0), (0, 1), (1, 1), (1, -1)]).groupBy("label").agg(F.bool_or("frame").alias("open"))
    return parts.crossJoin(closed.agg(F.count_if(~F.col("open")).alias("holes")))  # one row each


def region_strata(points: DataFrame, cell: list[str], new: Column, old: Column) -> DataFrame:
    """U4: cells inside both of two regions, one alone, or neither."""
    per = points.groupBy(*cell).agg(F.bool_or(new).alias("n"), F.bool_or(old).alias("o"))
    stratum = F.when(F.col("n") & F.col("o"), "interior").when(F.col("n"), "only_new").when(F.col("o"), "only_old").otherwise("exterior")
    return per.select(*cell, stratum.alias("stratum"))


def blocked_cells(points: DataFrame, size: float, blocked: Column) -> DataFrame:
    """Per cell its blocked points, all points and their share."""
    n = F.count_if(F.coalesce(blocked, F.lit(False)))
    return points.groupBy(_square("x", size).alias("cx"), _square("y", size).alias("cy")).agg(n.alias("blocked"), F.count("*").alias("n"), F.round(n / F.count("*").cast("double"), 9).alias("share"))


def candidates_in_turn(rows: DataFrame, category: str, id_: str, closeness: Column, per_category: int) -> DataFrame:
    """The closest candidates of each category, taken in turn: all first ones, then all second ones.

    ``turn`` numbers what is left after the cut, some dozens of rows a category.
    """
    place = F.row_number().over(Window.partitionBy(category).orderBy(closeness, id_)).cast("long")
    kept = rows.withColumn("place", place).filter(F.col("place") <= per_category)
    return kept.withColumn("turn", F.row_number().over(Window.orderBy("place", category)).cast("long")).select(id_, category, "place", "turn")


def ranked_candidates(rows: DataFrame, majors: list[str], id_: str, major: str, straight_m: Column, suspected: Column, unresolved: Column, farthest_m: float, threshold_m: float = 1000.0, budget: int = 40) -> DataFrame:
    """``id, major, priority, place, turn``: the facilities to ask about, ``budget`` of them, the majors taken in turn in their given order.

    Within a major come those that a suspected gap zone names, then those with an unresolved entrance, then the rest, each by how
    near their straight distance is to the threshold and by id. Facilities beyond ``farthest_m``, or without a distance, and majors
    that were not asked for are left out. No major can fill more than the budget, so that many of each are ranked further.
    """
    rank = F.when(F.coalesce(suspected, F.lit(False)), 0).when(F.coalesce(unresolved, F.lit(False)), 1).otherwise(2)
    turn_of = F.array_position(F.array(*[F.lit(m) for m in majors]), F.col(major))
    near = rows.withColumns({"m_": straight_m, "rank_": rank, "major_": turn_of}).filter((F.col("major_") > 0) & (F.col("m_") <= farthest_m))
    place = F.row_number().over(Window.partitionBy(major).orderBy("rank_", F.abs(F.col("m_") - threshold_m), id_))
    first = near.withColumn("place", place.cast("long")).filter(F.col("place") <= budget)
    name = F.element_at(F.array(*[F.lit(n) for n in ("suspected_zone", "unresolved_entrance", "decision_edge")]), F.col("rank_") + 1)
    turn = F.row_number().over(Window.orderBy("place", "major_")).cast("long")  # `budget` rows a major
    return first.withColumn("turn", turn).filter(F.col("turn") <= budget).select(id_, major, name.alias("priority"), "place", "turn")


def spots_in_turn(suspects: DataFrame, spread: DataFrame, id_: str, order: list[Column], per_spread: int = 2, budget: int = 80) -> DataFrame:
    """``id, kind, turn``: the first ``budget`` spots, ``per_spread`` suspects and one of the spread by turns, the rest of either when the other ends."""
    one = Window.orderBy("place")
    lists = []
    for df, kind, each, last in ((suspects, "suspect", per_spread, 0), (spread, "spread", 1, 1)):
        first = df.orderBy(*order).limit(budget).withColumn("place", F.row_number().over(Window.orderBy(*order)) - 1)  # `budget` rows
        lists.append(first.select(id_, F.lit(kind).alias("kind"), F.struct(F.floor(F.col("place") / each).alias("block"), F.lit(last).alias("last"), F.col("place").alias("n")).alias("place")))
    return lists[0].unionByName(lists[1]).withColumn("turn", F.row_number().over(one).cast("long")).filter(F.col("turn") <= budget).select(id_, "kind", "turn")


def coverage_report(facilities: DataFrame, cells: DataFrame, category: str, cell: list[str], cell_m2: int) -> DataFrame:
    """Facilities and analysed area by category, with what limits the statement."""
    have = facilities.groupBy(category).agg(F.count("*").alias("facilities"))
    area = cells.select(category, *cell).distinct().groupBy(category).agg((F.count("*") * float(cell_m2)).alias("area"))
    limitation = F.when(F.col("facilities").isNull(), "no_facilities").when(F.col("area").isNull(), "not_analysed")
    return have.join(area, category, "full").withColumn("limitation", limitation).withColumn("facilities", F.coalesce("facilities", F.lit(0)))


def route_assessment(routes: DataFrame, sample: str, facility: str, major: Column, distance: str, ties: list[str], tries: int = 3, limit_m: float = 1000.0) -> DataFrame:
    """Per sample and major the nearest facility within the rule among its ``tries`` closest candidates."""
    rows = routes.withColumn("major", major)
    n = F.row_number().over(Window.partitionBy(sample, "major").orderBy(distance, facility, *ties))
    near = rows.withColumn("n_", n).filter((F.col("n_") <= tries) & (F.col(distance) <= limit_m))
    return near.groupBy(sample, "major").agg(F.min(F.struct(distance, facility)).alias("b")).select(sample, "major", F.col(f"b.{facility}").alias(facility), F.col(f"b.{distance}").alias(distance))


def service_sources(facilities: DataFrame, group: str, counted: Column, nearby: Column) -> DataFrame:
    """U8: facilities that may serve, counted ones and those near by; none is both."""
    source = F.when(counted, "counted").when(nearby, "nearby")
    return facilities.withColumn("source", source).filter("source IS NOT NULL").groupBy("source", group).agg(F.count("*").alias("n"))


def refinement_order(points: DataFrame, class_: Column, size: str, id_: str, most: int) -> DataFrame:
    """T5: the first points to refine by class, then size, then id, numbered."""
    first = points.select(id_, class_.alias("class"), size).orderBy("class", F.desc(size), id_).limit(most)
    return first.select(id_, "class", F.row_number().over(Window.orderBy("class", F.desc(size), id_)).cast("long").alias("place"))  # `most` rows


def thinned(points: DataFrame, bin_m: float, risk: str, id_: str, most: int) -> DataFrame:
    """Of every bin the riskiest point (the lesser id of equal ones), and of these the ``most`` riskiest."""
    best = points.groupBy(_square("x", bin_m).alias("bx"), _square("y", bin_m).alias("by_")).agg(F.max(F.struct(F.col(risk).alias("r"), (-F.col(id_)).alias("i"))).alias("b"))
    return best.select((-F.col("b.i")).alias(id_), "bx", "by_", F.col("b.r").alias(risk)).orderBy(F.desc(risk), id_).limit(most)


def _sides(ring: str) -> Column:
    return F.transform(F.col(ring), lambda p, i: F.struct(p["x"].alias("ax"), p["y"].alias("ay"), F.get(F.col(ring), (i + 1) % F.size(ring))["x"].alias("bx"), F.get(F.col(ring), (i + 1) % F.size(ring))["y"].alias("by")))


def boundary_samples(rings: DataFrame, key: str, ring: str, step: float, more: tuple[str, ...] = ()) -> DataFrame:
    """``key, x, y``: points every ``step`` along each side of a ring, the sides' first ends among them; columns named in ``more`` stay."""
    each = rings.select(key, *more, F.explode(_sides(ring)).alias("s")).select(key, *more, "s.*")
    n = F.ceil(F.sqrt(F.pow(F.col("bx") - F.col("ax"), 2) + F.pow(F.col("by") - F.col("ay"), 2)) / step)
    at = each.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    t = F.col("i") / F.col("n")
    return at.select(key, *more, (F.col("ax") + t * (F.col("bx") - F.col("ax"))).alias("x"), (F.col("ay") + t * (F.col("by") - F.col("ay"))).alias("y"))


def boundary_distances(a: DataFrame, b: DataFrame, key: str, step: float = 5.0, ring: str = "ring") -> DataFrame:
    """``key, m``: the distance of every boundary sample of either of two rings of a key to the other ring, both ways."""

    # The rings of a key meet once, by a merge join over many tasks: a table of rings is small in its file and large in memory, so it
    # is not broadcast. A sample meets the other ring's sides as rows, and their least distance needs no further shuffle.
    met = spread(a.select(key, F.col(ring).alias("a_")), key).join(spread(b.select(key, F.col(ring).alias("b_")), key).hint("merge"), key)
    ways = F.explode(F.array(F.struct(F.col("a_").alias("own"), _sides("b_").alias("other")), F.struct(F.col("b_").alias("own"), _sides("a_").alias("other"))))
    both = met.select(key, ways.alias("w")).select(key, "w.own", "w.other")
    at = boundary_samples(both, key, "own", step, ("other",)).withColumn("n_", F.monotonically_increasing_id())
    m = segment_distance(*[F.col(c) for c in ("x", "y", "ax", "ay", "bx", "by")])
    return at.select(key, "n_", "x", "y", F.explode_outer("other").alias("s")).select(key, "n_", "x", "y", "s.*").groupBy(key, "n_").agg(F.min(m).alias("m")).select(key, "m")


def open_crossings(connectors: DataFrame, walls: DataFrame, bridges: DataFrame, reach_m: float) -> DataFrame:
    """``id, blocked, bridged``: connectors (``id, ax, bx, y``) that cross a wall (``wx``, ``period`` apart at least), unless a
    bridge (``wx, y``) over that wall stands within ``reach_m`` of the crossing. Bridges are met by wall and stretch of ``reach_m``."""
    hit = connectors.join(walls.select("wx"), (F.col("ax") < F.col("wx")) & (F.col("wx") < F.col("bx")) & (F.col("cell") == F.floor(F.col("wx") / 400))).select("id", "y", "wx")
    near = F.explode(F.sequence(F.floor(F.col("y") / reach_m) - 1, F.floor(F.col("y") / reach_m) + 1))
    spots = bridges.select("wx", F.col("y").alias("by"), F.floor(F.col("y") / reach_m).alias("k_")).distinct()
    close = hit.withColumn("k_", near).join(spots, ["wx", "k_"]).filter(F.abs(F.col("y") - F.col("by")) <= reach_m).select("id", "wx").distinct().withColumn("ok", F.lit(True))
    over = hit.select("id", "wx").distinct().join(close, ["id", "wx"], "left")
    return over.groupBy("id").agg(F.lit(True).alias("crosses"), F.bool_and(F.coalesce("ok", F.lit(False))).alias("bridged"))
