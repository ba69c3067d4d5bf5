"""Connected components over an edge table (operators G4, G14 and everything that groups transitively)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.session import checkpointed


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)`` for every node of an edge; ``component`` is the least node reachable.

    Each round keeps one row per surviving edge, always pointing from a larger node to a smaller
    one. A node's larger neighbours and the node itself are re-hung on its least neighbour (the
    "large star" step), then each node's smaller neighbours are re-hung on the least of them (the
    "small star" step). Both steps group by node, but the group is only ever reduced with ``min``
    (map-side combined) and joined back, so a node with very many neighbours costs no task more
    than its share. Rounds grow with the logarithm of the longest path. Lineage is cut with a
    checkpoint in the shared folder each round.

    Null ends and loops are ignored; an empty edge table gives an empty result.
    """
    pairs = (
        edges.select(F.greatest(src, dst).alias("hi"), F.least(src, dst).alias("lo"), F.col(src).isNotNull().alias("a"), F.col(dst).isNotNull().alias("b"))
        .filter("a AND b AND hi <> lo")
        .select("hi", "lo")
        .distinct()
    )
    pairs = checkpointed(pairs)
    state = _state(pairs)
    while state[0]:
        # Large star: every larger neighbour of a node hangs on the least of node and neighbours.
        both = pairs.select(F.col("hi").alias("n"), F.col("lo").alias("m")).unionByName(pairs.select(F.col("lo").alias("n"), F.col("hi").alias("m")))
        least = both.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("r"))
        large = pairs.select(F.col("lo").alias("n"), F.col("hi").alias("m")).join(least, "n").select(F.col("m").alias("hi"), F.col("r").alias("lo"))
        own = least.filter("r <> n").select(F.col("n").alias("hi"), F.col("r").alias("lo"))
        star = large.unionByName(own).filter("hi <> lo").distinct()
        # Small star: a node's smaller neighbours, and the node, hang on the least of them.
        low = star.groupBy(F.col("hi").alias("n")).agg(F.min("lo").alias("r"))
        small = star.withColumnRenamed("hi", "n").join(low, "n").select(F.col("lo").alias("hi"), F.col("r").alias("lo"))
        up = low.select(F.col("n").alias("hi"), F.col("r").alias("lo"))
        pairs = checkpointed(small.unionByName(up).filter("hi <> lo").distinct())
        now = _state(pairs)
        # Stars only: no node is both hung on another and a centre, and each hangs on one centre.
        if now[1] == 0 and now[2] == now[0]:
            break
        state = now
    hung = pairs.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    centres = pairs.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return hung.unionByName(centres)


def _state(pairs: DataFrame) -> tuple[int, int, int]:
    """(edges, nodes that are both hung and a centre, hung nodes): three counts, whatever the size."""
    roles = pairs.select(F.col("hi").alias("n"), F.lit(1).alias("h"), F.lit(0).alias("c")).unionByName(pairs.select(F.col("lo").alias("n"), F.lit(0).alias("h"), F.lit(1).alias("c")))
    per = roles.groupBy("n").agg(F.sum("h").alias("h"), F.max("c").alias("c"))
    row = per.agg(F.coalesce(F.sum("h"), F.lit(0)), F.count(_when("h > 0 AND c > 0")), F.count(_when("h > 0"))).first()
    return int(row[0]), int(row[1]), int(row[2])


def _when(test: str) -> Column:
    return F.when(F.expr(test), 1)
