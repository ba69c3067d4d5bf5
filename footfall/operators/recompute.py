"""Incremental recomputation: changed inputs select the cells that they can reach, and only these are judged again."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.operators.nearby import nearest
from footfall.session import checkpointed

LINEAGE = "revision int, parent int, changed long, recomputed long, kept long"


def changed_places(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``columns`` of every row that came, went or differs between two tables, as it was and as it is. ``columns`` hold ``x, y``."""
    a, b = (df.select(key, F.struct(*columns).alias(n)) for df, n in ((old, "was"), (new, "now")))
    both = a.join(b, key, "full").filter(~F.col("was").eqNullSafe(F.col("now")))
    places = F.explode(F.array_compact(F.array("was", "now")))
    return both.select(key, places.alias("p")).select(key, *[F.col(f"p.{c}").alias(c) for c in columns])


def affected_cells(cells: DataFrame, changes: DataFrame, key: list[str], radius: float, on: tuple[str, ...] = ()) -> DataFrame:
    """``key`` of the cells (``x, y`` their middle) within ``radius`` of a changed place with equal ``on``."""
    spots = changes.select("x", "y", *on).distinct()
    return nearest(cells.select(*dict.fromkeys([*key, "x", "y", *on])), spots, key, radius, "x", on=on).select(*key)  # one in reach is enough


def recomputed(cells: DataFrame, old: DataFrame, new: DataFrame, judge: Callable[[DataFrame, DataFrame], DataFrame], id_: str, columns: list[str], key: list[str], radius: float, on: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(changes, verdicts of the affected cells): ``judge(cells, inputs)`` sees the cells within ``radius`` of a change alone.

    ``radius`` is the farthest that an input has any influence, so no other cell's verdict can differ. The inputs are cut
    down as well, to those that an affected cell can meet; a change reaches few cells, so the rest is never read again.
    """
    changes = checkpointed(changed_places(old, new, id_, columns))
    hit = checkpointed(affected_cells(cells, changes, key, radius, on))
    some = cells.join(hit, key, "left_semi")
    near = nearest(new.select(*dict.fromkeys([id_, "x", "y", *on])), some.select("x", "y", *on).distinct(), [id_], radius, "x", on=on).select(id_)
    return changes, judge(some, new.join(near, id_, "left_semi"))


def publish(spark: SparkSession, base: str, verdicts: DataFrame, total: int, changed: int = 0, parent: int | None = None) -> int:
    """Write a revision (the first, or what differs from ``parent``) under ``base`` and its lineage; the revision's number.

    The rows are written before the lineage, so a revision that broke off is no revision; its number is used again.
    """
    revision = 1 if parent is None else parent + 1
    verdicts.write.mode("overwrite").parquet(f"{base}/revision-{revision}")
    n = spark.read.parquet(f"{base}/revision-{revision}").count()
    line = spark.createDataFrame([(revision, parent, changed, n, total - n)], LINEAGE)  # one row
    line.coalesce(1).write.mode("overwrite").parquet(f"{base}/lineage/{revision}")
    return revision


def read_revision(spark: SparkSession, base: str, revision: int, key: list[str]) -> DataFrame:
    """The verdicts as a revision has them, with the ``revision`` that judged each: a cell's last one up to it."""
    line = {r["revision"]: r["parent"] for r in spark.read.schema(LINEAGE).parquet(f"{base}/lineage/*").collect()}  # a row a revision
    chain: list[int] = []
    at: int | None = revision
    while at is not None:
        if at not in line:
            raise ValueError(f"revision {at} was not published")
        chain.append(at)
        at = line[at]
    parts = [spark.read.parquet(f"{base}/revision-{n}").withColumn("revision", F.lit(n)) for n in chain]
    whole = reduce(DataFrame.unionByName, parts)
    rest = [c for c in whole.columns if c not in key]
    return whole.groupBy(*key).agg(F.max_by(F.struct(*rest), "revision").alias("v")).select(*key, *[F.col(f"v.{c}").alias(c) for c in rest])
