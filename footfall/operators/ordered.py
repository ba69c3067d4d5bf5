"""Values of neighbouring rows along a key's order, computed bucket by bucket.

A key may hold a large share of all rows (one service's whole log), so nothing here sorts a key in one
task: rows are windowed within (key, bucket), each bucket is reduced to one row, and what a bucket takes
from those before it comes from a window over these rows alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _carried(rows: DataFrame, key: str, bucket: Column, per_bucket: Column, over: str) -> tuple[DataFrame, DataFrame]:
    """Rows with their bucket ``b_``, and per (key, bucket) what comes from the buckets before it, ``before_``."""
    rows = rows.withColumn("b_", bucket)
    sums = rows.groupBy(key, "b_").agg(per_bucket.alias("v_"))
    order = Window.partitionBy(key).orderBy("b_")
    how = {"last": F.lag("v_").over(order), "sum": F.sum("v_").over(order.rowsBetween(Window.unboundedPreceding, -1)), "max": F.max("v_").over(order.rowsBetween(Window.unboundedPreceding, -1))}
    return rows, sums.select(F.col(key).alias("k_"), F.col("b_").alias("c_"), how[over].alias("before_"))


def _joined(rows: DataFrame, before: DataFrame, key: str) -> DataFrame:
    return rows.join(before, F.col(key).eqNullSafe(F.col("k_")) & F.col("b_").eqNullSafe(F.col("c_")), "left").drop("k_", "c_")


def lagged(rows: DataFrame, key: str, order: list[str], values: list[str], bucket: Column) -> DataFrame:
    """``rows`` with ``prev``: a struct of the ``values`` of the row before in the key's order, null for its first.

    ``bucket`` must not fall as ``order`` rises.
    """
    own = F.struct(*values)
    rows, before = _carried(rows, key, bucket, F.max_by(own, F.struct(*order)), "last")
    inside = F.lag(own).over(Window.partitionBy(key, "b_").orderBy(*order))
    return _joined(rows.withColumn("prev", inside), before, key).withColumn("prev", F.coalesce("prev", "before_")).drop("before_", "b_")


def running(rows: DataFrame, key: str, order: list[str], value: Column, name: str, bucket: Column, how: str = "sum", own: bool = True) -> DataFrame:
    """``rows`` with ``name``: the sum or greatest of ``value`` over the key's rows so far (without the row itself unless ``own``)."""
    reduce = {"sum": F.sum, "max": F.max}[how]
    rows = rows.withColumn("x_", value)
    rows, before = _carried(rows, key, bucket, reduce("x_"), how)
    frame = Window.partitionBy(key, "b_").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    out = _joined(rows.withColumn("i_", reduce("x_").over(frame)), before, key)
    both = F.coalesce("i_", F.lit(0)) + F.coalesce("before_", F.lit(0)) if how == "sum" else F.greatest("i_", "before_")
    return out.withColumn(name, both).drop("x_", "i_", "before_", "b_")


def within_ahead(rows: DataFrame, key: str, at: str, span: int, name: str) -> DataFrame:
    """``rows`` with ``name``: how many of the key's rows lie in ``[at, at + span)``.

    Each row also visits the bucket before its own, so a bucket of ``span`` sees all that its rows reach.
    """
    place = F.floor(F.col(at) / span)
    twice = rows.withColumn("b_", F.explode(F.array(place, place - 1))).withColumn("own_", F.col("b_") == place)
    frame = Window.partitionBy(key, "b_").orderBy(at).rangeBetween(0, span - 1)
    return twice.withColumn(name, F.count("*").over(frame)).filter("own_").drop("b_", "own_")
