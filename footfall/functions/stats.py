"""Statistics as Column expressions over aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The Wilson interval of a share; null where there is nothing to count."""
    p = hits / F.nullif(n, F.lit(0))
    mid, wide = p + z**2 / (2 * n), z * F.sqrt(p * (1 - p) / n + z**2 / (4.0 * n * n))
    return (mid - wide) / (1 + z**2 / n), (mid + wide) / (1 + z**2 / n)


def log_factorial(n: Column) -> Column:
    """The logarithm of n!, by Stirling's series eight places on (to 1e-11 of small, 1e-15 times its size of large ones)."""
    z = n.cast("double") + 9
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z)
    less = F.lit(0.0)
    for k in range(1, 9):
        less = less + F.log(z - k)
    return series - less


def sign_test(wins: Column, losses: Column) -> Column:
    """Two-sided exact binomial probability of a split at least as uneven; 1 where there are no pairs.

    Each term follows from the one before it by a factor, so the work grows with the smaller count.
    """
    n, low = (wins + losses).cast("long"), F.least(wins, losses).cast("long")
    # Terms from the largest (i = low) down, as shares of it: none of them overflows, and tiny ones come last.
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))
    down = F.when(low > 0, F.sequence(low, F.lit(1).cast("long"), F.lit(-1).cast("long"))).otherwise(F.array().cast("array<bigint>"))

    def step(s: Column, i: Column) -> Column:
        term = s["term"] * i.cast("double") / (n - i + 1).cast("double")
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"))

    share = F.aggregate(down, start, step, lambda s: s["total"])
    first = log_factorial(n) - log_factorial(low) - log_factorial(n - low) - n * F.log(F.lit(2.0))
    return F.least(F.lit(1.0), 2 * F.exp(first) * share)


def largest_remainder(groups: DataFrame, key: str, weight: str, budget: int) -> DataFrame:
    """``key, share``: a whole budget dealt in proportion, the rest to the largest fractions (one row a group)."""
    every = Window.partitionBy()
    quota = groups.withColumn("q", F.lit(float(budget)) * F.col(weight) / F.sum(weight).over(every))
    part = quota.select(key, F.floor("q").alias("base"), (F.col("q") - F.floor("q")).alias("frac"), (budget - F.sum(F.floor("q")).over(every)).alias("rest"))
    rank = F.row_number().over(Window.orderBy(F.desc("frac"), key))
    return part.select(key, (F.col("base") + F.when(rank <= F.col("rest"), 1).otherwise(0)).alias("share"))


def validation_plan(groups: DataFrame, key: str, weight: str, size: str, budget: int, least: int = 1) -> DataFrame:
    """``key, share``: a budget over strata: empty ones get nothing and are named by 0, every other at least ``least`` of its
    points, the rest goes by largest remainders, and none gets more than it has (one row a stratum)."""
    held = groups.select(key, F.col(weight).alias("w_"), F.col(size).alias("s_"))
    floor = held.withColumn("least_", F.least(F.lit(least), "s_"))
    every = Window.partitionBy()
    rest = F.lit(budget) - F.sum("least_").over(every)
    quota = floor.withColumn("q", F.when(F.col("s_") > 0, rest * F.col("w_") / F.sum(F.when(F.col("s_") > 0, F.col("w_"))).over(every)).otherwise(0.0)).withColumn("rest_", rest)
    part = quota.withColumn("base", F.floor("q")).withColumn("over", F.col("rest_") - F.sum(F.floor("q")).over(every))
    rank = F.row_number().over(Window.orderBy(F.desc(F.col("q") - F.col("base")), key))
    share = F.col("least_") + F.col("base") + F.when((rank <= F.col("over")) & (F.col("s_") > 0), 1).otherwise(0)
    return part.select(key, F.least(share, "s_").cast("long").alias("share"))
