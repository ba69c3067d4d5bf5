"""Held-out fold and bounded training samples, shared by the two classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.session import checkpointed

#: Labels up to which the table with a row for each is broadcast.
FEW_LABELS = 100_000
#: Shares in which the rows of a label are ranked.
PARTS = 16


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fold that is never learned from: crc32 of the id as text, mod 5, is 0 (or there is no id)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


def bounded_sample(rows: DataFrame, key: str, label: str, per_label: int) -> DataFrame:
    """At most ``per_label`` rows for each value of ``label``, chosen by a hash of ``key``.

    Rows are first thinned to about the bound by the hash alone, so that the ranking that enforces it
    sees no more than a little over ``per_label`` rows of a value, however many there are. They are
    ranked in ``PARTS`` shares, each with its part of the bound, so that no value is ranked in one task.
    """
    counts = checkpointed(rows.groupBy(label).agg(F.count("*").alias("n_")))
    if counts.count() <= FEW_LABELS:
        counts = F.broadcast(counts)
    share = F.lit(1.3 * per_label) / F.col("n_") + F.lit(50.0) / F.col("n_")
    unit = F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 30)) / float(1 << 30)
    thin = rows.join(counts, label).filter(unit < share).drop("n_")
    parts = max(1, min(PARTS, per_label))
    thin = thin.withColumn("p_", F.pmod(F.xxhash64(F.lit("part"), F.col(key)), F.lit(parts)))
    rank = F.row_number().over(Window.partitionBy(label, "p_").orderBy(F.xxhash64(F.lit("sample"), F.col(key)), F.col(key)))
    return thin.withColumn("r_", rank).filter(F.col("r_") <= per_label // parts).drop("r_", "p_")
