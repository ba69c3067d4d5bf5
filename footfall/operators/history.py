"""Ordered histories: pagination state, interval merging, digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.operators import ordered


def pagination(rows: DataFrame, totals: DataFrame, seq: str = "seq", page: str = "page", uid: str = "uid", limit: int = 150, last_page: int = 20) -> DataFrame:
    """The state of every page of a sequence as its pages come in order.

    ``totals`` has a row for every page that was fetched, ``seq, page, total``: what the source reported with it (null where it did
    not); a total below 0 is none, with a warning. A page without rows ends the sequence with the last warning, short of its
    total with one more. A page that
    repeats another's set of members, or holds members of an earlier page, is an anomaly and ends the sequence. A total
    that reached ``limit`` may have been cut, and one that changed, or that fewer members name than came, leaves the
    sequence uncertain: these warnings do not end it, but the last of them is the reason once as many members have come as
    a total below the limit names (``completed`` without any). After ``last_page`` pages it ends whatever came.
    """
    own = rows.select(F.col(seq).alias("seq"), F.col(page).alias("page"), F.col(uid).alias("uid"))
    firsts = own.groupBy("seq", "uid").agg(F.min("page").alias("first_page"))
    # The fingerprint is order-free sums of hashes, so a page is never gathered.
    distinct = own.groupBy("seq", "page", "uid").agg(F.count("*").alias("n")).join(firsts, ["seq", "uid"])
    pages = distinct.groupBy("seq", "page").agg(
        F.sum("n").alias("rows_"), F.count_if(F.col("first_page") < F.col("page")).alias("overlap"),
        F.concat_ws("-", F.count("*"), F.sum(F.xxhash64("uid").cast("decimal(38,0)")), F.bit_xor(F.xxhash64(F.lit("x"), "uid"))).alias("print"),
    )
    told = totals.select(F.col(seq).alias("seq"), F.col(page).alias("page"), F.when(F.col("total") >= 0, F.col("total")).alias("total"), F.coalesce(F.col("total") < 0, F.lit(False)).alias("odd_"))
    order = Window.partitionBy("seq").orderBy("page")
    zero = F.lit(0).cast("long")
    out = told.join(pages, ["seq", "page"], "left").withColumns({"rows_": F.coalesce("rows_", zero), "overlap": F.coalesce("overlap", zero)}).select(
        "seq", "page", "total", "odd_", F.sum("rows_").over(order).alias("returned"), "overlap", (F.col("rows_") == 0).alias("empty_"), F.row_number().over(order).alias("n_"),
        ((F.col("rows_") > 0) & (F.count("*").over(Window.partitionBy("seq", "print").orderBy("page")) > 1)).alias("repeated"), (~F.col("total").eqNullSafe(F.lag("total").over(order))).alias("differs_"),
    )
    out = out.withColumn("total_changed", F.col("differs_") & (F.col("n_") > 1))
    short = F.col("empty_") & (F.col("returned") < F.col("total"))
    warning = F.when((F.col("returned") > F.col("total")) | short, "pagination_uncertain").when(F.col("total") >= limit, "possible_truncation").when(F.col("total_changed") | F.col("odd_"), "pagination_uncertain")
    out = out.withColumn("w_", warning).withColumn("last_", F.last("w_", ignorenulls=True).over(order)).withColumn("cut_", F.max(F.coalesce(F.col("total") >= limit, F.lit(False))).over(order))
    stop = (
        F.when((F.col("overlap") > 0) | F.col("repeated"), "pagination_anomaly")
        .when(F.col("empty_") | ((F.col("total") < limit) & (F.col("returned") >= F.col("total"))), F.coalesce("last_", F.lit("completed")))
        .when(F.col("n_") >= last_page, F.when(F.col("cut_"), "possible_truncation").otherwise("page_limit"))
    )
    return out.withColumn("stop_reason", stop).drop("n_", "differs_", "w_", "last_", "cut_", "odd_", "empty_")


def merge_intervals(rows: DataFrame, key: str, start: str, end: str, bucket: int = 3_600_000) -> DataFrame:
    """Gaps and islands: intervals of a key that overlap or touch become one; windows stay within buckets of the start."""
    place = F.floor(F.col(start) / bucket)
    reach = ordered.running(rows.select(key, start, end), key, [start, end], F.col(end), "reach_", place, "max", own=False)
    new = F.when(F.col("reach_").isNull() | (F.col(start) > F.col("reach_")), 1).otherwise(0)
    marked = ordered.running(reach.withColumn("new_", new), key, [start, end], F.col("new_"), "island_", place)
    return marked.groupBy(key, "island_").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("parts")).drop("island_")


def digest(columns: list[str]) -> Column:
    """sha256 of the canonical JSON (keys in order) of the columns."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)])), 256)
