"""Operator 10: line dedup by pairwise alignment of overlapping documents.

A document is the run of its lines that are not blank. Two documents overlap where both hold the same
lines in a row, of ``min_words`` words or more together. Such a block is made of *windows*, the shortest
runs from or up to a line that hold so many words: a long line is a window by itself, short ones are taken
together. The partners of a document are the earliest holders of its windows. A window names one earlier
document, so there are never more pairs than windows however large a group of copies or however common a
line is, and no overlap is lost: a window that any earlier document holds stands in its earliest holder too.

Each pair is aligned by patience diff on the windows that it has in common: the longest run of them that
ascends in both. The lines of aligned windows are deleted from the later document, and what is left is
aligned again until nothing is: a block that stands elsewhere in the two, or more often in the later one,
crosses the first alignment and goes by a later one. Nothing goes that no alignment holds, and the earliest
document with a block never loses it. Only the windows met travel, not the documents, so a document with
very many partners costs no more than its windows.

Documents are ordered by doc_id (those without one come last), then by a hash of the text.

Cases: lines are compared without white space at their ends; a blank line falls if the nearest other lines
on both sides of it have fallen; null and empty texts pass unchanged; rows that are equal in doc_id and
text are one document and come out alike; a document of which all is deleted comes out with an empty text;
an empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.session import checkpointed, table

MIN_WORDS = 5
#: Documents of one window that meet a copy of it in one place.
PAIRS_A_COPY = 500
#: Windows of more than that, up to which their table (some 40 bytes a row) is broadcast.
FEW_CROWDED = 200_000


def patience(places: list[int]) -> list[int]:
    """Indices of a longest run of ``places`` that never falls (of several, the one that ends lowest)."""
    tails: list[int] = []  # the least end of a run of each length
    ends: list[int] = []
    back = [-1] * len(places)
    for n, place in enumerate(places):
        at = bisect_right(tails, place)
        back[n] = ends[at - 1] if at else -1
        tails[at : at + 1], ends[at : at + 1] = [place], [n]
    chain, n = [], ends[-1] if ends else -1
    while n >= 0:
        chain.append(n)
        n = back[n]
    return chain[::-1]


def aligned(spans: list[tuple[int, int, int]]) -> list[int]:
    """Lines of the later document in windows that some alignment holds.

    ``spans`` are the windows that a pair has in common: first line and end in the later document, first line in the earlier
    one. Passes run until no window is left; every other one is read backwards, so that lines in falling order take few.
    """
    left, gone, turn = sorted(set(spans)), set(), 1
    while left:
        chosen = set(patience([turn * s[2] for s in left]))
        for n in chosen:
            gone.update(range(*left[n][:2]))
        left = [s for n, s in enumerate(left) if n not in chosen and not gone.issuperset(range(*s[:2]))]
        turn = -turn
    return sorted(gone)


def _identity(text: Column) -> Column:
    """A document's place in the order of all, and its identity."""
    doc_id = F.col("doc_id").cast("long")
    return F.struct(doc_id.isNull().alias("none"), doc_id.alias("doc_id"), F.xxhash64(text).alias("t"))


def line_rows(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``id, windows, ps, n``: a document, its windows (hash ``h``, first line ``a`` and end ``b``) and the places of its lines; ``n`` counts blank ones too."""
    text = F.col("text").cast("string")
    strip = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    rows = docs.filter(text != "").select(_identity(text).alias("id"), strip.alias("lines")).withColumn("n", F.size("lines"))
    rows = rows.select("id", "n", F.filter(F.transform("lines", lambda x, i: F.struct(x.alias("s"), i.alias("p"))), lambda v: v.s != "").alias("v")).filter("size(v) > 0")
    rows = rows.select(
        "id", "n", F.col("v.p").alias("ps"), F.transform("v.s", lambda x: F.xxhash64(F.lit("window"), x)).alias("es"),
        F.transform("v.s", lambda x: F.size(F.split(x, r"\s+"))).alias("ws"),
    )

    def window(at: Column, step: int) -> Column:
        """The shortest run from (or up to) ``at`` that holds enough words; null if none does."""
        out, total = F.lit(None).cast("struct<h: bigint, a: int, b: int>"), F.lit(0)
        places = [at + step * k for k in range(min_words)]
        tests = []
        for k, place in enumerate(places):
            total = total + F.when(place >= 0, F.get("ws", place))
            run = places[: k + 1][::step]
            tests.append((total >= min_words, F.struct(F.xxhash64(F.lit(k), *[F.get("es", i) for i in run]).alias("h"), run[0].alias("a"), (run[-1] + 1).alias("b"))))
        for test, key in reversed(tests):
            out = F.when(test, key).otherwise(out)
        return out

    places = F.sequence(F.lit(0), F.size("ws") - 1)
    windows = F.array_compact(F.array_distinct(F.concat(F.transform(places, lambda i: window(i, 1)), F.transform(places, lambda i: window(i, -1)))))
    return rows.select("id", windows.alias("windows"), "ps", "n").dropDuplicates(["id"])


def _crowded(counts: DataFrame, key: str) -> DataFrame:
    """``key, copies`` of those that are counted more than ``PAIRS_A_COPY`` times."""
    found = checkpointed(counts.select(key, F.ceil(F.col("n") / PAIRS_A_COPY).alias("copies")).filter("copies > 1"))
    return F.broadcast(found) if found.count() <= FEW_CROWDED else found


def _dealt(rows: DataFrame, crowded: DataFrame, key: str) -> DataFrame:
    """``rows`` with the ``copy`` of their key that each meets."""
    return rows.join(crowded, key, "left").withColumn("copy", F.pmod(F.xxhash64("id"), F.coalesce("copies", F.lit(1).cast("long")))).drop("copies")


def _laid(rows: DataFrame, crowded: DataFrame, key: str) -> DataFrame:
    """``rows`` once for each ``copy`` of their key."""
    every = F.sequence(F.lit(0).cast("long"), F.coalesce("copies", F.lit(1).cast("long")) - 1)
    return rows.join(crowded, key, "left").withColumn("copy", F.explode(every)).drop("copies")


def partners(rows: DataFrame) -> DataFrame:
    """``id, first, a, b, at``: each window of a document that an earlier one holds, its earliest holder and its first place there."""
    held = rows.select("id", F.explode("windows").alias("w")).select("id", "w.*")
    first = held.groupBy("h").agg(F.min(F.struct("id", "a")).alias("f"), F.count("*").alias("n")).filter("n > 1")
    first = checkpointed(first.select("h", F.col("f.id").alias("first"), F.col("f.a").alias("at"), "n"))
    crowded = _crowded(first, "h")
    met = _dealt(held, crowded, "h").join(_laid(first.drop("n"), crowded, "h"), ["h", "copy"])
    return met.filter("id > first").select("id", "first", "a", "b", "at")


def doomed(rows: DataFrame) -> DataFrame:
    """``id, mask``: for each line of a document that loses some, whether it stays."""
    spans = partners(rows).groupBy("id", "first").agg(F.collect_list(F.struct("a", "b", "at")).alias("spans"))
    identity = "none boolean, doc_id long, t long"

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            gone = [aligned([(s["a"], s["b"], s["at"]) for s in spans]) for spans in pdf["spans"]]
            yield pd.DataFrame({"none": pdf["none"], "doc_id": pdf["doc_id"].astype("Int64"), "t": pdf["t"], "gone": pd.Series(gone, dtype="object")})

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            masks = []
            for places, n, gone in zip(pdf["ps"], pdf["n"], pdf["gone"], strict=True):
                fallen = np.zeros(len(places) + 2, bool)  # one more at each end, for blank lines there
                fallen[1 + np.asarray(gone, np.int64)] = True
                fallen[0], fallen[-1] = fallen[1], fallen[-2]
                stays = np.ones(n, bool)
                after = np.searchsorted(places, np.arange(n), "right")  # lines up to here that are not blank
                stays[fallen[after] & fallen[after + 1]] = False
                stays[places] = ~fallen[1:-1]
                masks.append(stays.tolist())
            yield pd.DataFrame({"none": pdf["none"], "doc_id": pdf["doc_id"].astype("Int64"), "t": pdf["t"], "mask": pd.Series(masks, dtype="object")})

    found = spans.select("id.*", "spans").mapInPandas(align, identity + ", gone array<int>")
    id_ = F.struct("none", "doc_id", "t").alias("id")
    whole = found.groupBy(id_).agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))
    return whole.join(rows.select("id", "ps", "n"), "id").select("id.*", "ps", "n", "gone").mapInPandas(mark, identity + ", mask array<boolean>").select(id_, "mask")


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, text, removed``: every row with its text less the blocks of lines that stand in an earlier document."""
    rows = checkpointed(line_rows(docs, min_words))
    marks = checkpointed(doomed(rows))
    text = F.col("text").cast("string")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), _identity(text).alias("id"))
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: F.get("mask", i)), "\n")
    removed = F.size(F.filter("mask", lambda x: ~x))
    return own.join(marks, "id", "left").select("doc_id", F.when(F.col("mask").isNull(), F.col("text")).otherwise(kept).alias("text"), F.when(F.col("mask").isNull(), 0).otherwise(removed).alias("removed"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents less the blocks of lines that an earlier one holds."""
    return deduplicated(table(spark, sf_dir, "documents"))


QUERIES = {"op10_line_dedup": op10_line_dedup}
#: Patience diff has no SQL form; tests/llm/test_linededup.py holds the query against all pairs in plain Python.
SQL: dict[str, str] = {}
