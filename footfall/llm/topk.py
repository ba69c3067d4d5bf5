"""Operator 1: exact top-k search by term-at-a-time accumulation.

A vector is a sparse row of (term, weight); a term is a component's position. Candidates are dealt
into blocks. In a block each term has a posting list of candidate rows and weights, a query's terms
scatter their weighted postings into a dense score array, the k best are selected by partition, and
the blocks' selections are merged.

Cases: a vector that is null, empty, or holds a null or non-finite component takes no part, nor does
one without an id. Rows that repeat an id are rows of their own: each is a candidate for the other, and
each asks if the id does. Vectors of unequal length score over the terms they share. Scores are 64-bit integers and wrap beyond that. Ties go to
the smaller id; a query with fewer than k candidates returns all; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from footfall.session import checkpointed, table

#: Candidates of one block, and queries that meet a block at once: together they bound a task's memory.
BLOCK, QUERIES_AT_ONCE = 16_384, 2_048


def _postings(vectors: list[np.ndarray]) -> list[tuple[np.ndarray | None, np.ndarray]]:
    """Per term: the rows that hold it (None: all of them) and their weights."""
    length = np.array([len(v) for v in vectors])
    out = []
    for term in range(int(length.max(initial=0))):
        rows = np.flatnonzero(length > term)
        weight = np.fromiter((vectors[r][term] for r in rows), np.int64, len(rows)) if len(rows) < len(vectors) else np.array([v[term] for v in vectors], np.int64)
        if len(rows) < len(vectors) or 2 * np.count_nonzero(weight) < len(rows):
            held = weight != 0
            out.append((rows[held], weight[held]))
        else:
            out.append((None, weight))
    return out


def _select(score: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k highest scores; the earlier index wins a tie."""
    if len(score) <= k:
        return np.arange(len(score))
    bar = np.partition(score, len(score) - k)[len(score) - k]
    above = np.flatnonzero(score > bar)
    return np.r_[above, np.flatnonzero(score == bar)[: k - len(above)]]


def _block_top(key: tuple, queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best rows of one block for each of the queries."""
    empty = pd.DataFrame({c: np.zeros(0, np.int64) for c in ("asker", "query_id", "vec_id", "score")})
    if queries.empty or rows.empty:
        return empty
    rows = rows.sort_values(["vec_id", "rid"])
    ids, own = rows["vec_id"].to_numpy(), rows["rid"].to_numpy()
    postings = _postings([np.asarray(v) for v in rows["weights"]])
    out: list[list[np.ndarray]] = [[], [], [], []]
    for asker, query, weights in zip(queries["rid"].tolist(), queries["vec_id"].tolist(), queries["weights"], strict=True):
        score = np.zeros(len(ids), np.int64)
        for term in np.flatnonzero(weights):
            if term < len(postings):
                held, weight = postings[term]
                if held is None:
                    score += weights[term] * weight
                else:
                    score[held] += weights[term] * weight
        others = np.flatnonzero(own != asker)
        best = others[_select(score[others], k)] if len(others) < len(ids) else _select(score, k)
        for part, found in zip(out, (np.full(len(best), asker, np.int64), np.full(len(best), query, np.int64), ids[best], score[best]), strict=True):
            part.append(found)
    return pd.DataFrame({c: np.concatenate(part) for c, part in zip(("asker", "query_id", "vec_id", "score"), out, strict=True)})


def sparse_rows(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """``vec_id, weights``: floor(scale * x) of every component of every row; unusable vectors are left out."""
    x = F.col("v").cast("array<double>")
    usable = (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "weights": [np.clip(np.floor(scale * np.asarray(v, np.float64)), -(2.0**62), 2.0**62).astype(np.int64) for v in pdf["v"]]})

    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & usable)
    return rows.select("vec_id", x.alias("v")).mapInPandas(run, "vec_id long, weights array<long>")


def top_k(rows: DataFrame, is_query: Column, k: int = 10, block: int = BLOCK, queries_at_once: int = QUERIES_AT_ONCE) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k highest inner products of each query row over all other rows.

    ``rows`` has ``vec_id, weights``. They are numbered, written, and dealt into blocks of about ``block``
    candidates and ``queries_at_once`` queries by a hash of the number; every pair of blocks meets in one
    task, whose memory the two sizes bound, and hands on k rows per query.
    """
    rows = checkpointed(rows.withColumn("rid", F.monotonically_increasing_id()))
    n, nq = rows.agg(F.count("*"), F.count(F.when(is_query, 1))).first()
    blocks, groups = max(1, -(-n // block)), max(1, -(-nq // queries_at_once))
    deal = F.xxhash64("rid")
    cands = rows.select("rid", "vec_id", "weights", F.pmod(deal, F.lit(blocks)).alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("g"))
    asks = rows.filter(is_query).select("rid", "vec_id", "weights", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("b"), F.pmod(deal, F.lit(groups)).alias("g"))
    part = (
        asks.groupBy("b", "g")
        .cogroup(cands.groupBy("b", "g"))
        .applyInPandas(lambda key, a, c: _block_top(key, a, c, k), "asker long, query_id long, vec_id long, score long")
    )
    order = Window.partitionBy("asker").orderBy(F.desc("score"), "vec_id")
    return part.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best rows for every embedding whose id is divisible by 100."""
    return top_k(sparse_rows(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 100 == 0)


QUERIES = {"op1_exact_topk": op1_exact_topk}
SQL = {
    "op1_exact_topk": """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.rid, q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.rid <> q.rid WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""
}
