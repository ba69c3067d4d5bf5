import random

import pytest
from pyspark.sql import functions as F

from footfall.llm import topk
from tests.compare import assert_same, connect


def brute(vectors, is_query, k):
    out = []
    for q, a in vectors.items():
        if is_query(q):
            scored = sorted(((-sum(x * y for x, y in zip(a, b)), i) for i, b in vectors.items() if i != q))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("block", [7, 1000])
def test_against_brute_force(spark, block):
    rng = random.Random(3)
    vectors = {i: [rng.choice([0, 0, 0, -2, 1, 3]) for _ in range(rng.choice([3, 6]))] for i in range(60)}
    vectors |= {100 + i: [1, 1, 1] for i in range(30)}  # one vector for a third of all rows: ties
    df = spark.createDataFrame([(i, [x / 1024 for x in v]) for i, v in vectors.items()], "vec_id long, embedding array<float>")
    rows = topk.sparse_rows(df)
    assert {r.vec_id: r.weights for r in rows.collect()} == vectors
    got = topk.top_k(rows, F.col("vec_id") % 10 == 0, k=10, block=block, queries_at_once=4)
    assert sorted(map(tuple, got.collect())) == brute(vectors, lambda q: q % 10 == 0, 10)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, []), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [float("inf")]), (None, [1.0]), (6, [1.0]), (6, [1.0]), (100, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = topk.top_k(topk.sparse_rows(df), F.col("vec_id") % 100 == 0)
    assert sorted(map(tuple, got.collect())) == [(0, 1, 6, 1024 * 1024), (0, 2, 6, 1024 * 1024), (0, 3, 100, 0), (100, 1, 0, 0), (100, 2, 6, 0), (100, 3, 6, 0)]


def test_repeated_ids_are_rows_of_their_own(spark):
    rows = [(0, [1.0]), (0, [2.0]), (0, [2.0]), (3, [5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score >> 20) for r in topk.top_k(topk.sparse_rows(df), F.col("vec_id") % 100 == 0, k=2).collect())
    assert got == sorted([(0, 1, 3, 5), (0, 2, 0, 2), (0, 1, 3, 10), (0, 2, 0, 4), (0, 1, 3, 10), (0, 2, 0, 4)])


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(topk.sparse_rows(df), F.col("vec_id") % 100 == 0).count() == 0


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert_same(topk.op1_exact_topk(spark, sf).toPandas(), connect(sf).execute(topk.SQL["op1_exact_topk"]).df())
