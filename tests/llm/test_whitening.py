import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from footfall.llm import whitening as W


def _by_hand(vectors):
    """n, sums and covariance in Python integers, eigenvectors by numpy."""
    x = [[math.floor(1024 * c) + 100_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    y = [[n * r[i] - s[i] for i in range(d)] for r in x]
    cov = np.array([[sum(r[i] * r[j] for r in y) / n**3 for j in range(d)] for i in range(d)])
    e, v = np.linalg.eigh(cov)
    return n, y, e[::-1], v[:, ::-1]


def test_query_against_python_integers_and_numpy(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    n, y, e, v = _by_hand([[float(c) for c in vec] for vec in rows["embedding"]])
    want = np.array(y, float) / n @ v[:, :8] / np.sqrt(e[:8])
    got = W.op13_embedding_whitening(spark, sf).toPandas()
    assert len(got) == 8 * len(rows) and (got.n == n).all()
    table = got.pivot(index="vec_id", columns="component", values="whitened").loc[rows["vec_id"]].to_numpy()
    assert np.abs(table * np.sign((table * want).sum(0)) - want).max() < 1e-8
    assert dict(zip(got.vec_id, got.deviation, strict=True)) == {i: sum(c * c for c in r) for i, r in zip(rows["vec_id"], y, strict=True)}
    shares = got.groupby("component").explained.first().to_numpy()
    assert np.allclose(shares, e[:8] / e.sum(), rtol=1e-10)
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9


def test_rerun_agrees_to_the_bit(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    a = W.Whitener.fit(W.whole_rows(rows))
    b = W.Whitener.fit(W.whole_rows(rows.repartition(7, F.rand())))
    assert (a.values == b.values).all() and (a.vectors == b.vectors).all()


def test_factor_and_rotations():
    rng = np.random.default_rng(1)
    for d, rank in ((1, 1), (5, 5), (20, 12)):
        b = rng.normal(size=(d, rank)) * 10.0 ** rng.uniform(-3, 3, rank)
        a = b @ b.T
        low = W.pivoted_cholesky(a, 1e-13)
        assert low.shape[1] == rank and np.allclose(low @ low.T, a, rtol=1e-9, atol=1e-9 * np.abs(a).max())
        norms, u = W.one_sided_jacobi(low)
        assert np.allclose(u.T @ u, np.eye(rank), atol=1e-12)
        assert np.allclose(norms**2, np.linalg.eigvalsh(a)[::-1][:rank], rtol=1e-8, atol=1e-12 * np.abs(a).max())
    assert W.one_sided_jacobi(W.pivoted_cholesky(np.zeros((3, 3))))[0].shape == (0,)


def _frame(spark, rows):
    # component, n and w are names that the operator uses for columns of its own
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n string, w string, component string, x string")


def test_odd_input(spark):
    inf, nan = float("inf"), float("nan")
    odd = [(1, None), (2, []), (3, [1.0, None, 2.0]), (4, [1.0, nan, 2.0]), (5, [inf, 0.0, 0.0]), (6, [1.0, 2.0]), (None, None)]
    good = [(7, [1.0, 2.0, 3.0]), (7, [1.0, 2.0, 3.0]), (8, [0.5, -2.0, 3.0]), (None, [4.0, 1.0, 3.0]), (9, [-1.0, 0.0, 3.0])]
    rows = W.whole_rows(_frame(spark, [(i, v, 1, "a", "b", "c", "d") for i, v in odd + good]))
    model = W.Whitener.fit(rows)
    assert model.n == 5 and len(model.values) == 2  # the third dimension has no spread
    out = W.whitened(rows, model).collect()
    assert sorted((r.vec_id or 0) for r in out) == [0, 7, 7, 8, 9]
    assert W.identity_error(W.whitened(rows, model), 2) < 1e-12
    n, y, e, _ = _by_hand([v for _, v in good])
    assert np.allclose(model.values, e[:2]) and sorted(int(r.deviation) for r in out) == sorted(sum(c * c for c in r) for r in y)


@pytest.mark.parametrize("vectors", [[], [[1.0, 2.0]], [[1.0, 2.0]] * 3, [[]]])
def test_no_spread_gives_no_rows(spark, tmp_path, vectors):
    _frame(spark, [(i, v, 1, "a", "b", "c", "d") for i, v in enumerate(vectors)]).write.parquet(str(tmp_path / "embeddings.parquet"))
    out = W.op13_embedding_whitening(spark, str(tmp_path))
    assert out.count() == 0 and out.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_large_entries_are_exact(spark):
    rows = _frame(spark, [(i, v, 1, "a", "b", "c", "d") for i, v in enumerate([[3e30, 1.0], [-3e30, 7.0], [2e9, 3.0]])])
    got = W.whole_rows(rows)
    model = W.Whitener.fit(got)
    x = [[2**40 + 100_000, 101_024], [-(2**40) + 100_000, 107_168], [2_000_000_000 * 1024 + 100_000, 103_072]]
    x[2][0] = min(x[2][0], 2**40 + 100_000)
    s = [sum(r[i] for r in x) for i in range(2)]
    assert [int(v) for v in model.sums] == s
    want = {i: sum((3 * r[k] - s[k]) ** 2 for k in range(2)) for i, r in enumerate(x)}
    assert {r.vec_id: int(r.deviation) for r in W.whitened(got, model).collect()} == want


def test_square_sums():
    c = np.random.default_rng(2).integers(-(2**61), 2**61, (40, 9))
    c[0] = 0
    want = [sum(int(v) ** 2 for v in row) for row in c]
    assert W._square_sums(c) == want == W._square_sums(c.astype(object)) and W._square_sums(c[:0]) == []
