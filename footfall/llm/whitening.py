"""Operator 13: whitening of embeddings by pivoted Cholesky and one-sided Jacobi.

Components of a vector become whole numbers, so their sums and the scatter about the mean are exact
whatever the order of the rows: each task centres its rows on the rounded mean, multiplies them in blocks
whose sums a double holds without rounding, and hands on one number per pair of dimensions. From these
numbers comes the centred scatter, and on the driver (a matrix as wide as a vector, whatever the rows):

1. pivoted Cholesky: the scatter is L times its transpose, the largest remaining diagonal first;
2. one-sided Jacobi on the columns of L itself: pairs of columns are rotated until all are orthogonal.
   The columns' norms are the roots of the eigenvalues, the columns divided by them the components. The
   covariance is never diagonalised as such, so small eigenvalues keep their digits.

Rows are then projected on the components and divided by the roots of their eigenvalues.

Cases: a vector that is null, empty, or holds a null or non-finite entry is left out, and so is one whose
length is not the commonest (the longer, if two are). Rows with a null id and rows that repeat an id are
rows of their own. Components without spread are left out, so equal vectors, or a table of one, give no
rows. A ``deviation`` beyond 64 bits is null; ``deviation_exact`` has it as a decimal. Entries whose scaled
value is beyond 2^40 are held there. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.session import table

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Bound of a scaled entry.
LARGEST = 2**40
#: A pivot below this share of the largest ends the factor: what is left is rounding.
FLAT = 1e-15


def whole_rows(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """``vec_id, x``: floor(scale * c) + shift for every entry c of every usable vector of the commonest length."""
    v = F.col(f"`{vector}`").cast("array<double>")
    usable = (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = df.select(F.col(f"`{id_col}`").alias("vec_id"), v.alias("v")).filter(F.col("v").isNotNull() & usable)
    held = lambda c: F.least(F.lit(float(LARGEST)), F.greatest(F.lit(-float(LARGEST)), c * F.lit(float(scale))))
    whole = rows.select("vec_id", F.transform("v", lambda c: F.floor(held(c)).cast("long") + shift).alias("x"))
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return whole.filter(F.size("x") == (lengths["d"] if lengths else 0))


def _matrix(x: pd.Series, d: int) -> np.ndarray:
    return np.concatenate(x.to_list()).reshape(-1, d).astype(np.int64) if len(x) else np.zeros((0, d), np.int64)


def _products(y: np.ndarray) -> np.ndarray:
    """Exact sum of the outer products of the rows of ``y`` (as Python integers)."""
    total = np.zeros((y.shape[1],) * 2, object)
    most = int(np.abs(y).max(initial=0))
    rows = 2**53 // max(1, most * most)
    if not rows:  # the products alone are beyond a double
        big = y.astype(object)
        return big.T @ big
    for at in range(0, len(y), rows):
        part = y[at : at + rows].astype(np.float64)
        total += (part.T @ part).astype(np.int64)
    return total


def moments(rows: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, S, C): rows, sums per dimension, and n times the scatter about the mean, n * sum(x x') - S S', all exact."""
    first = rows.select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(F.count("*").alias("n"), F.sum(F.col("x").cast("decimal(20,0)")).alias("s")).orderBy("i").collect()
    d, n = len(first), first[0]["n"] if first else 0
    sums = np.array([int(r["s"]) for r in first], object)
    near = np.array([int(s) // n for s in sums], np.int64)
    upper = np.triu_indices(d)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, seen = np.zeros((d, d), object), False
        for pdf in batches:
            total, seen = total + _products(_matrix(pdf["x"], d) - near), True
        if seen:
            yield pd.DataFrame({"k": np.arange(len(upper[0])), "v": [Decimal(int(v)) for v in total[upper]]})

    parts = rows.select("x").mapInPandas(run, "k int, v decimal(38,0)").groupBy("k").agg(F.sum("v").alias("v")).collect()
    scatter = np.zeros((d, d), object)
    for r in parts:
        i, j = upper[0][r["k"]], upper[1][r["k"]]
        scatter[i, j] = scatter[j, i] = int(r["v"])
    rest = sums - n * near.astype(object)  # of the rows centred on the rounded mean
    return n, sums, n * scatter - np.outer(rest, rest)


def pivoted_cholesky(a: np.ndarray, flat: float = FLAT) -> np.ndarray:
    """Columns L with a = L L', each begun at the largest diagonal entry that the ones before leave."""
    rest, columns = np.array(a, np.float64), []
    bar = flat * max(rest.diagonal().max(initial=0), 0)
    for _ in range(len(rest)):
        at = int(rest.diagonal().argmax())
        if rest[at, at] <= bar:
            break
        column = rest[:, at] / np.sqrt(rest[at, at])
        for done in range(len(columns)):  # pivots taken before have nothing left
            column[columns[done][0]] = 0
        columns.append((at, column))
        rest = rest - np.outer(column, column)
        rest[at, :] = rest[:, at] = 0
    return np.stack([c for _, c in columns], 1) if columns else np.zeros((len(rest), 0))


def one_sided_jacobi(columns: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(norms, unit columns) by falling norm, after rotating pairs of columns until all are orthogonal."""
    u = np.array(columns, np.float64).T.copy()
    for _ in range(sweeps):
        turned = False
        for p in range(len(u) - 1):
            for q in range(p + 1, len(u)):
                a, b, c = u[p] @ u[p], u[q] @ u[q], u[p] @ u[q]
                if abs(c) <= 2**-52 * np.sqrt(a * b):
                    continue
                turned = True
                t = (b - a) / (2 * c)
                t = (1 if t >= 0 else -1) / (abs(t) + np.hypot(1, t))
                cos = 1 / np.hypot(1, t)
                u[p], u[q] = cos * u[p] - cos * t * u[q], cos * t * u[p] + cos * u[q]
        if not turned:
            break
    norms = np.sqrt((u * u).sum(1))
    order = np.argsort(-norms, kind="stable")
    return norms[order], (u[order] / norms[order, None]).T


class Whitener:
    """Components of a fit list: n, its sums, eigenvalues and unit eigenvectors of its covariance (divisor n), and the trace."""

    def __init__(self, n: int, sums: np.ndarray, scatter: np.ndarray, components: int = COMPONENTS):
        self.n, self.sums = n, sums
        cov = np.array([[float(v) for v in row] for row in scatter]).reshape(len(sums), len(sums)) / max(1, n) ** 2
        norms, vectors = one_sided_jacobi(pivoted_cholesky(cov))
        self.trace = float(sum(scatter.diagonal())) / max(1, n) ** 2
        self.values, self.vectors = norms[:components] ** 2, vectors[:, :components]

    @classmethod
    def fit(cls, rows: DataFrame, components: int = COMPONENTS) -> Whitener:
        return cls(*moments(rows), components)

    def project(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whitened, n * x - S as Python integers or 64-bit ones) of whole-number rows."""
        large = self.n * int(np.abs(x).max(initial=1)) >= 2**61
        centred = self.n * x.astype(object) - self.sums if large else self.n * x - self.sums.astype(np.int64)
        return (centred.astype(np.float64) / self.n) @ self.vectors / np.sqrt(self.values), centred


def _square_sums(c: np.ndarray) -> list[int]:
    """Exact sum of squares of each row: in parts of 24 bits, whose products and sums stay within 64."""
    if c.dtype == object or c.shape[1] > 2**13:
        return [int(v) for v in (c.astype(object) ** 2).sum(1)]
    parts = [(np.abs(c) >> shift) & (2**24 - 1) for shift in (0, 24, 48)]
    sums = [sum((parts[i] * parts[k - i]).sum(1) for i in range(3) if 0 <= k - i < 3).tolist() for k in range(5)]
    return [sum(v << (24 * k) for k, v in enumerate(row)) for row in zip(*sums, strict=True)]


def whitened(rows: DataFrame, model: Whitener) -> DataFrame:
    """``vec_id, deviation, w``: each row with its exact squared distance from the mean (times n^2) and its whitened components."""
    d = len(model.sums)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            w, centred = model.project(_matrix(pdf["x"], d))
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "deviation": [Decimal(v) for v in _square_sums(centred)], "w": list(w)})

    kind = dict(rows.dtypes)["vec_id"]
    return rows.mapInPandas(run, f"vec_id {kind}, deviation decimal(38,0), w array<double>")


def identity_error(out: DataFrame, components: int) -> float:
    """Largest entry, in size, of the covariance of ``w`` minus the identity; 0 without components."""
    if not components:
        return 0.0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total, square = 0, np.zeros(components), np.zeros((components, components))
        for pdf in batches:
            w = np.array(pdf["w"].to_list()).reshape(-1, components)
            n, total, square = n + len(w), total + w.sum(0), square + w.T @ w
        yield pd.DataFrame({"k": np.arange(components * (components + 1) + 1), "v": np.r_[n, total, square.ravel()]})

    parts = out.select("w").mapInPandas(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").collect()
    v = np.array([r["v"] for r in parts])
    mean = v[1 : components + 1] / v[0]
    return float(np.abs(v[components + 1 :].reshape(components, components) / v[0] - np.outer(mean, mean) - np.eye(components)).max())


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable embedding's first eight whitened components."""
    rows = whole_rows(table(spark, sf_dir, "embeddings"))
    model = Whitener.fit(rows)
    out = whitened(rows, model)
    error = identity_error(out, len(model.values))
    parts = F.array(*[F.struct(F.lit(i + 1).alias("component"), F.col("w")[i].alias("whitened"), F.lit(float(e / model.trace)).alias("explained")) for i, e in enumerate(model.values)])
    if not len(model.values):
        parts = F.expr("CAST(array() AS array<struct<component: int, whitened: double, explained: double>>)")
    return out.select("vec_id", "deviation", F.explode(parts).alias("p")).select(
        "vec_id",
        "p.component",
        F.lit(model.n).cast("long").alias("n"),
        F.expr("try_cast(deviation AS bigint)").alias("deviation"),
        "p.whitened",
        "p.explained",
        F.lit(error).alias("identity_error"),
        F.col("deviation").alias("deviation_exact"),
    )


QUERIES = {"op13_embedding_whitening": op13_embedding_whitening}
#: Eigenvectors have no SQL form; tests/llm/test_whitening.py holds the query against numpy's and against Python integers.
SQL: dict[str, str] = {}
