"""Whitening of embeddings held as whole numbers.

The fit list is each distinct vector once. Its sums are exact; its centred scatter is added up in matrices of one task each, which
are then summed by row. The scatter goes through a Cholesky factorisation with pivots, and one-sided Jacobi rotations make the
factor's columns orthogonal: their squared lengths are the scatter's eigenvalues, and the columns at length 1 its eigenvectors.
The scatter is never diagonalised itself. Both run on the driver, on a matrix of the vectors' dimension squared, whatever the rows.

Defined results: vectors that are null, hold null or non-finite entries or one of 2^54 or more in size (which has no whole-number
form here), or are of another length than most (of two equally frequent lengths the greater counts) take no part. Repeated rows
count once in the fit and are each returned; rows without vec_id are returned without it. A component without variance doesn't
exist, so a fit list of one vector, or an empty table, gives no rows. Components of equal variance are any basis of their space,
the same for all rows. A deviation that doesn't fit 64 bits is null. Further columns are not read, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.llm.storage import drop, materialize

SCALE = 256
LIMIT = float(1 << 54)
COMPONENTS = 4
OUTPUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """(vec_id, x): floor(256 * entry) of every vector that takes part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("c"))
    rows = rows.where(F.coalesce(F.forall("c", lambda x: x.isNotNull() & (F.abs(x) < LIMIT)), F.lit(False)))
    most = rows.groupBy(F.size("c").alias("d")).count().orderBy(F.col("count").desc(), F.col("d").desc()).limit(1)
    found = most.first()
    dim = found["d"] if found else 0
    return rows.where(F.size("c") == dim).select("vec_id", F.transform("c", lambda x: F.floor(x * SCALE)).alias("x"))


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """L with ``a`` = L Lᵀ, lower triangular up to the order of its rows; as many columns as ``a`` has rank."""
    d = len(a)
    left, order, factor = a.diagonal().copy(), np.arange(d), np.zeros((d, d))
    least = d * np.finfo(float).eps * left.max(initial=0.0)
    for k in range(d):
        p = k + int(np.argmax(left[order[k:]]))
        if left[order[p]] <= least:
            return factor[:, :k]
        order[[k, p]] = order[[p, k]]
        i, rest = order[k], order[k + 1 :]
        factor[i, k] = np.sqrt(left[i])
        factor[rest, k] = (a[rest, i] - factor[rest, :k] @ factor[i, :k]) / factor[i, k]
        left[rest] -= factor[rest, k] ** 2
    return factor


def _rounds(r: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Every pair of ``r`` columns once, in rounds of pairs that share no column."""
    seats = list(range(r + r % 2))
    half, out = len(seats) // 2, []
    for _ in range(len(seats) - 1):
        pairs = [(i, j) for i, j in zip(seats[:half], seats[:half - 1 : -1], strict=True) if max(i, j) < r]
        out.append(tuple(np.array(side, int) for side in zip(*pairs, strict=True)) if pairs else (np.zeros(0, int),) * 2)
        seats = [seats[0], seats[-1], *seats[1:-1]]
    return out


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(squared lengths, directions) of ``factor``'s columns once rotations have made them orthogonal, the longest first."""
    g, rounds = factor.copy(), _rounds(factor.shape[1])
    for _ in range(sweeps):
        worst = 0.0
        for i, j in rounds:
            a, b, c = (g[:, i] ** 2).sum(0), (g[:, j] ** 2).sum(0), (g[:, i] * g[:, j]).sum(0)
            size = np.sqrt(a * b)
            cosine = np.abs(c) / np.where(size > 0, size, 1)
            worst = max(worst, cosine.max(initial=0.0))
            turn = cosine > 1e-16
            i, j, c = i[turn], j[turn], c[turn]
            zeta = (b[turn] - a[turn]) / (2 * c)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            cos = 1 / np.hypot(1.0, t)
            x, y = g[:, i], g[:, j]
            g[:, i], g[:, j] = cos * (x - t * y), cos * (y + t * x)
        if worst < 1e-14:
            break
    else:
        raise ArithmeticError("rotations didn't settle")
    values = (g**2).sum(0)
    order = np.argsort(-values, kind="stable")
    return values[order], g[:, order] / np.sqrt(values[order])


@dataclass
class Whitening:
    """A fit: ``n`` vectors, their exact sums, the covariance's eigenvalues (falling), its unit eigenvectors as columns, its trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    offset: np.ndarray  # mean of the centred vectors, zero but for rounding

    def shifted(self, x: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Whole numbers less the whole part of the mean, and n times its rest."""
        return x - np.array([s // self.n for s in self.sums], np.int64), [s % self.n for s in self.sums]

    def centred(self, x: np.ndarray) -> np.ndarray:
        whole, rest = self.shifted(x)
        return whole - np.array(rest, float) / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Each row's sum of (n * x - sum)^2, exactly."""
        whole, rest = self.shifted(x)
        size = self.n * (int(np.abs(whole).max(initial=0)) + 1)
        if size * size * max(1, x.shape[1]) < 1 << 63:
            return ((self.n * whole - np.array(rest, np.int64)) ** 2).sum(1).tolist()
        exact = [sum((self.n * v - r) ** 2 for v, r in zip(row, rest, strict=True)) for row in whole.tolist()]
        return [e if e < 1 << 63 else None for e in exact]

    def whitened(self, x: np.ndarray, k: int) -> np.ndarray:
        return self.centred(x) @ (self.vectors[:, :k] / np.sqrt(self.values[:k]))


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _summed(fit: DataFrame, function, size: int) -> np.ndarray:
    """Rows (i, values of ``size``) that ``function`` makes in each task, summed by i."""
    parts = fit.mapInArrow(function, "i int, v array<double>")
    total = parts.groupBy("i").agg(F.array(*[F.sum(F.element_at("v", j + 1)) for j in range(size)]).alias("v"))
    return np.array([r["v"] for r in total.orderBy("i").collect()])


def _outer(values, dim: int):
    """A task's sum of outer products of ``values(batch)``, and of the values themselves in a last column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim + 1))
        for batch in batches:
            c = values(batch)
            total[:, :dim] += c.T @ c
            total[:, dim] += c.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "v"])

    return run


def fit_whitening(fit: DataFrame) -> Whitening | None:
    """The fit of distinct vectors ``x``; none if there is no vector or no variance."""
    found = fit.select(F.size("x").alias("d")).first()
    dim = found["d"] if found else 0
    if not dim:
        return None
    exact = fit.agg(F.count("*").alias("n"), F.array(*[F.sum(F.element_at("x", j + 1).cast("decimal(20,0)")) for j in range(dim)]).alias("sums")).first()
    start = Whitening(exact["n"], [int(s) for s in exact["sums"]], np.zeros(0), np.zeros((dim, 0)), 0.0, np.zeros(dim))
    scatter = _summed(fit, _outer(lambda batch: start.centred(_matrix(batch.column(0), dim)), dim), dim + 1)
    covariance = (scatter[:, :dim] + scatter[:, :dim].T) / 2
    values, vectors = one_sided_jacobi(pivoted_cholesky(covariance))
    if not len(values):
        return None
    return Whitening(start.n, start.sums, values / start.n, vectors, float(covariance.trace()) / start.n, scatter[:, dim] / start.n)


def identity_error(fit: DataFrame, model: Whitening, k: int) -> float:
    """The greatest entry of the whitened fit list's covariance less the identity, from the list itself."""
    dim = len(model.sums)
    mean = model.offset @ (model.vectors[:, :k] / np.sqrt(model.values[:k]))
    total = _summed(fit, _outer(lambda batch: model.whitened(_matrix(batch.column(0), dim), k) - mean, k), k)
    return float(np.abs(total / model.n - np.eye(k)).max())


def _rows(model: Whitening, k: int, error: float):
    share = model.values[:k] / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), len(model.sums))
            ids = pa.array(batch.column("vec_id"))
            times = pa.array(np.repeat(np.arange(len(x)), k))
            columns = [ids.take(times), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * k, model.n))]
            columns += [pa.array(model.deviations(x), pa.int64()).take(times), pa.array(model.whitened(x, k).ravel()), pa.array(np.tile(share, len(x))), pa.array(np.full(len(x) * k, error))]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in OUTPUT.split(", ")])

    return run


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Each vector's first whitened components with the fit's figures; see the module for what takes part."""
    spark, x = vectors.sparkSession, whole_numbers(vectors)
    fit = materialize(x.select("x").distinct(), "distinct-vectors")
    model = fit_whitening(fit)
    if model is None:
        drop(fit)
        return spark.createDataFrame([], OUTPUT)
    k = min(components, len(model.values))
    error = identity_error(fit, model, k)
    drop(fit)
    return x.mapInArrow(_rows(model, k, error), OUTPUT)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four whitened components of every embedding."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
