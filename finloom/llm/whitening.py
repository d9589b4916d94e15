"""Whitening of embedding vectors along their leading principal components.

Entries become integers, so sums over the distinct vectors are exact. Centred
products are added up by Spark in a tree of blocks; the driver holds one
covariance matrix. Its eigenvectors come from a float32 solver and are
corrected by matrix-multiplication iterations in float64 (Ogita and Aishima);
eigenvalues that lie too close together for the correction get a small
eigenproblem of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finloom.session import materialise

#: Blocks that one task of the adding tree brings together.
FAN_IN = 64
BLOCK = "part long, block binary"


def correction(v: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One Ogita-Aishima step: eigenvalues by ``x``, the corrected vectors, and which pairs of eigenvalues are told apart."""
    r = np.eye(len(v)) - x.T @ x
    s = x.T @ (v @ x)
    s = (s + s.T) / 2  # an asymmetry of rounding, over a small gap, would cost orthogonality
    e = np.diag(s) / (1 - np.diag(r))
    off = s - np.diag(e)
    resolution = 2 * (np.linalg.norm(off, 2) + np.linalg.norm(v, 2) * np.linalg.norm(r, 2))
    gap = e[None, :] - e[:, None]
    apart = np.abs(gap) > resolution
    step = np.where(apart, (s + e[None, :] * r) / np.where(apart, gap, 1), r / 2)
    return e, x + x @ step, apart


def _clusters(e: np.ndarray, apart: np.ndarray) -> list[np.ndarray]:
    """Runs of eigenvalues, in order, whose neighbours are not told apart."""
    order = np.argsort(e)
    edge = [i for i in range(1, len(e)) if apart[order[i - 1], order[i]]]
    return [c for c in np.split(order, edge) if len(c) > 1]


def refined_eigen(v: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors of the symmetric ``v`` to double precision, from a float32 start."""
    scale = np.abs(v).max(initial=0.0)
    if not scale:
        return np.zeros(len(v)), np.eye(len(v))
    a = (v + v.T) / (2 * scale)
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.float64)
    limit = 4 * len(a) * np.finfo(float).eps
    for _ in range(rounds):
        e, y, apart = correction(a, x)
        moved = np.abs(y - x).max()
        x = y
        for own in _clusters(e, apart):
            # within a cluster only its own small problem, shifted and scaled to full float32 precision, tells directions apart
            inner = x[:, own].T @ (a @ x[:, own]) - e[own].mean() * (x[:, own].T @ x[:, own])
            size = np.abs(inner - np.diag(np.diag(inner))).max()
            if size > limit:
                turn = np.linalg.eigh(((inner + inner.T) / (2 * np.abs(inner).max())).astype(np.float32))[1].astype(np.float64)
                x[:, own] = x[:, own] @ turn
                moved = max(moved, size)
        if moved <= limit:
            break
    for _ in range(2):  # back to orthonormal within rounding
        x = x + x @ ((np.eye(len(a)) - x.T @ x) / 2)
    e = np.einsum("ij,ij->j", x, a @ x) / np.einsum("ij,ij->j", x, x)
    order = np.argsort(-e, kind="stable")
    x = x[:, order]
    return e[order] * scale, x / np.linalg.norm(x, axis=0)


def _added(left: pa.Table) -> pa.Table:
    order = np.argsort(left["part"].to_numpy())
    total = None
    for i in order.tolist():
        block = np.frombuffer(left["block"][i].as_buffer())
        total = block.copy() if total is None else total + block
    return pa.table({"part": pa.array([int(left["part"][0].as_py()) // FAN_IN], pa.int64()), "block": pa.array([total.tobytes()], pa.binary())})


def _sum_of_blocks(blocks: DataFrame) -> np.ndarray | None:
    """The sum of float64 blocks of equal length, one per task, in a fixed order; three levels of the tree, the last holds one block per 4,096 tasks."""
    for _ in range(2):
        blocks = blocks.groupBy(F.expr(f"part div {FAN_IN}")).applyInArrow(_added, BLOCK)
    rows = blocks.orderBy("part").collect()
    total = None
    for r in rows:
        block = np.frombuffer(bytes(r.block))
        total = block.copy() if total is None else total + block
    return total


@dataclass
class Whitening:
    """n fitted vectors with per-dimension ``sums``; unit ``vectors`` by rows, their ``eigenvalues`` (0: no variance), the trace of the covariance."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    vectors: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n * x - S) exactly, as int64 or, where that is too small, as Python integers; and x - S / n."""
        most = max(map(abs, self.sums), default=0) + self.n * int(np.abs(x).max(initial=0))
        kind = np.int64 if most < 1 << 63 else object
        exact = x.astype(kind) * self.n - np.array(self.sums, kind)
        return exact, (exact / self.n).astype(float)

    def projected(self, x: np.ndarray) -> np.ndarray:
        """The components with variance of the whitened rows."""
        some = self.eigenvalues > 0
        return self.centred(x)[1] @ (self.vectors[some] / np.sqrt(self.eigenvalues[some])[:, None]).T


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _products(df: DataFrame, dim: int, function) -> np.ndarray | None:
    """Sum over the rows of ``x`` of function(matrix of x)' function(matrix of x), preceded by the sum of its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, product = None, None
        for batch in batches:
            for first in range(0, batch.num_rows, 4096):
                y = function(_matrix(batch.column(0).slice(first, 4096), dim))
                total = y.sum(0) + (0 if total is None else total)
                product = y.T @ y + (0 if product is None else product)
        if total is not None:
            part = pa.array([TaskContext.get().partitionId()], pa.int64())
            yield pa.RecordBatch.from_arrays([part, pa.array([np.concatenate([total, product.reshape(-1)]).tobytes()], pa.binary())], ["part", "block"])

    return _sum_of_blocks(df.select("x").mapInArrow(run, BLOCK))


def integers(vector: str = "embedding", scale: int = 256) -> Column:
    """floor(scale * c) of every entry as long; null for a vector that is null, empty or holds null or non-finite entries."""
    v = F.col(f"`{vector}`")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.when(v.isNotNull() & (F.size(v) > 0) & ~bad, F.transform(v, lambda c: F.floor(F.lit(float(scale)) * c.cast("double"))))


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """The fit list: each ``x`` once, stored."""
    return materialise(rows.select("x").distinct(), "fitted")


def fit(fitted: DataFrame, components: int = 4) -> Whitening | None:
    """The whitening of distinct vectors ``x`` (array<long>, one length); None without rows.

    An eigenvalue not above the rounding error of the trace counts as 0.
    """
    exact = fitted.select(F.posexplode("x").alias("i", "c")).groupBy("i").agg(F.count("*").alias("n"), F.sum(F.col("c").cast("decimal(38,0)")).alias("s"))
    sums = exact.orderBy("i").collect()
    if not sums:
        return None
    dim, n = len(sums), sums[0].n
    start = Whitening(n, [int(r.s) for r in sums], np.zeros(0), np.zeros((0, dim)), 0.0)
    covariance = _products(fitted, dim, lambda x: start.centred(x)[1])[dim:].reshape(dim, dim) / n
    e, x = refined_eigen(covariance)
    trace = float(np.trace(covariance))
    e = np.where(e > dim * np.finfo(float).eps * trace, e, 0.0)[:components]
    return Whitening(n, start.sums, e, x[:, : len(e)].T.copy(), trace)


def identity_error(whitening: Whitening, fitted: DataFrame) -> float | None:
    """Largest absolute entry of the whitened fit list's covariance minus the identity, over the components with variance; None without any."""
    k = int((whitening.eigenvalues > 0).sum())
    if not k:
        return None
    found = _products(fitted, len(whitening.sums), whitening.projected) / whitening.n
    mean = found[:k]
    return float(np.abs(found[k:].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def whiten(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = 4, scale: int = 256) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every row with a sound vector.

    Vectors that are null, empty or hold null or non-finite entries take no
    part, nor do vectors of another length than the most frequent one (of
    equally frequent ones the longest). Rows without an id stay. Repeated rows
    are returned each for itself, their vector is fitted once. A component
    without variance (any, if there is one distinct vector) explains 0 and its
    ``whitened`` is null; without any variance the error is null too. Entries
    or deviations that no long can hold raise. Extra columns are not returned.
    No rows give no rows. The fit needs memory for a square matrix of the
    vectors' length, on the driver and in each task.
    """
    spark = df.sparkSession
    rows = df.select(F.col(f"`{vec_id}`").alias("vec_id"), integers(vector, scale).alias("x")).where("x IS NOT NULL")
    kind = df.select(F.col(f"`{vec_id}`")).schema[0].dataType.simpleString()
    out = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    length = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if length is None:
        return spark.createDataFrame([], out)
    rows = rows.where(F.size("x") == length.d)
    fitted = distinct_vectors(rows)
    model = fit(fitted, components)
    error, dim, k = identity_error(model, fitted), length.d, len(model.eigenvalues)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        some = own.eigenvalues > 0
        explained = own.eigenvalues / (own.trace or 1)
        for whole in batches:
            for first in range(0, whole.num_rows, 4096):
                batch = whole.slice(first, 4096)
                x = _matrix(batch.column(1), dim)
                exact = own.centred(x)[0]
                if float(np.abs(exact).max(initial=0)) ** 2 * dim >= 2**62:
                    exact = exact.astype(object)
                deviation = pa.array((exact**2).sum(1).tolist(), pa.int64())
                whitened = np.full((len(x), k), np.nan)
                whitened[:, some] = own.projected(x)
                of_row = pa.array(np.repeat(np.arange(len(x)), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(of_row), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(len(x) * k, own.n)), deviation.take(of_row), pa.array(whitened.reshape(-1), from_pandas=True),
                        pa.array(np.tile(explained, len(x))), pa.array([error] * (len(x) * k), pa.float64()),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, out)
