"""Operator 13: whitening of embeddings.

Method: every partition takes its vectors one by one into a Welford state (count, mean, sums of
centred products, each new vector by a rank-one update); states merge by the parallel update
formula, 32 a task, until one is left; its covariance is solved by symmetric QR (Householder
tridiagonal form, implicit shifts). Only this one state, d x d numbers for vectors of d
entries, reaches the driver. A state counts from its own first vector, so that a common large
offset costs no digits.

Defined results: vectors that are null or hold null, NaN or infinite entries have no row, as do
vectors of another length than the commonest one among distinct vectors (of equally common
ones the longest) and vectors without entries. Repeated vectors count once in the fit and keep
all their rows; a null vec_id stays null; an empty table, or one without a valid vector, gives
no row. Directions without variance (rank-deficient data, a single vector) are whitened to 0
and don't count in the identity error. Other columns are not read. Tied eigenvalues give any
orthonormal basis of their space, the same for all rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsflow.llm.shared import arrow_rows, scratch_table

MERGED_TOGETHER = 32
#: Rows of an Arrow batch that holds states, and of one that holds vectors.
STATES, VECTORS = 4, 2048


@dataclass
class Moments:
    """What Welford's update keeps of vectors; mean is relative to origin. sums are exact integers, or None for vectors of other numbers."""

    n: int
    sums: np.ndarray | None
    origin: np.ndarray
    mean: np.ndarray
    products: np.ndarray

    @staticmethod
    def start(vector: np.ndarray) -> Moments:
        d = len(vector)
        return Moments(0, np.zeros(d, object) if vector.dtype.kind == "i" else None, vector.copy(), np.zeros(d), np.zeros((d, d)))

    def add(self, block: np.ndarray) -> None:
        """One rank-one update for each row."""
        if self.sums is not None:
            small = float(np.abs(block.astype(float)).max(initial=0)) * max(1, len(block)) < 2**62
            self.sums = self.sums + block.sum(axis=0, dtype=np.int64 if small else object)
        room = np.empty_like(self.products)
        for row in (block - self.origin).astype(float):
            delta = row - self.mean
            self.n += 1
            self.mean += delta / self.n
            np.multiply(delta[:, None], delta * ((self.n - 1) / self.n), out=room)
            self.products += room

    def merge(self, other: Moments) -> Moments:
        """The parallel update formula."""
        n = self.n + other.n
        delta = (other.origin - self.origin).astype(float) + (other.mean - self.mean)
        products = self.products + other.products + np.multiply.outer(delta, delta * (self.n * other.n / n))
        return Moments(n, None if self.sums is None else self.sums + other.sums, self.origin, self.mean + delta * (other.n / n), products)


def symmetric_qr(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and its unit eigenvectors as rows."""
    a, n = np.array(matrix, float), len(matrix)
    basis = np.eye(n)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        if not np.abs(v[1:]).max(initial=0):
            continue
        v /= np.abs(v).max()
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        v /= np.linalg.norm(v)
        a[k + 1 :, k:] -= 2 * np.outer(v, v @ a[k + 1 :, k:])
        a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ v, v)
        basis[k + 1 :] -= 2 * np.outer(v, v @ basis[k + 1 :])
    d, e = np.diag(a).copy(), np.diag(a, -1).copy()
    tiny, low, rounds = np.finfo(float).eps, 0, 0
    high = n - 1
    while high > 0:
        small = np.abs(e[:high]) <= tiny * (np.abs(d[:high]) + np.abs(d[1 : high + 1]))
        e[:high][small] = 0
        if small[high - 1]:
            high, rounds = high - 1, 0
            continue
        low = int(np.flatnonzero(small)[-1]) + 1 if small.any() else 0
        rounds += 1
        if rounds > 100:
            raise ArithmeticError("the eigenvalues did not converge")
        half = (d[high - 1] - d[high]) / 2
        shift = d[high] - e[high - 1] ** 2 / (half + np.copysign(np.hypot(half, e[high - 1]), half))
        x, z = d[low] - shift, e[low]
        for k in range(low, high):
            r = np.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > low:
                e[k - 1] = r
            p, q, f = d[k], d[k + 1], e[k]
            d[k], d[k + 1] = c * c * p + 2 * c * s * f + s * s * q, s * s * p - 2 * c * s * f + c * c * q
            e[k] = c * s * (q - p) + (c * c - s * s) * f
            if k < high - 1:
                x, z, e[k + 1] = e[k], s * e[k + 1], c * e[k + 1]
            basis[k], basis[k + 1] = c * basis[k] + s * basis[k + 1], c * basis[k + 1] - s * basis[k]
    order = np.argsort(-d, kind="stable")
    return d[order], basis[order]


def _block(column: pa.Array) -> np.ndarray:
    """Rows of an Arrow list column, all of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _states(batches: Iterator[pa.RecordBatch], prepare) -> Iterator[pa.RecordBatch]:
    state = None
    for batch in batches:
        if batch.num_rows:
            block = prepare(_block(batch.column(0)))
            state = state or Moments.start(block[0])
            state.add(block)
    if state is not None:
        yield _state_batch(TaskContext.get().partitionId(), state)


def _state_batch(number: int, state: Moments) -> pa.RecordBatch:
    return pa.record_batch([pa.array([number], pa.int64()), pa.array([pickle.dumps(state)], pa.binary())], names=["number", "state"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    states = (pickle.loads(v.as_py()) for batch in batches for v in batch.column(1))
    state = reduce(Moments.merge, states, None or next(states, None))
    if state is not None:
        yield _state_batch(TaskContext.get().partitionId(), state)


def _same(block: np.ndarray) -> np.ndarray:
    return block


def moments(vectors: DataFrame, column: str, prepare=_same) -> Moments | None:
    """The merged state of all vectors (arrays of one length, without nulls); None if there are none. prepare changes blocks of rows before."""
    spark = vectors.sparkSession
    with arrow_rows(spark, VECTORS):
        states = scratch_table(vectors.select(column).mapInArrow(partial(_states, prepare=prepare), "number long, state binary"), "states")
        n = states.count()
    with arrow_rows(spark, STATES):
        while n > 1:
            n = -(-n // MERGED_TOGETHER)
            states = states.repartitionByRange(n, "number") if n > 1 else states.coalesce(1)
            states = scratch_table(states.mapInArrow(_merged, "number long, state binary"), "states")
            n = min(n, states.count())
        row = states.first()
    return None if row is None else pickle.loads(row.state)


def valid(vectors: DataFrame, column: str) -> DataFrame:
    """Rows whose vector is there and holds finite numbers only."""
    fine = F.forall(column, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    return vectors.where(F.coalesce(fine & (F.size(column) > 0), F.lit(False)))


@dataclass
class Whitening:
    """A fit: count, sums or mean, the leading unit components as rows, all eigenvalues, and how far the whitened covariance of the fitted vectors is from the identity."""

    n: int
    sums: np.ndarray | None
    mean: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float = 0.0

    def deviations(self, block: np.ndarray) -> np.ndarray:
        """n x - S for integers, in exact arithmetic; else x - mean."""
        if self.sums is None:
            return block - self.mean
        reach = max(float(np.abs(block.astype(float)).max(initial=0)) * self.n, max(map(abs, self.sums.tolist()), default=0))
        kind = np.int64 if reach < 2**61 else object
        return block.astype(kind) * self.n - self.sums.astype(kind)

    def whitened(self, block: np.ndarray) -> np.ndarray:
        centred = self.deviations(block)
        centred = (centred / self.n).astype(float) if self.sums is not None else centred
        solid = self.solid()
        return centred @ self.components.T * np.where(solid, 1 / np.sqrt(np.where(solid, self.values[: len(solid)], 1)), 0)

    def solid(self) -> np.ndarray:
        """Which components have variance at all."""
        k = len(self.components)
        return self.values[:k] > max(self.trace, 0) * np.finfo(float).eps * 8 * self.components.shape[1]


def fit(vectors: DataFrame, column: str, components: int) -> Whitening | None:
    """Fit distinct vectors of one length, see valid. None if there are none."""
    state = moments(vectors, column)
    if state is None:
        return None
    values, basis = symmetric_qr(state.products / state.n)
    k = min(components, len(values))
    out = Whitening(state.n, state.sums, state.origin + state.mean, basis[:k], values, float(np.trace(state.products) / state.n))
    check = moments(vectors, column, out.whitened)
    off = np.abs(check.products / check.n - np.eye(k))[np.ix_(out.solid(), out.solid())]
    out.identity_error = float(off.max(initial=0))
    return out


WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _projected(batches: Iterator[pa.RecordBatch], model: Whitening) -> Iterator[pa.RecordBatch]:
    k = len(model.components)
    explained = model.values[:k] / model.trace if model.trace > 0 else np.zeros(k)
    for batch in batches:
        if not batch.num_rows:
            continue
        block, ids = _block(batch.column(1)), batch.column(0)
        off = model.deviations(block)
        if off.dtype == np.int64 and float(np.abs(off).max(initial=0)) ** 2 * off.shape[1] >= 2**62:
            off = off.astype(object)
        squares = (off * off).sum(axis=1).tolist()
        deviation = pa.array([x if isinstance(x, int) and x < 2**63 else None for x in squares], pa.int64())
        m, each = len(block), np.repeat(np.arange(len(block)), k)
        yield pa.record_batch(
            [
                ids.take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, model.n), pa.int64()), deviation.take(pa.array(each)),
                pa.array(model.whitened(block).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, model.identity_error)),
            ],
            names=[c.split()[0] for c in WHITENED.split(", ")],
        )


def whiten(vectors: DataFrame, column: str = "vector", components: int = 16) -> DataFrame:
    """vectors(vec_id, column) -> for each row and leading component its whitened coordinate.

    The array holds longs, which are summed exactly, or doubles. n counts the distinct vectors
    of the fit; deviation is the squared norm of n x - S (null for doubles, and where a long
    can't hold it); explained is the component's share of all variance.
    """
    spark = vectors.sparkSession
    rows = valid(vectors.select("vec_id", column), column)
    distinct = scratch_table(rows.select(column).distinct(), "distinct")
    common = distinct.groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if common is None:
        return spark.createDataFrame([], WHITENED)
    same = F.size(column) == common.d
    model = fit(distinct.where(same), column, components)
    return rows.where(same).mapInArrow(partial(_projected, model=model), WHITENED)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors of embeddings on the lattice of the contract, whitened by up to 16 components."""
    scaled = lambda c: F.floor(F.least(F.greatest(c.cast("double") * 64, F.lit(-4e18)), F.lit(4e18))) + 1_000_000  # noqa: E731  beyond 4e18 a long would overflow
    rows = valid(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), "embedding")
    return whiten(rows.select("vec_id", F.transform("embedding", scaled).alias("vector")))
