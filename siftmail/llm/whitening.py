"""Whitening of vectors: moments by Chan's merging formula, eigenvectors on the driver, a second pass that verifies.

1. Each partition folds its vectors, batch by batch, into (count, sums, mean, centred scatter). Two such moments merge by
   the pairwise formula of Chan, Golub and LeVeque: the scatters add, and so does the outer product of the difference
   of the means, weighted by n_a n_b / (n_a + n_b). ``treeReduce`` merges them; a moment is dims x dims numbers, at any
   number of rows. Sums are whole numbers and exact.
2. ``eigh`` of the covariance runs on the driver: dims x dims, which doesn't grow with the table.
3. A second pass folds the whitened vectors in the same way; the largest entry of their covariance minus the identity
   is the error that ``Whitening`` carries.

Vectors are made of whole numbers z = floor(scale * entry): what the entries are shifted by changes no result here, so
no shift is added. Rows with a null vector, an empty one, or one with null or non-finite entries are dropped. Vectors of
several lengths: the most frequent length counts (of equally frequent ones the longest), others are dropped. Entries
beyond 2^62 count as 2^62. Repeated rows count each. Directions without any variance (all, if there is but one distinct
vector) can't be whitened: ``explained`` is 0 (null if nothing varies), ``whitened`` is null, and the identity is
checked over the other directions (null if there are none). An empty table gives no rows. Columns other than the id
and the vector are ignored; a null id stays.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LARGEST = 2.0**62


@dataclass
class Moments:
    """Count, exact sums (whole numbers; none for whitened vectors), mean and centred scatter of vectors."""

    n: int
    sums: list[int] | None
    mean: np.ndarray
    scatter: np.ndarray

    @classmethod
    def of(cls, z: np.ndarray, exact: bool) -> Moments:
        n, dims = z.shape
        if not n:
            return cls(0, [0] * dims if exact else None, np.zeros(dims), np.zeros((dims, dims)))
        # a sum of up to 2^31 entries below 2^31 fits; larger ones are summed as Python's whole numbers
        small = not exact or np.abs(z).max(initial=0) < 1 << 31
        sums = [int(x) for x in (z.sum(0) if small else z.astype(object).sum(0))] if exact else None
        mean = np.array([x / n for x in sums]) if exact else z.mean(0)
        away = z - mean
        return cls(n, sums, mean, away.T @ away)

    def merge(self, other: Moments) -> Moments:
        if not (self.n and other.n):
            return self if self.n else other
        n = self.n + other.n
        apart = other.mean - self.mean
        sums = None if self.sums is None or other.sums is None else [a + b for a, b in zip(self.sums, other.sums, strict=True)]
        mean = self.mean + apart * (other.n / n) if sums is None else np.array([x / n for x in sums])
        return Moments(n, sums, mean, self.scatter + other.scatter + np.outer(apart, apart) * (self.n * other.n / n))


@dataclass
class Whitening:
    """What was fitted: count, exact sums and mean of z; unit eigenvectors (columns) and eigenvalues, largest first; the
    share of each in the whole variance; the error of the second pass."""

    n: int
    sums: list[int]
    mean: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    live: np.ndarray
    identity_error: float | None = None

    def project(self, z: np.ndarray) -> np.ndarray:
        """Whitened vectors; directions without variance come out as not a number."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return ((z - self.mean) @ self.vectors) / np.where(self.live, np.sqrt(np.maximum(self.values, 0)), np.nan)

    def deviations(self, z: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n*z - S)^2, exact; null beyond 64 bits."""
        if not len(z):
            return []
        reach = self.n * int(np.abs(z).max(initial=0)) + max(map(abs, self.sums), default=0)
        if len(self.sums) * reach * reach < 1 << 63:
            return ((self.n * z - np.array(self.sums, np.int64)) ** 2).sum(1).tolist()
        d = z.astype(object) * self.n - np.array(self.sums, object)
        return [x if x < 1 << 63 else None for x in (d * d).sum(1).tolist()]


def whole(vectors: pa.Array, dims: int, scale: float) -> np.ndarray:
    """floor(scale * entry) of vectors that all have ``dims`` entries."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    return np.clip(np.floor(scale * flat), -LARGEST, LARGEST).astype(np.int64)


def usable(df: DataFrame, vector_col: str, id_col: str) -> DataFrame:
    """vec_id and vector of the rows that take part, whatever their length."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.select(F.col(id_col).alias("vec_id"), v.alias("vector")).where(F.col("vector").isNotNull() & (F.size(v) > 0) & ~bad)


def length_of(vectors: DataFrame) -> int:
    """The most frequent length, 0 without rows."""
    best = vectors.groupBy(F.size("vector").alias("dims")).count().agg(F.max(F.struct("count", "dims")).alias("b")).first()
    return best["b"]["dims"] if best and best["b"] else 0


def moments(vectors: DataFrame, dims: int, make: Callable[[pa.Array], np.ndarray], exact: bool, depth: int = 2) -> Moments:
    """The moments of ``make`` of all vectors: one a partition, merged in a tree."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Moments.of(np.zeros((0, dims), np.int64 if exact else np.float64), exact)
        for batch in batches:
            state = state.merge(Moments.of(make(batch.column(0)), exact))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(state)], pa.binary())], ["state"])

    states = vectors.select("vector").mapInArrow(fold, "state binary").rdd
    if not states.getNumPartitions():
        return Moments.of(np.zeros((0, dims), np.int64), exact)
    return states.map(lambda r: pickle.loads(r["state"])).treeReduce(Moments.merge, depth)


def _seen(m: Moments, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    values, vectors = np.linalg.eigh(m.scatter / m.n)
    values, vectors = values[::-1].copy(), vectors[:, ::-1].copy()
    trace = float(np.trace(m.scatter)) / m.n
    live = values > dims * np.finfo(float).eps * max(values[0], 0) if trace > 0 else np.zeros(dims, bool)
    explained = np.where(live, values, 0) / trace if trace > 0 else np.full(dims, np.nan)
    return values, vectors, explained, live


def fit(vectors: DataFrame, dims: int, *, components: int, scale: float) -> Whitening | None:
    """The whitening of ``vectors`` (vec_id, vector of ``dims`` entries), checked in a second pass; None without rows."""
    m = moments(vectors, dims, lambda v: whole(v, dims, scale), exact=True) if dims else None
    if m is None or not m.n:
        return None
    values, own, explained, live = _seen(m, dims)
    k = min(components, dims)
    w = Whitening(m.n, m.sums, m.mean, own[:, :k], values[:k], explained[:k], live[:k])
    n_live = int(w.live.sum())
    if n_live:
        sent = vectors.sparkSession.sparkContext.broadcast(w)  # dims x components numbers
        again = moments(vectors, n_live, lambda v: sent.value.project(whole(v, dims, scale))[:, :n_live], exact=False)
        w.identity_error = float(np.abs(again.scatter / again.n - np.eye(n_live)).max())
    return w


WHITENED = pa.schema([
    ("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()),
    ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64()),
])
_COLUMNS = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(df: DataFrame, *, components: int = 32, scale: float = 64.0, vector_col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """One row for each usable vector and component: vec_id, component (from 1), n, deviation, whitened, explained,
    identity_error."""
    spark = df.sparkSession
    all_lengths = usable(df, vector_col, id_col)
    dims = length_of(all_lengths)
    vectors = all_lengths.where(F.size("vector") == dims)
    w = fit(vectors, dims, components=components, scale=scale)
    if w is None:
        return spark.createDataFrame([], _COLUMNS)
    sent = spark.sparkContext.broadcast(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, k = sent.value, len(sent.value.values)
        # not a number stands for what has no value
        none = lambda x: pa.array(x, from_pandas=True)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                z, n = whole(part.column(1), dims, scale), part.num_rows
                row = np.repeat(np.arange(n), k)
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(row)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(np.full(n * k, w.n, np.int64)),
                    pa.array(w.deviations(z), pa.int64()).take(pa.array(row)), none(w.project(z).reshape(-1)), none(np.tile(w.explained, n)),
                    pa.array([w.identity_error], pa.float64()).take(pa.array(np.zeros(n * k, np.int64))),
                ], schema=WHITENED)

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "vector").mapInArrow(run, _COLUMNS)
