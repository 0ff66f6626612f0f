"""Whitening of embeddings by streamed covariances and a symmetric QR eigen-solve.

A component c of a vector becomes the whole number floor(256 * c), c as double. The fit list holds each distinct vector of such numbers once. Each partition runs over its
part of the list and updates count, mean and scatter matrix by one vector at a time (Welford); the partitions' states are merged by the formula for two parts in
two levels of tasks, so one state of d * d numbers reaches the driver, whatever the number of rows or partitions. There the
matrix is made tridiagonal by reflections and diagonal by implicitly shifted QR steps. Sums of the numbers are kept exactly beside it.

A second pass over the fit list streams the whitened vectors through the same updates, which gives the error of their covariance against the identity.

Vectors that are null or hold null or non-finite components take no part; without any vector, or without components, the result is empty. Shorter vectors count as if
zeros followed; a number beyond 64 bits becomes the closest long, and so does a deviation. Null and repeated ids are returned like any other. A component without
variance (rank below the number of components asked for) has a null `whitened`; `explained` is null if nothing varies. Equal eigenvalues have any orthonormal
vectors of their space, the same for all rows. Only the id and the vector are read, so other columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import cut

SCALE = 256
MERGERS = 8  #: tasks that merge the partitions' states, before one merges theirs
_LONG = 1 << 63


class Moments:
    """Count, mean and scatter matrix (sums of products of centred components) of vectors of d numbers."""

    def __init__(self, d: int) -> None:
        self.n, self.mean, self.scatter, self._product = 0, np.zeros(d), np.zeros((d, d)), np.empty((d, d))

    def add(self, x: np.ndarray) -> None:
        """One vector more: a rank-one update."""
        self.n += 1
        delta = x - self.mean
        np.multiply.outer(delta, delta * ((self.n - 1) / self.n), out=self._product)
        self.scatter += self._product
        delta /= self.n
        self.mean += delta

    def merge(self, n: int, mean: np.ndarray, scatter: np.ndarray) -> None:
        """The vectors of another part more."""
        if n:
            total, delta = self.n + n, mean - self.mean
            self.scatter += scatter
            self.scatter += np.multiply.outer(delta, delta * (self.n * n / total))
            self.mean += delta * (n / total)
            self.n = total


_STATE = "n long, sums array<string>, mean binary, scatter binary"


def _state(moments: Moments, sums: list[int]) -> pa.RecordBatch:
    columns = [pa.array([moments.n], pa.int64()), pa.array([list(map(str, sums))], pa.list_(pa.string())), *(pa.array([x.tobytes()], pa.binary()) for x in (moments.mean, moments.scatter))]
    return pa.RecordBatch.from_arrays(columns, ["n", "sums", "mean", "scatter"])


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


def _column_sums(x: np.ndarray) -> list[int]:
    safe = len(x) * max(1, int(np.abs(x.astype(float)).max(initial=0))) < 1 << 62
    return x.sum(axis=0).tolist() if safe else x.astype(object).sum(axis=0).tolist()


def moments(vectors: DataFrame, d: int, project: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[Moments, list[int]]:
    """Moments of all vectors (column x, d whole numbers), and the exact sum of each component; or, given a centre and a matrix, moments of (x - centre) @ matrix."""
    width = d if project is None else project[1].shape[1]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sums = Moments(width), [0] * d
        for batch in batches:
            whole = _matrix(batch.column("x"), d)
            sums = [a + b for a, b in zip(sums, _column_sums(whole))] if len(whole) else sums
            for x in whole.astype(float) if project is None else (whole - project[0]) @ project[1]:
                own.add(x)
        yield _state(own, sums)

    def merged(states: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sums = Moments(width), [0] * d
        for batch in states:
            for row in batch.to_pylist():
                own.merge(row["n"], np.frombuffer(row["mean"]), np.frombuffer(row["scatter"]).reshape(width, width))
                sums = [a + int(b) for a, b in zip(sums, row["sums"])]
        yield _state(own, sums)

    states = vectors.select("x").mapInArrow(scan, _STATE).repartition(MERGERS).mapInArrow(merged, _STATE)
    last = states.repartition(1).mapInArrow(merged, _STATE).first()
    total = Moments(width)
    total.merge(last.n, np.frombuffer(bytes(last.mean)), np.frombuffer(bytes(last.scatter)).reshape(width, width))
    return total, list(map(int, last.sums))


def _tridiagonal(a: np.ndarray) -> tuple[list[float], list[float], np.ndarray]:
    """Diagonal and subdiagonal of q @ a @ q.T, and the orthogonal q, by Householder reflections."""
    a, n = a.copy(), len(a)
    q, off = np.eye(n), [0.0] * max(0, n - 1)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        off[k] = -math.copysign(float(np.linalg.norm(v)), v[0])
        v[0] -= off[k]
        length = float(np.linalg.norm(v))
        if length:
            v /= length
            rest = a[k + 1 :, k + 1 :]
            p = rest @ v
            w = 2 * (p - (v @ p) * v)
            rest -= np.multiply.outer(v, w) + np.multiply.outer(w, v)
            q[k + 1 :] -= 2 * np.multiply.outer(v, v @ q[k + 1 :])
    if n > 1:
        off[n - 2] = float(a[n - 1, n - 2])
    return np.diag(a).tolist(), off, q


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and its unit eigenvectors as rows, by QR steps with Wilkinson's shift."""
    d, e, z = _tridiagonal((a + a.T) / 2)
    tiny, hi = np.finfo(float).eps, len(d) - 1
    while hi > 0:
        for k in range(hi):
            if abs(e[k]) <= tiny * (abs(d[k]) + abs(d[k + 1])) or abs(e[k]) < 1e-300:
                e[k] = 0.0
        if not e[hi - 1]:
            hi -= 1
            continue
        lo = hi - 1
        while lo and e[lo - 1]:
            lo -= 1
        half = (d[hi - 1] - d[hi]) / 2
        shift = d[hi] - e[hi - 1] * (e[hi - 1] / (half + math.copysign(math.hypot(half, e[hi - 1]), half)))
        x, y = d[lo] - shift, e[lo]
        for k in range(lo, hi):  # each rotation moves what is beside the three diagonals one place down
            r = math.hypot(x, y)
            c, s = (x / r, y / r) if r else (1.0, 0.0)
            if k > lo:
                e[k - 1] = r
            p, t, f = d[k], d[k + 1], e[k]
            d[k], d[k + 1] = c * c * p + 2 * c * s * f + s * s * t, s * s * p - 2 * c * s * f + c * c * t
            e[k] = c * s * (t - p) + (c * c - s * s) * f
            if k + 1 < hi:
                x, y, e[k + 1] = e[k], s * e[k + 1], c * e[k + 1]
            z[k], z[k + 1] = c * z[k] + s * z[k + 1], c * z[k + 1] - s * z[k]
    order = np.argsort([-x for x in d], kind="stable")
    return np.array(d)[order], z[order]


def _deviations(whole: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """The sum over components of (n * x - sum)^2, exactly."""
    most = max(map(abs, sums), default=0) + n * int(np.abs(whole.astype(float)).max(initial=0))
    kind = np.int64 if most * most * max(1, len(sums)) < 1 << 62 else object
    apart = whole.astype(kind) * n - np.array(sums, kind)
    return [min(x, _LONG - 1) for x in (apart * apart).sum(axis=1).tolist()]


def whole_numbers(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The key and the whole numbers x of each vector that takes part."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    rows = rows.select(F.col(key).alias("vec_id"), F.col(vector).cast("array<double>").alias("x"))
    return rows.where(F.col("x").isNotNull() & F.forall("x", finite)).withColumn("x", F.transform("x", lambda c: F.floor(c * SCALE)))


def whiten(vectors: DataFrame, components: int = 4, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row for each vector and component: vec_id, component, n, deviation, whitened, explained and identity_error."""
    rows = whole_numbers(vectors, key, vector)
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    d = rows.agg(F.coalesce(F.max(F.size("x")), F.lit(0))).first()[0]
    if not d:
        return vectors.sparkSession.createDataFrame([], schema)
    rows = rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(d) - F.size("x"))))
    fit = cut(rows.select("x").distinct(), "fit")
    total, sums = moments(fit, d)
    n, centre = total.n, np.array([s / total.n for s in sums])
    values, directions = symmetric_qr(total.scatter / n)
    k = min(components, d)
    values, trace = values[:k], float(np.trace(total.scatter)) / n
    some = values > max(float(values[0]), 0.0) * d * np.finfo(float).eps
    whitener = (directions[:k] / np.sqrt(np.where(some, values, 1.0))[:, None]).T
    error = None
    if some.any():
        checked, _ = moments(fit, d, (centre, whitener[:, some]))
        error = float(np.abs(checked.scatter / n - np.eye(int(some.sum()))).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = _matrix(batch.column("x"), d)
            m = len(whole)
            each = np.repeat(np.arange(m), k)
            columns = [
                batch.column("vec_id").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                pa.array(_deviations(whole, n, sums), pa.int64()).take(pa.array(each)), pa.array(((whole - centre) @ whitener).ravel(), mask=np.tile(~some, m)),
                pa.array(np.tile(values / trace, m) if trace else [None] * (m * k), pa.float64()), pa.array([error] * (m * k), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
