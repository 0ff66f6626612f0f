"""Routing by logistic heads, cross-validated, fitted on all rows by passes that only sum.

A head says for one expert how likely it is right for an item's features. Features are standardised by the rows that a head learns from. Heads of all benchmarks, folds, decays and experts are
fitted side by side by Newton steps on a table of features that is written once: the first step needs the Gram matrices of the features, which also give mean and scale; each later step is
a pass that sums gradients and Hessians in Arrow batches. Tasks' sums are of fixed size and meet in a few tasks before they reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import written

MERGERS = 8  #: tasks that add up the others' sums
STEPS = 6  #: Newton steps, the first of which comes with the Gram matrices

Mask = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
"""Which rows, by benchmark, fold and inner fold, a set of heads learns from."""


def _sums(rows: DataFrame, of: Callable[..., np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """The sum over all batches of an array of the given shape that of() makes of features, truth, benchmark, fold and inner fold."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                wide = [np.array(batch.column(c).flatten().to_numpy(zero_copy_only=False), float).reshape(batch.num_rows, -1) for c in ("x", "y")]
                part = of(*wide, *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("bench", "fold", "inner")))
                total = part if total is None else np.add(total, part, out=total)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()] if total is not None else [], pa.binary())], ["v"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for v in batch.column("v"):
                total = np.frombuffer(v.as_buffer()).copy() if total is None else np.add(total, np.frombuffer(v.as_buffer()), out=total)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()] if total is not None else [], pa.binary())], ["v"])

    parts = rows.select("x", "y", "bench", "fold", "inner").mapInArrow(partial, "v binary").repartition(MERGERS).mapInArrow(added, "v binary")
    found = parts.coalesce(1).mapInArrow(added, "v binary").first()
    return np.frombuffer(bytes(found.v)).reshape(shape) if found else np.zeros(shape)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _bordered(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.hstack(((x - mean) / scale, np.ones((len(x), 1))))


def fit_heads(rows: DataFrame, d: int, experts: int, masks: Sequence[Mask], decays: Sequence[float], steps: int = STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights (mask, feature and 1, expert) of logistic heads, and each mask's mean and scale. decays: the L2 penalty of each mask."""
    m, size = len(masks), d + 1

    def gram(x, y, bench, fold, inner):
        out = np.zeros((m, size, size + experts))
        for k, f in enumerate(masks):
            u = f(bench, fold, inner)
            b = np.hstack((x[u], np.ones((int(u.sum()), 1))))
            out[k] = b.T @ np.hstack((b, y[u] - 0.5))
        return out

    first = _sums(rows, gram, (m, size, size + experts))
    n = np.maximum(first[:, d, d], 1)
    mean = first[:, d, :d] / n[:, None]
    scale = np.sqrt(np.maximum(np.diagonal(first[:, :d, :d], axis1=1, axis2=2) / n[:, None] - mean**2, 0)) + 1e-6
    turn = np.zeros((m, size, size))  # (x, 1) @ turn is standardised
    turn[:, range(d), range(d)] = 1 / scale
    turn[:, d, :d], turn[:, d, d] = -mean / scale, 1
    penalty = np.eye(size) * np.array(decays)[:, None, None]
    penalty[:, d, d] = 1e-9  # the intercept is free
    straight = turn.transpose(0, 2, 1) @ first[:, :, :size] @ turn / (4 * n[:, None, None])
    w = np.linalg.solve(straight + penalty, turn.transpose(0, 2, 1) @ first[:, :, size:] / n[:, None, None])

    for _ in range(steps - 1):

        def slopes(x, y, bench, fold, inner, w=w):
            out = np.zeros((m, experts, size, size + 1))
            for k, f in enumerate(masks):
                u = f(bench, fold, inner)
                b = _bordered(x[u], mean[k], scale[k])
                p = _sigmoid(b @ w[k])
                for e in range(experts):
                    out[k, e, :, :size] = b.T @ (b * (p[:, e] * (1 - p[:, e]))[:, None])
                    out[k, e, :, size] = b.T @ (p[:, e] - y[u, e])
            return out

        found = _sums(rows, slopes, (m, experts, size, size + 1)) / n[:, None, None, None]
        down = found[..., size] + np.einsum("kij,kje->kei", penalty, w)
        w = w - np.linalg.solve(found[..., :size] + penalty[:, None], down[..., None])[..., 0].transpose(0, 2, 1)
    return w, mean, scale


def route_cv(rows: DataFrame, folds: int = 5, inner: int = 5, decays: Sequence[float] = (1e-4, 1e-3, 1e-2), pooled_decay: float = 1e-3, steps: int = STEPS, most: int = 64) -> DataFrame:
    """id, bench, fold, route and pooled of every row: the expert whose head, fitted without the row's fold, is the most sure, the first of equals; by heads of the row's benchmark, and of all.

    rows: id, bench (optional: what benchmark an item is of), x (features) and y (1 or 0 for each expert), arrays of one length each. The decay of a benchmark and fold is the one whose heads,
    fitted on all but one inner fold of the others, route that inner fold best; pooled heads have one decay. Folds are dealt by a hash of the id. More than `most` benchmarks are an error.
    """
    deal = lambda salt, n: F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(salt)), F.lit(n)).cast("int")
    name = F.col("bench").cast("string") if "bench" in rows.columns else F.lit("")
    rows = written(rows.select("id", name.alias("name"), F.col("x").cast("array<double>").alias("x"), F.col("y").cast("array<double>").alias("y"), deal("fold", folds).alias("fold"), deal("inner", inner).alias("inner")), "features")
    sizes = rows.groupBy("name").agg(F.max(F.size("x")).alias("d"), F.max(F.size("y")).alias("experts")).limit(most + 1).collect()
    if not sizes:
        return rows.select("id", F.col("name").alias("bench"), "fold", F.lit(0).alias("route"), F.lit(0).alias("pooled"))
    if len(sizes) > most:
        raise ValueError(f"more than {most} benchmarks")
    names, d, experts = sorted((r.name for r in sizes), key=lambda x: (x is None, x)), max(r.d for r in sizes), max(r.experts for r in sizes)
    number = F.coalesce(*(F.when(F.col("name").eqNullSafe(F.lit(x)), F.lit(b)) for b, x in enumerate(names)))
    rows = rows.withColumn("bench", number)

    sets = [(b, f, c) for b in range(len(names)) for f in range(folds) for c in decays]
    tried: list[Mask] = [lambda bench, fold, own, b=b, f=f: (bench == b) & (fold != f) & (own != 0) for b, f, _ in sets]
    whole: list[Mask] = [lambda bench, fold, own, b=b, f=f: (bench == b) & (fold != f) for b, f, _ in sets]
    every: list[Mask] = [lambda bench, fold, own, f=f: fold != f for f in range(folds)]
    w, mean, scale = fit_heads(rows, d, experts, [*tried, *whole, *every], [c for _, _, c in sets] * 2 + [pooled_decay] * folds, steps)

    def right(x, y, bench, fold, own):
        out = np.zeros(len(sets))
        for k, (b, f, _) in enumerate(sets):
            u = np.flatnonzero((bench == b) & (fold != f) & (own == 0))
            out[k] = y[u, (_bordered(x[u], mean[k], scale[k]) @ w[k]).argmax(axis=1)].sum() if len(u) else 0
        return out

    best = _sums(rows, right, (len(sets),)).reshape(len(names), folds, len(decays)).argmax(axis=2)
    chosen = {(b, f): len(sets) + (b * folds + f) * len(decays) + int(best[b, f]) for b in range(len(names)) for f in range(folds)}
    used = {k: (w[k], mean[k], scale[k]) for k in [*chosen.values(), *range(2 * len(sets), len(w))]}
    kind = rows.schema["id"].dataType.simpleString()

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("x").flatten().to_numpy(zero_copy_only=False), float).reshape(batch.num_rows, d)
            fold, bench = batch.column("fold").to_numpy(), batch.column("bench").to_numpy()
            own, pooled = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int32)
            best = lambda u, k: (_bordered(x[u], *used[k][1:]) @ used[k][0]).argmax(axis=1)
            for f in range(folds):
                pooled[fold == f] = best(fold == f, 2 * len(sets) + f)
                for b in range(len(names)):
                    u = (fold == f) & (bench == b)
                    own[u] = best(u, chosen[b, f])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("name"), batch.column("fold"), pa.array(own), pa.array(pooled)], ["id", "bench", "fold", "route", "pooled"])

    return rows.select("id", "name", "fold", "bench", "x").mapInArrow(route, f"id {kind}, bench string, fold int, route int, pooled int")
