"""Bootstrap intervals of a mean by multinomial resampling of counts.

A resample of n rows with replacement draws, for each distinct value, how often it is taken; these numbers are multinomial with the values' counts. So what is drawn depends on
how many distinct values there are (two for an accuracy), and not on rows: ten thousand resamples of a billion answers are ten thousand draws of two numbers.

The values of a group fall into blocks of bounded size by hash. Each resample first draws how many of its n rows fall into each block, then each block its values given that number,
which is the same distribution; sums by group and resample are added up. Each task has its own generator, seeded by what it draws, so results repeat on any number of machines.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 4_096  #: distinct values of a group drawn in one task
CHUNK = 1_000  #: resamples drawn in one task


def _generator(*seed: object) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(blake2b("|".join(map(str, seed)).encode(), digest_size=16).digest()))


def _shares(counts: np.ndarray) -> np.ndarray:
    p = counts / counts.sum()
    return p * (1 - 1e-14)  # the last one takes what rounding leaves


def _block_draws(rows: pa.Table, draws: int, per: int, seed: int) -> pa.Table:
    """How many rows each resample of a chunk takes from each block of a group."""
    rows = rows.sort_by("block")
    group, chunk = rows.column("group")[0].as_py(), rows.column("chunk")[0].as_py()
    counts = rows.column("n").to_numpy()
    size = min(per, draws - chunk * per)
    drawn = _generator(seed, "blocks", group, chunk).multinomial(int(counts.sum()), _shares(counts), size)
    return pa.table({"group": rows.column("group"), "block": rows.column("block"), "chunk": rows.column("chunk"), "taken": pa.array([np.ascontiguousarray(x).tobytes() for x in drawn.T.astype(np.int64)], pa.binary())})


def _value_draws(values: pa.Table, taken: pa.Table, per: int, seed: int) -> pa.Table:
    """The sum of the values that each resample of a chunk takes from a block."""
    out = []
    order = np.argsort(values.column("value").to_numpy(), kind="stable")
    x, counts = values.column("value").to_numpy()[order], values.column("n").to_numpy()[order]
    for row in taken.to_pylist():
        n = np.frombuffer(row["taken"], np.int64)
        rng = _generator(seed, "values", row["group"], row["block"], row["chunk"])
        sums = np.concatenate([rng.multinomial(n[at : at + 100], _shares(counts)) @ x for at in range(0, len(n), 100)])
        out.append((row["group"], row["chunk"], sums))
    draw = np.concatenate([c * per + np.arange(len(s)) for _, c, s in out]) if out else np.zeros(0, np.int64)
    groups = [g for g, _, s in out for _ in range(len(s))]
    return pa.table({"group": pa.array(groups, pa.string()), "draw": pa.array(draw, pa.int64()), "total": pa.array(np.concatenate([s for *_, s in out]) if out else [], pa.float64())})


def resampled_means(counts: DataFrame, draws: int = 10_000, seed: int = 42, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """group, draw and mean of every resample. counts: group (string), value (double, one row for each of a group's) and n; block: values, chunk: resamples drawn in one task."""
    sizes = counts.groupBy(F.col("group").alias("of")).agg(F.count("*").alias("distinct"), F.sum("n").alias("rows"))
    dealt = counts.join(sizes, F.col("group").eqNullSafe(F.col("of"))).withColumn("block", F.pmod(F.xxhash64("value"), F.ceil(F.col("distinct") / block)))
    chunks = F.explode(F.sequence(F.lit(0), F.lit((draws - 1) // chunk))).alias("chunk")
    blocks = dealt.groupBy("group", "block").agg(F.sum("n").alias("n")).select("group", "block", "n", chunks)
    taken = blocks.groupBy("group", "chunk").applyInArrow(lambda rows: _block_draws(rows, draws, chunk, seed), "group string, block long, chunk int, taken binary")
    values = dealt.select("group", "block", F.col("value").cast("double").alias("value"), "n", chunks)
    keys = ("group", "block", "chunk")
    sums = values.groupBy(*keys).cogroup(taken.groupBy(*keys)).applyInArrow(lambda a, b: _value_draws(a, b, chunk, seed), "group string, draw long, total double")
    rows = sizes.select("of", "rows")
    return sums.groupBy("group", "draw").agg(F.sum("total").alias("total")).join(rows, F.col("group").eqNullSafe(F.col("of"))).select("group", "draw", (F.col("total") / F.col("rows")).alias("mean"))


def bootstrap_intervals(rows: DataFrame, group: str, value: str, draws: int = 10_000, quantiles: Sequence[tuple[float, str]] = ((0.025, "low"), (0.5, "median"), (0.975, "high")), seed: int = 42) -> DataFrame:
    """group, n, mean and the quantiles of the resampled means, for each group and for all rows (group `overall`); null values don't count."""
    some = rows.where(F.col(value).isNotNull()).groupBy(F.col(group).cast("string").alias("group"), F.col(value).alias("value")).agg(F.count("*").alias("n"))
    counts = some.unionByName(some.groupBy("value").agg(F.sum("n").alias("n")).withColumn("group", F.lit("overall")))
    means = resampled_means(counts, draws, seed).groupBy(F.col("group").alias("of")).agg(*(F.percentile("mean", p).alias(n) for p, n in quantiles))
    whole = counts.groupBy("group").agg(F.sum("n").alias("n"), (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"))
    return whole.join(means, F.col("group").eqNullSafe(F.col("of"))).drop("of")


def interval(counted: Column, draws: int = 10_000, percent: float = 95.0, seed: int = 42) -> Column:
    """mean, low and high of an array of (value, n): a bootstrap interval that stands beside other aggregates of one groupBy.

    Give it collect_list(struct(value, n)) over rows that were counted by value before, so that the array is as long as there are values, however many rows a group has.
    An empty or null array gives null.
    """
    tail = (100 - percent) / 2
    kind = pa.struct([("mean", pa.float64()), ("low", pa.float64()), ("high", pa.float64())])

    @F.arrow_udf("struct<mean: double, low: double, high: double>")
    def of(arrays: pa.Array) -> pa.Array:
        out = []
        for pairs in arrays.to_pylist():
            pairs = sorted((p["value"], p["n"]) for p in pairs or () if p["value"] is not None)
            if not pairs:
                out.append(None)
                continue
            x, n = np.array([p[0] for p in pairs], float), np.array([p[1] for p in pairs])
            rng = _generator(seed, *pairs)
            step = max(1, (1 << 20) // len(x))
            means = np.concatenate([rng.multinomial(int(n.sum()), _shares(n), min(step, draws - at)) @ x for at in range(0, draws, step)]) / n.sum()
            low, high = np.percentile(means, [tail, 100 - tail])
            out.append({"mean": float(x @ n / n.sum()), "low": float(low), "high": float(high)})
        return pa.array(out, kind)

    return of(F.transform(counted, lambda p: F.struct(p["value"].cast("double").alias("value"), p["n"].cast("long").alias("n"))))
