"""Window-like operators whose order is always explicit."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import written

Order = Sequence[Column | str]


def first_per_key(rows: DataFrame, keys: Sequence[str], order: Order) -> DataFrame:
    """The first row of each key in the given order, which should be total."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def top_per_key(rows: DataFrame, keys: Sequence[str], order: Order, k: int, rank: str = "rank") -> DataFrame:
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def running_total(rows: DataFrame, order: Order, value: Column, out: str, keys: Sequence[str] = ()) -> DataFrame:
    """The sum of value over all rows of the same keys before each row, as column out. The order should be total: rows that are equal in it stay in one task.

    A prefix sum in parallel: rows are dealt into ranges of the order, and written with the number of their range, as bounds are drawn anew whenever
    a plan runs again. Sums then run inside of each range, and over the ranges' totals, of which there are as many as partitions, whatever the keys' values are.
    """
    start = F.sum("__value").over(Window.partitionBy(*keys, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    ranged = rows.withColumn("__value", value).repartitionByRange(*keys, *order).withColumn("__range", F.spark_partition_id())
    ranged = written(ranged, "ranges")
    totals = ranged.groupBy(*keys, "__range").agg(F.sum("__value").alias("__total"))
    before = F.sum("__total").over(Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    same = [F.col(c).eqNullSafe(F.col(f"__of_{i}")) for i, c in enumerate((*keys, "__range"))]
    earlier = totals.select(*(F.col(c).alias(f"__of_{i}") for i, c in enumerate((*keys, "__range"))), F.coalesce(before, F.lit(0)).alias("__earlier"))
    inside = ranged.withColumn("__inside", F.coalesce(start, F.lit(0)))
    return inside.join(earlier, functools.reduce(Column.__and__, same)).withColumn(out, F.col("__earlier") + F.col("__inside")).select(*rows.columns, out)


def percentiles(rows: DataFrame, group: str, value: str, shares: Sequence[float]) -> DataFrame:
    """group and a column p0, p1, ... for each of the shares: the exact percentile, linear between the two values that it falls between; nulls don't count.

    Equal values are counted first; their running counts tell which values stand at the two places of each share. So what a task holds are ranges of
    distinct values, and no group's values gather in one buffer. A group without values has no row.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("__n"))
    placed = running_total(counts, [value], F.col("__n"), "__first", [group])
    sizes = placed.groupBy(F.col(group).alias("__of")).agg(F.sum("__n").alias("__all"))
    placed = placed.join(sizes, F.col(group).eqNullSafe(F.col("__of")))
    place = lambda p: F.lit(p) * (F.col("__all") - 1)
    at = lambda k: F.max(F.when((F.col("__first") <= k) & (k < F.col("__first") + F.col("__n")), F.col(value)))
    ends = placed.groupBy(group).agg(F.max("__all").alias("__all"), *(at(f(place(p)).cast("long")).alias(f"{e}{k}") for k, p in enumerate(shares) for e, f in (("a", F.floor), ("b", F.ceil))))
    part = lambda p: place(p) - F.floor(place(p))
    return ends.select(group, *((F.col(f"a{k}") + (F.col(f"b{k}") - F.col(f"a{k}")) * part(p)).alias(f"p{k}") for k, p in enumerate(shares)))


def base26(n: Column) -> Column:
    """0 is a, 25 is z, 26 is aa, 702 is aaa, and so on; a long has at most fourteen letters."""
    state = lambda k, s: F.struct(k.alias("k"), s.alias("s"))
    letter = lambda k: F.char((k % 26).cast("int") + 97)
    step = lambda x, _: F.when(x["k"] < 0, x).otherwise(state(F.call_function("div", x["k"], F.lit(26)).cast("long") - 1, F.concat(letter(x["k"]), x["s"])))
    return F.aggregate(F.sequence(F.lit(1), F.lit(14)), state(n.cast("long"), F.lit("")), step, lambda x: x["s"])


def suffix_duplicates(rows: DataFrame, key: str, order: Order, out: str = "new_id") -> DataFrame:
    """Ids made unique: the duplicates of a key get _a, _b, ... in order; keys that occur once stay. A key that very many rows have is numbered in several ranges."""
    sizes = rows.groupBy(F.col(key).alias("__of")).agg(F.count("*").alias("__n"))
    numbered = running_total(rows, order, F.lit(1), "__k", [key]).join(sizes, F.col(key).eqNullSafe(F.col("__of")))
    name = F.col(key).cast("string")
    return numbered.withColumn(out, F.when(F.col("__n") == 1, name).otherwise(F.concat(name, F.lit("_"), base26(F.col("__k"))))).drop("__n", "__k", "__of")


def gaps(intervals: DataFrame, keys: Sequence[str], start: str, end: str, total: str) -> DataFrame:
    """The stretches of [0, total) that no half-open interval covers, as gap_start and gap_end."""
    w = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    inner = intervals.select(*keys, F.coalesce(F.max(end).over(w), F.lit(0)).cast("long").alias("gap_start"), F.col(start).cast("long").alias("gap_end"))
    tail = intervals.groupBy(*keys).agg(F.max(end).cast("long").alias("gap_start"), F.max(total).cast("long").alias("gap_end"))
    return inner.unionByName(tail).where("gap_start < gap_end")
