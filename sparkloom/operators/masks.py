"""Which tokens of a sample see which, as rectangles.

A sample is splits in a row, each of n tokens and of a kind: causal, full or noise. A relation of tokens is rows of (sample, q_from, q_to, k_from, k_to, causal): queries q_from..q_to see keys
k_from..k_to, both half-open, and if causal only those that aren't behind them. Rectangles of a sample never overlap. There are two for each split, however long it
is, where the matrix has the square of a sample's tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EDGES = ("q_from", "q_to", "k_from", "k_to")


def placed(splits: DataFrame, sample: str, order: str, length: str) -> DataFrame:
    """The splits with start, end and total, the number of their sample's tokens. Sums run over one sample's splits only."""
    w = Window.partitionBy(sample).orderBy(order)
    end = F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return splits.withColumn("end", end).withColumn("start", F.col("end") - F.col(length)).withColumn("total", F.sum(length).over(Window.partitionBy(sample)))


def visible(splits: DataFrame, sample: str, causal: Column, noise: Column) -> DataFrame:
    """The relation of placed splits: each sees itself, wholly or causally, and all earlier ones but noise."""
    rectangle = lambda a, b, c, d, k: F.struct(*(x.cast("long").alias(n) for x, n in zip((a, b, c, d), EDGES)), k.alias("causal"))
    start, end = F.col("start"), F.col("end")
    own, later = rectangle(start, end, start, end, causal), rectangle(end, F.col("total"), start, end, F.lit(False))
    both = F.array(F.when(start < end, own), F.when((start < end) & (end < F.col("total")) & ~noise, later))
    return splits.select(sample, F.explode(F.array_compact(both)).alias("r")).select(sample, "r.*")


def without(relation: DataFrame, sample: str, queries: DataFrame, keys: DataFrame, shown: DataFrame | None = None) -> DataFrame:
    """The relation without the pairs of a query of `queries` and a key of `keys`, unless the key is one of `shown`.

    These three have rows (sample, start, end), which may overlap. Each rectangle is cut at their edges; the parts that are hidden go.
    """
    hidden = keys.select(sample, "start", "end", F.lit(1).alias("kind"))
    if shown is not None:
        hidden = hidden.unionByName(shown.select(sample, "start", "end", F.lit(2).alias("kind")))
    q = stretches(queries.select(sample, "start", "end", F.lit(1).alias("kind")), sample).select(F.col(sample).alias("q_of"), F.col("start").alias("q_a"), F.col("end").alias("q_b"), (F.col("kinds") > 0).alias("asks"))
    k = stretches(hidden, sample).select(F.col(sample).alias("k_of"), F.col("start").alias("k_a"), F.col("end").alias("k_b"), (F.col("kinds") == 1).alias("hides"))
    by_q = relation.join(q, (F.col(sample) == F.col("q_of")) & (F.col("q_a") < F.col("q_to")) & (F.col("q_b") > F.col("q_from")), "left")
    by_q = by_q.withColumn("q_from", F.greatest("q_from", "q_a")).withColumn("q_to", F.least("q_to", "q_b"))
    asks = F.coalesce(F.col("asks"), F.lit(False))
    meets = (F.col(sample) == F.col("k_of")) & (F.col("k_a") < F.col("k_to")) & (F.col("k_b") > F.col("k_from"))
    by_k = by_q.where(asks).join(k, meets, "left").where(~F.coalesce(F.col("hides"), F.lit(False)))
    by_k = by_k.withColumn("k_from", F.greatest("k_from", "k_a")).withColumn("k_to", F.least("k_to", "k_b"))
    left = by_q.where(~asks).select(sample, *EDGES, "causal").unionByName(by_k.select(sample, *EDGES, "causal"))
    return left.where(~F.col("causal") | (F.col("k_from") < F.col("q_to")))


def stretches(intervals: DataFrame, sample: str) -> DataFrame:
    """The whole line cut at the edges of a sample's intervals: sample, start, end and kinds, the sum of the distinct powers of two (kind) that cover the stretch."""
    least, most = -(1 << 62), 1 << 62
    edges = intervals.where("start < end").select(sample, "kind", F.explode(F.array(F.struct(F.col("start").cast("long").alias("at"), F.lit(1).alias("step")), F.struct(F.col("end").cast("long").alias("at"), F.lit(-1).alias("step")))).alias("e"))
    ends = edges.select(sample).distinct().select(sample, F.lit(least).cast("long").alias("at"), F.lit(0).alias("one"), F.lit(0).alias("two"))
    step = lambda n: F.sum(F.when(F.col("kind") == n, F.col("e.step")).otherwise(0)).alias("one" if n == 1 else "two")
    steps = edges.groupBy(sample, F.col("e.at").alias("at")).agg(step(1), step(2)).unionByName(ends)
    w = Window.partitionBy(sample).orderBy("at")
    covered = lambda c: (F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0)) > 0).cast("int")
    return steps.select(sample, F.col("at").alias("start"), F.coalesce(F.lead("at").over(w), F.lit(most).cast("long")).alias("end"), (covered("one") + 2 * covered("two")).alias("kinds"))


def pair_count(q_from: Column, q_to: Column, k_from: Column, k_to: Column, causal: Column) -> Column:
    """How many pairs a rectangle has. A causal one has, for each query, the keys from k_from up to the query."""
    rows, cols = q_to - q_from, k_to - k_from
    first, last = F.greatest(q_from, k_from), F.least(q_to, k_to - 1)  # queries from first to last - 1 see a part of the keys, later ones all
    part = F.greatest(last - first, F.lit(0).cast("long"))
    some = F.shiftright(part * (first + F.greatest(last, first) - 1 - 2 * k_from + 2), 1)
    return F.when(~causal, rows * cols).otherwise(some + F.greatest(q_to - F.greatest(last, q_from), F.lit(0).cast("long")) * cols)


def by_query(relation: DataFrame, sample: str) -> DataFrame:
    """sample, q, n_keys and key_sum: how many keys each query sees, and the sum of their places."""
    rows = relation.withColumn("q", F.explode(F.sequence(F.col("q_from"), F.col("q_to") - 1)))
    end = F.when(F.col("causal"), F.least("k_to", F.col("q") + 1)).otherwise(F.col("k_to"))
    rows = rows.withColumn("end", F.greatest(end, F.col("k_from")))
    n = F.col("end") - F.col("k_from")
    return rows.groupBy(sample, "q").agg(F.sum(n).alias("n_keys"), F.sum(F.shiftright(n * (F.col("k_from") + F.col("end") - 1), 1)).alias("key_sum"))
