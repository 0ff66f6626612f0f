"""Deterministic sampling: the order is that of md5(seed|id), with the id as tie-break, so both engines and every run agree."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(key: str, seed: int = 42) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))


def sample_n(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows, or all of a smaller table."""
    return rows.orderBy(hash_order(key, seed), key).limit(n)


def sample_per_group(rows: DataFrame, groups: Sequence[str | Column], key: str, n: int | Column, seed: int = 42) -> DataFrame:
    w = Window.partitionBy(*groups).orderBy(hash_order(key, seed), key)
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def sha256_mod(text: Column, n: int) -> Column:
    """sha256(text) as a number modulo n, folded from its hex digits."""
    digits = F.split(F.sha2(text.cast("binary"), 256), "")
    value = lambda c: F.conv(c, 16, 10).cast("long")
    return F.aggregate(F.filter(digits, lambda c: c != ""), F.lit(0).cast("long"), lambda acc, c: (acc * 16 + value(c)) % n)


def stratified_fill(rows: DataFrame, group: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """n div k rows of each of k groups, then the rest of n from what is left, in hash order; the key is unique.

    Both parts are limits known beforehand, so tasks drop what can't be among the first before anything moves: the fill is among the first n of all, as at most as many of these are taken already
    as rows are.
    """
    k = max(1, rows.agg(F.countDistinct(group)).first()[0])
    early = sample_per_group(rows, [group], key, n // k, seed).withColumn("__late", F.lit(0))
    rest = sample_n(rows, key, n, seed).join(early.select(key), key, "left_anti").withColumn("__late", F.lit(1))
    return early.unionByName(rest).orderBy("__late", hash_order(key, seed), key).limit(n).drop("__late")
