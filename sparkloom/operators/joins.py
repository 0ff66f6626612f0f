"""Joins, set membership and projections that several queries share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import running_total


def add_defaults(rows: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """rows with the columns that it lacks."""
    return rows.withColumns({n: c for n, c in defaults.items() if n not in rows.columns})


def drop_helpers(rows: DataFrame, *names: str) -> DataFrame:
    return rows.drop(*names, *(c for c in rows.columns if c.startswith("_")))


def swap_prefix(text: Column, old: str, new: str) -> Column:
    return F.when(text.startswith(old), F.concat(F.lit(new), text.substr(F.lit(len(old) + 1), F.length(text)))).otherwise(text)


def first_nonempty(*names: str) -> Column:
    return F.coalesce(*(F.nullif(F.col(n), F.lit("")) for n in names[:-1]), F.col(names[-1]))


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """How many rows of a full outer join both sides have, or only one."""
    both = a.withColumn("__a", F.lit(1)).join(b.withColumn("__b", F.lit(1)), key, "full")
    x, y = F.col("__a").isNotNull(), F.col("__b").isNotNull()
    return both.agg(F.count_if(x & y).alias("n_both"), F.count_if(~y).alias("only_a"), F.count_if(~x).alias("only_b"))


def in_all(rows: DataFrame, sets: Sequence[DataFrame], key: str) -> DataFrame:
    for s in sets:
        rows = rows.join(s, key, "left_semi")
    return rows


def cascade(rows: DataFrame, lookups: Sequence[tuple[Column, DataFrame]]) -> DataFrame:
    """rows with value and hit: of lookups with columns k and v, unique in k, the first that has the row's key, and its number from 1."""
    for i, (key, table) in enumerate(lookups, 1):
        rows = rows.withColumn("__k", key.cast("long")).join(table.select(F.col("k").cast("long").alias("__k"), F.col("v").alias(f"__v{i}")), "__k", "left").drop("__k")
    names = [f"__v{i}" for i in range(1, len(lookups) + 1)]
    hit = F.coalesce(*(F.when(F.col(n).isNotNull(), i) for i, n in enumerate(names, 1)))
    return rows.withColumn("value", F.coalesce(*names)).withColumn("hit", hit).drop(*names)


def nearest_ancestor(paths: DataFrame, key: str, path: str, homes: DataFrame) -> DataFrame:
    """key and dir: the longest directory in homes (dir) that is a proper ancestor of the path, or null."""
    parts = F.split(path, "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    exploded = paths.select(key, F.explode(ancestors).alias("dir"))
    return exploded.join(homes.withColumn("__hit", F.lit(1)), "dir", "left").groupBy(key).agg(F.max_by(F.col("dir"), F.when(F.col("__hit") == 1, F.length("dir"))).alias("dir"))


def prefix_match(rows: DataFrame) -> DataFrame:
    """For rows (id, q, ord) the best other row of the same id whose q is a prefix of this one's or reverse: a, b (their ord) and exact (0 if equal).

    Equal questions come first, then the smallest ord. Each distinct question is exploded into its proper prefixes and meets the others by equality, and only the
    smallest ord of a question travels, so a question that very many rows share is no more work than one.
    """
    nth = Window.partitionBy("id", "q").orderBy("ord")
    two = rows.withColumn("n", F.row_number().over(nth)).where("n <= 2").groupBy("id", "q").agg(F.min("ord").alias("first"), F.max(F.when(F.col("n") == 2, F.col("ord"))).alias("second"))
    prefixes = F.transform(F.sequence(F.lit(1), F.length("q") - 1), lambda n: F.substr(F.col("q"), F.lit(1), n))
    split = two.where("length(q) > 1").select("id", F.col("q").alias("longer"), "first", F.explode(prefixes).alias("q"))
    known = split.withColumnRenamed("first", "long_first").join(two.select("id", "q", "first"), ["id", "q"])
    up = known.groupBy("id", F.col("longer").alias("q")).agg(F.min("first").alias("c"))
    down = known.groupBy("id", "q").agg(F.min("long_first").alias("c"))
    proper = up.unionByName(down).groupBy("id", "q").agg(F.min("c").alias("proper"))
    found = rows.join(two, ["id", "q"]).join(proper, ["id", "q"], "left")
    equal = F.when(F.col("ord") == F.col("first"), F.col("second")).otherwise(F.col("first"))
    best = found.select(F.col("ord").alias("a"), F.coalesce(equal, "proper").alias("b"), F.when(equal.isNotNull(), 0).otherwise(1).alias("exact"))
    return best.where("b IS NOT NULL")


def contiguous_shards(rows: DataFrame, key: str, shards: int) -> DataFrame:
    """Shard from 0 of each row: sorted by a unique key, contiguous, sizes differing by one at most, larger ones first."""
    ranked = running_total(rows, [key], F.lit(1), "__k")
    n = rows.agg(F.count("*").alias("__n"))
    small, more = F.floor(F.col("__n") / shards), F.col("__n") % shards
    edge = more * (small + 1)
    shard = F.when(F.col("__k") < edge, F.floor(F.col("__k") / (small + 1))).otherwise(more + F.floor((F.col("__k") - edge) / F.greatest(small, F.lit(1))))
    return ranked.join(F.broadcast(n)).withColumn("shard", shard.cast("long")).drop("__k", "__n")
