"""Chat formatting with a collapse of cumulative snapshots, in DataFrame operations alone.

A chat log often holds a conversation several times, each time with a few turns more. The turns of each conversation are numbered in order, and
a rolling hash of 128 bits (the xor of each turn's hash with its number) stands for every prefix. Of conversations with equal turns
the smallest conv_id stays; those that an anti-join finds to be the prefix of a longer one go; the rest are rendered as

    <|im_start|>role, line feed, text<|im_end|>, line feed

turn after turn. Only hashes move in the search for prefixes: the texts are shuffled once, for those that stay.

Order is by turn, nulls first; turns with equal numbers are ordered by their hashes. A repeated row counts once. A null role reads `user`,
a null text is empty. Rows with a null conv_id belong to no conversation and are left out. Of other columns only conv_id, turn, role and text are read,
so they may have any name.

Conversations are compared by their hashes alone: two different prefixes of equal length are taken for one with a chance of about 2**-128 a pair. The
turns of one conversation are numbered in one sorted, spilling task; only a rendered conversation stands as one array, so it has to fit in a
task's memory, as its text, a single value, has to anyway.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import cut


def _clean(turns: DataFrame) -> DataFrame:
    role, text = F.coalesce(F.col("role"), F.lit("user")), F.coalesce(F.col("text"), F.lit(""))
    rows = turns.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", role.alias("role"), text.alias("text"))
    return rows.select("*", F.xxhash64("role", F.lit(0), "text").alias("a"), F.xxhash64("text", F.lit(1), "role").alias("b"))


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns and n_copies (conversations with just these turns) of each conversation that is no prefix of another."""
    order = Window.partitionBy("conv_id").orderBy("turn", "a", "b")
    numbered = _clean(turns).select("conv_id", "turn", "a", "b").distinct().withColumn("k", F.row_number().over(order))
    n = F.count("*").over(Window.partitionBy("conv_id"))
    rolling = [F.bit_xor(F.xxhash64("k", F.lit(seed), "a", "b")).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias(f"p{seed}") for seed in (0, 1)]
    prefixes = cut(numbered.select("conv_id", "k", *rolling, n.alias("n")), "prefixes")
    whole = prefixes.where("k = n").groupBy("k", "p0", "p1").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    shorter = prefixes.where("k < n").select("k", "p0", "p1").distinct()
    return whole.join(shorter, ["k", "p0", "p1"], "left_anti").select("conv_id", F.col("k").cast("long").alias("n_turns"), "n_copies")


def render(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies and text of each maximal conversation."""
    stays = cut(maximal(turns), "maximal")
    rows = _clean(turns).join(stays, "conv_id")
    whole = rows.groupBy("conv_id").agg(F.first("n_turns").alias("n_turns"), F.first("n_copies").alias("n_copies"), F.array_sort(F.collect_set(F.struct("turn", "a", "b", "role", "text"))).alias("turns"))
    said = F.transform("turns", lambda t: F.concat(F.lit("<|im_start|>"), t["role"], F.lit("\n"), t["text"], F.lit("<|im_end|>\n")))
    return whole.select("conv_id", "n_turns", "n_copies", F.array_join(said, "").alias("text"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE_SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT conv_id, turn, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS said,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM t),
p AS (SELECT a.conv_id, a.k, a.n, string_agg(b.said, '' ORDER BY b.k) AS text FROM n a JOIN n b ON a.conv_id = b.conv_id AND b.k <= a.k GROUP BY a.conv_id, a.k, a.n),
w AS (SELECT min(conv_id) AS conv_id, k, count(*) AS n_copies, text FROM p WHERE k = n GROUP BY k, text)
SELECT conv_id, k AS n_turns, n_copies, text FROM w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.k < p.n AND p.k = w.k AND p.text = w.text)
"""
