"""Metrics of texts and pixels that built-in functions can't express, Arrow batch by Arrow batch."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import written


def _words(text: str | None) -> list[str]:
    return re.findall(r"\w+", (text or "").lower())


def common_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence; a whole row of its table is the bits of one integer."""
    places: dict[str, int] = {}
    for i, w in enumerate(b):
        places[w] = places.get(w, 0) | 1 << i
    full = row = (1 << len(b)) - 1
    for w in a:
        hit = row & places.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(b) - row.bit_count()


def rouge_l(candidate: list[str], reference: list[str]) -> float:
    """F1 of the longest common subsequence."""
    common = common_length(candidate, reference)
    return 2 * common / (len(candidate) + len(reference)) if common else 0.0


def text_metrics(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys, rouge_l, bleu_1 to bleu_4 and cider of rows with candidate and reference.

    BLEU: the geometric mean of the clipped precisions of 1- to n-grams with the brevity penalty; a precision without a hit counts as a tenth of a hit, and without any
    common word the score is 0. CIDEr: ten times the mean over 1- to 4-grams of the clipped similarity of tf-idf vectors, lessened by how much the lengths differ. Words are runs of letters, digits
    and underscores; they aren't stemmed. All but ROUGE-L comes from one table of grams: counts meet in a join, document frequencies are counted over all references by
    a grouped aggregation, so the corpus' vocabulary never gathers in one place. Keys are taken to be unique.
    """
    pairs = written(pairs, "pairs")  # read for the scores, the grams and their number
    schema = ", ".join(f"{k} {pairs.schema[k].dataType.simpleString()}" for k in keys)

    def longest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = pdf[list(keys)].copy()
            words = [(_words(a), _words(b)) for a, b in zip(pdf["candidate"], pdf["reference"])]
            out["rouge_l"] = [rouge_l(a, b) for a, b in words]
            out["n_candidate"], out["n_reference"] = [len(a) for a, _ in words], [len(b) for _, b in words]
            yield out

    scores = pairs.mapInPandas(longest, f"{schema}, rouge_l double, n_candidate long, n_reference long")
    word = lambda c: F.expr(rf"regexp_extract_all(lower({c}), '(?U)\\w+', 0)")
    side = lambda c, x: F.struct(F.lit(x).alias("side"), word(c).alias("w"))
    rows = pairs.select(*keys, F.explode(F.array(side("candidate", 0), side("reference", 1))).alias("s")).select(*keys, "s.*")
    rows = rows.select(*keys, "side", "w", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("n")).where("size(w) >= n")
    gram = F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1), lambda i: F.array_join(F.slice("w", i, F.col("n")), " ")))
    both = rows.select(*keys, "side", "n", gram.alias("gram")).groupBy(*keys, "n", "gram").agg(F.count_if(F.col("side") == 0).alias("x"), F.count_if(F.col("side") == 1).alias("y"))
    df = both.where("y > 0").groupBy("n", "gram").agg(F.count("*").alias("df"))
    total = pairs.agg(F.log(F.greatest(F.count("*"), F.lit(1)).cast("double")).alias("most"))
    idf = F.col("most") - F.log(F.coalesce("df", F.lit(1)).cast("double"))
    both = both.join(df, ["n", "gram"], "left").join(F.broadcast(total)).withColumn("vx", F.col("x") * idf).withColumn("vy", F.col("y") * idf)
    sums = both.groupBy(*keys, "n").agg(
        F.sum(F.least("vx", "vy") * F.col("vy")).alias("xy"), F.sum(F.col("vx") ** 2).alias("xx"), F.sum(F.col("vy") ** 2).alias("yy"),
        F.sum(F.least("x", "y")).alias("hits"), F.sum("x").alias("all_x"), F.sum("y").alias("all_y"),
    )
    of = lambda c, n: F.coalesce(F.max(F.when(F.col("n") == n, F.col(c))), F.lit(0))
    delta = of("all_x", 2) - of("all_y", 2)
    near = F.sum(F.coalesce(F.col("xy") / F.nullif(F.sqrt(F.col("xx") * F.col("yy")), F.lit(0.0)), F.lit(0.0)))
    counts = sums.groupBy(*keys).agg((near * F.exp(-delta * delta / 72.0) / 4 * 10).alias("cider"), *(of(c, n).alias(f"{c}_{n}") for n in range(1, 5) for c in ("hits", "all_x")))
    found = scores.join(counts, list(keys), "left")
    lost = lambda n: F.log(F.when(F.col(f"hits_{n}") > 0, F.col(f"hits_{n}")).otherwise(0.1) / F.greatest(F.col(f"all_x_{n}"), F.lit(1)))
    short = F.least(F.lit(1.0), F.exp(1 - F.col("n_reference") / F.col("n_candidate")))
    score = lambda n: F.when((F.col("n_candidate") > 0) & (F.col("hits_1") > 0), short * F.exp(sum((lost(k) for k in range(1, n + 1)), F.lit(0.0)) / n)).otherwise(0.0)
    return found.select(*keys, "rouge_l", *(score(n).alias(f"bleu_{n}") for n in range(1, 5)), F.coalesce("cider", F.lit(0.0)).alias("cider"))


def hash_pixels(rows: DataFrame, key: str, pixels: str) -> DataFrame:
    """key and digest, the md5 of the pixels' bytes; a pixel counts modulo 256."""
    byte = lambda x: F.lpad(F.hex(x.cast("int").bitwiseAND(255)), 2, "0")
    return rows.select(key, F.md5(F.unhex(F.array_join(F.transform(pixels, byte), ""))).alias("digest"))
