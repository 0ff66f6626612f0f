"""Toxicity: a chain of linear classifiers over hashed word and prefix features.

The categories are judged one after another. Each category's logistic model sees the text's features and the log odds that the
models before it gave; in training those are out-of-fold predictions, so a later model learns from errors like those it will meet.
Here the chain is low quality, then toxic: what looks like junk is weighed before its words are.

Features are the prefixes of 4 to 8 bytes and the whole words of up to 12 bytes (words as in shingles), each once a text, and four
ratios of the text. Of the features that MIN_TEXTS sampled texts have, the SELECTED most telling ones for each category are kept by their
full 64-bit hash, so a rare word never counts for another. A model that predicts a fold out of it selects its features without that fold as well, and equal
texts are in one fold. A text is toxic from a probability on that is chosen where out-of-fold predictions part toxic texts best from clean ones, so labels
that training doesn't see have no part in it.

Training reads a bounded sample: of the labelled ids the SAMPLE first in hash order. Features are extracted and counted in parallel; only the
selected ones, a bounded number for each text, come together in one task for each model. Every text is then judged whole, row by row without a shuffle.

A null or empty text has no words and is never toxic. If no label exists, nothing is. Of an id labelled repeatedly the highest labels count, of an id with
several texts the first in code-point order teaches; rows with a null label or id teach nothing. Repeated rows give repeated rows. A very long text is
judged by itself, in memory of about 60 times its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from .shingles import lower_bytes, mix, words_of
from .storage import all_of, cut, discard, slices

SAMPLE = 8_000  #: labelled texts to learn from
SELECTED = 512  #: features of each category
MIN_TEXTS = 4  #: sampled texts that a feature needs
FOLDS = 5
PARTS = 32  #: partitions of the sample
THRESHOLDS = 0.1, 0.9  #: between which a text begins to be toxic
CLEAN = 20  #: how much a clean text called toxic weighs, as a share of the clean ones, beside a toxic one missed
CATEGORIES = ("low_quality", "toxic")
_PREFIXES, _WHOLE, _RATIOS = range(4, 9), 12, 4
_STEP = np.uint64(0x100000001B3)


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hash of each feature met, the number of its text, and each text's ratios."""
    data, sizes = lower_bytes(texts)
    starts, lengths, counts = words_of(data, sizes)
    owner = np.repeat(np.arange(len(texts)), counts)
    padded = np.concatenate((data, np.zeros(_WHOLE, np.uint8)))
    h, hashes, owners = np.full(len(starts), 0xCBF29CE484222325, np.uint64), [], []
    for k in range(_WHOLE):
        more = lengths > k
        if not more.any():
            break
        h = np.where(more, (h ^ padded[starts + k]) * _STEP, h)
        for take, salt in ((lengths == k + 1, 1), (more, 2) if k + 1 in _PREFIXES else (None, 0)):
            if take is not None and take.any():
                hashes.append(mix(h[take] + np.uint64(salt)))
                owners.append(owner[take])
    ends = np.cumsum(sizes)
    sums = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags)))[np.concatenate(([0], ends))])
    n = np.maximum(sizes - 1, 1)
    digits, marks = sums((data >= 48) & (data < 58)) / n, sums((data > 32) & (data < 128) & ~((data >= 48) & (data < 58)) & ~((data >= 97) & (data < 123))) / n
    ratios = np.stack((np.log1p(counts) / 10, digits, marks, np.minimum(n / np.maximum(counts, 1), 40) / 40), axis=1)
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return (np.concatenate(hashes) if hashes else none[0]), (np.concatenate(owners) if owners else none[1]), ratios


@dataclass
class Chain:
    categories: list[str] = field(default_factory=list)
    chosen: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  #: sorted hashes of the features
    weights: list[np.ndarray] = field(default_factory=list)  #: of the features, the ratios, earlier log odds and 1, by category
    threshold: float = 0.5  #: of the last category

    def __post_init__(self) -> None:
        self.seen = np.zeros(1 << 20, bool)  # a quick look before the search in chosen
        self.seen[(self.chosen >> np.uint64(44)).astype(np.int64)] = True

    def matrix(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row and column of each chosen feature that a text has, and the ratios."""
        hashes, owners, ratios = features(texts)
        may = self.seen[(hashes >> np.uint64(44)).astype(np.int64)]
        hashes, owners = hashes[may], owners[may]
        at = np.minimum(np.searchsorted(self.chosen, hashes), max(0, len(self.chosen) - 1))
        hit = self.chosen[at] == hashes if len(self.chosen) else np.zeros(0, bool)
        pairs = np.unique(owners[hit].astype(np.int64) * max(1, len(self.chosen)) + at[hit])
        return pairs // max(1, len(self.chosen)), pairs % max(1, len(self.chosen)), ratios

    def predict(self, texts: list[str | None]) -> np.ndarray:
        """Probabilities, text by category."""
        rows, cols, ratios = self.matrix(texts)
        out = np.zeros((len(texts), len(self.categories)))
        for c, w in enumerate(self.weights):
            out[:, c] = _sigmoid(_logits(w, rows, cols, np.hstack((ratios, _log_odds(out[:, :c]))), len(self.chosen)))
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-3, 1 - 1e-3)
    return np.log(p / (1 - p))


def _logits(w: np.ndarray, rows: np.ndarray, cols: np.ndarray, dense: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, w[cols], len(dense)) + dense @ w[n:-1] + w[-1]


def _fit(rows: np.ndarray, cols: np.ndarray, dense: np.ndarray, n: int, y: np.ndarray, use: np.ndarray, steps: int = 250) -> np.ndarray:
    """Logistic regression with a small L2 penalty, by Adam on all rows at once; use: rows to learn from."""
    w, m, v = np.zeros(n + dense.shape[1] + 1), 0.0, 0.0
    total, rate = max(1.0, use.sum()), y[use > 0].mean() if use.any() else 0.0
    w[-1] = _log_odds(np.array([rate]))[0]
    for t in range(1, steps + 1):
        g = (_sigmoid(_logits(w, rows, cols, dense, n)) - y) * use / total
        grad = np.concatenate((np.bincount(cols, g[rows], n), g @ dense, [g.sum()])) + 1e-5 * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Where out-of-fold probabilities p part texts with y = 1 from others at the least cost, in the middle of the gap."""
    if not 0 < y.sum() < len(y):
        return 0.5
    order = np.argsort(p, kind="stable")
    p, y = p[order], y[order]
    missed = np.concatenate(([0], np.cumsum(y))) / y.sum()  # when the first n are below
    wrong = 1 - np.concatenate(([0], np.cumsum(1 - y))) / (1 - y).sum()
    cost = missed + CLEAN * wrong
    cost[1:-1][p[1:] == p[:-1]] = np.inf  # equal probabilities can't be parted
    n = int(np.argmin(cost))
    low, high = (p[n - 1] if n else 0.0), (p[n] if n < len(p) else 1.0)
    return float(np.clip((low + high) / 2, *THRESHOLDS))


def _sample(docs: DataFrame, labels: DataFrame, key: str, text: str, sample: int) -> DataFrame:
    """at (a number that orders texts), fold, text and the categories of at most sample labelled ids."""
    known = labels.select(F.col(key).alias("id"), (F.col("quality") == 0).cast("int").alias("low_quality"), (F.col("toxic") == 1).cast("int").alias("toxic")).dropna()
    order = F.xxhash64(F.col("id").cast("string"), F.lit("toxicity"))
    known = known.groupBy("id").agg(F.max("low_quality").alias("low_quality"), F.max("toxic").alias("toxic")).orderBy(order, "id").limit(sample)
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).join(F.broadcast(known), "id")
    once = rows.groupBy("id").agg(F.min("text").alias("text"), *(F.max(c).alias(c) for c in CATEGORIES))
    return once.repartition(PARTS, "id").select(order.alias("at"), F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold"), "text", *CATEGORIES)


def _counted(rows: DataFrame) -> DataFrame:
    """hash, and for each fold how many texts have the feature (n) and how many of them are of each category (its name)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, owners, _ = features(part.column("text").to_pylist())
                order = np.lexsort((owners, hashes))
                hashes, owners = hashes[order], owners[order]
                new = np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])))[: len(hashes)]
                hashes, owners = hashes[new], owners[new]
                fold = part.column("fold").to_numpy(zero_copy_only=False)[owners].astype(np.int64)
                names, place = np.unique(hashes, return_inverse=True)
                flat = np.bincount(place * FOLDS + fold, minlength=len(names) * FOLDS)
                of = [np.bincount(place * FOLDS + fold, part.column(c).to_numpy(zero_copy_only=False)[owners], len(names) * FOLDS).astype(np.int64) for c in CATEGORIES]
                at = np.flatnonzero(flat)
                yield pa.RecordBatch.from_arrays([pa.array(names[at // FOLDS].view(np.int64)), pa.array((at % FOLDS).astype(np.int32)), *(pa.array(x[at]) for x in (flat, *of))], ["hash", "fold", "n", *CATEGORIES])

    counts = rows.mapInArrow(run, "hash long, fold int, n long, " + ", ".join(f"{c} long" for c in CATEGORIES))
    of_fold = lambda c, f: F.coalesce(F.sum(F.when(F.col("fold") == f, F.col(c))), F.lit(0)).alias(f"{c}_{f}")
    return counts.groupBy("hash").agg(*(of_fold(c, f) for c in ("n", *CATEGORIES) for f in range(FOLDS)), F.sum("n").alias("all")).where(F.col("all") >= MIN_TEXTS)


_EVERY = -1  #: in place of a fold: none is left out


def _selected(counted: DataFrame, totals: list[dict[str, int]]) -> dict[tuple[str, int], np.ndarray]:
    """The sorted hashes of the features of each category and each fold left out (or none). totals: of each fold how many texts it has (n), and of each category."""
    best, views = [], [(c, f) for c in CATEGORIES for f in (_EVERY, *range(FOLDS))]
    for k, (c, f) in enumerate(views):
        folds = [g for g in range(FOLDS) if g != f]
        n, y = (sum(totals[g][x] for g in folds) for x in ("n", c))
        if not 0 < y < n:
            continue
        df, pos = (sum((F.col(f"{x}_{g}") for g in folds), F.lit(0)) for x in ("n", c))
        z = F.abs(pos - df * (y / n)) / F.sqrt(F.greatest(df, F.lit(1)) * (y / n * (1 - y / n)))
        told = counted.where(df >= MIN_TEXTS).select(F.lit(k).alias("view"), "hash", z.alias("z")).where("z > 3")
        best.append(told.orderBy(F.desc("z"), "hash").limit(SELECTED).select("view", "hash"))
    found = [tuple(r) for r in reduce(DataFrame.unionByName, best).collect()] if best else []  # at most SELECTED a view
    return {v: np.unique(np.array([h for j, h in found if j == k], np.int64).view(np.uint64)) for k, v in enumerate(views)}


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Chain:
    """Learn the chain from docs' texts and the columns quality and toxic of labels, on a bounded sample."""
    rows = cut(_sample(docs, labels, key, text, sample), "labelled")
    sums = {r["fold"]: r.asDict() for r in rows.groupBy("fold").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in CATEGORIES)).collect()}
    if not sums:
        discard(rows)
        return Chain()
    counted = cut(_counted(rows), "counted")
    selected = _selected(counted, [sums.get(f, dict.fromkeys(("n", *CATEGORIES), 0)) for f in range(FOLDS)])
    every = Chain([], np.unique(np.concatenate(list(selected.values()))))
    allowed = {v: np.isin(every.chosen, h) for v, h in selected.items()}

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                owner, cols, ratios = every.matrix(part.column("text").to_pylist())
                offsets = np.searchsorted(owner, np.arange(part.num_rows + 1))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(cols, pa.int32())), pa.FixedSizeListArray.from_arrays(pa.array(ratios.ravel()), _RATIOS).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("at", "fold", *CATEGORIES)), *lists], ["at", "fold", *CATEGORIES, "cols", "ratios"])

    matrix = cut(rows.mapInArrow(sparse, "at long, fold int, " + ", ".join(f"{c} int" for c in CATEGORIES) + ", cols array<int>, ratios array<double>"), "matrix")
    odds: list[np.ndarray] = []
    weights = []
    for category in CATEGORIES:

        def fit(pdf: pd.DataFrame) -> pd.DataFrame:
            held, pdf = int(pdf["held"].iloc[0]), pdf.sort_values(["at", "fold"], kind="stable")
            cols = np.concatenate([np.asarray(x, np.int64) for x in pdf["cols"]])
            owner = np.repeat(np.arange(len(pdf)), [len(x) for x in pdf["cols"]])
            usable = allowed[category, held][cols]
            owner, cols = owner[usable], cols[usable]
            dense = np.hstack((np.array(pdf["ratios"].tolist()), *(x[:, None] for x in odds)))
            fold, y = pdf["fold"].to_numpy(), pdf[category].to_numpy(float)
            w = _fit(owner, cols, dense, len(every.chosen), y, (fold != held).astype(float))
            return pd.DataFrame({"held": [held], "weights": [w.tolist()], "p": [np.where(fold == held, _sigmoid(_logits(w, owner, cols, dense, len(every.chosen))), 0).tolist()], "y": [y.tolist()]})

        models = matrix.withColumn("held", F.explode(F.array(*map(F.lit, (_EVERY, *range(FOLDS)))))).repartition(FOLDS + 1, "held").groupBy("held").applyInPandas(fit, "held int, weights array<double>, p array<double>, y array<double>")
        got = {r["held"]: r for r in models.collect()}  # one row a model, of bounded size
        weights.append(np.array(got[_EVERY]["weights"]))
        unseen, y = sum(np.array(got[f]["p"]) for f in range(FOLDS)), np.array(got[_EVERY]["y"])
        odds.append(_log_odds(unseen))
    discard(rows, counted, matrix)
    return Chain(list(CATEGORIES), every.chosen, weights, best_threshold(unseen, y))


def judge(docs: DataFrame, chain: Chain, text: str = "text", threshold: float | None = None) -> DataFrame:
    """All columns of docs, and a double p_<category> for each category and the boolean is_toxic; those names are replaced."""
    threshold = chain.threshold if threshold is None else threshold
    new = [*(f"p_{c}" for c in CATEGORIES), "is_toxic"]
    docs = docs.drop(*new)
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    names = [f"c{k}" for k in range(len(docs.columns))]  # any name goes through Arrow by its place
    at = docs.columns.index(text)
    schema = StructType([*(StructField(n, f.dataType) for n, f in zip(names, docs.schema)), *(StructField(c, DoubleType()) for c in new[:-1]), StructField("is_toxic", BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, names[at]):
                p = np.zeros((part.num_rows, len(CATEGORIES)))
                if shared.value.weights:
                    p = shared.value.predict(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(np.ascontiguousarray(x)) for x in p.T), pa.array(p[:, -1] >= threshold)], [*names, *new])

    return docs.toDF(*names).mapInArrow(run, schema).toDF(*docs.columns, *new)


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that aren't toxic, with the columns of docs."""
    return judge(docs, train(docs, labels)).where(~F.col("is_toxic")).select(*all_of(docs))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.select("doc_id", "text")
    return judge(docs, train(docs, labels)).drop("text")
