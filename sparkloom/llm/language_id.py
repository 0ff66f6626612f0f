"""Language ID: multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased, every run of other characters becomes one space, and each n-gram of one to four characters falls into
one of 2**BITS buckets. A model is a matrix of log probabilities, bucket by language, and log priors. It is broadcast; its size is bounded, as it
takes 256 kB a language and a table with more than MAX_LANGUAGES labels is an error. Texts are scored whole, many at once: the bucket
numbers of some texts are the column numbers of a sparse matrix with a row for each text, and its product with the log-probability matrix is a
gather and a segmented sum, of at most about TERMS numbers at a time. A text with more n-grams than that, or of more than PIECE characters, is folded and
counted piece by piece, and its bucket counts are multiplied with the matrix, so what a task holds besides the texts grows neither with a text's
length nor with the number of languages.

Learning uses a bounded sample: of each language, about PER_LANGUAGE labelled texts and never more than twice as many, chosen by a hash of
their id. The bound makes the cost of learning independent of the corpus; counting labels and predicting cover every row.

A null text, or one without letters, is `und` with a score of 0, as is every text if no labelled text exists. Equal scores go to the
language first in code-point order. Repeated rows give repeated rows. Kept columns named lang_pred or score are replaced by the operator's own.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import slices

BITS = 15
SIZES = (1, 2, 3, 4)
PER_LANGUAGE = 2_000  #: labelled texts of each language to learn from, about
MAX_LANGUAGES = 2_048  #: labels; more of them are no languages
SMOOTHING = 0.5
PIECE = 1 << 18  #: characters of a long text folded at once
TERMS = 1 << 21  #: log probabilities gathered at once


_CLOSING = np.full(max(SIZES), 32, np.uint32)


@dataclass
class Model:
    languages: list[str]
    log_prior: np.ndarray
    log_prob: np.ndarray  #: bucket by language


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def _folded(text: str) -> np.ndarray:
    """The code points of a text's letters, lower-cased, with one space for each run of others and as many at the end as keep texts apart."""
    parts = list(_folded_pieces(text))
    return _closed(np.concatenate(parts)) if parts else np.zeros(0, np.uint32)


def _closed(codes: np.ndarray) -> np.ndarray:
    """Codes with a space behind the last letter and as many more as its n-grams reach over."""
    return np.concatenate((codes, _CLOSING[int(codes[-1] == 32) :]))


def _folded_pieces(text: str) -> Iterator[np.ndarray]:
    """The same piece by piece and without the end; nothing of a text without letters."""
    held: list[np.ndarray] = []
    any_letter, before = False, True  # a text that begins with another character begins with a space
    for at in range(0, len(text), PIECE):
        codes = np.frombuffer(text[at : at + PIECE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letters = _letters()[codes]
        keep = letters.copy()
        keep[1:] |= letters[:-1]
        keep[:1] |= before
        before = bool(letters[-1])
        held.append(np.where(letters, codes, np.uint32(32))[keep])
        any_letter |= bool(letters.any())
        if any_letter:
            yield from held
            held = []


def _hashed(codes: np.ndarray) -> np.ndarray:
    """The buckets of the n-grams, by size, that start at each code but the last ones, behind which the longest wouldn't fit."""
    n = len(codes) - max(SIZES) + 1
    out = np.empty((max(0, n), len(SIZES)), np.uint32)
    h, k = np.zeros(max(0, n), np.uint32), 0
    for size in range(1, max(SIZES) + 1):
        h = (h ^ codes[size - 1 : size - 1 + len(h)]) * np.uint32(0x01000193) + np.uint32(size)
        if size in SIZES:
            x = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            out[:, k] = (x ^ (x >> np.uint32(13))) & np.uint32((1 << BITS) - 1)
            k += 1
    return out


def buckets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every n-gram, text by text, and how many n-grams each text has (0 without letters)."""
    folded = [_folded(t) if t else np.zeros(0, np.uint32) for t in texts]
    lengths = np.fromiter(map(len, folded), np.int64, len(folded))
    out = _hashed(np.concatenate((*folded, np.full(max(SIZES) - 1, 32, np.uint32))))
    own = np.ones(len(out), bool)  # an n-gram that starts behind the first closing space would reach into the next text
    for back in range(1, max(SIZES)):
        own[np.cumsum(lengths)[lengths > 0] - back] = False
    return out[own].ravel(), np.maximum(lengths - max(SIZES) + 1, 0) * len(SIZES)


def bucket_counts(text: str) -> np.ndarray:
    """How many n-grams of a text fall into each bucket, piece by piece."""
    out, carried = np.zeros(1 << BITS, np.int64), np.zeros(0, np.uint32)
    for piece in _folded_pieces(text):
        codes = np.concatenate((carried, piece))
        out += np.bincount(_hashed(codes).ravel(), minlength=1 << BITS)
        carried = codes[-(max(SIZES) - 1) :]
    if len(carried):
        out += np.bincount(_hashed(_closed(carried)).ravel(), minlength=1 << BITS)
    return out


def _sums(texts: list[str | None], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The sum of each text's log probabilities by language, and whether it has n-grams."""
    out, some = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts), bool)
    most = max(1, TERMS // max(1, len(model.languages)))
    short: list[int] = []
    room = most

    def done() -> None:
        ids, counts = buckets([texts[i] for i in short])
        own = np.array(short)[counts > 0]
        if len(own):
            some[own] = True
            if len(model.languages):
                out[own] = np.add.reduceat(model.log_prob[ids], (np.cumsum(counts) - counts)[counts > 0], axis=0)

    for i, text in enumerate(texts):
        n = (len(text) + max(SIZES)) * len(SIZES) if text else 0  # as many as it can have, about
        if n > min(most, PIECE * len(SIZES)):
            counts = bucket_counts(text)
            some[i] = counts.any()
            out[i] = counts @ model.log_prob
            continue
        if n > room:
            done()
            short, room = [], most
        short.append(i)
        room -= n
    if short:
        done()
    return out, some


def score(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray]:
    """Each text's language and the posterior probability of it."""
    sums, some = _sums(texts, model)
    best, prob = np.full(len(texts), -1), np.zeros(len(texts))
    if some.any() and model.languages:
        sums = sums[some] + model.log_prior
        best[some] = sums.argmax(axis=1)
        prob[some] = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
    return [model.languages[b] if b >= 0 else "und" for b in best.tolist()], prob


def train(labelled: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", per_language: int = PER_LANGUAGE) -> Model:
    """A model of the rows whose text and label aren't null."""
    labelled = labelled.where(F.col(text).isNotNull() & F.col(label).isNotNull())
    sizes = {r[0]: r[1] for r in labelled.groupBy(F.col(label)).count().limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"{label} has more than {MAX_LANGUAGES} values")
    if not sizes:
        return Model([], np.zeros(0), np.zeros((1 << BITS, 0)))
    share = F.create_map(*[F.lit(x) for l, n in sizes.items() for x in (l, min(1.0, per_language / n))])
    chosen = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("language-id")), F.lit(1 << 20)) < F.element_at(share, F.col(label)) * (1 << 20)
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h", F.xxhash64("text")))
    sample = labelled.where(chosen).select(F.col(text).cast("string").alias("text"), F.col(label).alias("lang"), F.xxhash64(F.col(key).cast("string"), F.lit("language-id")).alias("h"))
    sample = sample.withColumn("nth", nth).where(F.col("nth") <= 2 * per_language).select("text", "lang").repartition(8)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                    own = total.setdefault(lang, np.zeros(1 << BITS, np.int64))
                    own += bucket_counts(text)
        for lang, v in total.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(v[at])], ["lang", "bucket", "n"])

    rows = sample.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(sizes)
    counts = np.full((1 << BITS, len(languages)), SMOOTHING)
    counts[rows["bucket"].to_numpy(int), [languages.index(x) for x in rows["lang"]]] += rows["n"].to_numpy(float)
    total = np.array([sizes[x] for x in languages], float)
    return Model(languages, np.log(total / total.sum()), np.log(counts / counts.sum(axis=0)))


def predict(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep, lang_pred and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = tuple(c for c in keep if c not in ("lang_pred", "score"))
    docs = docs.select(*keep, F.col(text).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                languages, prob = score(part.column("__text").to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(languages, pa.string()), pa.array(prob)], [*keep, "lang_pred", "score"])

    return docs.mapInArrow(run, ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", lang_pred string, score double")


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id")))
    model = train(docs.where(F.col("doc_id").isNotNull() & ~F.col("held_out")))
    return predict(docs, model, keep=("doc_id", "held_out"))
