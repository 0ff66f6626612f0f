"""Importance resampling towards a target distribution, with an exact top-k by distributed radix selection.

Words are runs of 0-9, A-Z, a-z and characters beyond ASCII, with A-Z lower-cased; features are runs of 1 to `grams` consecutive words, joined by one space; a
feature's bucket is the crc32 of its UTF-8 bytes modulo `buckets`. One pass over the texts writes the buckets of each document as a packed array. Counts per bucket, of fixed
number, give each bucket's gain, and a document's weight is the sum of an array of gains at its buckets. The score adds Gumbel noise that a hash of the id draws, so taking
the highest scores is sampling without replacement in proportion to exp(weight).

The k-th highest score is found exactly by radix selection: the order (score falling, doc_id rising and null last, number of features) is laid out as whole numbers from 0, whose
digits are counted from the first on, each time among the documents whose earlier digits are the k-th key's. Each pass sends one count for a digit to the driver. Only documents up to the k-th key are
range-sorted and ranked, by running totals over the sorted partitions; documents of one key are interchangeable, and go through that as one row with a count.

A null text has no words. With a null id the noise is that of an empty id. Repeated rows are documents of their own. Ids are whole numbers. A document's weight is below 64 bits for any text, and its
memory is bounded but for the text itself. An empty target or corpus leaves smoothed counts. Only the id and the text are read, so other columns may have any name.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.windows import running_total
from .storage import cut, discard, repeat_rows, slices
from .words import split_words

BUCKETS = 10_000
SEED = "2024"
LEAST_WORDS = 20
DRAWN = 10  #: of 100 documents with enough words
DIGIT = 12  #: bits of a digit: a pass sends 2**DIGIT counts at most

_WORD = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in bytes(range(256)).lower())


def features(text: str | None, grams: int = 1, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """The number of words, and the bucket of every feature."""
    n, found, open_runs = 0, [], []  # open_runs: crc32 of the runs that end at the last word, the longest first
    for words in split_words((text or "").encode("utf-8", "surrogatepass"), _WORD):
        n += len(words)
        if grams == 1:
            found.append(np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % np.uint32(buckets))
            continue
        crcs = []
        for word in words:
            open_runs = [zlib.crc32(word, zlib.crc32(b" ", run)) for run in open_runs[-(grams - 1) :]] + [zlib.crc32(word)]
            crcs += open_runs
        found.append(np.array(crcs, np.uint32) % np.uint32(buckets))
    return n, np.concatenate(found) if found else np.zeros(0, np.uint32)


def _kind(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def bucketed(docs: DataFrame, grams: int, buckets: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words and the packed buckets of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = [features(t, grams, buckets) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1].astype(_kind(buckets)).tobytes() for f in found], pa.binary())], ["doc_id", "n_words", "packed"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_words long, packed binary")


def bucket_counts(rows: DataFrame, buckets: int) -> np.ndarray:
    """How many features of all rows are in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for packed in batch.column("packed"):
                total += np.bincount(np.frombuffer(packed.as_buffer(), _kind(buckets)), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    counts = rows.select("packed").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(buckets, np.int64)
    out[counts["bucket"].to_numpy(int)] = counts["n"].to_numpy(int)
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of how much likelier the target is to draw each bucket, counts smoothed by one."""
    s, t, b = int(corpus.sum()), int(target.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log((int(y) + 1) * (s + b) / ((int(x) + 1) * (t + b)))) for x, y in zip(corpus, target)], np.int64)


def _weights(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight of each row; gain is of fixed length."""
    kind = _kind(len(gain))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [np.frombuffer(p.as_buffer(), kind) for p in batch.column("packed")]
            columns = [batch.column("doc_id"), batch.column("n_words"), pa.array(list(map(len, packed)), pa.int64()), pa.array([int(gain[p].sum()) for p in packed], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "weight"])

    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def _noise(seed: str) -> Column:
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((drawn + 0.5) / 4294967296.0)))


def kth_key(rows: DataFrame, parts: list[Column], k: int) -> tuple[list[int], int, int]:
    """The k-th smallest of tuples of whole numbers from 0 (columns never null), how many rows have smaller ones, and how many have it: by radix selection.

    A pass counts one digit; it ends when a single row has the digits found so far. At least k rows must be there, and k be at least 1.
    """
    rows = rows.select(*[p.alias(f"p{i}") for i, p in enumerate(parts)])
    most = rows.agg(*[F.max(f"p{i}") for i in range(len(parts))]).first()
    found: list[int] = []
    fits, smaller, equal = F.lit(True), 0, 0
    for i, top in enumerate(most):
        value, column = 0, F.col(f"p{i}")
        for low in range((max(1, top.bit_length()) - 1) // DIGIT * DIGIT, -1, -DIGIT):
            digit = F.shiftright(column, low).bitwiseAND((1 << DIGIT) - 1).alias("digit")
            for d, n in sorted(tuple(r) for r in rows.where(fits).groupBy(digit).count().collect()):
                if smaller + n >= k:
                    break
                smaller += n
            value, equal = value | d << low, n
            fits = fits & (F.shiftright(column, low) == value >> low)
            if equal == 1:  # one row has these digits
                return list(rows.where(fits).first()), smaller, 1
        found.append(value)
    return found, smaller, equal


def draw(docs: DataFrame, target: DataFrame, percent: int = DRAWN, grams: int = 1, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, seed: str = SEED, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score and rank (null if not drawn) of every row of docs; target is texts in a column of the same name."""
    packed = cut(bucketed(docs, grams, buckets, key, text), "packed")
    aim = bucketed(target.select(F.lit(None).cast("long").alias("doc_id"), text), grams, buckets, "doc_id", text)
    gain = gains(bucket_counts(packed, buckets), bucket_counts(aim, buckets))
    scored = cut(_weights(packed, gain).withColumn("score", F.col("weight") + _noise(seed)), "scored")
    discard(packed)
    enough = F.col("n_words") >= least_words
    n, best, least_id, last_id = scored.where(enough).agg(F.count("*"), F.max("score"), F.min("doc_id"), F.max("doc_id")).first()
    k, shown = percent * n // 100, ["doc_id", "n_features", "weight", "score"]
    if not k:
        return scored.select(*shown, F.lit(None).cast("long").alias("rank"))
    least_id, last_id = least_id or 0, last_id or 0
    parts = [F.lit(best) - F.col("score"), *_id_parts(least_id, last_id), F.col("n_features")]
    last, smaller, _ = kth_key(scored.where(enough), parts, k)
    upto, before = F.lit(False), F.lit(True)
    for part, value in zip(parts, last):
        upto, before = upto | (before & (part < value)), before & (part == value)
    taken = enough & (upto | before)
    groups = scored.where(taken).groupBy(*shown).agg(F.count("*").alias("copies"))
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features")]
    ranked = running_total(groups, order, F.col("copies"), "earlier")
    rank = F.col("earlier") + F.col("copy") + 1
    drawn = repeat_rows(ranked, "copies", "copy").select(*shown, F.when(rank <= k, rank).alias("rank"))
    return scored.where(~taken).select(*shown, F.lit(None).cast("long").alias("rank")).unionByName(drawn)


def _id_parts(least: int, last: int) -> list[Column]:
    """Ids as whole numbers from 0 that keep the order, null last: the upper and the lower 32 bits above the least id, as differences may have 64 bits."""
    upper, lower = F.shiftright("doc_id", 32), F.col("doc_id").bitwiseAND(0xFFFF_FFFF)
    return [F.coalesce(upper - (least >> 32), F.lit((last >> 32) - (least >> 32) + 1)), F.coalesce(lower, F.lit(0).cast("long"))]


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return draw(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: The crc32 bit by bit, as DuckDB has no such function; h is the hexadecimal form of the bytes.
_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(h) // 2), lambda i: CAST(CAST('0x' || substr(h, CAST(2 * i + 1 AS INTEGER), 2) AS INTEGER) AS BIGINT))),
    lambda c, byte: list_reduce(list_prepend(xor(c, byte), range(8)), lambda k, i: CASE WHEN k & 1 = 1 THEN xor(k >> 1, 3988292384::BIGINT) ELSE k >> 1 END)), 4294967295::BIGINT)"""

ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
dw AS (SELECT r, w, count(*) AS n FROM (SELECT r, unnest(ws) AS w FROM d) GROUP BY r, w),
bw AS (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM benchmark) GROUP BY w),
hexes AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
crc AS (SELECT w, {_CRC32} % {BUCKETS} AS b FROM hexes),
sc AS (SELECT b, sum(n) AS s FROM dw JOIN crc USING (w) GROUP BY b), tc AS (SELECT b, sum(n) AS t FROM bw JOIN crc USING (w) GROUP BY b),
gain AS (SELECT b, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM sc) + {BUCKETS}) / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM tc) + {BUCKETS})))) AS BIGINT) AS g FROM sc FULL JOIN tc USING (b)),
weights AS (SELECT r, CAST(sum(n * g) AS BIGINT) AS weight FROM dw JOIN crc USING (w) JOIN gain USING (b) GROUP BY r),
s AS (SELECT doc_id, r, CAST(len(ws) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN weights USING (r)),
o AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS k, count(*) OVER () AS n FROM s WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN k <= {DRAWN} * n // 100 THEN k END AS rank FROM s LEFT JOIN o USING (r)
"""
