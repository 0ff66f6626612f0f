"""Exact dedup by composable polynomial fingerprints and a chunkwise comparison.

Texts are equal when identical after each run of `[\\x20\\x09-\\x0D]` becomes one space; null counts as empty. A text's fingerprint is its
polynomial modulo two 31-bit primes and its length. It is put together from the fingerprints of its chunks, which numpy computes side by side:
of two neighbours the left one is shifted by the right one's length, so no step needs the whole of a huge text at once.

Equal fingerprints make a group; its smallest doc_id leads. Every other member's normalised text is then compared with the leader's,
chunk by chunk, in an ordinary join on leader and chunk number that is salted by the group's size. Members that differ
form groups of their own in another round, until none differs. So whether two texts are equal never rests on the fingerprint.

Rows are known by a mark, 128 bits of a sha256 of id and unchanged text, never by the id: rows with null or repeated ids are compared like any other. Rows of one mark
have one text; they travel once and count each. Every row of the input has a row in the result, and of each group one row is kept: that of the smallest doc_id, a null one
only where no row has any, of the smallest mark where ids are equal. Empty and null texts are equal. A very long text is hashed in slices and compared in chunks; the
text itself is all that has to fit. Only the id and the text are read, so other columns may have any name and type.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import all_of, cut, discard, named, one_of_each, repeat_rows, row_mark, slices

PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (1_315_423_911, 1_640_531_527)
CHUNK = 4_096  #: bytes hashed at once; 2**12 bytes of 8 bits by 31-bit powers stay below 64 bits
COMPARED = 1 << 16  #: bytes of a text compared in one row
GROUP_SLICE = 256  #: members that share a copy of their leader

_SPACE = frozenset(b" \t\n\v\f\r")


def normalise(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return raw
    return b" " * (raw[0] in _SPACE) + b" ".join(raw.split()) + b" " * (raw[-1] in _SPACE and not raw.isspace())


@dataclass(frozen=True)
class Fingerprint:
    length: int = 0
    values: tuple[int, ...] = (0,) * len(PRIMES)

    def __add__(self, right: Fingerprint) -> Fingerprint:
        """That of the text of self followed by right's."""
        return Fingerprint(self.length + right.length, tuple((a * pow(b, right.length, p) + c) % p for a, c, b, p in zip(self.values, right.values, BASES, PRIMES)))

    @property
    def packed(self) -> int:
        return self.values[0] << 31 | self.values[1]


def _powers() -> np.ndarray:
    return np.array([[pow(b, CHUNK - 1 - i, p) for i in range(CHUNK)] for b, p in zip(BASES, PRIMES)], np.uint64)


_POWERS = _powers()


def fingerprints(texts: list[bytes]) -> list[Fingerprint]:
    out = []
    for text in texts:
        data = np.frombuffer(text, np.uint8)
        whole = len(data) // CHUNK
        parts = [(CHUNK, data[: whole * CHUNK].reshape(whole, CHUNK))] if whole else []
        if len(data) % CHUNK:
            parts.append((len(data) % CHUNK, data[whole * CHUNK :].reshape(1, -1)))
        total = Fingerprint()
        for n, rows in parts:
            for at in range(0, len(rows), 64):
                block = rows[at : at + 64].astype(np.uint64) + np.uint64(1)
                values = [(block @ w[CHUNK - n :]) % np.uint64(p) for w, p in zip(_POWERS, PRIMES)]
                for v in zip(*(x.tolist() for x in values)):
                    total += Fingerprint(n, v)
        out.append(total)
    return out


def _marked(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(row_mark(key, text).alias("mark"), named(key).alias("doc_id"), named(text).cast("string").alias("text"))


def _scan(rows: DataFrame) -> DataFrame:
    """mark, doc_id, fingerprint, length and sha256 of each row's normalised text."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [normalise(t) for t in part.column("text").to_pylist()]
                prints = fingerprints(texts)
                columns = [part.column("mark"), part.column("doc_id"), pa.array([f.packed for f in prints], pa.int64()), pa.array(list(map(len, texts)), pa.int64()), pa.array([sha256(t).hexdigest() for t in texts], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["mark", "doc_id", "print", "n_bytes", "text_sha256"])

    return rows.mapInArrow(run, f"mark binary, doc_id {kind}, print long, n_bytes long, text_sha256 string")


def _chunks(rows: DataFrame, members: DataFrame) -> DataFrame:
    """The normalised texts of members, a row for each chunk. An empty text has one empty chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [normalise(t) for t in part.column("text").to_pylist()]
                found = [(i, at // COMPARED, t[at : at + COMPARED]) for i, t in enumerate(texts) for at in range(0, max(1, len(t)), COMPARED)]
                took = part.select(["mark", "leader", "n_marks"]).take(pa.array([r[0] for r in found], pa.int64()))
                yield pa.RecordBatch.from_arrays([*took.columns, pa.array([r[1] for r in found], pa.int64()), pa.array([r[2] for r in found], pa.binary())], ["mark", "leader", "n_marks", "chunk_no", "chunk"])

    wanted = members.select("mark", F.col("leader.mark").alias("leader"), "n_marks")
    return rows.select("mark", "text").join(wanted.hint("shuffle_hash"), "mark").mapInArrow(run, "mark binary, leader binary, n_marks long, chunk_no long, chunk binary")


def _differing(rows: DataFrame, members: DataFrame) -> DataFrame:
    """The members whose text isn't their leader's."""
    chunks = cut(_chunks(rows, members), "chunks")  # made once, read from both sides
    shares = F.ceil(F.col("n_marks") / GROUP_SLICE).cast("long")
    leaders = chunks.where(F.col("mark") == F.col("leader")).groupBy("leader", "chunk_no", "n_marks").agg(F.first("chunk").alias("leading"))
    leaders = leaders.select("leader", "chunk_no", "leading", F.explode(F.sequence(F.lit(0).cast("long"), shares - 1)).alias("share"))
    others = chunks.where(F.col("mark") != F.col("leader")).withColumn("share", F.pmod(F.xxhash64("mark"), shares))
    bad = others.join(leaders, ["leader", "chunk_no", "share"], "left").where(~F.col("chunk").eqNullSafe(F.col("leading"))).select("mark").distinct()
    found = cut(members.select("mark", "doc_id", "print", "n_bytes", "text_sha256", "n_rows").join(bad, "mark", "left_semi"), "differing")
    discard(chunks)
    return found


def _classes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """mark, doc_id, leader (lost, doc_id, mark), group_size, text_sha256 and n_rows of each mark."""
    rows = _marked(docs, key, text)
    once = [F.first(c).alias(c) for c in ("doc_id", "print", "n_bytes", "text_sha256")]
    left = cut(_scan(rows).groupBy("mark").agg(*once, F.count("*").alias("n_rows")), "prints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", "mark")).alias("leader")
    group = lambda of: of.groupBy("print", "n_bytes").agg(first, F.sum("n_rows").alias("group_size"), F.count("*").alias("n_marks"))
    done = None
    while True:
        groups = cut(group(left), "groups")
        members = left.join(groups.where("n_marks > 1"), ["print", "n_bytes"])
        bad = _differing(rows, members)
        again = not bad.isEmpty()
        if again:
            left = left.join(bad.select("mark"), "mark", "left_anti")
            groups = group(left)
        part = left.join(groups, ["print", "n_bytes"]).select("mark", "doc_id", "leader", "group_size", "text_sha256", "n_rows")
        done = part if done is None else done.unionByName(part)
        if not again:
            return done
        left = bad


def exact_classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, keep_id (doc_id of the one that stays), group_size, kept and text_sha256 of every row."""
    rows = repeat_rows(_classes(docs, key, text), "n_rows", "nth")
    kept = (F.col("mark") == F.col("leader.mark")) & (F.col("nth") == 0)
    return rows.select("doc_id", F.col("leader.doc_id").alias("keep_id"), "group_size", kept.alias("kept"), "text_sha256")


def keep_documents(docs: DataFrame) -> DataFrame:
    """One row of each group of equal texts, with the columns of docs."""
    stays = cut(_classes(docs, "doc_id", "text").where(F.col("mark") == F.col("leader.mark")).select(F.col("mark").alias("__mark"), "n_rows"), "stays")
    rows = docs.withColumn("__mark", row_mark("doc_id", "text"))
    of = lambda which: rows.join(stays.where(which).select("__mark").hint("shuffle_hash"), "__mark", "left_semi")
    alone = of("n_rows = 1").select(*all_of(docs))
    if stays.where("n_rows > 1").isEmpty():
        return alone
    return alone.unionByName(one_of_each(of("n_rows > 1"), "__mark", docs.columns))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = """
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
    doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM n
"""
