"""Language-model scoring with a log-frequency Bloom filter.

Tokens are words `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased, then one end for each text. The model learns from the rows that it is given: exact counts of tokens, kept as a table, and counts of
pairs of neighbours, kept in a Bloom filter. A pair of count c has the level 1 + floor(log c / log BASE), and the filter holds the pair with each number up to its level. Reading is by
repeated membership probes: a pair is asked for with 1, 2, ... until the filter says no, and counts as the least number of the last level that it has; a false
yes (about one in 100 for a pair that isn't there) can only raise a level. The probability of a token w behind v is

    (1 - a) * base(w) + a * min(count(v w), count(v), count(w)) / count(v),    a = MOST * count(v) / (count(v) + PRIOR)

with base(w) = (count(w) + 0.1) / (all tokens + 0.1 * (distinct tokens + 1)). Levels round down, so the probabilities of all w behind a v come to one at most, false answers aside.

What is learned grows with the corpus, so nothing of it is assumed to be small. The filter is made of shards of bounded size, each in a task. While all shards stay below `limit`, which is checked,
they are broadcast to the workers; beyond it the pairs of each block of documents, each once, go to the shards, are probed there, and the levels come back: the same answers. Token counts
always come that way, by a join of each block's distinct words. A block holds BLOCK bytes of text, or one longer text.

A null text is empty: its one token is the end. A row with a null id counts as held out. Repeated rows are scored alike, and travel once for each batch. Only the id and the text are read, so other columns may have
any name. Without anything to learn from, base is 1 for each token, and so is the model. Very long texts are taken apart in pieces.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import cut, repeat_rows, slices
from .words import split_words

BASE = 1.5  #: of the logarithm that counts are quantised by
LEVELS = [int(np.ceil(BASE**k)) for k in range(64)]  #: the least count of level k + 1
BITS = 12  #: of the filter, for each pair and level
PROBES = 5  #: bits that a pair and level sets
MOST, PRIOR = 0.3, 5.0  #: the weight of pairs, at most, and the count of a history at which it is half of that
SHARD = 1 << 20  #: pairs of a shard, about, repeats between batches counted
LIMIT = 1 << 27  #: bytes of a filter that is broadcast
BLOCK = 1 << 24  #: bytes of text of a block, about
BATCH = 1 << 18  #: tokens whose pairs are counted or scored together
WORDS = 1 << 17  #: distinct words held while counting
END, START = b"", b" "  #: no word is empty or has a space

_LOWER = bytes(range(256)).lower().translate(bytes(32 if 9 <= b <= 13 else b for b in range(256)))
_U = np.uint64


def tokens(text: str | None) -> Iterator[list[bytes]]:
    last: list[bytes] = []
    for words in split_words((text or "").encode("utf-8", "surrogatepass"), _LOWER):
        if last:
            yield last
        last = words
    yield [*last, END]


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words that differ, all at once; those of _Hashes."""
    return np.frombuffer(b"".join([blake2b(w, digest_size=8).digest() for w in words]), "<u8").astype(np.uint64)


class _Hashes(dict):
    """64-bit hashes of words, each made once."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > WORDS:
            self.clear()
        self[word] = out = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def pairs(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hashes of pairs from the hashes of their words."""
    return _mixed(first * _U(0x9E3779B97F4A7C15) + second)


def _distinct(x: np.ndarray) -> np.ndarray:
    """The different values, sorted; with counts numpy sorts, which takes it a fraction of the time of its hash table."""
    return np.unique(x, return_counts=True)[0]


def levels(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(np.array(LEVELS), counts, "right")


class Filter:
    """A log-frequency Bloom filter of shards; all the bits of a pair and level are in one word of 64 bits."""

    def __init__(self, shards: int, sizes: dict[int, int], words: np.ndarray | None = None) -> None:
        self.shards = shards
        self.size = np.ones(shards, np.uint64)
        for s, n in sizes.items():
            self.size[s] = n
        present = np.zeros(shards, np.int64)
        for s, n in sizes.items():
            present[s] = n
        self.start = np.cumsum(present) - present
        self.known = present > 0
        self.words = np.zeros(int(present.sum()), np.uint64) if words is None else words

    def _places(self, pair: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        shard = (pair % _U(self.shards)).astype(np.int64)
        h = _mixed(pair + _U(level * 0x9E3779B97F4A7C15 % (1 << 64)))
        mask = np.zeros(len(pair), np.uint64)
        for i in range(PROBES):
            mask |= _U(1) << ((h >> _U(6 * i)) & _U(63))
        return self.start[shard] + ((h >> _U(31)) % self.size[shard]).astype(np.int64), mask

    def add(self, pair: np.ndarray, count: np.ndarray) -> None:
        level = levels(count)
        for k in range(1, int(level.max(initial=0)) + 1):
            np.bitwise_or.at(self.words, *self._places(pair[level >= k], k))

    def levels(self, pair: np.ndarray) -> np.ndarray:
        """The level of each pair, by asking for one level after another until one isn't there."""
        out = np.zeros(len(pair), np.int64)
        left = np.flatnonzero(self.known[(pair % _U(self.shards)).astype(np.int64)])
        for k in range(1, len(LEVELS)):
            if not len(left):
                break
            at, mask = self._places(pair[left], k)
            left = left[(self.words[at] & mask) == mask]
            out[left] = k
        return out


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))


def held_out(key: str = "doc_id") -> Column:
    """A tenth of the ids; rows without an id as well."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 10 == 0


def count_words(texts: DataFrame) -> DataFrame:
    """word and c of every token; the end is an empty word."""

    def table(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for part in slices(batch, "text"):
                for text in part.column("text").to_pylist():
                    for words in tokens(text):
                        counts.update(words)
                        if len(counts) > WORDS:
                            yield table(counts)
                            counts = Counter()
        yield table(counts)

    return texts.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _pair_hashes(text: str | None, hashes: _Hashes) -> Iterator[np.ndarray]:
    last = hashes[START]
    for words in tokens(text):
        own = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
        yield pairs(np.concatenate((np.array([last], np.uint64), own[:-1])), own)
        last = own[-1]


def count_pairs(texts: DataFrame, shards: int) -> DataFrame:
    """shard, and pairs (64 bits each) with their counts c (32 bits each), packed: a batch gives one row for each shard. A pair can be in several rows, from different batches."""

    def packed(values: np.ndarray, starts: np.ndarray) -> pa.Array:
        ends = np.append(starts, len(values)) * values.itemsize
        return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(values)])

    def table(found: list[np.ndarray]) -> pa.RecordBatch:
        pair, c = np.unique(np.concatenate(found), return_counts=True)
        shard = (pair % _U(shards)).astype(np.uint16 if shards <= 1 << 16 else np.int32)  # numpy sorts 16 bits by radix
        order = np.argsort(shard, kind="stable")
        shard = shard[order].astype(np.int32)
        starts = np.flatnonzero(np.diff(shard, prepend=-1))
        return pa.RecordBatch.from_arrays([pa.array(shard[starts]), packed(pair[order], starts), packed(c.astype(np.int32)[order], starts)], ["shard", "pairs", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, found, n = _Hashes(), [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                for text in part.column("text").to_pylist():
                    for own in _pair_hashes(text, hashes):
                        found.append(own)
                        n += len(own)
                        if n > BATCH:
                            yield table(found)
                            found, n = [], 0
        if found:
            yield table(found)

    return texts.select("text").mapInArrow(run, "shard int, pairs binary, c binary")


def build_filter(texts: DataFrame, shards: int) -> DataFrame:
    """shard, size (in words of 64 bits) and the words of each shard that has pairs."""

    def unpacked(rows: pa.Table, column: str, kind: type) -> np.ndarray:
        return np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in rows.column(column)])

    def run(rows: pa.Table) -> pa.Table:
        shard = rows.column("shard")[0].as_py()
        pair, at = np.unique(unpacked(rows, "pairs", np.uint64), return_inverse=True)
        count = np.bincount(at, unpacked(rows, "c", np.int32)).astype(np.int64)
        size = -(-int(levels(count).sum()) * BITS // 64)
        built = Filter(shards, {shard: size})
        built.add(pair, count)
        return pa.table({"shard": pa.array([shard], pa.int32()), "size": pa.array([size], pa.int64()), "words": pa.array([built.words.tobytes()], pa.binary())})

    return count_pairs(texts, shards).groupBy("shard").applyInArrow(run, "shard int, size long, words binary")


def _dealt(rows: DataFrame, blocks: int) -> DataFrame:
    """block, doc_id, text and copies; rows that repeat within a batch become one."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                seen = Counter(zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()))
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], part.schema.field("doc_id").type), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["doc_id", "text", "copies"])

    return rows.mapInArrow(run, f"doc_id {kind}, text string, copies long").withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))


def _words_of(rows: pa.Table) -> pa.Table:
    found: set[bytes] = set()
    for text in rows.column("text"):
        for words in tokens(text.as_py()):
            found.update(words)
    found.add(END)
    return pa.table({"block": pa.array([rows.column("block")[0].as_py()] * len(found), pa.int64()), "word": pa.array(list(found), pa.binary())})


def _pairs_of(rows: pa.Table, shards: int) -> pa.Table:
    hashes, found = _Hashes(), [np.zeros(0, np.uint64)]
    for text in rows.column("text"):
        found += [_distinct(x) for x in _pair_hashes(text.as_py(), hashes)]
    pair = _distinct(np.concatenate(found))
    block = np.full(len(pair), rows.column("block")[0].as_py(), np.int64)
    return pa.table({"block": block, "shard": (pair % _U(shards)).astype(np.int32), "pair": pair.view(np.int64)})


def _probed(asked: pa.Table, shard: pa.Table, shards: int) -> pa.Table:
    level = np.zeros(asked.num_rows, np.int64)
    if asked.num_rows and shard.num_rows:
        own = Filter(shards, {shard.column("shard")[0].as_py(): shard.column("size")[0].as_py()}, np.frombuffer(shard.column("words")[0].as_py(), np.uint64))
        level = own.levels(asked.column("pair").to_numpy().view(np.uint64))
    some = level > 0
    return pa.table({"block": asked.column("block").to_numpy()[some], "pair": asked.column("pair").to_numpy()[some], "level": level[some]})


class _Places(dict):
    """Where the count of a word stands; 0 is any word that training doesn't have."""

    def __missing__(self, word: bytes) -> int:
        return 0


class _Answers:
    """What a block has been told: counts of words, and levels of pairs where no filter is at hand. The last place stands for the start of a text."""

    def __init__(self, answers: pa.Table, filter: Filter | None) -> None:
        words, told = answers.filter(answers.column("word").is_valid()), answers.filter(answers.column("word").is_null())
        names = words.column("word").to_pylist()
        self.at = _Places({w: i + 1 for i, w in enumerate(names)})
        count = words.column("value").to_numpy()
        starts = count[names.index(END)] if END in self.at else 0  # each text that was learned from has one start and one end
        self.count = np.concatenate(([0], count, [starts])).astype(np.int64)
        self.hash = np.concatenate((np.zeros(1, np.uint64), word_hashes([*names, START])))
        self.filter = filter
        if filter is None:
            pair, level = told.column("pair").to_numpy().view(np.uint64), told.column("value").to_numpy()
            order = np.argsort(pair)
            self.pair, self.level = pair[order], level[order]

    def levels(self, pair: np.ndarray) -> np.ndarray:
        if self.filter is not None:
            return self.filter.levels(pair)
        if not len(self.pair):
            return np.zeros(len(pair), np.int64)
        at = np.minimum(np.searchsorted(self.pair, pair), len(self.pair) - 1)
        return np.where(self.pair[at] == pair, self.level[at], 0)


class _Sums:
    """Sums over the tokens of each text of a block, for many texts at once."""

    def __init__(self, told: _Answers, texts: int, total: int, distinct: int) -> None:
        self.told, self.base_of, self.least = told, (told.count + 0.1) / (total + 0.1 * (distinct + 1)), np.array([0, *LEVELS])
        self.n, self.known = np.zeros(texts, np.int64), np.zeros(texts, np.int64)
        self.base, self.score = np.zeros(texts), np.zeros(texts)
        self.held: list[tuple[int, np.ndarray]] = []
        self.tokens, self.last = 0, (-1, 0)  # the last text, and the place of its last token

    def add(self, text: int, words: list[bytes]) -> None:
        self.held.append((text, np.fromiter(map(self.told.at.__getitem__, words), np.int64, len(words))))
        self.tokens += len(words)
        if self.tokens > BATCH:
            self.flush()

    def flush(self) -> None:
        if not self.tokens:
            return
        told, at = self.told, np.concatenate([x for _, x in self.held])
        text = np.repeat([t for t, _ in self.held], [len(x) for _, x in self.held])
        before = np.concatenate(([self.last[1]], at[:-1]))
        before[np.concatenate(([text[0] != self.last[0]], text[1:] != text[:-1]))] = len(told.count) - 1
        self.held, self.tokens, self.last = [], 0, (int(text[-1]), int(at[-1]))
        count, history = told.count[at], told.count[before]
        base = self.base_of[at]
        probability = base.copy()
        ask = np.flatnonzero((history > 0) & (count > 0))
        seen = history[ask]
        both = np.minimum(self.least[told.levels(pairs(told.hash[before[ask]], told.hash[at[ask]]))], np.minimum(seen, count[ask]))
        probability[ask] += MOST * seen / (seen + PRIOR) * (both / seen - probability[ask])
        first, size = int(text[0]), int(text[-1] - text[0]) + 1
        own = slice(first, first + size)
        for sums, values in ((self.n, None), (self.known, count > 0), (self.base, np.log10(base)), (self.score, np.log10(probability))):
            sums[own] += np.bincount(text - first, values, size).astype(sums.dtype)


def _scores(rows: pa.Table, told: _Answers, total: int, distinct: int) -> pa.Table:
    sums = _Sums(told, rows.num_rows, total, distinct)
    for k, text in enumerate(rows.column("text")):
        for words in tokens(text.as_py()):
            sums.add(k, words)
    sums.flush()
    found = [("n_tokens", sums.n), ("n_known", sums.known), ("train_tokens", np.full(rows.num_rows, total)), ("base_score", sums.base), ("score", sums.score)]
    return pa.table({"doc_id": rows.column("doc_id"), "copies": rows.column("copies"), **{n: pa.array(x) for n, x in found}})


def score(docs: DataFrame, learned: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of each row of docs, by a model of the rows learned."""
    spark = docs.sparkSession
    texts, rows = _rows(learned, key, text), _rows(docs, key, text)
    counts = cut(count_words(texts), "words")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    shards = max(1, -(-total // SHARD))
    filters = cut(build_filter(texts, shards), "filter")
    held = filters.agg(F.coalesce(F.sum("size"), F.lit(0)) * 8).first()[0]
    blocks = max(1, -(-rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] // BLOCK))
    dealt = _dealt(rows, blocks)
    asked = dealt.groupBy("block").applyInArrow(_words_of, "block long, word binary")
    answers = asked.join(counts.hint("shuffle_merge"), "word").select("block", "word", F.lit(None).cast("long").alias("pair"), F.col("c").alias("value"))
    sent = None
    if held <= limit:
        parts = {r["shard"]: (r["size"], bytes(r["words"])) for r in filters.toLocalIterator()}
        sent = spark.sparkContext.broadcast((shards, {s: parts[s][0] for s in sorted(parts)}, np.frombuffer(b"".join(parts[s][1] for s in sorted(parts)), np.uint64)))
        del parts
    else:
        wanted = dealt.groupBy("block").applyInArrow(lambda rows: _pairs_of(rows, shards), "block long, shard int, pair long")
        found = wanted.groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(lambda a, b: _probed(a, b, shards), "block long, pair long, level long")
        answers = answers.unionByName(found.select("block", F.lit(None).cast("binary").alias("word"), "pair", F.col("level").alias("value")))

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        return _scores(rows, _Answers(answers, Filter(*sent.value) if sent else None), total, distinct)

    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, f"doc_id {kind}, copies long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return repeat_rows(scored, "copies", "copy").drop("copy")


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score(docs, docs.where(~held_out()))
    return scored.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
