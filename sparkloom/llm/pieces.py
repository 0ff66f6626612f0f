"""SentencePiece encoding and decoding with the byte span of every piece.

The normaliser follows the model's own compiled character map: at each place the longest key in the map's double-array trie is
replaced by its value, else one character stays. Beside every normalised byte it records the source byte it came from, so pieces, which
tile the normalised text, project to spans of the original bytes: every text is normalised, and every piece's end is read off that record. An
empty map leaves all but spaces as they are, which numpy does at once.

Ids are those of the sentencepiece library. Where the model's pieces can't reach across a space or a line feed (checked on the vocabulary), the
ids of a text are those of its words one after another; words are encoded once by the library and kept in a bounded memory of
each worker (WORDS words, KEPT bytes of them, and none longer than LONGEST). Texts that hold U+2581 or U+0000 or a longer word and models of other kinds are
handed to the library whole. A model without byte fallback is an error, as its unknown pieces have no length of their own.

A null text counts as empty and has no ids. Texts are read whole, and a very long one is worked on by itself; repeated rows give repeated rows. Kept columns
named ids, ends or decoded are replaced by the operator's own.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import slices

SPACE = "▁"
_MARK = SPACE.encode()
WORDS = 300_000  #: words that a worker remembers
KEPT = 1 << 25  #: bytes of them
LONGEST = 1 << 12  #: characters of a word that is remembered


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = message[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(message):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(tag & 7) or varint()
            yield tag >> 3, message[at : at + n]
            at += n


class Normaliser:
    def __init__(self, spec: bytes) -> None:
        own = dict(_fields(spec))
        table = own.get(2, b"")
        self.dummy_prefix, self.trim, self.escape = (bool(own.get(k, 1)) for k in (3, 4, 5))
        size = int.from_bytes(table[:4], "little") if table else 0
        self.units = np.frombuffer(table[4 : 4 + size], "<u4").tolist()
        self.values = table[4 + size :]

    def _longest(self, raw: bytes, at: int) -> tuple[bytes, int] | None:
        """Value and length of the longest key that raw has at a place."""
        units, best, where = self.units, None, 0
        if not units:
            return None
        offset = lambda u: (u >> 10) << ((u & 512) >> 6)
        where ^= offset(units[0])
        for i in range(at, len(raw)):
            where ^= raw[i]
            if where >= len(units) or units[where] & 0x800000FF != raw[i]:
                break
            unit = units[where]
            where ^= offset(unit)
            if unit >> 8 & 1:
                best = units[where] & 0x7FFFFFFF, i + 1 - at
        return best and (self.values[best[0] : self.values.index(b"\0", best[0])], best[1])

    def __call__(self, raw: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and for each of them and the end the source byte it starts from."""
        if not self.units and not self.trim and self.escape:
            data = np.frombuffer(raw, np.uint8)
            if not len(data):
                return b"", np.zeros(1, np.int64)
            prefix = _MARK if self.dummy_prefix else b""
            kind = np.int32 if len(data) < 1 << 31 else np.int64
            at = np.repeat(np.arange(len(data), dtype=kind), np.where(data == 32, np.uint8(len(_MARK)), np.uint8(1)))
            return prefix + raw.replace(b" ", _MARK), np.concatenate((np.zeros(len(prefix), kind), at, np.array([len(data)], kind)))
        parts, at = [], 0
        while at < len(raw):
            got = self._longest(raw, at)
            if got is None:
                n = 1
                while at + n < len(raw) and raw[at + n] & 0xC0 == 0x80:
                    n += 1
                got = raw[at : at + n], n
            parts.append((got[0], at))
            at += got[1]
        if self.trim:
            while parts and parts[0][0] in (b" ", b""):
                parts.pop(0)
        out, source = bytearray(), []
        if parts and self.dummy_prefix:
            out += _MARK if self.escape else b" "
            source += [parts[0][1]] * (len(_MARK) if self.escape else 1)
        before = self.trim
        for value, start in parts:
            if self.trim and before:
                value = value.lstrip(b" ")
            if value:
                new = value.replace(b" ", _MARK) if self.escape else value
                out += new
                source += [start] * len(new)
                before = value.endswith(b" ")
        end, space = len(raw), _MARK if self.escape else b" "
        while self.trim and out.endswith(space):
            end = source[len(out) - len(space)]
            del out[len(out) - len(space) :]
            del source[len(out) :]
        return bytes(out), np.array([*source, end], np.int64)


class Codec:
    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            fields = list(_fields(f.read()))
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.normaliser = Normaliser(next((v for k, v in fields if k == 3), b""))
        n = self.library.get_piece_size()
        pieces, is_byte = [self.library.id_to_piece(i) for i in range(n)], [self.library.is_byte(i) for i in range(n)]
        if not any(is_byte):
            raise ValueError("only models with byte fallback are supported")
        kinds = [dict(_fields(v)).get(3, 1) for k, v in fields if k == 1]
        self.normalised = np.array([1 if b else len(p.encode()) for p, b in zip(pieces, is_byte)])
        self.by_word = (
            not self.normaliser.units and not self.normaliser.trim and self.normaliser.escape and self.normaliser.dummy_prefix
            and not any(k == 4 for k in kinds)
            and not any("\n" in p or SPACE in p.lstrip(SPACE) for p, b in zip(pieces, is_byte) if not b)
        )
        self.space, self.feed = self.library.piece_to_id(SPACE), self.library.piece_to_id("<0x0A>")
        self.by_word &= self.library.encode("\n") == [self.space, self.feed]
        self._forget()

    def _forget(self) -> None:
        self.held = 0
        self.slot: dict[str, int] = {}
        self.tail: dict[str, list[int]] = {}
        self.ids, self.at, self.texts = array("i"), array("q", [0]), []

    def _learn(self, words: list[str]) -> None:
        """Encode words, which stand behind a space each."""
        tails = dict.fromkeys(p for w in words if "\n" in w for p in w.split("\n")[1:] if p and p not in self.tail)
        for p, ids in zip(tails, self.library.encode(["\n" + p for p in tails], num_threads=1)):
            self.tail[p] = ids[2:]
            self.held += 4 * len(p)
        heads = [w.partition("\n")[0] for w in words]
        found = self.library.encode(heads, num_threads=1)
        all_ids = []
        for w, head, ids in zip(words, heads, found):
            ids = ids if head else [self.space]
            if "\n" in w:
                ids = list(ids)
                for p in w.split("\n")[1:]:
                    ids.append(self.feed)
                    ids += self.tail[p] if p else ()
            all_ids.append(ids)
        for w, ids, text in zip(words, all_ids, self.library.decode(all_ids)):
            self.slot[w] = len(self.texts)
            self.held += 4 * len(w)
            self.texts.append(" " + text)
            self.ids.extend(ids)
            self.at.append(len(self.ids))

    def _ends(self, text: str, ids: np.ndarray) -> np.ndarray:
        """The byte of the text behind each piece: pieces tile the normalised text, whose bytes know their source."""
        source = self.normaliser(text.encode("utf-8", "replace"))[1]
        return source[np.minimum(np.cumsum(self.normalised[ids]), len(source) - 1)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """All ids, the byte of its text at which each piece ends (the next one starts there), where each text ends among them, and the decoded texts."""
        if len(self.slot) > WORDS or len(self.tail) > WORDS or self.held > KEPT:
            self._forget()
        plan: list[list[str] | None] = []
        new: dict[str, None] = {}
        slot = self.slot
        for text in texts:
            if not text:
                plan.append([])
            elif not self.by_word or SPACE in text or "\0" in text:
                plan.append(None)
            else:
                words = text.split(" ")
                if "" in words:
                    words = list(_joined(words))
                if len(max(words, key=len)) > LONGEST:
                    plan.append(None)
                    continue
                plan.append(words)
                new.update((w, None) for w in words if w not in slot)
        if new:
            self._learn(list(new))
        ids, ends, decoded = [], [], []
        pool, at = np.frombuffer(self.ids, np.int32) if len(self.ids) else np.zeros(0, np.int32), np.frombuffer(self.at, np.int64)
        for text, words in zip(texts, plan):
            if words is None:
                own = np.array(self.library.encode(text), np.int32)
                ends.append(self._ends(text, own))
                decoded.append(self.library.decode(own.tolist()))
            elif not words:
                own = np.zeros(0, np.int32)
                ends.append(np.zeros(0, np.int64))
                decoded.append("")
            else:
                slots = np.fromiter(map(slot.__getitem__, words), np.int64, len(words))
                first, n = at[slots], at[slots + 1] - at[slots]
                own = pool[np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
                ends.append(self._ends(text, own))
                decoded.append("".join(map(self.texts.__getitem__, slots.tolist()))[1:])
            ids.append(own)
        del pool, at  # else the memory they look at can't grow
        bounds = np.cumsum([len(x) for x in ids]) if ids else np.zeros(0, np.int64)
        none = np.zeros(0, np.int32)
        return np.concatenate([none, *ids]), np.concatenate([none, *ends]).astype(np.int32), bounds, decoded


def _joined(words: list[str]) -> Iterator[str]:
    """Words of a text split at each space, where empty ones become spaces before the next."""
    spaces = 0
    for w in words:
        if w:
            yield " " * spaces + w
            spaces = 0
        else:
            spaces += 1
    if spaces:
        yield " " * (spaces - 1)


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, model: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep, and of each text ids, ends (the byte behind each piece; a piece starts where the one before ends) and decoded."""
    keep = tuple(c for c in keep if c not in ("ids", "ends", "decoded"))
    rows = docs.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            for part in slices(batch, "__text"):
                ids, ends, bounds, decoded = own.encode(part.column("__text").to_pylist())
                offsets = pa.array(np.concatenate(([0], bounds)), pa.int32())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(ends, pa.int32())), pa.array(decoded, pa.string())], [*keep, "ids", "ends", "decoded"])

    return rows.mapInArrow(run, ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", ids array<int>, ends array<int>, decoded string")


def digests(encoded: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Length and hash of the ids, hash of the decoded text, how many bytes the pieces span and a hash of their ends, for each row of encode()."""
    return encoded.select(
        *keep,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0)).cast("long").alias("n_bytes"),
        F.xxhash64("ends").alias("spans_hash"),
    )


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), model_path()))
