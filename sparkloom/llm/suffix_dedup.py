"""Suffix-array dedup: removes every byte that a string of LENGTH bytes covers which also starts anywhere else.

A suffix array of the whole corpus would be one task's work, so texts are first cut into places that can match. Every text is sampled at anchors:
of each window of LENGTH bytes, the 64-byte gram with the least hash (the last of equals). Equal windows have equal anchors, so a
repeated window has an anchor whose gram occurs twice. For each such occurrence a context holds all windows with that anchor.
Equal contexts are counted by a grouping; the different ones of an anchor form a group. The contexts of a group of at most GROUP are one
small text, without those that have no half of a context in common with another, and the suffix array of it, built by grouping suffixes on Lyndon prefixes, shows the
windows that start twice: they are neighbours in it with LENGTH equal bytes. A larger group, as at the edges of a
passage that very many texts share, is split: the windows of a context fall into four ranges, each keyed by the bytes that all windows of the range
have in common, again and again, until groups are small or a range is a single window. So no task gets an unbounded group, and no
window is left out.

Texts that occur repeatedly as a whole are wholly covered; one of each takes part for the rest. Matches are judged on the input as
UTF-8 and never cross texts. A null text is empty; texts shorter than LENGTH keep all. A repeated row is a copy. Texts are known by 128 bits of their
SHA-256, so a null doc_id, or one id with several texts, changes nothing. Only the id and the text are read, so other columns may have any name. A very long
text is scanned in pieces.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from hashlib import md5, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shingles import mix
from .storage import cut, discard, row_mark, slices
from .suffix_sort import suffix_array

LENGTH = 200
GRAM = 64
GROUP = 512  #: contexts of a group that are sorted at once
SPLIT = 4  #: ranges that a larger group's windows fall into
_CHUNK = 1 << 18
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15 | 1


def _hashes(data: np.ndarray, lengths: tuple[int, ...]) -> np.ndarray:
    """The hash of every window, whose length is the sum of descending powers of two."""
    h, parts, at, size = _BYTE[data], {}, 1, sum(lengths)
    while True:
        parts[at] = h
        if at == max(lengths):
            break
        h = h[:-at] * np.uint64(pow(_BASE, at, 1 << 64)) + h[at:]
        at *= 2
    n, out, shift = max(0, len(data) - size + 1), np.uint64(0), 0
    for length in lengths:
        out = out * np.uint64(pow(_BASE, length, 1 << 64)) + parts[length][shift : shift + n]
        shift += length
    return mix(out) if n else np.zeros(0, np.uint64)


def _periodic(data: np.ndarray, place: np.ndarray, h: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Which anchors are needed, and the stretches in which a text only repeats itself, from where to where.

    In a stretch of period p each window is also the one p bytes before or behind, so all of it is covered. The windows of its first two periods stand for the others, which have
    the same bytes. Such a stretch shows in anchors of one gram that follow each other at one distance; its bytes are compared before anything is left out.
    """
    need, found = np.ones(len(place), bool), []
    step = np.diff(place)
    step = np.where((h[1:] == h[:-1]) & (first[1:] == last[:-1] + 1), step, 0)
    edge = np.flatnonzero(np.concatenate(([True], step[1:] != step[:-1], [True]))) if len(step) else np.zeros(0, np.int64)
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
        p = int(step[a])
        if p and b - a >= 8:
            begin, end = int(first[a + 1]), int(last[b - 1]) + LENGTH  # without the anchors at both ends, whose windows may reach beyond
            if np.array_equal(data[begin : end - p], data[begin + p : end]):
                need[a + 1 : b] = first[a + 1 : b] < begin + 2 * p
                found.append((begin, end))
    return need, found


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Place and hash of the anchors of texts that stand one behind the other and end at ends, the first and last window of each, and the stretches that repeat themselves (from and to)."""
    found: list[tuple[np.ndarray, ...]] = []
    stretches: list[tuple[int, int]] = []
    span = LENGTH - GRAM + 1
    for first in range(0, max(0, len(data) - LENGTH + 1), _CHUNK):
        part = data[first : first + _CHUNK + LENGTH - 1]
        h = _hashes(part, (GRAM,))
        low = np.uint64((1 << 20) - 1)
        m = (h & ~low) | (low - np.arange(len(h), dtype=np.uint64))  # of equals the last is least
        at = 1
        while at * 2 <= span:
            m = np.minimum(m[:-at], m[at:])
            at *= 2
        m = np.minimum(m[: len(m) - (span - at)], m[span - at :])
        starts = np.arange(first, first + len(m))
        inside = ends[np.searchsorted(ends, starts, "right")] - starts >= LENGTH
        m, starts = m[inside], starts[inside]
        if len(m):
            place = (low - (m & low)).astype(np.int64)
            edge = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1], [True])))
            place = place[edge[:-1]]
            some = place + first, h[place], starts[edge[:-1]], starts[edge[1:] - 1]
            need, more = _periodic(data, *some)
            found.append(tuple(x[need] for x in some))
            stretches += more
    if not found:
        return (*(np.zeros(0, np.int64),) * 4, np.zeros((0, 2), np.int64))
    place, h, starts, lasts = (np.concatenate(x) for x in zip(*found))  # an anchor's windows stand together, perhaps in two chunks
    edge = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1], [True])))
    return place[edge[:-1]], h[edge[:-1]].view(np.int64), starts[edge[:-1]], lasts[edge[1:] - 1], np.array(stretches, np.int64).reshape(-1, 2)


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


_ANCHOR = ("place", "first", "last", "gram")


def _scan(docs: DataFrame, key: str, text: str) -> DataFrame:
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                raw = [_raw(t) for t in part.column("text").to_pylist()]
                sizes = np.fromiter(map(len, raw), np.int64, len(raw))
                ends = np.cumsum(sizes)
                place, h, *windows, stretches = anchors(np.frombuffer(b"".join(raw), np.uint8), ends)
                offsets = np.searchsorted(place, np.concatenate(([0], ends)))
                own = [x - np.repeat(ends - sizes, np.diff(offsets)) for x in (place, *windows)]
                of = np.searchsorted(ends, stretches[:, 0], "right")
                stretches -= (ends - sizes)[of][:, None]
                runs = pa.ListArray.from_arrays(pa.array(2 * np.searchsorted(of, np.arange(len(raw) + 1)), pa.int32()), pa.array(stretches.ravel(), pa.int32()))
                digests = [sha256(t).digest() for t in raw]
                lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), x) for x in (*(pa.array(x, pa.int32()) for x in own), pa.array(h, pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row"), pa.array([d[:16] for d in digests], pa.binary()), pa.array([d.hex() for d in digests], pa.string()), pa.array(sizes), *lists, runs], ["doc_id", "row", "text_id", "text_sha256", "n_bytes", *_ANCHOR, "runs"])

    rows = docs.select(F.col(key).alias("doc_id"), row_mark(key, text).alias("row"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, row binary, text_id binary, text_sha256 string, n_bytes long, place array<int>, first array<int>, last array<int>, gram array<long>, runs array<int>")


def _held(docs: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """The bytes of the texts in wanted (row, text_id, copies, hits, runs)."""
    rows = docs.select(row_mark(key, text).alias("row"), F.col(text).cast("string").alias("text")).join(wanted.hint("shuffle_hash"), "row")
    return rows.select("text_id", "copies", "hits", "runs", F.coalesce("text", F.lit("")).cast("binary").alias("raw")).dropDuplicates(["text_id"])


def _contexts(held: DataFrame) -> DataFrame:
    """text_id, copies, start (of the context), lead (from the anchor to it), key, id and context of every hit.

    The id is a hash of context and lead. A task hands on the bytes of equal contexts once in a while only; elsewhere the context is null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            rows = []
            for text_id, copies, raw, hits in zip(*(batch.column(c).to_pylist() for c in ("text_id", "copies", "raw", "hits"))):
                for x in hits:
                    first, lead = x["first"], x["first"] - x["place"]
                    context = raw[first : x["last"] + LENGTH]
                    name = md5(context + lead.to_bytes(2, "big", signed=True)).digest()
                    known = name in seen
                    seen.add(name)
                    rows.append((text_id, copies, first, lead, x["gram"], name.hex(), None if known else context))
                if len(seen) > 200_000:
                    seen.clear()
            kinds = pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.binary()
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["text_id", "copies", "start", "lead", "key", "id", "context"])

    return held.select("text_id", "copies", "raw", "hits").mapInArrow(run, "text_id binary, copies long, start int, lead int, key long, id string, context binary")


def with_company(group: list[int], contexts: list[bytes], leads: list[int], width: int) -> list[tuple[int, int]]:
    """From and up to which window (not with it) each context may share windows with others of its group; leads: the number, below width, of its first window.

    Windows of equal number are aligned. One of the lower half of the numbers covers the bytes from the half's last number to the end of window 0, any other
    those from the last number to the end of the upper half's first window. Contexts with a window in common have one of these two in common.
    """
    half = (width - 1) // 2
    ends = [
        ((g, 0, c[half - at : LENGTH - at]) if at <= half and at + len(c) >= LENGTH else None, (g, 1, c[width - 1 - at : half + 1 + LENGTH - at]) if at + len(c) >= half + 1 + LENGTH else None)
        for g, c, at in zip(group, contexts, leads)
    ]
    known = Counter(x for pair in ends for x in pair if x)
    out = []
    for c, at, (low, high) in zip(contexts, leads, ends):
        n, middle = len(c) - LENGTH + 1, half + 1 - at
        out.append((0 if low and known[low] > 1 else max(0, middle), n if high and known[high] > 1 else min(n, middle)))
    return out


def repeated_windows(group: list[int], contexts: list[bytes], counts: list[int], leads: list[int], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which windows of contexts also start elsewhere in their group, context by context, and how many windows each has.

    group: numbers the groups, whose different contexts stand together; counts: how often each context occurs; leads, width: as in with_company. The suffix array of
    a group's contexts decides, but for those that can't share a window; in a context that occurs repeatedly every window does.
    """
    windows = np.array([len(c) - LENGTH + 1 for c in contexts])
    first = np.cumsum(windows) - windows
    out = np.zeros(int(windows.sum()), bool)
    groups: dict[int, dict[bytes, list[int]]] = {}
    for k, (g, c, (low, high)) in enumerate(zip(group, contexts, with_company(group, contexts, leads, width))):
        if counts[k] > 1:
            out[first[k] : first[k] + windows[k]] = True
        if low < high:
            groups.setdefault(g, {}).setdefault(c[low : high - 1 + LENGTH], []).append(int(first[k]) + low)
    for own in groups.values():
        found = _repeats(list(own)) if len(own) > 1 else None
        start = 0
        for part, where in own.items():
            n = len(part) - LENGTH + 1
            for at in where:
                if len(where) > 1:
                    out[at : at + n] = True
                elif found is not None:
                    out[at : at + n] |= found[start : start + n]
            start += len(part) + 1
    return out, windows


def _repeats(parts: list[bytes]) -> np.ndarray:
    """Where in the parts, joined by a byte that UTF-8 never has, a window starts that also starts elsewhere in them."""
    text = b"\xff".join(parts)
    found = np.zeros(len(text) + 1, bool)
    whole = b"\xff".join(b"\1" * (len(p) - LENGTH + 1) + b"\0" * (LENGTH - 1) for p in parts)  # 1 where a window starts
    before, last = b"", -1
    for i in suffix_array(text):
        if whole[i] == 1:
            own = text[i : i + LENGTH]
            if own == before:
                found[last] = found[i] = True
            before, last = own, i
    return found


def _sorted_groups(batches: Iterator[pa.RecordBatch], width: int, least: int) -> Iterator[pa.RecordBatch]:
    """Of rows (key, id, context, count, lead) sorted by key, the runs of repeated windows of each context that occurs once."""
    keys, ids, contexts, counts, leads, group, held = [], [], [], [], [], [], 0

    def done() -> pa.RecordBatch:
        out, windows = repeated_windows(group, contexts, counts, leads, width)
        owner = np.repeat(np.arange(len(windows)), windows)
        own = out & (np.array(counts) == 1)[owner]
        edge = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (owner[1:] != owner[:-1]), [True])))
        a, b = edge[:-1], edge[1:]
        a, b = a[own[a]], b[own[a]]
        k, first = owner[a], np.cumsum(windows) - windows
        with_any, n = np.unique(k, return_counts=True)
        offsets = pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (a - first[k], b - 1 - first[k])]
        return pa.RecordBatch.from_arrays([pa.array([keys[i] for i in with_any], pa.int64()), pa.array([ids[i] for i in with_any], pa.string()), *lists], ["key", "id", "froms", "tos"])

    for batch in batches:
        for k, i, c, n, at in zip(*(batch.column(x).to_pylist() for x in ("key", "id", "context", "count", "lead"))):
            if keys and k != keys[-1] and held > 1 << 20:
                yield done()
                keys, ids, contexts, counts, leads, group, held = [], [], [], [], [], [], 0
            group.append(group[-1] + (k != keys[-1]) if keys else 0)
            keys.append(k), ids.append(i), contexts.append(c), counts.append(n), leads.append(at - least)
            held += len(c)
    if keys:
        yield done()


def _resolved(rows: DataFrame, width: int, least: int, made: list[DataFrame]) -> DataFrame:
    """key, id, froms and tos of each context with repeated windows, of rows (key, id, context, lead, count), all of them different.

    lead: number of the context's first window, where those of a key are numbered alike from least to least + width - 1.
    made: gets the tables that the result is read from.
    """
    rows = cut(rows, "contexts")
    made.append(rows)
    sizes = cut(rows.groupBy("key").agg(F.count("*").alias("members")), "groups")
    made.append(sizes)
    whole = rows.where("count > 1").select("key", "id", F.array(F.lit(0)).alias("froms"), F.array((F.length("context") - LENGTH).cast("int")).alias("tos"))
    small = rows.join(sizes.where(F.col("members").between(2, GROUP)), "key").select("key", "id", "context", "count", "lead")
    found = small.repartition("key").sortWithinPartitions("key", "id").mapInArrow(lambda batches: _sorted_groups(batches, width, least), "key long, id string, froms array<int>, tos array<int>")
    out = whole.unionByName(found)
    large = sizes.where(F.col("members") > GROUP)
    if width == 1 or large.isEmpty():
        return out
    step = -(-width // SPLIT)
    parts = rows.join(large, "key").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(-(-width // step) - 1))))
    low = F.lit(least) + F.col("part") * step
    high = F.least(low + step, F.lit(least + width)) - 1  # numbers of the range's first and last window
    own_low, own_high = F.greatest(low, F.col("lead")), F.least(high, F.col("lead") + F.length("context") - LENGTH)
    parts = parts.where(own_low <= own_high)
    cut_out = lambda a, n: F.col("context").substr((a - F.col("lead") + 1).cast("int"), n.cast("int"))
    parts = parts.select(
        "key", "id", F.xxhash64("key", "part", cut_out(high, low + LENGTH - high)).alias("new_key"), cut_out(own_low, own_high - own_low + LENGTH).alias("new"),
        own_low.alias("new_lead"), (own_low - F.col("lead")).cast("int").alias("shift"), "count",
    ).withColumn("new_id", F.md5(F.concat("new", F.col("new_lead").cast("string").cast("binary"))))
    parts = cut(parts, "parts")
    made.append(parts)
    fewer = parts.groupBy(F.col("new_key").alias("key"), F.col("new_id").alias("id")).agg(F.first("new").alias("context"), F.first("new_lead").cast("int").alias("lead"), F.sum("count").alias("count"))
    # Ranges of a key begin at different numbers, but all contexts of one key at the same: a range's number is part of the key.
    deeper = _resolved_ranges(fewer, step, made)
    back = parts.select("key", "id", "shift", F.col("new_key"), F.col("new_id")).join(deeper.select(F.col("key").alias("new_key"), F.col("id").alias("new_id"), "froms", "tos"), ["new_key", "new_id"])
    moved = lambda c: F.transform(c, lambda x: x + F.col("shift"))
    return out.unionByName(back.select("key", "id", moved("froms").alias("froms"), moved("tos").alias("tos")))


def _resolved_ranges(rows: DataFrame, width: int, made: list[DataFrame]) -> DataFrame:
    """_resolved for rows whose keys' ranges begin at different numbers: they are numbered anew from 0 by the key's smallest."""
    first = rows.groupBy("key").agg(F.min("lead").alias("least"))
    return _resolved(rows.join(first, "key").select("key", "id", "context", (F.col("lead") - F.col("least")).alias("lead"), "count"), width, 0, made)


def removals(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    scan = cut(_scan(docs, key, text), "scan")
    texts = cut(scan.groupBy("text_id").agg(F.min("row").alias("row"), F.count("*").alias("copies"), F.first("runs").alias("runs")), "texts")
    grams = scan.select("text_id", F.explode(F.arrays_zip(*_ANCHOR)).alias("x")).select("text_id", "x.*")
    where = F.xxhash64("text_id", "place")  # copies of a text say the same
    repeated = cut(grams.groupBy("gram").agg(F.min(where).alias("a"), F.max(where).alias("b")).where("a <> b").select("gram"), "grams")
    hits = grams.join(repeated, "gram", "left_semi").groupBy("text_id").agg(F.array_sort(F.collect_set(F.struct(*_ANCHOR))).alias("hits"))
    hits = cut(hits, "hits")
    held = cut(_held(docs, texts.join(hits, "text_id"), key, text), "held")
    at = cut(_contexts(held), "places")
    different = at.groupBy("key", "id").agg(F.first("context", ignorenulls=True).alias("context"), F.first("lead").alias("lead"), F.sum(F.least("copies", F.lit(2))).alias("count"))
    reach = LENGTH - GRAM
    made = [repeated, hits]
    found = cut(_resolved(different, reach + 1, -reach, made), "windows")
    discard(*made)
    spans = at.where("copies = 1").select("text_id", "key", "id", "start").join(found, ["key", "id"])
    spans = spans.groupBy("text_id").agg(F.flatten(F.collect_list(F.transform(F.arrays_zip("froms", "tos"), lambda x: F.struct((F.col("start") + x["froms"]).alias("a"), (F.col("start") + x["tos"] + LENGTH).alias("b"))))).alias("spans"))

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                raw = np.frombuffer(batch.column("raw")[i].as_buffer(), np.uint8)
                cover = np.zeros(len(raw) + 1, np.int32)
                spans = batch.column("spans")[i].values
                np.add.at(cover, spans.field("a").to_numpy(), 1)
                np.add.at(cover, spans.field("b").to_numpy(), -1)
                runs = batch.column("runs")[i].values.to_numpy()
                np.add.at(cover, runs[::2], 1)
                np.add.at(cover, runs[1::2], -1)
                gone = np.cumsum(cover[:-1]) > 0
                rows.append((batch.column("text_id")[i].as_py(), int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) > 0).sum()), sha256(raw[~gone].tobytes()).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.binary(), pa.int64(), pa.int64(), pa.string()))], ["text_id", "n_removed", "n_spans", "kept_sha256"])

    stripped = held.select("text_id", "raw", "runs").join(spans, "text_id").mapInArrow(strip, "text_id binary, n_removed long, n_spans long, kept_sha256 string")
    info = cut(texts.select("text_id", "copies").join(stripped, "text_id", "left"), "removed")
    discard(held, at, found, texts)
    every = (F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return scan.select("doc_id", "text_id", "n_bytes", "text_sha256").join(info, "text_id").select(
        "doc_id", "n_bytes", F.when(every, F.col("n_bytes")).otherwise(zero("n_removed")).alias("n_removed"), F.when(every, F.lit(1).cast("long")).otherwise(zero("n_spans")).alias("n_spans"),
        F.when(every, sha256(b"").hexdigest()).otherwise(F.coalesce("kept_sha256", "text_sha256")).alias("kept_sha256"),
    )


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removals(spark.read.parquet(f"{sf_dir}/documents.parquet"))
