"""Rows of large JSON documents, each read by many tasks.

A document is an array of rows, or an object that has one under a key. Its text is read in pieces that end with a closing brace, which Spark's text reader finds in parallel, so each split of a
file is a stretch of pieces. A split alone can't tell whether it begins inside of a string, or how deep. So a first pass says for both cases how a split ends: in a string or not,
and how much deeper. (In valid JSON no backslash stands before a brace, so no split begins inside of an escape.) Composing these along the file gives where every split begins; that is a few
numbers for each split of 128 MB, on the driver. A second pass then cuts the rows out. Rows that go on over the edge of a split are put together from their parts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .files import exists, written

_ESCAPE = re.compile(r"\\.", re.DOTALL)
_TOKEN = re.compile(r'\\.|["{}\[\],]', re.DOTALL)
_OPEN, _CLOSE = "{[", "}]"

Split = tuple[str, int]


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path, lineSep="}")
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Split, str]]:
    for batch in batches:
        for file, start, value in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "value"))):
            yield (file, start), value + "}"


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each split: the document's first character (of the first split), and for a beginning outside and inside of a string whether it ends inside, and how much deeper."""
    found: dict[Split, list] = {}
    for split, text in _by_split(batches):
        state = found.setdefault(split, [text.lstrip("\ufeff \t\r\n")[:1], [False, 0], [True, 0]])
        parts = _ESCAPE.sub("", text).split('"')
        sides = ["".join(parts[k::2]) for k in (0, 1)]
        depth = [sum(map(s.count, _OPEN)) - sum(map(s.count, _CLOSE)) for s in sides]
        for case in state[1:]:
            case[1] += depth[case[0]]
            case[0] ^= len(parts) % 2 == 0
    columns = list(zip(*((f, s, first, a[0], a[1], b[0], b[1]) for (f, s), (first, a, b) in found.items()))) or [[]] * 7
    kinds = [pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64()]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["file", "start", "first", "out_in", "out_depth", "in_in", "in_depth"])


class _Walk:
    """Goes over the text of a split from where it begins; level is how deep the rows' array is, key what it stands under (None for any)."""

    def __init__(self, inside: bool, depth: int, ours: bool, level: int, key: str | None) -> None:
        self.inside, self.depth, self.ours, self.level = inside, depth, ours, level
        self.opens = None if key is None else re.compile(re.escape(key) + r'"\s*:\s*\[\Z')
        self.parts: list[str] = []
        self.n = -1 if ours and depth >= level else None  # -1: the row that an earlier split has begun
        self.opened: bool | None = None
        self.at = 0  # where the rows' array opens in the text that has it

    def feed(self, text: str) -> Iterator[tuple[int, str, bool]]:
        """The parts of rows that end here: number in this split, text, and that the row ends with it."""
        since = 0
        for m in _TOKEN.finditer(text):
            c = m[0]
            if c == '"':
                self.inside = not self.inside
            elif self.inside or len(c) > 1:
                continue
            elif c in _OPEN:
                self.depth += 1
                if self.depth == self.level and c == "[" and (self.level == 1 or self.ours is not None):
                    self.ours = self.level == 1 or bool(self.opens.search(text, 0, m.end()))
                    self.opened = self.ours
                    if self.ours:
                        self.n, since = 0, m.end()
                        self.at = since
            elif c in _CLOSE:
                self.depth -= 1
                if self.ours and self.depth == self.level - 1:
                    yield self.n, "".join([*self.parts, text[since : m.start()]]), True
                    self.parts, self.ours, self.n = [], False, None
            elif self.ours and self.depth == self.level:
                yield self.n, "".join([*self.parts, text[since : m.start()]]), True
                self.parts, since, self.n = [], m.end(), self.n + 1
        if self.ours and self.n is not None:
            self.parts.append(text[since:])

    def rest(self) -> Iterator[tuple[int, str, bool]]:
        if self.ours and self.n is not None:
            yield self.n, "".join(self.parts), False


def json_rows(spark: SparkSession, path: str, row: StructType, key: str = "results") -> DataFrame:
    """file (its name), pos (from 0) and the fields of every row of the documents at path; a missing path has none.

    A row is an element of the document, if that is an array, or of the array under the key, if it is an object. A row that isn't an object of the schema has null fields. Of a document
    that breaks off, the rows before that are given.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], StructType.fromDDL("file string, pos long")).join(spark.createDataFrame([], row))
    pieces = _pieces(spark, path)
    ends = pieces.mapInArrow(_ends, "file string, start long, first string, out_in boolean, out_depth long, in_in boolean, in_depth long").collect()
    begins: dict[Split, tuple[bool, int, bool | None, int]] = {}
    here, inside, depth, level = "", False, 0, 1
    for e in sorted(ends, key=lambda r: (r.file, r.start)):
        if e.file != here:
            here, inside, depth, level = e.file, False, 0, 1 if e.first == "[" else 2
        begins[e.file, e.start] = (inside, depth, level == 1, level)
        inside, depth = (e.in_in, depth + e.in_depth) if inside else (e.out_in, depth + e.out_depth)
    if any(b[3] == 2 for b in begins.values()):
        _mark_arrays(pieces, begins, key)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[str, int, int, str, bool]] = []
        walk, at = None, None
        for split, text in _by_split(batches):
            if split != at:
                out += [(*at, *x) for x in walk.rest()] if walk else []
                at, walk = split, _Walk(*begins[split], key)
            out += [(*split, *x) for x in walk.feed(text)]
            if len(out) > 1_000:
                yield _table(out)
                out = []
        out += [(*at, *x) for x in walk.rest()] if walk else []
        yield _table(out)

    parts = written(pieces.mapInArrow(cut, "file string, start long, n long, text string, ends boolean"), "rows")
    before = F.coalesce(F.sum("begun").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = parts.groupBy("file", "start").agg((F.max("n") + 1).alias("begun")).select("file", "start", before.alias("before"))
    placed = parts.join(splits, ["file", "start"]).withColumn("pos", F.col("before") + F.col("n")).withColumn("alone", F.col("ends") & (F.col("n") >= 0))
    split_rows = placed.where("n < 0 OR NOT ends").select("file", "pos").distinct()
    whole = placed.join(split_rows, ["file", "pos"], "left_anti").select("file", "pos", "text")
    apart = placed.join(split_rows, ["file", "pos"], "left_semi").groupBy("file", "pos").agg(F.array_sort(F.collect_list(F.struct("start", "text"))).alias("parts"), F.bool_or("ends").alias("ends"))
    joined = apart.where("ends").select("file", "pos", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"))
    rows = whole.unionByName(joined).where(F.trim(F.regexp_replace("text", r"\s", " ")) != "")
    return rows.select(F.element_at(F.split("file", "/"), -1).alias("file"), "pos", F.from_json("text", row).alias("r")).select("file", "pos", "r.*")


def json_head(spark: SparkSession, path: str, schema: StructType, key: str = "results") -> DataFrame:
    """The fields that stand before the array under the key, of each document at path that is an object with one: only that head, which must end in the first split, is put together, however many rows follow."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walks: dict[Split, _Walk] = {}
        heads: dict[Split, list[str]] = {}
        found: list[tuple[str, str]] = []
        for split, text in _by_split(batches):
            if split not in walks:
                walks[split], heads[split] = _Walk(False, 0, False, 2, key), []
            walk = walks[split]
            if walk.at:
                continue
            for _ in walk.feed(text):
                pass
            heads[split].append(text[: walk.at] if walk.at else text)
            if walk.at:
                found.append((split[0], "".join(heads[split]) + "]}"))
                heads[split] = []
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.string()) for k in (0, 1)], ["file", "text"])

    heads = _pieces(spark, path).where("start = 0").mapInArrow(cut, "file string, text string")
    return heads.select(F.element_at(F.split("file", "/"), -1).alias("file"), F.from_json(F.ltrim(F.col("text"), F.lit("\ufeff")), schema).alias("r")).select("file", "r.*")


def _table(rows: list[tuple[str, int, int, str, bool]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()))], ["file", "start", "n", "text", "ends"])


def _mark_arrays(pieces: DataFrame, begins: dict[Split, tuple[bool, int, bool | None, int]], key: str) -> None:
    """Of objects, say in begins whether a split begins inside of the key's array: the last array that was opened before, if any, is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walks: dict[Split, _Walk] = {}
        for split, text in _by_split(batches):
            if split not in walks:
                walks[split] = _Walk(*begins[split], key)
            for _ in walks[split].feed(text):
                pass
            walks[split].parts = []
        found = [(f, s, w.opened, w.ours) for (f, s), w in walks.items() if w.opened is not None]
        columns = list(zip(*found)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.bool_(), pa.bool_()))], ["file", "start", "opened", "still"])

    last = {(r.file, r.start): r.still for r in pieces.mapInArrow(run, "file string, start long, opened boolean, still boolean").collect()}
    here, ours = "", False
    for file, start in sorted(begins):
        ours = ours if file == here else False
        here = file
        inside, depth, known, level = begins[file, start]
        begins[file, start] = (inside, depth, known if level == 1 else ours and depth >= level, level)
        ours = last.get((file, start), ours)
