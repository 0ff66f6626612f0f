"""A stream of Parquet rows that several workers read over and over, each with a cursor of its own: epoch, file, row group and row.

The files of a folder, by name, are dealt to the workers in turn. A worker reads its files one after another, and from the first again in the next epoch. A micro-batch takes up to
`rows` rows of each worker, so it may begin and end anywhere inside of a row group; the offsets in Spark's checkpoint are the cursors, and a query that
is stopped goes on at them. Rows come with their worker, epoch, file, row group and row. Only the row groups of a batch are opened, each in the task of its worker.

    spark.dataSource.register(Cursors)
    spark.readStream.format("cursors").option("progress", p).option("workers", 4).option("rows", 1000).load(folder)

Spark asks a source for its latest offset without saying where the query stands, so the last answer is noted below `progress`, a folder of its own for each query. Batches are always
from Spark's own last offset up to the answer, so a lost note, or one that is ahead of what Spark has logged, changes the size of a batch and no more. Footers are read once, at the
start. Paths are those that pyarrow opens: of a mounted folder, or the URI of a store that it knows. The files must not change while the stream is in use.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

PLACE = "worker int, epoch long, file string, row_group int, row long"
_PLACE = [StructField(n, {"int": IntegerType, "long": LongType, "string": StringType}[k]()) for n, k in map(str.split, PLACE.split(", "))]


def _store(path: str) -> tuple[fs.FileSystem, str]:
    path = path[len("file:") :] if path.startswith("file:/") and not path.startswith("file://") else path
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[str]:
    store, base = _store(path)
    return sorted(f.path for f in store.get_file_info(fs.FileSelector(base, recursive=True)) if f.base_name.endswith(".parquet") and not f.base_name.startswith(("_", ".")))


@dataclass
class Part(InputPartition):
    """Rows from first to last - 1 of a row group, in an epoch."""

    worker: int
    pieces: list[tuple[int, str, int, int, int]]


class Lane:
    """What one worker reads: the row groups of its files. A place in it is a number of rows since its start, over all epochs."""

    def __init__(self, groups: Sequence[tuple[str, int, int]]) -> None:
        self.groups = [g for g in groups if g[2]]
        self.starts = [0, *accumulate(g[2] for g in self.groups)]
        self.size = self.starts[-1]

    def cursor(self, place: int) -> dict:
        if not self.size:
            return {"epoch": 0, "file": "", "group": 0, "row": 0}
        epoch, inside = divmod(place, self.size)
        k = bisect_right(self.starts, inside) - 1
        return {"epoch": epoch, "file": self.groups[k][0].rsplit("/", 1)[-1], "group": self.groups[k][1], "row": inside - self.starts[k]}

    def place(self, cursor: dict) -> int:
        for start, (file, group, _) in zip(self.starts, self.groups):
            if (file.rsplit("/", 1)[-1], group) == (cursor["file"], cursor["group"]):
                return cursor["epoch"] * self.size + start + cursor["row"]
        if not self.size:
            return 0
        raise ValueError(f"the stream stands in {cursor['file']}, which isn't there any more")

    def pieces(self, start: int, end: int) -> list[tuple[int, str, int, int, int]]:
        out = []
        while start < end:
            epoch, inside = divmod(start, self.size)
            k = bisect_right(self.starts, inside) - 1
            file, group, n = self.groups[k]
            first = inside - self.starts[k]
            last = min(n, first + end - start)
            out.append((epoch, file, group, first, last))
            start += last - first
        return out


class CursorReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.path, self.progress = options["path"], options["progress"].rstrip("/") + "/cursors.json"
        self.rows, self.epochs = int(options.get("rows", 1_000)), int(options.get("epochs", 0))
        store, _ = _store(self.path)
        workers = int(options.get("workers", 1))
        found: list[list[tuple[str, int, int]]] = [[] for _ in range(workers)]
        for k, file in enumerate(_files(self.path)):
            with store.open_input_file(file) as f:
                meta = pq.read_metadata(f)
            found[k % workers] += [(file, g, meta.row_group(g).num_rows) for g in range(meta.num_row_groups)]
        self.lanes = list(map(Lane, found))

    def _offset(self, places: Sequence[int]) -> dict:
        return {str(w): lane.cursor(p) for w, (lane, p) in enumerate(zip(self.lanes, places))}

    def _places(self, offset: dict) -> list[int]:
        return [lane.place(offset[str(w)]) for w, lane in enumerate(self.lanes)]

    def _noted(self) -> list[int]:
        store, path = _store(self.progress)
        if store.get_file_info(path).type == fs.FileType.NotFound:
            return [0] * len(self.lanes)
        with store.open_input_stream(path) as f:
            return self._places(json.loads(f.read()))

    def _note(self, offset: dict) -> None:
        store, path = _store(self.progress)
        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with store.open_output_stream(path + ".new") as f:
            f.write(json.dumps(offset).encode())
        store.move(path + ".new", path)

    def initialOffset(self) -> dict:
        return self._offset([0] * len(self.lanes))

    def latestOffset(self) -> dict:
        ends = [self.epochs * lane.size if self.epochs else 1 << 62 for lane in self.lanes]
        latest = self._offset([min(p + self.rows * bool(lane.size), end) for p, end, lane in zip(self._noted(), ends, self.lanes)])
        self._note(latest)
        return latest

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        ends = self._places(end)
        if any(a < b for a, b in zip(self._noted(), ends)):
            self._note(end)  # the note was lost
        return [Part(w, pieces) for w, (lane, a, b) in enumerate(zip(self.lanes, self._places(start), ends)) if (pieces := lane.pieces(a, b))]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.path)
        for epoch, file, group, first, last in partition.pieces:
            with store.open_input_file(file) as f:
                rows = pq.ParquetFile(f).read_row_group(group).slice(first, last - first)
            n = rows.num_rows
            place = {"worker": pa.array([partition.worker] * n, pa.int32()), "epoch": pa.array([epoch] * n, pa.int64()), "file": pa.array([file.rsplit("/", 1)[-1]] * n), "row_group": pa.array([group] * n, pa.int32()), "row": pa.array(range(first, last), pa.int64())}
            for name, column in place.items():
                rows = rows.append_column(name, column)
            yield from rows.combine_chunks().to_batches()

    def commit(self, end: dict) -> None:
        pass


class Cursors(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cursors"

    def schema(self) -> StructType:
        files = _files(self.options["path"])
        if not files:
            raise FileNotFoundError(f"{self.options['path']} has no Parquet files")
        store, _ = _store(self.options["path"])
        with store.open_input_file(files[0]) as f:
            own = from_arrow_schema(pq.read_schema(f))
        return StructType([*own, *_PLACE])

    def streamReader(self, schema: StructType) -> CursorReader:
        return CursorReader(dict(self.options))
