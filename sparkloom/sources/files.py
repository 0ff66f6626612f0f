"""Sources and sinks: JSON documents and lines, CSV, Parquet, shards, directory trees.

Paths are Hadoop paths throughout, so a store that only Spark reads works as well.
"""

from __future__ import annotations

import io
import os
import tarfile
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def work_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Where that is unset, a folder of this machine will do only if the driver is the only executor."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.gettempdir()
    return f"{base.rstrip('/')}/files-{uuid.uuid4().hex}"


def written(rows: DataFrame, name: str) -> DataFrame:
    """The rows, written as Parquet into a work folder and read back: computed once, with no lineage, and safe when executors are lost."""
    path = f"{work_folder(rows.sparkSession)}-{name}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _hadoop(spark: SparkSession, path: str):
    """The file system of a path, and the path as its object."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def list_files(spark: SparkSession, path: str, suffix: str = "") -> list[str]:
    """The files below a folder, whatever its file system, sorted by path."""
    fs, p = _hadoop(spark, path)
    found, files = [], fs.listFiles(p, True)
    while files.hasNext():
        name = files.next().getPath()
        if name.getName().endswith(suffix) and not name.getName().startswith(("_", ".")):
            found.append(name.toString())
    return sorted(found)


def cycled(files: Sequence[str], n: int) -> list[str]:
    """n readings: the files in order, from the first again after the last; fewer than n files are cut, none give none."""
    return [files[k % len(files)] for k in range(n)] if files else []


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def choose_split(spark: SparkSession, path: str, wanted: Sequence[str] = ("test", "train")) -> str:
    """The first of the wanted folders that a dataset has, else its first folder by name."""
    fs, p = _hadoop(spark, path)
    names = sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory())
    if not names:
        raise FileNotFoundError(f"{path} has no splits")
    return next((n for n in wanted if n in names), names[0])


def json_list(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of a JSON array; a missing file has none."""
    return spark.read.json(path, schema=schema, multiLine=True) if exists(spark, path) else spark.createDataFrame([], schema)


def json_lines(spark: SparkSession, path: str, schema: StructType, tolerant: bool = False) -> DataFrame:
    """One object for each line; lines that aren't JSON are left out if tolerant, else they fail the read."""
    return spark.read.json(path, schema=schema, mode="DROPMALFORMED" if tolerant else "FAILFAST")


def json_results(spark: SparkSession, path: str, row: StructType) -> DataFrame:
    """The rows of documents that hold them below `results`, with the file and their position in it."""
    documents = spark.read.json(path, schema=f"results array<{row.simpleString()}>", multiLine=True)
    return documents.select(F.col("_metadata.file_name").alias("file"), F.posexplode("results").alias("pos", "r")).select("file", "pos", "r.*")


def csv_rows(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows below a header; an empty cell is null."""
    return spark.read.csv(path, schema=schema, header=True, nullValue="")


def shards(rows: DataFrame, pattern: str) -> DataFrame:
    """Rows of files whose name matches a pattern with a number in it, and that number as shard."""
    name = F.col("_metadata.file_name")
    return rows.where(F.regexp_like(name, F.lit(pattern))).withColumn("shard", F.regexp_extract(name, pattern, 1).cast("int"))


def missing_shards(rows: DataFrame, n: int) -> DataFrame:
    """The numbers below n of which no row has the shard."""
    return rows.sparkSession.range(n).select(F.col("id").cast("int").alias("shard")).join(rows.select("shard").distinct(), "shard", "left_anti")


def tree(spark: SparkSession, root: str, names: Sequence[str], marker: str) -> DataFrame:
    """The directories below root that hold a marker file: their path and the parts of it, from the last, under the given names."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", marker).load(root).select("path")
    parts = F.split("path", "/")
    return files.select(F.regexp_replace("path", "/[^/]*$", "").alias("dir"), *(F.try_element_at(parts, F.lit(-2 - k)).alias(n) for k, n in enumerate(names)))


def write_chunks(rows: DataFrame, path: str, rows_per_group: int, groups_per_file: int) -> DataFrame:
    """Parquet files of at most so many row groups of at most so many rows, and their manifest: file, num_row_groups, num_rows and largest_group. Both limits are the writer's, so rows aren't moved.

    The manifest is what the written footers say, and stands in `<path>-info/parquet_info.json` as well, an array with an object for each file.
    """
    rows.write.option("maxRecordsPerFile", rows_per_group * groups_per_file).option("parquet.block.row.count.limit", rows_per_group).parquet(path)
    groups = written(row_groups(rows.sparkSession, path), "footers")
    manifest = groups.groupBy("file").agg(F.count("*").alias("num_row_groups"), F.sum("num_rows").alias("num_rows"), F.max("num_rows").alias("largest_group"))
    write_json_document(manifest, f"{path}-info/parquet_info.json", "file")
    return manifest


def row_groups(spark: SparkSession, path: str) -> DataFrame:
    """file, row_group, num_rows and bytes of every row group of a folder's Parquet files, from their footers. Tasks take the files from Spark's reader, so any store will do; a file must be below 2 GB."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("path"), batch.column("content")):
                meta = pq.read_metadata(pa.BufferReader(content.as_buffer()))
                found = [meta.row_group(g) for g in range(meta.num_row_groups)]
                name = file.as_py().rsplit("/", 1)[-1]
                columns = [pa.array([name] * len(found), pa.string()), pa.array(range(len(found)), pa.int32()), pa.array([g.num_rows for g in found], pa.int64()), pa.array([g.total_byte_size for g in found], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["file", "row_group", "num_rows", "bytes"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, "file string, row_group int, num_rows long, bytes long")


def file_order(name: Column) -> Column:
    """What to sort names of files by, so that their numbers count as numbers: Spark's -c1000 comes behind its -c999."""
    padded = F.regexp_replace(name, r"(\d+)", "0" * 19 + "$1")
    return F.concat(F.regexp_replace(padded, r"0*(\d{20,})(?!\d)", "$1"), F.lit("\0"), name)


def row_at(manifest: DataFrame, n: int) -> tuple[str, int]:
    """The cursor of the n-th row (from 0) of chunks that were written in an order: its file, and its number in it."""
    before = F.sum("num_rows").over(Window.orderBy(file_order(F.col("file"))).rowsBetween(Window.unboundedPreceding, -1))
    placed = manifest.select("file", "num_rows", F.coalesce(before, F.lit(0)).alias("before"))
    file, first = placed.where((F.col("before") <= n) & (n < F.col("before") + F.col("num_rows"))).select("file", "before").first()
    return file, n - first


def rows_after(rows: DataFrame, file: str, row: int) -> DataFrame:
    """The rows of a Parquet table behind a cursor, a file's name and the number of a row in it; files go by name, and numbers in names by value. Files and row groups before it are skipped."""
    name, at = file_order(F.col("_metadata.file_name")), F.col("_metadata.row_index")
    here = file_order(F.lit(file))
    return rows.where((name >= here) & ((name > here) | (at > row)))


def write_by_status(rows: DataFrame, path: str, category: str, status: str) -> None:
    """Rows without helper columns, appended as JSON lines to a folder for each category and status."""
    helpers = [c for c in rows.columns if c.startswith("_")]
    rows.drop(*helpers).write.partitionBy(category, status).mode("append").json(path)


def markdown(rows: DataFrame, most: int = 1_000) -> str:
    """A small table as Markdown; one of more than most rows is an error."""
    got = rows.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"a report of more than {most} rows")
    lines = [rows.columns, ["---"] * len(rows.columns), *([str(v) for v in r] for r in got)]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)


def accuracy_report(rows: DataFrame, row: str, column: str, columns: Sequence[str], correct: str) -> DataFrame:
    """Of each row value, and overall, a cell for each of the columns: accuracy in percent (correct/all); an empty cell is a dash."""
    both = rows.select(F.explode(F.array(F.col(row).cast("string"), F.lit("**overall**"))).alias(row), F.col(column).cast("string").alias("__c"), F.col(correct).cast("long").alias("__k"))
    counts = both.groupBy(row).pivot("__c", list(columns)).agg(F.count(F.lit(1)).alias("n"), F.sum("__k").alias("k"))

    def cell(c: str) -> Column:
        n, k = F.col(f"{c}_n"), F.col(f"{c}_k")
        points = F.round(k * 10_000 / n).cast("long")
        text = F.concat((F.floor(points / 100)).cast("string"), F.lit("."), F.lpad((points % 100).cast("string"), 2, "0"), F.lit("% ("), k.cast("string"), F.lit("/"), n.cast("string"), F.lit(")"))
        return F.when(n > 0, text).otherwise("—").alias(c)

    return counts.select(row, *map(cell, columns)).orderBy(F.col(row) == "**overall**", row)


def write_atomic(rows: DataFrame, path: str) -> None:
    """Replace a table: the new one is written beside it and takes its name when it is complete, so a job that fails leaves the old one.

    The old table is moved aside first and deleted last. A folder's name can't pass from one to the other in a single step; should the driver die between the two
    renames, the old table is whole under its name with `.old` behind, and the next call puts it back.
    """
    new, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old"
    fs, target = _hadoop(rows.sparkSession, path)
    aside, fresh = (_hadoop(rows.sparkSession, x)[1] for x in (old, new))
    if fs.exists(aside):
        if fs.exists(target):
            fs.delete(aside, True)
        else:
            fs.rename(aside, target)
    try:
        rows.write.parquet(new)
    except BaseException:
        fs.delete(fresh, True)
        raise
    if fs.exists(target) and not fs.rename(target, aside):
        raise OSError(f"{path} can't be moved")
    if not fs.rename(fresh, target):
        raise OSError(f"{new} can't take its place")
    fs.delete(aside, True)


def write_json_document(rows: DataFrame, path: str, key: str, head: str = "[", tail: str = "]") -> None:
    """All rows as one JSON document: the head, the rows as objects in the order of a unique key with commas between, the tail.

    Rows are rendered and sorted in parallel; the driver only strings the parts' bytes together, whatever their size.
    """
    spark, parts = rows.sparkSession, f"{path}.parts-{uuid.uuid4().hex}"
    first = rows.agg(F.min(key)).first()[0]
    comma = F.when(F.col(key) == first, "").otherwise(",")
    rows.select(F.col(key).alias("__k"), F.concat(comma, F.to_json(F.struct(*rows.columns))).alias("value")).orderBy("__k").select("value").write.text(parts)
    fs, target = _hadoop(spark, path)
    copy = spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.copyBytes
    out = fs.create(target, True)
    try:
        out.write(bytearray(head.encode()))
        for part in list_files(spark, parts):
            source = fs.open(_hadoop(spark, part)[1])
            copy(source, out, spark.sparkContext._jsc.hadoopConfiguration(), False)
            source.close()
        out.write(bytearray(tail.encode()))
    finally:
        out.close()
    fs.delete(_hadoop(spark, parts)[1], True)


def _local(path: str) -> str:
    """A path that Python can open; the folder must be mounted on all machines."""
    if "://" in path or (":" in path and not path.startswith("file:")):
        raise ValueError(f"{path} isn't a folder of a mounted file system")
    return path.removeprefix("file:")


def _replace(path: str, write: Callable[[str], None]) -> None:
    """Write a file under another name and rename it, so a task that runs twice leaves one whole file."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    own = f"{path}.{uuid.uuid4().hex}"
    write(own)
    os.replace(own, path)


def export_images(rows: DataFrame, key: str, images: str, folder: str, suffix: str) -> DataFrame:
    """Write each image (bytes) of the rows' lists to a file named <key>_<position><suffix>, in parallel; key, i and name of each."""
    root = _local(folder)
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = []
            for k, i, data in zip(*(batch.column(c).to_pylist() for c in (key, "i", "image"))):
                names.append(f"{k}_{i}{suffix}")
                _replace(f"{root}/{names[-1]}", lambda p, d=data: _write(p, d))
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("i"), pa.array(names, pa.string())], [key, "i", "name"])

    return rows.select(key, F.posexplode(images).alias("i", "image")).where("image IS NOT NULL").mapInArrow(run, f"`{key}` {kind}, i int, name string")


def _write(path: str, data: bytes) -> None:
    with open(path, "wb") as f:
        f.write(data)


def archive(paths: DataFrame, root: str, folder: str, archives: int = 1) -> DataFrame:
    """Put the files below root that paths (column path, relative) name, each once, into so many tar archives; path and missing of each.

    A file goes into the archive of its path's hash, and each archive is written by one task, file by file.
    """
    target = _local(folder)
    spark = paths.sparkSession
    names = paths.select("path").where("path IS NOT NULL").distinct()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.substring_index("path", root.removeprefix("file:").rstrip("/") + "/", -1).alias("path"), "content")
    found = names.join(files, "path", "left").withColumn("shard", F.pmod(F.xxhash64("path"), F.lit(archives)).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[int, tuple[str, tarfile.TarFile]] = {}
        os.makedirs(target, exist_ok=True)
        for batch in batches:
            for path, data, shard in zip(*(batch.column(c).to_pylist() for c in ("path", "content", "shard"))):
                if shard not in open_:
                    own = f"{target}/part-{shard:05}.tar.{uuid.uuid4().hex}"
                    open_[shard] = own, tarfile.open(own, "w")
                if data is not None:
                    info = tarfile.TarInfo(path)
                    info.size = len(data)
                    open_[shard][1].addfile(info, io.BytesIO(data))
            yield pa.RecordBatch.from_arrays([batch.column("path"), pc.is_null(batch.column("content"))], ["path", "missing"])
        for shard, (own, tar) in open_.items():
            tar.close()
            os.replace(own, f"{target}/part-{shard:05}.tar")

    return found.repartition(archives, "shard").sortWithinPartitions("shard", "path").mapInArrow(run, "path string, missing boolean")


def archived(spark: SparkSession, folder: str) -> DataFrame:
    """path and size of every file in the tar archives of a folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content").to_pylist():
                with tarfile.open(fileobj=io.BytesIO(data)) as tar:
                    members = tar.getmembers()
                yield pa.RecordBatch.from_arrays([pa.array([m.name for m in members], pa.string()), pa.array([m.size for m in members], pa.int64())], ["path", "size"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.tar").load(folder).select("content").mapInArrow(run, "path string, size long")
