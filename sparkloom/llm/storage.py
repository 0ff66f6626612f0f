"""Where operators put tables that cut lineage, and how they hand out a text column in bounded slices."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where that is unset, a folder of this machine will do only if the driver is the only executor."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"/tmp/sparkloom-{spark.sparkContext.applicationId}"


def named(column: str) -> Column:
    """A column by its name, whatever characters are in it."""
    return F.col("`" + column.replace("`", "``") + "`")


def all_of(rows: DataFrame) -> list[Column]:
    return [named(c) for c in rows.columns]


def one_of_each(rows: DataFrame, mark: str, columns: list[str]) -> DataFrame:
    """The given columns of one row for each mark: the least by a hash of those columns, which may have any type."""
    row = F.min_by(F.struct(*map(named, columns)), row_mark(*columns)).alias("__least")
    return rows.groupBy(mark).agg(row).select(*(F.col("__least").getField(c).alias(c) for c in columns))


def row_mark(*columns: str | Column) -> Column:
    """16 bytes of a hash of columns each of which can be null: what names a row where its id can't."""
    text = lambda c: (named(c) if isinstance(c, str) else c).cast("string").cast("binary")
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.sha2(text(c), 256)), F.lit("null"))
    return F.unhex(F.substring(F.sha2(F.concat(*map(part, columns)).cast("binary"), 256), 1, 32))


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCK = threading.Lock()
_WRITING: list[str] = []  #: one entry for each write that is under way; the first is what the option was before


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: computed once, and safe when executors are lost.

    Nothing reads the shuffle files of the write afterwards, so they go when it has ended.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/sparkloom-{name}-{uuid.uuid4().hex}"
    with _LOCK:  # writes of several threads share the option
        _WRITING.append(spark.conf.get(_CLEANUP, "false") if not _WRITING else _WRITING[0])
        spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        with _LOCK:
            before = _WRITING.pop()
            if not _WRITING:
                spark.conf.set(_CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._sparkloom_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that cut() has written, once all that was made of them is written itself."""
    for table in tables:
        spark = table.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table._sparkloom_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def repeat_rows(rows: DataFrame, copies: str, index: str) -> DataFrame:
    """Each row as often as its column copies says, numbered from 0 by the column index. Numbers come in blocks, so no array of them is long."""
    block = 4096
    shares = rows.withColumn("__share", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(copies) - 1) / block)))).where(F.col(copies) > 0)
    each = F.sequence(F.col("__share") * block, F.least((F.col("__share") + 1) * block, F.col(copies)) - 1)
    return shares.withColumn(index, F.explode(each)).drop("__share", copies)


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose text comes to about limit bytes each; a longer text makes a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    first = total = 0
    for i, n in enumerate(sizes.tolist()):
        if i > first and total + n > limit:
            yield batch.slice(first, i - first)
            first, total = i, 0
        total += n
    if first < batch.num_rows:
        yield batch.slice(first)
