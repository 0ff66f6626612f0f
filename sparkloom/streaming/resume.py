"""Streams that resume: what is done is read from a log, a stream's checkpoint is its cursor."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.windows import first_per_key
from .cursors import PLACE, Cursors


def drain(source: DataFrame, sink: str, checkpoint: str) -> int:
    """Append all that a stream has at hand to a Parquet table. With the same checkpoint a later call goes on where this one ended. A stream of cursors has one batch at hand.

    Gives the number of rows read.
    """
    run = source.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return sum(p["numInputRows"] for p in run.recentProgress)


def upsert(source: DataFrame, table: str, checkpoint: str, key: str, order: Sequence[str], result: str) -> None:
    """Bring all that a stream has at hand into a table of results by key, which upserted() reads.

    Each micro-batch writes the last row that isn't blank of each of its keys into a folder of its own number, and replaces that folder should the batch run again: so a
    batch that is replayed, because the driver died before it was logged as done, changes nothing. Blank answers are never written, so their keys stay pending.
    """

    def write(rows: DataFrame, number: int) -> None:
        latest(rows, key, order, result).write.mode("overwrite").parquet(f"{table}/batch={number}")

    source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def upserted(spark: SparkSession, table: str, schema: str, key: str, order: Sequence[str], result: str) -> DataFrame:
    """The last result of each key over all batches."""
    return latest(spark.read.schema(schema).parquet(f"{table}/batch=*"), key, order, result)


def latest(log: DataFrame, key: str, order: Sequence[str], result: str) -> DataFrame:
    """The last row of each key with a result that isn't blank: an upsert read from an append-only log, so no writer rewrites another's rows."""
    return first_per_key(log.where(F.trim(F.coalesce(F.col(result), F.lit(""))) != ""), [key], [F.desc(c) for c in order])


def pending(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return rows.join(done.select(key), key, "left_anti")


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def cursor_stream(spark: SparkSession, path: str, progress: str, **options: int) -> DataFrame:
    """The rows of a folder's Parquet files as a stream with a cursor for each worker; see cursors.py for the options."""
    spark.dataSource.register(Cursors)
    return spark.readStream.format("cursors").options(progress=progress, **options).load(path)


def lanes(groups: DataFrame, workers: int) -> DataFrame:
    """What each worker reads: the row groups (file, row_group, num_rows) with their worker, the number of their first row in the file (first) and in all that the worker reads (start), and how much that is (size).

    The files, by name, are dealt to the workers in turn.
    """
    some = groups.where("num_rows > 0").select("file", "row_group", "num_rows", F.pmod(F.dense_rank().over(Window.orderBy("file")) - 1, F.lit(workers)).alias("worker"))
    before = lambda key: F.coalesce(F.sum("num_rows").over(Window.partitionBy(key).orderBy("file", "row_group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return some.select("*", before("file").alias("first"), before("worker").alias("start"), F.sum("num_rows").over(Window.partitionBy("worker")).alias("size"))


def advance(lanes: DataFrame, path: str, schema: str, sink: str, checkpoint: str, rows: int, epochs: int) -> int:
    """Bring the next rows of each worker, up to so many, into a table that advanced() reads; gives the number of row groups they are from, 0 if all epochs are over.

    A worker reads its lane over and over. Where it stands is a number of rows since its start: Spark's own source of numbers counts these up, and its offset in the checkpoint is every worker's cursor, so a
    batch may begin and end anywhere inside of a row group, and a later call goes on there. All files are read by Spark, so any store will do; those before and behind the batch's are skipped.
    Each batch writes a folder of its own number, and replaces it should it run again.
    """
    spark, found = lanes.sparkSession, []

    def write(places: DataFrame, number: int) -> None:
        low, high = places.agg(F.min("value"), F.max("value")).first()
        from_, to = F.floor(F.lit(low) / F.col("size")), F.least(F.floor(F.lit(high) / F.col("size")), F.lit(epochs - 1))
        turns = lanes.withColumn("epoch", F.explode(F.when(from_ <= to, F.sequence(from_, to))))
        begin = F.col("epoch") * F.col("size") + F.col("start")
        ends = F.greatest(F.lit(low) - begin, F.lit(0)).alias("least"), F.least(F.lit(high) + 1 - begin, F.col("num_rows")).alias("end")
        pieces = turns.select("worker", "epoch", "file", "row_group", "first", *ends).where(F.col("least") < F.col("end"))
        n, *files = pieces.agg(F.count("*"), F.min("file"), F.max("file")).first()
        own = spark.read.schema(schema).parquet(path).select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("__at"))
        joined = own.where(F.col("file").between(*map(F.lit, files))).join(pieces, "file").withColumn("row", F.col("__at") - F.col("first"))
        taken = joined.where((F.col("row") >= F.col("least")) & (F.col("row") < F.col("end")))
        place = [F.col(c).cast(kind).alias(c) for c, kind in map(str.split, PLACE.split(", "))]
        taken.select(*spark.read.schema(schema).parquet(path).columns, *place).write.mode("overwrite").parquet(f"{sink}/batch={number}")
        found.append(n)

    source = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", rows).load()
    source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return sum(found)


def advanced(spark: SparkSession, sink: str, schema: str) -> DataFrame:
    """The rows of all batches, each with its worker, epoch, file, row group and row."""
    return spark.read.schema(f"{schema}, {PLACE}").parquet(f"{sink}/batch=*")


def epochs(rows: DataFrame, n: int, cursor: Column) -> DataFrame:
    """The rows of n epochs one behind the other, with the epoch and a cursor in each."""
    return rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("cursor", cursor)
