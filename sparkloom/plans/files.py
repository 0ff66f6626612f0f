"""Sources and sinks on files that are written from the driver's tables first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources import files as S
from ..sources.json_documents import json_head, json_rows
from .registry import Tables, query

NATION = StructType().add("n_nationkey", "integer").add("n_name", "string").add("n_regionkey", "integer")
ALL = "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders"


def _orders(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice")


@query("scan_json_list", ALL)
def scan_json_list(t: Tables) -> DataFrame:
    path, rows = S.work_folder(t.spark), _orders(t)
    S.write_json_document(rows, path + "/list.json", "o_orderkey")
    found = json_rows(t.spark, path + "/list.json", rows.schema).unionByName(json_rows(t.spark, path + "/missing", rows.schema))
    return found.select(*rows.columns)


@query("scan_json_results", "SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS INTEGER) AS pos FROM orders")
def scan_json_results(t: Tables) -> DataFrame:
    path, rows = S.work_folder(t.spark) + "/results.json", _orders(t)
    S.write_json_document(rows, path, "o_orderkey", '{"results": [', "]}")
    return json_rows(t.spark, path, rows.schema, "results").select("o_orderkey", F.col("pos").cast("int").alias("pos"))


@query("scan_jsonl", ALL)
def scan_jsonl(t: Tables) -> DataFrame:
    path = S.work_folder(t.spark)
    _orders(t).write.json(path)
    return S.json_lines(t.spark, path, _orders(t).schema)


@query("scan_jsonl_tolerant", ALL)
def scan_jsonl_tolerant(t: Tables) -> DataFrame:
    """Lines that aren't JSON are left out."""
    path, rows = S.work_folder(t.spark), _orders(t)
    good = rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))
    good.unionByName(t.region.select(F.concat(F.lit("{broken "), "r_name").alias("value"))).write.text(path)
    return S.json_lines(t.spark, path, rows.schema, tolerant=True)


@query("scan_csv", "SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS o_orderpriority, o_totalprice FROM orders")
def scan_csv(t: Tables) -> DataFrame:
    path, rows = S.work_folder(t.spark), _orders(t)
    rows.withColumn("o_orderpriority", F.nullif(F.col("o_orderpriority"), F.lit("5-LOW"))).write.csv(path, header=True)
    return S.csv_rows(t.spark, path, rows.schema)


@query("scan_parquet_full", "SELECT * FROM supplier")
def scan_parquet_full(t: Tables) -> DataFrame:
    return t.supplier


@query("scan_parquet_columns", "SELECT l_orderkey, l_tax FROM lineitem WHERE l_tax > 0.05")
def scan_parquet_columns(t: Tables) -> DataFrame:
    """Two columns and a pushed filter: the scan reads no others."""
    return t.lineitem.where("l_tax > 0.05").select("l_orderkey", "l_tax")


@query("scan_parquet_rowgroup", "SELECT o_orderkey FROM orders WHERE o_orderkey > (SELECT quantile_disc(o_orderkey, 0.4) FROM orders)")
def scan_parquet_rowgroup(t: Tables) -> DataFrame:
    """The rows behind a cursor inside a row group: orders stand sorted in files of row groups, and reading goes on behind the last row of one key (two fifths from the first)."""
    path, rows = S.work_folder(t.spark), t.orders.select("o_orderkey")
    manifest = S.write_chunks(rows.orderBy("o_orderkey"), path, 50, 20)
    read = t.spark.read.schema(rows.schema).parquet(path)
    nulls, keys = rows.agg(F.count_if(F.col("o_orderkey").isNull()), F.count("o_orderkey")).first()
    if not keys:
        return read.where("o_orderkey IS NOT NULL")
    file, row = S.row_at(manifest, nulls + max(0, -(-2 * keys // 5) - 1))
    key = read.where((F.col("_metadata.file_name") == file) & (F.col("_metadata.row_index") == row)).first()[0]
    place = F.struct(S.file_order(F.col("_metadata.file_name")), F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    last = read.where(F.col("o_orderkey") == key).agg(F.max(place).alias("last")).select("last.file", "last.row").first()
    return S.rows_after(read, last.file, last.row)


def _shards(t: Tables) -> str:
    path = S.work_folder(t.spark)
    for k in (0, 2, 10):
        t.nation.where(F.col("n_nationkey") % 11 == k).coalesce(1).write.json(f"{path}/results_shard{k}_of_12.d")
    return path


@query("scan_shard_glob", "SELECT n_nationkey FROM nation WHERE n_nationkey % 11 IN (0, 10)")
def scan_shard_glob(t: Tables) -> DataFrame:
    """A glob without names that hold a word to leave out (here: shard2)."""
    rows = t.spark.read.schema(NATION).json(_shards(t) + "/results_*")
    return rows.where(~F.col("_metadata.file_path").contains("shard2_")).select("n_nationkey")


@query("scan_shard_regex", "SELECT n_nationkey, CAST(n_nationkey % 11 AS INTEGER) AS shard FROM nation WHERE n_nationkey % 11 IN (0, 2, 10)")
def scan_shard_regex(t: Tables) -> DataFrame:
    rows = t.spark.read.schema(NATION).json(_shards(t) + "/results_*")
    return rows.withColumn("shard", F.regexp_extract("_metadata.file_path", "shard([0-9]+)_of", 1).cast("int")).select("n_nationkey", "shard")


@query("scan_shard_missing", "SELECT CAST(i AS INTEGER) AS shard FROM (SELECT unnest(generate_series(0, 11)) AS i) WHERE i NOT IN (0, 2, 10)")
def scan_shard_missing(t: Tables) -> DataFrame:
    return S.missing_shards(scan_shard_regex(t), 12)


@query("scan_merged_else_shards", "SELECT n_nationkey FROM nation WHERE n_nationkey % 11 IN (0, 2, 10)")
def scan_merged_else_shards(t: Tables) -> DataFrame:
    """The merged file if there is one, else the shards."""
    path = _shards(t)
    merged = f"{path}/merged.json"
    return t.spark.read.schema(NATION).json(merged if S.exists(t.spark, merged) else f"{path}/results_*").select("n_nationkey")


def _tree(t: Tables) -> str:
    path = S.work_folder(t.spark)
    t.nation.select("n_regionkey", "n_nationkey", F.col("n_name").alias("value")).repartition(1).write.partitionBy("n_regionkey", "n_nationkey").text(path)
    return path


@query("scan_tree_scenes", "SELECT 'n_regionkey=' || n_regionkey AS room, 'n_nationkey=' || n_nationkey AS scene FROM nation")
def scan_tree_scenes(t: Tables) -> DataFrame:
    """Scenes and rooms as the directories of a tree of depth two."""
    return S.tree(t.spark, _tree(t), ["scene", "room"], "part-*").select("room", "scene")


@query("scan_tree_marker", "SELECT count(DISTINCT n_nationkey) AS n FROM nation")
def scan_tree_marker(t: Tables) -> DataFrame:
    return S.tree(t.spark, _tree(t), ["scene"], "*.txt").agg(F.countDistinct("dir").alias("n"))


@query("scan_tree_questions", "SELECT n_regionkey, n_nationkey, n_name AS value FROM nation")
def scan_tree_questions(t: Tables) -> DataFrame:
    """The rows of all files of a tree, with its directories as columns."""
    return t.spark.read.schema("value string, n_regionkey int, n_nationkey int").text(_tree(t)).select("n_regionkey", "n_nationkey", "value")


@query("scan_tree_viewpoints", "SELECT n_nationkey, n_name AS value FROM nation WHERE n_regionkey IN (1, 3)")
def scan_tree_viewpoints(t: Tables) -> DataFrame:
    """The same with a filter on ids, which prunes directories."""
    rows = t.spark.read.schema("value string, n_regionkey int, n_nationkey int").text(_tree(t))
    return rows.where(F.col("n_regionkey").isin(1, 3)).select("n_nationkey", "value")


@query("scan_layout_probe", "SELECT 'partitioned' AS layout, count(*) AS n FROM nation")
def scan_layout_probe(t: Tables) -> DataFrame:
    """Which of several layouts a folder has, by looking for what each must hold."""
    path = _tree(t)
    layout = next(n for n, p in (("flat", "/part-*"), ("scenes", "/scene*"), ("partitioned", "/*=*"), ("empty", "")) if S.exists(t.spark, path + p))
    return t.spark.read.option("recursiveFileLookup", "true").text(path).agg(F.lit(layout).alias("layout"), F.count("*").alias("n"))


@query("scan_hdfs_or_local", "SELECT r_name, CAST(k AS INTEGER) AS k FROM region, (SELECT unnest(generate_series(0, 11)) AS k) WHERE k % 5 = r_regionkey")
def scan_hdfs_or_local(t: Tables) -> DataFrame:
    """The files of a folder on any file system, listed and cycled up to a number of readings (here: twelve of five files), and the rows of each reading."""
    path = S.work_folder(t.spark)
    t.region.select("r_name", "r_regionkey").repartition(1).write.partitionBy("r_regionkey").parquet(path)
    readings = S.cycled(S.list_files(t.spark, path, ".parquet"), 12)
    turns = t.spark.createDataFrame(list(enumerate(f.rpartition("/")[2] + "|" + f.split("r_regionkey=")[1][0] for f in readings)), "k int, file string")
    rows = t.spark.read.schema("r_name string, r_regionkey int").parquet(path)
    return rows.select("r_name", F.concat_ws("|", "_metadata.file_name", "r_regionkey").alias("file")).join(turns, "file").select("r_name", "k")


@query("scan_hub", "SELECT c_custkey, 'train' AS split FROM customer WHERE c_acctbal >= 0")
def scan_hub(t: Tables) -> DataFrame:
    """A dataset with splits, of which the test split is read, else the training split, else the first by name. A hub's copy lies in a folder here (customers in credit and in debt), as there's no network."""
    path = S.work_folder(t.spark)
    for split, where in (("train", "c_acctbal >= 0"), ("debts", "c_acctbal < 0")):
        t.customer.where(where).select("c_custkey").write.parquet(f"{path}/{split}")
    split = S.choose_split(t.spark, path)
    return t.spark.read.schema(t.customer.select("c_custkey").schema).parquet(f"{path}/{split}").withColumn("split", F.lit(split))


@query("sink_parquet_chunks", "SELECT sum(num_rows)::BIGINT AS n, true AS bounded, true AS groups FROM (SELECT count(*) AS num_rows FROM customer)")
def sink_parquet_chunks(t: Tables) -> DataFrame:
    """Files of ten row groups of ten rows at most, and what their manifest says."""
    path = S.work_folder(t.spark)
    S.write_chunks(t.customer, path, 10, 10)
    manifest = t.spark.read.json(f"{path}-info/parquet_info.json", schema="file string, num_row_groups long, num_rows long, largest_group long", multiLine=True)
    whole = (F.max("largest_group") <= 10) & (F.max("num_row_groups") <= 10) & F.bool_and(F.col("num_row_groups") == F.ceil(F.col("num_rows") / 10))
    return manifest.agg(F.sum("num_rows").alias("n"), (F.max("num_rows") <= 100).alias("bounded"), whole.alias("groups"))


@query("sink_jsonl", ALL)
def sink_jsonl(t: Tables) -> DataFrame:
    path, rows = S.work_folder(t.spark), _orders(t)
    rows.write.json(path)
    return t.spark.read.schema(rows.schema).json(path)


@query("sink_json_document", "SELECT count(*) AS total, count(*) AS results, sum(o_orderkey)::BIGINT AS keys FROM orders")
def sink_json_document(t: Tables) -> DataFrame:
    """Metrics and rows in one JSON document, read back by many tasks."""
    path, rows = S.work_folder(t.spark) + "/document.json", _orders(t)
    S.write_json_document(rows, path, "o_orderkey", f'{{"metrics": {{"total": {rows.count()}}}, "results": [', "]}")
    metrics = json_head(t.spark, path, StructType.fromDDL("metrics struct<total: bigint>")).select("metrics.total")
    found = json_rows(t.spark, path, rows.schema).agg(F.count("*").alias("results"), F.sum("o_orderkey").alias("keys"))
    return metrics.crossJoin(found)


@query("sink_csv", ALL)
def sink_csv(t: Tables) -> DataFrame:
    path, rows = S.work_folder(t.spark), _orders(t)
    rows.write.csv(path, header=True)
    return S.csv_rows(t.spark, path, rows.schema)


@query("sink_partitioned_status", "SELECT o_orderpriority AS category, CASE WHEN o_totalprice < 1000 THEN 'failed' ELSE 'ok' END AS status, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders GROUP BY 1, 2")
def sink_partitioned_status(t: Tables) -> DataFrame:
    path = S.work_folder(t.spark)
    rows = t.orders.select("o_orderkey", F.lit(1).alias("_note"), F.col("o_orderpriority").alias("category"), F.when(F.col("o_totalprice") < 1000, "failed").otherwise("ok").alias("status"))
    S.write_by_status(rows, path, "category", "status")
    return t.spark.read.schema("o_orderkey long, category string, status string").json(path).groupBy("category", "status").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query("sink_atomic", ALL)
def sink_atomic(t: Tables) -> DataFrame:
    """A table is written and replaced; a write that fails after that changes nothing."""
    path, rows = S.work_folder(t.spark), _orders(t)
    S.write_atomic(rows.where("o_orderpriority IS NULL"), path)
    S.write_atomic(rows, path)
    try:
        S.write_atomic(rows.withColumn("o_totalprice", F.raise_error(F.lit("fails on purpose"))), path)
    except Exception:  # whatever the engine raises
        return t.spark.read.schema(rows.schema).parquet(path)
    raise AssertionError("the write should have failed")


_CELL = lambda c: f"coalesce(CAST(max(CASE WHEN c = '{c}' THEN p END) // 100 AS VARCHAR) || '.' || lpad(CAST(max(CASE WHEN c = '{c}' THEN p END) % 100 AS VARCHAR), 2, '0') || '% (' || max(CASE WHEN c = '{c}' THEN k END) || '/' || max(CASE WHEN c = '{c}' THEN n END) || ')', '—')"


@query("sink_markdown_pivot", f"""WITH e AS (SELECT unnest([event_type, '**overall**']) AS r, CASE WHEN value < 30 THEN 'low' WHEN value < 90 THEN 'mid' ELSE 'high' END AS c, CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END AS ok FROM events),
g AS (SELECT r, c, sum(ok)::BIGINT AS k, count(*) AS n, CAST(round(sum(ok) * 10000 / count(*)) AS BIGINT) AS p FROM e GROUP BY 1, 2),
w AS (SELECT r, {", ".join(f"{_CELL(c)} AS {c}" for c in ("low", "mid", "high"))} FROM g GROUP BY r)
SELECT 0 AS line, '| type | low | mid | high |' AS text UNION ALL SELECT 1, '| --- | --- | --- | --- |' UNION ALL
SELECT CAST(row_number() OVER (ORDER BY r = '**overall**', r) + 1 AS INTEGER), '| ' || r || ' | ' || low || ' | ' || mid || ' | ' || high || ' |' FROM w""")
def sink_markdown_pivot(t: Tables) -> DataFrame:
    """A report of accuracies, types by bands of value (a user's number divisible by three counts as right), with a row for all of them, as Markdown, line by line."""
    band = F.when(F.col("value") < 30, "low").when(F.col("value") < 90, "mid").otherwise("high")
    rows = t.events.select(F.col("event_type").alias("type"), band.alias("band"), (F.col("user_id") % 3 == 0).cast("int").alias("ok"))
    text = S.markdown(S.accuracy_report(rows, "type", "band", ["low", "mid", "high"], "ok"))
    return t.spark.createDataFrame(list(enumerate(text.split("\n"))), "line int, text string")


_PIXELS = "unhex(string_agg(printf('%02X', CAST(trunc(abs(CAST(x AS DOUBLE)) * 255) AS INTEGER) & 255), '' ORDER BY pos))"


@query("sink_images_export", f"SELECT vec_id || '_' || i || '.pgm' AS name, CAST(11 + count(*) AS BIGINT) AS length, md5(encode('P5 8 4 255' || chr(10)) || {_PIXELS}) AS digest FROM (SELECT *, pos // 32 AS i FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)) GROUP BY vec_id, i")
def sink_images_export(t: Tables) -> DataFrame:
    """Each image of every row's list (here: the halves of a vector as grey pictures) becomes a file named by row and position; the files are read back."""
    path = S.work_folder(t.spark)
    S.export_images(_pictures(t), "vec_id", "images", path, ".pgm").write.format("noop").mode("overwrite").save()
    files = t.spark.read.format("binaryFile").option("pathGlobFilter", "*.pgm").load(path)
    return files.select(F.substring_index("path", "/", -1).alias("name"), "length", F.md5("content").alias("digest"))


def _pictures(t: Tables) -> DataFrame:
    """vec_id and two pictures of eight by four grey pixels, as encoded files."""
    byte = lambda x: F.lpad(F.hex((F.abs(x.cast("double")) * 255).cast("int").bitwiseAND(255)), 2, "0")
    head = F.lit("P5 8 4 255\n").cast("binary")
    halves = F.transform(F.array(F.lit(1), F.lit(33)), lambda a: F.concat(head, F.unhex(F.array_join(F.transform(F.slice("embedding", a, F.lit(32)), byte), ""))))
    return t.embeddings.select("vec_id", halves.alias("images"))


@query("sink_tar", "SELECT vec_id || '_' || i || '.pgm' AS path, i = 2 AS missing, CASE WHEN i < 2 THEN 43::BIGINT ELSE -1 END AS size FROM embeddings, (SELECT unnest(generate_series(0, 2)) AS i)")
def sink_tar(t: Tables) -> DataFrame:
    """The distinct paths that rows name (here: three for each vector, of which only two exist), archived in four parts and read back; what is missing is listed."""
    path = S.work_folder(t.spark)
    S.export_images(_pictures(t), "vec_id", "images", path + "/images", ".pgm").write.format("noop").mode("overwrite").save()
    named = t.embeddings.select("vec_id", F.explode(F.array(*map(F.lit, (0, 1, 2, 1)))).alias("i")).select(F.concat(F.col("vec_id").cast("string"), F.lit("_"), F.col("i").cast("string"), F.lit(".pgm")).alias("path"))
    S.archive(named, path + "/images", path + "/archives", 4).write.parquet(path + "/listed")
    listed = t.spark.read.schema("path string, missing boolean").parquet(path + "/listed")
    return listed.join(S.archived(t.spark, path + "/archives"), "path", "left").select("path", "missing", F.coalesce("size", F.lit(-1)).alias("size"))
