"""Streaming-like behaviour and the extension surface."""

from __future__ import annotations

from itertools import chain, repeat

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.geometry import curriculum
from ..operators import external as E
from ..sources.files import row_groups, work_folder, write_chunks, written
from ..streaming import resume as R
from ..streaming.steps import STORE, last_cursors, numbered, settings
from .registry import Tables, query


@query("st_infinite_epochs", "SELECT event_id, CAST(e AS INTEGER) AS epoch, e * 1000000 + event_id AS cursor FROM events, (SELECT unnest(generate_series(0, 1)) AS e)")
def st_infinite_epochs(t: Tables) -> DataFrame:
    """Two epochs of all events by three workers that go round their files, from a stream that stops amid files and is started again until it has nothing more; with a cursor in each epoch."""
    rows = _rounds(t, t.events.select("event_id"), "event_id long", workers=3, epochs=2)
    return rows.select("event_id", F.col("epoch").cast("int").alias("epoch"), (F.col("epoch") * 1000000 + F.col("event_id")).alias("cursor"))


def _rounds(t: Tables, rows: DataFrame, schema: str, workers: int, epochs: int) -> DataFrame:
    """All that a stream over the written rows gives, each worker going round its files. Small tables get smaller chunks, so that every worker has some from a few hundred rows up.

    The first two runs each take a bit over a third of what the worker with the fewest rows has in all epochs, later ones that of the worker with the most. So at most five bring all, and every
    worker with more rows than eight full row groups stops and goes on at least twice. It does so some sixths into a row group; only where files end in shorter ones may a stop fall between two.
    """
    base = work_folder(t.spark)
    group = min(1_000, max(6, rows.count() // (30 * workers)))
    write_chunks(rows, f"{base}/in", group, 10)
    lanes = written(R.lanes(row_groups(t.spark, f"{base}/in"), workers), "lanes")
    fewest, most = (((size or 0) * epochs // 3 // group + 1) * group + group // 6 for size in lanes.agg(F.min("size"), F.max("size")).first())
    runs = chain([fewest, fewest], repeat(most))
    while R.advance(lanes, f"{base}/in", schema, f"{base}/out", f"{base}/checkpoint", next(runs), epochs):
        pass
    return R.advanced(t.spark, f"{base}/out", schema)


@query("st_cursor_resume", "SELECT event_id, user_id FROM events")
def st_cursor_resume(t: Tables) -> DataFrame:
    """One epoch by two workers, each stopped twice inside of row groups and resumed there: no row twice, none lost."""
    return _rounds(t, t.events.select("event_id", "user_id"), "event_id long, user_id long", workers=2, epochs=1).select("event_id", "user_id")


def _halves(t: Tables, rows: DataFrame, order: str, use) -> str:
    """Land the rows in two parts, split in the middle of their order, and hand the stream of the folder to use(stream, out, checkpoint) after each; gives the folder that use has written to."""
    low, high = rows.agg(F.min(order), F.max(order)).first()
    middle = ((low or 0) + (high or 0)) // 2
    base = work_folder(t.spark)
    for where in (F.col(order) < middle, (F.col(order) >= middle) | F.col(order).isNull()):
        rows.where(where).write.mode("append").parquet(f"{base}/in")
        use(R.file_stream(t.spark, f"{base}/in", rows.schema, 1_000), f"{base}/out", f"{base}/checkpoint")
    return f"{base}/out"


@query("st_cursor_state", "SELECT event_type AS dataset, user_id % 4 AS worker, max(event_id) AS cursor FROM events GROUP BY 1, 2")
def st_cursor_state(t: Tables) -> DataFrame:
    """The last cursor of each dataset and worker, kept in the state store of a stream that is stopped and started again."""
    rows = t.events.select(F.col("event_type").alias("dataset"), (F.col("user_id") % 4).alias("worker"), F.col("event_id").alias("cursor"))
    with settings(t.spark, STORE):
        out = _halves(t, rows, "cursor", lambda stream, *to: R.drain(last_cursors(stream, ["dataset", "worker"], "cursor"), *to))
    moved = t.spark.read.schema("dataset string, worker long, cursor long").parquet(out)
    return moved.groupBy("dataset", "worker").agg(F.max("cursor").alias("cursor"))


LOG = "WITH l AS (SELECT user_id AS id, event_id AS seq, CASE WHEN event_id % 3 = 0 THEN ' ' ELSE event_type END AS result FROM events)"


def _log(t: Tables) -> DataFrame:
    return t.events.select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 == 0, " ").otherwise(F.col("event_type")).alias("result"))


@query("st_checkpoint_upsert", LOG + " SELECT id, seq, result FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS n FROM l WHERE trim(result) <> '') WHERE n = 1")
def st_checkpoint_upsert(t: Tables) -> DataFrame:
    """Results by id, the last that isn't blank, brought in by a stream's micro-batches."""
    out = _halves(t, _log(t), "seq", lambda stream, *to: R.upsert(stream, *to, "id", ["seq"], "result"))
    return R.upserted(t.spark, out, "id long, seq long, result string", "id", ["seq"], "result").select("id", "seq", "result")


@query("st_append_log_cache", LOG + " SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT id FROM l WHERE trim(result) <> '')")
def st_append_log_cache(t: Tables) -> DataFrame:
    """What the log has no result of yet."""
    return R.pending(t.customer.select(F.col("c_custkey").alias("id")), R.latest(_log(t), "id", ["seq"], "result"), "id")


@query("st_done_by_status", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0)")
def st_done_by_status(t: Tables) -> DataFrame:
    """Rows whose status isn't ok or whose metric isn't a number."""
    metric = F.when(F.col("toxic") == 1, F.lit(float("nan"))).otherwise(1.0)
    done = t.labels.withColumn("m", metric).where((F.col("quality") == 1) & ~F.isnan("m"))
    return R.pending(t.documents.select("doc_id"), done, "doc_id")


@query("st_reparse", "SELECT CASE WHEN event_id % 3 = 0 THEN 'call' WHEN event_type = 'view' THEN 'ok' ELSE 'wrong' END AS status, count(*) AS n FROM events GROUP BY 1")
def st_reparse(t: Tables) -> DataFrame:
    """Status anew from the stored raw text; what can't be parsed needs a new call."""
    raw = F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("<think>x</think><answer>"), "event_type", F.lit("</answer>"))).otherwise("none")
    status = T.parse_status(raw, F.lit("view"))
    return t.events.groupBy(F.when(status == "parse_fail", "call").otherwise(status).alias("status")).agg(F.count("*").alias("n"))


@query("st_patch_column", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 2 ELSE 1 END AS n FROM events")
def st_patch_column(t: Tables) -> DataFrame:
    """One nested array of a document replaced; a row without a document gets a stub."""
    document = F.when(F.col("event_id") % 5 != 1, F.struct(F.col("event_type").alias("kind"), F.array(F.lit(0)).alias("distances")))
    stub = F.struct(F.lit("").alias("kind"), F.array(F.lit(9)).alias("distances"))
    patched = F.when(F.col("event_id") % 5 == 0, F.coalesce(document, stub).withField("distances", F.array(F.lit(1), F.lit(2)))).otherwise(F.coalesce(document, stub))
    return t.events.select("event_id", F.size(patched["distances"]).alias("n"))


@query("st_step_counter", "SELECT user_id, event_id, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, (k - 10) / 40.0::DOUBLE)), 6) AS p FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events)")
def st_step_counter(t: Tables) -> DataFrame:
    """Each worker's own step drives its curriculum. Steps are counted in the state store of a stream that is stopped and started again."""
    with settings(t.spark, STORE):
        out = _halves(t, t.events.select("user_id", "event_id"), "event_id", lambda stream, *to: R.drain(numbered(stream, "user_id", ["event_id"]), *to))
    steps = t.spark.read.schema("user_id long, event_id long, step long").parquet(out)
    return steps.select("user_id", "event_id", F.round(curriculum(F.col("step"), 10.0, 50.0), 6).alias("p"))


# ---- extension surface ------------------------------------------------------------------------------------------------------


@query("udf_dataset_registry", "SELECT 'nation' AS name, count(*) AS n FROM nation UNION ALL SELECT 'region', count(*) FROM region")
def udf_dataset_registry(t: Tables) -> DataFrame:
    """Datasets by name, each a factory of a DataFrame."""
    registry = E.Registry()
    registry.add("nation", lambda t: t.nation)
    registry.add("region", lambda t: t.region)
    parts = [registry.make(n, t).agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n in registry.names()]
    return parts[0].unionByName(parts[1])


@query("udf_parse_row", "SELECT doc_id, upper(lang) AS lang FROM documents WHERE lang <> 'en'")
def udf_parse_row(t: Tables) -> DataFrame:
    """A dataset's own parser, from DataFrame to DataFrame."""
    return t.documents.transform(lambda d: d.where("lang <> 'en'").select("doc_id", F.upper("lang").alias("lang")))


@query("udf_prompt_dispatch", "SELECT p_partkey, CASE p_type WHEN 'SMALL' THEN 'small ' || p_name WHEN 'ECONOMY' THEN 'cheap ' || p_name ELSE p_name END AS prompt FROM part")
def udf_prompt_dispatch(t: Tables) -> DataFrame:
    """A builder of prompts for each category."""
    name = F.col("p_name")
    builders = {"SMALL": F.concat(F.lit("small "), name), "ECONOMY": F.concat(F.lit("cheap "), name)}
    return t.part.select("p_partkey", F.coalesce(*(F.when(F.col("p_type") == k, c) for k, c in builders.items()), name).alias("prompt"))


@query("udf_parallel_map", "SELECT doc_id, length(text) AS n FROM documents WHERE text <> ''")
def udf_parallel_map(t: Tables) -> DataFrame:
    """A Python function over all rows, batch by batch; rows for which it gives None are dropped."""
    return E.parallel_map(t.documents.select("doc_id", "text"), lambda r: {"doc_id": r["doc_id"], "n": len(r["text"])} if r["text"] else None, "doc_id long, n long")


def _judge(prompt: str) -> str:
    if prompt.startswith("E"):
        raise TimeoutError("offline")
    return "True" if len(prompt) % 2 else "False"


@query("udf_external_judge", "SELECT p_partkey, NOT starts_with(p_type, 'E') AND length(p_type) % 2 = 1 AS verdict, starts_with(p_type, 'E') AS failed FROM part")
def udf_external_judge(t: Tables) -> DataFrame:
    """A verdict from an outside judge, three tries; false with an error where it fails. The judge is a function that the caller gives (here: an offline stub)."""
    return E.judged(t.part.select("p_partkey", F.col("p_type").alias("prompt")), "p_partkey", "prompt", _judge, wait=0.0).select("p_partkey", "verdict", F.col("error").isNotNull().alias("failed"))


@query("udf_retry_cascade", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'first' WHEN p_size % 3 = 1 THEN 'strict' ELSE 'repaired' END AS way FROM part")
def udf_retry_cascade(t: Tables) -> DataFrame:
    """Ways to an output one after another until one gives something."""
    ways = {"first": lambda r: r["p_name"] if r["p_size"] % 3 == 0 else None, "strict": lambda r: r["p_type"] if r["p_size"] % 3 == 1 else "", "repaired": lambda r: "repaired"}
    return E.parallel_map(t.part.select("p_partkey", "p_name", "p_type", "p_size"), E.cascade(ways, "p_partkey"), "p_partkey long, way string")


def _waits(row: dict) -> dict:
    waits: list[float] = []
    fails = iter([True] * row["failures"] + [False])

    def call(prompt: str) -> str:
        if next(fails):
            raise ConnectionError(prompt)
        return prompt

    reply, _ = E.with_retries(call, "ready", tries=7, sleep=waits.append)
    return {"s_suppkey": row["s_suppkey"], "failures": row["failures"], "waited": sum(waits), "reply": reply}


@query("udf_backoff", "SELECT s_suppkey, k AS failures, coalesce((SELECT sum(least(pow(2, i), 10)) FROM (SELECT unnest(generate_series(0, 5)) AS i) WHERE i < k), 0)::DOUBLE AS waited, CASE WHEN k < 7 THEN 'ready' END AS reply FROM (SELECT s_suppkey, s_suppkey % 8 AS k FROM supplier)")
def udf_backoff(t: Tables) -> DataFrame:
    """For each supplier a call that fails some times first, tried up to seven times: how many seconds it waits in all, and what it gives (the waits are noted, not slept)."""
    return E.parallel_map(t.supplier.select("s_suppkey", (F.col("s_suppkey") % 8).alias("failures")), _waits, "s_suppkey long, failures long, waited double, reply string")


@query("udtf_questions", "SELECT c_custkey, kind, n FROM (SELECT c_custkey, 'counting' AS kind, c_nationkey AS n FROM customer UNION ALL SELECT c_custkey, 'distance', CAST(floor(c_acctbal) AS INTEGER) FROM customer WHERE c_acctbal > 0)")
def udtf_questions(t: Tables) -> DataFrame:
    """Scenes (here: customers) become questions of several kinds."""
    row = lambda kind, n: F.struct(F.lit(kind).alias("kind"), n.cast("int").alias("n"))
    kinds = F.array(row("counting", F.col("c_nationkey")), F.when(F.col("c_acctbal") > 0, row("distance", F.floor("c_acctbal"))))
    return t.customer.select("c_custkey", F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("q")).select("c_custkey", "q.*")
