"""Scoring of model runs: merge and dedup of shards, accuracies, summaries, comparison of runs.

Stand-in: events are result rows. Three events make an id, the shard is event_id % 4, the position event_id, the question type event_type; the
prediction and the gold answer are letters of event_id, and a prediction is missing for every eleventh row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.bootstrap import bootstrap_intervals, interval
from ..operators.windows import first_per_key, percentiles
from ..operators.routing import route_cv
from .registry import Tables, query

R = """WITH r AS (SELECT event_id // 3 AS id, event_id % 4 AS shard, event_id AS pos, event_type AS type, value, ts,
    CASE WHEN event_id % 11 = 0 THEN NULL ELSE chr(CAST(65 + event_id % 4 AS INTEGER)) END AS predicted, chr(CAST(65 + (event_id // 3) % 4 AS INTEGER)) AS gold,
    CASE WHEN value > 30 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS accuracy FROM events),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY shard, pos) AS n FROM r) WHERE n = 1)
"""


def results(t: Tables) -> DataFrame:
    e = F.col("event_id")
    item = F.floor(e / 3)
    return t.events.select(
        item.alias("id"), (e % 4).alias("shard"), e.alias("pos"), F.col("event_type").alias("type"), "value", "ts",
        F.when(e % 11 != 0, T.letter(e % 4)).alias("predicted"), T.letter(item % 4).alias("gold"), F.when(F.col("value") > 30, 1.0).otherwise(0.0).alias("accuracy"),
    )


def merged(t: Tables) -> DataFrame:
    """Result rows without duplicate ids: the first by shard, then position, stays."""
    rows = results(t)  # a least row is aggregated before the shuffle, where a window would move and sort them all
    first = rows.groupBy("id").agg(F.min_by(F.struct(*(c for c in rows.columns if c != "id")), F.struct("shard", "pos")).alias("first"))
    return first.select("id", "first.*")


def mean_accuracy() -> Column:
    return F.coalesce(F.round(F.avg(F.coalesce("accuracy", F.lit(0.0))), 6), F.lit(0.0)).alias("accuracy")


def counts() -> list[Column]:
    return [F.sum("accuracy").alias("correct"), F.count("*").alias("total"), mean_accuracy()]


COUNTS = "sum(accuracy) AS correct, count(*) AS total, round(avg(accuracy), 6) AS accuracy"


@query("merge_dedup_first", R + "SELECT id, shard, pos, type, accuracy FROM m")
def merge_dedup_first(t: Tables) -> DataFrame:
    return merged(t).select("id", "shard", "pos", "type", "accuracy")


@query("merge_dedup_sorted", R + "SELECT id, shard, pos FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(id, 0) ORDER BY shard, pos) AS k FROM r) WHERE k = 1 ORDER BY id")
def merge_dedup_sorted(t: Tables) -> DataFrame:
    """As merge_dedup_first, where a missing id counts as 0, sorted by id."""
    return first_per_key(results(t).withColumn("id", F.coalesce("id", F.lit(0))), ["id"], ["shard", "pos"]).select("id", "shard", "pos").orderBy("id")


@query("agg_accuracy", R + f"SELECT {COUNTS} FROM m")
def agg_accuracy(t: Tables) -> DataFrame:
    return merged(t).agg(*counts())


@query("agg_accuracy_ok_only", R + "SELECT type, count(*) AS total, round(avg(accuracy), 6) AS accuracy FROM m WHERE predicted IS NOT NULL GROUP BY type")
def agg_accuracy_ok_only(t: Tables) -> DataFrame:
    return merged(t).where("predicted IS NOT NULL").groupBy("type").agg(F.count("*").alias("total"), mean_accuracy())


@query("agg_rethink_compare", R + "SELECT type, count(*) AS total, sum(CASE WHEN predicted = gold THEN 1 ELSE 0 END)::BIGINT AS first_correct, sum(accuracy)::BIGINT AS second_correct FROM m GROUP BY type")
def agg_rethink_compare(t: Tables) -> DataFrame:
    """First answers against those of a second pass, by type."""
    return merged(t).groupBy("type").agg(F.count("*").alias("total"), F.count_if(F.col("predicted") == F.col("gold")).alias("first_correct"), F.sum("accuracy").cast("long").alias("second_correct"))


@query("agg_split_extraction", R + "SELECT shard, count(*) AS total, sum(CASE WHEN predicted IS NULL THEN 1 ELSE 0 END)::BIGINT AS empty, sum(CASE WHEN predicted IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS extracted, sum(CASE WHEN predicted = gold THEN 1 ELSE 0 END)::BIGINT AS correct FROM m GROUP BY shard")
def agg_split_extraction(t: Tables) -> DataFrame:
    p = F.col("predicted")
    return merged(t).groupBy("shard").agg(F.count("*").alias("total"), F.count_if(p.isNull()).alias("empty"), F.count("predicted").alias("extracted"), F.count_if(p == F.col("gold")).alias("correct"))


@query("agg_answer_rate", R + "SELECT round(count(predicted)::DOUBLE / count(*), 6) AS answer_rate FROM m")
def agg_answer_rate(t: Tables) -> DataFrame:
    return merged(t).agg(F.round(F.count("predicted") / F.count("*"), 6).alias("answer_rate"))


@query("agg_by_group", R + f"SELECT type, {COUNTS} FROM m GROUP BY type")
def agg_by_group(t: Tables) -> DataFrame:
    return merged(t).groupBy("type").agg(*counts())


@query("agg_by_array_position", R + f"SELECT 0 AS position, type AS category, {COUNTS} FROM m GROUP BY type UNION ALL SELECT 1, CAST(shard AS VARCHAR), {COUNTS} FROM m GROUP BY shard")
def agg_by_array_position(t: Tables) -> DataFrame:
    """One scan groups by each entry of an array of categories."""
    rows = merged(t).select("accuracy", F.posexplode(F.array("type", F.col("shard").cast("string"))).alias("position", "category"))
    return rows.groupBy("position", "category").agg(*counts())


@query("agg_rollup_2level", R + f"SELECT type, CAST(shard AS VARCHAR) AS shard, {COUNTS} FROM m GROUP BY type, shard UNION ALL SELECT type, NULL, {COUNTS} FROM m GROUP BY type")
def agg_rollup_2level(t: Tables) -> DataFrame:
    return merged(t).withColumn("shard", F.col("shard").cast("string")).rollup("type", "shard").agg(*counts(), F.grouping_id().alias("level")).where("level < 3").drop("level")


@query("agg_prefix_category", R + f"SELECT CASE WHEN starts_with(type, 'si') THEN 'si' WHEN starts_with(type, 'c') THEN 'c' ELSE type END AS category, {COUNTS} FROM m GROUP BY 1")
def agg_prefix_category(t: Tables) -> DataFrame:
    """Types with a known prefix are one category; others stay."""
    name = F.col("type")
    category = F.coalesce(*(F.when(name.startswith(p), p) for p in ("si", "c")), name)
    return merged(t).groupBy(category.alias("category")).agg(*counts())


@query("agg_conditional_counts", R + "SELECT type, shard, count(*) AS total, count(predicted) AS has_answer, sum(CASE WHEN type = 'error' THEN 1 ELSE 0 END)::BIGINT AS errors FROM m GROUP BY type, shard")
def agg_conditional_counts(t: Tables) -> DataFrame:
    return merged(t).groupBy("type", "shard").agg(F.count("*").alias("total"), F.count("predicted").alias("has_answer"), F.count_if(F.col("type") == "error").alias("errors"))


MRA = "CASE WHEN gold = 0 OR predicted IS NULL OR gold IS NULL THEN 0.0::DOUBLE ELSE (" + " + ".join(f"CASE WHEN abs(predicted - gold) / abs(gold) < 1.0::DOUBLE - (0.5::DOUBLE + 0.05::DOUBLE * {i}) THEN 1 ELSE 0 END" for i in range(10)) + ") / 10.0::DOUBLE END"


@query("agg_mixed_metric", R + f""", x AS (SELECT type, id, accuracy, value AS predicted, CAST(pos % 97 AS DOUBLE) AS gold FROM m), y AS (SELECT type, id, accuracy, {MRA} AS mra FROM x)
SELECT type, count(*) AS total, round(avg(CASE WHEN id % 2 = 0 THEN mra ELSE accuracy END), 6) AS score FROM y GROUP BY type""")
def agg_mixed_metric(t: Tables) -> DataFrame:
    """Accuracy of letters, mean relative accuracy of numbers (here: even ids)."""
    mra = T.mean_relative_accuracy(F.col("value"), (F.col("pos") % 97).cast("double"))
    score = F.when(F.col("id") % 2 == 0, mra).otherwise(F.col("accuracy"))
    return merged(t).groupBy("type").agg(F.count("*").alias("total"), F.round(F.avg(score), 6).alias("score"))


@query("fn_mra", f"WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS predicted, CAST((l_orderkey + l_linenumber) % 50 AS DOUBLE) AS gold FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {MRA} AS mra FROM x")
def fn_mra(t: Tables) -> DataFrame:
    gold = ((F.col("l_orderkey") + F.col("l_linenumber")) % 50).cast("double")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", T.mean_relative_accuracy(F.col("l_quantity"), gold).alias("mra"))


@query("agg_value_histogram", R + "SELECT coalesce(predicted, 'None') AS answer, count(*) AS n FROM m GROUP BY 1")
def agg_value_histogram(t: Tables) -> DataFrame:
    return merged(t).groupBy(F.coalesce("predicted", F.lit("None")).alias("answer")).agg(F.count("*").alias("n"))


@query("agg_multi_run_sum", R + "SELECT type, sum(accuracy) AS correct, count(*) AS total FROM r GROUP BY type")
def agg_multi_run_sum(t: Tables) -> DataFrame:
    """Counts of each run (shard) are made first and summed."""
    runs = results(t).groupBy("shard", "type").agg(F.sum("accuracy").alias("c"), F.count("*").alias("n"))
    return runs.groupBy("type").agg(F.sum("c").alias("correct"), F.sum("n").alias("total"))


def summary(kind: str, value: str = "value") -> list[Column]:
    x = F.when(~F.isnan(value), F.col(value))
    r = lambda c, name: F.round(c, 6).alias(name)
    sample = r(F.coalesce(F.stddev_samp(x), F.lit(0.0)), "std")
    return {
        "pop": [r(F.avg(x), "mean"), r(F.stddev_pop(x), "std"), r(F.percentile(x, 0.5), "median"), F.min(x).alias("low"), F.max(x).alias("high"), F.count(x).alias("n")],
        "sample": [F.count(x).alias("n"), r(F.avg(x), "mean"), sample, *(r(F.percentile(x, p), name) for p, name in ((0.5, "median"), (0.25, "p25"), (0.75, "p75")))],
        "sem": [F.count(x).alias("n"), r(F.avg(x), "mean"), sample, r(F.coalesce(F.stddev_samp(x), F.lit(0.0)) / F.sqrt(F.count(x)), "sem")],
    }[kind]


@query("agg_summary_pop", "SELECT event_type AS type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(quantile_cont(value, 0.5), 6) AS median, min(value) AS low, max(value) AS high, count(value) AS n FROM events GROUP BY 1")
def agg_summary_pop(t: Tables) -> DataFrame:
    return t.events.groupBy(F.col("event_type").alias("type")).agg(*summary("pop"))


@query("agg_summary_sample", "SELECT user_id, count(value) AS n, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.75), 6) AS p75 FROM events GROUP BY user_id")
def agg_summary_sample(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(*summary("sample"))


@query("agg_summary_sem", "SELECT event_type AS type, count(value) AS n, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std, round(coalesce(stddev_samp(value), 0) / sqrt(count(value)), 6) AS sem FROM events GROUP BY 1")
def agg_summary_sem(t: Tables) -> DataFrame:
    return t.events.groupBy(F.col("event_type").alias("type")).agg(*summary("sem"))


@query("agg_percentile_linear", "SELECT l_returnflag, " + ", ".join(f"round(quantile_cont(l_extendedprice, {p}), 6) AS p{int(p * 100)}" for p in (0.1, 0.5, 0.9)) + " FROM lineitem GROUP BY l_returnflag")
def agg_percentile_linear(t: Tables) -> DataFrame:
    shares = (0.1, 0.5, 0.9)
    found = percentiles(t.lineitem, "l_returnflag", "l_extendedprice", shares)
    return found.select("l_returnflag", *(F.round(f"p{k}", 6).alias(f"p{int(p * 100)}") for k, p in enumerate(shares)))


@query("agg_nanmean", "SELECT event_type AS type, round(avg(CASE WHEN event_id % 7 <> 0 THEN value END), 6) AS mean FROM events GROUP BY 1")
def agg_nanmean(t: Tables) -> DataFrame:
    """Mean of what is a number (here: every seventh value is none)."""
    x = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return t.events.withColumn("x", x).groupBy(F.col("event_type").alias("type")).agg(F.round(F.avg(F.when(~F.isnan("x"), F.col("x"))), 6).alias("mean"))


@query("agg_multi_dim", R + f"SELECT 'all' AS dimension, 'all' AS name, {COUNTS} FROM m UNION ALL SELECT 'type', type, {COUNTS} FROM m GROUP BY type UNION ALL SELECT 'shard', CAST(shard AS VARCHAR), {COUNTS} FROM m GROUP BY shard")
def agg_multi_dim(t: Tables) -> DataFrame:
    """The same measures over several dimensions, in one pass."""
    rows = merged(t).select("accuracy", F.explode(F.array(F.struct(F.lit("all").alias("dimension"), F.lit("all").alias("name")), F.struct(F.lit("type").alias("dimension"), F.col("type").alias("name")), F.struct(F.lit("shard").alias("dimension"), F.col("shard").cast("string").alias("name")))).alias("d"))
    return rows.groupBy("d.dimension", "d.name").agg(*counts())


@query("agg_score_distribution", "WITH s AS (SELECT event_type AS type, CAST(1 + floor(least(value, 499) / 100) AS INTEGER) AS score FROM events), n AS (SELECT type, count(*) AS total, " + ", ".join(f"sum(CASE WHEN score = {k} THEN 1 ELSE 0 END)::BIGINT AS n{k}" for k in range(1, 6)) + " FROM s GROUP BY type) SELECT type, total, n1, n2, n3, n4, n5, round(100.0 * n1 / total, 6)::DOUBLE AS share1 FROM n")
def agg_score_distribution(t: Tables) -> DataFrame:
    """How often each score from 1 to 5 was given; a score never given counts 0."""
    score = (1 + F.floor(F.least("value", F.lit(499.0)) / 100)).cast("int")
    n = t.events.groupBy(F.col("event_type").alias("type")).agg(F.count("*").alias("total"), *(F.count_if(score == k).alias(f"n{k}") for k in range(1, 6)))
    return n.withColumn("share1", F.round(F.lit(100.0) * F.col("n1") / F.col("total"), 6))


@query("agg_group_plus_total", R + f"SELECT type, {COUNTS} FROM m GROUP BY type UNION ALL SELECT 'overall', {COUNTS} FROM m")
def agg_group_plus_total(t: Tables) -> DataFrame:
    return merged(t).rollup("type").agg(*counts(), F.grouping("type").alias("g")).withColumn("type", F.when(F.col("g") == 1, "overall").otherwise(F.col("type"))).drop("g")


#: Bands of layers that overlap, as (name, first, last).
BANDS = (("early", 1, 2), ("middle", 3, 5), ("late", 6, 7), ("all", 1, 7))


@query("agg_range_bands", "WITH l AS (SELECT l_linenumber AS layer, avg(l_discount) AS mass FROM lineitem GROUP BY 1), b AS (" + " UNION ALL ".join(f"SELECT '{n}' AS band, {a} AS first, {b} AS last" for n, a, b in BANDS) + ") SELECT band, round(avg(mass), 6) AS mass FROM l JOIN b ON layer BETWEEN first AND last GROUP BY band")
def agg_range_bands(t: Tables) -> DataFrame:
    """Means of layers' means over bands; a layer is handed to all of its bands, so no join is needed."""
    layer = F.col("layer")
    layers = t.lineitem.groupBy(F.col("l_linenumber").alias("layer")).agg(F.avg("l_discount").alias("mass"))
    bands = F.filter(F.array(*(F.when(layer.between(a, b), n) for n, a, b in BANDS)), lambda x: x.isNotNull())
    return layers.withColumn("band", F.explode(bands)).groupBy("band").agg(F.round(F.avg("mass"), 6).alias("mass"))


@query("agg_compact_string", R + ", c AS (SELECT shard, type, count(*) AS n FROM m GROUP BY shard, type) SELECT shard, string_agg(type || ':' || n, '; ' ORDER BY type) AS types FROM c GROUP BY shard")
def agg_compact_string(t: Tables) -> DataFrame:
    c = merged(t).groupBy("shard", "type").agg(F.count("*").alias("n"))
    return c.groupBy("shard").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("type", "n"))), lambda x: F.concat(x["type"], F.lit(":"), x["n"].cast("string"))), "; ").alias("types"))


@query("agg_coverage", R + "SELECT 'predicted' AS name, count(predicted) AS k, count(*) AS n, count(predicted) || '/' || count(*) AS coverage FROM m UNION ALL SELECT 'gold', count(gold), count(*), count(gold) || '/' || count(*) FROM m")
def agg_coverage(t: Tables) -> DataFrame:
    one = merged(t).agg(F.count("predicted").alias("predicted"), F.count("gold").alias("gold"), F.count("*").alias("n"))
    long = one.unpivot("n", ["predicted", "gold"], "name", "k")
    return long.select("name", "k", "n", F.concat_ws("/", F.col("k").cast("string"), F.col("n").cast("string")).alias("coverage"))


@query("agg_counter_top", R + "SELECT type, count(*) AS n FROM r GROUP BY type ORDER BY n DESC, min(pos) LIMIT 3")
def agg_counter_top(t: Tables) -> DataFrame:
    """The three most common types; of equally common ones the first seen."""
    return results(t).groupBy("type").agg(F.count("*").alias("n"), F.min("pos").alias("seen")).orderBy(F.desc("n"), "seen").limit(3).drop("seen")


@query("agg_flatten_metrics", R + ", o AS (SELECT count(*) AS n, sum(accuracy) AS c FROM m) SELECT 'overall.count' AS name, n::DOUBLE AS value FROM o UNION ALL SELECT 'overall.correct', c FROM o")
def agg_flatten_metrics(t: Tables) -> DataFrame:
    """Nested metrics as rows of dotted names."""
    nested = merged(t).agg(F.struct(F.count("*").alias("count"), F.sum("accuracy").alias("correct")).alias("overall"))
    return flatten_metrics(nested)


def flatten_metrics(row: DataFrame) -> DataFrame:
    names: list[tuple[str, str]] = []

    def walk(schema, prefix: str) -> None:
        for f in schema.fields:
            if hasattr(f.dataType, "fields"):
                walk(f.dataType, f"{prefix}{f.name}.")
            else:
                names.append((prefix + f.name, prefix + f.name))

    walk(row.schema, "")
    return row.select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(c).cast("double").alias("value")) for n, c in names))).alias("x")).select("x.*")


DRAWS = 50


# Poisson(1) by inversion: the chances of 0, 1, ... 6 or fewer events are fixed values.
CHANCES = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676)


def _bootstrap_sql(rows: str, seed: int) -> str:
    digits = " + ".join(f"(strpos('0123456789abcdef', substr(h, {i}, 1)) - 1) * {16 ** (7 - i)}" for i in range(1, 8))
    weight = " + ".join(f"CASE WHEN u >= {c}::DOUBLE THEN 1 ELSE 0 END" for c in CHANCES)
    return f"""{rows}, d AS (SELECT type, accuracy AS x, b, md5('{seed}|' || b || '|' || id) AS h FROM ({{0}}), (SELECT unnest(generate_series(1, {DRAWS})) AS b)),
    w AS (SELECT type, b, x, {weight} AS w FROM (SELECT type, b, x, ({digits}) / {1 << 28}::DOUBLE AS u FROM d)),
    s AS (SELECT type, b, sum(x * w) AS xw, sum(w) AS w FROM w GROUP BY 1, 2),
    t AS (SELECT "group", b, sum(xw) / nullif(sum(w), 0)::DOUBLE AS mean FROM (SELECT type AS "group", b, xw, w FROM s UNION ALL SELECT 'overall', b, xw, w FROM s) GROUP BY 1, 2)
    SELECT "group", {", ".join(f"round(quantile_cont(mean, {p}), 6) AS {n}" for p, n in QUANTILES)} FROM t GROUP BY 1"""


QUANTILES = ((0.025, "low"), (0.5, "median"), (0.975, "high"))


@query("agg_bootstrap_poisson", _bootstrap_sql(R, 42).format("SELECT type, accuracy, id FROM m"))
def agg_bootstrap_poisson(t: Tables) -> DataFrame:
    """Percentile interval of the accuracy by a Poisson bootstrap: each row draws its own weight for every resample from a hash, so resamples
    need no index into the rows, and only sums by type and resample are shuffled. Resamples by type and overall."""
    return poisson_bootstrap(merged(t), "type", "accuracy", "id", DRAWS)


def poisson_bootstrap(rows: DataFrame, group: str, value: str, key: str, draws: int, seed: int = 42) -> DataFrame:
    hashed = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("b").cast("string"), F.col(key).cast("string")).cast("binary"))
    u = F.conv(F.substring(hashed, 1, 7), 16, 10).cast("double") / float(1 << 28)
    drawn = rows.select(F.col(group).alias("group"), key, F.col(value).alias("x"), F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("b")).withColumn("u", u)
    drawn = drawn.withColumn("w", sum((F.when(F.col("u") >= c, 1).otherwise(0) for c in CHANCES), F.lit(0)))
    sums = drawn.groupBy("group", "b").agg(F.sum(F.col("x") * F.col("w")).alias("xw"), F.sum("w").alias("w"))
    both = sums.withColumn("group", F.explode(F.array("group", F.lit("overall"))))
    means = both.groupBy("group", "b").agg((F.sum("xw") / F.nullif(F.sum("w").cast("double"), F.lit(0.0))).alias("mean"))
    return means.groupBy("group").agg(*(F.round(F.percentile("mean", p), 6).alias(n) for p, n in QUANTILES))


@query("agg_bootstrap_ci", None)
def agg_bootstrap_ci(t: Tables) -> DataFrame:
    """Accuracy, and its percentile interval over ten thousand resamples of the rows, by type and overall."""
    return bootstrap_intervals(merged(t), "type", "accuracy").select("group", "n", *(F.round(c, 6).alias(c) for c in ("mean", "low", "median", "high")))


@query("udaf_bootstrap", None)
def udaf_bootstrap(t: Tables) -> DataFrame:
    """The interval as an aggregate beside others, over parsed answers counted by value; by type."""
    counts = merged(t).where("predicted IS NOT NULL").groupBy("type", "accuracy").agg(F.count("*").alias("n"), F.max("pos").alias("last"))
    by = counts.groupBy("type").agg(F.sum("n").alias("n"), F.max("last").alias("last"), interval(F.collect_list(F.struct(F.col("accuracy").alias("value"), "n"))).alias("i"))
    return by.select("type", "n", "last", *(F.round(F.col("i")[c], 6).alias(c) for c in ("mean", "low", "high")))


@query("agg_uplift", R + ", a AS (SELECT shard, avg(accuracy) AS acc FROM r GROUP BY shard) SELECT a.shard, round((a.acc - b.acc) * 100, 6) AS points FROM a JOIN a b ON b.shard = 0 WHERE a.shard <> 0")
def agg_uplift(t: Tables) -> DataFrame:
    """Points of accuracy above the baseline run (shard 0)."""
    return uplift(results(t)).select("shard", F.round((F.col("acc") - F.col("base")) * 100, 6).alias("points"))


def uplift(rows: DataFrame) -> DataFrame:
    acc = rows.groupBy("shard").agg(F.avg("accuracy").alias("acc"))
    every = Window.partitionBy()
    return acc.withColumn("base", F.max(F.when(F.col("shard") == 0, F.col("acc"))).over(every)).where("shard <> 0")


@query("agg_uplift_norm", R + ", a AS (SELECT shard, avg(accuracy) AS acc FROM r GROUP BY shard) SELECT a.shard, round((a.acc - b.acc) / nullif(1 - b.acc, 0), 6) AS uplift FROM a JOIN a b ON b.shard = 0 WHERE a.shard <> 0")
def agg_uplift_norm(t: Tables) -> DataFrame:
    return uplift(results(t)).select("shard", F.round((F.col("acc") - F.col("base")) / F.nullif(1 - F.col("base"), F.lit(0.0)), 6).alias("uplift"))


# Runs side by side: an item is seven events in a row, a run is an event type, which not every item has.
X = """WITH x AS (SELECT event_id // 7 AS item, event_type AS run, max(CASE WHEN value > 60 THEN 1 ELSE 0 END) AS ok, min(chr(CAST(65 + event_id % 3 AS INTEGER))) AS answer FROM events GROUP BY 1, 2),
common AS (SELECT item FROM x GROUP BY item HAVING count(DISTINCT run) = (SELECT count(DISTINCT run) FROM x)), c AS (SELECT x.* FROM x JOIN common USING (item))
"""


def runs(t: Tables) -> DataFrame:
    return t.events.groupBy(F.floor(F.col("event_id") / 7).alias("item"), F.col("event_type").alias("run")).agg(F.max(F.when(F.col("value") > 60, 1).otherwise(0)).alias("ok"), F.min(T.letter(F.col("event_id") % 3)).alias("answer"))


def common_items(rows: DataFrame, item: str = "item", run: str = "run") -> DataFrame:
    """The rows whose item occurs in every run."""
    n = rows.select(run).distinct().count()
    whole = rows.groupBy(item).agg(F.countDistinct(run).alias("n")).where(F.col("n") == n).select(item)
    return rows.join(whole, item, "left_semi")


@query("join_nway_intersection", X + "SELECT item FROM common")
def join_nway_intersection(t: Tables) -> DataFrame:
    return common_items(runs(t)).select("item").distinct()


@query("set_intersect", X + "SELECT item FROM x WHERE run = 'view' INTERSECT SELECT item FROM x WHERE run = 'click'")
def set_intersect(t: Tables) -> DataFrame:
    x = runs(t)
    return x.where("run = 'view'").select("item").intersect(x.where("run = 'click'").select("item"))


@query("dec_paired_filter", X + "SELECT run, count(*) AS n, sum(ok)::BIGINT AS correct FROM c GROUP BY run")
def dec_paired_filter(t: Tables) -> DataFrame:
    return common_items(runs(t)).groupBy("run").agg(F.count("*").alias("n"), F.sum("ok").alias("correct"))


@query("dec_oracle", X + ", i AS (SELECT item, max(ok) AS any_ok FROM c GROUP BY item), s AS (SELECT max(a) AS best FROM (SELECT run, avg(ok) AS a FROM c GROUP BY run)) SELECT count(*) AS n, round(avg(any_ok), 6) AS oracle, round(max(best), 6) AS best_single, round(avg(any_ok) - max(best), 6) AS gain FROM i, s")
def dec_oracle(t: Tables) -> DataFrame:
    """Accuracy if the right run was chosen for each item, and its gain over the best single run."""
    c = common_items(runs(t))
    oracle = c.groupBy("item").agg(F.max("ok").alias("any_ok")).agg(F.count("*").alias("n"), F.avg("any_ok").alias("o"))
    best = c.groupBy("run").agg(F.avg("ok").alias("a")).agg(F.max("a").alias("b"))
    return oracle.join(best).select("n", F.round("o", 6).alias("oracle"), F.round("b", 6).alias("best_single"), F.round(F.col("o") - F.col("b"), 6).alias("gain"))


@query("dec_complementarity", X + ", i AS (SELECT item, sum(ok)::BIGINT AS k FROM c GROUP BY item) SELECT k AS n_correct, count(*) AS items FROM i GROUP BY k")
def dec_complementarity(t: Tables) -> DataFrame:
    """How many items how many runs get right."""
    return common_items(runs(t)).groupBy("item").agg(F.sum("ok").alias("n_correct")).groupBy("n_correct").agg(F.count("*").alias("items"))


@query("dec_complementarity_pairs", X + "SELECT a.run AS run_a, b.run AS run_b, count(*) AS only_a FROM c a JOIN c b ON a.item = b.item AND a.run <> b.run WHERE a.ok = 1 AND b.ok = 0 GROUP BY 1, 2")
def dec_complementarity_pairs(t: Tables) -> DataFrame:
    c = common_items(runs(t))
    a, b = c.where("ok = 1").select("item", F.col("run").alias("run_a")), c.where("ok = 0").select("item", F.col("run").alias("run_b"))
    return a.join(b, "item").groupBy("run_a", "run_b").agg(F.count("*").alias("only_a"))


@query("dec_plurality_vote", X + """, p AS (SELECT run, row_number() OVER (ORDER BY avg(ok) DESC, run) AS priority FROM c GROUP BY run),
v AS (SELECT item, answer, count(*) AS votes, min(priority) AS priority FROM c JOIN p USING (run) GROUP BY item, answer),
w AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY votes DESC, priority) AS k FROM v)
SELECT w.item, w.answer, w.votes, c.ok AS correct FROM w JOIN p ON p.priority = w.priority JOIN c ON c.item = w.item AND c.run = p.run WHERE k = 1""")
def dec_plurality_vote(t: Tables) -> DataFrame:
    """The answer with most votes; a tie goes to the run with the best accuracy, whose verdict on the answer counts."""
    c = common_items(runs(t))
    p = c.groupBy("run").agg(F.avg("ok").alias("a")).withColumn("priority", F.row_number().over(Window.orderBy(F.desc("a"), "run"))).drop("a")
    v = c.join(F.broadcast(p), "run").groupBy("item", "answer").agg(F.count("*").alias("votes"), F.min("priority").alias("priority"), F.min_by("ok", "priority").alias("correct"))
    return first_per_key(v, ["item"], [F.desc("votes"), "priority"]).select("item", "answer", "votes", "correct")


@query("dec_routed_accuracy", X + """, best AS (SELECT run FROM c GROUP BY run ORDER BY avg(ok) DESC, run LIMIT 1),
r AS (SELECT DISTINCT item, CASE item % 4 WHEN 0 THEN 'view' WHEN 1 THEN 'click' WHEN 2 THEN 'error' END AS route FROM c)
SELECT coalesce(route, best.run) AS run, count(*) AS n, round(avg(c.ok), 6) AS accuracy FROM r, best JOIN c ON c.item = r.item AND c.run = coalesce(route, best.run) GROUP BY 1""".replace("FROM r, best JOIN c", "FROM r CROSS JOIN best JOIN c"))
def dec_routed_accuracy(t: Tables) -> DataFrame:
    """Accuracy of the routed runs; an item without a route goes to the best single run."""
    c = common_items(runs(t))
    best = c.groupBy("run").agg(F.avg("ok").alias("a")).orderBy(F.desc("a"), "run").limit(1).select(F.col("run").alias("best"))
    route = F.coalesce(F.when(F.col("item") % 4 == 0, "view"), F.when(F.col("item") % 4 == 1, "click"), F.when(F.col("item") % 4 == 2, "error"), F.col("best"))
    return c.join(F.broadcast(best)).where(F.col("run") == route).groupBy("run").agg(F.count("*").alias("n"), F.round(F.avg("ok"), 6).alias("accuracy"))


@query("dec_pick_run", X + "SELECT run, round(100 * avg(ok), 6) AS accuracy FROM x GROUP BY run HAVING abs(100 * avg(ok) - 38) <= 15 ORDER BY run LIMIT 1")
def dec_pick_run(t: Tables) -> DataFrame:
    """The first run whose accuracy is near an expected one (here: within 15 points of 38)."""
    return runs(t).groupBy("run").agg(F.round(100 * F.avg("ok"), 6).alias("accuracy")).where(F.abs(F.col("accuracy") - 38) <= 15).orderBy("run").limit(1)


@query("dec_gen_vs_gt", X + ", a AS (SELECT run, avg(ok) AS acc FROM x GROUP BY run) SELECT p.x AS generated, p.y AS truth, round(a.acc - b.acc, 6) AS delta FROM (SELECT 'view' AS x, 'click' AS y UNION ALL SELECT 'error', 'signup') p JOIN a ON a.run = p.x JOIN a b ON b.run = p.y")
def dec_gen_vs_gt(t: Tables) -> DataFrame:
    """Differences of accuracy between fixed pairs of conditions."""
    pairs = {"view": "click", "error": "signup"}
    acc = runs(t).groupBy("run").agg(F.avg("ok").alias("acc"))
    wide = acc.groupBy().pivot("run", sorted({*pairs, *pairs.values()})).agg(F.first("acc"))
    return wide.select(F.explode(F.array(*(F.struct(F.lit(a).alias("generated"), F.lit(b).alias("truth"), F.round(F.col(a) - F.col(b), 6).alias("delta")) for a, b in pairs.items()))).alias("p")).select("p.*")


@query("dec_pivot_report", "SELECT event_type AS method, " + ", ".join(f"coalesce(CAST(sum(CASE WHEN user_id % 40 = {k} AND event_id % 3 = 0 THEN 1 END) AS VARCHAR), '—') AS t{k}" for k in range(3)) + " FROM events GROUP BY 1")
def dec_pivot_report(t: Tables) -> DataFrame:
    """Methods by types, with a dash where nothing is."""
    wide = t.events.withColumn("k", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("t"), F.col("user_id") % 40))).groupBy(F.col("event_type").alias("method")).pivot("k", ["t0", "t1", "t2"]).agg(F.count(F.lit(1)))
    return wide.select("method", *(F.coalesce(F.col(c).cast("string"), F.lit("—")).alias(c) for c in ("t0", "t1", "t2")))


@query("set_agreement2", X + ", w AS (SELECT item, max(CASE WHEN run = 'view' THEN ok END) AS a, max(CASE WHEN run = 'click' THEN ok END) AS b FROM c GROUP BY item) SELECT CASE WHEN a = 1 AND b = 1 THEN 'both' WHEN a = 1 THEN 'a_only' WHEN b = 1 THEN 'b_only' ELSE 'neither' END AS agreement, count(*) AS n FROM w GROUP BY 1")
def set_agreement2(t: Tables) -> DataFrame:
    w = common_items(runs(t)).groupBy("item").pivot("run", ["view", "click"]).agg(F.max("ok"))
    a, b = F.col("view") == 1, F.col("click") == 1
    return w.groupBy(F.when(a & b, "both").when(a, "a_only").when(b, "b_only").otherwise("neither").alias("agreement")).agg(F.count("*").alias("n"))


@query("set_agreement_n", X + ", g AS (SELECT item, string_agg(CASE WHEN ok = 1 THEN run END, '+' ORDER BY run) AS who, sum(ok) AS k, count(*) AS n FROM c GROUP BY item) SELECT CASE WHEN k = n THEN 'all' WHEN k = 0 THEN 'none' WHEN k = 1 THEN 'only_' || who ELSE 'mixed:' || who END AS agreement, count(*) AS items FROM g GROUP BY 1")
def set_agreement_n(t: Tables) -> DataFrame:
    g = common_items(runs(t)).groupBy("item").agg(F.array_sort(F.collect_list(F.when(F.col("ok") == 1, F.col("run")))).alias("who"), F.count("*").alias("n"))
    k, who = F.size("who"), F.array_join("who", "+")
    kind = F.when(k == F.col("n"), "all").when(k == 0, "none").when(k == 1, F.concat(F.lit("only_"), who)).otherwise(F.concat(F.lit("mixed:"), who))
    return g.groupBy(kind.alias("agreement")).agg(F.count("*").alias("items"))


@query("set_wins", X + ", w AS (SELECT item, max(CASE WHEN run = 'view' THEN ok END) AS a, max(CASE WHEN run = 'click' THEN ok END) AS b, max(CASE WHEN run = 'error' THEN ok END) AS c FROM c GROUP BY item) SELECT item, a = 1 AND b = 0 AND c = 0 AS strict, a = 1 AND (b = 0 OR c = 0) AS beats_any FROM w")
def set_wins(t: Tables) -> DataFrame:
    w = common_items(runs(t)).groupBy("item").pivot("run", ["view", "click", "error"]).agg(F.max("ok"))
    a, b, c = F.col("view") == 1, F.col("click") == 0, F.col("error") == 0
    return w.select("item", (a & b & c).alias("strict"), (a & (b | c)).alias("beats_any"))


@query("set_except", X + "SELECT item FROM x WHERE run = 'view' EXCEPT SELECT item FROM x WHERE run = 'click' AND ok = 1")
def set_except(t: Tables) -> DataFrame:
    x = runs(t)
    return x.where("run = 'view'").select("item").subtract(x.where("run = 'click' AND ok = 1").select("item"))


@query("set_overlap_count", X + "SELECT count(*) AS shared FROM (SELECT item FROM x WHERE run = 'view' INTERSECT SELECT item FROM x WHERE run = 'error' AND ok = 1)")
def set_overlap_count(t: Tables) -> DataFrame:
    x = runs(t)
    return x.where("run = 'view'").select("item").intersect(x.where("run = 'error' AND ok = 1").select("item")).agg(F.count("*").alias("shared"))


@query("set_union_all", "SELECT c_custkey AS key, c_name AS name, 'customer' AS origin, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, 'supplier', NULL FROM supplier")
def set_union_all(t: Tables) -> DataFrame:
    """Sources one behind the other; a column that one lacks is null there."""
    a = t.customer.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.lit("customer").alias("origin"), F.col("c_mktsegment").alias("segment"))
    b = t.supplier.select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.lit("supplier").alias("origin"))
    return a.unionByName(b, allowMissingColumns=True)


@query("dec_router_cv", None)
def dec_router_cv(t: Tables) -> DataFrame:
    """Routing by feature vectors, cross-validated with logistic heads: of each benchmark and fold how many rows there are, how many the route, the pooled route, the best single expert and any
    expert get right. An expert (here: each label) is right for its own label; vectors of even and odd ids are two benchmarks. More than a thousand experts are an error."""
    labels = [r[0] for r in t.embeddings.select("label").distinct().orderBy("label").limit(1_001).collect()]
    if len(labels) > 1_000:
        raise ValueError("more than 1000 experts")
    y = F.transform(F.array(*map(F.lit, labels)), lambda x: x.eqNullSafe(F.col("label")).cast("double"))
    rows = t.embeddings.select(F.col("vec_id").alias("id"), (F.col("vec_id") % 2).alias("bench"), F.col("embedding").alias("x"), y.alias("y"))
    found = route_cv(rows).join(rows.select("id", "y"), "id")
    right = lambda c: F.sum(F.get("y", F.col(c)).cast("long"))
    singles = F.greatest(*(F.sum(F.get("y", F.lit(k))) for k in range(len(labels))), F.lit(0.0)).cast("long")
    return found.groupBy("bench", "fold").agg(F.count("*").alias("n"), right("route").alias("correct"), right("pooled").alias("pooled"), singles.alias("best_single"), F.sum(F.array_max("y")).cast("long").alias("oracle"))
