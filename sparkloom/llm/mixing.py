"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations alone.

A source's words, its documents in hash order, are an endless stream that repeats the source. The mix is a schedule of slots of
BLOCK words. Slot i falls on the van der Corput point of i, which the sources' cumulative shares map to a source, so every
stretch of the schedule is near the target weights: of its first n slots a source has its share to within log2(n) + 2. A source's slots are ranked, and slot
number r takes block r of its stream. The last slot of a source is cut so that it takes floor(target) words; slots beyond are skipped and
missing ones stand at the end. So the schedule says in what order the mix takes blocks, and its targets how many of each source.

Targets share all words by weight. A source's target stops at `most` times its size, and the excess is shared by weight among
the rest. Sorted by size over weight, the sources that stop are a prefix, so running sums give the fixed point at once.

Ranks and stream positions are running sums in levels: inside of bounded chunks and over the chunks' totals, so no task gets a whole source. Two
joins by equality place slots: on the cell of a grid over the shares, and on source and block. Nothing is broadcast but what Spark finds
small by itself. Only the sources themselves (a row each) are numbered and summed in one task.

A document of size 0, also one with a null text, is never taken. A null source comes last. A null doc_id is a document like others. Repeated rows are
documents of their own. Without any word nothing is taken. A very long document takes many blocks. Results depend on the rows alone, not on their order or
partitions. Other columns of the input may have any name that doesn't begin with two underscores.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import all_of, cut, row_mark

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK = 8_192  #: words a slot
CHUNK = 1 << 14  #: slots ranked together
DOCS = 1_024  #: documents put in order together, about
_COARSE = 12  #: bits of the buckets whose totals are summed together
_BITS = 40  #: of a van der Corput point; also the most slots


def sizes(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", also: Sequence[Column] = ()) -> DataFrame:
    words = F.regexp_count(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    return docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), words.cast("long").alias("size"), F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("|mix")).cast("binary")).alias("h"), *also)


def targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, number, source_size, target and quota (whole words) of each source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("number", F.row_number().over(by_name) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod("number", F.lit(len(weights))).cast("int") + 1)).withColumn("cap", F.lit(most) * F.col("source_size"))
    before = Window.orderBy(F.col("cap") / F.col("weight"), "number").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    s = s.select(
        "*", F.sum("source_size").over(every).alias("total"), F.sum("weight").over(every).alias("weights"), F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("caps"), F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("capped")
    ).withColumn("stops", F.col("cap") * (F.col("weights") - F.col("capped")) <= (F.col("total") - F.col("caps")) * F.col("weight"))
    stopped = lambda c: F.coalesce(F.sum(F.when(F.col("stops"), F.col(c))).over(every), F.lit(0))
    share = ((F.col("total") - stopped("cap")) * F.col("weight")).cast("double") / F.nullif((F.col("weights") - stopped("weight")).cast("double"), F.lit(0.0))
    s = s.withColumn("target", F.when(F.col("stops"), F.col("cap").cast("double")).otherwise(share))
    return s.select("source", F.col("number").cast("long").alias("number"), "source_size", "target", F.floor("target").alias("quota"))


def schedule(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """number (of the source), rank and slot (the place in the schedule) of each slot; sources: number and quota."""
    spark = sources.sparkSession
    plan = sources.where("quota > 0").select("number", "quota", F.ceil(F.col("quota") / block).alias("slots"))
    n, n_sources = plan.agg(F.coalesce(F.sum("slots"), F.lit(0)), F.count("*")).first()
    if n > 1 << _BITS:
        raise ValueError(f"{n} slots are more than 2**{_BITS}: use larger blocks")
    running = Window.orderBy("number")
    cells = 1 << max(10, int(n_sources).bit_length())
    share = plan.select("*", F.sum("quota").over(Window.partitionBy()).alias("all"), F.sum("quota").over(running).alias("to")).select("number", "slots", ((F.col("to") - F.col("quota")) / F.col("all")).alias("low"), F.when(F.col("to") == F.col("all"), 1.0).otherwise(F.col("to") / F.col("all")).alias("high"))
    grid = share.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * cells), F.least(F.ceil(F.col("high") * cells) - 1, F.lit(cells - 1)))))
    point = F.conv(F.reverse(F.lpad(F.bin("id"), _BITS, "0")), 2, 10).cast("double") / float(1 << _BITS)
    points = spark.range(int(n)).select("id", point.alias("x")).withColumn("cell", F.floor(F.col("x") * cells))
    drawn = points.join(grid, "cell").where("x >= low AND x < high").select("number", "slots", "id", F.floor(F.col("id") / CHUNK).alias("chunk"))
    counts = drawn.groupBy("number", "chunk").count()
    earlier = counts.withColumn("earlier", F.coalesce(F.sum("count").over(Window.partitionBy("number").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = drawn.withColumn("inside", F.row_number().over(Window.partitionBy("number", "chunk").orderBy("id")) - 1)
    ranked = inside.join(earlier, ["number", "chunk"]).select("number", "slots", (F.col("earlier") + F.col("inside")).alias("rank"), F.col("id").alias("slot")).where("rank < slots").select("number", "rank", "slot")
    got = counts.groupBy("number").agg(F.sum("count").alias("got"))
    short = plan.join(got, "number", "left").select("number", "slots", F.coalesce("got", F.lit(0)).cast("long").alias("got")).where("got < slots")
    before = F.coalesce(F.sum(F.col("slots") - F.col("got")).over(running.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    missing = short.withColumn("before", before).withColumn("rank", F.explode(F.sequence(F.col("got"), F.col("slots") - 1)))
    return ranked.unionByName(missing.select("number", "rank", (F.lit(int(n)) + F.col("before") + F.col("rank") - F.col("got")).alias("slot")))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, block: int = BLOCK, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted), first_slot (the first that takes words of it, -1 if none does) and n_blocks (how often one does) of every document."""
    return _mix(docs, weights, most, block, key, text, source).drop("turns")


def _earlier(sums: DataFrame) -> DataFrame:
    """Of words by number and bucket those of earlier buckets, summed in two levels."""
    sums = sums.withColumn("coarse", F.shiftright("bucket", _COARSE))
    before = lambda *keys: Window.partitionBy("number", *keys).rowsBetween(Window.unboundedPreceding, -1)
    total = lambda w: F.coalesce(F.sum("words").over(w), F.lit(0))
    far = sums.groupBy("number", "coarse").agg(F.sum("words").alias("words")).select("number", "coarse", total(before().orderBy("coarse")).alias("far"))
    near = sums.select("number", "coarse", "bucket", total(before("coarse").orderBy("bucket")).alias("near"))
    return near.join(far, ["number", "coarse"]).select("number", "bucket", (F.col("near") + F.col("far")).alias("earlier"))


def _mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, block: int = BLOCK, key: str = "doc_id", text: str = "text", source: str = "source", also: dict[str, Column] = {}) -> DataFrame:  # noqa: B006
    """The mix with turns (the slots at which a document is begun, once a repeat of its source) and the columns also (by name), which order rows of one doc_id and size."""
    sized = cut(sizes(docs, key, text, source, [c.alias(name) for name, c in also.items()]), "sizes")
    sources = cut(targets(sized, weights, most), "sources")
    bits = min(28, max(1, sized.count() // DOCS).bit_length())
    bucket = F.shiftright(F.conv(F.substring("h", 1, 8), 16, 10).cast("long"), 32 - bits)
    placed = sized.join(sources, sized["source"].eqNullSafe(sources["source"])).select("doc_id", "size", "h", "number", "source_size", "target", "quota", bucket.alias("bucket"), *also)
    earlier = _earlier(placed.groupBy("number", "bucket").agg(F.sum("size").alias("words")))
    order = Window.partitionBy("number", "bucket").orderBy("h", "doc_id", "size", *also)
    inside = placed.select("*", F.row_number().over(order).alias("n"), F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("to"))
    streamed = inside.join(earlier, ["number", "bucket"]).withColumn("first", F.col("earlier") + F.col("to") - F.col("size"))
    rounds = F.greatest(F.ceil(F.col("quota") / F.greatest("source_size", F.lit(1))), F.lit(1))
    turns = streamed.withColumn("round", F.explode(F.sequence(F.lit(0).cast("long"), rounds - 1))).withColumn("start", F.col("first") + F.col("round") * F.col("source_size"))
    last = F.col("start") + F.col("size") - 1
    blocks = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / block), F.floor(last / block)))
    parts = turns.withColumn("rank", F.explode_outer(blocks))
    slots = schedule(sources, block)
    low, high = F.greatest("start", F.col("rank") * block), F.least(F.col("start") + F.col("size"), (F.col("rank") + 1) * block, "quota")
    got = F.when(F.col("slot").isNotNull() & (high > low), high - low)
    taken = parts.join(slots, ["number", "rank"], "left").withColumn("got", got).withColumn("slot", F.when(F.col("got").isNotNull(), F.col("slot")))
    begun = F.array_compact(F.array(*(F.min(F.when(F.col("round") == r, F.col("slot"))) for r in range(most))))
    whole = taken.groupBy("number", "bucket", "n").agg(
        *(F.first(c).alias(c) for c in ("doc_id", "size", "source_size", "target", *also)), F.coalesce(F.sum("got"), F.lit(0)).alias("taken"), F.coalesce(F.min("slot"), F.lit(-1)).alias("first_slot"), F.count("slot").alias("n_blocks"), begun.alias("turns")
    )
    return whole.select("doc_id", "size", "source_size", "target", "taken", "first_slot", "n_blocks", "turns", *also)


def repeat_documents(docs: DataFrame) -> DataFrame:
    """The mix as rows in the order of the schedule: each document as often as its taken words come to, rounded, with the columns of docs.

    Every repeat of a document stands at the slot that begins it. Rows meet their slots by a hash of all their columns; of rows that are
    alike in all of them one is repeated for all.
    """
    times = F.floor((F.col("taken") * 2 + F.col("size")) / (F.col("size") * 2)).cast("int")
    mixed = _mix(docs, also={"__mark": row_mark(*docs.columns)}).where("taken > 0").select("__mark", F.slice("turns", F.lit(1), times).alias("__slots"))
    mixed = cut(mixed, "copies")
    copies = mixed.select("__mark", F.explode("__slots").alias("__slot"))
    alike = cut(mixed.groupBy("__mark").agg(F.count("*").alias("n")).where("n > 1").select("__mark"), "alike")
    rows = docs.withColumn("__mark", row_mark(*docs.columns))
    if not alike.isEmpty():
        some = alike.hint("shuffle_hash")
        rows = rows.join(some, "__mark", "left_anti").unionByName(rows.join(some, "__mark", "left_semi").dropDuplicates(["__mark"]))
    return rows.join(copies.hint("shuffle_hash"), "__mark").orderBy("__slot", "__mark").select(*all_of(docs))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size, md5(CAST(doc_id AS VARCHAR) || '|mix') AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number FROM d GROUP BY source),
w AS (SELECT *, CASE number % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, {MOST} * source_size AS cap FROM s),
r AS (SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
    coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
    coalesce(sum(weight) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped FROM w),
f AS (SELECT *, cap * (weights - capped) <= (total - caps) * weight AS stops FROM r),
t AS (SELECT *, CASE WHEN stops THEN CAST(cap AS DOUBLE) ELSE
    CAST((total - coalesce(sum(CASE WHEN stops THEN cap END) OVER (), 0)) * weight AS DOUBLE) / CAST(weights - coalesce(sum(CASE WHEN stops THEN weight END) OVER (), 0) AS DOUBLE) END AS target FROM f),
p AS (SELECT d.doc_id, d.size, d.source, t.number, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS quota,
    CAST(sum(d.size) OVER (PARTITION BY t.number ORDER BY d.h, d.doc_id ROWS UNBOUNDED PRECEDING) - d.size AS BIGINT) AS first FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT number, CAST(floor(target) AS BIGINT) AS quota, CAST(ceil(floor(target) / {BLOCK}) AS BIGINT) AS slots FROM t WHERE floor(target) > 0),
c AS (SELECT number, slots, CAST(sum(quota) OVER (ORDER BY number) - quota AS BIGINT) / CAST(sum(quota) OVER () AS BIGINT) AS low,
    CASE WHEN sum(quota) OVER (ORDER BY number) = sum(quota) OVER () THEN 1.0 ELSE CAST(sum(quota) OVER (ORDER BY number) AS BIGINT) / CAST(sum(quota) OVER () AS BIGINT) END AS high FROM q),
i AS (SELECT id, list_sum(list_transform(generate_series(0, {_BITS - 1}), lambda b: ((id >> b) & 1) / pow(2, b + 1))) AS x FROM (SELECT unnest(generate_series(0, (SELECT CAST(sum(slots) AS BIGINT) FROM q) - 1)) AS id)),
g AS (SELECT number, slots, id AS slot, row_number() OVER (PARTITION BY number ORDER BY id) - 1 AS rank FROM i JOIN c ON x >= low AND x < high),
n AS (SELECT number, slots, (SELECT count(*) FROM g WHERE g.number = q.number) AS got FROM q),
m AS (SELECT number, got, slots, coalesce(sum(slots - got) OVER (ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n WHERE got < slots),
z AS (SELECT number, rank, slot FROM g WHERE rank < slots UNION ALL
    SELECT number, rank, CAST((SELECT sum(slots) FROM q) + before + rank - got AS BIGINT) FROM (SELECT *, unnest(generate_series(got, slots - 1)) AS rank FROM m)),
u AS (SELECT doc_id, number, first + k * source_size AS a, least(first + k * source_size + size, quota) AS b FROM (SELECT *, unnest(generate_series(0, {MOST - 1})) AS k FROM p)),
o AS (SELECT doc_id, min(slot) AS first_slot, count(*) AS n_blocks FROM u JOIN z ON z.number = u.number AND z.rank BETWEEN a // {BLOCK} AND (b - 1) // {BLOCK} WHERE b > a GROUP BY doc_id)
SELECT p.doc_id, size, source_size, target, CAST(CASE WHEN source_size = 0 THEN 0 ELSE size * (quota // source_size) + greatest(0, least(size, quota % source_size - first)) END AS BIGINT) AS taken,
    coalesce(first_slot, -1) AS first_slot, coalesce(n_blocks, 0) AS n_blocks FROM p LEFT JOIN o ON o.doc_id = p.doc_id
"""
