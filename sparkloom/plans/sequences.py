"""Arrays, grids and sequences: chat elements, plans, packing, attention relations, spans.

Stand-ins: conversations for chats, lines of an order for segments of a sequence, documents' lengths for token counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import masks as M
from ..operators.packing import pack_greedy
from ..operators.windows import gaps
from .curation import SPANS, spans
from .registry import Tables, query


@query("arr_chat_elements", """WITH c AS (SELECT conv_id, turn, role, string_split(text, ' de ') AS parts FROM conversations WHERE role <> 'system'),
e AS (SELECT conv_id, turn, role, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM c)
SELECT conv_id, turn, CAST(2 * (i - 1) AS INTEGER) AS pos, 'text' AS kind, CASE WHEN role = 'assistant' THEN 1 ELSE 0 END AS loss FROM e WHERE trim(part) <> '' UNION ALL SELECT conv_id, turn, CAST(2 * (i - 1) - 1 AS INTEGER), 'image', 0 FROM e WHERE i > 1""")
def arr_chat_elements(t: Tables) -> DataFrame:
    """Turns cut at their image marks (here: ` de `): images and texts in turn, loss on the assistant's texts only."""
    parts = F.split("text", " de ")
    rows = t.conversations.where("role <> 'system'").select("conv_id", "turn", "role", F.posexplode(parts).alias("i", "part"))
    loss = F.when(F.col("role") == "assistant", 1).otherwise(0)
    two = F.array(F.when(F.trim("part") != "", F.struct((F.col("i") * 2).alias("pos"), F.lit("text").alias("kind"), loss.alias("loss"))), F.when(F.col("i") > 0, F.struct((F.col("i") * 2 - 1).alias("pos"), F.lit("image").alias("kind"), F.lit(0).alias("loss"))))
    return rows.select("conv_id", "turn", F.explode(F.filter(two, lambda x: x.isNotNull())).alias("e")).select("conv_id", "turn", "e.*")


@query("arr_no_loss_filter", "SELECT conv_id FROM conversations GROUP BY conv_id HAVING bool_or(role = 'assistant' AND trim(text) <> '')")
def arr_no_loss_filter(t: Tables) -> DataFrame:
    turns = t.conversations.groupBy("conv_id").agg(F.collect_list(F.struct("role", (F.trim("text") != "").alias("said"))).alias("turns"))
    return turns.where(F.exists("turns", lambda x: (x["role"] == "assistant") & x["said"])).select("conv_id")


@query("arr_plan_edit", "WITH n AS (SELECT conv_id, sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END)::BIGINT AS k FROM conversations GROUP BY conv_id) SELECT conv_id, 'image,text' || repeat(',text,image', CAST(k AS INTEGER)) AS plan FROM n")
def arr_plan_edit(t: Tables) -> DataFrame:
    """An image and an instruction, then a text and an image for each answer."""
    n = t.conversations.groupBy("conv_id").agg(F.count_if(F.col("role") == "assistant").cast("int").alias("k"))
    plan = F.concat(F.array(F.lit("image"), F.lit("text")), F.flatten(F.array_repeat(F.array(F.lit("text"), F.lit("image")), F.col("k"))))
    return n.select("conv_id", F.array_join(plan, ",").alias("plan"))


PLAN = "WITH n AS (SELECT l_orderkey, count(*) AS k FROM lineitem GROUP BY 1)"


@query("arr_plan_spatial", PLAN + " SELECT l_orderkey, repeat('input,', CAST(k - 1 AS INTEGER)) || 'prompt,out0,image' || CASE WHEN k > 1 THEN ',out1' ELSE '' END AS plan FROM n")
def arr_plan_spatial(t: Tables) -> DataFrame:
    """All but the last image as inputs, the prompt, the first output, the last image, the second output if there is one."""
    k = F.col("k").cast("int")
    n = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("k"))
    plan = F.concat(F.array_repeat(F.lit("input"), k - 1), F.array(F.lit("prompt"), F.lit("out0"), F.lit("image")), F.when(k > 1, F.array(F.lit("out1"))).otherwise(F.array().cast("array<string>")))
    return n.select("l_orderkey", F.array_join(plan, ",").alias("plan"))


@query("arr_role_tags", PLAN + ", i AS (SELECT l_orderkey, k, unnest(generate_series(0, k + 3)) AS i FROM n) SELECT l_orderkey, i, CASE WHEN i < k THEN CASE WHEN i = 0 THEN 'V1' WHEN i = 1 THEN 'V2' ELSE 'extra_' || (i - 2) END WHEN i = k THEN 'context' WHEN i = k + 1 THEN 'bridge_pre' WHEN i = k + 2 THEN 'bridge' ELSE 'reflect_answer' END AS role FROM i")
def arr_role_tags(t: Tables) -> DataFrame:
    """Roles of a plan's items: the views, the context, what leads to the bridge, the bridge, and the answer that reflects on it."""
    n = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("k"))
    views = F.transform(F.sequence(F.lit(0).cast("long"), F.col("k") - 1), lambda i: F.when(i < 2, F.concat(F.lit("V"), (i + 1).cast("string"))).otherwise(F.concat(F.lit("extra_"), (i - 2).cast("string"))))
    roles = F.concat(views, F.array(*map(F.lit, ("context", "bridge_pre", "bridge", "reflect_answer"))))
    return n.select("l_orderkey", F.posexplode(roles).alias("i", "role")).withColumn("i", F.col("i").cast("long"))


@query("arr_pack_greedy", None)
def arr_pack_greedy(t: Tables) -> DataFrame:
    """Documents packed into batches by workers of 512 ids each. Languages are the groups: English is drawn thrice as often, and every batch needs a French sample."""
    rows = t.documents.select(F.floor(F.col("doc_id") / 512).alias("worker"), F.coalesce("lang", F.lit("und")).alias("group"), "doc_id", F.col("n_chars").cast("long").alias("tokens"))
    return pack_greedy(rows, "worker", "group", "doc_id", "tokens", {"en": 3.0}, ("fr",))


@query("arr_pack_layout", "SELECT l_orderkey, l_linenumber, CAST(sum(CAST(l_quantity AS BIGINT)) OVER w - CAST(l_quantity AS BIGINT) AS BIGINT) AS first, CAST(l_quantity AS BIGINT) AS length, CASE l_returnflag WHEN 'A' THEN 'causal' WHEN 'N' THEN 'full' ELSE 'noise' END AS mode FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING)")
def arr_pack_layout(t: Tables) -> DataFrame:
    """Where each split of a batch begins, its length and attention mode, by prefix sums."""
    n = F.col("l_quantity").cast("long")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey").rowsBetween(Window.unboundedPreceding, 0)
    mode = F.when(F.col("l_returnflag") == "A", "causal").when(F.col("l_returnflag") == "N", "full").otherwise("noise")
    return t.lineitem.select("l_orderkey", "l_linenumber", (F.sum(n).over(w) - n).alias("first"), n.alias("length"), mode.alias("mode"))


TOKENS = """WITH s AS (SELECT l_orderkey AS o, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS s, 1 + CAST(l_quantity AS BIGINT) % 3 AS n, l_returnflag AS f FROM lineitem),
k AS (SELECT o, s, f, unnest(generate_series(1, n)) AS j FROM s)"""


def _splits(t: Tables) -> DataFrame:
    """Order o, number s, tokens n and kind f (A causal, N full, R noise) of each split (here: a line of an order), with its place among the order's tokens."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    lines = t.lineitem.select(F.col("l_orderkey").alias("o"), F.row_number().over(w).alias("s"), (F.col("l_quantity").cast("long") % 3 + 1).alias("n"), F.col("l_returnflag").alias("f"))
    return M.placed(lines, "o", "s", "n")


VISIBLE = "a.o = b.o AND ((b.s = a.s AND (a.f <> 'A' OR b.j <= a.j)) OR (b.s < a.s AND b.f <> 'R'))"
PLACES = TOKENS + ", p AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY s, j) - 1 AS pos FROM k)"


@query("arr_attn_mask", PLACES + f""" SELECT a.o, min(a.pos) AS q_from, max(a.pos) + 1 AS q_to, min(b.pos) AS k_from, max(b.pos) + 1 AS k_to, a.s = b.s AND b.f = 'A' AS causal, count(*) AS n_pairs
    FROM p a JOIN p b ON {VISIBLE} GROUP BY a.o, b.s, b.f, a.s = b.s""")
def arr_attn_mask(t: Tables) -> DataFrame:
    """The tokens that see one another, as rectangles with their number of pairs: causal or full inside of a split; earlier splits are seen unless they are noise. The twin expands all pairs."""
    relation = M.visible(_splits(t), "o", F.col("f") == "A", F.col("f") == "R")
    return relation.withColumn("n_pairs", M.pair_count(*map(F.col, (*M.EDGES, "causal"))))


@query("arr_mask_apply", PLACES + f" SELECT a.o, a.pos AS q, count(*) AS n_keys, CAST(sum(b.pos) AS BIGINT) AS key_sum FROM p a JOIN p b ON {VISIBLE} AND NOT (a.s >= 4 AND b.s <= 2 AND b.j = 2 AND NOT b.f = 'N') GROUP BY 1, 2")
def arr_mask_apply(t: Tables) -> DataFrame:
    """The same relation where reflecting splits (from the fourth) don't see dropped tokens of the views (the second of splits 1 and 2), unless the bridge (full splits) shows them again: what
    each token sees, from the rectangles that are left."""
    splits = _splits(t)
    relation = M.visible(splits, "o", F.col("f") == "A", F.col("f") == "R")
    dropped = splits.where("s <= 2 AND n >= 2").select("o", (F.col("start") + 1).alias("start"), (F.col("start") + 2).alias("end"))
    return M.by_query(M.without(relation, "o", splits.where("s >= 4"), dropped, splits.where("f = 'N'")), "o")


GRID = "WITH g AS (SELECT p_partkey, p_size % 6 + 1 AS h, p_size % 5 + 2 AS w FROM part), c AS (SELECT p_partkey, h, w, i, unnest(generate_series(0, w - 1)) AS j FROM (SELECT p_partkey, h, w, unnest(generate_series(0, h - 1)) AS i FROM g))"


def _grid(t: Tables) -> DataFrame:
    g = t.part.select("p_partkey", (F.col("p_size") % 6 + 1).alias("h"), (F.col("p_size") % 5 + 2).alias("w"))
    g = g.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("h") - 1)))
    return g.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("w") - 1)))


@query("arr_position_ids", GRID + " SELECT p_partkey, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, CAST(i * 70 + j AS BIGINT) AS id FROM c")
def arr_position_ids(t: Tables) -> DataFrame:
    """Row-major ids of a grid of patches with the stride of the longest side allowed."""
    return _grid(t).select("p_partkey", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), (F.col("i") * 70 + F.col("j")).cast("long").alias("id"))


@query("arr_region_pick", GRID + " SELECT p_partkey, count(*) AS n FROM c WHERE i < ceil(h * sqrt(0.5::DOUBLE)) AND j < ceil(w * sqrt(0.5::DOUBLE)) GROUP BY p_partkey")
def arr_region_pick(t: Tables) -> DataFrame:
    """The cells of a contiguous rectangle of about half of a grid."""
    side = F.sqrt(F.lit(0.5))
    return _grid(t).where((F.col("i") < F.ceil(F.col("h") * side)) & (F.col("j") < F.ceil(F.col("w") * side))).groupBy("p_partkey").agg(F.count("*").alias("n"))


_INSIDE = "{0} * 8 <= (2 * {1}.k + 1) * {2} AND (2 * {1}.k + 1) * {2} < ({0} + 1) * 8"
RESCALED = GRID + f""", k AS (SELECT unnest(generate_series(0, 3)) AS k), f AS (SELECT p_partkey, i, j, a.k AS to_i, b.k AS to_j FROM c JOIN k a ON {_INSIDE.format("i", "a", "h")} JOIN k b ON {_INSIDE.format("j", "b", "w")})
SELECT p_partkey, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, CAST(to_i AS BIGINT) AS to_i, CAST(to_j AS BIGINT) AS to_j FROM f
UNION ALL SELECT p_partkey, CAST(i AS BIGINT), CAST(j AS BIGINT), CAST((2 * i + 1) * 4 // (2 * h) AS BIGINT), CAST((2 * j + 1) * 4 // (2 * w) AS BIGINT) FROM c ANTI JOIN f USING (p_partkey, i, j)"""


@query("arr_grid_rescale", RESCALED)
def arr_grid_rescale(t: Tables) -> DataFrame:
    """Every cell of a grid of four by four whose centre lies in each cell, or the nearest one if there is none; arithmetic instead of a range join."""
    return rescale(_grid(t), 4, 4).select("p_partkey", "i", "j", "to_i", "to_j")


def rescale(cells: DataFrame, rows: int, columns: int) -> DataFrame:
    """The cells (i, j of a grid of h by w) with the cells to_i, to_j of a grid of rows by columns whose centres lie inside."""
    long = lambda x: F.col(x).cast("long")
    first = lambda x, n, m: F.ceil((x * 2 * m - n) / (n * 2))  # noqa: E731  # (k + 0.5) / m >= x / n
    whole = lambda low, high: F.filter(F.sequence(F.lit(0).cast("long"), F.lit(max(rows, columns) - 1).cast("long")), lambda k: (k >= low) & (k < high))
    inside = lambda x, n, m: whole(first(long(x), long(n), m), first(long(x) + 1, long(n), m))
    nearest = lambda x, n, m: F.array(F.floor((long(x) * 2 + 1) * m / (long(n) * 2)))
    found = cells.select("*", inside("i", "h", rows).alias("__i"), inside("j", "w", columns).alias("__j"))
    none = (F.size("__i") == 0) | (F.size("__j") == 0)
    to = found.withColumn("to_i", F.explode(F.when(none, nearest("i", "h", rows)).otherwise(F.col("__i")))).withColumn("to_j", F.explode(F.when(none, nearest("j", "w", columns)).otherwise(F.col("__j"))))
    return to.drop("__i", "__j").withColumns({"i": long("i"), "j": long("j")})


LONG = "WITH l AS (SELECT l_suppkey, l_linenumber, l_returnflag AS g, round(sum(l_discount), 6) AS m FROM lineitem GROUP BY 1, 2, 3)"


def _long(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_suppkey", "l_linenumber", F.col("l_returnflag").alias("g")).agg(F.round(F.sum("l_discount"), 6).alias("m"))


WIDE = LONG + ", w AS (SELECT l_suppkey, l_linenumber, " + ", ".join(f"coalesce(max(CASE WHEN g = '{g}' THEN m END), 0.0::DOUBLE) AS {g.lower()}" for g in "ANR") + " FROM l GROUP BY 1, 2)"


def _wide(t: Tables) -> DataFrame:
    w = t.lineitem.groupBy("l_suppkey", "l_linenumber").pivot("l_returnflag", ["A", "N", "R"]).agg(F.round(F.sum("l_discount"), 6))
    return w.select("l_suppkey", "l_linenumber", *(F.coalesce(F.col(g), F.lit(0.0)).alias(g.lower()) for g in "ANR"))


@query("arr_wide_from_long", WIDE + " SELECT * FROM w")
def arr_wide_from_long(t: Tables) -> DataFrame:
    return _wide(t)


@query("arr_long_from_wide", WIDE + " SELECT l_suppkey, l_linenumber, g, round(m / (a + n + r), 6) AS share FROM (" + " UNION ALL ".join(f"SELECT *, '{g}' AS g, {g} AS m FROM w" for g in "anr") + ") WHERE a + n + r > 0")
def arr_long_from_wide(t: Tables) -> DataFrame:
    """Groups as rows, each divided by the covered total; rows without any are dropped."""
    w = _wide(t).withColumn("total", F.col("a") + F.col("n") + F.col("r")).where("total > 0")
    return w.unpivot(["l_suppkey", "l_linenumber", "total"], ["a", "n", "r"], "g", "m").select("l_suppkey", "l_linenumber", "g", F.round(F.col("m") / F.col("total"), 6).alias("share"))


@query("arr_span_groups", "SELECT l_orderkey, " + ", ".join(f"CAST(sum(CASE WHEN starts_with(l_returnflag, '{g}') THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS {g.lower()}" for g in "AN") + ", CAST(greatest(0, 150 - sum(CASE WHEN l_returnflag IN ('A', 'N') THEN CAST(l_quantity AS BIGINT) ELSE 0 END)) AS BIGINT) AS other FROM lineitem GROUP BY l_orderkey")
def arr_span_groups(t: Tables) -> DataFrame:
    """Lengths of spans by the prefix of their names, and what of the total (here: 150) none of them covers."""
    n = F.col("l_quantity").cast("long")
    of = lambda g: F.sum(F.when(F.col("l_returnflag").startswith(g), n).otherwise(0))
    return t.lineitem.groupBy("l_orderkey").agg(of("A").alias("a"), of("N").alias("n"), F.greatest(F.lit(0), F.lit(150) - of("A") - of("N")).alias("other"))


STEPS = "WITH s AS (SELECT conv_id, turn, CAST(sum(length(text)) OVER w - length(text) AS BIGINT) AS a, CAST(sum(length(text)) OVER w AS BIGINT) AS b FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))"


@query("arr_answer_step", STEPS + " SELECT conv_id, turn FROM s WHERE 500 >= a AND 500 < b")
def arr_answer_step(t: Tables) -> DataFrame:
    """The step (turn) whose text holds a character of the whole (here: number 500)."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length("text")).over(w)
    return t.conversations.select("conv_id", "turn", (end - F.length("text")).alias("a"), end.alias("b")).where("500 >= a AND 500 < b").select("conv_id", "turn")


@query("arr_delimiter_labels", f"WITH s AS ({SPANS}) SELECT l_orderkey, CAST(a - 1 AS BIGINT) AS pos, 'start' AS label FROM s UNION ALL SELECT l_orderkey, CAST(b AS BIGINT), 'end' FROM s")
def arr_delimiter_labels(t: Tables) -> DataFrame:
    """The positions just before and just behind each span."""
    two = F.array(F.struct((F.col("a") - 1).alias("pos"), F.lit("start").alias("label")), F.struct(F.col("b").alias("pos"), F.lit("end").alias("label")))
    return spans(t).select("l_orderkey", F.explode(two).alias("x")).select("l_orderkey", "x.*")


@query("arr_gap_positions", f"""WITH s AS ({SPANS}), w AS (SELECT l_orderkey, coalesce(max(b) OVER (PARTITION BY l_orderkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS x, a AS y FROM s UNION ALL SELECT l_orderkey, max(b), max(total) FROM s GROUP BY l_orderkey),
p AS (SELECT l_orderkey, unnest(generate_series(x, y - 1)) AS pos FROM w WHERE x < y), d AS (SELECT DISTINCT l_orderkey, a - 1 AS pos, 'start' AS label FROM s)
SELECT p.l_orderkey, CAST(p.pos AS BIGINT) AS pos, coalesce(label, 'UNKNOWN') AS label FROM p LEFT JOIN d ON d.l_orderkey = p.l_orderkey AND d.pos = p.pos""")
def arr_gap_positions(t: Tables) -> DataFrame:
    """Positions that no span covers, with their labels."""
    s = spans(t)
    positions = gaps(s, ["l_orderkey"], "a", "b", "total").select("l_orderkey", F.explode(F.sequence(F.col("gap_start"), F.col("gap_end") - 1)).alias("pos"))
    labels = s.select("l_orderkey", (F.col("a") - 1).alias("pos"), F.lit("start").alias("label")).distinct()
    return positions.join(labels, ["l_orderkey", "pos"], "left").select("l_orderkey", "pos", F.coalesce("label", F.lit("UNKNOWN")).alias("label"))


CELLS = "WITH l AS (SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS day FROM events), g AS (SELECT u.user_id, e.event_type, d.day FROM (SELECT DISTINCT user_id FROM l) u CROSS JOIN (SELECT DISTINCT event_type FROM l) e CROSS JOIN (SELECT DISTINCT day FROM l) d)"


@query("arr_complete_grid", CELLS + " SELECT user_id, event_type, strftime(day, '%Y-%m-%d') AS day FROM g ANTI JOIN l USING (user_id, event_type, day) ORDER BY user_id, event_type, day LIMIT 20")
def arr_complete_grid(t: Tables) -> DataFrame:
    """The first twenty cells that a complete grid of three dimensions (here: users, types, days of events) lacks."""
    rows = t.events.select("user_id", "event_type", F.to_date("ts").alias("day"))
    return missing_cells(rows, ["user_id", "event_type", "day"]).orderBy("user_id", "event_type", "day").limit(20).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def missing_cells(rows: DataFrame, dims: list[str]) -> DataFrame:
    """The combinations of the values that each dimension has which no row has. The first dimension may be large; the values of the others (checked: at most
    10,000 combinations) are exploded beside it, so nothing is joined crosswise."""
    others = []
    for d in dims[1:]:
        values = [r[0] for r in rows.select(d).distinct().limit(10_001).collect()]
        others.append(sorted(v for v in values if v is not None))
    if math.prod(map(len, others)) > 10_000:
        raise ValueError(f"{dims[1:]} have more than 10,000 combinations")
    cells = rows.select(dims[0]).distinct()
    for d, values in zip(dims[1:], others):
        cells = cells.withColumn(d, F.explode(F.array(*map(F.lit, values)).cast(f"array<{rows.schema[d].dataType.simpleString()}>")))
    return cells.join(rows.select(*dims).distinct(), dims, "left_anti")


PATCH = 4  #: pixels of a patch's side


@query("arr_patchify", f"SELECT vec_id, CAST(pos // 8 // {PATCH} AS INTEGER) AS i, CAST(pos % 8 // {PATCH} AS INTEGER) AS j, CAST(pos // 8 % {PATCH} * {PATCH} + pos % 8 % {PATCH} AS INTEGER) AS k, x FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)")
def arr_patchify(t: Tables) -> DataFrame:
    """An image (here: a vector as eight by eight pixels) as rows of patches: the patch's place and each of its pixels."""
    patches = t.embeddings.select("vec_id", F.posexplode(patchify(F.col("embedding"), 1, 8, 8, PATCH)).alias("at", "patch"))
    return patches.select("vec_id", F.expr(f"cast(at div {8 // PATCH} AS int)").alias("i"), (F.col("at") % (8 // PATCH)).alias("j"), F.posexplode("patch").alias("k", "x"))


def patchify(image: Column, channels: int, height: int, width: int, side: int) -> Column:
    """The patches of an image, row by row, each an array of its pixels row by row with the channels of a pixel side by side. The image stands channel by channel."""
    rows, columns = height // side, width // side
    whole = lambda a, b: F.floor(a / b).cast("int")
    numbers = lambda n: F.sequence(F.lit(0), F.lit(n - 1))

    def pixel(p: Column, k: Column) -> Column:
        i, j = whole(p, columns) * side + whole(whole(k, channels), side), p % columns * side + whole(k, channels) % side
        return F.get(image, (k % channels) * (height * width) + i * width + j)

    return F.transform(numbers(rows * columns), lambda p: F.transform(numbers(side * side * channels), lambda k: pixel(p, k)))


@query("arr_composite", "WITH v AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) SELECT vec_id, CAST(pos // 8 AS INTEGER) AS row, CAST(pos % 8 + 10 * side AS INTEGER) AS col, x FROM (SELECT vec_id, pos, x, 0 AS side FROM v UNION ALL SELECT vec_id - 1, pos, x, 1 FROM v WHERE vec_id - 1 IN (SELECT vec_id FROM v)) WHERE vec_id + 1 IN (SELECT vec_id FROM v)")
def arr_composite(t: Tables) -> DataFrame:
    """Two images side by side (here: a vector and the next one, as eight by eight pixels) with a gap of two columns, whose pixels are left out here."""
    v = t.embeddings.select("vec_id", F.col("embedding").alias("a"))
    both = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    pixels = both.select("vec_id", F.posexplode(beside(F.col("a"), F.col("b"), 8, 8, 8, 2)).alias("at", "x"))
    return pixels.where("x IS NOT NULL").select("vec_id", F.expr("cast(at div 18 AS int)").alias("row"), (F.col("at") % 18).alias("col"), "x")


def beside(a: Column, b: Column, height: int, width_a: int, width_b: int, gap: int) -> Column:
    """Two images of one height, row by row, side by side with a gap of nulls between."""
    none = F.array_repeat(F.lit(None).cast("float"), gap)
    row = lambda r: F.concat(F.slice(a, r * width_a + 1, F.lit(width_a)), none, F.slice(b, r * width_b + 1, F.lit(width_b)))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(height - 1)), row))


WEIGHTS = "WITH n AS (SELECT 'block.' || (vec_id // 3) || CASE vec_id % 3 WHEN 0 THEN '' WHEN 1 THEN '.lora_A' ELSE '.lora_B' END || '.weight' AS name, embedding AS w FROM embeddings)"
_PART = lambda k: f"(SELECT replace(name, '.lora_{k}.', '.') AS name, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS pos FROM n WHERE contains(name, '.lora_{k}.'))"


@query("join_lora_delta", WEIGHTS + f""", d AS (SELECT a.name, b.pos // 8 * 8 + a.pos % 8 AS pos, sum(CAST(b.x AS DOUBLE) * a.x) AS delta FROM {_PART("A")} a JOIN {_PART("B")} b ON a.name = b.name AND a.pos // 8 = b.pos % 8 GROUP BY 1, 2)
SELECT d.name, CAST(d.pos AS INTEGER) AS pos, round(c.x + 2 * delta, 6) AS value FROM d JOIN (SELECT name, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS pos FROM n) c ON c.name = d.name AND c.pos = d.pos""")
def join_lora_delta(t: Tables) -> DataFrame:
    """Low-rank updates merged into the weights whose rewritten key they carry (here: three vectors in a row are a base and its two factors, all eight by eight)."""
    kind = F.element_at(F.array(F.lit(""), F.lit(".lora_A"), F.lit(".lora_B")), (F.col("vec_id") % 3 + 1).cast("int"))
    named = t.embeddings.select(F.concat(F.lit("block."), F.floor(F.col("vec_id") / 3).cast("string"), kind, F.lit(".weight")).alias("name"), F.col("embedding").cast("array<double>").alias("w"))
    return merge_low_rank(named, 8, 8, 8, 2.0).select("name", F.posexplode("w").alias("pos", "value")).withColumn("value", F.round("value", 6))


def merge_low_rank(weights: DataFrame, rows: int, columns: int, rank: int, scale: float) -> DataFrame:
    """name and w of the base matrices (row by row) that have both factors, with scale * B A added. weights: name and w; a factor's name has .lora_A. or .lora_B. where its base has a dot."""
    part = lambda k: weights.where(F.col("name").contains(f".lora_{k}.")).select(F.replace("name", F.lit(f".lora_{k}."), F.lit(".")).alias("name"), F.col("w").alias(k))
    whole = lambda x: F.floor(x).cast("int")
    cell = lambda x, p: x + scale * F.aggregate(F.sequence(F.lit(0), F.lit(rank - 1)), F.lit(0.0), lambda acc, k: acc + F.get("B", whole(p / columns) * rank + k) * F.get("A", k * columns + p % columns))
    both = weights.join(part("A"), "name").join(part("B"), "name")
    fits = (F.size("w") == rows * columns) & (F.size("A") == rank * columns) & (F.size("B") == rows * rank)
    return both.where(fits).select("name", F.transform("w", cell).alias("w"))
