"""Curation: filters, projections, joins and set membership, windows, sampling and splits.

Stand-ins are named in each docstring; where a text of a certain form is needed it is put together from the driver's columns in both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import joins as J
from ..operators import sampling as S
from ..operators import windows as W
from .registry import Tables, query

MD5 = "md5('42|' || CAST({} AS VARCHAR))"

# ---- filters and projections ------------------------------------------------------------------------------------------------


@query("filter_nonempty_question", "SELECT doc_id FROM documents WHERE trim(coalesce(text, '')) <> ''")
def filter_nonempty_question(t: Tables) -> DataFrame:
    return t.documents.where(F.trim(F.coalesce("text", F.lit(""))) != "").select("doc_id")


@query("filter_blacklist", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def filter_blacklist(t: Tables) -> DataFrame:
    return t.documents.join(t.labels.where("quality = 0"), "doc_id", "left_anti").select("doc_id")


@query("filter_type_subset", f"SELECT o_orderkey FROM (SELECT *, row_number() OVER (ORDER BY {MD5.format('o_orderkey')}, o_orderkey) AS n FROM orders) WHERE n <= 500 AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def filter_type_subset(t: Tables) -> DataFrame:
    """A subset of types, taken after the sample has been drawn."""
    return S.sample_n(t.orders, "o_orderkey", 500).where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey")


@query("filter_contains_ci", "SELECT doc_id FROM documents WHERE NOT contains(lower(text), 'idiot')")
def filter_contains_ci(t: Tables) -> DataFrame:
    return t.documents.where(~F.lower("text").contains("idiot")).select("doc_id")


@query("filter_question_rules", "SELECT p_partkey FROM part WHERE (p_type = 'SMALL' AND p_size >= 15) OR (p_type = 'ECONOMY' AND TRY_CAST(substr(p_brand, 7) AS INTEGER) IS NOT NULL AND TRY_CAST(substr(p_brand, 7) AS INTEGER) <> p_size) OR (p_type NOT IN ('SMALL', 'ECONOMY') AND p_retailprice >= 950)")
def filter_question_rules(t: Tables) -> DataFrame:
    """A rule for each question type (here: part type): a distance, an answer that is an integer and differs from the difficulty, a difficulty."""
    kind, number = F.col("p_type"), F.substring("p_brand", 7, 99).try_cast("int")
    rules = F.when(kind == "SMALL", F.col("p_size") >= 15).when(kind == "ECONOMY", number.isNotNull() & (number != F.col("p_size"))).otherwise(F.col("p_retailprice") >= 950)
    return t.part.where(rules).select("p_partkey")


ASSETS = "CASE WHEN c_acctbal < 0 THEN 'balance' WHEN c_mktsegment = 'MACHINERY' THEN 'segment' WHEN c_nationkey IS NULL THEN 'nation' END"


@query("filter_required_assets", f"SELECT c_custkey, coalesce({ASSETS}, 'ok') AS reason FROM customer")
def filter_required_assets(t: Tables) -> DataFrame:
    """The first requirement that fails (here: columns of a customer)."""
    return t.customer.select("c_custkey", F.coalesce(_reason(), F.lit("ok")).alias("reason"))


def _reason():
    return F.when(F.col("c_acctbal") < 0, "balance").when(F.col("c_mktsegment") == "MACHINERY", "segment").when(F.col("c_nationkey").isNull(), "nation")


@query("filter_scene_valid", f"SELECT c_custkey FROM customer WHERE ({ASSETS}) IS NULL")
def filter_scene_valid(t: Tables) -> DataFrame:
    return t.customer.where(_reason().isNull()).select("c_custkey")


@query("drop_reason_tally", f"SELECT coalesce({ASSETS}, 'kept') AS reason, count(*) AS n FROM customer GROUP BY 1")
def drop_reason_tally(t: Tables) -> DataFrame:
    return t.customer.groupBy(F.coalesce(_reason(), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("map_status_rows", f"SELECT CASE WHEN ({ASSETS}) IS NULL THEN 'ok' ELSE 'missing_' || ({ASSETS}) END AS status, count(*) AS n FROM customer GROUP BY 1")
def map_status_rows(t: Tables) -> DataFrame:
    return t.customer.groupBy(F.coalesce(F.concat(F.lit("missing_"), _reason()), F.lit("ok")).alias("status")).agg(F.count("*").alias("n"))


@query("filter_multi_instance", "SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey HAVING count(*) >= 2 ORDER BY l_orderkey LIMIT 50")
def filter_multi_instance(t: Tables) -> DataFrame:
    """Orders with at least two returned lines, the first fifty."""
    return t.lineitem.where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.count("*").alias("n")).where("n >= 2").orderBy("l_orderkey").limit(50).select("l_orderkey")


@query("filter_array_all", "SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING bool_and(l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 500))")
def filter_array_all(t: Tables) -> DataFrame:
    """Orders all of whose suppliers are in a table, by an anti-join of the exploded array."""
    lines = t.lineitem.select("l_orderkey", "l_suppkey")
    bad = lines.join(t.supplier.where("s_acctbal > 500"), F.col("l_suppkey") == F.col("s_suppkey"), "left_anti")
    return lines.select("l_orderkey").distinct().join(bad, "l_orderkey", "left_anti")


@query("filter_parse_rows", "SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) >= 2 AND sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) > 0 AND sum(CASE WHEN role IN ('user', 'assistant', 'system') THEN 0 ELSE 1 END) = 0")
def filter_parse_rows(t: Tables) -> DataFrame:
    """Conversations of two turns at least, with an answer and known roles only."""
    role = F.col("role")
    c = t.conversations.groupBy("conv_id").agg(F.count("*").alias("n"), F.count_if(role == "assistant").alias("a"), F.count_if(F.coalesce(~role.isin("user", "assistant", "system"), F.lit(True))).alias("other"))
    return c.where("n >= 2 AND a > 0 AND other = 0").select("conv_id")


SIDES = "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS user_1, CASE WHEN p_partkey % 3 <> 2 THEN p_type END AS user_2, p_name AS generic, p_size % 4 AS idx FROM part"


def sides(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    return t.part.select(k, F.when(k % 3 == 0, F.col("p_brand")).alias("user_1"), F.when(k % 3 != 2, F.col("p_type")).alias("user_2"), F.col("p_name").alias("generic"), (F.col("p_size") % 4).alias("idx"))


@query("project_coalesce_side", f"WITH s AS ({SIDES}) SELECT p_partkey, coalesce(user_1, user_2, generic) AS options, CASE WHEN user_1 IS NOT NULL OR user_2 IS NOT NULL THEN chr(CAST(65 + idx AS INTEGER)) ELSE generic END AS answer FROM s")
def project_coalesce_side(t: Tables) -> DataFrame:
    """Options of user 1, else user 2, else generic; the answer is a letter where a side has been chosen."""
    side = F.coalesce("user_1", "user_2")
    return sides(t).select("p_partkey", F.coalesce(side, "generic").alias("options"), F.when(side.isNotNull(), T.letter(F.col("idx"))).otherwise(F.col("generic")).alias("answer"))


@query("project_coalesce_side_rev", f"WITH s AS ({SIDES}) SELECT p_partkey, coalesce(user_2, user_1, generic) AS options FROM s")
def project_coalesce_side_rev(t: Tables) -> DataFrame:
    return sides(t).select("p_partkey", F.coalesce("user_2", "user_1", "generic").alias("options"))


@query("project_swap_sides", f"WITH s AS ({SIDES}) SELECT p_partkey, CASE WHEN user_1 IS NULL THEN user_2 ELSE user_1 END AS user_1, CASE WHEN user_1 IS NULL THEN NULL ELSE user_2 END AS user_2 FROM s")
def project_swap_sides(t: Tables) -> DataFrame:
    swap = F.col("user_1").isNull()
    return sides(t).select("p_partkey", F.when(swap, F.col("user_2")).otherwise(F.col("user_1")).alias("user_1"), F.when(~swap, F.col("user_2")).alias("user_2"))


@query("project_add_defaults", "SELECT r_regionkey, r_name, CAST(NULL AS VARCHAR) AS panorama_path, 0 AS difficulty FROM region")
def project_add_defaults(t: Tables) -> DataFrame:
    return J.add_defaults(t.region, {"panorama_path": F.lit(None).cast("string"), "difficulty": F.lit(0), "r_name": F.lit("")})


@query("project_infer_asker", f"WITH s AS ({SIDES}) SELECT p_partkey, CASE WHEN idx = 0 THEN 'both' WHEN user_1 IS NOT NULL THEN 'user_1' WHEN user_2 IS NOT NULL THEN 'user_2' END AS asker FROM s")
def project_infer_asker(t: Tables) -> DataFrame:
    """Who asks: as stated (here: idx 0), else the side with a question."""
    asker = F.when(F.col("idx") == 0, "both").when(F.col("user_1").isNotNull(), "user_1").when(F.col("user_2").isNotNull(), "user_2")
    return sides(t).select("p_partkey", asker.alias("asker"))


@query("project_mode_rows", "SELECT p_partkey, 'visual_only' AS mode, p_name AS prompt, p_brand AS output FROM part UNION ALL SELECT p_partkey, 'interleaved', p_name || ' ' || p_type, '<think>' || p_type || '</think>' || p_brand FROM part UNION ALL SELECT p_partkey, 'no_thinking', p_name, '<answer>' || p_brand || '</answer>' FROM part")
def project_mode_rows(t: Tables) -> DataFrame:
    """A training row for each mode of rendering."""
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>"))
    name, brand, kind = F.col("p_name"), F.col("p_brand"), F.col("p_type")
    modes = {"visual_only": (name, brand), "interleaved": (F.concat_ws(" ", name, kind), F.concat(tag("think", kind), brand)), "no_thinking": (name, tag("answer", brand))}
    rows = F.explode(F.array(*(F.struct(F.lit(m).alias("mode"), a.alias("prompt"), b.alias("output")) for m, (a, b) in modes.items())))
    return t.part.select("p_partkey", rows.alias("m")).select("p_partkey", "m.*")


@query("project_prompt_swap", "SELECT p_partkey, CASE WHEN starts_with(p_name, 'red') THEN 'blue' || substr(p_name, 4) ELSE p_name END AS prompt FROM part")
def project_prompt_swap(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", J.swap_prefix(F.col("p_name"), "red", "blue").alias("prompt"))


@query("project_normalize_row", "SELECT 'e' || event_id AS id, event_type AS kind, CAST(value AS DOUBLE) AS score FROM events UNION ALL SELECT 'o' || o_orderkey, o_orderpriority, o_totalprice FROM orders UNION ALL SELECT 'd' || doc_id, NULL, CAST(quality AS DOUBLE) FROM labels")
def project_normalize_row(t: Tables) -> DataFrame:
    """Three schemas made one."""
    row = lambda p, k, kind, score: (F.concat(F.lit(p), k).alias("id"), kind.alias("kind"), score.cast("double").alias("score"))
    a, b, c = F.col("event_id"), F.col("o_orderkey"), F.col("doc_id")
    parts = [t.events.select(*row("e", a, F.col("event_type"), F.col("value"))), t.orders.select(*row("o", b, F.col("o_orderpriority"), F.col("o_totalprice"))), t.labels.select(*row("d", c, F.lit(None).cast("string"), F.col("quality")))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("project_order_dominant", f"WITH s AS ({SIDES}) SELECT p_partkey, CASE WHEN idx % 2 = 1 THEN concat_ws('|', user_1, user_2) ELSE concat_ws('|', user_2, user_1) END AS images FROM s")
def project_order_dominant(t: Tables) -> DataFrame:
    return sides(t).select("p_partkey", F.when(F.col("idx") % 2 == 1, F.concat_ws("|", "user_1", "user_2")).otherwise(F.concat_ws("|", "user_2", "user_1")).alias("images"))


@query("project_alias_names", f"WITH s AS ({SIDES}) SELECT p_partkey, coalesce(nullif(user_1, ''), nullif(user_2, ''), generic) AS question FROM s")
def project_alias_names(t: Tables) -> DataFrame:
    return sides(t).select("p_partkey", J.first_nonempty("user_1", "user_2", "generic").alias("question"))


@query("project_drop_columns", "SELECT c_custkey, c_name FROM customer")
def project_drop_columns(t: Tables) -> DataFrame:
    """Without helper columns, whose names begin with an underscore, and without named ones."""
    rows = t.customer.withColumn("_resolved", F.lit(1))
    return J.drop_helpers(rows, "c_nationkey", "c_acctbal", "c_mktsegment")


# ---- joins and set membership -----------------------------------------------------------------------------------------------


@query("join_lookup_dict", "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey <> 1")
def join_lookup_dict(t: Tables) -> DataFrame:
    return t.customer.join(t.nation.where("n_regionkey <> 1"), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_name")


@query("join_left_llm", "WITH last AS (SELECT * FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1) SELECT c_custkey, value FROM customer LEFT JOIN last ON user_id = c_custkey")
def join_left_llm(t: Tables) -> DataFrame:
    """A left join with the last of duplicates on the right."""
    last = t.events.groupBy("user_id").agg(F.max_by("value", "event_id").alias("value"))
    return t.customer.join(last, F.col("c_custkey") == F.col("user_id"), "left").select("c_custkey", "value")


@query("join_inner_sorted", "SELECT d.doc_id, quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id ORDER BY d.doc_id")
def join_inner_sorted(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").join(t.labels, "doc_id").select("doc_id", "quality").orderBy("doc_id")


@query("join_full_diagnostics", "SELECT sum(CASE WHEN d.doc_id IS NOT NULL AND l.doc_id IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS n_both, sum(CASE WHEN l.doc_id IS NULL THEN 1 ELSE 0 END)::BIGINT AS only_a, sum(CASE WHEN d.doc_id IS NULL THEN 1 ELSE 0 END)::BIGINT AS only_b FROM documents d FULL JOIN (SELECT doc_id + 5 AS doc_id FROM labels) l ON d.doc_id = l.doc_id")
def join_full_diagnostics(t: Tables) -> DataFrame:
    return J.overlap(t.documents.select("doc_id"), t.labels.select((F.col("doc_id") + 5).alias("doc_id")), "doc_id")


@query("join_nway_variants", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) AND doc_id IN (SELECT user_id FROM events) AND doc_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AND doc_id IN (SELECT conv_id FROM conversations)")
def join_nway_variants(t: Tables) -> DataFrame:
    """Ids found in all asset sets, by semi-joins one after another."""
    sets = [t.labels.select("doc_id"), t.events.select(F.col("user_id").alias("doc_id")), t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("doc_id")), t.conversations.select(F.col("conv_id").alias("doc_id"))]
    return J.in_all(t.documents.select("doc_id"), sets, "doc_id")


@query("join_semi_ids", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def join_semi_ids(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("join_anti_scene", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment IN ('MACHINERY', 'FURNITURE'))")
def join_anti_scene(t: Tables) -> DataFrame:
    """No row of a group (customer) that training or test data hold."""
    held = t.customer.where(F.col("c_mktsegment").isin("MACHINERY", "FURNITURE"))
    return t.orders.join(held, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("o_orderkey")


@query("join_anti_resume", "SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)")
def join_anti_resume(t: Tables) -> DataFrame:
    """What isn't done yet; blank results (here: quality 0) don't count as done."""
    return t.documents.join(t.labels.where("quality = 1"), "doc_id", "left_anti").select("doc_id")


@query("join_split_train_test", "SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 0) THEN 'test' ELSE 'train' END AS split FROM documents")
def join_split_train_test(t: Tables) -> DataFrame:
    test = t.labels.where("toxic = 0").select("doc_id").distinct().withColumn("split", F.lit("test"))
    return t.documents.join(test, "doc_id", "left").select("doc_id", F.coalesce("split", F.lit("train")).alias("split"))


@query("join_cascade", "SELECT c_custkey, coalesce(s.s_name, n.n_name, r.r_name) AS name, CASE WHEN s.s_name IS NOT NULL THEN 1 WHEN n.n_name IS NOT NULL THEN 2 WHEN r.r_name IS NOT NULL THEN 3 ELSE 0 END AS hit FROM customer LEFT JOIN supplier s ON s_suppkey = c_custkey LEFT JOIN nation n ON n_nationkey = c_custkey % 50 LEFT JOIN region r ON r_regionkey = c_custkey % 7")
def join_cascade(t: Tables) -> DataFrame:
    """The first hit of several lookups, with its number."""
    k = F.col("c_custkey")
    lookups = [(k, t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v"))), (k % 50, t.nation.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v"))), (k % 7, t.region.select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("v")))]
    return J.cascade(t.customer.select("c_custkey"), lookups).select("c_custkey", F.col("value").alias("name"), F.coalesce("hit", F.lit(0)).alias("hit"))


@query("join_sample_else_scene", "SELECT o_orderkey, CASE WHEN l.n IS NOT NULL THEN 'sample' WHEN c.c_name IS NOT NULL THEN 'scene' ELSE 'missing' END AS source FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) l ON l_orderkey = o_orderkey LEFT JOIN customer c ON c_custkey = o_custkey AND c_acctbal > 3000")
def join_sample_else_scene(t: Tables) -> DataFrame:
    per_sample = t.lineitem.where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("k")).agg(F.lit("sample").alias("v"))
    per_scene = t.customer.where("c_acctbal > 3000").select(F.col("c_custkey").alias("k"), F.lit("scene").alias("v"))
    return J.cascade(t.orders.select("o_orderkey", "o_custkey"), [(F.col("o_orderkey"), per_sample), (F.col("o_custkey"), per_scene)]).select("o_orderkey", F.coalesce("value", F.lit("missing")).alias("source"))


@query("join_first_match_roots", "SELECT l_orderkey, min_by(l_suppkey, l_linenumber * 1000000 + l_suppkey) AS path FROM lineitem WHERE l_discount > 0.05 GROUP BY l_orderkey".replace("min_by", "arg_min"))
def join_first_match_roots(t: Tables) -> DataFrame:
    """The path in the first root that has the scene (here: the supplier of the first discounted line)."""
    return t.lineitem.where("l_discount > 0.05").groupBy("l_orderkey").agg(F.min_by("l_suppkey", F.struct("l_linenumber", "l_suppkey")).alias("path"))


PATHS = "SELECT page_id, regexp_extract(url, '://([^?#]*)', 1) AS path FROM pages"


@query("join_path_ancestor", f"""WITH p AS ({PATHS}), h AS (SELECT DISTINCT regexp_extract(path, '^([^/]*/[^/]*)', 1) AS dir FROM p WHERE page_id % 3 = 0)
SELECT page_id, max(dir) AS dir FROM p LEFT JOIN h ON starts_with(path, dir || '/') AND dir = regexp_extract(path, '^([^/]*/[^/]*)', 1) GROUP BY page_id""")
def join_path_ancestor(t: Tables) -> DataFrame:
    """The nearest ancestor directory that holds a file, by exploding each path's prefixes into an equi-join."""
    paths = t.pages.select("page_id", F.regexp_extract("url", "://([^?#]*)", 1).alias("path"))
    homes = paths.where("page_id % 3 = 0").select(F.regexp_extract("path", "^([^/]*/[^/]*)", 1).alias("dir")).distinct()
    return J.nearest_ancestor(paths, "page_id", "path", homes)


Q = "SELECT p_brand AS id, CAST(p_size AS VARCHAR) AS q, p_partkey AS ord FROM part"


@query("join_prefix_theta", f"""WITH a AS ({Q}), j AS (SELECT a.ord AS a, b.ord AS b, row_number() OVER (PARTITION BY a.ord ORDER BY CASE WHEN a.q = b.q THEN 0 ELSE 1 END, b.ord) AS n FROM a JOIN a b ON a.id = b.id AND a.ord <> b.ord AND (starts_with(a.q, b.q) OR starts_with(b.q, a.q)))
SELECT a, b FROM j WHERE n = 1""")
def join_prefix_theta(t: Tables) -> DataFrame:
    """Rows of one id (here: parts of a brand) where either question (the size's digits) is a prefix of the other; the exact match first, then the earliest."""
    return J.prefix_match(_questions(t)).select("a", "b")


@query("join_match_class", f"""WITH a AS ({Q}), j AS (SELECT a.ord, max(CASE WHEN a.q = b.q THEN 2 WHEN starts_with(a.q, b.q) OR starts_with(b.q, a.q) THEN 1 ELSE 0 END) AS best FROM a LEFT JOIN a b ON a.id = b.id AND a.ord <> b.ord GROUP BY a.ord)
SELECT CASE WHEN best = 2 THEN 'exact' WHEN best = 1 THEN 'prefix' ELSE 'none' END AS class, count(*) AS n FROM j GROUP BY 1""")
def join_match_class(t: Tables) -> DataFrame:
    rows = _questions(t)
    best = J.prefix_match(rows).select(F.col("a").alias("ord"), F.when(F.col("exact") == 0, "exact").otherwise("prefix").alias("class"))
    return rows.join(best, "ord", "left").groupBy(F.coalesce("class", F.lit("none")).alias("class")).agg(F.count("*").alias("n"))


def _questions(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_brand").alias("id"), F.col("p_size").cast("string").alias("q"), F.col("p_partkey").alias("ord"))


@query("join_question_tiebreak", """WITH q AS (SELECT doc_id, coalesce(text, '') AS q, md5(coalesce(source, '') || '|' || coalesce(lang, '')) AS h FROM documents), n AS (SELECT *, count(*) OVER (PARTITION BY q) AS k, count(*) OVER (PARTITION BY q, h) AS kh FROM q)
SELECT doc_id, CASE WHEN k = 1 THEN 'question' WHEN kh = 1 THEN 'image' ELSE 'ambiguous' END AS match FROM n""")
def join_question_tiebreak(t: Tables) -> DataFrame:
    """What identifies a row: its question (here: the whole text) alone, else with its image's hash (here: source and language), else nothing. Questions travel as hashes, and
    both counts are aggregated before rows meet them."""
    image = F.concat(F.coalesce("source", F.lit("")), F.lit("|"), F.coalesce("lang", F.lit("")))
    rows = t.documents.select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("q"), F.md5(image.cast("binary")).alias("h"))
    both = rows.groupBy("q", "h").agg(F.count("*").alias("kh"))
    k = both.groupBy("q").agg(F.sum("kh").alias("k"))
    counted = rows.join(both, ["q", "h"]).join(k, "q")
    return counted.select("doc_id", F.when(F.col("k") == 1, "question").when(F.col("kh") == 1, "image").otherwise("ambiguous").alias("match"))


@query("join_content_hash", "SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text)) AS first_id, count(*) OVER (PARTITION BY md5(text)) AS n FROM documents WHERE text IS NOT NULL")
def join_content_hash(t: Tables) -> DataFrame:
    """Rows of equal content by its hash: each with the first of its class and the class's size, not with every other row."""
    d = t.documents.where("text IS NOT NULL").select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"))
    return d.join(d.groupBy("h").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "h").select("doc_id", "first_id", "n")


@query("join_metadata_2key", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, n FROM lineitem l JOIN (SELECT l_returnflag AS f, l_linestatus AS s, l_linenumber AS k, count(*) AS n FROM lineitem GROUP BY 1, 2, 3) m ON m.f = l_returnflag AND m.s = l_linestatus AND m.k = l_linenumber WHERE l_quantity > 45")
def join_metadata_2key(t: Tables) -> DataFrame:
    keys = ["l_returnflag", "l_linestatus", "l_linenumber"]
    return t.lineitem.where("l_quantity > 45").join(t.lineitem.groupBy(*keys).agg(F.count("*").alias("n")), keys).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "n")


@query("join_rethink", "SELECT l_orderkey, o_totalprice, n FROM (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_quantity > 25 GROUP BY 1) JOIN orders ON o_orderkey = l_orderkey")
def join_rethink(t: Tables) -> DataFrame:
    """First results with the raw data, where the list of images (here: large lines) isn't empty."""
    images = t.lineitem.groupBy("l_orderkey").agg(F.count_if(F.col("l_quantity") > 25).alias("n")).where("n > 0")
    return images.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).select("l_orderkey", "o_totalprice", "n")


@query("join_covisible", "SELECT a.l_orderkey, a.l_partkey FROM (SELECT DISTINCT l_orderkey, l_partkey % 20 AS l_partkey FROM lineitem WHERE l_linenumber <= 3) a JOIN (SELECT DISTINCT l_orderkey, l_partkey % 20 AS l_partkey FROM lineitem WHERE l_linenumber > 3) b ON a.l_orderkey = b.l_orderkey AND a.l_partkey = b.l_partkey")
def join_covisible(t: Tables) -> DataFrame:
    """Objects (parts modulo 20) that both halves of an order hold, by an intersection of sets in one aggregation."""
    part, n = F.col("l_partkey") % 20, F.col("l_linenumber")
    both = t.lineitem.groupBy("l_orderkey").agg(F.collect_set(F.when(n <= 3, part)).alias("a"), F.collect_set(F.when(n > 3, part)).alias("b"))
    return both.select("l_orderkey", F.explode(F.array_intersect("a", "b")).alias("l_partkey"))


@query("join_schema_fill", "SELECT k, v FROM (SELECT s_suppkey AS k, s_name AS v FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier))")
def join_schema_fill(t: Tables) -> DataFrame:
    """Keys that one side lacks, copied from the other."""
    a, b = t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v")), t.customer.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"))
    return a.unionByName(b.join(a, "k", "left_anti"))


# ---- windows ----------------------------------------------------------------------------------------------------------------


@query("win_first_per_key", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1")
def win_first_per_key(t: Tables) -> DataFrame:
    return W.first_per_key(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("win_first_per_scene_hist", "SELECT o_orderpriority, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1 GROUP BY 1")
def win_first_per_scene_hist(t: Tables) -> DataFrame:
    return W.first_per_key(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


_NTH = [sum(26**i for i in range(1, n)) for n in range(1, 7)]  # the first number that has n letters
_LETTERS = lambda n: " || ".join(f"chr(CAST(97 + ({{0}} - {_NTH[n - 1]}) // {26**i} % 26 AS INTEGER))" for i in range(n - 1, -1, -1))
BASE26 = "CASE " + " ".join(f"WHEN {{0}} < {_NTH[n]} THEN {_LETTERS(n)}" for n in range(1, 6)) + " END"


@query("win_dup_suffix", f"WITH n AS (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k FROM events) SELECT event_id, CASE WHEN n = 1 THEN CAST(user_id AS VARCHAR) ELSE user_id || '_' || {BASE26.format('k')} END AS new_id FROM n")
def win_dup_suffix(t: Tables) -> DataFrame:
    return W.suffix_duplicates(t.events.select("event_id", "user_id"), "user_id", ["event_id"]).select("event_id", "new_id")


@query("fn_base26", f"SELECT p_partkey, {BASE26.format('p_partkey')} AS name FROM part")
def fn_base26(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", W.base26(F.col("p_partkey")).alias("name"))


@query("win_sequential_id", "SELECT o_orderkey, o_orderpriority || '_' || lpad(CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS VARCHAR), 6, '0') AS id FROM orders")
def win_sequential_id(t: Tables) -> DataFrame:
    """Running ids of each type. Numbers run in ranges of keys first, so a type's rows needn't meet in one task."""
    rows = W.running_total(t.orders.select("o_orderkey", "o_orderpriority"), ["o_orderkey"], F.lit(1), "k", ["o_orderpriority"])
    return rows.select("o_orderkey", F.concat(F.col("o_orderpriority"), F.lit("_"), F.lpad(F.col("k").cast("string"), 6, "0")).alias("id"))


@query("win_shard_slice", "SELECT doc_id, CAST(ntile(7) OVER (ORDER BY doc_id) - 1 AS BIGINT) AS shard FROM documents")
def win_shard_slice(t: Tables) -> DataFrame:
    """Sorted, contiguous slices of nearly equal size; the first ones take the remainder."""
    return J.contiguous_shards(t.documents.select("doc_id"), "doc_id", 7)


@query("win_prefix_lengths", "SELECT doc_id, CAST(sum(n_chars) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - n_chars AS BIGINT) AS char_start, CAST(sum(n_chars) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS char_end FROM documents")
def win_prefix_lengths(t: Tables) -> DataFrame:
    rows = W.running_total(t.documents.select("doc_id", "n_chars"), ["doc_id"], F.col("n_chars"), "char_start")
    return rows.select("doc_id", "char_start", (F.col("char_start") + F.col("n_chars")).alias("char_end"))


@query("win_split_ranges", "SELECT conv_id, turn, CAST(sum(length(text)) OVER w - length(text) AS BIGINT) AS first, CAST(sum(length(text)) OVER w AS BIGINT) AS last FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)")
def win_split_ranges(t: Tables) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length("text")).over(w)
    return t.conversations.select("conv_id", "turn", (end - F.length("text")).alias("first"), end.alias("last"))


SPANS = "SELECT l_orderkey, l_linenumber * 10 AS a, l_linenumber * 10 + CAST(l_quantity AS BIGINT) % 14 AS b, 90 AS total FROM lineitem"


def spans(t: Tables) -> DataFrame:
    a = F.col("l_linenumber") * 10
    return t.lineitem.select("l_orderkey", a.cast("long").alias("a"), (a + F.col("l_quantity").cast("long") % 14).alias("b"), F.lit(90).alias("total"))


@query("win_interval_gaps", f"""WITH s AS ({SPANS}), w AS (SELECT l_orderkey, coalesce(max(b) OVER (PARTITION BY l_orderkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gap_start, a AS gap_end FROM s UNION ALL SELECT l_orderkey, max(b), max(total) FROM s GROUP BY l_orderkey)
SELECT l_orderkey, CAST(gap_start AS BIGINT) AS gap_start, CAST(gap_end AS BIGINT) AS gap_end FROM w WHERE gap_start < gap_end""")
def win_interval_gaps(t: Tables) -> DataFrame:
    return W.gaps(spans(t), ["l_orderkey"], "a", "b", "total")


@query("win_paired_delta", "WITH g AS (SELECT l_suppkey, l_linenumber, l_returnflag, avg(l_tax) AS m FROM lineitem GROUP BY 1, 2, 3) SELECT a.l_suppkey, a.l_linenumber, round(a.m - b.m, 6) + 0.0 AS delta FROM g a JOIN g b ON a.l_suppkey = b.l_suppkey AND a.l_linenumber = b.l_linenumber WHERE a.l_returnflag = 'R' AND b.l_returnflag = 'N'")
def win_paired_delta(t: Tables) -> DataFrame:
    """Candidate less baseline on their common keys, from one pivoted aggregation."""
    w = t.lineitem.groupBy("l_suppkey", "l_linenumber").pivot("l_returnflag", ["R", "N"]).agg(F.avg("l_tax"))
    return w.where("R IS NOT NULL AND N IS NOT NULL").select("l_suppkey", "l_linenumber", (F.round(F.col("R") - F.col("N"), 6) + 0.0).alias("delta"))


@query("win_share_of_total", "WITH g AS (SELECT l_orderkey, sum(CASE WHEN l_returnflag = 'R' THEN l_discount ELSE 0 END) AS part, sum(l_discount) AS total FROM lineitem GROUP BY 1) SELECT l_orderkey, round(part / total, 6) AS share FROM g WHERE total > 0")
def win_share_of_total(t: Tables) -> DataFrame:
    g = t.lineitem.groupBy("l_orderkey").agg(F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_discount")).otherwise(0.0)).alias("part"), F.sum("l_discount").alias("total"))
    return g.where("total > 0").select("l_orderkey", F.round(F.col("part") / F.col("total"), 6).alias("share"))


@query("win_running_metric", "WITH w AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, avg(CASE WHEN value > 30 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS a FROM events) SELECT user_id, event_id, round(a, 6) AS accuracy FROM w WHERE k % 10 = 0")
def win_running_metric(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id")
    hit = F.when(F.col("value") > 30, 1.0).otherwise(0.0)
    rows = t.events.withColumn("k", F.row_number().over(w)).withColumn("a", F.avg(hit).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where("k % 10 = 0").select("user_id", "event_id", F.round("a", 6).alias("accuracy"))


@query("win_rank_slots", "WITH n AS (SELECT l_orderkey, sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS a, sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS b FROM lineitem GROUP BY 1) SELECT l_orderkey, CASE WHEN a > b THEN 'agent_1' ELSE 'agent_2' END AS slot FROM n")
def win_rank_slots(t: Tables) -> DataFrame:
    """The slot with more maps (here: lines of a status); a tie goes to the second."""
    s = F.col("l_linestatus")
    return t.lineitem.groupBy("l_orderkey").agg(F.when(F.count_if(s == "O") > F.count_if(s == "F"), "agent_1").otherwise("agent_2").alias("slot"))


@query("win_topk_area", "SELECT l_orderkey, l_partkey, rank FROM (SELECT l_orderkey, l_partkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_linenumber, l_suppkey) AS INTEGER) AS rank FROM lineitem) WHERE rank <= 2")
def win_topk_area(t: Tables) -> DataFrame:
    return W.top_per_key(t.lineitem, ["l_orderkey"], [F.desc("l_extendedprice"), "l_partkey", "l_linenumber", "l_suppkey"], 2).select("l_orderkey", "l_partkey", "rank")


@query("win_epoch_min", "SELECT user_id, min(event_id // 1000) AS epoch FROM events GROUP BY user_id")
def win_epoch_min(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.min(F.floor(F.col("event_id") / 1000)).alias("epoch"))


# ---- sort, limit, sampling, splits ------------------------------------------------------------------------------------------


@query("sort_numeric_chunk", "SELECT c_name, CAST(regexp_extract(c_name, '([0-9]+)$', 1) AS BIGINT) AS number FROM customer ORDER BY number")
def sort_numeric_chunk(t: Tables) -> DataFrame:
    return t.customer.select("c_name", F.regexp_extract("c_name", "([0-9]+)$", 1).cast("long").alias("number")).orderBy("number")


@query("sort_multi_key", "SELECT l_returnflag, l_linenumber, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2, 3 ORDER BY 1, 2, 3")
def sort_multi_key(t: Tables) -> DataFrame:
    keys = ["l_returnflag", "l_linenumber", "l_linestatus"]
    return t.lineitem.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(*keys)


@query("limit_head", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 25")
def limit_head(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").orderBy("doc_id").limit(25)


@query("sample_n", f"SELECT doc_id FROM documents ORDER BY {MD5.format('doc_id')}, doc_id LIMIT 100")
def sample_n(t: Tables) -> DataFrame:
    return S.sample_n(t.documents.select("doc_id"), "doc_id", 100)


SUPER = "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'a' WHEN o_orderpriority = '5-LOW' THEN 'b' END"


@query("sample_cap_groups", f"WITH n AS (SELECT o_orderkey, {SUPER} AS g, row_number() OVER (PARTITION BY {SUPER} ORDER BY {MD5.format('o_orderkey')}, o_orderkey) AS n FROM orders) SELECT o_orderkey FROM n WHERE g IS NULL OR n <= 500")
def sample_cap_groups(t: Tables) -> DataFrame:
    """Two super-groups, each capped at half of 1000; other rows stay."""
    p = F.col("o_orderpriority")
    rows = t.orders.select("o_orderkey", F.when(p.isin("1-URGENT", "2-HIGH"), "a").when(p == "5-LOW", "b").alias("g"))
    return S.sample_per_group(rows.where("g IS NOT NULL"), ["g"], "o_orderkey", 500).unionByName(rows.where("g IS NULL")).select("o_orderkey")


@query("sample_per_scene", f"WITH n AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY md5('42|' || (l_partkey * 100000 + l_suppkey)), l_partkey * 100000 + l_suppkey) AS n FROM lineitem WHERE l_returnflag IN ('R', 'N')) SELECT l_orderkey, l_returnflag, count(*) AS n FROM n WHERE n <= CASE WHEN l_returnflag = 'R' THEN 2 ELSE 1 END GROUP BY 1, 2")
def sample_per_scene(t: Tables) -> DataFrame:
    """Of each scene (order) at most two rows of one type and one of another."""
    rows = t.lineitem.where(F.col("l_returnflag").isin("R", "N")).withColumn("k", F.col("l_partkey") * 100000 + F.col("l_suppkey"))
    some = S.sample_per_group(rows, ["l_orderkey", "l_returnflag"], "k", F.when(F.col("l_returnflag") == "R", 2).otherwise(1))
    return some.groupBy("l_orderkey", "l_returnflag").agg(F.count("*").alias("n"))



@query("sample_one_per_scene_posneg", "SELECT c_custkey, CASE WHEN substr(md5('42|' || c_custkey), 1, 1) IN ('0', '2', '4', '6', '8', 'a', 'c', 'e') THEN 'pos' ELSE 'neg' END AS label FROM customer")
def sample_one_per_scene_posneg(t: Tables) -> DataFrame:
    """A row for each scene, its label by the parity of its hash."""
    even = F.conv(F.substring(S.hash_order("c_custkey"), 1, 1), 16, 10).cast("int") % 2 == 0
    return t.customer.select("c_custkey", F.when(even, "pos").otherwise("neg").alias("label"))


@query("sample_pos_and_neg", f"WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY {MD5.format('o_orderkey')}, o_orderkey) AS n FROM orders) SELECT c_custkey, 'pos' AS label, -1::BIGINT AS o_orderkey FROM customer UNION ALL SELECT c_custkey, 'neg', coalesce(o_orderkey, -1) FROM customer LEFT JOIN o ON o_custkey = c_custkey AND n = 1")
def sample_pos_and_neg(t: Tables) -> DataFrame:
    """Both labels for each scene; the negative is chosen by hash."""
    one = S.sample_per_group(t.orders, ["o_custkey"], "o_orderkey", 1).select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("negative"))
    both = t.customer.join(one, "c_custkey", "left").withColumn("label", F.explode(F.array(F.lit("pos"), F.lit("neg"))))
    return both.select("c_custkey", "label", F.coalesce(F.when(F.col("label") == "neg", F.col("negative")), F.lit(-1)).cast("long").alias("o_orderkey"))


@query("sample_stratified_fill", f"WITH n AS (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY {MD5.format('doc_id')}, doc_id) > 130 // (SELECT count(DISTINCT lang) FROM documents) AS late FROM documents) SELECT doc_id FROM n ORDER BY late, {MD5.format('doc_id')}, doc_id LIMIT 130")
def sample_stratified_fill(t: Tables) -> DataFrame:
    return S.stratified_fill(t.documents.select("doc_id", "lang"), "lang", "doc_id", 130).select("doc_id")


@query("sample_quota_mix", f"(SELECT doc_id FROM documents WHERE lang <> 'en' ORDER BY {MD5.format('doc_id')}, doc_id LIMIT 30) UNION ALL (SELECT doc_id FROM documents WHERE lang = 'en' ORDER BY {MD5.format('doc_id')}, doc_id LIMIT 70)")
def sample_quota_mix(t: Tables) -> DataFrame:
    """A quota of one kind; the other kind fills the rest."""
    d = t.documents.select("doc_id", "lang")
    return S.sample_n(d.where("lang <> 'en'"), "doc_id", 30).unionByName(S.sample_n(d.where("lang = 'en'"), "doc_id", 70)).select("doc_id")


FOLD = "list_reduce(list_prepend(0::BIGINT, list_transform(string_split(sha256({0}), ''), lambda c: CAST(strpos('0123456789abcdef', c) - 1 AS BIGINT))), lambda a, b: (a * 16 + b) % {1})"


@query("sample_hash_mod", f"SELECT c_custkey FROM customer WHERE {FOLD.format('c_name', 250)} < 200")
def sample_hash_mod(t: Tables) -> DataFrame:
    return t.customer.where(S.sha256_mod(F.col("c_name"), 250) < 200).select("c_custkey")


@query("sample_hash_assign", f"WITH p AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS i FROM supplier), c AS (SELECT c_custkey, {FOLD.format('c_name', 'n')} AS i FROM (SELECT c_custkey, c_name, n FROM customer, (SELECT count(*) AS n FROM supplier))) SELECT c_custkey, s_suppkey FROM c JOIN p USING (i)")
def sample_hash_assign(t: Tables) -> DataFrame:
    """A member of a pool (here: of all suppliers) for each id by its hash."""
    pool = W.running_total(t.supplier.select("s_suppkey"), ["s_suppkey"], F.lit(1), "i")
    return t.customer.withColumn("i", S.sha256_mod(F.col("c_name"), t.supplier.count())).join(pool, "i").select("c_custkey", "s_suppkey")


@query("sample_rotated_pick", f"SELECT c_custkey, concat_ws(',', " + ", ".join("['a', 'b', 'c', 'd', 'e'][CAST(1 + (" + FOLD.format("c_name", 5) + f" + {k}) % 5 AS INTEGER)]" for k in range(3)) + ") AS picked FROM customer")
def sample_rotated_pick(t: Tables) -> DataFrame:
    """Three names of a list, rotated by the id's hash."""
    names, turn = F.array(*map(F.lit, "abcde")), S.sha256_mod(F.col("c_name"), 5).cast("int")
    rotated = F.concat(F.slice(names, turn + 1, F.lit(5)), F.slice(names, F.lit(1), turn))
    return t.customer.select("c_custkey", F.array_join(F.slice(rotated, 1, 3), ",").alias("picked"))


@query("sample_correct_incorrect", f"WITH n AS (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY {MD5.format('doc_id')}, doc_id) AS n FROM labels) SELECT doc_id, toxic FROM n WHERE n <= 20")
def sample_correct_incorrect(t: Tables) -> DataFrame:
    return S.sample_per_group(t.labels, ["toxic"], "doc_id", 20).select("doc_id", "toxic")


@query("shuffle_global", f"SELECT doc_id FROM documents ORDER BY {MD5.format('doc_id')}, doc_id")
def shuffle_global(t: Tables) -> DataFrame:
    """Seeded order of all rows: a range-partitioned sort of hashes."""
    return t.documents.select("doc_id").orderBy(S.hash_order("doc_id"), "doc_id")


@query("split_by_group", "WITH g AS (SELECT o_custkey, row_number() OVER (ORDER BY md5('42|' || o_custkey), o_custkey) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT o_custkey FROM orders)) SELECT o_orderkey, CASE WHEN k <= CAST(floor(n * 0.9) AS BIGINT) THEN 'train' ELSE 'val' END AS split FROM orders JOIN g USING (o_custkey)")
def split_by_group(t: Tables) -> DataFrame:
    """Nine tenths of the groups in hash order train, and no group is in both. Ranks are two-level over ranges of hashes."""
    groups = t.orders.select("o_custkey").distinct().withColumn("h", S.hash_order("o_custkey"))
    ranked = W.running_total(groups, ["h", "o_custkey"], F.lit(1), "k")
    n = groups.agg(F.floor(F.count("*") * 0.9).alias("cut"))
    sides = ranked.join(F.broadcast(n)).select("o_custkey", F.when(F.col("k") < F.col("cut"), "train").otherwise("val").alias("split"))
    return t.orders.join(sides, "o_custkey").select("o_orderkey", "split")


@query("split_files_ranks", "SELECT nation_key, (k - 1) % 4 AS rank, ((k - 1) // 4) % 2 AS worker FROM (SELECT n_nationkey AS nation_key, row_number() OVER (ORDER BY md5('42|' || n_nationkey), n_nationkey) AS k FROM nation)")
def split_files_ranks(t: Tables) -> DataFrame:
    """Files (here: nations) dealt in hash order to ranks and their workers; none is dropped."""
    files = t.nation.select(F.col("n_nationkey").alias("nation_key")).withColumn("h", S.hash_order("nation_key"))
    return W.running_total(files, ["h", "nation_key"], F.lit(1), "k").select("nation_key", (F.col("k") % 4).alias("rank"), (F.floor(F.col("k") / 4) % 2).alias("worker"))


HEX8 = " + ".join(f"(strpos('0123456789abcdef', substr(md5('42|' || doc_id), {i}, 1)) - 1) * {16 ** (6 - i)}" for i in range(1, 7))


@query("mix_weighted", f"SELECT doc_id, CASE WHEN ({HEX8}) / 16777216.0::DOUBLE < 0.5 THEN 'a' WHEN ({HEX8}) / 16777216.0::DOUBLE < 0.8 THEN 'b' ELSE 'c' END AS chosen FROM documents")
def mix_weighted(t: Tables) -> DataFrame:
    """A group for each draw by its place among cumulative weights 5, 3, 2."""
    u = F.conv(F.substring(S.hash_order("doc_id"), 1, 6), 16, 10).cast("double") / 16777216.0
    return t.documents.select("doc_id", F.when(u < 0.5, "a").when(u < 0.8, "b").otherwise("c").alias("chosen"))
