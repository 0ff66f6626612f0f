"""Scalar functions on texts, and those on geometry and numbers.

Model outputs are templates chosen by doc_id, the same in both engines; they cover every branch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import metrics as M
from ..functions import text as T
from .registry import Tables, query

OUTPUTS = (
    "<answer> b </answer>", "**Final Answer: C**", "Answer: because it is left", "I pick (D)", "\\boxed{A}", "B is wrong, so C", "A chair is visible", "none", "the [B] one", "<answer>yes, D</answer>",
    "<think>it is near</think><answer>A</answer>", "so\n<answer>B</answer>", "<think></think><answer>C</answer>", "answer is d", "[Round 3] about 4.5 or 12", "<answer>7.25</answer>", "Answer: 19", "\\boxed{x {y} z}", "True, since it fits", "<think>false?</think> I say true",
    "It is false.", "<score>4</score><reason>good", "Score: 2", "<thinking>slow walk</thinking>rest", "'Quoted.'", "D.", "\\bbox{C} and more", "<view_token>left<view_token>right<answer>A",
)
_LIST = "[" + ", ".join("'" + o.replace("'", "''") + "'" for o in OUTPUTS) + "]"
O = f"WITH o AS (SELECT doc_id, {_LIST}[CAST(doc_id % {len(OUTPUTS)} + 1 AS INTEGER)] AS s, replace({_LIST}[CAST(doc_id % {len(OUTPUTS)} + 1 AS INTEGER)], '**', '') AS p FROM documents) "  # noqa: E741


def outputs(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.element_at(F.array(*map(F.lit, OUTPUTS)), (F.col("doc_id") % len(OUTPUTS) + 1).cast("int")).alias("s"))


def _first(pattern: str, text: str = "p", flags: str = "") -> str:
    p = pattern.replace("'", "''")
    return f"CASE WHEN regexp_matches({text}, '{flags}{p}') THEN regexp_extract({text}, '{flags}{p}', 1) END"


def _last(pattern: str, text: str = "p") -> str:
    p = pattern.replace("'", "''")
    return f"list_extract(regexp_extract_all({text}, '{p}', 1), -1)"


TAG, FINAL, ANY, BOX = r"<answer>\s*([A-D])\s*</answer>", r"answer:\s*([A-D])", r"[\(\[]([A-D])[\)\]]", r"\\boxed\{([A-D])\}"
LETTER = r"\b([A-D])\b"
NESTED = r"\{((?:[^{}]|\{[^{}]*\})*)\}"


def _chain(*steps: str) -> str:
    return f"upper(coalesce({', '.join(steps)}))"


def _answers(name: str, function, sql: str) -> None:
    query(name, O + f"SELECT doc_id, {sql} AS answer FROM o")(lambda t: outputs(t).select("doc_id", function(F.col("s")).alias("answer")))


_answers("fn_extract_answer", T.extract_answer, _chain(_first(TAG, flags="(?is)"), _first(FINAL, flags="(?i)"), _first(ANY), _first(BOX), _last(LETTER)))
_answers("fn_extract_answer_paren", T.extract_answer_paren, _chain(_first(r"<answer>\s*\(?([A-D])\)?\s*</answer>", flags="(?is)"), _first(r"answer:\s*\(?([A-D])", flags="(?i)"), _first(r"\(([A-D])\)"), _first(r"\[([A-D])\]"), _first(BOX), _last(LETTER)))
_answers("fn_extract_answer_notag", T.extract_answer_notag, _chain(_first(FINAL, flags="(?i)"), _first(ANY), _last(LETTER)))
_answers("fn_extract_answer_nobox", T.extract_answer_nobox, _chain(_first(TAG, flags="(?is)"), _first(FINAL, flags="(?i)"), _first(ANY), _last(LETTER)))
_answers("fn_extract_answer_ab", T.extract_answer_ab, _chain(*(_first(x.replace("A-D", "A-B"), flags=f) for x, f in ((TAG, "(?is)"), (FINAL, "(?i)"), (ANY, ""))), _last(r"\b([A-B])\b")))
RAW = "trim(" + _first(r"<answer>(.*?)</answer>", "s", "(?is)") + ")"
_answers("fn_extract_answer_raw", T.extract_answer_raw, f"CASE WHEN {RAW} IS NULL THEN {_chain(_first(TAG, flags='(?is)'), _first(FINAL, flags='(?i)'), _first(ANY), _first(BOX), _last(LETTER))} WHEN regexp_matches({RAW}, '(?i)^[A-D]$') THEN upper({RAW}) ELSE {RAW} END")
BOXED, BBOXED, ANSWER = _last(r"\\boxed" + NESTED, "s"), _last(r"\\bbox" + NESTED, "s"), _last(r"(?s)<answer>(.*?)</answer>", "s")
_answers("fn_extract_boxed", T.extract_boxed, f"trim(coalesce({BOXED}, {ANSWER}))")
_answers("fn_extract_boxed_chain", T.extract_boxed_chain, f"trim(coalesce({BOXED}, {BBOXED}, {ANSWER}))")
FREE = ", ".join("upper(" + _first(p, "s") + ")" for p in (r"^\s*\(?([A-Da-d])[\)\.:\s]", r"(?i)answer is\s*:?\s*\(?([A-D])\b", r"\b([A-D])\.?\s*$"))
_answers("fn_extract_boxed_free", T.extract_boxed_free, f"coalesce(trim(coalesce({BOXED}, {BBOXED}, {ANSWER})), {FREE})")
NUMBER = "TRY_CAST(" + _first(r"<answer>\s*([0-9.]+)\s*</answer>", flags="(?i)") + " AS DOUBLE), TRY_CAST(" + _first(r"answer:\s*([0-9.]+)", flags="(?i)") + " AS DOUBLE), TRY_CAST(" + _last(r"\b([0-9]+(?:\.[0-9]+)?)\b", r"regexp_replace(p, '\[Round [0-9]+\]', '', 'g')") + " AS DOUBLE)"
_answers("fn_extract_number", T.extract_number, f"coalesce({NUMBER})")
JUDGE = "lower(trim(regexp_replace(s, '(?s)<think>.*?</think>', '', 'g')))"
_answers("fn_parse_judge", lambda s: T.parse_judge(s).cast("string"), f"CASE coalesce({_first('^(true|false)', JUDGE)}, {_first(chr(92) + 'b(true|false)' + chr(92) + 'b', JUDGE)}) WHEN 'true' THEN 'true' WHEN 'false' THEN 'false' END")
SCORE = "coalesce(" + ", ".join((_first(r"<score>\s*([1-5])\s*</score>", "s", "(?is)"), _first(r"score\s*[:=]?\s*([1-5])\b", "s", "(?i)"), _first(r"\b([1-5])\b", "s"))) + ")"
_answers("fn_parse_score", lambda s: T.parse_score(s).cast("string"), SCORE)
_answers("fn_think_answer", lambda s: F.concat_ws("|", T.think(s), T.answer(s)), f"concat_ws('|', trim({_first('<think>(.*?)</think>', 's', '(?s)')}), trim({_first('<answer>(.*?)</answer>', 's', '(?s)')}))")
_answers("fn_extract_thinking", T.extract_thinking, f"coalesce(trim({_first('<thinking>(.*?)</thinking>', 's', '(?s)')}), trim(regexp_replace(s, '</?[a-z_]+>', '', 'g')))")
_answers("fn_split_view_token", lambda s: F.array_join(F.split(F.substring_index(s, "<answer>", 1), "<view_token>"), "|"), "array_to_string(string_split(string_split(s, '<answer>')[1], '<view_token>'), '|')")
_answers("fn_split_output", lambda s: F.array_join(_split_output(s), "|"), "CASE WHEN contains(s, '<answer>') THEN substr(s, 1, strpos(s, '<answer>') + 7) || '|' || substr(s, strpos(s, '<answer>') + 8) ELSE s END")


def _split_output(s: Column, mark: str = "<answer>") -> Column:
    """Cut behind the first mark (here: the answer tag) into one or two elements."""
    at = F.instr(s, mark)
    return F.when(at > 0, F.array(s.substr(F.lit(1), at + len(mark) - 1), s.substr(at + len(mark), F.length(s)))).otherwise(F.array(s))


NORMAL = "regexp_replace(lower(trim({0})), '\\.+$', '')"
N1 = NORMAL.format("s")
_answers("fn_normalize_match", T.normalised, f"CASE WHEN regexp_matches({N1}, '^\"[^\"]*\"$') OR regexp_matches({N1}, '^''[^'']*''$') THEN substr({N1}, 2, length({N1}) - 2) ELSE {N1} END")
STATUS = f"CASE WHEN {_first('<answer>(.*?)</answer>', 's', '(?s)')} IS NULL OR coalesce(trim(coalesce(trim({_first('<think>(.*?)</think>', 's', '(?s)')}), trim({_first('^(.*?)<answer>', 's', '(?s)')}))), '') = '' THEN 'parse_fail' WHEN upper(trim({_first('<answer>(.*?)</answer>', 's', '(?s)')})) = 'A' THEN 'ok' ELSE 'wrong' END"
_answers("fn_parse_status", lambda s: T.parse_status(s, F.lit("A")), STATUS)
RECOVER = _chain(_first(TAG, flags="(?is)"), _first(FINAL, flags="(?i)"), _first(ANY), _first(BOX), _last(LETTER))
_answers("fn_recover_answer", lambda s: _recovered(s), f"CASE WHEN regexp_matches(s, '^[A-D]$') THEN 'given:' || s WHEN regexp_matches(s, '(?i)answer is\\s*\\(?([A-D])') THEN 'pattern:' || upper(regexp_extract(s, '(?i)answer is\\s*\\(?([A-D])', 1)) ELSE 'extract:' || {RECOVER} END")


def _recovered(s: Column) -> Column:
    """An answer with the name of the way that found it: as given, by a loose pattern, or extracted."""
    loose = r"(?i)answer is\s*\(?([A-D])"
    return F.when(F.regexp_like(s, F.lit("^[A-D]$")), F.concat(F.lit("given:"), s)).when(F.regexp_like(s, F.lit(loose)), F.concat(F.lit("pattern:"), F.upper(F.regexp_extract(s, loose, 1)))).otherwise(F.concat(F.lit("extract:"), T.extract_answer(s)))


@query("fn_normalize_output", O + f"""SELECT doc_id, coalesce(trim({_first('<think>(.*?)</think>', 's', '(?s)')}), trim({_first('<thinking>(.*?)</thinking>', 's', '(?s)')}), trim({_first('^(.*?)<answer>', 's', '(?s)')})) AS reasoning,
    {RECOVER} AS answer, CASE WHEN {RECOVER} IS NULL THEN 'no_answer' WHEN {RECOVER} <> 'A' THEN 'mismatch' ELSE 'ok' END AS status FROM o""")
def fn_normalize_output(t: Tables) -> DataFrame:
    """Reasoning out of three places, the answer out of four, checked against the gold answer (here: A)."""
    s = F.col("s")
    before = F.trim(T.found(s, r"(?s)^(.*?)<answer>"))
    reasoning, answer = F.coalesce(T.think(s), F.trim(T.found(s, r"(?s)<thinking>(.*?)</thinking>")), before), T.extract_answer(s)
    return outputs(t).select("doc_id", reasoning.alias("reasoning"), answer.alias("answer"), F.when(answer.isNull(), "no_answer").when(answer != "A", "mismatch").otherwise("ok").alias("status"))


@query("fn_accuracy", O + f"SELECT doc_id, CASE WHEN {RECOVER} = chr(CAST(65 + doc_id % 4 AS INTEGER)) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS accuracy FROM o")
def fn_accuracy(t: Tables) -> DataFrame:
    return outputs(t).select("doc_id", F.when(T.extract_answer(F.col("s")) == T.letter(F.col("doc_id") % 4), 1.0).otherwise(0.0).alias("accuracy"))


@query("fn_accuracy_ci", O + "SELECT doc_id, coalesce(upper(s) = upper('d.'), false) AS correct FROM o")
def fn_accuracy_ci(t: Tables) -> DataFrame:
    return outputs(t).select("doc_id", F.coalesce(F.upper("s") == F.upper(F.lit("d.")), F.lit(False)).alias("correct"))


@query("fn_accuracy_mixed", O + "SELECT doc_id, CASE WHEN regexp_matches(s, '^[A-D]\\.?$') THEN substr(s, 1, 1) = 'D' ELSE lower(trim(s)) = 'none' END AS correct FROM o")
def fn_accuracy_mixed(t: Tables) -> DataFrame:
    """A letter is compared with the index, other text with the gold text, ignoring case."""
    s = F.col("s")
    return outputs(t).select("doc_id", F.when(F.regexp_like(s, F.lit(r"^[A-D]\.?$")), F.substring(s, 1, 1) == "D").otherwise(F.lower(F.trim(s)) == "none").alias("correct"))


@query("fn_parse_pm_id", "SELECT p_partkey, TRY_CAST(p_partkey % 9 AS INTEGER) AS idx, p_type AS src FROM part")
def fn_parse_pm_id(t: Tables) -> DataFrame:
    """Source and index of pointmatch_<source>_<scene>_<index> (here put together from a part)."""
    parts = F.split(F.concat_ws("_", F.lit("pointmatch"), "p_type", "p_size", (F.col("p_partkey") % 9).cast("string")), "_")
    return t.part.select("p_partkey", F.try_element_at(parts, F.lit(-1)).try_cast("int").alias("idx"), F.get(parts, F.lit(1)).alias("src"))


@query("fn_question_tail", "SELECT conv_id, turn, right(text, 20) AS tail FROM conversations")
def fn_question_tail(t: Tables) -> DataFrame:
    """The text behind the last image mark (here put before the last twenty characters)."""
    s = F.col("text")
    cut = F.greatest(F.length(s) - 20, F.lit(0))
    marked = F.concat(F.lit("<image>"), F.substr(s, F.lit(1), cut), F.lit("<image>"), F.substr(s, cut + 1))
    return t.conversations.select("conv_id", "turn", F.substring_index(marked, "<image>", -1).alias("tail"))


@query("fn_render_options", "SELECT p_partkey, 'A) ' || p_name || chr(10) || 'B) ' || p_brand || chr(10) || 'C) ' || p_type AS options FROM part")
def fn_render_options(t: Tables) -> DataFrame:
    lines = F.transform(F.array("p_name", "p_brand", "p_type"), lambda o, i: F.concat(T.letter(i), F.lit(") "), o))
    return t.part.select("p_partkey", F.array_join(lines, "\n").alias("options"))


@query("fn_render_options_inline", "SELECT p_partkey, 'Options: A. ' || p_name || ', B. ' || p_brand AS options FROM part")
def fn_render_options_inline(t: Tables) -> DataFrame:
    parts = F.transform(F.array("p_name", "p_brand"), lambda o, i: F.concat(T.letter(i), F.lit(". "), o))
    return t.part.select("p_partkey", F.concat(F.lit("Options: "), F.array_join(parts, ", ")).alias("options"))


SOURCES = {"indoor/scenes/": "indoor", "outputs_rendered/": "rendered", "shared_dataset/": "shared"}  #: parts of a path that tell its source, first match first


@query("fn_source_from_path", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'indoor' WHEN 1 THEN 'rendered' WHEN 2 THEN 'shared' ELSE 'unknown' END AS source, CASE p_partkey % 4 WHEN 0 THEN 'indoor_' WHEN 1 THEN 'rendered_' WHEN 2 THEN 'shared_' ELSE '' END || p_name AS id FROM part")
def fn_source_from_path(t: Tables) -> DataFrame:
    path = F.element_at(F.array(*map(F.lit, ("/d/indoor/scenes/a", "/d/outputs_rendered/a", "/shared_dataset/a", "/other"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return t.part.select("p_partkey", T.source_from_path(path, SOURCES).alias("source"), T.prefixed_id(F.col("p_name"), path, SOURCES).alias("id"))


@query("fn_path_segments", "SELECT p_partkey, p_type AS scene, p_brand AS room FROM part")
def fn_path_segments(t: Tables) -> DataFrame:
    """Scene and room of a path: the segments before `frames`."""
    parts = F.split(F.concat_ws("/", F.lit("data"), "p_brand", "p_type", F.lit("frames"), "p_name"), "/")
    at = F.array_position(parts, "frames").cast("int")
    return t.part.select("p_partkey", F.get(parts, at - 2).alias("scene"), F.get(parts, at - 3).alias("room"))


@query("fn_strip_affixes", "SELECT p_partkey, p_name AS id, p_type AS category FROM part")
def fn_strip_affixes(t: Tables) -> DataFrame:
    """Ids without a source in front and a duplicate's suffix behind; a category without its closing number."""
    name, kind = F.concat(F.lit("rendered_"), "p_name", F.lit("_b")), F.concat_ws("_", "p_type", (F.col("p_partkey") % 7).cast("string"))
    return t.part.select("p_partkey", F.regexp_replace(F.regexp_replace(name, f"^({'|'.join(SOURCES.values())})_", ""), "_[a-z]{1,2}$", "").alias("id"), F.regexp_replace(kind, "_[0-9]+$", "").alias("category"))


@query("fn_hash", "SELECT doc_id, md5(text) AS m, sha256(text) AS s FROM documents")
def fn_hash(t: Tables) -> DataFrame:
    raw = F.col("text").cast("binary")
    return t.documents.select("doc_id", F.md5(raw).alias("m"), F.sha2(raw, 256).alias("s"))


STOP = ["the", "and", "that", "with"]


@query("fn_tokens", "WITH w AS (SELECT doc_id, unnest(string_split(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' ')) AS w FROM documents), k AS (SELECT doc_id, CASE WHEN length(w) > 4 AND ends_with(w, 's') THEN substr(w, 1, length(w) - 1) ELSE w END AS w FROM w WHERE length(w) > 2 AND w NOT IN ('the', 'and', 'that', 'with')) SELECT doc_id, count(DISTINCT w) AS n FROM k GROUP BY doc_id")
def fn_tokens(t: Tables) -> DataFrame:
    tokens = T.tokens(F.col("text"), STOP)
    return t.documents.select("doc_id", F.size(tokens).cast("long").alias("n")).where("n > 0")


@query("fn_target_pick", "SELECT p_partkey, CASE WHEN starts_with(p_name, 'red ') AND ends_with(p_name, 'bolt') THEN 'strong' WHEN starts_with(p_name, 'red ') THEN 'colour' WHEN ends_with(p_name, 'bolt') THEN 'filtered' ELSE 'ambiguous' END AS rule FROM part")
def fn_target_pick(t: Tables) -> DataFrame:
    """The first rule that picks a target: the tokens of target and name overlap twice, by colour, otherwise once, not at all."""
    words = F.split("p_name", " ")
    overlap = F.array_intersect(words, F.array(F.lit("red"), F.lit("bolt")))
    rule = F.when(F.size(overlap) >= 2, "strong").when(F.array_contains(overlap, "red"), "colour").when(F.size(overlap) == 1, "filtered").otherwise("ambiguous")
    return t.part.select("p_partkey", rule.alias("rule"))


@query("fn_option_match", "WITH s AS (SELECT p_brand, p_partkey, CASE WHEN starts_with(p_name, 'red ') THEN 1 ELSE 0 END + CASE WHEN ends_with(p_name, 'ring') THEN 1 ELSE 0 END AS overlap, p_size FROM part WHERE NOT starts_with(p_name, 'blue ')), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY overlap DESC, p_size DESC, p_partkey) AS n FROM s) SELECT p_brand, p_partkey FROM r WHERE n = 1")
def fn_option_match(t: Tables) -> DataFrame:
    """The best object of an option (here: brand) by overlap of tokens, then area; a wrong colour is a veto."""
    words = F.split("p_name", " ")
    overlap = F.size(F.array_intersect(words, F.array(F.lit("red"), F.lit("ring"))))
    return t.part.where(F.get(words, F.lit(0)) != "blue").groupBy("p_brand").agg(F.min_by("p_partkey", F.struct((-overlap).alias("o"), (-F.col("p_size")).alias("s"), "p_partkey")).alias("p_partkey"))


@query("fn_find_by_category", "SELECT p_partkey FROM part WHERE contains(lower(p_name), lower('RING'))")
def fn_find_by_category(t: Tables) -> DataFrame:
    return t.part.where(F.lower("p_name").contains(F.lower(F.lit("RING")))).select("p_partkey")


ANGLE = "CASE WHEN a <= 22.5 OR a >= 337.5 THEN 'front' WHEN a < 67.5 THEN 'front-right' WHEN a <= 112.5 THEN 'right' WHEN a < 157.5 THEN 'behind-right' WHEN a <= 202.5 THEN 'behind' WHEN a < 247.5 THEN 'behind-left' WHEN a <= 292.5 THEN 'left' ELSE 'front-left' END"


@query("fn_angle_bucket", f"WITH x AS (SELECT o_orderkey, (o_orderkey % 720) / 2.0::DOUBLE AS a FROM orders) SELECT o_orderkey, {ANGLE} AS bucket FROM x")
def fn_angle_bucket(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", G.angle_bucket((F.col("o_orderkey") % 720) / 2.0).alias("bucket"))


BOX = "WITH b AS (SELECT p_partkey, (p_partkey % 10) / 20.0::DOUBLE AS x1, (p_partkey % 7) / 14.0::DOUBLE AS y1, (p_partkey % 10) / 20.0::DOUBLE + (p_size % 11) / 22.0::DOUBLE AS x2, (p_partkey % 7) / 14.0::DOUBLE + (p_size % 9) / 18.0::DOUBLE AS y2 FROM part) "


def boxes(t: Tables) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    x1, y1 = (k % 10) / 20.0, (k % 7) / 14.0
    return t.part.select("p_partkey", x1.alias("x1"), y1.alias("y1"), (x1 + (size % 11) / 22.0).alias("x2"), (y1 + (size % 9) / 18.0).alias("y2"))


_BOX = ["x1", "y1", "x2", "y2"]


@query("fn_bbox_placement", BOX + "SELECT p_partkey, CASE WHEN 0.5 * (y1 + y2) < 0.33 THEN 'upper' WHEN 0.5 * (y1 + y2) < 0.66 THEN 'mid' ELSE 'lower' END || ' ' || CASE WHEN 0.5 * (x1 + x2) < 0.15 THEN 'left edge' WHEN 0.5 * (x1 + x2) < 0.4 THEN 'centre-left' WHEN 0.5 * (x1 + x2) < 0.6 THEN 'centre' WHEN 0.5 * (x1 + x2) < 0.85 THEN 'centre-right' ELSE 'right edge' END AS placement, round(greatest(0, x2 - x1) * greatest(0, y2 - y1), 6) AS area FROM b")
def fn_bbox_placement(t: Tables) -> DataFrame:
    box = [F.col(c) for c in _BOX]
    return boxes(t).select("p_partkey", G.box_placement(*box).alias("placement"), F.round(G.box_area(*box), 6).alias("area"))


@query("fn_bbox_to_px", BOX + "SELECT p_partkey, round(greatest(0.0, least(639.0, x1 * 640)), 6) AS px_left, round(greatest(0.0, least(479.0, 480 - y2 * 480)), 6) AS px_top, round(greatest(0.0, least(639.0, x2 * 640)), 6) AS px_right, round(greatest(0.0, least(479.0, 480 - y1 * 480)), 6) AS px_bottom FROM b")
def fn_bbox_to_px(t: Tables) -> DataFrame:
    pixels = G.box_to_pixels([F.col(c) for c in _BOX], F.lit(480.0), F.lit(640.0))
    return boxes(t).select("p_partkey", *(F.round(p, 6).alias(n) for p, n in zip(pixels, ("px_left", "px_top", "px_right", "px_bottom"))))


@query("fn_point_in_bbox", BOX + "SELECT p_partkey, (0.3 * 100 - x1 * 100) / greatest(1.0, x2 * 100 - x1 * 100) BETWEEN -0.05 AND 1.05 AND (0.3 * 100 - y1 * 100) / greatest(1.0, y2 * 100 - y1 * 100) BETWEEN -0.05 AND 1.05 AS inside FROM b")
def fn_point_in_bbox(t: Tables) -> DataFrame:
    return boxes(t).select("p_partkey", G.point_in_box(F.lit(30.0), F.lit(30.0), [F.col(c) * 100 for c in _BOX]).alias("inside"))


@query("fn_angle_cam", "WITH p AS (SELECT c_custkey, c_acctbal / 100 AS x, (c_custkey % 9) - 4.5 AS z FROM customer) SELECT c_custkey, round((degrees(atan2(x, -z)) + 360) - 360 * floor((degrees(atan2(x, -z)) + 360) / 360), 6) AS angle FROM p")
def fn_angle_cam(t: Tables) -> DataFrame:
    """The angle of a point (here: from a customer) in a camera whose frame is the world's."""
    unit = F.array(*(F.array(*(F.lit(1.0 if i == j else 0.0) for j in range(4))) for i in range(4)))
    point = F.array(F.col("c_acctbal") / 100, F.lit(0.0), (F.col("c_custkey") % 9) - 4.5)
    return t.customer.select("c_custkey", F.round(G.camera_angle(unit, point), 6).alias("angle"))


@query("fn_rel_pose", f"WITH x AS (SELECT o_orderkey, o_orderkey % 360 + 0.25::DOUBLE AS a FROM orders) SELECT o_orderkey, {ANGLE} AS other_from_pov, CASE WHEN cos(radians(a)) > 0.5 THEN 'same way' WHEN cos(radians(a)) < -0.5 THEN 'towards' ELSE 'sideways' END AS facing FROM x")
def fn_rel_pose(t: Tables) -> DataFrame:
    """Where another camera stands and how it faces, by the product of both directions; here it is turned by an order's key."""
    a = F.col("o_orderkey") % 360 + 0.25
    d = G.dot(F.array(F.lit(0.0), F.lit(1.0)), F.array(F.sin(F.radians(a)), F.cos(F.radians(a))))
    return t.orders.select("o_orderkey", G.angle_bucket(a).alias("other_from_pov"), F.when(d > 0.5, "same way").when(d < -0.5, "towards").otherwise("sideways").alias("facing"))


@query("fn_cosine", "WITH v AS (SELECT vec_id, i, CAST(x AS DOUBLE) AS x FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)) SELECT a.vec_id, round(sum(a.x * b.x) / (sqrt(sum(a.x * a.x)) * sqrt(sum(b.x * b.x))), 6) AS cosine FROM v a JOIN v b ON a.i = b.i AND b.vec_id = a.vec_id + 1 GROUP BY a.vec_id")
def fn_cosine(t: Tables) -> DataFrame:
    v = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    return v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id").select("vec_id", F.round(G.cosine(F.col("a"), F.col("b")), 6).alias("cosine"))


SSIM = "(2 * ma * mb + 1e-4) * (2 * (ab - ma * mb) + 9e-4) / ((ma * ma + mb * mb + 1e-4) * (aa - ma * ma + bb - mb * mb + 9e-4))"


@query("fn_psnr_ssim", f"""WITH v AS (SELECT vec_id, i, CAST(x AS DOUBLE) AS x FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)),
e AS (SELECT a.vec_id, avg((a.x - b.x) * (a.x - b.x)) AS mse, avg(a.x) AS ma, avg(b.x) AS mb, avg(a.x * a.x) AS aa, avg(b.x * b.x) AS bb, avg(a.x * b.x) AS ab FROM v a JOIN v b ON a.i = b.i AND b.vec_id = a.vec_id + 1 GROUP BY a.vec_id)
SELECT vec_id, CASE WHEN mse = 0 THEN 'infinity'::DOUBLE ELSE round(10 * log10(1 / nullif(mse, 0)), 6) END AS psnr, round({SSIM}, 6) AS ssim FROM e""")
def fn_psnr_ssim(t: Tables) -> DataFrame:
    """PSNR (infinite if equal) and global SSIM of pairs of images (here: a vector and the next one)."""
    psnr, equal = G.psnr(F.col("a"), F.col("b")), F.lit(float("inf"))
    return _neighbours(t).select("vec_id", F.when(psnr == equal, psnr).otherwise(F.round(psnr, 6)).alias("psnr"), F.round(G.ssim(F.col("a"), F.col("b")), 6).alias("ssim"))


def _neighbours(t: Tables) -> DataFrame:
    v = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    return v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")


@query("fn_text_metrics", None)
def fn_text_metrics(t: Tables) -> DataFrame:
    """ROUGE-L, BLEU-1 to 4 and CIDEr of each answer against the turn before it."""
    c = t.conversations
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("reference"))
    return M.text_metrics(c.where("role = 'assistant'").join(before, ["conv_id", "turn"]).select("conv_id", "turn", F.col("text").alias("candidate"), "reference"), ["conv_id", "turn"])


@query("fn_route_parse", "SELECT event_id, CASE WHEN contains(event_type, 'view') THEN 'view' WHEN contains(event_type, 'click') THEN 'click' END AS route FROM events")
def fn_route_parse(t: Tables) -> DataFrame:
    """The first allowed route that a reply names."""
    return t.events.select("event_id", F.coalesce(*(F.when(F.regexp_like("event_type", F.lit(rf"\b{r}\b")), r) for r in ("view", "click"))).alias("route"))


@query("fn_resize_dims", "WITH s AS (SELECT p_partkey, p_size * 40.0::DOUBLE AS w, p_retailprice AS h FROM part), k AS (SELECT *, least(1.0::DOUBLE, 980.0::DOUBLE / greatest(w, h)) AS f FROM s) SELECT p_partkey, CAST(greatest(14, round_even(w * f / 14, 0) * 14) AS BIGINT) AS w, CAST(greatest(14, round_even(h * f / 14, 0) * 14) AS BIGINT) AS h FROM k")
def fn_resize_dims(t: Tables) -> DataFrame:
    """Width and height scaled to a longest side of 980 and rounded, half to even, to multiples of 14."""
    w, h = F.col("p_size") * 40.0, F.col("p_retailprice")
    f = F.least(F.lit(1.0), F.lit(980.0) / F.greatest(w, h))
    fit = lambda x: F.greatest(F.lit(14), F.rint(x * f / 14) * 14).cast("long")
    return t.part.select("p_partkey", fit(w).alias("w"), fit(h).alias("h"))


@query("fn_token_count", "SELECT doc_id, (doc_id % 640 + 64) * 480 // 196 + len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS tokens FROM documents")
def fn_token_count(t: Tables) -> DataFrame:
    """Patches of an image (here: as wide as doc_id says) and words of a text."""
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    return t.documents.select("doc_id", (F.expr("(doc_id % 640 + 64) * 480 div 196") + words).alias("tokens"))


@query("fn_loss_weight", "SELECT doc_id, round(1 / sqrt(n_chars + 1), 6) AS square, round(1.0::DOUBLE / (n_chars + 1), 6) AS sample FROM documents")
def fn_loss_weight(t: Tables) -> DataFrame:
    n = F.col("n_chars") + 1
    return t.documents.select("doc_id", *(F.round(G.loss_weight(n, k), 6).alias(k) for k in ("square", "sample")))


@query("fn_frame_indices", "SELECT p_partkey, p_size // 2 AS middle, (p_size - 1) // 4 * 3 AS third FROM part")
def fn_frame_indices(t: Tables) -> DataFrame:
    """Frames of a clip: the middle one, and the last of four spread evenly from the first."""
    spread = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.expr("(p_size - 1) div 4") * k)
    return t.part.select("p_partkey", F.expr("p_size div 2").cast("int").alias("middle"), F.get(spread, F.lit(3)).cast("int").alias("third"))


@query("fn_curriculum_p", "SELECT event_id, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, (event_id - 500) / 1500.0::DOUBLE)), 6) AS p FROM events")
def fn_curriculum_p(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.round(G.curriculum(F.col("event_id"), 500.0, 2000.0), 6).alias("p"))


@query("fn_mention", "SELECT lang, round(avg(CASE WHEN regexp_matches(text, '(?i)\\b(the|der|les)\\b') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS rate FROM documents GROUP BY lang")
def fn_mention(t: Tables) -> DataFrame:
    """How often texts name any of several aliases."""
    hit = F.when(F.regexp_like("text", F.lit(r"(?i)\b(the|der|les)\b")), 1.0).otherwise(0.0)
    return t.documents.groupBy("lang").agg(F.round(F.avg(hit), 6).alias("rate"))


@query("fn_hash_pixels", "SELECT vec_id, md5(unhex(string_agg(printf('%02X', CAST(trunc(abs(CAST(x AS DOUBLE)) * 255) AS INTEGER) & 255), '' ORDER BY i))) AS digest FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY vec_id")
def fn_hash_pixels(t: Tables) -> DataFrame:
    """md5 of decoded pixels. Pixels are arrays of bytes here (vectors, scaled), as no image library is at hand; encoded images are decoded by a function the caller gives."""
    return M.hash_pixels(t.embeddings.select("vec_id", F.transform("embedding", lambda x: (F.abs(x.cast("double")) * 255).cast("int")).alias("pixels")), "vec_id", "pixels")
