"""Scalar functions on model outputs, as column expressions.

The patterns are fixed values: they define which answer counts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, or null."""
    return F.when(F.regexp_like(text, F.lit(pattern)), F.regexp_extract(text, pattern, group))


def last_found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(-1))


def _chain(text: Column, patterns: list[str], letters: str, last: bool = True) -> Column:
    plain = F.replace(text, F.lit("**"), F.lit(""))
    steps = [found(plain, p) for p in patterns]
    if last:
        steps.append(last_found(plain, rf"\b([{letters}])\b"))
    return F.upper(F.coalesce(*steps))


# One pattern for each step, in order.
TAG = r"(?is)<answer>\s*\(?([A-D])\)?\s*</answer>"
STRICT = r"(?i)answer:\s*([A-D])"
STRICT_PAREN = r"(?i)answer:\s*\(?([A-D])"
BRACKET = r"[\(\[]([A-D])[\)\]]"
PAREN, SQUARE = r"\(([A-D])\)", r"\[([A-D])\]"
BOXED = r"\\boxed\{([A-D])\}"


def extract_answer(text: Column) -> Column:
    """Letter in the answer tag, after `Answer:`, in brackets, boxed, or the last that stands alone."""
    return _chain(text, [r"(?is)<answer>\s*([A-D])\s*</answer>", STRICT, BRACKET, BOXED], "A-D")


def extract_answer_paren(text: Column) -> Column:
    return _chain(text, [TAG, STRICT_PAREN, PAREN, SQUARE, BOXED], "A-D")


def extract_answer_notag(text: Column) -> Column:
    return _chain(text, [STRICT, BRACKET], "A-D")


def extract_answer_nobox(text: Column) -> Column:
    return _chain(text, [r"(?is)<answer>\s*([A-D])\s*</answer>", STRICT, BRACKET], "A-D")


def extract_answer_ab(text: Column) -> Column:
    sub = [p.replace("A-D", "A-B") for p in (r"(?is)<answer>\s*([A-D])\s*</answer>", STRICT, BRACKET)]
    return _chain(text, sub, "A-B")


def extract_answer_raw(text: Column) -> Column:
    """What the answer tag holds, in upper case if it is one letter; else as extract_answer."""
    tag = F.trim(found(text, r"(?is)<answer>(.*?)</answer>"))
    return F.when(tag.isNull(), extract_answer(text)).when(F.regexp_like(tag, F.lit("(?i)^[A-D]$")), F.upper(tag)).otherwise(tag)


def extract_boxed(text: Column) -> Column:
    """What the last box holds, braces nested once, else the last answer tag's content."""
    return F.trim(F.coalesce(last_found(text, r"\\boxed\{((?:[^{}]|\{[^{}]*\})*)\}"), last_found(text, r"(?s)<answer>(.*?)</answer>")))


def extract_boxed_chain(text: Column) -> Column:
    return F.trim(F.coalesce(last_found(text, r"\\boxed\{((?:[^{}]|\{[^{}]*\})*)\}"), last_found(text, r"\\bbox\{((?:[^{}]|\{[^{}]*\})*)\}"), last_found(text, r"(?s)<answer>(.*?)</answer>")))


def extract_boxed_free(text: Column) -> Column:
    """As extract_boxed_chain; else a leading letter, `answer is X`, or a trailing letter."""
    return F.coalesce(extract_boxed_chain(text), F.upper(found(text, r"^\s*\(?([A-Da-d])[\)\.:\s]")), F.upper(found(text, r"(?i)answer is\s*:?\s*\(?([A-D])\b")), F.upper(found(text, r"\b([A-D])\.?\s*$")))


def extract_number(text: Column) -> Column:
    """The number in the answer tag, after `Answer:`, or the last one outside of [Round N]."""
    plain = F.replace(text, F.lit("**"), F.lit(""))
    last = last_found(F.regexp_replace(plain, r"\[Round [0-9]+\]", ""), r"\b([0-9]+(?:\.[0-9]+)?)\b")
    steps = [found(plain, r"(?i)<answer>\s*([0-9.]+)\s*</answer>"), found(plain, r"(?i)answer:\s*([0-9.]+)"), last]
    return F.coalesce(*(x.try_cast("double") for x in steps))


def parse_judge(text: Column) -> Column:
    """True or false as a judge says it: at the start after its thoughts, else the first such word; null if neither."""
    plain = F.lower(F.trim(F.regexp_replace(text, r"(?s)<think>.*?</think>", "")))
    return F.coalesce(found(plain, r"^(true|false)"), found(plain, r"\b(true|false)\b")) == "true"


def parse_score(text: Column) -> Column:
    return F.coalesce(found(text, r"(?is)<score>\s*([1-5])\s*</score>"), found(text, r"(?i)score\s*[:=]?\s*([1-5])\b"), found(text, r"\b([1-5])\b")).try_cast("int")


def think(text: Column) -> Column:
    return F.trim(found(text, r"(?s)<think>(.*?)</think>"))


def answer(text: Column) -> Column:
    return F.trim(found(text, r"(?s)<answer>(.*?)</answer>"))


def parse_status(text: Column, gold: Column) -> Column:
    """ok, wrong or parse_fail; without a think tag the text before the answer counts as thoughts."""
    thoughts = F.coalesce(think(text), F.trim(found(text, r"(?s)^(.*?)<answer>")))
    return F.when(answer(text).isNull() | thoughts.isNull() | (thoughts == ""), "parse_fail").when(F.upper(answer(text)) == F.upper(gold), "ok").otherwise("wrong")


def without_tags(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"</?[a-z_]+>", ""))


def extract_thinking(text: Column) -> Column:
    return F.coalesce(F.trim(found(text, r"(?s)<thinking>(.*?)</thinking>")), without_tags(text))


def normalised(text: Column) -> Column:
    """Trimmed, lower-cased, without closing full stops and without a pair of quotes around."""
    s = F.regexp_replace(F.lower(F.trim(text)), r"\.+$", "")
    return F.when(F.regexp_like(s, F.lit("^\"[^\"]*\"$")) | F.regexp_like(s, F.lit("^'[^']*'$")), s.substr(F.lit(2), F.length(s) - 2)).otherwise(s)


def mean_relative_accuracy(predicted: Column, gold: Column) -> Column:
    """Share of the thresholds .5, .55, ... .95 whose complement exceeds the relative error; 0 if gold is 0 or either is null."""
    error = F.abs(predicted - gold) / F.nullif(F.abs(gold), F.lit(0.0))
    hits = F.aggregate(F.sequence(F.lit(0), F.lit(9)), F.lit(0), lambda acc, i: acc + F.when(error < F.lit(1.0) - (F.lit(0.5) + F.lit(0.05) * i), 1).otherwise(0))
    return F.when(error.isNull(), 0.0).otherwise(hits / F.lit(10.0))


def letter(index: Column) -> Column:
    return F.char(F.lit(65) + index.cast("int"))


def source_from_path(path: Column, parts: dict[str, str]) -> Column:
    """The source of the first of the parts that a path has, else unknown."""
    return F.coalesce(*(F.when(path.contains(part), name) for part, name in parts.items()), F.lit("unknown"))


def prefixed_id(sample: Column, path: Column, parts: dict[str, str]) -> Column:
    """The id with its source in front, unless it has one or the source is unknown."""
    source = source_from_path(path, parts)
    has = F.lit(False)
    for name in parts.values():
        has |= sample.startswith(name + "_")
    return F.when((sample == "") | has | (source == "unknown"), sample).otherwise(F.concat(source, F.lit("_"), sample))


def tokens(text: Column, stop: list[str]) -> Column:
    """Distinct lower-case words of over two letters or digits of any script, without stop words; of what is left, words of over four lose a closing s."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: (F.length(w) > 2) & ~w.isin(stop))
    return F.array_distinct(F.transform(words, lambda w: F.when((F.length(w) > 4) & w.endswith("s"), w.substr(F.lit(1), F.length(w) - 1)).otherwise(w)))
