"""URL filter: host and path rules first, then a weighted vocabulary found by an Aho-Corasick automaton.

A rule fits its host and all subdomains if the url's path starts with the rule's path; the longest fitting rule decides. For
other urls the automaton finds every term of the vocabulary in the url, A-Z lower-cased. A hit counts where the characters next
to it are no ASCII letters or digits. One strict hit blocks a url, as do `soft_needed` distinct soft terms.

The operator works row by row without a shuffle, so hot hosts don't matter. A null url, or one without `://`, has an empty host
and path; a null url has no hits and is allowed. Repeated rows give repeated rows; other columns of the input aren't read, so they may have any name. Urls are
read whole, however long. Of two fitting rules of equal length the one with the longer host decides, then the later one in the list.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"


@dataclass(frozen=True)
class Vocabulary:
    strict: tuple[str, ...]
    soft: tuple[str, ...]
    soft_needed: int = 2


RULES = (
    Rule("allow", "com"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)

VOCABULARY = Vocabulary(
    strict=("casino", "hentai", "malware", "phishing", "porn", "sportsbook", "spam", "viagra", "warez", "xxx"),
    soft=("adult", "bet", "bonus", "cheap", "crack", "dating", "free", "hot", "keygen", "loan", "pills", "replica", "sex", "slots", "win"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TO_LOWER = str.maketrans(_UPPER, _LOWER)
_WORD = frozenset(_LOWER + "0123456789")


MOST_TERMS = 100_000


def vocabulary_of(terms: DataFrame, soft_needed: int = 2) -> Vocabulary:
    """The vocabulary in a table of term and strict (boolean). It goes to every worker, so more than MOST_TERMS are an error; empty and null terms are left out."""
    rows = terms.where("term <> '' AND strict IS NOT NULL").select("term", "strict").distinct().limit(MOST_TERMS + 1).collect()
    if len(rows) > MOST_TERMS:
        raise ValueError(f"a vocabulary of more than {MOST_TERMS} terms")
    return Vocabulary(*(tuple(sorted(r.term for r in rows if r.strict == kind)) for kind in (True, False)), soft_needed)


@lru_cache(8)
def _automaton(vocabulary: Vocabulary) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for strict, terms in ((False, vocabulary.soft), (True, vocabulary.strict)):
        for term in terms:
            found.add_word(term.translate(_TO_LOWER), (len(term), strict, term))
    found.make_automaton()
    return found


def vocabulary_hits(url: str | None, vocabulary: Vocabulary = VOCABULARY) -> tuple[int, int]:
    """How many strict hits and how many distinct soft terms a url has."""
    if not url or not (vocabulary.strict or vocabulary.soft):
        return 0, 0
    text, strict, soft = url.translate(_TO_LOWER), 0, set()
    for end, (n, is_strict, term) in _automaton(vocabulary).iter(text):
        start = end + 1 - n
        if (start and text[start - 1] in _WORD) or (end + 1 < len(text) and text[end + 1] in _WORD):
            continue
        if is_strict:
            strict += 1
        else:
            soft.add(term)
    return strict, len(soft)


def _fits(rule: Rule) -> Column:
    host = F.col("host")
    return ((host == rule.host) | host.endswith("." + rule.host)) & F.col("path").startswith(rule.path)


def filter_urls(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", rules: Sequence[Rule] = RULES, vocabulary: Vocabulary = VOCABULARY) -> DataFrame:
    """The id, host, path, rule (null if none fits), verdict, n_strict and n_soft of every row."""

    @F.pandas_udf("n_strict int, n_soft int")
    def hits(urls: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([vocabulary_hits(u, vocabulary) for u in urls], columns=["n_strict", "n_soft"])

    url = F.coalesce(F.col(url_column).cast("string"), F.lit(""))
    rows = pages.select(
        id_column,
        F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER).alias("host"),
        F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1).alias("path"),
        hits(url).alias("hits"),
    )
    rule, verdict = F.lit(None).cast("string"), F.when((F.col("hits.n_strict") > 0) | (F.col("hits.n_soft") >= vocabulary.soft_needed), "block").otherwise("allow")
    for r in sorted(rules, key=lambda r: (len(r.host + r.path), len(r.host))):  # the longest is asked first
        rule, verdict = F.when(_fits(r), r.host + r.path).otherwise(rule), F.when(_fits(r), r.verdict).otherwise(verdict)
    return rows.select(id_column, "host", "path", rule.alias("rule"), verdict.alias("verdict"), "hits.n_strict", "hits.n_soft")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _oracle() -> str:
    fits = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    ordered = sorted(RULES, key=lambda r: (-len(r.host + r.path), -len(r.host)))
    case = lambda f, other: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{f(r)}'" for r in ordered) + f" ELSE {other} END"
    count = lambda terms: " + ".join(f"len(regexp_extract_all(low, '(^|[^a-z0-9]){t}($|[^a-z0-9])'))" for t in terms)
    some = lambda terms: " + ".join(f"CASE WHEN regexp_matches(low, '(^|[^a-z0-9]){t}($|[^a-z0-9])') THEN 1 ELSE 0 END" for t in terms)
    return f"""
    WITH low AS (SELECT page_id, translate(coalesce(url, ''), '{_UPPER}', '{_LOWER}') AS low, coalesce(url, '') AS url FROM pages),
    cut AS (SELECT page_id, low,
        translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '{_UPPER}', '{_LOWER}') AS host,
        regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path,
        CAST({count(VOCABULARY.strict)} AS INTEGER) AS n_strict, CAST({some(VOCABULARY.soft)} AS INTEGER) AS n_soft FROM low)
    SELECT page_id, host, path, {case(lambda r: r.host + r.path, "NULL")} AS rule,
        {case(lambda r: r.verdict, f"CASE WHEN n_strict > 0 OR n_soft >= {VOCABULARY.soft_needed} THEN 'block' ELSE 'allow' END")} AS verdict, n_strict, n_soft FROM cut
    """


ORACLE_SQL = _oracle()
