"""A corpus pipeline: five stages, each of which calls one operator of sparkloom.llm on all that the stage before has kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs. All but the
last return the columns of documents, whatever other columns there are; names that begin with two underscores are the stages' own.

Every stage takes null ids and texts, one id with several texts, repeated rows, very long texts and empty tables. A row with a null text is never toxic, counts
as empty in exact dedup, has no near copies, isn't taken by the mix (nor is any text without words), and would have no ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import exact_dedup, mixing, near_dedup, pieces, toxicity
from sparkloom.llm.storage import cut, discard


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, learned from labelled ones among docs, doesn't call toxic."""
    return toxicity.reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def remove_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of equal texts, or one without a doc_id where none has any."""
    return exact_dedup.keep_documents(docs)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each class of near duplicates."""
    return near_dedup.keep_one_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; documents without words, which no mix can take, go."""
    return mixing.repeat_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and source of every row, the number of its pieces and bytes, and the hashes of its ids and of the decoded text."""
    keep = ("doc_id", "source")
    return pieces.digests(pieces.encode(docs, pieces.model_path(), keep=keep), keep)


STAGES = [
    ("toxicity", remove_toxic),
    ("exact dedup", remove_copies),
    ("n-gram Jaccard join", remove_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode_pieces),
]

#: SQL can't express the classifier, so the pipeline is tested stage by stage against brute force (tests/llm/test_llm.py).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        kept = cut(stage(spark, docs, sf_dir), f"stage{k + 1}")
        if k:
            discard(docs)  # the stage before, which nothing reads any more
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
