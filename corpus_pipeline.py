"""A training corpus in five stages: quality, copies, test items, mix, token files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidings.llm import decontamination, mixing, near_duplicates, quality_classifier
from tidings.llm.common import stored, table
from tidings.llm.queries import token_digest

#: Strings that a task of the last stage remembers; few, for executors that have run four stages before.
REMEMBERED = 20_000
#: Bytes of text that a task of the last stage encodes at a time, for the same reason.
TOGETHER = 1 << 19


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from those labelled among them, accepts."""
    ranking = quality_classifier.train_ranking(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.good_rows(docs, ranking)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_duplicates.deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of a test item; a document that holds one goes as a whole."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"), coverage=0)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.repeated(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the corpus, and one row for every document in them."""
    return token_digest(spark, docs, REMEMBERED, TOGETHER)


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("token_ids", token_ids),
]

#: SQL can neither learn the classifier nor run the tokenizer; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a table that the next stage reads."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
