"""Filters of a training corpus, run one after another over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame: the documents it
keeps, with the columns they had; the last one adds their tokens.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import bpe, decontamination, gram_join, surrogates, toxicity
from millrace.llm.columns import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; it is trained on the labelled ones among docs."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of exact and near copies the document of the smallest id stays."""
    return gram_join.drop_similar(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontamination.drop_leaked(docs, table(spark, sf_dir, "benchmark"))


def replace_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Private data in the texts is replaced; every document stays."""
    return surrogates.with_surrogates(docs, in_place=True)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """tokens, n_tokens and n_bytes are added; every document stays."""
    return bpe.with_tokens(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("pii", replace_private_data),
    ("bpe", encode),
]

#: SQL has no classifier, automaton, keyed permutation or tokenizer; tests/llm compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
