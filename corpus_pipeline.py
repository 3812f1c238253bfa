"""Corpus pipeline: quality, toxicity, near-duplicates, repeated passages, packing.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and calls one operator of
``plumbline.llm``.  All but the last return the columns of ``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm.common import discard, stage, table
from plumbline.llm.minhash import one_of_each
from plumbline.llm.packing import pack_documents
from plumbline.llm.quality import good_documents
from plumbline.llm.queries import tokenizer_path
from plumbline.llm.repeats import without_repeats
from plumbline.llm.toxicity import clean_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return good_documents(docs, table(spark, sf_dir, "labels"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxic window go."""
    return clean_documents(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return one_of_each(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur twice are taken out of the texts."""
    return without_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 4096 ids, as few as the plan can make."""
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"), 4096)


STAGES = [
    ("quality", quality),
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("passage_dedup", passage_dedup),
    ("packing", packing),
]

#: classifiers and tokenizers are beyond SQL; the stages are tested against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        before, docs = docs, stage(step(spark, docs, sf_dir), name)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
