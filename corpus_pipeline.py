"""Corpus pipeline: toxicity, SimHash near-duplicates, benchmark
decontamination, source mixing, token ids.

Every stage takes ``(spark, docs, sf_dir)`` and works on all documents its
predecessor kept.  All but the last return the columns of ``documents`` (a
document mixed in for several epochs is several rows); the last writes the
token files and returns what it reads back from them.  Stages are judged on
their own input: the toxicity model is learned from the labelled documents the
stage is given, duplicates are sought among what is left, and so on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refbank.llm import decontaminate, simhash, tokens, toxicity
from refbank.llm.common import HELD_OUT_FOLD, fold, store, table
from refbank.llm.entries import mixed, tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the class-conditional models score below the threshold."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), fold("doc_id") != HELD_OUT_FOLD)
    return toxicity.drop_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id) of every group of linked fingerprints."""
    return simhash.drop_near_duplicates(docs, shingle=4, max_bits=4)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window that matches a benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), threshold=0.8)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by hierarchical budgets, repeated by epoch."""
    return mixed(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, read back: doc_id, start, n_tokens, ids_crc32."""
    return tokens.token_output(docs, tokenizer_path(), end_id=2)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
    ("token_output", write_tokens),
]

#: Fingerprints, learned models and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir).select(*docs.columns), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
