"""Corpus pipeline: documents of a known language, one of each group of near copies, without secrets, packed.

Each stage takes (spark, docs, sf_dir), where docs is all that its predecessor kept, and returns a DataFrame.
All but the last return the columns of documents.  Nulls, repeated rows and empty tables are as the operators
state; columns beside doc_id, text, lang and n_chars pass through unchanged.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from dupeloom.llm.common import cut, documents
from dupeloom.llm.langid import keep_identified
from dupeloom.llm.minhash import keep_one_of_each
from dupeloom.llm.packing import pack_documents
from dupeloom.llm.secretscan import redact_secrets


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language go: without a letter, or with trigrams that no mixture of languages makes likelier than chance."""
    return keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links of five-word shingles at 0.8 join, the one with the smallest doc_id stays."""
    return keep_one_of_each(docs, shingle=5, percent=80)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets, sure ones and linked weak ones, are replaced by a mark."""
    return redact_secrets(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are packed into sequences of at most 1024 tokens; a row per piece."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("best_fit_packing", best_fit_packing)]

#: Mixture inference and near-duplicate components cannot be put as SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, over the whole of documents."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
