"""A training corpus from raw documents: each stage reads what the one before it kept.

Null and empty texts have no words, so the first stage rejects them. Of exact or near copies those
with the smallest doc_id stay; rows of one doc_id stay or go together, and a row without one stays.
A null lang or source is a group of its own. An empty table gives no rows in every stage.
Columns other than doc_id, text, lang, source and n_chars pass through up to the last stage,
whatever their names; only an n_entities is set anew with the surrogates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerflow.llm.common import materialize, table
from ledgerflow.llm.minhash import NearDuplicates, keep_one
from ledgerflow.llm.mixing import mix_documents
from ledgerflow.llm.packing import pack_documents
from ledgerflow.llm.privacy import replace_private
from ledgerflow.llm.quality import keep_good


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the thresholds of their language and source reject go."""
    return keep_good(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with 0.8 or more of their five-word shingles in common, one stays."""
    return keep_one(docs, NearDuplicates(width=5, percent=80, bands=36, rows=5))


def privacy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets get surrogates; every document stays."""
    return replace_private(docs).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are repeated or thinned out to their target weights."""
    return mix_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenized pieces and their places in sequences of 1024."""
    return pack_documents(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("near-duplicates", near_duplicate_stage),
    ("surrogates", privacy_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Shingle similarity, surrogates and packing cannot be said in SQL; tests/llm has the stages one after another against plain expectations.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
