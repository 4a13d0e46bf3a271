"""The corpus pipeline: operators of lagscope.llm in a row over documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it to the session's shared folder and the next stage reads it from there, so a
lost executor never costs more than the stage that is running.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lagscope.llm import bpe, exact_dedup, lang_id, mixing, simhash
from lagscope.llm.common import stage, table


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents that it rejects go."""
    return lang_id.accepted(docs, lang_id.fit(docs))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: the longest of equal texts stays."""
    return exact_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: one document of each group stays."""
    return simhash.deduplicated(docs, shingle=4, max_bits=4)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: every document as often as its source's target takes it."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE encoding and decoding: doc_id, n_tokens and digests of both."""
    return bpe.round_trip_digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", keep_identified),
    ("exact dedup", drop_exact_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: Language models, block joins and the cube method are not SQL; the tests
#: hold run() against brute-force versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), "pipeline-" + name.split()[0].lower())
    return docs
