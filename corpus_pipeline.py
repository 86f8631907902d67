"""Corpus pipeline: classify quality, drop repeated lines, drop near-duplicates, mix sources, encode.

Defined cases: a null text is classified as an empty one, has no lines, has fingerprint zero, has no words to mix and
encodes to no ids; rows that share an id or have none are documents of their own; columns beyond those of ``documents``
are carried along up to the last stage; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from mirrorloom.llm import bpe, line_dedup, mixing, quality_fm, simhash_pigeonring
from mirrorloom.llm.common import documents, drop_stored, labels, shared_folder
from mirrorloom.llm.queries import vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labelled documents of this input."""
    return quality_fm.keep_good(docs, labels(spark, sf_dir))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one, or nearly, go; every document stays."""
    return line_dedup.rewrite_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    return simhash_pigeonring.drop_near_duplicates(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.repeat_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the text decoded from them."""
    return bpe.encode_decode(docs, vocabulary(), keep=("ids",))


STAGES = [("quality classifier", quality), ("line dedup", lines), ("SimHash near-dedup", near_duplicates), ("mixing", mixture), ("BPE", encode)]

#: SQL can express neither the classifier, the fingerprints, the balancing nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read back by the next."""
    docs, before = documents(spark, sf_dir), None
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}")
        docs = spark.read.parquet(f"{base}/{i}")
        if before is not None:
            drop_stored(before)  # the stage that read it is written
        before = docs
    return docs
