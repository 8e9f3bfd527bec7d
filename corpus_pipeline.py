"""Corpus pipeline: quality rules, near-duplicate removal, secret redaction, mixing of sources, tokens.

Each stage takes the documents that the one before it kept and returns the same columns; the last returns the encoded documents.

* quality: documents that the base rules or the robust outlier test reject go.
* near_dedup: one document of each component of SimHash links stays, the one with the smallest id.
* secrets: what the forest finds to be a secret is replaced in the text; n_chars follows.
* mixing: a document occurs once per epoch in which the mix takes of it, with the words taken; n_chars follows.
* bpe: token count, digests and ids of every text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfline.llm.bpe import encode_documents
from shelfline.llm.common import stored, table
from shelfline.llm.mixing import mixed_documents
from shelfline.llm.quality import judge_quality
from shelfline.llm.secrets import redact
from shelfline.llm.simhash import without_near_duplicates
from shelfline.session import ship_package


def measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return judge_quality(docs, docs.columns).filter("kept").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return without_near_duplicates(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return measured(redact(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return measured(mixed_documents(docs))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=True)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("secrets", secrets), ("mixing", mixing), ("bpe", bpe)]

#: The robust outlier test, the forest and the permutations have no SQL twin; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
