"""A training corpus in four stages: quality, near-duplicates, mixture, tokens.

Each stage works on all that its predecessor kept, is written as Parquet in the
folder that driver and executors share, and is read again, so that a lost executor
costs no more than the stage that runs.

Null texts count as empty in each stage.  Rows that repeat an id and a text are one
document from the second stage on; rows without an id are told apart by their texts,
and repeats that the mixture takes stay.  Other columns pass through all stages but
the last, whatever their names.  No documents, or no labels, give what the stages give
for them: no rows, or the same score for all.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from signet.llm import bpe, mixing, quality, similar
from signet.llm.common import shared_dir, table


def accepted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier accepts."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are similar by 0.8 or more, by operator 7's trie self-join."""
    return similar.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources takes them."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document of the mixture."""
    import public_tokenizers

    return bpe.encode(docs.select("doc_id", "source", "text"), public_tokenizers.path(bpe.VOCABULARY), public_tokenizers.PATTERN)


STAGES = [("quality", accepted), ("near_dedup", distinct), ("mixing", mixture), ("bpe", tokens)]

#: Compressed sizes and merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    place = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{name}")
        docs = spark.read.parquet(f"{place}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
