"""Corpus pipeline: toxicity, line dedup, near-duplicates, secrets, packing; each stage is written and read by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenrv.llm.common import materialize
from lumenrv.llm.line_dedup import dedup_lines
from lumenrv.llm.near_copies import drop_near_copies
from lumenrv.llm.packing import pack
from lumenrv.llm.secrets import redact_secrets
from lumenrv.llm.toxicity import score_toxicity


def _measured(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of documents, with the number of characters of the text as it is now."""
    return df.withColumn("n_chars", F.length("text").cast(like.schema["n_chars"].dataType)).select(*like.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network predicts as toxic go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_toxicity(docs, labels).filter("predicted = 0").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of lines that an earlier document holds go; documents of which nothing is left go too."""
    cut = dedup_lines(docs)
    left = cut.filter((F.size("removed_lines") == 0) | (F.trim(F.translate("text", "\n\r\t", "   ")) != ""))
    return _measured(left, docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of the smallest id: five words, similarity 0.8."""
    return drop_near_copies(docs, percent=80, width=5).select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    return _measured(redact_secrets(docs), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 ids."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("secrets", secrets), ("packing", packing)]

#: No SQL: a trained network and library tokenizers; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
