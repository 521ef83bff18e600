"""A corpus pipeline: quality, exact duplicates, near duplicates, mixing, tokens.

Every stage takes all documents the stage before kept, and its result is written as Parquet in the shared folder
and read again, so a lost executor repeats at most the stage at hand.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from wayfare.llm import bpe, chosen_path, divergence, exact_dedup, mixing
from wayfare.llm.catalog import RANKS
from wayfare.llm.common import prepare
from wayfare.session import materialise


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and stay near their language's histograms, if it has any; limits are set
    from the table of labels, if there is one."""
    prepare(spark)
    try:
        labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        labels = None
    return divergence.kept(docs, labels=labels)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest identifier."""
    prepare(spark)
    return exact_dedup.kept(docs, keep="largest")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates, the document with the least identifier."""
    prepare(spark)
    return chosen_path.kept(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    prepare(spark)
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of every document of the mix, repeats included."""
    prepare(spark)
    return bpe.encode_digests(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [("quality rules", quality), ("exact dedup", exact), ("n-gram Jaccard join", near), ("mixing", mix), ("byte-level BPE", tokens)]

#: SQL has no byte-pair merges; tests hold ``run`` against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{k}")
    return docs
