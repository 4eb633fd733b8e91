"""From raw documents to packed sequences, a table written between the stages.

A stage alone leaves the session with small batches for Python, since its result is computed when it is written; run() puts
the session's own setting back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from loomery.llm.common import set_batches, small_batches
from loomery.llm.mixing import mixing_stage
from loomery.llm.packing import packing_stage
from loomery.llm.pii import pii_stage
from loomery.llm.quality_classifier import quality_stage
from loomery.llm.simhash import dedup_stage
from loomery.session import shared_dir, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    set_batches(spark)
    return quality_stage(spark, docs, sf_dir)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    set_batches(spark)
    return dedup_stage(spark, docs, sf_dir)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    set_batches(spark)
    return pii_stage(spark, docs, sf_dir)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    set_batches(spark)
    return mixing_stage(spark, docs, sf_dir)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    set_batches(spark)
    return packing_stage(spark, docs, sf_dir)


STAGES = [("quality", quality), ("dedup", dedup), ("pii", pii), ("mixing", mixing), ("packing", packing)]

#: the classifier, the random field and the tokenizer are not SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents; each result is written to the shared folder and read again."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    with small_batches(spark):
        for name, stage in STAGES:
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
    return docs
