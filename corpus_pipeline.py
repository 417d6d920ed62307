"""The corpus pipeline: quality, near-duplicates, decontamination, mixing and shards, in that order.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's result as
Parquet and reads it again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm.common import table
from corpusloom.llm.decontaminate import without_leaks
from corpusloom.llm.jaccard import keep_one_of_each_group
from corpusloom.llm.mixing import mixed_documents
from corpusloom.llm.quality import good_documents
from corpusloom.llm.sharding import byte_shards
from corpusloom.operators.ordering import shared_folder

#: Of the tokens that are left, the share that the mix is filled to.
MIX_SHARE = 0.8
#: No document counts more than once in the mix.
MIX_EPOCHS = 1


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier gives at least an even chance of label 1."""
    return good_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group that five-word Jaccard similarities of 0.8 connect."""
    return keep_one_of_each_group(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fill the budgets of the domain-language-source tree, each once."""
    return mixed_documents(docs, budget_share=MIX_SHARE, max_epochs=MIX_EPOCHS)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each document in 24 contiguous shards of near-equal bytes."""
    return byte_shards(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing to target weights", mixing_stage),
    ("sharding", sharding_stage),
]

#: The classifier and the near-dedup are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents in sf_dir.

    Stages' results are written to a new folder in the session's shared checkpoint folder; a stage's
    input is removed once its result is written, so that two of them are there at a time.
    """
    folder, docs, before = f"{shared_folder(spark)}/corpus_pipeline_{uuid.uuid4().hex}", table(spark, sf_dir, "documents"), None
    for number, (_, stage) in enumerate(STAGES):
        out = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if before:
            _remove(spark, before)
        before = out
    return docs


def _remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Spark can open."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
