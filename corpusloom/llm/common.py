"""What the operators of this subpackage share: tables, code shipping and joins by document; lineage cuts and order are the library's."""

from __future__ import annotations

import os
from math import ceil

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.ordering import cut, in_order

__all__ = ["cut", "cut_small", "in_order", "least_row", "row_key", "ship_code", "signed", "table", "with_keys"]

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_code(spark: SparkSession) -> None:
    """Let Python workers started from now on import this package, whatever their folder is."""
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep)
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])


def signed(value: int) -> int:
    """The signed 64-bit integer with the bits of an unsigned one."""
    return value - (1 << 64) if value >= 1 << 63 else value


def cut_small(df: DataFrame, per_part: int = 50_000, **sums: Column) -> tuple[DataFrame, dict]:
    """cut(df), and its number of rows `n` and other aggregates, taken as it is written.

    A small table is read again in parts of about per_part rows: in a part for each of the shuffle's it
    would cost as many tasks, and files in every shuffle that reads it. Larger ones stay as they are.
    """
    seen, wanted = Observation(), [F.count(F.lit(1)).alias("n"), *[c.alias(name) for name, c in sums.items()]]
    out = cut(df.observe(seen, *wanted))
    found = seen.get or out.agg(*wanted).first().asDict()  # an empty table can be optimised away with its aggregates
    parts = max(1, ceil(found["n"] / per_part))
    few = 2 * parts < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (out.coalesce(parts) if few else out), found


def row_key(docs: DataFrame) -> Column:
    """What tells a document from others: a digest of its doc_id, null or not, and its whole text."""
    text = F.col("text").cast("string") if "text" in docs.columns else F.lit(None).cast("string")
    return F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce(text, F.lit("")))))


def least_row(docs: DataFrame) -> list[Column]:
    """Fields that order documents: by doc_id, nulls last, and of equal ones by row_key(), the field `key`."""
    return [F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("bigint").alias("id"), row_key(docs).alias("key")]


def with_keys(docs: DataFrame, keys: DataFrame, how: str, once: bool = False) -> DataFrame:
    """The rows of docs, all columns, whose row_key() is in keys (`key`; 'left_semi') or is not ('left_anti').

    With `once` one row a key stays; it shares the join's exchange. Broadcast hints on keys are kept.
    """
    name = "__row_key"
    kept = docs.withColumn(name, row_key(docs)).join(keys.withColumnRenamed("key", name), name, how)
    return (kept.dropDuplicates([name]) if once else kept).select(*[F.col(f"`{c}`") for c in docs.columns])
