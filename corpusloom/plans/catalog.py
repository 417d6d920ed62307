"""The registered queries of the library's own operators, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.plans import assembly_queries, dedup_queries, report_queries, stats_queries, text_queries, web_queries
from corpusloom.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "flagship", "assembly_queries", "dedup_queries", "report_queries", "stats_queries", "text_queries", "web_queries"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean all documents, drop copies, and count lines and words by source."""
    return QUERIES["flagship"](spark, sf_dir)
