"""Where queries are registered, each with the DuckDB SQL for the same rows if SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

Read = Callable[[str], DataFrame]


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if its scan is small: fewer bytes than one partition a core may have, so that one file would be one task.

    The size is that of the planner's statistics; a large table stays as it is read, without a shuffle.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    most = cores * spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    return df.repartition(cores) if size < most else df


def query(sql: str | None = None, name: str | None = None) -> Callable:
    """Register a function of a table reader as a query of (spark, sf_dir)."""

    def register(make: Callable[[Read], DataFrame]) -> Callable[[Read], DataFrame]:
        key = name or make.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return make(lambda table: spread(spark.read.parquet(f"{sf_dir}/{table}.parquet")))

        run.__name__, run.__doc__ = key, make.__doc__
        QUERIES[key] = run
        if sql:
            ORACLE_SQL[key] = sql
        return make

    return register


def category() -> Column:
    """A fifth of the sources count as collected by hand."""
    return F.when(F.col("source").isin("src0", "src5", "src10", "src15"), "manual").otherwise("public")


CATEGORY_SQL = "CASE WHEN source IN ('src0','src5','src10','src15') THEN 'manual' ELSE 'public' END"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: A text's lines and words in SQL; the test tables have no other white space than spaces and line feeds.
def lines_sql(c: str = "text") -> str:
    return f"(CASE WHEN {c} = '' OR right({c}, 1) = chr(10) THEN string_split({c}, chr(10))[1:len(string_split({c}, chr(10))) - 1] ELSE string_split({c}, chr(10)) END)"


def words_sql(c: str = "text") -> str:
    return f"list_filter(string_split_regex({c}, '\\s+'), lambda ww: ww <> '')"


def strip_sql(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
