"""Order and running sums over whole tables without a task that holds them all."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, and where it is unset one of our own.

    A folder of our own is on this machine, so it is only taken where all executors are: on a local master.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from the files."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def in_order(df: DataFrame, order: list[str], sums: tuple[str, ...] = ()) -> DataFrame:
    """df with `row`, its place from 0 in the order, and for each column c of sums `c_before` and `c_total`.

    Rows are dealt by range and numbered and summed within their part; the parts' totals, a row a
    part, are summed up in one place. Rows alike in `order` are spread over parts by a last key and
    ordered at will. The result is of files, so that all that reads it sees the same order.
    """
    keys = [*order, "__tie"]
    placed = cut(
        df.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*keys).withColumn("__part", F.spark_partition_id())
    )
    totals = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__rows"), *[F.sum(c).alias(f"__{c}") for c in sums])
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    offsets = totals.select(
        "__part",
        F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__rows"),
        *[F.coalesce(F.sum(f"__{c}").over(before), F.lit(0)).alias(f"__{c}") for c in sums],
        *[F.sum(f"__{c}").over(everything).alias(f"{c}_total") for c in sums],
    )
    within = Window.partitionBy("__part").orderBy(*keys)
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    ranked = placed.select(
        "*",
        (F.row_number().over(within) - 1).cast("bigint").alias("row"),
        *[(F.sum(c).over(upto) - F.col(c)).alias(f"{c}_before") for c in sums],
    )
    joined = ranked.join(offsets, "__part").withColumn("row", F.col("row") + F.col("__rows"))
    for c in sums:
        joined = joined.withColumn(f"{c}_before", F.col(f"{c}_before") + F.col(f"__{c}"))
    return joined.drop("__part", "__tie", "__rows", *[f"__{c}" for c in sums])


def in_order_by_group(df: DataFrame, group: str, order: list[str], sums: tuple[str, ...] = ()) -> DataFrame:
    """As in_order, with row and sums counted from the beginning of each group; groups must be few."""
    whole = in_order(df, [group, *order], sums)
    firsts = whole.groupBy(group).agg(F.min("row").alias("__row"), *[F.min(f"{c}_before").alias(f"__{c}") for c in sums])
    joined = whole.join(firsts, group).withColumn("row", F.col("row") - F.col("__row"))
    for c in sums:
        joined = joined.withColumn(f"{c}_before", F.col(f"{c}_before") - F.col(f"__{c}")).drop(f"{c}_total")
    return joined.drop("__row", *[f"__{c}" for c in sums])
