"""Contiguous shards of near-equal bytes, by global prefix sums from per-partition totals.

DataFrame operations only. Cost at scale: the text is read once for its length and CRC; what is
ordered and summed is four numbers a row, spread by range over all tasks. Only one row a partition
and one row a shard are summed up in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, in_order


def byte_shards(
    docs: DataFrame, shards: int = 24, overhead: int = 8, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Rows in order of doc_id, cut where the bytes before them pass equal shares of the total.

    Returns doc_id, size (UTF-8 bytes and overhead; a null text has none), text_crc32 (null text:
    that of no bytes), law 'bytes', shard, slot (place in the shard, from 0) and grown_shard (null:
    more shards move rows everywhere). The middle byte of a row decides its shard, so a shard's
    size differs from its share by at most a row. Null ids come first; rows with the same id are
    ordered by text CRC and size; equal rows are interchangeable. A shard that a longer row spans
    is empty. An empty table gives no rows; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = cut(
        docs.select(
            F.col(id_col).cast("bigint").alias("doc_id"),
            (F.octet_length(text).cast("bigint") + overhead).alias("size"),
            F.crc32(text).alias("text_crc32"),
        )
    )
    middle = F.expr(f"(2 * size_before + size) * {shards} div (2 * size_total)")
    ordered = in_order(sized, ["doc_id", "text_crc32", "size"], ("size",))
    dealt = cut(
        ordered.select("doc_id", "size", "text_crc32", F.least(middle, F.lit(shards - 1)).cast("int").alias("shard"), "row")
    )
    firsts = dealt.groupBy("shard").agg(F.min("row").alias("first_row"))
    return dealt.join(F.broadcast(firsts), "shard").select(  # one row a shard
        "doc_id", "size", "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("row") - F.col("first_row")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
