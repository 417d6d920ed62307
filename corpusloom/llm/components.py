"""Connected components of an edge list, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_small, ship_code


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the least node of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link every smaller neighbour of a node, and the node, to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("low"))
    joined = edges.join(least, "a")
    moved = joined.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.unionByName(least.select("a", F.col("low").alias("b"))).distinct()


def _contracted_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) of a part -> (node, least node it reaches by them), without the least nodes."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := root.setdefault(top, top)) != top:
            top = up
        while x != top:
            root[x], x = top, root[x]
        return top

    for batch in batches:
        for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    found = [(x, top) for x in root if (top := find(x)) != x]
    for at in range(0, len(found), 1 << 16):
        a, b = zip(*found[at : at + (1 << 16)], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _state(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """Edges written and read again; their number and the sum of their hashes, which tells a changed edge set from a repeated one."""
    edges, found = cut_small(edges, total=F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    return edges, (found["n"], found["total"])


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) pairs of orderable ids -> (node, root), root being the least id that node reaches.

    Nodes without an edge to another node have no row. Nulls and self loops are ignored, repeated
    and reversed edges count once, an empty input gives an empty result. Edges of bigint are first
    contracted to stars within each part, so that few edges, in one part, need one round; rounds go
    on until one changes nothing. Each round is written to the shared checkpoint folder; nothing is
    gathered on the driver but two numbers a round. The grouped minima are combined before the
    shuffle and the joins are plain equi-joins that adaptive execution splits where a node has very
    many edges.
    """
    edges, seen = _state(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    if {kind for _, kind in edges.dtypes} == {"bigint"}:
        ship_code(edges.sparkSession)
        edges, seen = _state(edges.mapInArrow(_contracted_batches, "a bigint, b bigint").distinct())
    for _ in range(max_rounds):
        edges, now = _state(_small_star(_large_star(edges)))
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
