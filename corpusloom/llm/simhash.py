"""SimHash fingerprints, their links within a few bits found by pigeonring filtering, and groups.

Cost at scale: texts are read once and never shuffled; what moves is 16 bytes a document and, a
distinct fingerprint, one row for each ring position. Buckets of up to `bucket_limit` fingerprints
are compared pair by pair after the chain filter; fuller ones are linked exactly by masked keys, in
rows proportional to the bucket, so no bucket is capped or quadratic.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, least_row, ship_code, signed, with_keys
from .components import connected_components

BITS = 64
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
BLOCK = 1 << 15  # shingles hashed at once
ROWS = 256  # texts decoded at once


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The unsigned 64-bit SimHash of a text's word shingles, repeats included; 0 without words.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased. A text of fewer words
    than a shingle is one shingle. A bit is set if more than half of the shingles' XXH64 (seed 42)
    have it.
    """
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    ends = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, n, BLOCK):
        pairs = zip(starts[at : min(n, at + BLOCK)].tolist(), ends[at : at + BLOCK].tolist(), strict=False)
        hashes = np.array([digest(joined[s:e], 42) for s, e in pairs], dtype=">u8")
        ones += np.unpackbits(hashes.view(np.uint8)).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _fingerprint_batches(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            prints = [signed(fingerprint(t, shingle)) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(prints, pa.int64())], ["row", "fp"])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the SimHash of every row's whole text as a signed 64-bit integer."""
    ship_code(docs.sparkSession)
    kept = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    found = kept.mapInArrow(lambda batches: _fingerprint_batches(batches, shingle), "row bigint, fp bigint")
    return found.withColumnRenamed("row", "doc_id")


def ring(segments: int, max_diff: int) -> tuple[list[int], list[int]]:
    """Masks of the segments, and how many differences a chain of 1, 2, ... segments may have.

    If two fingerprints differ in at most max_diff bits, then on the ring of segments there is a
    start from which every chain of l segments differs in at most max_diff * l / segments bits.
    """
    edges = [round(i * BITS / segments) for i in range(segments + 1)]
    masks = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:], strict=False)]
    return masks, [max_diff * (n + 1) // segments for n in range(segments)]


def _bits(xor: Column, mask: int) -> Column:
    return F.bit_count(xor.bitwiseAND(F.lit(signed(mask))))


def similar_fingerprints(
    prints: DataFrame, max_diff: int = 2, segments: int = 5, bucket_limit: int = 1024
) -> DataFrame:
    """Distinct fp -> edges (a, b) whose components are those of all pairs within max_diff bits.

    Buckets of at most bucket_limit fingerprints give every pair within max_diff. In fuller ones
    each fingerprint is linked to the least of those that equal it outside some max_diff bits: all
    of these are within max_diff, and every such pair shares such a star. Prints must be distinct.
    """
    if max_diff <= 0:
        return prints.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where(F.lit(False))
    segments = max(segments, max_diff + 1)
    masks, budget = ring(segments, max_diff)
    exact = sum(b == 0 for b in budget)  # the chain that has to be equal, and so can be a join key
    chains = [sum(masks[(start + k) % segments] for k in range(exact)) for start in range(segments)]

    keys = F.array(*[F.col("fp").bitwiseAND(F.lit(signed(chain))) for chain in chains])
    rows = prints.select("fp", F.posexplode(keys).alias("start", "key"))
    sizes = rows.groupBy("start", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = cut(rows.join(sizes, ["start", "key"]))

    few = rows.where(F.col("n") <= bucket_limit)
    left = few.select("start", "key", F.col("fp").alias("a"))
    right = few.select("start", "key", F.col("fp").alias("b"))
    xor = F.col("a").bitwiseXOR(F.col("b"))
    viable = F.lit(False)
    for start in range(segments):
        holds, passed = F.col("start") == start, 0
        for length in range(segments):
            passed |= masks[(start + length) % segments]
            if length >= exact:
                holds &= _bits(xor, passed) <= budget[length]
        viable |= holds
    pairs = (
        left.join(right, ["start", "key"])
        .where((F.col("a") < F.col("b")) & viable)
        .where(F.bit_count(xor) <= max_diff)
        .select("a", "b")
    )

    many = rows.where(F.col("n") > bucket_limit)
    open_masks = []
    for chain in chains:
        free = [1 << bit for bit in range(BITS) if not chain >> bit & 1]
        open_masks.append(F.array(*[F.lit(signed(sum(c))) for c in combinations(free, max_diff)]))
    masked = many.select(
        "fp", "start", F.explode(F.element_at(F.array(*open_masks), F.col("start") + 1)).alias("mask")
    ).withColumn("rest", F.col("fp").bitwiseAND(F.bitwise_not("mask")))
    hubs = masked.groupBy("start", "mask", "rest").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("m"))
    stars = (
        masked.join(hubs.where("m > 1"), ["start", "mask", "rest"])
        .where("fp <> a")
        .select("a", F.col("fp").alias("b"))
    )
    return pairs.unionByName(stars)


def group_rows(prints: DataFrame, max_diff: int = 2, segments: int = 5, bucket_limit: int = 1024) -> DataFrame:
    """(row, fp) -> (row, fp, least): the least `row`, an orderable value, of its group."""
    prints = cut(prints)
    classes = prints.groupBy("fp").agg(F.min("row").alias("first_row"))
    edges = similar_fingerprints(classes.select("fp"), max_diff, segments, bucket_limit)
    roots = connected_components(edges)
    rooted = cut(
        classes.join(roots, classes["fp"] == roots["node"], "left").select(
            "fp", "first_row", F.coalesce("root", "fp").alias("root")
        )
    )
    firsts = rooted.groupBy("root").agg(F.min("first_row").alias("least"))
    labels = rooted.join(firsts, "root").select("fp", "least")
    return prints.join(labels, "fp").select("row", "fp", "least")


def near_duplicate_groups(
    docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """(doc_id, fp, component_id) for every row: its SimHash and the least doc_id of its group.

    Texts whose fingerprints differ in at most max_diff bits are linked; a group is what links
    connect. A null text counts as empty; texts without words have fingerprint 0 and are linked
    like any other. Repeated rows stay and share their group; a null doc_id is kept, and is the
    group's id only if the group has no other. An empty table gives no rows; other columns are
    ignored. Options are those of similar_fingerprints().
    """
    prints = fingerprints(docs, shingle, id_col, text_col).withColumnRenamed("doc_id", "row")
    return group_rows(prints, **options).select(F.col("row").alias("doc_id"), "fp", F.col("least").alias("component_id"))


def keep_one_of_each_group(docs: DataFrame, shingle: int = 3, **options) -> DataFrame:
    """The rows of docs, all columns, without near-duplicates: of each group the row of the least doc_id stays.

    Null ids come last; of rows with the same doc_id the one of the least digest of its text stays,
    of equal ones any.
    """
    ship_code(docs.sparkSession)
    kept = docs.select(F.struct(*least_row(docs)).alias("row"), F.col("text").cast("string").alias("text"))
    schema = kept.select("row", F.lit(0).cast("bigint").alias("fp")).schema
    prints = kept.mapInArrow(lambda batches: _fingerprint_batches(batches, shingle), schema)
    groups = group_rows(prints, **options)
    return with_keys(docs, groups.where(F.col("row") == F.col("least")).select("row.key").distinct(), "left_semi", once=True)
