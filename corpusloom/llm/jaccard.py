"""Groups of documents that share most word shingles: SimHash candidates, pigeonring filtering, exact Jaccard similarities.

64 SimHash bits can't be a join key for these pairs: at a five-word similarity of 0.8 they differ in
up to 17 bits. So SimHash's sums are taken in 1024 dimensions, by feature hashing and many random
rotations, and a text's keys are its strongest bits: of each GROUP of sums the place and sign of the
largest. Two texts of similarity 0.8 have a key (two groups) in common with a chance of 0.142, so
they share none of BANDS keys with a chance of 5e-8. Within a bucket, texts stay that differ from
another one of it in at most radius() of PRINT SimHash bits.

What is left is pruned by exact bounds. A text's second fingerprint has 1024 bits, each the parity of
the number of its shingles that hash there. Two of these differ in at most as many bits as shingles
are in one text only, and at a similarity s these are at most (1 - s) / (1 + s) of both texts'
shingles: a budget that depends on the texts' sizes, and that no pair over s exceeds. The pigeonring
principle holds as for SimHash: on the ring of 16 segments there is a start from which every chain
of l segments differs in at most l / 16 of the budget. Chains prune candidates, then the full
Hamming distance does, then the exact similarity decides.

Cost at scale: texts are read twice and never shuffled; what moves is 28 bytes a document and key,
packed by part, a row a document and key that it shares with a text near by, and, of documents that
have any, their shingles' hashes, once. Each set is first held against one hub, the most popular
member of its buckets. After that only pairs of a bucket's members in different groups are looked
at: those outside the bucket's largest group against the others, in slots of bounded size; of these
each set is verified against its nearest in each other group first, and against the rest only if the
groups are still apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import acos, ceil, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, cut_small, least_row, ship_code, signed, with_keys
from .components import connected_components
from .simhash import LOWER
from .wordhash import mix

SIDE = 32  # a text's SimHash sums have SIDE * SIDE dimensions
GROUP = 256  # sums that the strongest is taken of; two of these are a key
BANDS = 110  # keys a text
PRINT = 128  # SimHash bits that are compared within a bucket
SEGMENTS = 16  # of 64 bits, that a fingerprint has
SMALL = 100_000  # sets whose ids, roots or sums may be broadcast
WIDE, WIDEST = 10_000, 2_000  # rows a part that small tables of fingerprints, and of shingles, are read in
TEXTS = 256  # worked on at once
PACKED = 1 << 20  # keys that a task packs at once, and that a part has in expectation
BUCKET = 1024  # sets up to which a bucket's are compared with each other for near ones; of more all stay
SLOT = 2048  # members of a bucket that are held against the same others in one task, in expectation

DIM = SIDE * SIDE
GROUP_BITS = GROUP.bit_length()  # a place in it and a sign
KEY = np.dtype([("key", "<u4"), ("set", "<i8"), ("low", "<u8"), ("high", "<u8")])


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; words and short texts are as in fingerprint()."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    size = min(shingle, len(words))
    out = np.zeros(len(words) - size + 1 if words else 0, np.uint64)
    for k in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + len(out)]
    return np.unique(mix(out + np.uint64(size)))


@cache
def _rotations() -> tuple[np.ndarray, np.ndarray]:
    """Random signs of each rotation, the last two the first one's of all and the fingerprint's, and the Hadamard matrix of SIDE."""
    hadamard = np.ones((1, 1), np.float32)
    while len(hadamard) < SIDE:
        hadamard = np.block([[hadamard, hadamard], [hadamard, -hadamard]])
    rounds = ceil(2 * BANDS * GROUP / DIM)
    return np.random.default_rng(20240602).choice(np.array([-1, 1], np.float32), (rounds + 2, DIM)), hadamard


def _rotate(sums: np.ndarray, signs: np.ndarray, hadamard: np.ndarray) -> np.ndarray:
    half = ((sums * signs).reshape(-1, SIDE) @ hadamard).reshape(-1, SIDE, SIDE)
    return (np.ascontiguousarray(half.swapaxes(1, 2)).reshape(-1, SIDE) @ hadamard).reshape(-1, DIM)


def simhash_keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of each set of shingles its BANDS keys, from its strongest SimHash bits, and PRINT SimHash bits in words of 64."""
    signs, hadamard = _rotations()
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    hashes = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    place = (hashes >> np.uint64(40)).astype(np.int64) & (DIM - 1)
    sums = np.bincount(row * DIM + place, 1.0 - 2.0 * (hashes >> np.uint64(63)), len(sets) * DIM)
    # Without this rotation before each of the others, sums of few shingles have ties that depend on each other.
    sums = _rotate(sums.astype(np.float32).reshape(-1, DIM), signs[-2], hadamard) / np.float32(SIDE)
    bits = []
    for k in range(len(signs) - 2):
        turned = _rotate(sums, signs[k], hadamard).reshape(-1, GROUP)
        strongest = np.abs(turned).argmax(axis=1)
        plus = turned[np.arange(len(turned)), strongest] > 0
        bits.append((strongest << 1 | plus).reshape(len(sets), -1))
    bits = np.concatenate(bits, axis=1)[:, : 2 * BANDS].astype(np.uint32)
    band = np.arange(BANDS, dtype=np.uint32) << np.uint32(2 * GROUP_BITS)
    keys = band | bits[:, ::2] << np.uint32(GROUP_BITS) | bits[:, 1::2]
    return keys, np.packbits(_rotate(sums, signs[-1], hadamard)[:, :PRINT] > 0, axis=1).view(np.uint64)


def radius(similarity: float) -> int:
    """How many of PRINT SimHash bits two sets of that similarity may differ in.

    By the angle between them, and six standard deviations.
    """
    share = acos(min(1.0, 2 * similarity / (1 + similarity))) / pi
    return ceil(PRINT * share + 6 * sqrt(PRINT * share * (1 - share)))


def set_id(shingles: np.ndarray) -> int:
    return signed(xxhash.xxh64_intdigest(shingles.tobytes()))


def parities(shingles: np.ndarray) -> np.ndarray:
    """The parity fingerprint of a set, in words of 64 bits."""
    odd = np.bincount((shingles >> np.uint64(20)).astype(np.int64) & (64 * SEGMENTS - 1), minlength=64 * SEGMENTS) & 1
    return np.packbits(odd.astype(np.uint8)).view(">i8").astype(np.int64)


def _key_batches(batches: Iterator[pa.RecordBatch], shingle: int, least: int) -> Iterator[pa.RecordBatch]:
    """Sets of fewer shingles than `least` have no keys: none but their equals are similar to them."""
    names = ["row", "set", "n", "keys", "bits", "print"]
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS):
            part = batch.slice(at, TEXTS)
            sets = [shingle_set(t, shingle) for t in part.column(1).to_pylist()]
            keys, bits = simhash_keys(sets)
            columns = [
                pa.array([set_id(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([k.tobytes() if len(s) >= least else b"" for s, k in zip(sets, keys, strict=True)], pa.binary()),
                pa.array([b.tobytes() for b in bits], pa.binary()),
                pa.array([parities(s) for s in sets], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], names)


def _packed_batches(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """(set, keys, bits) of sets -> (part, entries): their keys by the part that each belongs to."""

    def packed(rows: list[np.ndarray]) -> pa.RecordBatch:
        entries = np.concatenate(rows)
        part = (mix(entries["key"].astype(np.uint64)) % np.uint64(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        entries, part = entries[order], part[order]
        first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        blobs = [x.tobytes() for x in np.split(entries, first[1:])]
        return pa.RecordBatch.from_arrays([pa.array(part[first], pa.int32()), pa.array(blobs, pa.binary())], ["part", "entries"])

    rows, n = [], 0
    for batch in batches:
        for ident, keys, bits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            entries = np.empty(len(keys) // 4, KEY)
            entries["key"], entries["set"] = np.frombuffer(keys, "<u4"), ident
            entries["low"], entries["high"] = np.frombuffer(bits, np.uint64)
            rows.append(entries)
            n += len(entries)
            if n >= PACKED:
                yield packed(rows)
                rows, n = [], 0
    if n:
        yield packed(rows)


def near_entries(entries: np.ndarray, most: int, limit: int = BUCKET) -> np.ndarray:
    """Of entries in order of key those that differ from another one of their key in at most `most` bits, and all of keys with more than `limit`."""
    keys = entries["key"]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(first, len(keys)))
    near, size = np.repeat(sizes > limit, sizes), np.repeat(sizes, sizes)
    end = np.repeat(first + sizes, sizes)
    at = np.flatnonzero((size > 1) & (size <= limit))
    for ahead in range(1, limit):
        at = at[at + ahead < end[at]]
        if not len(at):
            break
        other = at + ahead
        distance = sum(np.bitwise_count(entries[c][at] ^ entries[c][other]).astype(np.int16) for c in ("low", "high"))
        close = distance <= most
        near[at[close]] = near[other[close]] = True
    return entries[near]


def _bucket_batches(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The entries of a part that are near another one -> (key, set, m), m being how many of the key these are."""
    blobs = [b for batch in batches for b in batch.column(1).to_pylist()]
    entries = np.frombuffer(b"".join(blobs), KEY)
    del blobs
    entries = near_entries(entries[np.argsort(entries["key"], kind="stable")], most)
    _, which, m = np.unique(entries["key"], return_inverse=True, return_counts=True)
    columns = [pa.array(entries["key"].astype(np.int64)), pa.array(np.ascontiguousarray(entries["set"])), pa.array(m[which].astype(np.int64))]
    whole = pa.RecordBatch.from_arrays(columns, ["key", "set", "m"])
    for at in range(0, whole.num_rows, 1 << 16):
        yield whole.slice(at, 1 << 16)


def _set_batches(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            sets = [shingle_set(t, shingle) for t in batch.slice(at, 256).column(0).to_pylist()]
            columns = [pa.array([set_id(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["set", "shingles"])


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of sets whose Jaccard similarity is at least `similarity`."""
    left = sets.select(F.col("set").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("set").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return (
        pairs.join(left, "a").join(right, "b")
        .where(both >= similarity * (F.size("x") + F.size("y") - both) - 1e-9)
        .select("a", "b")
    )


def _likely(a: str, b: str, similarity: float) -> Column:
    """Whether sets a and b, columns of (n, w0, w1, ...), can be that similar: sizes, chains on the ring, Hamming distance."""
    n_a, n_b = F.col(f"{a}.n"), F.col(f"{b}.n")
    budget = F.floor((n_a + n_b) * ((1 - similarity) / (1 + similarity)) + 1e-9)
    bits = [F.bit_count(F.col(f"{a}.w{k}").bitwiseXOR(F.col(f"{b}.w{k}"))) for k in range(SEGMENTS)]
    # Chains of the ring's quarters: from some quarter on, one, two and three are within their shares.
    size = SEGMENTS // 4
    quarters = [sum(bits[size * q + 1 : size * (q + 1)], bits[size * q]) for q in range(4)]
    chains = F.lit(False)
    for start in range(4):
        passed, holds = None, None
        for length in range(1, 4):
            quarter = quarters[(start + length - 1) % 4]
            passed = quarter if passed is None else passed + quarter
            within = passed * 4 <= budget * length
            holds = within if holds is None else holds & within
        chains |= holds
    return (F.least(n_a, n_b) >= similarity * F.greatest(n_a, n_b) - 1e-9) & chains & (_distance(a, b) <= budget)


def _distance(a: str, b: str) -> Column:
    bits = [F.bit_count(F.col(f"{a}.w{k}").bitwiseXOR(F.col(f"{b}.w{k}"))) for k in range(SEGMENTS)]
    return sum(bits[1:], bits[0])


def _buckets(classes: DataFrame, n: int, similarity: float) -> tuple[DataFrame, DataFrame, int]:
    """(key, set, m, popular, hub) of every bucket of m > 1 sets near each other, popular being the sum of m over a set's buckets; their sets, and how many."""
    parts, most = max(32, ceil(n * BANDS / PACKED)), radius(similarity)
    packed = classes.select("set", "keys", "bits").mapInArrow(lambda batches: _packed_batches(batches, parts), "part int, entries binary")
    rows = packed.repartition(parts, "part").mapInArrow(lambda batches: _bucket_batches(batches, most), "key bigint, set bigint, m bigint")
    rows, _ = cut_small(rows)
    popular, found = cut_small(rows.groupBy("set").agg(F.sum("m").alias("popular")))
    rows = rows.join(_small(popular, found["n"]), "set")
    hubs = rows.groupBy("key").agg(F.max_by("set", F.struct("popular", "set")).alias("hub"), F.max("popular").alias("hub_popular"))
    return cut_small(rows.join(hubs, "key"))[0], popular.select("set"), found["n"]


def _small(df: DataFrame, n: int) -> DataFrame:
    """df, of at most n rows of two numbers, to be broadcast if these are few."""
    return F.broadcast(df) if n <= SMALL else df


def _open_pairs(rows: DataFrame, prints: DataFrame, roots: DataFrame, similarity: float) -> tuple[DataFrame, int]:
    """(a, b, root_a, root_b, distance) of members of a bucket that are in different groups and can be similar; their number."""
    rooted = rows.select("key", "m", "set").join(roots, rows["set"] == roots["node"], "left")
    rooted, _ = cut_small(rooted.select("key", "m", "set", F.coalesce("root", "set").alias("root")))
    bucket = ["key"]
    split = rooted.groupBy(*bucket).agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select(*bucket)
    rooted = rooted.join(split, bucket)
    counts = rooted.groupBy(*bucket, "root").agg(F.count(F.lit(1)).alias("size"))
    major = counts.groupBy(*bucket).agg(F.max(F.struct("size", "root")).alias("major")).select(*bucket, F.col("major.root").alias("major"))
    slots = F.ceil(F.col("m") / SLOT).cast("int")
    whole, _ = cut_small(rooted.join(major, bucket).join(prints, "set").withColumn("slots", slots), WIDE)
    right = whole.select(
        *bucket, F.pmod(F.xxhash64("set"), F.col("slots")).cast("int").alias("slot"),
        F.col("set").alias("b"), F.col("root").alias("root_b"), (F.col("root") == F.col("major")).alias("b_major"), F.col("print").alias("pb"),
    )
    left = whole.where("root <> major").select(
        *bucket, F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"), F.col("set").alias("a"), F.col("root").alias("root_a"), F.col("print").alias("pa")
    )
    apart = (F.col("root_a") != F.col("root_b")) & (F.col("b_major") | (F.col("a") < F.col("b")))
    pairs = left.join(right, [*bucket, "slot"]).where(apart).where(_likely("pa", "pb", similarity))
    pairs, found = cut_small(pairs.select("a", "b", "root_a", "root_b", _distance("pa", "pb").alias("distance")).distinct())
    return pairs, found["n"]


def near_copy_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id) for every row: the least doc_id of its group.

    Texts whose sets of word shingles have a Jaccard similarity of at least `similarity` are linked;
    a group is what links connect. Null texts are empty; texts without words are linked with each
    other, shorter texts than a shingle are one. Repeated rows stay; null ids are kept, and are a
    group's id only if it has no other. An empty table gives no rows; other columns are ignored.
    """
    groups = group_rows(docs.select(F.col("doc_id").cast("bigint").alias("row"), "text"), shingle, similarity)
    return groups.select(F.col("row").alias("doc_id"), F.col("least").alias("component_id"))


def group_rows(texts: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(row, text) -> (row, least): the least `row`, an orderable value, of its group, as in near_copy_groups()."""
    ship_code(texts.sparkSession)
    kind = texts.schema["row"].dataType.simpleString()
    schema = f"row {kind}, set bigint, n bigint, keys binary, bits binary, print array<bigint>"
    least = ceil(similarity / (1 - similarity) - 1e-9) if similarity < 1 else 1 << 62
    keyed = cut(texts.select("row", F.col("text").cast("string").alias("text")).mapInArrow(lambda batches: _key_batches(batches, shingle, least), schema))
    classes, found = cut_small(keyed.groupBy("set").agg(F.min("row").alias("first_row"), *[F.first(c).alias(c) for c in ("n", "keys", "bits", "print")]), WIDE)
    rows, shared, n = _buckets(classes, found["n"], similarity)
    few = _small(shared, n)
    sets = texts.select("text").mapInArrow(lambda batches: _set_batches(batches, shingle), "set bigint, shingles array<bigint>")
    sets, _ = cut_small(sets.join(few, "set", "left_semi").dropDuplicates(["set"]), WIDEST)
    words = [F.element_at("print", k + 1).alias(f"w{k}") for k in range(SEGMENTS)]
    prints, _ = cut_small(classes.join(few, "set", "left_semi").select("set", F.struct("n", *words).alias("print")), WIDE)

    # One hub a set, the most popular of its buckets': most copies of a text are linked by this.
    stars = rows.where("set <> hub").groupBy("set").agg(F.max(F.struct("hub_popular", "hub")).alias("h")).select(F.col("h.hub").alias("a"), F.col("set").alias("b"))
    stars = stars.join(prints.select(F.col("set").alias("a"), F.col("print").alias("pa")), "a").join(prints.select(F.col("set").alias("b"), F.col("print").alias("pb")), "b")
    edges, _ = cut_small(_similar(stars.where(_likely("pa", "pb", similarity)).select("a", "b"), sets, similarity))
    roots = _small(connected_components(edges), n)

    pairs, n_pairs = _open_pairs(rows, prints, roots, similarity)
    if n_pairs:
        nearest, _ = cut_small(pairs.groupBy("a", "root_b").agg(F.min_by("b", F.struct("distance", "b")).alias("b")).select("a", "b"))
        edges, _ = cut_small(edges.unionByName(_similar(nearest, sets, similarity)))
        roots = _small(connected_components(edges), n)
        side = [_small(roots.select(F.col("node").alias(x), F.col("root").alias(f"now_{x}")), n) for x in "ab"]
        left = pairs.join(side[0], "a", "left").join(side[1], "b", "left").where(F.coalesce("now_a", "a") != F.coalesce("now_b", "b")).select("a", "b")
        left, found = cut_small(left.join(nearest, ["a", "b"], "left_anti"))
        if found["n"]:
            more, found = cut_small(_similar(left, sets, similarity))
            if found["n"]:
                roots = _small(connected_components(edges.unionByName(more)), n)
    rooted, _ = cut_small(classes.join(roots, classes["set"] == roots["node"], "left").select("set", "first_row", F.coalesce("root", "set").alias("root")))
    firsts = rooted.groupBy("root").agg(F.min("first_row").alias("least"))
    labels = rooted.join(firsts, "root").select("set", "least")
    return keyed.select("row", "set").join(labels, "set").select("row", "least")


def keep_one_of_each_group(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns, without near copies: of each group the row of the least doc_id stays.

    Null ids come last; of rows with the same doc_id the one of the least digest of its text stays, of equal ones any.
    """
    groups = group_rows(docs.select(F.struct(*least_row(docs)).alias("row"), "text"), **options)
    return with_keys(docs, groups.where(F.col("row") == F.col("least")).select("row.key").distinct(), "left_semi", once=True)
