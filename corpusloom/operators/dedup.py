"""Exact and near duplicate removal, greedy in input order: only rows that stay are compared to.

Groups of copies are found by grouped minima that combine before the shuffle; band collisions by
grouped minima per band, never by pairs. Each round of the greedy selection is linear in band rows
and is written to the checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import char_ngrams, word_shingles, words
from corpusloom.operators.ordering import cut

PRIME = 2147483647


def first_occurrences(df: DataFrame, text: Column, order: str) -> DataFrame:
    """Of rows with the same text, the one that comes first; order must tell rows apart."""
    firsts = df.groupBy(F.md5(text.cast("binary")).alias("__digest")).agg(F.min(order).alias(order)).select(order)
    return df.join(firsts, order, "left_semi")


def dedup_counters(df: DataFrame, text: Column) -> DataFrame:
    """Rows read, kept and skipped, and the share skipped in percent, 0 for no rows."""
    groups = df.groupBy(F.md5(text.cast("binary"))).agg(F.count(F.lit(1)).alias("n"))
    total, kept = F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))
    return groups.agg(
        total.alias("n_read"), kept.alias("n_kept"), (total - kept).alias("n_skipped"),
        F.when(total > 0, (total - kept) * 100.0 / total).otherwise(0.0).alias("duplicate_pct"),
    )


def permutation(i: int) -> tuple[int, int]:
    """The i-th hash of the family x -> (a * x + b) mod the prime."""
    return (i * 40503 + 12345) % 65521 * 9 + 1, (i * 2654435761 + 97) % PRIME


def shingle_hash(shingle: Column) -> Column:
    return F.conv(F.substring(F.md5(shingle.cast("binary")), 1, 7), 16, 10).cast("bigint")


def minhash(df: DataFrame, key: str, shingles: Column, perms: int = 64) -> DataFrame:
    """(key, s0, s1, ...): the least value of each permutation over a row's shingles."""
    hashes = df.select(key, F.explode(F.array_distinct(shingles)).alias("g")).select(key, shingle_hash(F.col("g")).alias("h"))
    least = [F.min((F.col("h") * F.lit(a) + F.lit(b)) % F.lit(PRIME)).alias(f"s{i}") for i, (a, b) in enumerate(map(permutation, range(perms)))]
    return hashes.groupBy(key).agg(*least)


def signatures(df: DataFrame, key: str, shingles: Column, perms: int = 64) -> DataFrame:
    return minhash(df, key, shingles, perms).select(key, F.array(*[f"s{i}" for i in range(perms)]).alias("signature"))


def bands(signed: DataFrame, key: str, n_bands: int = 8, rows: int = 8) -> DataFrame:
    """(key, band_id, band_hash): a row a band, the digest of its values."""
    digest = lambda b: F.md5(F.array_join(F.slice("signature", b * rows + 1, rows), ",").cast("binary"))
    return signed.select(key, F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(n_bands - 1)), digest)).alias("band_id", "band_hash"))


def word_bands(df: DataFrame, key: str, text: Column, n: int = 3, perms: int = 64, n_bands: int = 8, rows: int = 8) -> DataFrame:
    return bands(signatures(df, key, word_shingles(words(text), n), perms), key, n_bands, rows)


def char_bands(df: DataFrame, key: str, text: Column, n: int = 3, perms: int = 128, n_bands: int = 9, rows: int = 13) -> DataFrame:
    """Bands of character n-grams without spaces; 9 bands of 13 are the best cut at 0.8 for 128 values."""
    return bands(signatures(df, key, char_ngrams(text, n), perms), key, n_bands, rows)


def greedy_verdicts(band_rows: DataFrame, key: str, kept_bands: DataFrame | None = None) -> DataFrame:
    """(key, verdict, dup_of): keep a row unless an earlier kept row shares a band with it.

    The lexicographically first maximal independent set of the collision graph: a row is dropped if
    a smaller kept row shares a band, kept if no smaller undecided row does. kept_bands are rows of
    bands (band_id, band_hash, kept_key) kept before; they come before all others. A round decides
    the least open row at least, so the rounds end, however long a chain of collisions is; rows that
    nothing can decide, those of null keys or bands, are an error.
    """
    rows = band_rows
    if kept_bands is not None:
        before = kept_bands.groupBy("band_id", "band_hash").agg(F.min("kept_key").alias("old"))
        rows = rows.join(before, ["band_id", "band_hash"], "left")
    else:
        rows = rows.withColumn("old", F.lit(None).cast(dict(band_rows.dtypes)[key]))
    state = cut(rows.withColumn("state", F.when(F.col("old").isNotNull(), "drop")))
    # A row with any old band is dropped as a whole.
    state = cut(_spread(state, key))
    left = state.where("state IS NULL").count()
    while left:
        least = state.groupBy("band_id", "band_hash").agg(
            F.min(F.when(F.col("state") == "keep", F.col(key))).alias("low_kept"),
            F.min(F.when(F.col("state").isNull(), F.col(key))).alias("low_open"),
        )
        seen = state.join(least, ["band_id", "band_hash"])
        decided = seen.where("state IS NULL").groupBy(key).agg(
            F.max(F.col("low_kept") < F.col(key)).alias("hit"), F.min(F.col("low_open") == F.col(key)).alias("first")
        )
        new = decided.select(key, F.when(F.col("hit"), "drop").when(F.col("first"), "keep").alias("now"))
        state = cut(state.join(new, key, "left").withColumn("state", F.coalesce("state", "now")).drop("now"))
        before, left = left, state.where("state IS NULL").count()
        if left == before:
            raise ValueError(f"{left} rows of bands have a null key or band")
    kept = state.where("state = 'keep'").groupBy("band_id", "band_hash").agg(F.min(key).alias("low"))
    found = state.join(kept, ["band_id", "band_hash"], "left").groupBy(key).agg(
        F.max("state").alias("verdict"), F.coalesce(F.min("old"), F.min(F.when(F.col("low") < F.col(key), F.col("low")))).alias("dup_of")
    )
    return found.withColumn("dup_of", F.when(F.col("verdict") == "drop", F.col("dup_of")))


def _spread(rows: DataFrame, key: str) -> DataFrame:
    dropped = rows.where("state = 'drop'").select(key).distinct().withColumn("hit", F.lit(True))
    return rows.join(dropped, key, "left").withColumn("state", F.when(F.col("hit"), "drop")).drop("hit")


def near_dedup(df: DataFrame, order: str, text: str, make_bands=word_bands, kept_bands: DataFrame | None = None, kept_digests: DataFrame | None = None) -> DataFrame:
    """(order, verdict, dup_of) of every row: kept, exact or near.

    Equal texts are one in the selection. A copy is exact if the first of its text is kept, near if
    that one was dropped, since only what is kept is remembered. kept_digests (digest) and
    kept_bands are of earlier runs.
    """
    rows = df.select(order, text, F.md5(F.col(text).cast("binary")).alias("digest"))
    first = rows.groupBy("digest").agg(F.min(order).alias("first"))
    if kept_digests is not None:
        old = kept_digests.select("digest").distinct().withColumn("old_exact", F.lit(True))
        first = first.join(old, "digest", "left")
    else:
        first = first.withColumn("old_exact", F.lit(None).cast("boolean"))
    first = cut(first)
    fresh = df.join(first.where("old_exact IS NULL").select(F.col("first").alias(order)), order, "left_semi")
    verdicts = greedy_verdicts(make_bands(fresh, order, F.col(text)), order, kept_bands).withColumnRenamed(order, "first")
    known = first.join(verdicts, "first", "left")
    joined = rows.select(order, "digest").join(known, "digest")
    is_first = F.col(order) == F.col("first")
    verdict = (
        F.when(F.col("old_exact"), "exact").when(F.col("verdict") == "drop", "near").when(is_first, "kept").otherwise("exact")
    )
    dup_of = F.when(F.col("verdict") == "drop", F.col("dup_of")).when(~is_first, F.col("first"))
    return joined.select(order, verdict.alias("verdict"), F.when(F.col("old_exact").isNull(), dup_of).alias("dup_of"))


def unseen(df: DataFrame, processed: DataFrame, key: str) -> DataFrame:
    """Each new key once: the distinct rows whose key is not in processed."""
    return df.dropDuplicates([key]).join(processed.select(key).distinct(), key, "left_anti")


def leaked(train: DataFrame, held_out: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct keys that both have; empty if the sets are disjoint."""
    return train.select(*keys).intersect(held_out.select(*keys))
