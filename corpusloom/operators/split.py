"""Splits, samples, windows and running totals over ordered corpora."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import let
from corpusloom.operators.ordering import cut, in_order, in_order_by_group

#: Token targets of the training, validation and test sets.
TARGETS = {"train_manual": 98_000_000, "train_public": 392_000_000, "val": 5_000_000, "test": 5_000_000}


def quota_split(df: DataFrame, category: str, order: str, tokens: str, targets: dict[str, int] = TARGETS) -> DataFrame:
    """df with `split`, filled in input order: a row goes where the tokens before it are below target.

    Manual rows fill train and the rest is left out (null); public rows fill train, then val, then
    test. Each set is over its target by less than a row. The sums before a row are global prefix
    sums; where a set ends is one row a set.
    """
    ordered = in_order_by_group(df.where(F.col(category).isin("manual", "public")), category, [order], (tokens,))
    before, public = F.col(f"{tokens}_before"), F.col(category) == "public"

    def end(start: int, target: int) -> int:
        """Tokens before the first public row after a set that begins at `start`."""
        row = ordered.where(public & (before >= start + target)).agg(F.min(before)).first()[0]
        return math.inf if row is None else row

    train = end(0, targets["train_public"])
    val = end(train, targets["val"]) if train < math.inf else math.inf
    test = end(val, targets["test"]) if val < math.inf else math.inf
    bound = lambda x: F.lit(True) if x == math.inf else before < x
    split = (
        F.when(~public, F.when(before < targets["train_manual"], "train"))
        .when(bound(train), "train")
        .when(bound(val), "val")
        .when(bound(test), "test")
    )
    return ordered.withColumn("split", split).drop("row", f"{tokens}_before")


def head_half(df: DataFrame, order: str) -> DataFrame:
    """The first half, rounded down, of the rows in order."""
    n = df.count()
    return in_order(df, [order]).where(F.col("row") < n // 2).drop("row")


def nested_subsets(df: DataFrame, key: str, sizes: list[int], seed: int = 42) -> DataFrame:
    """(size, key) of prefixes of one seeded shuffle, so that smaller sets are in larger ones."""
    top = df.select(key).withColumn("shuffle", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")))
    first = top.orderBy("shuffle", key).limit(max(sizes))
    ranked = first.withColumn("rank", F.row_number().over(Window.orderBy("shuffle", key)))  # the largest size at most
    return ranked.select(F.explode(F.array(*map(F.lit, sizes))).alias("size"), key, "rank").where("rank <= size").drop("rank")


def stratified(df: DataFrame, stratum: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows of each stratum by a seeded hash of key."""
    ranked = df.withColumn(
        "__r", F.row_number().over(Window.partitionBy(stratum).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), key))
    )
    return ranked.where(F.col("__r") <= n).drop("__r")


def round_robin(df: DataFrame, stratum: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """`turn` and the rows of n turns that go round the strata in order of name, over and over.

    Each stratum gives its rows in the order of a seeded hash and begins anew at its end. Strata are
    few; a turn is a row, so what is repeated is what the n turns ask for.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))
    placed = in_order_by_group(df.withColumn("__h", digest), stratum, ["__h", key]).drop("__h").withColumnRenamed("row", "__row")
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("__size"))
    everything = Window.partitionBy(F.lit(0))
    strata = sizes.select(stratum, "__size", F.row_number().over(everything.orderBy(stratum)).alias("__no"), F.count(F.lit(1)).over(everything).alias("__strata"))
    turns = df.sparkSession.range(n).select(F.col("id").alias("turn"))
    wanted = turns.join(F.broadcast(strata), F.col("turn") % F.col("__strata") == F.col("__no") - 1)
    wanted = wanted.withColumn("__row", F.floor(F.col("turn") / F.col("__strata")) % F.col("__size"))
    return wanted.join(placed, [stratum, "__row"]).select("turn", *df.columns)


def training_windows(tokens: Column, length: int) -> Column:
    """Every (start, x, y): length tokens from each start and the same shifted by one; none if there are too few. All in one row: see window_rows for long texts."""
    def cut_up(a: Column) -> Column:
        n = F.size(a) - length
        pair = lambda i: F.struct((i - 1).alias("start"), F.slice(a, i, length).alias("x"), F.slice(a, i + 1, length).alias("y"))
        return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), pair))

    return let(tokens, cut_up)


def window_rows(df: DataFrame, keys: list[str], tokens: Column, length: int) -> DataFrame:
    """(keys, start, x, y): the windows of training_windows(), a row each.

    A window is cut as its row leaves: a text's tokens are held once, not `length` times.
    """
    n = F.size("__tokens") - length
    starts = F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1))))
    placed = df.select(*keys, tokens.alias("__tokens")).select("*", F.explode(starts).alias("__at"))
    piece = lambda shift: F.slice("__tokens", F.col("__at") + shift, length)
    return placed.select(*keys, (F.col("__at") - 1).alias("start"), piece(0).alias("x"), piece(1).alias("y"))


def positions(n_tokens: Column, context: int) -> Column:
    return F.greatest(n_tokens - context, F.lit(0))


def epoch_order(df: DataFrame, shard: str, position: str, epoch: int, batch: int, seed: int = 42, skip: int = 0) -> DataFrame:
    """Rows with `batch_no`: shards in one seeded order, positions within each in another; an incomplete last batch and the first `skip` batches are left out."""
    key = lambda c, s: F.md5(F.concat_ws(":", F.lit(str(s)), F.lit(str(epoch)), c.cast("string")).cast("binary"))
    keyed = df.withColumn("__s", key(F.col(shard), seed)).withColumn("__p", key(F.concat_ws("/", F.col(shard), F.col(position)), seed + 1))
    full = df.count() // batch
    ordered = in_order(keyed, ["__s", "__p"]).withColumn("batch_no", F.floor(F.col("row") / batch))
    return ordered.where((F.col("batch_no") >= skip) & (F.col("batch_no") < full)).drop("__s", "__p", "row")


def cyclic_batches(df: DataFrame, order: str, batch: int, steps: int) -> DataFrame:
    """(step, slot, row's columns): batches in order that begin anew at the end."""
    n = df.count()
    wanted = df.sparkSession.range(steps * batch).select(F.floor(F.col("id") / batch).alias("step"), (F.col("id") % batch).alias("slot"), (F.col("id") % max(1, n)).alias("row"))
    return wanted.join(in_order(df, [order]), "row").drop("row")


def fold_with_reset(df: DataFrame, order: str, size: str, limit: int, out: str = "file_index", check_every: int = 1) -> DataFrame:
    """df with the index of the file each row goes to: a new one begins once `limit` is reached.

    Rows are taken in batches of check_every; the sum is looked at after a whole batch. Where a file
    ends depends on all before it, so the batches' totals, three numbers each, pass in order through
    one task, which keeps a sum and nothing else; rows themselves stay where they are.
    """
    ordered = in_order(df, [order]).withColumn("__batch", F.floor(F.col("row") / check_every))
    totals = ordered.groupBy("__batch").agg(F.sum(size).alias("n"), F.count(F.lit(1)).alias("rows"))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = total = 0
        for part in batches:
            found = []
            for n, rows in zip(part["n"], part["rows"], strict=True):
                found.append(index)
                total += n
                if total >= limit and rows == check_every:
                    index, total = index + 1, 0
            yield pd.DataFrame({"__batch": part["__batch"], out: found})

    in_turn = totals.repartition(1).sortWithinPartitions("__batch")
    return ordered.join(in_turn.mapInPandas(fold, f"__batch bigint, {out} int"), "__batch").drop("__batch", "row")


def min_max(c: Column, over) -> Column:
    """Scaled to 0..1 over the window; 0 if all are alike."""
    low, high = F.min(c).over(over), F.max(c).over(over)
    return F.when(high > low, (c - low) / (high - low)).otherwise(0.0)


def select_model(runs: DataFrame, key: str, weights: dict[str, float]) -> DataFrame:
    """runs with `score`, the weighted scaled metrics to six places, and whether it is the selected, least one; of equals the least key."""
    everything = Window.partitionBy(F.lit(0))
    score = sum((F.lit(w) * min_max(F.col(c), everything) for c, w in weights.items()), F.lit(0.0))
    scored = runs.withColumn("score", F.round(score, 6))
    return scored.withColumn("selected", F.col(key) == F.min_by(key, F.struct("score", key)).over(everything))


def best_so_far(log: DataFrame, step: str, loss: str) -> DataFrame:
    """log with `is_best`: whether a loss is below all of earlier steps; a null loss is not, the first is."""
    placed = cut(log.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(step, "__tie").withColumn("__part", F.spark_partition_id()))
    lows = placed.groupBy("__part").agg(F.min(loss).alias("__low"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    lows = lows.select("__part", F.min("__low").over(before(Window.orderBy("__part"))).alias("__low"))  # a row a part
    within = F.min(loss).over(before(Window.partitionBy("__part").orderBy(step, "__tie")))
    low = F.least(F.col("__within"), F.col("__low"))
    return placed.withColumn("__within", within).join(F.broadcast(lows), "__part").withColumn("is_best", low.isNull() | (F.col(loss) < low)).drop("__tie", "__part", "__low", "__within")


def learning_rate(step: Column, warmup: int, steps: int, top: float, floor: float) -> Column:
    """Linear from 0 to top, then half a cosine down to floor."""
    progress = (step - warmup) / max(steps - warmup, 1)
    return (
        F.when(step < warmup, step * top / max(warmup, 1))
        .when(step >= steps, F.lit(floor))
        .otherwise(floor + 0.5 * (1 + F.cos(math.pi * progress)) * (top - floor))
    )


def latest_checkpoint(df: DataFrame, path: str) -> DataFrame:
    step = F.regexp_extract(path, r"(\d+)\.[^./]*$", 1)
    return df.where(step != "").agg(F.max_by(path, F.struct(step.cast("bigint"), F.col(path))).alias(path), F.max(step.cast("bigint")).alias("step"))


def trim_loop(tokens: Column, n: int = 4) -> Column:
    """Without the last n tokens if they repeat the n before them."""
    long_enough = F.size(tokens) >= 2 * n
    repeats = F.slice(tokens, -n, n) == F.slice(tokens, -2 * n, n)
    return F.when(long_enough, F.when(repeats, F.slice(tokens, 1, F.size(tokens) - n)).otherwise(tokens)).otherwise(tokens)
