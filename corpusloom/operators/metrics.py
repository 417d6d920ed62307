"""Generation quality: repetition, diversity, BLEU, chrF and ROUGE-L from pooled n-gram counts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from corpusloom.functions.text import SPACE, let, strip, word_ngrams, words


def _grams(c: Column, n: int) -> Column:
    return F.transform(word_ngrams(words(c), n), lambda g: F.array_join(g, " "))


def repetition_rate(df: DataFrame, key: str, text: Column, n: int = 3) -> DataFrame:
    """Share of the n-grams of all texts that occur more than once in their text."""
    counts = df.select(key, F.explode(_grams(text, n)).alias("g")).groupBy(key, "g").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg((F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)), F.lit(0)) / F.greatest(F.coalesce(F.sum("n"), F.lit(0)), F.lit(1))).alias("repetition_rate"))


def distinct_n(df: DataFrame, text: Column, n: int) -> DataFrame:
    """Different n-grams over all n-grams of the corpus."""
    counts = df.select(F.explode(_grams(text, n)).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg((F.count(F.lit(1)) / F.greatest(F.coalesce(F.sum("n"), F.lit(0)), F.lit(1))).alias(f"distinct_{n}"))


def _overlap(df: DataFrame, key: str, hyp: Column, ref: Column, order: int) -> DataFrame:
    """(order, n_hyp, n_ref, n_match): clipped matches of grams, pooled over pairs."""
    side = lambda grams, name: df.select(key, F.explode(grams).alias("g")).groupBy(key, "g").agg(F.count(F.lit(1)).alias(name))
    both = side(hyp, "h").join(side(ref, "r"), [key, "g"], "full")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return both.agg(
        F.lit(order).alias("order"), F.coalesce(F.sum("h"), F.lit(0)).alias("n_hyp"), F.coalesce(F.sum("r"), F.lit(0)).alias("n_ref"),
        F.coalesce(F.sum(F.least(zero("h"), zero("r"))), F.lit(0)).alias("n_match"),
    )


def bleu(df: DataFrame, key: str, hyp: str, ref: str, most: int = 4) -> DataFrame:
    """Corpus BLEU in percent: clipped precisions, brevity penalty; an order without matches counts half the last one without."""
    parts = [_overlap(df, key, _grams(F.col(hyp), n), _grams(F.col(ref), n), n) for n in range(1, most + 1)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    # `most` rows: folded in order, halving the smoothing value at each order without a match.
    ordered = F.array_sort(F.collect_list(F.struct("order", "n_hyp", "n_ref", "n_match")))

    def step(acc: Column, x: Column) -> Column:
        smooth = F.when(x["n_match"] == 0, acc["smooth"] / 2).otherwise(acc["smooth"])
        p = F.when(x["n_hyp"] == 0, F.lit(0.0)).when(x["n_match"] == 0, 100.0 * smooth / x["n_hyp"]).otherwise(100.0 * x["n_match"] / x["n_hyp"])
        return F.struct(F.when(p > 0, acc["logs"] + F.log(p)).otherwise(F.lit(float("-inf"))).alias("logs"), smooth.alias("smooth"))

    folded = rows.agg(ordered.alias("o")).select(
        F.aggregate("o", F.struct(F.lit(0.0).alias("logs"), F.lit(1.0).alias("smooth")), step).alias("f"), F.col("o")[0]["n_hyp"].alias("h"), F.col("o")[0]["n_ref"].alias("r")
    )
    penalty = F.when(F.col("h") == 0, 0.0).when(F.col("h") >= F.col("r"), 1.0).otherwise(F.exp(1 - F.col("r") / F.col("h")))
    return folded.select((penalty * F.exp(F.col("f.logs") / most)).alias("bleu"))


def chrf(df: DataFrame, key: str, hyp: str, ref: str, char_order: int = 6, word_order: int = 0, beta: float = 2.0) -> DataFrame:
    """Corpus chrF (chrF++ with word_order 2) in percent: the F score of the orders' mean precision and recall."""
    bare = lambda c: F.regexp_replace(F.col(c), f"[{SPACE}]+", "")

    def char_grams(c: str, n: int) -> Column:
        return let(bare(c), lambda s: F.when(F.length(s) >= n, F.transform(F.sequence(F.lit(1), F.length(s) - n + 1), lambda i: F.substring(s, i, F.lit(n)))))

    # Punctuation at a word's ends is a word of its own.
    spaced = lambda c: F.regexp_replace(F.regexp_replace(F.col(c), r"([^\p{L}\p{N}\s])(?=\s|$)", " $1"), r"(^|\s)([^\p{L}\p{N}\s])", "$1$2 ")
    parts = [_overlap(df, key, char_grams(hyp, n), char_grams(ref, n), n) for n in range(1, char_order + 1)]
    parts += [_overlap(df, key, _grams(spaced(hyp), n), _grams(spaced(ref), n), char_order + n) for n in range(1, word_order + 1)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    used = rows.where("n_hyp > 0 AND n_ref > 0").agg(F.avg(F.col("n_match") / F.col("n_hyp")).alias("p"), F.avg(F.col("n_match") / F.col("n_ref")).alias("r"))
    b2 = beta * beta
    score = F.when(F.col("p") + F.col("r") > 0, 100.0 * (1 + b2) * F.col("p") * F.col("r") / (b2 * F.col("p") + F.col("r"))).otherwise(0.0)
    return used.select(score.alias("chrf"))


def lcs_length(a: Column, b: Column) -> Column:
    """Longest common subsequence of two word lists, of at most some hundred words each.

    Arrow-batched: the table's rows are array operations, which a fold of lambdas is far from.
    """
    return _lcs(a, b)


@F.pandas_udf(IntegerType())
def _lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    def length(x, y) -> int:
        if x is None or y is None or not len(x) or not len(y):
            return 0
        ids = {w: i for i, w in enumerate(dict.fromkeys([*x, *y]))}
        other = np.array([ids[w] for w in y])
        row = np.zeros(len(y) + 1, int)
        for word in x:
            row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (other == ids[word])))
        return int(row[-1])

    return pd.Series([length(x, y) for x, y in zip(a, b, strict=True)])


def rouge_l(df: DataFrame, hyp: str, ref: str) -> DataFrame:
    """Means over pairs of precision, recall and F of the longest common subsequence, in percent."""
    prepared = df.select(words(F.col(hyp)).alias("h"), words(F.col(ref)).alias("r"))
    lengths = prepared.select(F.size("h").alias("nh"), F.size("r").alias("nr"), lcs_length(F.col("h"), F.col("r")).alias("l"))
    p = F.when(F.col("nh") > 0, F.col("l") / F.col("nh")).otherwise(0.0)
    r = F.when(F.col("nr") > 0, F.col("l") / F.col("nr")).otherwise(0.0)
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return lengths.agg(*[(100 * F.avg(c)).alias(f"rouge_l_{name}") for c, name in ((p, "p"), (r, "r"), (f, "f"))])


def by_setting(scored: DataFrame, setting: str, metrics: list[str]) -> DataFrame:
    """(setting, mean of each metric, n): the table of metrics by sampling temperature."""
    return scored.groupBy(setting).agg(*[F.avg(m).alias(m) for m in metrics], F.count(F.lit(1)).alias("n"))


def first_non_blank(lines: DataFrame, order: list[str], value: str, n: int = 250) -> DataFrame:
    """The first n lines in order that aren't blank."""
    return lines.where(strip(F.col(value)) != "").orderBy(*order).limit(n)
