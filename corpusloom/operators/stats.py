"""Corpus, tokenizer, training and attention statistics; no rounding, that is for reports."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import SPACE, word_count

#: The tokens that queries count: runs of letters, marks, digits and joiners, and runs of other symbols.
PIECE = r"[\p{L}\p{M}\p{N}\p{Pc}\x{200C}\x{200D}]+|[^\p{L}\p{M}\p{N}\p{Pc}\x{200C}\x{200D}\t-\r\x1c-\x20\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{3000}]+"


def pieces(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({PIECE})"), F.lit(1))


def piece_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(PIECE))


def prefix_counts(df: DataFrame, line: str) -> DataFrame:
    """Lines by how they begin; `manually` begins with manual, too."""
    s = F.regexp_replace(F.col(line), rf"^[{SPACE}]+|[{SPACE}]+$", "")
    manual, public, empty = s.startswith("manual"), s.startswith("public"), s == ""
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    return df.agg(F.count(F.lit(1)).alias("n_lines"), n(empty).alias("n_empty"), n(manual).alias("n_manual"), n(public).alias("n_public"), n(~empty & ~manual & ~public).alias("n_none"))


def source_breakdown(df: DataFrame, source: str, text: str) -> DataFrame:
    """Lines, words and share of all words of each source, and a TOTAL row, in one pass."""
    counted = df.select(F.col(source).alias("source"), word_count(F.col(text)).alias("w"))
    rolled = counted.rollup("source").agg(F.grouping("source").alias("g"), F.count(F.lit(1)).alias("n_lines"), F.sum("w").alias("n_words"))
    total = F.sum(F.when(F.col("g") == 1, F.col("n_words"))).over(Window.partitionBy(F.lit(0)))  # a row a source
    return rolled.select(F.when(F.col("g") == 1, "TOTAL").otherwise(F.col("source")).alias("source"), "n_lines", "n_words", F.when(total > 0, F.col("n_words") / total).alias("share"))


def token_report(df: DataFrame, category: str, words: Column, tokens: Column) -> DataFrame:
    """Lines, words, tokens, fertility and share of tokens by category and in all; fertility is infinite without words."""
    counted = df.select(F.col(category).alias("category"), words.alias("w"), tokens.alias("t"))
    rolled = counted.rollup("category").agg(F.grouping("category").alias("g"), F.count(F.lit(1)).alias("n_lines"), F.sum("w").alias("n_words"), F.sum("t").alias("n_tokens"))
    total = F.sum(F.when(F.col("g") == 1, F.col("n_tokens"))).over(Window.partitionBy(F.lit(0)))
    fertility = F.when(F.col("n_words") > 0, F.col("n_tokens") / F.col("n_words")).otherwise(F.lit(math.inf))
    return rolled.select(F.when(F.col("g") == 1, "total").otherwise(F.col("category")).alias("category"), "n_lines", "n_words", "n_tokens", fertility.alias("fertility"), (F.col("n_tokens") / total).alias("token_share"))


def token_frequency(df: DataFrame, tokens: Column, skip: str | None = None) -> DataFrame:
    counts = df.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return counts if skip is None else counts.where(F.col("token") != skip)


def frequency_stats(counts: DataFrame, vocab_size: int, specials: int = 4) -> DataFrame:
    """Unique tokens, coverage of the vocabulary in percent, mean, median, sample deviation, extremes."""
    return counts.agg(
        F.count(F.lit(1)).alias("n_unique"),
        (F.count(F.lit(1)) * 100.0 / (vocab_size - specials)).alias("coverage_pct"),
        F.avg("n").alias("mean_n"), F.median("n").alias("median_n"), F.stddev_samp("n").alias("stdev_n"), F.max("n").alias("max_n"), F.min("n").alias("min_n"),
    )


def top(counts: DataFrame, n: int = 20, least: bool = False) -> DataFrame:
    """The n most, or least, frequent tokens; ties in order of the token."""
    return counts.orderBy(F.col("n").asc() if least else F.col("n").desc(), "token").limit(n)


def first_words_where(df: DataFrame, order: list[str], words: Column, test, n: int = 20) -> DataFrame:
    """The first n distinct words, in reading order, that pass the test."""
    at = df.select(*order, F.posexplode(words).alias("pos", "word")).where(test(F.col("word")))
    return at.groupBy("word").agg(F.min(F.struct(*order, "pos")).alias("first")).orderBy("first").limit(n).select("word", "first.*")


def accuracy(df: DataFrame, groups: list[str], correct: Column) -> DataFrame:
    """Correct and total of each value of each group column, and of all: one pass over grouping sets."""
    marked = df.select(*groups, correct.cast("boolean").alias("__c"))
    expanded = marked.select("__c", F.explode(F.array(F.struct(F.lit("all").alias("dimension"), F.lit("all").alias("value")), *[F.struct(F.lit(g).alias("dimension"), F.col(g).cast("string").alias("value")) for g in groups])).alias("k"))
    return expanded.groupBy("k.dimension", "k.value").agg(
        F.count_if("__c").alias("n_correct"), F.count(F.lit(1)).alias("n_total"), (F.count_if("__c") * 100.0 / F.count(F.lit(1))).alias("accuracy_pct")
    )


def perplexity(loss: Column, tokens: Column, n_bytes: Column, cap: float = 20.0, start: float = 0.0) -> list[Column]:
    """Cross-entropy a token, perplexity and bits a byte from sums; start is what the loss sum begins with."""
    ce = (F.sum(loss) + start) / F.sum(tokens)
    return [ce.alias("ce"), F.exp(F.least(ce, F.lit(cap))).alias("ppl"), (ce / math.log(2) / (F.sum(n_bytes) / F.sum(tokens))).alias("bpb")]


def file_bytes_bpb(loss: Column, file_bytes: Column) -> Column:
    """Loss of the tokens looked at over the bytes of the whole file, in bits: too small, kept to compare with old reports."""
    return (F.sum(loss) / math.log(2) / F.max(file_bytes)).alias("bpb_file_bytes")


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.sum(value * weight) / F.sum(weight)


def interval_means(log: DataFrame, step: str, interval: int, *values: str) -> DataFrame:
    return log.groupBy(F.floor(F.col(step) / interval).alias("interval_no")).agg(F.count(F.lit(1)).alias("n"), *[F.avg(v).alias(f"mean_{v}") for v in values])


def weight_norms(values: DataFrame, name: str, value: str) -> DataFrame:
    """(component, mean_norm): the mean L2 norm of the tensors whose names differ after the last dot."""
    norms = values.groupBy(name).agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias("norm"))
    return norms.groupBy(F.regexp_replace(name, r"\.[^.]*$", "").alias("component")).agg(F.avg("norm").alias("mean_norm"), F.count(F.lit(1)).alias("n_tensors"))


def parameter_count(vocab: Column, d: Column, layers: Column, ffn: Column, gated: Column, tied: Column) -> Column:
    """Parameters by part: embedding, attention, norms, feed-forward (a third matrix if gated), head (none if tied)."""
    attention, norms = 4 * d * d, 4 * d
    forward = d * ffn + ffn + ffn * d + d + F.when(gated, d * ffn + ffn).otherwise(0)
    embedding, blocks, head = vocab * d, layers * (attention + norms + forward), F.when(tied, 0).otherwise(vocab * d)
    return F.struct(
        embedding.alias("embedding"), (layers * attention).alias("attention"), (layers * forward).alias("feed_forward"), (layers * norms + 2 * d).alias("norms"), head.alias("head"), (embedding + blocks + 2 * d + head).alias("total")
    )


def rank_runs(runs: DataFrame, loss: str, key: str) -> DataFrame:
    return runs.withColumn("rank", F.row_number().over(Window.orderBy(loss, key)))  # runs of a sweep: few rows


def marginals(runs: DataFrame, dimensions: list[str], value: str) -> DataFrame:
    """Mean, least, and quartiles of value for every combination of the dimensions; null means all."""
    return runs.cube(*dimensions).agg(
        F.grouping_id().alias("grouping"), F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("least"),
        F.percentile(value, 0.25).alias("q1"), F.percentile(value, 0.5).alias("q2"), F.percentile(value, 0.75).alias("q3"),
    )


def attention_entropy(weights: Column) -> Column:
    """Bits of a row of weights; weights are taken as 1e-9 at least."""
    return F.aggregate(weights, F.lit(0.0), lambda acc, w: acc - F.greatest(w, F.lit(1e-9)) * F.log2(F.greatest(w, F.lit(1e-9))))


def attention_distance(weights: Column, query: Column) -> Column:
    """Mean distance of a query from its keys, weighted."""
    return F.aggregate(F.transform(weights, lambda w, k: w * F.abs(query - k)), F.lit(0.0), lambda acc, x: acc + x)


def compare_checkpoints(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Difference and change in percent of value by key; null percent where it was 0."""
    joined = before.select(key, F.col(value).alias("before")).join(after.select(key, F.col(value).alias("after")), key)
    return joined.select(key, "before", "after", (F.col("after") - F.col("before")).alias("delta"), F.try_divide((F.col("after") - F.col("before")) * 100.0, F.col("before")).alias("change_pct"))


def saved_or_computed(saved: DataFrame, computed: DataFrame, step: str, loss: str) -> DataFrame:
    joined = saved.select(step, F.col(loss).alias("__saved")).join(computed.select(step, F.col(loss).alias("__own")), step, "full")
    return joined.select(step, F.coalesce("__saved", "__own").alias(loss), F.when(F.col("__saved").isNotNull(), "saved").otherwise("computed").alias("origin"))


def dataset_stats(df: DataFrame, category: str, hop: str) -> DataFrame:
    """Rows and share in percent by category, by hop and in all, as (dimension, value)."""
    expanded = df.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), v.alias("value")) for d, v in (("all", F.lit("all")), ("category", F.col(category).cast("string")), ("hop", F.col(hop).cast("string")))])).alias("k"))
    counts = expanded.groupBy("k.dimension", "k.value").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share_pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("dimension")))  # a row a value


def retained(before: Column, after: Column) -> list[Column]:
    """Characters before and after cleaning, and the share left in percent; 0 of nothing."""
    b, a = F.coalesce(F.sum(F.char_length(before)), F.lit(0)), F.coalesce(F.sum(F.char_length(after)), F.lit(0))
    return [b.alias("chars_before"), a.alias("chars_after"), F.when(b > 0, a * 100.0 / b).otherwise(0.0).alias("retained_pct")]


def throughput(log: DataFrame, group: str, ts: str, n_bytes: str, target: int) -> DataFrame:
    """Megabytes, minutes, megabytes a minute of each group, and minutes left to a target of bytes (null without a rate, 0 beyond it)."""
    seen = log.groupBy(group).agg(F.sum(n_bytes).alias("n_bytes"), ((F.unix_micros(F.max(F.col(ts).cast("timestamp"))) - F.unix_micros(F.min(F.col(ts).cast("timestamp")))) / 60e6).alias("minutes"))
    mb = F.col("n_bytes") / 1e6
    rate = F.try_divide(mb, F.col("minutes"))
    left = F.greatest(F.lit(target / 1e6) - mb, F.lit(0.0))
    return seen.select(group, mb.alias("mb"), "minutes", rate.alias("mb_per_min"), F.try_divide(left, rate).alias("eta_min"))


def head_means(heads: DataFrame, layer: str, head: str, value: str, n_heads: int) -> DataFrame:
    """(layer, mean, h0, h1, ...): a layer's mean and its value by head, from rows of a layer and head."""
    return heads.groupBy(layer).agg(F.avg(value).alias("mean"), *[F.avg(F.when(F.col(head) == h, F.col(value))).alias(f"h{h}") for h in range(n_heads)])


def checkpoint_summary(values: DataFrame, checkpoint: str, layer: str, samples: str, value: str, layers: int) -> DataFrame:
    """A JSON line a checkpoint, in order of its samples: its mean value by layer; another number of layers is an error."""
    means = values.groupBy(checkpoint, layer).agg(F.max(samples).alias("samples"), F.avg(value).alias("mean"))
    by_layer = F.array_sort(F.collect_list(F.struct(layer, "mean")))  # `layers` long
    whole = means.groupBy(checkpoint).agg(F.max("samples").alias("samples"), by_layer.alias("by_layer"))
    checked = F.when(F.size("by_layer") == layers, F.transform("by_layer", lambda x: F.round(x["mean"], 6))).otherwise(F.raise_error(F.concat(F.lit("another number of layers in "), F.col(checkpoint).cast("string"))))
    return whole.select(checkpoint, "samples", F.to_json(checked).alias("layer_means")).orderBy("samples", checkpoint)


def token_examples(encoded: DataFrame, order: str, text: str, tokens: str, n: int = 5, width: int = 80) -> DataFrame:
    """The first n texts in order with their beginning, tokens joined by |, and how many there are."""
    return encoded.orderBy(order).limit(n).select(order, F.substring(text, 1, width).alias("beginning"), F.array_join(tokens, "|").alias("tokens"), F.size(tokens).alias("n_tokens"))
