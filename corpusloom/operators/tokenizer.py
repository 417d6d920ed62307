"""Byte-pair vocabularies: training on distinct pieces, encoding, decoding and packing.

Merges are learned over all distinct pieces, few on the driver, many on executors. Texts are encoded
where they are.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from corpusloom.functions.text import nfc
from corpusloom.operators.merging import learn_on_executors
from corpusloom.operators.ordering import cut
from corpusloom.operators.stats import pieces

#: Special tokens, first in the vocabulary.
SPECIALS = ("<pad>", "<unk>", "<bos>", "<eos>")
MAX_PIECES = 20_000  # distinct pieces that are merged on the driver; more are where they are (merging.py)
KNOWN = 200_000  # pieces whose ids a task keeps
ROWS = 500  # texts encoded at once


@dataclass
class Bpe:
    vocab: dict[str, int]
    merges: list[tuple[str, str]]

    def encode_piece(self, piece: str) -> list[str]:
        """Tokens of one piece: merges in rank order, leftmost first; unknown letters are <unk> each."""
        ranks = getattr(self, "_ranks", None)
        if ranks is None:
            ranks = self._ranks = {m: r for r, m in enumerate(self.merges)}
        parts = [c if c in self.vocab else "<unk>" for c in piece]
        none, here = len(ranks), [ranks.get(p, len(ranks)) for p in zip(parts, parts[1:], strict=False)]
        while here and (rank := min(here)) < none:
            at = here.index(rank)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del here[at]
            if at:
                here[at - 1] = ranks.get((parts[at - 1], parts[at]), none)
            if at < len(here):
                here[at] = ranks.get((parts[at], parts[at + 1]), none)
        return parts


def piece_counts(df: DataFrame, text: Column) -> DataFrame:
    return df.select(F.explode(pieces(nfc(text))).alias("piece")).groupBy("piece").agg(F.count(F.lit(1)).alias("n"))


def train_bpe(df: DataFrame, text: Column, vocab_size: int, min_frequency: int = 2, max_pieces: int = MAX_PIECES) -> Bpe:
    """Learn a vocabulary from all texts: specials, letters by code point, then merges by frequency.

    The most frequent pair is merged while it has min_frequency; of equals the one of least ids.
    All pieces count: up to max_pieces of them are merged on the driver, more on executors.
    """
    counts = cut(piece_counts(df, text))
    alphabet = sorted(r["c"] for r in counts.select(F.explode(F.split("piece", "")).alias("c")).where("c <> ''").distinct().collect())
    n_pieces = counts.count()
    if n_pieces <= max_pieces:
        return learn_merges({r["piece"]: r["n"] for r in counts.collect()}, alphabet, vocab_size, min_frequency)
    names = [*SPECIALS, *alphabet]
    vocab, merges = {t: i for i, t in enumerate(names)}, []
    for pair in learn_on_executors(counts, n_pieces, names, len(SPECIALS), vocab_size, min_frequency):
        left, right = (names[i] for i in pair)
        merges.append((left, right))
        if vocab.setdefault(left + right, len(vocab)) == len(names):
            names.append(left + right)
    return Bpe(vocab, merges)


def _merged(parts: list[str], pair: tuple[str, str]) -> list[str]:
    out, i = [], 0
    while i < len(parts):
        if tuple(parts[i : i + 2]) == pair:
            out.append(parts[i] + parts[i + 1])
            i += 2
        else:
            out.append(parts[i])
            i += 1
    return out


def learn_merges(counts: dict[str, int], alphabet: list[str], vocab_size: int, min_frequency: int = 2) -> Bpe:
    vocab = {t: i for i, t in enumerate([*SPECIALS, *alphabet])}
    split = {p: list(p) for p in counts}
    pairs, where = Counter(), defaultdict(set)
    for piece, parts in split.items():
        for pair in zip(parts, parts[1:], strict=False):
            pairs[pair] += counts[piece]
            where[pair].add(piece)
    entry = lambda pair: (-pairs[pair], vocab[pair[0]], vocab[pair[1]], pair)
    heap, merges = [entry(p) for p in pairs], []
    heapq.heapify(heap)
    while heap and len(vocab) < vocab_size:
        n, _, _, pair = heapq.heappop(heap)
        if -n != pairs[pair]:
            if pairs[pair] >= min_frequency:
                heapq.heappush(heap, entry(pair))
            continue
        if -n < min_frequency:
            break
        merges.append(pair)
        vocab.setdefault(pair[0] + pair[1], len(vocab))
        changed = set()
        for piece in list(where[pair]):
            parts, n_piece = split[piece], counts[piece]
            for old in zip(parts, parts[1:], strict=False):
                pairs[old] -= n_piece
                where[old].discard(piece)
            out = _merged(parts, pair)
            split[piece] = out
            for new in zip(out, out[1:], strict=False):
                pairs[new] += n_piece
                where[new].add(piece)
                changed.add(new)
        pairs[pair] = 0
        for new in changed:
            heapq.heappush(heap, entry(new))
    return Bpe(vocab, merges)


def _id_lists(lists: pa.ListArray, model: Bpe, known: dict[str, list[int]]) -> pa.ListArray:
    """The token ids of each text, of its pieces in order; `known` has pieces' ids, those of the latest texts at least."""
    coded = lists.flatten().dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    if len(known) > KNOWN:
        known.clear()
    for piece in distinct:
        if piece not in known:
            known[piece] = [model.vocab[t] for t in model.encode_piece(piece)]
    ids = [known[piece] for piece in distinct]
    size = np.fromiter(map(len, ids), np.int64, len(ids))
    flat, at = np.fromiter(chain.from_iterable(ids), np.int32, size.sum()), coded.indices.to_numpy()
    n, first = size[at], (np.cumsum(size) - size)[at]
    ends = np.concatenate(([0], np.cumsum(n)))
    pieces_of = lists.value_lengths().fill_null(0).to_numpy()
    offsets = ends[np.concatenate(([0], np.cumsum(pieces_of)))]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat[np.repeat(first - ends[:-1], n) + np.arange(ends[-1])]))


def encode(df: DataFrame, key: str, text: Column, bpe: Bpe) -> DataFrame:
    """(key, ids): token ids of each text in order, a row a row; nothing is shuffled, each task encodes a piece once or seldom more."""
    shared = df.sparkSession.sparkContext.broadcast(bpe)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[int]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                yield pa.RecordBatch.from_arrays([part.column(0), _id_lists(part.column(1), shared.value, known)], [key, "ids"])

    split = df.select(key, pieces(nfc(text)).alias("pieces"))
    return split.mapInArrow(run, StructType([StructField(key, split.schema[key].dataType), StructField("ids", ArrayType(IntegerType()))]))


def decode(coded: DataFrame, key: str, vocab: DataFrame, specials: int = len(SPECIALS)) -> DataFrame:
    """(key, tokens): each id's token, <id:n> where there is none; specials are left out."""
    placed = coded.select(key, F.posexplode("ids").alias("pos", "id")).where(F.col("id") >= specials)
    named = placed.join(vocab, "id", "left").withColumn("token", F.coalesce("token", F.format_string("<id:%d>", "id")))
    return named.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]).alias("tokens"))


def chars_per_token(vocab: DataFrame, specials: int = len(SPECIALS)) -> DataFrame:
    """Mean length of the vocabulary's tokens, each once."""
    return vocab.where(F.col("id") >= specials).agg(F.avg(F.length("token")).alias("chars_per_token"))


def pack(prompt_ids: Column, answer_ids: Column, context: int, pad: int = 0, eos: int = 3, ignored: int = -100) -> Column:
    """struct<x, y> of `context` ids: prompt, answer and end, cut and filled up; y is x shifted, ignored in the prompt and the filling."""
    whole = F.concat(prompt_ids, answer_ids, F.array(F.lit(eos)))
    labels = F.concat(F.array_repeat(F.lit(ignored), F.size(prompt_ids)), answer_ids, F.array(F.lit(eos)))
    fill = lambda a, v: F.slice(F.concat(a, F.array_repeat(F.lit(v), context + 1)), 1, context + 1)
    return F.struct(F.slice(fill(whole, pad), 1, context).alias("x"), F.slice(fill(labels, ignored), 2, context).alias("y"))


def clamp_ids(ids: Column, vocab_size: int) -> Column:
    return F.transform(ids, lambda x: F.least(F.greatest(x, F.lit(0)), F.lit(vocab_size - 1)))


def masked_loss(loss: Column, start: Column, prompt_chars: Column) -> list[Column]:
    """Sum of losses and number of tokens that begin after the prompt."""
    counted = start >= prompt_chars
    return [F.sum(F.when(counted, loss)).alias("loss"), F.count_if(counted).alias("n_tokens")]


def known_pieces(df: DataFrame, key: str, tokens: Column, vocab: DataFrame, unknown: str = "<unk>") -> DataFrame:
    """(key, tokens): each token that vocab (token) has, `unknown` for others, in order."""
    placed = df.select(key, F.posexplode(tokens).alias("pos", "token"))
    known = placed.join(vocab.select("token", F.lit(True).alias("known")), "token", "left").withColumn("token", F.when(F.col("known"), F.col("token")).otherwise(unknown))
    return known.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]).alias("tokens"))


def best_vocabulary(reports: DataFrame, size: str, score: str, tolerance: float = 0.01) -> DataFrame:
    """reports with `chosen`: the least vocabulary whose score is at most the best one's plus a tolerance."""
    everything = Window.partitionBy(F.lit(0))  # a row a size
    near = F.col(score) <= F.min(score).over(everything) * (1 + tolerance)
    return reports.withColumn("chosen", F.col(size) == F.min(F.when(near, F.col(size))).over(everything))


def unk_report(encoded: DataFrame, words: str, tokens: str) -> DataFrame:
    """Fertility and share of unknown tokens, infinite without words or tokens."""
    unk = F.size(F.filter(F.col(tokens), lambda t: t == "<unk>"))
    s = encoded.agg(F.coalesce(F.sum(words), F.lit(0)).alias("w"), F.coalesce(F.sum(F.size(tokens)), F.lit(0)).alias("t"), F.coalesce(F.sum(unk), F.lit(0)).alias("u"))
    infinite = F.lit(float("inf"))
    return s.select(F.when(F.col("w") > 0, F.col("t") / F.col("w")).otherwise(infinite).alias("fertility"), F.when(F.col("t") > 0, F.col("u") / F.col("t")).otherwise(infinite).alias("unk_rate"))
