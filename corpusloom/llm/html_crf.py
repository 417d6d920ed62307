"""Main text of pages by a linear-chain conditional random field over their leaf blocks.

A page's blocks are a chain of main and other; what a block stands in and the shape of its text
are the features. The field is trained once a process on pages made from a seed, and decoded by
Viterbi. Cost at scale: one narrow scan, no shuffle; a page at a time is in memory.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship_code
from .html_blocks import Block, blocks
from .html_pages import CUES, MARK, labelled_pages

PAGES, ROUNDS, RATE, DECAY = 1200, 4, 0.3, 2e-4  # of the training
ROWS = 64  # pages decoded at once


#: What articles stand in, and tags that mean one thing in it and another outside.
ARTICLE = frozenset("t=article t=main r=main c=content c=post c=entry c=story c=text k=arti k=cont".split())
TWOFOLD = "header footer section h1 h2 p li div".split()


def block_features(chain: list[Block]) -> list[set[str]]:
    """Names of the features of each block of a page."""
    out, any_article = [], any(not ARTICLE.isdisjoint(b.above) for b in chain)
    for at, block in enumerate(chain):
        text = block.text
        place = "in" if not ARTICLE.isdisjoint(block.above) else "out" if any_article else "none"
        words = text.count(" ") + 1
        size = min(5, int(math.log2(words)))
        density = block.linked / max(1, len(text))
        own = {f"p={block.tag}", f"pp={block.parent}>{block.tag}", f"w={size}", f"l={min(3, int(density * 4))}", f"end={text[-1] in '.!?:;'}"}
        own.add(f"place={place}")
        own.update(f"{place}&{t}" for t in TWOFOLD if f"t={t}" in block.above)
        own.add(f"at={min(3, at)}")
        own.add(f"left={min(3, len(chain) - 1 - at)}")
        if "©" in text or text[:9].lower() == "copyright":
            own.add("sign")
        if words <= 40:
            own.update(f"cue={w}" for w in CUES if w in text.lower())
        out.append(own | block.above)
    return out


@dataclass
class Field:
    """Weights of features for main against other, of starts, and of steps from label to label."""

    weights: dict[str, float]
    start: tuple[float, float]
    step: tuple[tuple[float, float], tuple[float, float]]

    def scores(self, chain: list[Block]) -> list[float]:
        weight, known = self.weights.get, {}
        out = []
        for block, own in zip(chain, block_features(chain), strict=True):
            if block.above not in known:
                known[block.above] = sum(weight(f, 0.0) for f in block.above)
            out.append(known[block.above] + sum(weight(f, 0.0) for f in own - block.above))
        return out

    def decode(self, chain: list[Block]) -> list[int]:
        """The likeliest labels by Viterbi; of equally likely ones, other."""
        if not chain:
            return []
        (a, b), ((s00, s01), (s10, s11)) = self.start, self.step
        back = []
        for at, score in enumerate(self.scores(chain)):
            if at:
                back.append((int(b + s10 > a + s00), int(b + s11 > a + s01)))
                a, b = max(a + s00, b + s10), max(a + s01, b + s11)
            b += score
        labels = [int(b > a)]
        for choice in reversed(back):
            labels.append(choice[labels[-1]])
        return labels[::-1]


def _marginals(scores: np.ndarray, start: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chances of each label at each place, and of each pair of labels at each step."""
    n, emit = len(scores), np.exp(np.stack([np.zeros(len(scores)), np.clip(scores, -30, 30)], axis=1))
    move, forward, backward = np.exp(step), np.zeros((n, 2)), np.ones((n, 2))
    forward[0] = np.exp(start) * emit[0]
    forward[0] /= forward[0].sum()
    for t in range(1, n):
        row = forward[t - 1] @ move * emit[t]
        forward[t] = row / row.sum()
    for t in range(n - 2, -1, -1):
        row = move @ (emit[t + 1] * backward[t + 1])
        backward[t] = row / row.sum()
    one = forward * backward
    two = forward[:-1, :, None] * move * (emit[1:] * backward[1:])[:, None, :]
    return one / one.sum(axis=1, keepdims=True), two / np.maximum(two.sum(axis=(1, 2), keepdims=True), 1e-300)


def train(pages: list[str], rounds: int = ROUNDS) -> Field:
    """Maximum likelihood by AdaGrad over pages whose main blocks hold MARK."""
    names: dict[str, int] = {}
    data = []
    for page in pages:
        chain = blocks(page)
        labels = np.array([MARK in b.text for b in chain], int)
        for block in chain:
            block.text = block.text.replace(MARK, "")
        chain, labels = [b for b in chain if b.text], labels[[bool(b.text) for b in chain]]
        if chain:
            rows = [np.array([names.setdefault(f, len(names)) for f in sorted(own)]) for own in block_features(chain)]
            data.append((np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows]), labels))
    w, grad2 = np.zeros(len(names)), np.full(len(names), 1e-2)
    chain_w, chain2 = np.zeros(6), np.full(6, 1e-2)
    order = np.random.default_rng(7)
    for _ in range(rounds):
        for k in order.permutation(len(data)):
            feature, place, labels = data[k]
            scores = np.bincount(place, w[feature], minlength=len(labels))
            one, two = _marginals(scores, chain_w[:2], chain_w[2:].reshape(2, 2))
            error = one[:, 1] - labels
            kinds, inverse = np.unique(feature, return_inverse=True)
            g = np.bincount(inverse, error[place]) + DECAY * w[kinds]
            grad2[kinds] += g * g
            w[kinds] -= RATE * g / np.sqrt(grad2[kinds])
            seen = np.zeros((2, 2))
            np.add.at(seen, (labels[:-1], labels[1:]), 1)
            g = np.concatenate((one[0] - np.eye(2)[labels[0]], (two.sum(axis=0) - seen).ravel())) + DECAY * chain_w
            chain2 += g * g
            chain_w -= RATE * g / np.sqrt(chain2)
    weights = {name: float(w[i]) for name, i in names.items() if w[i]}
    s, m = chain_w[:2].tolist(), chain_w[2:].tolist()
    return Field(weights, (s[0], s[1]), ((m[0], m[1]), (m[2], m[3])))


@cache
def trained_field() -> Field:
    return train(labelled_pages(PAGES))


def main_blocks(page: str | None, field: Field) -> list[str]:
    """The texts of a page's main blocks, in order."""
    chain = blocks(page or "")
    return [b.text for b, label in zip(chain, field.decode(chain), strict=True) if label]


def _extract_batches(batches: Iterator[pa.RecordBatch], field: Field) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            found = [main_blocks(page, field) for page in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.string()))], ["row", "main_blocks"])


def extract_main_text(
    pages: DataFrame, field: Field | None = None, html_col: str = "html", passed: tuple[str, ...] = ("page_id", "url")
) -> DataFrame:
    """Columns `passed`, main_blocks (a list), text (blocks joined by a space) and n_chars of every row.

    A null or empty page, and one without main text, has text ''. Repeated rows stay; an empty
    table gives no rows; other columns are ignored.
    """
    spark = pages.sparkSession
    ship_code(spark)
    shared = spark.sparkContext.broadcast(field or trained_field())
    kept = pages.select(F.struct(*passed).alias("row"), F.col(html_col).cast("string").alias("html"))
    schema = kept.select("row", F.array(F.lit("")).alias("main_blocks")).schema
    found = kept.mapInArrow(lambda batches: _extract_batches(batches, shared.value), schema)
    text = F.array_join("main_blocks", " ")
    return found.select("row.*", "main_blocks", text.alias("text"), F.char_length(text).cast("bigint").alias("n_chars"))
