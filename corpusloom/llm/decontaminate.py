"""Benchmark decontamination by latent semantic retrieval, with subsequence and answer checks.

Passages of 32 words are TF-IDF vectors over hashed words. One pass counts passages by word, one
sketches A'A of the passage matrix A against a random test matrix, from which the driver gets the
leading right singular vectors (a randomised SVD by the Nystrom formula, in one pass). A third pass
folds overlapping windows into that space, looks up items by cosine and checks what it finds. Beside
it, windows with five words on end of an item are looked at whatever their cosine.

Cost at scale: three narrow scans. What moves is a count a word bucket and a row of the sketch a
bucket from each task, summed in the JVM with bounded memory; the driver gets those sums, whose
size the parameters set. Items are looked up in blocks, many of them in one scan.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, row_key, ship_code, with_keys
from .wordhash import Words, mix, utf8, words

BUCKET_BITS = 13  # hashed words that passages are vectors over
RANK, OVERSAMPLE = 112, 16  # dimensions kept, and more that the sketch has
STEP = 16  # words between windows; a window, as a passage, has two steps
GRAM = 5  # words on end of an item that are looked for as they are
GRAM_BITS = 20
RUN = 3  # words of the shortest items that may stand inside a text
PART = 48  # an item is looked up in parts of so many words at most
SCALE = 1 << 16  # sketch entries are summed as whole multiples of 1 / SCALE, so order doesn't matter
ITEM_BLOCK = 4096  # items held against windows at once, in expectation
SCAN_BLOCKS = 16  # blocks looked up in one scan
CELLS = 1 << 22  # cosines held at once
SMALL = 100_000  # ids of leaking documents that may be broadcast
ROWS = 256  # texts worked on at once

BUCKETS, WIDTH = 1 << BUCKET_BITS, RANK + OVERSAMPLE


@dataclass(frozen=True)
class Checks:
    """When a window is looked at, and when what is found is a leak.

    cosine: of the window and a part of an item, in latent space. shared: share of the part's words
    of weight that the window must have for a look at their order. lcs: share of the item's words in
    their longest common subsequence with the region. density: of that subsequence in the words it
    spans. answer: share of the answer's words found in order in that span. Items of fewer words
    than min_words count only as they are.
    """

    cosine: float = 0.35
    shared: float = 0.3
    lcs: float = 0.6
    density: float = 0.5
    answer: float = 0.5
    min_words: int = 5


def _words(texts: pa.Array) -> tuple[Words, np.ndarray]:
    found = words(*utf8(texts), marks=False)
    return found, (found.hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)


def _spans(offsets: np.ndarray, step: int) -> np.ndarray:
    """Where spans of `step` words begin if each text is cut into them, the last one shorter."""
    lengths = np.diff(offsets)
    counts = -(-lengths // step)
    inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.repeat(offsets[:-1], counts) + inside * step


def _entries(found: Words, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(passage, bucket) of every word that a passage has, once, in order of passage."""
    starts = _spans(found.offsets, 2 * STEP)
    passage = np.repeat(np.arange(len(starts), dtype=np.int64), np.diff(np.append(starts, len(buckets))))
    both = np.sort(passage << BUCKET_BITS | buckets)
    both = both[np.concatenate(([True], both[1:] != both[:-1]))] if len(both) else both
    return both >> BUCKET_BITS, both & (BUCKETS - 1), len(starts)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, total = np.zeros(BUCKETS + 1, np.int64), 0
    for part in _parts(batches):
        _, bucket, n = _entries(*_words(part.column(0)))
        counts[:BUCKETS] += np.bincount(bucket, minlength=BUCKETS)
        total += n
    counts[BUCKETS] = total
    kept = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int64()), pa.array(counts[kept], pa.int64())], ["bucket", "n"])


def passage_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """How many of all passages have each word bucket, and how many passages there are."""
    ship_code(docs.sparkSession)
    counts = docs.select(text_col).mapInArrow(_count_batches, "bucket bigint, n bigint")
    rows = counts.groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # a row a bucket
    out = np.zeros(BUCKETS + 1, np.int64)
    for row in rows:
        out[row["bucket"]] = row["n"]
    return out[:BUCKETS], int(out[BUCKETS])


def _test_matrix() -> np.ndarray:
    return np.random.default_rng(20240601).standard_normal((BUCKETS, WIDTH)).astype(np.float32)


def _with_zero(table: np.ndarray) -> np.ndarray:
    return np.concatenate((table, np.zeros((1, table.shape[1]), table.dtype)))


def _sum_rows(table: np.ndarray, rows: np.ndarray, sizes: np.ndarray, most: int) -> np.ndarray:
    """Sums of a table's rows over groups of `sizes` consecutive entries, `most` at most.

    The table's last row is 0. Groups are filled up with it, some hundred at a time, so that what is
    gathered stays in the cache.
    """
    ends = np.cumsum(sizes)
    out = np.empty((len(sizes), table.shape[1]), table.dtype)
    for at in range(0, len(sizes), 128):
        begins, size = (ends - sizes)[at : at + 128, None], sizes[at : at + 128, None]
        places = np.arange(most)
        index = np.where(places < size, rows[np.minimum(begins + places, len(rows) - 1)], len(table) - 1)
        out[at : at + 128] = table[index].sum(axis=1)
    return out


def _sum_groups(table: np.ndarray, rows: np.ndarray, sizes: np.ndarray, block: int = 8) -> np.ndarray:
    """Sums of a table's rows over groups of `sizes` consecutive entries, one at least and of any number.

    Whole blocks of a group's entries are gathered and summed first, then what groups have beyond them.
    """
    begins, rest = np.cumsum(sizes) - sizes, sizes % block
    out = np.zeros((len(sizes), table.shape[1]), table.dtype)
    several, single = np.flatnonzero(sizes >= block), np.flatnonzero(rest)
    if len(several):
        counts = sizes[several] // block
        inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        first = np.repeat(begins[several], counts) + inside * block
        sums = np.empty((len(first), table.shape[1]), table.dtype)
        for at in range(0, len(first), 256):
            sums[at : at + 256] = table[rows[first[at : at + 256, None] + np.arange(block)]].sum(axis=1)
        out[several] = np.add.reduceat(sums, np.cumsum(counts) - counts, axis=0)
    for k in range(1, block):
        groups = single[rest[single] == k]
        for at in range(0, len(groups), 256):
            part = groups[at : at + 256]
            out[part] += table[rows[(begins + sizes - k)[part, None] + np.arange(k)]].sum(axis=1)
    return out


def _sketch_batches(batches: Iterator[pa.RecordBatch], idf: np.ndarray) -> Iterator[pa.RecordBatch]:
    omega, sketch = _with_zero(_test_matrix() * idf[:, None]), np.zeros((BUCKETS, WIDTH))
    for part in _parts(batches):
        passage, bucket, n = _entries(*_words(part.column(0)))
        if not n:
            continue
        sizes = np.bincount(passage, minlength=n)
        square = np.bincount(passage, idf[bucket].astype(np.float64) ** 2, minlength=n)
        # Rows of A have length 1, so A @ omega and A' @ (A @ omega) divide by the length twice.
        projected = _sum_rows(omega, bucket, sizes, 2 * STEP) / np.maximum(square, 1e-12)[:, None]
        order = np.argsort(bucket.astype(np.int16), kind="stable")
        bucket, passage = bucket[order], passage[order]
        starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        sums = _sum_groups(projected.astype(np.float32), passage, np.diff(np.append(starts, len(bucket))))
        sketch[bucket[starts]] += sums * idf[bucket[starts], None]
    whole = np.rint(sketch * SCALE).astype(np.int64)
    kept = np.flatnonzero(whole.any(axis=1))
    columns = [pa.array(kept, pa.int64()), *(pa.array(np.ascontiguousarray(whole[kept, k])) for k in range(WIDTH))]
    yield pa.RecordBatch.from_arrays(columns, ["bucket", *(f"c{k}" for k in range(WIDTH))])


def latent_space(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Latent vectors of word buckets: IDF times right singular vectors over singular values.

    All passages of all rows count. Without any words all vectors are 0 and nothing is found.
    """
    counts, total = passage_frequencies(docs, text_col)
    # Never 0: a leak in very many rows must not make its own words weightless.
    idf = np.log1p(total / np.maximum(counts, 1.0)).astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast(idf)
    names = [f"c{k}" for k in range(WIDTH)]
    schema = "bucket bigint, " + ", ".join(f"{c} bigint" for c in names)
    rows = docs.select(text_col).mapInArrow(lambda batches: _sketch_batches(batches, shared.value), schema)
    sums = rows.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in names]).toPandas()  # a row a bucket
    sketch = np.zeros((BUCKETS, WIDTH))
    sketch[sums["bucket"].to_numpy(np.int64)] = sums[names].to_numpy(np.float64) / SCALE
    return singular_vectors(sketch, _test_matrix().astype(np.float64)) * idf[:, None]


def singular_vectors(sketch: np.ndarray, test: np.ndarray, rank: int = RANK) -> np.ndarray:
    """V / sigma of the leading `rank` singular triples of A, from A'A @ test."""
    if not np.any(sketch):
        return np.zeros((len(sketch), rank))
    shift = 1e-9 * np.linalg.norm(sketch)
    sketch = sketch + shift * test
    core = test.T @ sketch
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    kept = values > 1e-12 * values.max()
    left, sigma, _ = np.linalg.svd(sketch @ (vectors[:, kept] / np.sqrt(values[kept])), full_matrices=False)
    out = np.zeros((len(sketch), rank))
    used = min(rank, int((sigma > 1e-6 * sigma[0]).sum()))
    out[:, :used] = left[:, :used] / sigma[:used]
    return out


@dataclass
class Item:
    item_id: int
    words: list[int]
    answer: list[int]

    @cached_property
    def counts(self) -> Counter:
        return Counter(self.words)


@dataclass
class Index:
    """Items with their parts' unit vectors in latent space, and the words' vectors.

    A part's words of weight are marks in one hash table for all parts; need is how many of them a
    window must have. grams are the parts' runs of GRAM words on end, sorted, gram_part whose they
    are, and gram_marks tells most others from them by their leading bits.
    """

    items: list[Item]
    owner: np.ndarray
    vectors: np.ndarray
    latent: np.ndarray
    need: np.ndarray
    marked: np.ndarray
    grams: np.ndarray
    gram_part: np.ndarray
    gram_marks: np.ndarray
    short: dict[int, dict[int, list[int]]]  # items of few words: their number -> their hash -> item_ids

    def verbatim(self, found: Words) -> tuple[np.ndarray, np.ndarray]:
        """(word, part) where a run of words of a part begins."""
        runs = _grams(found.hashes)
        at = np.flatnonzero(self.gram_marks[runs >> np.uint64(64 - GRAM_BITS)]) if len(self.grams) else np.zeros(0, np.int64)
        at = at[np.searchsorted(found.offsets, at, "right") == np.searchsorted(found.offsets, at + GRAM - 1, "right")]
        first, last = (np.searchsorted(self.grams, runs[at], side) for side in ("left", "right"))
        n = last - first
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(at, n), self.gram_part[np.repeat(first, n) + inside]

    def places(self, hashes: np.ndarray, parts: np.ndarray) -> np.ndarray:
        bits = len(self.marked).bit_length() - 1
        return (mix(hashes + parts.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def _grams(hashes: np.ndarray, size: int = GRAM) -> np.ndarray:
    """Hashes of every `size` words on end."""
    n = max(0, len(hashes) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
    return mix(out)


def build_index(rows: list[tuple[int, str, str | None]], latent: np.ndarray, checks: Checks) -> Index:
    """Rows are (item_id, text, answer or None: the last quarter of the words, three at least)."""
    items, owner, vectors, need, keys, runs = [], [], [], [], [], []
    short: dict[int, dict[int, list[int]]] = {}
    weighs = latent.any(axis=1)
    if rows:
        found, buckets = _words(pa.array([r[1] for r in rows], pa.string()))
        given, _ = _words(pa.array([r[2] for r in rows], pa.string()))
        for k, (item_id, _, answer) in enumerate(rows):
            lo, hi = int(found.offsets[k]), int(found.offsets[k + 1])
            if hi - lo < checks.min_words:
                if hi > lo:
                    short.setdefault(hi - lo, {}).setdefault(int(_grams(found.hashes[lo:hi], hi - lo)[0]), []).append(item_id)
                continue
            own = found.hashes[lo:hi].tolist()
            tail = given.hashes[given.offsets[k] : given.offsets[k + 1]].tolist() if answer else own[-max(3, len(own) // 4) :]
            for part in np.array_split(np.arange(lo, hi), -(-(hi - lo) // PART)):
                vectors.append(latent[buckets[part]].sum(axis=0))
                own_words = np.unique(found.hashes[part[weighs[buckets[part]]]])
                keys.append((len(owner), own_words))
                need.append(checks.shared * len(own_words))
                # Every part's runs, one after the other, and its last words.
                own_runs = _grams(found.hashes[part])
                runs += [(run, len(owner)) for run in {*own_runs[::GRAM].tolist(), *own_runs[-1:].tolist()}]
                owner.append(len(items))
            items.append(Item(item_id, own, tail))
    matrix = np.array(vectors, np.float32).reshape(len(vectors), latent.shape[1])
    size = 1 << max(20, (32 * sum(len(w) for _, w in keys)).bit_length())
    runs.sort()
    grams, gram_part, gram_marks = np.array([r for r, _ in runs], np.uint64), np.array([p for _, p in runs], np.int64), np.zeros(1 << GRAM_BITS, bool)
    gram_marks[grams >> np.uint64(64 - GRAM_BITS)] = True
    index = Index(
        items, np.array(owner, np.int64), _unit(matrix), _with_zero(latent.astype(np.float32)), np.array(need), np.zeros(size, bool), grams, gram_part, gram_marks, short
    )
    for part, own_words in keys:
        index.marked[index.places(own_words, np.full(len(own_words), part))] = True
    return index


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1)), 1e-12)[:, None]


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, a bit of a whole number a word of a."""
    at: dict[int, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        if hit := row & at.get(x, 0):
            row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _matched(a: list[int], b: list[int]) -> list[int]:
    """Places in b of one longest common subsequence, taken from the end; a bit of memory a cell."""
    at: dict[int, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row, rows = full, []
    for x in b:
        if hit := row & at.get(x, 0):
            row = ((row + hit) | (row - hit)) & full
        rows.append(row)
    # A zero at i: one word more with a[i] than without. The first row with it is where it is matched.
    i, j, places = len(a) - 1, len(b) - 1, []
    while i >= 0 and j >= 0:
        if rows[j] >> i & 1:
            i -= 1
            continue
        while j and not rows[j - 1] >> i & 1:
            j -= 1
        places.append(j)
        i, j = i - 1, j - 1
    return places[::-1]


def verify(item: Item, region: list[int], checks: Checks) -> tuple[float, float, int, int] | None:
    """(share of the item, share of the answer, first and last place) if the region leaks the item."""
    n = len(item.words)
    need = checks.lcs * n
    want = item.counts
    if sum(map(want.__getitem__, want.keys() & set(region))) < need:  # the quick bound first
        return None
    have = Counter(region)
    if sum(min(c, have[w]) for w, c in want.items()) < need or common_subsequence(item.words, region) < need:
        return None
    places = _matched(item.words, region)
    while len(places) >= need:  # leave out far words at an end, the looser end first
        if len(places) >= checks.density * (places[-1] - places[0] + 1):
            break
        if places[1] - places[0] > places[-1] - places[-2]:
            places.pop(0)
        else:
            places.pop()
    if len(places) < need or len(places) < 2:
        return None
    span = region[places[0] : places[-1] + 1 + len(item.answer)]
    answer = common_subsequence(item.answer, span) / max(1, len(item.answer))
    return (len(places) / n, answer, places[0], places[-1]) if answer >= checks.answer else None


def _share_words(found: Words, starts: np.ndarray, ends: np.ndarray, parts: np.ndarray, index: Index) -> np.ndarray:
    """Whether windows have enough different words of weight of the parts they are near to; starts are in order."""
    out = np.zeros(len(starts), bool)
    for at in range(0, len(starts), 1 << 14):
        rows = slice(at, at + (1 << 14))
        begin, first, which = np.unique(starts[rows], return_index=True, return_inverse=True)
        places = begin[:, None] + np.arange(2 * STEP)
        # Past the text's end its last word is repeated, and each window's words count once.
        words = np.sort(found.hashes[np.minimum(places, ends[rows][first][:, None] - 1)], axis=1)
        once = np.ones(words.shape, bool)
        once[:, 1:] = words[:, 1:] != words[:, :-1]
        marks = index.marked[index.places(words[which], parts[rows, None])]
        out[rows] = (marks & once[which]).sum(axis=1) >= index.need[parts[rows]]
    return out


@dataclass
class Windows:
    """Texts in words, and their overlapping windows as unit vectors."""

    found: Words
    buckets: np.ndarray
    starts: np.ndarray  # of blocks of STEP words
    text: np.ndarray  # that each block is in
    first: np.ndarray  # a window's first block
    vectors: np.ndarray


def _windows(texts: pa.Array, latent: np.ndarray) -> Windows | None:
    found, buckets = _words(texts)
    if not len(buckets):
        return None
    starts = _spans(found.offsets, STEP)
    sums = _sum_rows(latent, buckets, np.diff(np.append(starts, len(buckets))), STEP)
    text = np.searchsorted(found.offsets, starts, "right") - 1
    follows = np.append(text[1:] == text[:-1], False)
    sums[:-1] += sums[1:] * follows[:-1, None]
    # The last block of a text of several is in the window before it.
    first = np.flatnonzero(follows | np.append(True, text[1:] != text[:-1]))
    return Windows(found, buckets, starts, text, first, _unit(sums[first]))


def _look_up(texts: pa.Array, index: Index, checks: Checks) -> Iterator[tuple[int, int, float, float, float, int, int]]:
    """(row, item_id, cosine, share of item, share of answer, first word, words) of each leak."""
    windows = _windows(texts, index.latent)
    if windows is not None:
        yield from _look_up_windows(windows, index, checks)


def _candidates(w: Windows, index: Index, checks: Checks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block, part, cosine) of windows to look at."""
    ends, kept = w.found.offsets[w.text + 1], []
    rows = max(1, CELLS // len(index.owner))
    for at in range(0, len(w.first), rows):
        cosines = w.vectors[at : at + rows] @ index.vectors.T
        near, part = np.nonzero(cosines >= checks.cosine)
        block = w.first[at : at + rows][near]
        enough = _share_words(w.found, w.starts[block], ends[block], part, index)
        kept.append((block[enough], part[enough], cosines[near, part][enough]))
    # Runs of an item's words are looked at in the window that they begin in, whatever its cosine.
    begins, run_part = index.verbatim(w.found)
    window = np.searchsorted(w.first, np.searchsorted(w.starts, begins, "right") - 1, "right") - 1
    both = np.unique(window * len(index.owner) + run_part)
    window, run_part = both // len(index.owner), both % len(index.owner)
    cosine = np.einsum("ij,ij->i", w.vectors[window], index.vectors[run_part])
    kept.append((w.first[window], run_part, cosine))
    return tuple(np.concatenate(x) for x in zip(*kept, strict=True))


def _look_up_windows(w: Windows, index: Index, checks: Checks) -> Iterator[tuple[int, int, float, float, float, int, int]]:
    yield from _short_leaks(w, index)
    if not len(index.owner):
        return
    near: dict[tuple[int, int], list[tuple[int, float]]] = {}
    for block, p, c in zip(*(x.tolist() for x in _candidates(w, index, checks)), strict=True):
        near.setdefault((int(w.text[block]), int(index.owner[p])), []).append((int(w.starts[block]), c))
    for (row, which), hits in near.items():
        item, lo, hi = index.items[which], int(w.found.offsets[row]), int(w.found.offsets[row + 1])
        n, best, done = len(item.words), None, -1
        for at, cosine in sorted(hits):
            if at < done:
                continue
            first, done = max(lo, at - n), at + STEP
            region = w.found.hashes[first : min(hi, at + 2 * STEP + n)].tolist()
            if (leak := verify(item, region, checks)) and (best is None or leak[0] > best[3]):
                best = (row, item.item_id, cosine, leak[0], leak[1], first - lo + leak[2], leak[3] - leak[2] + 1)
        if best:
            yield best


def _short_leaks(w: Windows, index: Index) -> Iterator[tuple[int, int, float, float, float, int, int]]:
    """Items of few words, where all their words stand in order: in a text, or as a whole one if they are one or two."""
    offsets = w.found.offsets
    for n, keys in index.short.items():
        known, whole = np.array(sorted(keys), np.uint64), np.diff(offsets) == n
        runs = _grams(w.found.hashes, n)
        at = np.flatnonzero(np.isin(runs, known))
        row = np.searchsorted(offsets, at, "right") - 1
        seen = set()
        for r, place in zip(row.tolist(), at.tolist(), strict=True):
            if place + n <= offsets[r + 1] and (n >= RUN or whole[r]):
                for item_id in keys[int(runs[place])]:
                    if (r, item_id) not in seen:
                        seen.add((r, item_id))
                        yield r, item_id, 1.0, 1.0, 1.0, place - int(offsets[r]), n


LEAKS = "item_id bigint, cosine double, lcs_share double, answer_share double, first_word bigint, n_words bigint"


def _leak_batches(batches: Iterator[pa.RecordBatch], indexes: list[Index], checks: Checks) -> Iterator[pa.RecordBatch]:
    names, kinds = zip(*(c.split() for c in LEAKS.split(", ")), strict=True)
    types = [pa.int64() if k == "bigint" else pa.float64() for k in kinds]
    for part in _parts(batches):
        windows = _windows(part.column(1), indexes[0].latent)
        for index in indexes if windows is not None else []:
            leaks = list(_look_up_windows(windows, index, checks))
            if leaks:
                rows, *rest = zip(*leaks, strict=True)
                columns = [pa.array(c, t) for c, t in zip(rest, types, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), *columns], ["id", *names])


def _leaks_by_id(texts: DataFrame, benchmark: DataFrame, checks: Checks, answer_col: str | None, item_block: int) -> DataFrame:
    """(id, text) of documents -> a row a pair of an id and an item."""
    spark = texts.sparkSession
    ship_code(spark)
    latent = latent_space(texts)
    answer = F.col(answer_col).cast("string") if answer_col else F.lit(None).cast("string")
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"), answer.alias("answer")).distinct()
    blocks = max(1, -(-items.count() // item_block))
    block = F.pmod(F.xxhash64("item_id", "text", "answer"), F.lit(blocks)).alias("block")
    found = None
    for at in range(0, blocks, SCAN_BLOCKS):
        rows = items.select(block, "*").where((F.col("block") >= at) & (F.col("block") < at + SCAN_BLOCKS)).orderBy("block", "item_id", "text", "answer").collect()
        indexes = [build_index([tuple(r)[1:] for r in rows if r["block"] == b], latent, checks) for b in sorted({r["block"] for r in rows})]
        if indexes:
            shared = spark.sparkContext.broadcast(indexes)
            kind = texts.schema["id"].dataType.simpleString()
            leaks = texts.select("id", "text").mapInArrow(lambda batches, shared=shared: _leak_batches(batches, shared.value, checks), f"id {kind}, {LEAKS}")
            found = leaks if found is None else found.unionByName(leaks)
    if found is None:
        found = texts.select("id", *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in LEAKS.split(", ")]).where(F.lit(False))
    best = F.max_by(F.struct("cosine", "lcs_share", "answer_share", "first_word", "n_words"), F.struct("lcs_share", "cosine", "first_word"))
    return found.groupBy("id", "item_id").agg(best.alias("best")).select("id", "item_id", "best.*")


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    checks: Checks = Checks(),
    answer_col: str | None = None,
    item_block: int = ITEM_BLOCK,
) -> DataFrame:
    """The (doc_id, item_id) pairs of documents that hold a benchmark item, or a paraphrase in order.

    A row a pair: cosine, the item's and the answer's share found, and where. Of repeated rows and
    of several places the fullest counts. Items of fewer than checks.min_words words are found where
    they stand word by word; of one or two, where a text has no other words. Null texts are empty, and neither they nor
    empty texts leak; an item's answer is answer_col, or the end of its text. Items with the same id
    are looked up each, repeated rows of the benchmark once; an item without words is never found. A
    null doc_id or item_id is kept as one. Texts and items may be of any length: windows and cosines
    are worked on in bounded pieces, and what is held for an item of n words is n * n / 2 bits.
    Empty tables give no rows; other columns are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").cast("string").alias("text"))
    return _leaks_by_id(texts, benchmark, checks, answer_col, item_block).withColumnRenamed("id", "doc_id")


def without_leaks(
    docs: DataFrame, benchmark: DataFrame, checks: Checks = Checks(), answer_col: str | None = None, item_block: int = ITEM_BLOCK
) -> DataFrame:
    """The rows of docs, all columns, that leak no item, whether or not they share a doc_id with one that does.

    A few leaking documents' keys are broadcast, many joined.
    """
    texts = docs.select(row_key(docs).alias("id"), F.col("text").cast("string").alias("text"))
    keys = cut(_leaks_by_id(texts, benchmark, checks, answer_col, item_block).select(F.col("id").alias("key")).distinct())
    return with_keys(docs, F.broadcast(keys) if keys.count() <= SMALL else keys, "left_anti")
