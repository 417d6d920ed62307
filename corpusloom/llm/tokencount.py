"""Token counts of a word-level byte-pair vocabulary by merging on a heap and a linked list.

Cost at scale: a narrow scan with no shuffle; each Python worker keeps a bounded cache of the
counts of pieces it has seen, so frequent words are merged once.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import ship_code

ROWS = 256  # texts decoded at once
CACHE = 400_000  # pieces whose counts a worker keeps
LONG_PIECE = 64  # longer pieces are merged each time rather than kept

#: Characters whose case, class and composition don't depend on a Unicode version, and most texts have no others.
_OTHERS = re.compile("[^\0-\u024f\u2010-\u2027\u20ac]")


class MergeCounter:
    """Counts tokens as a vocabulary file's library gives them, without making their ids.

    The file holds merges in rank order, an end-of-word suffix, a split pattern, a normaliser
    (NFC and lower case) and added tokens, which are cut out of the raw
    text first and count one each. Texts of Latin letters and plain punctuation are lower-cased and
    split here; for others this is left to the library, whose Unicode version is its own. Merging
    is done here for all.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {pair: rank for rank, pair in enumerate(merges)}
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab = model["vocab"]
        pattern = next(p["pattern"] for p in _flat(spec["pre_tokenizer"]) if p["type"] == "Split")
        # The library's \\s is Unicode's White_Space; white space is in no piece, so need not be replaced.
        self.pieces = regex.compile(pattern["Regex"].replace(r"\s", r"\p{White_Space}")).findall
        # A byte-level alphabet: printable Latin-1 bytes stand for themselves, the rest move up.
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        moved = iter(range(256, 512))
        self.letters = [chr(b) if b in set(plain) else chr(next(moved)) for b in range(256)]
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None
        library = Tokenizer.from_file(path)
        self.normalize, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.cache: dict[str, int] = {}  # of pieces as they are
        self.spelt: dict[str, int] = {}  # of pieces in the byte-level alphabet

    def piece(self, piece: str) -> int:
        """Tokens of one piece."""
        return self.merge([self.letters[b] for b in piece.encode("utf-8", "surrogatepass")])

    def merge(self, symbols: list[str]) -> int:
        """How many symbols are left after the merges, lowest rank and leftmost first."""
        symbols[-1] += self.suffix
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.ranks.get
        heap = [(r, i, i + 1) for i in range(n - 1) if (r := rank((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        merged = 0
        while heap:
            r, i, j = heapq.heappop(heap)
            # An entry is stale once either side has been merged into something else.
            if symbols[i] is None or after[i] != j or j >= n or rank((symbols[i], symbols[j])) != r:
                continue
            symbols[i] += symbols[j]
            symbols[j] = None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                if (r := rank((symbols[i], symbols[after[i]]))) is not None:
                    heapq.heappush(heap, (r, i, after[i]))
            if before[i] >= 0 and (r := rank((symbols[before[i]], symbols[i]))) is not None:
                heapq.heappush(heap, (r, before[i], i))
            merged += 1
        return n - merged

    def _kept(self, pieces: Iterable[str], cache: dict[str, int], count: Callable[[str], int]) -> int:
        total = 0
        for piece in pieces:
            if (n := cache.get(piece)) is None:
                n = count(piece)
                if len(piece) <= LONG_PIECE:
                    if len(cache) >= CACHE:
                        cache.clear()
                    cache[piece] = n
            total += n
        return total

    def _plain(self, text: str) -> int:
        if not text:
            return 0
        if _OTHERS.search(text) is None:
            return self._kept(self.pieces(text.lower()), self.cache, self.piece)
        pieces = (piece for piece, _ in self.split(self.normalize(text)))
        return self._kept(pieces, self.spelt, lambda piece: self.merge(list(piece)))

    def text(self, text: str | None) -> int:
        """Tokens of a whole text; a null text counts as empty, an empty text has none."""
        if not text:
            return 0
        if self.added is None or self.added.search(text) is None:
            return self._plain(text)
        found = self.added.findall(text)
        return len(found) + sum(map(self._plain, self.added.split(text)))


def _flat(node: dict | None) -> Iterator[dict]:
    if node:
        yield node
        for key in ("pretokenizers", "normalizers"):
            for child in node.get(key) or []:
                yield from _flat(child)


_counters: dict[str, MergeCounter] = {}


def counter(path: str) -> MergeCounter:
    """The worker's counter for a file, kept with its cache from task to task."""
    if path not in _counters:
        _counters[path] = MergeCounter(path)
    return _counters[path]


def _count_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    count = counter(path).text
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            tokens = pa.array(map(count, part.column(2).to_pylist()), pa.int64(), size=part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), tokens], ["doc_id", "n_bytes", "n_tokens"])


def token_counts(
    docs: DataFrame, vocabulary: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row's whole text.

    vocabulary is the path of a tokenizer file that every worker can read. A null text counts as
    empty: no bytes, no tokens. Rows with a null or repeated doc_id stay as they are; an empty
    table gives no rows; other columns are ignored. over_limit is true above `limit` tokens.
    """
    ship_code(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.octet_length(text).cast("bigint").alias("n_bytes"),
        text.alias("text"),
    )
    counted = kept.mapInArrow(
        lambda batches: _count_batches(batches, vocabulary), "doc_id bigint, n_bytes bigint, n_tokens bigint"
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
