"""Words of many texts as 64-bit hashes, cut and hashed with array operations over UTF-8 bytes.

A word is a run of letters, digits and bytes of other scripts; a mark is a run of ASCII
punctuation. Latin-1 and general punctuation and ideographic spaces end words, as white space does.
A-Z and the Latin-1 capitals are lower-cased. Texts are worked on in pieces of about a megabyte, cut
between words, so memory does not depend on a text's length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
SPACE, WORD, MARK = 0, 1, 2
LOW, TITLE, UPPER, DIGITS, SAME = 1, 2, 3, 4, 5  # shapes of words

_KIND = np.full(256, MARK, np.uint8)
_KIND[:33] = _KIND[127] = SPACE
_KIND[128:] = WORD
for _run in (b"0123456789", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"):
    _KIND[list(_run)] = WORD
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64)] * 2


def _powers(n: int) -> list[np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    if len(_POWERS[0]) < n + 1:
        size = max(n, 2 * PIECE) + 1
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            _POWERS[k] = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, base, np.uint64))))
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


@dataclass
class Words:
    """Words in order: hashes, whether each is a mark, shapes (0 for marks), and words before each text."""

    hashes: np.ndarray
    marks: np.ndarray
    shapes: np.ndarray
    offsets: np.ndarray


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column's rows on end, and where each row begins; nulls are empty."""
    texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return raw, offsets.astype(np.int64) - int(offsets[0])


def _cuts(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    at, end = 0, len(raw)
    while at < end:
        stop = min(at + PIECE, end)
        while stop < end:
            # A cut is good at the beginning of a text or on white space.
            row = int(offsets[np.searchsorted(offsets, stop, "right") - 1])
            spaces = np.flatnonzero(_KIND[raw[max(at, row) : stop]] == SPACE)
            if len(spaces):
                stop = max(at, row) + int(spaces[-1]) + 1
                break
            if row > at:
                stop = row
                break
            stop = min(stop + PIECE, end)
        yield at, stop
        at = stop


def words(raw: np.ndarray, offsets: np.ndarray, marks: bool) -> Words:
    """Cut rows of UTF-8 bytes into words; with marks, marks and shapes too."""
    found: list[tuple[np.ndarray, ...]] = []
    for at, stop in _cuts(raw, offsets):
        found.append(_piece(raw[at:stop], offsets[(offsets >= at) & (offsets < stop)] - at, marks, at))
    if not found:
        empty = np.zeros(0, np.uint64)
        return Words(empty, empty.astype(bool), empty.astype(np.uint8), np.zeros(len(offsets), np.int64))
    starts, hashes, is_mark, shapes = (np.concatenate(x) for x in zip(*found, strict=True))
    return Words(hashes, is_mark, shapes, np.searchsorted(starts, offsets))


def _piece(b: np.ndarray, rows: np.ndarray, marks: bool, at: int) -> tuple[np.ndarray, ...]:
    n = len(b)
    kind = _KIND[b]
    previous = np.concatenate((b[:1] * 0, b[:-1]))
    high = b >= 0xC2
    if high.any():
        lead = np.flatnonzero(high)
        for first, second, length in ((0xC2, None, 2), (0xE2, (0x80, 0x81), 3), (0xE3, (0x80,), 3)):
            here = lead[b[lead] == first]
            here = here[here + length <= n]
            if second:
                here = here[np.isin(b[here + 1], second)]
            for k in range(length):
                kind[here + k] = SPACE
    capital = (b >= 65) & (b <= 90)
    capital_latin = (previous == 0xC3) & (b >= 0x80) & (b <= 0x9E) & (b != 0x97)
    low = b + ((capital | capital_latin) * np.uint8(32))
    if not marks:
        kind[kind == MARK] = SPACE
    edge = np.ones(n + 1, bool)
    edge[1:n] = kind[1:] != kind[:-1]
    edge[rows] = True
    edges = np.flatnonzero(edge)
    starts, ends = edges[:-1], edges[1:]
    taken = kind[starts] != SPACE
    starts, ends = starts[taken], ends[taken]
    up, down = _powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    if not marks:
        none = np.zeros(len(starts), np.uint8)
        return starts + at, hashes, none.astype(bool), none
    is_mark = kind[starts] == MARK
    caps = np.concatenate(([0], np.cumsum(capital | capital_latin)))
    digits = np.concatenate(([0], np.cumsum((b >= 48) & (b <= 57))))
    letters = np.concatenate(([0], np.cumsum((kind == WORD) & ((b & 0xC0) != 0x80))))
    n_caps, n_digits, n_letters = (x[ends] - x[starts] for x in (caps, digits, letters))
    shapes = np.where(n_digits == n_letters, DIGITS, np.where(n_caps == 0, LOW, np.where((n_caps == n_letters) & (n_caps > 1), UPPER, TITLE)))
    shapes = np.where(is_mark, 0, shapes).astype(np.uint8)
    return starts + at, hashes, is_mark, shapes
