"""Byte-pair merges learned where the pieces are: on executors, in one stage of tasks that add up what they count.

Each task holds a share of the distinct pieces as one array of token ids. For a merge it changes its
own pieces and tells the first task by how much that changes the counts of pairs; that task adds up
what all tell and answers with the sums, so that all have the same counts and take the same next
pair. The tasks are a barrier stage's, and talk by sockets of their own: a barrier's messages take
a second each. The driver gets the merges only.
"""

from __future__ import annotations

import heapq
import hmac
import secrets
import socket
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARE = 50_000  # pieces a task has at least, if there are so many
PATIENCE = 600  # seconds that a task waits for the others to come
SHIFT = np.int64(31)  # a pair is its first id times 2**31 plus its second


class Pieces:
    """Pieces as runs of token ids in one array, each in a place of its own that ends in zeros."""

    def __init__(self, batches: Iterator[pa.RecordBatch], letters: np.ndarray, first_id: int, vocab_size: int):
        kind = np.uint16 if max(vocab_size, first_id + len(letters)) < 1 << 16 else np.uint32
        tokens, sizes, counts = [np.zeros(0, kind)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for batch in batches:
            texts = batch.column(0).to_pylist()
            n = np.fromiter(map(len, texts), np.int64, len(texts))
            points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
            placed = np.zeros(len(points) + len(n), kind)
            placed[np.arange(len(points)) + np.repeat(np.arange(len(n)), n)] = np.searchsorted(letters, points) + first_id
            tokens.append(placed)
            sizes.append(n + 1)
            counts.append(batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64))
        self.tokens, self.counts = np.concatenate(tokens), np.concatenate(counts)
        self.starts = np.concatenate(([0], np.cumsum(np.concatenate(sizes))))
        self.dropped = 0

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        return summed(*_pairs(self.tokens, np.repeat(self.counts, np.diff(self.starts))))

    def merge(self, a: int, b: int, new: int) -> tuple[np.ndarray, np.ndarray]:
        """Put `new` for a, b wherever they follow each other, leftmost first; pairs and by how much their counts change."""
        tokens = self.tokens
        at = np.flatnonzero(tokens[:-1] == a)
        at = at[tokens[at + 1] == b]
        if a == b and len(at):
            order = np.arange(len(at))
            run = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) != 1, order, 0))
            at = at[(order - run) % 2 == 0]
        if not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        owners = np.searchsorted(self.starts, at, "right") - 1
        pieces, hits = np.unique(owners, return_counts=True)
        low, size = self.starts[pieces], self.starts[pieces + 1] - self.starts[pieces]
        index = np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())
        here = np.searchsorted(index, at)
        before, weights = tokens[index], np.repeat(self.counts[pieces], size)
        after, kept = before.copy(), np.ones(len(before), bool)
        after[here], kept[here + 1] = new, False
        after, after_weights = after[kept], weights[kept]
        # What is left of a piece goes to the beginning of its place.
        left = size - hits
        tokens[index] = 0
        tokens[np.repeat(low - np.cumsum(left) + left, left) + np.arange(left.sum())] = after
        near, near_after, there = np.zeros(len(before), bool), np.zeros(len(after), bool), here - np.arange(len(here))
        near[here] = near[here + 1] = near_after[there] = True
        near[here[here > 0] - 1] = near_after[there[there > 0] - 1] = True
        old, new_ = _pairs(before, weights, near), _pairs(after, after_weights, near_after)
        self.dropped += len(at)
        if 2 * self.dropped > len(tokens):
            self._compact()
        return summed(np.concatenate((old[0], new_[0])), np.concatenate((-old[1], new_[1])))

    def _compact(self) -> None:
        """Leave out what is free, and pieces of one token."""
        used = self.tokens != 0
        size = np.add.reduceat(used, self.starts[:-1], dtype=np.int64)
        more = size > 1
        kept = self.tokens[used & np.repeat(more, np.diff(self.starts))]
        size, self.counts = size[more], self.counts[more]
        self.starts = np.concatenate(([0], np.cumsum(size + 1)))
        self.tokens = np.zeros(self.starts[-1], kept.dtype)
        self.tokens[np.arange(len(kept)) + np.repeat(np.arange(len(size)), size)] = kept
        self.dropped = 0


def _pairs(tokens: np.ndarray, weights: np.ndarray, chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of neighbours in a piece, those that begin at chosen places only, and what each counts."""
    ok = (tokens[:-1] != 0) & (tokens[1:] != 0)
    at = np.flatnonzero(ok if chosen is None else ok & chosen[:-1])
    return (tokens[at].astype(np.int64) << SHIFT) | tokens[at + 1].astype(np.int64), weights[at]


def summed(keys: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, with its sum if that isn't 0."""
    if not len(keys):
        return keys, sums
    order = np.argsort(keys, kind="stable")
    keys, sums = keys[order], sums[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sums = np.add.reduceat(sums, first)
    return keys[first][sums != 0], sums[sums != 0]


class Talk:
    """Sums over the tasks of a barrier stage: each sends to the first one, which answers all."""

    def __init__(self, context: BarrierTaskContext):
        self.first, n_tasks = context.partitionId() == 0, len(context.getTaskInfos())
        if n_tasks == 1:
            self.links = []
            return
        server = socket.create_server(("", 0)) if self.first else None
        word = secrets.token_hex(32)
        port, word = context.allGather(f"{server.getsockname()[1]} {word}" if self.first else "")[0].split()
        if self.first:
            server.settimeout(PATIENCE)
            self.links = []
            while len(self.links) < n_tasks - 1:
                link, _ = server.accept()
                link.settimeout(PATIENCE)
                if hmac.compare_digest(_read(link, len(word)), word.encode()):
                    self.links.append(link)
            server.close()
        else:
            host = context.getTaskInfos()[0].address.rsplit(":", 1)[0].strip("[]")
            self.links = [socket.create_connection((host, int(port)), PATIENCE)]
            self.links[0].sendall(word.encode())
        for link in self.links:
            link.settimeout(None)
            link.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)

    def total(self, keys: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sums of all tasks' keys."""
        if self.first:
            for link in self.links:
                more = _receive(link)
                keys, sums = np.concatenate((keys, more[0])), np.concatenate((sums, more[1]))
            keys, sums = summed(keys, sums)
        for link in self.links:
            _send(link, keys, sums)
        return (keys, sums) if self.first else _receive(self.links[0])


def _send(link: socket.socket, keys: np.ndarray, sums: np.ndarray) -> None:
    link.sendall(struct.pack("<q", len(keys)) + keys.tobytes() + sums.tobytes())


def _receive(link: socket.socket) -> tuple[np.ndarray, np.ndarray]:
    n = struct.unpack("<q", _read(link, 8))[0]
    both = np.frombuffer(_read(link, 16 * n), np.int64)
    return both[:n], both[n:]


def _read(link: socket.socket, n: int) -> bytes:
    out, at = bytearray(n), 0
    while at < n:
        got = link.recv_into(memoryview(out)[at:])
        if not got:
            raise ConnectionError("another task ended")
        at += got
    return bytes(out)


def learn(pieces: Pieces, names: list[str], vocab_size: int, min_frequency: int, tell: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """Merges as pairs of ids, by frequency, of equals that of least ids; names are the vocabulary so far, and grow."""
    ids, merges = {t: i for i, t in enumerate(names)}, []
    sums = dict(zip(*(x.tolist() for x in tell(*pieces.pairs())), strict=True))
    heap = [(-n, pair) for pair, n in sums.items()]
    heapq.heapify(heap)
    while heap and len(ids) < vocab_size:
        n, pair = heapq.heappop(heap)
        if -n != sums[pair]:
            if sums[pair] >= min_frequency:
                heapq.heappush(heap, (-sums[pair], pair))
            continue
        if -n < min_frequency:
            break
        a, b = pair >> 31, pair & ((1 << 31) - 1)
        merges.append((a, b))
        name = names[a] + names[b]
        if ids.setdefault(name, len(ids)) == len(names):
            names.append(name)
        for changed, by in zip(*(x.tolist() for x in tell(*pieces.merge(a, b, ids[name]))), strict=True):
            sums[changed] = sums.get(changed, 0) + by
            if by > 0:
                heapq.heappush(heap, (-sums[changed], changed))
    return merges


def learn_on_executors(counts: DataFrame, n_pieces: int, names: list[str], first_id: int, vocab_size: int, min_frequency: int) -> list[tuple[int, int]]:
    """learn() over all pieces (piece, n) of a table.

    The tasks run side by side, no more than the cluster has room for: dynamic allocation can't have that.
    """
    scala = counts.sparkSession.sparkContext._jsc.sc()
    room = scala.maxNumConcurrentTasks(scala.resourceProfileManager().defaultResourceProfile())
    n_tasks = max(1, min(room, -(-n_pieces // SHARE)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = BarrierTaskContext.get()
        letters = np.array([ord(c) for c in names[first_id:]], np.uint32)
        own = Pieces(batches, letters, first_id, vocab_size)
        merges = learn(own, list(names), vocab_size, min_frequency, Talk(context).total)
        if context.partitionId() == 0:
            a, b = zip(*merges, strict=True) if merges else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(range(len(merges)), pa.int32()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], ["rank", "a", "b"])

    shares = counts.where(F.length("piece") > 1).select("piece", "n").repartition(n_tasks)
    found = shares.mapInArrow(run, "rank int, a int, b int", barrier=True).collect()
    return [(r["a"], r["b"]) for r in sorted(found, key=lambda r: r["rank"])]
