"""Ogg: texts stored as 8-bit sample streams, and a reader that checks, demultiplexes and times them.

Cost at scale: one narrow scan, no shuffle; a task holds one text's payload and media at a time.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship_code

RATE = 8000  # samples a second
SAMPLES = 4096  # of a packet
SEGMENTS = 255  # of a page at most
UNIT = 64  # payloads are padded to a multiple of this
CONTINUED, FIRST, LAST = 1, 2, 4
HEADER = struct.Struct("<4sBBqIIIB")
ROWS = 64  # texts decoded at once

_FLIPPED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def page_checksum(page: bytes) -> int:
    """The Ogg CRC of a page whose checksum field is zero.

    Ogg's polynomial is zlib's with the bits in the other order and no inversion, so zlib runs over
    bit-reversed bytes from an undone start value and the result is reversed again.
    """
    crc = zlib.crc32(page.translate(_FLIPPED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_FLIPPED), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = HEADER.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    crc = page_checksum(head + body)
    return head[:22] + crc.to_bytes(4, "little") + head[26:] + body


def stream_pages(serial: int, packets: list[tuple[bytes, int]]) -> list[tuple[int, bytes]]:
    """(granule, page) in order of one logical stream of (packet, granule at its end).

    The first packet has a page of its own. Packets run on over pages; a page on which none ends
    has granule -1.
    """
    segments = []  # (length, granule if the packet ends here)
    for data, granule in packets:
        full, rest = divmod(len(data), 255)
        segments += [(255, None)] * full + [(rest, granule)]
    body, pages, at, offset, inside = b"".join(d for d, _ in packets), [], 0, 0, False
    first = len(packets[0][0]) // 255 + 1
    while at < len(segments):
        part = segments[at : first if at < first else at + SEGMENTS][:SEGMENTS]
        lacing = bytes(n for n, _ in part)
        ended = [g for _, g in part if g is not None]
        flags = CONTINUED * inside | FIRST * (at == 0) | LAST * (at + len(part) == len(segments))
        size = sum(lacing)
        pages.append((ended[-1] if ended else -1, _page(flags, ended[-1] if ended else -1, serial, len(pages), lacing, body[offset : offset + size])))
        at, offset, inside = at + len(part), offset + size, part[-1][1] is None
    return pages


@dataclass
class Stream:
    """One logical stream: packets with the granule of the page they end on, where they are its last."""

    serial: int
    packets: list[bytes] = field(default_factory=list)
    granules: list[int | None] = field(default_factory=list)
    pages: int = 0
    lost: int = 0  # pages missing by their sequence numbers
    repeated: int = 0  # pages left out, as they or later ones were there before
    ended: bool = False
    open: bytearray | None = None
    number: int = -1

    @property
    def granule(self) -> int:
        return max((g for g in self.granules if g is not None), default=0)


@dataclass
class Media:
    streams: dict[int, Stream]
    pages: int
    damaged: int  # bytes skipped, for a wrong checksum, a cut page or no capture pattern


def read_ogg(data: bytes) -> Media:
    """Verify, demultiplex and reassemble an Ogg file.

    Pages with a wrong checksum are skipped to the next capture pattern; packets that lack a page
    are dropped; of pages that come again, or late, only the first in order counts. A stream that
    begins anew once it has ended goes on with its packets. An empty or foreign file gives no streams.
    """
    streams: dict[int, Stream] = {}
    at = pages = damaged = 0
    while at < len(data):
        size = 0
        if data[at : at + 4] == b"OggS" and at + HEADER.size <= len(data):
            _, version, flags, granule, serial, number, crc, count = HEADER.unpack_from(data, at)
            lacing = data[at + HEADER.size : at + HEADER.size + count]
            size = HEADER.size + count + sum(lacing)
            page = data[at : at + size]
            if version or len(page) < size or page_checksum(page[:22] + bytes(4) + page[26:]) != crc:
                size = 0
        if not size:
            found = data.find(b"OggS", at + 1)
            damaged += (found if found >= 0 else len(data)) - at
            at = found if found >= 0 else len(data)
            continue
        stream = streams.setdefault(serial, Stream(serial))
        pages += 1
        at += size
        if stream.ended and flags & FIRST:
            stream.number, stream.open = number - 1, None
        if number <= stream.number:
            stream.repeated += 1
            continue
        if number != stream.number + 1:
            stream.lost += max(0, number - stream.number - 1)
            stream.open = None
        if not flags & CONTINUED:
            stream.open = bytearray()
        offset = HEADER.size + count
        done = len(stream.packets)
        for length in lacing:
            if stream.open is not None:
                stream.open += page[offset : offset + length]
            offset += length
            if length < 255:
                if stream.open is not None:
                    stream.packets.append(bytes(stream.open))
                    stream.granules.append(None)
                stream.open = bytearray()
        if granule >= 0 and len(stream.packets) > done:
            stream.granules[-1] = granule
        stream.number, stream.ended = number, bool(flags & LAST)
        stream.pages += 1
    return Media(streams, pages, damaged)


def clock(ident: bytes) -> tuple[int, int, int] | None:
    """(granules a second, granules before time 0, bytes a granule or 0 if they vary) by a stream's first packet; None for unknown codecs.

    Fixed values: the first packets' magic bytes and where they hold a rate, by each codec's mapping.
    """
    if ident.startswith(b"PCM     ") and len(ident) >= 22:
        return int.from_bytes(ident[16:20], "big"), 0, ident[20] * ident[21] // 8
    if ident.startswith(b"CRC32   "):
        return RATE, 0, 0
    if ident.startswith(b"OpusHead") and len(ident) >= 12:
        return 48_000, int.from_bytes(ident[10:12], "little"), 0
    if ident.startswith(b"\x01vorbis") and len(ident) >= 16:
        return int.from_bytes(ident[12:16], "little"), 0, 0
    if ident.startswith(b"Speex   ") and len(ident) >= 40:
        return int.from_bytes(ident[36:40], "little"), 0, 0
    return None


def packet_times(stream: Stream) -> tuple[list[int | None], list[float | None]]:
    """(granules, seconds) at each packet's end.

    A page gives the granule of the last packet that ends on it. Packets before that one on the same
    page have theirs by its size where samples have one size, else none.
    """
    granules, known = list(stream.granules), clock(stream.packets[0]) if stream.packets else None
    rate, skip, size = known or (0, 0, 0)
    for k in range(len(granules) - 2, -1, -1):
        if granules[k] is None and granules[k + 1] is not None and size:
            granules[k] = granules[k + 1] - len(stream.packets[k + 1]) // size
    return granules, [None if g is None or not rate else max(0, g - skip) / rate for g in granules]


def encode(payload: bytes) -> bytes:
    """Payload bytes as unsigned 8-bit mono samples in one stream, and their packets' CRCs in another.

    The serial numbers come from the payload, so equal payloads give equal files. The granule is
    the number of samples so far.
    """
    serial = zlib.crc32(payload) & 0x7FFFFFFE
    ident = b"PCM     " + struct.pack(">HHIIBBHI", 0, 0, 1, RATE, 8, 1, SAMPLES, 0)
    parts = [payload[i : i + SAMPLES] for i in range(0, len(payload), SAMPLES)]
    ends = [min(len(payload), i + SAMPLES) for i in range(0, len(payload), SAMPLES)]
    sound = stream_pages(serial, [(ident, 0), *zip(parts, ends, strict=True)])
    checks = [(struct.pack("<I", zlib.crc32(p)), e) for p, e in zip(parts, ends, strict=True)]
    sums = stream_pages(serial + 1, [(b"CRC32   " + struct.pack("<I", len(parts)), 0), *checks])
    # Both streams begin before either goes on; then pages follow in order of time.
    timed = []
    for pages in (sound, sums):
        now = 0
        for granule, page in pages[1:]:
            now = max(now, granule)
            timed.append((now, page))
    timed.sort(key=lambda x: x[0])  # stable: a stream's pages stay in order
    return b"".join([sound[0][1], sums[0][1], *(page for _, page in timed)])


def decode(media: bytes) -> tuple[bytes, Media, Stream]:
    """The payload of a file that encode() made; raises ValueError where a check fails."""
    read = read_ogg(media)
    sound = next((s for s in read.streams.values() if s.packets[:1] and s.packets[0].startswith(b"PCM     ")), None)
    sums = next((s for s in read.streams.values() if s.packets[:1] and s.packets[0].startswith(b"CRC32   ")), None)
    if read.damaged or sound is None or sums is None or any(s.lost or s.repeated or not s.ended for s in (sound, sums)):
        raise ValueError("damaged Ogg file")
    if [struct.pack("<I", zlib.crc32(p)) for p in sound.packets[1:]] != sums.packets[1:]:
        raise ValueError("samples differ from their checksums")
    payload = b"".join(sound.packets[1:])
    if len(payload) != sound.granule:
        raise ValueError("samples and granule position differ")
    return payload, read, sound


def features(payload: bytes, media: Media, sound: Stream) -> str:
    """What the streams hold, the time of the last granule, and the samples' mean and RMS."""
    samples = np.frombuffer(payload, np.uint8).astype(np.int64)
    mean, power = int(samples.sum()) / len(samples), int((samples * samples).sum()) / len(samples)
    packets = sum(len(s.packets) for s in media.streams.values())
    return (
        f"ogg;streams={len(media.streams)};pages={media.pages};packets={packets};granule={sound.granule};"
        f"seconds={sound.granule / RATE:.6f};mean={mean:.6f};rms={power**0.5:.6f}"
    )


def payload_of(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), data + bytes(-len(data) % UNIT or UNIT * (not data))


SCHEMA = (
    "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, "
    "media_bytes bigint, media_sha256 string, feature string"
)


def _digest(text: str | None) -> tuple:
    size, payload = payload_of(text)
    media = encode(payload)
    back, read, sound = decode(media)
    return (
        size, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]),
        len(media), hashlib.sha256(media).hexdigest(), features(back, read, sound),
    )


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            rows = [_digest(text.as_py()) for text in part.column(1)]
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], names)


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every whole text as an Ogg file, read the file back and describe it; a row a row.

    The payload is the text's UTF-8 bytes with bytes 0 up to a positive multiple of 64; a null text
    counts as empty. Equal texts give equal values. Rows with a null or repeated doc_id stay; an
    empty table gives no rows; other columns are ignored. A file that doesn't read back whole fails
    the query.
    """
    ship_code(docs.sparkSession)
    kept = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return kept.mapInArrow(_digest_batches, SCHEMA)


def _media_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(batch.num_rows):
            part = batch.slice(at, 1)
            media = encode(payload_of(part.column(1)[0].as_py())[1])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([media], pa.binary())], ["doc_id", "media"])


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, media): every whole text as an Ogg file."""
    ship_code(docs.sparkSession)
    kept = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return kept.mapInArrow(_media_batches, "doc_id bigint, media binary")


def _packet_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "serial", "packet_no", "packet", "granule", "seconds"]
    for batch in batches:
        for at in range(batch.num_rows):
            key, data = batch.column(0)[at].as_py(), batch.column(1)[at].as_py()
            for s in read_ogg(data or b"").streams.values():
                n = len(s.packets)
                granules, times = packet_times(s)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * n, pa.int64()), pa.array([s.serial] * n, pa.int64()), pa.array(range(n), pa.int64()),
                     pa.array(s.packets, pa.binary()), pa.array(granules, pa.int64()), pa.array(times, pa.float64())], names,
                )


def media_packets(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """The packets of every logical stream, with granule and seconds at their ends where these follow from the pages.

    Seconds are by the rate in the stream's first packet, null for unknown codecs. Damaged pages and packets that lack one are left out; null, empty or foreign files give no rows.
    """
    ship_code(media.sparkSession)
    kept = media.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(media_col).alias("media"))
    schema = "doc_id bigint, serial bigint, packet_no bigint, packet binary, granule bigint, seconds double"
    return kept.mapInArrow(_packet_batches, schema)
