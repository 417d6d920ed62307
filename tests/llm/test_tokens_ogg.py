import random
import struct
import zlib

import pytest

from corpusloom.llm import ogg as O
from corpusloom.llm.catalog import vocabulary_path
from corpusloom.llm.tokencount import MergeCounter, token_counts

EDGES = ["", " ", "a", "<|endoftext|>", "a<|startoftext|>b<|endoftext|><|endoftext|>", "ΑΣ ΣΑΣ.", "I'LL we'Re X'S", "a" * 5000, "É İ ß ﬁ \x1c\x85 x", "😀👍🏽 中文 कि"]


def test_counts_are_the_librarys(spark):
    from tokenizers import Tokenizer

    rng = random.Random(1)
    alphabet = "abcxyzABC019 \n\t'.,!?#$%é É ß İ Σσς कि \x1c\x1f\x85  中文 😀½²Ⅷǅ"
    texts = EDGES + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    library = Tokenizer.from_file(vocabulary_path())
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    counter = MergeCounter(vocabulary_path())
    assert [counter.text(t) for t in texts] == want
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(None, None, 0), (0, texts[0], 0)]
    got = token_counts(spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int"), vocabulary_path(), limit=20).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].n_tokens == n and by[i].n_bytes == len(texts[i].encode()) and by[i].over_limit == (n > 20) for i, n in enumerate(want))
    assert (by[None].n_tokens, by[None].n_bytes) == (0, 0)
    assert token_counts(spark.createDataFrame([], "doc_id bigint, text string"), vocabulary_path()).count() == 0


def slow_crc(data):
    crc = 0
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 1 << 31 else crc << 1) & 0xFFFFFFFF
    return crc


@pytest.mark.parametrize("size", [0, 1, 64, 255, 256, 4096, 65_025, 300_000])
def test_round_trip(size):
    data = random.Random(size).randbytes(size)
    payload = data + bytes(-size % 64 or 64 * (not size))
    media = O.encode(payload)
    back, read, sound = O.decode(media)
    assert back == payload and sound.granule == len(payload) and len(read.streams) == 2 and not read.damaged
    assert O.encode(payload) == media
    at = 0
    for _ in range(3 if size < 1000 else 1):  # the checksum is the polynomial's
        n = media[at + 26]
        page = media[at : at + 27 + n + sum(media[at + 27 : at + 27 + n])]
        assert slow_crc(page[:22] + bytes(4) + page[26:]) == struct.unpack("<I", page[22:26])[0]
        at += len(page)


def test_damage_is_seen():
    media = bytearray(O.encode(bytes(range(256)) * 1000))
    media[len(media) // 2] ^= 1
    read = O.read_ogg(bytes(media))
    assert read.damaged and any(s.lost for s in read.streams.values())
    with pytest.raises(ValueError):
        O.decode(bytes(media))
    assert O.read_ogg(b"").streams == {} and O.read_ogg(b"no ogg here").damaged == 11
    cut = O.read_ogg(O.encode(bytes(64))[:-3])
    assert cut.damaged


def test_packets_of_full_segments():
    packets = [(b"a" * 255, 255), (b"", 255), (b"b" * 510, 765), (b"c" * 140_000, 140_765)]
    pages = O.stream_pages(9, packets)
    stream = O.read_ogg(b"".join(p for _, p in pages)).streams[9]
    assert stream.packets == [p for p, _ in packets] and stream.granules[-1] == 140_765 and -1 in [g for g, _ in pages]


def test_repeated_pages_and_packet_times():
    data = random.Random(5).randbytes(300_032)
    media = O.encode(data)
    want, pages, at = O.read_ogg(media), [], 0
    while at < len(media):
        n = media[at + 26]
        size = 27 + n + sum(media[at + 27 : at + 27 + n])
        pages.append(media[at : at + size])
        at += size
    again = O.read_ogg(b"".join(p for k, page in enumerate(pages) for p in ([page, page] if k in (0, 3, len(pages) - 2) else [page])))
    assert [s.packets for s in again.streams.values()] == [s.packets for s in want.streams.values()] and not any(s.lost for s in again.streams.values())
    assert sum(s.repeated for s in again.streams.values()) == 3
    sound = next(iter(want.streams.values()))
    granules, seconds = O.packet_times(sound)
    ends = [sum(map(len, sound.packets[1 : k + 1])) for k in range(len(sound.packets))]
    assert granules == ends and seconds == [e / O.RATE for e in ends] and None in sound.granules
    twice = O.read_ogg(media + media)  # a chain of two files
    assert next(iter(twice.streams.values())).packets == sound.packets * 2
    assert O.clock(b"OpusHead\x01\x02\x38\x01" + bytes(7)) == (48_000, 312, 0) and O.clock(b"\x01vorbis" + bytes(4) + b"\x02" + (44_100).to_bytes(4, "little")) == (44_100, 0, 0)
    assert O.clock(b"theora?") is None


def test_digests(spark):
    rows = [(1, "é" * 40, "x"), (2, None, "x"), (3, "", "x"), (1, "é" * 40, "y"), (None, "long " * 50_000, "z")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, feature string")
    got = O.media_digests(table).collect()
    assert len(got) == 5
    by = {r.doc_id: r for r in got}
    assert (by[1].n_bytes, by[1].payload_bytes) == (80, 128) and by[2][1:] == by[3][1:] and by[2].payload_bytes == 64
    assert by[1].tail_crc32 == zlib.crc32(("é" * 40).encode()[64:] + bytes(48)) and by[None].n_bytes == 250_000
    packets = O.media_packets(O.store_media(table.where("doc_id = 1"))).collect()
    assert len(packets) == 8 and {r.seconds for r in packets} == {0.0, 128 / 8000}
    assert O.media_digests(table.where("false")).count() == 0
