import random

import pytest

from corpusloom.llm import simhash as S
from corpusloom.llm.common import signed
from corpusloom.llm.components import connected_components
from corpusloom.llm.sharding import byte_shards


def reach(n, edges):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(x) for x in range(n)]


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(100), rng.randrange(100)) for _ in range(60)] + [(170, 170)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges + edges[:5], "a bigint, b bigint")).collect()}
    want = reach(200, edges)
    assert all(got.get(x, x) == want[x] for x in range(200))
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize(("limit", "segments", "most"), [(1024, 5, 2), (3, 5, 2), (1024, 3, 2), (4, 9, 3), (1024, 5, 1), (5, 5, 0)])
def test_links_are_all_within_the_distance(spark, limit, segments, most):
    rng = random.Random(2)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for p in list(prints)[:25]:
        for _ in range(8):
            prints.add(p)
            for bit in rng.sample(range(64), rng.randint(1, 3)):
                p ^= 1 << bit
    prints = sorted(prints)
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp bigint")
    edges = S.similar_fingerprints(df, most, segments, limit)
    place = {signed(p): i for i, p in enumerate(prints)}
    pairs = [(place[r.a], place[r.b]) for r in edges.collect()]
    assert all((prints[a] ^ prints[b]).bit_count() <= most for a, b in pairs)
    true = [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= most]
    assert reach(len(prints), pairs) == reach(len(prints), true)


def plain_fingerprint(text):
    import xxhash

    words = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_groups_of_texts(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeÉ") for _ in range(4)) for _ in range(200)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 80))) for _ in range(120)]
    texts += [texts[i] for i in range(20)] * 3 + [texts[5].upper().replace("É", "É") + "\x0b", None, "", " \n", "A"]
    long = " ".join(rng.choice(words) for _ in range(60_000))
    texts += [long, long + " more", long.replace("abcd", "abce")]
    rows = [(i + 10, t, "c") for i, t in enumerate(texts)] + [(10, texts[0], "again"), (None, texts[1], "c")]
    got = S.near_duplicate_groups(spark.createDataFrame(rows, "doc_id bigint, text string, fp string"), bucket_limit=4).collect()
    prints = [plain_fingerprint(t) for _, t, _ in rows]
    assert sorted((r.doc_id or -1, r.fp % 2**64) for r in got) == sorted((d or -1, p) for (d, _, _), p in zip(rows, prints))
    close = [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2]
    root = reach(len(rows), close)
    least = {}
    for (d, _, _), r in zip(rows, root):
        least[r] = min(least.get(r, 10**9), d if d is not None else 10**9)
    want = {(d, prints[i]): least[root[i]] for i, (d, _, _) in enumerate(rows)}
    assert all(r.component_id == want[r.doc_id, r.fp % 2**64] for r in got)


def test_one_stays(spark):
    rows = [(1, "a b c d e", "x"), (2, "a b c d e", "y"), (1, "a b c d e", "z"), (3, "f g h i j k", "x"), (None, "l m n o p", "x"), (None, "a b c d e", "x")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, component_id string")
    kept = S.keep_one_of_each_group(table)
    assert kept.columns == table.columns
    assert sorted((r.doc_id or 0, r.text[0]) for r in kept.collect()) in ([(0, "l"), (1, "a"), (3, "f")], [(0, "a"), (1, "a"), (3, "f")])
    assert S.keep_one_of_each_group(table.where("false")).count() == 0


@pytest.mark.parametrize("n", [0, 1, 30, 700])
def test_shards(spark, n):
    rng = random.Random(n)
    rows = [(rng.randrange(1000), rng.choice(["é" * rng.randrange(300), None, ""]), "x") for _ in range(n)] + [(None, "abc", "x")] * (n > 1) + [(7, "same", "x")] * (n // 2)
    got = byte_shards(spark.createDataFrame(rows, "doc_id bigint, text string, shard string")).collect()
    size = lambda t: len((t or "").encode()) + 8
    assert sorted((r.doc_id or -1, r.size) for r in got) == sorted((d or -1, size(t)) for d, t, _ in rows)
    total, largest = sum(r.size for r in got), max((r.size for r in got), default=0)
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [(r.doc_id if r.doc_id is not None else -1) for r in order] == sorted((r.doc_id if r.doc_id is not None else -1) for r in got)
    before = 0
    for r in order:  # the middle of each row decides
        assert r.shard == min(23, (2 * before + r.size) * 24 // (2 * total)) and r.law == "bytes" and r.grown_shard is None
        before += r.size
    for s in {r.shard for r in got}:
        own = [r for r in got if r.shard == s]
        assert sorted(r.slot for r in own) == list(range(len(own))) and abs(sum(r.size for r in own) - total / 24) <= largest


def test_few_edges_take_one_round_in_few_parts(spark, monkeypatch):
    """Of an edge list that is in one part, the first round of stars changes nothing, however many parts a shuffle has."""
    from pyspark.sql import functions as F

    from corpusloom.llm import common, components

    rounds, star = [], components._small_star
    monkeypatch.setattr(components, "_small_star", lambda edges: rounds.append(edges) or star(edges))
    held = {"spark.sql.shuffle.partitions": "31", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        edges = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1100)] + [(2002, 2001), (2002, 2003)]
        got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
        assert got == {**dict.fromkeys(range(301), 0), **dict.fromkeys(range(1000, 1100), 1000), **dict.fromkeys(range(2001, 2004), 2001)}
        assert len(rounds) == 1
        words = spark.createDataFrame([("b", "c"), ("a", "b"), ("x", "y")], "a string, b string")
        assert {r.node: r.root for r in components.connected_components(words).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
        rows = spark.range(500).groupBy((F.col("id") % 100).alias("k")).count()
        small, found = common.cut_small(rows, total=F.sum("k"))
        assert (small.count(), found, small.rdd.getNumPartitions()) == (100, {"n": 100, "total": 4950}, 1)
        assert common.cut_small(rows, 2)[0].rdd.getNumPartitions() == 31
        assert common.cut_small(rows.where("false"))[1]["n"] == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
