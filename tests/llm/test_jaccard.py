import random
from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from corpusloom.llm import jaccard as J


def plain_set(text, k=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def plain_kept(rows, similarity=0.8):
    sets, root = {d: plain_set(t) for d, t in rows}, {d: d for d, _ in rows}
    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if (len(x & y) >= similarity * len(x | y)) and root[a] != root[b]:
            low, high = sorted((root[a], root[b]))
            root = {d: low if r == high else r for d, r in root.items()}
    return sorted(set(root.values()))


def near_copies(n_others=60, n_hot=0):
    rng = random.Random(7)
    words = ["".join(rng.choice("aeioutnrslk") for _ in range(rng.randint(3, 8))) for _ in range(900)]
    rows, number = [(500_000, ""), (500_001, None), (500_002, "  "), (500_003, "two words"), (500_004, "Two  words")], 0
    hot = [rng.choice(words) for _ in range(150)]
    for k in range(n_others + n_hot):
        base = [rng.choice(words) for _ in range(rng.randint(8, 250))] if k < n_others else hot
        for _ in range(4 if k < n_others else 1):
            copy = [rng.choice(words) if rng.random() < rng.choice((0, 0.005, 0.02, 0.04)) else w for w in base]
            rows.append((number, " ".join(copy)))
            number += 1
    return rows


@pytest.mark.parametrize("n_others, n_hot", [(60, 0), (10, 150)])
def test_near_dedup_stage_is_five_word_jaccard(spark, n_others, n_hot):
    rows = near_copies(n_others, n_hot)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()) == plain_kept(rows)


def test_no_documents_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b"), (3, "a b"), (None, "c d")], "doc_id bigint, text string")
    assert sorted(str(r.doc_id) for r in J.keep_one_of_each_group(docs).collect()) == ["3", "None"]
    assert J.keep_one_of_each_group(docs.where("false")).count() == 0


@pytest.mark.parametrize("n", [4, 8, 40, 400])
def test_sets_of_the_similarity_share_a_simhash_key(n):
    """Pairs at 0.8, in sets of few and of many shingles, have equal keys, and SimHash bits within the radius."""
    rng = np.random.default_rng(n)
    only = n // 4
    rows = rng.integers(0, 1 << 63, (400, n + only), dtype=np.uint64) << np.uint64(1)
    rows |= rng.integers(0, 2, rows.shape, dtype=np.uint64)
    a, b = [np.unique(r[: n + only // 2]) for r in rows], [np.unique(np.delete(r, slice(n, n + only // 2))) for r in rows]
    (keys_a, bits_a), (keys_b, bits_b) = J.simhash_keys(a), J.simhash_keys(b)
    assert (keys_a == keys_b).any(axis=1).all() and (keys_a == keys_b).mean() > 0.12
    assert np.bitwise_count(bits_a ^ bits_b).sum(axis=1).max() <= J.radius(0.8)
    assert (keys_a[1:] == keys_a[:-1]).mean() < 0.001


@pytest.mark.parametrize("limit", [8, 1000])
def test_entries_near_another_of_their_key(limit):
    rng = np.random.default_rng(3)
    entries = np.zeros(600, J.KEY)
    entries["key"] = np.sort(np.repeat(np.arange(120), rng.multinomial(600, np.r_[0.1, np.full(119, 0.9 / 119)])))
    entries["set"], entries["low"], entries["high"] = np.arange(600), rng.integers(0, 1 << 63, 600), rng.integers(0, 1 << 63, 600)
    prints = [int(e["low"]) | int(e["high"]) << 64 for e in entries]
    want = set()
    for i, j in combinations(range(600), 2):
        if entries["key"][i] == entries["key"][j] and ((prints[i] ^ prints[j]).bit_count() <= 58 or (entries["key"] == entries["key"][i]).sum() > limit):
            want |= {i, j}
    assert set(J.near_entries(entries, 58, limit)["set"].tolist()) == want and 0 < len(want) < 600
    assert len(J.near_entries(entries[:0], 58)) == 0
