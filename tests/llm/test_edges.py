"""What every stage and operator does with null and repeated ids, empty tables, clashing names, broken and very long input."""

import random
import time

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from corpusloom.llm import decontaminate as D
from corpusloom.llm import jaccard as J
from corpusloom.llm import quality as Q
from corpusloom.llm.html_blocks import blocks
from corpusloom.llm.licenses import TEMPLATES, license_scan, template_weights
from corpusloom.llm.mixing import mix_sources, mixed_documents
from corpusloom.llm.tokencount import MergeCounter

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, row string, key string, component_id int"


def documents(spark, rows):
    return spark.createDataFrame([(*r, "en", "src0", 1, 0.5, "r", "k", 1) for r in rows], DOCS)


def ids(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in df.collect())


def test_near_dedup_keeps_each_text(spark):
    rows = [(None, "one two three four five six"), (None, "red green blue white black grey"), (7, "north south east west up down"), (7, "spring summer autumn winter rain snow"), (1, "bread milk eggs tea sugar salt"), (9, "bread milk eggs tea sugar salt"), (None, "bread milk eggs tea sugar salt"), (1, "bread milk eggs tea sugar salt")]
    docs = documents(spark, rows)
    got = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert got.columns == docs.columns
    assert ids(got) == sorted([(-1, rows[0][1]), (-1, rows[1][1]), (7, rows[2][1]), (7, rows[3][1]), (1, rows[4][1])])


def test_only_the_leak_goes(spark):
    item = "the quick brown fox jumps over the lazy dog near the old river bank"
    rows = [(None, item + " and more"), (None, "nothing of that kind is in here at all"), (5, item), (5, "another text that shares the id of a leak")]
    bench = spark.createDataFrame([(1, item, "x")], "item_id bigint, text string, cosine string")
    got = D.without_leaks(documents(spark, rows), bench)
    assert {t for _, t in ids(got)} == {rows[1][1], rows[3][1]} and got.columns == documents(spark, rows).columns


def test_short_items_count_word_by_word(spark):
    bench = spark.createDataFrame([(1, "blue paper moon"), (2, "yes"), (3, "  ")], "item_id bigint, text string")
    docs = documents(spark, [(1, "a blue, paper moon rose"), (2, "a blue moon paper"), (3, "yes we can"), (4, "Yes!"), (5, "")])
    assert sorted((r.doc_id, r.item_id) for r in D.find_leaks(docs, bench).collect()) == [(1, 1), (4, 2)]


def test_long_texts_and_items_match_in_bounded_memory():
    rng = random.Random(2)
    a, b = [rng.randrange(50) for _ in range(400)], [rng.randrange(50) for _ in range(3000)]
    table = [[0] * (len(b) + 1)]
    for x in a:
        last, row = table[-1], [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
        table.append(row)
    places = D._matched(a, b)
    assert len(places) == table[-1][-1] == D.common_subsequence(a, b) and places == sorted(set(places))
    rest = iter(a)
    assert all(any(b[j] == x for x in rest) for j in places)


def test_mixing_tells_texts_of_one_id_apart(spark):
    rows = [(None, f"w{i} " * 10) for i in range(40)] + [(3, f"v{i} " * 10) for i in range(40)]
    got = mixed_documents(documents(spark, rows), budget_share=0.5, max_epochs=1)
    n = got.count()
    assert 36 <= n <= 40 and got.columns == documents(spark, rows).columns
    assert mix_sources(documents(spark, rows), budget_share=0.5, max_epochs=1).count() == n


@pytest.mark.parametrize("empty", ["documents", "labels", "benchmark"])
def test_stages_on_empty_tables(spark, tmp_path, empty):
    tables = {
        "documents": documents(spark, [(i, f"some words of text number {i} that are here") for i in range(6)]),
        "labels": spark.createDataFrame([(i, i % 2, 0) for i in range(6)], "doc_id bigint, quality int, toxic int"),
        "benchmark": spark.createDataFrame([(1, "an item that is in no text at all")], "item_id bigint, text string"),
    }
    for name, df in tables.items():
        (df.where("false") if name == empty else df).write.parquet(str(tmp_path / f"{name}.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == tables["documents"].columns
    assert corpus_pipeline.STAGES[4][1](spark, docs, str(tmp_path)).count() == docs.count() <= 6


def test_scores_and_names(spark):
    docs = documents(spark, [(1, "a b c")])
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    kept = Q.good_documents(docs, labels)
    assert kept.columns == docs.columns and kept.first().score == 0.5
    with pytest.raises(ValueError):
        Q.quality_scores(docs, Q.Ftrl().model().tobytes())
    with pytest.raises(ValueError):
        license_scan(docs.selectExpr("'p' AS path", "text", "'x' AS license"), passed=["path", "license"])


def test_scores_are_sparse_dot_products(spark):
    """Scores against sums over a plain dictionary of the same weights."""
    import numpy as np
    import pyarrow as pa

    texts = ["A good Text of words.", "", "BAD BAD!! 12", "été " * 30]
    rng = np.random.default_rng(1)
    weights = rng.standard_normal((1 << Q.BUCKET_BITS) + 1).astype(np.float32)
    docs = documents(spark, list(enumerate(texts)))
    got = {r.doc_id: r.chance for r in Q.quality_scores(docs, weights.tobytes(), ["doc_id"], "chance").collect()}
    for i, text in enumerate(texts):
        bucket, _, value = Q.features(pa.array([text]))
        dot = float(weights[-1]) + sum(float(weights[b]) for b in bucket.tolist()) * (float(value[0]) if len(bucket) else 0.0)
        assert abs(got[i] - 1 / (1 + np.exp(-dot))) < 1e-6


@pytest.mark.parametrize("page", ["<a" * 500_000, '<a x="' * 150_000, "<a '>' " * 140_000, "<div>" * 200_000, "<div>x" * 150_000 + "</span>" * 50_000, "<b><div>" + "<i>" * 200_000 + "</b>" * 100_000, "<!--" * 250_000, "<title>" * 140_000, "<li>" * 250_000])
def test_broken_pages_take_linear_time(page):
    began = time.time()
    blocks(page)
    assert time.time() - began < 30


def test_text_of_unusual_elements():
    page = "<p>one <math><mi>x</mi></math> two<select><option>no</select><p>three<svg><circle></svg><template><p>not</template><p>four<object>five"
    assert [b.text for b in blocks(page)] == ["one x two", "three", "four", "five"] or " ".join(b.text for b in blocks(page)) == "one x two three fourfive"
    assert [b.text for b in blocks("<svg><p>an article after it</p>")] == ["an article after it"]


def test_counts_are_the_library_s_for_all_of_unicode():
    path = public_tokenizers.path("word_bpe_49k.json")
    library, own, rng = Tokenizer.from_file(path), MergeCounter(path), random.Random(9)
    for k in range(4000):
        top = (0x250, 0x3000, 0x110000)[k % 3]
        text = "".join(c for c in (rng.choice([chr(rng.randrange(1, top)), rng.choice("aAeb 's12.\n<|Σςéİ")]) for _ in range(rng.randint(0, 30))) if not 0xD800 <= ord(c) < 0xE000)
        assert own.text(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)


def test_jaccard_groups_with_hot_near_copies(spark):
    """Groups of one text's copies, whose members are near to some others only, against brute force."""
    from tests.llm.test_jaccard import plain_kept

    rng = random.Random(11)
    words = ["".join(rng.choice("aeioutnrslk") for _ in range(6)) for _ in range(700)]
    base, rows = [rng.choice(words) for _ in range(120)], []
    for i in range(150):
        base = [rng.choice(words) if rng.random() < 0.004 else w for w in base]  # a chain that drifts away
        rows.append((i, " ".join(rng.choice(words) if rng.random() < rng.choice((0, 0.03, 0.08)) else w for w in base)))
    got = J.near_copy_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted({r.component_id for r in got}) == plain_kept(rows) and len(got) == len(rows)


def test_parity_fingerprints_never_part_similar_sets():
    """No pair over the similarity has a Hamming distance over its budget."""
    import numpy as np

    rng = np.random.default_rng(4)
    for _ in range(300):
        n = int(rng.integers(1, 3000))
        both, apart = rng.integers(0, 1 << 63, n, dtype=np.uint64), int(rng.integers(0, max(1, n // 4) + 1))
        a = np.unique(np.concatenate((both, rng.integers(0, 1 << 63, apart, dtype=np.uint64))))
        b = np.unique(both)
        common = len(np.intersect1d(a, b))
        if common >= 0.8 * (len(a) + len(b) - common):
            distance = sum((int(x) ^ int(y)).bit_count() for x, y in zip(J.parities(a).view(np.uint64), J.parities(b).view(np.uint64)))
            assert distance <= (len(a) + len(b)) / 9 + 1e-9


def test_choices_between_licences(spark):
    rows = [("a/x", "Licensed under the MIT License or the Apache License, Version 2.0."), ("b/x", "# Dual licensed: licensed under the MIT License and/or licensed under the BSD 3-Clause License."), ("c/x", "He studied at MIT or at another school.")]
    got = {r.path: r.license for r in license_scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {"a/x": "Apache-2.0 AND MIT", "b/x": "BSD-3-Clause AND MIT", "c/x": None}


def test_licence_cosines_are_the_plain_ones(spark):
    import math
    import re
    from collections import Counter

    rows, idf, other = template_weights(TEMPLATES)
    from corpusloom.llm.licenses import STOP_WORDS

    def plain(line):
        words = Counter(w for w in re.findall("[a-z0-9]+", line.lower()) if w not in STOP_WORDS)
        length = math.sqrt(sum((n * idf.get(w, other)) ** 2 for w, n in words.items()))
        dots = Counter()
        for t, name, w, weight in rows:
            dots[t, name] += words.get(w, 0) * idf.get(w, other) * weight
        return max((round(d / length, 6), name) for (_, name), d in dots.items())

    rng = random.Random(3)
    lines = []
    for notices in TEMPLATES.values():
        for notice in notices:
            words = notice.split()
            lines += [" ".join(w for w in words if rng.random() > p) or "x" for p in (0, 0.1, 0.3)] + [notice + " extra words"]
    table = spark.createDataFrame([(f"d{i}/f", line) for i, line in enumerate(lines)], "path string, text string")
    got = {r.path: (r.license, r.cosine) for r in license_scan(table).collect()}
    for i, line in enumerate(lines):
        cosine, name = plain(line)
        if cosine >= 0.8:
            assert got[f"d{i}/f"][1] >= cosine - 1e-6 and name in got[f"d{i}/f"][0], line
