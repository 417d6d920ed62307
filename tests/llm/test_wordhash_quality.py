import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import quality as Q
from corpusloom.llm import wordhash as W


def test_words_do_not_depend_on_place_or_piece(monkeypatch):
    texts = pa.array(["the cat THE cat!! Été été", None, "", "été «été»", "x" * 50 + " the"])
    found = W.words(*W.utf8(texts), marks=True)
    h = found.hashes.tolist()
    assert found.offsets.tolist() == [0, 7, 7, 7, 9, 11]
    assert h[0] == h[2] == h[10] and h[1] == h[3] and h[5] == h[6] == h[7] == h[8] and len(set(h)) == 5
    assert found.marks.tolist()[4] and found.shapes.tolist()[:7] == [W.LOW, W.LOW, W.UPPER, W.LOW, 0, W.TITLE, W.LOW]
    monkeypatch.setattr(W, "PIECE", 7)
    again = W.words(*W.utf8(texts), marks=True)
    assert again.hashes.tolist() == h and again.offsets.tolist() == found.offsets.tolist()
    assert W.words(*W.utf8(pa.array([], pa.string())), marks=True).offsets.tolist() == [0]
    assert W.words(*W.utf8(texts.slice(3, 1)), marks=True).hashes.tolist() == h[7:9]


def test_ftrl_is_the_published_update():
    learner, z, n = Q.Ftrl(4), np.zeros(5), np.zeros(5)
    rng = np.random.default_rng(1)
    for _ in range(40):
        at, label = np.sort(rng.choice(4, 2, replace=False)), int(rng.integers(2))
        value = rng.random(2)
        idx, x = [*at, 4], [*value, 1.0]
        w = [0.0 if abs(z[i]) <= Q.L1 else -(z[i] - np.sign(z[i]) * Q.L1) / ((Q.BETA + np.sqrt(n[i])) / Q.ALPHA + Q.L2) for i in idx]
        p = 1 / (1 + np.exp(-sum(a * b for a, b in zip(w, x))))
        for i, xi, wi in zip(idx, x, w):
            g = (p - label) * xi
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / Q.ALPHA * wi
            n[i] += g * g
        learner.learn(at, value, label)
    assert np.allclose(learner.z, z) and np.allclose(learner.n, n)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("aeioutnrs"), 5))
    good = [" ".join(word() for _ in range(int(rng.integers(5, 60)))) + "." for _ in range(300)]
    bad = [" ".join(word().upper() + "!!" for _ in range(int(rng.integers(5, 60)))) for _ in range(100)]
    rows = [(i, t, int(i < 300)) for i, t in enumerate(good + bad)]
    docs = spark.createDataFrame([(i, t, "extra") for i, t, _ in rows] + [(1000, None, "x"), (1001, "", "x"), (None, "abc def", "x"), (1, good[1], "again")], "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows] + [(5, 0, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    return docs, labels, {i: q for i, _, q in rows}


def test_held_out_accuracy_and_edges(corpus):
    docs, labels, truth = corpus
    got = Q.quality(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 80 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    empty = {r.doc_id: r.score for r in got if r.doc_id in (1000, 1001)}
    assert empty[1000] == empty[1001]


def test_bounded_sample_still_learns(corpus):
    docs, labels, truth = corpus
    got = {r.doc_id: r.predicted for r in Q.quality(docs, labels, max_rows=80).collect()}
    assert np.mean([got[i] == q for i, q in truth.items()]) > 0.85


def test_no_labels_and_no_rows(spark, corpus):
    docs, labels, _ = corpus
    got = Q.quality(docs, labels.where("false"))
    assert {r.score for r in got.collect()} == {0.5}
    assert Q.quality(docs.where("false"), labels).count() == 0
    kept = Q.good_documents(docs.where("doc_id < 400"), labels)
    assert kept.columns == docs.columns and 280 <= kept.count() <= 305
    assert docs.select(Q.fold(F.lit(None).cast("bigint")).alias("f")).first().f == 0
