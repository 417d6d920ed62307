import random

import numpy as np
import pyarrow as pa

from corpusloom.llm import decontaminate as D


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
    return row[-1]


def test_subsequences():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 20))] for _ in range(2))
        assert D.common_subsequence(a, b) == lcs(a, b) == len(D._matched(a, b))
        assert [b[j] for j in D._matched(a, b)] == sorted([b[j] for j in D._matched(a, b)], key=lambda _: 0)


def test_singular_vectors_of_a_low_rank_matrix():
    rng = np.random.default_rng(3)
    a = rng.standard_normal((200, 6)) @ rng.standard_normal((6, 50))
    test = rng.standard_normal((50, 12))
    scaled = D.singular_vectors(a.T @ (a @ test), test, 6)
    _, s, vt = np.linalg.svd(a, full_matrices=False)
    want = vt[:6].T / s[:6]
    assert np.allclose(np.abs(scaled.T @ want), np.diag(1 / s[:6] ** 2), atol=1e-6)
    assert not D.singular_vectors(np.zeros((5, 3)), np.ones((5, 3)), 2).any()


def corpus():
    rng = random.Random(4)
    words = ["".join(rng.choice("aeioutnrslk") for _ in range(rng.randint(2, 8))) for _ in range(1500)]
    some = lambda n: [rng.choice(words[:40]) if rng.random() < 0.4 else rng.choice(words) for _ in range(n)]
    items = [(i, some(rng.randint(16, 60))) for i in range(30)] + [(90, some(130)), (91, ["one", "two"])]
    docs, truth = [], set()
    for d in range(240):
        text = some(rng.randint(20, 300))
        if d % 4 == 0:
            i, item = items[d // 4 % 31]
            at = rng.randrange(len(text))
            leak = item if d % 8 else [rng.choice(words) if rng.random() < 0.15 else w for w in item]
            text[at:at] = [w.upper() + "," for w in leak] if d % 12 == 0 else leak
            truth.add((d, i))
        docs.append((d, " ".join(text), "x"))
    return docs, [(i, " ".join(t)) for i, t in items], truth


def test_leaks_and_nothing_else(spark):
    docs, items, truth = corpus()
    rows = docs + [(500, None, "x"), (501, "", "x"), (0, docs[0][1], "again"), (None, docs[4][1], "x"), (502, "w " * 60_000 + docs[8][1], "long")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, cosine string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = D.find_leaks(table, bench)
    pairs = {(r.doc_id, r.item_id) for r in got.collect()}
    assert len(truth - pairs) <= 1, truth - pairs
    extra = pairs - truth
    assert extra == {(None, 1), (502, 2)}
    small = D.find_leaks(table, bench, item_block=8)
    assert {(r.doc_id, r.item_id) for r in small.collect()} == pairs
    clean = D.without_leaks(table, bench)
    assert clean.columns == table.columns and {r.doc_id for r in clean.collect()} == {r[0] for r in rows} - {d for d, _ in pairs}


def test_brute_force_finds_no_more(spark):
    """Every pair that the checks accept with any window, near or not, is found."""
    docs, items, _ = corpus()
    table = spark.createDataFrame(docs, "doc_id bigint, text string, x string")
    got = {(r.doc_id, r.item_id) for r in D.find_leaks(table, spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    checks, brute = D.Checks(), set()
    for d, text, _ in docs:
        words = text.lower().replace(",", " ").split()
        for i, item in items:
            own = item.split()
            if len(own) < checks.min_words:
                continue
            ids = {w: n + 1 for n, w in enumerate(dict.fromkeys(words + own))}
            whole = D.Item(i, [ids[w] for w in own], [ids[w] for w in own[-max(3, len(own) // 4) :]])
            n = len(own)
            for at in range(0, len(words), D.STEP):
                if D.verify(whole, [ids[w] for w in words[max(0, at - n) : at + 2 * D.STEP + n]], checks):
                    brute.add((d, i))
                    break
    assert len(brute - got) <= 0.1 * len(brute) and got <= brute


def test_found_leaks_hold_by_plain_rules(spark):
    """Shares and places of every leak found, recomputed with the plain table of subsequences alone."""
    docs, items, _ = corpus()
    table = spark.createDataFrame(docs, "doc_id bigint, text string, x string")
    got = D.find_leaks(table, spark.createDataFrame(items, "item_id bigint, text string")).collect()
    text, item, checks = {d: t.lower().replace(",", " ").split() for d, t, _ in docs}, {i: t.split() for i, t in items}, D.Checks()
    assert got
    for r in got:
        own, all_ = item[r.item_id], text[r.doc_id]
        span = all_[r.first_word : r.first_word + r.n_words]
        assert len(span) == r.n_words and {span[0], span[-1]} <= set(own)
        assert lcs(own, span) >= r.lcs_share * len(own) - 1e-9 and r.lcs_share >= checks.lcs and r.lcs_share * len(own) >= checks.density * r.n_words - 1e-9
        answer = own[-max(3, len(own) // 4) :]
        near = lcs(answer, all_[r.first_word : r.first_word + r.n_words + len(answer)]) / len(answer)
        assert near >= r.answer_share - 1e-9 >= checks.answer - 1e-9


def test_a_leak_in_a_third_of_all_rows(spark):
    docs, items, truth = corpus()
    hot = [(1000 + k, docs[4][1]) for k in range(len(docs) // 2)]
    table = spark.createDataFrame([(d, t) for d, t, _ in docs] + hot, "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in D.find_leaks(table, spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert len(truth - got) <= 1, truth - got
    assert got - truth == {(d, 1) for d, _ in hot}


def test_a_table_of_one_document(spark):
    docs, items, _ = corpus()
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for number, item in ((4, 1), (8, 2)):
        table = spark.createDataFrame([(number, docs[number][1])], "doc_id bigint, text string")
        assert [(r.doc_id, r.item_id) for r in D.find_leaks(table, bench).collect()] == [(number, item)]


def test_runs_of_words_are_looked_at_without_weight():
    """Verbatim items are found even in a space where no word has a vector."""
    docs, items, truth = corpus()
    checks = D.Checks()
    index = D.build_index([(i, t, None) for i, t in items], np.zeros((D.BUCKETS, D.RANK)), checks)
    found = {(docs[row][0], item) for row, item, *_ in D._look_up(pa.array([t for _, t, _ in docs]), index, checks)}
    assert found <= truth and {(d, i) for d, i in truth if d % 8} <= found


def test_answers(spark):
    docs, _, _ = corpus()
    question = "what is the name of the river that runs through the old town of the north"
    bench = spark.createDataFrame([(1, question, "long blue danube water")], "item_id bigint, text string, answer string")
    filler = spark.createDataFrame([(i, t) for i, t, _ in docs] + [(900, docs[1][1] + " " + question + " long blue danube water"), (901, question + " " + docs[1][1])], "doc_id bigint, text string")
    assert {r.doc_id for r in D.find_leaks(filler, bench, answer_col="answer").collect()} == {900}
    assert {900, 901} <= {r.doc_id for r in D.find_leaks(filler, bench).collect()}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, "a b c d e f g")], "item_id bigint, text string")
    assert D.find_leaks(docs.where("false"), bench).count() == 0
    assert D.find_leaks(docs, bench.where("false")).count() == 0
    assert D.without_leaks(docs, bench.where("false")).count() == 1


def test_recall_does_not_fall_with_the_vocabulary(spark):
    """Far more words than buckets: planted items, as they are or with a tenth of their words replaced, are found."""
    rng = np.random.default_rng(8)
    share = np.cumsum(1 / np.arange(1, 200_001))
    draw = lambda n: np.searchsorted(share / share[-1], rng.random(n))
    named = lambda ids: " ".join(f"w{i:x}q" for i in ids)
    items, docs, truth = [draw(rng.integers(24, 60)) for _ in range(60)], [], set()
    for d in range(900):
        text = draw(rng.integers(50, 300))
        if d < 120:
            item, at = items[d % 60].copy(), rng.integers(len(text))
            other = rng.random(len(item)) < (0.1 if d >= 60 else 0)
            item[other] = draw(other.sum())
            text = np.concatenate((text[:at], item, text[at:]))
            truth.add((d, d % 60))
        docs.append((d, named(text)))
    bench = spark.createDataFrame([(i, named(t)) for i, t in enumerate(items)], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in D.find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), bench).collect()}
    assert got <= truth and len(truth - got) <= 2


def test_sums_of_groups_of_any_size():
    rng = np.random.default_rng(2)
    table, sizes = rng.integers(-50, 50, (90, 5)).astype(np.float32), np.array([1, 7, 8, 9, 16, 2500, 1, 31, 3])
    rows = rng.integers(0, 90, sizes.sum())
    for s in (sizes, sizes[:2], np.array([8, 2568])):
        want = [table[part].sum(axis=0) for part in np.split(rows[: s.sum()], np.cumsum(s)[:-1])]
        assert (D._sum_groups(table, rows[: s.sum()], s) == np.array(want)).all()
    assert D._sum_groups(table, rows[:0], sizes[:0]).shape == (0, 5)
