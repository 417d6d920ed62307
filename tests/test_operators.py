"""Operators against small models written here."""

import hashlib
import os
import random
import subprocess
import sys
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import dedup as D
from corpusloom.operators import metrics as M
from corpusloom.operators import split as W
from corpusloom.operators import stats as A
from corpusloom.operators import structure as S
from corpusloom.operators import tokenizer as B
from corpusloom.operators import web as H
from corpusloom.operators.ordering import in_order


@pytest.mark.parametrize("seed", [1, 2])
def test_greedy_selection_is_a_loop_in_order(spark, seed):
    rng = random.Random(seed)
    rows = [(key, band, str(rng.randrange(12))) for key in range(60) for band in range(3)]
    kept, seen, want = set(), set(), {}
    for key in range(60):
        own = {(b, h) for k, b, h in rows if k == key}
        want[key] = "drop" if own & seen else "keep"
        if want[key] == "keep":
            kept.add(key)
            seen |= own
    df = spark.createDataFrame(rows, "doc_id bigint, band_id int, band_hash string")
    assert {r.doc_id: r.verdict for r in D.greedy_verdicts(df, "doc_id").collect()} == want


def test_greedy_selection_of_nulls_and_nothing(spark):
    """Rows that can't be decided are an error, not a loop without end; no rows give none."""
    schema = "doc_id bigint, band_id int, band_hash string"
    assert D.greedy_verdicts(spark.createDataFrame([], schema), "doc_id").count() == 0
    for row in [(None, 0, "a"), (1, 0, None)]:
        with pytest.raises(ValueError):
            D.greedy_verdicts(spark.createDataFrame([row, (2, 0, "b")], schema), "doc_id")


def test_window_rows(spark):
    rows = [(1, list(range(6))), (2, [1, 2, 3]), (3, []), (4, None), (1, [7, 8, 9, 9])]
    got = W.window_rows(spark.createDataFrame(rows, "k int, t array<int>"), ["k"], F.col("t"), 3).collect()
    want = [(k, i, t[i : i + 3], t[i + 1 : i + 4]) for k, t in rows for i in range(max(0, len(t or []) - 3))]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_copies_follow_their_first(spark):
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    texts = [base, base + " x", base, base + " x", "other words entirely here and now"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    bands = lambda d, key, text: d.select(key, F.lit(0).alias("band_id"), F.substring(text, 1, 5).alias("band_hash"))
    got = {r.doc_id: (r.verdict, r.dup_of) for r in D.near_dedup(df, "doc_id", "text", bands).collect()}
    assert got == {0: ("kept", None), 1: ("near", 0), 2: ("exact", 0), 3: ("near", 0), 4: ("kept", None)}


def test_incremental_is_one_run(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("ab") for _ in range(6)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    whole = {r.doc_id for r in D.near_dedup(df, "doc_id", "text").where("verdict = 'kept'").collect()}
    first = df.where("doc_id < 20")
    kept = first.join(D.near_dedup(first, "doc_id", "text").where("verdict = 'kept'"), "doc_id", "left_semi")
    old = D.word_bands(kept, "doc_id", F.col("text")).select("band_id", "band_hash", F.col("doc_id").alias("kept_key"))
    digests = kept.select(F.md5(F.col("text").cast("binary")).alias("digest"))
    later = D.near_dedup(df.where("doc_id >= 20"), "doc_id", "text", D.word_bands, old, digests)
    assert whole == {r.doc_id for r in kept.collect()} | {r.doc_id for r in later.where("verdict = 'kept'").collect()}


def test_in_order(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(50), rng.randrange(9)) for _ in range(500)]
    got = sorted((r.row, r.k, r.n, r.n_before, r.n_total) for r in in_order(spark.createDataFrame(rows, "k int, n int"), ["k"], ("n",)).collect())
    assert [r[1] for r in got] == sorted(k for k, _ in rows)
    total = 0
    for place, (row, _, n, before, everything) in enumerate(got):
        assert (row, before, everything) == (place, total, sum(n for _, n in rows))
        total += n


def test_quota_split(spark):
    rows = [(i, "public", 4) for i in range(12)] + [(20 + i, "manual", 4) for i in range(5)]
    df = spark.createDataFrame(rows, "i int, category string, n int")
    out = {r.i: r.split for r in W.quota_split(df, "category", "i", "n", {"train_manual": 10, "train_public": 10, "val": 5, "test": 8}).collect()}
    assert [out[i] for i in range(12)] == ["train"] * 3 + ["val"] * 2 + ["test"] * 2 + [None] * 5
    assert [out[20 + i] for i in range(5)] == ["train"] * 3 + [None] * 2


def test_folds_and_windows(spark):
    df = spark.createDataFrame([(i, 3) for i in range(10)], "i int, n int")
    assert [r.file_index for r in W.fold_with_reset(df, "i", "n", 7).orderBy("i").collect()] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 3]
    x = spark.range(1).select(W.training_windows(F.array(*map(F.lit, range(4))), 3).alias("w")).first()["w"]
    assert [(w.start, w.x, w.y) for w in x] == [(0, [0, 1, 2], [1, 2, 3])]
    trimmed = spark.range(1).select(W.trim_loop(F.array(*map(F.lit, [9, 1, 2, 3, 4, 1, 2, 3, 4]))).alias("t")).first()["t"]
    assert trimmed == [9, 1, 2, 3, 4]


def test_model_selection(spark):
    rows = [(5000, 0.0, 2.043), (7500, 0.0, 1.8713), (10000, 0.0, 1.7677), (12500, 0.0, 1.6973)]
    got = W.select_model(spark.createDataFrame(rows, "k int, unk double, fert double"), "k", {"unk": 0.6, "fert": 0.4}).orderBy("k").collect()
    assert [r.score for r in got] == [0.4, 0.201331, 0.081458, 0.0] and [r.selected for r in got] == [False, False, False, True]


def test_paragraphs(spark):
    rows = [(1, "public a b"), (2, ""), (3, "manual c d"), (4, "public"), (5, "manual e"), (6, "x f")]
    df = spark.createDataFrame([("s", *r) for r in rows], "src string, line_no int, value string")
    got = [(r.prefix, r.paragraph) for r in S.paragraphs_by_prefix(df, "src").orderBy("para_no").collect()]
    assert got == [("public", "a b\nc d"), ("manual", "e\nf")]
    small = [(r.part, r.paragraph) for r in S.paragraphs_by_prefix(df, "src", max_lines=1).orderBy("para_no", "part").collect()]
    assert small == [(0, "a b"), (1, "c d"), (0, "e"), (1, "f")]
    assert [r.paragraph for r in S.paragraphs_by_blank(df, "src").orderBy("para_no").collect()] == ["public a b", "manual c d\npublic\nmanual e\nx f"]


def test_paragraphs_of_one_long_source(spark):
    """Against a loop, over a source dealt over many parts and a short one; lines come in no order."""
    lines = [("long", i, "" if i % 7 in (0, 3) else f"x line {i}") for i in range(4000)] + [("short", i, "a b") for i in range(5)]
    want, held = [], {}
    for source, _, value in lines:
        if value:
            held.setdefault(source, []).append(value)
        elif held.get(source):
            want.append((source, "\n".join(held.pop(source))))
    want += [(source, "\n".join(rest)) for source, rest in held.items()]
    df = spark.createDataFrame(lines, "src string, line_no int, value string").repartition(7, "value")
    assert sorted((r.src, r.paragraph) for r in S.paragraphs_by_blank(df, "src").collect()) == sorted(want)


def test_texts_on_end_with_nulls_and_ties(spark):
    rows = [("a", 2, "two"), ("a", 1, "one\n"), ("a", None, "last"), ("a", 3, None), ("a", 4, ""), ("b", 1, None), (None, 1, "é"), ("c", 1, "y"), ("c", 1, "x")]
    got = S.texts_on_end(spark.createDataFrame(rows, "lang string, doc_id int, text string"), "lang", "doc_id", "text").collect()
    assert {r.lang: r.text for r in got} == {"a": "one\n\ntwo\n\nlast\n", "b": None, None: "é\n", "c": "x\ny\n"} and len(got) == 4


def test_a_language_of_80_mb_is_written_in_a_small_heap(spark, tmp_path):
    """In a process of its own: the query's text, joined and written as Parquet, where all of Spark has 600 MB."""
    docs, n = str(tmp_path / "documents.parquet"), 800
    text = F.repeat(F.sha2(F.col("doc_id").cast("string"), 256), 1600)
    spark.range(n, 0, -1, 20).select(F.col("id").alias("doc_id"), F.lit("x").alias("lang")).withColumn("text", text).write.option("compression", "none").parquet(docs)
    code = f"""
from pyspark.sql import SparkSession
import __spark_entry__ as e
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.sql.files.maxPartitionBytes", "4m").getOrCreate()
e.queries()["concatenated_texts"](spark, {str(tmp_path)!r}).write.parquet({str(tmp_path / "o")!r})
"""
    apart = {k: v for k, v in os.environ.items() if not k.startswith("PYSPARK_GATEWAY")} | {"PYSPARK_SUBMIT_ARGS": "--driver-memory 600m pyspark-shell"}
    root = str(Path(__file__).resolve().parents[1])
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=apart | {"PYTHONPATH": f"{root}:{apart.get('PYTHONPATH', '')}"}, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-2000:]
    want = "".join(hashlib.sha256(str(i).encode()).hexdigest() * 1600 + "\n" for i in range(1, n + 1))
    got = spark.read.parquet(str(tmp_path / "o")).select("lang", F.octet_length("body").alias("size"), F.sha2("body", 256).alias("digest")).collect()
    assert [tuple(r) for r in got] == [("x", len(want), hashlib.sha256(want.encode()).hexdigest())]


def test_texts_on_end_over_batches(spark):
    """Groups that begin, end and go on at any row of a batch, some without a text, against a loop."""
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", "é", "n", None]), i, rng.choice([None, "", "x\n", "é" * rng.randrange(5)])) for i in range(120)]
    rows = [(lang, i, None if lang == "n" else text) for lang, i, text in rows]
    want = {lang: "".join(t + "\n" for g, _, t in rows if g == lang and t is not None) for lang, _, _ in rows} | {"n": None}
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "lang string, doc_id int, text string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for most in (1, 2, 7, 10_000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
            got = S.texts_on_end(df, "lang", "doc_id", "text").collect()
            assert {r.lang: r.text for r in got} == want and len(got) == len(want)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert S.texts_on_end(df.limit(0), "lang", "doc_id", "text").collect() == []


def test_texts_on_end_of_more_than_a_string_holds(spark, monkeypatch):
    """An error that says so, nothing cut; the limit itself is still a text."""
    df = spark.createDataFrame([("a", 1, "123"), ("a", 2, "567"), ("b", 1, "")], "lang string, doc_id int, text string")
    monkeypatch.setattr(S, "MAX_TEXT_BYTES", 8)
    assert {r.lang: r.text for r in S.texts_on_end(df, "lang", "doc_id", "text").collect()} == {"a": "123\n567\n", "b": "\n"}
    monkeypatch.setattr(S, "MAX_TEXT_BYTES", 7)
    with pytest.raises(Exception, match="have 8 bytes on end"):
        S.texts_on_end(df, "lang", "doc_id", "text").collect()


def test_a_language_of_150_mb_is_joined_in_a_small_heap(spark, tmp_path):
    """In a process of its own: the query's text, joined and hashed, where all of Spark has 600 MB."""
    docs, n = str(tmp_path / "documents.parquet"), 1500
    text = F.repeat(F.sha2(F.col("doc_id").cast("string"), 256), 1600)
    spark.range(n, 0, -1, 20).select(F.col("id").alias("doc_id"), F.lit("x").alias("lang")).withColumn("text", text).write.option("compression", "none").parquet(docs)
    code = f"""
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
import __spark_entry__ as e
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.sql.files.maxPartitionBytes", "4m").getOrCreate()
print(*e.queries()["concatenated_texts"](spark, {str(tmp_path)!r}).select("lang", F.octet_length("body"), F.sha2("body", 256)).first())
"""
    apart = {k: v for k, v in os.environ.items() if not k.startswith("PYSPARK_GATEWAY")} | {"PYSPARK_SUBMIT_ARGS": "--driver-memory 600m pyspark-shell"}
    root = str(Path(__file__).resolve().parents[1])
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=apart | {"PYTHONPATH": f"{root}:{apart.get('PYTHONPATH', '')}"}, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-2000:]
    want = "".join(hashlib.sha256(str(i).encode()).hexdigest() * 1600 + "\n" for i in range(1, n + 1))
    assert run.stdout.split() == ["x", str(len(want)), hashlib.sha256(want.encode()).hexdigest()]


def test_headers(spark):
    pages = [(1, p, f"My Book {p}\nbody {'abc'[p]} text\nmore\nand more\nagain\n{p}") for p in range(3)]
    got = S.strip_headers_footers(spark.createDataFrame(pages, "d int, p int, t string"), "d", "p", "t").orderBy("p").collect()
    assert [r.t for r in got] == [f"body {'abc'[p]} text" for p in range(3)]


def test_metrics(spark):
    df = spark.createDataFrame([(1, "a b a b a b", "a b a b a b")], "id int, hyp string, ref string")
    assert M.repetition_rate(df, "id", F.col("hyp")).first()[0] == 1.0
    assert M.distinct_n(df, F.col("hyp"), 1).first()[0] == 2 / 6 and M.distinct_n(df, F.col("hyp"), 2).first()[0] == 2 / 5
    assert abs(M.bleu(df, "id", "hyp", "ref").first()[0] - 100) < 1e-9 and abs(M.chrf(df, "id", "hyp", "ref").first()[0] - 100) < 1e-9
    pair = spark.createDataFrame([("a b c d", "a x c"), ("", "a")], "hyp string, ref string")
    got = M.rouge_l(pair, "hyp", "ref").first()
    assert [round(x, 6) for x in got] == [25.0, 33.333333, round(100 * (2 * 0.5 * (2 / 3) / (0.5 + 2 / 3)) / 2, 6)]


def test_attention_and_parameters(spark):
    row = spark.range(1).select(
        A.attention_entropy(F.array(*[F.lit(0.125)] * 8)).alias("e"), A.attention_distance(F.array(*[F.lit(0.125)] * 8), F.lit(7)).alias("d"),
        A.parameter_count(F.lit(7500), F.lit(512), F.lit(6), F.lit(1600), F.lit(True), F.lit(True)).alias("n"),
    ).first()
    assert (row.e, row.d, row.n.total) == (3.0, 3.5, 24_912_640)


def test_bpe_matches_a_plain_loop(spark):
    counts = {"low": 5, "lower": 2, "newest": 6, "widest": 3}
    got = B.learn_merges(counts, sorted(set("".join(counts))), 30)
    split, vocab, merges = {w: list(w) for w in counts}, {t: i for i, t in enumerate([*B.SPECIALS, *sorted(set("".join(counts)))])}, []
    while len(vocab) < 30:
        pairs = defaultdict(int)
        for w, parts in split.items():
            for p in zip(parts, parts[1:]):
                pairs[p] += counts[w]
        pairs = {p: n for p, n in pairs.items() if n >= 2}
        if not pairs:
            break
        best = min(pairs, key=lambda p: (-pairs[p], vocab[p[0]], vocab[p[1]]))
        merges.append(best)
        vocab.setdefault("".join(best), len(vocab))
        for w, parts in split.items():
            i = 0
            while i < len(parts) - 1:
                if (parts[i], parts[i + 1]) == best:
                    parts[i : i + 2] = ["".join(best)]
                i += 1
    assert got.merges == merges and got.vocab == vocab
    df = spark.createDataFrame([(1, "lower newest low"), (2, "")], "id int, text string")
    bpe = B.train_bpe(df, F.col("text"), 40)
    coded = {r.id: r.ids for r in B.encode(df, "id", F.col("text"), bpe).collect()}
    names = {i: t for t, i in bpe.vocab.items()}
    assert "".join(names[i] for i in coded[1]) == "lowernewestlow" and coded[2] == []
    packed = spark.range(1).select(B.pack(F.array(F.lit(7), F.lit(8)), F.array(F.lit(9)), 6).alias("p")).first()["p"]
    assert packed.x == [7, 8, 9, 3, 0, 0] and packed.y == [-100, 9, 3, -100, -100, -100]


def test_bpe_counts_rare_pieces(spark):
    """Pieces beyond those on the driver count as well: here all the pairs of 'qz' are in rare ones."""
    text = "low low low lower lower " + " ".join(f"qz{c}qz" for c in "abcdefgh") + " aaaa aaaaa"
    df = spark.createDataFrame([(1, text)], "id int, text string")
    whole, few = (B.train_bpe(df, F.col("text"), 30, max_pieces=m) for m in (B.MAX_PIECES, 2))
    assert few.merges == whole.merges and few.vocab == whole.vocab and ("q", "z") in few.merges


def test_web(spark):
    page = "<nav>menu</nav><article><p>short</p><p>A paragraph that is long enough &amp; kept.</p></article><a href='/x?y#z'>l</a><a href='https://o.org/q'>m</a>"
    df = spark.createDataFrame([("https://h.org/a/b?c", page)], "url string, html string")
    assert df.select(H.fallback_text(F.col("html"))).first()[0] == "A paragraph that is long enough & kept."
    inner, outer = "inner words / " * 8, "outer words " * 5
    boxes = [f"<div class=a>{outer}<div>{inner}</div><section>{outer}</section> end</div><div>{inner}</div>", f"</div><section>{inner}", "<div>short</div>", None]
    got = [r[0] for r in spark.createDataFrame([(b,) for b in boxes], "html string").select(H.fallback_text(F.col("html"))).collect()]
    assert got == [outer + inner + outer + " end", inner.strip(), None, None]
    chain = spark.createDataFrame([(boxes[1],), (boxes[2],)], "html string").select(H.first_long_enough(F.col("html"), [H.fallback_text, H.visible_text]))
    assert [r[0] for r in chain.collect()] == [inner.strip(), "short"]
    assert {(r.src, r.dst) for r in H.page_links(df, "url", "html").collect()} == {("https://h.org/a/b", "https://h.org/x")}
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "src string, dst string")
    found = H.reachable(edges, spark.createDataFrame([("a",)], "url string"))
    assert {(r.url, r.depth) for r in found.collect()} == {("a", 0), ("b", 1), ("c", 2)}
    files = spark.createDataFrame([("r.xml", "<loc>s.xml</loc><loc>r.xml</loc>"), ("s.xml", "<loc>p1</loc><loc>i.jpg</loc>")], "url string, xml string")
    assert [r.url for r in H.sitemap_urls(files, spark.createDataFrame([("r.xml",)], "url string")).collect()] == ["p1"]


def test_main_text_is_that_of_its_sql(spark, tmp_path):
    """On pages without an article, with odd white space at ends, cut tags and letters that fold to ASCII."""
    import duckdb

    import __spark_entry__ as entry

    long = "A paragraph that is long enough"
    pages = [
        f"<div><div>{long} {long} {long} {long}</div></div>", f"<article><p>{long} </p><p> {long}\x0b</p></article>", f"<article><p>{long} &nbsp;<p {long}</article>",
        f"<article><ſcript>x</ſcript><p>{long}\u0085</p\x0b></article>", f"<article><pé>{long}<p>{long}  <P>{long}\n</article>", f"<article><p>short</p></article><section>{long * 5}</section>", "", None,
    ]
    spark.createDataFrame(list(enumerate(pages)), "page_id bigint, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    for name in ("html_main_text", "html_extractor_chain"):
        want = con.execute(entry.oracle_sql()[name]).fetchall()
        got = [tuple(r) for r in entry.queries()[name](spark, str(tmp_path)).collect()]
        if name == "html_extractor_chain":  # what is visible is not the matter here
            got, want = ([(k, t) for k, t in rows if k == 0] for rows in (got, want))
        assert sorted(got, key=str) == sorted(want, key=str)


def test_many_pieces_are_merged_on_executors(spark, monkeypatch):
    """Beyond max_pieces the driver merges none; tasks, some without a piece, agree on what it would have learned."""
    rng, learn = random.Random(4), B.learn_merges
    texts = [" ".join("".join(rng.choice("abcé\U00010348") for _ in range(rng.choice((1, 2, 3, 6, 15)))) for _ in range(k)) for k in (40, 0, 3, 80)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    want = B.train_bpe(df, F.col("text"), 60)
    counts = {r.piece: r.n for r in B.piece_counts(df, F.col("text")).collect()}
    assert learn(counts, sorted(set("".join(counts))), 60).merges == want.merges and len(want.merges) > 40
    monkeypatch.setattr(B, "learn_merges", None)
    monkeypatch.setattr("corpusloom.operators.merging.SHARE", 1)
    got = B.train_bpe(df, F.col("text"), 60, max_pieces=1)
    assert got.merges == want.merges and got.vocab == want.vocab
    few = B.train_bpe(spark.createDataFrame([(1, "aaaaa bb")], "id int, text string"), F.col("text"), 30, 1, max_pieces=0)
    assert few.merges == learn({"aaaaa": 1, "bb": 1}, ["a", "b"], 30, 1).merges


def test_texts_are_encoded_a_row_each_without_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(B, "KNOWN", 3)
    monkeypatch.setattr(B, "ROWS", 2)
    texts = ["low lower, lowest!", None, "", "low zz é low", "new newer\nlow", "low lower, lowest!"]
    df = spark.createDataFrame([(7 if i in (0, 5) else i, t) for i, t in enumerate(texts)], "id int, text string").coalesce(1)
    bpe = B.train_bpe(df.where("id <> 3"), F.col("text"), 30)
    coded = B.encode(df, "id", F.col("text"), bpe)
    assert "Exchange" not in coded._jdf.queryExecution().executedPlan().toString()
    words = [r[0] or [] for r in df.select(B.pieces(F.col("text"))).collect()]
    want = [(r.id, [bpe.vocab[t] for w in ws for t in bpe.encode_piece(w)]) for r, ws in zip(df.collect(), words)]
    assert [(r.id, r.ids) for r in coded.collect()] == want and bpe.vocab["<unk>"] in want[3][1]
