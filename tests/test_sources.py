"""Readers, writers and streams over files made here."""

import json

import numpy as np
from pyspark.sql import functions as F

from corpusloom.sources import readers as R
from corpusloom.sources import writers as Wr
from corpusloom.streaming.incremental import NearDedupIndex, exact_dedup_stream, paragraph_stream


def test_text_readers(spark, tmp_path):
    (tmp_path / "t/skip").mkdir(parents=True)
    (tmp_path / "t/a.txt").write_bytes("x\ny\n".encode())
    (tmp_path / "t/skip/b.txt").write_text("no")
    (tmp_path / "t/c.md").write_text("no")
    got = R.text_folder(spark, str(tmp_path / "t"), exclude=("skip",)).orderBy("line_no").collect()
    assert [(r.line_no, r.value) for r in got] == [(0, "x"), (1, "y")]
    (tmp_path / "bad.txt").write_bytes(b"a\xffb")
    assert R.whole_files(spark, str(tmp_path / "bad.txt"), True).first()["text"] == "ab"


def test_lines_of_files_in_many_splits(spark, tmp_path):
    """Numbers of lines do not depend on where splits begin, nor do line ends and empty lines."""
    files = {"a": [f"line {i} " + "x" * (i * 7 % 50) for i in range(3000)], "b/c": ["", "one", "", "", "é two", ""], "d": [], "e": ["last without end"]}
    for name, lines in files.items():
        (tmp_path / "s" / name).parent.mkdir(parents=True, exist_ok=True)
        end = "\r\n" if name == "a" else "\n"
        (tmp_path / "s" / f"{name}.txt").write_bytes((end.join(lines) + (end if name in ("a", "b/c") else "")).encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (before, "1000", "4096"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            found = {}
            for r in R.text_folder(spark, str(tmp_path / "s")).collect():
                found.setdefault(r.path.split("/s/")[1].removesuffix(".txt"), {})[r.line_no] = r.value
            assert {k: [v[i] for i in range(len(v))] for k, v in found.items()} == {k: v for k, v in files.items() if v}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_json_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text": " one "}\nnot json\n{"text": ""}\n{"text": "two"}\n')
    assert sorted(r.text for r in R.jsonl_texts(spark, str(tmp_path / "a.jsonl")).collect()) == ["one", "two"]
    (tmp_path / "b.json").write_text(json.dumps({"k": 1}, indent=2) + "\n junk " + json.dumps({"k": 2}))
    assert sorted(r.k for r in R.concatenated_json(spark, str(tmp_path / "b.json"), "k int").collect()) == [1, 2]
    (tmp_path / "log.jsonl").write_text('{"step": 1, "train_loss": 2.5}\n{"step": 1, "val_loss": 3.0, "val_ppl": 20.0}\nxx\n')
    train, val = R.training_log(spark, str(tmp_path / "log.jsonl"))
    assert train.count() == 1 and val.first()["val_loss"] == 3.0


def test_wiki_dump(spark, tmp_path):
    page = "<page><title>{}</title>{}<revision><text>{}</text></revision></page>"
    pages = [("A", "", "'''Hi''' [[b|there]]"), ("Template:X", "", "t"), ("R", '<redirect title="A" />', "r"), ("E", "", " ")]
    (tmp_path / "w.xml").write_text("<mediawiki>" + "".join(page.format(*p) for p in pages) + "</mediawiki>")
    assert [tuple(r) for r in R.wiki_dump(spark, str(tmp_path / "w.xml")).collect()] == [("A", "Hi there")]


def test_labels(spark):
    df = spark.createDataFrame([("manual: a b",), ("public",), ("other c",), ("PUBLIC  d",)], "value string")
    assert sorted((r.category, r.text) for r in R.labelled_lines(df).collect()) == [("manual", "a b"), ("public", "d")]
    name = spark.range(1).select(R.parse_run_name(F.lit("run32_base_swiglu_ctx512_bs16_lr1e-03")).alias("r")).first()["r"]
    assert tuple(name) == (32, "base", "swiglu", 512, 16, 0.001)


def test_token_shards(spark, tmp_path):
    df = spark.createDataFrame([(0, 0, [1, 2, 3]), (1, 0, [4]), (2, 1, [5, 6])], "i int, shard_idx int, ids array<int>")
    (tmp_path / "bins").mkdir()
    got = {r.shard_idx: r.n_tokens for r in Wr.write_shards(df, "i", "ids", str(tmp_path / "bins")).collect()}
    assert got == {0: 4, 1: 2} and np.fromfile(tmp_path / "bins/train_shard_000.bin", "<u4").tolist() == [1, 2, 3, 4]
    shards = R.token_shards(spark, str(tmp_path / "bins/train_shard_000.bin"))
    assert [(r.x, r.y) for r in R.shard_windows(shards, 3).collect()] == [([1, 2, 3], [2, 3, 4])]


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    spark.createDataFrame([(1, "a b c d"), (2, "a b c d"), (3, "e f g h")], "doc_id bigint, text string").coalesce(1).write.mode("append").parquet(str(src))
    stream = lambda: spark.readStream.schema("doc_id bigint, text string").parquet(str(src))
    q = exact_dedup_stream(stream(), "text").writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("seen").count() == 2
    index = NearDedupIndex(spark, str(tmp_path / "index"), "doc_id", "text")
    index.run(stream(), str(tmp_path / "c2")).awaitTermination()
    assert sorted(r.doc_id for r in spark.read.parquet(str(tmp_path / "index/rows")).collect()) == [1, 3]
    spark.createDataFrame([(4, "a b c d"), (5, "new words are here")], "doc_id bigint, text string").coalesce(1).write.mode("append").parquet(str(src))
    index.run(stream(), str(tmp_path / "c2")).awaitTermination()
    assert sorted(r.doc_id for r in spark.read.parquet(str(tmp_path / "index/rows")).collect()) == [1, 3, 5]


def test_exact_dedup_within_an_interval(spark, tmp_path):
    """Copies within the interval go; digests that the watermark has passed leave the state."""
    src, schema = tmp_path / "times", "text string, at timestamp"

    def put(*rows):
        spark.createDataFrame(list(rows), "text string, at string").selectExpr("text", "CAST(at AS timestamp) AS at").coalesce(1).write.mode("append").parquet(str(src))

    def run():
        seen = exact_dedup_stream(spark.readStream.schema(schema).parquet(str(src)), "text", "at", "1 hour")
        q = seen.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c5")).trigger(availableNow=True).start()
        q.awaitTermination()
        return q.lastProgress["stateOperators"][0]["numRowsTotal"]

    put(("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:10:00"), ("b", "2024-01-01 00:20:00"))
    assert run() == 2
    put(("a", "2024-01-01 00:30:00"), ("c", "2024-01-02 00:00:00"))
    assert run() == 1  # c; the others are forgotten
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]


def test_paragraph_stream(spark, tmp_path):
    src = tmp_path / "lines"
    src.mkdir()
    (src / "a.csv").write_text("f,one\nf,two\nf,\nf,three\n")
    lines = spark.readStream.schema("source string, value string").option("nullValue", "\x00").option("emptyValue", "").csv(str(src)).fillna("")
    q = paragraph_stream(lines, "source", "value").writeStream.format("memory").queryName("paras").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.paragraph for r in spark.table("paras").collect()] == ["one\ntwo"]


def test_paragraph_stream_in_order_to_the_end(spark, tmp_path):
    """A null line ends a source; lines of a micro-batch are put in order."""
    rows = [("f", 3, ""), ("f", 1, "one"), ("f", 5, None), ("f", 2, "two"), ("f", 4, "three"), ("g", 1, "open")]
    spark.createDataFrame(rows, "source string, n int, value string").coalesce(1).write.parquet(str(tmp_path / "rows"))
    lines = spark.readStream.schema("source string, n int, value string").parquet(str(tmp_path / "rows"))
    q = paragraph_stream(lines, "source", "value", "n").writeStream.format("memory").queryName("ends").option("checkpointLocation", str(tmp_path / "c4")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.source, r.paragraph) for r in spark.table("ends").collect()] == [("f", "one\ntwo"), ("f", "three")]


def test_clean_folder_mirrors_the_tree(spark, tmp_path):
    root, out = tmp_path / "in", tmp_path / "out"
    (root / "a/b").mkdir(parents=True)
    (root / "a/b/one.txt").write_text("x1\ny2\n" * 50)
    (root / "two.txt").write_text("12345")
    clean = lambda c: F.regexp_replace(c, "[0-9]", "")
    files = R.whole_files(spark, str(root))
    got = {r.path.rsplit("/", 1)[1]: (r.chars_before, r.chars_after) for r in Wr.clean_folder(files, str(root), str(out), clean, flush_chars=40).collect()}
    assert got == {"one.txt": (300, 200), "two.txt": (5, 0)}
    assert (out / "a/b/one.txt").read_text() == "x\ny\n" * 50 and (out / "two.txt").read_text() == ""
    assert sorted(p.name for p in out.rglob("*") if p.is_file()) == ["one.txt", "two.txt"]
    (root / "three.txt").write_text("z9")
    again = Wr.clean_folder(R.whole_files(spark, str(root)), str(root), str(out), clean)
    assert [(r.chars_before, r.chars_after, r.retained_pct) for r in again.collect()] == [(2, 1, 50.0)]


def test_texts_on_end(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a"), (3, "c\nd")], "i int, t string")
    Wr.concatenate(df, "i", "t", str(tmp_path / "o"))
    assert "".join(p.read_text() for p in sorted((tmp_path / "o").glob("part-*"))) == "a\nb\nc\nd\n"
    rows = spark.createDataFrame([("T", "body")], "title string, text string")
    assert [r.value for r in Wr.articles_text(rows).collect()] == ["=== T ===\nbody\n"]


def test_readers_of_lines_and_files(spark, tmp_path):
    (tmp_path / "b.txt").write_text("two")
    (tmp_path / "a.txt").write_text("one")
    (tmp_path / "all.txt").write_text("merged")
    got = R.merge_folder(spark, str(tmp_path), output="all.txt").orderBy("file_no").collect()
    assert [(r.file_no, r.text) for r in got] == [(0, "one"), (1, "two")]
    (tmp_path / "c.yaml").write_text("model:\n  d: 4\n  name: x\nsteps: 10\n")
    assert [(r.key, r.value) for r in R.yaml_configs(spark, [str(tmp_path / "c.yaml")]).collect()] == [("model.d", "4"), ("model.name", "x"), ("steps", "10")]
    (tmp_path / "log.txt").write_text("run01_base_gelu_ctx128_bs8_lr1e-3\nstep 1 loss=2.5\nstep 2 loss=2.0\nval_loss=1.9 ppl=6.7 bpb=1.2\n")
    row = R.sweep_console(spark, str(tmp_path / "log.txt")).first()
    assert (row.run.run_no, row.steps, row.val_loss, row.ppl, row.bpb) == (1, [2.5, 2.0], 1.9, 6.7, 1.2)
