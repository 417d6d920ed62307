"""Readers: whole files, lines in order, labelled lines, JSON in several shapes, wiki dumps, token shards, logs."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.text import label_of, split_prefixed_line, strip, strip_wikitext
from corpusloom.operators.ordering import cut, in_order

#: Titles that begin so are no articles.
NAMESPACES = ("వికీపీడియా:", "దస్త్రం:", "మూస:", "వర్గం:", "సహాయం:", "Wikipedia:", "Template:", "Category:", "File:", "Help:", "MediaWiki:")

SMALL = 100_000  # splits of files that may be broadcast


def whole_files(spark: SparkSession, path: str, ignore_bad_bytes: bool = False) -> DataFrame:
    """(path, text) a file; bytes that are not UTF-8 become U+FFFD, or are left out if asked for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    text = _decode_ignoring(F.col("content")) if ignore_bad_bytes else F.decode("content", "UTF-8")
    return files.select("path", text.alias("text"))


@F.pandas_udf(T.StringType())
def _decode_ignoring(content: pd.Series) -> pd.Series:
    return content.map(lambda b: bytes(b).decode("utf-8", errors="ignore"))


def text_folder(spark: SparkSession, path: str, glob: str = "*.txt", exclude: tuple[str, ...] = ()) -> DataFrame:
    """(path, line_no, value): lines of the text files under a folder, but for named subfolders.

    Lines end with a line feed, with or without a carriage return, and are numbered from 0 in their
    file. A file is read in splits, so that its size has no bound: lines of a split have ids without
    gaps, and the splits' line counts, a row a split, are summed up in order of their place. Lines
    are not shuffled while the splits are few enough to broadcast. An empty file has no lines.
    """
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("lineSep", "\n").text(path)
    read = files.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("__at"), F.monotonically_increasing_id().alias("__id"), "value"
    )
    splits = read.groupBy("path", "__at").agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__lines"))
    before = F.sum("__lines").over(Window.partitionBy("path").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1))
    splits = cut(splits.select("path", "__at", (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__shift")))
    placed = read.join(F.broadcast(splits) if splits.count() <= SMALL else splits, ["path", "__at"])
    for folder in exclude:
        placed = placed.where(~F.contains("path", F.lit(f"/{folder}/")))
    return placed.select("path", (F.col("__id") + F.col("__shift")).alias("line_no"), F.regexp_replace("value", r"\r\z", "").alias("value"))


def merge_folder(spark: SparkSession, path: str, output: str | None = None) -> DataFrame:
    """(file_no, path, text) of a folder's text files in order of path, without the output file."""
    files = whole_files(spark, path).where(F.col("path").endswith(".txt"))
    if output:
        files = files.where(~F.col("path").endswith(output))
    return in_order(files, ["path"]).withColumnRenamed("row", "file_no")


def with_label(lines: DataFrame, label: str, separator: str = "\t", skip_empty: bool = True) -> DataFrame:
    """Lines with their label and a separator before them; the sources stay as they are."""
    kept = lines.where(strip(F.col("value")) != "") if skip_empty else lines
    return kept.withColumn("value", F.concat(F.lit(label + separator), F.col("value")))


def prefix_non_blank(value: Column, prefix: str = "manual ") -> Column:
    return F.when(strip(value) != "", F.concat(F.lit(prefix), value)).otherwise(value)


def labelled_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """lines with `category` and `text`, for lines `manual ...` and `public ...` with text."""
    prefix, rest = split_prefixed_line(F.col(value))
    return lines.withColumn("category", label_of(prefix)).withColumn("text", strip(rest)).where("category IS NOT NULL AND text <> ''")


def text_after_tab(value: Column) -> Column:
    """What stands after the first tab of a line, or else the line; '' for none."""
    return strip(F.regexp_replace(value, r"^[^\t]*\t", ""))


def jsonl_texts(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """(text) of JSON lines that have one; malformed lines are left out."""
    rows = spark.read.schema("text string, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    texts = rows.where(F.col("_bad").isNull()).select(strip(F.col("text")).alias("text")).where("text <> ''")
    return texts if most is None else texts.limit(most)


def concatenated_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects written one after another, over several lines or not; what can't be parsed is skipped."""

    def objects(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder = json.JSONDecoder()
        for batch in batches:
            for text in batch["text"]:
                at, out = 0, []
                while (at := text.find("{", at)) >= 0:
                    try:
                        value, at = decoder.raw_decode(text, at)
                        out.append(json.dumps(value, ensure_ascii=False))
                    except json.JSONDecodeError:
                        at += 1
                yield pd.DataFrame({"json": out})

    parsed = whole_files(spark, path).select("text").mapInPandas(objects, "json string")
    return parsed.select(F.from_json("json", schema).alias("o")).select("o.*")


def wiki_dump(spark: SparkSession, path: str) -> DataFrame:
    """(title, text) of the articles of a MediaWiki dump, plain or bz2: no redirects, no other namespaces, not empty."""
    schema = T.StructType([
        T.StructField("title", T.StringType()),
        T.StructField("redirect", T.StructType([T.StructField("_title", T.StringType())])),
        T.StructField("revision", T.StructType([T.StructField("text", T.StringType())])),
    ])
    pages = spark.read.format("xml").option("rowTag", "page").schema(schema).load(path)
    other = F.lit(False)
    for name in NAMESPACES:
        other |= F.col("title").startswith(name)
    articles = pages.where(F.col("redirect").isNull() & F.col("title").isNotNull() & ~other)
    return articles.select("title", strip_wikitext(F.col("revision.text")).alias("text")).where("text <> ''")


def parquet_texts(spark: SparkSession, path: str) -> DataFrame:
    """(text): the text column, or else the first, of Parquet files; strings that are not blank."""
    df = spark.read.parquet(path)
    name = "text" if "text" in df.columns else df.columns[0]
    return df.select(strip(F.col(name).cast("string")).alias("text")).where("text <> ''")


def token_shards(spark: SparkSession, path: str) -> DataFrame:
    """(path, tokens) of files of little-endian unsigned 32-bit ids."""

    @F.pandas_udf("array<bigint>")
    def ids(content: pd.Series) -> pd.Series:
        return content.map(lambda b: np.frombuffer(bytes(b), "<u4").astype(np.int64))

    files = spark.read.format("binaryFile").load(path)
    return files.select("path", ids("content").alias("tokens"))


def shard_windows(shards: DataFrame, context: int, rows: int = 1024) -> DataFrame:
    """(path, start, x, y) of every window; a shard of no more than `context` tokens is an error.

    Windows are views of the shard's tokens and leave it `rows` at a time: a shard is held once, not context times.
    """

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, tokens in zip(batch.column(0), batch.column(1), strict=True):
                ids = tokens.values.to_numpy()
                if len(ids) <= context:
                    raise ValueError(f"too few tokens in {path.as_py()}")
                views = np.lib.stride_tricks.sliding_window_view(ids, context)
                for at in range(0, len(ids) - context, rows):
                    upto = min(at + rows, len(ids) - context)
                    sides = [pa.ListArray.from_arrays(np.arange(upto - at + 1, dtype=np.int32) * context, views[k : k + upto - at].ravel()) for k in (at, at + 1)]
                    yield pa.RecordBatch.from_arrays([pa.array([path.as_py()] * (upto - at)), pa.array(np.arange(at, upto, dtype=np.int64)), *sides], ["path", "start", "x", "y"])

    kept = shards.select("path", F.col("tokens").cast("array<bigint>").alias("tokens"))
    return kept.mapInArrow(cut_up, "path string, start bigint, x array<bigint>, y array<bigint>")


def training_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Training rows and validation rows of a log of JSON lines; malformed lines are left out."""
    schema = "step bigint, epoch bigint, train_loss double, lr double, grad_norm double, tokens_per_sec bigint, elapsed_s double, val_loss double, val_ppl double, is_best boolean"
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    train = rows.where("train_loss IS NOT NULL").select("step", "epoch", "train_loss", "lr", "grad_norm", "tokens_per_sec", "elapsed_s")
    return train, rows.where("val_loss IS NOT NULL").select("step", "val_loss", "val_ppl", "is_best")


#: Fixed value: the name of a run of a sweep.
RUN_NAME = r"run(\d+)_([a-z]+)_([a-z]+)_ctx(\d+)_bs(\d+)_lr([0-9.e+\-]+)"


def parse_run_name(name: Column) -> Column:
    part = lambda i: F.regexp_extract(name, RUN_NAME, i)
    return F.struct(
        part(1).cast("int").alias("run_no"), part(2).alias("family"), part(3).alias("activation"), part(4).cast("int").alias("context"), part(5).cast("int").alias("batch"), part(6).cast("double").alias("lr")
    )


def sweep_console(spark: SparkSession, path: str) -> DataFrame:
    """(run, steps, val_loss, ppl, bpb) of the runs in console logs: a run's name, its step losses, its final line."""
    text = whole_files(spark, path).select(F.explode(F.split("text", rf"(?={RUN_NAME})")).alias("block")).where(F.col("block").rlike(f"^{RUN_NAME}"))
    number = lambda label: F.regexp_extract("block", rf"(?i){label}\s*[=:]\s*([0-9.]+)", 1).cast("double")
    steps = F.transform(F.regexp_extract_all("block", F.lit(r"(?i)step\s*\d+[^\n]*?loss\s*[=:]\s*([0-9.]+)"), F.lit(1)), lambda x: x.cast("double"))
    return text.select(parse_run_name(F.col("block")).alias("run"), steps.alias("steps"), number("val_loss").alias("val_loss"), number("ppl").alias("ppl"), number("bpb").alias("bpb"))


def yaml_configs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, key, value): settings of configuration files by dotted names, in order of path."""
    import yaml

    def flat(node, name=""):
        if isinstance(node, dict):
            for k, v in node.items():
                yield from flat(v, f"{name}.{k}" if name else str(k))
        else:
            yield name, None if node is None else str(node)

    rows = []
    for path in sorted(paths):
        with open(path, encoding="utf-8") as file:
            rows += [(path, k, v) for k, v in flat(yaml.safe_load(file) or {})]
    return spark.createDataFrame(rows, "path string, key string, value string")
