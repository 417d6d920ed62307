"""Writers: rotated text files, token shards, JSON and reports."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.split import fold_with_reset

SHARD_TOKENS, SHARD_LINES, ROTATE_BYTES = 50_000_000, 10_000, 100 * 1024 * 1024


def rotated_texts(df: DataFrame, order: str, text: str, limit: int = ROTATE_BYTES, total: int | None = None) -> DataFrame:
    """df with file_index: a new file begins once one has `limit` bytes; nothing after `total` bytes."""
    sized = df.withColumn("n_bytes", F.octet_length(text).cast("bigint") + 2)
    dealt = fold_with_reset(sized, order, "n_bytes", limit)
    if total is not None:
        from corpusloom.operators.ordering import in_order

        dealt = in_order(dealt, [order], ("n_bytes",)).where(F.col("n_bytes_before") < total).drop("row", "n_bytes_before", "n_bytes_total")
    return dealt


def write_rotated(df: DataFrame, order: str, text: str, path: str, **options) -> None:
    dealt = rotated_texts(df, order, text, **options)
    dealt.repartition("file_index").sortWithinPartitions("file_index", order).select("file_index", F.concat(F.col(text), F.lit("\n")).alias("value")).write.partitionBy("file_index").text(path)


def shard_tokens(df: DataFrame, order: str, n_tokens: str, per_shard: int | None = SHARD_TOKENS, lines: int = SHARD_LINES) -> DataFrame:
    """df with shard_idx: looked at after whole batches of lines; one shard if per_shard is None."""
    if per_shard is None:
        return df.withColumn("shard_idx", F.lit(0))
    return fold_with_reset(df, order, n_tokens, per_shard, "shard_idx", lines)


def write_shards(df: DataFrame, order: str, ids: str, path: str) -> DataFrame:
    """A file train_shard_NNN.bin a shard_idx, of little-endian unsigned 32-bit ids; returns (shard_idx, n_tokens).

    path is a folder that all executors share. A shard is written by one task, batch by batch, under
    a name of the attempt, then renamed, so that a task that runs again does no harm.
    """
    import os
    import uuid

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_files, counts, tag = {}, {}, uuid.uuid4().hex
        for batch in batches:
            for shard, tokens in zip(batch["shard_idx"], batch[ids], strict=True):
                name = f"{path}/train_shard_{shard:03d}.bin"
                if shard not in open_files:
                    open_files[shard] = open(f"{name}.{tag}", "wb")
                open_files[shard].write(np.asarray(tokens, "<u4").tobytes())
                counts[shard] = counts.get(shard, 0) + len(tokens)
        for shard, file in open_files.items():
            file.close()
            os.replace(file.name, f"{path}/train_shard_{shard:03d}.bin")
        yield pd.DataFrame({"shard_idx": list(counts), "n_tokens": list(counts.values())})

    rows = df.repartition("shard_idx").sortWithinPartitions("shard_idx", order).select("shard_idx", ids)
    return rows.mapInPandas(write, "shard_idx int, n_tokens bigint")


def write_json(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def append_report(df: DataFrame, line: str, path: str) -> None:
    df.select(F.col(line).cast("string").alias("value")).write.mode("append").text(path)


def not_yet_written(inputs: DataFrame, written: DataFrame, key: str) -> DataFrame:
    """Inputs whose key is not among what a former run wrote."""
    return inputs.join(written.select(key).distinct(), key, "left_anti")


def write_mirrored(texts: DataFrame, root: str, output: str, path: str = "path", order: str = "chunk_no", text: str = "text") -> DataFrame:
    """Write (path, chunk_no, text) rows to files under output as they lie under root; returns (path, n_chunks, n_bytes).

    output is a folder that all executors share. A file's chunks are written in order by one task,
    one at a time, under a name of the attempt, then renamed, so that a task that runs again does no harm.
    """
    import os
    import uuid

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tag, name, file, found = uuid.uuid4().hex, None, None, {}

        def close() -> None:
            if file is not None:
                file.close()
                os.replace(file.name, file.name[: -len(tag) - 1])

        for batch in batches:
            for at, body in zip(batch[path], batch[text], strict=True):
                if at != name:
                    close()
                    name = at
                    target = os.path.join(output, os.path.relpath(at.removeprefix("file:"), root))
                    os.makedirs(os.path.dirname(target), exist_ok=True)
                    file = open(f"{target}.{tag}", "wb")
                chunks, size = found.get(name, (0, 0))
                found[name] = chunks + 1, size + file.write(body.encode("utf-8", "replace"))
        close()
        rows = [(p, *sizes) for p, sizes in found.items()]
        yield pd.DataFrame(rows, columns=[path, "n_chunks", "n_bytes"])

    rows = texts.where(F.col(text).isNotNull()).repartition(path).sortWithinPartitions(path, order).select(path, text)
    return rows.mapInPandas(write, f"{path} string, n_chunks bigint, n_bytes bigint")


def clean_folder(files: DataFrame, root: str, output: str, clean, flush_chars: int = 50 * 1024 * 1024, skip_existing: bool = True) -> DataFrame:
    """Clean the files (path, text) under root into a mirrored tree: (path, chars_before, chars_after, retained_pct).

    `clean` takes and gives a column of text; it is applied to chunks of whole lines of about
    flush_chars characters. Files that are in output already are left as they are if asked for.
    """
    import os

    from corpusloom.operators.ordering import cut
    from corpusloom.operators.stats import retained

    if skip_existing:
        done = [os.path.join(folder, name) for folder, _, names in os.walk(output) for name in names]
        there = files.sparkSession.createDataFrame([(os.path.relpath(p, output),) for p in done], "relative string")
        relative = F.regexp_replace("path", rf"^(file:/*)?\Q/{root.strip('/')}/\E", "")
        files = files.withColumn("relative", F.regexp_replace(relative, rf"^/?\Q{root.strip('/')}/\E", "")).join(there, "relative", "left_anti").drop("relative")
    lines = files.select("path", F.posexplode(F.split("text", r"(?<=\n)")).alias("line_no", "line")).where("line <> ''")
    sized = in_order_by_path(lines.withColumn("n_chars", F.char_length("line").cast("bigint")))
    chunked = sized.withColumn("chunk_no", F.floor(F.col("chars_before") / flush_chars))
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))  # a chunk's lines
    chunks = chunked.groupBy("path", "chunk_no").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "").alias("raw"))
    cleaned = cut(chunks.withColumn("text", clean(F.col("raw"))))
    write_mirrored(cleaned, root, output).count()
    return cleaned.groupBy("path").agg(*retained(F.col("raw"), F.col("text")))


def in_order_by_path(lines: DataFrame) -> DataFrame:
    """(path, line_no, line, n_chars) with chars_before, the characters before a line in its file."""
    from corpusloom.operators.ordering import in_order

    whole = in_order(lines, ["path", "line_no"], ("n_chars",))
    firsts = whole.groupBy("path").agg(F.min("n_chars_before").alias("first"))
    return whole.join(firsts, "path").withColumn("chars_before", F.col("n_chars_before") - F.col("first")).select("path", "line_no", "line", "chars_before")


def concatenate(texts: DataFrame, order: str, text: str, path: str) -> None:
    """All texts in order, a line feed after each, as part files whose names are in order: bytes on end give one file."""
    texts.repartitionByRange(order).sortWithinPartitions(order).select(F.col(text).alias("value")).write.text(path)


def articles_text(articles: DataFrame) -> DataFrame:
    """(value) of articles (title, text): a line `=== title ===`, the text, a blank line."""
    return articles.select(F.concat(F.lit("=== "), "title", F.lit(" ===\n"), "text", F.lit("\n")).alias("value"))
