"""Pages, paragraphs and lines of texts and of line streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from corpusloom.functions.text import lines, mask_digits, split_prefixed_line, strip
from corpusloom.operators.ordering import in_order_by_group

MAX_LINES, MAX_CHARS = 5_000, 500_000
#: Of a JVM array, rounded up to words.
MAX_TEXT_BYTES = 2**31 - 64
#: Fixed value: a line that is only a page number.
PAGE_NUMBER = r"(?i)^\s*(page\s*)?\p{Nd}+(\s*(of|/)\s*\p{Nd}+)?\s*$"


def split_pages(df: DataFrame, key: str, text: str, separator: str | None = "\f") -> DataFrame:
    """(key, page_no from 0, page_text); one page if there is no separator."""
    pages = F.array(text) if separator is None else F.split(text, f"\\Q{separator}\\E")
    return df.select(key, F.posexplode(pages).alias("page_no", "page_text"))


def split_paragraphs(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, para_no, paragraph) between runs of two or more line feeds; blank ones are left out."""
    return df.select(key, F.posexplode(F.split(text, r"\n{2,}")).alias("para_no", "paragraph")).where(strip(F.col("paragraph")) != "")


def join_paragraphs(df: DataFrame, key: str, paragraph: str = "paragraph") -> DataFrame:
    """Texts again from paragraphs in order of para_no."""
    ordered = F.array_sort(F.collect_list(F.struct("para_no", paragraph)))
    return df.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x[paragraph]), "\n\n").alias("text"))


def texts_on_end(df: DataFrame, group: str, order: str, text: str) -> DataFrame:
    """(text, group): a group's texts on end in order, nulls of it last, a line feed after each; null if all of them are null.

    Rows are sorted where they can spill, and joined as they come from Arrow, outside the heap, which then
    has the row alone. A group is one value, so less than 2 GB.
    """
    names, most = [text, group], MAX_TEXT_BYTES

    def row(body: bytearray | None, key: pa.Array) -> pa.RecordBatch:
        if body is None:
            return pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), key], names=names)
        if len(body) > most:
            raise ValueError(f"the texts of {key[0].as_py()!r} have {len(body)} bytes on end; a string has at most {most}")
        # The bytes as they are, without a copy.
        whole = pa.StringArray.from_buffers(1, pa.py_buffer(np.array([0, len(body)], "<i4")), pa.py_buffer(body))
        return pa.RecordBatch.from_arrays([whole, key], names=names)

    def on_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        body, key = None, None
        for batch in batches:
            texts, keys = batch.column(0).cast(pa.large_string()), batch.column(1)
            start = 0
            for end in pc.run_end_encode(keys).run_ends.to_pylist():
                now = keys.slice(start, 1)
                if key is None or now[0].as_py() != key[0].as_py():
                    if key is not None:
                        yield row(body, key)
                    body, key = None, pa.concat_arrays([now])
                if len(part := texts.slice(start, end - start).drop_null()):
                    _, offsets, data = part.buffers()
                    first, last = np.frombuffer(offsets, "<i8")[[part.offset, part.offset + len(part)]]
                    body = bytearray() if body is None else body
                    body += memoryview(data)[first:last]
                start = end
        if key is not None:
            yield row(body, key)

    ordered = df.select(group, order, text).repartition(group).sortWithinPartitions(group, F.col(order).asc_nulls_last(), text)
    schema = StructType([StructField(text, StringType()), StructField(group, df.schema[group].dataType)])
    return ordered.select(F.concat(F.col(text), F.lit("\n")).alias(text), group).mapInArrow(on_end, schema)


def split_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(key, F.posexplode(lines(F.col(text))).alias("line_no", "line"))


def paragraphs_by_blank(df: DataFrame, source: str, order: str = "line_no", value: str = "value") -> DataFrame:
    """(source, para_no, paragraph): lines of each source up to a blank line, joined by line feeds."""
    blank = strip(F.col(value)) == ""
    grouped = _numbered(df.select(source, order, value), source, order, blank).where(~blank)
    return _assemble(grouped, [source, "para_no"], order, F.col(value))


def paragraphs_by_prefix(df: DataFrame, source: str, order: str = "line_no", value: str = "value", max_lines: int = MAX_LINES, max_chars: int = MAX_CHARS) -> DataFrame:
    """(source, para_no, part, prefix, paragraph) of lines `prefix content`.

    A line of one word ends a paragraph, blank lines are nothing. A paragraph takes its first
    line's prefix. One that reaches max_lines or max_chars goes out as it is, and what follows is a
    new part; only such paragraphs are folded in Python, one at a time.
    """
    prefix, content = split_prefixed_line(F.col(value))
    split = df.select(source, order, prefix.alias("prefix"), content.alias("content")).where("prefix <> ''")
    grouped = _numbered(split, source, order, F.col("content") == "").where("content <> ''")
    sizes = grouped.groupBy(source, "para_no").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("chars"))
    grouped = grouped.join(sizes, [source, "para_no"])
    large = (F.col("n") >= max_lines) | (F.col("chars") >= max_chars)
    schema = grouped.drop("n", "chars").withColumn("part", F.lit(0)).schema

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group, parts, n, chars, part = group.sort_values(order), [], 0, 0, 0
        for size in group["content"].str.len():
            parts.append(part)
            n, chars = n + 1, chars + size
            if n >= max_lines or chars >= max_chars:
                n, chars, part = 0, 0, part + 1
        return group.assign(part=parts)

    small_rows = grouped.where(~large).drop("n", "chars").withColumn("part", F.lit(0))
    large_rows = grouped.where(large).drop("n", "chars").groupBy(source, "para_no").applyInPandas(fold, schema)
    both = small_rows.unionByName(large_rows)
    first = F.min_by("prefix", order).alias("prefix")
    return _assemble(both, [source, "para_no", "part"], order, F.col("content"), first)


def _numbered(df: DataFrame, source: str, order: str, ends: Column) -> DataFrame:
    """df with para_no, how many lines of the source up to this one end a paragraph, by prefix sums: a source is no task."""
    placed = in_order_by_group(df.withColumn("__end", F.when(ends, 1).otherwise(0).cast("bigint")), source, [order], ("__end",))
    return placed.withColumn("para_no", F.col("__end_before") + F.col("__end")).drop("row", "__end", "__end_before")


def _assemble(df: DataFrame, keys: list[str], order: str, value: Column, *more: Column) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x["v"]), "\n").alias("paragraph"), *more)


def with_prefix(prefix: Column, paragraph: Column) -> Column:
    """Every line of a paragraph with its label and two spaces before it, and a blank line after."""
    return F.concat(F.array_join(F.transform(F.split(paragraph, "\n"), lambda line: F.concat(prefix, F.lit("  "), line)), "\n"), F.lit("\n\n"))


def strip_headers_footers(pages: DataFrame, doc: str, page: str, text: str, ratio: float = 0.6, edge: int = 3) -> DataFrame:
    """(doc, page, text) without lines near a page's ends that repeat there on most pages of the document.

    Digits are masked for the comparison. A pattern counts once a page and end; it is a running
    header or footer on at least two pages and `ratio` of them. Page numbers near the ends go too.
    """
    numbered = pages.select(doc, page, F.posexplode_outer(lines(F.col(text))).alias("i", "line"), F.size(lines(F.col(text))).alias("n"))
    numbered = numbered.withColumn("pattern", mask_digits(F.col("line"))).withColumn("at_top", F.col("i") < edge).withColumn("at_end", F.col("i") >= F.col("n") - edge)
    total = pages.groupBy(doc).agg(F.count(F.lit(1)).alias("n_pages"))
    near = numbered.where(F.col("pattern") != "").select(doc, page, "pattern", F.explode(F.array_compact(F.array(F.when(F.col("at_top"), "top"), F.when(F.col("at_end"), "end")))).alias("side"))
    repeated = (
        near.distinct().groupBy(doc, "pattern", "side").agg(F.count(F.lit(1)).alias("seen")).join(total, doc)
        .where(F.col("seen") >= F.greatest(F.lit(2), F.floor(F.col("n_pages") * ratio))).select(doc, "pattern").distinct().withColumn("running", F.lit(True))
    )
    at_edge = F.col("at_top") | F.col("at_end")
    gone = at_edge & (F.col("running").isNotNull() | F.col("line").rlike(PAGE_NUMBER))
    kept = numbered.join(repeated, [doc, "pattern"], "left").withColumn("line", F.when(~F.coalesce(gone, F.lit(False)), F.col("line")))
    ordered = F.array_sort(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("i", "line"))))
    return kept.groupBy(doc, page).agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias(text))


