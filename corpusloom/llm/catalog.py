"""The queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .chat import link_quotes
from .decontaminate import find_leaks
from .html_crf import extract_main_text
from .licenses import license_scan
from .mixing import mix_sources
from .ogg import media_digests
from .quality import quality
from .sharding import byte_shards
from .simhash import near_duplicate_groups
from .tokencount import token_counts


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocabulary_path())


def op4_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_shards(table(spark, sf_dir, "documents"))


def op5_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(table(spark, sf_dir, "documents"))


def op6_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_duplicate_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op8_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotes(table(spark, sf_dir, "conversations"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files source/lang/thousand/doc_id: the table has no paths of its own."""
    parts = [F.coalesce(c, F.lit("unknown")) for c in ("source", "lang")]
    number = F.coalesce(F.col("doc_id"), F.lit(-1))
    path = F.concat_ws("/", *parts, F.floor(number / 1000).cast("string"), number.cast("string"))
    files = table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text")
    return license_scan(files, passed=["doc_id"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_benchmark_leaks, op2_quality_scores, op3_token_counts, op4_byte_shards, op5_ogg_media,
        op6_simhash_groups, op7_source_mix, op8_quote_links, op9_main_text, op10_license_scan,
    )
}
