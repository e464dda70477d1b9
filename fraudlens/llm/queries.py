"""The registered queries of the corpus operators and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fraudlens.llm import (bloom_sketch, fill_middle, html_text, line_dedup, minhash, packing, periodic_runs, prefix_forest, quality,
                           secrets, sentencepiece_codec, token_counts, warc)
from fraudlens.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


@query("op2_quality_rules", quality.oracle_sql())
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality statistics and verdict of every document."""
    return quality.quality_query(table(spark, sf_dir, "documents"))


@query("op10_sentencepiece")
def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every document, and the text decoded from them."""
    return sentencepiece_codec.sentencepiece_query(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op6_line_dedup", line_dedup.oracle_sql())
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that several documents share stay in the largest document id only."""
    return line_dedup.line_dedup_query(table(spark, sf_dir, "documents"))


@query("op8_packing")
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    return packing.packing_query(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op4_minhash_near_dedup")
def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return minhash.minhash_query(table(spark, sf_dir, "documents"))


@query("op3_warc", warc.oracle_sql())
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to WARC archives and read back."""
    return warc.warc_query(table(spark, sf_dir, "pages"))


@query("op9_prefix_forest")
def op9_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every vector whose id is divisible by 20."""
    return prefix_forest.nearest_query(table(spark, sf_dir, "embeddings"))


@query("op1_html_main_text")
def op1_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.html_query(table(spark, sf_dir, "pages"))


@query("op7_token_counts")
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after a batch of edits."""
    return token_counts.token_counts_query(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op5_secret_scan")
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret findings of every document with the forest's verdict."""
    return secrets.secrets_query(table(spark, sf_dir, "documents"))


@query("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in every document, with planted ones in every tenth."""
    return periodic_runs.periodic_query(table(spark, sf_dir, "documents"))


@query("op12_fill_middle", fill_middle.oracle_sql())
def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut for fill-in-the-middle training, and restored."""
    return fill_middle.fill_middle_query(table(spark, sf_dir, "documents"))


@query("op13_bloom_sketch")
def op13_bloom_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and their likeness."""
    return bloom_sketch.fingerprints_query(table(spark, sf_dir, "documents"))
