"""Training-data pipeline over ``documents``: five stages, each one of the
corpus operators on all that the stage before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as parquet under the shared checkpoint folder and read again as the
next one's docs. All but the last return the columns of documents; where a
text changes, ``n_chars`` follows it.

Rows may repeat and any column may be null: a null text has no words and
goes in the first stage, as blank ones do; a row without document id stays
as long as its own text allows. Stages join by document id and hash of the
text, so repeated rows share their fate. Empty tables pass as empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fraudlens.llm import line_dedup, minhash, packing, quality, secrets
from fraudlens.llm.common import fresh, table, write_table

#: The last stage cuts and tokenises; no SQL expresses it, nor the forest and
#: the hash families before it. Tests hold the stages against brute force.
ORACLE_SQL = None

#: Similarity of near duplicates; with bands of 5 rows instead of 6 a pair at
#: this bound is missed with probability (1 - 0.8**5)**28 = 1.5e-5.
SIMILAR_PERCENT, BAND_ROWS = 80, 5


def _with_text(out: DataFrame, docs: DataFrame, new: str) -> DataFrame:
    """The columns of ``docs``, the text replaced by column ``new``."""
    changed = {"text": F.col(f"`{new}`"), "n_chars": F.length(F.col(f"`{new}`")).cast("long")}
    return out.select(*[changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules (operator 2)."""
    out, names = quality.apply_rules(docs)
    return out.where(F.col(names["kept"])).select(*[F.col(f"`{c}`") for c in docs.columns])


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that several documents share stay in one (operator 6). Documents
    without a line left stay too, as empty texts; dropping is for the others."""
    out, kept, _, _ = line_dedup.clean(docs)
    return _with_text(out, docs, kept)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (operator 4): the one
    with the smallest id. Of rows that repeat it with the same text, one. An
    id's other texts stay as long as operator 4 keeps their own rows."""
    groups = minhash.near_duplicates(docs, percent=SIMILAR_PERCENT, rows=BAND_ROWS)
    gone = write_table(groups.where(~F.col("kept")).select("doc_id", "th").distinct(), "near-duplicates")
    th, gone_id, gone_th = fresh(docs, "th__", "gone_id__", "gone_th__")
    gone = gone.select(F.col("doc_id").alias(gone_id), F.col("th").alias(gone_th))
    same = F.col("doc_id").eqNullSafe(F.col(gone_id)) & F.col(th).eqNullSafe(F.col(gone_th))
    left = docs.withColumn(th, F.xxhash64("text")).join(gone, same, "left_anti")
    return left.dropDuplicates(["doc_id", th]).select(*[F.col(f"`{c}`") for c in docs.columns])


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets replaced by a mark in the texts (operator 5)."""
    out, clean = secrets.redact(docs)
    return _with_text(out, docs, clean)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens (operator 8)."""
    return packing.packing_query(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_table(stage(spark, docs, sf_dir), name)
    return docs
