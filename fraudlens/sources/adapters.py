"""Adapters that turn the shared parquet tables into review-shaped tables.

Every adapter returns the full review schema
``(review_id, user_id, prod_id, date, Review, rating, label)`` and is written
so that the same definition can be repeated in plain SQL by the oracle
(see ``fraudlens.plans.sql``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REVIEW_COLUMNS = ["review_id", "user_id", "prod_id", "date", "Review", "rating", "label"]


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def reviews_orders(spark: SparkSession, sf_dir: str, with_text: bool = True,
                   text_stats: bool = False, key_only: bool = False) -> DataFrame:
    """One review per order.

    user = customer, product = smallest part key of the order's line items
    (null when the order has none), date = order date, rating = priority
    digit, label = -1 for finished orders whose key is divisible by 3, text =
    the document whose id is the order key modulo the number of documents.
    ``key_only`` gives that id (``doc_key``) in the text's place, for joins that
    come before ``order_texts``.
    """
    orders = load_table(spark, sf_dir, "orders")
    lineitem = load_table(spark, sf_dir, "lineitem")
    # Partial aggregation per order before the shuffle: one row per order.
    first_part = (lineitem.groupBy("l_orderkey")
                  .agg(F.min("l_partkey").alias("prod_id")))
    base = (orders.join(first_part, orders.o_orderkey == first_part.l_orderkey, "left")
            .select(F.col("o_orderkey").alias("review_id"),
                    F.col("o_custkey").alias("user_id"),
                    F.col("prod_id"),
                    F.col("o_orderdate").alias("date"),
                    F.substring("o_orderpriority", 1, 1).cast("double").alias("rating"),
                    F.when((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 3 == 0),
                           F.lit(-1)).otherwise(F.lit(1)).alias("label")))
    if not with_text:
        return base.withColumn("Review", F.lit(None).cast("string")).select(REVIEW_COLUMNS)
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "text")
    # The document count, as a scalar subquery (one partial count).
    n_docs = docs.agg(F.count(F.lit(1))).scalar()
    keyed = base.withColumn("doc_key", F.col("review_id") % n_docs)
    if key_only:
        return keyed.select(*["doc_key" if c == "Review" else c for c in REVIEW_COLUMNS])
    if text_stats:
        # Many reviews share one document: measure each text once (B1, B2)
        # and join only the numbers, so no text is copied by the fan-out.
        from fraudlens.functions.columns import text_length, word_count
        stats = docs.select("doc_id", text_length("text").alias("review_len"),
                            word_count("text").alias("word_count"))
        out = keyed.join(stats, keyed.doc_key == stats.doc_id, "left")
        return out.select(*[c for c in REVIEW_COLUMNS if c != "Review"], "review_len", "word_count",
                          F.col("doc_id").isNotNull().alias("_has_text"))
    out = keyed.join(docs, keyed.doc_key == docs.doc_id, "left")
    return out.select(*[F.col("text").alias("Review") if c == "Review" else F.col(c)
                        for c in REVIEW_COLUMNS])


def order_texts(spark: SparkSession, sf_dir: str, keyed: DataFrame, presence: bool = False) -> DataFrame:
    """Rows with a ``doc_key``, and the document's text as ``Review`` in its
    place; with ``presence`` an empty text stands for any text."""
    text = F.when(F.col("text").isNotNull(), F.lit("")) if presence else F.col("text")
    docs = load_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc_key"), text.alias("Review"))
    return keyed.join(docs, "doc_key", "left").drop("doc_key")


def reviews_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One review per event: product = ``k`` of the JSON props, sub-second
    dates, rating from the value, label -1 for error events."""
    ev = load_table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").alias("review_id"),
        F.col("user_id"),
        F.get_json_object("props", "$.k").cast("long").alias("prod_id"),
        F.col("ts").alias("date"),
        F.col("event_type").alias("Review"),
        (F.lit(1.0) + F.least(F.lit(4.0), F.floor(F.col("value") / 50).cast("double"))).alias("rating"),
        F.when(F.col("event_type") == "error", F.lit(-1)).otherwise(F.lit(1)).alias("label"),
    )


def _docs_date(doc_id: Column) -> Column:
    return F.date_add(F.lit("2024-01-01").cast("date"),
                      (doc_id * 37 % 365).cast("int")).cast("timestamp_ntz")


def reviews_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One review per labelled document (inner join to ``labels``)."""
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = load_table(spark, sf_dir, "labels").select("doc_id", "quality")
    j = docs.join(labels, "doc_id")
    d = F.col("doc_id")
    return j.select(
        d.alias("review_id"),
        (d % 97).alias("user_id"),
        (d % 41).alias("prod_id"),
        _docs_date(d).alias("date"),
        F.col("text").alias("Review"),
        (F.lit(1) + d * d % 5).cast("double").alias("rating"),
        F.when(F.col("quality") == 0, F.lit(-1)).otherwise(F.lit(1)).alias("label"),
    )


def split_content_meta(reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cut a review table into the two files of the reference layout.

    content = every column but rating and label (review_id, user_id, prod_id,
              date, Review - or precomputed text statistics)
    metadata = (meta_id, user_id, prod_id, rating, label, date)
    """
    content = reviews.select(*[c for c in reviews.columns if c not in ("rating", "label")])
    meta = reviews.select(F.col("review_id").alias("meta_id"), "user_id", "prod_id",
                          "rating", "label", "date")
    return content, meta
