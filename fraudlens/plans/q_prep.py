"""Registered queries: sources, joins, projections, sampling (S, J, P, A1, A10, M9, K)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fraudlens.functions.columns import (fill_zero, label_fixed, label_name, threshold_predict,
                                         to_timestamp_safe, truncate_int)
from fraudlens.operators import prep, sampling
from fraudlens.plans.registry import query
from fraudlens.plans.sql import EVENTS, J1, ORDERS, ORDERS_NOTEXT
from fraudlens.sources import adapters, sinks


def joined_orders(spark: SparkSession, sf_dir: str, with_text: bool = True,
                  text_stats: bool = False, presence: bool = False) -> DataFrame:
    """J1 over the orders adapter: content LEFT JOIN metadata. With
    ``text_stats`` the content carries per-document text statistics
    instead of the text itself.

    Many orders share one text, so the text stays out of the join's shuffle: the
    content carries its document's id through J1 and takes the text behind it
    (with ``presence``: an empty text instead of any)."""
    reviews = adapters.reviews_orders(spark, sf_dir, with_text=with_text, text_stats=text_stats)
    content, meta = adapters.split_content_meta(reviews)
    if with_text and not text_stats:
        content = adapters.split_content_meta(adapters.reviews_orders(spark, sf_dir, key_only=True))[0]
        return adapters.order_texts(spark, sf_dir, prep.left_join_reviews(content, meta), presence)
    return prep.left_join_reviews(content, meta)


def labelled_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1 output with ``label_fixed`` (P4), text left out."""
    return joined_orders(spark, sf_dir, with_text=False).withColumn("label_fixed", label_fixed("label"))


@query("left_join_reviews", f"""
WITH {ORDERS}, {J1}
SELECT review_id, user_id, prod_id, date, Review, meta_id, rating, label FROM joined""")
def left_join_reviews(spark, sf_dir):
    """Content LEFT JOIN metadata on (user_id, prod_id, date)."""
    return joined_orders(spark, sf_dir).select("review_id", "user_id", "prod_id", "date", "Review",
                                               "meta_id", "rating", "label")


@query("preview_top5", f"""
WITH {ORDERS}, {J1}
SELECT review_id, user_id, prod_id, date, rating, label FROM joined ORDER BY review_id LIMIT 5""")
def preview_top5(spark, sf_dir):
    """First five joined rows by review id (a top-5 report)."""
    j = joined_orders(spark, sf_dir, with_text=False)
    return sinks.preview(j.select("review_id", "user_id", "prod_id", "date", "rating", "label"), "review_id")


_NULL_COLS = ["review_id", "user_id", "prod_id", "date", "Review", "meta_id", "rating", "label"]


@query("null_profile", f"""
WITH {ORDERS}, {J1}
SELECT * FROM (
""" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS null_count FROM joined"
    for c in _NULL_COLS) + ")")
def null_profile(spark, sf_dir):
    """NULL count of every column of the joined table."""
    return prep.null_profile(joined_orders(spark, sf_dir, presence=True).select(*_NULL_COLS))


@query("label_map_recode", f"""
WITH {ORDERS_NOTEXT}, {J1}
SELECT review_id, label,
       CASE WHEN label = -1 THEN 'Spam' WHEN label = 1 THEN 'Non‑Spam' END AS label_name,
       CASE WHEN label = -1 THEN 0 ELSE label END AS label_fixed
FROM joined""")
def label_map_recode(spark, sf_dir):
    """P3 (map, unmapped -> NULL) and P4 (recode, unmapped unchanged)."""
    j = joined_orders(spark, sf_dir, with_text=False)
    return j.select("review_id", "label", label_name("label").alias("label_name"),
                    label_fixed("label").alias("label_fixed"))


@query("class_distribution", f"""
WITH {ORDERS_NOTEXT}, {J1},
named AS (SELECT CASE WHEN label = -1 THEN 'Spam' WHEN label = 1 THEN 'Non‑Spam' END AS label_name FROM joined)
SELECT label_name, round(count(*) * 100.0 / (SELECT count(*) FROM named WHERE label_name IS NOT NULL), 6) AS pct
FROM named WHERE label_name IS NOT NULL GROUP BY label_name""")
def class_distribution(spark, sf_dir):
    """A1: class shares in percent, NULL excluded."""
    return prep.class_distribution(joined_orders(spark, sf_dir, with_text=False))


@query("imbalance_ratio", f"""
WITH {ORDERS_NOTEXT}, {J1},
lf AS (SELECT CASE WHEN label = -1 THEN 0 ELSE label END AS label_fixed FROM joined)
SELECT count(*) FILTER (WHERE label_fixed = 0) AS neg, count(*) FILTER (WHERE label_fixed = 1) AS pos,
       round(CAST(count(*) FILTER (WHERE label_fixed = 0) AS DOUBLE)
             / nullif(count(*) FILTER (WHERE label_fixed = 1), 0), 6) AS ratio
FROM lf""")
def imbalance_ratio(spark, sf_dir):
    """A10 (+P10): negatives / positives."""
    return prep.imbalance_ratio(labelled_orders(spark, sf_dir))


@query("class_weights", f"""
WITH {ORDERS_NOTEXT}, {J1},
lf AS (SELECT CASE WHEN label = -1 THEN 0 ELSE label END AS label_fixed FROM joined WHERE label IS NOT NULL),
c AS (SELECT label_fixed, count(*) AS n_class FROM lf GROUP BY label_fixed)
SELECT label_fixed, n_class,
       round((SELECT sum(n_class) FROM c) / ((SELECT count(*) FROM c) * CAST(n_class AS DOUBLE)), 6) AS weight
FROM c""")
def class_weights(spark, sf_dir):
    """M9: balanced class weights n / (2 n_c)."""
    return prep.class_weights(labelled_orders(spark, sf_dir))


def _strat_sql(frac: float, label: str, flag: str | None, seed: int = 42) -> str:
    order = f"md5(CAST(review_id AS VARCHAR) || '|{seed}'), review_id"
    ranked = f"""ranked AS (
  SELECT review_id, {label}, rating,
         row_number() OVER (PARTITION BY {label} ORDER BY {order}) AS rn,
         ceil({frac} * count(*) OVER (PARTITION BY {label})) AS k
  FROM base WHERE {label} IS NOT NULL)"""
    if flag:
        return f"{ranked}\nSELECT review_id, {label}, rn <= k AS {flag} FROM ranked"
    return f"{ranked}\nSELECT review_id, {label}, rating FROM ranked WHERE rn <= k"


@query("stratified_sample", f"""
WITH {ORDERS_NOTEXT}, {J1}, base AS (SELECT * FROM joined),
""" + _strat_sql(0.1, "label", None))
def stratified_sample(spark, sf_dir):
    """K1: 10 % per class, hash order with seed 42 (NULL labels dropped)."""
    j = joined_orders(spark, sf_dir, with_text=False)
    return sampling.stratified_sample(j, "label", 0.10, seed=42).select("review_id", "label", "rating")


@query("train_val_split", f"""
WITH {ORDERS_NOTEXT}, {J1},
base AS (SELECT *, CASE WHEN label = -1 THEN 0 ELSE label END AS label_fixed FROM joined),
""" + _strat_sql(0.2, "label_fixed", "is_val"))
def train_val_split(spark, sf_dir):
    """K2: stratified 80/20 split flag."""
    return sampling.train_val_split(labelled_orders(spark, sf_dir), "label_fixed", 0.2, seed=42) \
                   .select("review_id", "label_fixed", "is_val")


@query("kfold", f"""
WITH {ORDERS_NOTEXT}, {J1},
base AS (SELECT *, CASE WHEN label = -1 THEN 0 ELSE label END AS label_fixed FROM joined WHERE label IS NOT NULL)
SELECT review_id, label_fixed,
       CAST((row_number() OVER (PARTITION BY label_fixed
             ORDER BY md5(CAST(review_id AS VARCHAR) || '|42'), review_id) - 1) % 5 AS INTEGER) AS fold
FROM base""")
def kfold(spark, sf_dir):
    """K3: stratified 5-fold assignment."""
    return sampling.kfold(labelled_orders(spark, sf_dir), "label_fixed", 5, seed=42) \
                   .select("review_id", "label_fixed", "fold")


# ---- building blocks ------------------------------------------------------------

@query("project_derive", f"""
WITH {ORDERS_NOTEXT}, {J1}
SELECT review_id, rating, label, round(rating * 2 - 1, 6) AS rating_scaled,
       CASE WHEN label = -1 THEN 0 ELSE label END AS label_fixed
FROM joined""")
def project_derive(spark, sf_dir):
    """Projection and derived columns (``withColumns``)."""
    j = joined_orders(spark, sf_dir, with_text=False).select("review_id", "rating", "label")
    return j.withColumns({"rating_scaled": F.col("rating") * 2 - 1, "label_fixed": label_fixed("label")})


@query("safe_casts", f"""
WITH {ORDERS_NOTEXT}
SELECT review_id, try_strptime(CAST(CAST(date AS DATE) AS VARCHAR), '%Y-%m-%d') AS parsed,
       CAST(trunc(rating * 1.7) AS INTEGER) AS rating_int,
       try_strptime(CAST(review_id AS VARCHAR) || '-13-45', '%Y-%m-%d') AS bad_date
FROM reviews_orders""")
def safe_casts(spark, sf_dir):
    """P5 (string -> timestamp, unparsable -> NULL) and P6 (truncating int)."""
    r = adapters.reviews_orders(spark, sf_dir, with_text=False)
    return r.select("review_id",
                    to_timestamp_safe(F.date_format("date", "yyyy-MM-dd")).cast("timestamp_ntz").alias("parsed"),
                    truncate_int(F.col("rating") * 1.7).alias("rating_int"),
                    to_timestamp_safe(F.concat(F.col("review_id").cast("string"), F.lit("-13-45")))
                    .cast("timestamp_ntz").alias("bad_date"))


@query("null_fill", f"""
WITH {ORDERS_NOTEXT}, {J1}
SELECT review_id, coalesce(rating, 0.0) AS rating_filled FROM joined""")
def null_fill(spark, sf_dir):
    """NULL -> 0."""
    j = joined_orders(spark, sf_dir, with_text=False)
    return j.select("review_id", fill_zero("rating").alias("rating_filled"))


@query("threshold_predict", """
SELECT doc_id, CAST(round(CAST(doc_id * 7919 % 23 AS DOUBLE) / 23, 2) >= 0.5 AS INTEGER) AS pred FROM labels""")
def threshold_predict_q(spark, sf_dir):
    """Score >= t (inclusive) -> 1."""
    lab = adapters.load_table(spark, sf_dir, "labels")
    score = F.round((F.col("doc_id") * 7919 % 23).cast("double") / 23, 2)
    return lab.select("doc_id", threshold_predict(score, 0.5).alias("pred"))


@query("count_where", f"""
WITH {ORDERS_NOTEXT}, {J1}
SELECT count(*) FILTER (WHERE label = 1) AS n_pos, count(*) FILTER (WHERE label = -1) AS n_neg,
       count(*) FILTER (WHERE label IS NULL) AS n_null FROM joined""")
def count_where(spark, sf_dir):
    """P10: predicate counts."""
    j = joined_orders(spark, sf_dir, with_text=False)
    return j.agg(F.count_if(F.col("label") == 1).alias("n_pos"), F.count_if(F.col("label") == -1).alias("n_neg"),
                 F.count_if(F.col("label").isNull()).alias("n_null"))


@query("tsv_round_trip", f"""
WITH {EVENTS},
c AS (SELECT user_id, prod_id, CAST(epoch_us(date) AS VARCHAR) AS date, Review FROM reviews_events),
m AS (SELECT user_id, prod_id, rating, label, CAST(epoch_us(date) AS VARCHAR) AS date FROM reviews_events WHERE review_id % 50 <> 0)
SELECT c.user_id, c.prod_id, c.date, c.Review, m.rating, m.label
FROM c LEFT JOIN m ON c.user_id = m.user_id AND c.prod_id = m.prod_id AND c.date = m.date""")
def tsv_round_trip(spark, sf_dir):
    """S1, S2 (+J1): content and metadata written as tab-separated files to
    the shared folder, read back with the two scans, and joined."""
    import uuid

    from fraudlens.session import ensure_checkpoint_dir
    from fraudlens.sources import tsv
    ev = adapters.reviews_events(spark, sf_dir).withColumn(
        "date", F.unix_micros(F.col("date").cast("timestamp")).cast("string"))
    home = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tsv-{uuid.uuid4().hex}"
    tsv.write_tsv(ev.select("user_id", "prod_id", "date", "Review"), f"{home}/content")
    tsv.write_tsv(ev.where(F.col("review_id") % 50 != 0).select("user_id", "prod_id", "rating", "label", "date"), f"{home}/metadata")
    j = prep.left_join_reviews(tsv.read_content(spark, f"{home}/content"), tsv.read_metadata(spark, f"{home}/metadata"))
    return j.select("user_id", "prod_id", "date", "Review", "rating", "label")


@query("tsv_graph", f"""
WITH {EVENTS} SELECT review_id AS "ID", user_id AS unknown, rating AS "Rating" FROM reviews_events""")
def tsv_graph(spark, sf_dir):
    """S3: the three-column label file, written and scanned."""
    import uuid

    from fraudlens.session import ensure_checkpoint_dir
    from fraudlens.sources import tsv
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tsv-graph-{uuid.uuid4().hex}"
    tsv.write_tsv(adapters.reviews_events(spark, sf_dir).select("review_id", "user_id", "rating"), path)
    return tsv.read_graph(spark, path)
