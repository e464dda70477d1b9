"""Registered queries: windows and behavioural features (W, B, A2-A8, A12, X1, J2)."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from fraudlens.functions.columns import seconds_between
from fraudlens.operators import behavior, features, prep
from fraudlens.plans.q_prep import joined_orders
from fraudlens.plans.registry import query
from fraudlens.plans.sql import EVENTS, J1, ORDERS, behavior_sql, feat_select
from fraudlens.sources import adapters

GAP_SQL = """
SELECT review_id, {key},
  round(CASE WHEN {key} IS NULL THEN 0.0 ELSE coalesce(
    (epoch_us(date) - epoch_us(lag(date) OVER (PARTITION BY {key} ORDER BY date NULLS FIRST, review_id))) / 1e6,
    0.0) END, 6) AS {out}
FROM reviews_events"""


@query("user_gap", f"WITH {EVENTS}" + GAP_SQL.format(key="user_id", out="gap_seconds"))
def user_gap(spark: SparkSession, sf_dir: str):
    """W1 (+D1): seconds since the same user's previous review (events adapter)."""
    ev = adapters.reviews_events(spark, sf_dir)
    return behavior.time_gap(ev, "user_id", "gap_seconds").select("review_id", "user_id", "gap_seconds")


@query("product_gap", f"WITH {EVENTS}" + GAP_SQL.format(key="prod_id", out="gap_seconds"))
def product_gap(spark, sf_dir):
    """Seconds since the same product's previous review."""
    ev = adapters.reviews_events(spark, sf_dir)
    return behavior.time_gap(ev, "prod_id", "gap_seconds").select("review_id", "prod_id", "gap_seconds")


_EVENT_FEATS = behavior_sql(EVENTS, "reviews_events")


@query("minmax_gap", _EVENT_FEATS + """
SELECT review_id, round(time_since_prev, 6) AS time_since_prev,
       round(time_since_prev_prod, 6) AS time_since_prev_prod FROM feat""")
def minmax_gap(spark, sf_dir):
    """W3 (+B3, B4): both gaps min-max scaled over the table."""
    ev = adapters.reviews_events(spark, sf_dir)
    g = behavior.with_time_gaps(behavior.narrow_reviews(ev))
    return g.select("review_id", "time_since_prev", "time_since_prev_prod")


@query("text_stats", f"""
WITH {ORDERS}
SELECT review_id, length(Review) AS review_len,
       CAST(len(regexp_extract_all(Review, '\\S+')) AS BIGINT) AS word_count
FROM reviews_orders""")
def text_stats(spark, sf_dir):
    """B1, B2 (F1, F2): characters and whitespace tokens of every whole text."""
    r = adapters.reviews_orders(spark, sf_dir, text_stats=True)
    return r.select("review_id", "review_len", "word_count")


@query("user_profile", f"""
WITH {ORDERS}, {J1}
SELECT user_id, count(Review) AS user_review_count, round(avg(rating), 6) AS user_avg_rating,
       round(coalesce(var_samp(rating), 0.0), 6) AS user_rating_var
FROM joined WHERE user_id IS NOT NULL GROUP BY user_id""")
def user_profile(spark, sf_dir):
    """B7-B9 (A2-A4): per-user count of texts, mean and sample variance of ratings."""
    n = behavior.narrow_reviews(joined_orders(spark, sf_dir, text_stats=True))
    return n.where(F.col("user_id").isNotNull()).groupBy("user_id").agg(*behavior.user_profile_aggs())


@query("user_time_profile", _EVENT_FEATS + """
SELECT DISTINCT user_id, round(user_time_mean, 6) AS user_time_mean, round(user_time_std, 6) AS user_time_std
FROM feat WHERE user_id IS NOT NULL""")
def user_time_profile(spark, sf_dir):
    """B10, B11 (A3, A5): mean and sample std of each user's scaled gap."""
    ev = adapters.reviews_events(spark, sf_dir)
    g = behavior.with_time_gaps(behavior.narrow_reviews(ev))
    return g.where(F.col("user_id").isNotNull()).groupBy("user_id").agg(*behavior.user_time_aggs())


@query("user_rating_entropy", _EVENT_FEATS + """
SELECT user_id, round(user_rating_entropy, 6) AS user_rating_entropy FROM ent""")
def user_rating_entropy(spark, sf_dir):
    """B12 (A8, U1): Shannon entropy of each user's ratings."""
    ev = adapters.reviews_events(spark, sf_dir)
    return behavior.user_rating_entropy(ev)


_ORDER_FEATS = behavior_sql(f"{ORDERS}, {J1}", "joined")


@query("product_profile", _ORDER_FEATS + """
SELECT review_id, prod_target_count, round(rating_dev, 6) AS rating_dev,
       round(prod_rating_var, 6) AS prod_rating_var FROM feat""")
def product_profile(spark, sf_dir):
    """B5, B6, B13 (J2): per-product count, deviation from product mean, variance."""
    n = behavior.narrow_reviews(joined_orders(spark, sf_dir, text_stats=True))
    out = prep.aggregate_back(n, ["prod_id"], behavior.product_aggs())
    return out.select("review_id", "prod_target_count",
                      F.abs(F.col("rating") - F.col("_prod_mean")).alias("rating_dev"),
                      F.when(F.col("prod_id").isNull(), F.lit(0.0)).otherwise(F.col("prod_rating_var"))
                      .alias("prod_rating_var"))


@query("user_product_count", _ORDER_FEATS + """
SELECT review_id, user_prod_review_count FROM feat""")
def user_product_count(spark, sf_dir):
    """B14 (A6): reviews by the same user of the same product."""
    n = behavior.narrow_reviews(joined_orders(spark, sf_dir, text_stats=True))
    out = prep.aggregate_back(n, ["user_id", "prod_id"],
                              [F.count_if(F.col("_has_text")).alias("user_prod_review_count")])
    return out.select("review_id", "user_prod_review_count")


@query("behavior_features", _ORDER_FEATS + f"""
SELECT review_id, user_id, prod_id, label, {feat_select()} FROM feat""")
def behavior_features(spark, sf_dir):
    """The 14 behavioural features of every joined review."""
    return behavior.behavior_features(joined_orders(spark, sf_dir, text_stats=True))


def _zscore_sql(base_sql: str) -> str:
    cols = behavior.BEHAVIOR_COLUMNS
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in cols)
    z = ", ".join(
        f"round(CASE WHEN s_{c} = 0 THEN {c} - m_{c} ELSE ({c} - m_{c}) / s_{c} END, 6) AS {c}" for c in cols)
    return base_sql + f""",
st AS (SELECT {stats} FROM feat)
SELECT review_id, label, {z} FROM feat, st"""


@query("zscore_features", _zscore_sql(_ORDER_FEATS))
def zscore_features(spark, sf_dir):
    """Z-score of the 14 features with the population std (constant -> 0)."""
    f = behavior.behavior_features(joined_orders(spark, sf_dir, text_stats=True))
    return features.zscore_columns(f, behavior.BEHAVIOR_COLUMNS).select("review_id", "label",
                                                                        *behavior.BEHAVIOR_COLUMNS)


def _box_sql() -> str:
    feats = behavior.BOX_FEATURES
    unp = "\nUNION ALL\n".join(
        f"SELECT label_name, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM named WHERE {c} IS NOT NULL"
        for c in feats)
    return _EVENT_FEATS + f""",
named AS (SELECT *, CASE WHEN label = -1 THEN 'Spam' WHEN label = 1 THEN 'Non‑Spam' END AS label_name FROM feat),
lng AS ({unp}),
q AS (SELECT label_name, feature, count(*) AS n, quantile_cont(value, 0.25) AS q1,
             quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3
      FROM lng GROUP BY label_name, feature),
b AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT b.label_name, b.feature, b.n, round(b.q1, 6) AS q1, round(b.median, 6) AS median, round(b.q3, 6) AS q3,
       round(min(l.value) FILTER (WHERE l.value >= b.lo AND l.value <= b.hi), 6) AS whisker_low,
       round(max(l.value) FILTER (WHERE l.value >= b.lo AND l.value <= b.hi), 6) AS whisker_high,
       count(*) FILTER (WHERE l.value < b.lo OR l.value > b.hi) AS n_outliers
FROM b JOIN lng l ON b.label_name IS NOT DISTINCT FROM l.label_name AND b.feature = l.feature
GROUP BY b.label_name, b.feature, b.n, b.q1, b.median, b.q3"""


@query("box_stats", _box_sql())
def box_stats(spark, sf_dir):
    """Per class and feature, quartiles, whiskers and outlier count
    (the data behind the 14 box plots), events adapter."""
    ev = adapters.reviews_events(spark, sf_dir)
    return behavior.box_stats(behavior.behavior_features(ev))


# ---- building blocks --------------------------------------------------------------

@query("aggregate_back_join", f"""
WITH {EVENTS}
SELECT r.review_id, r.user_id, g.n_user, round(g.mean_value, 6) AS mean_rating
FROM reviews_events r LEFT JOIN (
  SELECT user_id, count(*) AS n_user, avg(rating) AS mean_value FROM reviews_events
  WHERE user_id IS NOT NULL GROUP BY user_id) g ON r.user_id = g.user_id""")
def aggregate_back_join(spark, sf_dir):
    """Group aggregates broadcast back to every row of the group."""
    ev = adapters.reviews_events(spark, sf_dir)
    out = prep.aggregate_back(ev, ["user_id"], [F.count(F.lit(1)).alias("n_user"),
                                                F.avg("rating").alias("mean_rating")])
    return out.select("review_id", "user_id", "n_user", "mean_rating")


@query("group_stats", f"""
WITH {EVENTS}
SELECT prod_id, count(rating) AS n, round(avg(rating), 6) AS mean,
       round(coalesce(var_samp(rating), 0.0), 6) AS var, round(coalesce(stddev_samp(rating), 0.0), 6) AS std
FROM reviews_events GROUP BY prod_id""")
def group_stats(spark, sf_dir):
    """A2-A5: count, mean, sample variance and std per group (1-row -> 0)."""
    ev = adapters.reviews_events(spark, sf_dir)
    return ev.groupBy("prod_id").agg(F.count("rating").alias("n"), F.avg("rating").alias("mean"),
                                     F.coalesce(F.var_samp("rating"), F.lit(0.0)).alias("var"),
                                     F.coalesce(F.stddev_samp("rating"), F.lit(0.0)).alias("std"))


@query("pair_counts", f"""
WITH {EVENTS}
SELECT user_id, prod_id, count(Review) AS n FROM reviews_events GROUP BY user_id, prod_id""")
def pair_counts(spark, sf_dir):
    """Multi-key group count."""
    ev = adapters.reviews_events(spark, sf_dir)
    return ev.groupBy("user_id", "prod_id").agg(F.count("Review").alias("n"))


@query("global_bounds", f"""
WITH {EVENTS}
SELECT min(rating) AS min_rating, max(rating) AS max_rating, min(date) AS min_date, max(date) AS max_date
FROM reviews_events""")
def global_bounds(spark, sf_dir):
    """Global min / max (one row)."""
    ev = adapters.reviews_events(spark, sf_dir)
    return ev.agg(F.min("rating").alias("min_rating"), F.max("rating").alias("max_rating"),
                  F.min("date").alias("min_date"), F.max("date").alias("max_date"))


@query("entropy", f"""
WITH {EVENTS},
rc AS (SELECT prod_id, CAST(trunc(rating) AS INTEGER) AS r, count(*) AS c FROM reviews_events
       WHERE prod_id IS NOT NULL AND CAST(trunc(rating) AS INTEGER) >= 1 GROUP BY 1, 2)
SELECT u.prod_id, round(coalesce(e.h, 0.0), 6) AS entropy
FROM (SELECT DISTINCT prod_id FROM reviews_events WHERE prod_id IS NOT NULL) u LEFT JOIN (
  SELECT prod_id, sum(-(p * ln(p))) AS h
  FROM (SELECT prod_id, CAST(c AS DOUBLE) / sum(c) OVER (PARTITION BY prod_id) AS p FROM rc) q
  GROUP BY prod_id) e ON u.prod_id = e.prod_id""")
def entropy(spark, sf_dir):
    """Rating entropy, here per product."""
    ev = adapters.reviews_events(spark, sf_dir)
    return behavior.user_rating_entropy(ev, user_col="prod_id").withColumnRenamed("user_rating_entropy", "entropy")


@query("scalar_mix", f"""
WITH {EVENTS}
SELECT review_id, length(Review) AS n_chars, CAST(len(regexp_extract_all(Review, '\\S+')) AS BIGINT) AS n_words,
       round(abs(rating - 3.0), 6) AS abs_dev, round(ln(rating), 6) AS log_rating,
       round((epoch_us(date) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 1e6, 6) AS secs_since_2024,
       round((rating * 2.0 - 1.0) / (rating + 1.0), 6) AS arith
FROM reviews_events""")
def scalar_mix(spark, sf_dir):
    """Length, word split, abs, ln, timestamp difference in seconds, arithmetic."""
    ev = adapters.reviews_events(spark, sf_dir)
    from fraudlens.functions.columns import text_length, word_count
    return ev.select("review_id", text_length("Review").alias("n_chars"), word_count("Review").alias("n_words"),
                     F.abs(F.col("rating") - 3.0).alias("abs_dev"), F.ln("rating").alias("log_rating"),
                     seconds_between(F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.col("date"))
                     .alias("secs_since_2024"),
                     ((F.col("rating") * 2.0 - 1.0) / (F.col("rating") + 1.0)).alias("arith"))
