"""Oracle SQL (DuckDB dialect) for the registered queries.

Each text repeats a query's definition independently of Spark: the same
adapters, the brute-force form of every operator (plain windows, cross
joins of small fixtures), doubles rounded to 6 places as on the Spark side.
"""

from __future__ import annotations

# ---- adapters ----------------------------------------------------------------

ORDERS = """
reviews_orders AS (
  SELECT o.o_orderkey AS review_id, o.o_custkey AS user_id, fp.prod_id AS prod_id,
         o.o_orderdate AS date,
         CAST(substring(o.o_orderpriority, 1, 1) AS DOUBLE) AS rating,
         CASE WHEN o.o_orderstatus = 'F' AND o.o_orderkey % 3 = 0 THEN -1 ELSE 1 END AS label,
         d.text AS Review
  FROM orders o
  LEFT JOIN (SELECT l_orderkey, min(l_partkey) AS prod_id FROM lineitem GROUP BY l_orderkey) fp
         ON o.o_orderkey = fp.l_orderkey
  LEFT JOIN documents d ON d.doc_id = o.o_orderkey % (SELECT count(*) FROM documents)
)"""

ORDERS_NOTEXT = """
reviews_orders AS (
  SELECT o.o_orderkey AS review_id, o.o_custkey AS user_id, fp.prod_id AS prod_id,
         o.o_orderdate AS date,
         CAST(substring(o.o_orderpriority, 1, 1) AS DOUBLE) AS rating,
         CASE WHEN o.o_orderstatus = 'F' AND o.o_orderkey % 3 = 0 THEN -1 ELSE 1 END AS label,
         CAST(NULL AS VARCHAR) AS Review
  FROM orders o
  LEFT JOIN (SELECT l_orderkey, min(l_partkey) AS prod_id FROM lineitem GROUP BY l_orderkey) fp
         ON o.o_orderkey = fp.l_orderkey
)"""

J1 = """
content AS (SELECT review_id, user_id, prod_id, date, Review FROM reviews_orders),
meta AS (SELECT review_id AS meta_id, user_id, prod_id, rating, label, date FROM reviews_orders),
joined AS (
  SELECT c.review_id, c.user_id, c.prod_id, c.date, c.Review, m.meta_id, m.rating, m.label
  FROM content c LEFT JOIN meta m
    ON c.user_id = m.user_id AND c.prod_id = m.prod_id AND c.date = m.date
)"""

EVENTS = """
reviews_events AS (
  SELECT event_id AS review_id, user_id,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS prod_id,
         ts AS date, event_type AS Review,
         1.0 + least(4.0, CAST(floor(value / 50) AS DOUBLE)) AS rating,
         CASE WHEN event_type = 'error' THEN -1 ELSE 1 END AS label
  FROM events
)"""

DOCS = """
reviews_docs AS (
  SELECT d.doc_id AS review_id, d.doc_id % 97 AS user_id, d.doc_id % 41 AS prod_id,
         CAST(DATE '2024-01-01' + CAST(d.doc_id * 37 % 365 AS INTEGER) AS TIMESTAMP) AS date,
         d.text AS Review, CAST(1 + d.doc_id * d.doc_id % 5 AS DOUBLE) AS rating,
         CASE WHEN l.quality = 0 THEN -1 ELSE 1 END AS label
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id
)"""

SCORES = """
scored AS (
  SELECT doc_id, quality AS label,
         round(CAST(doc_id * 7919 % 23 AS DOUBLE) / 23, 2) AS score
  FROM labels
)"""

SCORES_MULTI = """
scored_multi AS (
  SELECT 'mod23' AS model, doc_id, quality AS label,
         round(CAST(doc_id * 7919 % 23 AS DOUBLE) / 23, 2) AS score FROM labels
  UNION ALL
  SELECT 'mod101', doc_id, quality, round(CAST(doc_id * 104729 % 101 AS DOUBLE) / 101, 3) FROM labels
  UNION ALL
  SELECT 'toxic_mix', doc_id, quality, round((toxic + CAST(doc_id % 7 AS DOUBLE) / 7) / 2, 3) FROM labels
)"""

GRID = "(0.01 + CAST(j AS DOUBLE) * 0.98 / 199.0)"


def behavior_sql(base: str, base_name: str) -> str:
    """All 14 behavioural features over a review CTE (brute-force windows)."""
    return f"""WITH {base},
n AS (
  SELECT review_id, user_id, prod_id, date, rating, label,
         length(Review) AS review_len,
         CAST(len(regexp_extract_all(Review, '\\S+')) AS BIGINT) AS word_count,
         Review IS NOT NULL AS has_text
  FROM {base_name}
),
g AS (
  SELECT *,
    CASE WHEN user_id IS NULL THEN 0.0 ELSE coalesce(
      (epoch_us(date) - epoch_us(lag(date) OVER (PARTITION BY user_id ORDER BY date NULLS FIRST, review_id))) / 1e6,
      0.0) END AS tsp,
    CASE WHEN prod_id IS NULL THEN 0.0 ELSE coalesce(
      (epoch_us(date) - epoch_us(lag(date) OVER (PARTITION BY prod_id ORDER BY date NULLS FIRST, review_id))) / 1e6,
      0.0) END AS tspp
  FROM n
),
bnd AS (SELECT min(tsp) AS mn1, max(tsp) AS mx1, min(tspp) AS mn2, max(tspp) AS mx2 FROM g),
s AS (
  SELECT g.*,
    coalesce((tsp - mn1) / nullif(mx1 - mn1, 0), 0.0) AS time_since_prev,
    coalesce((tspp - mn2) / nullif(mx2 - mn2, 0), 0.0) AS time_since_prev_prod
  FROM g, bnd
),
u AS (
  SELECT user_id, count(*) FILTER (WHERE has_text) AS user_review_count,
         avg(rating) AS user_avg_rating, coalesce(var_samp(rating), 0.0) AS user_rating_var,
         avg(time_since_prev) AS user_time_mean,
         coalesce(stddev_samp(time_since_prev), 0.0) AS user_time_std
  FROM s WHERE user_id IS NOT NULL GROUP BY user_id
),
rc AS (
  SELECT user_id, CAST(trunc(rating) AS INTEGER) AS r, count(*) AS c
  FROM n WHERE user_id IS NOT NULL AND CAST(trunc(rating) AS INTEGER) >= 1 GROUP BY 1, 2
),
ent AS (
  SELECT u0.user_id, coalesce(e.h, 0.0) AS user_rating_entropy
  FROM (SELECT DISTINCT user_id FROM n WHERE user_id IS NOT NULL) u0
  LEFT JOIN (
    SELECT user_id, sum(-(p * ln(p))) AS h
    FROM (SELECT user_id, CAST(c AS DOUBLE) / sum(c) OVER (PARTITION BY user_id) AS p FROM rc) q
    GROUP BY user_id) e ON u0.user_id = e.user_id
),
p AS (
  SELECT prod_id, count(*) FILTER (WHERE has_text) AS prod_target_count,
         avg(rating) AS prod_mean, coalesce(var_samp(rating), 0.0) AS prod_rating_var
  FROM s WHERE prod_id IS NOT NULL GROUP BY prod_id
),
up AS (
  SELECT user_id, prod_id, count(*) FILTER (WHERE has_text) AS user_prod_review_count
  FROM s WHERE user_id IS NOT NULL AND prod_id IS NOT NULL GROUP BY user_id, prod_id
),
feat AS (
  SELECT s.review_id, s.user_id, s.prod_id, s.label,
         s.review_len, s.word_count, s.time_since_prev, s.time_since_prev_prod,
         p.prod_target_count, abs(s.rating - p.prod_mean) AS rating_dev,
         u.user_review_count, u.user_avg_rating, u.user_rating_var, u.user_time_mean,
         u.user_time_std, ent.user_rating_entropy,
         CASE WHEN s.prod_id IS NULL THEN 0.0 ELSE p.prod_rating_var END AS prod_rating_var,
         up.user_prod_review_count
  FROM s
  LEFT JOIN u ON s.user_id = u.user_id
  LEFT JOIN ent ON s.user_id = ent.user_id
  LEFT JOIN p ON s.prod_id = p.prod_id
  LEFT JOIN up ON s.user_id = up.user_id AND s.prod_id = up.prod_id
)"""


BEHAVIOR_COLS = ["review_len", "word_count", "time_since_prev", "time_since_prev_prod",
                 "prod_target_count", "rating_dev", "user_review_count", "user_avg_rating",
                 "user_rating_var", "user_time_mean", "user_time_std", "user_rating_entropy",
                 "prod_rating_var", "user_prod_review_count"]

INT_BEHAVIOR = {"review_len", "word_count", "prod_target_count", "user_review_count",
                "user_prod_review_count"}


def r6(expr: str, alias: str | None = None) -> str:
    return f"round({expr}, 6) AS {alias or expr}"


def feat_select(cols=BEHAVIOR_COLS) -> str:
    return ", ".join(c if c in INT_BEHAVIOR else r6(c) for c in cols)
