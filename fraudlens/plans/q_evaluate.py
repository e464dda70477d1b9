"""Registered queries: evaluation (V1-V9), agreement (G6, G7, A9), D2, D3.

Scores are model-free so that SQL can repeat them: label = ``quality`` of
``labels``, score = a rounded hash of the id (many ties on purpose).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fraudlens.operators import evaluate
from fraudlens.operators.ordering import ordered_rank
from fraudlens.plans.registry import query
from fraudlens.plans.sql import EVENTS, GRID, SCORES, SCORES_MULTI
from fraudlens.sources import adapters


def scored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = adapters.load_table(spark, sf_dir, "labels")
    return lab.select("doc_id", F.col("quality").alias("label"),
                      F.round((F.col("doc_id") * 7919 % 23).cast("double") / 23, 2).alias("score"))


def scored_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = adapters.load_table(spark, sf_dir, "labels")
    d = F.col("doc_id")

    def one(name, score):
        return lab.select(F.lit(name).alias("model"), "doc_id", F.col("quality").alias("label"), score.alias("score"))

    return (one("mod23", F.round((d * 7919 % 23).cast("double") / 23, 2))
            .unionByName(one("mod101", F.round((d * 104729 % 101).cast("double") / 101, 3)))
            .unionByName(one("toxic_mix", F.round((F.col("toxic") + (d % 7).cast("double") / 7) / 2, 3))))


_BALACC = """(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0.0) + coalesce(CAST(tn AS DOUBLE) / nullif(tn + fp, 0), 0.0))
  / nullif((CASE WHEN tp + fn > 0 THEN 1 ELSE 0 END) + (CASE WHEN tn + fp > 0 THEN 1 ELSE 0 END), 0)"""


def _sweep_sql(src: str, keys: str = "") -> str:
    kc = f"{keys}, " if keys else ""
    gb = f", {keys}" if keys else ""
    return f"""
grid AS (SELECT CAST(range AS INTEGER) AS j FROM range(200)),
cnt AS (
  SELECT {kc}g.j, {GRID} AS threshold,
         count(*) FILTER (WHERE s.score >= {GRID} AND s.label = 1) AS tp,
         count(*) FILTER (WHERE s.score >= {GRID} AND s.label = 0) AS fp,
         count(*) FILTER (WHERE s.score < {GRID} AND s.label = 0) AS tn,
         count(*) FILTER (WHERE s.score < {GRID} AND s.label = 1) AS fn
  FROM grid g, {src} s GROUP BY g.j{gb}),
sweep AS (SELECT *, {_BALACC} AS balanced_accuracy FROM cnt)"""


@query("threshold_sweep", f"WITH {SCORES}," + _sweep_sql("scored") + """
SELECT j, round(threshold, 6) AS threshold, tp, fp, tn, fn, round(balanced_accuracy, 6) AS balanced_accuracy
FROM sweep""")
def threshold_sweep(spark, sf_dir):
    """V1 (+F8, P7): balanced accuracy at the 200 grid thresholds."""
    return evaluate.threshold_sweep(scored_labels(spark, sf_dir))


@query("best_threshold", f"WITH {SCORES}," + _sweep_sql("scored") + """
SELECT j, round(threshold, 6) AS threshold, tp, fp, tn, fn, round(balanced_accuracy, 6) AS balanced_accuracy
FROM sweep ORDER BY balanced_accuracy DESC, j LIMIT 1""")
def best_threshold(spark, sf_dir):
    """V2 (D3): argmax of balanced accuracy, first maximum wins."""
    return evaluate.best_threshold(evaluate.threshold_sweep(scored_labels(spark, sf_dir)))


_AUC_PAIRS = """
auc AS (
  SELECT {kp}(sum(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0.0 END)
          / (count(*))) AS roc_auc
  FROM {src} p JOIN {src} n ON p.label = 1 AND n.label = 0 {kj} {gb})"""


def _auc_sql(src: str, keys: str = "") -> str:
    return _AUC_PAIRS.format(src=src, kp=f"p.{keys}, " if keys else "",
                             kj=f"AND p.{keys} = n.{keys}" if keys else "",
                             gb=f"GROUP BY p.{keys}" if keys else "")


@query("metrics_at_threshold", f"WITH {SCORES}," + _sweep_sql("scored") + "," + _auc_sql("scored") + """,
best AS (SELECT * FROM sweep ORDER BY balanced_accuracy DESC, j LIMIT 1)
SELECT round(threshold, 6) AS threshold,
       round(CAST(tp + tn AS DOUBLE) / (tp + fp + tn + fn), 6) AS accuracy,
       round(balanced_accuracy, 6) AS balanced_accuracy,
       round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END, 6) AS f1,
       round(roc_auc, 6) AS roc_auc
FROM best, auc""")
def metrics_at_threshold(spark, sf_dir):
    """V3-V5, V8: accuracy, balanced accuracy, F1 and AUC at the best threshold."""
    return evaluate.metrics_at_best_threshold(scored_labels(spark, sf_dir))


@query("roc_auc", f"WITH {SCORES}," + _auc_sql("scored") + """
SELECT round(roc_auc, 6) AS roc_auc,
       (SELECT count(*) FROM scored WHERE label = 1) AS n_pos,
       (SELECT count(*) FROM scored WHERE label = 0) AS n_neg FROM auc""")
def roc_auc(spark, sf_dir):
    """V6 (J4): ROC AUC, ties half, by the Mann-Whitney form."""
    return evaluate.roc_auc(scored_labels(spark, sf_dir))


@query("roc_curve", f"""WITH {SCORES},
tot AS (SELECT count(*) FILTER (WHERE label = 1) AS P, count(*) FILTER (WHERE label = 0) AS N FROM scored),
pts AS (
  SELECT DISTINCT s.score AS threshold FROM scored s)
SELECT round(t.threshold, 6) AS threshold,
       round((SELECT count(*) FROM scored x WHERE x.label = 0 AND x.score >= t.threshold) / (SELECT N FROM tot), 6) AS fpr,
       round((SELECT count(*) FROM scored x WHERE x.label = 1 AND x.score >= t.threshold) / (SELECT P FROM tot), 6) AS tpr
FROM pts t
UNION ALL SELECT CAST('inf' AS DOUBLE), 0.0, 0.0""")
def roc_curve(spark, sf_dir):
    """V7: ROC points, one per distinct score, plus the origin."""
    return evaluate.roc_curve(scored_labels(spark, sf_dir))


@query("leaderboard", f"WITH {SCORES_MULTI}," + _sweep_sql("scored_multi", "model") + "," +
       _auc_sql("scored_multi", "model") + """,
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY balanced_accuracy DESC, j) AS r
                        FROM sweep) WHERE r = 1),
m AS (
  SELECT b.model, b.threshold,
         CAST(tp + tn AS DOUBLE) / (tp + fp + tn + fn) AS accuracy, b.balanced_accuracy,
         CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END AS f1, a.roc_auc
  FROM best b JOIN auc a ON a.model = b.model)
SELECT model, round(threshold, 6) AS threshold, round(accuracy, 6) AS accuracy,
       round(balanced_accuracy, 6) AS balanced_accuracy, round(f1, 6) AS f1, round(roc_auc, 6) AS roc_auc,
       CAST(row_number() OVER (ORDER BY roc_auc DESC NULLS LAST, model) AS INTEGER) AS rank
FROM m""")
def leaderboard(spark, sf_dir):
    """V9: models x (accuracy, balanced accuracy, F1, AUC) ranked by AUC."""
    return evaluate.leaderboard(scored_models(spark, sf_dir))


def _clustered_events(spark, sf_dir):
    ev = adapters.reviews_events(spark, sf_dir)
    return ev.select("review_id", "label", (F.col("rating") >= 2).cast("int").alias("cluster"))


_CLUST = f"""WITH {EVENTS},
x AS (SELECT review_id, label, CAST(rating >= 2 AS INTEGER) AS cluster FROM reviews_events),
c AS (SELECT label AS t, cluster AS p, CAST(count(*) AS DOUBLE) AS n FROM x GROUP BY 1, 2),
a AS (SELECT t, sum(n) AS a FROM c GROUP BY t),
b AS (SELECT p, sum(n) AS b FROM c GROUP BY p),
tot AS (SELECT sum(n) AS n FROM c)"""


@query("ari", _CLUST + """,
s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS sij, (SELECT sum(a * (a - 1) / 2) FROM a) AS sa,
             (SELECT sum(b * (b - 1) / 2) FROM b) AS sb, (SELECT n * (n - 1) / 2 FROM tot) AS np)
SELECT round(CASE WHEN 0.5 * (sa + sb) - sa * sb / np = 0 THEN 1.0
                  ELSE (sij - sa * sb / np) / (0.5 * (sa + sb) - sa * sb / np) END, 6) AS ari FROM s""")
def ari(spark, sf_dir):
    """Adjusted Rand index of label vs a rating-based clustering."""
    return evaluate.adjusted_rand_index(_clustered_events(spark, sf_dir), "label", "cluster")


@query("nmi", _CLUST + """,
mi AS (SELECT sum(c.n / tot.n * ln(tot.n * c.n / (a.a * b.b))) AS mi FROM c JOIN a ON c.t = a.t JOIN b ON c.p = b.p, tot),
hu AS (SELECT -sum(a / tot.n * ln(a / tot.n)) AS h, count(*) AS k FROM a, tot),
hv AS (SELECT -sum(b / tot.n * ln(b / tot.n)) AS h, count(*) AS k FROM b, tot)
SELECT round(CASE WHEN hu.k = 1 AND hv.k = 1 THEN 1.0 WHEN mi.mi <= 1e-15 THEN 0.0
                  ELSE mi.mi / ((hu.h + hv.h) / 2) END, 6) AS nmi FROM mi, hu, hv""")
def nmi(spark, sf_dir):
    """Normalised mutual information (arithmetic mean, nats)."""
    return evaluate.normalized_mutual_info(_clustered_events(spark, sf_dir), "label", "cluster")


@query("crosstab", f"""WITH {EVENTS},
x AS (SELECT CASE WHEN label = -1 THEN 'Spam' WHEN label = 1 THEN 'Non‑Spam' END AS label_name,
             CAST(rating >= 2 AS INTEGER) AS k FROM reviews_events)
SELECT label_name, count(*) FILTER (WHERE k = 0) AS cluster_0, count(*) FILTER (WHERE k = 1) AS cluster_1
FROM x WHERE label_name IS NOT NULL GROUP BY label_name""")
def crosstab(spark, sf_dir):
    """Class x cluster contingency counts."""
    return evaluate.crosstab(_clustered_events(spark, sf_dir), "label", "cluster")


@query("sort_desc_rank", f"""WITH {EVENTS},
g AS (SELECT prod_id, avg(rating) AS mean_rating FROM reviews_events GROUP BY prod_id)
SELECT prod_id, round(mean_rating, 6) AS mean_rating,
       row_number() OVER (ORDER BY mean_rating DESC, prod_id NULLS FIRST) AS rank FROM g""")
def sort_desc_rank(spark, sf_dir):
    """Descending sort by one metric with a dense rank number (range
    slices, so the ranking is never a single-partition window)."""
    ev = adapters.reviews_events(spark, sf_dir)
    g = ev.groupBy("prod_id").agg(F.avg("rating").alias("mean_rating")) \
          .withColumn("_neg", -F.col("mean_rating"))
    return ordered_rank(g, [], ["_neg", "prod_id"], "rank").select("prod_id", "mean_rating", "rank")


@query("argmax_first", f"""WITH {EVENTS}
SELECT prod_id, review_id AS argmax_review, rating AS max_rating FROM (
  SELECT prod_id, review_id, rating,
         row_number() OVER (PARTITION BY prod_id ORDER BY rating DESC, review_id) AS r
  FROM reviews_events) WHERE r = 1""")
def argmax_first(spark, sf_dir):
    """D3: per group, the row with the largest value; first (smallest id) wins."""
    ev = adapters.reviews_events(spark, sf_dir)
    best = ev.groupBy("prod_id").agg(
        F.max_by(F.struct("review_id", "rating"), F.struct(F.col("rating"), -F.col("review_id"))).alias("b"))
    return best.select("prod_id", F.col("b.review_id").alias("argmax_review"), F.col("b.rating").alias("max_rating"))
