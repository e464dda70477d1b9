"""Evaluation (V1-V9), cluster agreement (G6, G7) and the crosstab.

Every metric is an aggregate over a small intermediate: scores are reduced
to per-(score) or per-(grid bin) class counts first, so no step touches
``rows x thresholds``. Running sums over distinct scores use range slices
(``ordering.prefix_sums``), so even a continuous score column never lands
in one partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fraudlens.functions.columns import GRID_SIZE, entropy_term, grid_bin, label_name, threshold_at
from fraudlens.operators.ordering import prefix_sums
from fraudlens.session import write_table


def _lit_group(df: DataFrame, by: list[str]) -> tuple[DataFrame, list[str]]:
    if by:
        return df, by
    return df.withColumn("_g", F.lit(0)), ["_g"]


def _recalls(tp, fn, tn, fp):
    """Balanced accuracy as sklearn: mean recall over classes present."""
    tpr = F.try_divide(tp.cast("double"), (tp + fn).cast("double"))
    tnr = F.try_divide(tn.cast("double"), (tn + fp).cast("double"))
    n_present = F.when(tpr.isNotNull(), 1).otherwise(0) + F.when(tnr.isNotNull(), 1).otherwise(0)
    return F.try_divide(F.coalesce(tpr, F.lit(0.0)) + F.coalesce(tnr, F.lit(0.0)), n_present.cast("double"))


def _f1(tp, fp, fn):
    den = (2 * tp + fp + fn).cast("double")
    return F.when(den == 0, F.lit(0.0)).otherwise((2 * tp).cast("double") / den)


def score_counts(scored: DataFrame, label_col: str, score_col: str, keys: list[str]) -> DataFrame:
    """Positives and negatives per distinct score. Rows without a score are
    left out here, once, so that every metric speaks of the same rows."""
    y = F.col(label_col)
    return (scored.where(F.col(score_col).isNotNull()).groupBy(*keys, F.col(score_col).alias("score"))
                  .agg(F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg")))


def threshold_sweep(scored: DataFrame, label_col: str = "label", score_col: str = "score",
                    by: list[str] | None = None) -> DataFrame:
    """V1: confusion counts and balanced accuracy at each of the 200 grid
    thresholds (prediction = score >= t).

    One pass: rows -> counts per score -> (group, bin, pos, neg) with bin =
    #thresholds <= score (<= 201 bins per group); then suffix sums over the bins."""
    df, keys = _lit_group(scored, list(by or []))
    out = _sweep(score_counts(df, label_col, score_col, keys), keys)
    return out if by else out.drop("_g")


def _sweep(counts: DataFrame, keys: list[str]) -> DataFrame:
    bins = (counts.groupBy(*keys, grid_bin("score").alias("_bin"))
                  .agg(F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg")))
    df = counts
    full = (df.select(*keys).distinct()
              .select(*keys, F.explode(F.sequence(F.lit(0), F.lit(GRID_SIZE))).alias("_bin"))
              .join(bins, keys + ["_bin"], "left").fillna(0, ["_pos", "_neg"]))
    # suffix sums over <= 201 rows per group: window by group is tiny
    ge = Window.partitionBy(*keys).orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, 0)
    allw = Window.partitionBy(*keys)
    s = (full.withColumn("_pos_ge", F.sum("_pos").over(ge)).withColumn("_neg_ge", F.sum("_neg").over(ge))
             .withColumn("_P", F.sum("_pos").over(allw)).withColumn("_N", F.sum("_neg").over(allw)))
    # threshold j predicts 1 exactly for bins > j
    sweep = (s.where(F.col("_bin") >= 1)
              .select(*keys, (F.col("_bin") - 1).alias("j"), F.col("_pos_ge").alias("tp"),
                      F.col("_neg_ge").alias("fp"), "_P", "_N"))
    tp, fp = F.col("tp"), F.col("fp")
    fn, tn = F.col("_P") - tp, F.col("_N") - fp
    return sweep.select(*keys, "j", threshold_at(F.col("j")).alias("threshold"), "tp", "fp",
                        tn.alias("tn"), fn.alias("fn"), _recalls(tp, fn, tn, fp).alias("balanced_accuracy"))


def best_threshold(sweep: DataFrame, by: list[str] | None = None) -> DataFrame:
    """V2/D3: argmax of balanced accuracy, first (smallest) threshold wins."""
    df, keys = _lit_group(sweep, list(by or []))
    rank_key = F.struct(F.col("balanced_accuracy"), -F.col("j"))
    best = df.groupBy(*keys).agg(F.max_by(F.struct("j", "threshold", "tp", "fp", "tn", "fn",
                                                   "balanced_accuracy"), rank_key).alias("b"))
    out = best.select(*keys, "b.*")
    return out if by else out.drop("_g")


def roc_auc(scored: DataFrame, label_col: str = "label", score_col: str = "score",
            by: list[str] | None = None, n_slices: int | None = None) -> DataFrame:
    """V6: ROC AUC with ties counted half (Mann-Whitney form).

    AUC = sum_s pos_s * (neg_below_s + neg_s / 2) / (P * N); NULL when a
    class is missing (undefined). J4 is implicit: truth and score are
    columns of the same row, never aligned by position."""
    df, keys = _lit_group(scored, list(by or []))
    out = _auc(score_counts(df, label_col, score_col, keys), keys, n_slices)
    return out if by else out.drop("_g")


def _auc(counts: DataFrame, keys: list[str], n_slices: int | None = None) -> DataFrame:
    cum = prefix_sums(counts, keys, ["score"], ["neg"], suffix="_below", inclusive=False, n_slices=n_slices)
    return cum.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0)),
                     F.sum("pos").cast("double") * F.sum("neg").cast("double")).alias("roc_auc"),
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))


def roc_curve(scored: DataFrame, label_col: str = "label", score_col: str = "score",
              by: list[str] | None = None, n_slices: int | None = None) -> DataFrame:
    """V7: one ROC point per distinct score (threshold = that score, in
    decreasing order) plus the origin at threshold +inf."""
    df, keys = _lit_group(scored, list(by or []))
    c = score_counts(df, label_col, score_col, keys).withColumn("_neg_score", -F.col("score"))
    cum = prefix_sums(c, keys, ["_neg_score"], ["pos", "neg"], suffix="_ge", n_slices=n_slices)
    tot = cum.groupBy(*keys).agg(F.sum("pos").alias("_P"), F.sum("neg").alias("_N"))
    pts = cum.join(tot, keys).select(
        *keys, F.col("score").alias("threshold"),
        F.try_divide(F.col("neg_ge").cast("double"), F.col("_N").cast("double")).alias("fpr"),
        F.try_divide(F.col("pos_ge").cast("double"), F.col("_P").cast("double")).alias("tpr"))
    origin = tot.select(*keys, F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"),
                        F.lit(0.0).alias("tpr"))
    out = pts.unionByName(origin)
    return out if by else out.drop("_g")


def metrics_at_best_threshold(scored: DataFrame, label_col: str = "label", score_col: str = "score",
                              by: list[str] | None = None) -> DataFrame:
    """V3-V5, V8: accuracy, balanced accuracy, F1 (class 1) at the best grid
    threshold, plus ROC AUC - one row per group. The scores are reduced to
    counts per distinct score once, in a written table that the sweep and
    the AUC both read."""
    df, keys = _lit_group(scored, list(by or []))
    counts = write_table(score_counts(df, label_col, score_col, keys), "score-counts")
    best = best_threshold(_sweep(counts, keys), keys)
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    m = best.select(*keys, "threshold",
                    ((tp + tn).cast("double") / (tp + fp + tn + fn).cast("double")).alias("accuracy"),
                    "balanced_accuracy", _f1(tp, fp, fn).alias("f1"))
    out = m.join(_auc(counts, keys).select(*keys, "roc_auc"), keys)
    return out if by else out.drop("_g")


def majority_baseline(scored: DataFrame, label_col: str = "label", positive_label: int = 1) -> DataFrame:
    """The metrics of always answering the more frequent class (ties: the
    positive one), next to which a model's must be read. Unlabelled rows are
    left out; ``positive_label`` is the class that F1 speaks of."""
    y = F.col(label_col)
    c = scored.agg(F.count_if(y == positive_label).alias("p"), F.count_if(y.isNotNull() & (y != positive_label)).alias("n"))
    yes = F.col("p") >= F.col("n")
    tp, fp = F.when(yes, F.col("p")).otherwise(0), F.when(yes, F.col("n")).otherwise(0)
    fn, tn = F.when(yes, 0).otherwise(F.col("p")), F.when(yes, 0).otherwise(F.col("n"))
    return c.select(F.lit("majority").alias("model"), F.lit(None).cast("double").alias("threshold"),
                    F.try_divide((tp + tn).cast("double"), (F.col("p") + F.col("n")).cast("double")).alias("accuracy"),
                    _recalls(tp, fn, tn, fp).alias("balanced_accuracy"), _f1(tp, fp, fn).alias("f1"), F.lit(0.5).alias("roc_auc"))


def metrics_at(scored: DataFrame, threshold: float, label_col: str = "label",
               score_col: str = "score") -> DataFrame:
    """V3-V5 at one given threshold (P7 predictions)."""
    y = F.col(label_col)
    p = (F.col(score_col) >= F.lit(float(threshold))).cast("int")
    c = scored.agg(F.count_if((p == 1) & (y == 1)).alias("tp"), F.count_if((p == 1) & (y == 0)).alias("fp"),
                   F.count_if((p == 0) & (y == 0)).alias("tn"), F.count_if((p == 0) & (y == 1)).alias("fn"))
    tp, fp, tn, fn = (F.col(k) for k in ("tp", "fp", "tn", "fn"))
    return c.select(((tp + tn).cast("double") / (tp + fp + tn + fn).cast("double")).alias("accuracy"),
                    _recalls(tp, fn, tn, fp).alias("balanced_accuracy"), _f1(tp, fp, fn).alias("f1"))


def leaderboard(scored_long: DataFrame, model_col: str = "model", label_col: str = "label",
                score_col: str = "score") -> DataFrame:
    """V9: one row per model (accuracy, balanced accuracy, F1, ROC AUC at
    its own best threshold), ranked by ROC AUC, ties by model name."""
    m = metrics_at_best_threshold(scored_long, label_col, score_col, [model_col])
    w = Window.orderBy(F.desc_nulls_last("roc_auc"), F.col(model_col))  # one row per model
    return m.withColumn("rank", F.row_number().over(w))


# ---- clustering agreement ----------------------------------------------------

def contingency(df: DataFrame, truth_col: str, pred_col: str, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or []), F.col(truth_col).alias("t"), F.col(pred_col).alias("p")).agg(
        F.count(F.lit(1)).cast("double").alias("n"))


def _ari() -> F.Column:
    """ARI from the sums of squared cell, row and column counts; 1.0 when no
    pair is split differently (sklearn's special case)."""
    tp = F.col("ss") - F.col("n_tot")
    fp = F.col("sb") - F.col("ss")
    fn = F.col("sa") - F.col("ss")
    tn = F.col("n_tot") * F.col("n_tot") - fp - fn - F.col("ss")
    return F.when((fn == 0) & (fp == 0), F.lit(1.0)).otherwise(
        2.0 * (tp * tn - fn * fp) / ((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn))).alias("ari")


def adjusted_rand_index(df: DataFrame, truth_col: str = "label", pred_col: str = "cluster") -> DataFrame:
    """ARI from the pair-confusion counts of the contingency table."""
    c = contingency(df, truth_col, pred_col)
    rows = c.groupBy("t").agg(F.sum("n").alias("a"))
    cols = c.groupBy("p").agg(F.sum("n").alias("b"))
    s = c.agg(F.sum("n").alias("n_tot"), F.sum(F.col("n") * F.col("n")).alias("ss"))
    t = s.select("n_tot", "ss", rows.agg(F.sum(F.col("a") * F.col("a"))).scalar().alias("sa"),
                 cols.agg(F.sum(F.col("b") * F.col("b"))).scalar().alias("sb"))
    return t.select(_ari())


def adjusted_rand_index_by(df: DataFrame, by: list[str], truth_col: str = "label", pred_col: str = "cluster") -> DataFrame:
    """G6 of several labellings at once: one row per value of ``by``."""
    c = contingency(df, truth_col, pred_col, by)
    out = c.groupBy(*by).agg(F.sum("n").alias("n_tot"), F.sum(F.col("n") * F.col("n")).alias("ss"))
    for key, name in (("t", "sa"), ("p", "sb")):
        one = c.groupBy(*by, key).agg(F.sum("n").alias("m")).groupBy(*by).agg(F.sum(F.col("m") * F.col("m")).alias(name))
        out = out.join(one, by)
    return out.select(*by, _ari())


def normalized_mutual_info(df: DataFrame, truth_col: str = "label", pred_col: str = "cluster") -> DataFrame:
    """NMI with the arithmetic-mean normaliser, natural log. Both
    labellings constant -> 1.0; zero mutual information -> 0.0."""
    c = contingency(df, truth_col, pred_col)
    n_tot = c.agg(F.sum("n")).scalar()
    rows = c.groupBy("t").agg(F.sum("n").alias("a"))
    cols = c.groupBy("p").agg(F.sum("n").alias("b"))
    cj = c.join(rows, "t").join(cols, "p")
    mi = (cj.select((F.col("n") / n_tot * F.ln(n_tot * F.col("n") / (F.col("a") * F.col("b")))).alias("_mi"))
            .agg(F.sum("_mi").alias("mi")))
    hu = (rows.select(entropy_term(F.col("a") / n_tot).alias("_h"))
              .agg(F.struct(F.sum("_h").alias("h"), F.count(F.lit(1)).alias("k")))).scalar()
    hv = (cols.select(entropy_term(F.col("b") / n_tot).alias("_h"))
              .agg(F.struct(F.sum("_h").alias("h"), F.count(F.lit(1)).alias("k")))).scalar()
    t = mi.select("mi", hu["h"].alias("hu"), hu["k"].alias("ku"), hv["h"].alias("hv"), hv["k"].alias("kv"))
    mi_c = F.greatest(F.col("mi"), F.lit(0.0))
    nmi = (F.when((F.col("ku") == 1) & (F.col("kv") == 1), F.lit(1.0))
             .when(mi_c <= 1e-15, F.lit(0.0))
             .otherwise(mi_c / ((F.col("hu") + F.col("hv")) / 2.0)))
    return t.select(nmi.alias("nmi"))


def crosstab(df: DataFrame, label_col: str = "label", cluster_col: str = "cluster",
             clusters: tuple | None = None) -> DataFrame:
    """Class name x cluster counts (columns ``cluster_<k>``). Without
    ``clusters`` there is a column for each cluster that occurs (their number
    is k, a parameter of the clustering); with them, rows of any other
    cluster, or of none, are counted in ``cluster_other``."""
    named = df.select(label_name(label_col).alias("label_name"), F.col(cluster_col).alias("_k"))
    named = named.where(F.col("label_name").isNotNull())
    k = F.col("_k")
    if clusters is None:
        found = [r["_k"] for r in named.select("_k").distinct().orderBy("_k").collect()]
        counts = [F.count_if(k.eqNullSafe(F.lit(c))).alias(f"cluster_{'null' if c is None else c}") for c in found]
    else:
        counts = [F.count_if(k == c).alias(f"cluster_{c}") for c in clusters]
        counts.append(F.count_if(k.isNull() | ~k.isin(*clusters)).alias("cluster_other"))
    return named.groupBy("label_name").agg(*counts)
