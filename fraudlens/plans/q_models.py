"""Registered queries: classifiers (M1-M9), search (H1-H3), PCA.

The model queries fit on the training part of the fused review matrix
(documents adapter, whole table) and return validation probabilities
``(id, label, prob)``. Each uses one fixed point of its search space (stated
per query); the searches themselves are the ``param_search_*`` queries.
"""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from fraudlens.operators import evaluate, features, models, search
from fraudlens.operators.sampling import three_way_split, train_val_split
from fraudlens.plans import pipeline
from fraudlens.plans.registry import query
from fraudlens.plans.sql import DOCS
from fraudlens.session import write_table
from fraudlens.sources import adapters


_MATRICES: dict = {}


def _matrix(spark, sf_dir):
    """The fused review matrix, built once per application and folder and
    written to the shared checkpoint folder, then split."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _MATRICES:
        _MATRICES[key] = write_table(pipeline.model_matrix(spark, sf_dir, "docs"), "matrix")
    return pipeline.split(_MATRICES[key])


def _nb_sql() -> str:
    return """WITH
base AS (SELECT vec_id, CASE WHEN label >= 5 THEN 1 ELSE 0 END AS y, embedding FROM embeddings),
ranked AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5(CAST(vec_id AS VARCHAR) || '|42'), vec_id) AS rn,
                  ceil(0.2 * count(*) OVER (PARTITION BY y)) AS k FROM base),
sp AS (SELECT vec_id, y, embedding, rn <= k AS is_val FROM ranked),
lng AS (SELECT vec_id, y, is_val, CAST(i AS INTEGER) - 1 AS f, CAST(v AS DOUBLE) AS x FROM (
          SELECT vec_id, y, is_val, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM sp)),
tr AS (SELECT * FROM lng WHERE NOT is_val),
eps AS (SELECT 1e-9 * max(v) AS e FROM (SELECT f, var_pop(x) AS v FROM tr GROUP BY f)),
ntr AS (SELECT count(*) AS n FROM sp WHERE NOT is_val),
prior AS (SELECT y, ln(CAST(count(*) AS DOUBLE) / (SELECT n FROM ntr)) AS lp FROM sp WHERE NOT is_val GROUP BY y),
th AS (SELECT y, f, avg(x) AS m, var_pop(x) + (SELECT e FROM eps) AS v FROM tr GROUP BY y, f),
jll AS (SELECT l.vec_id, l.y AS label, th.y AS c,
               sum(-0.5 * ln(2 * pi() * th.v) - 0.5 * (l.x - th.m) * (l.x - th.m) / th.v) AS s
        FROM lng l JOIN th ON l.f = th.f WHERE l.is_val GROUP BY l.vec_id, l.y, th.y),
j2 AS (SELECT jll.vec_id, jll.label, jll.c, jll.s + p.lp AS j FROM jll JOIN prior p ON jll.c = p.y)
SELECT vec_id AS id, label,
       round(1.0 / (1.0 + exp(max(j) FILTER (WHERE c = 0) - max(j) FILTER (WHERE c = 1))), 6) AS prob
FROM j2 GROUP BY vec_id, label"""


@query("gaussian_nb", _nb_sql())
def gaussian_nb(spark, sf_dir):
    """M7: Gaussian naive Bayes (var_smoothing 1e-9) on the 64-dim
    embeddings, label = (class >= 5), stratified 80/20 split."""
    e = adapters.load_table(spark, sf_dir, "embeddings")
    m = e.select(F.col("vec_id").alias("id"), (F.col("label") >= 5).cast("int").alias("label"),
                 F.col("embedding").cast("array<double>").alias("features"))
    s = train_val_split(m, "label", 0.2, seed=42, id_col="id")
    tr, va = s.where(~F.col("is_val")).drop("is_val"), s.where(F.col("is_val")).drop("is_val")
    return models.fit_gaussian_nb(tr, va, 1e-9)


@query("model_split", f"""
WITH {DOCS},
base AS (SELECT review_id, CASE WHEN label = -1 THEN 0 ELSE label END AS y FROM reviews_docs),
ranked AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5(CAST(review_id AS VARCHAR) || '|42'), review_id) AS rn,
                  ceil(0.2 * count(*) OVER (PARTITION BY y)) AS k FROM base)
SELECT review_id AS id, y AS label, rn <= k AS is_val, CAST(78 AS INTEGER) AS width FROM ranked""")
def model_split(spark, sf_dir):
    """The rows that every model is fit on and judged by: id, label, split
    flag (K2) and the width of the fused vector (64 semantic + 14 behavioural)."""
    tr, va = _matrix(spark, sf_dir)
    one = lambda df, v: df.select("id", "label", F.lit(v).alias("is_val"), F.size("features").alias("width"))
    return one(tr, False).unionByName(one(va, True))


_STRICT = """
WITH base AS (SELECT vec_id AS id, CASE WHEN label >= 5 THEN 1 ELSE 0 END AS label, embedding FROM embeddings),
t1 AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(id AS VARCHAR) || '|42'), id)
                 <= ceil(0.2 * count(*) OVER (PARTITION BY label)) AS is_test FROM base),
t2 AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(id AS VARCHAR) || '|43'), id)
                 <= ceil(0.2 * count(*) OVER (PARTITION BY label)) AS is_val FROM t1 WHERE NOT is_test),
parts AS (SELECT id, label, embedding, 'test' AS part FROM t1 WHERE is_test
  UNION ALL SELECT id, label, embedding, CASE WHEN is_val THEN 'val' ELSE 'train' END FROM t2)"""


def _strict(spark, sf_dir):
    """T4: the embeddings with a stratified part: train, val or test."""
    e = adapters.load_table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), (F.col("label") >= 5).cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("features"))
    return three_way_split(e, "label", 0.2, 0.2, 42, "id")


@query("strict_split", _STRICT + "\nSELECT id, label, part FROM parts")
def strict_split(spark, sf_dir):
    """T4, strict mode: three-way stratified split."""
    return _strict(spark, sf_dir).select("id", "label", "part")


@query("strict_zscore", _STRICT + """,
lng AS (SELECT id, part, CAST(i AS INTEGER) - 1 AS slot, CAST(v AS DOUBLE) AS v FROM (
  SELECT id, part, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM parts)),
st AS (SELECT slot, avg(v) AS m, stddev_pop(v) AS s FROM lng WHERE part = 'train' GROUP BY slot)
SELECT id, part, lng.slot, round(CASE WHEN s = 0 THEN v - m ELSE (v - m) / s END, 6) AS value FROM lng JOIN st ON lng.slot = st.slot""")
def strict_zscore(spark, sf_dir):
    """All parts scaled by the statistics of the training part."""
    z = features.zscore_vector(_strict(spark, sf_dir), "features", fit_on=F.col("part") == "train")
    return z.select("id", "part", F.posexplode("features").alias("slot", "value"))


@query("strict_metrics")
def strict_metrics(spark, sf_dir):
    """T4 end to end: naive Bayes fit on the training part, its threshold
    chosen on the validation part, metrics of the test part at it."""
    z = write_table(features.zscore_vector(_strict(spark, sf_dir), "features", fit_on=F.col("part") == "train"), "strict")
    part = lambda p: z.where(F.col("part") == p).drop("part")
    params = write_table(models.gaussian_nb_fit(part("train")), "strict-nb")
    sweep = evaluate.threshold_sweep(models.gaussian_nb_predict(params, part("val")), score_col="prob")
    best = evaluate.best_threshold(sweep).first()["threshold"]
    pred = models.gaussian_nb_predict(params, part("test")).withColumn("pred", (F.col("prob") >= F.lit(best)).cast("int"))
    hit = lambda y, p: F.count_if((F.col("label") == y) & (F.col("pred") == p)).cast("double")
    c = pred.agg(hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), hit(0, 0).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select(F.lit(best).alias("threshold"), F.try_divide(tp + tn, tp + fp + fn + tn).alias("accuracy"),
                    ((F.try_divide(tp, tp + fn) + F.try_divide(tn, tn + fp)) / 2).alias("balanced_accuracy"),
                    F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"))


@query("fit_logreg")
def fit_logreg(spark, sf_dir):
    """M2: logistic regression, C = 1, L2, balanced weights, 2000 iterations."""
    tr, va = _matrix(spark, sf_dir)
    return models.fit_logreg(tr, va, C=1.0, penalty="l2", class_weight="balanced")


def _neg_pos(tr) -> float:
    """A10 on the training rows: the boosted trees' positive weight."""
    return tr.agg(F.try_divide(F.count_if(F.col("label") == 0).cast("double"),
                               F.count_if(F.col("label") == 1).cast("double"))).first()[0]


# One fixed point of each search space.
GBT = {"n_estimators": 200, "max_depth": 4, "learning_rate": 0.1, "subsample": 0.8, "colsample": 0.8}
POINTS = {
    "svm": {"kernel": "rbf", "C": 1.0, "class_weight": "balanced"},
    "mlp": {"hidden": (64,), "activation": "relu", "solver": "lbfgs", "alpha": 1e-4},
    "lr": {"C": 1.0, "penalty": "l2", "class_weight": "balanced"},
    "gbt": GBT,
    "dt": {"criterion": "entropy", "max_depth": 6, "min_samples_leaf": 2, "class_weight": "balanced"},
    "rf": {"n_estimators": 100, "max_depth": 8, "max_features": "sqrt", "class_weight": "balanced"},
    "nb": {"var_smoothing": 1e-9},
}
PCA_FIRST = ("svm", "mlp")  # X3 stands before these two


def _fit(name: str, tr, va, params: dict):
    """One model on the training rows, its validation probabilities."""
    if name in PCA_FIRST:
        tr, va = models.with_pca(tr, va)
    if name == "gbt":
        params = {"scale_pos_weight": _neg_pos(tr)} | params
    return models.MODEL_FITS[name](tr, va, **params)


@query("fit_gbt")
def fit_gbt(spark, sf_dir):
    """M1: boosted trees, 200 rounds, depth 4, learning rate 0.1, positive
    weight neg/pos (A10)."""
    return _fit("gbt", *_matrix(spark, sf_dir), POINTS["gbt"])


@query("fit_hist_gbt")
def fit_hist_gbt(spark, sf_dir):
    """M1, second order: boosted trees on histograms, the point of ``fit_gbt``
    but 60 rounds; child weight 1, gamma 0."""
    tr, va = _matrix(spark, sf_dir)
    return models.fit_hist_gbt(tr, va, scale_pos_weight=_neg_pos(tr), **POINTS["gbt"] | {"n_estimators": 60})


@query("fit_svm")
def fit_svm(spark, sf_dir):
    """M3: PCA, rbf kernel via 512 random Fourier features, linear SVM, Platt."""
    return _fit("svm", *_matrix(spark, sf_dir), POINTS["svm"])


@query("fit_mlp")
def fit_mlp(spark, sf_dir):
    """M4: PCA, perceptron with one hidden layer of 64 relu units, l-bfgs until it converges."""
    return _fit("mlp", *_matrix(spark, sf_dir), POINTS["mlp"])


@query("fit_tree")
def fit_tree(spark, sf_dir):
    """M5: decision tree, entropy, depth 6, balanced weights."""
    return _fit("dt", *_matrix(spark, sf_dir), POINTS["dt"])


@query("fit_forest")
def fit_forest(spark, sf_dir):
    """M6: random forest, 100 trees, depth 8, sqrt features."""
    return _fit("rf", *_matrix(spark, sf_dir), POINTS["rf"])


def _stacked(tr, va, ready: dict | None = None):
    """M8 with the points of its bases; plain vectors, as in the reference."""
    params = {b: dict(POINTS[b]) for b in ("svm", "dt", "rf", "gbt", "nb", "mlp")}
    params["gbt"]["scale_pos_weight"] = _neg_pos(tr)
    return models.fit_stacking(tr, va, params, n_folds=5, ready=ready)


@query("fit_stacking")
def fit_stacking(spark, sf_dir):
    """M8: stacking of svm, dt, rf, gbt, nb, mlp with a logistic meta-model (5 stratified folds)."""
    return _stacked(*_matrix(spark, sf_dir))


_SCORES: dict = {}


def model_scores(spark, sf_dir):
    """(model, id, label, score) of the eight models on the validation rows;
    fitted once per application and folder and written as one table."""
    from concurrent.futures import ThreadPoolExecutor

    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _SCORES:
        tr, va = _matrix(spark, sf_dir)

        def fit(name):
            return write_table(_fit(name, tr, va, POINTS[name]).select("id", "label", "prob"), "scores")

        # the fits run beside each other, and stacking takes over those that are its own refits
        with ThreadPoolExecutor(len(POINTS)) as pool:
            fits = {name: pool.submit(fit, name) for name in POINTS}
            shared = {name: f.result for name, f in fits.items() if name not in (*PCA_FIRST, "lr")}
            scores = {"stacking": write_table(_stacked(tr, va, shared), "scores")} | {name: f.result() for name, f in fits.items()}
        out = None
        for name in [*POINTS, "stacking"]:
            p = scores[name].select(F.lit(name).alias("model"), "id", "label", F.col("prob").alias("score"))
            out = p if out is None else out.unionByName(p)
        _SCORES[key] = write_table(out, "model-scores")
    return _SCORES[key]


@query("model_leaderboard")
def model_leaderboard(spark, sf_dir):
    """Path 3 end to end: review matrix, split, the eight models, their
    thresholds and metrics ranked by AUC (V1-V9), and the majority baseline
    (T3) as a ninth, unranked row."""
    scores = model_scores(spark, sf_dir)
    board = evaluate.leaderboard(scores)
    base = evaluate.majority_baseline(scores.where(F.col("model") == "nb")).withColumn("rank", F.lit(None).cast("int"))
    return board.unionByName(base.select(*board.columns))


@query("model_roc_curves")
def model_roc_curves(spark, sf_dir):
    """V7 of the eight models: one ROC point per model and distinct score."""
    return evaluate.roc_curve(model_scores(spark, sf_dir), by=["model"])


_STUDIES: dict = {}


def _study(model: str, seed: int):
    """H1-H3: ten seeded trials of a space, scored by validation AUC. The
    vectors (after PCA, for the two models that want it) are written once
    and shared by the trials. Run once per application and folder."""
    def run(spark, sf_dir):
        key = (spark.sparkContext.applicationId, sf_dir, model, seed)
        if key not in _STUDIES:
            _STUDIES[key] = study(spark, sf_dir)
        return _STUDIES[key]

    def study(spark, sf_dir):
        tr, va = _matrix(spark, sf_dir)
        if model in PCA_FIRST:
            tr, va = models.with_pca(tr, va)
        else:
            tr, va = write_table(tr, "study-train"), write_table(va, "study-test")
        more = {"scale_pos_weight": _neg_pos(tr)} if model == "gbt" else {}

        def objective(p):
            pred = models.MODEL_FITS[model](tr, va, **more, **search.used(model, p))
            return evaluate.roc_auc(pred, score_col="prob").first()["roc_auc"] or 0.0

        trials = write_table(search.run_study(spark, model, objective, 10, seed, parallelism=8), "trials")
        best = search.best_trial(trials).select("model", F.col("trial").alias("_bt"))
        return trials.join(best, "model").withColumn("is_best", F.col("trial") == F.col("_bt")).drop("_bt")
    run.__doc__ = f"H1-H3: ten trials of the {model} study, with the best one marked."
    return run


for _i, _m in enumerate(("nb", "lr", "svm", "mlp", "dt", "rf", "gbt")):
    query(f"param_search_{_m}")(_study(_m, _i + 1))


@query("param_search")
def param_search(spark, sf_dir):
    """H2: the naive-Bayes and logistic-regression studies in one trial table."""
    return _study("nb", 1)(spark, sf_dir).unionByName(_study("lr", 2)(spark, sf_dir))


@query("best_refit")
def best_refit(spark, sf_dir):
    """H3: the logistic regression refit with its best trial's parameters;
    validation probabilities."""
    trials = _study("lr", 2)(spark, sf_dir)
    best = json.loads(trials.where("is_best").first()["params"])
    return _fit("lr", *_matrix(spark, sf_dir), search.used("lr", best))


@query("pca_train_val")
def pca_train_val(spark, sf_dir):
    """PCA to min(100, width) components, fit on the training rows
    (centred with their mean) and applied to the validation rows."""
    return models.with_pca(*_matrix(spark, sf_dir))[1].select("id", "label", F.col("features").alias("pca"))


@query("pca_all")
def pca_all(spark, sf_dir):
    """The same components, fit on and applied to all rows."""
    tr, va = _matrix(spark, sf_dir)
    rows = write_table(tr.unionByName(va).select("id", "label", "features"), "matrix")
    k = min(100, len(rows.select("features").first()[0]))
    return features.pca_fit_transform(rows, "features", k, out="pca").select("id", "label", "pca")
