"""Classifiers (M1-M9): fit on a training table, probability of class 1 on
another table.

Inputs are ``(id, label, features array<double>)``; outputs are
``(id, label, prob)`` DataFrames, so evaluation (V*) joins nothing by
position. Trees, forests and the linear models are Spark ML estimators, the
perceptron is trained over partitions (``operators.mlp``); naive Bayes is two aggregations over the long form ``(id, slot, value)``
(the per-class parameter table has classes x features rows and is
broadcast), which an SQL oracle can repeat exactly.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fraudlens.functions.columns import with_scalar
from fraudlens.operators import fitlog
from fraudlens.operators.prep import class_weights
from fraudlens.session import ensure_checkpoint_dir, write_table

ID, Y, X = "id", "label", "features"


def _vec(df: DataFrame, col: str = X) -> DataFrame:
    return df.withColumn("_fv", array_to_vector(F.col(col)))


#: Rows that one task of an iterative fit holds. A fit is many short jobs, and
#: a small table dealt over all cores pays for its tasks and not for its rows.
ROWS_PER_TASK = 8192
#: The same for the logistic regression: a step costs a row one product of blocks.
LINEAR_ROWS_PER_TASK = 65_536


def _dealt(train: DataFrame, rows_per_task: int | None = None) -> DataFrame:
    """Training rows dealt by their hash over tasks of ``ROWS_PER_TASK`` rows and
    sorted by it: what a fit draws per task depends neither on the files'
    layout nor on the number of cores."""
    tasks = max(1, math.ceil(train.count() / (rows_per_task or ROWS_PER_TASK)))
    return (train.withColumn("_deal", F.xxhash64(ID, Y, X)).repartition(tasks, "_deal").sortWithinPartitions("_deal")).drop("_deal")


def _prob(pred: DataFrame) -> DataFrame:
    return pred.select(ID, Y, vector_to_array("probability")[1].alias("prob"))


def _weighted(train: DataFrame, balanced: bool, pos_weight: float | None = None) -> tuple[DataFrame, dict]:
    """M9 weights: balanced ``n / (2 n_c)`` or a positive-class weight
    (the boosted trees' ``neg / pos``). The weight table is one row per
    class, so it is broadcast."""
    if pos_weight is not None:
        return train.withColumn("_w", F.when(F.col(Y) == 1, F.lit(float(pos_weight))).otherwise(1.0)), \
            {"weightCol": "_w"}
    if balanced:
        w = class_weights(train, Y).select(Y, F.col("weight").alias("_w"))
        return train.join(F.broadcast(w), Y), {"weightCol": "_w"}
    return train, {}  # T18: never pass weightCol=None


# ---- M7 Gaussian naive Bayes (SQL-checkable) -------------------------------------

def gaussian_nb_fit(train: DataFrame, var_smoothing: float = 1e-9) -> DataFrame:
    """One row per class: mean and population variance + epsilon of every
    slot (arrays) and the log prior; epsilon = var_smoothing * largest
    per-slot variance of all training rows. Spark's ``Summarizer`` gives the
    moments in one partially aggregated pass (its variance is the sample
    one, so it is rescaled)."""
    v = _vec(train)
    moments = Summarizer.metrics("mean", "variance", "count").summary(F.col("_fv"))

    def population(df):
        n = F.col("s.count")
        return df.withColumns({"mean": vector_to_array("s.mean"),
                               "var": F.transform(vector_to_array("s.variance"), lambda x: x * (n - 1) / n), "n": n}).drop("s")

    whole = population(v.agg(moments.alias("s")))
    all_rows = whole.select(F.struct((F.lit(float(var_smoothing)) * F.array_max("var")).alias("eps"), F.col("n").alias("n")))
    by_class = with_scalar(population(v.groupBy(Y).agg(moments.alias("s"))), "_all", all_rows)
    return by_class.select(Y, "mean", F.transform("var", lambda x: x + F.col("_all.eps")).alias("var"),
                           F.ln(F.col("n") / F.col("_all.n")).alias("log_prior"))


def gaussian_nb_predict(params: DataFrame, df: DataFrame) -> DataFrame:
    """Joint log likelihood per class, then a two-class softmax, as one
    expression per row: the parameters are a scalar subquery with one entry
    per class, so nothing is exploded or shuffled."""
    table = params.where(F.col(Y).isin(0, 1)).agg(F.map_from_entries(F.collect_list(F.struct(
        F.col(Y).cast("int"), F.struct("mean", "var", "log_prior")))).alias("p"))
    out = with_scalar(df, "_p", table)

    def joint(c):
        p = F.try_element_at(F.col("_p"), F.lit(c))
        term = F.zip_with(F.zip_with(F.col(X), p["mean"], lambda x, m: (x - m) * (x - m)), p["var"],
                          lambda d2, v: -0.5 * F.ln(2 * math.pi * v) - 0.5 * d2 / v)
        return F.aggregate(term, F.lit(0.0), lambda acc, t: acc + t) + p["log_prior"]

    j0, j1 = joint(0), joint(1)
    prob = F.when(j0.isNull() & j1.isNotNull(), F.lit(1.0)).when(j1.isNull() & j0.isNotNull(), F.lit(0.0)).otherwise(
        1.0 / (1.0 + F.exp(j0 - j1)))
    return out.select(ID, Y, prob.alias("prob"))


def fit_gaussian_nb(train: DataFrame, test: DataFrame, var_smoothing: float = 1e-9) -> DataFrame:
    """M7."""
    return gaussian_nb_predict(gaussian_nb_fit(train, var_smoothing), test)


# ---- Spark ML models -----------------------------------------------------------------

def _check_depth(depth: int) -> None:
    if depth > 30:
        raise ValueError(f"Spark's trees have at most 30 levels, not {depth}")


def fit_logreg(train: DataFrame, test: DataFrame, C: float = 1.0, penalty: str = "l2",
               class_weight: str | None = None, max_iter: int = 2000, tol: float = 1e-4) -> DataFrame:
    """M2: C-parameterised logistic regression; regParam = 1 / (C * sum w),
    stopping tolerance 1e-4 as in the reference's solver default."""
    tr, kw = _weighted(_dealt(train, LINEAR_ROWS_PER_TASK), class_weight == "balanced")
    total_w = tr.agg(F.sum(F.col(kw["weightCol"])) if kw else F.count(F.lit(1))).first()[0]
    lr = LogisticRegression(featuresCol="_fv", labelCol=Y, maxIter=max_iter, standardization=False,
                            regParam=1.0 / (C * float(total_w)), elasticNetParam=1.0 if penalty == "l1" else 0.0,
                            tol=tol, **kw)
    return _prob(lr.fit(_vec(tr)).transform(_vec(test)))


def fit_gbt(train: DataFrame, test: DataFrame, n_estimators: int = 200, max_depth: int = 6,
            learning_rate: float = 0.1, subsample: float = 1.0, colsample: float = 1.0,
            min_child_weight: int = 1, gamma: float = 0.0, scale_pos_weight: float | None = None,
            seed: int = 42) -> DataFrame:
    """M1: gradient-boosted trees. colsample is per node here (Spark has
    no per-tree subset), min child weight is a row count, gamma is the
    minimum information gain."""
    tr, kw = _weighted(_dealt(train), False, scale_pos_weight)
    _check_depth(max_depth)
    ensure_checkpoint_dir(train.sparkSession)  # long boosting cuts its lineage every 10 rounds
    strategy = "all" if colsample >= 1.0 else str(float(colsample))
    m = GBTClassifier(featuresCol="_fv", labelCol=Y, maxIter=n_estimators, maxDepth=max_depth, checkpointInterval=10,
                      stepSize=learning_rate, subsamplingRate=subsample, featureSubsetStrategy=strategy,
                      minInstancesPerNode=int(min_child_weight), minInfoGain=float(gamma), seed=seed, **kw)
    return _prob(m.fit(_vec(tr)).transform(_vec(test)))


def fit_hist_gbt(train: DataFrame, test: DataFrame, n_estimators: int = 200, max_depth: int = 6, learning_rate: float = 0.1,
                 subsample: float = 1.0, colsample: float = 1.0, min_child_weight: float = 1.0, gamma: float = 0.0,
                 scale_pos_weight: float | None = None, reg_lambda: float = 1.0, max_bins: int = 64, seed: int = 42) -> DataFrame:
    """M1: second-order boosted trees on histograms (``operators.boosting``):
    gamma is subtracted from a split's gain, the child weight is a sum of
    hessians, columns are drawn per tree."""
    from fraudlens.operators import boosting

    rows = boosting.Rows(train, ID, X, Y, 1.0 if scale_pos_weight is None else float(scale_pos_weight), max_bins)
    trees = boosting.train(rows, n_estimators, max_depth, learning_rate, subsample, colsample, min_child_weight, gamma, reg_lambda, seed)
    bounds = rows.bounds

    @F.pandas_udf(T.DoubleType())
    def prob(col: pd.Series) -> pd.Series:
        x = np.array([[0.0 if z is None or z != z else z for z in row] for row in col], dtype=float).reshape(len(col), -1)
        return pd.Series(0.5 * (1.0 + np.tanh(0.5 * boosting.values_of(trees, boosting.bins_of(bounds, x)))) if len(col) else np.empty(0))

    return test.select(ID, Y, prob(F.col(X)).alias("prob"))


def fit_tree(train: DataFrame, test: DataFrame, criterion: str = "gini", max_depth: int = 5,
             min_samples_split: int = 2, min_samples_leaf: int = 1, max_features: str | None = None,
             class_weight: str | None = None, seed: int = 42) -> DataFrame:
    """M5: one tree; a feature subset per split is a one-tree forest
    without bootstrap. min_samples_split has no Spark counterpart and is
    folded into the leaf minimum as max(leaf, split / 2)."""
    tr, kw = _weighted(_dealt(train), class_weight == "balanced")
    _check_depth(max_depth)
    leaf = max(int(min_samples_leaf), int(math.ceil(min_samples_split / 2)))
    if max_features:
        m = RandomForestClassifier(featuresCol="_fv", labelCol=Y, numTrees=1, bootstrap=False,
                                   featureSubsetStrategy=max_features, impurity=criterion, maxDepth=max_depth,
                                   minInstancesPerNode=leaf, seed=seed, **kw)
    else:
        m = DecisionTreeClassifier(featuresCol="_fv", labelCol=Y, impurity=criterion, maxDepth=max_depth,
                                   minInstancesPerNode=leaf, seed=seed, **kw)
    return _prob(m.fit(_vec(tr)).transform(_vec(test)))


def fit_forest(train: DataFrame, test: DataFrame, n_estimators: int = 100, max_depth: int = 8,
               min_samples_split: int = 2, min_samples_leaf: int = 1, max_features: str = "sqrt",
               class_weight: str | None = None, seed: int = 42) -> DataFrame:
    """M6: random forest."""
    tr, kw = _weighted(_dealt(train), class_weight == "balanced")
    _check_depth(max_depth)
    leaf = max(int(min_samples_leaf), int(math.ceil(min_samples_split / 2)))
    m = RandomForestClassifier(featuresCol="_fv", labelCol=Y, numTrees=n_estimators, maxDepth=max_depth,
                               featureSubsetStrategy=max_features, minInstancesPerNode=leaf, seed=seed, **kw)
    return _prob(m.fit(_vec(tr)).transform(_vec(test)))


def fit_mlp(train: DataFrame, test: DataFrame, hidden: tuple = (64,), activation: str = "relu", solver: str = "lbfgs",
            alpha: float = 1e-4, learning_rate: str = "constant", learning_rate_init: float = 1e-3, max_iter: int = 50_000,
            tol: float = 1e-4, seed: int = 42) -> DataFrame:
    """M4: multilayer perceptron with L2 penalty ``alpha``, hidden units relu,
    tanh or sigmoid, trained by lbfgs, adam or sgd over the partitions of the
    table (see ``operators.mlp``). The learning rate's schedule matters to sgd
    alone. Steps and convergence are recorded (``fitlog``)."""
    from fraudlens.operators import mlp

    solver = {"l-bfgs": "lbfgs", "gd": "sgd"}.get(solver, solver)
    for what, value, known in (("solver", solver, ("lbfgs", "adam", "sgd")), ("activation", activation, mlp.ACTIVATIONS),
                               ("learning rate", learning_rate, ("constant", "adaptive"))):
        if value not in known:
            raise ValueError(f"no {what} {value!r}; there are {known}")
    net, theta, steps, converged = mlp.train_mlp(train, ID, X, Y, tuple(hidden), activation, solver, alpha, learning_rate, learning_rate_init,
                                                 max_iter, tol, seed)
    fitlog.record("mlp", steps, converged)

    @F.pandas_udf(T.DoubleType())
    def prob(col: pd.Series) -> pd.Series:
        some = col.notna().to_numpy()
        out = np.full(len(col), np.nan)
        if some.any():
            _, z = net.forward(theta, np.vstack(col[some].to_numpy()).astype(float))
            out[some] = 0.5 * (1.0 + np.tanh(0.5 * z))
        return pd.Series(out)

    return test.select(ID, Y, F.nanvl(prob(F.col(X)), F.lit(None).cast("double")).alias("prob"))


def _rff(width: int, n_components: int, gamma: float, seed: int):
    rng = np.random.default_rng(seed)
    W = rng.normal(0.0, math.sqrt(2.0 * gamma), size=(width, n_components))
    b = rng.uniform(0.0, 2.0 * math.pi, size=n_components)
    scale = math.sqrt(2.0 / n_components)
    return lambda x: scale * np.cos(x @ W + b)


def _sketch(width: int, n_components: int, degree: int, gamma: float, seed: int):
    """Tensor sketch of the kernel ``(gamma x.y)^degree``: the circular
    convolution of ``degree`` count sketches, so the output width is the
    same at any degree."""
    rng = np.random.default_rng(seed)
    place = rng.integers(0, n_components, size=(degree, width))
    sign = rng.choice([-1.0, 1.0], size=(degree, width))
    maps = np.zeros((degree, width, n_components))
    for p in range(degree):
        maps[p, np.arange(width), place[p]] = sign[p]

    def sketch(x):
        prod = np.ones((len(x), n_components // 2 + 1), dtype=complex)
        for m in maps:
            prod *= np.fft.rfft(math.sqrt(gamma) * x @ m, axis=1)
        return np.fft.irfft(prod, n=n_components, axis=1)
    return sketch


def _sketch_udf(width: int, n_components: int, degree: int, gamma: float, seed: int):
    """``_sketch`` as a column function."""
    f = _sketch(width, n_components, degree, gamma, seed)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def sketch(col: pd.Series) -> pd.Series:
        return pd.Series(list(f(np.vstack(col.to_numpy()) if len(col) else np.empty((0, width)))))
    return sketch


def _mapped(df: DataFrame, f, width: int, rows: int = 1024) -> DataFrame:
    """``df`` with its features mapped by ``f`` to ``_z``, ``rows`` rows at a time."""
    keep = [c for c in df.columns if c != X]

    def run(batches):
        for whole in batches:
            for a in range(0, whole.num_rows, rows):
                b = whole.slice(a, rows)
                z = np.ascontiguousarray(f(b.column(X).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)))
                wide = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1]), pa.array(z.ravel()))
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], wide], names=[*keep, "_z"])

    return df.select(*keep, X).mapInArrow(run, T.StructType([*[df.schema[c] for c in keep], T.StructField("_z", T.ArrayType(T.DoubleType()))]))


def fit_svm(train: DataFrame, test: DataFrame, kernel: str = "rbf", C: float = 1.0, degree: int = 2,
            gamma: float | None = None, class_weight: str | None = None, n_components: int = 512,
            max_iter: int = 100, seed: int = 42, n_folds: int = 3) -> DataFrame:
    """M3 (re-aimed): kernel SVM as an explicit feature map + LinearSVC with
    regParam = 1 / (C * sum of weights), then Platt scaling (a 1-D logistic
    regression) on margins of rows that the SVM they come from has not seen
    (``n_folds`` stratified folds).

    rbf: random Fourier features sqrt(2/D) cos(Wx + b), W ~ N(0, 2 gamma I).
    poly: tensor sketch of ``(gamma x.y)^degree`` at any degree. gamma is
    1 / (d * var(X)) unless given. Both maps have seeded tables and
    ``n_components`` slots; rows are mapped as a fit reads them, and the wide
    rows are never written. Steps and convergence are
    recorded (``fitlog``); the reference allows 2000 to 20000."""
    from fraudlens.operators.sampling import kfold

    if kernel not in ("rbf", "poly"):
        raise ValueError(f"no kernel {kernel!r}; there are rbf and poly")
    width = len(train.select(X).first()[0])
    if gamma is None:
        var = train.select(F.explode(X).alias("v")).agg(F.var_pop("v")).first()[0] or 1.0
        gamma = 1.0 / (width * var)
    f = (_rff(width, n_components, float(gamma), seed) if kernel == "rbf"
         else _sketch(width, n_components, int(degree), float(gamma), seed))
    folded = write_table(kfold(train.select(ID, Y, X), Y, n_folds, seed=seed, id_col=ID), "svm-train")
    # mapped rows are wide: a task of a large table holds a bounded number of them
    large = folded.count() > 16 * ROWS_PER_TASK

    def margins(tr: DataFrame, rows: DataFrame) -> tuple[DataFrame, int]:
        tr, rows = _mapped(_dealt(tr) if large else tr, f, width), _mapped(rows.select(ID, Y, X), f, width)
        tr, kw = _weighted(tr, class_weight == "balanced")
        total = tr.agg(F.sum(F.col(kw["weightCol"])) if kw else F.count(F.lit(1))).first()[0]
        svc = LinearSVC(featuresCol="_fv", labelCol=Y, regParam=1.0 / (C * float(total)), maxIter=max_iter, tol=1e-3, **kw)
        model = svc.fit(_vec(tr, "_z"))
        return model.transform(_vec(rows, "_z")).select(
            ID, Y, F.array(vector_to_array("rawPrediction")[1]).alias("_m")), model.summary().totalIterations

    # a fit is many short jobs, so the folds' fits and the last one run beside each other
    sides = [(folded.where(F.col("fold") != k), folded.where(F.col("fold") == k)) for k in range(n_folds)] + [(folded, test)]
    with ThreadPoolExecutor(len(sides)) as pool:
        parts = list(pool.map(lambda side: margins(*side), sides))
    for _, steps in parts:
        fitlog.record("svm", steps, steps < max_iter)
    unseen = None
    for part, _ in parts[:-1]:
        unseen = part if unseen is None else unseen.unionByName(part)
    unseen = write_table(unseen, "svm-margins")
    platt = LogisticRegression(featuresCol="_fv", labelCol=Y, maxIter=100).fit(_vec(unseen, "_m"))
    return _prob(platt.transform(_vec(parts[-1][0], "_m")))


def with_pca(train: DataFrame, test: DataFrame, k: int = 100) -> tuple[DataFrame, DataFrame]:
    """X3 before the SVM and the MLP: components fit on the training rows and
    applied to both tables; k is the vector's width if that is smaller."""
    from fraudlens.operators.features import pca_fit_transform

    k = min(k, len(train.select(X).first()[0]))
    train, test = write_table(train.select(ID, Y, X), "pca-train"), write_table(test.select(ID, Y, X), "pca-test")
    both = [pca_fit_transform(df, X, k, out="_pc", fit_on=train) for df in (train, test)]
    return tuple(write_table(df.select(ID, Y, F.col("_pc").alias(X)), "pca") for df in both)


MODEL_FITS = {
    "svm": fit_svm, "dt": fit_tree, "rf": fit_forest, "gbt": fit_gbt, "nb": fit_gaussian_nb, "mlp": fit_mlp,
    "lr": fit_logreg,
}


def fit_stacking(train: DataFrame, test: DataFrame, base_params: dict[str, dict] | None = None,
                 n_folds: int = 5, seed: int = 42, parallelism: int = 8, ready: dict | None = None) -> DataFrame:
    """M8: stacking of six bases (svm, dt, rf, gbt, nb, mlp; no LR base).

    Out-of-fold probabilities (stratified folds, K3) train a logistic
    meta-model (500 iterations, no passthrough); the bases are then refit
    on all training rows and the meta-model combines their test
    probabilities. The 6 x (folds + 1) fits are independent Spark jobs and
    run ``parallelism`` at a time from driver threads. ``ready`` names bases
    that were fit on the same rows with the same parameters elsewhere: functions
    without arguments that return their ``(id, label, prob)`` of ``test``."""
    from fraudlens.operators.sampling import kfold

    bases = ["svm", "dt", "rf", "gbt", "nb", "mlp"]
    base_params = base_params or {}
    folded = write_table(kfold(train, Y, n_folds, seed=seed, id_col=ID), "folds")
    test = write_table(test, "stack-test")
    whole = folded.drop("fold")

    def run(task):
        name, f = task
        if f is None and name in (ready or {}):
            p = ready[name]()
            return p.select(ID, Y, F.lit(name).alias("model"), F.lit(True).alias("of_test"), "prob")
        tr = whole if f is None else folded.where(F.col("fold") != f).drop("fold")
        te = test if f is None else folded.where(F.col("fold") == f).drop("fold")
        p = MODEL_FITS[name](tr, te, **base_params.get(name, {}))
        # one long table of predictions; written, so that the fit runs in this thread
        return write_table(p.select(ID, Y, F.lit(name).alias("model"), F.lit(f is None).alias("of_test"), "prob"), "stack-part")

    tasks = [(b, f) for f in [*range(n_folds), None] for b in ("gbt", "svm", "mlp", "rf", "dt", "nb")]  # the longest first
    with ThreadPoolExecutor(max(1, parallelism)) as ex:
        parts = list(ex.map(run, tasks))
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    wide = write_table(long.groupBy("of_test", ID, Y).agg(
        F.array(*[F.max(F.when(F.col("model") == b, F.col("prob"))) for b in bases]).alias("_ps")), "stack")
    meta = LogisticRegression(featuresCol="_fv", labelCol=Y, maxIter=500).fit(_vec(wide.where(~F.col("of_test")), "_ps"))
    return _prob(meta.transform(_vec(wide.where("of_test"), "_ps")))
