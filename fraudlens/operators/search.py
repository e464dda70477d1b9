"""Hyper-parameter search (H1-H3) and view-weight search support.

H1: search spaces with uniform int / float, log-uniform float,
categorical and conditional dimensions. The sampler is a tree-structured
Parzen estimator: its first ``STARTUP`` trials are seeded random draws (which
may run side by side), and every later one is drawn where the good trials so
far are dense and the others are not. The reference's studies end after ten
trials, which are all start-up draws of its sampler too.
H2: each trial is a distributed fit + a distributed AUC; trials may run
concurrently from driver threads (``parallelism``), since every fit is its
own set of Spark jobs. H3: the trial table ``(model, trial, params,
score, status)`` and its best row (``max_by``); a failed trial scores 0
with status ``failed`` (T17). ``fits`` says in how many steps the trial's
iterative fits ended, and whether they converged.
"""

from __future__ import annotations

import json
import math
from concurrent.futures import ThreadPoolExecutor
from typing import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fraudlens.operators import fitlog

# ---- fixed values: the search spaces of the reference's eight studies ----------
# ("int", lo, hi) | ("float", lo, hi) | ("log", lo, hi) | ("cat", [choices])
SPACES: dict[str, dict] = {
    "gbt": {"n_estimators": ("int", 200, 800), "max_depth": ("int", 3, 10),
            "learning_rate": ("log", 0.01, 0.3), "subsample": ("float", 0.5, 1.0),
            "colsample": ("float", 0.5, 1.0), "min_child_weight": ("int", 1, 10),
            "gamma": ("float", 0.0, 5.0)},
    "lr": {"C": ("log", 1e-4, 10.0), "penalty": ("cat", ["l1", "l2"]),
           "class_weight": ("cat", [None, "balanced"])},
    "svm": {"kernel": ("cat", ["rbf", "poly"]), "C": ("log", 1e-4, 10.0),
            "gamma": ("log", 1e-5, 1e-1), "class_weight": ("cat", [None, "balanced"])},
    "mlp": {"n_layers": ("int", 1, 3), "n_units": ("int", 32, 256), "activation": ("cat", ["relu", "tanh"]),
            "solver": ("cat", ["adam", "lbfgs"]), "alpha": ("log", 1e-6, 1e-2),
            "learning_rate": ("cat", ["constant", "adaptive"]), "learning_rate_init": ("log", 1e-4, 1e-2)},
    "dt": {"criterion": ("cat", ["gini", "entropy"]), "max_depth": ("int", 3, 15),
           "min_samples_split": ("int", 2, 20), "min_samples_leaf": ("int", 1, 10),
           "max_features": ("cat", [None, "sqrt", "log2"]), "class_weight": ("cat", [None, "balanced"])},
    "rf": {"n_estimators": ("int", 100, 600), "max_depth": ("int", 3, 15),
           "min_samples_split": ("int", 2, 20), "min_samples_leaf": ("int", 1, 10),
           "max_features": ("cat", ["sqrt", "log2"]), "class_weight": ("cat", [None, "balanced"])},
    "nb": {"var_smoothing": ("log", 1e-12, 1e-6)},
    "views": {"w1": ("float", 0.1, 0.8), "w2": ("float", 0.1, 0.8), "w3": ("float", 0.1, 0.8)},
}
# Conditional dimensions: the polynomial kernel also draws a degree in 2..5;
# the MLP draws one width per layer.
CONDITIONAL = {("svm", "kernel", "poly"): {"degree": ("int", 2, 5), "coef0": ("float", 0.0, 1.0)},
               ("svm", "kernel", "rbf"): {"degree": ("int", 1, 10)},
               ("lr", "penalty", "l2"): {"solver": ("cat", ["liblinear", "saga"])}}
# Drawn and recorded with every trial, but without effect on the fit here: the
# solver of the logistic regression (Spark has one), degree under the rbf
# kernel and coef0 (without effect in the reference as well).
UNUSED = {"lr": {"solver"}, "svm": {"coef0"}}
# ---------------------------------------------------------------------------------


def _draw(rng: np.random.Generator, spec):
    kind = spec[0]
    if kind == "int":
        return int(rng.integers(spec[1], spec[2] + 1))
    if kind == "float":
        return float(rng.uniform(spec[1], spec[2]))
    if kind == "log":
        return float(math.exp(rng.uniform(math.log(spec[1]), math.log(spec[2]))))
    if kind == "cat":
        return spec[1][int(rng.integers(0, len(spec[1])))]
    raise ValueError(kind)


def sample_params(space_name: str, n_trials: int, seed: int = 42) -> list[dict]:
    """H1: ``n_trials`` seeded draws from a named space."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n_trials):
        p = {k: _draw(rng, s) for k, s in SPACES[space_name].items()}
        for (sp, key, val), extra in CONDITIONAL.items():
            if sp == space_name and p.get(key) == val:
                p.update({k: _draw(rng, s) for k, s in extra.items()})
        if space_name == "mlp":
            p["hidden"] = tuple(int(rng.integers(32, 257)) for _ in range(p.pop("n_layers")))
            p.pop("n_units")
        out.append(p)
    return out


#: Random trials before the estimator starts, and candidates that it draws per dimension.
STARTUP, CANDIDATES = 10, 24


def _flat(space_name: str, p: dict) -> dict:
    """A trial's parameters by dimension (a layer's width is one)."""
    if space_name != "mlp":
        return dict(p)
    return {k: v for k, v in p.items() if k != "hidden"} | {"n_layers": len(p["hidden"])} | {f"units_{i}": u for i, u in enumerate(p["hidden"])}


class _Parzen:
    """Density of one dimension: a kernel on each value seen and the prior."""

    def __init__(self, spec, seen: list):
        self.spec, self.kind = spec, spec[0]
        if self.kind == "cat":
            counts = np.array([1.0 + sum(v == c for v in seen) for c in spec[1]])
            self.p = counts / counts.sum()
            return
        f = math.log if self.kind == "log" else float
        edge = 0.5 if self.kind == "int" else 0.0
        self.low, self.high = f(spec[1]) - edge, f(spec[2]) + edge
        # (one name may have another range under another condition)
        x = np.sort(np.array([f(v) for v in seen if spec[1] <= v <= spec[2]], dtype=float))
        mid, span = (self.low + self.high) / 2, self.high - self.low
        self.at = np.r_[x, mid]
        ends = np.r_[self.low, x, self.high]
        wide = np.maximum(ends[1:-1] - ends[:-2], ends[2:] - ends[1:-1]) if len(x) else np.empty(0)
        self.sd = np.r_[np.clip(wide, span / min(100, 1 + len(self.at)), span), span]

    def draw(self, rng: np.random.Generator):
        if self.kind == "cat":
            return self.spec[1][int(rng.choice(len(self.p), p=self.p))]
        i = int(rng.integers(len(self.at)))
        x = rng.normal(self.at[i], self.sd[i])
        while not self.low <= x < self.high:
            x = rng.normal(self.at[i], self.sd[i])
        if self.kind == "int":
            return int(min(self.spec[2], max(self.spec[1], round(x))))
        return float(min(self.spec[2], max(self.spec[1], math.exp(x) if self.kind == "log" else x)))

    def log_density(self, v) -> float:
        if self.kind == "cat":
            return math.log(self.p[self.spec[1].index(v)])
        x = math.log(v) if self.kind == "log" else float(v)
        cdf = lambda z: 0.5 * (1.0 + np.vectorize(math.erf)(z / math.sqrt(2.0)))
        inside = cdf((self.high - self.at) / self.sd) - cdf((self.low - self.at) / self.sd)
        dens = np.exp(-0.5 * ((x - self.at) / self.sd) ** 2) / (math.sqrt(2.0 * math.pi) * self.sd * inside)
        return math.log(max(float(dens.mean()), 1e-300))


def next_params(space_name: str, tried: list[tuple[dict, float]], seed: int = 42) -> dict:
    """H1: the next trial's parameters, from the parameters and scores so far.

    The best tenth (one at least, 25 at most) are the good trials. A dimension
    is drawn ``CANDIDATES`` times from their density; the draw with the largest
    ratio to the density of the others is taken. Conditional dimensions are
    drawn if they apply, from the trials that had them."""
    if len(tried) < STARTUP:
        return sample_params(space_name, len(tried) + 1, seed)[-1]
    rng = np.random.default_rng([seed, len(tried)])
    order = sorted(tried, key=lambda t: -t[1])
    n_good = min(25, max(1, math.ceil(0.1 * len(order))))
    good, rest = [[_flat(space_name, p) for p, _ in part] for part in (order[:n_good], order[n_good:])]

    def choose(name, spec):
        g, r = (_Parzen(spec, [p[name] for p in part if name in p]) for part in (good, rest))
        return max((g.draw(rng) for _ in range(CANDIDATES)), key=lambda v: g.log_density(v) - r.log_density(v))

    p = {k: choose(k, s) for k, s in SPACES[space_name].items() if (space_name, k) != ("mlp", "n_units")}
    for (sp, key, val), extra in CONDITIONAL.items():
        if sp == space_name and p.get(key) == val:
            p.update({k: choose(k, s) for k, s in extra.items()})
    if space_name == "mlp":
        p["hidden"] = tuple(choose(f"units_{i}", SPACES["mlp"]["n_units"]) for i in range(p.pop("n_layers")))
    return p


def run_study(spark: SparkSession, model: str, objective: Callable[[dict], float], n_trials: int, seed: int = 42, parallelism: int = 1) -> DataFrame:
    """H2 with the sampler: the start-up trials ``parallelism`` at a time, the
    later ones one after the other, each drawn from all before it. The trial
    table of ``run_search``; a failed trial counts with its score 0."""
    params = sample_params(model, min(n_trials, STARTUP), seed)
    rows = _run(model, objective, list(enumerate(params)), parallelism)
    while len(rows) < n_trials:
        p = next_params(model, [(q, r[3]) for q, r in zip(params, rows)], seed)
        params.append(p)
        rows += _run(model, objective, [(len(rows), p)], 1)
    return spark.createDataFrame(rows, TRIALS)


TRIALS = "model string, trial int, params string, score double, status string, error string, fits string"


def run_search(spark: SparkSession, model: str, objective: Callable[[dict], float], params: list[dict],
               parallelism: int = 1) -> DataFrame:
    """H2: evaluate every parameter set; returns the trial table."""
    return spark.createDataFrame(_run(model, objective, list(enumerate(params)), parallelism), TRIALS)


def _run(model: str, objective: Callable[[dict], float], numbered: list[tuple[int, dict]], parallelism: int) -> list[tuple]:
    """Rows of the trial table."""
    def one(i_p):
        i, p = i_p
        fitlog.taken()
        try:
            score, status, error = float(objective(p)), "ok", None
        except Exception as e:  # noqa: BLE001 - T17: a failed trial scores 0 and says why
            score, status, error = 0.0, "failed", f"{type(e).__name__}: {e}"[:2000]
        return (model, i, json.dumps(p, sort_keys=True, default=str), score, status, error, json.dumps(fitlog.taken()))

    if parallelism > 1:
        with ThreadPoolExecutor(parallelism) as ex:
            return list(ex.map(one, numbered))
    return [one(x) for x in numbered]


def used(model: str, params: dict) -> dict:
    """The parameters of a trial that the fit takes."""
    out = {k: v for k, v in params.items() if k not in UNUSED.get(model, ())}
    if model == "svm" and out.get("kernel") == "rbf":
        out.pop("degree", None)
    return out


def best_trial(trials: DataFrame) -> DataFrame:
    """H3: best score per model; ties go to the earliest trial."""
    return trials.groupBy("model").agg(
        F.max_by(F.struct("trial", "params", "score"), F.struct(F.col("score"), -F.col("trial"))).alias("b")) \
        .select("model", "b.trial", "b.params", "b.score")
