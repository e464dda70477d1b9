"""M4: the perceptron's gradient, its sums over slices, and convergence on planted structure."""
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from fraudlens.operators import evaluate, fitlog, mlp, models, search


def ring(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2))
    y = (np.hypot(*x.T) > 1.1).astype(int)
    df = spark.createDataFrame([(i, int(y[i]), x[i].tolist()) for i in range(n)], "id long, label int, features array<double>")
    return df.where("id % 4 < 3"), df.where("id % 4 = 3")


@pytest.mark.parametrize("activation", mlp.ACTIVATIONS)
def test_gradient_equals_finite_differences(activation):
    net = mlp.Net((3, 5, 4, 1), activation)
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(7, 3)), rng.integers(0, 2, 7).astype(float)
    theta = net.start(3) + 0.05
    _, g = net.loss_gradient(theta, x, y)
    for i in rng.integers(0, len(theta), 25):
        step = np.zeros_like(theta)
        step[i] = 1e-6
        slope = (net.loss_gradient(theta + step, x, y)[0] - net.loss_gradient(theta - step, x, y)[0]) / 2e-6
        assert abs(slope - g[i]) < 1e-5 * max(1.0, abs(slope))


def test_sums_over_many_slices_equal_one(spark, monkeypatch):
    tr, _ = ring(spark)
    net = mlp.Net((2, 6, 1), "tanh")
    theta = net.start(1)
    one = mlp.Table(tr, "id", "features", "label").gradient(net, theta, 0.1)
    monkeypatch.setattr(mlp, "SLICE_ROWS", 20)
    monkeypatch.setattr(mlp, "FAN_IN", 4)
    table = mlp.Table(tr, "id", "features", "label")
    many = table.gradient(net, theta, 0.1)
    assert table.tasks == 15 and abs(one[0] - many[0]) < 1e-12 and np.allclose(one[1], many[1], atol=1e-12)
    rows = tr.collect()
    x, y = np.array([r.features for r in rows]), np.array([r.label for r in rows], dtype=float)
    loss, _ = net.loss_gradient(theta, x, y)
    w = theta * net.penalised()
    assert abs(one[0] - (loss + 0.05 * w @ w) / len(y)) < 1e-12


def test_slices_lie_in_tasks_of_their_own_and_sums_in_smaller_ones(spark, monkeypatch):
    tr, _ = ring(spark)
    net = mlp.Net((2, 6, 1), "tanh")
    theta = net.start(1)
    one = mlp.Table(tr, "id", "features", "label").gradient(net, theta, 0.1)
    monkeypatch.setattr(mlp, "SLICE_ROWS", 60)
    monkeypatch.setattr(mlp, "SUM_ROWS", 25)
    monkeypatch.setattr(mlp, "BLOCK_ROWS", 8)
    for sums, tasks in ((False, 5), (True, 12)):
        table = mlp.Table(tr, "id", "features", "label", sums=sums)
        files = table.rows.groupBy(F.input_file_name().alias("file")).agg(F.countDistinct("slice").alias("slices"), F.sum(F.length("y") / 8).alias("rows")).collect()
        assert table.tasks == len(files) == tasks and all(f.slices == 1 for f in files) and sum(f.rows for f in files) == 300
        got = table.gradient(net, theta, 0.1)
        assert abs(one[0] - got[0]) < 1e-12 and np.allclose(one[1], got[1], atol=1e-12)


@pytest.mark.parametrize("params", [{"solver": "lbfgs", "activation": "tanh", "alpha": 1e-2}, {"solver": "adam", "learning_rate_init": 0.02, "tol": 1e-3},
                                    {"solver": "sgd", "learning_rate": "adaptive", "learning_rate_init": 0.05, "tol": 1e-3}])
def test_solvers_find_a_ring_and_say_that_they_converged(spark, params):
    tr, te = ring(spark)
    fitlog.taken()
    auc = evaluate.roc_auc(models.fit_mlp(tr, te, hidden=(16,), **params), score_col="prob").first()["roc_auc"]
    (log,) = fitlog.taken()
    assert auc > 0.97 and log["model"] == "mlp" and log["converged"] and log["steps"] > 3


def test_slices_average_to_a_good_net(spark, monkeypatch):
    monkeypatch.setattr(mlp, "SLICE_ROWS", 100)
    tr, te = ring(spark)
    out = models.fit_mlp(tr, te, hidden=(16,), solver="adam", learning_rate_init=0.02, tol=1e-3)
    assert evaluate.roc_auc(out, score_col="prob").first()["roc_auc"] > 0.95


def test_used_up_steps_are_recorded_in_the_trial(spark):
    tr, te = ring(spark, 80)
    def objective(p):
        return evaluate.roc_auc(models.fit_mlp(tr, te, hidden=(4,), max_iter=2), score_col="prob").first()["roc_auc"]
    with pytest.warns(RuntimeWarning, match="used up 2 steps"):
        t = search.run_search(spark, "mlp", objective, [{}]).first()
    assert json.loads(t.fits) == [{"model": "mlp", "steps": 2, "converged": False}]


def test_penalty_shrinks_weights_and_null_rows_have_no_probability(spark):
    tr, te = ring(spark, 120)
    size = []
    for alpha in (1e-6, 50.0):
        _, theta, _, _ = mlp.train_mlp(tr, "id", "features", "label", (6,), "tanh", "lbfgs", alpha, "constant", 1e-3, 300, 1e-4, 1)
        size.append(np.abs(theta).sum())
    assert size[1] < 0.3 * size[0]
    odd = te.limit(1).withColumn("features", F.lit(None).cast("array<double>"))
    assert models.fit_mlp(tr, odd, hidden=(4,), max_iter=5).first().prob is None
