"""M1: splits against brute force, the planted ring, and the parameters' meaning."""
import numpy as np

from fraudlens.operators import boosting as B
from fraudlens.operators import evaluate, models


def ring(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2))
    y = (np.hypot(*x.T) > 1.1).astype(int)
    df = spark.createDataFrame([(i, int(y[i]), x[i].tolist()) for i in range(n)], "id long, label int, features array<double>")
    return df.where("id % 4 < 3"), df.where("id % 4 = 3")


def brute(x, g, h, lam, gamma, child):
    """Best gain over every threshold of every slot."""
    best = -np.inf
    for s in range(x.shape[1]):
        for t in np.unique(x[:, s])[:-1]:
            left = x[:, s] <= t
            gl, hl, gr, hr = g[left].sum(), h[left].sum(), g[~left].sum(), h[~left].sum()
            if hl >= child and hr >= child:
                best = max(best, 0.5 * (gl * gl / (hl + lam) + gr * gr / (hr + lam) - (gl + gr) ** 2 / (hl + hr + lam)) - gamma)
    return best


def test_first_split_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 12, size=(150, 3)).astype(float)
    y = (x[:, 1] + rng.normal(0, 2, 150) > 6).astype(int)
    df = spark.createDataFrame([(i, int(y[i]), x[i].tolist()) for i in range(150)], "id long, label int, features array<double>")
    for pos, child, gamma in ((1.0, 1.0, 0.0), (3.0, 12.0, 0.5)):
        rows = B.Rows(df, "id", "features", "label", pos, 64)
        root = (np.full(3, -1), np.zeros(3, dtype=np.int64), np.zeros(3))
        hist = rows.histograms(root, [0], 2 ** 32, 7)
        w = np.where(y == 1, pos, 1.0)
        g, h = w * (0.5 - y), w * 0.25
        assert np.allclose(hist[0, 0].sum(axis=0), [g.sum(), h.sum()])
        (split,) = B.best_splits(hist, np.ones(3, dtype=bool), 1.0, gamma, child)
        assert abs(split[0] - brute(x, g, h, 1.0, gamma, child)) < 1e-9
        left = x[:, split[1]] <= rows.bounds[split[1]][split[2]]
        assert np.allclose(split[3:], [g[left].sum(), h[left].sum(), g[~left].sum(), h[~left].sum()])


def test_many_slices_equal_one_and_margins_are_kept(spark, monkeypatch):
    tr, te = ring(spark, 200)
    args = dict(n_estimators=12, max_depth=3, learning_rate=0.3, subsample=0.8, colsample=0.5)
    one = {r.id: r.prob for r in models.fit_hist_gbt(tr, te, **args).collect()}
    monkeypatch.setattr(B, "SLICE_ROWS", 20)
    monkeypatch.setattr(B, "REFRESH", 3)
    monkeypatch.setattr(B, "FAN_IN", 3)
    many = {r.id: r.prob for r in models.fit_hist_gbt(tr, te, **args).collect()}
    assert one.keys() == many.keys() and all(abs(one[i] - many[i]) < 1e-9 for i in one)


def test_ring_is_found_and_gamma_and_child_weight_stop_splits(spark):
    tr, te = ring(spark)
    out = models.fit_hist_gbt(tr, te, n_estimators=25, max_depth=3, learning_rate=0.3)
    assert evaluate.roc_auc(out, score_col="prob").first()["roc_auc"] > 0.95
    for stop in ({"gamma": 1e6}, {"min_child_weight": 1e6}):
        assert {r.prob for r in models.fit_hist_gbt(tr, te, n_estimators=3, max_depth=2, **stop).collect()} == {0.5}
    empty = models.fit_hist_gbt(tr, te.limit(0), n_estimators=2, max_depth=2)
    assert empty.count() == 0
