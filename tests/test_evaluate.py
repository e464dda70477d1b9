"""V1-V9, G6, G7, A9 against hand-worked values."""
import numpy as np
from pyspark.sql import functions as F

from fraudlens.operators import evaluate

TIED = [(1, 0.9), (1, 0.8), (0, 0.8), (1, 0.6), (0, 0.5), (0, 0.5), (1, 0.3), (0, 0.1)]


def _auc_brute(rows):
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    return sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg) / (len(pos) * len(neg))


def test_auc_ties_half(spark):
    df = spark.createDataFrame(TIED, "label int, score double")
    assert abs(evaluate.roc_auc(df, n_slices=3).first().roc_auc - _auc_brute(TIED)) < 1e-12
    assert abs(_auc_brute(TIED) - 11.5 / 16) < 1e-12  # 4 + 3.5 + 3 + 1 pairs of 16


def test_auc_invariant_to_monotone_map(spark):
    df = spark.createDataFrame(TIED, "label int, score double")
    a = evaluate.roc_auc(df).first().roc_auc
    b = evaluate.roc_auc(df.withColumn("score", F.exp(F.col("score") * 3))).first().roc_auc
    assert a == b


def test_one_class_is_undefined_auc(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.7)], "label int, score double")
    assert evaluate.roc_auc(df).first().roc_auc is None
    m = evaluate.metrics_at(df, 0.5).first()
    assert m.balanced_accuracy == 0.5  # only class 1 present: its recall


def test_sweep_matches_direct_form(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 300)
    s = np.round(rng.random(300), 2)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "label int, score double")
    sweep = {r.j: r for r in evaluate.threshold_sweep(df).collect()}
    ts = 0.01 + np.arange(200) * 0.98 / 199
    for j in (0, 57, 120, 199):
        p = s >= sweep[j].threshold
        tp = int(((p == 1) & (y == 1)).sum())
        fp = int(((p == 1) & (y == 0)).sum())
        assert (sweep[j].tp, sweep[j].fp) == (tp, fp)
        assert abs(sweep[j].threshold - ts[j]) < 1e-15
    best = evaluate.best_threshold(evaluate.threshold_sweep(df)).first()
    bal = [sweep[j].balanced_accuracy for j in range(200)]
    assert best.j == int(np.argmax(bal))


def test_f1_and_accuracy(spark):
    df = spark.createDataFrame(TIED, "label int, score double")
    m = evaluate.metrics_at(df, 0.55).first()
    # predictions >= .55: 0.9, 0.8, 0.8, 0.6 -> tp 3, fp 1, fn 1, tn 3
    assert abs(m.accuracy - 6 / 8) < 1e-12 and abs(m.f1 - 6 / 8) < 1e-12


def test_roc_curve_endpoints(spark):
    df = spark.createDataFrame(TIED, "label int, score double")
    pts = evaluate.roc_curve(df).orderBy(F.desc("threshold")).collect()
    assert (pts[0].fpr, pts[0].tpr) == (0.0, 0.0) and (pts[-1].fpr, pts[-1].tpr) == (1.0, 1.0)


def test_ari_nmi(spark):
    same = spark.createDataFrame([(i % 3, i % 3) for i in range(30)], "label int, cluster int")
    assert evaluate.adjusted_rand_index(same).first().ari == 1.0
    assert abs(evaluate.normalized_mutual_info(same).first().nmi - 1.0) < 1e-12
    indep = spark.createDataFrame([(i % 2, (i // 2) % 2) for i in range(400)], "label int, cluster int")
    assert abs(evaluate.adjusted_rand_index(indep).first().ari) < 0.01
    assert evaluate.normalized_mutual_info(indep).first().nmi == 0.0
    const = spark.createDataFrame([(1, 0)] * 5, "label int, cluster int")
    assert evaluate.adjusted_rand_index(const).first().ari == 1.0


def test_leaderboard_ranks_by_auc(spark):
    rows = [("good", y, float(s) if y else float(s) / 2) for y, s in TIED] + [("bad", y, 0.5) for y, _ in TIED]
    df = spark.createDataFrame(rows, "model string, label int, score double")
    lb = {r.model: r.rank for r in evaluate.leaderboard(df).collect()}
    assert lb == {"good": 1, "bad": 2}
