"""G4/G5 on planted structure: two 10-cliques (bridged or not) must split."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from fraudlens.operators import cluster, evaluate


def _cliques(spark, bridge: bool):
    edges = []
    for base in (0, 10):
        for i in range(base, base + 10):
            for j in range(base, base + 10):
                if i != j:
                    edges.append((i, j, 1.0))
    if bridge:
        edges += [(9, 10, 1.0), (10, 9, 1.0)]
    return spark.createDataFrame(edges, "src long, dst long, weight double")


@pytest.mark.parametrize("bridge", [True, False])
@pytest.mark.parametrize("how", ["cluster_qr", "kmeans"])
def test_two_cliques_split(spark, bridge, how):
    lab = {r.id: r.cluster for r in cluster.spectral_clustering(_cliques(spark, bridge), how).collect()}
    a = {lab[i] for i in range(10)}
    b = {lab[i] for i in range(10, 20)}
    assert len(a) == 1 and len(b) == 1 and a != b


def _views(spark, n=90, seed=3):
    rng = np.random.default_rng(seed)
    W = np.zeros((2, n, n))
    for v in range(2):
        for i in range(n):
            for j in rng.choice(n, 12, replace=False):
                if i != j:
                    W[v, i, j] = W[v, j, i] = rng.uniform(0.5, 2.0) * (3.0 if (i < 30 + 20 * v) == (j < 30 + 20 * v) else 1.0)
    rows = [(i, j, [float(W[0, i, j]), float(W[1, i, j])]) for i in range(n) for j in range(n) if W[:, i, j].any()]
    return W, spark.createDataFrame(rows, "src long, dst long, w array<double>")


def test_many_weightings_in_one_run_equal_dense_eigenvectors(spark):
    W, edges = _views(spark)
    weights = [[0.5, 0.5], [0.9, 0.1], [0.1, 0.9], [0.7, 0.3]]
    out, theta, residual, steps = cluster.second_eigenvectors(edges, weights)
    assert max(residual) < 1e-6 and steps < 200
    rows = {r.id: r for r in out.collect()}
    for t, p in enumerate(weights):
        A = p[0] * W[0] + p[1] * W[1]
        d = A.sum(1)
        S = A / np.sqrt(np.outer(d, d))
        x = np.array([rows[i].v2[t] for i in range(len(d))])
        u = np.array([rows[i].u1[t] for i in range(len(d))])
        assert np.allclose(u, np.sqrt(d / d.sum())) and abs(u @ x) < 1e-8 and abs(x @ x - 1) < 1e-8
        assert np.linalg.norm(S @ x - theta[t] * x) < 2e-6
        assert abs(theta[t] - np.sort(np.linalg.eigvalsh(S))[-2]) < 1e-9


def test_trials_together_equal_trials_alone(spark):
    _, edges = _views(spark, seed=5)
    weights = [[0.5, 0.5], [0.95, 0.05], [0.05, 0.95]]
    both, _, _ = cluster.spectral_trials(edges, weights)
    got = {(r.id, r.trial): r.cluster for r in both.collect()}
    for t, p in enumerate(weights):
        one = edges.select("src", "dst", (F.col("w")[0] * p[0] + F.col("w")[1] * p[1]).alias("weight"))
        assert {(r.id, t): r.cluster for r in cluster.spectral_clustering(one, "kmeans").collect()} == {k: v for k, v in got.items() if k[1] == t}


def test_two_means_settles_at_the_best_threshold(spark):
    x = [0.0, 0.1, 0.2, 5.0, 5.1, 9.0, 0.05, 5.2]
    emb = spark.createDataFrame([(i, [1.0, 1.0], [v, 3.0]) for i, v in enumerate(x)], "id long, e0 array<double>, e1 array<double>")
    out, rounds = cluster.two_means(emb, 2)
    labels = {r.id: r.cluster for r in out.collect()}
    assert [labels[i][0] for i in range(len(x))] == [int(v > 3) for v in x]
    assert {c[1] for c in labels.values()} == {0} and rounds >= 1  # rows that are all alike


def test_rand_index_by_group_equals_one_by_one(spark):
    df = spark.createDataFrame([(g, i % 3, (i * (g + 1)) % 2) for g in range(3) for i in range(30)], "g int, label int, cluster int")
    got = {r.g: r.ari for r in evaluate.adjusted_rand_index_by(df, ["g"]).collect()}
    for g in range(3):
        assert got[g] == pytest.approx(evaluate.adjusted_rand_index(df.where(F.col("g") == g)).first()["ari"], abs=1e-12)


def test_label_rules_of_the_review_clusters_share_one_eigenvector_run(spark, monkeypatch):
    from fraudlens.plans import q_graph

    edges = _cliques(spark, True).withColumn("rank", F.lit(1))
    v = spark.range(20).select(F.col("id").alias("review_id"), (F.col("id") >= 10).cast("int").alias("label"))
    monkeypatch.setattr(q_graph, "review_graphs", lambda *_: (v, {name: edges for name in q_graph.REVIEW_VIEWS}))
    runs, whole = [], cluster.second_eigenvectors
    monkeypatch.setattr(cluster, "second_eigenvectors", lambda *a, **kw: runs.append(1) or whole(*a, **kw))
    found = q_graph.review_clusters(spark, "made rows").collect()
    assert len(found) == 40 and len(runs) == 1
    for how in ("cluster_qr", "kmeans"):
        sides = {r.label: {x.cluster for x in found if x.assign == how and x.label == r.label} for r in found}
        assert all(len(s) == 1 for s in sides.values()) and sides[0] != sides[1]
    assert [round(r.ari, 6) for r in q_graph.review_cluster_agreement(spark, "made rows").collect()] == [1.0, 1.0] and len(runs) == 1
