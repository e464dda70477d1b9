"""Parameters are honoured or refused, nothing is cut in silence, and hot keys are split."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from fraudlens.operators import cluster, evaluate, graph, models, prep, search, text
from fraudlens.session import ensure_checkpoint_dir
from fraudlens.sources import tsv


def rings(spark, n=240, seed=0):
    """Label 1 inside, 0 outside: no linear rule tells them apart."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        y, a = i % 2, rng.uniform(0, 2 * np.pi)
        r = (0.5 if y else 2.0) + rng.normal(0, 0.1)
        rows.append((i, y, [float(r * np.cos(a)), float(r * np.sin(a))]))
    df = spark.createDataFrame(rows, "id long, label int, features array<double>")
    return df.where("id % 4 < 2"), df.where("id % 4 >= 2")


@pytest.mark.parametrize("name,params", [
    ("gbt", {"n_estimators": 20, "max_depth": 3}), ("svm", {"kernel": "rbf", "C": 10.0, "gamma": 1.0, "max_iter": 30}),
    ("svm", {"kernel": "poly", "degree": 2, "C": 10.0, "gamma": 1.0, "max_iter": 30}), ("mlp", {"hidden": (16,), "max_iter": 200}),
    ("rf", {"n_estimators": 20, "max_depth": 5})])
def test_models_find_a_planted_ring(spark, name, params):
    tr, te = rings(spark)
    auc = evaluate.roc_auc(models.MODEL_FITS[name](tr, te, **params), score_col="prob").first()["roc_auc"]
    assert auc > 0.95


def test_stacking_combines_its_bases(spark):
    tr, te = rings(spark, 160)
    p = {"svm": {"gamma": 1.0, "C": 10.0, "max_iter": 20, "n_folds": 2}, "gbt": {"n_estimators": 5, "max_depth": 2}, "rf": {"n_estimators": 5, "max_depth": 4}, "mlp": {"hidden": (8,), "max_iter": 50}}
    out = models.fit_stacking(tr, te, p, n_folds=2)
    assert out.count() == te.count()
    assert evaluate.roc_auc(out, score_col="prob").first()["roc_auc"] > 0.95


def test_svm_says_when_its_steps_are_used_up(spark):
    tr, te = rings(spark, 80)
    with pytest.warns(RuntimeWarning, match="used up 2 steps"):
        models.fit_svm(tr, te, gamma=1.0, C=10.0, max_iter=2, n_folds=2)


def test_svm_degree_and_unknown_choices(spark):
    tr, te = rings(spark, 80)
    probs = [[r.prob for r in models.fit_svm(tr, te, kernel="poly", degree=d, gamma=1.0, max_iter=10, n_folds=2).orderBy("id").collect()] for d in (3, 5)]
    assert not np.allclose(*probs)
    for call in (lambda: models.fit_mlp(tr, te, solver="newton"), lambda: models.fit_mlp(tr, te, activation="step"), lambda: models.fit_svm(tr, te, kernel="sigmoid"),
                 lambda: models.fit_gbt(tr, te, max_depth=31), lambda: models.fit_forest(tr, te, max_depth=31)):
        with pytest.raises(ValueError):
            call()


def test_tensor_sketch_approximates_the_kernel():
    import pandas as pd
    x = np.random.default_rng(0).standard_normal((30, 4))
    z = np.vstack(models._sketch_udf(4, 4096, 3, 0.5, 1).func(pd.Series(list(x))).to_numpy())
    want = (0.5 * x @ x.T) ** 3
    assert np.abs(z @ z.T - want).max() < 0.2 * np.abs(want).max()


def test_nb_of_one_class_and_failed_trials(spark):
    rows = spark.createDataFrame([(1, 1, [1.0]), (2, 1, [2.0])], "id long, label int, features array<double>")
    assert [r.prob for r in models.fit_gaussian_nb(rows, rows).collect()] == [1.0, 1.0]

    def objective(p):
        raise RuntimeError("no luck")
    t = search.run_search(spark, "nb", objective, [{}]).first()
    assert t.status == "failed" and "no luck" in t.error and t.score == 0.0


def test_search_draws_every_dimension_and_names_the_used_ones():
    for p in search.sample_params("svm", 30, 3):
        assert "degree" in p and ("coef0" in p) == (p["kernel"] == "poly")
        assert "coef0" not in search.used("svm", p) and ("degree" in search.used("svm", p)) == (p["kernel"] == "poly")
    for p in search.sample_params("mlp", 10, 3):
        assert {"activation", "alpha", "learning_rate", "hidden"} <= set(p)
        assert search.used("mlp", p) == p  # every dimension reaches the fit


def test_hot_key_is_split_in_the_back_join(spark):
    keep = {k: spark.conf.get(k, None) for k in (
        "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold", "spark.sql.adaptive.advisoryPartitionSizeInBytes",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "spark.sql.adaptive.skewJoin.skewedPartitionFactor", "spark.sql.adaptive.coalescePartitions.enabled")}
    for k, v in zip(keep, ("-1", "-1", "32k", "64k", "2", "false")):
        spark.conf.set(k, v)
    try:
        df = spark.range(200_000, numPartitions=8).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("k"), F.rand(1).alias("v"), F.sha2(F.col("id").cast("string"), 256).alias("pad"))
        out = prep.aggregate_back(df, ["k"], [F.count(F.lit(1)).alias("n")])
        out.write.format("noop").mode("overwrite").save()
        collected = out.groupBy().agg(F.max("n"))
        assert collected.first()[0] == 100_001
        rows = out.select("k", "n", "pad")
        qe = rows._jdf.queryExecution()
        qe.toRdd().count()
        assert "skew=true" in qe.executedPlan().toString()
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_null_scores_are_left_out_everywhere(spark):
    rows = [(1, 0.9), (1, 0.8), (0, 0.1), (0, 0.2), (1, None), (0, None)]
    df = spark.createDataFrame(rows, "label int, score double")
    m = evaluate.metrics_at_best_threshold(df).first()
    assert m.accuracy == 1.0 and m.roc_auc == 1.0
    assert evaluate.roc_auc(df).first()["n_pos"] == 2
    assert evaluate.roc_curve(df).count() == 5


def test_majority_baseline(spark):
    df = spark.createDataFrame([(1,)] * 9 + [(0,)] + [(None,)], "label int")
    b = evaluate.majority_baseline(df).first()
    assert b.accuracy == 0.9 and b.balanced_accuracy == 0.5 and abs(b.f1 - 18 / 19) < 1e-12
    other = evaluate.majority_baseline(df, positive_label=0).first()
    assert other.accuracy == 0.9 and other.f1 == 0.0


def test_crosstab_counts_every_cluster(spark):
    df = spark.createDataFrame([(1, 0), (1, 2), (-1, 1), (-1, None)], "label int, cluster int")
    whole = evaluate.crosstab(df).collect()
    assert sum(v for r in whole for k, v in r.asDict().items() if k != "label_name") == 4
    assert sum(r.cluster_other for r in evaluate.crosstab(df, clusters=(0, 1)).collect()) == 2


def test_lsh_gives_each_vertex_k_neighbours(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(0, 20, 8)]) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    near = graph.knn_graph_lsh(df, "id", "v", 10)
    assert near.count() == 1200 and near.select("src", "dst").distinct().count() == 1200
    assert near.groupBy("src").agg(F.max("rank").alias("m")).where("m != 10").count() == 0
    assert graph.recall_at_k(near, graph.knn_graph(df, "id", "v", 10)).first()["recall"] > 0.5
    assert graph.knn_graph_lsh(df.limit(0), "id", "v", 3).count() == 0


def test_lsh_meets_all_rows_of_its_buckets(spark, monkeypatch):
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(8)
    x = rng.normal(0, 3, (150, 4))
    x[100:130] = x[0]  # copies
    df = spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(x)], "id long, v array<double>")
    vec = df.select("id", array_to_vector("v").alias("v"))
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=6.0, numHashTables=2, seed=3).fit(vec)
    h = {r["id"]: [b[0] for b in r["h"]] for r in model.transform(vec).collect()}
    d2 = ((x[:, None] - x[None, :]) ** 2).sum(axis=2)
    want = {}
    for i in h:
        near = sorted((d2[i, j], j) for j in h if j != i and any(a == b for a, b in zip(h[i], h[j])))
        if len(near) >= 5:
            want[i] = [j for _, j in near[:5]]
    monkeypatch.setattr(graph, "LSH_ROWS", (16, 16))
    got = {}
    for r in graph.knn_graph_lsh(df, "id", "v", 5, bucket_length=6.0, num_hash_tables=2, seed=3).orderBy("src", "rank").collect():
        got.setdefault(r["src"], []).append(r["dst"])
    assert len(want) > 100 and all(got[i] == want[i] for i in want)
    assert len(got) == 150 and all(len(set(g)) == 5 for g in got.values())


def test_lsh_ends_where_no_bucket_spans_zero(spark):
    df = spark.createDataFrame([(1, [5.0, 5.0]), (2, [-5.0, -5.0]), (3, [float("nan"), 0.0]), (4, None)], "id long, v array<double>")
    assert sorted((r["src"], r["dst"]) for r in graph.knn_graph_lsh(df, "id", "v", 3).collect()) == [(1, 2), (2, 1)]


def test_null_vectors_and_texts(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [None, 1.0]), (None, [1.0, 1.0])], "id long, v array<double>")
    assert {(r.src, r.dst) for r in graph.knn_graph(df, "id", "v", 2).collect()} == {(1, 2), (2, 1)}
    t = spark.createDataFrame([(1, None), (2, ""), (3, "one two")], "id long, Review string")
    v = {r.id: r.cnn for r in text.cnn_embedding(t).collect()}
    assert v[1] == v[2] != v[3]


def test_lanczos_converges_or_says_so(spark):
    edges = [(i, j, 1.0) for g in (0, 30) for i in range(g, g + 30) for j in range(g, g + 30) if i != j and (i + j) % 3] + [(0, 30, 0.1), (30, 0, 0.1)]
    e = spark.createDataFrame(edges, "src long, dst long, weight double")
    a, la, _ = cluster.second_eigenvector(e)
    b, lb, steps = cluster.second_eigenvector(e, width=4)  # needs restarts
    assert abs(la - lb) < 1e-8 and steps > 4
    cos = a.join(b.select("id", F.col("v2").alias("w")), "id").agg(F.sum(F.col("v2") * F.col("w"))).first()[0]
    assert abs(abs(cos) - 1) < 1e-6
    with pytest.raises(RuntimeError, match="did not converge"):
        cluster.second_eigenvector(e, width=2, max_restarts=0)


def test_tsv_lines_keep_their_tabs_and_bad_lines_are_named(spark):
    home = f"{ensure_checkpoint_dir(spark)}/tsv-test-{id(spark)}"
    lines = ['1\t2\t2014-01-01\ta "quoted\ttext" with\ttabs', "3\t4\t2014-01-02\t"]
    spark.createDataFrame([(x,) for x in lines], "value string").write.mode("overwrite").text(f"{home}/good")
    got = sorted((r.user_id, r.prod_id, r.date, r.Review) for r in tsv.read_content(spark, f"{home}/good").collect())
    assert got == [(1, 2, "2014-01-01", 'a "quoted\ttext" with\ttabs'), (3, 4, "2014-01-02", None)]
    spark.createDataFrame([("1\t2\t5.0\t-1\td",), ("x\t2\t5.0\t-1\td",), ("1\t2",)], "value string").write.mode("overwrite").text(f"{home}/meta")
    kept = tsv.read_metadata(spark, f"{home}/meta", on_bad="keep").collect()
    assert sorted(r._corrupt or "" for r in kept) == ["", "1\t2", "x\t2\t5.0\t-1\td"]
    with pytest.raises(Exception, match="does not fit"):
        tsv.read_metadata(spark, f"{home}/meta").collect()


def test_fits_do_not_depend_on_how_the_rows_lie(spark, monkeypatch):
    """A small table is one task, wherever its rows come from."""
    from fraudlens.operators import fitlog, models

    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 3))
    rows = [(i, int(x[i] @ x[i] < 2.4), x[i].tolist()) for i in range(300)]
    wide = spark.createDataFrame(rows, "id long, label int, features array<double>").repartition(7)
    one = spark.createDataFrame(rows[::-1], "id long, label int, features array<double>").coalesce(1)
    assert models._dealt(wide).rdd.getNumPartitions() == 1
    monkeypatch.setattr(models, "ROWS_PER_TASK", 100)
    assert models._dealt(wide).rdd.getNumPartitions() == 3
    prob = lambda df: {r.id: r.prob for r in models.fit_forest(df, one, n_estimators=5, max_depth=3).collect()}
    assert prob(wide) == prob(one)
    fitlog.taken()
    models.fit_svm(wide, one, max_iter=3, n_folds=2).collect()
    assert [r["model"] for r in fitlog.taken()] == ["svm"] * 3  # two folds and the whole
    # the wide rows are mapped as they are read, in pieces
    f = models._rff(3, 16, 0.5, 1)
    got = {r.id: r["_z"] for r in models._mapped(wide, f, 3, rows=11).collect()}
    assert all(np.allclose(got[i], f(x[i:i + 1])[0], rtol=0, atol=1e-12) for i in range(300))
