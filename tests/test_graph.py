"""Exact kNN vs numpy brute force; graph properties."""
import numpy as np
from pyspark.sql import functions as F

from fraudlens.operators import graph


def _vectors(spark, n=300, d=8, seed=0):
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(n, d))
    df = spark.createDataFrame([(i, X[i].tolist()) for i in range(n)], "id long, v array<double>")
    return X, df


def test_knn_equals_brute_force_across_blocks(spark):
    X, df = _vectors(spark)
    k = 7
    g = graph.knn_graph(df, "id", "v", k, n_blocks=4).collect()
    got = {(r.src, r.dst) for r in g}
    D = ((X[:, None, :] - X[None, :, :]) ** 2).sum(-1)
    np.fill_diagonal(D, np.inf)
    want = {(i, int(j)) for i in range(len(X)) for j in np.lexsort((np.arange(len(X)), D[i]))[:k]}
    assert got == want
    deg = {}
    for r in g:
        deg[r.src] = deg.get(r.src, 0) + 1
        assert r.src != r.dst
    assert set(deg.values()) == {k}


def test_one_block_equals_many_blocks(spark):
    _, df = _vectors(spark, 120, 4, 3)
    a = {(r.src, r.dst, r.rank) for r in graph.knn_graph(df, "id", "v", 5, n_blocks=1).collect()}
    b = {(r.src, r.dst, r.rank) for r in graph.knn_graph(df, "id", "v", 5, n_blocks=5).collect()}
    assert a == b


def test_weights_fusion_symmetry(spark):
    _, df = _vectors(spark, 60, 4, 1)
    views = {"a": graph.knn_graph(df, "id", "v", 3), "b": graph.knn_graph(df, "id", "v", 5)}
    n = df.agg(F.count("*").alias("n"))
    w = {r.view: r.weight for r in graph.view_weights(views, n).collect()}
    assert abs(sum(w.values()) - 1.0) < 1e-12 and abs(w["a"] / w["b"] - 5 / 3) < 1e-12
    fused = graph.fuse_graphs(views, graph.view_weights(views, n))
    total = fused.agg(F.sum("weight")).first()[0]
    assert abs(total - (w["a"] * 60 * 3 + w["b"] * 60 * 5)) < 1e-9
    sym = {(r.src, r.dst): r.weight for r in graph.symmetrize(fused).collect()}
    assert all(abs(sym[(s, d)] - sym[(d, s)]) < 1e-15 for s, d in sym)


def test_clustered_rows_skip_most_blocks(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 100, size=(20, 6))
    X = np.concatenate([c + rng.normal(size=(60, 6)) for c in centres])
    X[5:25] = X[5]  # a group of copies: ties, and a ring of radius zero
    df = spark.createDataFrame([(i, X[i].tolist()) for i in range(len(X))], "id long, v array<double>")
    k = 6
    g = graph.knn_graph(df, "id", "v", k, rows_per_block=50)
    D = ((X[:, None, :] - X[None, :, :]) ** 2).sum(-1)
    np.fill_diagonal(D, np.inf)
    want = {(i, int(j), r + 1) for i in range(len(X)) for r, j in enumerate(np.lexsort((np.arange(len(X)), D[i]))[:k])}
    assert {(r.src, r.dst, r["rank"]) for r in g.collect()} == want

    v = df.select("id", F.col("v").alias("vec"))
    blocked, pivots, rings = graph.pivot_blocks(v, len(X), 50)
    assert blocked.groupBy("blk").count().agg(F.max("count")).first()[0] <= 50
    asked = graph.visits(blocked.withColumn("bound", F.lit(30.0)), pivots, rings).collect()
    went = sum(len(r.visits) for r in asked)
    assert went < 0.25 * len(X) * (len(rings) - 1)  # isotropic rows would go nearly everywhere
    block = {r.id: r.blk for r in blocked.collect()}
    for r in asked:  # nothing within the bound is skipped
        assert {block[int(j)] for j in np.flatnonzero(D[r.id] <= 30.0)} <= {r.blk, *r.visits}


def test_descent_gives_k_neighbours_and_recall(spark):
    X, df = _vectors(spark, 1500, 16, 7)
    near = graph.knn_graph_descent(df, "id", "v", 10, rows_per_block=128)
    assert near.groupBy("src").agg(F.count("*").alias("n"), F.max("rank").alias("m")).where("n != 10 or m != 10").count() == 0
    assert near.where("src = dst").count() == 0 and near.select("src").distinct().count() == 1500
    assert graph.recall_at_k(near, graph.knn_graph(df, "id", "v", 10)).first()["recall"] >= 0.9
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(40)], "id long, v array<double>")
    assert graph.knn_graph_descent(same, "id", "v", 5).count() == 200
    assert graph.knn_graph_descent(df.limit(0), "id", "v", 3).count() == 0
    assert graph.knn_graph_descent(df.limit(1), "id", "v", 3).count() == 0


def test_descent_meets_in_cells_like_brute_force(spark, monkeypatch):
    """A vector comes once to a cell, in its own precision; only the k best of a row leave it."""
    import pyarrow as pa

    monkeypatch.setattr(graph, "DESCENT_PAIRS", 50)
    rng, k = np.random.default_rng(3), 4
    X = rng.normal(size=(30, 5)).astype(np.float32)
    X[7] = X[8] = X[9]
    ids, far = rng.permutation(30) * 10, np.full(30, 9.0)
    lists = [rng.permutation(30)[:12] for _ in range(20)]
    got = graph._meet(k)(pa.table({"cell": [1] * 20, "fresh": [ids[m[:5]].tolist() for m in lists], "stale": [ids[m[5:]].tolist() for m in lists]}),
                         pa.table({"at": [1] * 30, "u": ids, "vec": pa.array(list(X), pa.list_(pa.float32())), "far": far}))
    near = {}
    for m in lists:
        for a, i in enumerate(m):
            for b, j in enumerate(m):
                d = float(((X[i].astype(float) - X[j].astype(float)) ** 2).sum())
                if i != j and (a < 5 or b < 5) and d < 9.0:
                    near.setdefault(int(ids[i]), {})[int(ids[j])] = d
    want = {(i, j) for i, js in near.items() for j, _ in sorted(js.items(), key=lambda e: (round(e[1], 9), e[0]))[:k]}
    assert set(zip(got["src"].to_pylist(), got["dst"].to_pylist())) == want and got.num_rows == len(want)

    Y = rng.normal(size=(400, 8)).astype(np.float32)
    rows = [(i, [float(x) for x in y]) for i, y in enumerate(Y)]
    edges = [{(r.src, r.dst, r["rank"]) for r in graph.knn_graph_descent(spark.createDataFrame(rows, f"id long, v array<{t}>"), "id", "v", 6, rows_per_block=64).collect()}
             for t in ("float", "double")]
    assert edges[0] == edges[1] and len(edges[0]) == 2400


def test_view_edges_are_the_symmetrised_fusion(spark):
    _, df = _vectors(spark, 40, 4, 2)
    views = {"a": graph.knn_graph(df, "id", "v", 3), "b": graph.knn_graph(df, "id", "v", 6)}
    want = {(r.src, r.dst): r.weight for r in graph.symmetrize(graph.fuse_graphs(views, {"a": 0.3, "b": 0.7})).collect()}
    got = {(r.src, r.dst): 0.3 * r.w[0] + 0.7 * r.w[1] for r in graph.view_edges(views).collect()}
    assert got.keys() == want.keys() and all(abs(got[e] - want[e]) < 1e-12 for e in want)


def test_modularity_equals_its_definition(spark):
    rng = np.random.default_rng(1)
    A = rng.uniform(size=(20, 20)) * (rng.uniform(size=(20, 20)) < 0.3)
    A = A + A.T
    c = rng.integers(0, 3, 20)
    edges = spark.createDataFrame([(i, j, float(A[i, j])) for i in range(20) for j in range(20) if A[i, j]], "src long, dst long, weight double")
    labels = spark.createDataFrame([(i, int(c[i])) for i in range(20)], "id long, cluster int")
    d, W = A.sum(1), A.sum()
    want = sum((A[i, j] - d[i] * d[j] / W) for i in range(20) for j in range(20) if c[i] == c[j]) / W
    assert abs(graph.modularity(edges, labels).first()["modularity"] - want) < 1e-12
    assert graph.modularity(edges.limit(0), labels).first()["modularity"] is None


def test_rows_are_sent_a_fixed_number_of_times(spark, monkeypatch):
    X, df = _vectors(spark, 1200, 4, 5)
    X[100:130] = X[100]  # copies: ties
    df = spark.createDataFrame([(i, X[i].tolist()) for i in range(len(X))], "id long, v array<double>")
    k, sent, whole = 6, spark.sparkContext.accumulator(0), graph._stream_past

    def counted(pivots, k):
        run = whole(pivots, k)

        def past(batches):
            def seen():
                for b in batches:
                    sent.add(b.num_rows)
                    yield b
            yield from run(seen())
        return past

    monkeypatch.setattr(graph, "_stream_past", counted)
    monkeypatch.setattr(graph, "GROUPS", 5)
    got = {(r.src, r.dst, r["rank"]) for r in graph.knn_graph(df, "id", "v", k, rows_per_block=20).collect()}
    D = ((X[:, None, :] - X[None, :, :]) ** 2).sum(-1)
    np.fill_diagonal(D, np.inf)
    assert got == {(i, int(j), r + 1) for i in range(len(X)) for r, j in enumerate(np.lexsort((np.arange(len(X)), D[i]))[:k])}
    assert sent.value == 5 * len(X)  # sixty blocks, but five groups
    # single precision, and a group bound that makes more groups
    monkeypatch.setattr(graph, "GROUP_BYTES", 1200 * (4 * 8 + k * 24) // 9)
    one = df.select("id", F.col("v").cast("array<float>").alias("v"))
    got = {(r.src, r.dst, r["rank"]) for r in graph.knn_graph(one, "id", "v", k, rows_per_block=20).collect()}
    X = X.astype(np.float32).astype(float)
    D = ((X[:, None, :] - X[None, :, :]) ** 2).sum(-1)
    np.fill_diagonal(D, np.inf)
    assert got == {(i, int(j), r + 1) for i in range(len(X)) for r, j in enumerate(np.lexsort((np.arange(len(X)), D[i]))[:k])}
    assert sent.value >= (5 + 9) * len(X)


def test_blocks_longer_than_a_groups_share_leave_no_empty_group(spark):
    X = np.repeat([[0.0, 1.0], [1.0, 1.0]], [13, 28], axis=0)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "id long, v array<double>")
    rings = graph.pivot_blocks(df.withColumnRenamed("v", "vec"), len(X), 20)[2]
    assert rings["rows"].tolist() == [13, 20, 8]  # the second third of the rows has no block that begins in it
    k = 4
    got = {(r.src, r.dst, r.rank) for r in graph.knn_graph(df, "id", "v", k, rows_per_block=20).collect()}
    D = ((X[:, None, :] - X[None, :, :]) ** 2).sum(-1)
    np.fill_diagonal(D, np.inf)
    assert got == {(i, int(j), n + 1) for i in range(len(X)) for n, j in enumerate(np.lexsort((np.arange(len(X)), D[i]))[:k])}
