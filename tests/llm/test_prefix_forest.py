import numpy as np
from pyspark.sql import functions as F

from fraudlens.llm import prefix_forest as P


def brute(rows, queries, k):
    ok = lambda v: v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    rows = [(i, tuple(v)) for i, v in rows if i is not None and ok(v)]
    seen = sorted(set(rows))
    out = {}
    for q, v in sorted(set((i, tuple(v)) for i, v in queries if i is not None and ok(v))):
        near = sorted((-float(np.dot(np.array(v, dtype=np.float64), np.array(w, dtype=np.float64))), i) for i, w in seen if i != q and len(w) == len(v))
        out[q] = [(i, -s) for s, i in near[:k]]
    return out


def got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_odd_vectors_ties_and_clashes(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]),
            (7, [None, 1.0]), (8, []), (9, [5.0, -3.0]), (10, [-1.0, 0.5]), (11, [1.0, 2.0, 3.0]), (12, [2.0, 1.0, 0.0]), (None, [1.0, 1.0]), (20, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("id", "v", "dim", "shard", "block", "rank", "score")})
    want = brute(rows, rows, 20)
    have = got(P.nearest(df, df))
    assert {q: [i for i, _ in x] for q, x in have.items()} == {q: [i for i, _ in x] for q, x in want.items()}
    assert P.nearest_query(df.limit(0)).count() == 0
    assert set(got(P.nearest_query(df))) == {0, 20}


def test_many_copies_are_ranked_by_id(spark):
    rows = [(i, [0.6, 0.8, 0.0]) for i in range(500)] + [(500 + i, [float(np.cos(i)), float(np.sin(i)), 0.1]) for i in range(500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    have = got(P.nearest(df, df.where("vec_id in (40, 3)"), shard_rows=128))
    assert [i for i, _ in have[40]] == list(range(20))
    assert [i for i, _ in have[3]] == [i for i in range(21) if i != 3]


def test_norms_matter_to_the_inner_product(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((600, 8)) * rng.lognormal(0, 1, (600, 1))
    rows = [(i, [float(np.float32(y)) for y in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    have, want = got(P.nearest_query(df)), brute(rows, [r for r in rows if r[0] % 20 == 0], 20)
    assert set(have) == set(want)
    assert np.mean([len({i for i, _ in have[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9


def test_query_recall_against_brute_force(spark):
    from fraudlens.llm.queries import QUERIES
    sf = "/root/testdata/sf0.1"
    t = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    x, ids = np.stack(t["embedding"]).astype(np.float64), t["vec_id"].to_numpy()
    have = got(QUERIES["op9_prefix_forest"](spark, sf))
    hits = []
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        near = ids[np.lexsort((ids, -s))[:20]]
        mine = have[ids[q]]
        assert len(mine) == 20 and all(abs(score - s[np.flatnonzero(ids == i)[0]]) < 1e-12 for i, score in mine)
        assert mine == sorted(mine, key=lambda m: (-m[1], m[0]))
        hits.append(len(set(near) & {i for i, _ in mine}) / 20)
    assert len(hits) == len(have) and np.mean(hits) >= 0.9


def test_recall_beside_many_copies_and_with_varied_norms(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((4096, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[:4096 // 3] = x[0]
    asked = np.flatnonzero((x @ x[0] > 0.2) & (x @ x[0] < 0.3))[:100]
    varied = x * rng.uniform(0.5, 2, (4096, 1))
    varied[:4096 // 3] = varied[0]
    for y in (x, varied):
        rows = [(i, v.tolist()) for i, v in enumerate(y)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        have = got(P.nearest(df, df.where(F.col("vec_id").isin(asked.tolist()))))
        hits = []
        for q in asked.tolist():
            s = (y * y[q]).sum(axis=1)
            s[q] = -np.inf
            want = np.lexsort((np.arange(4096), -s))[:20].tolist()
            hits.append(len(set(want) & {i for i, _ in have[q]}) / 20)
        assert np.mean(hits) >= 0.9


def test_descent_finds_the_longest_prefix():
    x = np.random.default_rng(0).standard_normal((300, 6))
    f = P.Forest(np.arange(300), x, 4, 3)
    lo, hi = f.ranges(P.hash_strings(np.c_[x, np.zeros(300)], f.planes, 4), 1)
    assert (hi > lo).any(axis=1).all()
    assert f.sorted[0].tolist() == sorted(f.sorted[0].tolist())


def test_large_ids_are_told_apart(spark):
    big = 2 ** 53
    rows = [(big, [1.0, 0.0]), (big + 1, [1.0, 0.0]), (big + 1, [1.0, 0.0]), (20, [0.5, 0.5]), (-2 ** 62, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert [i for i, _ in got(P.nearest(df, df.where("vec_id = 20")))[20]] == [-2 ** 62, big, big + 1]
    assert got(P.nearest(df, df)) == brute(rows, rows, 20)
