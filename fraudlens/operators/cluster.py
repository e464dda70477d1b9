"""Spectral clustering of fused graphs, k = 2.

Only the second eigenvector of ``S = D^-1/2 W D^-1/2`` is needed: the first
is known (``u1 = sqrt(d)``, normalised). One run serves many weight sets: an
edge has a weight per view, a vertex an array with one vector per weight set
(trial), so a step is one join and one ``groupBy`` for all of them.

* A cycle makes ``width`` basis vectors ``T_j((S - c) / e) q`` from the current
  vector's residual ``q``: Chebyshev polynomials on the interval of the Ritz
  values seen so far, which keep the basis well conditioned without a single
  inner product in between. A step is one job that writes the vertex table,
  so losing executors costs one step and plans stay short.
* One Gram matrix per trial ends the cycle (numpy per batch, summed by
  Spark). Rayleigh-Ritz on it gives the best vector of the span and its
  residual; ``u1`` is a column of the Gram matrix and projected out there.
* The next cycle starts from that vector and its residual, until the residual
  of every trial meets the tolerance. Trials that do are left as they are.
* Only the Gram matrices ((width + 3)^2 numbers a trial) and a 2 x 2 SVD are
  worked on by the driver.

Labels: ``cluster_qr`` (column-pivoted QR pivots = two ``max_by``
aggregates, polar factor on the driver, argmax per row) or two means on the
spectral embedding divided by ``sqrt(d)``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraudlens.session import write_table

#: Steps of the first cycle, which finds the interval.
FIRST_WIDTH = 6


def _unit_hash(id_col: str) -> F.Column:
    """Deterministic start value in [-0.5, 0.5) from md5 of the id."""
    h = F.conv(F.substring(F.md5(F.col(id_col).cast("string")), 1, 12), 16, 10).cast("double")
    return h / F.lit(float(16 ** 12)) - 0.5


def _num(x: float) -> str:
    """A double as SQL text, exactly."""
    return f"{float(x)!r}D" if np.isfinite(x) else f"double('{x}')"


def _basis(batch: pa.RecordBatch, scale: np.ndarray) -> np.ndarray:
    """(rows, basis vectors and u1 last, trials) of a batch of the vertex table."""
    n, trials = batch.num_rows, len(scale)
    sd = batch.column(batch.schema.get_field_index("sd")).flatten().to_numpy().reshape(n, trials)
    k = batch.column(batch.schema.get_field_index("K")).flatten().flatten().to_numpy().reshape(n, -1, trials)
    return np.concatenate([k, (sd * scale)[:, None, :]], axis=1)


def _gram(X: DataFrame, scale: np.ndarray) -> np.ndarray:
    """Gram matrix of each trial's basis and u1."""
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                f = _basis(b, scale)
                g = np.einsum("nit,njt->tij", f, f)
                total = g if total is None else total + g
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([g.ravel() for g in total])], names=["t", "g"])

    rows = (X.select("sd", "K").mapInArrow(part, "t int, g array<double>").select("t", F.posexplode("g").alias("i", "x"))
            .groupBy("t", "i").agg(F.sum("x").alias("x")).collect())
    size = round((len(rows) / len(scale)) ** 0.5)
    out = np.zeros((len(scale), size * size))
    for r in rows:
        out[r["t"], r["i"]] = r["x"]
    return out.reshape(len(scale), size, size)


def _ritz(G: np.ndarray, start: int, c: float, e: float, theta: float, rho: float):
    """Best vector of the span, from the Gram matrix of ``[x,] q, ..., u1``
    (``start`` 1 with x, else 0): coefficients of it and of its residual over
    all columns, the Ritz values and the residual norm."""
    full = G.shape[0] - 1
    g, G = G[:-1, -1], G[:-1, :-1]
    G = G - np.outer(g, g)  # without the part along u1
    m = full - 1
    M = np.zeros((full, m))  # S K[:, j] = K M[:, j]
    if start:
        M[0, 0], M[1, 0] = theta, rho
    M[start, start], M[start + 1, start] = c, e
    for j in range(start + 1, m):
        M[j - 1, j], M[j, j], M[j + 1, j] = e / 2, c, e / 2
    A, B = G[:m] @ M, G[:m, :m]
    w, U = np.linalg.eigh(B)
    keep = w > 1e-13 * w[-1]
    white = U[:, keep] / np.sqrt(w[keep])
    values, Z = np.linalg.eigh(white.T @ ((A + A.T) / 2) @ white)
    x = np.r_[white @ Z[:, -1], 0.0]
    r = M @ x[:m] - values[-1] * x
    norm = float(np.sqrt(max(r @ G @ r, 0.0)))
    return np.r_[x, -(g @ x)], np.r_[r, -(g @ r)], values, norm


def _combine(X: DataFrame, coefficients: np.ndarray, scale: np.ndarray) -> DataFrame:
    """The vertex table with new basis vectors: ``coefficients`` (trial, old column, new one)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = np.einsum("nit,tij->njt", _basis(b, scale), coefficients)
            n, k, trials = new.shape
            inner = pa.ListArray.from_arrays(pa.array(np.arange(n * k + 1, dtype=np.int32) * trials), pa.array(new.ravel()))
            outer = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), inner)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), outer], names=["id", "sd", "K"])

    return write_table(X.select("id", "sd", "K").mapInArrow(run, X.select("id", "sd", "K").schema), "basis")


def second_eigenvectors(edges: DataFrame, weights: list[list[float]], width: int = 16, tol: float = 1e-6,
                        max_restarts: int | None = 100) -> tuple[DataFrame, list[float], list[float], int]:
    """Second-largest eigenpairs of S for several weightings of one graph.

    ``edges`` is symmetric, ``(src, dst, w array<double>)`` with a weight per
    view; trial ``t`` weighs view ``v`` by ``weights[t][v]``. Returns
    ``(vertices(id, sd, u1, v2), eigenvalues, residuals, steps)`` with arrays
    over the trials; ``v2`` has unit norm and is orthogonal to ``u1``. Cycles
    end when every residual is below ``tol``, or after ``max_restarts``: the
    caller sees from the residuals which trials have converged."""
    P = np.array(weights, dtype=float)
    trials, views = P.shape
    each = range(trials)
    edges = write_table(edges.select("src", "dst", "w"), "graph")
    # (as SQL text: expressions over many trials are long, and text reaches the JVM in one call)
    mixed = lambda t, w: "(" + " + ".join(f"{_num(P[t, v])} * {w(v)}" for v in range(views)) + ")"
    fused = [mixed(t, lambda v: f"w[{v}]") for t in each]
    deg = edges.groupBy(F.col("src").alias("id")).agg(*[F.sum(F.col("w")[v]).alias(f"d{v}") for v in range(views)])
    verts = write_table(deg.select("id", F.expr("array(" + ", ".join(f"sqrt{mixed(t, lambda v: f'd{v}')}" for t in each) + ")").alias("sd"), _unit_hash("id").alias("x")), "vertices")
    sd = lambda t: F.col("sd")[t]
    sums = verts.agg(F.count(F.lit(1)), *[F.sum(sd(t) * sd(t)) for t in each], *[F.sum(sd(t) * F.col("x")) for t in each]).first()
    n, tot, along = sums[0], np.array(sums[1:trials + 1], dtype=float), np.array(sums[trials + 1:], dtype=float)
    scale = 1.0 / np.sqrt(tot)
    X = write_table(verts.select("id", "sd", F.array(F.array(*[F.col("x") - sd(t) * F.lit(float(along[t] / tot[t])) for t in each])).alias("K")), "basis")

    def step(X: DataFrame, c: np.ndarray, e: np.ndarray, first: bool) -> DataFrame:
        z = X.select(F.col("id").alias("dst"), F.expr("zip_with(element_at(K, -1), sd, (x, d) -> try_divide(x, d))").alias("z"))
        sums = [F.expr(f"sum({fused[t]} * z[{t}])").alias(f"y{t}") for t in each]
        y = edges.join(z, "dst").groupBy(F.col("src").alias("id")).agg(*sums)
        moved = [f"(coalesce(try_divide(y{t}, sd[{t}]), 0D) - {_num(c[t])} * k1[{t}]) / {_num(e[t])}" for t in each]
        new = moved if first else [f"2D * {m} - back[{t}]" for t, m in zip(each, moved)]
        now = X.selectExpr("id", "sd", "K", "element_at(K, -1) AS k1", *([] if first else ["element_at(K, -2) AS back"])).join(y, "id", "left")
        return write_table(now.selectExpr("id", "sd", f"concat(K, array(array({', '.join(new)}))) AS K"), "step")

    low, high = np.full(trials, -1.0), np.full(trials, 1.0)
    theta, rho, residual = np.zeros(trials), np.zeros(trials), np.full(trials, np.inf)
    steps = restarts = start = 0
    while True:
        c, e = (low + high) / 2, np.maximum((high - low) / 2, 1e-3)
        s = max(1, min(width if start else min(width, FIRST_WIDTH), n - 1))
        for j in range(s):
            X = step(X, c, e, j == 0)
        steps += s
        G = _gram(X, scale)
        new = np.zeros((trials, G.shape[1], 2))
        for t in each:
            if residual[t] < tol:  # kept as it is
                new[t, 0, 0] = new[t, 1, 1] = 1.0
                continue
            x, r, values, norm = _ritz(G[t], start, c[t], e[t], theta[t], rho[t])
            if not start:
                low[t], high[t] = values[0], values[-1]
            low[t], high[t] = min(low[t], values[0]), max(high[t], values[-1])
            pad = 0.05 * (values[-1] - values[0])
            low[t], high[t] = max(-1.0, min(low[t], values[0] - pad)), min(1.0, max(high[t], values[-1] + pad))
            theta[t], rho[t], residual[t] = values[-1], norm, norm
            new[t, :, 0], new[t, :, 1] = x, r / norm if norm > 0 else x
        X = _combine(X, new, scale)
        start = 1
        # n - 1 steps span all that is orthogonal to u1
        if (residual < tol).all() or s >= n - 1:
            residual = np.where(s >= n - 1, 0.0, residual)
            break
        if max_restarts is not None and restarts >= max_restarts:
            break
        restarts += 1
    v = lambda t: F.col("K")[0][t]
    # deterministic sign: the entry of largest magnitude is positive
    signs = X.agg(*[F.max_by(v(t), F.struct(F.abs(v(t)), F.col("id"))) for t in each]).first()
    out = X.select("id", "sd", F.array(*[sd(t) * F.lit(float(scale[t])) for t in each]).alias("u1"),
                   F.array(*[v(t) * F.lit(-1.0 if (signs[t] or 0.0) < 0 else 1.0) for t in each]).alias("v2"))
    return write_table(out, "eigenvectors"), theta.tolist(), residual.tolist(), steps


def second_eigenvector(edges: DataFrame, width: int = 16, tol: float = 1e-6, max_restarts: int | None = 100) -> tuple[DataFrame, float, int]:
    """The same for one graph ``(src, dst, weight)``: ``(vertices(id, sd, u1,
    v2), eigenvalue, steps)``. Raises if ``max_restarts`` restarts do not reach
    ``tol``: an unconverged vector is never returned."""
    out, theta, residual, steps = second_eigenvectors(edges.select("src", "dst", F.array(F.col("weight").cast("double")).alias("w")), [[1.0]], width, tol, max_restarts)
    if residual[0] >= tol:
        raise RuntimeError(f"the eigenvector did not converge: residual {residual[0]:.3g} after {steps} steps (tol {tol:g})")
    return out.select("id", *[F.col(c)[0].alias(c) for c in ("sd", "u1", "v2")]), theta[0], steps


def spectral_embedding(edges: DataFrame, **kw) -> DataFrame:
    """``(id, e0, e1)``: the two leading eigenvectors divided by sqrt(d)."""
    verts, _, _ = second_eigenvector(edges, **kw)
    return verts.select("id", (F.col("u1") / F.col("sd")).alias("e0"), (F.col("v2") / F.col("sd")).alias("e1"))


def cluster_qr(emb: DataFrame) -> DataFrame:
    """G4 label assignment: QR-with-pivoting pivots (largest row norm, then
    largest residual), polar factor of the 2 x 2 pivot block, argmax."""
    p1 = emb.agg(F.max_by(F.struct("e0", "e1"), F.struct(F.col("e0") ** 2 + F.col("e1") ** 2, -F.col("id")))
                 .alias("p")).first()["p"]
    r1 = np.array([p1["e0"], p1["e1"]], dtype=float)
    u = r1 / np.linalg.norm(r1)
    proj = F.col("e0") * F.lit(float(u[0])) + F.col("e1") * F.lit(float(u[1]))
    res2 = (F.col("e0") - proj * F.lit(float(u[0]))) ** 2 + (F.col("e1") - proj * F.lit(float(u[1]))) ** 2
    p2 = emb.agg(F.max_by(F.struct("e0", "e1"), F.struct(res2, -F.col("id"))).alias("p")).first()["p"]
    block = np.array([[p1["e0"], p2["e0"]], [p1["e1"], p2["e1"]]], dtype=float)  # vectors[piv].T
    ut, _, vt = np.linalg.svd(block)
    R = ut @ vt
    s0 = F.abs(F.col("e0") * F.lit(float(R[0, 0])) + F.col("e1") * F.lit(float(R[1, 0])))
    s1 = F.abs(F.col("e0") * F.lit(float(R[0, 1])) + F.col("e1") * F.lit(float(R[1, 1])))
    return emb.select("id", F.when(s1 > s0, 1).otherwise(0).alias("cluster"))


def two_means(emb: DataFrame, trials: int, max_rounds: int = 1000) -> tuple[DataFrame, int]:
    """k-means with k = 2 for several embeddings at once: ``(id, e0
    array<double>, e1 array<double>)`` to ``(id, cluster array<int>)`` and the
    rounds used. One aggregate row a round for all trials.

    Starts from the rows above and below the mean of ``e1`` (``e0`` is the same
    for all vertices) and ends when no centre moves any more; raises if
    ``max_rounds`` are not enough. Cluster 1 is the one with the larger ``e1``."""
    each = range(trials)
    mean = emb.agg(*[F.avg(F.col("e1")[t]) for t in each]).first()
    upper = [f"e1[{t}] > {_num(m or 0.0)}" for t, m in zip(each, mean)]
    centres, rounds = None, 0
    while True:
        sides = emb.selectExpr("e0", "e1", *[f"{u} AS u{t}" for t, u in zip(each, upper)])
        row = sides.agg(*[F.expr(f"avg(CASE WHEN {side} u{t} THEN e{i}[{t}] END)") for t in each for side in ("NOT", "") for i in (0, 1)]).first()
        now = np.array([np.nan if x is None else x for x in row], dtype=float).reshape(trials, 2, 2)
        if centres is not None and np.allclose(now, centres, rtol=1e-12, atol=0.0, equal_nan=True):
            break
        if rounds >= max_rounds:
            raise RuntimeError(f"k-means has not settled after {rounds} rounds")
        centres, rounds = now, rounds + 1
        far = lambda t, side: " + ".join(f"(e{i}[{t}] - {_num(now[t, side, i])}) * (e{i}[{t}] - {_num(now[t, side, i])})" for i in (0, 1))
        # an empty side: all rows are alike
        upper = ["false" if np.isnan(now[t]).any() else f"{far(t, 1)} < {far(t, 0)}" for t in each]
    return emb.select("id", F.expr("array(" + ", ".join(f"int({u})" for u in upper) + ")").alias("cluster")), rounds


def cluster_kmeans(emb: DataFrame) -> DataFrame:
    """G5 label assignment: k-means (k = 2) on the embedding rows."""
    labels, _ = two_means(emb.select("id", F.array("e0").alias("e0"), F.array("e1").alias("e1")), 1)
    return labels.select("id", F.col("cluster")[0].alias("cluster"))


def assigned(emb: DataFrame, assign_labels: str = "cluster_qr") -> DataFrame:
    """``(id, cluster)`` of a spectral embedding by one of the label rules."""
    return cluster_qr(emb) if assign_labels == "cluster_qr" else cluster_kmeans(emb)


def spectral_clustering(sym_edges: DataFrame, assign_labels: str = "cluster_qr", **kw) -> DataFrame:
    """``(id, cluster)`` for a symmetric weighted edge table."""
    return assigned(spectral_embedding(sym_edges, **kw), assign_labels)


def spectral_trials(edges: DataFrame, weights: list[list[float]], tol: float = 1e-6, **kw) -> tuple[DataFrame, list[float], int]:
    """Spectral k-means of one graph under many view weights, in one run.
    Returns ``(id, trial, cluster)``, the residual of each trial and the steps."""
    verts, _, residual, steps = second_eigenvectors(edges, weights, tol=tol, **kw)
    emb = verts.select("id", *[F.zip_with(a, "sd", lambda x, d: F.try_divide(x, d)).alias(b) for a, b in (("u1", "e0"), ("v2", "e1"))])
    labels, _ = two_means(emb, len(weights))
    return labels.select("id", F.posexplode("cluster").alias("trial", "cluster")), residual, steps
