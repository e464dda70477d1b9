"""Second-order boosted trees on histograms (M1).

Features are cut into at most ``max_bins`` bins once (approximate quantiles,
one aggregate for all slots) and written as one byte a slot. A level of a tree
is one job: each task sums gradient and hessian of its rows per (node, slot,
bin) with numpy, Spark adds the histograms up in a tree, and the driver, which
holds ``2**depth x slots x bins`` numbers whatever the rows, takes each node's
best split. The sums of the children follow from the split, so a tree of depth
``d`` costs ``d`` jobs. A row's margin is stored and brought up to date every
``REFRESH`` trees; in between, the few trees since are evaluated again.

Gain of a split: ``1/2 (GL^2/(HL + l) + GR^2/(HR + l) - G^2/(H + l)) - gamma``;
both children need a hessian of ``min_child_weight``. Rows are drawn by a hash
of id and tree, columns per tree. Null features are taken as 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraudlens.operators.sums import summed
from fraudlens.session import write_table

REFRESH, FAN_IN, SLICE_ROWS = 10, 16, 1 << 20

#: A tree: per node slot (-1: leaf), bin (left if the row's bin is not larger) and value; children of i are 2i + 1 and 2i + 2.
Tree = tuple[np.ndarray, np.ndarray, np.ndarray]


def leaf_of(tree: Tree, bins: np.ndarray) -> np.ndarray:
    """The leaf each row falls into."""
    slot, cut, _ = tree
    at = np.zeros(len(bins), dtype=np.int64)
    rows = np.arange(len(bins))
    while True:
        s = slot[at]
        inner = s >= 0
        if not inner.any():
            return at
        right = bins[rows, np.maximum(s, 0)] > cut[at]
        at = np.where(inner, 2 * at + 1 + right, at)


def values_of(trees: list[Tree], bins: np.ndarray) -> np.ndarray:
    out = np.zeros(len(bins))
    for t in trees:
        out += t[2][leaf_of(t, bins)]
    return out


def best_splits(hist: np.ndarray, columns: np.ndarray, lam: float, gamma: float, child: float) -> list[tuple | None]:
    """Per node (gain, slot, bin, GL, HL, GR, HR) of its best split, or None.
    ``hist`` is (node, slot, bin, gradient and hessian)."""
    left = np.cumsum(hist, axis=2)[:, :, :-1]
    total = hist.sum(axis=2)[:, :, None]
    gl, hl = left[..., 0], left[..., 1]
    gr, hr = total[..., 0] - gl, total[..., 1] - hl
    g, h = total[..., 0], total[..., 1]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = 0.5 * (gl * gl / (hl + lam) + gr * gr / (hr + lam) - g * g / (h + lam)) - gamma
    gain = np.where((hl >= child) & (hr >= child) & np.isfinite(gain), gain, -np.inf)
    gain[:, ~columns] = -np.inf
    out: list[tuple | None] = []
    for n in range(len(hist)):
        s, b = np.unravel_index(int(gain[n].argmax()), gain[n].shape) if gain[n].size else (0, 0)
        some = gain[n].size and gain[n, s, b] > 1e-12
        out.append((gain[n, s, b], int(s), int(b), gl[n, s, b], hl[n, s, b], gr[n, s, b], hr[n, s, b]) if some else None)
    return out


def _arrays(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    codes = np.frombuffer(b"".join(b.column(3).to_pylist()), dtype=np.uint8).reshape(b.num_rows, -1)
    return b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(), codes, b.column(4).to_numpy()


class Rows:
    """The binned training rows with their margins."""

    def __init__(self, train: DataFrame, id_col: str, features: str, label: str, pos_weight: float, max_bins: int):
        v = write_table(train.where(F.col(label).isNotNull()).select(
            F.xxhash64(id_col).alias("h"), F.col(features).alias("x"), F.col(label).cast("double").alias("y")), "boost-rows")
        n = v.count()
        self.width = v.agg(F.max(F.size("x"))).first()[0] or 0
        at = F.array(*[F.lit(i / max_bins) for i in range(1, max_bins)])
        cuts = v.agg(*[F.percentile_approx(F.coalesce(F.col("x")[i], F.lit(0.0)), at, 10_000) for i in range(self.width)]).first()
        self.bounds = [np.unique(np.array(c, dtype=float)) for c in cuts] if n else []
        self.max_bins, bounds = max_bins, self.bounds

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x = np.array([[0.0 if z is None else z for z in row] for row in b.column(1).to_pylist()], dtype=float)
                    codes = bins_of(bounds, x)
                    y = b.column(2).to_numpy()
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(np.where(y == 1, pos_weight, 1.0)),
                                                      pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(np.zeros(len(y)))], names=["h", "y", "w", "bins", "m"])

        self.tasks = max(1, -(-n // SLICE_ROWS))
        dealt = v.repartition(self.tasks, "h") if n else v
        self.table = write_table(dealt.mapInArrow(cut, "h long, y double, w double, bins binary, m double"), "boost-bins")
        self.stale: list[Tree] = []

    def histograms(self, tree: Tree, nodes: list[int], keep: int, salt: int) -> np.ndarray:
        """(node, slot, bin, 2) sums of the rows of this tree's draw: those
        whose hash with ``salt`` is below ``keep`` of 2**32."""
        width, bins, stale = self.width, self.max_bins, self.stale
        place = np.full(len(tree[0]), -1)
        place[nodes] = np.arange(len(nodes))
        shape = (len(nodes), width, bins, 2)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape)
            for b in batches:
                if not b.num_rows:
                    continue
                h, y, w, codes, m = _arrays(b)
                mixed = (h.astype(np.uint64) ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
                node = place[leaf_of(tree, codes)]
                use = ((mixed >> np.uint64(32)).astype(np.int64) < keep) & (node >= 0)
                y, w, codes, m, node = y[use], w[use], codes[use], m[use], node[use]
                p = 0.5 * (1.0 + np.tanh(0.5 * (m + values_of(stale, codes))))
                g, hs = w * (p - y), w * p * (1.0 - p)
                for s in range(width):
                    at = node * bins + codes[:, s]
                    total[:, s, :, 0] += np.bincount(at, g, len(nodes) * bins).reshape(len(nodes), bins)
                    total[:, s, :, 1] += np.bincount(at, hs, len(nodes) * bins).reshape(len(nodes), bins)
            yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([total.tobytes()], pa.binary())], names=["part", "v"])

        parts = self.table.mapInArrow(run, "part long, v binary").withColumn("part", F.spark_partition_id().cast("long"))
        return np.reshape(summed(parts, self.tasks, FAN_IN), shape)

    def grown(self, tree: Tree) -> None:
        """Count ``tree`` into the margins."""
        self.stale.append(tree)
        if len(self.stale) < REFRESH:
            return
        stale = self.stale

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    _, _, _, codes, m = _arrays(b)
                    m = m + values_of(stale, codes)
                    yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(m)], names=b.schema.names)

        self.table = write_table(self.table.mapInArrow(run, self.table.schema), "boost-margins")
        self.stale = []


def bins_of(bounds: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    """Bin numbers: how many bounds a value exceeds."""
    return np.stack([np.searchsorted(c, x[:, i], side="left") for i, c in enumerate(bounds)], axis=1).astype(np.uint8)


def grow(rows: Rows, max_depth: int, rate: float, columns: np.ndarray, lam: float, gamma: float, child: float, keep: int, salt: int) -> Tree:
    """One tree, level by level."""
    size = 2 ** (max_depth + 1) - 1
    slot, cut, value = np.full(size, -1), np.zeros(size, dtype=np.int64), np.zeros(size)
    nodes = [0]
    for depth in range(max_depth):
        found = best_splits(rows.histograms((slot, cut, value), nodes, keep, salt), columns, lam, gamma, child)
        after = []
        for n, split in zip(nodes, found):
            if split is not None:
                _, slot[n], cut[n], gl, hl, gr, hr = split
                for c, g, h in ((2 * n + 1, gl, hl), (2 * n + 2, gr, hr)):
                    value[c] = -rate * g / (h + lam)
                    after.append(c)
        if not after:
            break
        nodes = after
    return slot, cut, value


def train(rows: Rows, n_estimators: int, max_depth: int, rate: float, subsample: float, colsample: float, child: float, gamma: float,
          lam: float, seed: int) -> list[Tree]:
    """All trees. A tree without a split ends the training early only where
    neither rows nor columns are drawn, as the next would be the same."""
    rng, trees = np.random.default_rng(seed), []
    for _ in range(n_estimators):
        columns = np.zeros(rows.width, dtype=bool)
        columns[rng.choice(rows.width, max(1, round(colsample * rows.width)), replace=False)] = True
        tree = grow(rows, max_depth, rate, columns, lam, gamma, child, int(subsample * 2 ** 32), int(rng.integers(1 << 62)))
        if tree[0][0] < 0 and subsample >= 1.0 and colsample >= 1.0:
            break
        trees.append(tree)
        rows.grown(tree)
    return trees
