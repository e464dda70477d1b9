"""kNN graphs and their fusion.

Graphs are edge tables ``(src, dst, weight)``; vertices are ids, never
positions.

Exact kNN (G1) goes by pivot cells. Every vector belongs to its nearest
pivot, and the rows of a cell are cut into blocks by their distance to it
(rings). Neighbouring blocks make up query groups, at most ``GROUPS`` of them
until a group would exceed ``GROUP_BYTES``; every row is sent once to every group,
so the shuffle is a fixed multiple of the table. A task holds one group and
the ``k`` best of its rows, and all rows stream past it ring by ring, the
group's own first. The k-th distance so far bounds what a row still has to look
for; by the triangle inequality a ring ``[low, high]`` around pivot ``p`` holds
nothing nearer than ``d(q, p) - high`` or ``low - d(q, p)``, and nothing nearer
than the plane between ``p`` and the own pivot, and is not compared with rows
that look nearer. Ties break by the smaller destination id. Clustered data skip
most comparisons; isotropic data in many dimensions skip few, and then the
comparisons (not the shuffle) grow with the square of the rows, as they must
for an exact answer.

Approximate kNN (G1b) is neighbour descent (neighbours of neighbours are
likely neighbours), whose work per vertex and round is bounded, or LSH, whose
work grows with the buckets.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fraudlens.operators.ordering import ordered_rank
from fraudlens.session import write_table

EDGE_SCHEMA = "src long, dst long, d2 double"


def _block_topk(qids: np.ndarray, Q: np.ndarray, cids: np.ndarray, C: np.ndarray, k: int):
    """Best ``k`` candidates per query row by exact squared distance."""
    nq, nc = len(qids), len(cids)
    if nq == 0 or nc == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    qn = np.einsum("ij,ij->i", Q, Q)
    cn = np.einsum("ij,ij->i", C, C)
    approx = qn[:, None] + cn[None, :] - 2.0 * (Q @ C.T)
    approx[qids[:, None] == cids[None, :]] = np.inf  # no self loops
    kk = min(k, nc)
    kth = np.partition(approx, kk - 1, axis=1)[:, kk - 1]
    # keep every candidate that could be in the exact top k: the expansion's
    # rounding error is far below this tolerance
    tol = 1e-9 * (qn + cn.max() + 1.0)
    rows, cols = np.nonzero(approx <= (kth + tol)[:, None])
    keep = np.isfinite(approx[rows, cols])
    rows, cols = rows[keep], cols[keep]
    diff = Q[rows] - C[cols]
    exact = np.einsum("ij,ij->i", diff, diff)
    order = np.lexsort((cids[cols], exact, rows))
    rows, cols, exact = rows[order], cols[order], exact[order]
    # position within each row after sorting -> first k
    starts = np.r_[0, np.flatnonzero(np.diff(rows)) + 1]
    pos = np.arange(len(rows)) - np.repeat(starts, np.diff(np.r_[starts, len(rows)]))
    sel = pos < k
    return qids[rows[sel]], cids[cols[sel]], exact[sel]


def _topk(qids, Q, cids, C, k: int, bound: np.ndarray | None = None, rows: int = 1024):
    """``_block_topk`` for a bounded number of query rows at a time; with
    ``bound``, only what is not farther than each row's bound."""
    parts = [_block_topk(qids[a:a + rows], Q[a:a + rows], cids, C, k) for a in range(0, len(qids), rows)]
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    s, d, e = (np.concatenate(x) for x in zip(*parts))
    if bound is not None:
        order = np.argsort(qids, kind="stable")
        keep = e <= bound[order][np.searchsorted(qids[order], s)]
        s, d, e = s[keep], d[keep], e[keep]
    return s, d, e


def _stack(series: pd.Series) -> np.ndarray:
    if len(series) == 0:
        return np.empty((0, 0))
    return np.vstack([np.asarray(v, dtype=np.float64) for v in series.to_numpy()])


#: Pivots and blocks at most (both are known to every task).
MAX_PIVOTS, MAX_BLOCKS = 4096, 65536


def pivot_blocks(v: DataFrame, n: int, rows_per_block: int = 2048) -> tuple[DataFrame, np.ndarray, pd.DataFrame]:
    """``(id, vec, cell, r, blk)`` of vectors ``(id, vec)``, the pivots, and
    the blocks ``(blk, cell, low, high, rows)``. A row's cell is its nearest pivot,
    ``r`` the distance to it, and a block a ring of a cell with at most
    ``rows_per_block`` rows (more beyond ``MAX_BLOCKS`` blocks). Pivots are the
    rows that come first by a hash of the id."""
    rows_per_block = max(rows_per_block, math.ceil(n / MAX_BLOCKS))
    top = v.orderBy(F.xxhash64("id"), "id").limit(min(MAX_PIVOTS, math.ceil(n / rows_per_block)))
    pivots = np.unique(np.array([r["vec"] for r in top.collect()], dtype=np.float64), axis=0)

    def nearest(batches):
        for b in batches:
            if len(b):
                d = np.sqrt(_square_distances(_stack(b["vec"]), pivots))
                cell = d.argmin(axis=1)
                yield b.assign(cell=cell.astype(np.int32), r=d[np.arange(len(d)), cell])

    celled = v.mapInPandas(nearest, f"id long, vec {v.schema['vec'].dataType.simpleString()}, cell int, r double")
    ranked = ordered_rank(celled, ["cell"], ["r", "id"], "_rank")
    placed = write_table(ranked.withColumn("ring", F.floor((F.col("_rank") - 1) / rows_per_block)).drop("_rank"), "pivot-cells")
    rings = placed.groupBy("cell", "ring").agg(F.min("r").alias("low"), F.max("r").alias("high"), F.count(F.lit(1)).alias("rows")).orderBy("cell", "ring").toPandas()
    rings.insert(0, "blk", np.arange(len(rings), dtype=np.int64))
    names = placed.sparkSession.createDataFrame(rings[["blk", "cell", "ring"]].astype({"cell": "int32"}))
    return placed.join(F.broadcast(names), ["cell", "ring"]).select("id", "vec", "cell", "r", "blk"), pivots, rings


def _square_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)[None, :] - 2.0 * (a @ b.T)
    return np.maximum(d, 0.0)


def visits(blocked: DataFrame, pivots: np.ndarray, rings: pd.DataFrame) -> DataFrame:
    """``(id, vec, blk, bound, visits)`` of rows with ``bound`` (square of the
    distance within which they look): the other blocks that may hold a row
    that near, by the triangle inequality."""
    cells = rings["cell"].to_numpy(np.int64)
    low, high, names = (rings[c].to_numpy() for c in ("low", "high", "blk"))
    apart = np.sqrt(_square_distances(pivots, pivots))

    def run(batches):
        for whole in batches:
            for a in range(0, len(whole), 256):  # 256 x blocks distances at a time
                b = whole.iloc[a:a + 256]
                q, own = _stack(b["vec"]), b["cell"].to_numpy(np.int64)
                d2 = _square_distances(q, pivots)
                d = np.sqrt(d2)
                with np.errstate(divide="ignore", invalid="ignore"):
                    plane = (d2 - d2[np.arange(len(q)), own][:, None]) / (2.0 * apart[own])
                plane = np.where(np.isfinite(plane), plane, 0.0)
                least = np.maximum(np.maximum(d[:, cells] - high, low - d[:, cells]), plane[:, cells])
                # rounding errors of the expansion stay far below this slack
                slack = 1e-6 * (1.0 + d.max(axis=1))
                may = least <= (np.sqrt(b["bound"].to_numpy(np.float64)) + slack)[:, None]
                may &= names[None, :] != b["blk"].to_numpy(np.int64)[:, None]
                yield pd.DataFrame({"id": b["id"], "vec": b["vec"], "blk": b["blk"], "bound": b["bound"], "visits": [names[m] for m in may]})

    return blocked.mapInPandas(run, "id long, vec array<double>, blk long, bound double, visits array<long>")


#: Query groups of a table, until one would hold more than so many bytes
#: (vectors and k best).
GROUPS, GROUP_BYTES = 24, 96 << 20


class _Group:
    """The ``k`` best of one group's rows while candidates stream past."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, cell: np.ndarray, r: np.ndarray, pivots: np.ndarray | None, k: int, rows: int = 1024):
        self.ids, self.x, self.cell, self.r, self.pivots, self.k, self.rows = ids, x, cell, r, pivots, k, rows
        self.norm = np.einsum("ij,ij->i", x, x)
        self.most = float(np.abs(x).max(initial=0.0, where=np.isfinite(x)))
        self.x32 = x.astype(np.float32) if self.most <= 1e15 else None
        self.d2 = np.full((len(ids), k), np.inf)
        self.dst = np.full((len(ids), k), -1, dtype=np.int64)
        self.bound = np.full(len(ids), np.inf)
        self.waiting = [[] for _ in range(0, len(ids), rows)]
        self.n_waiting = [0] * len(self.waiting)

    def meet(self, cids: np.ndarray, c: np.ndarray, cell: int, low: float, high: float) -> None:
        """Compare with candidates of one ring."""
        fits = np.isfinite(c).all(axis=1)
        if not fits.all():
            cids, c = cids[fits], c[fits]
        if not len(cids):
            return
        cn = np.einsum("ij,ij->i", c, c)
        # rounding errors of the expansion stay far below the slack
        if self.x32 is not None and np.abs(c).max() <= 1e15:
            q, c32, part = self.x32, c.astype(np.float32), (c.shape[1] + 16) * 1.2e-7
        else:
            q, c32, part = self.x, c, 1e-9
        cn32 = cn.astype(c32.dtype)
        for i, a in enumerate(range(0, len(self.ids), self.rows)):
            at = np.arange(a, min(a + self.rows, len(self.ids)))
            if self.pivots is not None:
                at = at[self._may(at, cell, low, high)]
                if not len(at):
                    continue
            d = q[at] @ c32.T
            d *= -2.0
            d += self.norm[at].astype(d.dtype)[:, None]
            d += cn32
            slack = part * (self.norm[at] + cn.max()) + 1e-37
            bound = self.bound[at]
            if not np.isfinite(bound).all():
                d[self.ids[at][:, None] == cids[None, :]] = np.inf
                kk = min(self.k, len(cids))
                bound = np.minimum(bound, np.partition(d, kk - 1, axis=1)[:, kk - 1] + slack) if kk == self.k else bound
            n, cols = np.nonzero(d <= ((bound + slack) * (1.0 + 2e-7)).astype(d.dtype)[:, None])
            keep = self.ids[at][n] != cids[cols]
            n, cols = at[n[keep]], cols[keep]
            for b in range(0, len(n), 1 << 16):
                diff = self.x[n[b:b + (1 << 16)]] - c[cols[b:b + (1 << 16)]]
                exact = np.einsum("ij,ij->i", diff, diff)
                near = exact <= self.bound[n[b:b + (1 << 16)]]
                if near.any():
                    self.waiting[i].append((n[b:b + (1 << 16)][near], cids[cols[b:b + (1 << 16)]][near], exact[near]))
                    self.n_waiting[i] += int(near.sum())
                    if self.n_waiting[i] > self.rows * self.k // 2:
                        self._merge(i)
            if not np.isfinite(self.bound[at]).all():
                self._merge(i)

    def _may(self, at: np.ndarray, cell: int, low: float, high: float) -> np.ndarray:
        """The rows that a ring may hold something near enough for."""
        p, own = self.pivots[cell], self.cell[at]
        d2 = _square_distances(self.x[at], p[None, :])[:, 0]
        d = np.sqrt(d2)
        apart = np.sqrt(((self.pivots[own] - p) ** 2).sum(axis=1))
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = np.where(apart > 0, (d2 - self.r[at] ** 2) / (2.0 * apart), 0.0)
        slack = 1e-6 * (1.0 + np.sqrt(self.norm[at]) + np.sqrt((p ** 2).sum()))
        least = np.maximum(np.maximum(d - high, low - d), plane)
        return ~(least > np.sqrt(self.bound[at]) + slack)

    def _merge(self, i: int) -> None:
        if not self.waiting[i]:
            return
        a, b = i * self.rows, min((i + 1) * self.rows, len(self.ids))
        n, j, e = (np.concatenate(x) for x in zip(*self.waiting[i]))
        r, c = np.nonzero(np.isfinite(self.d2[a:b]))
        n, j, e = np.r_[r + a, n], np.r_[self.dst[a:b][r, c], j], np.r_[self.d2[a:b][r, c], e]
        order = np.lexsort((j, e, n))
        n, j, e = n[order], j[order], e[order]
        starts = np.r_[0, np.flatnonzero(np.diff(n)) + 1]
        pos = np.arange(len(n)) - np.repeat(starts, np.diff(np.r_[starts, len(n)]))
        best = pos < self.k
        self.d2[n[best], pos[best]], self.dst[n[best], pos[best]] = e[best], j[best]
        self.bound[a:b] = self.d2[a:b, -1]
        self.waiting[i], self.n_waiting[i] = [], 0

    def edges(self):
        for i, a in enumerate(range(0, len(self.ids), self.rows)):
            self._merge(i)
            r, c = np.nonzero(np.isfinite(self.d2[a:a + self.rows]))
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[a + r]), pa.array(self.dst[a + r, c]), pa.array(self.d2[a + r, c])], names=["src", "dst", "d2"])


def _vectors_of(b: pa.RecordBatch) -> np.ndarray:
    flat = b.column("vec").flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(b.num_rows, -1)


def _stream_past(pivots: np.ndarray | None, k: int):
    """Rows sorted by group, the group's own first (``side`` 0, at least one), then by block."""
    def run(batches):
        group, at, own = None, None, []

        def rings(part):
            """Runs of one block."""
            blk = part.column("blk").to_numpy()
            cuts = np.r_[0, np.flatnonzero(np.diff(blk)) + 1, len(blk)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if b > a:
                    one = part.slice(a, b - a)
                    r = one.column("r").to_numpy()
                    yield one.column("id").to_numpy(), _vectors_of(one), int(one.column("cell")[0].as_py()), r.min(), r.max()

        def opened():
            col = lambda c: np.concatenate([b.column(c).to_numpy() for b in own])
            g = _Group(col("id"), np.concatenate([_vectors_of(b) for b in own]), col("cell"), col("r"), pivots, k)
            for b in own:
                for ring in rings(b):
                    g.meet(*ring)
            return g

        for whole in batches:
            if not whole.num_rows:
                continue
            key = whole.column("qa").to_numpy().astype(np.int64) * 2 + whole.column("side").to_numpy()
            cuts = np.r_[0, np.flatnonzero(np.diff(key)) + 1, len(key)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                part, qa, side = whole.slice(a, b - a), int(key[a]) // 2, int(key[a]) % 2
                if qa != at:
                    if at is not None:
                        yield from (group or opened()).edges()
                    group, at, own = None, qa, []
                if side == 0:
                    own.append(part)
                    continue
                if group is None:
                    group, own = opened(), []
                for ring in rings(part):
                    group.meet(*ring)
        if at is not None:
            yield from (group or opened()).edges()

    return run


def knn_graph(df: DataFrame, id_col: str, vec_col: str, k: int = 50, n_blocks: int | None = None,
              rows_per_block: int = 2048) -> DataFrame:
    """G1 (J3, D4): directed exact kNN graph, self excluded, weight 1.

    Output ``(src, dst, weight, rank)`` with ``rank`` 1..k by (distance, dst).
    Rows without an id, or whose vector is null or holds a null, take no part.
    """
    v = _whole_vectors(df, id_col, vec_col)
    if v.schema["vec"].dataType.elementType.typeName() != "float":
        v = v.withColumn("vec", F.col("vec").cast("array<double>"))
    n, width = v.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    if n_blocks is not None:
        rows_per_block = max(1, math.ceil(n / n_blocks))
    if n <= rows_per_block:
        groups, pivots = 1, None
        placed = v.select("id", "vec", F.lit(0).alias("cell"), F.lit(0.0).alias("r"), F.lit(0).cast("long").alias("blk"), F.lit(0).alias("own"))
    else:
        blocked, pivots, rings = pivot_blocks(v, n, rows_per_block)
        groups = max(min(GROUPS, math.ceil(n / rows_per_block)), math.ceil(n * (width * 8 + k * 24) / GROUP_BYTES))
        before = rings["rows"].cumsum() - rings["rows"]
        # a block may be longer than a group's share: groups without a block are not counted
        own, kept = pd.factorize(before * groups // n)
        names, groups = rings[["blk"]].assign(own=own.astype("int32")), len(kept)
        placed = blocked.join(F.broadcast(v.sparkSession.createDataFrame(names)), "blk").select("id", "vec", "cell", "r", "blk", "own")
    sent = placed.withColumn("qa", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select(
        "id", "vec", "cell", "r", "blk", "qa", F.when(F.col("qa") == F.col("own"), 0).otherwise(1).alias("side"))
    dealt = sent.repartitionById(groups, "qa").sortWithinPartitions("qa", "side", "blk")
    found = dealt.mapInArrow(_stream_past(pivots, k), EDGE_SCHEMA)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy("d2", "dst"))).where(F.col("rank") <= k)
    return ranked.select("src", "dst", F.lit(1.0).alias("weight"), F.col("rank").cast("int").alias("rank"))


def _whole_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    return v.where(F.col("id").isNotNull() & F.col("vec").isNotNull() & ~F.exists("vec", lambda x: x.isNull()))


#: Rows of a bucket that one task looks neighbours up for, at least and at most.
LSH_ROWS = (1024, 65536)


def _bucket_topk(asked: DataFrame, rows: DataFrame, n: int, k: int) -> DataFrame:
    """``(src, dst, d2)``: of every bucket ``(slot, bucket)`` of ``asked`` the
    ``k`` nearest of its rows to each. A bucket's askers are cut into groups and all
    its rows stream past each group, so no pair leaves its task unless it is
    among the ``k`` best."""
    size = max(LSH_ROWS[0], min(LSH_ROWS[1], n // 16))
    cuts = asked.groupBy("slot", "bucket").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("cuts"))
    # a bucket is a share of the spread: they are few, however many rows there are
    ask = asked.join(F.broadcast(cuts), ["slot", "bucket"]).withColumn("part", F.pmod(F.xxhash64("id", F.lit(7)), F.col("cuts")).cast("int"))
    look = rows.join(F.broadcast(cuts), ["slot", "bucket"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    one = lambda df, side: df.select("slot", "bucket", "part", F.lit(side).alias("side"), "id", "vec")
    sent = one(ask, 0).unionByName(one(look, 1))
    dealt = sent.repartition(max(8, min(1024, n // 500)), "slot", "bucket", "part").sortWithinPartitions("slot", "bucket", "part", "side")

    def run(batches):
        group, at, own = None, None, []

        def opened():
            ids, x = np.concatenate([b.column("id").to_numpy() for b in own]), np.concatenate([_vectors_of(b) for b in own])
            return _Group(ids, x, np.zeros(len(ids)), np.zeros(len(ids)), None, k)

        for whole in batches:
            keys = list(zip(*(whole.column(c).to_pylist() for c in ("slot", "bucket", "part", "side"))))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if keys[a][:3] != at:
                    if group is not None:
                        yield from group.edges()
                    group, at, own = None, keys[a][:3], []
                if keys[a][3] == 0:
                    own.append(whole.slice(a, b - a))
                    continue
                if group is None:
                    group, own = opened(), []
                some = whole.slice(a, b - a)
                group.meet(some.column("id").to_numpy(), _vectors_of(some), 0, 0.0, 0.0)
        if group is not None:
            yield from group.edges()

    return dealt.mapInArrow(run, EDGE_SCHEMA)


def knn_graph_lsh(df: DataFrame, id_col: str, vec_col: str, k: int = 50, bucket_length: float | None = None,
                  num_hash_tables: int = 3, seed: int = 42) -> DataFrame:
    """Approximate kNN by ``BucketedRandomProjectionLSH``: neighbours
    are looked for among the rows that share a bucket in some hash table and
    ranked by exact distance, like G1. Same schema; recall below 1 is the
    price of less work, but every vertex gets ``min(k, n - 1)`` neighbours:
    vertices that found fewer are searched again, against all rows, with
    buckets twice as long, until none is left. Buckets longer than every
    vector hold all rows, on whichever side of zero they lie. Vectors that are
    not finite take no part.

    ``bucket_length`` starts at half the spread of the data along a random
    direction (root mean variance per slot) unless given. All pairs of a bucket
    are compared, inside tasks (``_bucket_topk``): the shuffle is a few copies of
    the table and ``k`` edges a row and hash table."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array

    odd = F.exists("vec", lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    v = write_table(_whole_vectors(df, id_col, vec_col).where(~odd), "lsh-vectors")
    n, most, width = v.agg(F.count(F.lit(1)), F.max(F.array_max(F.transform("vec", F.abs))), F.max(F.size("vec"))).first()
    want = min(k, n - 1)
    if bucket_length is None and n:
        spread = v.select(F.posexplode("vec").alias("slot", "x")).groupBy("slot").agg(F.var_pop("x").alias("s")).agg(F.avg("s")).first()[0]
        bucket_length = 0.5 * math.sqrt(spread) if spread else 1.0
    rows = v.dropDuplicates(["id", "vec"])
    if want > 0:
        rows = write_table(rows.withColumn("v", array_to_vector(F.col("vec").cast("array<double>"))), "lsh-rows")
    out, asked = None, rows
    w = Window.partitionBy("src")
    while want > 0:
        last = bucket_length > most * math.sqrt(width)
        model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=float(bucket_length),
                                            numHashTables=num_hash_tables, seed=seed).fit(rows)

        def buckets(some):
            if last:
                return some.select(F.lit(0).alias("slot"), F.lit(0.0).alias("bucket"), "id", "vec")
            hashed = model.transform(some).select("id", "vec", F.posexplode("h").alias("slot", "_h"))
            return hashed.select("slot", vector_to_array("_h")[0].alias("bucket"), "id", "vec")

        near = _bucket_topk(buckets(asked), buckets(rows), n, want).repartition("src").dropDuplicates(["src", "dst", "d2"])
        found = write_table(near.withColumn("rank", F.row_number().over(w.orderBy("d2", "dst"))).withColumn("got", F.count(F.lit(1)).over(w))
                            .where(F.col("rank") <= want), "lsh-neighbours")
        part = found if last else found.where(F.col("got") >= want)
        out = part if out is None else out.unionByName(part)
        if last:
            break
        asked = write_table(asked.join(part.where(F.col("rank") == want).select(F.col("src").alias("id")), "id", "left_anti"), "lsh-unfinished")
        if asked.isEmpty():
            break
        bucket_length *= 2.0
    if out is None:
        out = v.sparkSession.createDataFrame([], "src long, dst long, rank int")
    return out.select("src", "dst", F.lit(1.0).alias("weight"), F.col("rank").cast("int").alias("rank"))


def _closest(src: np.ndarray, dst: np.ndarray, d2: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The ``k`` nearest of each ``src``, a pair once: (src, dst, d2, place from 0)."""
    order = np.lexsort((dst, d2, src))
    src, dst, d2 = src[order], dst[order], d2[order]
    once = np.ones(len(src), dtype=bool)
    once[1:] = (src[1:] != src[:-1]) | (dst[1:] != dst[:-1])
    src, dst, d2 = src[once], dst[once], d2[once]
    starts = np.flatnonzero(np.r_[True, src[1:] != src[:-1]]) if len(src) else np.empty(0, np.int64)
    place = np.arange(len(src)) - np.repeat(starts, np.diff(np.r_[starts, len(src)]))
    keep = place < k
    return src[keep], dst[keep], d2[keep], place[keep]


#: Rows of a cell of neighbour descent at least and at most, and pairs that a
#: task holds before it thins them out.
DESCENT_ROWS, DESCENT_PAIRS = (256, 8192), 1 << 20


def _meet(k: int):
    """Brings the rows of a cell's lists ``(fresh, stale)`` together, from its
    rows ``(u, vec, far)``: pairs of which one is fresh and that are nearer than
    ``far``. No more than the ``k`` nearest of a row leave the cell; others cannot
    be among its ``k`` nearest of all cells."""
    def meet(lists: pa.Table, rows: pa.Table) -> pa.Table:
        ids = rows.column("u").to_numpy()
        order = np.argsort(ids)
        ids, far = ids[order], rows.column("far").to_numpy()[order]
        x = np.concatenate([_raw(c) for c in rows.column("vec").chunks])[order]
        bound, slack = np.full(len(ids), np.inf), 1e-9 * (1.0 + np.einsum("ij,ij->i", x, x, dtype=np.float64).max(initial=0.0))
        none = np.empty(0, np.int64)
        best, held, more = (none, none, np.empty(0)), [], 0

        def thin():
            nonlocal best, held, more
            s, d, e, place = _closest(*(np.concatenate(c) for c in zip(best, *held)), k)
            last = place == k - 1
            bound[s[last]] = e[last]
            best, held, more = (s, d, e), [], 0

        for b in lists.to_batches():
            fresh, stale = b.column("fresh"), b.column("stale")
            one, two = (np.searchsorted(ids, c.flatten().to_numpy()) for c in (fresh, stale))
            ends = [np.r_[0, np.cumsum(pc.list_value_length(c).to_numpy())] for c in (fresh, stale)]
            for r in range(b.num_rows):
                young = one[ends[0][r]:ends[0][r + 1]]
                at = np.r_[young, two[ends[1][r]:ends[1][r + 1]]]
                near = x[at].astype(np.float64)
                d2 = _square_distances(near, near)
                np.fill_diagonal(d2, np.inf)
                d2[len(young):, len(young):] = np.inf
                # (places among ids keep the order of the ids)
                i, j = np.nonzero((d2 < far[at][:, None]) & (d2 <= (bound[at] * (1.0 + 1e-9) + slack)[:, None]))
                diff = near[i] - near[j]
                held.append((at[i], at[j], np.einsum("ij,ij->i", diff, diff)))
                more += len(i)
                if more > DESCENT_PAIRS:
                    thin()
        thin()
        return pa.table({"src": ids[best[0]], "dst": ids[best[1]], "d2": best[2]})

    return meet


def _raw(vectors: pa.Array) -> np.ndarray:
    """Vectors of equal length as a matrix of their own type."""
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def knn_graph_descent(df: DataFrame, id_col: str, vec_col: str, k: int = 50, sample: int | None = None, projections: int = 3,
                      rows_per_block: int = 1024, tol: float = 0.001, max_rounds: int = 50, seed: int = 42) -> DataFrame:
    """Approximate kNN by neighbour descent. Same schema as G1; every
    vertex gets ``min(k, n - 1)`` neighbours, some of them not the nearest.

    It starts from the nearest rows inside blocks of rows that lie close on
    seeded random directions. In a round, each vertex brings ``sample``
    (``k / 2``) of its neighbours that are new and as many of the others
    together, in both directions of the edges (a vertex that very many rows
    point to takes part with as few as any other), and each of them keeps the
    ``k`` nearest it has met. It ends when a round changes less than ``tol`` of
    the edges, and raises if ``max_rounds`` are not enough.

    Vertices meet in cells of rows that lie close (``pivot_blocks``): a vector
    is sent once to each cell whose vertices bring it, in the input's own
    precision, instead of once to each vertex."""
    single = df.schema[vec_col].dataType == T.ArrayType(T.FloatType(), df.schema[vec_col].dataType.containsNull)
    v = _whole_vectors(df, id_col, vec_col).withColumn("vec", F.col("vec").cast("array<float>" if single else "array<double>"))
    v = write_table(v.dropDuplicates(["id"]), "descent-vectors")
    n = v.count()
    k = min(k, n - 1)
    empty = v.sparkSession.createDataFrame([], "src long, dst long, weight double, rank int")
    if k < 1:
        return empty
    sample = sample or max(4, k // 2)
    width = len(v.select("vec").first()[0])
    rng = np.random.default_rng(seed)
    best = Window.partitionBy("src").orderBy("d2", "dst")

    def inside(b: pd.DataFrame) -> pd.DataFrame:
        ids, x = b["id"].to_numpy(np.int64), _stack(b["vec"])
        return pd.DataFrame(dict(zip(("src", "dst", "d2"), _topk(ids, x, ids, x, k))))

    def k_best(edges: DataFrame) -> DataFrame:
        """The k nearest of each vertex. ``was`` is the mark of an edge that was
        there before, ``used`` says that it has taken part as a new one: it is old from now on."""
        one = edges.repartition("src").groupBy("src", "dst").agg(F.min("d2").alias("d2"), F.min("was").alias("was"), F.max("used").alias("used"))
        mark = F.when(F.col("was").isNull(), 1).when(F.col("used") == 1, 0).otherwise(F.col("was"))
        ranked = one.where("d2 is not null").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        return write_table(ranked.select("src", "dst", "d2", mark.alias("new"), "rank", F.col("was").isNotNull().alias("kept")), "descent-graph")

    size = max(rows_per_block, 2 * (k + 1))
    start = None
    for _ in range(projections if n > size else 1):
        along = F.aggregate(F.zip_with("vec", F.lit(rng.normal(size=width).tolist()), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        ranked = ordered_rank(v.withColumn("_x", along), [], ["_x", "id"], "_rank")
        # equal blocks: none is left with too few rows for k neighbours
        blocks = ranked.withColumn("blk", F.floor((F.col("_rank") - 1) * max(1, n // size) / n))
        part = blocks.select("blk", "id", "vec").groupBy("blk").applyInPandas(inside, EDGE_SCHEMA)
        start = part if start is None else start.unionByName(part)
    found_as = lambda e: e.select("src", "dst", "d2", F.lit(None).cast("int").alias("was"), F.lit(0).alias("used"))
    graph = k_best(found_as(start))
    rows = min(DESCENT_ROWS[1], max(DESCENT_ROWS[0], n // 24))
    cells = write_table(pivot_blocks(v, n, rows)[0].select(F.col("id").alias("v"), F.col("blk").alias("cell")), "descent-cells")

    for _ in range(max_rounds):
        far = graph.groupBy("src").agg(F.max("d2").alias("far")).withColumnRenamed("src", "u")
        ways = [graph.select(F.col(a).alias("v"), F.col(b).alias("u"), "new", F.lit(int(rng.integers(1 << 30))).alias("way")) for a, b in (("src", "dst"), ("dst", "src"))]
        drawn = Window.partitionBy("v", "new", "way").orderBy(F.xxhash64("v", "u", "way"))
        picked = ways[0].unionByName(ways[1]).repartition("v").withColumn("i", F.row_number().over(drawn)).where(F.col("i") <= sample)
        met = (picked.groupBy("v", "u").agg(F.max("new").alias("new"))
               .groupBy("v").agg(*[F.collect_list(F.when(F.col("new") == m, F.col("u"))).alias(name) for m, name in ((1, "fresh"), (0, "stale"))]))
        met = write_table(met.where(F.size("fresh") > 0).join(cells, "v"), "descent-met")
        asked = met.select("cell", F.explode(F.concat("fresh", "stale")).alias("u")).repartition("u").groupBy("u", "cell").agg(F.lit(1).alias("one"))
        sent = asked.join(v.withColumnRenamed("id", "u").join(far, "u"), "u").select(F.col("cell").alias("at"), "u", "vec", "far")
        found = met.select("cell", "fresh", "stale").groupBy("cell").cogroup(sent.groupBy("at")).applyInArrow(_meet(k), EDGE_SCHEMA)
        used = met.select(F.col("v").alias("src"), F.explode("fresh").alias("dst"))
        before = graph.select("src", "dst", "d2", F.col("new").alias("was"), F.lit(0).alias("used"))
        used = used.select("src", "dst", F.lit(None).cast("double").alias("d2"), F.lit(None).cast("int").alias("was"), F.lit(1).alias("used"))
        graph = k_best(before.unionByName(used).unionByName(found_as(found)))
        kept = graph.where("kept").count()
        if n * k - kept <= tol * n * k:
            break
    else:
        raise RuntimeError(f"neighbour descent still changes after {max_rounds} rounds")
    return graph.select("src", "dst", F.lit(1.0).alias("weight"), F.col("rank").cast("int").alias("rank"))


def recall_at_k(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact graph's edges that ``found`` has, in one row."""
    both = exact.select("src", "dst").join(found.select("src", "dst").withColumn("hit", F.lit(1)), ["src", "dst"], "left")
    return both.agg(F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("recall"))


def mean_degree(edges: DataFrame, n_vertices: DataFrame) -> DataFrame:
    """Total edge weight / number of vertices (``n_vertices`` is a
    one-row table with column ``n``)."""
    n = n_vertices.select("n").scalar()
    return edges.agg(F.sum("weight").alias("_w")).select((F.col("_w") / n).alias("mean_degree"))


def view_weights(views: dict[str, DataFrame], n_vertices: DataFrame) -> DataFrame:
    """Per view ``1 / mean degree``, normalised to sum 1.
    Output ``(view, mean_degree, weight)`` - one row per view."""
    parts = None
    for name, e in views.items():
        d = mean_degree(e, n_vertices).select(F.lit(name).alias("view"), "mean_degree")
        parts = d if parts is None else parts.unionByName(d)
    inv = parts.withColumn("_inv", 1.0 / F.col("mean_degree"))
    tot = inv.agg(F.sum("_inv")).scalar()
    return inv.select("view", "mean_degree", (F.col("_inv") / tot).alias("weight"))


def fuse_graphs(views: dict[str, DataFrame], weights: dict[str, float] | DataFrame) -> DataFrame:
    """``sum_v w_v * W_v`` as an edge table. ``weights`` is a dict or
    the (view, weight) table of ``view_weights`` (one row per view, so it
    is broadcast)."""
    tagged = None
    for name, e in views.items():
        t = e.select("src", "dst", "weight", F.lit(name).alias("view"))
        tagged = t if tagged is None else tagged.unionByName(t)
    if isinstance(weights, dict):
        wt = tagged.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "view string, w double")
    else:
        wt = weights.select("view", F.col("weight").alias("w"))
    j = tagged.join(F.broadcast(wt), "view")
    return j.groupBy("src", "dst").agg(F.sum(F.col("w") * F.col("weight")).alias("weight"))


def symmetrize(edges: DataFrame) -> DataFrame:
    """``(W + W^T) / 2``."""
    both = edges.select("src", "dst", "weight").unionByName(
        edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    return both.groupBy("src", "dst").agg((F.sum("weight") / 2.0).alias("weight"))


def view_edges(views: dict[str, DataFrame]) -> DataFrame:
    """The symmetrised views side by side: ``(src, dst, w)`` with the weights
    ``(W_v + W_v^T) / 2`` of an edge in all views, in the order of ``views``.
    ``sum_v p_v w[v]`` is the symmetrised fusion (G3, G3b) under weights ``p``."""
    tagged = None
    for i, e in enumerate(views.values()):
        for a, b in (("src", "dst"), ("dst", "src")):
            t = e.select(F.col(a).alias("src"), F.col(b).alias("dst"), "weight", F.lit(i).alias("view"))
            tagged = t if tagged is None else tagged.unionByName(t)
    return tagged.groupBy("src", "dst").agg(F.array(*[
        F.coalesce(F.sum(F.when(F.col("view") == i, F.col("weight"))), F.lit(0.0)) / 2.0 for i in range(len(views))]).alias("w"))


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Modularity of a clustering ``(id, cluster)`` on a symmetric edge
    table, ``sum_c in_c / W - (s_c / W)^2`` with the weight inside a cluster,
    its vertices' strength and the total weight; an objective that needs no
    truth. One row; no edges give null. Ends without a cluster are left out."""
    ends = edges.join(labels.select(F.col("id").alias("src"), F.col("cluster").alias("_a")), "src").join(
        labels.select(F.col("id").alias("dst"), F.col("cluster").alias("_b")), "dst")
    sums = ends.groupBy("_a").agg(F.sum("weight").alias("s"), F.sum(F.when(F.col("_a") == F.col("_b"), F.col("weight")).otherwise(0.0)).alias("i"))
    total = sums.agg(F.sum("s").alias("w"), F.sum("i").alias("i"), F.sum(F.col("s") * F.col("s")).alias("ss"))
    return total.select(F.try_divide("i", "w").alias("_i"), (F.try_divide("ss", F.col("w") * F.col("w"))).alias("_s")).select(
        (F.col("_i") - F.col("_s")).alias("modularity"))
