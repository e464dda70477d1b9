"""Operator 9, nearest neighbours by a forest of hash-prefix trees.

Vectors are dealt to shards of about ``shard_rows`` rows by a hash of their
id, queries to blocks, and each (shard, block of queries) meets in one task.
A task builds one tree per group of random hyperplanes: the sorted array of
its different vectors' long hash strings (32 bits). A query descends every tree to its
longest prefix match, by binary search and comparison with both neighbours,
and then ascends all trees together, one bit shorter at a time, until the
ranges of vectors that share its prefix hold ``share`` of the shard's vectors
(different ones: neither repeats over trees nor rows with the same vector
count again, so a group of copies fills no quota). Those candidates are scored exactly on the
original vectors in double precision and stand for all rows that hold them;
the best of each shard are merged per query.

``share`` is relative to a shard, whose size is fixed, so recall does not
fall as the table grows. Inner products of vectors of any norm are ranked as
angles by one more coordinate, ``sqrt(max_norm**2 - norm**2)`` in the shard.

The trees hold every row; hyperplanes are random (seeded), nothing is fitted.

Edge cases: vectors that are null, zero, or hold null or non-finite
components take no part, nor do rows without id. Vectors of different
length never meet. Repeated rows count once; rows with the query's own id
are not its candidates. Exact copies are one vector of the trees, so all of them
are candidates, and equal scores are ranked by smaller id. With fewer than
``k`` candidates all are found. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

K, TREES, BITS, SHARE, SHARD_ROWS, BLOCK_QUERIES, SEED = 20, 64, 32, 0.6, 4096, 2048, 20050510


def hash_strings(x: np.ndarray, planes: np.ndarray, trees: int) -> np.ndarray:
    """(rows, trees) 32-bit strings, the first plane of a tree in the highest bit."""
    out = np.empty((len(x), trees), dtype=np.uint32)
    for a in range(0, len(x), 1024):
        side = (x[a:a + 1024] @ planes > 0).reshape(-1, trees, BITS)
        out[a:a + 1024] = np.packbits(side, axis=2).view(">u4")[:, :, 0]
    return out


def _prefix(depth: int) -> np.uint32:
    return np.uint32((0xFFFFFFFF << (BITS - depth)) & 0xFFFFFFFF)


class Forest:
    """Trees over the different vectors of one shard."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, trees: int, seed: int):
        x, of = np.unique(x, axis=0, return_inverse=True)
        by = np.lexsort((ids, of.ravel()))
        self.ids, self.x, self.trees = ids[by], x, trees  # the ids of vector i, in order, are ids[start[i]:start[i + 1]]
        self.start = np.r_[0, np.cumsum(np.bincount(of.ravel(), minlength=len(x)))]
        norm2 = (x * x).sum(axis=1)
        self.top = norm2.max()
        lifted = np.c_[x, np.sqrt(np.maximum(self.top - norm2, 0))]
        self.planes = np.random.default_rng(seed).standard_normal((x.shape[1] + 1, trees * BITS))
        strings = hash_strings(lifted, self.planes, trees)
        self.order = [np.argsort(strings[:, t], kind="stable") for t in range(trees)]
        self.sorted = [strings[o, t] for t, o in enumerate(self.order)]

    def among(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Flags of the vectors that the trees' ranges hold."""
        out = np.zeros(len(self.x), dtype=bool)
        for order, a, b in zip(self.order, lo.tolist(), hi.tolist()):
            out[order[a:b]] = True
        return out

    def ranges(self, strings: np.ndarray, enough: int, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Per query and tree the range of candidates in the sorted array:
        ``enough`` different ones in all trees together, ``least`` in one."""
        n, rows = len(strings), len(self.x)
        lo = np.zeros((n, self.trees), dtype=np.int64)
        hi = np.full((n, self.trees), rows, dtype=np.int64)
        longest = np.zeros(n, dtype=np.int64)
        for t, s in enumerate(self.sorted):  # descend: a neighbour in the order has the longest common prefix
            at = np.searchsorted(s, strings[:, t])
            for near in (np.maximum(at - 1, 0), np.minimum(at, rows - 1)):
                differ = (s[near] ^ strings[:, t]).astype(np.float64)
                longest = np.maximum(longest, BITS - np.frexp(differ)[1])
        waiting = np.arange(n)
        for depth in range(int(longest.max(initial=0)), 0, -1):  # ascend all trees together
            now = waiting[longest[waiting] >= depth]
            if not len(now):
                continue
            a, b = np.empty((len(now), self.trees), dtype=np.int64), np.empty((len(now), self.trees), dtype=np.int64)
            for t, s in enumerate(self.sorted):
                low = strings[now, t] & _prefix(depth)
                a[:, t], b[:, t] = np.searchsorted(s, low), np.searchsorted(s, low | ~_prefix(depth), side="right")
            full = ((b - a).sum(axis=1) >= enough) & ((b - a).max(axis=1) >= least)
            for j in np.flatnonzero(full):  # without repeats there may be fewer
                full[j] = self.among(a[j], b[j]).sum() >= enough
            lo[now[full]], hi[now[full]] = a[full], b[full]
            waiting = np.setdiff1d(waiting, now[full], assume_unique=True)
        return lo, hi

    def search(self, q_ids: np.ndarray, q: np.ndarray, k: int, share: float) -> list[tuple]:
        """(query id, id, score) of the best candidates of each query."""
        strings = hash_strings(np.c_[q, np.zeros(len(q))], self.planes, self.trees)
        lo, hi = self.ranges(strings, int(share * len(self.x)), min(len(self.x), 2 * k + 2))
        out = []
        for i, qid in enumerate(q_ids):
            rows = np.flatnonzero(self.among(lo[i], hi[i]))
            score = (self.x[rows] * q[i]).sum(axis=1)  # the same order of additions for every row
            if len(rows) > k + 1:  # every vector stands for a row at least, one of them may be the query's own
                top = score >= np.partition(score, -k - 1)[-k - 1]
                rows, score = rows[top], score[top]
            first, held = self.start[rows], np.minimum(self.start[rows + 1] - self.start[rows], k + 1)
            ids = self.ids[np.repeat(first - np.r_[0, np.cumsum(held)[:-1]], held) + np.arange(held.sum())]
            score = np.repeat(score, held)
            ids, score = ids[ids != qid], score[ids != qid]
            best = np.lexsort((ids, -score))[:k]
            out += zip([qid] * len(best), ids[best].tolist(), score[best].tolist())
        return out


def valid(v: Column) -> Column:
    """A vector without null or non-finite components that is not zero."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


def nearest(rows: DataFrame, queries: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, trees: int = TREES,
            share: float = SHARE, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES, seed: int = SEED) -> DataFrame:
    """The ``k`` nearest ``rows`` of each of ``queries``: query_id, rank, vec_id, score."""

    def clean(df: DataFrame) -> DataFrame:
        v = F.col(f"`{vector}`").cast("array<double>")
        out = df.select(F.col(f"`{vec_id}`").cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull())
        return out.where(valid(F.col("v"))).withColumn("dim", F.size("v"))

    own, asked = clean(rows), clean(queries).dropDuplicates(["id", "v"])
    n, m = own.count(), asked.count()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-m // block_queries))
    own = own.withColumns({"shard": F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"),
                           "block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
    asked = asked.withColumns({"block": F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"),
                               "shard": F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))})

    def task(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        ids, x = left["id"].to_numpy(), np.stack(left["v"].to_numpy())
        different, number = np.unique(ids, return_inverse=True)  # numbers, as doubles do not tell large ids apart
        # repeated rows count once
        first = np.sort(np.unique(np.c_[number, x], axis=0, return_index=True)[1]) if len(different) < len(ids) else slice(None)
        forest = Forest(ids[first], x[first], trees, seed)
        found = forest.search(right["id"].to_numpy(), np.stack(right["v"].to_numpy()), k, share)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    found = (own.groupBy("dim", "shard", "block").cogroup(asked.groupBy("dim", "shard", "block"))
             .applyInPandas(task, "query_id long, vec_id long, score double"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def nearest_query(embeddings: DataFrame) -> DataFrame:
    """Contract of ``op9``: queries are the rows whose id is divisible by 20."""
    return nearest(embeddings, embeddings.where(F.col("vec_id") % 20 == 0))
