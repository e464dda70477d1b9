"""Text operators (E1-E5): token ids, batched encoders, projections.

E1 is pure Spark SQL (regex tokens, md5-hashed ids). E3/E4 keep the
tokens in the row and run the per-row arithmetic in Arrow-batched pandas
UDFs; their model tables are generated from a seed inside each Python
worker, so every executor computes identical vectors without shipping
weights. Whole texts are processed: nothing is truncated (a text shorter
than ``pad_to`` is right-padded with id 0, whose vector takes part in the
CNN's max over time, as padding does in the reference).
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fraudlens.operators.sums import summed
from fraudlens.session import write_table

# Token pattern: runs of Unicode letters, digits and underscore.
TOKEN_PATTERN = "[\\p{L}\\p{N}_]+"
DEFAULT_VOCAB = 1 << 15
#: Ids of the learned encoder, whose driver holds a dense row for each.
LEARNED_VOCAB = 1 << 13


#: Texts of a task.
TEXT_ROWS = 1024


def spread(df: DataFrame, rows: int = TEXT_ROWS) -> DataFrame:
    """Rows of a stored table dealt evenly over tasks of ``rows`` rows. A file may
    hold many texts in one row group, which one task would work through alone."""
    tasks = math.ceil(df.count() / rows)
    return df.repartition(tasks) if tasks > 1 else df


def tokens(text: Column | str) -> Column:
    """Lower-cased word tokens of the whole text."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN_PATTERN), 0)


def token_hash(tok: Column, vocab: int = DEFAULT_VOCAB) -> Column:
    """Stable id in 1..vocab: first 32 bits of md5, modulo vocab, plus 1
    (0 is the pad id)."""
    return F.conv(F.substring(F.md5(tok), 1, 8), 16, 10).cast("long") % F.lit(vocab) + F.lit(1)


def token_ids(text: Column | str, vocab: int = DEFAULT_VOCAB, pad_to: int | None = None) -> Column:
    """``array<long>`` of hashed ids; right-padded with 0 up to
    ``pad_to`` when shorter. Never truncated."""
    ids = F.transform(tokens(text), lambda t: token_hash(t, vocab))
    if pad_to:
        ids = F.concat(ids, F.array_repeat(F.lit(0).cast("long"), F.greatest(F.lit(0), F.lit(pad_to) - F.size(ids))))
    return ids


def batch_encode(df: DataFrame, text_col: str, make_predict_fn, dim: int, batch_size: int = 500,
                 out: str = "embedding") -> DataFrame:
    """Pluggable batched encoder. ``make_predict_fn()`` runs once per
    Python worker and returns ``f(np.ndarray[str]) -> np.ndarray[n, dim]``
    (e.g. a transformer's first-token vector); Spark feeds it Arrow batches
    of ``batch_size`` texts."""
    from pyspark.ml.functions import predict_batch_udf

    udf = predict_batch_udf(make_predict_fn, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    return df.withColumn(out, udf(F.col(text_col)))


# ---- E3 semantic encoder: TF-IDF -> L2 -> seeded random projection --------------

@lru_cache(maxsize=4)
def _projection(vocab: int, dim: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return (rng.standard_normal((vocab + 1, dim)) / math.sqrt(dim)).astype(np.float32)


def idf_table(df: DataFrame, ids_col: str) -> DataFrame:
    """Smoothed inverse document frequency ``ln((1+N)/(1+df)) + 1`` per id.
    Distinct ids per document, then a partially aggregated count per id
    (at most ``vocab`` rows)."""
    n = df.agg(F.count(F.lit(1))).scalar()
    d = (df.select(F.explode(F.array_distinct(F.col(ids_col))).alias("tok"))
           .groupBy("tok").agg(F.count(F.lit(1)).alias("_df")))
    return d.select("tok", (F.ln((1.0 + n) / (1.0 + F.col("_df"))) + 1.0).alias("idf"))


def semantic_embedding(df: DataFrame, text_col: str = "Review", dim: int = 64, vocab: int = DEFAULT_VOCAB,
                       seed: int = 7, out: str = "semantic") -> DataFrame:
    """E3 (built-in offline encoder): hashed TF-IDF of the whole text,
    L2-normalised, projected to ``dim`` by a seeded Gaussian matrix.

    The idf vector has at most ``vocab`` entries (a parameter, not the
    data size); it travels to the workers inside the UDF closure.

    Both passes (document frequencies, then encoding) need the token ids
    of every whole text. They are computed once and written, without the
    text, to a table in the shared checkpoint folder that both passes
    read. The result has the input columns except ``text_col``."""
    keep = [c for c in df.columns if c != text_col]
    with_ids = write_table(df.select(*keep, token_ids(text_col, vocab).alias("_ids")), "token_ids")
    idf_rows = idf_table(with_ids, "_ids").collect()  # <= vocab rows
    idf = np.zeros(vocab + 1, dtype=np.float64)
    for r in idf_rows:
        idf[int(r["tok"])] = float(r["idf"])

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def encode(col: pd.Series) -> pd.Series:
        R = _projection(vocab, dim, seed)
        res = []
        for ids in col.to_numpy():
            if ids is None or len(ids) == 0:
                res.append(np.zeros(dim, dtype=np.float32))
                continue
            u, c = np.unique(np.asarray(ids, dtype=np.int64), return_counts=True)
            w = c * idf[u]
            w = w / (np.sqrt((w * w).sum()) or 1.0)
            res.append((w.astype(np.float32) @ R[u]).astype(np.float32))
        return pd.Series(res)

    return with_ids.withColumn(out, encode(F.col("_ids"))).drop("_ids")


# ---- E3 learned word vectors: co-occurrence -> PPMI -> randomised SVD ---------------

#: Tokens whose pairs a task counts at a time.
PAIR_TOKENS = 1 << 20


def cooccurrence(df: DataFrame, ids_col: str, window: int = 5) -> DataFrame:
    """``(i, j, n)``: how often two ids stand within ``window`` places of each
    other in a whole text, in either order. Tasks count unordered pairs of some
    texts at a time; their counts are added up and mirrored."""
    def counted(ids: np.ndarray, text: np.ndarray) -> pa.RecordBatch:
        known, at = np.unique(ids, return_inverse=True)
        keys = []
        for d in range(1, window + 1):
            same = text[d:] == text[:-d]
            a, b = at[:-d][same], at[d:][same]
            keys.append(np.minimum(a, b) * len(known) + np.maximum(a, b))
        keys, n = np.unique(np.concatenate(keys), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(known[keys // len(known)]), pa.array(known[keys % len(known)]), pa.array(n.astype(np.int64))],
                                          names=["a", "b", "n"])

    def run(batches):
        for whole in batches:
            size = pc.fill_null(pc.list_value_length(whole.column(0)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ids = whole.column(0).flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(size)
            start = 0
            while start < len(size):  # whole texts, at least one
                before = int(ends[start] - size[start])
                stop = max(start + 1, int(np.searchsorted(ends, before + PAIR_TOKENS, side="right")))
                if ends[stop - 1] > before + 1:
                    yield counted(ids[before:ends[stop - 1]], np.repeat(np.arange(start, stop), size[start:stop]))
                start = stop

    # (a filter on the ids would make Spark compute them once more)
    ids = df.select(F.col(ids_col).cast("array<long>").alias("ids"))
    pairs = ids.mapInArrow(run, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))  # at most vocab^2 rows
    one = lambda i, j, n: F.struct(i.alias("i"), j.alias("j"), n.alias("n"))
    a, b, n = F.col("a"), F.col("b"), F.col("n")
    both = F.when(a == b, F.array(one(a, b, 2 * n))).otherwise(F.array(one(a, b, n), one(b, a, n)))
    return pairs.select(F.explode(both).alias("p")).select("p.i", "p.j", "p.n")


def ppmi(counts: DataFrame, smoothing: float = 0.75) -> DataFrame:
    """``(i, j, v)``: positive pointwise mutual information, with context
    counts raised to ``smoothing`` so that rare contexts weigh less."""
    row = counts.groupBy("i").agg(F.sum("n").alias("ri"))  # at most vocab rows
    ctx = row.select(F.col("i").alias("j"), F.pow("ri", F.lit(smoothing)).alias("cj"))
    total = ctx.agg(F.sum("cj")).scalar()
    v = F.ln(F.col("n") * total / (F.col("ri") * F.col("cj")))
    return counts.join(row, "i").join(ctx, "j").select("i", "j", v.alias("v")).where(F.col("v") > 0)


def _times(matrix: DataFrame, right: np.ndarray, transposed: bool = False, tasks: int = 64) -> np.ndarray:
    """The sparse matrix ``(i, j, v)`` (or its transpose) times a dense one."""
    shape = right.shape

    def run(batches):
        out = None
        for b in batches:
            i, j, v = (b.column(k).to_numpy() for k in ((1, 0, 2) if transposed else (0, 1, 2)))
            out = np.zeros(shape) if out is None else out
            rows, at = np.unique(i, return_inverse=True)
            part = np.zeros((len(rows), shape[1]))
            np.add.at(part, at, v[:, None] * right[j])
            out[rows] += part
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([out.tobytes()], pa.binary())], names=["part", "v"])

    parts = matrix.select("i", "j", "v").mapInArrow(run, "part long, v binary").withColumn("part", F.spark_partition_id().cast("long"))
    total = summed(parts, tasks, 16)
    return total.reshape(shape) if np.ndim(total) else np.zeros(shape)


def word_vectors(df: DataFrame, ids_col: str, dim: int = 64, vocab: int = LEARNED_VOCAB, window: int = 5, rounds: int = 2, seed: int = 7) -> np.ndarray:
    """Learned vectors of the ids ``0..vocab``, rows of ``U sqrt(S)`` of their
    PPMI matrix. The randomised SVD multiplies the matrix by ``dim + 10`` dense
    columns in tasks; QR and the small SVD are the driver's (``vocab`` rows, a
    parameter). Each column's largest entry is positive."""
    matrix = write_table(ppmi(write_table(cooccurrence(df, ids_col, window), "cooccurrence")), "ppmi")
    rng = np.random.default_rng(seed)
    y = _times(matrix, rng.standard_normal((vocab + 1, dim + 10)))
    for _ in range(rounds):
        q, _ = np.linalg.qr(y)
        z, _ = np.linalg.qr(_times(matrix, q, transposed=True))
        y = _times(matrix, z)
    q, _ = np.linalg.qr(y)
    b = _times(matrix, q, transposed=True).T
    u, s, _ = np.linalg.svd(b, full_matrices=False)
    w = (q @ u * np.sqrt(s))[:, :dim]
    return w * np.where(w[np.abs(w).argmax(axis=0), np.arange(w.shape[1])] < 0, -1.0, 1.0)


def learned_embedding(df: DataFrame, text_col: str = "Review", dim: int = 64, vocab: int = LEARNED_VOCAB, window: int = 5, seed: int = 7,
                      out: str = "semantic") -> DataFrame:
    """E3, learned: each text is the mean of its words' learned vectors
    (``word_vectors`` of the same texts), weighted by TF-IDF and scaled to unit
    length; texts without words are zero. ``text_col`` itself is dropped."""
    keep = [c for c in df.columns if c != text_col]
    with_ids = write_table(spread(df).select(*keep, token_ids(F.coalesce(F.col(text_col), F.lit("")), vocab).alias("_ids")), "token_ids")
    idf = np.zeros(vocab + 1)
    for r in idf_table(with_ids, "_ids").collect():  # <= vocab rows
        idf[int(r["tok"])] = float(r["idf"])
    vectors = word_vectors(with_ids, "_ids", dim, vocab, window, seed=seed) * idf[:, None]

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def encode(col: pd.Series) -> pd.Series:
        sums = [vectors[np.asarray(ids, dtype=np.int64)].sum(axis=0) if len(ids) else np.zeros(dim) for ids in col]
        return pd.Series([(x / (np.linalg.norm(x) or 1.0)).astype(np.float32) for x in sums])

    return with_ids.withColumn(out, encode(F.col("_ids"))).drop("_ids")


# ---- E4 n-gram CNN with seeded, untrained weights ----------------------------------

@lru_cache(maxsize=4)
def _cnn_weights(vocab: int, emb: int, channels: int, widths: tuple, seed: int):
    rng = np.random.default_rng(seed)
    E = rng.standard_normal((vocab + 1, emb)).astype(np.float32)  # embedding init N(0, 1)
    taps, biases = [], []
    for w in widths:
        bound = 1.0 / math.sqrt(emb * w)  # conv init U(-1/sqrt(fan_in), +)
        taps.append(rng.uniform(-bound, bound, size=(w, emb, channels)).astype(np.float32))
        biases.append(rng.uniform(-bound, bound, size=channels).astype(np.float32))
    return E, taps, biases


@lru_cache(maxsize=1)
def _cnn_products(vocab: int, emb: int, channels: int, widths: tuple, seed: int):
    """Per width ``(w, vocab + 1, channels)``: every id multiplied by every tap,
    once in a worker; and the biases."""
    E, taps, biases = _cnn_weights(vocab, emb, channels, widths, seed)
    return [np.einsum("ue,jec->juc", E, t) for t in taps], biases


def cnn_forward(ids_list, vocab: int, emb: int = 128, channels: int = 100, widths=(3, 4, 5),
                seed: int = 11) -> np.ndarray:
    """Batch forward pass. Each text gathers and adds the rows of its tokens
    in the products of all tokens and filter taps."""
    P, biases = _cnn_products(vocab, emb, channels, tuple(widths), seed)
    seqs = [np.asarray(s, dtype=np.int64) for s in ids_list]
    out = np.zeros((len(seqs), channels * len(widths)), dtype=np.float32)
    for i, idx in enumerate(seqs):
        for k, (w, Pw) in enumerate(zip(widths, P)):
            L = len(idx) - w + 1
            if L <= 0:
                continue
            acc = Pw[0][idx[0:L]].copy()
            for j in range(1, w):
                acc += Pw[j][idx[j: j + L]]
            acc += biases[k]
            out[i, k * channels:(k + 1) * channels] = np.maximum(acc, 0.0).max(axis=0)
    return out


def cnn_embedding(df: DataFrame, text_col: str = "Review", vocab: int = DEFAULT_VOCAB, pad_to: int = 256,
                  emb: int = 128, channels: int = 100, widths=(3, 4, 5), seed: int = 11,
                  out: str = "cnn") -> DataFrame:
    """Embedding -> 1-D convolutions (widths 3/4/5 x 100) -> ReLU -> max
    over time -> 300 floats, over the whole text padded to >= ``pad_to``. A
    NULL text is all padding, as an empty one is."""
    widths = tuple(widths)

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def encode(col: pd.Series) -> pd.Series:
        padded = (np.r_[ids, np.zeros(max(0, pad_to - len(ids)), dtype=np.int64)] for ids in col)
        vecs = cnn_forward(list(padded), vocab, emb, channels, widths, seed)
        return pd.Series(list(vecs))

    return spread(df).withColumn(out, encode(token_ids(F.coalesce(F.col(text_col), F.lit("")), vocab)))


def projection_2d(df: DataFrame, id_col: str, vec_col: str, label_col: str | None = None) -> DataFrame:
    """E5 (re-aimed from a manifold embedding): first two principal
    components of a view -> ``(id, x, y[, label])``."""
    from fraudlens.operators.features import pca_fit_transform

    p = pca_fit_transform(df, vec_col, 2, out="_xy")
    keep = [id_col] + ([label_col] if label_col else [])
    return p.select(*keep, F.col("_xy")[0].alias("x"), F.col("_xy")[1].alias("y"))
