"""Stratified sampling and splitting (K1-K3).

Order inside a class = ``md5('<id>|<seed>')`` then id. A class keeps its
first ``ceil(fraction * n_class)`` rows in that order. This is the same
definition in every engine, so an SQL oracle can repeat it.

Scale: ranking a whole class in one window would put half the table in
one task (two labels = two partitions). Instead a histogram over the first
``prefix_len`` hex digits of the hash finds, per class, the bucket where the
cut falls; rows of earlier buckets are kept by a filter, and only the rows
of that one bucket are ranked. The cut table has one row per class, so it
is broadcast. Nothing is shuffled except the histogram (partially
aggregated) and the rows of the cut bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fraudlens.operators.ordering import hash_order, ordered_rank


def _prepared(df: DataFrame, label_col: str, id_col: str, seed: int, prefix_len: int) -> DataFrame:
    return (df.where(F.col(label_col).isNotNull())  # T10: explicit drop of NULL labels
              .withColumn("_h", hash_order(id_col, seed))
              .withColumn("_b", F.substring("_h", 1, prefix_len)))


def _cuts(d: DataFrame, label_col: str, fraction: float) -> DataFrame:
    hist = d.groupBy(label_col, "_b").agg(F.count(F.lit(1)).alias("_c"))
    upto = Window.partitionBy(label_col).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    allw = Window.partitionBy(label_col)
    hist = (hist.withColumn("_cum", F.sum("_c").over(upto))
                .withColumn("_k", F.ceil(F.lit(float(fraction)) * F.sum("_c").over(allw))))
    return (hist.where((F.col("_cum") >= F.col("_k")) & (F.col("_cum") - F.col("_c") < F.col("_k")))
                .select(label_col, F.col("_b").alias("_cb"),
                        (F.col("_k") - (F.col("_cum") - F.col("_c"))).alias("_need")))


def _flag(df: DataFrame, label_col: str, fraction: float, seed: int, id_col: str,
          prefix_len: int, flag_col: str) -> DataFrame:
    d = _prepared(df, label_col, id_col, seed, prefix_len)
    cuts = _cuts(d, label_col, fraction)
    # one row per class -> broadcast is size-safe
    j = d.join(F.broadcast(cuts), label_col, "left")
    rest = (j.where(F.col("_cb").isNull() | (F.col("_b") != F.col("_cb")))
             .withColumn(flag_col, F.coalesce(F.col("_b") < F.col("_cb"), F.lit(False))))
    w = Window.partitionBy(label_col).orderBy("_h", id_col)
    at = (j.where(F.col("_b") == F.col("_cb"))
           .withColumn(flag_col, F.row_number().over(w) <= F.col("_need")))
    return rest.unionByName(at).drop("_h", "_b", "_cb", "_need")


def stratified_sample(df: DataFrame, label_col: str = "label", fraction: float = 0.10,
                      seed: int = 42, id_col: str = "review_id", mode: str = "exact",
                      prefix_len: int = 5) -> DataFrame:
    """K1: class-preserving sample of ``ceil(fraction * n_class)`` rows per class.

    ``mode="bernoulli"`` keeps a row when its hash, read as a number in
    [0, 1), is below ``fraction`` - no shuffle at all, expected sizes only.
    """
    if mode == "bernoulli":
        h = hash_order(id_col, seed)
        u = F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / F.lit(float(16 ** 13))
        return df.where(F.col(label_col).isNotNull() & (u < F.lit(float(fraction))))
    flagged = _flag(df, label_col, fraction, seed, id_col, prefix_len, "_keep")
    return flagged.where("_keep").drop("_keep")


def train_val_split(df: DataFrame, label_col: str = "label_fixed", val_fraction: float = 0.2,
                    seed: int = 42, id_col: str = "review_id", prefix_len: int = 5) -> DataFrame:
    """K2: stratified split; adds boolean ``is_val`` (``ceil(0.2 * n_class)``
    validation rows per class)."""
    return _flag(df, label_col, val_fraction, seed, id_col, prefix_len, "is_val")


def kfold(df: DataFrame, label_col: str = "label_fixed", n_folds: int = 5, seed: int = 42,
          id_col: str = "review_id", n_slices: int | None = None) -> DataFrame:
    """K3: stratified fold number ``(rank - 1) mod n_folds`` in K1's order.

    The rank inside a class comes from ``ordered_rank`` (range slices), so
    a class is never a single partition."""
    d = df.where(F.col(label_col).isNotNull()).withColumn("_h", hash_order(id_col, seed))
    r = ordered_rank(d, [label_col], ["_h", id_col], "_rank", n_slices)
    return r.withColumn("fold", F.pmod(F.col("_rank") - 1, F.lit(n_folds)).cast("int")).drop("_h", "_rank")


def three_way_split(df: DataFrame, label_col: str = "label_fixed", val_fraction: float = 0.2, test_fraction: float = 0.2, seed: int = 42,
                    id_col: str = "review_id", prefix_len: int = 5) -> DataFrame:
    """T4, strict mode: stratified ``part`` train, val or test. The test rows
    are K2's under ``seed``; the validation rows are drawn from the rest, by
    ``seed + 1``, as ``val_fraction`` of the rest."""
    first = _flag(df, label_col, test_fraction, seed, id_col, prefix_len, "_is_test")
    rest = _flag(first.where(~F.col("_is_test")).drop("_is_test"), label_col, val_fraction, seed + 1, id_col, prefix_len, "_is_val")
    test = first.where("_is_test").drop("_is_test").withColumn("part", F.lit("test"))
    return test.unionByName(rest.withColumn("part", F.when(F.col("_is_val"), "val").otherwise("train")).drop("_is_val"))
