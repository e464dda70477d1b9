"""Data preparation: J1, J2, P9, A1, A10, M9."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraudlens.functions.columns import label_name
from fraudlens.session import write_table

JOIN_KEYS = ["user_id", "prod_id", "date"]


def left_join_reviews(content: DataFrame, meta: DataFrame, keys: list[str] = JOIN_KEYS,
                      null_safe: bool = False) -> DataFrame:
    """Content LEFT JOIN metadata on (user_id, prod_id, date).

    Duplicate keys multiply, unmatched content rows keep NULL rating/label.
    ``null_safe=True`` lets NULL keys match each other, as a pandas merge
    does; the default is SQL equality. A hot key is handled by AQE's skew
    join (both sides are shuffled on the key; no side is broadcast because
    neither has a size bound).
    """
    if not null_safe:
        return content.join(meta, list(keys), "left")
    m = meta.select(*[F.col(k).alias(f"_m_{k}") for k in keys],
                    *[c for c in meta.columns if c not in keys])
    cond = reduce(lambda a, b: a & b, [content[k].eqNullSafe(m[f"_m_{k}"]) for k in keys])
    return content.join(m, cond, "left").drop(*[f"_m_{k}" for k in keys])


def null_profile(df: DataFrame) -> DataFrame:
    """NULL count per column in long form ``(column_name, null_count)``.

    One pass, one row of counters, then ``stack`` to long form."""
    cols = df.columns
    wide = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(cols)])
    pairs = ", ".join(f"'{c}', n{i}" for i, c in enumerate(cols))
    return wide.selectExpr(f"stack({len(cols)}, {pairs}) as (column_name, null_count)")


def class_distribution(df: DataFrame, label_col: str = "label") -> DataFrame:
    """A1: share of each class name in percent; NULL names are excluded."""
    named = df.select(label_name(label_col).alias("label_name")).where(F.col("label_name").isNotNull())
    counts = named.groupBy("label_name").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select("label_name", (F.col("n") * 100.0 / total).alias("pct"))


def imbalance_ratio(df: DataFrame, label_col: str = "label_fixed") -> DataFrame:
    """A10 + P10: ``neg / pos`` (the boosted-trees positive weight)."""
    c = F.col(label_col)
    return df.agg(F.count_if(c == 0).alias("neg"), F.count_if(c == 1).alias("pos")) \
             .withColumn("ratio", F.try_divide(F.col("neg").cast("double"), F.col("pos").cast("double")))


def class_weights(df: DataFrame, label_col: str = "label_fixed") -> DataFrame:
    """M9: balanced class weights ``n / (n_classes * n_c)``, one row per class."""
    counts = df.where(F.col(label_col).isNotNull()).groupBy(label_col).agg(F.count(F.lit(1)).alias("n_class"))
    tot = counts.agg(F.struct(F.sum("n_class").alias("n_total"),
                              F.count(F.lit(1)).alias("n_classes")).alias("t")).scalar()
    return counts.select(label_col, "n_class",
                         (tot["n_total"] / (tot["n_classes"] * F.col("n_class"))).alias("weight"))


def aggregate_back(df: DataFrame, keys: list[str], aggs: list[Column]) -> DataFrame:
    """Per-group aggregates attached to every row of the group
    (``groupby(k)[c].transform(f)``).

    groupBy uses partial (map-side) aggregation, so a hot key costs one
    partial row per task. The groups are written before the join back: an
    aggregate is already dealt by the key and would join without an exchange
    of its own, and Spark splits a skewed partition only between two
    exchanges. Rows with a NULL key get NULL aggregates, as the reference's
    groupby drops NULL keys.
    """
    g = df.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])) \
          .groupBy(*keys).agg(*aggs)
    return df.join(write_table(g, "groups"), keys, "left")
