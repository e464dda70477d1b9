"""End-to-end plans (the reference's three paths, as lazy Spark plans).

Path 1  reviews -> J1 -> (K1 sample) -> 14 behavioural features -> X1
Path 2  text -> views (E3 semantic, behaviour, E4 n-gram CNN) -> kNN graphs
        -> fusion -> spectral clustering -> agreement
Path 3  fused matrix X4 -> K2 split -> models -> metrics -> leaderboard
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fraudlens.functions.columns import label_fixed
from fraudlens.operators import behavior, features, prep, sampling, text
from fraudlens.sources import adapters

SEMANTIC_WEIGHT = 0.3
BEHAVIOR_WEIGHT = 1.0


def reviews(spark: SparkSession, sf_dir: str, source: str = "docs") -> DataFrame:
    """Review table from an adapter, rebuilt through the reference's
    content/metadata split and left join (J1)."""
    base = {"docs": adapters.reviews_docs, "events": adapters.reviews_events,
            "orders": adapters.reviews_orders}[source](spark, sf_dir)
    content, meta = adapters.split_content_meta(base)
    return prep.left_join_reviews(content, meta)


def review_views(spark: SparkSession, sf_dir: str, source: str = "docs", fraction: float | None = None,
                 with_cnn: bool = False) -> DataFrame:
    """Per review: label_fixed, z-scored behaviour block, z-scored semantic
    block (E3) and optionally the CNN block (E4)."""
    r = reviews(spark, sf_dir, source).where(F.col("label").isNotNull())
    if fraction:
        r = sampling.stratified_sample(r, "label", fraction)
    feats = behavior.behavior_features(r)
    z = features.zscore_columns(feats, behavior.BEHAVIOR_COLUMNS)
    z = features.assemble(z, behavior.BEHAVIOR_COLUMNS, out="behavior")
    sem = text.semantic_embedding(r.select("review_id", "Review"), "Review")
    sem = features.zscore_vector(sem.withColumn("semantic", F.col("semantic").cast("array<double>")), "semantic")
    out = z.select("review_id", label_fixed("label").alias("label"), "behavior").join(
        sem.select("review_id", "semantic"), "review_id")
    if with_cnn:
        cnn = text.cnn_embedding(r.select("review_id", "Review"), "Review")
        out = out.join(cnn.select("review_id", F.col("cnn").cast("array<double>").alias("cnn")), "review_id")
    return out


def model_matrix(spark: SparkSession, sf_dir: str, source: str = "docs", fraction: float | None = None,
                 val_fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """X4 + K2: ``(id, label, features, is_val)`` with
    features = [0.3 * z(semantic), 1.0 * z(behaviour)]."""
    v = review_views(spark, sf_dir, source, fraction)
    fused = features.fuse_views(v, {"semantic": SEMANTIC_WEIGHT, "behavior": BEHAVIOR_WEIGHT})
    m = fused.select(F.col("review_id").alias("id"), "label", "features")
    return sampling.train_val_split(m, "label", val_fraction, seed=seed, id_col="id")


def split(matrix: DataFrame) -> tuple[DataFrame, DataFrame]:
    return (matrix.where(~F.col("is_val")).drop("is_val"), matrix.where(F.col("is_val")).drop("is_val"))
