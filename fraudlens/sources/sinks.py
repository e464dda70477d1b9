"""Sinks (S4, S5) and the deterministic preview."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_embeddings(df: DataFrame, path: str, fmt: str = "parquet",
                     vector_col: str = "embedding", mode: str = "overwrite") -> None:
    """Reviews plus their embedding. Parquet keeps the array natively;
    CSV (header, no index) stores the array as a JSON text column because
    the CSV writer rejects array columns."""
    if fmt == "csv":
        (df.withColumn(vector_col, F.to_json(F.col(vector_col)))
           .write.mode(mode).option("header", "true").csv(path))
    else:
        df.write.mode(mode).parquet(path)


def write_feature_matrix(df: DataFrame, path: str, id_col: str = "review_id",
                         label_col: str | None = "label", vector_col: str = "features",
                         width: int | None = None, fmt: str = "parquet",
                         mode: str = "overwrite") -> None:
    """The fused feature matrix, one column per slot named ``0..width-1``.

    Unlike the reference export, the row id (and label, when given) are kept
    so that rows can be joined back; positional alignment is never assumed.
    """
    arr = F.col(vector_col)
    if width is None:
        width = len(df.select(vector_col).head()[0])
    keep = [id_col] + ([label_col] if label_col else [])
    out = df.select(*keep, *[arr[i].alias(str(i)) for i in range(width)])
    writer = out.write.mode(mode)
    if fmt == "csv":
        writer.option("header", "true").csv(path)
    else:
        writer.parquet(path)


def preview(df: DataFrame, order_by: str | list[str], n: int = 5) -> DataFrame:
    """First ``n`` rows in a stated order (a top-n, so the limit is the
    feature); Spark plans it as TakeOrderedAndProject, no global sort."""
    keys = [order_by] if isinstance(order_by, str) else order_by
    return df.orderBy(*keys).limit(n)
