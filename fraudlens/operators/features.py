"""Feature transforms (X1-X4) and matrix assembly.

Statistics are always one small row (means / population stds, or a k x d
PCA basis) computed by a partial aggregate and used as a scalar
subquery; the vectors themselves are never collected.
"""

from __future__ import annotations

from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraudlens.functions.columns import fill_zero, with_scalar
from fraudlens.session import written


def zscore_columns(df: DataFrame, cols: list[str], fit_on: Column | None = None) -> DataFrame:
    """X1 on scalar columns: ``(x - mean) / std_pop``; a constant column
    gives ``x - mean`` (= 0), as a scaler with unit fallback scale does.
    NULLs stay NULL (ignored by the statistics). The rows are written first:
    the statistics and the scaling both read them. ``fit_on`` limits the
    statistics to some rows (T4: those of the training part)."""
    df = written(df, "unscaled")
    fit = df if fit_on is None else df.where(fit_on)
    out = with_scalar(df, "_st", fit.agg(F.struct(*[F.avg(c).alias(f"m_{c}") for c in cols],
                                                   *[F.stddev_pop(c).alias(f"s_{c}") for c in cols])))
    def z(c):
        m, s = F.col(f"_st.m_{c}"), F.col(f"_st.s_{c}")
        return F.when(s == 0, F.col(c) - m).otherwise((F.col(c) - m) / s)

    return out.withColumns({c: z(c) for c in cols}).drop("_st")


def assemble(df: DataFrame, cols: list[str], out: str = "features", fill_null: bool = True) -> DataFrame:
    """Scalar columns -> one ``array<double>`` column, NULL -> 0
    after scaling (= mean imputation) so distances and models see numbers."""
    elems = [fill_zero(F.col(c).cast("double")) if fill_null else F.col(c).cast("double") for c in cols]
    return df.withColumn(out, F.array(*elems))


def zscore_vector(df: DataFrame, col: str, out: str | None = None, fit_on: Column | None = None) -> DataFrame:
    """X1 on an array column, per slot, population std.

    Means and variances come from ``Summarizer`` (one JVM aggregate with
    partial merge); Spark's variance is the sample one, so it is rescaled
    by (n-1)/n. The width-d statistics row is a scalar subquery, and the
    vectors are written first, since statistics and scaling both read them.
    ``fit_on`` limits the statistics to some rows."""
    out = out or col
    df = written(df, "unscaled")
    v = (df if fit_on is None else df.where(fit_on)).withColumn("_v", array_to_vector(F.col(col)))
    st = v.select(Summarizer.metrics("mean", "variance", "count").summary(F.col("_v")).alias("s")) \
          .select(F.struct(vector_to_array("s.mean").alias("mean"), vector_to_array("s.variance").alias("var"),
                           F.col("s.count").alias("n")))
    j = with_scalar(df, "_st", st)
    n = F.col("_st.n")
    std = F.transform(F.col("_st.var"), lambda x: F.sqrt(x * (n - 1) / n))
    z = F.zip_with(F.zip_with(F.col(col), F.col("_st.mean"), lambda x, m: x - m), std,
                   lambda d, s: F.when(s == 0, d).otherwise(d / s))
    return j.withColumn(out, z).drop("_st")


def fuse_views(df: DataFrame, views: dict[str, float], out: str = "features") -> DataFrame:
    """Concatenate array views, each multiplied by its weight
    (e.g. ``{"semantic": 0.3, "behavior": 1.0}``)."""
    def scaled(c, w):
        return F.transform(F.col(c), lambda x: x * F.lit(float(w)))

    parts = [scaled(c, w) for c, w in views.items()]
    return df.withColumn(out, F.concat(*parts))


def pca_fit_transform(df: DataFrame, col: str, k: int, out: str = "pca", center: bool = True,
                      fit_on: DataFrame | None = None) -> DataFrame:
    """PCA to ``k`` dims, fit on ``fit_on`` (default: ``df``) and
    applied to ``df``. Spark's PCA does not centre, so the data are centred
    with the fitting set's mean first (``StandardScaler(withMean, not
    withStd)``). The fit is a distributed covariance (d x d on the driver)."""
    src = fit_on if fit_on is not None else df
    a = df.withColumn("_v", array_to_vector(F.col(col)))
    s = src.withColumn("_v", array_to_vector(F.col(col)))
    if center:
        sc = StandardScaler(withMean=True, withStd=False, inputCol="_v", outputCol="_c").fit(s)
        a, s = sc.transform(a), sc.transform(s)
        vin = "_c"
    else:
        vin = "_v"
    model = PCA(k=k, inputCol=vin, outputCol="_p").fit(s)
    res = model.transform(a).withColumn(out, vector_to_array("_p"))
    return res.drop("_v", "_c", "_p")
