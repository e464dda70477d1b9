"""Headerless tab-separated review files (S1-S3) with explicit schemas.

Column names are fixed by the file layout; types are declared instead of
inferred so that a scan never needs a sampling pass and never guesses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CONTENT_SCHEMA = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("prod_id", T.LongType()),
    T.StructField("date", T.StringType()),
    T.StructField("Review", T.StringType()),
])

META_SCHEMA = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("prod_id", T.LongType()),
    T.StructField("rating", T.DoubleType()),
    T.StructField("label", T.IntegerType()),
    T.StructField("date", T.StringType()),
])

# The third file's middle column has no usable name ("?"); it is renamed.
GRAPH_SCHEMA = T.StructType([
    T.StructField("ID", T.LongType()),
    T.StructField("unknown", T.LongType()),
    T.StructField("Rating", T.DoubleType()),
])


def _lines(spark: SparkSession, path: str, schema: T.StructType, open_end: bool, on_bad: str) -> DataFrame:
    """Raw mode: a line is cut at its tabs. The last field of an ``open_end``
    file keeps the tabs in it. A line with another number of fields, or a
    number that cannot be read, fits not: ``on_bad`` "fail" raises on it,
    "keep" gives nulls and the line in ``_corrupt``."""
    n = len(schema)
    parts = F.split("value", "\t", n if open_end else -1)
    fields = [F.nullif(F.get(parts, i), F.lit("")) for i in range(n)]
    cast = [F.when(F.size(parts) == n, f.try_cast(s.dataType)) for f, s in zip(fields, schema)]
    unread = F.lit(False)
    for f, c in zip(fields, cast):
        unread = unread | (f.isNotNull() & c.isNull())
    bad = (F.size(parts) != n) | unread
    df = spark.read.text(path)
    if on_bad == "keep":
        return df.select(*[F.when(~bad, c).alias(s.name) for c, s in zip(cast, schema)], F.when(bad, F.col("value")).alias("_corrupt"))
    if on_bad != "fail":
        raise ValueError(f"on_bad is 'fail' or 'keep', not {on_bad!r}")
    stop = F.raise_error(F.concat(F.lit("line does not fit the file layout: "), F.col("value")))
    return df.select(*[F.when(bad, stop.cast(s.dataType)).otherwise(c).alias(s.name) for c, s in zip(cast, schema)])


def _read(spark: SparkSession, path: str, schema: T.StructType, quote: str | None, open_end: bool, on_bad: str) -> DataFrame:
    if quote is None:  # the default: a quote sign inside a review must not swallow rows
        return _lines(spark, path, schema, open_end, on_bad)
    mode = {"fail": "FAILFAST", "keep": "PERMISSIVE"}[on_bad]
    full = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())]) if on_bad == "keep" else schema
    return (spark.read.schema(full).option("sep", "\t").option("header", "false").option("mode", mode).option("nullValue", "")
            .option("columnNameOfCorruptRecord", "_corrupt").option("quote", quote).csv(path))


def read_content(spark: SparkSession, path: str, quote: str | None = None, on_bad: str = "fail") -> DataFrame:
    """Review text file -> (user_id, prod_id, date, Review). Tabs after
    the third belong to the review."""
    return _read(spark, path, CONTENT_SCHEMA, quote, True, on_bad)


def read_metadata(spark: SparkSession, path: str, quote: str | None = None, on_bad: str = "fail") -> DataFrame:
    """Metadata file -> (user_id, prod_id, rating, label, date)."""
    return _read(spark, path, META_SCHEMA, quote, False, on_bad)


def read_graph(spark: SparkSession, path: str, quote: str | None = None, on_bad: str = "fail") -> DataFrame:
    """S3: graph label file -> (ID, unknown, Rating)."""
    return _read(spark, path, GRAPH_SCHEMA, quote, False, on_bad)


def write_tsv(df: DataFrame, path: str) -> None:
    """The columns of ``df`` as headerless tab-separated lines; null is the
    empty field, and tabs and line ends in texts become blanks."""
    text = lambda c: F.regexp_replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), r"[\t\r\n]", " ")
    df.select(F.concat_ws("\t", *[text(c) for c in df.columns]).alias("value")).write.text(path)
