"""Query registry: name -> (Spark query, oracle SQL or None).

Every query reads the shared tables of one scale-factor folder (through an
adapter) and runs over all of their rows. Doubles are rounded to 6 places
on both sides so that engine-specific summation order cannot change the
value hash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
CHECK: dict[str, str] = {}  # name -> "oracle" | "rows"


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Round every double/float column (top level) to ``places``."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(F.round(F.col(f"`{f.name}`").cast("double"), places).alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


def query(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(fn(spark, sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql.strip()
        CHECK[name] = "oracle" if sql is not None else "rows"
        return run
    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from fraudlens.plans import q_prep, q_behavior, q_evaluate, q_graph, q_models, q_text  # noqa: F401
