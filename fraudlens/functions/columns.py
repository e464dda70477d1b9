"""Column expressions.

All are built-in Spark expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values (must equal the reference) -------------------------------
# Label codes and display names; the hyphen in "Non‑Spam" is U+2011.
SPAM_CODE = -1
NON_SPAM_CODE = 1
SPAM_NAME = "Spam"
NON_SPAM_NAME = "Non‑Spam"
# Threshold grid: 200 evenly spaced values from 0.01 to 0.99 inclusive.
GRID_START = 0.01
GRID_STOP = 0.99
GRID_SIZE = 200
GRID_SPAN = 0.98  # GRID_STOP - GRID_START, written as the literal
# -----------------------------------------------------------------------------


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def label_name(col="label") -> Column:
    """-1 -> Spam, 1 -> Non-Spam, anything else -> NULL."""
    c = _c(col)
    return (F.when(c == SPAM_CODE, F.lit(SPAM_NAME))
             .when(c == NON_SPAM_CODE, F.lit(NON_SPAM_NAME)))


def label_fixed(col="label") -> Column:
    """-1 -> 0, every other value unchanged (1 stays 1)."""
    c = _c(col)
    return F.when(c == SPAM_CODE, F.lit(0)).otherwise(c)


def to_timestamp_safe(col) -> Column:
    """P5: string -> timestamp; unparsable -> NULL (no ANSI error)."""
    return F.try_to_timestamp(_c(col))


def truncate_int(col) -> Column:
    """Numeric -> int, truncating toward zero."""
    return _c(col).cast("int")


def threshold_predict(score, t) -> Column:
    """1 when score >= t (inclusive), else 0."""
    return (_c(score) >= (t if isinstance(t, Column) else F.lit(float(t)))).cast("int")


def fill_zero(col) -> Column:
    """NULL -> 0.0."""
    return F.coalesce(_c(col), F.lit(0.0))


def count_where(pred: Column) -> Column:
    """P10: number of rows where ``pred`` holds."""
    return F.count_if(pred)


def scale_array(col, w: float) -> Column:
    """Multiply every element of an array by a constant."""
    return F.transform(_c(col), lambda x: x * F.lit(float(w)))


def text_length(col="Review") -> Column:
    """F1/B1: characters (code points)."""
    return F.length(_c(col)).cast("long")


def word_count(col="Review", unicode_blanks: bool = False) -> Column:
    """F2/B2: whitespace-separated tokens. ``unicode_blanks`` also splits on
    Unicode spaces such as U+00A0, as Python's ``str.split()`` does."""
    pattern = "(?U)\\S+" if unicode_blanks else "\\S+"
    return F.regexp_count(_c(col), F.lit(pattern)).cast("long")


def seconds_between(prev, cur) -> Column:
    """``cur - prev`` in seconds, exact to the microsecond.

    ``timestamp_diff`` works on both TIMESTAMP and TIMESTAMP_NTZ, so no
    time-zone conversion is involved."""
    return F.timestamp_diff("MICROSECOND", _c(prev), _c(cur)).cast("double") / F.lit(1e6)


def threshold_at(j) -> Column:
    """Value j (0-based) of the 200-point grid, as one fixed expression."""
    return (F.lit(GRID_START)
            + _c(j).cast("double") * F.lit(GRID_SPAN) / F.lit(float(GRID_SIZE - 1)))


def grid_bin(score) -> Column:
    """Number of grid thresholds ``t`` with ``t <= score`` (0..200).

    Closed form first, then an exact correction against ``threshold_at`` so
    that ``score >= t_j  <=>  j < grid_bin(score)`` holds bit for bit."""
    s = _c(score)
    j0 = F.floor((s - F.lit(GRID_START)) * F.lit(float(GRID_SIZE - 1))
                 / F.lit(GRID_SPAN))
    j0 = F.least(F.greatest(j0, F.lit(0)), F.lit(GRID_SIZE - 1))
    b = (j0
         + F.when(threshold_at(j0) <= s, 1).otherwise(0)
         + F.when((j0 + 1 < GRID_SIZE) & (threshold_at(j0 + 1) <= s), 1).otherwise(0)
         - F.when((j0 >= 1) & (threshold_at(j0 - 1) > s), 1).otherwise(0))
    return F.when(s.isNull(), F.lit(None)).otherwise(F.least(F.greatest(b, F.lit(0)), F.lit(GRID_SIZE)))


def entropy_term(p) -> Column:
    """-p ln p for p > 0 (zero probabilities are left out)."""
    pc = _c(p)
    return F.when(pc > 0, -pc * F.ln(pc))


def with_scalar(df: DataFrame, name: str, one_row: DataFrame) -> DataFrame:
    """Attach a one-row, one-column aggregate (usually a struct of
    statistics) to every row as column ``name``: one uncorrelated scalar
    subquery, computed once - no join, nothing collected. Later
    expressions read its fields as ``F.col(name + ".field")``, also inside
    higher-order functions, where a subquery itself is not allowed."""
    return df.withColumn(name, one_row.scalar())
