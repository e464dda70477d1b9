"""Order-dependent primitives that stay balanced when one key is huge.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task, so
a user holding a third of all reviews becomes a third of the job in a single
task. The helpers below split by *range* instead:

1. ``repartitionByRange(n, key, order...)`` cuts the ordered key space into
   ``n`` slices of about equal size (a hot key spans several slices);
2. a key that continues across a slice boundary is, by construction, the
   key that ends the previous slice; so a carry table with one row per
   slice (the last key and its running totals / last value) gives every
   slice its carry-in; it is broadcast and joined on the slice number
   alone (the big side is not reshuffled for it);
3. the row-level window runs per (key, slice), so no task holds more than
   about 1/n of the data.

Slices are contiguous ranges of the sort order, so adaptive coalescing of
neighbouring slices keeps the result exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fraudlens.session import write_table, written

SLICE = "_slice"


#: Rows that one slice should hold at most, and at least where the shuffle
#: setting asks for more slices than the size does.
ROWS_PER_SLICE, LEAST_ROWS = 2_000_000, 5_000


def _n_slices(written: DataFrame, n: int | None) -> int:
    """Slices by the number of rows, so that a slice of a hot key stays as
    large as any other when the table grows."""
    if n:
        return int(n)
    rows = written.count()  # from the footers of the written files
    wanted = int(written.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(1, -(-rows // ROWS_PER_SLICE), min(wanted, -(-rows // LEAST_ROWS)))


def _sliced(df: DataFrame, part_cols: list[str], order_cols: list[str], n: int | None) -> DataFrame:
    """Rows with their range-slice number, materialised once.

    The slice number comes from the range exchange's partitioner, whose
    bounds are sampled from the input. If two plan branches each ran their
    own exchange over an input whose row order is not fixed (any shuffle
    output), they could sample different bounds and disagree on slices.
    Writing the sliced rows as a table in the shared checkpoint folder
    pins one assignment (the slice is a stored column) that every branch
    reads and that survives executor loss. The input is written before, unless
    it is a written table, since slicing reads it three times (row count,
    bounds, rows).
    """
    df = written(df, "unsliced")
    sliced = (df.repartitionByRange(_n_slices(df, n), *[F.col(c).asc_nulls_first() for c in part_cols + order_cols])
                .withColumn(SLICE, F.spark_partition_id()))
    return write_table(sliced, "sliced")


def _key(part_cols: list[str]):
    return F.struct(*[F.col(c) for c in part_cols]) if part_cols else F.lit(0)


def _carry_sums(r: DataFrame, part_cols: list[str], sum_exprs: dict) -> DataFrame:
    """Per slice: the key that ends the previous non-empty slice and that
    key's running totals over all earlier slices. One row per slice, so it
    is broadcast and joined on the slice number alone.

    Sound because slices are contiguous ranges of (key, order): rows of a
    key that began before slice s are exactly the tail of slice s-1 and
    possibly whole single-key slices before it."""
    key = _key(part_cols)
    per_key = r.groupBy(SLICE, key.alias("_k")).agg(*[e.alias(n) for n, e in sum_exprs.items()])
    last = per_key.groupBy(SLICE).agg(
        F.max_by(F.struct(F.col("_k"), *[F.col(n) for n in sum_exprs]), F.col("_k")).alias("_last"))
    last = last.select(SLICE, F.col("_last._k").alias("_lk"), *[F.col(f"_last.{n}").alias(n) for n in sum_exprs])
    run = Window.partitionBy("_lk").orderBy(SLICE).rowsBetween(Window.unboundedPreceding, 0)
    cum = last.select(SLICE, "_lk", *[F.sum(n).over(run).alias(n) for n in sum_exprs])
    prev = Window.orderBy(SLICE)  # <= n_slices rows
    return cum.select(SLICE, F.lag(F.struct("_lk", *sum_exprs)).over(prev).alias("_carry"))


def ordered_rank(df: DataFrame, part_cols: list[str], order_cols: list[str],
                 rank_col: str = "_rank", n_slices: int | None = None) -> DataFrame:
    """``row_number() over (partition by part_cols order by order_cols)``,
    1-based, computed without a single-task partition per key.

    ``order_cols`` must give a total order (end with a unique id)."""
    r = _sliced(df, part_cols, order_cols, n_slices)
    carry = _carry_sums(r, part_cols, {"_n": F.count(F.lit(1))})
    j = r.join(F.broadcast(carry), SLICE, "left")
    same = F.col("_carry").isNotNull() & _key(part_cols).eqNullSafe(F.col("_carry._lk"))
    off = F.when(same, F.col("_carry._n")).otherwise(F.lit(0))
    w = Window.partitionBy(*part_cols, SLICE).orderBy(*[F.col(c).asc_nulls_first() for c in order_cols])
    return j.withColumn(rank_col, off + F.row_number().over(w)).drop(SLICE, "_carry")


def previous_value(df: DataFrame, part_cols: list[str], order_cols: list[str],
                   value_col: str, out_col: str, n_slices: int | None = None) -> DataFrame:
    """``lag(value_col) over (partition by part_cols order by order_cols)``.

    The first row of a key in a slice takes the last row of the previous
    non-empty slice when that row has the same key (a key that continues
    across a slice boundary ends the previous slice). The carry table has
    one row per slice and is broadcast; the row-level window runs per
    (key, slice)."""
    r = _sliced(df, part_cols, order_cols, n_slices)
    full = F.struct(*[F.col(c) for c in part_cols + order_cols])
    last = r.groupBy(SLICE).agg(
        F.max_by(F.struct(_key(part_cols).alias("k"), F.col(value_col).alias("v")), full).alias("_l"))
    carry = last.select(SLICE, F.lag("_l").over(Window.orderBy(SLICE)).alias("_carry"))  # <= n_slices rows
    j = r.join(F.broadcast(carry), SLICE, "left")
    w = Window.partitionBy(*part_cols, SLICE).orderBy(*[F.col(c).asc_nulls_first() for c in order_cols])
    same = F.col("_carry").isNotNull() & _key(part_cols).eqNullSafe(F.col("_carry.k"))
    first_in_slice = F.row_number().over(w) == 1
    prev = F.when(first_in_slice, F.when(same, F.col("_carry.v"))).otherwise(F.lag(value_col).over(w))
    return j.withColumn(out_col, prev).drop(SLICE, "_carry")


def prefix_sums(df: DataFrame, part_cols: list[str], order_cols: list[str], sum_cols: list[str],
                suffix: str = "_cum", inclusive: bool = True,
                n_slices: int | None = None) -> DataFrame:
    """Running sums of ``sum_cols`` per ``part_cols`` group along
    ``order_cols``, without moving a group into one partition (range slices
    + the per-slice carry of ``_carry_sums``)."""
    r = _sliced(df, part_cols, order_cols, n_slices)
    carry = _carry_sums(r, part_cols, {f"_t_{c}": F.sum(c) for c in sum_cols})
    j = r.join(F.broadcast(carry), SLICE, "left")
    same = F.col("_carry").isNotNull() & _key(part_cols).eqNullSafe(F.col("_carry._lk"))
    frame_end = 0 if inclusive else -1
    w = (Window.partitionBy(*part_cols, SLICE).orderBy(*[F.col(c).asc_nulls_first() for c in order_cols])
         .rowsBetween(Window.unboundedPreceding, frame_end))
    def running(c):
        off = F.when(same, F.col(f"_carry._t_{c}")).otherwise(F.lit(0))
        return off + F.coalesce(F.sum(c).over(w), F.lit(0))

    return j.withColumns({c + suffix: running(c) for c in sum_cols}).drop(SLICE, "_carry")


def hash_order(id_col: str | Column, seed: int) -> Column:
    """Deterministic pseudo-random order key: md5 of ``'<id>|<seed>'``."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(c.cast("string"), F.lit("|"), F.lit(str(seed))))
