"""Ties, single rows, odd text, hot keys."""
import datetime as dt

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from fraudlens.functions.columns import NON_SPAM_NAME, SPAM_NAME, seconds_between, text_length, word_count
from fraudlens.operators import behavior
from fraudlens.operators.ordering import ordered_rank, prefix_sums, previous_value

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "review_id long, user_id long, prod_id long, date timestamp, Review string, rating double, label int"


def test_ties_broken_by_id(spark):
    rows = [(3, 1, 1, T0, "x", 1.0, 1), (1, 1, 1, T0, "x", 2.0, 1), (2, 1, 1, T0 + dt.timedelta(seconds=5), "x", 3.0, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    g = {r.review_id: r.gap for r in behavior.time_gap(df, "user_id", "gap").collect()}
    assert g == {1: 0.0, 3: 0.0, 2: 5.0}


def test_hot_key_split_matches_plain_window(spark):
    rng = np.random.default_rng(0)
    n = 3000
    users = np.where(rng.random(n) < 0.5, 0, rng.integers(1, 50, n))  # user 0 holds half the rows
    secs = rng.integers(0, 10 ** 6, n)
    rows = [(i, int(u), int(u) % 7, T0 + dt.timedelta(seconds=int(s)), "t", 1.0, 1)
            for i, (u, s) in enumerate(zip(users, secs))]
    df = spark.createDataFrame(rows, SCHEMA)
    fast = previous_value(df, ["user_id"], ["date", "review_id"], "date", "prev", n_slices=16)
    w = Window.partitionBy("user_id").orderBy("date", "review_id")
    plain = df.withColumn("prev", F.lag("date").over(w))
    a = {r.review_id: r.prev for r in fast.select("review_id", "prev").collect()}
    b = {r.review_id: r.prev for r in plain.select("review_id", "prev").collect()}
    assert a == b
    rk = ordered_rank(df, ["user_id"], ["date", "review_id"], "rk", n_slices=16)
    plain_rk = df.withColumn("rk", F.row_number().over(w))
    assert ({r.review_id: r.rk for r in rk.collect()} == {r.review_id: r.rk for r in plain_rk.collect()})
    ps = prefix_sums(df.withColumn("one", F.lit(1)), ["user_id"], ["date", "review_id"], ["one"], n_slices=16)
    assert {r.review_id: r.one_cum for r in ps.collect()} == {r.review_id: r.rk for r in plain_rk.collect()}


def test_single_rows_give_zero_variance(spark):
    df = spark.createDataFrame([(1, 1, 1, T0, "a b", 4.0, 1), (2, 2, 2, T0, "c", 2.0, -1)], SCHEMA)
    f = behavior.behavior_features(df).collect()
    for r in f:
        assert r.user_rating_var == 0.0 and r.user_time_std == 0.0 and r.prod_rating_var == 0.0
        assert r.time_since_prev == 0.0  # max == min -> 0 (T7)


def test_odd_text(spark):
    texts = [None, "", "   ", "a b", "\U0001F600 ok", "tab\there", 'say "hi"']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    out = df.select(text_length("t").alias("n"), word_count("t").alias("w"),
                    word_count("t", unicode_blanks=True).alias("wu")).collect()
    assert [r.n for r in out] == [None, 0, 3, 3, 4, 8, 8]
    assert [r.w for r in out] == [None, 0, 0, 1, 2, 2, 2]
    assert out[3].wu == 2  # no-break space splits like str.split()


def test_entropy_keeps_above_five_drops_zero(spark):
    df = spark.createDataFrame([(1, 0.0), (1, 6.0), (1, 6.0), (1, 1.0), (2, 0.0)], "user_id long, rating double")
    h = {r.user_id: r.user_rating_entropy for r in behavior.user_rating_entropy(df).collect()}
    p = np.array([2 / 3, 1 / 3])
    assert abs(h[1] - float(-(p * np.log(p)).sum())) < 1e-12
    assert h[2] == 0.0


def test_box_stats_match_numpy(spark):
    rng = np.random.default_rng(1)
    vals = rng.normal(size=101).tolist() + [8.0, -9.0]
    df = spark.createDataFrame([(i, 1, float(v)) for i, v in enumerate(vals)], "review_id long, label int, x double")
    b = behavior.box_stats(df, "label", ["x"], n_slices=5).first()
    q1, med, q3 = np.percentile(vals, [25, 50, 75])
    assert abs(b.q1 - q1) < 1e-12 and abs(b.median - med) < 1e-12 and abs(b.q3 - q3) < 1e-12
    lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    v = np.array(vals)
    assert b.n_outliers == int(((v < lo) | (v > hi)).sum())
    assert b.whisker_high == v[v <= hi].max()


def test_box_stats_hot_value_and_two_classes(spark):
    """A third of the rows share one value (a hot distinct value), many
    ties, two classes; every group must equal numpy's linear quantiles."""
    rng = np.random.default_rng(7)
    a = [3.0] * 120 + rng.integers(0, 10, size=240).astype(float).tolist()
    b = rng.exponential(size=97).tolist() + [50.0]
    rows = [(i, 1, v) for i, v in enumerate(a)] + [(1000 + i, -1, v) for i, v in enumerate(b)]
    df = spark.createDataFrame(rows, "review_id long, label int, x double")
    got = {r.label_name: r for r in behavior.box_stats(df, "label", ["x"], n_slices=7).collect()}
    for name, vals in ((NON_SPAM_NAME, a), (SPAM_NAME, b)):
        r, v = got[name], np.array(vals)
        q1, med, q3 = np.percentile(v, [25, 50, 75])
        assert r.n == len(v)
        assert abs(r.q1 - q1) < 1e-12 and abs(r.median - med) < 1e-12 and abs(r.q3 - q3) < 1e-12
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        inside = v[(v >= lo) & (v <= hi)]
        assert r.whisker_low == inside.min() and r.whisker_high == inside.max()
        assert r.n_outliers == int(len(v) - len(inside))


def test_seconds_between_subsecond(spark):
    df = spark.createDataFrame([(T0, T0 + dt.timedelta(microseconds=1500001))], "a timestamp, b timestamp")
    assert df.select(seconds_between("a", "b").alias("s")).first().s == 1.500001
