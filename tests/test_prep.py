"""J1, P3/P4, P9, A1, A10, M9, K1-K3 on hand-made tables."""
import datetime as dt

from pyspark.sql import functions as F

from fraudlens.functions.columns import label_fixed, label_name
from fraudlens.operators import prep, sampling

D = dt.datetime(2024, 1, 1)


def test_left_join_keeps_duplicates_and_unmatched(spark):
    content = spark.createDataFrame([(1, 10, 100, D, "a"), (2, 10, 100, D, "b"), (3, 11, 101, D, "c")],
                                    "review_id long, user_id long, prod_id long, date timestamp, Review string")
    meta = spark.createDataFrame([(10, 10, 100, 5.0, 1, D), (11, 10, 100, 4.0, -1, D)],
                                 "meta_id long, user_id long, prod_id long, rating double, label int, date timestamp")
    j = prep.left_join_reviews(content, meta)
    rows = j.collect()
    assert len(rows) == 5  # 2 x 2 duplicates + 1 unmatched
    unmatched = [r for r in rows if r.review_id == 3][0]
    assert unmatched.rating is None and unmatched.label is None


def test_null_safe_join_matches_null_keys(spark):
    content = spark.createDataFrame([(1, 10, None, D, "a")],
                                    "review_id long, user_id long, prod_id long, date timestamp, Review string")
    meta = spark.createDataFrame([(1, 10, None, 3.0, 1, D)],
                                 "meta_id long, user_id long, prod_id long, rating double, label int, date timestamp")
    assert prep.left_join_reviews(content, meta).first().rating is None
    assert prep.left_join_reviews(content, meta, null_safe=True).first().rating == 3.0


def test_label_map_and_recode(spark):
    df = spark.createDataFrame([(-1,), (1,), (0,), (None,)], "label int")
    out = df.select(label_name("label").alias("n"), label_fixed("label").alias("f")).collect()
    assert [r.n for r in out] == ["Spam", "Non‑Spam", None, None]
    assert out[0].f == 0 and out[1].f == 1 and out[2].f == 0 and out[3].f is None


def test_null_profile_counts(spark):
    df = spark.createDataFrame([(1, None, 2.0), (2, "x", None), (3, None, None)], "a long, b string, c double")
    got = {r.column_name: r.null_count for r in prep.null_profile(df).collect()}
    assert got == {"a": 0, "b": 2, "c": 2}


def test_class_stats(spark):
    df = spark.createDataFrame([(1,)] * 9 + [(-1,)] + [(None,)], "label int")
    pct = {r.label_name: r.pct for r in prep.class_distribution(df).collect()}
    assert abs(pct["Spam"] - 10.0) < 1e-9 and abs(pct["Non‑Spam"] - 90.0) < 1e-9
    lf = df.withColumn("label_fixed", label_fixed("label"))
    r = prep.imbalance_ratio(lf).first()
    assert (r.neg, r.pos) == (1, 9) and abs(r.ratio - 1 / 9) < 1e-12
    w = {r.label_fixed: r.weight for r in prep.class_weights(lf).collect()}
    assert abs(w[0] - 10 / 2) < 1e-12 and abs(w[1] - 10 / 18) < 1e-12


def _labelled(spark, n=2000):
    return spark.range(n).select(F.col("id").alias("review_id"),
                                 F.when(F.col("id") % 7 == 0, -1).otherwise(1).alias("label"))


def test_stratified_sample_ratio_and_partition_invariance(spark):
    df = _labelled(spark)
    s1 = sampling.stratified_sample(df, "label", 0.1, seed=3)
    s8 = sampling.stratified_sample(df.repartition(8), "label", 0.1, seed=3)
    c = {r.label: r["count"] for r in s1.groupBy("label").count().collect()}
    n = {r.label: r["count"] for r in df.groupBy("label").count().collect()}
    for k in n:
        assert c[k] == -(-n[k] // 10)  # ceil(0.1 * n_class)
    assert sorted(r.review_id for r in s1.collect()) == sorted(r.review_id for r in s8.collect())


def test_sample_equals_brute_force_rank(spark):
    df = _labelled(spark, 500)
    fast = {r.review_id for r in sampling.stratified_sample(df, "label", 0.25, seed=5, prefix_len=1).collect()}
    from pyspark.sql import Window
    from fraudlens.operators.ordering import hash_order
    w = Window.partitionBy("label").orderBy(hash_order("review_id", 5), "review_id")
    cnt = Window.partitionBy("label")
    brute = (df.withColumn("rn", F.row_number().over(w)).withColumn("k", F.ceil(0.25 * F.count("*").over(cnt)))
               .where("rn <= k"))
    assert fast == {r.review_id for r in brute.collect()}


def test_split_and_folds(spark):
    df = _labelled(spark, 1000).withColumn("label_fixed", label_fixed("label"))
    s = sampling.train_val_split(df, "label_fixed", 0.2)
    got = {(r.label_fixed, r.is_val): r["count"] for r in s.groupBy("label_fixed", "is_val").count().collect()}
    assert got[(0, True)] == 29 and got[(1, True)] == 172
    f = sampling.kfold(df, "label_fixed", 5, n_slices=4)
    per = {r.fold: r["count"] for r in f.where("label_fixed = 0").groupBy("fold").count().collect()}
    assert max(per.values()) - min(per.values()) <= 1


def test_three_parts_are_stratified_and_disjoint(spark):
    from fraudlens.operators import features, sampling
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(i, int(i % 5 == 0), [float(i), 1.0]) for i in range(200)], "id long, label int, v array<double>")
    out = sampling.three_way_split(df, "label", 0.25, 0.2, 42, "id")
    n = {(r.part, r.label): r["count"] for r in out.groupBy("part", "label").count().collect()}
    assert n == {("test", 0): 32, ("test", 1): 8, ("val", 0): 32, ("val", 1): 8, ("train", 0): 96, ("train", 1): 24}
    assert out.select("id").distinct().count() == 200
    z = features.zscore_vector(out, "v", fit_on=F.col("part") == "train").withColumn("x", F.col("v")[0])
    m = z.where("part = 'train'").agg(F.avg("x"), F.stddev_pop("x")).first()
    assert abs(m[0]) < 1e-12 and abs(m[1] - 1) < 1e-12 and abs(z.where("part = 'test'").agg(F.avg("x")).first()[0]) > 1e-6


def test_a_written_table_is_not_written_again(spark):
    from fraudlens.session import write_table, written
    df = write_table(spark.range(5), "once")
    assert written(df) is df and written(df.where("id > 1")) is not df and written(df.where("id > 1")).count() == 3


def test_texts_join_behind_j1_and_repeats_still_multiply(spark, tmp_path):
    from fraudlens.plans import q_prep
    from fraudlens.sources import adapters

    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    put("documents", [(0, "zero"), (1, "one"), (1, "uno"), (2, None), (None, "lost")], "doc_id long, text string")
    put("orders", [(1, 7, "F", D, "1-URGENT"), (2, 7, "O", D, "2-HIGH"), (6, 7, "F", D, "3-MEDIUM"), (6, 7, "F", D, "3-MEDIUM"), (11, None, "F", D, None), (None, 8, "O", D, "5")],
        "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp, o_orderpriority string")
    put("lineitem", [(1, 5), (1, 4), (2, 4), (6, 4), (11, 3)], "l_orderkey long, l_partkey long")
    got = q_prep.joined_orders(spark, str(tmp_path))
    plain = prep.left_join_reviews(*adapters.split_content_meta(adapters.reviews_orders(spark, str(tmp_path)))).select(*got.columns)
    assert got.count() == plain.count() and got.exceptAll(plain).count() == 0
    profile = lambda df: {r.column_name: r.null_count for r in prep.null_profile(df.select(*q_prep._NULL_COLS)).collect()}
    assert {r.column_name: r.null_count for r in q_prep.null_profile(spark, str(tmp_path)).collect()} == profile(plain)
    # the text meets the rows in the last join, not before the one on user, product and date
    joins = [line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join LeftOuter" in line]
    assert "doc_key" in joins[0] and "user_id" not in joins[0]
