"""Lineage cuts and scalar statistics (session.write_table, columns.with_scalar)."""

from urllib.parse import urlparse

from pyspark.sql import functions as F

from fraudlens.functions.columns import with_scalar
from fraudlens.operators import features
from fraudlens.session import ensure_checkpoint_dir, write_table


def test_write_table_keeps_rows_and_lives_in_checkpoint_dir(spark):
    df = spark.range(1000).withColumn("p", F.spark_partition_id())
    t = write_table(df.repartition(7, "id").withColumn("p", F.spark_partition_id()), "t")
    base = urlparse(ensure_checkpoint_dir(spark)).path.rstrip("/")
    assert t.inputFiles() and all(urlparse(f).path.startswith(base + "/") for f in t.inputFiles())
    assert t.count() == 1000 and t.select("id").distinct().count() == 1000
    # the stored partition id does not change when the table is read again
    a = {r.id: r.p for r in t.collect()}
    b = {r.id: r.p for r in t.collect()}
    assert a == b


def test_with_scalar_inside_higher_order_function(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 6.0])], "id int, v array<double>")
    st = df.agg(F.struct(F.max(F.col("v")[1]).alias("mx")))
    out = with_scalar(df, "_st", st)
    out = out.select("id", F.transform("v", lambda x: x / F.col("_st.mx")).alias("w"))
    got = {r.id: r.w for r in out.collect()}
    assert got == {1: [1 / 6, 2 / 6], 2: [3 / 6, 1.0]}


def test_zscore_columns_population_std_and_constant(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (2, 3.0, 5.0), (3, None, 5.0)], "id int, x double, c double")
    got = {r.id: r for r in features.zscore_columns(df, ["x", "c"]).collect()}
    assert got[1].x == -1.0 and got[2].x == 1.0 and got[3].x is None
    assert all(got[i].c == 0.0 for i in (1, 2, 3))  # constant column -> x - mean


def test_cluster_without_shared_checkpoint_dir_raises():
    """No machine-local fallback outside local mode (stand-in session)."""
    import pytest

    class Conf:
        def get(self, key, default=None):
            return default

        def set(self, key, value):
            raise AssertionError("must not set a local folder on a cluster")

    class Ctx:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Ctx()
        conf = Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())


def test_tables_of_a_scope_are_deleted(spark):
    from fraudlens.session import table_scope, write_table
    with table_scope(spark) as path:
        inside = write_table(spark.range(5), "scoped")
        assert inside.count() == 5 and path.rsplit("/", 1)[1] in inside.inputFiles()[0]
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    assert not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path))
    assert path.rsplit("/", 1)[1] not in write_table(spark.range(2), "free").inputFiles()[0]
