"""Spark session defaults and the shared checkpoint folder."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "fraudlens") -> SparkSession:
    """Session with AQE (coalesce + skew join), UTC clock and the UI off.

    On a cluster ``master`` stays None and the launcher's settings win; the
    explicit values below are only what this library relies on.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    b = (b.config("spark.sql.adaptive.enabled", "true")
          .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
          .config("spark.sql.adaptive.skewJoin.enabled", "true")
          .config("spark.sql.session.timeZone", "UTC")
          .config("spark.sql.execution.arrow.pyspark.enabled", "true")
          .config("spark.ui.enabled", "false")
          .config("spark.ui.showConsoleProgress", "false")
          .config("spark.driver.memory", os.environ.get("FRAUDLENS_DRIVER_MEM", "16g")))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    Only when the session has none and runs in local mode (tests) is a
    scratch folder created and registered. On a cluster a machine-local
    folder would be lost with its executor, so the launcher must name a
    shared location; without one this raises instead of guessing.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS, S3, ...) for this cluster")
        conf = tempfile.mkdtemp(prefix="fraudlens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", conf)
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def checkpoint(df, eager: bool = True):
    """Cut lineage with a reliable checkpoint into the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


_SCOPES: list[str] = []


@contextlib.contextmanager
def table_scope(spark: SparkSession):
    """Owner of the tables written inside it: they go to one folder of the
    shared checkpoint space, which is deleted at the end. Results that are
    still needed must be written elsewhere before. Without a scope, tables
    stay until the folder's owner clears it."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/scope-{uuid.uuid4().hex}"
    _SCOPES.append(path)
    try:
        yield path
    finally:
        _SCOPES.remove(path)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def write_table(df, name: str = "table"):
    """Cut lineage by writing ``df`` as a parquet table under the shared
    checkpoint folder and reading it back.

    One write job, columnar and compressed; unlike ``checkpoint()`` (a count
    job, then a second job that recomputes the lineage to save it row by
    row) the input is computed once. The copy lives in the cluster's shared
    folder, so it survives the loss of any executor. The innermost
    ``table_scope`` owns it, if there is one."""
    spark = df.sparkSession
    base = _SCOPES[-1] if _SCOPES else f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables"
    path = f"{base}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.parquet(path)
    out._written_table = True
    return out


def written(df, name: str = "table"):
    """``df`` itself if ``write_table`` returned it, else written now."""
    return df if getattr(df, "_written_table", False) else write_table(df, name)
