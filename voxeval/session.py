"""Session defaults, and the one place that cuts lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, partitions: int = 8) -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("voxeval")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )


_fallback: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The shared folder for staged tables: the cluster's ``spark.checkpoint.dir``.

    Only a local master may do without the setting; it gets one new folder of this machine per process.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if root:
        return root
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    if not _fallback:
        _fallback.append(tempfile.mkdtemp(prefix="spark-voxeval-"))
    return _fallback[0]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_staged: list[str] = []


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Lost executors then never replay the history, the plan stays short (a checkpointed plan
    would keep its constraints, which grow in loops), and later steps read columns.
    """
    spark = df.sparkSession
    path = fresh_path(spark, "stage")
    df.write.parquet(path)
    _staged.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def unstage(df: DataFrame) -> None:
    """Delete a table that ``stage`` returned, once nothing reads it any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._staged_at)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    _staged.remove(df._staged_at)


def clear_stages(spark: SparkSession) -> int:
    """Delete the tables this process has staged; call it once their results are used."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    n = 0
    while _staged:
        path = jvm.org.apache.hadoop.fs.Path(_staged.pop())
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n
