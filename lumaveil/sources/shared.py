"""Durable intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints. Only a session on one machine gets a temporary one."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    held = sc._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lumaveil-"))
        held = sc._jsc.sc().getCheckpointDir()
    return held.get()


def written(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage, survives lost executors.

    The folder goes when the driver's JVM ends, or earlier by `dropped`.
    """
    spark = df.sparkSession
    to = f"{shared_folder(spark).rstrip('/')}/lumaveil-{uuid.uuid4().hex}"
    df.write.parquet(to)
    path = spark._jvm.org.apache.hadoop.fs.Path(to)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    out = spark.read.schema(df.schema).parquet(to)
    out._lumaveil_folder = to
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete what `written` made, when its last reader has run."""
    for df in tables:
        if to := getattr(df, "_lumaveil_folder", None):
            spark = df.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(to)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
