"""Session construction and lineage cutting.

Settings are the ones that matter at scale: AQE (coalescing, skew-join split),
UTC session zone, Arrow for the few pandas hand-offs, UI off. The checkpoint
folder is read from ``spark.checkpoint.dir``; a default is only set when the
cluster did not name one (tests, local runs).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "brieflane", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if spark.sparkContext.master.startswith("local"):
        ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder. Where none is named, a local session gets one of its own;
    a cluster has to name one, as a local folder would lie on one machine."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not configured:
        configured = tempfile.mkdtemp(prefix="brieflane-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_intermediate: list[str] = []  # folders that this application has made for itself


def intermediate(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder, for a table that only this application reads."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/brieflane-{name}-{uuid.uuid4().hex}"
    _intermediate.append(path)
    return path


def sweep(spark: SparkSession) -> int:
    """Removes all intermediate tables of this application and returns their number. Call it when
    every result is written: DataFrames that were built before read from them."""
    n = len(_intermediate)
    while _intermediate:
        discard(spark, _intermediate.pop())
    return n


def written(df: DataFrame, name: str = "table", compression: str = "snappy") -> DataFrame:
    """``df`` written to the shared folder and read again: computed once, kept if an executor is
    lost, column by column for what reads it, and with its true size for the joins that follow."""
    spark = df.sparkSession
    path = intermediate(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names of what lies in a folder of any file system that Spark reads (none, if it is missing)."""
    place, fs = _place(spark, folder)
    return [f.getPath().getName() for f in fs.listStatus(place)] if fs.exists(place) else []


def discard(spark: SparkSession, path: str) -> None:
    """Removes an intermediate table of the library that no plan reads any more."""
    place, fs = _place(spark, path)
    fs.delete(place, True)
