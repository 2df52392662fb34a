"""Session defaults and the shared working folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.ui.enabled": "false",
}

CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int = 8, partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A single-machine session, for tests and the bench."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("tidewheel")
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def visible(spark: SparkSession) -> None:
    """Lets Python workers that share this file system import the package, whatever folder they start in."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    known = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        environment["PYTHONPATH"] = os.pathsep.join([root, *known])


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.

    Only where nothing is set and the master is local (tests on one machine) a temporary folder of our own is made; on a
    cluster that is an error, as executors couldn't reach such a folder.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    target = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not target:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        target = tempfile.mkdtemp(prefix="tidewheel-checkpoint-")
        delete_at_end(spark, target)
    sc.setCheckpointDir(target)
    return sc._jsc.sc().getCheckpointDir().get()


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Have the file system delete ``path`` when the driver ends; results that read it are lazy, so it can't go before."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    delete_at_end(spark, path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back, so that a lost executor costs no recomputation.

    Its shuffle files go as soon as it is written: nothing reads them again, and else they stay until the driver collects its garbage.
    """
    spark = df.sparkSession
    path = shared_path(spark, "cut")
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEAN) if before is None else spark.conf.set(CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes what ``cut`` wrote for tables that nothing reads any more."""
    for df in tables:
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.cut_at)
        where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
