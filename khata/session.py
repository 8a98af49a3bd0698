"""Session settings and the shared working folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings of a session that this library starts itself; a session that is handed in keeps its own.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}
#: Tables of more bytes are never spread by a shuffle, whatever their partitions.
SPREAD_BYTES = 1 << 30


def session(master: str = "local[*]", name: str = "khata", **conf: str) -> SparkSession:
    """A session with this library's defaults; `conf` overrides them."""
    builder = SparkSession.builder.master(master).appName(name)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _is_local(master: str) -> bool:
    """Whether driver and executors are one process and so share every folder."""
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or, only where that is unset and the master is local, a folder of this process.

    On a cluster a folder of one machine would be another for each executor, so there the setting must be made.
    """
    known = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not _is_local(spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="khata-")
        spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


def size_in_bytes(df: DataFrame) -> int:
    """What Spark takes the size of a table to be; of files, their bytes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def balanced(df: DataFrame) -> DataFrame:
    """`df` as read, or, where it is of at most SPREAD_BYTES and gives fewer partitions than half the cores, spread over all of them."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if 2 * df.rdd.getNumPartitions() > cores or size_in_bytes(df) > SPREAD_BYTES:
        return df
    return df.repartition(cores)


_written: list[tuple[SparkSession, str]] = []


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a folder, on whatever file system it lies."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def drop_all() -> None:
    """Deletes what scratch() named so far; called when the process ends."""
    while _written:
        spark, path = _written.pop()
        try:
            drop(spark, path)
        except Exception:  # the session may be gone already
            pass


atexit.register(drop_all)


def scratch(spark: SparkSession, name: str = "step") -> str:
    """A new place in the shared folder, deleted when the process ends."""
    path = f"{shared_dir(spark)}/khata/{os.getpid()}-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """`df` written once as a Parquet table in the shared folder and read back.

    Cuts the lineage in a way that survives the loss of executors and keeps later
    stages from computing the input again. The folder goes when the process ends.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
