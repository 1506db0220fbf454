"""Shared scratch space: cut lineage with tables that every executor can read.

The folder comes from ``spark.checkpoint.dir`` (a cluster names a shared one);
only where that is unset, as in local tests, a local folder is chosen.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables."""
    set_already = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if set_already:
        return set_already
    own = "file://" + os.path.join(tempfile.gettempdir(), f"mnemospark-{os.getuid()}")
    spark.sparkContext.setCheckpointDir(own)
    return own


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later stages
    start from files, so a lost executor never recomputes what came before."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/mnemospark-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def by_shuffle(df: DataFrame) -> DataFrame:
    """``df`` for a join that must not broadcast it or its partner: both grow with
    the input, and Spark takes a compressed file, however many rows an explode
    makes of each of its rows, for the size of what it would send to the driver."""
    return df.hint("merge")


def release() -> None:
    """Delete every table that ``materialize`` wrote in this process."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(conf).delete(path, True)


def _at_exit() -> None:
    try:
        release()
    except Exception:  # the JVM may be gone already; nothing is left to do then
        pass


atexit.register(_at_exit)


def spread(df: DataFrame, split_bytes: int = 4 << 20) -> DataFrame:
    """Deals out a table too small to give every core a split.

    A small file is one task however heavy the work on its rows is. The plan's
    own size estimate decides (nothing runs); anything that has ``split_bytes``
    for each core keeps its splits.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * split_bytes else df
