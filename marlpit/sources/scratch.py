"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

UNSET_DIR = os.path.join(tempfile.gettempdir(), "checkpoints")
SCRATCH = re.compile(r".*/marlpit-[0-9a-f]{32}(?=/)")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Where it is unset a local session has a folder of its own; on a cluster each executor would write to its own disk,
    so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or UNSET_DIR


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        delete(spark, path)
    except Exception:  # at interpreter exit the session may have ended already
        pass


def scratch_folder(spark: SparkSession) -> str:
    """A path of its own in the shared folder, which is removed when the driver exits."""
    path = f"{scratch_dir(spark)}/marlpit-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def written(df: DataFrame) -> DataFrame:
    """Cuts lineage: df as a Parquet table in the shared scratch folder, which outlives any executor.

    Unlike a checkpoint of rows it is compressed and read by column.
    """
    path = scratch_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the scratch tables that df reads, once nothing else does."""
    for path in {found.group() for x in df.inputFiles() if (found := SCRATCH.match(x))}:
        delete(df.sparkSession, path)
