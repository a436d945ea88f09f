"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

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


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        _delete(spark, path)
    except Exception:  # at interpreter exit the session may have ended already
        pass


def written(df: DataFrame) -> DataFrame:
    """Cuts lineage: df as a Parquet table in the shared scratch folder, which outlives any executor.

    Unlike a checkpoint of rows it is compressed and read by column. It is removed when the driver exits.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/marlpit-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the scratch tables that df reads, once nothing else does."""
    for path in {found.group() for x in df.inputFiles() if (found := SCRATCH.match(x))}:
        _delete(df.sparkSession, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def in_pieces(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches in pieces of a few rows: what is made of a piece is gone before the next one comes."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_arrow(df: DataFrame, function: Callable[[pa.RecordBatch], list | pa.RecordBatch], schema: str) -> DataFrame:
    """mapInArrow for a function from a batch to a dict of columns, named as in schema."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches):
            yield pa.RecordBatch.from_pydict(function(batch))

    return df.mapInArrow(run, schema)


def crc_fraction(*columns: str) -> Column:
    """A row's place in [0, 1), the same in every run, from the CRC-32 of its columns."""
    return F.crc32(F.concat_ws("\x1f", *[F.col(c).cast("string") for c in columns])) / F.lit(float(2**32))


def crc(data: bytes) -> int:
    return zlib.crc32(data)
