"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder spark.checkpoint.dir names, set for checkpoints; a local one only where none is
    named and the session runs in one process, as in tests."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not (context.master or "").split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tidewater-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


@contextmanager
def temporary(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A function that writes a frame to a table in the shared folder and reads it again, for iterations
    whose tables are of no use afterwards: leaving the block deletes them."""
    folder = f"{shared_dir(spark)}/steps-{uuid.uuid4().hex}"
    written = []

    def store(df: DataFrame) -> DataFrame:
        written.append(f"{folder}/{len(written)}")
        df.write.parquet(written[-1])
        return spark.read.schema(df.schema).parquet(written[-1])

    try:
        yield store
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
