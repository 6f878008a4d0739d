"""Cut lineage in the folder that the cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from tidewater.sources.shared import shared_dir


def few(df: DataFrame, a_core: int = 3) -> DataFrame:
    """The frame in no more partitions than so many a core, or than that share of a shuffle's: what
    is dealt finely is written as fewer files. Texts take more partitions than narrow rows."""
    spark = df.sparkSession
    dealt = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.coalesce(max(1, a_core * spark.sparkContext.defaultParallelism, a_core * dealt // 24))


def checkpointed(df: DataFrame) -> DataFrame:
    """The frame, computed once and kept in the shared folder; its readers survive lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bytes of text that an executor hands a Python worker at once.
BATCH_BYTES = 4 << 20


def bounded(df: DataFrame) -> DataFrame:
    """The frame, in a session whose Arrow batches hold BATCH_BYTES at most: Spark bounds them by
    rows, and ten thousand long texts would take both sides' memory. A lower limit is kept."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(key).rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


def unused(df: DataFrame, name: str) -> str:
    """The name, or it with underscores before it, that the frame has no column of."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def stored(df: DataFrame) -> DataFrame:
    """The frame as a Parquet table in the shared folder: columnar, compressed, pruned on reading."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
