"""What jobs share: their settings, their command line, and how they write."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

HERE = Path(__file__).parent


def settings(name: str, path: str | None = None) -> dict[str, Any]:
    """The job's settings: a JSON file beside it, with those of another file in their place. They are
    the driver's own small files; data goes through Spark only."""
    known = json.loads((HERE / f"{name}.json").read_text())
    given = json.loads(Path(path).read_text()) if path else {}
    if unknown := sorted(given.keys() - known.keys()):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return known | given


def write(df: DataFrame, path: str, by: list[str]) -> DataFrame:
    """Writes the frame in place of the partitions that it has rows of, and gives the whole table. A
    partition's rows are dealt evenly first, so that a large one has several writers and files."""
    df.hint("rebalance", *by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def main(job: str, run: Callable[..., dict[str, Any]], paths: dict[str, str], arguments: list[str] | None = None) -> None:
    """The command line: a session of its own, one run, and a line of what it did."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{job}", description=(run.__doc__ or "").strip())
    for name, help_ in paths.items():
        parser.add_argument(f"--{name}", required=True, help=help_)
    parser.add_argument("--config", help=f"a JSON file with settings other than those of jobs/{job}.json")
    given = vars(parser.parse_args(arguments))
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    config = settings(job, given.pop("config"))
    spark = SparkSession.builder.appName(job).getOrCreate()
    try:
        done = run(spark, **given, config=config)
        logging.getLogger(f"jobs.{job}").info("done: %s", json.dumps(done, default=str))
    finally:
        spark.stop()
