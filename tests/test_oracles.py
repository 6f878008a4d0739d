"""Every query with a DuckDB counterpart gives the same rows on the smallest tables."""

import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from jobs import queries as jobs
from tidewater.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings labels".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def cell(v):
    if v is None or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return ""
    if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "iufb":
        return f"{float(v):.9g}" if abs(float(v)) > 1e-9 else "0"
    return str(v)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(cell(v) for v in r) for r in frame[columns].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_oracle(spark, duck, name):
    assert rows(catalog.QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(catalog.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(jobs.QUERIES))
def test_job_equals_oracle(spark, duck, name):
    assert rows(jobs.QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(jobs.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry_lists_the_queries(spark):
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("gone", ["folders", "library"])
def test_entry_imports_without_the_llm_subpackage(tmp_path, gone):
    """On a copy without the subpackage and the pipeline, or without a library that only they need."""
    root = Path(__file__).parent.parent
    shutil.copytree(root / "jobs", tmp_path / "jobs", ignore=shutil.ignore_patterns("__pycache__"))
    shutil.copytree(root / "tidewater", tmp_path / "tidewater", ignore=shutil.ignore_patterns("__pycache__", *["llm"] * (gone == "folders")))
    for name in ["__spark_entry__.py", *["corpus_pipeline.py"] * (gone == "library")]:
        if (root / name).exists():
            shutil.copy(root / name, tmp_path)
    block = "import sys; sys.modules['xxhash'] = None; " if gone == "library" else ""
    said = subprocess.run(
        [sys.executable, "-c", block + "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path,
        env=os.environ | {"PYTHONPATH": ""}, capture_output=True, text=True
    )
    rest = [len(catalog.QUERIES) + len(jobs.QUERIES), len(catalog.ORACLES) + len(jobs.ORACLES)]
    assert said.stdout.split() == list(map(str, rest)), said.stderr
