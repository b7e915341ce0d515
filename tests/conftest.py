"""One local session for all tests."""

from __future__ import annotations

import glob
import os
import sys

import duckdb
import pandas as pd
import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")  # Python workers import the package too

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    base = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g").config("spark.sql.warehouse.dir", str(base / "warehouse")).config("spark.checkpoint.dir", str(base / "checkpoints"))
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def same_rows(got, want) -> None:
    """Two pandas frames hold the same rows in any order; floats to nine places."""
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)

    def plain(v):
        if v is None or pd.isna(v):
            return "-"
        if isinstance(v, bool) or type(v).__name__ == "bool":
            return str(bool(v))
        return f"{float(v):.9g}" if isinstance(v, float | int) or hasattr(v, "dtype") else str(v)

    rows = lambda df: sorted(tuple(plain(v) for v in r) for r in df[columns].itertuples(index=False))
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    assert a == b
