import os
import sys

import duckdb
import pandas as pd
import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", f"file://{shared}")
        .config("spark.sql.warehouse.dir", f"{shared}/warehouse")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SMALL}/{f}')")
    return con


def _plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if v is None or (not isinstance(v, list) and pd.isna(v)):
        return "null"
    if isinstance(v, pd.Timestamp) and v == v.normalize():  # DuckDB's frames have dates as midnights
        v = v.date()
    if isinstance(v, float) and v.is_integer():  # a column of integers with nulls is one of floats in Spark's frames
        return str(int(v))
    return repr(round(v, 9) + 0.0) if isinstance(v, float) else str(v)


def _rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(map(_plain, r)) for r in df.itertuples(index=False, name=None))


@pytest.fixture(scope="session")
def same_rows(spark, duck):
    """Asserts that a query gives the rows of its SQL on the small tables."""

    def check(query, sql):
        got, want = query(spark, SMALL).toPandas(), duck.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert _rows(got) == _rows(want)

    return check
