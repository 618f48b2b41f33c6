import os
import sys
import tempfile

import pandas as pd
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = sys.path[0] + os.pathsep + os.environ.get("PYTHONPATH", "")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


def plain(frame):
    """Rows of a pandas frame as sorted tuples of text, numbers to six digits."""
    frame = frame[sorted(frame.columns)]

    def cell(v):
        if v is None or v is pd.NA or v != v:
            return ""
        if isinstance(v, bool):
            return str(v)
        try:
            return f"{float(v):.5f}" if not isinstance(v, str) else v
        except (TypeError, ValueError):
            return str(v)

    return sorted(tuple(cell(v) for v in row) for row in frame.itertuples(index=False))


@pytest.fixture(scope="session")
def same_as_duckdb():
    import duckdb

    def check(got, sql, folder):
        con = duckdb.connect()
        for name in TABLES:
            if os.path.exists(f"{folder}/{name}.parquet"):
                con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
        want = con.execute(sql).df()
        got = got.toPandas()
        assert sorted(got.columns) == sorted(want.columns)
        assert plain(got) == plain(want)

    return check
