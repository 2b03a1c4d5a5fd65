import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g"}
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


def canonical(df, cols):
    import pandas as pd

    out = pd.DataFrame({c: df[c] for c in cols})
    for c in cols:
        if out[c].dtype.kind in "iuf" or str(out[c].dtype).startswith("Int"):
            out[c] = out[c].astype(float)
        elif out[c].dtype.kind == "M":
            out[c] = out[c].astype("datetime64[us]")
        else:
            out[c] = out[c].where(out[c].notna(), None)
    return out.astype(str).sort_values(cols).reset_index(drop=True)


@pytest.fixture(scope="session")
def same(sf):
    """Compares a Spark result with DuckDB's answer over the same tables."""
    import duckdb

    con = duckdb.connect()
    for path in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")

    def check(df, sql):
        got, want = df.toPandas(), con.execute(sql).df()
        cols = sorted(got.columns)
        assert cols == sorted(want.columns)
        a, b = canonical(got, cols), canonical(want, cols)
        assert len(a) == len(b)
        assert a.equals(b), a.compare(b).head()

    return check
