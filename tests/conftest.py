import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    from contrasto.sources.adapters import TABLES

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def canonical(df):
    import pandas as pd

    df = df[sorted(df.columns)].copy()
    for k in df.columns:
        real = df[k].dtype.kind == "f"
        df[k] = df[k].map(lambda v: "" if v is None or (not isinstance(v, (list, str)) and pd.isna(v)) else f"{v:.6f}" if real else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)
