import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints"))).getOrCreate()
    )
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(rows):
    """Rows as sorted tuples of comparable texts; numbers to six places."""
    import math

    import numpy as np
    import pandas as pd

    def one(x):
        if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
            return "null"
        if isinstance(x, bool | np.bool_):
            return str(bool(x))
        if hasattr(x, "__float__") and not isinstance(x, str):
            return repr(round(float(x), 6) + 0.0)
        return str(x)

    return sorted(tuple(one(v) for v in r) for r in rows)


def same_as_sql(spark, duck, f, sql):
    got, want = f(spark, DATA).toPandas(), duck.execute(sql).fetchdf()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert plain(got[cols].itertuples(index=False)) == plain(want[cols].itertuples(index=False))
