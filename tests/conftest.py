import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF0001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from vigil.session import get_session
    s = get_session("local[4]", shuffle_partitions=8)
    yield s
    s.stop()


def ts(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)


def fact_rows(spark, rows, extra_cols=None):
    """Build a fact-table DataFrame from dicts (missing columns NULL)."""
    from vigil.sources.telemetry import TELEMETRY_SCHEMA
    from pyspark.sql import functions as F
    cols = [f.name for f in TELEMETRY_SCHEMA.fields]
    data = [tuple(r.get(c) for c in cols) for r in rows]
    df = spark.createDataFrame(data, TELEMETRY_SCHEMA)
    for c in extra_cols or []:
        df = df.withColumn(c, F.lit(None).cast("double"))
    return df
