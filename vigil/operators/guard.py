"""Isolation of failing groups.

A Python function that raises for one group ends a whole Spark job.  Wrapped
here, it gives an error row for that group instead; ``split`` separates good
rows from a quarantine table, so the other groups get their usual results.
"""

from __future__ import annotations

import traceback
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ERROR = "_error"


def with_error(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(ERROR, T.StringType())])


def guarded(fn: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType, keys: Sequence[str]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """``fn`` for ``groupBy(keys).applyInPandas`` with schema ``with_error(schema)``:
    its rows with a NULL error, or one row of the keys and the error text."""
    names = [f.name for f in schema.fields]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            return fn(pdf)[names].assign(**{ERROR: None})
        except Exception as e:          # becomes a row; nothing is hidden
            where = traceback.extract_tb(e.__traceback__)[-1]
            row = {n: None for n in names} | {k: pdf[k].iloc[0] for k in keys}
            return pd.DataFrame([row | {ERROR: f"{type(e).__name__}: {e} ({where.name}:{where.lineno})"[:1000]}])
    return run


def split(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows of keys without any error, one row (keys, error) per failed key).
    ``df`` should be a written table: both sides read it."""
    bad = df.where(F.col(ERROR).isNotNull()).groupBy(*keys).agg(F.min(ERROR).alias("error"))
    return df.join(bad.select(*keys), list(keys), "left_anti").drop(ERROR), bad
