"""Order-insensitive comparison of rows."""

import math

import pandas as pd


def cell(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool) or not isinstance(v, int | float):
        return str(v)
    return f"{float(v):.9g}"


def rows(frame, columns):
    return sorted(tuple(map(cell, r)) for r in frame[columns].astype(object).itertuples(index=False))


def same(spark_frame, sql_frame):
    got, want = spark_frame.toPandas(), sql_frame
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert rows(got, columns) == rows(want, columns)
