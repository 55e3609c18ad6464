"""Order-insensitive comparison of a Spark result with a DuckDB result."""

import datetime
import math

import pandas as pd


def norm(v):
    if v is None or v is pd.NaT or v is pd.NA:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return norm(v.item())
        except Exception:
            pass
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return float(v)
    if isinstance(v, pd.Timestamp):
        v = v.to_pydatetime()
    if isinstance(v, datetime.datetime):
        return str(v.date()) if v.time() == datetime.time(0) else str(v)
    if isinstance(v, datetime.date):
        return str(v)
    if hasattr(v, "tolist"):
        return tuple(norm(x) for x in v.tolist())
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return str(v)


def rows(df: pd.DataFrame) -> list:
    cols = sorted(df.columns)
    out = [tuple(norm(x) for x in rec) for rec in df[cols].itertuples(index=False)]
    return sorted(out, key=lambda r: tuple((x is None, repr(round(x, 6)) if isinstance(x, float) else repr(x)) for x in r))


def same(a, b) -> bool:
    if a == b:
        return True
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6)
    return False


def assert_same(spark_pdf: pd.DataFrame, duck_pdf: pd.DataFrame) -> None:
    assert sorted(spark_pdf.columns) == sorted(duck_pdf.columns)
    assert len(spark_pdf) == len(duck_pdf)
    for x, y in zip(rows(spark_pdf), rows(duck_pdf)):
        assert all(same(a, b) for a, b in zip(x, y)), (x, y)
