"""Order-free comparison of two result frames."""

import pandas as pd


def _cell(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return "null"
    if hasattr(v, "__len__") and not isinstance(v, (str, bytes)):
        return str([_cell(x) for x in v])
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    try:
        return repr(round(float(v), 9)) if not isinstance(v, str) else v
    except (TypeError, ValueError):
        return str(v)


def rows(df):
    return sorted(tuple(_cell(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


def same_rows(a, b):
    return rows(a) == rows(b)
