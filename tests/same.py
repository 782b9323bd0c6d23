"""Comparing frames whatever their order of rows and columns."""

import math

import numpy as np
import pandas as pd


def _plain(x):
    if isinstance(x, (list, np.ndarray)):
        return str([_plain(y) for y in x])
    if x is None or x is pd.NA or x is pd.NaT or isinstance(x, float) and math.isnan(x):
        return "null"
    if isinstance(x, (bool, np.bool_)):
        return str(bool(x))
    if isinstance(x, (float, np.floating)):
        return str(int(x)) if x == int(x) else f"{x:.9g}"
    return str(x)


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple(map(_plain, r)) for r in frame.itertuples(index=False, name=None))
