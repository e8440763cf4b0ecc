"""Tail probabilities that Spark lacks, as vectorised functions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def incomplete_beta(a: np.ndarray, b: float, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction, vectorised over a and x."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    flip = x > (a + 1) / (a + b + 2)
    p, q = np.where(flip, b, a), np.where(flip, a, b)
    y = np.where(flip, 1 - x, x)
    log_gamma = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
    tiny = 1e-300
    c, d = np.ones_like(y), 1 - (p + q) * y / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    out = d.copy()
    for m in range(1, 300):
        for step in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + step / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            out = out * d * c
        if np.nanmax(np.abs(d * c - 1), initial=0) < 1e-15:
            break
    got = np.where(y <= 0, 0.0, front * out)
    return np.where(flip, 1 - got, got)


@F.pandas_udf(DoubleType())
def _two_sided_t(t: pd.Series, dof: pd.Series) -> pd.Series:
    t, dof = t.to_numpy(float), dof.to_numpy(float)
    with np.errstate(invalid="ignore"):
        return pd.Series(np.where(np.isfinite(t) & (dof > 0), incomplete_beta(dof / 2, 0.5, dof / (dof + t * t)), np.nan))


def two_sided_t(t: Column, dof: Column) -> Column:
    """The two-sided p-value of Student's t; NaN where t isn't finite."""
    return F.coalesce(_two_sided_t(t.cast("double"), dof.cast("double")), F.lit(float("nan")))  # pandas gives NaN back as null
