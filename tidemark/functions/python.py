"""Functions that no built-in expression gives: Arrow-batched, registered by name on a session."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def _erf(x: pd.Series) -> pd.Series:
    return x.map(math.erf, na_action="ignore")


def normal_distribution(mean: pd.Series, deviation: pd.Series, x: pd.Series) -> pd.Series:
    """P(X <= x)."""
    return 0.5 * (1 + _erf((x - mean) / (deviation * math.sqrt(2))))


def _poisson(mean: float, x: float) -> float:
    if pd.isna(mean) or pd.isna(x):
        return math.nan
    if x < 0:
        return 0.0
    term = total = math.exp(-mean)
    for k in range(1, int(x) + 1):
        term *= mean / k
        total += term
    return min(1.0, total)


def poisson_distribution(mean: pd.Series, x: pd.Series) -> pd.Series:
    return pd.Series([_poisson(m, v) for m, v in zip(mean, x, strict=True)], dtype=float)


def _binomial(trials: float, p: float, x: float) -> float:
    if pd.isna(trials) or pd.isna(p) or pd.isna(x):
        return math.nan
    n = int(trials)
    if x >= n:
        return 1.0
    return min(1.0, sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(int(x) + 1))) if x >= 0 else 0.0


def binomial_distribution(trials: pd.Series, p: pd.Series, x: pd.Series) -> pd.Series:
    return pd.Series([_binomial(*v) for v in zip(trials, p, x, strict=True)], dtype=float)


def next_after(x: pd.Series, towards: pd.Series) -> pd.Series:
    return pd.Series(np.nextafter(x.to_numpy(float), towards.to_numpy(float)))


def ulp(x: pd.Series) -> pd.Series:
    return pd.Series(np.spacing(np.abs(x.to_numpy(float))))


DOUBLES: dict[str, Callable[..., pd.Series]] = {f.__name__: f for f in (normal_distribution, poisson_distribution, binomial_distribution, next_after, ulp)}


def register(spark: SparkSession) -> None:
    """Make the functions known to SQL under their names."""
    for name, f in DOUBLES.items():
        spark.udf.register(name, F.pandas_udf(f, "double"))


def load_function(target: str) -> Callable:
    """``package.module.name`` or ``package.module:name`` as a callable."""
    import importlib

    module, _, name = target.replace(":", ".").rpartition(".")
    return getattr(importlib.import_module(module), name)
