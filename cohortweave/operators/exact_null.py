"""Exact distributions of paired tests under all sign patterns, by convolution instead of enumeration.

Adding one fold to the distribution of a sum is one shift and one mean, so n folds cost n passes over the possible sums
and not 2^n patterns. Groups are fold-sized: one row per held-out dataset.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STEP, CELLS = 1e-6, 4_000_000  # deltas are counted in steps, wider ones if the possible sums were more than CELLS


def subset_sums(parts: Sequence[int]) -> np.ndarray:
    """Share of all subsets of the whole numbers `parts` with each sum."""
    share = np.zeros(sum(parts) + 1)
    share[0], top = 1.0, 0
    for p in parts:
        new = share[:top + p + 1] / 2
        new[p:] += share[:top + 1] / 2
        top += p
        share[:top + 1] = new
    return share


def sign_flip_p(deltas: Sequence[float]) -> float:
    """Share of the sign patterns whose |sum| is at least the observed one."""
    size = math.fsum(abs(d) for d in deltas)
    step = max(STEP, size / CELLS)
    parts = [round(abs(d) / step) for d in deltas]
    seen = abs(sum(p if d > 0 else -p for p, d in zip(parts, deltas)))
    share = subset_sums(parts)
    return float(share[np.abs(2 * np.arange(len(share)) - sum(parts)) >= seen].sum())


def signed_rank(deltas: Sequence[float]) -> tuple[int, float, float]:
    """n, W+ and its two-sided p for the non-zero deltas, mid-ranks for ties."""
    d = np.array([x for x in deltas if x != 0])
    if not len(d):
        return 0, 0.0, 1.0
    _, at, ties = np.unique(np.abs(d), return_inverse=True, return_counts=True)
    twice = (2 * np.cumsum(ties) - ties + 1)[at]  # twice the mid-rank is whole
    share = subset_sums(twice.tolist())
    w, half = twice[d > 0].sum(), twice.sum() / 2
    return len(d), w / 2, float(share[np.abs(np.arange(len(share)) - half) >= abs(w - half) - 1e-9].sum())


def t_quantile(df: int, level: float = 0.975) -> float:
    """Quantile of Student's t for whole degrees of freedom, by bisection of its finite trigonometric sum."""
    def central(t: float) -> float:
        angle = math.atan2(t, math.sqrt(df))
        c, term, total = math.cos(angle), 1.0, 0.0
        if df % 2:
            term = c
            for k in range(3, df + 1, 2):
                total += term
                term *= c * c * (k - 1) / k
            return 2 / math.pi * (angle + math.sin(angle) * total)
        for k in range(2, df + 1, 2):
            total += term
            term *= c * c * (k - 1) / k
        return math.sin(angle) * total
    lo, hi = 0.0, 1.0
    while central(hi) < 2 * level - 1:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if central(mid) < 2 * level - 1 else (lo, mid)
    return (lo + hi) / 2


def paired(deltas: DataFrame, keys: Sequence[str], delta: str) -> DataFrame:
    """keys, n, mean, lo, hi (95 % t interval; NULL below two folds), p (sign flips) of each comparison."""
    keys = list(keys)
    schema = T.StructType([*[deltas.schema[k] for k in keys], T.StructField("n", T.IntegerType()),
                           *[T.StructField(c, T.DoubleType()) for c in ("mean", "lo", "hi", "p")]])

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.sort(pdf[delta].to_numpy(np.float64))
        n, mean = len(x), math.fsum(x) / len(x)
        half = t_quantile(n - 1) * x.std(ddof=1) / math.sqrt(n) if n > 1 else None
        lo, hi = (None, None) if half is None else (mean - half, mean + half)
        return pd.DataFrame([[*pdf[keys].iloc[0], n, mean, lo, hi, sign_flip_p(x.tolist())]], columns=schema.names)

    return deltas.where(F.col(delta).isNotNull()).select(*keys, delta).groupBy(*keys).applyInPandas(test, schema)


def wilcoxon(deltas: DataFrame, keys: Sequence[str], delta: str) -> DataFrame:
    """keys, n, w_plus, p of the signed-rank test; comparisons without a non-zero delta are left out."""
    keys = list(keys)
    schema = T.StructType([*[deltas.schema[k] for k in keys], T.StructField("n", T.IntegerType()),
                           T.StructField("w_plus", T.DoubleType()), T.StructField("p", T.DoubleType())])

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*pdf[keys].iloc[0], *signed_rank(pdf[delta].tolist())]], columns=schema.names)

    return deltas.where(F.col(delta) != 0).select(*keys, delta).groupBy(*keys).applyInPandas(test, schema)
