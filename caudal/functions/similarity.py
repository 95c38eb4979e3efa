"""String similarities without a built-in, as vectorised functions for candidate pairs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    window = max(len(a), len(b)) // 2 - 1
    taken = [False] * len(b)
    left = []
    for i, c in enumerate(a):
        for j in range(max(0, i - window), min(len(b), i + window + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for c, t in zip(b, taken) if t]
    m, half = len(left), sum(x != y for x, y in zip(left, right)) // 2
    return (m / len(a) + m / len(b) + (m - half) / m) / 3


def jaro_winkler_of(a: str, b: str) -> float:
    """Jaro similarity, raised for a common prefix of up to four letters when it is above 0.7."""
    s = jaro(a, b)
    if s > 0.7:
        p = 0
        for x, y in zip(a[:4], b[:4]):
            if x != y:
                break
            p += 1
        s += 0.1 * p * (1 - s)
    return s


def jaro_winkler(a: Column, b: Column) -> Column:
    """Null where either side is null."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else jaro_winkler_of(p, q) for p, q in zip(x, y)], dtype="Float64").astype("float64")

    return run(a, b)


def level(score: Column, bounds: list[float]) -> Column:
    """Number of the first bound that a score reaches, from the top: len(bounds) for the best, 0 for none, null for null."""
    out = F.lit(0)
    for i, b in enumerate(sorted(bounds)):
        out = F.when(score >= b, F.lit(i + 1)).otherwise(out)
    return F.when(score.isNotNull(), out)
