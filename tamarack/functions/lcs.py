"""Longest common substring of long texts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def _named(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers for the items of both, equal where the items are."""
    name = np.unique(np.concatenate([a, b]), return_inverse=True)[1].astype(np.int64)
    return name[: len(a)], name[len(a) :]


def _joined(a: np.ndarray, b: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of stretches from the names of two shorter ones that cover them, ``step`` apart."""
    base = 1 + max(int(a.max(initial=0)), int(b.max(initial=0)))
    both = [x[: max(0, len(x) - step)] * base + x[step:] for x in (a, b)]
    return _named(*both)


#: Characters of two texts together up to which their stretches are compared as sets of strings: arrays cost more than that to set up.
SHORT = 400


def _of_short(a: str, b: str) -> str | None:
    """``longest`` of short texts: bisection over sizes."""
    sized = lambda size: {a[i : i + size] for i in range(len(a) - size + 1)}.intersection([b[i : i + size] for i in range(len(b) - size + 1)])
    low, high, found = 0, min(len(a), len(b)), set()
    while low < high:
        middle = (low + high + 1) // 2
        some = sized(middle)
        if some:
            low, found = middle, some
        else:
            high = middle - 1
    return min(found, default=None)


def longest(a: str | None, b: str | None) -> str | None:
    """The longest text that both hold, the smallest of equals; null if there is none.

    Stretches get names by doubling: two of 2n characters are equal where both their halves are, so names are exact. The
    size doubles while the texts share one, and then bisection finds the greatest. Memory follows the length of the texts.
    """
    if not a or not b:
        return None
    if len(a) + len(b) <= SHORT:
        return _of_short(a, b)
    x, y = _named(*(np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in (a, b)))
    if not np.isin(x, y).any():
        return None
    size, least = 1, min(len(a), len(b))
    while 2 * size <= least:
        p, q = _joined(x, y, size)
        if not np.isin(p, q).any():
            break
        x, y, size = p, q, 2 * size
    low, high = size, min(2 * size - 1, least)
    while low < high:
        middle = (low + high + 1) // 2
        p, q = _joined(x, y, middle - size)
        low, high = (middle, high) if np.isin(p, q).any() else (low, middle - 1)
    p, q = _joined(x, y, low - size)
    starts = np.flatnonzero(np.isin(p, q))
    starts = starts[np.unique(p[starts], return_index=True)[1]]
    return min(a[i : i + low] for i in starts.tolist())


def longest_common():
    """The vectorised function of two text columns."""

    def run(first: pd.Series, second: pd.Series) -> pd.Series:
        return pd.Series([longest(a, b) for a, b in zip(first, second, strict=True)], dtype=object)

    return F.pandas_udf(run, "string")
