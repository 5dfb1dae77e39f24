"""Pairwise alignment in Arrow batches, a registry of aligners by name."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

#: Room for a start position beside a cost in one integer.
SHIFT = 32

ALIGNERS: dict[str, Callable] = {}


def aligner(name: str):
    def register(f):
        ALIGNERS[name] = f
        return f

    return register


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le"), dtype=np.uint32)


@aligner("dovetail")
def dovetail(a: str, b: str, rate: float, least: int) -> tuple[int, int, int] | None:
    """(begin in a, end in b, errors) of a suffix of a against a prefix of b.

    The longest prefix of b, of at least `least` letters, whose errors are at most
    rate times it; its begin is the least of those of equal cost.  A row of the
    table is updated at once: insertions are a running minimum.
    """
    x, y = _codes(a), _codes(b)
    if len(y) < least or not len(x):
        return None
    one = 1 << SHIFT
    ramp = np.arange(len(y) + 1, dtype=np.int64) * one
    row = ramp.copy()  # a suffix that begins at 0, nothing of a used
    for i, c in enumerate(x, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + np.where(y == c, 0, one), row[1:] + one)
        row = np.minimum.accumulate(new - ramp) + ramp
    cost, begin = row >> SHIFT, row & (one - 1)
    n = np.arange(len(y) + 1)
    ok = np.flatnonzero((n >= least) & (cost <= rate * n))
    if not len(ok):
        return None
    j = int(ok[-1])
    return int(begin[j]), j, int(cost[j])


@aligner("global")
def edit_distance(a: str, b: str, rate: float, least: int) -> tuple[int, int, int] | None:
    """Whole texts against each other; null if more errors than rate times the longer."""
    x, y = _codes(a), _codes(b)
    ramp = np.arange(len(y) + 1, dtype=np.int64)
    row = ramp.copy()
    for i, c in enumerate(x, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + (y != c), row[1:] + 1)
        row = np.minimum.accumulate(new - ramp) + ramp
    n = max(len(x), len(y))
    return (0, len(y), int(row[-1])) if n >= least and row[-1] <= rate * n else None


def align(name: str, rate: float, least: int):
    """A column function of (a, b): struct(bgn, end, errors), null where no alignment is good enough or a text is null."""

    @F.pandas_udf("bgn int, end int, errors int")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        f = ALIGNERS[name]
        out = [f(p, q, rate, least) if p is not None and q is not None else None for p, q in zip(a, b)]
        return pd.DataFrame([o or (None, None, None) for o in out], columns=["bgn", "end", "errors"]).astype("Int32")

    return run
