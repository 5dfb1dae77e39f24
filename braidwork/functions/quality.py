"""Column functions on quality strings: values, means, other encodings, clear ranges by quality."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Offset of each encoding, and the letters that it may use.
OFFSET = {"sanger": 33, "solexa": 64, "illumina13": 64, "illumina15": 64, "illumina18": 33}
RANGE = {"sanger": ("!", "I"), "solexa": (";", "h"), "illumina13": ("@", "h"), "illumina15": ("B", "h"), "illumina18": ("!", "J")}


def values(qlt: Column, offset: int = 33) -> Column:
    """The qualities of a string as integers; null stays null, an empty string has none."""
    return F.transform(F.filter(F.split(qlt, ""), lambda c: c != ""), lambda c: F.ascii(c) - offset)


def mean(qlt: Column, offset: int = 33) -> Column:
    v = values(qlt, offset)
    return F.when(F.length(qlt) > 0, F.aggregate(v, F.lit(0).cast("long"), lambda a, x: a + x) / F.length(qlt))


def recoded(qlt: Column, source: str, target: str = "sanger") -> Column:
    """A quality string in another encoding; solexa's odds-based scores become error-based ones."""
    v = values(qlt, OFFSET[source])
    if source == "solexa" and target != "solexa":
        v = F.transform(v, lambda x: F.round(10 * F.log10(1 + F.pow(F.lit(10.0), x / 10.0))).cast("int"))
    return F.array_join(F.transform(v, lambda x: F.char(x + OFFSET[target])), "")


def possible(lowest: Column, highest: Column) -> Column:
    """The encodings that may have letters from lowest to highest, as an array of names."""
    return F.filter(F.array(*[F.when((lowest >= lo) & (highest <= hi), F.lit(n)) for n, (lo, hi) in RANGE.items()]), lambda x: x.isNotNull())


def best_stretch(errors, limit: float, longer_than: int = 10) -> tuple[int, int]:
    """(bgn, end) of the longest stretch common to a run found forward and one found backward, of equals the first; (0, 0) if none.

    A run opens at an error of at most limit, goes on while the mean of its errors
    is below limit, and counts if it is longer than longer_than.
    """

    def found(e) -> list[tuple[int, int]]:
        out, p = [], 0
        while p < len(e):
            if e[p] > limit:
                p += 1
                continue
            bgn, total = p, e[p]
            p += 1
            while p < len(e) and total / (p - bgn) < limit:
                total += e[p]
                p += 1
            if p - bgn > longer_than:
                out.append((bgn, p))
        return out

    n, best = len(errors), (0, 0)
    back = [(n - b, n - a) for a, b in found(errors[::-1])]
    for a, b in found(errors):
        for c, d in back:
            lo, hi = max(a, c), min(b, d)
            if hi - lo > best[1] - best[0] or (hi - lo == best[1] - best[0] > 0 and lo < best[0]):
                best = (lo, hi)
    return best


def clear_by_quality(qlt: Column, least: int) -> Column:
    """struct(bgn, end): the best stretch of a quality string (offset 33) whose errors are at most those of the quality `least`; of null an empty one."""
    error = [10 ** (-q / 10) for q in range(95)]

    def each(strings: pd.Series) -> pd.DataFrame:
        out = [best_stretch([error[min(94, max(0, ord(c) - 33))] for c in s] if isinstance(s, str) else [], error[least]) for s in strings]
        return pd.DataFrame(out, columns=["bgn", "end"])

    return F.pandas_udf(each, "bgn int, end int")(qlt)
