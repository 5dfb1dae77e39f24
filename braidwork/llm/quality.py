"""Document quality by Bradley-Terry ranking of preference pairs."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .learning import held_out, known_labels
from .spans import LOWER, NOT_SPACE, pieces, span_hashes, text_buffer, tidied, word_spans

MODULUS, REST = 4, 2
RIDGE, STEPS = 1e-3, 25
#: Nodes to a unit of strength: of the chances, and of the sums that only steer the steps.
FINE, COARSE = 64, 8
FAR = 1 << 20
#: From this lead on the chance of the other order, 4e-18, is nought beside one.
FLAT = 40
#: The score from which a document counts as good.
GOOD = 0.7
STEP_BYTES = 1 << 20

NOT_NEWLINE = np.ones(256, bool)
NOT_NEWLINE[[0x0A, 0x0D]] = False


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


#: Classes of bytes whose shares of a text are features.
SHARES = [
    _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("abcdefghijklmnopqrstuvwxyz"), _class("0123456789"), _class(".,;:'\"()?-"), _class("!"), _class("|"), _class("#$%&*"),
    _class("@^~=+<>{}[]\\/_`"), _class("\n\r"), _class(" \t"),
]
N_FEATURES = 2 * (len(SHARES) + 7) + 2


def features(column: pa.Array):
    """For a stretch of texts: rows of N_FEATURES numbers."""
    buf, offsets = text_buffer(column)
    for lo, hi in pieces(offsets, STEP_BYTES):
        own, off = buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        n = hi - lo

        def per_row(values, bounds):
            total = np.append(0, np.cumsum(values, dtype=np.float64))
            return total[bounds[1:]] - total[bounds[:-1]]

        chars = np.maximum(np.diff(off), 1)
        shares = [per_row(c[own], off) / chars for c in SHARES]
        s, e, first = word_spans(own, off, NOT_SPACE)
        words = np.diff(first)
        some = np.maximum(words, 1)
        h = span_hashes(LOWER[own], s, e)
        row = np.repeat(np.arange(n), words)
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
        order = np.lexsort((h, row))
        fresh = np.ones(len(h), bool)
        if len(h) > 1:
            fresh[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
        distinct = np.bincount(row[order][fresh], minlength=n)
        size = e - s
        ls, le, lfirst = word_spans(own, off, NOT_NEWLINE)
        lh, lrow = span_hashes(LOWER[own], ls, le), np.repeat(np.arange(n), np.diff(lfirst))
        lorder = np.lexsort((lh, lrow))
        seen = np.zeros(len(lh), bool)
        if len(lh) > 1:
            seen[1:] = (lh[lorder][1:] == lh[lorder][:-1]) & (lrow[lorder][1:] == lrow[lorder][:-1])
        dup = np.bincount(lrow[lorder][seen], weights=(le - ls)[lorder][seen], minlength=n)
        upper = SHARES[0][own[s]] & SHARES[0][own[np.maximum(e - 1, s)]] & (size > 1) if len(s) else np.empty(0, bool)
        more = [
            per_row(again, first) / some, distinct / some, distinct / np.sqrt(some) / 20, per_row(size, first) / some / 20, per_row(size == 1, first) / some,
            dup / chars, per_row(upper, first) / some,
        ]
        base = np.stack([*shares, *more], axis=1)
        yield np.hstack([base, np.sqrt(base), np.log1p(words)[:, None], np.log1p(words)[:, None] ** 2 / 10]).astype(np.float64)


class Ranking:
    """score(x): the logistic of the fitted strength above the quantile `cut`, with GOOD at the cut itself."""

    def __init__(self):
        self.mean, self.dev, self.w, self.cut, self.scale = np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES), 0.0, 1.0

    def normal(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.dev, -8, 8)

    def strength(self, x: np.ndarray) -> np.ndarray:
        return (self.normal(x) * self.w).sum(axis=1)  # row by row: the same in batches of any size

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (self.strength(x) - self.cut) / self.scale + math.log(GOOD / (1 - GOOD))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, N_FEATURES)


def vectors(docs: DataFrame, *, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns `keep` and x, the features of the whole text as bytes; null is taken as empty."""
    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)

    def run(batches):
        for b in tidied(batches):
            x = np.concatenate(list(features(b.column("__text"))) or [np.zeros((0, N_FEATURES))])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array([r.tobytes() for r in x], pa.binary())], [*keep, "x"])

    return docs.select(*keep, F.col(text_col).alias("__text")).mapInArrow(run, f"{kinds}x binary")


def totals(rows: DataFrame, of) -> tuple[np.ndarray, np.ndarray]:
    """(keys, sums), by key, of what of(x, good) gives as (keys, values) for all rows (x, good): a task sends its sums alone."""

    def run(batches):
        keys, sums = np.empty(0, np.int64), np.empty(0)
        for b in tidied(batches):
            k, v = of(matrix(b.column("x")), np.asarray(b.column("good")) == 1)
            keys, at = np.unique(np.append(keys, k), return_inverse=True)
            sums = np.bincount(at, np.append(sums, v), len(keys))
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums)], ["k", "v"])

    got = rows.mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).toArrow().sort_by("k")
    return np.asarray(got.column("k")), np.asarray(got.column("v"))


def nodes(s: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(node below, share of the node above) of strengths on a grid of `width` nodes to a unit."""
    at = np.floor(s * width)
    return at.astype(np.int64), s * width - at


def across(values: np.ndarray, f, width: int, sign: int, far=None) -> np.ndarray:
    """For every node k: the sum over nodes l of values[l] * f(t), t = sign * (strength of k - strength of l).

    f is nought for t above FLAT; far gives the sums for all t below -FLAT
    from those of values[l] and of values[l] * -t, none: nought.  The work
    grows with the number of nodes alone.
    """
    n = len(values)
    reach = min(n - 1, FLAT * width)
    out = np.convolve(values, f(sign * np.arange(-reach, reach + 1) / width))[reach : reach + n]
    if far is not None and reach < n - 1:
        v = values[::sign]
        count, place = (np.cumsum(x[::-1])[::-1][reach + 1 :] for x in (v, v * np.arange(n)))
        out[::sign][: len(count)] += far(count, (place - np.arange(len(count)) * count) / width)
    return out


def other(t: np.ndarray) -> np.ndarray:
    """The chance of the other order at a lead of t."""
    return 1 / (1 + np.exp(np.clip(t, -700, 700)))


def unsure(t: np.ndarray) -> np.ndarray:
    p = other(np.abs(t))
    return p * (1 - p)


class Pairs:
    """What the sums over all pairs of a good and a bad row need to know of their strengths, by nodes.

    A pair's chance is a function of the difference of two strengths.  Summed
    over all partners of a row it is a function of the row's strength, which
    follows from the numbers of partners by node: so all pairs are summed in
    one pass over the rows.  Chances are interpolated between nodes 1/64
    apart, which changes each by less than 0.0001 of itself.
    """

    def __init__(self, rows: DataFrame, model: Ranking):
        def count(x, good):
            at, up = nodes(model.strength(x), FINE)
            return np.append(2 * at + good, 2 * at + 2 + good), np.append(1 - up, up)

        keys, sums = totals(rows, count)
        self.low = int(keys.min() >> 1)
        by = np.zeros((int(keys.max() >> 1) - self.low + 1, 2))
        by[(keys >> 1) - self.low, keys & 1] = sums
        bad, good = by.T
        # of the leads of good over bad rows
        self.other = np.stack([across(good, other, FINE, -1, lambda n, t: n), across(bad, other, FINE, 1, lambda n, t: n)])
        self.unsure = np.stack([across(good, unsure, FINE, -1), across(bad, unsure, FINE, 1)])
        self.loss = float(good @ across(bad, lambda t: np.logaddexp(0, -t), FINE, 1, lambda n, t: t))

    def at(self, table: np.ndarray, s: np.ndarray, good: np.ndarray) -> np.ndarray:
        at, up = nodes(s, FINE)
        k, g = np.clip(at - self.low, 0, table.shape[1] - 2), good.astype(np.int64)
        return table[g, k] * (1 - up) + table[g, k + 1] * up


def slopes(rows: DataFrame, model: Ranking, pairs: Pairs) -> tuple[np.ndarray, np.ndarray]:
    """(gradient, curvature) over all pairs: the sums of their differences d times the chance of the other order, and of d d' times p (1 - p)."""
    m = N_FEATURES

    def part(x, good):
        z, s = model.normal(x), model.strength(x)
        p, q = pairs.at(pairs.other, s, good), pairs.at(pairs.unsure, s, good)
        at, up = nodes(s, COARSE)
        at = np.append(at, at + 1)
        cell, of = np.unique(2 * (at + FAR) + np.tile(good, 2), return_inverse=True)
        both = np.zeros((len(cell), m))
        np.add.at(both, of, np.concatenate([z * (1 - up)[:, None], z * up[:, None]]))
        keys = m + m * m + (cell[:, None] * m + np.arange(m)).reshape(-1)
        return np.concatenate([np.arange(m + m * m), keys]), np.concatenate([np.where(good, p, -p) @ z, ((z * q[:, None]).T @ z).reshape(-1), both.reshape(-1)])

    keys, sums = totals(rows, part)
    own, cross = sums[: m + m * m], sums[m + m * m :]
    cell, j = np.divmod(keys[m + m * m :] - m - m * m, m)
    low = int(cell.min() >> 1)
    by = np.zeros((2, int(cell.max() >> 1) - low + 1, m))
    by[cell & 1, (cell >> 1) - low, j] = cross
    mixed = by[1].T @ np.stack([across(c, unsure, COARSE, 1) for c in by[0].T], axis=1)
    return own[:m], own[m:].reshape(m, m) - mixed - mixed.T


def ranked(rows: DataFrame, model: Ranking, ranks: list[int]) -> tuple[list[float], float]:
    """(the strengths of these ranks from 0 among all rows, their deviation): exact, 16 bits at a time."""
    top = np.uint64(1 << 63)

    def bits(s):
        u = (s + 0.0).view(np.uint64)
        return np.where(u & top, ~u, u | top)

    found, left, dev = [0] * len(ranks), list(ranks), 0.0
    for shift in (48, 32, 16, 0):
        def digits(x, good, shift=shift, found=tuple(found)):
            s = model.strength(x)
            u = bits(s)
            above, digit = u >> np.uint64(shift) >> np.uint64(16), ((u >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.int64)
            keys = [digit[above == np.uint64(f)] + (i << 16) for i, f in enumerate(found)]
            n = sum(map(len, keys))
            return np.concatenate([*keys, [-3, -2, -1]]), np.concatenate([np.ones(n), [len(s), s.sum(), s @ s]])

        keys, sums = totals(rows, digits)
        n, one, two = sums[:3]
        dev = math.sqrt(max(0.0, two / n - (one / n) ** 2))
        for i in range(len(ranks)):
            own = keys >> 16 == i
            upto = np.cumsum(sums[own])
            k = int(np.searchsorted(upto, left[i], "right"))
            left[i] -= int(upto[k - 1]) if k else 0
            found[i] = (found[i] << 16) | int(keys[own][k] & 0xFFFF)
    u = np.array(found, np.uint64)
    return np.where(u & top, u ^ top, ~u).view(np.float64).tolist(), dev


def fit(rows: DataFrame) -> Ranking:
    """The ranking of all rows (x, good): every good row is paired with every bad one.

    Newton steps in passes over the rows.  Figures are rounded, so that they
    don't change with the order in which tasks are summed.
    """
    out = Ranking()
    m = N_FEATURES
    keys, sums = totals(rows, lambda x, good: (np.arange(m + 2), np.concatenate([[(~good).sum(), good.sum()], x.sum(axis=0)])))
    if not len(keys) or sums[0] == 0 or sums[1] == 0:
        return out
    bad, good = int(sums[0]), int(sums[1])
    mean = (sums[2:] / (bad + good)).astype(np.float32).astype(np.float64)
    _, sums = totals(rows, lambda x, good: (np.arange(m), ((x - mean) ** 2).sum(axis=0)))
    out.mean, out.dev = mean, np.maximum(np.sqrt(sums / (bad + good)), 1e-6).astype(np.float32).astype(np.float64)
    n = float(bad) * good
    # the chance that a good document beats a bad one: logistic in the difference of their features
    price = lambda: pairs.loss / n + RIDGE / 2 * float(out.w @ out.w)
    pairs = Pairs(rows, out)
    loss = price()
    for _ in range(STEPS):
        first, second = slopes(rows, out, pairs)
        step, before = np.linalg.solve(second / n + RIDGE * np.eye(m), first / n - RIDGE * out.w), out.w
        while np.linalg.norm(before + step) > 40:  # beyond that the ridge alone costs more than weights of nought
            step = step / 2
        for _ in range(8):
            out.w = before + step
            pairs, last = Pairs(rows, out), loss
            loss = price()
            if loss <= last * (1 + 1e-6):
                break
            step, loss = step / 2, last
        if np.abs(step).max() < 1e-6:
            break
    out.w = np.round(out.w, 9)
    # the quantile of the strengths of all labelled documents that leaves the share of bad ones below it
    (a, b), dev = ranked(rows, out, [bad - 1, bad])
    out.cut, out.scale = (a + b) / 2, max(1e-6, round(dev / 4, 9))
    return out


def train(vectors: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", label_col: str = "quality", modulus: int = MODULUS, rest: int = REST) -> Ranking:
    """Fit the ranking to all pairs of labelled rows of vectors(id_col, x) whose id is not held out.

    Without documents of both labels every score is GOOD.
    """
    known = known_labels(labels, label_col, modulus, rest, id_col=id_col)
    rows = vectors.select(F.col(id_col).alias("__own"), "x").join(known.hint("merge"), F.col("__own") == F.col("__id"))
    rows = written(rows.select("x", (F.col("y") == 1).cast("int").alias("good")), "quality-labelled")
    return fit(rows)


def score(vectors: DataFrame, model: Ranking, *, keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns `keep` and quality_score (0 to 1) for every row of vectors()."""
    kinds = "".join(f"`{c}` {vectors.schema[c].dataType.simpleString()}, " for c in keep)

    def run(batches):
        for b in tidied(batches):
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(model.score(matrix(b.column("x"))), pa.float64())], [*keep, "quality_score"])

    return vectors.select(*keep, "x").mapInArrow(run, f"{kinds}quality_score double")


def quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """id_col, held_out, score and predicted for every document; see train() and score().

    Each row has its result, repeated rows and null ids (not held out) too;
    null is scored as empty text.  A score of GOOD itself is good.  Empty
    table: no rows.  Other columns are not looked at, whatever their names.
    """
    own = written(vectors(docs, keep=(id_col,)), "quality-features")
    out = score(own, train(own, labels, id_col=id_col), keep=(id_col,))
    return out.select(id_col, held_out(id_col, MODULUS, REST).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= GOOD).cast("int").alias("predicted"))
