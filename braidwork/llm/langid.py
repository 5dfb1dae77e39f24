"""Language identification: the family first, then pairwise linear machines within it."""

from __future__ import annotations

import math
import pickle
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .learning import first_of_each, held_out, remainder
from .spans import pieces, text_buffer, tidied

DIM = 4096
#: Training uses at most so many documents of each language.
PER_LANGUAGE = 500
MODULUS, REST = 5, 0
EPOCHS, SEED, PENALTY = 30, 11, 1e-4
STEP_BYTES = 1 << 20
#: Texts whose features are held at once.
STEP_TEXTS = 128
LETTER = re.compile(r"[^\W\d_]")

#: Bytes of letters in lower case; all others are blanks.
FOLD = np.full(256, 0x20, np.uint8)
FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
FOLD[0x80:] = np.arange(0x80, 0x100)


def features(column: pa.Array):
    """For a stretch of texts: rows of hashed counts of two and three letters in turn, square roots, of length one."""
    buf, offsets = text_buffer(column)
    for lo, hi in pieces(offsets, STEP_BYTES):
        for a in range(lo, hi, STEP_TEXTS):
            b = min(a + STEP_TEXTS, hi)
            own = FOLD[buf[offsets[a] : offsets[b]]].astype(np.uint32)
            row = np.repeat(np.arange(b - a), np.diff(offsets[a : b + 1]))
            out = np.zeros((b - a) * DIM, np.float32)
            for n, scale in ((2, 0x9E3779B1), (3, 0x85EBCA77)):
                if len(own) < n:
                    continue
                code = own[n - 1 :].copy()
                solid = own[n - 1 :] != 0x20
                for j in range(1, n):
                    part = own[n - 1 - j : len(own) - j]
                    code |= part << np.uint32(8 * j)
                    if j == 1:
                        solid |= part != 0x20
                ok = solid & (row[n - 1 :] == row[: len(row) - n + 1])
                cell = ((code[ok] * np.uint32(scale)) >> np.uint32(32 - 12)).astype(np.int64)
                out += np.bincount(row[n - 1 :][ok] * DIM + cell, minlength=len(out)).astype(np.float32)
            m = np.sqrt(out.reshape(b - a, DIM))
            norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
            yield m / np.maximum(norm, 1e-9)


def svm(x: np.ndarray, y: np.ndarray, rng) -> np.ndarray:
    """A linear machine by stochastic steps on the hinge loss; classes weigh the same. y: -1 or 1. The last column of x is 1 and its weight the bias."""
    w, mean = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y)
    t = n = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(x))
        for a in range(0, len(order), 16):
            rows = order[a : a + 16]
            t += 1
            rate = 4.0 / (1 + 0.02 * t)
            bad = y[rows] * (x[rows] @ w) < 1
            w *= 1 - rate * PENALTY
            if bad.any():
                r = rows[bad]
                w += rate / len(rows) * ((weight[r] * y[r]) @ x[r]).astype(np.float32)
            if epoch >= EPOCHS // 2:
                mean += w
                n += 1
    return (mean / max(1, n)).astype(np.float32)


def families(centres: np.ndarray) -> list[list[int]]:
    """Languages by average-link clustering of their centres, down to the square root of their number."""
    groups = [[i] for i in range(len(centres))]
    near = centres @ centres.T
    while len(groups) > max(1, math.ceil(math.sqrt(len(centres)))):
        best = max(((near[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j), key=lambda t: (t[0], -t[1], -t[2]))
        groups[best[1]] += groups.pop(best[2])
    return groups


def names_of(model: "Model", texts: pa.Array) -> list[str]:
    """The predicted language of each text, "und" as in identify()."""
    out: list[str] = []
    for x in features(texts):
        own = texts.slice(len(out), len(x)).to_pylist()
        out += [model.names[k] if k >= 0 and t and LETTER.search(t) else "und" for k, t in zip(model.predict(x)[0].tolist(), own)]
    return out


class Model:
    def __init__(self, names: list[str], groups: list[list[int]], family: np.ndarray, pairs: dict):
        self.names, self.groups = names, groups
        self.family = family  # a row for each family, one against the rest
        self.pairs = [(f, a, b) for f, a, b in pairs]
        self.pair_w = np.array([pairs[k] for k in self.pairs], np.float32).reshape(len(self.pairs), DIM + 1)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the language, score): score is the chance of the family times that within it."""
        n = len(x)
        if not self.names:
            return np.full(n, -1), np.zeros(n)
        if len(self.groups) > 1:
            z = 3 * (x @ self.family[:, :-1].T + self.family[:, -1])
            e = np.exp(z - z.max(axis=1, keepdims=True))
            fam, chance = z.argmax(axis=1), e.max(axis=1) / e.sum(axis=1)
        else:
            fam, chance = np.zeros(n, int), np.ones(n)
        out, sure = np.zeros(n, int), np.ones(n)
        margin = x @ self.pair_w[:, :-1].T + self.pair_w[:, -1]
        for f, group in enumerate(self.groups):
            rows = np.flatnonzero(fam == f)
            if len(group) == 1:
                out[rows] = group[0]
                continue
            # votes of the pairs, the sums of margins decide between equal votes
            votes = np.zeros((len(rows), len(group)))
            at = {lang: i for i, lang in enumerate(group)}
            for k, (g, a, b) in enumerate(self.pairs):
                if g == f:
                    m = margin[rows, k]
                    votes[:, at[a]] += (m > 0) + 0.01 * np.tanh(m)
                    votes[:, at[b]] += (m <= 0) - 0.01 * np.tanh(m)
            top = votes.argmax(axis=1)
            out[rows] = np.array(group)[top]
            low = np.full(len(rows), np.inf)
            for k, (g, a, b) in enumerate(self.pairs):
                if g == f:
                    own = out[rows]
                    low = np.where(own == a, np.minimum(low, margin[rows, k]), np.where(own == b, np.minimum(low, -margin[rows, k]), low))
            sure[rows] = 1 / (1 + np.exp(-3 * np.clip(low, -10, 10)))
        return out, chance * sure


def fit(got: pa.Table) -> Model:
    """The machines of got(x binary, y string): DIM features as 16-bit floats and the language of each text."""
    got = got.sort_by([("y", "ascending"), ("x", "ascending")])
    label = np.array(got.column("y").to_pylist(), object)
    names = sorted(set(label.tolist()))
    if not names:
        return Model([], [], np.zeros((0, DIM + 1), np.float32), {})
    x = np.ones((len(label), DIM + 1), np.float32)
    x[:, :-1] = text_buffer(got.column("x"))[0].view(np.float16).reshape(-1, DIM)
    del got
    y = np.array([names.index(v) for v in label])
    centres = np.stack([x[y == i, :-1].mean(axis=0) for i in range(len(names))])
    common = centres.mean(axis=0)
    centres = centres - common if len(names) > 2 else centres
    groups = families(centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9))
    rng = np.random.default_rng(SEED)
    family = np.zeros((len(groups), DIM + 1), np.float32)
    pairs = {}
    for f, group in enumerate(groups):
        inside = np.isin(y, group)
        if len(groups) > 1:
            family[f] = svm(x, np.where(inside, 1.0, -1.0), rng)
        for i, a in enumerate(group):
            for b in group[i + 1 :]:
                rows = np.flatnonzero((y == a) | (y == b))
                pairs[f, a, b] = svm(x[rows], np.where(y[rows] == a, 1.0, -1.0), rng)
    return Model(names, groups, family, pairs)


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, modulus: int = MODULUS, rest: int = REST) -> Model:
    """Fit the machines, in numpy in one task, to at most per_language documents of each language.

    Only the machines come to the driver: the features of the sample, and what
    the fit makes of them, are larger than all else that it holds.  Documents
    of null id, lang or text are left out, repeated rows are used as often as
    they occur; without documents nothing is learned.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (remainder(id_col, modulus) != rest))
    ids, _ = first_of_each(rows.select(F.col(id_col).alias("__id"), F.col(lang_col).alias("y")), per_language)
    ids = ids.distinct()
    own = rows.select(F.col(id_col).alias("__own"), F.col(lang_col).alias("__lang"), F.col(text_col).alias("text"))
    own = own.join(F.broadcast(ids), (F.col("__own") == F.col("__id")) & (F.col("__lang") == F.col("y"))).select("text", "y")

    def run(batches):
        for b in batches:
            x = np.concatenate(list(features(b.column("text"))) or [np.zeros((0, DIM), np.float32)])
            has = np.array([bool(t and LETTER.search(t)) for t in b.column("text").to_pylist()], bool)
            yield pa.RecordBatch.from_arrays([pa.array([r.astype(np.float16).tobytes() for r in x[has]], pa.binary()), b.column("y").filter(pa.array(has, pa.bool_()))], ["x", "y"])

    def learn(batches):
        held = list(tidied(batches))
        if held:
            got = pa.Table.from_batches(held)
            del held
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(got))], pa.binary())], ["model"])

    # the sample is bounded, and so is the one task
    got = own.mapInArrow(run, "x binary, y string").repartition(1).mapInArrow(learn, "model binary").toArrow().column("model").to_pylist()
    return pickle.loads(got[0]) if got else fit(pa.table({"x": pa.array([], pa.binary()), "y": pa.array([], pa.string())}))


def identify(docs: DataFrame, model: Model, *, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns `keep`, lang_pred and lang_score for every row, by its whole text.

    Null texts and texts without a letter, and all texts if nothing was
    learned: "und", score 0.
    """
    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few machines of DIM weights

    def run(batches):
        m: Model = sent.value
        for b in batches:
            texts = b.column("__text")
            lang, score = [], []
            for x in features(texts):
                k, s = m.predict(x)
                lang.append(k)
                score.append(s)
            lang, score = (np.concatenate(v) if v else np.empty(0, int) for v in (lang, score))
            has = np.array([bool(t and LETTER.search(t)) for lo in range(0, len(texts), 500) for t in texts.slice(lo, 500).to_pylist()], bool) & (lang >= 0)
            names = [m.names[k] if ok else "und" for k, ok in zip(lang.tolist(), has.tolist())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(names, pa.string()), pa.array(np.where(has, score, 0.0), pa.float64())], [*keep, "lang_pred", "lang_score"])

    return docs.select(*keep, F.col(text_col).alias("__text")).mapInArrow(run, f"{kinds}lang_pred string, lang_score double")


def languages(docs: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """id_col, held_out, lang_pred and score for every document; see train() and identify().

    Each row has its result, repeated rows too; equal votes go to the language
    that is first by name.  Null id: not held out.  Empty table: no rows.
    Other columns are not looked at, whatever their names.
    """
    out = identify(docs, train(docs, id_col=id_col), keep=(id_col,))
    return out.select(id_col, held_out(id_col, MODULUS, REST).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
