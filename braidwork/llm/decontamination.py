"""Benchmark decontamination by winnowing."""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hidden, written
from .spans import LOWER, U64, WORD, covered, pieces, span_hashes, text_buffer, tidied, whole_windows, window_hashes, word_spans

WINDOW = 10
#: Benchmark text that one pass ships to the executors; a larger benchmark takes several passes.
MAX_BROADCAST_BYTES = 16 << 20
#: Document bytes looked at together.
STEP_BYTES = 2 << 20


def words_of(text: str | None) -> list[bytes]:
    raw = LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    starts, ends, _ = word_spans(raw, np.array([0, len(raw)]), WORD)
    data = raw.tobytes()
    return [data[a:b] for a, b in zip(starts.tolist(), ends.tolist())]


def gram(length: int) -> int:
    """Words of a hashed k-gram for windows of `length` words: half of them."""
    return math.ceil(length / 2)


def winnow(h: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """The least k-gram hash within each window of `length` words that starts at `starts`.

    A window holds length - k + 1 k-grams.  Equal windows have equal minima, so
    any shared span of at least `length` words shares a fingerprint.
    """
    k = gram(length)
    grams = window_hashes(h, k, 1)
    low = grams[starts]
    for j in range(1, length - k + 1):
        low = np.minimum(low, grams[starts + j])
    return low


class Index:
    """Fingerprints and exact windows of some benchmark items."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.ids: list[str] = []
        self.windows: dict[int, dict[bytes, list[int]]] = defaultdict(dict)
        prints: dict[int, list[np.ndarray]] = defaultdict(list)
        for item, text in items:
            words = words_of(text)
            if not words:
                continue
            n, at = min(window, len(words)), len(self.ids)
            self.ids.append(item)
            for i in range(len(words) - n + 1):
                own = self.windows[n].setdefault(b" ".join(words[i : i + n]), [])
                if not own or own[-1] != at:
                    own.append(at)
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            ends = np.cumsum(sizes)
            h = span_hashes(np.frombuffer(b"".join(words), np.uint8), ends - sizes, ends)
            prints[n].append(winnow(h, np.arange(len(words) - n + 1), n))
        self.prints = {n: np.unique(np.concatenate(x)) for n, x in prints.items()}
        self.maybe = {}
        for n, x in self.prints.items():
            self.maybe[n] = np.zeros(1 << 20, bool)
            self.maybe[n][(x & U64((1 << 20) - 1)).astype(np.int64)] = True

    def look(self, column: pa.Array):
        """For each text: (number of words, hit spans [start, end), item numbers)."""
        buf, offsets = text_buffer(column)
        for lo, hi in pieces(offsets, STEP_BYTES):
            yield from self._look(LOWER[buf[offsets[lo] : offsets[hi]]], offsets[lo : hi + 1] - offsets[lo])

    def _look(self, buf, offsets):
        starts, ends, first = word_spans(buf, offsets, WORD)
        h = span_hashes(buf, starts, ends)
        data = buf.tobytes()
        hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
        found: dict[int, set[int]] = defaultdict(set)
        for n, prints in self.prints.items():
            at = whole_windows(first, n)
            if not len(at):
                continue
            low = winnow(h, at, n)
            # neighbouring windows mostly share their minimum: look each up once
            fresh = np.ones(len(low), bool)
            fresh[1:] = low[1:] != low[:-1]
            sel = np.flatnonzero(fresh)
            got = self.maybe[n][(low[sel] & U64((1 << 20) - 1)).astype(np.int64)]
            some = np.flatnonzero(got)
            got[some] = np.isin(low[sel[some]], prints)
            if not got.any():
                continue
            run = np.cumsum(fresh) - 1
            cand = at[got[run]]
            rows = np.searchsorted(first, cand, "right") - 1
            for i, row in zip(cand.tolist(), rows.tolist()):
                key = b" ".join([data[starts[j] : ends[j]] for j in range(i, i + n)])
                items = self.windows[n].get(key)
                if items is not None:
                    hits[row].append((i - int(first[row]), n))
                    found[row].update(items)
        for row in range(len(offsets) - 1):
            n_words = int(first[row + 1] - first[row])
            spans: list[tuple[int, int]] = []
            for a, n in sorted(hits[row]) if row in hits else ():
                if spans and a <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], max(spans[-1][1], a + n))
                else:
                    spans.append((a, a + n))
            yield n_words, spans, found.get(row, ())


ADDED = "n_words long, hit_spans array<struct<start:int,end:int>>, items array<string>"
SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _merge(old, new):
    out: list[tuple[int, int]] = []
    for a, b in sorted([(x["start"], x["end"]) for x in old or ()] + list(new)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = WINDOW, max_broadcast_bytes: int = MAX_BROADCAST_BYTES, keep: tuple[str, ...] = (),
) -> DataFrame:
    """Words of every document that lie in a window of a benchmark item.

    Winnowing: from each window of `window` words the least hash of its k-grams
    is kept on both sides, equal fingerprints are joined, and each hit is
    extended to the windows around it, which are compared word by word.  Every
    shared span of `window` words shares a fingerprint, so none is missed.
    Items of fewer words are one window of all their words, with k-grams of
    half that length.

    A map over the documents: nothing is shuffled.  The benchmark's size is
    measured; up to `max_broadcast_bytes` it is shipped to the executors,
    beyond that the documents are passed once for every such part of it.

    Returns id_col and `keep`, n_words, hit_spans (word numbers, merged), items
    (ids of the items with occurring windows, sorted as strings).  Null or
    empty texts have no words and no hits; repeated documents and repeated ids
    each get their own row; items of null id take no part, repeated items count
    once; an empty benchmark hits nothing; other columns are not looked at.
    """
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("body")).where("item is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0))).first()[0]
    parts = max(1, math.ceil(size / max_broadcast_bytes))
    spark = docs.sparkSession
    cols = [id_col, *keep]
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in cols)
    now = docs.select(*cols, F.col(text_col).alias("__text"), F.lit(None).cast("array<struct<start:int,end:int>>").alias("__spans"), F.lit(None).cast("array<string>").alias("__items"))
    for part in range(parts):
        own = items if parts == 1 else items.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == part)
        index = spark.sparkContext.broadcast(Index([(r.item, r.body) for r in own.collect()], window))
        last = part == parts - 1

        def mark(batches, index=index, last=last):
            idx: Index = index.value
            for b in tidied(batches):
                n_words, spans, names = [], [], []
                before = b.column("__spans").to_pylist() if parts > 1 else [None] * b.num_rows
                listed = b.column("__items").to_pylist() if parts > 1 else [None] * b.num_rows
                for (n, s, it), s0, i0 in zip(idx.look(b.column("__text")), before, listed):
                    n_words.append(n)
                    spans.append(_merge(s0, s) if s0 else s)
                    names.append(sorted({*(i0 or ()), *(idx.ids[i] for i in it)}))
                out = [b.column(c) for c in cols]
                arrays = [pa.array([[{"start": a, "end": e} for a, e in s] for s in spans], SPANS), pa.array(names, pa.list_(pa.string()))]
                if last:
                    yield pa.RecordBatch.from_arrays([*out, pa.array(n_words, pa.int64()), *arrays], [*cols, "n_words", "hit_spans", "items"])
                else:
                    yield pa.RecordBatch.from_arrays([*out, b.column("__text"), *arrays], [*cols, "__text", "__spans", "__items"])

        now = now.mapInArrow(mark, f"{kinds}, " + (ADDED if last else "__text string, __spans array<struct<start:int,end:int>>, __items array<string>"))
        if not last:
            now = written(now, "decontaminate")
    return now


def n_hit() -> F.Column:
    return F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]).cast("long"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs, all columns, without the documents that hold a window of the benchmark."""
    own, of = hidden(docs)
    rest = tuple(c for c in own.columns if c != of(id_col))
    out = find_contamination(own, benchmark, id_col=of(id_col), text_col=of(text_col), keep=rest, **options)
    return out.where(F.size("hit_spans") == 0).select(*own.columns).toDF(*docs.columns)
