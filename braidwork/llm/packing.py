"""Vector bin packing of token sequences."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spans import tidied, tidy
from .tokens import encoder

MAX_TOKENS, MAX_SEGMENTS = 1024, 256
END_ID = 0
#: Rests of documents among which the packer chooses.
OPEN_ITEMS = 512


class Packer:
    """Fills bins one after another from the open items.

    An item is a stretch [a, b) of a document.  Its demands are tokens, one
    segment and loss-bearing tokens.  The next item of a bin is the one that
    fits with the greatest dot product of its demands and what the bin has
    left, each over the bin's limit and weighted by the mean demand.  If no
    whole item fits, the item of the greatest product is cut to fit.
    """

    def __init__(self, limits: tuple[int, int, int], open_items: int):
        self.cap = np.array(limits, np.float64)
        self.most = limits
        self.n = 0
        size = open_items + 64
        self.a = np.zeros(size, np.int64)
        self.b = np.zeros(size, np.int64)
        self.lo = np.zeros(size, np.int64)  # loss-bearing tokens of the document: [lo, hi)
        self.hi = np.zeros(size, np.int64)
        self.doc: list = [None] * size
        self.open_items = open_items
        self.total = 0

    def loss(self, a, b, lo, hi):
        return np.maximum(0, np.minimum(b, hi) - np.maximum(a, lo))

    def longest(self, i: int, tokens: int, loss: int) -> int:
        """Tokens from the start of item i within both limits."""
        a, b = int(self.a[i]), int(self.b[i])
        n = min(tokens, b - a)
        if int(self.loss(a, a + n, self.lo[i], self.hi[i])) > loss:
            n = max(a, int(self.lo[i])) + loss - a
        return n

    def add(self, doc, n: int, lo: int, hi: int):
        """Bins that document pieces fill alone; the rest becomes an open item."""
        a = 0
        while n - a >= self.most[0] and self.loss(a, a + self.most[0], lo, hi) <= self.most[2]:
            yield [(doc, a, a + self.most[0])]
            a += self.most[0]
        if n > a:
            i = self.n
            self.a[i], self.b[i], self.lo[i], self.hi[i], self.doc[i] = a, n, lo, hi, doc
            self.n += 1
            self.total += n - a
        while self.n > self.open_items:
            yield self.fill(self.most[0])

    def fill(self, tokens: int) -> list[tuple[object, int, int]]:
        left = [tokens, self.most[1], self.most[2]]
        out = []
        while self.n and left[0] > 0 and left[1] > 0:
            n = self.n
            size = self.b[:n] - self.a[:n]
            loss = self.loss(self.a[:n], self.b[:n], self.lo[:n], self.hi[:n])
            weight = np.array([size.mean(), 1.0, loss.mean()]) / self.cap
            rest = np.array(left) / self.cap * weight
            score = size * (rest[0] / self.cap[0]) + rest[1] / self.cap[1] + loss * (rest[2] / self.cap[2])
            fits = (size <= left[0]) & (loss <= left[2])
            if fits.any():
                i = int(np.argmax(np.where(fits, score, -1.0)))
                take = int(size[i])
            else:
                i = int(np.argmax(score))
                take = self.longest(i, left[0], left[2])
                if take < 1:
                    order = np.argsort(-score, kind="stable").tolist()
                    i, take = next(((j, t) for j in order if (t := self.longest(j, left[0], left[2])) > 0), (-1, 0))
                    if i < 0:
                        break
            a = int(self.a[i])
            got = int(self.loss(a, a + take, self.lo[i], self.hi[i]))
            out.append((self.doc[i], a, a + take))
            left = [left[0] - take, left[1] - 1, left[2] - got]
            self.total -= take
            self.a[i] += take
            if self.a[i] == self.b[i]:
                last = self.n = self.n - 1
                for x in (self.a, self.b, self.lo, self.hi):
                    x[i] = x[last]
                self.doc[i], self.doc[last] = self.doc[last], None
        return out

    def finish(self):
        """Full bins while there are tokens for them, then bins of powers of two, which need no padding."""
        while self.total >= self.most[0]:
            yield self.fill(self.most[0])
        while self.total > 0:
            yield self.fill(1 << (self.total.bit_length() - 1))


def pack(
    docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", prompt_col: str | None = None,
    max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int | None = None, end_id: int = END_ID,
    open_items: int = OPEN_ITEMS, ids: bool = True,
) -> DataFrame:
    """Documents as token sequences of at most max_tokens, one row per piece.

    Each document is its ids by the tokenizer, then end_id.  The loss-bearing
    tokens of a document are its ids after the first `prompt_col` (default 0),
    without end_id.  Vector bin packing (see Packer) keeps every sequence within
    max_tokens, max_segments pieces and max_loss loss-bearing tokens (default:
    max_tokens).  Documents may be cut anywhere; each id lies in one piece.

    A map over the documents: each task packs its own rows, holding at most
    `open_items` rests of documents; nothing is shuffled.  A task's last
    sequences have lengths of powers of two.  sequence_id holds the task's
    number in its upper bits, so it is unique and the same after a retry.

    Null or empty text: just end_id.  Rows that repeat, or share or lack an
    id, are packed as separate documents.  Empty table: no rows.  Special
    tokens of the tokenizer's file that occur in a text become their ids, as
    the library has it by default.  Columns of other names are not looked at.
    """
    limits = (max_tokens, max_segments, max_tokens if max_loss is None else max_loss)
    if min(limits) < 1:
        raise ValueError("each limit must be at least 1")
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"), (F.coalesce(F.col(prompt_col), F.lit(0)) if prompt_col else F.lit(0)).cast("long").alias("p"))

    def run(batches):
        enc = encoder(tokenizer_path)
        packer = Packer(limits, open_items)
        task = TaskContext.get().partitionId() << 36
        seq = 0

        def rows_of(bins):
            nonlocal seq
            got = []
            for b in bins:
                offset = 0
                for (name, tokens), a, e in b:
                    got.append((name, a, e - a, zlib.crc32(tokens[a:e].tobytes()), len(tokens), task + seq, offset, tokens[a:e] if ids else None))
                    offset += e - a
                seq += bool(b)
            return got

        def table(got):
            cols = list(zip(*got))
            arrays = [pa.array(cols[0], id_type), *(pa.array(c, pa.int64()) for c in cols[1:7])]
            if ids:
                arrays.append(pa.array(cols[7], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(arrays, [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * ids])

        id_type = None
        for batch in tidied(batches):
            id_type = batch.schema.field("i").type
            texts = batch.column("t")
            got = []
            for at in range(0, batch.num_rows, 400):
                part = texts.slice(at, 400).to_pylist()
                names = batch.column("i").slice(at, 400).to_pylist()
                prompts = batch.column("p").slice(at, 400).to_pylist()
                for name, x, p in zip(names, enc.encode(part), prompts):
                    tokens = np.append(x, np.int32(end_id)).astype("<u4")
                    got += rows_of(packer.add((name, tokens), len(tokens), max(0, min(p, len(tokens) - 1)), len(tokens) - 1))
                if got:
                    yield table(got)
                    got = []
        enc.forget()  # workers are reused by later stages
        tidy()
        got = rows_of(packer.finish())
        if got:
            yield table(got)

    return rows.mapInArrow(run, f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * ids)
