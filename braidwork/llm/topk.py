"""Exact top-k search by a bit-sliced index."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BLOCK = 1 << 16
#: Queries that meet a block in one task: at most so many, and not fewer than LEAST_QUERIES for the sake of more tasks.
QUERIES_PER_BLOCK, LEAST_QUERIES = 1 << 14, 128
#: The default bound of quantised components.
LIMIT = 1 << 24
LONG = (-(1 << 63), (1 << 63) - 1)


class SlicedBlock:
    """Bitmaps over the rows of a block: one for each binary digit of each attribute.

    Attribute d is held as the unsigned number x_d - min_d of `width` digits,
    and also as its complement for negative weights, so that every weighted
    sum has terms of one sign.  x holds int64 numbers, or Python's own where
    those don't suffice; sums are exact at any size.
    """

    def __init__(self, x: np.ndarray):
        self.n, self.dims = x.shape
        self.low = x.min(axis=0) if self.n else np.zeros(self.dims, np.int64)
        u = x - self.low
        self.width = max(1, int(u.max()).bit_length()) if u.size else 1
        words = (self.n + 63) // 64
        self.full = self.pack(np.ones(self.n, bool), words)
        self.slices = np.empty((2, self.dims, self.width, words), np.uint64)
        for d in range(self.dims):
            for b in range(self.width):
                s = self.pack((u[:, d] >> b) & 1, words)
                self.slices[0, d, b] = s
                self.slices[1, d, b] = s ^ self.full

    @staticmethod
    def pack(bits: np.ndarray, words: int) -> np.ndarray:
        out = np.zeros(words * 8, np.uint8)
        raw = np.packbits(bits.astype(bool), bitorder="little")
        out[: len(raw)] = raw
        return out.view(np.uint64)

    def scores(self, q: np.ndarray) -> tuple[list[np.ndarray], int]:
        """(slices of the weighted sum from the least digit, the constant that was left out).

        The slices of each weight's binary digits are added by carry-save
        adders: three bitmaps of one digit become one and a carry.
        """
        columns: list[list[np.ndarray]] = []
        left_out = sum(a * b for a, b in zip(q.tolist(), self.low.tolist()))
        for d, w in enumerate(q.tolist()):
            side = 0
            if w < 0:  # w u = -w ~u + w (2^width - 1)
                left_out += w * ((1 << self.width) - 1)
                w, side = -w, 1
            digit = 0
            while w:
                if w & 1:
                    for b in range(self.width):
                        while len(columns) <= digit + b:
                            columns.append([])
                        columns[digit + b].append(self.slices[side, d, b])
                w >>= 1
                digit += 1
        out, at = [], 0
        while at < len(columns):
            col = columns[at]
            if len(col) > 1 and at + 1 == len(columns):
                columns.append([])
            while len(col) > 2:
                a, b, c = col.pop(), col.pop(), col.pop()
                half = a ^ b
                carry = a & b
                carry |= half & c
                half ^= c
                col.insert(0, half)
                columns[at + 1].append(carry)
            if len(col) == 2:
                a, b = col
                columns[at + 1].append(a & b)
                col = [a ^ b]
            out.append(col[0] if col else np.zeros_like(self.full))
            at += 1
        return out, left_out

    def top(self, q: np.ndarray, k: int, skip: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
        """The k greatest (score, id), ties to the smaller id, without the rows `skip`.

        From the most significant slice downward the rows that are surely among
        the k greatest are kept and the rows on the boundary narrowed; what is
        left on the boundary is equal in score and resolved by id.
        """
        slices, left_out = self.scores(q)
        open_ = self.full.copy()
        for r in skip.tolist():
            open_[r >> 6] &= ~np.uint64(1 << (r & 63))
        sure = np.zeros_like(open_)
        n_sure, n_open = 0, int(np.bitwise_count(open_).sum())
        for s in reversed(slices):
            if n_sure + n_open <= k:
                break
            ones = open_ & s
            n = int(np.bitwise_count(ones).sum())
            if n_sure + n >= k:
                open_, n_open = ones, n
            else:
                sure |= ones
                n_sure += n
                open_ ^= ones
                n_open -= n

        def rows(bitmap):
            return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little", count=self.n))

        edge = rows(open_)
        edge = edge[np.argsort(ids[edge], kind="stable")]
        if n_sure + n_open > k:
            edge = edge[: k - n_sure]
        got = np.concatenate([rows(sure), edge])
        total = np.zeros(len(got), object)
        for b, s in enumerate(slices):
            total += ((s[got >> 6] >> (got & 63).astype(np.uint64)) & np.uint64(1)).astype(object) * (1 << b)
        found = [(int(t) + left_out, int(ids[r])) for t, r in zip(total, got.tolist())]
        return sorted(found, key=lambda x: (-x[0], x[1]))


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors as rows of whole numbers, shorter ones filled with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.asarray(column.value_lengths())
    flat = np.asarray(column.flatten())
    flat = np.array([int(x) for x in flat.tolist()], object) if flat.dtype.kind == "f" else flat.astype(np.int64)
    dims = int(lengths.max()) if len(lengths) else 0
    if len(lengths) and (lengths == dims).all():
        return flat.reshape(len(column), dims)
    out = np.zeros((len(column), dims), flat.dtype)
    at = 0
    for i, n in enumerate(lengths.tolist()):
        out[i, :n] = flat[at : at + n]
        at += n
    return out


def beyond(score: int) -> bytes:
    """What orders scores that don't fit a long, in bytes that sort as they do."""
    if LONG[0] <= score <= LONG[1]:
        return b"\x01"
    size = abs(score).to_bytes((abs(score).bit_length() + 7) // 8, "big")
    key = len(size).to_bytes(2, "big") + size
    return b"\x02" + key if score > 0 else b"\x00" + bytes(255 - x for x in key)


def layout(n: int, n_queries: int, rows_per_block: int, queries_per_block: int, cores: int) -> tuple[int, int]:
    """(blocks of rows, groups of queries): more groups than queries_per_block asks for only while there are fewer tasks than twice the cores."""
    blocks = max(1, math.ceil(n / rows_per_block))
    return blocks, max(1, math.ceil(n_queries / queries_per_block), min(math.ceil(n_queries / LEAST_QUERIES), math.ceil(2 * cores / blocks)))


def top_k(
    vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 256.0, k: int = 5, query_modulus: int = 50,
    rows_per_block: int = ROWS_PER_BLOCK, queries_per_block: int = QUERIES_PER_BLOCK, bound: int | None = LIMIT,
) -> DataFrame:
    """The k greatest integer inner products of every query with all other rows, exactly.

    Components are quantised to floor(scale * x) and, unless `bound` is None,
    held within it.  Queries are the rows whose id is divisible by
    query_modulus.  All rows are dealt by a hash into blocks of about
    rows_per_block, the queries into groups of at most about queries_per_block;
    a block meets a group in one task, by an equi-join on both numbers, builds
    a bit-sliced index of its rows and takes its own k greatest for each query.
    The k greatest of all follow from those.  Rows travel once for each group
    and queries once for each block, so the exchange is n * q * (1 /
    queries_per_block + 1 / rows_per_block) vectors of the smallest whole
    numbers that hold them; up to queries_per_block queries it grows with n.
    Only the numbers of rows and queries and the greatest component come to the
    driver, nothing is broadcast, and a task holds one block and one group.

    Vectors that are null or hold a null or non-finite component, and rows of
    null id, take no part.  Rows that repeat an id and a vector count as one;
    rows of one id and other vectors are each a candidate, and each a query.
    Shorter vectors are filled with zeros; an empty one scores 0.  Ties go to
    the smaller id.  A query with fewer than
    k other rows gets them all.  Without bound, scores beyond a long are ranked
    exactly and given as the greatest or least long.

    Returns query_id, rank (from 1), vec_id, score.
    """
    q = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    q = q.where("id is not null and v is not null").where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    most = float(np.finfo(np.float64).max) if bound is None else float(bound)

    def whole(x):  # a double is whole from 2**52 on
        y = x * scale
        y = F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y)
        return F.least(F.greatest(y, F.lit(-most)), F.lit(most))

    q = q.select("id", F.transform("v", whole).alias("v"))
    size = F.aggregate("v", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
    n, n_queries, top = q.select(F.count(F.lit(1)), F.count_if(F.col("id") % query_modulus == 0), F.coalesce(F.max(size), F.lit(0.0))).first()
    kind = next((t for t, b in (("smallint", 15), ("int", 31), ("bigint", 62)) if top < 2.0**b), "double")
    rows = q.select("id", F.col("v").cast(f"array<{kind}>").alias("v")).dropDuplicates(["id", "v"])
    blocks, groups = layout(n, n_queries, rows_per_block, queries_per_block, vectors.sparkSession.sparkContext.defaultParallelism)
    left = rows.select("id", "v", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"))
    right = rows.where(F.col("id") % query_modulus == 0).select(
        "id", "v", F.md5(F.concat_ws(",", F.col("v").cast("array<string>"))).alias("which"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
        F.pmod(F.xxhash64("id", "v", F.lit(1)), F.lit(groups)).cast("int").alias("grp"),
    )

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if a.num_rows and b.num_rows:
            rows, weights = _matrix(a.column("v")), _matrix(b.column("v"))
            dims = max(rows.shape[1], weights.shape[1])
            rows, weights = (np.pad(m, ((0, 0), (0, dims - m.shape[1]))) for m in (rows, weights))
            ids = np.asarray(a.column("id"))
            order = np.argsort(ids, kind="stable")
            for lo in range(0, len(ids), 2 * rows_per_block):
                part = order[lo : lo + 2 * rows_per_block]
                own, mine = ids[part], rows[part]
                block = SlicedBlock(mine)
                for w, name, which in zip(weights, b.column("id").to_pylist(), b.column("which").to_pylist()):
                    i, j = np.searchsorted(own, name), np.searchsorted(own, name, "right")
                    skip = i + np.flatnonzero((mine[i:j] == w).all(axis=1))
                    out += [(name, which, i, min(max(s, LONG[0]), LONG[1]), beyond(s)) for s, i in block.top(w, k, skip, own)]
        c = list(zip(*out)) or [()] * 5
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
        return pa.table([pa.array(v, t) for v, t in zip(c, kinds)], ["query_id", "which", "vec_id", "score", "beyond"])

    near = left.groupBy("block", "grp").cogroup(right.groupBy("block", "grp")).applyInArrow(meet, "query_id long, which string, vec_id long, score long, beyond binary")
    best = Window.partitionBy("query_id", "which").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
