"""Removal of repeated word windows, with a count-min prefilter."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from .spans import NOT_SPACE, U64, covered, mix, pieces, span_hashes, text_buffer, tidy, whole_windows, window_hashes, word_spans

WINDOW_WORDS = 20
#: Text bytes of one chunk of documents, which one task handles at a time.
CHUNK_BYTES = 8 << 20
#: Rows of the sketch, and cells of each for a byte of text.
DEPTH, CELLS_PER_BYTE = 2, 0.75
STEP_BYTES = 1 << 20
NULL_ID = np.iinfo(np.int64).max


def squeeze(values: np.ndarray) -> bytes:
    """Sorted or small unsigned numbers as compressed byte planes."""
    v = np.ascontiguousarray(values.astype("<u8"))
    top = int(v.max()) if len(v) else 0
    width = max(1, (top.bit_length() + 7) // 8)
    planes = np.ascontiguousarray(v.view(np.uint8).reshape(-1, 8)[:, :width].T)
    raw = planes.tobytes()
    return len(v).to_bytes(4, "little") + bytes([width]) + pa.compress(raw, codec="zstd", asbytes=True)


def unsqueeze(data: bytes) -> np.ndarray:
    n, width = int.from_bytes(data[:4], "little"), data[4]
    raw = pa.decompress(data[5:], decompressed_size=n * width, codec="zstd", asbytes=True) if n else b""
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, n).T
    return out.reshape(-1).view("<u8").astype(U64)


def squeeze_sorted(values: np.ndarray) -> bytes:
    return squeeze(np.diff(values, prepend=U64(0)))


def unsqueeze_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(data), dtype=U64)


class Chunk:
    """The rows of one chunk in the order of (id, text), with the hashes of their windows."""

    def __init__(self, table: pa.Table, window: int, second: bool = False):
        ids = table.column("i").combine_chunks()
        table = table.set_column(0, "i", ids.fill_null(NULL_ID) if ids.null_count else ids)
        table = table.sort_by([("i", "ascending"), ("t", "ascending")]).combine_chunks()
        self.table = table
        self.ids = np.asarray(table.column("i"))
        self.texts = table.column("t")
        self.window = window
        h1, h2, rows, starts, counts = [], [], [], [], []
        buf, offsets = text_buffer(self.texts)
        for lo, hi in pieces(offsets, STEP_BYTES):
            own = buf[offsets[lo] : offsets[hi]]
            s, e, first = word_spans(own, offsets[lo : hi + 1] - offsets[lo], NOT_SPACE)
            counts.append(np.diff(first))
            at = whole_windows(first, window)
            if not len(at):
                continue
            h1.append(window_hashes(span_hashes(own, s, e), window)[at])
            if second:
                h2.append(window_hashes(span_hashes(own, s, e, 1), window, 1)[at])
            row = np.searchsorted(first, at, "right") - 1
            rows.append((row + lo).astype(np.int64))
            starts.append(at - first[row])
        cat = lambda x, t: np.concatenate(x) if x else np.empty(0, t)
        self.h1, self.h2 = cat(h1, U64), cat(h2, U64)
        self.rows, self.starts, self.counts = cat(rows, np.int64), cat(starts, np.int64), cat(counts, np.int64)


def cells(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    return mix(h, 0x5851F42D4C957F2D * (row + 1) % (1 << 64)) >> U64(64 - bits)


def repeated_words(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW_WORDS, chunk_bytes: int = CHUNK_BYTES,
    depth: int = DEPTH, cells_per_byte: float = CELLS_PER_BYTE, result: str = "digest", keep: tuple[str, ...] = (),
) -> DataFrame:
    """Removes each word that a window of `window` words covers whose words also start earlier.

    Earlier is a smaller id, or the same row further left; windows are judged
    on the input.  The documents are dealt into chunks by a hash, once; all
    steps below work on these same chunks.

    1. Each chunk makes a partial count-min sketch of its windows: for each of
       `depth` rows the cells that it hits, once or more often.
    2. The partial sketches are merged cell range by cell range, counts added,
       and each chunk is told which of its own cells hold two or more.  No task
       and no driver ever holds a whole sketch, so it grows with the corpus.
    3. Each chunk looks its windows up.  The least count over the rows is never
       below the truth, so a window that occurs twice is never missed; what is
       estimated repeated is dealt by hash range and grouped exactly by 128-bit
       keys, and every occurrence but the first is told to its chunk.
    4. Each chunk removes the words that these windows cover.

    Words are cut at ASCII white space.  Null text: no words.  Rows of null id
    come after all others.  Rows that repeat an id and a text are at the same
    place, so neither is earlier; rows of one id and other texts also count as
    one place each.  A text without removals is kept as it is.  Empty table: no
    rows.  Other columns are not looked at, but those in `keep` are passed on.

    result "digest": id_col, n_words, n_removed, kept_sha256; "text": id_col,
    keep, text_col with the kept words joined by one blank if any went, n_removed.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    chunks = max(1, math.ceil(size / chunk_bytes))
    bits = max(10, math.ceil(math.log2(max(1.0, size * cells_per_byte))))
    spread = min(bits, max(0, math.ceil(math.log2(chunks))))  # cell ranges and key ranges: about as many as chunks
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"), *(F.col(c).alias(f"k_{n}") for n, c in enumerate(keep)))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("i", "t"), F.lit(chunks)).cast("int"))
    dealt = rows.groupBy("chunk")
    SKETCH = "chunk int, line int, part int, cells binary"

    def sketch(table):
        tidy()
        name = table.column("chunk")[0].as_py()
        own = Chunk(table, window)
        out: list[tuple] = []
        for line in range(depth):
            c, n = np.unique(cells(own.h1, line, bits), return_counts=True)
            v = (c << U64(1)) | (n > 1).astype(U64)
            part = (c >> U64(bits - spread)).astype(np.int64)
            cut = np.flatnonzero(np.diff(part, prepend=-1)) if len(part) else []
            for a, b in zip(cut, [*cut[1:], len(part)]):
                out.append((name, line, int(part[a]), squeeze_sorted(v[a:b])))
        return _table(out)

    def merge(key, table):
        tidy()
        own = [unsqueeze_sorted(x) for x in table.column("cells").to_pylist()]
        v = np.sort(np.concatenate(own))
        c = v >> U64(1)
        # a cell is full if a chunk hits it twice or two chunks hit it
        two = (v & U64(1)).astype(bool)
        same = c[1:] == c[:-1]
        two[1:] |= same
        two[:-1] |= same
        full = np.unique(c[two])
        out = []
        for name, x in zip(table.column("chunk").to_pylist(), own):
            hit = x >> U64(1)
            hit = hit[np.isin(hit, full, assume_unique=True)] if len(full) else hit[:0]
            if len(hit):
                out.append((name, key[0].as_py(), key[1].as_py(), squeeze_sorted(hit)))
        return _table(out)

    def _table(out):
        c = list(zip(*out)) or [(), (), (), ()]
        return pa.table([pa.array(c[0], pa.int32()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.int32()), pa.array(c[3], pa.binary())], ["chunk", "line", "part", "cells"])

    told = dealt.applyInArrow(sketch, SKETCH).groupBy("line", "part").applyInArrow(merge, SKETCH)

    def candidates(table: pa.Table, full: pa.Table) -> pa.Table:
        tidy()
        out: list[tuple] = []
        if table.num_rows and full.num_rows:
            name = table.column("chunk")[0].as_py()
            own = Chunk(table, window, True)
            lines: list[list] = [[] for _ in range(depth)]
            for line, part, data in zip(*(full.column(c).to_pylist() for c in ("line", "part", "cells"))):
                lines[line].append((part, data))
            ok = np.ones(len(own.h1), bool)
            for line, got in enumerate(lines):
                c = cells(own.h1, line, bits)
                known = np.concatenate([unsqueeze_sorted(d) for _, d in sorted(got)]) if got else np.empty(0, U64)
                at = np.searchsorted(known, c)
                at[at == len(known)] = 0
                ok &= (known[at] == c) if len(known) else False
            k1, k2 = own.h1[ok], own.h2[ok]
            order = np.argsort(k1)
            k1, k2, r, s = k1[order], k2[order], own.rows[ok][order], own.starts[ok][order]
            part = (k1 >> U64(64 - spread)).astype(np.int64) if spread else np.zeros(len(k1), np.int64)
            cut = np.flatnonzero(np.diff(part, prepend=-1)) if len(part) else []
            for a, b in zip(cut, [*cut[1:], len(part)]):
                ids = own.ids[r[a:b]].view(U64) ^ U64(1 << 63)  # keeps the order of signed numbers
                low = ids.min()
                out.append((name, int(part[a]), squeeze_sorted(k1[a:b]), squeeze(k2[a:b]), int(low.view(np.int64)), squeeze(ids - low), squeeze(r[a:b].astype(U64)), squeeze(s[a:b].astype(U64))))
        c = list(zip(*out)) or [()] * 8
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.table([pa.array(v, k) for v, k in zip(c, kinds)], ["chunk", "part", "k1", "k2", "low", "ids", "rows", "starts"])

    asked = dealt.cogroup(told.groupBy("chunk")).applyInArrow(candidates, "chunk int, part int, k1 binary, k2 binary, low long, ids binary, rows binary, starts binary")

    def resolve(key, table):
        tidy()
        names = table.column("chunk").to_pylist()
        k1 = [unsqueeze_sorted(x) for x in table.column("k1").to_pylist()]
        k2 = [unsqueeze(x) for x in table.column("k2").to_pylist()]
        ids = [unsqueeze(x) + np.int64(low).view(U64) for x, low in zip(table.column("ids").to_pylist(), np.array(table.column("low").to_pylist(), np.int64))]
        starts = [unsqueeze(x) for x in table.column("starts").to_pylist()]
        place = np.repeat(np.arange(len(names)), [len(x) for x in k1])
        a, b, i, s = (np.concatenate(x) for x in (k1, k2, ids, starts))
        order = np.lexsort((s, i, b, a))
        a, b, i, s = a[order], b[order], i[order], s[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        head = np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))
        later = np.empty(len(a), bool)
        later[order] = (i != i[head]) | (s != s[head])
        out, at = [], 0
        for n, name, x, y in zip(range(len(names)), names, table.column("rows").to_pylist(), starts):
            mark = later[at : at + len(k1[n])]
            at += len(k1[n])
            if mark.any():
                v = np.sort((unsqueeze(x)[mark] << U64(36)) | y[mark])
                out.append((name, squeeze_sorted(v)))
        c = list(zip(*out)) or [(), ()]
        return pa.table([pa.array(c[0], pa.int32()), pa.array(c[1], pa.binary())], ["chunk", "marks"])

    marks = asked.groupBy("part").applyInArrow(resolve, "chunk int, marks binary")
    digest = result == "digest"

    def remove(table: pa.Table, told: pa.Table) -> pa.Table:
        tidy()
        if not table.num_rows:
            return pa.table([pa.array([], f.type) for f in arrow], [f.name for f in arrow])
        ids = table.column("i").combine_chunks()
        order = pa.compute.sort_indices(pa.table({"i": ids.fill_null(NULL_ID), "t": table.column("t")}), [("i", "ascending"), ("t", "ascending")])
        table = table.take(order).combine_chunks()
        v = np.concatenate([unsqueeze_sorted(x) for x in told.column("marks").to_pylist()]) if told.num_rows else np.empty(0, U64)
        v.sort()
        row, start = (v >> U64(36)).astype(np.int64), (v & U64((1 << 36) - 1)).astype(np.int64)
        bound = np.searchsorted(row, np.arange(table.num_rows + 1))
        n_words, n_removed, kept = [], [], []
        for n, t in enumerate(table.column("t").to_pylist()):
            words = t.encode().split() if t else []
            a, b = bound[n], bound[n + 1]
            gone = 0
            if b > a:
                out = covered(len(words), start[a:b], window)
                gone = int(out.sum())
                words = [w for w, x in zip(words, out.tolist()) if not x]
            n_words.append(len(words) + gone)
            n_removed.append(gone)
            if digest:
                kept.append(hashlib.sha256(b" ".join(words)).hexdigest())
            else:
                kept.append(b" ".join(words).decode() if gone else t)
        if digest:
            return pa.table([table.column("i"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["i", "n_words", "n_removed", "kept_sha256"])
        extra = [f"k_{n}" for n in range(len(keep))]
        return pa.table([table.column("i"), pa.array(kept, pa.string()), *(table.column(c) for c in extra), pa.array(n_removed, pa.int64())], ["i", "t", *extra, "n_removed"])

    if digest:
        schema = "i long, n_words long, n_removed long, kept_sha256 string"
    else:
        schema = "i long, t string, " + "".join(f"k_{n} {docs.schema[c].dataType.simpleString()}, " for n, c in enumerate(keep)) + "n_removed long"
    arrow = to_arrow_schema(_parse_datatype_string(schema))
    out = dealt.cogroup(marks.groupBy("chunk")).applyInArrow(remove, schema)
    if digest:
        return out.select(F.col("i").cast(kind).alias(id_col), "n_words", "n_removed", "kept_sha256")
    return out.select(F.col("i").cast(kind).alias(id_col), F.col("t").alias(text_col), *(F.col(f"k_{n}").alias(c) for n, c in enumerate(keep)), "n_removed")
