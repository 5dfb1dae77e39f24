"""Vectorised words and hashes over the bytes of an Arrow text column.

Texts are looked at as one UTF-8 byte buffer.  Word spans come from a table of
byte classes; hashes of spans are made for all spans together, so no Python
object is made per word.
"""

from __future__ import annotations

import ctypes
import numpy as np
import pyarrow as pa

U64 = np.uint64
#: A factor and the salts of the two hashes.
STEP = 0x9E3779B97F4A7C15
SALTS = (0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7)
#: Bytes of a span that are hashed together with other spans.
LONG = 128
#: What is kept of eight bytes of which only the first n belong to a span.
TAILS = np.array([(1 << (8 * n)) - 1 for n in range(9)], U64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words cut at ASCII white space.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

#: Bytes of words of lower-cased text: digits, a-z and everything beyond ASCII.
WORD = np.zeros(256, bool)
WORD[0x30:0x3A] = WORD[0x61:0x7B] = WORD[0x80:] = True


def tidy() -> None:
    """Give freed memory back: workers are reused by later stages, whose memory adds to what is kept."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def tidied(batches):
    """The batches, with freed memory given back after each and at the end."""
    try:
        for b in batches:
            yield b
            del b
            tidy()
    finally:
        tidy()


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    column = column.cast(pa.large_binary())
    n = len(column)
    _, off, data = column.buffers()
    if n == 0 or off is None:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(off, np.int64, n + 1, column.offset * 8)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    if column.null_count:
        keep = np.asarray(column.is_valid())
        size = np.where(keep, np.diff(offsets), 0)
        if size.sum() != offsets[-1] - offsets[0]:  # bytes below a null: leave them out
            buf = np.concatenate([buf[a : a + s] for a, s in zip(offsets[:-1], size)] or [buf[:0]])
            return buf, np.concatenate([[0], np.cumsum(size)])
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, most: int):
    """(first, last) row ranges of about `most` bytes; one longer row stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


def word_spans(buf: np.ndarray, offsets: np.ndarray, table: np.ndarray):
    """(starts, ends, first): byte spans of the words, and the first word of each row (with the end)."""
    inside = table[buf]
    cut = np.zeros(len(buf) + 1, bool)
    cut[offsets[offsets <= len(buf)]] = True
    before = np.empty(len(buf), bool)
    if len(buf):
        before[0], before[1:] = False, inside[:-1]
    begin = inside & (~before | cut[:-1])
    after = np.empty(len(buf), bool)
    if len(buf):
        after[-1], after[:-1] = False, inside[1:]
    end = inside & (~after | cut[1:])
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets, "left")


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    h = h ^ U64(salt)
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of every span of `values` (bytes or code points); each `which` is a hash of its own.

    Eight bytes at a time are mixed in, one after another, over all spans
    together: no sum over positions that a pattern of letters could cancel.
    Spans beyond LONG bytes, which are rare, go through XXH3 one by one.
    """
    width = values.dtype.itemsize
    if width > 1:
        values, starts, ends = np.ascontiguousarray(values).view(np.uint8), starts * width, ends * width
    size = ends - starts
    h = mix(size.astype(U64) * U64(STEP), SALTS[which])
    if not len(h):
        return h
    eight = np.ndarray((len(values) + 1,), "<u8", np.concatenate([values, np.zeros(8, np.uint8)]), strides=(1,))
    rows = np.flatnonzero((size > 0) & (size <= LONG))
    at, left = starts[rows], size[rows]
    while len(rows):
        v = eight[at]
        v &= TAILS[np.minimum(left, 8)]
        h[rows] = mix(h[rows] ^ v)
        more = left > 8
        rows, at, left = rows[more], at[more] + 8, left[more] - 8
    far = np.flatnonzero(size > LONG)
    if len(far):
        from xxhash import xxh3_64_intdigest

        h[far] = [xxh3_64_intdigest(values[a:b].data, SALTS[which]) for a, b in zip(starts[far].tolist(), ends[far].tolist())]
    return h


def window_hashes(h: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """Hashes of all runs of n consecutive values of h; length len(h) - n + 1, or none.

    Runs are put together from runs of powers of two, mixed at each step.
    """
    if n < 1 or len(h) < n:
        return np.empty(0, U64)
    out, done, block, size = None, 0, h, 1
    salt = SALTS[1 - which]
    while True:
        if n & size:
            # what is gathered so far stands before this block
            out = block if out is None else mix(out[: len(block) - done] * U64(STEP) + block[done:], salt)
            done += size
        if size * 2 > n:
            break
        block = mix(block[:-size] * U64(STEP) + block[size:], salt) if len(block) > size else block[:0]
        size *= 2
    return mix(out[: len(h) - n + 1], n)


def whole_windows(first: np.ndarray, n: int) -> np.ndarray:
    """Starts (word numbers) of all windows of n words that stay within one row."""
    total = int(first[-1]) if len(first) else 0
    if total < n:
        return np.empty(0, np.int64)
    ok = np.ones(total - n + 1, bool)
    inner = np.unique(first[1:-1])
    for j in range(1, n):
        k = inner - j
        ok[k[(k >= 0) & (k < len(ok))]] = False
    return np.flatnonzero(ok)


def covered(n_words: int, starts: np.ndarray, length) -> np.ndarray:
    """Which of n_words words lie in a window that starts at one of `starts`."""
    delta = np.zeros(n_words + 1, np.int32)
    np.add.at(delta, starts, 1)
    np.subtract.at(delta, starts + length, 1)
    return np.cumsum(delta[:-1]) > 0
