"""Byte-level BPE ids of whole texts, with the work per distinct word piece.

The ids are those of the `tokenizers` library for the given file.  For a
byte-level file the texts are cut by the file's word pattern with array
operations over code points, and each distinct piece is merged once; anything
else, and texts that hold one of the file's special tokens, goes through the
library itself.
"""

from __future__ import annotations

import json
import unicodedata
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np

from .spans import span_hashes

STEP_CHARS = 2_000_000
#: Distinct pieces remembered by a worker; beyond it the table starts anew.
CACHE_PIECES = 600_000
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: The code points of Unicode's White_Space property.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(1)
def classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[WHITE_SPACE] = SPACE
    return out


def piece_starts(cp: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the word pieces of texts laid end to end.

    The pattern: 's 't 're 've 'm 'll 'd, else letters, numbers or other signs
    each with at most one blank before them, else white space, of which the
    last is left to what follows.
    """
    n = len(cp)
    if not n:
        return np.empty(0, np.int64)
    kind = classes()[cp]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    new = edge[:-1].copy()
    new[1:] |= kind[1:] != kind[:-1]
    runs = np.flatnonzero(new)
    stop = np.append(runs[1:], n)
    what = kind[runs]
    starts = np.zeros(n + 1, bool)
    blank = what == SPACE
    # runs of letters, numbers and signs, with the blank before them
    word = runs[~blank]
    glued = ~edge[word] & (word > 0)
    glued[glued] = cp[word[glued] - 1] == 0x20
    starts[word - glued] = True
    # white space
    a, b = runs[blank], stop[blank]
    at_end = edge[b]
    to_next = ~at_end & (cp[b - 1] == 0x20)
    starts[a[at_end | ~to_next | (b - a > 1)]] = True
    own_last = ~at_end & ~to_next
    starts[b[own_last] - 1] = True
    # contractions: a lone apostrophe without a blank, then letters
    mark = word[(cp[word] == 0x27) & ~glued]
    mark = mark[mark + 1 < n]
    mark = mark[(kind[mark + 1] == LETTER) & ~edge[mark + 1]]
    if len(mark):
        one = cp[mark + 1]
        two = np.where((mark + 2 < n) & ~edge[np.minimum(mark + 2, n)], cp[np.minimum(mark + 2, n - 1)], 0)
        size = np.where(np.isin(one, [ord(x) for x in "stmd"]), 1, 0)
        for pair in ("re", "ve", "ll"):
            size = np.where((one == ord(pair[0])) & (two == ord(pair[1])), 2, size)
        mark, size = mark[size > 0], size[size > 0]
        starts[mark + 1] = False
        rest = mark + 1 + size
        inside = (rest < n) & ~edge[np.minimum(rest, n)]
        inside[inside] = kind[rest[inside]] == LETTER
        starts[rest[inside]] = True
    return np.flatnonzero(starts[:n])


def _byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [x["content"] for x in spec.get("added_tokens") or ()]
        pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
        self.merge = None
        plain = not any(spec.get(k) for k in ("normalizer", "post_processor", "truncation", "padding"))
        if plain and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and model.get("type") == "BPE" and not model.get("dropout"):
            import tiktoken

            letters = _byte_letters()
            ranks = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if t not in self.special}
            by_id = sorted(ranks.values())
            if by_id == [*range(len(by_id))]:  # ids in the order of the merges, so they serve as ranks
                core = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
                self.merge = core._core_bpe.encode_single_piece
                self.id_bytes = np.zeros(max(ranks.values()) + 1, np.int64)
                for t, i in ranks.items():
                    self.id_bytes[i] = len(t)
        self._forget()

    @cached_property
    def library(self):
        """The tokenizer of the library, loaded where the table can't give the ids."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _forget(self) -> None:
        """Known pieces: sorted hashes with their numbers, and by number the piece itself and its stretch of ids."""
        self.keys, self.number = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.pieces: list[str] = []
        self.sizes, self.begin, self.flat = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)

    def forget(self) -> None:
        """Gives back what the known pieces take."""
        self._forget()

    def _learn(self, new: list[str]) -> np.ndarray:
        """The numbers that the pieces get, which are merged here."""
        merge = self.merge
        lists = [merge(x.encode()) for x in new]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        first = len(self.pieces)
        self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(lists), np.int32, int(sizes.sum()))])
        self.pieces += new
        return np.arange(first, len(self.pieces))

    def _known(self, h: np.ndarray, own: list[str]) -> np.ndarray:
        """Numbers of the distinct pieces `own` of sorted hashes h, after merging those not yet known.

        A hash only leads to a piece, which is then compared letter by letter.
        """
        if len(self.pieces) > CACHE_PIECES:
            self._forget()
        at = np.searchsorted(self.keys, h)
        miss = at == len(self.keys)
        miss[~miss] = self.keys[at[~miss]] != h[~miss]
        out = np.empty(len(h), np.int64)
        out[~miss] = self.number[at[~miss]]
        pieces = self.pieces
        other = [i for i, n in zip(np.flatnonzero(~miss).tolist(), out[~miss].tolist()) if pieces[n] != own[i]]
        if miss.any():
            out[miss] = self._learn([own[i] for i in np.flatnonzero(miss).tolist()])
            self.keys, self.number = np.insert(self.keys, at[miss], h[miss]), np.insert(self.number, at[miss], out[miss])
        if other:  # another piece has this hash: known by number only
            out[other] = self._learn([own[i] for i in other])
        return out

    def encode_with_offsets(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, start and end of each id in characters) of each text; special tokens in it are plain text.

        An id that ends within a character covers it.
        """
        if self.merge is None:
            self.library.encode_special_tokens = True
            try:
                got = [(np.array(e.ids, np.int32), np.array(e.offsets, np.int32).reshape(-1, 2)) for e in self.library.encode_batch(texts, add_special_tokens=False)]
            finally:
                self.library.encode_special_tokens = False
            return [(ids, off[:, 0].copy(), off[:, 1].copy()) for ids, off in got]
        out = []
        for text, ids in zip(texts, self.encode(texts, special=False)):
            ends = np.cumsum(self.id_bytes[ids])
            starts = ends - self.id_bytes[ids]
            if not text.isascii():
                raw = np.frombuffer(text.encode(), np.uint8)
                upto = np.append(0, np.cumsum((raw & 0xC0) != 0x80))  # characters begun before a byte
                starts, ends = upto[starts + 1] - 1, upto[ends]
            out.append((ids, starts.astype(np.int32), ends.astype(np.int32)))
        return out

    def safe_cut(self, text: str) -> int:
        """Characters of text after which it may be cut, whatever follows, without another id; 0: nowhere.

        Word pieces are encoded each for itself, and where one starts depends on
        no more than three characters behind it.
        """
        if self.merge is None or len(text) < 8:
            return 0
        cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        starts = piece_starts(cp, np.array([0, len(cp)]))
        starts = starts[starts <= len(cp) - 4]
        return int(starts[-1]) if len(starts) else 0

    def encode(self, texts: list[str], special: bool = True) -> list[np.ndarray]:
        """The ids of each text, as int32 arrays."""
        if self.merge is None:
            return [np.array(x.ids, np.int32) for x in self.library.encode_batch(texts, add_special_tokens=False)]
        out: list[np.ndarray] = []
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= STEP_CHARS):
                size += len(texts[hi])
                hi += 1
            out += self._encode(texts[lo:hi])
            lo = hi
        for i, t in enumerate(texts):
            if special and any(s in t for s in self.special):
                out[i] = np.array(self.library.encode(t, add_special_tokens=False).ids, np.int32)
        return out

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        offsets = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=offsets[1:])
        whole = "".join(texts)
        cp = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        starts = piece_starts(cp, offsets)
        if not len(starts):
            return [np.empty(0, np.int32) for _ in texts]
        ends = np.append(starts[1:], len(cp))
        h, where, of = np.unique(span_hashes(cp, starts, ends), return_index=True, return_inverse=True)
        second = span_hashes(cp, starts, ends, 1)
        if (second != second[where][of]).any() or (ends - starts != (ends - starts)[where][of]).any():  # pieces that share a hash here
            return [np.array(x.ids, np.int32) for x in self.library.encode_batch(texts, add_special_tokens=False)]
        at = self._known(h, [whole[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist())])
        sizes, begin, flat = self.sizes[at], self.begin[at], self.flat
        each = sizes[of]
        upto = np.cumsum(each)
        take = np.arange(int(upto[-1])) + np.repeat(begin[of] - (upto - each), each)
        ids = flat[take]
        bound = np.append(0, upto)[np.searchsorted(starts, offsets)]
        return [ids[a:b] for a, b in zip(bound[:-1].tolist(), bound[1:].tolist())]


@lru_cache(4)
def encoder(path: str) -> Encoder:
    return Encoder(path)
