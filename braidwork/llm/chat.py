"""Chat formatting with loss masks aligned to token offsets."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import shuffle_partitions
from .spans import tidied
from .tokens import encoder

#: The marks around a turn, by role; other roles are written out between OTHER's marks.
MARKS = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
OTHER = ("[ROLE]", "[/ROLE]", "[/TURN]")
LOSS_ROLE = "assistant"
#: Characters after which a conversation goes on in a further row, cut where no id depends on both sides.
PART_CHARS = 1_000_000
#: Characters encoded in one call.
STEP_CHARS = 200_000

_CONTROL = "|".join(re.escape(x) for pair in (*MARKS.values(), OTHER) for x in pair)
_ESCAPE = re.compile(rf"\\|{_CONTROL}")
_PLAIN = re.compile(rf"\\({_CONTROL}|\\)", re.S)
_SCAN = re.compile(rf"\\(?:{_CONTROL}|\\)|({_CONTROL})", re.S)


def escape(text: str) -> str:
    """A backslash before every backslash and every control string."""
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _PLAIN.sub(lambda m: m[1], text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """(formatted text, sorted spans of the texts that bear loss)."""
    out, spans, at = [], [], 0
    for role, text in turns:
        body = escape(text)
        if role in MARKS:
            before, after = MARKS[role]
        else:
            before, after = OTHER[0] + escape(role) + OTHER[1], OTHER[2]
        if role == LOSS_ROLE and body:
            spans.append((at + len(before), at + len(before) + len(body)))
        out += (before, body, after)
        at += len(before) + len(body) + len(after)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted text."""
    return whole_turns(formatted)[0]


def whole_turns(formatted: str) -> tuple[list[tuple[str, str]], int]:
    """(the turns that end within the beginning of a formatted text, where the last of them ends)."""
    opens = {a: role for role, (a, _) in MARKS.items()}
    turns, marks = [], [(m.start(), m.end(), m[1]) for m in _SCAN.finditer(formatted) if m[1]]
    i = end = 0
    while i < len(marks):
        _, a, mark = marks[i]
        if i + (2 if mark == OTHER[0] else 1) >= len(marks):
            break
        if mark == OTHER[0]:
            role = unescape(formatted[a : marks[i + 1][0]])
            turns.append((role, unescape(formatted[marks[i + 1][1] : marks[i + 2][0]])))
            i += 3
        else:
            turns.append((opens[mark], unescape(formatted[a : marks[i + 1][0]])))
            i += 2
        end = marks[i - 1][1]
    return turns, end


def align(spans: list[tuple[int, int]], starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token the characters [from, to) of it that lie in a loss span; (0, 0) if none.

    Spans and tokens are sorted.  The tokens that meet a span are found by
    binary search: the first that ends after the span's start up to the last
    that starts before its end.
    """
    lo, hi = np.zeros(len(starts), np.int32), np.zeros(len(starts), np.int32)
    if not spans:
        return lo, hi
    a = np.array(spans)
    first = np.searchsorted(ends, a[:, 0], "right")
    last = np.searchsorted(starts, a[:, 1], "left")
    for (s, e), i, j in zip(spans, first.tolist(), last.tolist()):
        lo[i:j], hi[i:j] = np.maximum(starts[i:j], s), np.minimum(ends[i:j], e)
    return lo, hi


def loss_texts(formatted: str, lo: list[int], hi: list[int]) -> list[str]:
    """The texts under a mask, each stretch once, unescaped."""
    out: list[list[int]] = []
    for a, b in zip(lo, hi):
        if b <= a:
            continue
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [unescape(formatted[a:b]) for a, b in out]


SCHEMA = "part int, formatted string, token_ids array<int>, token_starts array<int>, token_ends array<int>, loss_from array<int>, loss_to array<int>"


def format_chat(
    conversations: DataFrame, tokenizer_path: str, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
    text_col: str = "text", part_chars: int = PART_CHARS,
) -> DataFrame:
    """Conversations as formatted, tokenised text with a loss mask on the assistant's words.

    Each turn is written between the marks of its role, with control strings
    and backslashes inside texts escaped by a backslash, so that parse() gives
    the turns back.  The whole text is encoded once with character offsets and
    the sorted loss spans are intersected with the sorted token spans by
    binary search.  loss_from and loss_to give, for each token, its characters
    under the mask (equal: none), which is exact where a token straddles the
    edge of a turn.

    Rows are dealt by conv_col and sorted by conv_col, turn_col, role_col,
    text_col; a task streams through its sorted rows.  A conversation longer
    than `part_chars` is given in several rows that follow each other in one
    task.  They are cut where a word piece of the tokenizer starts, so that the
    ids are those of one encoding of the whole; token offsets count from the
    start of the part.  With a tokenizer of other than byte-level pieces there
    are no parts.

    Null text or role: empty.  Null turn: before the others.  Null conv_col:
    one conversation of that id.  Repeated rows are repeated turns.  Empty
    table: no rows.  Returns conv_col and the columns of SCHEMA; other columns
    are not looked at.
    """
    kind = conversations.schema[conv_col].dataType.simpleString()
    rows = conversations.select(
        F.col(conv_col).alias("c"), F.col(turn_col).alias("n"), F.coalesce(F.col(role_col), F.lit("")).alias("r"), F.coalesce(F.col(text_col), F.lit("")).alias("t")
    )
    rows = rows.repartition(shuffle_partitions(conversations.sparkSession), "c").sortWithinPartitions("c", "n", "r", "t")

    def run(batches):
        enc = encoder(tokenizer_path)
        id_type = None

        def emit(parts):
            cols: list[list] = [[], [], [], [], []]
            for (_, _, _, spans), (ids, starts, ends) in zip(parts, enc.encode_with_offsets([p[2] for p in parts])):
                lo, hi = align(spans, starts, ends)
                for c, v in zip(cols, (ids, starts, ends, lo, hi)):
                    c.append(v)
            ints = pa.list_(pa.int32())
            return pa.RecordBatch.from_arrays(
                [pa.array([p[0] for p in parts], id_type), pa.array([p[1] for p in parts], pa.int32()), pa.array([p[2] for p in parts], pa.string()), *(pa.array(c, ints) for c in cols)],
                [conv_col, "part", "formatted", "token_ids", "token_starts", "token_ends", "loss_from", "loss_to"],
            )

        def parts():
            """(conversation, part, formatted text, loss spans) in order."""
            nonlocal id_type
            conv, part, turns, size, begun = None, 0, [], 0, False
            rest, rest_spans = "", []

            def rendered():
                nonlocal rest, rest_spans, turns
                text, spans = render(turns)
                rest_spans = rest_spans + [(a + len(rest), b + len(rest)) for a, b in spans]
                rest, turns = rest + text, []

            for b in tidied(batches):
                id_type = b.schema.field("c").type
                for c, r, t in zip(b.column("c").to_pylist(), b.column("r").to_pylist(), b.column("t").to_pylist()):
                    if begun and c != conv:
                        rendered()
                        yield conv, part, rest, rest_spans
                        part, size, rest, rest_spans = 0, 0, "", []
                    elif size > part_chars:
                        rendered()
                        cut = enc.safe_cut(rest)
                        if cut:
                            yield conv, part, rest[:cut], [(x, min(y, cut)) for x, y in rest_spans if x < cut]
                            rest, rest_spans = rest[cut:], [(max(x - cut, 0), y - cut) for x, y in rest_spans if y > cut]
                            part += 1
                        size = 0
                    conv, begun = c, True
                    turns.append((r, t))
                    size += len(t) + len(r)
            if begun:
                rendered()
                yield conv, part, rest, rest_spans

        ready, held = [], 0
        for p in parts():
            ready.append(p)
            held += len(p[2])
            if held > STEP_CHARS or len(ready) >= 200:
                yield emit(ready)
                ready, held = [], 0
        if ready:
            yield emit(ready)

    return rows.mapInArrow(run, f"`{conv_col}` {kind}, {SCHEMA}")


def digests(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """What format_chat's rows say, read back: turns, the text under the loss mask, and lengths.

    A map over format_chat's own tasks, in which a conversation's parts follow each other.
    """
    kind, id_type = formatted.schema[conv_col].dataType.simpleString(), to_arrow_type(formatted.schema[conv_col].dataType)

    def run(batches):
        def parts():
            for b in batches:
                yield from zip(*(b.column(k).to_pylist() for k in (conv_col, "part", "formatted", "loss_from", "loss_to")))

        number = -1

        def which(row):
            nonlocal number
            number += row[1] == 0
            return number

        out = []
        for _, group in groupby(parts(), which):
            turns, loss = hashlib.sha256(), hashlib.sha256()
            n = loss_chars = chars = 0
            rest, at, to = "", [], []  # a turn may go on in the next part
            for conv, _, text, lo, hi in group:
                chars += len(text)
                for x, y in zip(lo, hi):
                    if x < y:
                        at.append(x + len(rest))
                        to.append(y + len(rest))
                rest += text
                own, end = whole_turns(rest)
                for role, body in own:
                    n += 1
                    turns.update(f"{role}\n{body}\n".encode())
                k = bisect_right(at, end - 1)  # masks do not reach beyond their turn
                for x in loss_texts(rest, at[:k], to[:k]):
                    loss_chars += len(x)
                    loss.update(x.encode())
                rest, at, to = rest[end:], [x - end for x in at[k:]], [x - end for x in to[k:]]
            out.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
            if len(out) >= 5000:
                yield rows_of(out, id_type)
                out = []
        if out:
            yield rows_of(out, id_type)

    def rows_of(out, id_type):
        c = list(zip(*out))
        kinds = (id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(c, kinds)], [conv_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select(conv_col, "part", "formatted", "loss_from", "loss_to").mapInArrow(
        run, f"`{conv_col}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
