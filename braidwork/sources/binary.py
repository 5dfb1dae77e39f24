"""Binary read formats as DataFrames: flowgram files (SFF) and alignments (BAM).

A file is read whole by one task: neither format can be cut without an index,
so give large sets as many files.  A file that ends too early raises an error.
"""

from __future__ import annotations

import io
import struct
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SFF_SCHEMA = "file string, name string, bases string, qualities string, clip_bgn int, clip_end int, adapter_bgn int, adapter_end int"
BAM_SCHEMA = "file string, qname string, flag int, rname string, pos int, mapq int, cigar string, seq string, qual string"
ROWS = 2000
#: Fixed values of the formats.
SFF_MAGIC, BAM_MAGIC, CIGAR, LETTERS = b".sff", b"BAM\1", "MIDNSHP=X", "=ACMGRSVTWYHKDBN"


def _read(f, n: int) -> bytes:
    b = f.read(n)
    if len(b) < n:
        raise ValueError("the file ends within a record")
    return b


def sff_reads(data: bytes):
    """(name, bases, qualities, clip_bgn, clip_end, adapter_bgn, adapter_end); clips count from 0, the end is not in them, 0 and the length if unset."""
    f = io.BytesIO(data)
    magic, version, _, _, reads, header, key, flows, code = struct.unpack(">4s4sQIIHHHB", _read(f, 31))
    if magic != SFF_MAGIC or version != b"\0\0\0\1" or code != 1:
        raise ValueError("not a flowgram file of version 1")
    f.seek(header)
    for _ in range(reads):
        size, name_len, n, ql, qr, al, ar = struct.unpack(">HHIHHHH", _read(f, 16))
        name = _read(f, size - 16)[:name_len].decode()
        body = 2 * flows + 3 * n
        b = _read(f, body)
        at = 2 * flows + n
        yield name, b[at:at + n].decode(), "".join(chr(33 + q) for q in b[at + n:at + 2 * n]), max(0, ql - 1), qr or n, max(0, al - 1), ar or n
        f.seek(-body % 8, 1)


def _inflated(data: bytes):
    """The content of the gzip members of data, one after another."""
    while data:
        d = zlib.decompressobj(31)
        yield d.decompress(data) + d.flush()
        if not d.eof:
            raise ValueError("the file ends within a block")
        data = d.unused_data


class _Joined:
    """Bytes of blocks as one stream that holds a few blocks at a time."""

    def __init__(self, blocks):
        self.blocks, self.rest = blocks, b""

    def read(self, n: int) -> bytes:
        while len(self.rest) < n:
            b = next(self.blocks, None)
            if b is None:
                break
            self.rest += b
        out, self.rest = self.rest[:n], self.rest[n:]
        return out


def bam_alignments(data: bytes):
    """(qname, flag, rname, pos, mapq, cigar, seq, qual); pos counts from 1; rname, cigar, seq and qual are null if absent."""
    f = _Joined(_inflated(data))
    if _read(f, 4) != BAM_MAGIC:
        raise ValueError("not a BAM file")
    one = lambda: struct.unpack("<i", _read(f, 4))[0]
    _read(f, one())
    names = []
    for _ in range(one()):
        names.append(_read(f, one())[:-1].decode())
        one()
    while head := f.read(4):
        if len(head) < 4:
            raise ValueError("the file ends within a record")
        b = _read(f, struct.unpack("<i", head)[0])
        ref, pos, name_len, mapq, _, ops, flag, n = struct.unpack("<iiBBHHHi", b[:20])
        at = 32 + name_len
        cigar = "".join(f"{c >> 4}{CIGAR[c & 15]}" for c in struct.unpack(f"<{ops}I", b[at:at + 4 * ops]))
        at += 4 * ops
        packed = b[at:at + (n + 1) // 2]
        seq = "".join(LETTERS[x >> 4] + LETTERS[x & 15] for x in packed)[:n]
        q = b[at + len(packed):at + len(packed) + n]
        yield b[32:32 + name_len - 1].decode(), flag, names[ref] if ref >= 0 else None, pos + 1, mapq, cigar or None, seq or None, None if not n or q[0] == 255 else "".join(chr(33 + x) for x in q)


def _table(spark: SparkSession, path: str, parse, schema: str) -> DataFrame:
    columns = [c.split()[0] for c in schema.split(", ")]

    def rows(batches):
        for b in batches:
            for file, data in zip(b["path"], b["content"]):
                some = []
                for r in parse(bytes(data)):
                    some.append((file, *r))
                    if len(some) == ROWS:
                        yield pd.DataFrame(some, columns=columns)
                        some = []
                yield pd.DataFrame(some, columns=columns)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, schema)


def read_sff(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, path, sff_reads, SFF_SCHEMA)


def read_bam(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, path, bam_alignments, BAM_SCHEMA)
