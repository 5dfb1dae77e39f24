"""Readers and writers on small files, round trips, and blocks smaller than a file."""

import gzip

import pytest
from pyspark.sql import functions as F

from braidwork.functions import quality as ql
from braidwork.sources import sinks
from braidwork.sources import text as tx


def got(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_fasta_round_trip(spark, tmp_path):
    d = spark.createDataFrame([("r1", "ACGT" * 40), ("r2", ""), ("r3", "A" * 60), ("r4", None)], "name string, seq string")
    sinks.fasta(d, str(tmp_path / "f"))
    assert got(tx.fasta(spark, str(tmp_path / "f")), "name", "seq") == [("r1", "ACGT" * 40), ("r2", ""), ("r3", "A" * 60), ("r4", "")]
    (tmp_path / "g.fa").write_bytes(b">x a note > here\r\nAC\r\nGT\r\n>y\nTT\n")
    assert got(tx.fasta(spark, str(tmp_path / "g.fa")), "name", "comment", "seq") == [("x", "a note > here", "ACGT"), ("y", "", "TT")]


def test_fastq_in_small_blocks(spark, tmp_path):
    want = [(i, f"r{i}", "ACGT" * (i % 7 + 1), "@+!I" * (i % 7 + 1)) for i in range(400)]
    text = "".join(f"@{n} c\n{s}\n+\n{q}\n" for _, n, s, q in want)
    (tmp_path / "a.fastq").write_text(text)
    with gzip.open(tmp_path / "b.fastq.gz", "wt") as f:
        f.write(text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        for name in ("a.fastq", "b.fastq.gz"):
            d = tx.fastq(spark, str(tmp_path / name))
            assert got(d.where("error is null"), "ord", "name", "seq", "qlt") == sorted(want, key=str)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    sinks.fastq(d, str(tmp_path / "c"), "gzip")
    assert {r[1:] for r in got(tx.fastq(spark, str(tmp_path / "c")), "ord", "name", "seq", "qlt")} == {r[1:] for r in want}


def test_fastq_errors_and_pairs(spark, tmp_path):
    (tmp_path / "e.fastq").write_text("@a/1\nAC\n+\nII\n@b\nACG\n+\nII\nc\nA\n+\nI\n@d\nA\n+\n\x01\n@e\nAC\n")
    d = tx.fastq(spark, str(tmp_path / "e.fastq"))
    assert got(d, "ord", "error") == [(0, None), (1, "lengths_differ"), (2, "no_header"), (3, "quality_range"), (4, "truncated")]
    (tmp_path / "o.fastq").write_text("@a/2\nGT\n+\nII\n@x\nA\n+\nI\n")
    p = tx.paired(d, tx.fastq(spark, str(tmp_path / "o.fastq")))
    assert got(p, "ord", "error") == [(0, None), (1, "names_differ"), (2, "unpaired"), (3, "unpaired"), (4, "unpaired")]


def test_overlap_text(spark, tmp_path):
    d = spark.createDataFrame([(1, 2, 5, -3, True, 125), (3, 4, -7, 0, False, 0)], "a_iid long, b_iid long, a_hang int, b_hang int, flipped boolean, erate int")
    sinks.overlaps(d, str(tmp_path / "o"))
    cols = ("a_iid", "b_iid", "a_hang", "b_hang", "flipped", "corr_pct", "error")
    assert got(tx.overlaps(spark, str(tmp_path / "o")), *cols) == [(1, 2, 5, -3, True, 1.25, None), (3, 4, -7, 0, False, 0.0, None)]
    (tmp_path / "bad").write_text("1 2 N 3 4 1.0 1.0 77\n1 2 Q 3 4 1 1\nx y\n")
    assert got(tx.overlaps(spark, str(tmp_path / "bad")), "seed", "error") == [(77, None), (None, "invalid_line"), (None, "invalid_line")]
    (tmp_path / "p").write_text("1 2 f 0 10 5 15 1.5\n1 3 r 0 10 15 5 0.5\nnothing\n")
    assert got(tx.partial_overlaps(spark, str(tmp_path / "p")), "b_iid", "forward", "b_bgn", "b_end", "pct") == [(2, True, 5, 15, 1.5), (3, False, 15, 5, 0.5)]
    sinks.overlap_store(d, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).where("a_iid between 2 and 9").count() == 1


def test_sam(spark, tmp_path):
    (tmp_path / "s.sam").write_text("@HD\tVN:1\nq\t16\tc\t11\t60\t2H3S5M1I2D4M1S\t*\t0\t0\tACGT\tIIII\nu\t4\t*\t0\t0\t*\t*\t0\t0\tA\tI\n")
    assert got(tx.alignments(spark, str(tmp_path / "s.sam")), "qname", "rname", "bgn", "end", "reverse", "clip5", "clip3") == [("q", "c", 10, 21, True, 3, 1)]


RECORDS = """{LIB
act:A
acc:lib1
ori:I
mea:3000.0
std:300.0
src:
.
nft:2
fea:
trim=1
note=a=b
.
}
{FRG
act:A
acc:f1
lib:lib1
src:
.
seq:
ACGT
AC
.
qlt:
IIIIII
.
clr:0,6
}
{LKG
act:A
frg:f1
frg:f2
}
"""


def test_records(spark, tmp_path):
    (tmp_path / "r.frg").write_text(RECORDS)
    rec = tx.records(spark, str(tmp_path / "r.frg"))
    assert got(tx.reads(rec), "acc", "lib", "seq", "qlt", "clr_bgn", "clr_end") == [("f1", "lib1", "ACGTAC", "IIIIII", 0, 6)]
    lib = tx.libraries(rec).first()
    assert (lib.acc, lib.mean, lib.std, lib.features) == ("lib1", 3000.0, 300.0, {"trim": "1", "note": "a=b"})
    assert got(tx.links(rec), "frag1", "frag2") == [("f1", "f2")]
    sinks.records(rec.coalesce(1), str(tmp_path / "w"))
    assert got(tx.records(spark, str(tmp_path / "w")), "code", "fields") == got(rec, "code", "fields")


def test_nested_records(spark, tmp_path):
    (tmp_path / "n").write_text("{CCO\nacc:c1\ncns:\nAC\nGT\n.\n{UPS\ntyp:S\n}\n{MPS\nmid:5\n}\n}\n{CCO\nacc:c2\n}\n")
    d = tx.nested(spark, str(tmp_path / "n"))
    assert got(d, "id", "parent", "code") == [(0, None, "CCO"), (1, 0, "UPS"), (2, 0, "MPS"), (3, None, "CCO")]
    assert d.where("id = 0").select(tx.tag("cns")).first()[0] == "AC\nGT"


def test_tables(spark, tmp_path):
    d = spark.createDataFrame([("f", "c", 0, 5, "f")], "frg string, ctg string, bgn int, end int, ori string")
    sinks.table(d, str(tmp_path / "t"))
    assert got(tx.table(spark, str(tmp_path / "t"), "frg string, ctg string, bgn int, end int, ori string"), *d.columns) == [("f", "c", 0, 5, "f")]


def test_quality(spark):
    r = spark.range(1).select(
        ql.values(F.lit("!I")).alias("v"), ql.mean(F.lit("!I")).alias("m"), ql.mean(F.lit("")).alias("e"), ql.recoded(F.lit("hB"), "illumina13").alias("i"), ql.recoded(F.lit(";h"), "solexa").alias("s"),
        ql.possible(F.lit("!"), F.lit("J")).alias("p"), ql.values(F.lit(None).cast("string")).alias("n"),
    ).first()
    assert (r.v, r.m, r.e, r.i, r.s, r.p, r.n) == ([0, 40], 20.0, None, "I#", '"I', ["illumina18"], None)


def test_flowgrams_and_alignments(spark, tmp_path):
    import gzip
    import struct

    from braidwork.sources import binary

    flows, key = 3, b"TCAG"
    head = struct.pack(">4s4sQIIHHHB", b".sff", b"\0\0\0\1", 0, 0, 2, 40, len(key), flows, 1) + b"TAC" + key
    head += b"\0" * (40 - len(head))

    def read(name, seq, quals, clips):
        h = struct.pack(">HHIHHHH", 32, len(name), len(seq), *clips) + name
        body = b"\0" * (2 * flows + len(seq)) + seq + bytes(quals)
        return h + b"\0" * (32 - len(h)) + body + b"\0" * (-len(body) % 8)

    sff = head + read(b"r1", b"TCAGA", [1, 2, 3, 4, 40], (2, 4, 0, 0)) + read(b"read2", b"", [], (0, 0, 0, 0))
    (tmp_path / "a.sff").write_bytes(sff)
    got = {tuple(r)[1:] for r in binary.read_sff(spark, str(tmp_path / "a.sff")).collect()}
    assert got == {("r1", "TCAGA", '"#$%I', 1, 4, 0, 5), ("read2", "", "", 0, 0, 0, 0)}
    with pytest.raises(ValueError):
        list(binary.sff_reads(sff[:-20]))

    def aligned(name, flag, ref, pos, ops, seq, quals):
        code = ["=ACMGRSVTWYHKDBN".index(c) for c in seq] + [0] * (len(seq) % 2)
        b = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, 7, 0, len(ops), flag, len(seq), -1, -1, 0) + name + b"\0" + struct.pack(f"<{len(ops)}I", *(n << 4 | "MIDNSHP=X".index(o) for n, o in ops))
        b += bytes(code[i] << 4 | code[i + 1] for i in range(0, len(code), 2)) + bytes(quals)
        return struct.pack("<i", len(b)) + b

    plain = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 3) + b"c1\0" + struct.pack("<i", 99)
    plain += aligned(b"q1", 16, 0, 4, [(2, "S"), (3, "M")], "ACGTN", [0, 1, 2, 3, 4]) + aligned(b"q2", 4, -1, -1, [], "", [])
    bam = gzip.compress(plain[:50]) + gzip.compress(plain[50:]) + gzip.compress(b"")
    (tmp_path / "a.bam").write_bytes(bam)
    got = {tuple(r)[1:] for r in binary.read_bam(spark, str(tmp_path / "a.bam")).collect()}
    assert got == {("q1", 16, "c1", 5, 7, "2S3M", "ACGTN", "!\"#$%"), ("q2", 4, None, 0, 7, None, None, None)}
    with pytest.raises(ValueError):
        list(binary.bam_alignments(gzip.compress(plain[:-3])))


def test_clear_by_quality(spark):
    from braidwork.functions import quality

    good, bad = "I" * 20, "!" * 15
    d = spark.createDataFrame([(bad + good + bad,), ("",), (None,), (bad,), ("IIIII",)], "q string")
    got = [tuple(r["c"]) for r in d.coalesce(1).select(quality.clear_by_quality(F.col("q"), 20).alias("c")).collect()]
    assert got[0] == (15, 35)
    assert got[1:] == [(0, 0)] * 4
