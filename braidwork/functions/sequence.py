"""Column functions on sequences, qualities, error codes and orientations."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest error code; codes count ten-thousandths.
MAX_ERATE = 4095


def reverse_complement(seq: Column) -> Column:
    """Null stays null; letters other than ACGT in either case stay as they are."""
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def homopolymer_compressed(seq: Column) -> Column:
    """Each run of one letter as that letter."""
    return F.regexp_replace(seq, r"(.)\1+", "$1")


def gc_count(seq: Column) -> Column:
    return F.length(F.regexp_replace(seq, "[^GCgc]", "")).cast("long")


def ungapped_length(seq: Column) -> Column:
    return F.length(F.regexp_replace(seq, "-", "")).cast("long")


def erate_code(rate: Column) -> Column:
    """An error rate as a saturating count of ten-thousandths."""
    return F.least(F.floor(rate * 10000 + 0.5), F.lit(MAX_ERATE)).cast("int")


def canonical(kmer: Column) -> Column:
    return F.least(kmer, reverse_complement(kmer))


def gap_size(mean: Column, least: int = 20) -> Column:
    """A gap estimate in whole bases, at least `least`."""
    return F.when(mean <= least, least).otherwise(F.floor(mean)).cast("long")


def flip_orientation(orient: Column) -> Column:
    """A pair seen from its other member: innie and outtie stay, normal and anti change."""
    return F.when(orient == "normal", "anti").when(orient == "anti", "normal").otherwise(orient)


def combine(mean_a: Column, var_a: Column, mean_b: Column, var_b: Column) -> tuple[Column, Column]:
    """Inverse-variance (mean, variance) of two estimates; null unless both variances are positive."""
    ok = (var_a > 0) & (var_b > 0)
    weight = 1 / var_a + 1 / var_b
    return F.when(ok, (mean_a / var_a + mean_b / var_b) / weight), F.when(ok, 1 / weight)


def bases(texts: DataFrame, letter: dict[str, str]) -> DataFrame:
    """texts(id, seq) with each ASCII letter of `letter` replaced and every other one left out, in Arrow batches; null stays null."""
    kind = texts.schema["id"].dataType.simpleString()
    table = bytes(ord(letter.get(chr(i), "?")) if i < 128 else 63 for i in range(256))
    other = bytes(i for i in range(256) if i >= 128 or chr(i) not in letter)

    def run(batches):
        for b in batches:
            out = [None if t is None else t.translate(table, other) for t in b.column("seq").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.binary()).cast(pa.string())], ["id", "seq"])

    return texts.select("id", "seq").mapInArrow(run, f"id {kind}, seq string")
