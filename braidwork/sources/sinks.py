"""Writers of sequence, overlap and record text and of sorted overlap tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def wrapped(seq: Column, width: int = 60) -> Column:
    return F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n")


def fasta(df: DataFrame, path: str, width: int = 60, compression: str | None = None) -> None:
    """Writes df(name, seq); null sequences are empty ones."""
    _text(df.select(F.concat(F.lit(">"), "name", F.lit("\n"), wrapped(F.coalesce("seq", F.lit("")), width)).alias("value")), path, compression)


def fastq(df: DataFrame, path: str, compression: str | None = None) -> None:
    """Writes df(name, seq, qlt)."""
    _text(df.select(F.concat(F.lit("@"), "name", F.lit("\n"), "seq", F.lit("\n+\n"), "qlt").alias("value")), path, compression)


def overlaps(df: DataFrame, path: str) -> None:
    """Writes overlaps as lines of seven fields; erate is in ten-thousandths."""
    o = F.when(F.col("flipped"), "I").otherwise("N")
    pct = F.col("erate") / 100
    _text(df.select(F.format_string("%8d %8d  %s %5d %5d  %4.2f  %4.2f", "a_iid", "b_iid", o, "a_hang", "b_hang", pct, pct).alias("value")), path, None)


def overlap_store(df: DataFrame, path: str) -> None:
    """Overlaps as Parquet in ranges of a_iid, sorted within each, so that a range of reads is a range of row groups."""
    keys = ["a_iid", "b_iid", "a_hang", "b_hang"]
    df.repartitionByRange("a_iid").sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def records(df: DataFrame, path: str, blocks: tuple[str, ...] = ("src", "seq", "qlt", "hps", "fea", "com")) -> None:
    """Writes (code, fields) as tagged records."""
    line = lambda f: F.when(f["tag"].isin(*blocks), F.concat(f["tag"], F.lit(":\n"), F.when(f["value"] != "", F.concat(f["value"], F.lit("\n"))).otherwise(""), F.lit("."))).otherwise(F.concat(f["tag"], F.lit(":"), f["value"]))
    _text(df.select(F.concat(F.lit("{"), "code", F.lit("\n"), F.array_join(F.transform("fields", line), "\n"), F.lit("\n}")).alias("value")), path, None)


def table(df: DataFrame, path: str) -> None:
    """Tab-separated text, as of a position map."""
    df.write.mode("overwrite").option("sep", "\t").csv(path)


def _text(df: DataFrame, path: str, compression: str | None) -> None:
    w = df.write.mode("overwrite")
    (w.option("compression", compression) if compression else w).text(path)
