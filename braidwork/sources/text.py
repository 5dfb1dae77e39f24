"""Readers of sequence, alignment and record text; all but nested records can be split between tasks.

Compressed files are opened by their suffix.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Codes whose value is the lines up to one with just a full stop.
BLOCKS = "src seq qlt hps fea com lay cns"


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, comment, seq): a record runs from a line that begins with ">" to the next; line ends are dropped."""
    t = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("r")).where(F.length(F.trim("r")) > 0)
    head = F.regexp_replace(F.regexp_extract("r", r"^([^\n]*)", 1), "\r$", "")
    seq = F.regexp_replace(F.regexp_replace("r", r"^[^\n]*", ""), r"\s+", "")
    return t.select(F.regexp_extract(head, r"^(\S*)", 1).alias("name"), F.regexp_extract(head, r"^\S*\s+(.*)$", 1).alias("comment"), seq.alias("seq"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value), lines counted from 0 in each file.

    Files are read in blocks by many tasks: lines are counted by block, the
    counts of the blocks before give each block its first number.  Only one row
    for each block is sorted.
    """
    t = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"),
    )
    b = t.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("first"))
    w = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    b = b.select("file", "block", "first", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    return t.join(b, ["file", "block"]).select("file", (F.col("before") + F.col("i") - F.col("first")).alias("line"), "value")


def fastq(spark: SparkSession, path: str) -> DataFrame:
    """(file, ord, name, seq, qlt, error) of four-line records; error names what is wrong with one, else null."""
    n = numbered_lines(spark, path).withColumn("value", F.regexp_replace("value", "\r$", ""))
    at = lambda i: F.max(F.when(F.col("line") % 4 == i, F.col("value")))
    r = n.groupBy("file", F.floor(F.col("line") / 4).alias("ord")).agg(at(0).alias("h"), at(1).alias("seq"), at(2).alias("plus"), at(3).alias("qlt"))
    r = r.where(~((F.trim("h") == "") & F.col("seq").isNull()))  # an empty line at the end
    error = (
        F.when(F.col("qlt").isNull(), "truncated").when(~F.col("h").startswith("@"), "no_header").when(~F.col("plus").startswith("+"), "no_separator")
        .when(F.length("seq") != F.length("qlt"), "lengths_differ").when(F.col("qlt").rlike(r"[^!-~]"), "quality_range")
    )
    return r.select("file", "ord", F.regexp_extract("h", r"^@(\S*)", 1).alias("name"), "seq", "qlt", error.alias("error"))


def paired(first: DataFrame, second: DataFrame) -> DataFrame:
    """(ord, name1, seq1, qlt1, name2, seq2, qlt2, error): two files' records by their order; names are compared without /1 and /2."""
    bare = lambda c: F.regexp_replace(c, "/[12]$", "")
    a = first.select("ord", *(F.col(c).alias(f"{c}1") for c in ("name", "seq", "qlt")))
    b = second.select("ord", *(F.col(c).alias(f"{c}2") for c in ("name", "seq", "qlt")))
    j = a.join(b, "ord", "full_outer")
    return j.withColumn("error", F.when(F.col("name1").isNull() | F.col("name2").isNull(), "unpaired").when(bare(F.col("name1")) != bare(F.col("name2")), "names_differ"))


def overlaps(spark: SparkSession, path: str) -> DataFrame:
    """(a_iid, b_iid, flipped, a_hang, b_hang, orig_pct, corr_pct, seed, error) of lines of seven or eight fields, N or I in the third."""
    f = F.split(F.trim("value"), r"\s+")
    t = spark.read.text(path).where(F.length(F.trim("value")) > 0).select("value", f.alias("f"))
    num = lambda i, kind: F.expr(f"try_cast(get(f, {i}) as {kind})")
    out = t.select(
        num(0, "long").alias("a_iid"), num(1, "long").alias("b_iid"), (F.get("f", F.lit(2)) == "I").alias("flipped"), num(3, "int").alias("a_hang"), num(4, "int").alias("b_hang"),
        num(5, "double").alias("orig_pct"), num(6, "double").alias("corr_pct"), num(7, "int").alias("seed"), F.size("f").alias("n"), F.get("f", F.lit(2)).alias("o"),
    )
    bad = ~F.col("n").isin(7, 8) | ~F.col("o").isin("N", "I") | F.col("a_iid").isNull() | F.col("b_iid").isNull() | F.col("a_hang").isNull() | F.col("b_hang").isNull() | F.col("corr_pct").isNull()
    return out.withColumn("error", F.when(bad, "invalid_line")).drop("n", "o")


def partial_overlaps(spark: SparkSession, path: str) -> DataFrame:
    """(a_iid, b_iid, forward, a_bgn, a_end, b_bgn, b_end, pct) of lines of eight fields, f or r in the third; other lines are left out."""
    t = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("f")).where(F.size("f") == 8)
    names = ["a_bgn", "a_end", "b_bgn", "b_end"]
    return t.where(F.col("f")[2].isin("f", "r")).selectExpr(
        "try_cast(f[0] as long) a_iid", "try_cast(f[1] as long) b_iid", "f[2] = 'f' forward", *(f"try_cast(f[{i + 3}] as int) {n}" for i, n in enumerate(names)), "try_cast(f[7] as double) pct"
    )


def alignments(spark: SparkSession, path: str) -> DataFrame:
    """(qname, flag, rname, bgn, end, reverse, clip5, clip3, cigar, seq) of SAM text: half-open positions, from 0; unmapped reads have none."""
    f = F.split("value", "\t")
    t = spark.read.text(path).where(~F.col("value").startswith("@") & (F.length("value") > 0)).select(f.alias("f")).where(F.size("f") >= 11)
    s = t.selectExpr("f[0] qname", "cast(f[1] as int) flag", "f[2] rname", "cast(f[3] as long) - 1 bgn", "f[5] cigar", "f[9] seq").where("cigar <> '*'")
    span = F.expr(r"aggregate(regexp_extract_all(cigar, '([0-9]+)[MDN=X]', 1), 0L, (a, x) -> a + cast(x as long))")
    clip = lambda p: F.coalesce(F.expr(f"try_cast(regexp_extract(cigar, '{p}', 1) as int)"), F.lit(0))
    return s.select(
        "qname", "flag", "rname", "bgn", (F.col("bgn") + span).alias("end"), (F.col("flag").bitwiseAND(16) != 0).alias("reverse"),
        clip("^(?:[0-9]+H)?([0-9]+)S").alias("clip5"), clip("([0-9]+)S(?:[0-9]+H)?$").alias("clip3"), "cigar", "seq",
    )


def table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-separated text by a schema: position maps, k-mer counts, reference mappings."""
    return spark.read.option("sep", "\t").schema(schema).csv(path)


def records(spark: SparkSession, path: str) -> DataFrame:
    """(code, fields) of flat tagged records {XXX ... }: fields is an array of (tag, value), tags may recur."""
    r = spark.read.option("lineSep", "\n}").text(path).select(F.regexp_replace("value", "\r", "").alias("r")).where(F.col("r").contains("{"))
    body = F.regexp_replace("r", r"(?s)^.*?\{", "")
    pattern = r"(?ms)^(?:(" + BLOCKS.replace(" ", "|") + r"):\n(.*?)\n?^\.$|([a-z][a-z0-9]{2}):([^\n]*)$)"
    out = r.select(F.substring(body, 1, 3).alias("code"), body.alias("b"))
    every = lambda g: F.regexp_extract_all("b", F.lit(pattern), F.lit(g))
    z = F.arrays_zip(every(1).alias("t"), every(2).alias("v"), every(3).alias("u"), every(4).alias("w"))
    pick = lambda x: F.when(x["t"] != "", F.struct(x["t"].alias("tag"), x["v"].alias("value"))).otherwise(F.struct(x["u"].alias("tag"), x["w"].alias("value")))
    return out.select("code", F.transform(z, pick).alias("fields"))


def tag(name: str) -> Column:
    """The first value of a tag, null if there is none."""
    return F.get(F.filter("fields", lambda f: f["tag"] == name), F.lit(0))["value"]


def reads(rec: DataFrame) -> DataFrame:
    """(act, acc, lib, seq, qlt, clr_bgn, clr_end) of FRG records; line ends within a sequence are dropped."""
    clr = F.split(tag("clr"), ",")
    flat = lambda c: F.regexp_replace(c, r"\s+", "")
    return rec.where("code = 'FRG'").select(
        tag("act").alias("act"), tag("acc").alias("acc"), tag("lib").alias("lib"), flat(tag("seq")).alias("seq"), flat(tag("qlt")).alias("qlt"),
        F.get(clr, F.lit(0)).try_cast("int").alias("clr_bgn"), F.get(clr, F.lit(1)).try_cast("int").alias("clr_end"),
    )


def libraries(rec: DataFrame) -> DataFrame:
    """(act, acc, ori, mean, std, features) of LIB records; of a feature given twice the last counts."""
    lines = F.filter(F.split(F.coalesce(tag("fea"), F.lit("")), "\n"), lambda x: x.contains("="))
    pair = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("k"), F.trim(F.regexp_replace(x, "^[^=]*=", "")).alias("v")))
    features = F.aggregate(pair, F.expr("cast(map() as map<string,string>)"), lambda m, x: F.map_concat(F.map_filter(m, lambda k, v: k != x["k"]), F.create_map(x["k"], x["v"])))
    return rec.where("code = 'LIB'").select(
        tag("act").alias("act"), tag("acc").alias("acc"), tag("ori").alias("ori"), tag("mea").try_cast("double").alias("mean"), tag("std").try_cast("double").alias("std"), features.alias("features"),
    )


def links(rec: DataFrame) -> DataFrame:
    """(act, frag1, frag2) of LKG records."""
    frg = F.filter("fields", lambda f: f["tag"] == "frg")
    return rec.where("code = 'LKG'").select(tag("act").alias("act"), F.get(frg, F.lit(0))["value"].alias("frag1"), F.get(frg, F.lit(1))["value"].alias("frag2"))


def nested(spark: SparkSession, path: str) -> DataFrame:
    """(file, id, parent, code, fields) of records that hold others: a file is one task's; ids count from 0 in a file, the parent of an outer record is null."""
    blocks = set(BLOCKS.split())

    def parse(file: str, text: str) -> Iterator[tuple]:
        open_, n, lines = [], 0, iter(text.replace("\r", "").split("\n"))
        for line in lines:
            if line.startswith("{"):
                open_.append((n, open_[-1][0] if open_ else None, line[1:4], []))
                n += 1
            elif line.startswith("}") and open_:
                i, parent, code, fields = open_.pop()
                yield file, i, parent, code, fields
            elif open_ and line[3:4] == ":":
                value = line[4:]
                if line[:3] in blocks and not value:
                    value = []
                    for more in lines:
                        if more == ".":
                            break
                        value.append(more)
                    value = "\n".join(value)
                open_[-1][3].append({"tag": line[:3], "value": value})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, text in zip(b["file"], b["value"]):
                out = pd.DataFrame(list(parse(file, text)), columns=["file", "id", "parent", "code", "fields"])
                yield out.astype({"parent": "Int64"})

    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return t.mapInPandas(run, "file string, id long, parent long, code string, fields array<struct<tag:string,value:string>>")
