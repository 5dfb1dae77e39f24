"""Tigs and the reads placed in them: mates, duplicates, splits, repeat rules, votes and base calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import intervals as iv
from .overlaps import overlap_class

#: Order of symbols in a base call; of equals the first wins.
SYMBOLS = "-ACGT"


def mate_status(reads: DataFrame, mates: DataFrame, mean: float, stddev: float) -> DataFrame:
    """(iid, mate, status) of reads(iid, tig, bgn, end, reverse): apart, same_way, outtie, near, good or far.

    Only an innie pair can be good: its outer ends must lie within five standard deviations of the mean.
    """
    a = reads.select("iid", F.col("tig").alias("ta"), F.col("bgn").alias("ba"), F.col("end").alias("ea"), F.col("reverse").alias("ra"))
    b = reads.select(F.col("iid").alias("mate"), F.col("tig").alias("tb"), F.col("bgn").alias("bb"), F.col("end").alias("eb"), F.col("reverse").alias("rb"))
    fwd_bgn, rev_end = F.when(F.col("rb"), F.col("ba")).otherwise(F.col("bb")), F.when(F.col("rb"), F.col("eb")).otherwise(F.col("ea"))
    d = rev_end - fwd_bgn
    status = (
        F.when(F.col("ta") != F.col("tb"), "apart").when(F.col("ra") == F.col("rb"), "same_way").when(d < 0, "outtie")
        .when(d < mean - 5 * stddev, "near").when(d <= mean + 5 * stddev, "good").otherwise("far")
    )
    return mates.select("iid", "mate").join(a, "iid").join(b, "mate").select("iid", "mate", status.alias("status"))


def duplicate_reads(reads: DataFrame) -> DataFrame:
    """(iid, keeper) of reads(iid, tig, bgn, end, reverse) placed as one of lower id is."""
    same = reads.groupBy("tig", "bgn", "end", "reverse").agg(F.min("iid").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return reads.join(same, ["tig", "bgn", "end", "reverse"]).where("iid > keeper").select("iid", "keeper")


def duplicate_pairs(reads: DataFrame, mates: DataFrame) -> DataFrame:
    """(iid, mate, keeper): pairs of which both members are placed as those of a pair of lower id."""
    place = F.struct("tig", "bgn", "end", "reverse")
    p = reads.select("iid", place.alias("p"))
    j = mates.select("iid", "mate").join(p, "iid").join(p.select(F.col("iid").alias("mate"), F.col("p").alias("q")), "mate")
    keep = j.groupBy("p", "q").agg(F.min("iid").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return j.join(keep, ["p", "q"]).where("iid > keeper").select("iid", "mate", "keeper")


def split_discontinuous(reads: DataFrame, min_overlap: int = 40) -> DataFrame:
    """reads(iid, tig, bgn, end) with part, counted from 0: a part begins where a read overlaps what precedes it by less than min_overlap."""
    w = Window.partitionBy("tig").orderBy("bgn", "end", "iid")
    far = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = reads.withColumn("new", F.when(F.col("bgn") > far - min_overlap, 1).otherwise(0))
    return new.withColumn("part", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new")


def suspicious(ov: DataFrame) -> DataFrame:
    """(iid, pieces): reads that no other contains and whose overlaps cover them in more than one piece."""
    cls = overlap_class()
    inner = ov.where(cls == "contained").select(F.col("a_iid").alias("key")).distinct()
    span = ov.select(F.col("a_iid").alias("key"), F.greatest(F.lit(0), F.col("a_hang")).alias("bgn"), F.least(F.col("a_len"), F.col("a_len") + F.col("b_hang")).alias("end"))
    n = iv.islands(span.join(inner, "key", "left_anti")).groupBy("key").agg(F.count(F.lit(1)).alias("pieces"))
    return n.where("pieces > 1").select(F.col("key").alias("iid"), "pieces")


def repeat_rules(tigs: DataFrame, *, min_reads: int, min_length: int, span: float, astat: float, low_depth: float) -> DataFrame:
    """(tig, call, rule) of tigs(tig, reads, len, longest, astat, shallow): the first rule that holds.

    longest is the share of the tig that one read spans, shallow the share of it at depth low_depth's column or less.
    """
    rules = [
        ("single_read", F.col("reads") == 1, "repeat"), ("few_reads", F.col("reads") < min_reads, "repeat"), ("spanned", F.col("longest") > span, "repeat"),
        ("low_astat", F.col("astat") < astat, "repeat"), ("shallow", F.col("shallow") > low_depth, "repeat"), ("short", F.col("len") < min_length, "repeat"),
    ]
    name, call = F.lit("none"), F.lit("unique")
    for rule, holds, what in reversed(rules):
        name, call = F.when(holds, rule).otherwise(name), F.when(holds, what).otherwise(call)
    return tigs.select("tig", call.alias("call"), name.alias("rule"))


def base_calls(columns: DataFrame) -> DataFrame:
    """(tig, col, base, qv, depth) of columns(tig, col, base, qv), base one of -ACGT.

    Each symbol sums log(1 - e) over the reads that have it and log(e / 4) over the
    rest, with e = 10 ** (-qv / 10) and qv 0 read as 5; the greatest is called, its
    quality from the share of the others, 60 at most.  A single read keeps its own
    quality.  Logarithms are summed as decimals, so the order of rows has no effect.
    """
    e = F.pow(F.lit(10.0), -F.when(F.col("qv") == 0, 5).otherwise(F.col("qv")) / 10.0)
    fixed = lambda c: F.round(c, 9).cast("decimal(20,9)")
    hit, miss = fixed(F.log(1 - e)), fixed(F.log(e / 4))
    sums = [F.sum(F.when(F.col("base") == s, hit).otherwise(miss)).cast("double").alias(f"s{i}") for i, s in enumerate(SYMBOLS)]
    g = columns.where(F.col("base").isin(*SYMBOLS)).groupBy("tig", "col").agg(*sums, F.count(F.lit(1)).alias("depth"), F.max("qv").alias("own"))
    s = [F.col(f"s{i}") for i in range(5)]
    top = F.greatest(*s)
    call, which = F.lit(SYMBOLS[4]), F.lit(4)
    for i in range(3, -1, -1):
        call, which = F.when(s[i] == top, SYMBOLS[i]).otherwise(call), F.when(s[i] == top, i).otherwise(which)
    rest = sum(F.when(which == i, 0.0).otherwise(F.exp(s[i] - top)) for i in range(5))
    wrong = rest / (1 + rest)
    qv = F.when(wrong <= 1e-6, 60).otherwise(F.least(F.lit(60), F.round(-10 * F.log10(wrong)).cast("int")))
    return g.select("tig", "col", call.alias("base"), F.when(F.col("depth") == 1, F.col("own")).otherwise(qv).cast("int").alias("qv"), "depth")


def votes(columns: DataFrame) -> DataFrame:
    """(tig, col, base, change_to) of columns(tig, col, base, own): the strict majority of at least two votes where it differs from own."""
    n = columns.groupBy("tig", "col", "own", "base").agg(F.count(F.lit(1)).alias("n"))
    g = n.groupBy("tig", "col", "own").agg(F.sum("n").alias("total"), F.max(F.struct("n", "base")).alias("k"))
    return g.where("total > 1 and 2 * k.n > total and k.base <> own").select("tig", "col", "own", F.col("k.base").alias("change_to"), F.col("k.n").alias("votes"))
