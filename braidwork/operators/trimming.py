"""Overlaps as intervals on both reads, and what they say of the reads' ends, gaps and error rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import MAX_ERATE
from . import intervals as iv

#: Least distance of 5' ends, error limit in ten-thousandths, least length.
FAR_ENDS, LOW_ERATE, LONG = 29, 200, 75


def as_intervals(ov: DataFrame) -> DataFrame:
    """(a_iid, b_iid, fwd, a_beg, a_end, b_beg, b_end, erate, a_len, b_len); on a flipped b the begin is the greater."""
    beg, end = F.greatest(F.lit(0), -F.col("a_hang")), F.col("b_len") - F.greatest(F.lit(0), F.col("b_hang"))
    on_b = lambda c: F.when(F.col("flipped"), F.col("b_len") - c).otherwise(c)
    return ov.select(
        "a_iid", "b_iid", (~F.col("flipped")).alias("fwd"), F.greatest(F.lit(0), F.col("a_hang")).alias("a_beg"), (F.col("a_len") + F.least(F.lit(0), F.col("b_hang"))).alias("a_end"),
        on_b(beg).alias("b_beg"), on_b(end).alias("b_end"), "erate", "a_len", "b_len",
    )


def acceptable() -> Column:
    """Low error or length on both reads; a forward one must also have its begins far apart."""
    long = (F.col("a_end") - F.col("a_beg") > LONG) & (F.abs(F.col("b_end") - F.col("b_beg")) > LONG)
    far = ~F.col("fwd") | (F.abs(F.col("a_beg") - F.col("b_beg")) > FAR_ENDS)
    return ((F.col("erate") < LOW_ERATE) | long) & far


def trim_points(ov: DataFrame) -> DataFrame:
    """Per read, of its overlaps' begins: the least, the least seen twice, the most frequent (of equals the
    outermost) and its count; the same of their ends, outermost the greatest."""

    def side(col: str, name: str, sign: int) -> DataFrame:
        n = ov.groupBy("a_iid", F.col(col).alias("x")).agg(F.count(F.lit(1)).alias("n"))
        out = F.min if sign > 0 else F.max
        g = n.groupBy("a_iid").agg(out("x").alias(f"{name}_first"), out(F.when(F.col("n") > 1, F.col("x"))).alias(f"{name}_twice"), F.max(F.struct("n", (-sign * F.col("x")).alias("x"))).alias("m"))
        return g.select("a_iid", f"{name}_first", f"{name}_twice", (-sign * F.col("m.x")).alias(f"{name}_mode"), F.col("m.n").alias(f"{name}_count"))

    return side("a_beg", "bgn", 1).join(side("a_end", "end", -1), "a_iid")


def gaps_within(ov: DataFrame, least: int) -> DataFrame:
    """(iid, bgn, end): stretches of a read between its overlaps, each taken shorter by least // 2 - 1 at both ends."""
    cut = least // 2 - 1
    i = iv.islands(ov.select(F.col("a_iid").alias("key"), (F.col("a_beg") + cut).alias("bgn"), (F.col("a_end") - cut).alias("end")))
    w = Window.partitionBy("key").orderBy("bgn")
    g = i.select(F.col("key").alias("iid"), F.lag("end").over(w).alias("from"), F.col("bgn").alias("to")).where("from is not null")
    return g.select("iid", F.col("from").alias("bgn"), F.col("to").alias("end"))


def error_profile(ov: DataFrame) -> DataFrame:
    """(iid, bgn, end, depth, erate): mean of half the error codes of the overlaps over each stretch of a read.

    Only begins and ends are shuffled, summed by place first; half of a pair's errors are one read's own.
    """
    point = lambda at, s: F.struct(F.col(at).alias("at"), F.lit(s).alias("d"), (F.col("erate") * s).alias("e"))
    p = ov.where("a_beg < a_end").select(F.col("a_iid").alias("iid"), F.explode(F.array(point("a_beg", 1), point("a_end", -1))).alias("p"))
    p = p.groupBy("iid", "p.at").agg(F.sum("p.d").alias("d"), F.sum("p.e").alias("e"))
    w = Window.partitionBy("iid").orderBy("at")
    r = p.select("iid", F.col("at").alias("bgn"), F.lead("at").over(w).alias("end"), F.sum("d").over(w).alias("depth"), F.sum("e").over(w).alias("e"))
    return r.where("depth > 0").select("iid", "bgn", "end", "depth", (F.col("e") / (2 * F.col("depth"))).alias("erate"))


def high_errors(ov: DataFrame, rounds: int = 10, clip: float = 3.0, over: float = 2.0) -> DataFrame:
    """Overlaps whose error code is beyond mean + over * sigma, both from codes within `clip` sigmas, `rounds` times anew.

    The rounds go over the counts of codes, at most MAX_ERATE + 1 rows, on the driver.
    """
    code = F.least(F.col("erate"), F.lit(MAX_ERATE))
    counts = [(r["x"], r["n"]) for r in ov.where("erate >= 0").groupBy(code.alias("x")).agg(F.count(F.lit(1)).alias("n")).collect()]
    limit, mean, sigma = float("inf"), 0.0, 0.0
    for _ in range(rounds):
        kept = [(x, n) for x, n in counts if x <= limit]
        m, s, q = sum(n for _, n in kept), sum(x * n for x, n in kept), sum(x * x * n for x, n in kept)
        if m < 2:
            break
        mean = s / m
        sigma = max(0.0, (q - s * mean) / (m - 1)) ** 0.5
        limit = mean + clip * sigma
    return ov.where(F.lit(bool(counts)) & (code > mean + over * sigma))


def bad_windows(columns: DataFrame, width: int, low: int, most: int) -> DataFrame:
    """(iid, col): the last columns of windows of `width` columns with more than `most` qualities below `low`."""
    w = Window.partitionBy("iid").orderBy("col").rowsBetween(1 - width, 0)
    n = columns.select("iid", "col", F.count_if(F.col("qv") < low).over(w).alias("bad"))
    return n.where(F.col("bad") > most)
