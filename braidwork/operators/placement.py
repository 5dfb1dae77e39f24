"""Reads and tigs placed on others: the overlaps that follow, clusters of placements, break points, links, AGP lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import intervals as iv
from .selection import offsets
from .tigs import mate_status


def implied_overlaps(reads: DataFrame, bin_size: int, least: int) -> DataFrame:
    """(a_iid, b_iid, a_hang, b_hang, flipped): reads(iid, tig, bgn, end, reverse) of one tig that share `least` places or more.

    An equi-join on (tig, bin), each pair found once, in the bin where its
    intersection begins.  Hangs are a's: those of a reversed a swap and change sign.
    """
    n = F.lit(bin_size)
    r = reads.where("bgn < end").withColumn("bin", F.explode(F.sequence(F.floor(F.col("bgn") / n), F.floor((F.col("end") - 1) / n))))
    a = r.select("tig", "bin", F.col("iid").alias("a_iid"), F.col("bgn").alias("x"), F.col("end").alias("y"), F.col("reverse").alias("r"))
    b = r.select("tig", "bin", F.col("iid").alias("b_iid"), F.col("bgn").alias("u"), F.col("end").alias("v"), F.col("reverse").alias("s"))
    begin = F.greatest("x", "u")
    j = a.join(b, ["tig", "bin"]).where((F.col("a_iid") < F.col("b_iid")) & (F.least("y", "v") - begin >= max(1, least)) & (F.floor(begin / n) == F.col("bin")))
    return j.select(
        "a_iid", "b_iid", F.when(F.col("r"), F.col("y") - F.col("v")).otherwise(F.col("u") - F.col("x")).alias("a_hang"),
        F.when(F.col("r"), F.col("x") - F.col("u")).otherwise(F.col("v") - F.col("y")).alias("b_hang"), (F.col("r") != F.col("s")).alias("flipped"),
    )


def placement_clusters(placed: DataFrame, slop: int) -> DataFrame:
    """(iid, tig, reverse, bgn, end, n, errors) of placed(iid, tig, reverse, bgn, end, errors).

    Begins no more than slop apart chain into one group, and so do ends; placements
    of one group of begins and one of ends are a cluster.
    """
    key = ["iid", "tig", "reverse"]

    def chained(d: DataFrame, at: str, name: str) -> DataFrame:
        w = Window.partitionBy(*key).orderBy(at)
        new = F.when(F.col(at) - F.lag(at).over(w) <= slop, 0).otherwise(1)
        return d.withColumn("new", new).withColumn(name, F.sum("new").over(w)).drop("new")

    g = chained(chained(placed, "bgn", "from"), "end", "to").groupBy(*key, "from", "to")
    return g.agg(F.min("bgn").alias("bgn"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n"), F.sum("errors").alias("errors")).drop("from", "to")


def break_points(reads: DataFrame, mates: DataFrame, mean: float, stddev: float, least: int) -> DataFrame:
    """(tig, status, bgn, end): where at least `least` spans of mates too near or too far lie over each other."""
    s = mate_status(reads, mates, mean, stddev).where("status in ('near', 'far')")
    p = reads.select("iid", "tig", "bgn", "end")
    j = s.join(p, "iid").join(p.select(F.col("iid").alias("mate"), F.col("bgn").alias("b"), F.col("end").alias("e")), "mate")
    spans = j.select(F.struct("tig", "status").alias("key"), F.least("bgn", "b").alias("bgn"), F.greatest("end", "e").alias("end"))
    return iv.at_least(spans, least).select("key.tig", "key.status", "bgn", "end")


def rocks(links: DataFrame, tigs: DataFrame, least: int = 2, astat: float = -2.0) -> DataFrame:
    """(tig, scaffold, n): tigs whose links(tig, scaffold), `least` or more, all go to one scaffold, and whose statistic is astat or more."""
    one = links.groupBy("tig").agg(F.min("scaffold").alias("scaffold"), F.max("scaffold").alias("other"), F.count(F.lit(1)).alias("n"))
    good = tigs.where(F.col("astat") >= astat).select("tig")
    return one.where((F.col("scaffold") == F.col("other")) & (F.col("n") >= least)).join(good, "tig", "left_semi").select("tig", "scaffold", "n")


def agp_lines(pieces: DataFrame, least_gap: int = 20) -> DataFrame:
    """(object, object_beg, object_end, part_number, component_type, component) of pieces(scaffold, ord, piece, len, gap): places from 1, gaps as N lines."""
    n = F.row_number().over(Window.partitionBy("scaffold").orderBy("ord")).cast("long")
    o = offsets(pieces, least_gap).withColumn("n", n)
    line = lambda bgn, end, part, kind, what: F.struct(bgn.alias("object_beg"), end.alias("object_end"), part.alias("part_number"), F.lit(kind).alias("component_type"), what.alias("component"))
    piece = line(F.col("bgn") + 1, F.col("end"), F.col("n") * 2 - 1, "W", F.col("piece").cast("string"))
    gap = line(F.col("end") + 1, F.col("end") + F.col("gap"), F.col("n") * 2, "N", F.col("gap").cast("string"))
    both = F.when(F.col("gap").isNotNull(), F.array(piece, gap)).otherwise(F.array(piece))
    return o.select(F.col("scaffold").alias("object"), F.explode(both).alias("l")).select("object", "l.*")


def surrogate_reads(reads: DataFrame, mates: DataFrame, instances: DataFrame, placed: DataFrame) -> DataFrame:
    """(iid, instance): reads(iid, tig) of a surrogate tig, in its one instance(tig, instance, scaffold) in the scaffold of the mate.

    placed(iid, scaffold) are the mates that lie in a scaffold.  A scaffold with two
    instances of the tig or more leaves the read open.
    """
    one = instances.groupBy("tig", "scaffold").agg(F.min("instance").alias("instance"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    both = mates.select("iid", "mate").unionByName(mates.select(F.col("mate").alias("iid"), F.col("iid").alias("mate")))
    at = reads.select("iid", "tig").join(both, "iid").join(placed.select(F.col("iid").alias("mate"), "scaffold"), "mate")
    return at.join(one, ["tig", "scaffold"]).select("iid", "instance")
