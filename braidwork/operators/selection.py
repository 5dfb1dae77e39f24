"""Choosing and laying out rows: longest first to a total, weak overlaps, buckets, offsets, comparisons of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .overlaps import length_on_a, overlap_class
from .stats import spread


def longest_until(df: DataFrame, total: int, id_col: str = "id", len_col: str = "len") -> DataFrame:
    """The longest rows, of equals those of the least id, until their lengths reach total.

    Lengths are counted first, so the running sum goes over distinct lengths; of
    the last length just the rows still wanted are taken, by a distributed sort.
    """
    c = df.where(F.col(len_col).isNotNull()).groupBy(len_col).agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum(F.col(len_col) * F.col("c")).over(Window.orderBy(F.desc(len_col)))
    run = c.withColumn("before", upto - F.col(len_col) * F.col("c"))
    last = run.where(F.col("before") < total).orderBy(len_col).select(len_col, "before").first()
    if last is None:
        return df.limit(0)
    at, before = last
    want = -(-(total - before) // at) if at else 0
    return df.where(F.col(len_col) > at).unionByName(df.where(F.col(len_col) == at).orderBy(id_col).limit(int(want)))


def without_weak(ov: DataFrame, share: float) -> DataFrame:
    """Dovetails of each read end whose error is at most that of rank floor((n - 1) * share), counted from 0 in rising order."""
    d = ov.withColumn("cls", overlap_class()).where("cls in ('dovetail5', 'dovetail3')").withColumn("olen", length_on_a())
    c = d.groupBy("a_iid", "cls", "erate").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("a_iid", "cls")
    run = c.withColumn("upto", F.sum("c").over(w.orderBy("erate"))).withColumn("n", F.sum("c").over(w))
    cut = run.where(F.col("upto") > F.floor((F.col("n") - 1) * share)).groupBy("a_iid", "cls").agg(F.min("erate").alias("cut"))
    return d.join(cut, ["a_iid", "cls"]).where("erate <= cut").drop("cut")


def repeat_threshold(ov: DataFrame) -> DataFrame:
    """(threshold): mode + 2 * MAD of dovetails per read end, averaged over both ends."""
    d = ov.withColumn("key", overlap_class()).where("key in ('dovetail5', 'dovetail3')").groupBy("a_iid", "key").agg(F.count(F.lit(1)).alias("x"))
    return spread(d).agg((F.sum(F.col("mode") + 2 * F.col("mad")) / 2).alias("threshold"))


def log_buckets(values: DataFrame, base: float = 10.0) -> DataFrame:
    """(key, bucket, n, total, least, most, upto) of values(key, x) by the whole part of x's logarithm; x of 0 or less take no part."""
    b = values.where("x > 0").groupBy("key", F.floor(F.log(F.col("x")) / F.log(F.lit(base)) + 1e-9).alias("bucket"))
    g = b.agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("total"), F.min("x").alias("least"), F.max("x").alias("most"))
    return g.withColumn("upto", F.sum("n").over(Window.partitionBy("key").orderBy("bucket")))


def offsets(pieces: DataFrame, least_gap: int = 20) -> DataFrame:
    """(scaffold, ord, piece, next, bgn, end, gap) of pieces(scaffold, ord, piece, len, gap): places by running sums, gaps of at least least_gap."""
    w = Window.partitionBy("scaffold").orderBy("ord")
    p = pieces.withColumn("next", F.lead("piece").over(w)).withColumn("gap", F.when(F.col("next").isNotNull(), F.greatest(F.col("gap"), F.lit(least_gap))))
    before = F.coalesce(F.sum(F.col("len") + F.coalesce("gap", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return p.withColumn("bgn", before).withColumn("end", F.col("bgn") + F.col("len")).select("scaffold", "ord", "piece", "next", "bgn", "end", "gap")


def compared(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(key, before, after, change, status) of two runs' metrics: added, removed, same or changed."""
    j = a.select(key, F.col(value).alias("before")).join(b.select(key, F.col(value).alias("after")), key, "full_outer")
    status = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") == F.col("after"), "same").otherwise("changed")
    return j.withColumn("change", F.col("after") - F.col("before")).withColumn("status", status)


def random_until(df: DataFrame, total: int, seed: int, id_col: str = "id", len_col: str = "len", buckets: int = 4096) -> DataFrame:
    """Rows in the order of the MD5 of "seed:id", as many as it takes for their lengths to reach total.

    Lengths are summed by the first digits of the hash (`buckets` of them, a power of 16), and
    only the bucket in which the total is reached is sorted.
    """
    digits = len(f"{buckets - 1:x}")
    h = df.where(F.col(id_col).isNotNull() & F.col(len_col).isNotNull()).withColumn("__h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")).cast("binary")))
    b = h.groupBy(F.substring("__h", 1, digits).alias("b")).agg(F.sum(len_col).alias("n"))
    run = b.withColumn("before", F.sum("n").over(Window.orderBy("b")) - F.col("n"))  # at most `buckets` rows
    last = run.where(F.col("before") < total).orderBy(F.desc("b")).first()
    if last is None:
        return df.limit(0)
    head = F.substring("__h", 1, digits)
    w = Window.partitionBy(head).orderBy("__h", id_col).rowsBetween(Window.unboundedPreceding, -1)
    rest = h.where(head == last["b"]).withColumn("__n", F.coalesce(F.sum(len_col).over(w), F.lit(0))).where(F.col("__n") < total - last["before"])
    return h.where(head < last["b"]).select(df.columns).unionByName(rest.select(df.columns))


def random_share(df: DataFrame, share: float, seed: int, id_col: str = "id") -> DataFrame:
    """Rows whose id, hashed with a seed, falls into the lowest `share` of the hash's first 28 bits: the same at every run and layout."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")).cast("binary")), 1, 7), 16, 10).cast("long")
    return df.where(h < int(share * (1 << 28)))


def chosen_sets(df: DataFrame, first: str, second: str) -> DataFrame:
    """df with columns both, either, only_first and neither of two conditions, null counting as not met."""
    a, b = F.coalesce(F.expr(first), F.lit(False)), F.coalesce(F.expr(second), F.lit(False))
    return df.withColumns({"both": a & b, "either": a | b, "only_first": a & ~b, "neither": ~(a | b)})
