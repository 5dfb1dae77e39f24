"""Pairwise overlaps by their hangs: symmetry, classes, filters, best edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_LENGTH = 40


def symmetrised(ov: DataFrame) -> DataFrame:
    """Each overlap seen from both reads: hangs swap if flipped, else both change sign; lengths swap."""
    f = F.col("flipped")
    back = ov.select(
        F.col("b_iid").alias("a_iid"), F.col("a_iid").alias("b_iid"), F.when(f, F.col("b_hang")).otherwise(-F.col("a_hang")).alias("a_hang"),
        F.when(f, F.col("a_hang")).otherwise(-F.col("b_hang")).alias("b_hang"), "flipped", "erate", F.col("b_len").alias("a_len"), F.col("a_len").alias("b_len"),
    )
    return ov.select(*back.columns).unionByName(back)


def overlap_class() -> Column:
    a, b = F.col("a_hang"), F.col("b_hang")
    return (
        F.when((a < 0) & (b < 0), "dovetail5").when((a > 0) & (b > 0), "dovetail3").when((a == 0) & (b == 0), "equal").when((a >= 0) & (b <= 0), "contains").otherwise("contained")
    )


def length_on_a() -> Column:
    a, b, n = F.col("a_hang"), F.col("b_hang"), F.col("a_len")
    raw = F.when(a < 0, F.when(b < 0, n + b).otherwise(n)).otherwise(F.when(b < 0, n - a + b).otherwise(n - a))
    return F.greatest(F.lit(0), F.least(raw, n))


def good(cut: int, limit: int) -> Column:
    """Error at most cut ten-thousandths, or at most `limit` errors in ten-thousandths of a base."""
    return (F.col("erate") <= cut) | (F.lit(limit > 0) & (length_on_a() * F.col("erate") <= limit))


def best_edges(ov: DataFrame) -> DataFrame:
    """The best dovetail of each read end: longest on A, then least error, then the first stored (least b_iid and hangs)."""
    d = ov.withColumn("cls", overlap_class()).where("cls in ('dovetail5', 'dovetail3')").withColumn("olen", length_on_a())
    key = F.struct(F.col("olen"), (-F.col("erate")).alias("e"), (-F.col("b_iid")).alias("b"), (-F.col("a_hang")).alias("ah"), (-F.col("b_hang")).alias("bh"))
    best = d.groupBy("a_iid", F.substring("cls", 9, 1).alias("a_end")).agg(F.max(key).alias("k"))
    return best.select("a_iid", "a_end", (-F.col("k.b")).alias("b_iid"), F.col("k.olen").alias("olen"), (-F.col("k.e")).alias("erate"))


def best_containers(ov: DataFrame) -> DataFrame:
    """The best container of each contained read; of exact duplicates the lower id is the container."""
    c = ov.withColumn("cls", overlap_class()).where("cls = 'contained' or (cls = 'equal' and b_iid < a_iid)").withColumn("olen", length_on_a())
    key = F.struct(F.col("olen"), (-F.col("erate")).alias("e"), (-F.col("b_iid")).alias("b"))
    return c.groupBy("a_iid").agg(F.max(key).alias("k")).select("a_iid", (-F.col("k.b")).alias("container"), F.col("k.olen").alias("olen"))


def top_per_read(ov: DataFrame, most: int, max_erate: int, min_length: int = MIN_LENGTH) -> DataFrame:
    """At most `most` overlaps of each read, the longest, then of least error, then the first stored."""
    d = ov.withColumn("olen", length_on_a()).where((F.col("erate") <= max_erate) & (F.col("olen") >= min_length))
    w = Window.partitionBy("a_iid").orderBy(F.desc("olen"), "erate", "b_iid", "a_hang", "b_hang", "flipped")
    return d.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)


def per_read(ov: DataFrame) -> DataFrame:
    """Overlaps of each read by class."""
    cls = overlap_class()
    return ov.groupBy("a_iid").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(cls == c).alias(c) for c in ("dovetail5", "dovetail3", "contains", "contained", "equal")))


def spurs(ov: DataFrame) -> DataFrame:
    """Reads with overlaps that lack a best edge at just one end."""
    ends = best_edges(ov).groupBy("a_iid").agg(F.count(F.lit(1)).alias("n"), F.max("a_end").alias("a_end"))
    return ends.where("n = 1").select("a_iid", "a_end")
