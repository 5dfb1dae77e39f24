"""Half-open intervals [bgn, end) of keys: depth, islands, coverage algebra, joins, lift-over.

Rows whose key, bgn or end is null and empty intervals take no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def solid(iv: DataFrame) -> DataFrame:
    return iv.where("key is not null and bgn < end")


def depth(iv: DataFrame) -> DataFrame:
    """(key, bgn, end, depth): stretches of constant positive depth.

    Endpoints are summed by (key, position), combined before the shuffle, so
    the window sorts distinct endpoints only; equal neighbours stay apart if an
    endpoint lies between them only by a change that sums to zero, which is dropped.
    """
    ends = solid(iv).select("key", F.explode(F.array(F.struct(F.col("bgn").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("d")))).alias("e"))
    steps = ends.groupBy("key", F.col("e.at").alias("at")).agg(F.sum("e.d").alias("d")).where("d <> 0")
    w = Window.partitionBy("key").orderBy("at")
    run = steps.select("key", F.col("at").alias("bgn"), F.lead("at").over(w).alias("end"), F.sum("d").over(w).alias("depth"))
    return run.where("depth > 0 and end is not null")


def islands(iv: DataFrame, min_overlap: int = 0) -> DataFrame:
    """(key, bgn, end, n): unions of intervals of which each overlaps those before it by at least min_overlap.

    Without min_overlap all intervals of one begin are put together before the
    window, which so sorts distinct begins of a key only.
    """
    w = Window.partitionBy("key").orderBy("bgn", "end")
    far = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    if min_overlap == 0:
        iv = solid(iv).groupBy("key", "bgn").agg(F.max("end").alias("end"), F.count(F.lit(1)).alias("c"))
    else:
        iv = solid(iv).withColumn("c", F.lit(1).cast("long"))
    marked = iv.select("key", "bgn", "end", "c", F.when(far.isNull() | (F.col("bgn") > far - min_overlap), 1).otherwise(0).alias("new"))
    grouped = marked.withColumn("g", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy("key", "g").agg(F.min("bgn").alias("bgn"), F.max("end").alias("end"), F.sum("c").alias("n")).drop("g")


def at_least(iv: DataFrame, d: int) -> DataFrame:
    """(key, bgn, end): the stretches of depth d or more, joined where they touch."""
    return islands(depth(iv).where(F.col("depth") >= d).select("key", "bgn", "end")).drop("n")


def longest(iv: DataFrame) -> DataFrame:
    """The longest interval of each key, the first of equals."""
    best = F.max_by(F.struct("bgn", "end"), F.struct((F.col("end") - F.col("bgn")).alias("n"), (-F.col("bgn")).alias("b")))
    return iv.groupBy("key").agg(best.alias("x")).select("key", "x.bgn", "x.end")


def algebra(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """(key, bgn, end, depth) of two coverages: "and" least depth, "or" greatest, "minus" a where b is not.

    Both are swept at once: one shuffle for the two inputs.
    """
    def ends(iv, side):
        e = F.array(*[F.struct(F.col(c).alias("at"), F.lit(v if side == 0 else 0).alias("da"), F.lit(v if side == 1 else 0).alias("db")) for c, v in (("bgn", 1), ("end", -1))])
        return solid(iv).select("key", F.explode(e).alias("e"))

    steps = ends(a, 0).unionByName(ends(b, 1)).groupBy("key", F.col("e.at").alias("at")).agg(F.sum("e.da").alias("da"), F.sum("e.db").alias("db"))
    w = Window.partitionBy("key").orderBy("at")
    run = steps.select("key", F.col("at").alias("bgn"), F.lead("at").over(w).alias("end"), F.sum("da").over(w).alias("x"), F.sum("db").over(w).alias("y"))
    value = {"and": F.least("x", "y"), "or": F.greatest("x", "y"), "minus": F.when(F.col("y") > 0, 0).otherwise(F.col("x"))}[how]
    return runs(run.select("key", "bgn", "end", value.alias("depth")).where("end is not null"))


def divide(iv: DataFrame, n: int) -> DataFrame:
    """Depth divided by n, rounded down."""
    return runs(depth(iv).withColumn("depth", F.floor(F.col("depth") / n)))


def complement(iv: DataFrame, bounds: DataFrame) -> DataFrame:
    """(key, bgn, end): what iv leaves of bounds(key, bgn, end), one interval for each key."""
    return algebra(bounds, iv, "minus").select("key", "bgn", "end")


def dilate(iv: DataFrame, n: int) -> DataFrame:
    """Every interval wider by n on both sides."""
    return solid(iv).select("key", (F.col("bgn") - n).alias("bgn"), (F.col("end") + n).alias("end"))


def runs(run: DataFrame) -> DataFrame:
    """Touching stretches of equal positive depth as one."""
    w = Window.partitionBy("key").orderBy("bgn")
    run = run.where("depth > 0")
    new = F.when((F.lag("end").over(w) == F.col("bgn")) & (F.lag("depth").over(w) == F.col("depth")), 0).otherwise(1)
    g = run.withColumn("new", new).withColumn("g", F.sum("new").over(w))
    return g.groupBy("key", "g", "depth").agg(F.min("bgn").alias("bgn"), F.max("end").alias("end")).select("key", "bgn", "end", "depth")


def intersecting(a: DataFrame, b: DataFrame, bin_size: int, how: str = "intersects") -> DataFrame:
    """Rows of a(key, bgn, end, ...) that some b intersects, "inside" which they lie, or which they "contain".

    Both sides are cut into bins of bin_size, so the join is an equi-join on
    (key, bin); a pair is tested in the bin where its intersection begins.
    """
    test = {"intersects": (F.col("bgn") < F.col("y")) & (F.col("x") < F.col("end")), "inside": (F.col("x") <= F.col("bgn")) & (F.col("end") <= F.col("y")), "contain": (F.col("bgn") <= F.col("x")) & (F.col("y") <= F.col("end"))}[how]
    bins = lambda lo, hi: F.sequence(F.floor(F.col(lo) / bin_size), F.floor((F.col(hi) - 1) / bin_size))
    left = solid(a).withColumn("bin", F.explode(bins("bgn", "end")))
    right = solid(b).select(F.col("key").alias("k"), F.col("bgn").alias("x"), F.col("end").alias("y")).distinct()
    right = right.withColumn("bin", F.explode(bins("x", "y"))).select("k", "x", "y", F.col("bin").alias("b"))
    hit = left.join(right, (F.col("key") == F.col("k")) & (F.col("bin") == F.col("b")) & test, "left_semi")
    return hit.drop("bin").distinct()


def lift_over(pos: DataFrame, placed: DataFrame) -> DataFrame:
    """Positions on pieces as positions on what the pieces are placed in.

    pos(piece, bgn, end), placed(piece, target, t_bgn, t_end, reverse): forward
    pieces shift by t_bgn, reversed ones are counted back from t_end.
    """
    j = pos.join(placed, "piece")
    return j.select(
        "piece", "target", F.when(F.col("reverse"), F.col("t_end") - F.col("end")).otherwise(F.col("t_bgn") + F.col("bgn")).alias("bgn"),
        F.when(F.col("reverse"), F.col("t_end") - F.col("bgn")).otherwise(F.col("t_bgn") + F.col("end")).alias("end"), F.when(F.col("reverse"), "r").otherwise("f").alias("ori"),
    )
