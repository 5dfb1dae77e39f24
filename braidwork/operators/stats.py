"""Summary statistics of lengths, sizes and arrivals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def n_statistics(lengths: DataFrame, percents: list[int]) -> DataFrame:
    """(key, n, value): in descending order, the length at which the running sum reaches floor(total * n / 100).

    Lengths are counted first, so the window sorts distinct lengths of a key.
    """
    c = lengths.where("key is not null and len is not null").groupBy("key", "len").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("key").orderBy(F.desc("len"))
    run = c.select("key", "len", F.sum(F.col("len") * F.col("c")).over(w).alias("upto"), F.sum(F.col("len") * F.col("c")).over(Window.partitionBy("key")).alias("total"))
    each = run.withColumn("n", F.explode(F.array(*[F.lit(p) for p in percents])))
    return each.where(F.col("upto") >= F.floor(F.col("total") * F.col("n") / 100)).groupBy("key", "n").agg(F.max("len").alias("value"))


def spread(values: DataFrame) -> DataFrame:
    """(key, n, mean, stddev, median, mode, mad): median is the lower middle value, mode the least of the most frequent,
    mad 1.4826 times the lower median of the distances from the median."""
    v = values.where("key is not null and x is not null")
    c = v.groupBy("key", "x").agg(F.count(F.lit(1)).alias("c"))

    def middle(d: DataFrame, name: str) -> DataFrame:
        w = Window.partitionBy("key").orderBy("x")
        run = d.select("key", "x", F.sum("c").over(w).alias("upto"), F.sum("c").over(Window.partitionBy("key")).alias("total"))
        return run.where("upto * 2 >= total").groupBy("key").agg(F.min("x").alias(name))

    med = middle(c, "median")
    mode = c.groupBy("key").agg(F.max(F.struct("c", (-F.col("x")).alias("x"))).alias("m")).select("key", (-F.col("m.x")).alias("mode"))
    base = v.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("stddev"))
    away = c.join(med, "key").select("key", F.abs(F.col("x") - F.col("median")).alias("x"), "c").groupBy("key", "x").agg(F.sum("c").alias("c"))
    mad = middle(away, "away").select("key", (F.col("away") * 1.4826).alias("mad"))
    return base.join(med, "key").join(mode, "key").join(mad, "key")


def insert_sizes(sizes: DataFrame) -> DataFrame:
    """(key, n, mean, stddev) without outliers: those further from the median than five times the
    greater of its distances to the lower and upper third, each by rank.

    Sizes are counted first, so that the window sorts distinct sizes of a key.
    """
    c = sizes.where("key is not null and x is not null").groupBy("key", "x").agg(F.count(F.lit(1)).alias("c"))
    r = c.select("key", "x", F.sum("c").over(Window.partitionBy("key").orderBy("x")).alias("upto"), F.sum("c").over(Window.partitionBy("key")).alias("m"))
    at = lambda num, den: F.min(F.when(F.col("upto") >= F.floor(F.col("m") * num / den) + 1, F.col("x")))
    q = r.groupBy("key").agg(at(1, 2).alias("mid"), at(1, 3).alias("lo"), at(2, 3).alias("hi"))
    q = q.withColumn("far", 5 * F.greatest(F.col("mid") - F.col("lo"), F.col("hi") - F.col("mid")))
    kept = c.join(q, "key").where((F.col("x") >= F.col("mid") - F.col("far")) & (F.col("x") <= F.col("mid") + F.col("far")))
    g = kept.groupBy("key").agg(F.sum("c").alias("n"), F.sum(F.col("x") * F.col("c")).alias("s"))
    g = g.withColumn("avg", F.col("s") / F.col("n"))
    away = kept.join(g.select("key", "avg"), "key").groupBy("key").agg(F.sum(F.col("c") * (F.col("x") - F.col("avg")) ** 2).alias("q"))
    dev = F.when(F.col("n") > 1, F.sqrt(F.col("q") / F.greatest(F.col("n") - 1, F.lit(1)))).otherwise(0.0)
    return g.join(away, "key").select("key", "n", F.floor("avg").alias("mean"), F.floor(dev).alias("stddev"))


def arrival_statistic(reads: DataFrame, rate: float | None = None) -> DataFrame:
    """(tig, reads, rho, astat) of reads(tig, bgn, end).

    rho is the mean of the span of the reads' left ends and that of their right
    ends; the global rate is the reads beyond the first of each tig over the
    sum of rho; astat = rho * rate - ln 2 * (reads - 1), 0 if rate is 0.
    """
    t = reads.where("tig is not null").groupBy("tig").agg(
        F.count(F.lit(1)).alias("reads"), ((F.max("bgn") - F.min("bgn") + F.max("end") - F.min("end")) / 2).alias("rho")
    )
    if rate is None:
        g = t.agg((F.sum(F.col("reads") - 1) / F.sum("rho")).alias("rate"))  # one row
        t = t.join(F.broadcast(g))
    else:
        t = t.withColumn("rate", F.lit(rate))
    return t.select("tig", "reads", "rho", F.when(F.coalesce(F.col("rate"), F.lit(0.0)) == 0, 0.0).otherwise(F.col("rho") * F.col("rate") - 0.6931471805599453 * (F.col("reads") - 1)).alias("astat"))
