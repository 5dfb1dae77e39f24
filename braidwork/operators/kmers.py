"""K-mer counting and the algebra of k-mer multisets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import canonical

#: Letters of a block.
BLOCK = 512


def kmers(seqs: DataFrame, k: int, canonical_only: bool = True) -> DataFrame:
    """(id, kmer) for every window of k letters that are all of ACGT; null and short sequences give none."""
    runs = seqs.select("id", F.explode(F.split("seq", "[^ACGT]+")).alias("run")).where(F.length("run") >= k)
    # a letter of a string is found from its start, so long runs are cut into overlapping blocks first
    blocks = runs.select("id", "run", F.explode(F.sequence(F.lit(0), F.floor((F.length("run") - k) / BLOCK).cast("int"))).alias("b"))
    blocks = blocks.select("id", F.substring("run", F.col("b") * BLOCK + 1, F.lit(BLOCK + k - 1)).alias("run"))
    s = blocks.select("id", "run", F.explode(F.sequence(F.lit(1), F.length("run") - (k - 1))).alias("i"))
    s = s.select("id", F.substring("run", F.col("i"), F.lit(k)).alias("kmer"))
    return s.withColumn("kmer", canonical(F.col("kmer"))) if canonical_only else s


def counts(seqs: DataFrame, k: int) -> DataFrame:
    """(kmer, n): counts are combined before the shuffle."""
    return kmers(seqs, k).groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))


def histogram(count: DataFrame) -> DataFrame:
    """(n, distinct_kmers, kmers): k-mers by how often they occur."""
    return count.groupBy("n").agg(F.count(F.lit(1)).alias("distinct_kmers")).withColumn("kmers", F.col("n") * F.col("distinct_kmers"))


def algebra(inputs: list[DataFrame], how: str) -> DataFrame:
    """(kmer, n) of several multisets.

    min (of all), minexist (of those that have it), max, maxexist (the greatest,
    of k-mers that all have), add; and, nand (in the first alone), or, xor (in an odd
    number of them), each with count 1; sub (first minus second), abs (their
    difference), divide (first by second, where both have it, at least 1).
    """
    tagged = None
    for i, c in enumerate(inputs):
        own = c.select("kmer", *(F.when(F.lit(i == j), F.col("n")).otherwise(0).cast("long").alias(f"n{j}") for j in range(len(inputs))))
        tagged = own if tagged is None else tagged.unionByName(own)
    names = [f"n{j}" for j in range(len(inputs))]
    g = tagged.groupBy("kmer").agg(*(F.sum(n).alias(n) for n in names))
    cols = [F.col(n) for n in names]
    present = sum(F.when(c > 0, 1).otherwise(0) for c in cols)
    value = {
        "min": F.least(*cols), "max": F.greatest(*cols), "add": sum(cols), "and": F.when(present == len(cols), F.lit(1)).otherwise(0),
        "minexist": F.least(*[F.when(c > 0, c) for c in cols]), "maxexist": F.when(present == len(cols), F.greatest(*cols)).otherwise(0),
        "nand": F.when((cols[0] > 0) & (present == 1), 1).otherwise(0), "or": F.when(present > 0, 1).otherwise(0), "abs": F.abs(cols[0] - cols[1]),
        "divide": F.when((cols[0] > 0) & (cols[1] > 0), F.greatest(F.lit(1), F.floor(cols[0] / F.when(cols[1] > 0, cols[1])))).otherwise(0),
        "xor": F.when(present % 2 == 1, 1).otherwise(0), "sub": F.greatest(F.lit(0), cols[0] - cols[1]),
    }[how].cast("long")
    return g.select("kmer", value.alias("n")).where("n > 0")


def within(count: DataFrame, least: int | None = None, most: int | None = None) -> DataFrame:
    """K-mers of counts from least to most; equal bounds: just that count."""
    if least is not None:
        count = count.where(F.col("n") >= least)
    return count if most is None else count.where(F.col("n") <= most)


def peak(histogram: DataFrame) -> DataFrame:
    """(valley, peak, threshold) of histogram(n, distinct_kmers), one row: the count with the fewest k-mers before
    they rise again, the count with most k-mers from there on, of equals the least, and twice the peak.

    A histogram that never rises has its first count as valley.  The rows are distinct counts, few whatever the input.
    """
    w = Window.orderBy("n")
    h = histogram.withColumn("next", F.lead("distinct_kmers").over(w))
    valley = h.agg(F.coalesce(F.min(F.when(F.col("next") > F.col("distinct_kmers"), F.col("n"))), F.min("n")).alias("valley"))
    j = histogram.join(F.broadcast(valley), F.col("n") >= F.col("valley"))
    g = j.agg(F.min("valley").alias("valley"), F.max(F.struct("distinct_kmers", (-F.col("n")).alias("m"))).alias("k"))
    return g.select("valley", (-F.col("k.m")).alias("peak"), (-2 * F.col("k.m")).alias("threshold"))


def presence_matrix(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a_class, b_class, n): distinct k-mers by their counts on both sides, absent being 0."""
    def cls(c):
        return F.when(c == 0, "0").when(c == 1, "1").when(c <= 10, "2-10").when(c <= 100, "11-100").otherwise("more")

    both = a.select("kmer", F.col("n").alias("na"), F.lit(0).cast("long").alias("nb")).unionByName(b.select("kmer", F.lit(0).cast("long").alias("na"), F.col("n").alias("nb")))
    g = both.groupBy("kmer").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"))
    return g.groupBy(cls(F.col("na")).alias("a_class"), cls(F.col("nb")).alias("b_class")).agg(F.count(F.lit(1)).alias("n"))
