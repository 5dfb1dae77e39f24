"""The read store: lookups, scans, partitions, rules that records are checked and repaired by, clear ranges and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import settled

#: Least length of a read, mean and deviation of a library that states neither.
LEAST_LENGTH, DEFAULT_MEAN, DEFAULT_STDDEV = 64, 3000.0, 300.0
#: Column sets of a scan.
INF, SEQ, QLT = ("iid", "lib", "len", "deleted"), ("seq",), ("qlt",)


def lookup(reads: DataFrame, ids: list[int]) -> DataFrame:
    """The reads of some ids; the list reaches the scan as a filter."""
    return reads.where(F.col("iid").isin(ids))


def scan(reads: DataFrame, bgn: int, end: int, columns: tuple[str, ...] = INF, deleted: bool = False) -> DataFrame:
    """Reads of ids bgn to end, both included, with a set of columns; deleted ones only if asked for."""
    own = reads.where(F.col("iid").between(bgn, end))
    return (own if deleted else own.where(~F.col("deleted"))).select(*[c for c in columns if c in reads.columns])


def partitioned(reads: DataFrame, parts: DataFrame) -> DataFrame:
    """reads with the part that parts(part, iid) names; reads of no part are left out, a read of several stays in the least."""
    one = parts.groupBy("iid").agg(F.min("part").alias("part"))
    return reads.join(one, "iid")


def ranges(text: Column) -> Column:
    """The numbers of a list such as "3-5,9" as a sorted array without repeats; what is no number or range, or runs backwards, gives none."""
    def one(item):
        lo, hi = F.regexp_extract(item, r"^\s*(\d{1,18})", 1), F.regexp_extract(item, r"-\s*(\d{1,18})\s*$", 1)
        a, b = lo.cast("long"), F.when(hi != "", hi.cast("long")).otherwise(lo.cast("long"))
        return F.when(item.rlike(r"^\s*\d{1,18}\s*(-\s*\d{1,18}\s*)?$") & (a <= b), F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.split(F.coalesce(text, F.lit("")), ","), one))))


def with_mates(reads: DataFrame, mates: DataFrame, chosen: DataFrame) -> DataFrame:
    """The reads of chosen(iid) and the mates of those; mates(iid, mate) holds each pair both ways."""
    ids = chosen.select("iid").unionByName(mates.join(chosen.select("iid"), "iid", "left_semi").select(F.col("mate").alias("iid"))).distinct()
    return reads.join(ids, "iid", "left_semi")


def deleted_with_mates(reads: DataFrame, mates: DataFrame, gone: DataFrame, cascade: bool = True) -> DataFrame:
    """reads with deleted set for those of gone(iid), and for their mates if the deletion cascades."""
    ids = gone.select("iid").distinct()
    if cascade:
        ids = ids.unionByName(mates.join(ids, "iid", "left_semi").select(F.col("mate").alias("iid"))).distinct()
    hit = ids.select(F.col("iid").alias("__iid"))
    return reads.join(hit, F.col("iid") == F.col("__iid"), "left").withColumn("deleted", F.col("deleted") | F.col("__iid").isNotNull()).drop("__iid")


def checked_clear(reads: DataFrame, least: int = LEAST_LENGTH) -> DataFrame:
    """reads with clear ranges held within the read, the rules broken (errors) and whether the read is refused.

    A begin below 0 or an end beyond the read is set right and told; a range
    that is then turned round or shorter than `least` refuses the read.
    """
    bgn, end = F.greatest(F.col("clr_bgn"), F.lit(0)), F.least(F.col("clr_end"), F.col("len"))
    turned, short = bgn > end, end - bgn < least
    rules = (("clear begin below 0", F.col("clr_bgn") < 0), ("clear end beyond the read", F.col("clr_end") > F.col("len")), ("clear range turned round", turned), ("clear range too short", short))
    errors = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules]), lambda x: x.isNotNull())
    return reads.withColumns({"errors": errors, "refused": turned | short, "clr_bgn": bgn, "clr_end": end})


def checked_libraries(libs: DataFrame, fix: bool = True) -> DataFrame:
    """libs(lib, mean, stddev) repaired, with the rules broken.

    Neither positive: the defaults.  Mean not positive: ten deviations.
    Deviation not positive: a tenth of the mean.  With fix, a deviation of over
    a third or of under a tenth of the mean becomes a tenth of it.
    """
    m, s = F.col("mean"), F.col("stddev")
    neither = (m <= 0) & (s <= 0)
    m1, s1 = F.when(neither, DEFAULT_MEAN).otherwise(m), F.when(neither, DEFAULT_STDDEV).otherwise(s)
    no_mean = m1 <= 0
    m2 = F.when(no_mean, 10 * s1).otherwise(m1)
    no_dev = s1 <= 0
    s2 = F.when(no_dev, 0.1 * m2).otherwise(s1)
    wide = (m2 < 3 * s2) & F.lit(fix)
    s3 = F.when(wide, 0.1 * m2).otherwise(s2)
    narrow = (s3 + 0.001 < 0.1 * m2) & F.lit(fix)
    rules = (("neither positive", neither), ("mean", no_mean), ("deviation", no_dev), ("deviation too great", wide), ("deviation too small", narrow))
    errors = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules]), lambda x: x.isNotNull())
    return libs.withColumns({"errors": errors, "mean": m2, "stddev": F.when(narrow, 0.1 * m2).otherwise(s3)})


def checked_links(links: DataFrame, reads: DataFrame) -> DataFrame:
    """links(frag1, frag2) with the first rule that each breaks, or null.

    In order: a link of a read to itself, a read that is not there, a deleted
    read, reads of two libraries, a read that another link names too.
    """
    r1 = reads.select(F.col("iid").alias("frag1"), F.col("lib").alias("lib1"), F.col("deleted").alias("gone1"))
    r2 = reads.select(F.col("iid").alias("frag2"), F.col("lib").alias("lib2"), F.col("deleted").alias("gone2"))
    uses = links.select(F.explode(F.array_distinct(F.array("frag1", "frag2"))).alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n"))
    u1, u2 = uses.select(F.col("f").alias("frag1"), F.col("n").alias("n1")), uses.select(F.col("f").alias("frag2"), F.col("n").alias("n2"))
    j = links.join(r1, "frag1", "left").join(r2, "frag2", "left").join(u1, "frag1", "left").join(u2, "frag2", "left")
    error = (
        F.when(F.col("frag1") == F.col("frag2"), "self").when(F.col("lib1").isNull() | F.col("lib2").isNull(), "missing").when(F.col("gone1") | F.col("gone2"), "deleted")
        .when(F.col("lib1") != F.col("lib2"), "libraries").when((F.col("n1") > 1) | (F.col("n2") > 1), "mated")
    )
    return j.select(*links.columns, error.alias("error"))


def checked_placements(placements: DataFrame, reads: DataFrame) -> DataFrame:
    """placements(frag, bound1, bound2) with the first rule that each breaks, or null: a read between itself, equal bounds, a read that is not there or deleted."""
    out = placements
    for c in ("frag", "bound1", "bound2"):
        out = out.join(reads.select(F.col("iid").alias(c), F.col("deleted").alias(f"__{c}")), c, "left")
    gone = [F.col(f"__{c}") for c in ("frag", "bound1", "bound2")]
    error = (
        F.when((F.col("frag") == F.col("bound1")) | (F.col("frag") == F.col("bound2")), "self").when(F.col("bound1") == F.col("bound2"), "same bounds")
        .when(gone[0].isNull() | gone[1].isNull() | gone[2].isNull(), "missing").when(gone[0] | gone[1] | gone[2], "deleted")
    )
    return out.select(*placements.columns, error.alias("error"))


def checked_actions(actions: DataFrame, reads: DataFrame, mates: DataFrame, libs: DataFrame) -> DataFrame:
    """actions(ord, action, iid, lib) with the first rule that each breaks, or null.

    ADD: an id that the store has or that an earlier action adds, a library
    that is not there.  DELETE: a read that is not there, one that is deleted
    already, one that still has a mate.  IGNORE breaks none; others are unknown.
    """
    have = reads.select(F.col("iid").alias("__iid"), F.col("deleted").alias("__gone"))
    mated = mates.select(F.col("iid").alias("__mated")).distinct()
    known = libs.select(F.col("lib").alias("__lib")).distinct()
    first = actions.where("action = 'ADD'").groupBy(F.col("iid").alias("__added")).agg(F.min("ord").alias("__first"))
    j = actions.join(have, F.col("iid") == F.col("__iid"), "left").join(mated, F.col("iid") == F.col("__mated"), "left")
    j = j.join(known, F.col("lib") == F.col("__lib"), "left").join(first, F.col("iid") == F.col("__added"), "left")
    add = F.when(F.col("__iid").isNotNull() | (F.col("__first") < F.col("ord")), "exists").when(F.col("__lib").isNull(), "library")
    delete = F.when(F.col("__iid").isNull(), "missing").when(F.col("__gone"), "deleted").when(F.col("__mated").isNotNull(), "mated")
    error = F.when(F.col("action") == "ADD", add).when(F.col("action") == "DELETE", delete).when(F.col("action") != "IGNORE", "unknown")
    return j.select(*actions.columns, error.alias("error"))


def errors_by_library(checked: DataFrame) -> DataFrame:
    """(lib, error, n) of checked(lib, errors), with the totals over all libraries under lib null."""
    e = checked.select("lib", F.explode("errors").alias("error"))
    own = e.groupBy("lib", "error").agg(F.count(F.lit(1)).alias("n"))
    return own.unionByName(own.groupBy("error").agg(F.sum("n").alias("n")).select(F.lit(None).cast(e.schema["lib"].dataType).alias("lib"), "error", "n"))


def current_clear(versions: DataFrame, upto: int | None = None) -> DataFrame:
    """(iid, version, bgn, end): the clear range of the greatest version set for each read, of those not after `upto` (a revert).

    versions(iid, version, bgn, end); a range whose begin is beyond its end is not set.
    """
    own = versions.where("bgn <= end")
    if upto is not None:
        own = own.where(F.col("version") <= upto)
    k = own.groupBy("iid").agg(F.max(F.struct("version", "bgn", "end")).alias("k"))
    return k.select("iid", "k.version", "k.bgn", "k.end")


def with_vector_clear(reads: DataFrame, vector: DataFrame) -> DataFrame:
    """reads with vec_bgn and vec_end of vector(iid, bgn, end), held within the read; reads without are left (1, 0), as not set."""
    v = vector.groupBy("iid").agg(F.max(F.struct("bgn", "end")).alias("v"))
    j = reads.join(v, "iid", "left")
    return j.select(*reads.columns, F.coalesce(F.greatest("v.bgn", F.lit(0)), F.lit(1)).alias("vec_bgn"), F.coalesce(F.least("v.end", "len"), F.lit(0)).alias("vec_end"))


def totals(reads: DataFrame) -> DataFrame:
    """Per library, and under null over all: reads active and deleted, mated, lengths, clear lengths, least and greatest id."""
    on = ~F.col("deleted")
    return reads.rollup("lib").agg(
        F.count_if(on).alias("active"), F.count_if("deleted").alias("removed"), F.count_if(on & F.col("mate").isNotNull()).alias("mated"),
        F.sum(F.when(on, F.col("len"))).alias("letters"), F.sum(F.when(on, F.col("clr_end") - F.col("clr_bgn"))).alias("clear"), F.min("iid").alias("least"), F.max("iid").alias("most"),
    )


def dictionary(names: DataFrame, first: int = 1) -> DataFrame:
    """(uid, iid) of names(uid): numbers from `first` on in the order of the distinct names, by a range sort and counts of its parts."""
    spark = names.sparkSession
    d = names.select("uid").where("uid is not null").distinct().repartitionByRange("uid").sortWithinPartitions("uid").withColumn("part", F.spark_partition_id())
    d = settled(d.withColumn("at", F.monotonically_increasing_id() - F.shiftleft(F.col("part").cast("long"), 33)), "names")
    sizes = sorted((r["part"], r["n"]) for r in d.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())  # one row for each partition
    before, rows = first, []
    for part, n in sizes:
        rows.append((part, before))
        before += n
    base = spark.createDataFrame(rows, "part int, base long")
    return d.join(F.broadcast(base), "part").select("uid", (F.col("base") + F.col("at")).alias("iid"))


def blocks(requests: DataFrame, first: int = 1) -> DataFrame:
    """(requester, n, bgn, end) of requests(requester, n): consecutive stretches of unused numbers, by rising requester.

    Summed by ranges of requesters first, so no task holds them all.
    """
    spark = requests.sparkSession
    r = settled(requests.repartitionByRange("requester").withColumn("part", F.spark_partition_id()), "requests")
    sizes = sorted((x["part"], x["n"]) for x in r.groupBy("part").agg(F.sum("n").alias("n")).collect())  # one row for each partition
    before, rows = first, []
    for part, n in sizes:
        rows.append((part, before))
        before += n
    w = Window.partitionBy("part").orderBy("requester").rowsBetween(Window.unboundedPreceding, -1)
    j = r.join(F.broadcast(spark.createDataFrame(rows, "part int, base long")), "part")
    bgn = F.col("base") + F.coalesce(F.sum("n").over(w), F.lit(0))
    return j.select("requester", "n", bgn.alias("bgn"), (bgn + F.col("n")).alias("end"))
