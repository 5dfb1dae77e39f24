"""Statistics of stores and assemblies, layouts as rows, and the lines of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import intervals as iv
from .overlaps import length_on_a, overlap_class
from .stats import spread

#: Fixed value: the order of record kinds in a final report.
REPORT_ORDER = ("MDI", "AFG", "AMP", "UTG", "ULK", "CCO", "CLK", "SCF", "SLK")
LEAST_GAP = 20


# overlaps of a store


def dump_filter(ov: DataFrame, most_error: int | None = None, least_length: int | None = None, ends: str = "53Cc=", ids: tuple[int, int] | None = None, partner: int | None = None) -> DataFrame:
    """Overlaps by error code, length, kind (5, 3, C contains, c contained, = equal), range of a_iid and partner, each if asked for."""
    cls = {"5": "dovetail5", "3": "dovetail3", "C": "contains", "c": "contained", "=": "equal"}
    if ids is not None:
        ov = ov.where(F.col("a_iid").between(*ids))
    if partner is not None:
        ov = ov.where(F.col("b_iid") == partner)
    if most_error is not None:
        ov = ov.where(F.col("erate") <= most_error)
    if least_length is not None:
        ov = ov.where(length_on_a() >= least_length)
    return ov.where(overlap_class().isin([cls[c] for c in ends]))


def merged_stores(first: DataFrame, second: DataFrame) -> DataFrame:
    """Overlaps of two stores, those of both once."""
    return first.unionByName(second.select(first.columns)).distinct()


def among(ov: DataFrame, ids: DataFrame) -> DataFrame:
    """Overlaps whose reads are both in ids(iid)."""
    a, b = ids.select(F.col("iid").alias("a_iid")), ids.select(F.col("iid").alias("b_iid"))
    return ov.join(a, "a_iid", "left_semi").join(b, "b_iid", "left_semi")


def build_filter(ov: DataFrame, libs: DataFrame, most_error: int) -> DataFrame:
    """Overlaps that a store keeps, by flags of libs(iid, lib, dedup): at most the error code, and those between different
    libraries only if neither read's library is for duplicates alone."""
    a = libs.select(F.col("iid").alias("a_iid"), F.col("lib").alias("lib_a"), F.col("dedup").alias("da"))
    b = libs.select(F.col("iid").alias("b_iid"), F.col("lib").alias("lib_b"), F.col("dedup").alias("db"))
    j = ov.where(F.col("erate") <= most_error).join(a, "a_iid").join(b, "b_iid")
    return j.where((F.col("lib_a") == F.col("lib_b")) | ~(F.col("da") | F.col("db"))).select(*ov.columns)


def with_errors(ov: DataFrame, erates: DataFrame) -> DataFrame:
    """ov with the error codes of erates(a_iid, b_iid, erate) where there is one, the least of several."""
    new = erates.groupBy("a_iid", "b_iid").agg(F.min("erate").alias("__new"))
    return ov.join(new, ["a_iid", "b_iid"], "left").withColumn("erate", F.coalesce("__new", "erate")).select(*ov.columns)


def compared_pairs(true: DataFrame, found: DataFrame) -> DataFrame:
    """(status, n): pairs of reads, whichever comes first, that are in both, missed or false."""
    def pairs(d, name):
        return d.select(F.least("a_iid", "b_iid").alias("x"), F.greatest("a_iid", "b_iid").alias("y")).distinct().withColumn(name, F.lit(True))

    j = pairs(true, "t").join(pairs(found, "f"), ["x", "y"], "full_outer")
    return j.groupBy(F.when(F.col("f").isNull(), "missed").when(F.col("t").isNull(), "false").otherwise("both").alias("status")).agg(F.count(F.lit(1)).alias("n"))


def mates_overlapping(ov: DataFrame, mates: DataFrame) -> DataFrame:
    """Overlaps between a read and its mate; mates(iid, mate) both ways."""
    m = mates.select(F.col("iid").alias("a_iid"), F.col("mate").alias("b_iid"))
    return ov.join(m, ["a_iid", "b_iid"], "left_semi")


def block_plan(n_hash: int, n_ref: int, spark) -> DataFrame:
    """(job, hash_block, ref_block): all pairs of blocks of which the reference block is not after the hash block."""
    h = spark.range(1, n_hash + 1).select(F.col("id").alias("hash_block"))
    j = h.select("hash_block", F.explode(F.sequence(F.lit(1), F.least(F.col("hash_block"), F.lit(n_ref)))).alias("ref_block"))
    before = F.when(F.col("hash_block") <= n_ref + 1, F.col("hash_block") * (F.col("hash_block") - 1) / 2).otherwise(n_ref * (n_ref + 1) / 2 + (F.col("hash_block") - n_ref - 1) * n_ref)
    return j.select((before.cast("long") + F.col("ref_block")).alias("job"), "hash_block", "ref_block")


def end_errors(ov: DataFrame, repeat_from: int) -> DataFrame:
    """(kind, erate, n, letters): dovetails by error code, apart for ends with repeat_from or more of them (repeat) and others (unique)."""
    d = ov.withColumn("cls", overlap_class()).where("cls in ('dovetail5', 'dovetail3')").withColumn("olen", length_on_a())
    n = d.groupBy("a_iid", "cls", "erate").agg(F.count(F.lit(1)).alias("n"), F.sum("olen").alias("letters"))
    w = Window.partitionBy("a_iid", "cls")
    k = n.withColumn("kind", F.when(F.sum("n").over(w) >= repeat_from, "repeat").otherwise("unique"))
    return k.groupBy("kind", "erate").agg(F.sum("n").alias("n"), F.sum("letters").alias("letters"))


def top_per_end(ov: DataFrame, most: int) -> DataFrame:
    """The `most` dovetails of least error at each read end, of equals the longest, then the first stored."""
    d = ov.withColumn("cls", overlap_class()).where("cls in ('dovetail5', 'dovetail3')").withColumn("olen", length_on_a())
    w = Window.partitionBy("a_iid", "cls").orderBy("erate", F.desc("olen"), "b_iid", "a_hang", "b_hang", "flipped")
    return d.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).drop("n")


def duplicate_pairs_by_overlap(ov: DataFrame, mates: DataFrame, slop: int) -> DataFrame:
    """(iid, mate, keeper): pairs (a, a') of which a overlaps b and a' overlaps b', both with begins within slop, b and b' a pair of lower id.

    mates(iid, mate) both ways; the keeper is the least such b.
    """
    near = ov.where((F.abs("a_hang") <= slop) & (F.col("b_iid") < F.col("a_iid"))).select("a_iid", "b_iid").distinct()
    m1 = mates.select(F.col("iid").alias("a_iid"), F.col("mate").alias("a2"))
    m2 = mates.select(F.col("iid").alias("b_iid"), F.col("mate").alias("b2"))
    other = ov.where(F.abs("a_hang") <= slop).select(F.col("a_iid").alias("a2"), F.col("b_iid").alias("b2")).distinct()
    j = near.join(m1, "a_iid").join(m2, "b_iid").join(other, ["a2", "b2"], "left_semi")
    return j.groupBy(F.col("a_iid").alias("iid"), F.col("a2").alias("mate")).agg(F.min("b_iid").alias("keeper"))


def intersections(ov: DataFrame, placed: DataFrame) -> DataFrame:
    """(tig, other, iid, n): how many overlaps lead into each read from reads of other tigs, by placed(iid, tig)."""
    a, b = placed.select(F.col("iid").alias("a_iid"), F.col("tig").alias("ta")), placed.select(F.col("iid").alias("b_iid"), F.col("tig").alias("tb"))
    j = ov.join(a, "a_iid").join(b, "b_iid").where("ta <> tb")
    return j.groupBy(F.col("ta").alias("tig"), F.col("tb").alias("other"), F.col("a_iid").alias("iid")).agg(F.count(F.lit(1)).alias("n"))


def repeat_models(ov: DataFrame, libs: DataFrame) -> DataFrame:
    """(lib, threshold): mode + 2 * MAD of dovetails per read end, averaged over both ends, for each library of libs(iid, lib)."""
    d = ov.withColumn("cls", overlap_class()).where("cls in ('dovetail5', 'dovetail3')").groupBy("a_iid", "cls").agg(F.count(F.lit(1)).alias("x"))
    j = d.join(libs.select(F.col("iid").alias("a_iid"), "lib"), "a_iid").select(F.struct("lib", "cls").alias("key"), "x")
    return spread(j).groupBy(F.col("key.lib").alias("lib")).agg(F.avg(F.col("mode") + 2 * F.col("mad")).alias("threshold"))


def solid_clear(ov: DataFrame, min_overlap: int, min_depth: int) -> DataFrame:
    """(iid, bgn, end): of the unions of a read's overlaps, cut to where min_depth of them lie, the longest, of equals the first.

    ov(a_iid, a_beg, a_end).
    """
    i = ov.select(F.col("a_iid").alias("key"), F.col("a_beg").alias("bgn"), F.col("a_end").alias("end"))
    both = iv.algebra(iv.islands(i, min_overlap), iv.at_least(i, min_depth), "and")
    return iv.longest(iv.islands(both)).select(F.col("key").alias("iid"), "bgn", "end")


# trims


def decided_trim(points: DataFrame, least_count: int) -> DataFrame:
    """points with bgn and end by their evidence: the most frequent place if it is seen least_count times, else the
    least seen twice, else the outermost; (iid, bgn, end, by) where `by` names the evidence of the begin.
    """
    def side(name):
        often = F.col(f"{name}_count") >= least_count
        twice = F.col(f"{name}_twice").isNotNull()
        return F.when(often, F.col(f"{name}_mode")).when(twice, F.col(f"{name}_twice")).otherwise(F.col(f"{name}_first")), F.when(often, "mode").when(twice, "twice").otherwise("first")

    (bgn, by), (end, _) = side("bgn"), side("end")
    return points.select(F.col("a_iid").alias("iid"), bgn.alias("bgn"), end.alias("end"), by.alias("by"))


def within_max(trims: DataFrame, reads: DataFrame, least: int) -> DataFrame:
    """reads(iid, max_bgn, max_end) with their trim (iid, bgn, end) held within the greatest clear range; reads without a trim
    keep that range; what is then shorter than `least` is deleted."""
    j = reads.join(trims.select("iid", "bgn", "end"), "iid", "left")
    bgn, end = F.greatest(F.coalesce("bgn", "max_bgn"), F.col("max_bgn")), F.least(F.coalesce("end", "max_end"), F.col("max_end"))
    return j.select("iid", bgn.alias("bgn"), end.alias("end"), (end - bgn < least).alias("deleted"))


# layouts


def rows_of_layout(intervals: DataFrame, room: int = 0) -> DataFrame:
    """intervals(key, bgn, end, ...) with the display row of each: the number of intervals of its key, not after it in
    the order of begin and end, that still cover its begin or end within `room` before it, less one.

    No two of a row overlap only if ends rise with begins; others may share a row's band, so the depth at the begin is
    the number of rows needed there.  A sum over endpoints, no pass along the axis in one task.
    """
    w = Window.partitionBy("key").orderBy("at", "kind", "o_end")
    ends = intervals.select("key", (F.col("end") + room).alias("at"), F.lit(0).alias("kind"), F.col("end").alias("o_end"), F.lit(-1).alias("d"), F.lit(None).cast("long").alias("bgn"))
    begins = intervals.select("key", F.col("bgn").alias("at"), F.lit(1).alias("kind"), F.col("end").alias("o_end"), F.lit(1).alias("d"), F.col("bgn").alias("bgn"))
    s = ends.unionByName(begins).withColumn("row", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return s.where("kind = 1").select("key", "bgn", F.col("o_end").alias("end"), "row")


def in_view(intervals: DataFrame, bgn: int, end: int) -> DataFrame:
    """Intervals that lie in or reach into the stretch bgn to end, cut to it."""
    own = intervals.where((F.col("bgn") < end) & (F.col("end") > bgn))
    return own.withColumns({"bgn": F.greatest("bgn", F.lit(bgn)), "end": F.least("end", F.lit(end))})


def lengths(intervals: DataFrame) -> DataFrame:
    """(key, n, total, mean, stddev) of the lengths of intervals, the deviation that of the whole population."""
    x = F.col("end") - F.col("bgn")
    return intervals.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("total"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("stddev"))


def members(links: DataFrame, segments: DataFrame) -> DataFrame:
    """The segments that links(link, members) name, each once."""
    ids = links.select(F.explode("members").alias("line")).distinct()
    return segments.join(ids, "line", "left_semi")


# tigs and scaffolds


def layout_order(reads: DataFrame) -> DataFrame:
    """reads(tig, iid, bgn, end) with their place in the tig: by begin, longest first, then id."""
    w = Window.partitionBy("tig").orderBy("bgn", F.desc("end"), "iid")
    return reads.withColumn("place", F.row_number().over(w))


def stash(reads: DataFrame) -> DataFrame:
    """Reads of a tig that reach beyond all reads before them (kept), and whether each does."""
    w = Window.partitionBy("tig").orderBy("bgn", F.desc("end"), "iid").rowsBetween(Window.unboundedPreceding, -1)
    return reads.withColumn("kept", F.coalesce(F.col("end") > F.max("end").over(w), F.lit(True)))


def broken(reads: DataFrame, points: DataFrame) -> DataFrame:
    """reads(tig, iid, bgn, end) with the piece of the tig that each goes to, counted from 0: the number of points(tig, at) at or before its middle."""
    p = points.select("tig", "at").distinct()
    mid = F.floor((F.col("bgn") + F.col("end")) / 2)
    n = reads.join(p, "tig").where(F.col("at") <= mid).groupBy("tig", "iid").agg(F.count(F.lit(1)).alias("piece"))
    return reads.join(n, ["tig", "iid"], "left").withColumn("piece", F.coalesce("piece", F.lit(0).cast("long")))


def split_points(reads: DataFrame, bad: DataFrame, good: DataFrame, most_depth: int, least_bad: int, most_good: int) -> DataFrame:
    """(key, bgn, end): stretches within a tig of at most most_depth reads, least_bad or more bad spans and at most most_good good ones.

    Each input is intervals(key, bgn, end); depths are summed over endpoints.
    """
    d = iv.depth(bad).where(F.col("depth") >= least_bad)
    out = iv.algebra(d, iv.depth(good).where(F.col("depth") > most_good), "minus")
    out = iv.algebra(out, iv.depth(reads).where(F.col("depth") > most_depth), "minus")
    return iv.islands(out).select("key", "bgn", "end")


def tig_statistics(tigs: DataFrame) -> DataFrame:
    """(kind, n, total, least, most, mean, gc) of tigs(kind, len, gc); gc is the share of letters."""
    return tigs.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), F.sum("len").alias("total"), F.min("len").alias("least"), F.max("len").alias("most"), F.avg("len").alias("mean"), (F.sum("gc") / F.sum("len")).alias("gc")
    )


def scaffold_statistics(pieces: DataFrame) -> DataFrame:
    """(scaffold, pieces, letters, gaps, span) of pieces(scaffold, ord, len, gap): gaps of at least LEAST_GAP after all but the last."""
    last = pieces.groupBy("scaffold").agg(F.max("ord").alias("__last"))
    gap = F.when(F.col("ord") < F.col("__last"), F.greatest(F.col("gap"), F.lit(LEAST_GAP))).otherwise(0)
    g = pieces.join(last, "scaffold").groupBy("scaffold").agg(F.count(F.lit(1)).alias("pieces"), F.sum("len").alias("letters"), F.sum(gap).alias("gaps"))
    return g.withColumn("span", F.col("letters") + F.col("gaps"))


def trust(edges: DataFrame, places: DataFrame, deviations: float = 3.0) -> DataFrame:
    """edges(id_a, id_b, mean, variance) within a scaffold with their status by places(piece, scaffold, bgn, end): trusted if the
    gap between the pieces is within some deviations of the mean, else tentative; edges between scaffolds are left out."""
    a = places.select(F.col("piece").alias("id_a"), F.col("scaffold").alias("sa"), F.col("bgn").alias("ba"), F.col("end").alias("ea"))
    b = places.select(F.col("piece").alias("id_b"), F.col("scaffold").alias("sb"), F.col("bgn").alias("bb"), F.col("end").alias("eb"))
    j = edges.join(a, "id_a").join(b, "id_b").where("sa = sb")
    gap = F.greatest("ba", "bb") - F.least("ea", "eb")
    ok = F.abs(gap - F.col("mean")) <= deviations * F.sqrt("variance")
    return j.select("id_a", "id_b", gap.alias("gap"), F.when(ok, "trusted").otherwise("tentative").alias("status"))


def repeat_coverage(depths: DataFrame) -> DataFrame:
    """(low, high, threshold) of depths(x): the quartiles, and the upper one and one and a half times their distance beyond it."""
    q = depths.agg(F.expr("percentile_disc(0.25) WITHIN GROUP (ORDER BY x)").alias("low"), F.expr("percentile_disc(0.75) WITHIN GROUP (ORDER BY x)").alias("high"))
    return q.withColumn("threshold", F.col("high") + 1.5 * (F.col("high") - F.col("low")))


def covered_by_others(ov: DataFrame) -> DataFrame:
    """(lib_a, lib_b, reads, letters): reads of one library that another one's overlaps cover at all, and how many of their letters.

    ov(a_iid, lib_a, lib_b, a_beg, a_end).
    """
    i = iv.islands(ov.select(F.struct("a_iid", "lib_a", "lib_b").alias("key"), F.col("a_beg").alias("bgn"), F.col("a_end").alias("end")))
    per = i.groupBy("key").agg(F.sum(F.col("end") - F.col("bgn")).alias("letters"))
    return per.groupBy(F.col("key.lib_a").alias("lib_a"), F.col("key.lib_b").alias("lib_b")).agg(F.count(F.lit(1)).alias("reads"), F.sum("letters").alias("letters"))


def smoothed(columns: DataFrame, width: int) -> DataFrame:
    """columns(iid, col, x, gap) with the mean of x over the columns of no gap among the `width` on either side and its own; null if there is none."""
    w = Window.partitionBy("iid").orderBy("col").rowsBetween(-width, width)
    return columns.withColumn("smooth", F.avg(F.when(~F.col("gap"), F.col("x"))).over(w))


def merged_corrections(parts: list[DataFrame]) -> DataFrame:
    """Corrections(iid, at, letter) of several jobs as one table in the order of iid and at; of a place named by several jobs the least letter."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("iid", "at").agg(F.min("letter").alias("letter")).repartitionByRange("iid", "at").sortWithinPartitions("iid", "at")


def letters(texts: DataFrame, col: str = "seq") -> DataFrame:
    """(letter, n): how often each letter occurs, in lower case; summed within each text first."""
    each = F.explode(F.split(F.lower(col), ""))
    return texts.select(each.alias("letter")).where("letter <> ''").groupBy("letter").agg(F.count(F.lit(1)).alias("n"))


# lines


def unique_unique(tigs: DataFrame, places: DataFrame, least: int) -> DataFrame:
    """(tig, class) of tigs(tig, len) that occur in places(tig, scaffold, ord): of one place and at least `least` long unique, at the
    first or last place of a scaffold alone an end, else a middle."""
    w = places.groupBy("scaffold").agg(F.min("ord").alias("lo"), F.max("ord").alias("hi"))
    p = places.join(w, "scaffold").groupBy("tig").agg(F.count(F.lit(1)).alias("n"), F.bool_and((F.col("ord") == F.col("lo")) | (F.col("ord") == F.col("hi"))).alias("outer"))
    return p.join(tigs, "tig").select("tig", F.when((F.col("n") == 1) & (F.col("len") >= least), "unique").when(F.col("outer"), "end").otherwise("middle").alias("class"))


def voted(mates: DataFrame, votes: DataFrame, least: int) -> DataFrame:
    """mates(iid, mate) with how often votes(iid, kind) call the pair's first read innie or outtie, and the kind that has at
    least `least` votes and more than the other, else unknown."""
    v = votes.groupBy("iid").agg(F.count_if(F.col("kind") == "innie").alias("innie"), F.count_if(F.col("kind") == "outtie").alias("outtie"))
    j = mates.join(v, "iid", "left").fillna(0, ["innie", "outtie"])
    kind = F.when((F.col("innie") >= least) & (F.col("innie") > F.col("outtie")), "innie").when((F.col("outtie") >= least) & (F.col("outtie") > F.col("innie")), "outtie").otherwise("unknown")
    return j.select("iid", "mate", "innie", "outtie", kind.alias("kind"))


def gff(places: DataFrame, source: str = "braidwork", kind: str = "match") -> DataFrame:
    """(line) of places(seq, name, bgn, end, reverse): nine columns, counted from 1 with the end included."""
    strand = F.when(F.col("reverse"), "-").otherwise("+")
    return places.select(F.concat_ws("\t", "seq", F.lit(source), F.lit(kind), (F.col("bgn") + 1).cast("string"), F.col("end").cast("string"), F.lit("."), strand, F.lit("."), F.concat(F.lit("ID="), F.col("name").cast("string"))).alias("line"))


def report(records: DataFrame) -> DataFrame:
    """records(kind, id, ...) with their place in a final report: kinds in REPORT_ORDER, ids rising; other kinds are left out."""
    place: Column = F.array_position(F.array(*[F.lit(k) for k in REPORT_ORDER]), F.col("kind"))
    return records.withColumn("section", place.cast("int")).where("section > 0")
