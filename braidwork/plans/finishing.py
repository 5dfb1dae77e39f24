"""Registered queries on trims, placements and variants, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import overlaps as ov
from ..operators import placement as pl
from ..operators import selection as sl
from ..operators import trimming as tr
from ..operators import variants as va
from .assembly import COLS, MEAN, RD, STATUS, STDDEV, _tig_mates, columns, mates, reads
from .catalog import OV, merge, query, read_overlaps, sweep, table


def spans(spark, sf):
    """Hangs are taken twice as long, so that begins can be far apart."""
    y = ov.symmetrised(read_overlaps(spark, sf))
    return tr.as_intervals(y.withColumn("a_hang", F.col("a_hang") * 2).withColumn("b_hang", F.col("b_hang") * 2))


SPANS = OV + """,
sp0 AS (SELECT *, 2 * a_hang AS ah, 2 * b_hang AS bh FROM y),
sp AS (SELECT a_iid, b_iid, NOT flipped AS fwd, greatest(0, ah) AS a_beg, a_len + least(0, bh) AS a_end, CASE WHEN flipped THEN b_len - greatest(0, -ah) ELSE greatest(0, -ah) END AS b_beg,
  CASE WHEN flipped THEN greatest(0, bh) ELSE b_len - greatest(0, bh) END AS b_end, erate, a_len, b_len FROM sp0)"""


@query(f"WITH {SPANS} SELECT * FROM sp")
def overlap_intervals(spark, sf):
    return spans(spark, sf)


@query(f"""WITH {SPANS} SELECT a_iid, b_iid, fwd, a_beg, b_beg FROM sp WHERE (erate < 200 OR (a_end - a_beg > 75 AND abs(b_end - b_beg) > 75)) AND (NOT fwd OR abs(a_beg - b_beg) > 29)""")
def acceptable_overlaps(spark, sf):
    return spans(spark, sf).where(tr.acceptable()).select("a_iid", "b_iid", "fwd", "a_beg", "b_beg")


def _side(col: str, name: str, out: str, order: str) -> str:
    return f"""{name}n AS (SELECT id, {col} AS x, count(*) AS n FROM co GROUP BY ALL), {name}m AS (SELECT id, x, n FROM {name}n QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, x {order}) = 1),
{name} AS (SELECT id, {out}(k.x) AS "{name}_first", {out}(CASE WHEN k.n > 1 THEN k.x END) AS "{name}_twice", any_value(m.x) AS "{name}_mode", any_value(m.n) AS "{name}_count"
  FROM {name}n k JOIN {name}m m USING (id) GROUP BY id)"""


@query(f"""WITH {SPANS}, co AS (SELECT a_iid // 64 AS id, a_beg // 10 AS a_beg, a_end // 10 AS a_end FROM sp), {_side("a_beg", "bgn", "min", "")}, {_side("a_end", "fin", "max", "DESC")}
SELECT id AS a_iid, bgn_first, bgn_twice, bgn_mode, bgn_count, fin_first AS end_first, fin_twice AS end_twice, fin_mode AS end_mode, fin_count AS end_count FROM bgn JOIN fin USING (id)""")
def trim_points(spark, sf):
    """Reads are taken in groups of 64 ids and places in tens, so that places are seen more than once."""
    s = spans(spark, sf).select(F.floor(F.col("a_iid") / 64).alias("a_iid"), F.floor(F.col("a_beg") / 10).alias("a_beg"), F.floor(F.col("a_end") / 10).alias("a_end"))
    return tr.trim_points(s)


@query(f"""WITH {SPANS}, c AS (SELECT a_iid AS key, a_beg + 29 AS bgn, a_end - 29 AS "end" FROM sp), cv AS (SELECT * FROM c WHERE bgn < "end"), {merge("i", "cv")},
g AS (SELECT key AS iid, lag("end") OVER (PARTITION BY key ORDER BY bgn) AS bgn, bgn AS "end" FROM i) SELECT * FROM g WHERE bgn IS NOT NULL""")
def gaps_within_reads(spark, sf):
    return tr.gaps_within(spans(spark, sf), 60)


@query(f"""WITH {SPANS}, p AS (SELECT iid, pos, sum(d) AS d, sum(e) AS e FROM (SELECT a_iid AS iid, a_beg AS pos, 1 AS d, erate AS e FROM sp WHERE a_beg < a_end
  UNION ALL SELECT a_iid, a_end, -1, -erate FROM sp WHERE a_beg < a_end) GROUP BY iid, pos),
r AS (SELECT iid, pos AS bgn, lead(pos) OVER w AS "end", CAST(sum(d) OVER w AS BIGINT) AS depth, sum(e) OVER w AS e FROM p WINDOW w AS (PARTITION BY iid ORDER BY pos))
SELECT iid, bgn, "end", depth, round(CAST(e AS DOUBLE) / (2 * depth), 6) AS erate FROM r WHERE depth > 0""")
def error_profile(spark, sf):
    return tr.error_profile(spans(spark, sf)).withColumn("erate", F.round("erate", 6))


def _clipped(rounds: int) -> str:
    out = ["c0 AS MATERIALIZED (SELECT CAST('inf' AS DOUBLE) AS lim, 0.0::DOUBLE AS mean, 0.0::DOUBLE AS sigma)"]
    for i in range(1, rounds + 1):
        out.append(f"""s{i} AS MATERIALIZED (SELECT count(*) AS m, CAST(sum(z) AS DOUBLE) AS s, CAST(sum(z * z) AS DOUBLE) AS q FROM er, c{i - 1} WHERE z <= lim),
c{i} AS MATERIALIZED (SELECT s / m + 3.0::DOUBLE * sqrt((q - s * (s / m)) / (m - 1)) AS lim, s / m AS mean, sqrt((q - s * (s / m)) / (m - 1)) AS sigma FROM s{i})""")
    return ",\n".join(out)


@query(f"""WITH {SPANS}, er AS MATERIALIZED (SELECT a_iid, b_iid, erate * (1 + a_beg % 7) AS z FROM sp), {_clipped(10)} SELECT a_iid, b_iid, z AS erate FROM er, c10 WHERE z > mean + 2.0::DOUBLE * sigma""")
def high_error_overlaps(spark, sf):
    """Codes are spread by the place of the overlap, so that some lie far out."""
    return tr.high_errors(spans(spark, sf).select("a_iid", "b_iid", (F.col("erate") * (1 + F.col("a_beg") % 7)).alias("erate")))


def bases(spark, sf):
    """(tig, col, iid, base, qv): eight columns of each part, on which some of its reads differ."""
    r = reads(spark, sf).select(F.col("l_partkey").alias("tig"), "iid", "e", "noise", "q", F.explode(F.expr("sequence(0L, 7L)")).alias("col"))
    other = F.when((F.col("e") + F.col("col")) % 5 == 0, 1).otherwise(0)
    return r.select("tig", "col", "iid", F.substring(F.lit("ACGT"), ((F.col("tig") + F.col("col") + other) % 4 + 1).cast("int"), F.lit(1)).alias("base"), ((F.col("q") + 3 * F.col("col")) % 40).alias("qv"))


BASE = RD + """,
ba AS (SELECT l_partkey AS tig, c AS col, iid, substr('ACGT', CAST((l_partkey + c + CASE WHEN (e + c) % 5 = 0 THEN 1 ELSE 0 END) % 4 + 1 AS BIGINT), 1) AS base, (q + 3 * c) % 40 AS qv FROM rd, range(8) t(c)),
vc AS (SELECT tig, col, CAST(sum(CASE WHEN n >= 2 THEN 1 ELSE 0 END) AS BIGINT) AS symbols, CAST(sum(n) AS BIGINT) AS depth FROM (SELECT tig, col, base, count(*) AS n FROM ba GROUP BY ALL) GROUP BY tig, col
  HAVING sum(CASE WHEN n >= 2 THEN 1 ELSE 0 END) > 1)"""


@query(f"WITH {BASE} SELECT * FROM vc")
def variant_columns(spark, sf):
    return va.variant_columns(bases(spark, sf))


@query(f"""WITH {BASE}, n AS (SELECT tig, col, CASE WHEN col - lag(col) OVER (PARTITION BY tig ORDER BY col) <= 1 THEN 0 ELSE 1 END AS new FROM vc),
k AS (SELECT tig, col, sum(new) OVER (PARTITION BY tig ORDER BY col) AS k FROM n), rg AS (SELECT tig, col, min(col) OVER (PARTITION BY tig, k) AS region, count(*) OVER (PARTITION BY tig, k) AS width FROM k),
al AS (SELECT tig, region, width, iid, string_agg(base, '' ORDER BY col) AS allele, count(*) AS n, sum(qv) AS qv FROM ba JOIN rg USING (tig, col) GROUP BY tig, region, width, iid)
SELECT tig, region, width, allele, count(*) AS reads, CAST(sum(qv) AS BIGINT) AS weight, min(iid) AS first_iid FROM al WHERE n = width GROUP BY tig, region, width, allele""")
def variant_alleles(spark, sf):
    return va.alleles(bases(spark, sf))


@query(f"""WITH {BASE}, w AS (SELECT iid, col, CAST(sum(CASE WHEN qv < 12 THEN 1 ELSE 0 END) OVER (PARTITION BY iid ORDER BY col ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS BIGINT) AS bad FROM ba)
SELECT * FROM w WHERE bad > 2""")
def bad_windows(spark, sf):
    return tr.bad_windows(bases(spark, sf), 4, 12, 2)


@query("""SELECT p_size // 10 * 10 AS x, CAST(floor(l_quantity / 5) * 5 AS BIGINT) AS y, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL""")
def size_grid(spark, sf):
    j = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_quantity").alias("y")).join(table(spark, sf, "part").select("p_partkey", F.col("p_size").alias("x")), "p_partkey")
    return va.grid(j, 10, 5)


@query(f"""WITH {RD}, r AS (SELECT iid, tig, bgn, "end" + 15 AS "end", reverse FROM rd)
SELECT a.iid AS a_iid, b.iid AS b_iid, CASE WHEN a.reverse THEN a."end" - b."end" ELSE b.bgn - a.bgn END AS a_hang, CASE WHEN a.reverse THEN a.bgn - b.bgn ELSE b."end" - a."end" END AS b_hang,
  a.reverse <> b.reverse AS flipped FROM r a JOIN r b ON a.tig = b.tig AND a.iid < b.iid AND least(a."end", b."end") - greatest(a.bgn, b.bgn) >= 12""")
def implied_overlaps(spark, sf):
    """Reads are taken longer by 15 letters, so that they overlap more than the next one."""
    return pl.implied_overlaps(reads(spark, sf).withColumn("end", F.col("end") + 15), 100, 12)


@query(f"""WITH {RD}, p AS (SELECT l_partkey % 100 AS iid, tig % 20 AS tig, reverse, bgn, "end", e FROM rd),
f AS (SELECT *, CASE WHEN bgn - lag(bgn) OVER (PARTITION BY iid, tig, reverse ORDER BY bgn) <= 4 THEN 0 ELSE 1 END AS x, CASE WHEN "end" - lag("end") OVER (PARTITION BY iid, tig, reverse ORDER BY "end") <= 4 THEN 0 ELSE 1 END AS y FROM p),
g AS (SELECT *, sum(x) OVER (PARTITION BY iid, tig, reverse ORDER BY bgn) AS gx, sum(y) OVER (PARTITION BY iid, tig, reverse ORDER BY "end") AS gy FROM f)
SELECT iid, tig, reverse, min(bgn) AS bgn, max("end") AS "end", count(*) AS n, CAST(sum(e) AS BIGINT) AS errors FROM g GROUP BY iid, tig, reverse, gx, gy""")
def placement_clusters(spark, sf):
    """Parts of 100 groups stand for reads with several placements in 20 tigs."""
    r = reads(spark, sf).select((F.col("l_partkey") % 100).alias("iid"), (F.col("tig") % 20).alias("tig"), "reverse", "bgn", "end", F.col("e").alias("errors"))
    return pl.placement_clusters(r, 4)


@query(f"""WITH {RD}, mt2 AS (SELECT iid, lead(iid) OVER (PARTITION BY tig ORDER BY rn) AS mate FROM rd), nx AS (SELECT * FROM mt2 WHERE mate IS NOT NULL),
{STATUS.replace("mt.", "nx.").replace("FROM mt ", "FROM nx ")},
s AS (SELECT a.tig || ' ' || status AS key, a.tig, status, least(a.bgn, b.bgn) AS bgn, greatest(a."end", b."end") AS "end" FROM ms JOIN rd a ON a.iid = ms.iid JOIN rd b ON b.iid = ms.mate WHERE status IN ('near', 'far')),
{sweep("d", "s")}, h AS (SELECT * FROM d WHERE depth >= 2), {merge("i", "h")}
SELECT CAST(split_part(key, ' ', 1) AS BIGINT) AS tig, split_part(key, ' ', 2) AS status, bgn, "end" FROM i""")
def break_points(spark, sf):
    r = reads(spark, sf)
    return pl.break_points(r, _tig_mates(r), MEAN, STDDEV, 2)


@query(f"""WITH {RD}, l AS (SELECT a.tig, b.tig % 8 AS scaffold FROM mt JOIN rd a ON a.iid = mt.iid JOIN rd b ON b.iid = mt.mate),
o AS (SELECT tig, min(scaffold) AS scaffold, max(scaffold) AS other, count(*) AS n FROM l GROUP BY tig), t AS (SELECT tig, sum(q) - 30.0 * count(*) AS astat FROM rd GROUP BY tig)
SELECT tig, scaffold, n FROM o JOIN t USING (tig) WHERE scaffold = other AND n >= 2 AND astat >= -2""")
def rock_candidates(spark, sf):
    """Tigs of 8 groups stand for scaffolds."""
    r = reads(spark, sf)
    place = r.select("iid", "tig")
    links = mates(r).join(place, "iid").join(place.select(F.col("iid").alias("mate"), (F.col("tig") % 8).alias("scaffold")), "mate").select("tig", "scaffold")
    return pl.rocks(links, r.groupBy("tig").agg((F.sum("q") - 30.0 * F.count(F.lit(1))).alias("astat")))


@query(f"""WITH {RD}, p AS (SELECT tig, rn, iid, q, CASE WHEN lead(iid) OVER w IS NOT NULL THEN greatest(noise * 5, 20) END AS gap FROM rd WINDOW w AS (PARTITION BY tig ORDER BY rn)),
s AS (SELECT *, CAST(coalesce(sum(q + coalesce(gap, 0)) OVER (PARTITION BY tig ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS b FROM p)
SELECT tig AS object, b + 1 AS object_beg, b + q AS object_end, rn * 2 - 1 AS part_number, 'W' AS component_type, CAST(iid AS VARCHAR) AS component FROM s
UNION ALL SELECT tig, b + q + 1, b + q + gap, rn * 2, 'N', CAST(gap AS VARCHAR) FROM s WHERE gap IS NOT NULL""")
def agp_lines(spark, sf):
    r = reads(spark, sf)
    return pl.agp_lines(r.select(F.col("tig").alias("scaffold"), F.col("rn").alias("ord"), F.col("iid").alias("piece"), F.col("q").alias("len"), (F.col("noise") * 5).alias("gap")))


@query(f"""WITH {BASE}, n AS (SELECT tig, col, base, count(*) AS n FROM ba GROUP BY ALL), m AS (SELECT tig, col, base AS most FROM (SELECT *, sum(n) OVER (PARTITION BY tig, col) AS total FROM n) WHERE total > 1 AND 2 * n > total)
SELECT tig, iid, string_agg(coalesce(most, base), '' ORDER BY col) AS seq, CAST(sum(CASE WHEN most <> base THEN 1 ELSE 0 END) AS BIGINT) AS changes FROM ba LEFT JOIN m USING (tig, col) GROUP BY tig, iid""")
def corrected_reads(spark, sf):
    return va.corrected(bases(spark, sf))


@query(f"""WITH {COLS}, c AS (SELECT tig, col, max(base) AS base, CAST(max(qv) AS INTEGER) AS qv FROM cl GROUP BY tig, col)
SELECT tig, col // 3 AS block, coalesce(string_agg(CASE WHEN base <> '-' THEN base END, '' ORDER BY col), '') AS seq, coalesce(string_agg(CASE WHEN base <> '-' THEN chr(qv + 33) END, '' ORDER BY col), '') AS qlt FROM c GROUP BY tig, col // 3""")
def consensus_blocks(spark, sf):
    """The greatest letter of a column stands for its call."""
    c = columns(spark, sf).groupBy("tig", "col").agg(F.max("base").alias("base"), F.max("qv").alias("qv"))
    return va.consensus_blocks(c, 3)


@query(f"""WITH {RD}, bo AS (SELECT iid, mate FROM mt UNION ALL SELECT mate, iid FROM mt), ins AS (SELECT DISTINCT tig % 40 AS tig, tig AS instance, tig % 997 AS scaffold FROM rd WHERE tig % 5 = 0),
one AS (SELECT tig, scaffold, min(instance) AS instance FROM ins GROUP BY tig, scaffold HAVING count(*) = 1)
SELECT a.iid, one.instance FROM rd a JOIN bo ON bo.iid = a.iid JOIN rd b ON b.iid = bo.mate JOIN one ON one.tig = a.tig % 40 AND one.scaffold = b.tig % 997""")
def surrogate_reads(spark, sf):
    """Tigs of 40 groups stand for surrogates, those of every fifth id for their instances, 997 groups for scaffolds."""
    r = reads(spark, sf)
    ins = r.where("tig % 5 = 0").select((F.col("tig") % 40).alias("tig"), F.col("tig").alias("instance"), (F.col("tig") % 997).alias("scaffold")).distinct()
    return pl.surrogate_reads(r.select("iid", (F.col("tig") % 40).alias("tig")), mates(r), ins, r.select("iid", (F.col("tig") % 997).alias("scaffold")))


@query("""WITH t AS (SELECT sum(n_chars) // 3 AS total FROM documents), h AS (SELECT doc_id, n_chars, md5('7:' || doc_id) AS h FROM documents),
r AS (SELECT *, coalesce(sum(n_chars) OVER (ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM h) SELECT doc_id, n_chars FROM r, t WHERE before < total""")
def random_until(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    return sl.random_until(d, d.agg(F.floor(F.sum("n_chars") / 3)).first()[0], 7, "doc_id", "n_chars")
