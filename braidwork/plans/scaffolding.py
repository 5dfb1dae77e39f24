"""Registered queries on scaffolds, repeats, contained reads, trusted k-mers, linkers and simulated reads, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.sequence import bases
from ..operators import overlaps as ov
from ..operators import scaffolds as sc
from .assembly import EDGES, MEAN, RD, STDDEV, edges, mates, reads
from .catalog import BASES, LETTERS, OV, merge, query, read_overlaps, sweep, table
from .finishing import SPANS, spans
from .storage import both_ways

TRUSTED, LINKER = 11, "ACGTACGTAC"


def sequences(spark, sf):
    """(id, seq): the letters of each text alone."""
    return bases(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("seq")), dict(zip(LETTERS, BASES)))


SQ = f"sq AS (SELECT doc_id AS id, regexp_replace(translate(text, '{LETTERS}', '{BASES}'), '[^ACGT]', '', 'g') AS seq FROM documents)"


def win(k: int) -> str:
    return f"""{SQ},
bl AS (SELECT id, b, substr(seq, b * 512 + 1, {512 + k - 1}) AS run FROM (SELECT id, seq, unnest(range(0, (length(seq) - {k}) // 512 + 1)) AS b FROM sq WHERE length(seq) >= {k})),
wi AS (SELECT id, b * 512 + i AS pos, substr(run, i + 1, {k}) AS win FROM (SELECT id, b, run, unnest(range(0, length(run) - {k - 1})) AS i FROM bl))"""


def drawn(number: str, salt: int) -> str:
    m = sc.MODULUS
    return f"((((({number}) % {m} * {sc.MULTIPLIER} + {salt * 16807}) % {m}) * {sc.MULTIPLIER} + 1) % {m} * {sc.MULTIPLIER} + 1) % {m}"


CDF = """CASE WHEN {z} >= 0 THEN 1 - exp(-{z} * {z} / 2) / sqrt(2 * pi()) * {p} ELSE exp(-{z} * {z} / 2) / sqrt(2 * pi()) * {p} END"""


def _cdf(z: str) -> str:
    t = f"(1 / (1 + 0.2316419::DOUBLE * abs({z})))"
    p = f"({t} * (0.319381530::DOUBLE + {t} * (-0.356563782::DOUBLE + {t} * (1.781477937::DOUBLE + {t} * (-1.821255978::DOUBLE + {t} * 1.330274429::DOUBLE)))))"
    return CDF.format(z=z, p=p)


@query(f"""WITH {RD}, mb AS (SELECT iid, mate FROM mt UNION ALL SELECT mate, iid FROM mt),
an AS (SELECT a.tig, CASE WHEN a.reverse THEN a."end" - {MEAN} ELSE a.bgn + {MEAN} END::DOUBLE AS mid FROM mb JOIN rd a ON a.iid = mb.iid JOIN rd b ON b.iid = mb.mate WHERE a.tig <> b.tig),
ga AS (SELECT tig, rn AS gap, "end" AS bgn, "end" + 5 + noise AS "end" FROM rd),
zz AS (SELECT ga.tig, gap, ("end" - mid) / {STDDEV} AS z, (bgn - mid) / {STDDEV} AS y FROM ga JOIN an ON an.tig = ga.tig AND mid > bgn - {5 * STDDEV} AND mid < "end" + {5 * STDDEV}),
su AS (SELECT tig, gap, count(*) AS mates, sum({_cdf('z')} - ({_cdf('y')})) AS expected FROM zz GROUP BY ALL)
SELECT ga.tig AS scaffold, CAST(ga.gap AS BIGINT) AS gap, coalesce(mates, 0) AS mates, round(coalesce(expected, 0), 6) AS expected FROM ga LEFT JOIN su ON su.tig = ga.tig AND su.gap = ga.gap""")
def gap_fill(spark, sf):
    """A gap follows each read; anchors are the reads whose mates lie in other tigs."""
    r = reads(spark, sf)
    gaps = r.select(F.col("tig").alias("scaffold"), F.col("rn").cast("long").alias("gap"), F.col("end").alias("bgn"), (F.col("end") + 5 + F.col("noise")).alias("end"))
    m = both_ways(mates(r)).join(r.select("iid", "tig", "bgn", "end", "reverse"), "iid").join(r.select(F.col("iid").alias("mate"), F.col("tig").alias("other")), "mate")
    anchors = m.where("tig <> other").select(F.col("tig").alias("scaffold"), F.when(F.col("reverse"), F.col("end")).otherwise(F.col("bgn")).alias("pos"), "reverse")
    return sc.gap_fill(gaps, anchors, MEAN, STDDEV).withColumn("expected", F.round("expected", 6))


@query(f"""WITH RECURSIVE {EDGES}, eg AS (SELECT src // 64 AS scaffold, src AS a, dst AS b FROM ed WHERE length >= 25), nb AS (SELECT * FROM eg UNION ALL SELECT scaffold, b, a FROM eg),
re AS (SELECT scaffold, a AS x, b AS y, a AS node FROM eg UNION SELECT re.scaffold, x, y, nb.b FROM re JOIN nb ON nb.scaffold = re.scaffold AND nb.a = re.node AND NOT (nb.a = x AND nb.b = y) AND NOT (nb.a = y AND nb.b = x))
SELECT scaffold, a, b FROM eg WHERE NOT EXISTS (SELECT 1 FROM re WHERE re.scaffold = eg.scaffold AND x = a AND y = b AND node = b)""")
def scaffold_bridges(spark, sf):
    """Tigs are scaffolds of their reads, tied by the edges of 25 letters or more."""
    e = edges(reads(spark, sf)).where("length >= 25")
    return sc.bridges(e.select(F.floor(F.col("src") / 64).alias("scaffold"), F.col("src").alias("a"), F.col("dst").alias("b")))


@query(None)
def gap_sizes(spark, sf):
    """Tigs are scaffolds of their reads; SQL can't express least squares of any size."""
    r = reads(spark, sf)
    e = edges(r).join(r.select(F.col("iid").alias("src"), "q", "noise"), "src")
    e = e.select(F.col("src").alias("piece_a"), F.col("dst").alias("piece_b"), (F.col("length") - F.col("q")).alias("mean"), (F.col("noise") + 1.0).alias("variance"))
    out = sc.gap_sizes(r.select(F.col("tig").alias("scaffold"), F.col("iid").alias("piece"), F.col("rn").alias("ord"), F.col("q").alias("length")), e)
    return out.withColumn("bgn", F.round("bgn", 4)).withColumn("gap", F.round("gap", 4))


@query(f"""WITH RECURSIVE {OV}, bc AS (SELECT a_iid, b_iid AS container, -a_hang AS o FROM x WHERE cls = 'contained' OR (cls = 'equal' AND b_iid < a_iid) QUALIFY row_number() OVER (PARTITION BY a_iid ORDER BY olen DESC, erate, b_iid, a_hang DESC) = 1),
pl AS (SELECT DISTINCT a_iid AS iid, a_iid // 8 AS tig, a_iid % 8 * 40 AS bgn FROM x WHERE a_iid NOT IN (SELECT a_iid FROM bc)),
ch AS (SELECT a_iid AS iid, container AS root, o, 1 AS depth FROM bc UNION ALL SELECT ch.iid, bc.container, ch.o + bc.o, ch.depth + 1 FROM ch JOIN bc ON bc.a_iid = ch.root WHERE ch.depth < 400)
SELECT ch.iid, tig, CAST(bgn + o AS BIGINT) AS bgn, CAST(depth AS BIGINT) AS depth FROM ch JOIN pl ON pl.iid = ch.root""")
def placed_contained(spark, sf):
    """Reads that no other contains are placed by their ids."""
    both = ov.symmetrised(read_overlaps(spark, sf))
    cls = ov.overlap_class()
    w = Window.partitionBy("a_iid").orderBy(F.desc("olen"), "erate", "b_iid", F.desc("a_hang"))
    best = both.withColumn("olen", ov.length_on_a()).where((cls == "contained") | ((cls == "equal") & (F.col("b_iid") < F.col("a_iid")))).withColumn("k", F.row_number().over(w)).where("k = 1")
    best = best.select("a_iid", F.col("b_iid").alias("container"), (-F.col("a_hang")).alias("offset"))
    free = both.select("a_iid").distinct().join(best, "a_iid", "left_anti")
    placed = free.select(F.col("a_iid").alias("iid"), F.floor(F.col("a_iid") / 8).alias("tig"), (F.col("a_iid") % 8 * 40).alias("bgn"))
    return sc.placed_contained(best, placed)


@query(f"""WITH {RD}, mb AS (SELECT iid, mate FROM mt UNION ALL SELECT mate, iid FROM mt),
nx AS (SELECT iid, lead(tig) OVER w // 1000 AS tig, lead(q) OVER w AS score FROM rd WINDOW w AS (PARTITION BY l_partkey ORDER BY iid)),
op AS (SELECT iid, tig, max(score) AS score FROM (SELECT iid, tig // 1000 AS tig, q AS score FROM rd UNION ALL SELECT * FROM nx WHERE tig IS NOT NULL) GROUP BY ALL),
ne AS (SELECT DISTINCT mb.iid, rd.tig // 1000 AS tig FROM mb JOIN rd ON rd.iid = mb.mate),
ra AS (SELECT op.*, row_number() OVER (PARTITION BY op.iid ORDER BY (ne.iid IS NOT NULL) DESC, score DESC, op.tig) AS n, first(op.tig) OVER (PARTITION BY op.iid ORDER BY score DESC, op.tig) AS plain
  FROM op LEFT JOIN ne ON ne.iid = op.iid AND ne.tig = op.tig)
SELECT iid, tig, tig <> plain AS moved FROM ra WHERE n = 1""")
def moved_contained(spark, sf):
    """A read could lie in its own stretch of a thousand tigs or in that of the next read of its part."""
    r = reads(spark, sf).withColumn("tig", F.floor(F.col("tig") / 1000))
    w = Window.partitionBy("l_partkey").orderBy("iid")
    nxt = r.select("iid", F.lead("tig").over(w).alias("tig"), F.lead("q").over(w).alias("score")).where("tig is not null")
    return sc.moved_contained(r.select("iid", "tig", F.col("q").alias("score")).unionByName(nxt), both_ways(mates(r)), r.select("iid", "tig"))


@query(f"""WITH {RD}, pt AS (SELECT l_partkey AS key, noise * 10 AS bgn, noise * 10 + q AS "end", reverse FROM rd), fo AS (SELECT * FROM pt WHERE reverse), ow AS (SELECT * FROM pt WHERE NOT reverse),
{sweep("d", "fo")}, h AS (SELECT * FROM d WHERE depth >= 3), {merge("i", "h")}
SELECT key, bgn, "end" FROM i WHERE NOT EXISTS (SELECT 1 FROM ow WHERE ow.key = i.key AND ow.bgn + 10 <= i.bgn AND i."end" <= ow."end" - 10)""")
def repeat_marks(spark, sf):
    """Parts are tigs, on which the reversed reads are foreign."""
    p = reads(spark, sf).select(F.col("l_partkey").alias("key"), (F.col("noise") * 10).alias("bgn"), (F.col("noise") * 10 + F.col("q")).alias("end"), "reverse")
    return sc.repeat_marks(p.where("reverse"), p.where("not reverse"), 3, 10, 64)


@query(f"""WITH {RD}, el AS (SELECT tig, rn = 1 AS fst, rn = max(rn) OVER (PARTITION BY tig) AS lst, l_partkey // 20 AS target, e * 20 + noise AS pos, tig_len FROM rd),
a AS (SELECT DISTINCT tig, target, pos, tig_len FROM el WHERE fst AND NOT lst), b AS (SELECT DISTINCT tig, target, pos FROM el WHERE lst AND NOT fst)
SELECT a.tig, a.target, least(a.pos, b.pos) AS bgn, greatest(a.pos, b.pos) AS "end" FROM a JOIN b ON a.tig = b.tig AND a.target = b.target AND a.tig <> a.target
WHERE tig_len <= 200 AND abs(abs(a.pos - b.pos) - tig_len) <= 40 QUALIFY row_number() OVER (PARTITION BY a.tig ORDER BY abs(abs(a.pos - b.pos) - tig_len), a.target, least(a.pos, b.pos), greatest(a.pos, b.pos)) = 1""")
def bubble_places(spark, sf):
    """Twenty parts are a target; the ends of a tig are its first and last read."""
    r = reads(spark, sf)
    end = r.join(r.groupBy("tig").agg(F.max("rn").alias("m")), "tig").where("m > 1 and (rn = 1 or rn = m)")
    end = end.select("tig", (F.col("rn") == F.col("m")).alias("last"), F.floor(F.col("l_partkey") / 20).alias("target"), (F.col("e") * 20 + F.col("noise")).alias("pos"))
    return sc.bubbles(end, r.select("tig", F.col("tig_len").alias("length")).distinct(), 200, 40)


@query(f"""WITH {RD}, li AS (SELECT a.tig // 1000 AS a, CAST(NOT a.reverse AS INTEGER) AS ae, b.tig // 1000 AS b, CAST(NOT b.reverse AS INTEGER) AS be FROM mt JOIN rd a ON a.iid = mt.iid JOIN rd b ON b.iid = mt.mate),
bo AS (SELECT * FROM li WHERE a <> b UNION ALL SELECT b, be, a, ae FROM li WHERE a <> b), we AS (SELECT a, ae, b, be, count(*) AS weight FROM bo GROUP BY ALL HAVING count(*) >= 2),
bs AS (SELECT * FROM we QUALIFY row_number() OVER (PARTITION BY a, ae ORDER BY weight DESC, b, be) = 1)
SELECT p.a, p.ae AS a_end, p.b, p.be AS b_end, p.weight FROM bs p JOIN bs r ON r.a = p.b AND r.ae = p.be AND r.b = p.a AND r.be = p.ae WHERE p.a < p.b""")
def tig_joins(spark, sf):
    """A thousand tigs are one, and mates link the ends that they face."""
    r = reads(spark, sf).select("iid", F.floor(F.col("tig") / 1000).alias("tig"), (~F.col("reverse")).cast("int").alias("way"))
    j = mates(reads(spark, sf)).join(r, "iid").join(r.select(F.col("iid").alias("mate"), F.col("tig").alias("b"), F.col("way").alias("b_end")), "mate")
    return sc.joins(j.select(F.col("tig").alias("a"), F.col("way").alias("a_end"), "b", "b_end"), 2)


@query(f"""WITH {SPANS}, co AS (SELECT a_iid // 512 AS a, b_iid // 512 AS b, fwd, a_beg, a_end FROM sp),
be AS (SELECT * FROM co QUALIFY row_number() OVER (PARTITION BY a, b, fwd ORDER BY a_end - a_beg DESC, a_beg DESC, a_end DESC) = 1),
st AS (SELECT f.a, greatest(f.a_beg, r.a_beg) AS x, least(f.a_end, r.a_end) AS y FROM be f JOIN be r ON f.a = r.a AND f.b = r.b AND f.fwd AND NOT r.fwd),
ag AS (SELECT a, count(*) AS n, max(x) AS x, min(y) AS y FROM st WHERE x < y GROUP BY a HAVING count(*) >= 2)
SELECT a AS a_iid, n, CASE WHEN x < y THEN x END AS bgn, CASE WHEN x < y THEN y END AS "end" FROM ag""")
def palindromic_stretches(spark, sf):
    """Reads are taken in groups of 512 ids, so that partners are seen more than once."""
    s = spans(spark, sf).select(F.floor(F.col("a_iid") / 512).alias("a_iid"), F.floor(F.col("b_iid") / 512).alias("b_iid"), "fwd", "a_beg", "a_end")
    return sc.both_ways(s, 2)


@query(f"""WITH {win(TRUSTED)}, go AS (SELECT win FROM wi GROUP BY win HAVING count(*) >= 3),
gr AS (SELECT id, pos, pos - row_number() OVER (PARTITION BY id ORDER BY pos) AS g FROM wi SEMI JOIN go USING (win)),
st AS (SELECT id, min(pos) AS bgn, max(pos) + {TRUSTED} AS "end" FROM gr GROUP BY id, g)
SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY id ORDER BY "end" - bgn DESC, bgn) = 1""")
def trusted_stretches(spark, sf):
    return sc.trusted_stretch(sequences(spark, sf), TRUSTED, 3)


@query(f"""WITH {win(len(LINKER))}, hi AS (SELECT id, pos, hamming(win, '{LINKER}') AS errors FROM wi), be AS (SELECT * FROM hi WHERE errors <= 3 QUALIFY row_number() OVER (PARTITION BY id ORDER BY errors, pos) = 1)
SELECT id, pos, CAST(errors AS INTEGER) AS errors, pos AS before, length(seq) - pos - {len(LINKER)} AS after FROM be JOIN sq USING (id)""")
def linker_places(spark, sf):
    return sc.linkers(sequences(spark, sf), LINKER, 3)


def _simulated(kind: str) -> str:
    pair = kind != "single"
    size = f"200 + {drawn('nu', 5)} % 40" if pair else "100"
    rc = lambda s: f"reverse(translate({s}, 'ACGT', 'TGCA'))"
    one, two = {"single": ("l", None), "paired": ("l", rc("r")), "mates": (rc("l"), "r")}[kind]
    sides = f"SELECT *, 1 AS side, {one} AS s FROM cu" + (f" UNION ALL SELECT *, 2 AS side, {two} AS s FROM cu" if two else "")
    draw = drawn("(nu * 2 + side) * 1024 + i - 1", 7)
    return f"""WITH {SQ}, rn AS (SELECT id, seq, unnest(range(1, greatest(CAST(ceil(length(seq) * 0.5::DOUBLE / {200 if pair else 100}) AS BIGINT), 1) + 1)) AS read FROM sq WHERE length(seq) >= {239 if pair else 100}),
nu AS (SELECT *, id * 65537 + read AS nu FROM rn), sz AS (SELECT *, {size} AS size FROM nu), po AS (SELECT *, {drawn('nu', 6)} % (length(seq) - size + 1) AS pos FROM sz),
cu AS (SELECT id, read, nu, pos, size, substr(seq, pos + 1, 100) AS l, substr(seq, pos + size - 99, 100) AS r FROM po), si AS ({sides})
SELECT id, CAST(read AS INTEGER) AS read, side, pos, CAST(size AS BIGINT) AS insert,
  array_to_string(list_transform(range(1, 101), lambda i : CASE WHEN {draw} % 10000 < 150 THEN translate(s[i], 'ACGT', 'CGTA') ELSE s[i] END), '') AS seq FROM si"""


def _reads_of(kind):
    def run(spark, sf):
        size = {} if kind == "single" else {"insert": 200, "spread": 40}
        return sc.simulated(sequences(spark, sf), 100, 0.5, 150, kind, seed=5, **size)

    run.__name__ = f"simulated_{kind}"
    return run


for _kind in ("single", "paired", "mates"):
    query(_simulated(_kind))(_reads_of(_kind))
