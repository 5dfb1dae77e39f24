"""Registered queries on graphs, tigs, seeds and layouts, with their SQL.

Orders are tigs, their line items the reads placed in them, and reads of one
part, taken in pairs, are mates.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.sequence import bases
from ..operators import graph as gr
from ..operators import overlaps as ov
from ..operators import seeds as sd
from ..operators import selection as sl
from ..operators import tigs as tg
from .catalog import BASES, EV, LETTERS, OV, events, merge, query, read_overlaps, sweep, table
from .intervalquery import Layout

MEAN, STDDEV = 60.0, 8.0


def reads(spark, sf):
    """(iid, tig, tig_len, bgn, end, reverse, ...): each read begins up to ten letters before the end of the one before it."""
    t = table(spark, sf, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    q = F.col("l_quantity").cast("long")
    r = t.select("*", q.alias("q"), F.row_number().over(w).alias("rn"), F.sum(q).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("end"), F.sum(q).over(Window.partitionBy("l_orderkey")).alias("tig_len"))
    return r.select(
        (F.col("l_orderkey") * 64 + F.col("rn")).alias("iid"), F.col("l_orderkey").alias("tig"), "tig_len", F.greatest(F.lit(0), F.col("end") - F.col("q") - 10).alias("bgn"), "end",
        (F.col("l_returnflag") == "R").alias("reverse"), "l_partkey", "rn", F.round(F.col("l_tax") * 100).cast("long").alias("noise"), F.round(F.col("l_discount") * 100).cast("long").alias("e"), "q",
    )


def mates(r):
    w = Window.partitionBy("l_partkey").orderBy("iid")
    return r.select("iid", F.lead("iid").over(w).alias("mate"), F.row_number().over(w).alias("n")).where("n % 2 = 1 and mate is not null").select("iid", "mate")


def edges(r):
    """(src, dst, length): each read and the next three of its tig, lengths a little off."""
    w = Window.partitionBy("tig").orderBy("rn")
    steps = F.array(*[F.struct(F.lead("iid", i).over(w).alias("dst"), F.lead("bgn", i).over(w).alias("b"), F.lit(i).alias("i")) for i in (1, 2, 3)])
    x = r.select("iid", "bgn", "noise", steps.alias("s")).select("iid", "bgn", "noise", F.explode("s").alias("s")).where("s.dst is not null")
    return x.select(F.col("iid").alias("src"), F.col("s.dst").alias("dst"), (F.col("s.b") - F.col("bgn") + (F.col("noise") + F.col("s.i")) % 4).alias("length"))


RD = """rd0 AS (SELECT *, CAST(l_quantity AS BIGINT) AS q, row_number() OVER w AS rn, CAST(sum(CAST(l_quantity AS BIGINT)) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS "end",
  CAST(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey) AS BIGINT) AS tig_len FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate)),
rd AS (SELECT l_orderkey * 64 + rn AS iid, l_orderkey AS tig, tig_len, greatest(0, "end" - q - 10) AS bgn, "end", l_returnflag = 'R' AS reverse, l_partkey, rn,
  CAST(round(l_tax * 100) AS BIGINT) AS noise, CAST(round(l_discount * 100) AS BIGINT) AS e, q FROM rd0),
mt AS (SELECT iid, mate FROM (SELECT iid, lead(iid) OVER w AS mate, row_number() OVER w AS n FROM rd WINDOW w AS (PARTITION BY l_partkey ORDER BY iid)) WHERE n % 2 = 1 AND mate IS NOT NULL)"""
EDGES = RD + """,
ed AS (SELECT a.iid AS src, b.iid AS dst, b.bgn - a.bgn + (a.noise + b.rn - a.rn) % 4 AS length FROM rd a JOIN rd b ON a.tig = b.tig AND b.rn > a.rn AND b.rn <= a.rn + 3)"""
BEST = OV + """,
dv AS (SELECT a_iid, CASE cls WHEN 'dovetail3' THEN 1 ELSE 0 END AS a_end, b_iid, CASE WHEN (cls = 'dovetail3') = flipped THEN 1 ELSE 0 END AS b_end, olen, erate,
  CASE cls WHEN 'dovetail3' THEN b_hang ELSE -a_hang END AS grow FROM x WHERE cls IN ('dovetail5', 'dovetail3')),
be AS (SELECT * FROM dv QUALIFY row_number() OVER (PARTITION BY a_iid, a_end ORDER BY olen DESC, erate, b_iid, b_end, grow) = 1),
mu AS (SELECT p.* FROM be p WHERE EXISTS (SELECT 1 FROM be r WHERE r.a_iid = p.b_iid AND r.a_end = p.b_end AND r.b_iid = p.a_iid AND r.b_end = p.a_end))"""


def _mutual(spark, sf):
    return gr.mutual(gr.best_of_ends(gr.dovetails(ov.symmetrised(read_overlaps(spark, sf)))))


@query(f"""WITH RECURSIVE {BEST}, lk AS (SELECT DISTINCT a_iid AS a, b_iid AS b FROM mu), rc AS (SELECT a AS node, a AS seen FROM lk UNION SELECT rc.node, lk.b FROM rc JOIN lk ON lk.a = rc.seen)
SELECT node, min(seen) AS component FROM rc GROUP BY node""")
def unitig_components(spark, sf):
    return gr.components(_mutual(spark, sf).select(F.col("a_iid").alias("a"), F.col("b_iid").alias("b")))


@query(f"""WITH RECURSIVE {BEST}, st AS (SELECT a_iid * 2 + a_end AS node, b_iid * 2 + 1 - b_end AS nxt, grow FROM mu),
pt AS (SELECT node, nxt AS last, 1 AS steps, grow AS length FROM st UNION ALL SELECT pt.node, st.nxt, pt.steps + 1, pt.length + st.grow FROM pt JOIN st ON st.node = pt.last WHERE pt.steps < 3000),
en AS (SELECT * FROM pt QUALIFY row_number() OVER (PARTITION BY node ORDER BY steps DESC) = 1)
SELECT node, CASE WHEN steps < 3000 THEN last END AS last, CASE WHEN steps < 3000 THEN CAST(steps AS BIGINT) END AS steps, CASE WHEN steps < 3000 THEN CAST(length AS BIGINT) END AS length, steps >= 3000 AS cyclic FROM en""")
def best_edge_paths(spark, sf):
    return gr.follow(gr.steps_of(_mutual(spark, sf)))


@query(f"""WITH {OV} SELECT a_iid AS iid, CASE WHEN bool_or(cls = 'contained') THEN 'contained' WHEN bool_or(cls = 'dovetail5') AND bool_or(cls = 'dovetail3') THEN 'thru'
  WHEN bool_or(cls IN ('dovetail5', 'dovetail3')) THEN 'hanging' ELSE 'solo' END AS class FROM x GROUP BY a_iid""")
def read_end_classes(spark, sf):
    return gr.end_classes(ov.symmetrised(read_overlaps(spark, sf)))


@query(f"""WITH {OV}, c AS (SELECT DISTINCT a_iid FROM x WHERE cls = 'contained'),
sp AS (SELECT a_iid AS key, greatest(0, 4 * a_hang) AS bgn, least(a_len, a_len + 4 * b_hang) AS "end" FROM x WHERE a_iid NOT IN (SELECT a_iid FROM c)), sv AS (SELECT * FROM sp WHERE bgn < "end"), {merge("i", "sv")}
SELECT key AS iid, count(*) AS pieces FROM i GROUP BY key HAVING count(*) > 1""")
def suspicious_reads(spark, sf):
    """Hangs are taken four times as long, so that overlaps are short."""
    y = ov.symmetrised(read_overlaps(spark, sf))
    return tg.suspicious(y.withColumn("a_hang", F.col("a_hang") * 4).withColumn("b_hang", F.col("b_hang") * 4))


@query(f"""WITH {EDGES} SELECT * FROM ed e WHERE EXISTS (SELECT 1 FROM ed f JOIN ed g ON f.dst = g.src WHERE f.src = e.src AND g.dst = e.dst AND abs(e.length - f.length - g.length) <= 1)""")
def transitive_edges(spark, sf):
    return gr.transitive(edges(reads(spark, sf)), 1)


@query(f"""WITH RECURSIVE {EDGES}, pr AS (SELECT DISTINCT first(iid ORDER BY rn) AS src, last(iid ORDER BY rn) AS dst FROM rd GROUP BY tig HAVING count(*) > 1),
fr AS (SELECT src, dst, src AS node, 0 AS hops, 0 AS length FROM pr UNION SELECT fr.src, fr.dst, ed.dst, fr.hops + 1, fr.length + ed.length FROM fr JOIN ed ON ed.src = fr.node
  WHERE fr.hops < 3 AND fr.length + ed.length <= 150)
SELECT src, dst, CAST(hops AS BIGINT) AS hops, CAST(length AS BIGINT) AS length FROM fr WHERE node = dst AND hops > 0 QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY hops, length) = 1""")
def path_search(spark, sf):
    r = reads(spark, sf)
    pairs = r.groupBy("tig").agg(F.min_by("iid", "rn").alias("src"), F.max_by("iid", "rn").alias("dst")).where("src <> dst")
    return gr.reach(edges(r), pairs, 3, 150)


ME = RD + f""",
of AS (SELECT iid, tig, CASE WHEN reverse THEN "end" ELSE tig_len - bgn END AS off, CASE WHEN reverse THEN 'B' ELSE 'A' END AS way FROM rd),
me AS (SELECT least(a.tig, b.tig) AS id_a, greatest(a.tig, b.tig) AS id_b, CASE WHEN a.tig < b.tig THEN a.way || b.way ELSE b.way || a.way END AS orient,
  {MEAN}::DOUBLE - a.off - b.off AS mean, {STDDEV ** 2}::DOUBLE AS variance FROM mt JOIN of a ON a.iid = mt.iid JOIN of b ON b.iid = mt.mate WHERE a.tig <> b.tig)"""


@query(f"WITH {ME} SELECT * FROM me")
def mate_edges(spark, sf):
    r = reads(spark, sf)
    return gr.mate_edges(r, mates(r), MEAN, STDDEV)


@query(f"""WITH {ME}, bk AS (SELECT id_a % 64 AS id_a, id_b % 64 AS id_b, orient, mean, variance FROM me),
md AS (SELECT id_a, id_b, orient, quantile_disc(mean, 0.5) AS mid, avg(variance) AS mv FROM bk GROUP BY ALL)
SELECT id_a, id_b, orient, count(*) AS weight, round(sum(mean / variance) / sum(1 / variance), 6) AS mean, round(1 / sum(1 / variance), 6) AS variance FROM bk JOIN md USING (id_a, id_b, orient)
WHERE (mean - mid) * (mean - mid) / (greatest(variance, 25) + greatest(mv, 25)) < 23.637 GROUP BY ALL""")
def bundled_edges(spark, sf):
    """Tigs are taken in 64 groups, so that an edge has several estimates."""
    r = reads(spark, sf)
    e = gr.mate_edges(r, mates(r), MEAN, STDDEV).withColumn("id_a", F.col("id_a") % 64).withColumn("id_b", F.col("id_b") % 64)
    return gr.bundled(e).withColumn("mean", F.round("mean", 6)).withColumn("variance", F.round("variance", 6))


STATUS = f"""ms AS (SELECT mt.iid, mt.mate, CASE WHEN a.tig <> b.tig THEN 'apart' WHEN a.reverse = b.reverse THEN 'same_way'
  ELSE CASE WHEN d < 0 THEN 'outtie' WHEN d < {MEAN - 5 * STDDEV} THEN 'near' WHEN d <= {MEAN + 5 * STDDEV} THEN 'good' ELSE 'far' END END AS status
  FROM mt JOIN rd a ON a.iid = mt.iid JOIN rd b ON b.iid = mt.mate, LATERAL (SELECT CASE WHEN b.reverse THEN b."end" - a.bgn ELSE a."end" - b.bgn END AS d))"""


def _tig_mates(r):
    """Mates of one tig: each read and the next."""
    w = Window.partitionBy("tig").orderBy("rn")
    return r.select("iid", F.lead("iid").over(w).alias("mate")).where("mate is not null")


@query(f"""WITH {RD}, mt2 AS (SELECT iid, lead(iid) OVER (PARTITION BY tig ORDER BY rn) AS mate FROM rd), nx AS (SELECT * FROM mt2 WHERE mate IS NOT NULL), {STATUS.replace("mt.", "nx.").replace("FROM mt ", "FROM nx ")} SELECT * FROM ms""")
def mate_status(spark, sf):
    r = reads(spark, sf)
    return tg.mate_status(r, _tig_mates(r), MEAN, STDDEV)


@query(f"""WITH {RD}, {STATUS} SELECT coalesce(p_brand, 'all') AS library, coalesce(status, 'all') AS status, count(*) AS n
FROM ms JOIN rd USING (iid) JOIN part ON p_partkey = l_partkey GROUP BY ROLLUP (p_brand, status)""")
def mate_fate(spark, sf):
    r = reads(spark, sf)
    s = tg.mate_status(r, mates(r), MEAN, STDDEV).join(r.select("iid", "l_partkey"), "iid").join(table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("library")), "l_partkey")
    return s.rollup("library", "status").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("library", F.lit("all")).alias("library"), F.coalesce("status", F.lit("all")).alias("status"), "n")


@query(f"""WITH {RD}, g AS (SELECT *, min(iid) OVER (PARTITION BY tig % 200, bgn, "end", reverse) AS keeper FROM rd) SELECT iid, keeper FROM g WHERE iid > keeper""")
def duplicate_reads(spark, sf):
    """Tigs are taken in 200 groups, so that reads share places."""
    return tg.duplicate_reads(reads(spark, sf).withColumn("tig", F.col("tig") % 200))


@query(f"""WITH {RD}, pl AS (SELECT mt.iid, mt.mate, min(mt.iid) OVER (PARTITION BY a.tig % 4, a.bgn // 50, a."end" // 50, a.reverse, b.tig % 4, b.bgn // 50, b."end" // 50, b.reverse) AS keeper
  FROM mt JOIN rd a ON a.iid = mt.iid JOIN rd b ON b.iid = mt.mate) SELECT * FROM pl WHERE iid > keeper""")
def duplicate_pairs(spark, sf):
    """Tigs are taken in 4 groups and places in steps of 50, so that pairs share places."""
    r = reads(spark, sf)
    coarse = r.withColumn("tig", F.col("tig") % 4).withColumn("bgn", F.floor(F.col("bgn") / 50)).withColumn("end", F.floor(F.col("end") / 50))
    return tg.duplicate_pairs(coarse, mates(r))


@query(f"""WITH {RD}, f AS (SELECT *, max("end") OVER (PARTITION BY tig ORDER BY bgn, "end", iid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM rd)
SELECT iid, tig, bgn, "end", CAST(sum(CASE WHEN bgn > far - 8 THEN 1 ELSE 0 END) OVER (PARTITION BY tig ORDER BY bgn, "end", iid ROWS UNBOUNDED PRECEDING) AS BIGINT) AS part FROM f""")
def split_discontinuous(spark, sf):
    return tg.split_discontinuous(reads(spark, sf).select("iid", "tig", "bgn", "end"), 8)


@query(f"""WITH {RD}, t AS (SELECT tig, count(*) AS reads, max(tig_len) AS len, max(q) / CAST(max(tig_len) AS DOUBLE) AS longest, sum(q) - 30.0 * count(*) AS astat,
  sum(CASE WHEN q < 10 THEN q ELSE 0 END) / CAST(max(tig_len) AS DOUBLE) AS shallow FROM rd GROUP BY tig),
r AS (SELECT tig, CASE WHEN reads = 1 THEN 'single_read' WHEN reads < 3 THEN 'few_reads' WHEN longest > 0.6 THEN 'spanned' WHEN astat < -20 THEN 'low_astat' WHEN shallow > 0.2 THEN 'shallow'
  WHEN len < 60 THEN 'short' ELSE 'none' END AS rule FROM t) SELECT tig, CASE rule WHEN 'none' THEN 'unique' ELSE 'repeat' END AS call, rule FROM r""")
def repeat_rules(spark, sf):
    share = lambda c: c / F.max("tig_len")
    t = reads(spark, sf).groupBy("tig").agg(
        F.count(F.lit(1)).alias("reads"), F.max("tig_len").alias("len"), share(F.max("q")).alias("longest"), (F.sum("q") - 30.0 * F.count(F.lit(1))).alias("astat"),
        share(F.sum(F.when(F.col("q") < 10, F.col("q")).otherwise(0))).alias("shallow"),
    )
    return tg.repeat_rules(t, min_reads=3, min_length=60, span=0.6, astat=-20, low_depth=0.2)


def columns(spark, sf):
    """(tig, col, base, own, qv): the reads of a part are aligned to it, one letter of each in a column."""
    return reads(spark, sf).select(F.col("l_partkey").alias("tig"), F.col("rn").alias("col"), F.substring(F.lit("-ACGTACC"), (F.col("e") % 8 + 1).cast("int"), F.lit(1)).alias("base"),
                                   F.substring(F.lit("ACGT"), (F.col("l_partkey") % 4 + 1).cast("int"), F.lit(1)).alias("own"), (F.col("q") % 40).alias("qv"))


COLS = RD + """, cl AS (SELECT l_partkey AS tig, rn AS col, substr('-ACGTACC', CAST(e % 8 + 1 AS BIGINT), 1) AS base, substr('ACGT', CAST(l_partkey % 4 + 1 AS BIGINT), 1) AS own, q % 40 AS qv FROM rd)"""
_SUM = ", ".join(f"CAST(sum(CASE WHEN base = '{s}' THEN hit ELSE miss END) AS DOUBLE) AS s{i}" for i, s in enumerate(tg.SYMBOLS))
_REST = " + ".join(f"CASE WHEN w = {i} THEN 0 ELSE exp(s{i} - top) END" for i in range(5))


@query(f"""WITH {COLS}, lg AS (SELECT *, pow(10.0::DOUBLE, -(CASE qv WHEN 0 THEN 5 ELSE qv END) / 10.0::DOUBLE) AS e FROM cl),
fx AS (SELECT *, CAST(round(ln(1 - e), 9) AS DECIMAL(20, 9)) AS hit, CAST(round(ln(e / 4), 9) AS DECIMAL(20, 9)) AS miss FROM lg),
sm AS (SELECT tig, col, {_SUM}, count(*) AS depth, max(qv) AS own FROM fx GROUP BY tig, col),
tp AS (SELECT *, greatest(s0, s1, s2, s3, s4) AS top FROM sm), wh AS (SELECT *, CASE top WHEN s0 THEN 0 WHEN s1 THEN 1 WHEN s2 THEN 2 WHEN s3 THEN 3 ELSE 4 END AS w FROM tp),
rs AS (SELECT *, {_REST} AS rest FROM wh), wr AS (SELECT *, rest / (1 + rest) AS wrong FROM rs)
SELECT tig, col, substr('{tg.SYMBOLS}', w + 1, 1) AS base, CAST(CASE WHEN depth = 1 THEN own WHEN wrong <= 1e-6 THEN 60 ELSE least(60, round(-10 * log10(wrong))) END AS INTEGER) AS qv, depth FROM wr""")
def base_calls(spark, sf):
    return tg.base_calls(columns(spark, sf))


@query(f"""WITH {COLS}, n AS (SELECT tig, col, own, base, count(*) AS n FROM cl GROUP BY ALL)
SELECT tig, col, own, base AS change_to, n AS votes FROM (SELECT *, sum(n) OVER (PARTITION BY tig, col, own) AS total FROM n) WHERE total > 1 AND 2 * n > total AND base <> own""")
def correction_votes(spark, sf):
    return tg.votes(columns(spark, sf))


K = 22


def _km(name: str, source: str) -> str:
    return f"""{name}_r AS (SELECT id, translate(regexp_replace(text, '[^A-Za-z]', '', 'g'), '{LETTERS}', '{BASES}') AS run FROM {source}),
{name}_w AS (SELECT id, unnest(list_transform(range(1, len(run) - {K - 2}), lambda i: substr(run, i, {K}))) AS f FROM {name}_r WHERE len(run) >= {K}),
{name} AS (SELECT DISTINCT id, least(f, reverse(translate(f, 'ACGT', 'TGCA'))) AS kmer FROM {name}_w)"""


@query(f"""WITH src_a AS (SELECT item_id AS id, text FROM benchmark), src_b AS (SELECT doc_id AS id, text FROM documents), {_km("ka", "src_a")}, {_km("kb", "src_b")},
rare AS (SELECT kmer FROM (SELECT kmer, 1 AS x, 0 AS y FROM ka UNION ALL SELECT kmer, 0, 1 FROM kb) GROUP BY kmer HAVING sum(x) > 0 AND sum(y) > 0 AND sum(x) + sum(y) <= 500)
SELECT ka.id AS a, kb.id AS b, count(*) AS shared FROM rare JOIN ka USING (kmer) JOIN kb USING (kmer) GROUP BY ALL HAVING count(*) >= 2""")
def seed_pairs(spark, sf):
    """Only the letters of the texts count, so that k-mers cross words."""
    b, d = (bases(table(spark, sf, t).select(F.col(i).alias("id"), F.col("text").alias("seq")), dict(zip(LETTERS, BASES))) for t, i in (("benchmark", "item_id"), ("documents", "doc_id")))
    return sd.seed_pairs(b, d, K, 500, 2)


def layout(spark, sf) -> Layout:
    return Layout(events(spark, sf).withColumnRenamed("event_type", "style").withColumn("name", F.col("style")).withColumn("label", F.col("key").cast("string")))


def _style(name: str, test: str) -> str:
    return f'{name}_e AS (SELECT * FROM ev WHERE {test}), {sweep(name, name + "_e")}'


@query(f"""WITH {EV}, {_style("c", "event_type = 'click'")}, {_style("v", "event_type = 'view'")}, ci AS (SELECT key, bgn, "end" FROM c), {merge("cm", "ci")}, vi AS (SELECT key, bgn, "end" FROM v), {merge("vm", "vi")}
SELECT c.key, c.bgn, c."end", c.depth FROM c JOIN cm ON c.key = cm.key AND c.bgn >= cm.bgn AND c."end" <= cm."end"
WHERE EXISTS (SELECT 1 FROM vm WHERE vm.key = cm.key AND vm.bgn <= cm.bgn AND cm."end" <= vm."end")""")
def layout_inside(spark, sf):
    return layout(spark, sf).run("click ?i view")


@query(f"""WITH {EV}, {_style("c", "event_type = 'click'")}, ci AS (SELECT key, bgn, "end" FROM c), {merge("cm", "ci")}
SELECT c.key, c.bgn, c."end", c.depth FROM c JOIN cm ON c.key = cm.key AND c.bgn >= cm.bgn AND c."end" <= cm."end" WHERE cm."end" - cm.bgn < 20000""")
def layout_short(spark, sf):
    return layout(spark, sf).run("click < 20000")


@query("""WITH t AS (SELECT sum(n_chars) // 4 AS total FROM documents), r AS (SELECT doc_id, n_chars, sum(n_chars) OVER (ORDER BY n_chars DESC, doc_id ROWS UNBOUNDED PRECEDING) - n_chars AS before FROM documents)
SELECT doc_id, n_chars FROM r, t WHERE before < total""")
def longest_until(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    total = d.agg(F.floor(F.sum("n_chars") / 4)).first()[0]
    return sl.longest_until(d, total, "doc_id", "n_chars")


@query(f"""WITH {OV}, d AS (SELECT *, row_number() OVER (PARTITION BY a_iid, cls ORDER BY erate) - 1 AS r, count(*) OVER (PARTITION BY a_iid, cls) AS n FROM x WHERE cls IN ('dovetail5', 'dovetail3')),
c AS (SELECT a_iid, cls, erate AS cut FROM d WHERE r = floor((n - 1) * 0.5)) SELECT d.a_iid, d.b_iid, d.cls, d.olen, d.erate FROM d JOIN c ON c.a_iid = d.a_iid AND c.cls = d.cls WHERE d.erate <= c.cut""")
def strong_edges(spark, sf):
    return sl.without_weak(ov.symmetrised(read_overlaps(spark, sf)), 0.5).select("a_iid", "b_iid", "cls", "olen", "erate")


@query(f"""WITH {OV}, n AS (SELECT cls, a_iid, count(*) AS v FROM x WHERE cls IN ('dovetail5', 'dovetail3') GROUP BY cls, a_iid),
md AS (SELECT cls, quantile_disc(v, 0.5) AS mid FROM n GROUP BY cls), mo AS (SELECT cls, v AS mode FROM (SELECT cls, v, count(*) AS c FROM n GROUP BY cls, v) QUALIFY row_number() OVER (PARTITION BY cls ORDER BY c DESC, v) = 1),
ma AS (SELECT cls, 1.4826 * quantile_disc(abs(v - mid), 0.5) AS mad FROM n JOIN md USING (cls) GROUP BY cls)
SELECT round(CAST(sum(mode + 2 * mad) / 2 AS DOUBLE), 6) AS threshold FROM mo JOIN ma USING (cls)""")
def repeat_threshold(spark, sf):
    return sl.repeat_threshold(ov.symmetrised(read_overlaps(spark, sf))).withColumn("threshold", F.round("threshold", 6))


@query("""WITH b AS (SELECT o_orderpriority AS key, CAST(floor(ln(o_totalprice) / ln(10) + 1e-9) AS BIGINT) AS bucket, CAST(floor(o_totalprice) AS BIGINT) AS x FROM orders WHERE o_totalprice >= 1),
c AS (SELECT key, CAST(floor(ln(x) / ln(10) + 1e-9) AS BIGINT) AS bucket, x FROM b)
SELECT key, bucket, count(*) AS n, CAST(sum(x) AS BIGINT) AS total, min(x) AS least, max(x) AS most, CAST(sum(count(*)) OVER (PARTITION BY key ORDER BY bucket) AS BIGINT) AS upto FROM c GROUP BY key, bucket""")
def log_buckets(spark, sf):
    o = table(spark, sf, "orders").where("o_totalprice >= 1")
    return sl.log_buckets(o.select(F.col("o_orderpriority").alias("key"), F.floor("o_totalprice").alias("x")))


@query(f"""WITH {RD}, p AS (SELECT tig AS scaffold, rn AS ord, iid AS piece, lead(iid) OVER w AS next, q, CASE WHEN lead(iid) OVER w IS NOT NULL THEN greatest(noise * 5, 20) END AS gap FROM rd WINDOW w AS (PARTITION BY tig ORDER BY rn)),
s AS (SELECT *, CAST(coalesce(sum(q + coalesce(gap, 0)) OVER (PARTITION BY scaffold ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS bgn FROM p)
SELECT scaffold, CAST(ord AS INTEGER) AS ord, piece, next, bgn, bgn + q AS "end", gap FROM s""")
def scaffold_offsets(spark, sf):
    r = reads(spark, sf)
    return sl.offsets(r.select(F.col("tig").alias("scaffold"), F.col("rn").alias("ord"), F.col("iid").alias("piece"), F.col("q").alias("len"), (F.col("noise") * 5).alias("gap")))


@query("""WITH a AS (SELECT event_type || ' ' || user_id % 50 AS metric, count(*) AS n FROM events WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT event_type || ' ' || user_id % 50 AS metric, count(*) AS n FROM events WHERE event_id % 2 = 1 GROUP BY 1)
SELECT metric, a.n AS before, b.n AS after, b.n - a.n AS change, CASE WHEN a.n IS NULL THEN 'added' WHEN b.n IS NULL THEN 'removed' WHEN a.n = b.n THEN 'same' ELSE 'changed' END AS status FROM a FULL JOIN b USING (metric)""")
def runs_compared(spark, sf):
    """Events of even and odd ids stand for two runs."""
    e = table(spark, sf, "events").select("event_id", F.concat_ws(" ", "event_type", F.col("user_id") % 50).alias("metric"))
    run = lambda k: e.where(F.col("event_id") % 2 == k).groupBy("metric").agg(F.count(F.lit(1)).alias("n"))
    return sl.compared(run(0), run(1), "metric", "n")
