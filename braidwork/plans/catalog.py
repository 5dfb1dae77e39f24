"""The registered queries of the library's own operators and their SQL.

Sequence-style data are read off the general tables: events are intervals of
their users, neighbouring line items of a part are overlapping reads, orders
are tigs of their line items, and texts are sequences by a fixed mapping of
letters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sequence as sq
from ..operators import intervals as iv
from ..operators import kmers as km
from ..operators import overlaps as ov
from ..operators import records as rec
from ..operators import stats as st

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "coverage_depth"

LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
BASES = ("ACGT" * 7)[:26] * 2
K = 9


def query(sql: str | None):
    """Registers a query; one without SQL is tested against a plain version."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events(spark: SparkSession, sf: str) -> DataFrame:
    """(key, bgn, end, event_type): each event spans a minute and one more for each unit of its value."""
    e = table(spark, sf, "events")
    bgn = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
    return e.select(F.col("user_id").alias("key"), bgn.alias("bgn"), (bgn + 60 + 60 * F.floor("value")).alias("end"), "event_type")


def read_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "lineitem")
    l = t.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("iid"), "l_partkey", F.col("l_quantity").cast("int").alias("q"), F.round(F.col("l_discount") * 1000).cast("int").alias("e"),
        F.col("l_returnflag").alias("f"), (F.col("l_quantity") + 100).cast("int").alias("len"), "l_extendedprice",
    )
    w = Window.partitionBy("l_partkey").orderBy("iid", "q", "e", "f", "l_extendedprice")
    o = l.select(
        F.col("iid").alias("a_iid"), F.lead("iid").over(w).alias("b_iid"), (F.col("q") - 25).alias("a_hang"), (F.lead("q").over(w) - 25).alias("b_hang"), (F.col("f") == "R").alias("flipped"),
        F.col("e").alias("erate"), F.col("len").alias("a_len"), F.lead("len").over(w).alias("b_len"),
    )
    return o.where("b_iid is not null and a_iid <> b_iid")


def dna(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("id"), "lang", F.translate("text", LETTERS, BASES).alias("seq"))


EV = "ev AS (SELECT user_id AS key, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS bgn, CAST(floor(epoch_us(ts) / 1000000) + 60 + 60 * floor(value) AS BIGINT) AS \"end\", event_type FROM events)"


def sweep(name: str, source: str) -> str:
    return f"""{name}_p AS (SELECT key, pos, sum(d) AS d FROM (SELECT key, bgn AS pos, 1 AS d FROM {source} UNION ALL SELECT key, "end", -1 FROM {source}) GROUP BY key, pos HAVING sum(d) <> 0),
{name}_s AS (SELECT key, pos AS bgn, lead(pos) OVER (PARTITION BY key ORDER BY pos) AS "end", CAST(sum(d) OVER (PARTITION BY key ORDER BY pos) AS BIGINT) AS depth FROM {name}_p),
{name} AS (SELECT * FROM {name}_s WHERE depth > 0 AND "end" IS NOT NULL)"""


def merge(name: str, source: str) -> str:
    return f"""{name}_m AS (SELECT key, bgn, "end", CASE WHEN bgn <= max("end") OVER (PARTITION BY key ORDER BY bgn, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM {source}),
{name}_g AS (SELECT *, sum(n) OVER (PARTITION BY key ORDER BY bgn, "end", n DESC ROWS UNBOUNDED PRECEDING) AS g FROM {name}_m),
{name} AS (SELECT key, min(bgn) AS bgn, max("end") AS "end", count(*) AS n FROM {name}_g GROUP BY key, g)"""


@query(f'WITH {EV}, {sweep("d", "ev")} SELECT * FROM d')
def coverage_depth(spark, sf):
    return iv.depth(events(spark, sf)).withColumn("depth", F.col("depth").cast("long"))


@query(f"""WITH {EV}, {sweep("d", "ev")}, c AS (SELECT key, depth, sum("end" - bgn) AS n FROM d GROUP BY key, depth)
SELECT key, CAST(sum(n) AS BIGINT) AS covered, round(sum(n * depth) / CAST(sum(n) AS DOUBLE), 6) AS mean_depth, max(depth) AS max_depth FROM c GROUP BY key""")
def depth_summary(spark, sf):
    c = iv.depth(events(spark, sf)).withColumn("n", F.col("end") - F.col("bgn"))
    return c.groupBy("key").agg(F.sum("n").alias("covered"), F.round(F.sum(F.col("n") * F.col("depth")) / F.sum("n"), 6).alias("mean_depth"), F.max("depth").cast("long").alias("max_depth"))


@query(f'WITH {EV}, {merge("i", "ev")} SELECT * FROM i')
def interval_islands(spark, sf):
    return iv.islands(events(spark, sf))


@query(f"""WITH {EV}, {merge("i", "ev")}
SELECT key, bgn, "end" FROM i QUALIFY row_number() OVER (PARTITION BY key ORDER BY "end" - bgn DESC, bgn) = 1""")
def largest_covered(spark, sf):
    return iv.longest(iv.islands(events(spark, sf)))


@query(f"""WITH {EV}, {sweep("d", "ev")}, h AS (SELECT * FROM d WHERE depth >= 3), {merge("i", "h")} SELECT key, bgn, "end" FROM i""")
def depth_at_least(spark, sf):
    return iv.at_least(events(spark, sf), 3)


def _two(value: str) -> str:
    return f"""WITH {EV}, p AS (SELECT key, pos, sum(x) AS x, sum(y) AS y FROM (
  SELECT key, bgn AS pos, 1 AS x, 0 AS y FROM ev WHERE event_type = 'view' UNION ALL SELECT key, "end", -1, 0 FROM ev WHERE event_type = 'view'
  UNION ALL SELECT key, bgn, 0, 1 FROM ev WHERE event_type = 'click' UNION ALL SELECT key, "end", 0, -1 FROM ev WHERE event_type = 'click') GROUP BY key, pos),
r AS (SELECT key, pos AS bgn, lead(pos) OVER w AS "end", sum(x) OVER w AS x, sum(y) OVER w AS y FROM p WINDOW w AS (PARTITION BY key ORDER BY pos)),
v AS (SELECT key, bgn, "end", CAST({value} AS BIGINT) AS depth FROM r WHERE "end" IS NOT NULL),
z AS (SELECT *, CASE WHEN lag("end") OVER w = bgn AND lag(depth) OVER w = depth THEN 0 ELSE 1 END AS n FROM v WHERE depth > 0 WINDOW w AS (PARTITION BY key ORDER BY bgn)),
g AS (SELECT *, sum(n) OVER (PARTITION BY key ORDER BY bgn) AS g FROM z)
SELECT key, min(bgn) AS bgn, max("end") AS "end", depth FROM g GROUP BY key, g, depth"""


def _pair(spark, sf, how):
    e = events(spark, sf)
    return iv.algebra(e.where("event_type = 'view'"), e.where("event_type = 'click'"), how).withColumn("depth", F.col("depth").cast("long"))


@query(_two("least(x, y)"))
def coverage_and(spark, sf):
    return _pair(spark, sf, "and")


@query(_two("greatest(x, y)"))
def coverage_or(spark, sf):
    return _pair(spark, sf, "or")


@query(_two("CASE WHEN y > 0 THEN 0 ELSE x END"))
def coverage_minus(spark, sf):
    return _pair(spark, sf, "minus")


@query(f"""WITH {EV}, b AS (SELECT min(bgn) AS lo, max("end") AS hi FROM ev), {merge("i", "ev")},
g AS (SELECT key, lag("end") OVER (PARTITION BY key ORDER BY bgn) AS bgn, bgn AS "end" FROM i
  UNION ALL SELECT key, lo, min(bgn) FROM i, b GROUP BY key, lo UNION ALL SELECT key, max("end"), hi FROM i, b GROUP BY key, hi)
SELECT key, bgn, "end" FROM g WHERE bgn < "end" """)
def coverage_not(spark, sf):
    e = events(spark, sf)
    span = e.agg(F.min("bgn").alias("bgn"), F.max("end").alias("end"))  # one row
    return iv.complement(e, e.select("key").distinct().join(F.broadcast(span)))


@query(f"""WITH {EV}, {sweep("d", "ev")}, v AS (SELECT key, bgn, "end", CAST(floor(depth / 2) AS BIGINT) AS depth FROM d),
z AS (SELECT *, CASE WHEN lag("end") OVER w = bgn AND lag(depth) OVER w = depth THEN 0 ELSE 1 END AS n FROM v WHERE depth > 0 WINDOW w AS (PARTITION BY key ORDER BY bgn)),
g AS (SELECT *, sum(n) OVER (PARTITION BY key ORDER BY bgn) AS g FROM z)
SELECT key, min(bgn) AS bgn, max("end") AS "end", depth FROM g GROUP BY key, g, depth""")
def cover_divide(spark, sf):
    return iv.divide(events(spark, sf), 2)


@query(f"""WITH {EV}, w AS (SELECT key, bgn - 300 AS bgn, "end" + 300 AS "end" FROM ev), {merge("i", "w")} SELECT * FROM i""")
def cover_expand(spark, sf):
    return iv.islands(iv.dilate(events(spark, sf), 300))


def _semi(test: str) -> str:
    return f"""WITH {EV} SELECT DISTINCT a.key, a.bgn, a."end" FROM ev a WHERE a.event_type = 'view' AND EXISTS (
  SELECT 1 FROM ev b WHERE b.event_type = 'click' AND b.key = a.key AND {test})"""


def _semi_of(spark, sf, how):
    e = events(spark, sf)
    return iv.intersecting(e.where("event_type = 'view'").select("key", "bgn", "end"), e.where("event_type = 'click'"), 3600, how)


@query(_semi('a.bgn < b."end" AND b.bgn < a."end"'))
def interval_intersects(spark, sf):
    return _semi_of(spark, sf, "intersects")


@query(_semi('b.bgn <= a.bgn AND a."end" <= b."end"'))
def interval_inside(spark, sf):
    return _semi_of(spark, sf, "inside")


@query(_semi('a.bgn <= b.bgn AND b."end" <= a."end"'))
def interval_contains(spark, sf):
    return _semi_of(spark, sf, "contain")


@query("""WITH p AS (SELECT c_custkey AS piece, c_nationkey AS target, CAST(sum(100) OVER w AS BIGINT) - 100 AS t_bgn, CAST(sum(100) OVER w AS BIGINT) AS t_end, c_custkey % 2 = 1 AS reverse
  FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey)),
o AS (SELECT o_custkey AS piece, o_orderkey % 90 AS bgn, o_orderkey % 90 + 10 AS "end" FROM orders)
SELECT piece, target, CASE WHEN reverse THEN t_end - "end" ELSE t_bgn + bgn END AS bgn, CASE WHEN reverse THEN t_end - bgn ELSE t_bgn + "end" END AS "end",
  CASE WHEN reverse THEN 'r' ELSE 'f' END AS ori FROM o JOIN p USING (piece)""")
def lift_over(spark, sf):
    w = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    c = table(spark, sf, "customer")
    upto = F.sum(F.lit(100)).over(w)
    placed = c.select(F.col("c_custkey").alias("piece"), F.col("c_nationkey").alias("target"), (upto - 100).alias("t_bgn"), upto.alias("t_end"), (F.col("c_custkey") % 2 == 1).alias("reverse"))
    pos = table(spark, sf, "orders").select(F.col("o_custkey").alias("piece"), (F.col("o_orderkey") % 90).alias("bgn"), (F.col("o_orderkey") % 90 + 10).alias("end"))
    return iv.lift_over(pos, placed)


OV = """l AS (SELECT l_orderkey * 8 + l_linenumber AS iid, l_partkey, CAST(l_quantity AS INTEGER) AS q, CAST(round(l_discount * 1000) AS INTEGER) AS e, l_returnflag AS f,
  CAST(l_quantity + 100 AS INTEGER) AS len, l_extendedprice FROM lineitem),
o1 AS (SELECT iid AS a_iid, lead(iid) OVER w AS b_iid, q - 25 AS a_hang, lead(q) OVER w - 25 AS b_hang, f = 'R' AS flipped, e AS erate, len AS a_len, lead(len) OVER w AS b_len
  FROM l WINDOW w AS (PARTITION BY l_partkey ORDER BY iid, q, e, f, l_extendedprice)),
o AS (SELECT * FROM o1 WHERE b_iid IS NOT NULL AND a_iid <> b_iid),
y AS (SELECT a_iid, b_iid, a_hang, b_hang, flipped, erate, a_len, b_len FROM o UNION ALL
  SELECT b_iid, a_iid, CASE WHEN flipped THEN b_hang ELSE -a_hang END, CASE WHEN flipped THEN a_hang ELSE -b_hang END, flipped, erate, b_len, a_len FROM o),
x AS (SELECT *, CASE WHEN a_hang < 0 AND b_hang < 0 THEN 'dovetail5' WHEN a_hang > 0 AND b_hang > 0 THEN 'dovetail3' WHEN a_hang = 0 AND b_hang = 0 THEN 'equal'
    WHEN a_hang >= 0 AND b_hang <= 0 THEN 'contains' ELSE 'contained' END AS cls,
  greatest(0, least(a_len, CASE WHEN a_hang < 0 THEN CASE WHEN b_hang < 0 THEN a_len + b_hang ELSE a_len END ELSE CASE WHEN b_hang < 0 THEN a_len - a_hang + b_hang ELSE a_len - a_hang END END)) AS olen FROM y)"""


@query(f"WITH {OV} SELECT * FROM y")
def overlap_symmetrise(spark, sf):
    return ov.symmetrised(read_overlaps(spark, sf))


@query(f"WITH {OV} SELECT cls, count(*) AS n, CAST(sum(olen) AS BIGINT) AS olen FROM x GROUP BY cls")
def overlap_class(spark, sf):
    y = ov.symmetrised(read_overlaps(spark, sf))
    return y.groupBy(ov.overlap_class().alias("cls")).agg(F.count(F.lit(1)).alias("n"), F.sum(ov.length_on_a()).alias("olen"))


@query(f"""WITH {OV} SELECT a_iid, cls[9:9] AS a_end, b_iid, olen, erate FROM x WHERE cls IN ('dovetail5', 'dovetail3')
QUALIFY row_number() OVER (PARTITION BY a_iid, cls ORDER BY olen DESC, erate, b_iid, a_hang, b_hang) = 1""")
def best_edge(spark, sf):
    return ov.best_edges(ov.symmetrised(read_overlaps(spark, sf)))


@query(f"""WITH {OV} SELECT a_iid, b_iid AS container, olen FROM x WHERE cls = 'contained' OR (cls = 'equal' AND b_iid < a_iid)
QUALIFY row_number() OVER (PARTITION BY a_iid ORDER BY olen DESC, erate, b_iid) = 1""")
def best_container(spark, sf):
    return ov.best_containers(ov.symmetrised(read_overlaps(spark, sf)))


@query(f"""WITH {OV} SELECT a_iid, b_iid, olen, erate FROM x WHERE erate <= 80 AND olen >= 40
QUALIFY row_number() OVER (PARTITION BY a_iid ORDER BY olen DESC, erate, b_iid, a_hang, b_hang, flipped) <= 2""")
def overlap_topn(spark, sf):
    return ov.top_per_read(ov.symmetrised(read_overlaps(spark, sf)), 2, 80).select("a_iid", "b_iid", "olen", "erate")


@query(f"""WITH {OV} SELECT a_iid, count(*) AS n, count(*) FILTER (cls = 'dovetail5') AS dovetail5, count(*) FILTER (cls = 'dovetail3') AS dovetail3,
  count(*) FILTER (cls = 'contains') AS contains, count(*) FILTER (cls = 'contained') AS contained, count(*) FILTER (cls = 'equal') AS equal FROM x GROUP BY a_iid""")
def overlaps_per_read(spark, sf):
    return ov.per_read(ov.symmetrised(read_overlaps(spark, sf)))


@query(f"WITH {OV} SELECT a_iid, b_iid, olen, erate FROM x WHERE erate <= 30 OR olen * erate <= 5000")
def overlap_quality(spark, sf):
    y = ov.symmetrised(read_overlaps(spark, sf)).where(ov.good(30, 5000))
    return y.select("a_iid", "b_iid", ov.length_on_a().alias("olen"), "erate")


@query(f"""WITH {OV}, e AS (SELECT DISTINCT a_iid, cls[9:9] AS a_end FROM x WHERE cls IN ('dovetail5', 'dovetail3'))
SELECT a_iid, max(a_end) AS a_end FROM e GROUP BY a_iid HAVING count(*) = 1""")
def spur_reads(spark, sf):
    return ov.spurs(ov.symmetrised(read_overlaps(spark, sf)))


KM = f"""s AS (SELECT doc_id, lang, translate(text, '{LETTERS}', '{BASES}') AS seq FROM documents),
r AS (SELECT doc_id, lang, unnest(regexp_extract_all(seq, '[ACGT]{{{K},}}')) AS seq FROM s),
w AS (SELECT doc_id, lang, seq[i : i + {K - 1}] AS kmer FROM (SELECT *, unnest(generate_series(1, length(seq) - {K - 1})) AS i FROM r)),
k AS (SELECT doc_id, lang, least(kmer, reverse(translate(kmer, 'ACGT', 'TGCA'))) AS kmer FROM w),
c AS (SELECT kmer, count(*) AS n FROM k GROUP BY kmer)"""


@query(f"WITH {KM} SELECT kmer, n FROM c WHERE n >= 3")
def kmer_count(spark, sf):
    return km.counts(dna(spark, sf), K).where("n >= 3")


@query(f"WITH {KM} SELECT n, count(*) AS distinct_kmers, n * count(*) AS kmers FROM c GROUP BY n")
def kmer_histogram(spark, sf):
    return km.histogram(km.counts(dna(spark, sf), K))


def _sets(value: str) -> str:
    return f"""WITH {KM}, a AS (SELECT kmer, count(*) FILTER (lang = 'en') AS x, count(*) FILTER (lang = 'de') AS y FROM k GROUP BY kmer)
SELECT kmer, CAST({value} AS BIGINT) AS n FROM a WHERE {value} > 0"""


def _set(spark, sf, how):
    d = dna(spark, sf)
    return km.algebra([km.counts(d.where(F.col("lang") == lang), K) for lang in ("en", "de")], how)


@query(_sets("least(x, y)"))
def kmer_set_min(spark, sf):
    return _set(spark, sf, "min")


@query(_sets("CASE WHEN (x > 0) <> (y > 0) THEN 1 ELSE 0 END"))
def kmer_set_xor(spark, sf):
    return _set(spark, sf, "xor")


@query(f"""WITH {KM}, b1 AS (SELECT translate(text, '{LETTERS}', '{BASES}') AS seq FROM benchmark),
b2 AS (SELECT seq[i : i + {K - 1}] AS kmer FROM (SELECT seq, unnest(generate_series(1, length(seq) - {K - 1})) AS i FROM b1 WHERE length(seq) >= {K})),
b AS (SELECT least(kmer, reverse(translate(kmer, 'ACGT', 'TGCA'))) AS kmer, count(*) AS n FROM b2 WHERE regexp_full_match(kmer, '[ACGT]{{{K}}}') GROUP BY 1),
j AS (SELECT coalesce(c.n, 0) AS x, coalesce(b.n, 0) AS y FROM c FULL JOIN b USING (kmer))
SELECT CASE WHEN x = 0 THEN '0' WHEN x = 1 THEN '1' WHEN x <= 10 THEN '2-10' WHEN x <= 100 THEN '11-100' ELSE 'more' END AS a_class,
  CASE WHEN y = 0 THEN '0' WHEN y = 1 THEN '1' WHEN y <= 10 THEN '2-10' WHEN y <= 100 THEN '11-100' ELSE 'more' END AS b_class, count(*) AS n FROM j GROUP BY 1, 2""")
def kmer_qc_matrix(spark, sf):
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.translate("text", LETTERS, BASES).alias("seq"))
    return km.presence_matrix(km.counts(dna(spark, sf), K), km.counts(b, K))


@query(f"""SELECT doc_id AS id, length(seq) AS len, length(regexp_replace(seq, '[^GC]', '', 'g')) AS gc, md5(reverse(translate(seq, 'ACGT', 'TGCA'))) AS rc
FROM (SELECT doc_id, translate(regexp_replace(text, '[^a-zA-Z]', '', 'g'), '{LETTERS}', '{BASES}') AS seq FROM documents)""")
def sequence_scalars(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.translate(F.regexp_replace("text", "[^a-zA-Z]", ""), LETTERS, BASES).alias("seq"))
    return d.select(F.col("doc_id").alias("id"), F.length("seq").cast("long").alias("len"), sq.gc_count(F.col("seq")).alias("gc"), F.md5(sq.reverse_complement(F.col("seq")).cast("binary")).alias("rc"))


LEN = "v AS (SELECT l_returnflag AS key, CAST(l_quantity AS BIGINT) AS x FROM lineitem)"


def _lengths(spark, sf, name):
    return table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("key"), F.col("l_quantity").cast("long").alias(name))


@query(f"""WITH {LEN}, r AS (SELECT key, x, CAST(sum(x) OVER (PARTITION BY key ORDER BY x DESC) AS BIGINT) AS upto, CAST(sum(x) OVER (PARTITION BY key) AS BIGINT) AS total FROM v)
SELECT key, n, max(x) AS value FROM r, (SELECT unnest([10, 25, 50, 75, 90]) AS n) WHERE upto >= floor(total * n / 100) GROUP BY key, n""")
def n_statistics(spark, sf):
    return st.n_statistics(_lengths(spark, sf, "len"), [10, 25, 50, 75, 90])


@query(f"""WITH {LEN}, m AS (SELECT key, count(*) AS n, avg(x) AS mean, stddev_samp(x) AS stddev, quantile_disc(x, 0.5) AS median FROM v GROUP BY key),
o AS (SELECT key, x AS mode FROM v GROUP BY key, x QUALIFY row_number() OVER (PARTITION BY key ORDER BY count(*) DESC, x) = 1),
d AS (SELECT key, quantile_disc(abs(x - median), 0.5) * 1.4826 AS mad FROM v JOIN m USING (key) GROUP BY key)
SELECT key, n, round(mean, 6) AS mean, round(stddev, 6) AS stddev, median, mode, round(CAST(mad AS DOUBLE), 6) AS mad FROM m JOIN o USING (key) JOIN d USING (key)""")
def histogram_mad(spark, sf):
    s = st.spread(_lengths(spark, sf, "x"))
    return s.select("key", "n", F.round("mean", 6).alias("mean"), F.round("stddev", 6).alias("stddev"), "median", "mode", F.round("mad", 6).alias("mad"))


@query(f"""WITH {LEN}, r AS (SELECT key, x, row_number() OVER (PARTITION BY key ORDER BY x) AS r, count(*) OVER (PARTITION BY key) AS m FROM v),
q AS (SELECT key, max(CASE WHEN r = floor(m / 2) + 1 THEN x END) AS mid, max(CASE WHEN r = floor(m / 3) + 1 THEN x END) AS lo, max(CASE WHEN r = floor(m * 2 / 3) + 1 THEN x END) AS hi FROM r GROUP BY key)
SELECT key, count(*) AS n, CAST(floor(avg(x)) AS BIGINT) AS mean, CAST(floor(coalesce(stddev_samp(x), 0)) AS BIGINT) AS stddev
FROM v JOIN q USING (key) WHERE abs(x - mid) <= 5 * greatest(mid - lo, hi - mid) GROUP BY key""")
def insert_size(spark, sf):
    return st.insert_sizes(_lengths(spark, sf, "x"))


TIG = """t AS (SELECT l_suppkey AS tig, count(*) AS reads, (max(l_partkey) - min(l_partkey) + max(l_partkey + CAST(l_quantity AS BIGINT)) - min(l_partkey + CAST(l_quantity AS BIGINT))) / 2.0 AS rho FROM lineitem GROUP BY l_suppkey)"""


@query(f"""WITH {TIG}, g AS (SELECT sum(reads - 1) / sum(rho) AS rate FROM t)
SELECT tig, reads, rho, round(rho * rate - 0.6931471805599453 * (reads - 1), 4) AS astat FROM t, g""")
def arrival_statistic(spark, sf):
    r = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("tig"), F.col("l_partkey").alias("bgn"), (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("end"))
    return st.arrival_statistic(r).withColumn("astat", F.round("astat", 4))


@query("""SELECT 'balance' AS error, count(*) AS n FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'segment', count(*) FROM customer WHERE c_mktsegment = 'BUILDING'
UNION ALL SELECT 'nation', count(*) FROM customer WHERE c_nationkey > 20""")
def validate_records(spark, sf):
    rules = {"balance": F.col("c_acctbal") < 0, "segment": F.col("c_mktsegment") == "BUILDING", "nation": F.col("c_nationkey") > 20}
    return rec.catalogue(rec.validated(table(spark, sf, "customer"), rules))


@query("""WITH e AS (SELECT user_id AS id, event_type AS value, event_id AS ord FROM events WHERE event_type IN ('view', 'click')),
l AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord DESC, value DESC) = 1)
SELECT c_custkey, c_name, coalesce(value, c_mktsegment) AS c_mktsegment FROM customer LEFT JOIN l ON id = c_custkey""")
def edits_apply(spark, sf):
    e = table(spark, sf, "events").where("event_type in ('view', 'click')").select(F.col("user_id").alias("id"), F.lit("c_mktsegment").alias("field"), F.col("event_type").alias("value"), F.col("event_id").alias("ord"))
    return rec.apply_edits(table(spark, sf, "customer"), e, "c_custkey", ["c_mktsegment"]).select("c_custkey", "c_name", "c_mktsegment")


@query("SELECT user_id, event_id, event_type FROM events WHERE event_id <= 5000 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def version_latest(spark, sf):
    return rec.latest(table(spark, sf, "events"), ["user_id"], "event_id", 5000).select("user_id", "event_id", "event_type")


@query("""SELECT c_nationkey AS a_lib, s_nationkey AS b_lib, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2""")
def library_matrix(spark, sf):
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("a_lib"))
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("b_lib"))
    j = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return j.groupBy("a_lib", "b_lib").agg(F.count(F.lit(1)).alias("n"))
