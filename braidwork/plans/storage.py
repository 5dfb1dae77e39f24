"""Registered queries on the read store, validation, overlap stores, k-mer modes, reports and the assembly's tables, with their SQL.

Line items are the store's reads: libraries, clear ranges and deletions are read off their numbers.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import probability as pb
from ..operators import graph as gr
from ..operators import intervals as iv
from ..operators import kmers as km
from ..operators import overlaps as ov
from ..operators import records as rec
from ..operators import reports as rp
from ..operators import selection as sl
from ..operators import store as so
from ..operators import trimming as tr
from .assembly import EDGES, RD, edges, mates, reads
from .catalog import BASES, EV, K, KM, LETTERS, OV, dna, events, merge, query, read_overlaps, sweep, table
from .finishing import SPANS, _side, spans


def store(spark, sf):
    """(iid, tig, rn, lib, len, deleted, clr_bgn, clr_end): a clear range may reach beyond its read at both ends."""
    r = reads(spark, sf)
    return r.select(
        "iid", "tig", "rn", (F.col("tig") % 4).alias("lib"), (F.col("q") + 40).alias("len"), (F.col("reverse") & (F.col("noise") < 3)).alias("deleted"),
        (F.col("e") - 3).alias("clr_bgn"), (F.col("q") + 45 - F.col("noise") * 2).alias("clr_end"),
    )


def both_ways(m):
    return m.unionByName(m.select(F.col("mate").alias("iid"), F.col("iid").alias("mate")))


def store_mates(spark, sf):
    return both_ways(mates(reads(spark, sf)))


ST = RD + """,
st AS (SELECT iid, tig, rn, tig % 4 AS lib, q + 40 AS len, reverse AND noise < 3 AS deleted, e - 3 AS clr_bgn, q + 45 - noise * 2 AS clr_end FROM rd),
mb AS (SELECT iid, mate FROM mt UNION ALL SELECT mate, iid FROM mt)"""


@query(f"WITH {ST} SELECT * FROM st WHERE iid IN (65, 66, 130, 1001, 2049)")
def read_lookup(spark, sf):
    return so.lookup(store(spark, sf), [65, 66, 130, 1001, 2049])


@query(f"WITH {ST} SELECT iid, lib, len, deleted FROM st WHERE iid BETWEEN 1000 AND 90000 AND NOT deleted")
def read_range_scan(spark, sf):
    return so.scan(store(spark, sf), 1000, 90000)


@query(f"WITH {ST}, p AS (SELECT iid, min(part) AS part FROM (SELECT iid, rn % 3 AS part FROM rd WHERE noise > 2 UNION ALL SELECT iid, rn % 5 FROM rd WHERE e > 4) GROUP BY iid) SELECT st.*, part FROM st JOIN p USING (iid) WHERE part = 1")
def store_partition(spark, sf):
    r = reads(spark, sf)
    parts = r.where("noise > 2").select((F.col("rn") % 3).cast("int").alias("part"), "iid").unionByName(r.where("e > 4").select((F.col("rn") % 5).cast("int").alias("part"), "iid"))
    return so.partitioned(store(spark, sf), parts).where("part = 1")


@query("""WITH t AS (SELECT o_orderkey, o_custkey % 7 AS a, o_custkey % 7 + o_orderkey % 3 AS b, o_orderkey % 20 AS c FROM orders)
SELECT o_orderkey, list_sort(list_distinct(list_concat(range(a, b + 1), [c]))) AS ids FROM t""".replace("SELECT o_orderkey, list_sort", "SELECT o_orderkey, array_to_string(list_sort").replace("[c]))) AS ids", "[c]))), ' ') AS ids"))
def range_strings(spark, sf):
    o = table(spark, sf, "orders")
    a = F.col("o_custkey") % 7
    text = F.concat_ws(",", F.concat_ws("-", a.cast("string"), (a + F.col("o_orderkey") % 3).cast("string")), (F.col("o_orderkey") % 20).cast("string"))
    return o.select("o_orderkey", F.array_join(so.ranges(text).cast("array<string>"), " ").alias("ids"))


@query(f"WITH {ST}, c AS (SELECT iid FROM st WHERE len > 85 UNION SELECT mate FROM mb WHERE iid IN (SELECT iid FROM st WHERE len > 85)) SELECT iid, lib, len FROM st WHERE iid IN (SELECT iid FROM c)")
def selected_with_mates(spark, sf):
    s = store(spark, sf)
    return so.with_mates(s, store_mates(spark, sf), s.where("len > 85")).select("iid", "lib", "len")


@query(f"WITH {ST}, g AS (SELECT iid FROM st WHERE len < 45 UNION SELECT mate FROM mb WHERE iid IN (SELECT iid FROM st WHERE len < 45)) SELECT iid, deleted OR iid IN (SELECT iid FROM g) AS deleted FROM st")
def deleted_with_mates(spark, sf):
    s = store(spark, sf)
    return so.deleted_with_mates(s, store_mates(spark, sf), s.where("len < 45")).select("iid", "deleted")


CHECKED = ST + """,
cc AS (SELECT *, greatest(clr_bgn, 0) AS b, least(clr_end, len) AS z FROM st),
ck AS (SELECT iid, lib, b AS clr_bgn, z AS clr_end, [x FOR x IN [CASE WHEN clr_bgn < 0 THEN 'clear begin below 0' END, CASE WHEN clr_end > len THEN 'clear end beyond the read' END,
  CASE WHEN b > z THEN 'clear range turned round' END, CASE WHEN z - b < 64 THEN 'clear range too short' END] IF x IS NOT NULL] AS errors, b > z OR z - b < 64 AS refused FROM cc)"""


@query(f"WITH {CHECKED} SELECT iid, clr_bgn, clr_end, array_to_string(errors, '; ') AS errors, refused FROM ck")
def checked_clear_ranges(spark, sf):
    return so.checked_clear(store(spark, sf)).select("iid", "clr_bgn", "clr_end", F.array_join("errors", "; ").alias("errors"), "refused")


@query(f"WITH {CHECKED}, e AS (SELECT lib, unnest(errors) AS error FROM ck) SELECT lib, error, count(*) AS n FROM e GROUP BY lib, error UNION ALL SELECT NULL, error, count(*) FROM e GROUP BY error")
def errors_by_library(spark, sf):
    return so.errors_by_library(so.checked_clear(store(spark, sf)))


@query("""WITH l AS (SELECT s_suppkey AS lib, s_acctbal AS mean, s_acctbal * (s_nationkey - 3) / 40 + 0.00001::DOUBLE AS stddev FROM supplier),
a AS (SELECT *, mean <= 0 AND stddev <= 0 AS x FROM l), b AS (SELECT lib, x, CASE WHEN x THEN 3000.0::DOUBLE ELSE mean END AS m, CASE WHEN x THEN 300.0::DOUBLE ELSE stddev END AS s FROM a),
c AS (SELECT lib, x, m <= 0 AS y, CASE WHEN m <= 0 THEN 10 * s ELSE m END AS m, s FROM b), d AS (SELECT lib, x, y, s <= 0 AS z, m, CASE WHEN s <= 0 THEN 0.1::DOUBLE * m ELSE s END AS s FROM c),
e AS (SELECT lib, x, y, z, m < 3 * s AS u, m, CASE WHEN m < 3 * s THEN 0.1::DOUBLE * m ELSE s END AS s FROM d), f AS (SELECT *, s + 0.001::DOUBLE < 0.1::DOUBLE * m AS v FROM e)
SELECT lib, round(m, 4) AS mean, round(CASE WHEN v THEN 0.1::DOUBLE * m ELSE s END, 4) AS stddev, array_to_string([t FOR t IN [CASE WHEN x THEN 'neither positive' END, CASE WHEN y THEN 'mean' END,
  CASE WHEN z THEN 'deviation' END, CASE WHEN u THEN 'deviation too great' END, CASE WHEN v THEN 'deviation too small' END] IF t IS NOT NULL], '; ') AS errors FROM f""")
def checked_libraries(spark, sf):
    l = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("lib"), F.col("s_acctbal").alias("mean"), (F.col("s_acctbal") * (F.col("s_nationkey") - 3) / 40 + 0.00001).alias("stddev"))
    return so.checked_libraries(l).select("lib", F.round("mean", 4).alias("mean"), F.round("stddev", 4).alias("stddev"), F.array_join("errors", "; ").alias("errors"))


def _links(spark, sf):
    r = reads(spark, sf)
    own = r.select(F.col("iid").alias("frag1"), (F.col("iid") + F.col("noise") - F.col("e") % 3).alias("frag2"), (F.col("q") % 7).alias("k"))
    return own.where("k = 0").drop("k")


LINKS = "lk AS (SELECT iid AS frag1, iid + noise - e % 3 AS frag2 FROM rd WHERE q % 7 = 0)"


@query(f"""WITH {ST}, {LINKS}, u AS (SELECT f, count(*) AS n FROM (SELECT frag1 AS f FROM lk UNION ALL SELECT frag2 FROM lk WHERE frag1 <> frag2) GROUP BY f)
SELECT frag1, frag2, CASE WHEN frag1 = frag2 THEN 'self' WHEN a.iid IS NULL OR b.iid IS NULL THEN 'missing' WHEN a.deleted OR b.deleted THEN 'deleted' WHEN a.lib <> b.lib THEN 'libraries'
  WHEN x.n > 1 OR y.n > 1 THEN 'mated' END AS error FROM lk LEFT JOIN st a ON a.iid = frag1 LEFT JOIN st b ON b.iid = frag2 LEFT JOIN u x ON x.f = frag1 LEFT JOIN u y ON y.f = frag2""")
def checked_links(spark, sf):
    return so.checked_links(_links(spark, sf), store(spark, sf))


@query(f"""WITH {ST}, p AS (SELECT iid AS frag, iid + noise AS bound1, iid - e AS bound2 FROM rd WHERE q % 5 = 0)
SELECT frag, bound1, bound2, CASE WHEN frag = bound1 OR frag = bound2 THEN 'self' WHEN bound1 = bound2 THEN 'same bounds' WHEN a.iid IS NULL OR b.iid IS NULL OR c.iid IS NULL THEN 'missing'
  WHEN a.deleted OR b.deleted OR c.deleted THEN 'deleted' END AS error FROM p LEFT JOIN st a ON a.iid = frag LEFT JOIN st b ON b.iid = bound1 LEFT JOIN st c ON c.iid = bound2""")
def checked_placements(spark, sf):
    p = reads(spark, sf).where("q % 5 = 0").select(F.col("iid").alias("frag"), (F.col("iid") + F.col("noise")).alias("bound1"), (F.col("iid") - F.col("e")).alias("bound2"))
    return so.checked_placements(p, store(spark, sf))


@query(f"""WITH {ST}, ac AS (SELECT event_id AS ord, CASE event_type WHEN 'view' THEN 'ADD' WHEN 'click' THEN 'DELETE' WHEN 'purchase' THEN 'IGNORE' ELSE 'OTHER' END AS action, user_id * 64 + event_id % 6 AS iid, event_id % 5 AS lib FROM events),
f AS (SELECT iid, min(ord) AS o FROM ac WHERE action = 'ADD' GROUP BY iid)
SELECT ord, action, ac.iid, ac.lib, CASE action WHEN 'ADD' THEN CASE WHEN s.iid IS NOT NULL OR f.o < ord THEN 'exists' WHEN ac.lib > 3 THEN 'library' END
  WHEN 'DELETE' THEN CASE WHEN s.iid IS NULL THEN 'missing' WHEN s.deleted THEN 'deleted' WHEN m.iid IS NOT NULL THEN 'mated' END WHEN 'IGNORE' THEN NULL ELSE 'unknown' END AS error
FROM ac LEFT JOIN st s ON s.iid = ac.iid LEFT JOIN f ON f.iid = ac.iid LEFT JOIN (SELECT DISTINCT iid FROM mb) m ON m.iid = ac.iid""")
def checked_actions(spark, sf):
    e = table(spark, sf, "events")
    kind = F.when(F.col("event_type") == "view", "ADD").when(F.col("event_type") == "click", "DELETE").when(F.col("event_type") == "purchase", "IGNORE").otherwise("OTHER")
    a = e.select(F.col("event_id").alias("ord"), kind.alias("action"), (F.col("user_id") * 64 + F.col("event_id") % 6).alias("iid"), (F.col("event_id") % 5).alias("lib"))
    return so.checked_actions(a, store(spark, sf), store_mates(spark, sf), spark.range(4).withColumnRenamed("id", "lib"))


CLEARS = "cv AS (SELECT tig AS iid, rn AS version, e + rn AS bgn, q + e - 8 AS \"end\" FROM rd)"


def _clears(spark, sf):
    return reads(spark, sf).select(F.col("tig").alias("iid"), F.col("rn").alias("version"), (F.col("e") + F.col("rn")).alias("bgn"), (F.col("q") + F.col("e") - 8).alias("end"))


@query(f"""WITH {RD}, {CLEARS} SELECT * FROM cv WHERE bgn <= "end" QUALIFY row_number() OVER (PARTITION BY iid ORDER BY version DESC) = 1""")
def current_clear_ranges(spark, sf):
    return so.current_clear(_clears(spark, sf))


@query(f"""WITH {RD}, {CLEARS} SELECT * FROM cv WHERE bgn <= "end" AND version <= 3 QUALIFY row_number() OVER (PARTITION BY iid ORDER BY version DESC) = 1""")
def reverted_clear_ranges(spark, sf):
    return so.current_clear(_clears(spark, sf), 3)


@query(f"""WITH {ST}, v AS (SELECT l.l_orderkey * 64 + l.rn AS iid, e - 2 AS bgn, q + 60 - 3 * noise AS "end" FROM (SELECT l_orderkey, rn, CAST(round(l_tax * 100) AS BIGINT) AS noise, CAST(round(l_discount * 100) AS BIGINT) AS e, q FROM rd0) l WHERE e > 3)
SELECT st.iid, coalesce(greatest(v.bgn, 0), 1) AS vec_bgn, coalesce(least(v."end", len), 0) AS vec_end FROM st LEFT JOIN v USING (iid)""")
def vector_clear(spark, sf):
    v = reads(spark, sf).where("e > 3").select("iid", (F.col("e") - 2).alias("bgn"), (F.col("q") + 60 - 3 * F.col("noise")).alias("end"))
    return so.with_vector_clear(store(spark, sf), v).select("iid", F.col("vec_bgn").cast("long").alias("vec_bgn"), F.col("vec_end").cast("long").alias("vec_end"))


@query(f"""WITH {ST} SELECT lib, count(*) FILTER (NOT deleted) AS active, count(*) FILTER (deleted) AS removed, count(*) FILTER (NOT deleted AND mate IS NOT NULL) AS mated,
  CAST(sum(len) FILTER (NOT deleted) AS BIGINT) AS letters, CAST(sum(clr_end - clr_bgn) FILTER (NOT deleted) AS BIGINT) AS clear, min(iid) AS least, max(iid) AS most
FROM st LEFT JOIN mb USING (iid) GROUP BY ROLLUP (lib)""")
def store_statistics(spark, sf):
    return so.totals(store(spark, sf).join(store_mates(spark, sf), "iid", "left"))


@query(f"WITH {CHECKED} SELECT clr_end - clr_bgn AS len, count(*) AS n FROM ck GROUP BY 1")
def clear_range_histogram(spark, sf):
    c = so.checked_clear(store(spark, sf))
    return c.groupBy((F.col("clr_end") - F.col("clr_bgn")).alias("len")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_quantity > 40")
def distinct_ids(spark, sf):
    return table(spark, sf, "lineitem").where("l_quantity > 40").select(F.col("l_partkey").alias("id")).distinct()


@query("SELECT uid, row_number() OVER (ORDER BY uid) AS iid FROM (SELECT DISTINCT c_name AS uid FROM customer)")
def id_dictionary(spark, sf):
    return so.dictionary(table(spark, sf, "customer").select(F.col("c_name").alias("uid")))


@query("SELECT o_orderkey, c_name AS name, o_totalprice FROM orders JOIN customer ON c_custkey = o_custkey")
def names_for_ids(spark, sf):
    o, c = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("name"))
    return o.join(c, "o_custkey").select("o_orderkey", "name", "o_totalprice")


@query("WITH r AS (SELECT c_custkey AS requester, 1 + c_custkey % 9 AS n FROM customer) SELECT requester, n, CAST(sum(n) OVER w AS BIGINT) + 1 - n AS bgn, CAST(sum(n) OVER w AS BIGINT) + 1 AS \"end\" FROM r WINDOW w AS (ORDER BY requester)")
def id_blocks(spark, sf):
    return so.blocks(table(spark, sf, "customer").select(F.col("c_custkey").alias("requester"), (1 + F.col("c_custkey") % 9).alias("n")))


@query("SELECT event_type, event_id, user_id FROM events WHERE event_type IN ('click', 'purchase')")
def records_by_type(spark, sf):
    return table(spark, sf, "events").where(F.col("event_type").isin("click", "purchase")).select("event_type", "event_id", "user_id")


# overlap stores


def _both(spark, sf):
    return ov.symmetrised(read_overlaps(spark, sf))


@query(f"WITH {OV} SELECT a_iid, b_iid, a_hang, b_hang, erate FROM x WHERE a_iid BETWEEN 100 AND 60000 AND erate <= 70 AND olen >= 90 AND cls IN ('dovetail5', 'contains')")
def overlap_dump(spark, sf):
    return rp.dump_filter(_both(spark, sf), 70, 90, "5C", (100, 60000)).select("a_iid", "b_iid", "a_hang", "b_hang", "erate")


@query(f"WITH {OV}, m AS (SELECT * FROM y WHERE erate <= 40 UNION SELECT * FROM y WHERE flipped) SELECT * FROM m")
def overlap_stores_merged(spark, sf):
    y = _both(spark, sf)
    return rp.merged_stores(y.where("erate <= 40"), y.where("flipped"))


@query(f"WITH {OV} SELECT a_iid, b_iid, erate FROM y WHERE a_iid % 16 < 9 AND b_iid % 16 < 9")
def overlaps_among(spark, sf):
    y = _both(spark, sf)
    return rp.among(y, y.select(F.col("a_iid").alias("iid")).distinct().where("iid % 16 < 9")).select("a_iid", "b_iid", "erate")


@query(f"""WITH {OV}, lb AS (SELECT DISTINCT iid, iid % 5 AS lib, iid % 5 = 2 AS dd FROM l) SELECT a_iid, b_iid, y.erate FROM y JOIN lb p ON p.iid = a_iid JOIN lb r ON r.iid = b_iid
WHERE y.erate <= 60 AND (p.lib = r.lib OR NOT (p.dd OR r.dd))""")
def overlap_build_filter(spark, sf):
    y = _both(spark, sf)
    ids = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("iid")).distinct()
    return rp.build_filter(y, ids.select("iid", (F.col("iid") % 5).alias("lib"), (F.col("iid") % 5 == 2).alias("dedup")), 60).select("a_iid", "b_iid", "erate")


@query(f"WITH {OV}, n AS (SELECT a_iid, b_iid, min(erate // 2) AS e FROM y WHERE olen_of > 80 GROUP BY ALL) SELECT y.a_iid, y.b_iid, coalesce(e, erate) AS erate FROM y LEFT JOIN n USING (a_iid, b_iid)".replace("y WHERE olen_of > 80", "x WHERE olen > 80"))
def overlap_errors_updated(spark, sf):
    y = _both(spark, sf)
    new = y.where(ov.length_on_a() > 80).select("a_iid", "b_iid", F.floor(F.col("erate") / 2).cast("int").alias("erate"))
    return rp.with_errors(y, new).select("a_iid", "b_iid", "erate")


@query(f"""WITH {OV}, t AS (SELECT DISTINCT least(a_iid, b_iid) AS p, greatest(a_iid, b_iid) AS r FROM y WHERE erate <= 60), f AS (SELECT DISTINCT least(a_iid, b_iid) AS p, greatest(a_iid, b_iid) AS r FROM x WHERE olen >= 95)
SELECT CASE WHEN f.p IS NULL THEN 'missed' WHEN t.p IS NULL THEN 'false' ELSE 'both' END AS status, count(*) AS n FROM t FULL JOIN f ON t.p = f.p AND t.r = f.r GROUP BY 1""")
def overlaps_compared(spark, sf):
    y = _both(spark, sf)
    return rp.compared_pairs(y.where("erate <= 60"), y.where(ov.length_on_a() >= 95))


@query(f"WITH {OV}, pr AS (SELECT iid, iid + 1 AS mate FROM (SELECT DISTINCT iid FROM l) UNION ALL SELECT iid + 1, iid FROM (SELECT DISTINCT iid FROM l)) SELECT a_iid, b_iid, a_hang, b_hang FROM y WHERE EXISTS (SELECT 1 FROM pr WHERE iid = a_iid AND mate = b_iid)")
def mates_overlapping(spark, sf):
    y = _both(spark, sf)
    ids = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("iid")).distinct()
    return rp.mates_overlapping(y, both_ways(ids.select("iid", (F.col("iid") + 1).alias("mate")))).select("a_iid", "b_iid", "a_hang", "b_hang")


@query("SELECT row_number() OVER (ORDER BY h, r) AS job, h AS hash_block, r AS ref_block FROM range(1, 13) a(h), range(1, 10) b(r) WHERE r <= h")
def overlap_block_plan(spark, sf):
    return rp.block_plan(12, 9, spark)


@query(f"""WITH {OV}, d AS (SELECT *, count(*) OVER (PARTITION BY a_iid, cls) AS k FROM x WHERE cls IN ('dovetail5', 'dovetail3'))
SELECT CASE WHEN k >= 2 THEN 'repeat' ELSE 'unique' END AS kind, erate, count(*) AS n, CAST(sum(olen) AS BIGINT) AS letters FROM d GROUP BY 1, 2""")
def end_errors(spark, sf):
    return rp.end_errors(_both(spark, sf), 2)


@query(f"WITH RECURSIVE {OV}, bc AS (SELECT a_iid, b_iid AS container FROM x WHERE cls = 'contained' OR (cls = 'equal' AND b_iid < a_iid) QUALIFY row_number() OVER (PARTITION BY a_iid ORDER BY olen DESC, erate, b_iid) = 1),"
       " ch AS (SELECT a_iid AS iid, container AS root, 1 AS depth FROM bc UNION ALL SELECT ch.iid, bc.container, ch.depth + 1 FROM ch JOIN bc ON bc.a_iid = ch.root WHERE ch.depth < 400)"
       " SELECT iid, CASE WHEN depth < 400 THEN root END AS root, CASE WHEN depth < 400 THEN CAST(depth AS BIGINT) END AS depth FROM ch QUALIFY row_number() OVER (PARTITION BY iid ORDER BY depth DESC) = 1")
def contained_order(spark, sf):
    return gr.contained_order(ov.best_containers(_both(spark, sf)))


@query(f"""WITH {OV} SELECT a_iid, cls, b_iid, erate, olen FROM x WHERE cls IN ('dovetail5', 'dovetail3') QUALIFY row_number() OVER (PARTITION BY a_iid, cls ORDER BY erate, olen DESC, b_iid, a_hang, b_hang, flipped) <= 1""")
def overlap_top_per_end(spark, sf):
    return rp.top_per_end(_both(spark, sf), 1).select("a_iid", "cls", "b_iid", "erate", "olen")


PAIR = "ol AS (SELECT a_iid % 400 AS a_iid, b_iid % 400 AS b_iid, a_hang FROM y), pr AS (SELECT range AS iid, CASE WHEN range % 2 = 0 THEN range + 1 ELSE range - 1 END AS mate FROM range(400))"


@query(f"""WITH {OV}, {PAIR}, nr AS (SELECT DISTINCT a_iid, b_iid FROM ol WHERE abs(a_hang) <= 6)
SELECT n.a_iid AS iid, p.mate, min(n.b_iid) AS keeper FROM nr n JOIN pr p ON p.iid = n.a_iid JOIN pr q ON q.iid = n.b_iid JOIN nr o ON o.a_iid = p.mate AND o.b_iid = q.mate WHERE n.b_iid < n.a_iid GROUP BY 1, 2""")
def duplicate_pairs_by_overlap(spark, sf):
    """Reads are taken in 400 groups, neighbours being mates, so that pairs overlap."""
    y = _both(spark, sf).select((F.col("a_iid") % 400).alias("a_iid"), (F.col("b_iid") % 400).alias("b_iid"), "a_hang")
    m = spark.range(400).select(F.col("id").alias("iid"), F.when(F.col("id") % 2 == 0, F.col("id") + 1).otherwise(F.col("id") - 1).alias("mate"))
    return rp.duplicate_pairs_by_overlap(y, m, 6)


@query(f"WITH {OV}, lb AS (SELECT DISTINCT iid, iid % 97 AS tig FROM l) SELECT p.tig, r.tig AS other, a_iid AS iid, count(*) AS n FROM y JOIN lb p ON p.iid = a_iid JOIN lb r ON r.iid = b_iid WHERE p.tig <> r.tig GROUP BY ALL")
def tig_intersections(spark, sf):
    ids = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("iid")).distinct()
    return rp.intersections(_both(spark, sf), ids.withColumn("tig", F.col("iid") % 97))


@query(f"""WITH {OV}, e AS (SELECT a_iid % 512 AS a_iid, cls, count(*) AS x FROM x WHERE cls IN ('dovetail5', 'dovetail3') GROUP BY 1, 2), v AS (SELECT a_iid % 3 AS lib, cls, x FROM e),
m AS (SELECT lib, cls, quantile_disc(x, 0.5) AS mid FROM v GROUP BY ALL), om AS (SELECT lib, cls, x AS mode FROM v GROUP BY lib, cls, x QUALIFY row_number() OVER (PARTITION BY lib, cls ORDER BY count(*) DESC, x) = 1),
dd AS (SELECT lib, cls, quantile_disc(abs(x - mid), 0.5) * 1.4826 AS mad FROM v JOIN m USING (lib, cls) GROUP BY ALL) SELECT lib, round(avg(mode + 2 * CAST(mad AS DOUBLE)), 6) AS threshold FROM om JOIN dd USING (lib, cls) GROUP BY lib""")
def repeat_models(spark, sf):
    """Reads are taken in 512 groups, so that ends have several overlaps."""
    y = _both(spark, sf).withColumn("a_iid", F.col("a_iid") % 512)
    return rp.repeat_models(y, spark.range(512).select(F.col("id").alias("iid"), (F.col("id") % 3).alias("lib"))).withColumn("threshold", F.round("threshold", 6))


@query(f"""WITH {SPANS}, sg AS (SELECT a_iid // 16 AS key, a_beg AS bgn, a_end AS "end" FROM sp WHERE a_beg < a_end), {merge("i", "sg")}, {sweep("d", "sg")}, hd AS (SELECT key, bgn, "end" FROM d WHERE depth >= 2), {merge("h", "hd")},
b AS (SELECT i.key, greatest(i.bgn, h.bgn) AS bgn, least(i."end", h."end") AS "end" FROM i JOIN h ON i.key = h.key AND i.bgn < h."end" AND h.bgn < i."end")
SELECT key AS iid, bgn, "end" FROM b QUALIFY row_number() OVER (PARTITION BY key ORDER BY "end" - bgn DESC, bgn) = 1""")
def solid_clear_ranges(spark, sf):
    """Reads are taken in groups of 16 ids, so that overlaps lie on each other."""
    return rp.solid_clear(spans(spark, sf).withColumn("a_iid", F.floor(F.col("a_iid") / 16)), 0, 2)


POINTS = f"""co AS (SELECT a_iid // 64 AS id, a_beg // 10 AS a_beg, a_end // 10 AS a_end FROM sp), {_side("a_beg", "bgn", "min", "")}, {_side("a_end", "fin", "max", "DESC")},
tp AS (SELECT id AS iid, CASE WHEN bgn_count >= 4 THEN bgn_mode ELSE coalesce(bgn_twice, bgn_first) END AS bgn, CASE WHEN fin_count >= 4 THEN fin_mode ELSE coalesce(fin_twice, fin_first) END AS "end",
  CASE WHEN bgn_count >= 4 THEN 'mode' WHEN bgn_twice IS NOT NULL THEN 'twice' ELSE 'first' END AS by FROM bgn JOIN fin USING (id))"""


def _decided(spark, sf):
    s = spans(spark, sf).select(F.floor(F.col("a_iid") / 64).alias("a_iid"), F.floor(F.col("a_beg") / 10).alias("a_beg"), F.floor(F.col("a_end") / 10).alias("a_end"))
    return rp.decided_trim(tr.trim_points(s), 4)


@query(f"WITH {SPANS}, {POINTS} SELECT * FROM tp")
def trims_by_evidence(spark, sf):
    return _decided(spark, sf)


@query(f"""WITH {SPANS}, {POINTS}, mx AS (SELECT c_custkey AS iid, c_custkey % 3 AS max_bgn, 8 + c_custkey % 6 AS max_end FROM customer),
j AS (SELECT iid, greatest(coalesce(bgn, max_bgn), max_bgn) AS bgn, least(coalesce("end", max_end), max_end) AS "end" FROM mx LEFT JOIN tp USING (iid)) SELECT *, "end" - bgn < 9 AS deleted FROM j""")
def trims_within_max(spark, sf):
    c = F.col("c_custkey")
    return rp.within_max(_decided(spark, sf), table(spark, sf, "customer").select(c.alias("iid"), (c % 3).alias("max_bgn"), (8 + c % 6).alias("max_end")), 9)


@query("SELECT c_custkey, c_acctbal FROM customer WHERE CAST('0x' || left(md5('7:' || c_custkey), 7) AS BIGINT) < CAST(0.3 * 268435456 AS BIGINT)")
def random_share(spark, sf):
    return sl.random_share(table(spark, sf, "customer"), 0.3, 7, "c_custkey").select("c_custkey", "c_acctbal")


@query("""WITH s AS (SELECT event_id, coalesce(value > 50, false) AS a, coalesce(event_type = 'view', false) AS b FROM events) SELECT event_id, a AND b AS "both", a OR b AS either, a AND NOT b AS only_first, NOT (a OR b) AS neither FROM s""")
def object_sets(spark, sf):
    return sl.chosen_sets(table(spark, sf, "events"), "value > 50", "event_type = 'view'").select("event_id", "both", "either", "only_first", "neither")


@query("""WITH p AS (SELECT l_suppkey AS tig, l_orderkey AS scaffold, l_linenumber AS ord FROM lineitem WHERE l_orderkey % 40 = 1), w AS (SELECT scaffold, min(ord) AS lo, max(ord) AS hi FROM p GROUP BY scaffold),
g AS (SELECT tig, count(*) AS n, bool_and(ord = lo OR ord = hi) AS outside FROM p JOIN w USING (scaffold) GROUP BY tig)
SELECT tig, CASE WHEN n = 1 AND s_acctbal >= 3000 THEN 'unique' WHEN outside THEN 'end' ELSE 'middle' END AS class FROM g JOIN supplier ON s_suppkey = tig""".replace("WHERE l_orderkey % 40 = 1", "WHERE l_quantity = 50"))
def unique_tigs(spark, sf):
    p = table(spark, sf, "lineitem").where("l_quantity = 50").select(F.col("l_suppkey").alias("tig"), F.col("l_orderkey").alias("scaffold"), F.col("l_linenumber").alias("ord"))
    return rp.unique_unique(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("tig"), F.col("s_acctbal").alias("len")), p, 3000)


@query("""WITH v AS (SELECT l_partkey AS iid, count(*) FILTER (l_returnflag = 'A') AS innie, count(*) FILTER (l_returnflag = 'R') AS outtie FROM lineitem GROUP BY 1), m AS (SELECT p_partkey AS iid, p_partkey + 1 AS mate FROM part),
j AS (SELECT iid, mate, coalesce(innie, 0) AS innie, coalesce(outtie, 0) AS outtie FROM m LEFT JOIN v USING (iid))
SELECT *, CASE WHEN innie >= 8 AND innie > outtie THEN 'innie' WHEN outtie >= 8 AND outtie > innie THEN 'outtie' ELSE 'unknown' END AS kind FROM j""")
def mate_votes(spark, sf):
    kind = F.when(F.col("l_returnflag") == "A", "innie").when(F.col("l_returnflag") == "R", "outtie")
    m = table(spark, sf, "part").select(F.col("p_partkey").alias("iid"), (F.col("p_partkey") + 1).alias("mate"))
    return rp.voted(m, table(spark, sf, "lineitem").select(F.col("l_partkey").alias("iid"), kind.alias("kind")), 8)


# k-mers


def _mode(value: str) -> str:
    return f"""WITH {KM}, a AS (SELECT kmer, count(*) FILTER (lang = 'en') AS x, count(*) FILTER (lang = 'de') AS y FROM k GROUP BY kmer), v AS (SELECT kmer, CAST({value} AS BIGINT) AS n FROM a)
SELECT * FROM v WHERE n > 0"""


def _kmers(spark, sf, how):
    d = dna(spark, sf)
    return km.algebra([km.counts(d.where(F.col("lang") == lang), K) for lang in ("en", "de")], how)


MODES = {
    "minexist": "CASE WHEN x > 0 AND y > 0 THEN least(x, y) ELSE x + y END", "max": "greatest(x, y)", "maxexist": "CASE WHEN x > 0 AND y > 0 THEN greatest(x, y) ELSE 0 END", "add": "x + y",
    "and": "CASE WHEN x > 0 AND y > 0 THEN 1 ELSE 0 END", "nand": "CASE WHEN x > 0 AND y = 0 THEN 1 ELSE 0 END", "or": "CASE WHEN x + y > 0 THEN 1 ELSE 0 END", "sub": "greatest(0, x - y)", "abs": "abs(x - y)",
    "divide": "CASE WHEN x > 0 AND y > 0 THEN greatest(1, x // y) ELSE 0 END",
}


def _register(how: str, value: str) -> None:
    def f(spark, sf):
        return _kmers(spark, sf, how)

    f.__name__ = f"kmer_set_{how}"
    query(_mode(value))(f)


for _how, _value in MODES.items():
    _register(_how, _value)


@query(f"WITH {KM} SELECT kmer, n FROM c WHERE n <= 2")
def kmer_at_most(spark, sf):
    return km.within(km.counts(dna(spark, sf), K), most=2)


@query(f"WITH {KM} SELECT kmer, n FROM c WHERE n = 4")
def kmer_equal(spark, sf):
    return km.within(km.counts(dna(spark, sf), K), 4, 4)


@query(f"""WITH {KM}, h AS (SELECT n, count(*) AS d FROM c GROUP BY n), hn AS (SELECT *, lead(d) OVER (ORDER BY n) AS nx FROM h), v AS (SELECT coalesce(min(n) FILTER (nx > d), min(n)) AS valley FROM hn),
p AS (SELECT valley, n AS peak FROM h, v WHERE n >= valley QUALIFY row_number() OVER (ORDER BY d DESC, n) = 1) SELECT valley, peak, 2 * peak AS threshold FROM p""")
def kmer_peak(spark, sf):
    return km.peak(km.histogram(km.counts(dna(spark, sf), K)))


# scalar functions


@query("""WITH v AS (SELECT s_suppkey, s_acctbal / 4000 - 1 AS z, s_nationkey % 9 AS n, 0.5 + s_nationkey / 4.0::DOUBLE AS m, CAST(floor(s_acctbal) AS BIGINT) % 5000 AS code FROM supplier),
t AS (SELECT *, 1 / (1 + 0.2316419::DOUBLE * abs(z)) AS t FROM v),
u AS (SELECT *, exp(-z * z / 2) / sqrt(2 * pi()) * t * (0.319381530::DOUBLE + t * (-0.356563782::DOUBLE + t * (1.781477937::DOUBLE + t * (-1.821255978::DOUBLE + t * 1.330274429::DOUBLE)))) AS tail FROM t)
SELECT s_suppkey, round(CASE WHEN z >= 0 THEN 1 - tail ELSE tail END, 6) AS cdf, round(exp(-m) * pow(m, n) / CAST(factorial(CAST(n AS INTEGER)) AS DOUBLE), 6) AS poisson, code / 10000.0::DOUBLE AS erate,
  CASE WHEN code <= 1 THEN 0 ELSE CAST(floor(128 * ln(CAST(least(code, 4095) AS DOUBLE)) / ln(4096::DOUBLE)) AS INTEGER) END AS log_code FROM u""")
def probability_scalars(spark, sf):
    s = table(spark, sf, "supplier")
    code = F.floor("s_acctbal") % 5000
    n = F.col("s_nationkey") % 9
    return s.select(
        "s_suppkey", F.round(pb.normal_cdf(F.col("s_acctbal") / 4000 - 1), 6).alias("cdf"), F.round(pb.poisson(n, 0.5 + F.col("s_nationkey") / 4.0), 6).alias("poisson"),
        pb.erate(code).alias("erate"), pb.log_code(code).alias("log_code"),
    )


def _fixed_point(steps: int) -> str:
    out = "SELECT l_partkey, n, m, m AS a FROM d"
    for _ in range(steps):
        out = f"SELECT l_partkey, n, m, m * (1 - exp(-a)) AS a FROM ({out})"
    return out


@query(f"WITH d AS (SELECT l_partkey, count(*) AS n, avg(l_quantity) / 10 AS m FROM lineitem GROUP BY l_partkey) SELECT l_partkey, n, CASE WHEN m > 1 THEN round(a, 6) END AS mean FROM ({_fixed_point(60)})")
def truncated_poisson(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"), (F.avg("l_quantity") / 10).alias("m"))
    return g.select("l_partkey", "n", F.round(pb.truncated_poisson_mean(F.col("m")), 6).alias("mean"))


@query(f"""WITH s AS (SELECT item_id, left(translate(regexp_replace(text, '[^a-zA-Z]', '', 'g'), '{LETTERS}', '{BASES}'), 4000) AS seq FROM benchmark)
SELECT item_id, length(seq) AS len, md5(seq) AS back, regexp_full_match(seq, '[ACGTNacgtn]+') AS valid, (length(seq) + 3) // 4 AS quads FROM s""")
def packed_sequences(spark, sf):
    """The letters after packing and unpacking; a benchmark item has fewer than 4000."""
    b = table(spark, sf, "benchmark").select("item_id", F.translate(F.regexp_replace("text", "[^a-zA-Z]", ""), LETTERS, BASES).alias("seq"))
    p = b.withColumn("p", pb.packed(F.col("seq")))
    body = F.length(F.split_part("p", F.lit(":"), F.lit(2)))
    return p.select("item_id", F.length("seq").cast("long").alias("len"), F.md5(pb.unpacked(F.col("p")).cast("binary")).alias("back"), pb.valid_fasta(F.col("seq")).alias("valid"), (body / 2).cast("long").alias("quads"))


@query("""SELECT s_suppkey, CASE WHEN s_nationkey % 3 = 0 THEN s_suppkey END AS number, CASE WHEN s_nationkey % 3 <> 0 THEN s_name END AS name, s_nationkey % 4 IN (1, 2, 3) AS feature FROM supplier""")
def uid_and_feature(spark, sf):
    s = table(spark, sf, "supplier")
    text = F.concat(F.when(F.col("s_nationkey") % 3 == 0, F.col("s_suppkey").cast("string")).otherwise(F.col("s_name")), F.lit(",rest of it"))
    u = pb.uid(text)
    flag = F.element_at(F.array(F.lit("0"), F.lit("T"), F.lit("yes"), F.lit(" 17 ")), (F.col("s_nationkey") % 4 + 1).cast("int"))
    return s.select("s_suppkey", u["number"].alias("number"), u["name"].alias("name"), pb.feature(flag).alias("feature"))


@query("""WITH m AS (SELECT l_orderkey, l_linenumber, l_partkey, ['normal', 'innie', 'outtie', 'anti'][CAST(l_quantity AS INTEGER) % 4 + 1] AS o, CAST(l_quantity AS BIGINT) - 25 AS h, CAST(round(l_tax * 100) AS BIGINT) AS g, l_returnflag = 'A' AS f FROM lineitem),
t AS (SELECT *, o IN ('innie', 'outtie') AS flipped, CASE WHEN o IN ('outtie', 'anti') THEN -g ELSE h END AS a, CASE WHEN o IN ('outtie', 'anti') THEN -h ELSE g END AS b FROM m)
SELECT l_orderkey, l_linenumber, l_partkey, flipped, CASE WHEN f THEN a WHEN flipped THEN b ELSE -a END AS a_hang, CASE WHEN f THEN b WHEN flipped THEN a ELSE -b END AS b_hang FROM t""")
def message_hangs(spark, sf):
    l = table(spark, sf, "lineitem")
    o = F.element_at(F.array(*[F.lit(x) for x in ("normal", "innie", "outtie", "anti")]), (F.col("l_quantity").cast("int") % 4 + 1))
    flipped, a, b = pb.hangs(o, F.col("l_returnflag") == "A", F.col("l_quantity").cast("long") - 25, F.round(F.col("l_tax") * 100).cast("long"))
    return l.select("l_orderkey", "l_linenumber", "l_partkey", flipped.alias("flipped"), a.alias("a_hang"), b.alias("b_hang"))


@query("SELECT letter, count(*) AS n FROM (SELECT unnest(string_split(lower(text), '')) AS letter FROM benchmark) WHERE letter <> '' GROUP BY letter")
def letter_composition(spark, sf):
    return rp.letters(table(spark, sf, "benchmark"), "text")


# layouts


@query(f"""WITH {EV}, p AS (SELECT key, "end" AS pos, 0 AS kind, "end" AS o, -1 AS d, NULL AS bgn FROM ev UNION ALL SELECT key, bgn, 1, "end", 1, bgn FROM ev),
r AS (SELECT *, CAST(sum(d) OVER (PARTITION BY key ORDER BY pos, kind, o ROWS UNBOUNDED PRECEDING) AS BIGINT) - 1 AS row FROM p) SELECT key, bgn, o AS "end", row FROM r WHERE kind = 1""")
def layout_rows(spark, sf):
    return rp.rows_of_layout(events(spark, sf))


@query(f"""WITH {EV}, b AS (SELECT min(bgn) + 1000000 AS lo, min(bgn) + 3000000 AS hi FROM ev) SELECT key, greatest(bgn, lo) AS bgn, least("end", hi) AS "end" FROM ev, b WHERE bgn < hi AND "end" > lo""")
def layout_view(spark, sf):
    e = events(spark, sf).select("key", "bgn", "end")
    lo = e.agg(F.min("bgn")).first()[0]
    return e.limit(0) if lo is None else rp.in_view(e, lo + 1_000_000, lo + 3_000_000)


@query(f"""WITH {EV} SELECT key, count(*) AS n, CAST(sum("end" - bgn) AS BIGINT) AS total, round(avg("end" - bgn), 6) AS mean, round(stddev_pop("end" - bgn), 5) AS stddev FROM ev GROUP BY key""")
def layout_lengths(spark, sf):
    return rp.lengths(events(spark, sf)).withColumn("mean", F.round("mean", 6)).withColumn("stddev", F.round("stddev", 5))


@query("WITH k AS (SELECT DISTINCT o_custkey * 3 + j AS line FROM orders, range(3) t(j) WHERE o_orderstatus = 'F') SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT line FROM k)")
def link_members(spark, sf):
    links = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("link"), F.array(*[F.col("o_custkey") * 3 + j for j in range(3)]).alias("members"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("line"), "c_custkey", "c_name")
    return rp.members(links, c).select("c_custkey", "c_name")


# tigs and scaffolds


@query(f"""WITH {RD} SELECT tig, iid, bgn, "end", row_number() OVER (PARTITION BY tig ORDER BY bgn, "end" DESC, iid) AS place FROM rd""")
def layout_order(spark, sf):
    return rp.layout_order(reads(spark, sf).select("tig", "iid", "bgn", "end")).withColumn("place", F.col("place").cast("long"))


STASH = """sh0 AS (SELECT tig, iid, bgn // 20 * 20 AS bgn, bgn // 20 * 20 + q AS "end" FROM rd)"""


@query(f"""WITH {RD}, {STASH} SELECT tig, iid, coalesce("end" > max("end") OVER (PARTITION BY tig ORDER BY bgn, "end" DESC, iid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS kept FROM sh0""")
def stash_reads(spark, sf):
    """Begins are taken in twenties, so that some reads lie within others."""
    b = F.floor(F.col("bgn") / 20) * 20
    return rp.stash(reads(spark, sf).select("tig", "iid", b.alias("bgn"), (b + F.col("q")).alias("end"))).select("tig", "iid", "kept")


@query(f"""WITH {RD}, p AS (SELECT DISTINCT tig, "end" AS at FROM rd WHERE noise > 5) SELECT tig, iid, (SELECT count(*) FROM p WHERE p.tig = rd.tig AND p.at <= (rd.bgn + rd."end") // 2) AS piece FROM rd""")
def broken_tigs(spark, sf):
    r = reads(spark, sf)
    return rp.broken(r.select("tig", "iid", "bgn", "end"), r.where("noise > 5").select("tig", F.col("end").alias("at"))).select("tig", "iid", "piece")


@query("""WITH t AS (SELECT o_orderstatus AS kind, CAST(floor(o_totalprice / 100) AS BIGINT) AS len, CAST(floor(o_totalprice / 250) AS BIGINT) AS gc FROM orders)
SELECT kind, count(*) AS n, CAST(sum(len) AS BIGINT) AS total, min(len) AS least, max(len) AS most, round(avg(len), 4) AS mean, round(CAST(sum(gc) AS DOUBLE) / CAST(sum(len) AS DOUBLE), 6) AS gc FROM t GROUP BY kind""")
def tig_statistics(spark, sf):
    t = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("kind"), F.floor(F.col("o_totalprice") / 100).alias("len"), F.floor(F.col("o_totalprice") / 250).alias("gc"))
    return rp.tig_statistics(t).withColumn("mean", F.round("mean", 4)).withColumn("gc", F.round("gc", 6))


@query(f"""WITH {RD}, g AS (SELECT tig AS scaffold, q AS len, CASE WHEN rn < max(rn) OVER (PARTITION BY tig) THEN greatest(noise * 10 - 20, 20) ELSE 0 END AS gap FROM rd)
SELECT scaffold, count(*) AS pieces, CAST(sum(len) AS BIGINT) AS letters, CAST(sum(gap) AS BIGINT) AS gaps, CAST(sum(len) + sum(gap) AS BIGINT) AS span FROM g GROUP BY scaffold""")
def scaffold_statistics(spark, sf):
    p = reads(spark, sf).select(F.col("tig").alias("scaffold"), F.col("rn").alias("ord"), F.col("q").alias("len"), (F.col("noise") * 10 - 20).alias("gap"))
    return rp.scaffold_statistics(p)


@query(f"""WITH {EDGES} SELECT src AS id_a, dst AS id_b, greatest(a.bgn, b.bgn) - least(a."end", b."end") AS gap,
  CASE WHEN abs(greatest(a.bgn, b.bgn) - least(a."end", b."end") - (length - 20)) <= 3 * sqrt(36.0::DOUBLE) THEN 'trusted' ELSE 'tentative' END AS status
FROM ed JOIN rd a ON a.iid = src JOIN rd b ON b.iid = dst""")
def edge_trust(spark, sf):
    r = reads(spark, sf)
    e = edges(r).select(F.col("src").alias("id_a"), F.col("dst").alias("id_b"), (F.col("length") - 20).alias("mean"), F.lit(36.0).alias("variance"))
    return rp.trust(e, r.select(F.col("iid").alias("piece"), F.col("tig").alias("scaffold"), "bgn", "end"))


@query(f"""WITH {RD}, e AS (SELECT iid // 64 AS a, mate // 64 AS b FROM mt) SELECT least(a % 50, b % 50) AS scaffold_a, greatest(a % 50, b % 50) AS scaffold_b, count(*) AS weight FROM e WHERE a % 50 <> b % 50 GROUP BY 1, 2""")
def scaffold_edges(spark, sf):
    r = reads(spark, sf)
    m = mates(r).select(F.floor(F.col("iid") / 64).alias("id_a"), F.floor(F.col("mate") / 64).alias("id_b"))
    return gr.lifted(m, r.select(F.col("tig").alias("piece"), (F.col("tig") % 50).alias("scaffold")).distinct())


@query(f"WITH {EDGES}, b AS (SELECT * FROM ed UNION ALL SELECT dst, src, length + 1 FROM ed WHERE length > 20) SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS n, min(length) AS length FROM b WHERE src <> dst GROUP BY 1, 2")
def simple_edges(spark, sf):
    e = edges(reads(spark, sf))
    back = e.where("length > 20").select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("length") + 1).alias("length"))
    return gr.simple(e.unionByName(back))


@query(f"WITH {RD}, w AS (SELECT iid // 64 % 40 AS id_a, mate // 64 % 40 AS id_b, count(*) AS weight FROM mt GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY id_a ORDER BY weight DESC, id_b) AS rank FROM w QUALIFY rank <= 3")
def edge_ranking(spark, sf):
    m = mates(reads(spark, sf)).groupBy((F.floor(F.col("iid") / 64) % 40).alias("id_a"), (F.floor(F.col("mate") / 64) % 40).alias("id_b")).agg(F.count(F.lit(1)).alias("weight"))
    return gr.ranked(m, 3).withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {EDGES}, p AS (SELECT e.src, e.dst, e.length, count(*) AS k FROM ed e JOIN ed f ON f.src = e.src JOIN ed g ON g.src = f.dst AND g.dst = e.dst WHERE abs(e.length - f.length - g.length) <= 2 GROUP BY ALL)
SELECT e.src, e.dst, e.length, coalesce(k, 0) AS paths FROM ed e LEFT JOIN p USING (src, dst, length)""")
def edges_confirmed(spark, sf):
    return gr.confirmed(edges(reads(spark, sf)), 2)


@query(f"WITH {EDGES}, b AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM ed WHERE dst = src + 1 UNION ALL SELECT dst, src FROM ed WHERE dst = src + 1)) SELECT src AS node FROM b GROUP BY src HAVING count(*) = 1")
def scaffold_starts(spark, sf):
    return gr.essential_ends(edges(reads(spark, sf)).where("dst = src + 1"))


CLUSTERS = """me AS (SELECT l_partkey AS id_a, l_partkey + 1 + l_suppkey % 2 AS id_b, l_returnflag AS orient, l_extendedprice / 100 AS mean, 30.0::DOUBLE + l_quantity AS variance FROM lineitem),
mo AS (SELECT *, lag(mean) OVER w AS pm, lag(variance) OVER w AS pv FROM me WINDOW w AS (PARTITION BY id_a, id_b, orient ORDER BY mean, variance)),
mn AS (SELECT *, CASE WHEN (mean - pm) * (mean - pm) / (greatest(variance, 25.0) + greatest(pv, 25.0)) < 23.637::DOUBLE THEN 0 ELSE 1 END AS new FROM mo),
mc AS (SELECT *, CAST(sum(new) OVER (PARTITION BY id_a, id_b, orient ORDER BY mean, variance ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster FROM mn)"""


@query(f"WITH {CLUSTERS} SELECT id_a, id_b, orient, cluster, count(*) AS weight, round(sum(mean / variance) / sum(1 / variance), 8) AS mean, round(1 / sum(1 / variance), 8) AS variance FROM mc GROUP BY ALL")
def edge_clusters(spark, sf):
    l = table(spark, sf, "lineitem")
    e = l.select(
        F.col("l_partkey").alias("id_a"), (F.col("l_partkey") + 1 + F.col("l_suppkey") % 2).alias("id_b"), F.col("l_returnflag").alias("orient"), (F.col("l_extendedprice") / 100).alias("mean"), (30.0 + F.col("l_quantity")).alias("variance")
    )
    return gr.clustered(e).withColumn("mean", F.round("mean", 8)).withColumn("variance", F.round("variance", 8))


@query(f"""WITH {EV}, {sweep("d", "ev")}, q AS (SELECT quantile_disc(depth, 0.25) AS low, quantile_disc(depth, 0.75) AS high FROM d) SELECT low, high, CAST(high + 1.5 * (high - low) AS DOUBLE) AS threshold FROM q""")
def repeat_coverage(spark, sf):
    q = rp.repeat_coverage(iv.depth(events(spark, sf)).select(F.col("depth").cast("long").alias("x")))
    return q.withColumn("threshold", F.col("threshold").cast("double"))


@query(f"""WITH {EV}, {sweep("r", "ev")}, vw AS (SELECT key, bgn, "end" FROM ev WHERE event_type = 'view'), {sweep("b", "vw")}, pu AS (SELECT key, bgn, "end" FROM ev WHERE event_type = 'purchase'), {sweep("g", "pu")},
u AS (SELECT key, bgn AS pos FROM r UNION SELECT key, "end" FROM r UNION SELECT key, bgn FROM b UNION SELECT key, "end" FROM b UNION SELECT key, bgn FROM g UNION SELECT key, "end" FROM g),
s AS (SELECT key, pos AS bgn, lead(pos) OVER (PARTITION BY key ORDER BY pos) AS "end" FROM u),
k AS (SELECT s.key, s.bgn, s."end" FROM s WHERE s."end" IS NOT NULL AND EXISTS (SELECT 1 FROM b WHERE b.key = s.key AND b.bgn <= s.bgn AND s."end" <= b."end" AND b.depth >= 1)
  AND NOT EXISTS (SELECT 1 FROM g WHERE g.key = s.key AND g.bgn <= s.bgn AND s."end" <= g."end" AND g.depth > 0) AND NOT EXISTS (SELECT 1 FROM r WHERE r.key = s.key AND r.bgn <= s.bgn AND s."end" <= r."end" AND r.depth > 1)), {merge("i", "k")}
SELECT key, bgn, "end" FROM i""")
def split_points(spark, sf):
    e = events(spark, sf)
    return rp.split_points(e.select("key", "bgn", "end"), e.where("event_type = 'view'"), e.where("event_type = 'purchase'"), 1, 1, 0)


@query(f"WITH {RD}, c AS (SELECT tig AS iid, rn AS col, e AS x, noise < 3 AS gap FROM rd) SELECT iid, col, round(avg(CASE WHEN NOT gap THEN x END) OVER (PARTITION BY iid ORDER BY col ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smooth FROM c")
def smoothed_columns(spark, sf):
    c = reads(spark, sf).select(F.col("tig").alias("iid"), F.col("rn").alias("col"), F.col("e").alias("x"), (F.col("noise") < 3).alias("gap"))
    return rp.smoothed(c, 2).select("iid", "col", F.round("smooth", 6).alias("smooth"))


@query(f"WITH {RD}, u AS (SELECT tig AS iid, rn + e AS \"at\", chr(CAST(65 + noise AS INTEGER)) AS letter FROM rd WHERE reverse UNION ALL SELECT tig, rn + e, chr(CAST(70 + e AS INTEGER)) FROM rd WHERE q > 30) SELECT iid, \"at\", min(letter) AS letter FROM u GROUP BY ALL")
def merged_corrections(spark, sf):
    r = reads(spark, sf).withColumn("at", F.col("rn") + F.col("e"))
    a = r.where("reverse").select(F.col("tig").alias("iid"), "at", F.char(65 + F.col("noise")).alias("letter"))
    b = r.where("q > 30").select(F.col("tig").alias("iid"), "at", F.char(70 + F.col("e")).alias("letter"))
    return rp.merged_corrections([a, b])


@query(f"""WITH {RD} SELECT concat_ws(chr(9), CAST(tig AS VARCHAR), 'braidwork', 'match', CAST(bgn + 1 AS VARCHAR), CAST("end" AS VARCHAR), '.', CASE WHEN reverse THEN '-' ELSE '+' END, '.', 'ID=' || iid) AS line FROM rd""")
def gff_lines(spark, sf):
    return rp.gff(reads(spark, sf).select(F.col("tig").cast("string").alias("seq"), F.col("iid").alias("name"), "bgn", "end", "reverse"))


@query("""WITH r AS (SELECT 'UTG' AS kind, o_orderkey AS id FROM orders UNION ALL SELECT 'MDI', s_suppkey FROM supplier UNION ALL SELECT 'SCF', c_custkey FROM customer UNION ALL SELECT 'XXX', n_nationkey FROM nation)
SELECT kind, id, list_position(['MDI', 'AFG', 'AMP', 'UTG', 'ULK', 'CCO', 'CLK', 'SCF', 'SLK'], kind) AS section FROM r WHERE kind <> 'XXX'""")
def final_report(spark, sf):
    parts = (("UTG", "orders", "o_orderkey"), ("MDI", "supplier", "s_suppkey"), ("SCF", "customer", "c_custkey"), ("XXX", "nation", "n_nationkey"))
    out = None
    for kind, name, col in parts:
        own = table(spark, sf, name).select(F.lit(kind).alias("kind"), F.col(col).cast("long").alias("id"))
        out = own if out is None else out.unionByName(own)
    return rp.report(out)


@query(f"""WITH {RD}, a AS (SELECT r.iid, r.tig % 3 AS lib_a, s.tig % 3 AS lib_b, greatest(0, r.e) AS a_beg, greatest(0, r.e) + least(r.q, s.q) AS a_end FROM rd r JOIN mt ON mt.iid = r.iid JOIN rd s ON s.iid = mt.mate)
SELECT lib_a, lib_b, count(*) AS reads, CAST(sum(a_end - a_beg) AS BIGINT) AS letters FROM a GROUP BY 1, 2""")
def covered_by_libraries(spark, sf):
    r = reads(spark, sf)
    a, b = r.select("iid", (F.col("tig") % 3).alias("lib_a"), "e", F.col("q").alias("qa")), r.select(F.col("iid").alias("mate"), (F.col("tig") % 3).alias("lib_b"), F.col("q").alias("qb"))
    j = mates(r).join(a, "iid").join(b, "mate")
    return rp.covered_by_others(j.select(F.col("iid").alias("a_iid"), "lib_a", "lib_b", F.col("e").alias("a_beg"), (F.col("e") + F.least("qa", "qb")).alias("a_end")))


# the assembly's tables


@query("SELECT count(*) AS n, max(o_orderkey) AS last, count(DISTINCT o_custkey) AS owners FROM orders")
def table_counts(spark, sf):
    return table(spark, sf, "orders").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("last"), F.countDistinct("o_custkey").alias("owners"))


@query("""SELECT o_orderkey AS unitig, o_orderstatus AS status, l_linenumber AS read, l_quantity AS len, p_type AS kind FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE o_orderstatus = 'O'""")
def unitig_read_join(spark, sf):
    o = table(spark, sf, "orders").where("o_orderstatus = 'O'").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    l = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", F.col("l_linenumber").alias("read"), F.col("l_quantity").alias("len"))
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("kind"))
    return l.join(o, "o_orderkey").join(p, "l_partkey").select(F.col("o_orderkey").alias("unitig"), "status", "read", "len", "kind")


@query("""SELECT c_custkey AS contig, n_name AS genome, count(DISTINCT o_orderkey) AS unitigs, count(*) AS reads, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS letters FROM customer JOIN nation ON n_nationkey = c_nationkey
JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2""")
def contig_read_join(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    n = table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("genome"))
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    l = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("reads"), F.sum(F.col("l_quantity").cast("long")).alias("letters"))
    j = o.join(l, "o_orderkey").join(c, "o_custkey").join(n, "n_nationkey")
    per = j.groupBy(F.col("o_custkey").alias("contig"), "genome")
    return per.agg(F.countDistinct("o_orderkey").alias("unitigs"), F.sum("reads").alias("reads"), F.sum("letters").alias("letters"))


@query("""WITH e AS (SELECT user_id AS id, event_id AS version, event_type AS value FROM events), k AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC, value DESC) = 1) SELECT id, version, value FROM k""")
def store_compacted(spark, sf):
    return rec.compacted(table(spark, sf, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("version"), F.col("event_type").alias("value")), ["id"], "version")
