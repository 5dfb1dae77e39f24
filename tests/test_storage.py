"""The read store's rules and layouts on hand-made rows."""

from pyspark.sql import functions as F

from braidwork.functions import probability as pb
from braidwork.operators import graph as gr
from braidwork.operators import kmers as km
from braidwork.operators import records as rec
from braidwork.operators import reports as rp
from braidwork.operators import store as so

READS = "iid long, lib long, len long, deleted boolean, clr_bgn long, clr_end long"


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_a_clear_range_out_of_bounds_is_told_and_set_right(spark):
    r = spark.createDataFrame([(1, 1, 500, False, 20, 400), (2, 1, 500, False, -5, 700), (3, 1, 500, False, 510, 700), (4, 2, 100, False, 50, 90), (5, 2, 100, False, None, 90)], READS)
    c = so.checked_clear(r)
    got = {x.iid: (x.clr_bgn, x.clr_end, x.errors, x.refused) for x in c.collect()}
    assert got[1] == (20, 400, [], False)
    assert got[2] == (0, 500, ["clear begin below 0", "clear end beyond the read"], False)
    assert got[3] == (510, 500, ["clear end beyond the read", "clear range turned round", "clear range too short"], True)
    assert got[4] == (50, 90, ["clear range too short"], True)
    assert (2, "clear range too short", 1) in rows(so.errors_by_library(c.where("iid < 5")), "lib", "error", "n")
    assert (None, "clear range too short", 2) in rows(so.errors_by_library(c.where("iid < 5")), "lib", "error", "n")
    assert so.checked_clear(r.limit(0)).count() == 0


def test_links_placements_and_actions(spark):
    r = spark.createDataFrame([(1, 1, 9, False, 0, 9), (2, 1, 9, False, 0, 9), (3, 2, 9, False, 0, 9), (4, 1, 9, True, 0, 9), (5, 1, 9, False, 0, 9)], READS)
    l = spark.createDataFrame([(1, 1), (1, 99), (1, 4), (2, 3), (2, 5), (5, 1)], "frag1 long, frag2 long")
    assert rows(so.checked_links(l, r), "frag1", "frag2", "error") == [(1, 1, "self"), (1, 4, "deleted"), (1, 99, "missing"), (2, 3, "libraries"), (2, 5, "mated"), (5, 1, "mated")]
    assert rows(so.checked_links(spark.createDataFrame([(1, 2)], "frag1 long, frag2 long"), r), "error") == [(None,)]
    p = spark.createDataFrame([(1, 1, 2), (1, 2, 2), (1, 2, 9), (1, 2, 4), (1, 2, 3)], "frag long, bound1 long, bound2 long")
    assert rows(so.checked_placements(p, r), "bound1", "bound2", "error") == [(1, 2, "self"), (2, 2, "same bounds"), (2, 3, None), (2, 4, "deleted"), (2, 9, "missing")]
    m = spark.createDataFrame([(1, 2), (2, 1)], "iid long, mate long")
    a = spark.createDataFrame([(1, "ADD", 7, 1), (2, "ADD", 7, 1), (3, "ADD", 8, 6), (4, "DELETE", 1, 1), (5, "DELETE", 4, 1), (6, "DELETE", 70, 1), (7, "IGNORE", 70, 1), (8, "X", 1, 1), (9, "DELETE", 5, 1)], "ord long, action string, iid long, lib long")
    got = rows(so.checked_actions(a, r, m, r.select("lib")), "ord", "error")
    assert got == [(1, None), (2, "exists"), (3, "library"), (4, "mated"), (5, "deleted"), (6, "missing"), (7, None), (8, "unknown"), (9, None)]
    assert rows(so.deleted_with_mates(r, m, spark.createDataFrame([(1,)], "iid long")).where("deleted"), "iid") == [(1,), (2,), (4,)]
    assert rows(so.deleted_with_mates(r, m, spark.createDataFrame([(1,)], "iid long"), False).where("deleted"), "iid") == [(1,), (4,)]


def test_libraries_are_repaired(spark):
    l = spark.createDataFrame([(1, 0.0, 0.0), (2, -1.0, 50.0), (3, 1000.0, -1.0), (4, 1000.0, 400.0), (5, 1000.0, 10.0), (6, 1000.0, 200.0)], "lib long, mean double, stddev double")
    got = {r.lib: (round(r["mean"], 6), round(r["stddev"], 6), r.errors) for r in so.checked_libraries(l).collect()}
    assert got == {
        1: (3000.0, 300.0, ["neither positive"]), 2: (500.0, 50.0, ["mean"]), 3: (1000.0, 100.0, ["deviation"]), 4: (1000.0, 100.0, ["deviation too great"]),
        5: (1000.0, 100.0, ["deviation too small"]), 6: (1000.0, 200.0, []),
    }
    assert rows(so.checked_libraries(l, fix=False).where("lib = 4"), "stddev") == [(400.0,)]


def test_range_strings(spark):
    text = ["3-5,9", "", None, "7", "5-3", "x,2", " 1 - 2 , 2 ", "1-2-3"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(text)], "i int, t string")
    assert [r.x for r in d.select("i", so.ranges(F.col("t")).alias("x")).orderBy("i").collect()] == [[3, 4, 5, 9], [], [], [7], [], [2], [1, 2], []]


def test_scalars(spark):
    d = spark.createDataFrame([("ACGTA",), ("",), ("T",), ("ACGTACGT",), ("nnA",), (None,)], "s string")
    p = d.select("s", pb.packed(F.col("s")).alias("p")).select("s", "p", pb.unpacked(F.col("p")).alias("u"))
    assert {r.s: r.u for r in p.collect()} == {"ACGTA": "ACGTA", "": "", "T": "T", "ACGTACGT": "ACGTACGT", "nnA": "AAA", None: None}
    v = spark.createDataFrame([("1", True), ("T", True), ("Yes", True), ("0", False), ("no", False), (None, None), ("25", True)], "v string, want boolean")
    assert v.where(~pb.feature(F.col("v")).eqNullSafe(F.col("want"))).count() == 0
    z = spark.createDataFrame([(0.0, 0.5), (1.96, 0.975002), (-1.0, 0.158655)], "z double, want double")
    assert z.where(F.abs(pb.normal_cdf(F.col("z")) - F.col("want")) > 1e-5).count() == 0
    table = pb.bound_table(0.06, 20)
    assert table == sorted(table) and table[0] == 1 and len(table) == 21
    from math import comb

    tail = lambda n, e: 1 - sum(comb(n, k) * 0.06**k * 0.94 ** (n - k) for k in range(e + 1))
    assert all(tail(table[e], e) > 1e-4 >= tail(table[e] - 1, e) for e in range(1, 21) if table[e] - 1 >= e)


def test_versions_and_numbers(spark):
    d = spark.createDataFrame([(1, 1, "a"), (1, 3, "b"), (1, 3, "c"), (2, 9, None), (None, 1, "n")], "id long, v long, x string")
    assert rows(rec.latest(d, ["id"], "v"), "id", "v", "x") == [(1, 3, "c"), (2, 9, None), (None, 1, "n")]
    assert rows(rec.latest(d, ["id"], "v", 2), "id", "x") == [(1, "a"), (None, "n")]
    n = spark.createDataFrame([(f"u{i % 40:03}",) for i in range(100)] + [(None,)], "uid string")
    assert rows(so.dictionary(n), "uid", "iid") == [(f"u{i:03}", i + 1) for i in range(40)]
    assert so.dictionary(n.limit(0)).count() == 0 and so.blocks(spark.createDataFrame([], "requester long, n long")).count() == 0


def test_clusters_keep_all_edges_and_hubs_are_passed(spark):
    e = spark.createDataFrame([(1, 2, "AB", m, 100.0) for m in (0.0, 10.0, 500.0, 505.0, 2000.0)], "id_a long, id_b long, orient string, mean double, variance double")
    assert [(r.cluster, r.weight) for r in gr.clustered(e).orderBy("cluster").collect()] == [(1, 2), (2, 2), (3, 1)]
    hub = [(0, 1, 5)] + [(1, i, 5) for i in range(2, 102)] + [(0, 50, 10)]
    got = gr.transitive(spark.createDataFrame(hub, "src long, dst long, length long"), 1)
    assert rows(got, "src", "dst") == [(0, 50)]


def test_containers_in_a_circle_have_no_root(spark):
    b = spark.createDataFrame([(1, 2), (2, 3), (4, 5), (5, 4), (6, 4)], "a_iid long, container long")
    assert rows(gr.contained_order(b), "iid", "root", "depth") == [(1, 3, 2), (2, 3, 1), (4, None, None), (5, None, None), (6, None, None)]


def test_plan_of_blocks(spark):
    got = rows(rp.block_plan(4, 2, spark), "job", "hash_block", "ref_block")
    assert got == [(1, 1, 1), (2, 2, 1), (3, 2, 2), (4, 3, 1), (5, 3, 2), (6, 4, 1), (7, 4, 2)]


def test_kmer_modes(spark):
    a, b = (spark.createDataFrame(x, "kmer string, n long") for x in ([("A", 4), ("C", 2)], [("A", 3), ("G", 5)]))
    want = {"minexist": {"A": 3, "C": 2, "G": 5}, "maxexist": {"A": 4}, "nand": {"C": 1}, "or": {"A": 1, "C": 1, "G": 1}, "abs": {"A": 1, "C": 2, "G": 5}, "divide": {"A": 1}, "max": {"A": 4, "C": 2, "G": 5}}
    for how, x in want.items():
        assert {r.kmer: r.n for r in km.algebra([a, b], how).collect()} == x
