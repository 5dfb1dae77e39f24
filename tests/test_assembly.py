"""Graphs, tigs, seeds, alignments, layout queries and streams on small rows, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidwork.functions import align as al
from braidwork.operators import graph as gr
from braidwork.operators import seeds as sd
from braidwork.operators import tigs as tg
from braidwork.plans.intervalquery import Layout, QueryError
from braidwork.streaming import flows


def got(df, *cols):
    return sorted((tuple(r) for r in df.select(*(cols or df.columns)).collect()), key=str)


def test_follow_and_components(spark):
    chain = [(i, i + 1, 2) for i in range(100)] + [(200, 201, 1), (201, 202, 1), (202, 200, 1), (300, 201, 1)]
    s = spark.createDataFrame(chain, "node long, to long, length long")
    out = {r.node: r for r in gr.follow(s).collect()}
    assert all((out[i]["last"], out[i].steps, out[i].length, out[i].cyclic) == (100, 100 - i, 2 * (100 - i), False) for i in range(100))
    assert all(out[i].cyclic and out[i]["last"] is None for i in (200, 201, 202, 300))
    assert gr.follow(s.limit(0)).count() == 0
    links = [(i, i + 1) for i in range(0, 70)] + [(500, 400), (400, 500), (600, 600), (None, 3)]
    random.Random(1).shuffle(links)
    c = {r.node: r.component for r in gr.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert c == {i: 0 for i in range(71)} | {400: 400, 500: 400, 600: 600}


def test_transitive_and_reach(spark):
    e = spark.createDataFrame([(1, 2, 5), (2, 3, 5), (1, 3, 11), (1, 4, 50), (3, 4, 7)], "src long, dst long, length long")
    assert got(gr.transitive(e, 1)) == [(1, 3, 11)]
    assert got(gr.transitive(e, 1, max_degree=0)) == []
    p = spark.createDataFrame([(1, 4), (4, 1)], "src long, dst long")
    assert got(gr.reach(e, p, 3, 20)) == [(1, 4, 2, 18)]
    assert got(gr.reach(e, p, 1, 20)) == []


def test_mates_and_tigs(spark):
    r = spark.createDataFrame(
        [(1, 7, 0, 50, False), (2, 7, 250, 300, True), (3, 7, 0, 50, False), (4, 7, 250, 300, True), (5, 8, 0, 50, True), (6, 7, 900, 950, True), (7, 7, 10, 60, True)],
        "iid long, tig long, bgn long, end long, reverse boolean")
    m = spark.createDataFrame([(1, 2), (3, 4), (1, 5), (1, 6), (1, 3), (1, 7), (4, 1)], "iid long, mate long")
    assert got(tg.mate_status(r, m, 300, 10)) == sorted([(1, 2, "good"), (3, 4, "good"), (1, 5, "apart"), (1, 6, "far"), (1, 3, "same_way"), (1, 7, "near"), (4, 1, "good")], key=str)
    assert got(tg.duplicate_reads(r)) == [(3, 1), (4, 2)]
    assert got(tg.duplicate_pairs(r, spark.createDataFrame([(1, 2), (3, 4)], "iid long, mate long"))) == [(3, 4, 1)]
    assert got(tg.split_discontinuous(r.where("tig = 7"), 40), "iid", "part") == [(1, 0), (2, 1), (3, 0), (4, 1), (6, 2), (7, 0)]
    ok = spark.range(1).select(gr.agree(F.lit(100.0), F.lit(100.0), F.lit(110.0), F.lit(100.0)), gr.agree(F.lit(0.0), F.lit(1.0), F.lit(900.0), F.lit(1.0)), gr.agree(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))).first()
    assert tuple(ok) == (True, False, False)


def test_base_calls(spark):
    d = spark.createDataFrame([(1, 1, "A", 30), (1, 1, "A", 20), (1, 1, "C", 10), (1, 2, "G", 13), (1, 3, "A", 20), (1, 3, "C", 20)], "tig int, col int, base string, qv int")
    out = {r.col: (r.base, r.qv, r.depth) for r in tg.base_calls(d).collect()}
    assert out[1][0] == "A" and out[1][1] > 35 and out[2] == ("G", 13, 1) and out[3][0] == "A" and out[3][1] == 3


def _dp(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_aligners(spark):
    rnd = random.Random(3)
    for _ in range(60):
        a, b = ("".join(rnd.choice("ACGT") for _ in range(rnd.randint(1, 14))) for _ in range(2))
        assert al.edit_distance(a, b, 9, 0)[2] == _dp(a, b)
        want = max(((j, -min(_dp(a[i:], b[:j]) for i in range(len(a) + 1))) for j in range(3, len(b) + 1) if min(_dp(a[i:], b[:j]) for i in range(len(a) + 1)) <= 0.3 * j), default=None)
        found = al.dovetail(a, b, 0.3, 3)
        assert (found is None) == (want is None)
        if found:
            assert (found[1], -found[2]) == want and _dp(a[found[0]:], b[:found[1]]) == found[2]
    d = spark.createDataFrame([("ACGTACGT", "ACGTTT"), (None, "A")], "a string, b string")
    assert [tuple(r.x) for r in d.select(al.align("dovetail", 0.0, 3)("a", "b").alias("x")).collect()] == [(4, 4, 0), (None, None, None)]


def test_seed_overlaps(spark):
    rnd = random.Random(5)
    genome = "".join(rnd.choice("ACGT") for _ in range(900))
    reads = [(i, genome[i * 60:i * 60 + 120]) for i in range(12)]
    rc = reads[5][1][::-1].translate(str.maketrans("ACGT", "TGCA"))
    reads[5] = (5, rc)
    o = sd.overlaps(spark.createDataFrame(reads, "id long, seq string"), 15, 20, 0.05, 40)
    pairs = {(r.a_iid, r.b_iid, r.flipped, r.a_hang) for r in o.collect()}
    assert {(i, i + 1, False, 60) for i in range(11) if i not in (4, 5)} <= pairs and (4, 5, True, 60) in pairs
    assert all({a, b} == {a, a + 1} or {a, b} == {a, a - 1} for a, b, _, _ in pairs)


def _profile(rows, lo, hi):
    d = [0] * (hi - lo)
    for b, e, n in rows:
        for x in range(max(b, lo), min(e, hi)):
            d[x - lo] += n
    return d


def _runs(d):
    """Maximal stretches (from, to) where the condition holds."""
    out, start = [], None
    for x, on in enumerate([*d, False]):
        if on and start is None:
            start = x
        elif not on and start is not None:
            out.append((start, x))
            start = None
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_layout_queries(spark, seed):
    rnd = random.Random(seed)
    obj = []
    for i in range(14):
        b = rnd.randrange(0, 60)
        obj.append(("k", b, b + rnd.randrange(1, 16), rnd.choice(["Red", "Blue"]), f"n{i}", rnd.choice(["left 1", "Right 2", None])))
    hi, lo = max(o[2] for o in obj), min(o[1] for o in obj)
    lay = Layout(spark.createDataFrame(obj, "key string, bgn long, end long, style string, name string, label string"))
    prof = lambda f: _profile([(b, e, 1) for _, b, e, *r in obj if f(*r)], lo, hi)
    red, blue = prof(lambda s, n, c: s == "Red"), prof(lambda s, n, c: s == "Blue")
    top, n = max(red), len(red)
    win = lambda d, i, f: [f(d[y] if 0 <= y < n else 0 for y in range(x - i, x + i + 1)) for x in range(n)]
    levels = [(d, r) for d in range(1, top + 1) for r in _runs([v >= d for v in red])]
    stack = lambda keep: _profile([(a, b, 1) for d, (a, b) in levels if keep(a, b)], 0, n)
    br = _runs([v > 0 for v in blue])
    only = lambda keep: [v if any(a <= x < b and keep(a, b) for a, b in _runs([v > 0 for v in red])) else 0 for x, v in enumerate(red)]
    want = {
        "Red & Blue": [min(p, q) for p, q in zip(red, blue)], "Red | Blue": [max(p, q) for p, q in zip(red, blue)], "Red - Blue": [0 if q else p for p, q in zip(red, blue)],
        "!Red": [int(not p) for p in red], "Red _ 2": [p // 2 for p in red], "Red + 2": win(red, 2, max), "Red > 6": stack(lambda a, b: b - a > 6), "Red < 12": only(lambda a, b: b - a < 12),
        "Red ?i Blue": only(lambda a, b: any(x <= a and b <= y for x, y in br)), "Red ?x Blue": stack(lambda a, b: any(x < b and a < y for x, y in br)),
        "Red ?c Blue": stack(lambda a, b: any(a <= x and y <= b for x, y in br)), 'Red ~ i "right"': prof(lambda s, n, c: s == "Red" and bool(c) and "right" in c.lower()),
        "(Red | Blue) & !(Red & Blue)": [min(max(p, q), int(not min(p, q))) for p, q in zip(red, blue)], "Red - 2": stack(lambda a, b: False),
    }
    erode = _profile([(a + 2, b - 2, 1) for _, (a, b) in levels], 0, n)
    want["Red - 2"] = erode
    for text, d in want.items():
        rows = lay.run(text).collect()
        assert _profile([(r.bgn - lo, r.end - lo, r.depth) for r in rows], 0, n) == d, text
    lay.run("Red & Blue", save_as="both")
    assert got(lay.run("$both")) == got(lay.run("Red & Blue"))
    for bad in ("Red &", "(Red", "$none", "Red Blue", '(Red) ~ "x"', "%"):
        with pytest.raises(QueryError):
            lay.run(bad)


def test_streams_equal_batches(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "value")
    src = str(tmp_path / "in")
    e.repartitionByRange(4, "ts").write.parquet(src)
    s = flows.source(spark, src, e.schema, files=1)
    flows.ingest(s, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    flows.ingest(s, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()  # nothing twice
    assert got(spark.read.parquet(str(tmp_path / "out"))) == got(e)
    late = "365 days"
    for name, f in (("w", lambda d: flows.windowed(d, "ts", "user_id", "1 hour", late)), ("s", lambda d: flows.sessions(d, "ts", "user_id", "30 minutes", late)), ("t", lambda d: flows.totals(d, "user_id", "event_id"))):
        q = f(flows.source(spark, src, e.schema, files=4)).writeStream.format("memory").queryName(f"out_{name}").outputMode("complete").trigger(availableNow=True).start()
        q.awaitTermination()
        assert got(spark.table(f"out_{name}")) == got(f(e))


@pytest.mark.parametrize("repeated", [True, False])
@pytest.mark.parametrize("small", [0, 10**6])
def test_seed_pairs_against_plain_sets(spark, monkeypatch, repeated, small):
    """Repeated and null ids count once; a plan without rows for all k-mers."""
    from braidwork.operators import seeds

    monkeypatch.setattr(seeds, "SMALL", small)
    monkeypatch.setattr(seeds, "PAIRS", 7)
    rng = np.random.default_rng(6)
    draw = lambda n, ids: [(ids(i), "".join(rng.choice(list("ACGTNÉ"), rng.integers(0, 60), p=[0.24, 0.24, 0.24, 0.24, 0.02, 0.02]))) for i in range(n)] + [(77, None)]
    left, right = draw(20, lambda i: i), draw(60, lambda i: i if not repeated else None if i % 20 == 3 else i % 50)
    turn = str.maketrans("ACGT", "TGCA")

    def sets(rows):
        out = {}
        for i, s in rows:
            for w in (s[p : p + 4] for p in range(len(s or "") - 3)):
                if set(w) <= set("ACGT"):
                    out.setdefault(i, set()).add(min(w, w[::-1].translate(turn)))
        return out

    a, b = sets(left), sets(right)
    n = lambda w: sum(w in s for s in a.values()) + sum(w in s for s in b.values())
    rare = {w for s in a.values() for w in s if n(w) <= 16}
    want = {(i, j, len(a[i] & b[j] & rare)) for i in a for j in b if len(a[i] & b[j] & rare) >= 2}
    df = lambda rows: spark.createDataFrame(rows, "id long, seq string")
    got = seeds.seed_pairs(df(left), df(right), 4, 16, 2)
    assert len(want) > 9 and {tuple(r) for r in got.collect()} == want
    assert "Generate" not in got._jdf.queryExecution().toString()
