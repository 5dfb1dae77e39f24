"""Scaffold operators against plain versions and on hand-made rows."""

import numpy as np

from braidwork.operators import scaffolds as sc
from braidwork.plans import scaffolding

SF = "/root/testdata/sf0.001"


def plain_gaps(pieces, edges):
    """Places by numpy's least squares, scaffold by scaffold; edges all run within a scaffold and along its order."""
    out = {}
    for s in {p[0] for p in pieces}:
        own = sorted((p[2], p[1], p[3]) for p in pieces if p[0] == s)
        at = {p[1]: k for k, p in enumerate(own)}
        links = [e for e in edges if e[0] in at and e[1] in at]
        m, v = np.zeros((len(links) + 1, len(own))), np.zeros(len(links) + 1)
        m[-1, 0] = 1.0
        for k, (a, b, mean, var) in enumerate(links):
            w = var**-0.5
            m[k, at[b]], m[k, at[a]], v[k] = w, -w, w * (mean + own[at[a]][2])
        x = np.linalg.lstsq(m, v, rcond=None)[0]
        for k, p in enumerate(own):
            out[p[1]] = (x[k], None if k == 0 else x[k] - x[k - 1] - own[k - 1][2])
    return out


def test_gap_sizes_of_a_table(spark):
    r = scaffolding.reads(spark, SF)
    pieces = [tuple(x) for x in r.select("tig", "iid", "rn", "q").collect()]
    noise = {x.iid: (x.q, x.noise) for x in r.select("iid", "q", "noise").collect()}
    edges = [(e.src, e.dst, e.length - noise[e.src][0], noise[e.src][1] + 1.0) for e in scaffolding.edges(r).collect()]
    want = plain_gaps(pieces, edges)
    got = scaffolding.gap_sizes(spark, SF).collect()
    assert len(got) == len(want)
    for g in got:
        bgn, gap = want[g.piece]
        assert abs(g.bgn - bgn) < 1e-3 and (g.gap is None if gap is None else abs(g.gap - gap) < 1e-3)


def test_gap_sizes_of_hard_rows(spark):
    pieces = spark.createDataFrame([("s", "a", 1, 10), ("s", "b", 2, 20), ("s", "c", 3, 5), ("t", "d", 1, 7), (None, "e", 1, 7)], "scaffold string, piece string, ord int, length int")
    edges = spark.createDataFrame(
        [("a", "b", 4.0, 1.0), ("a", "b", 6.0, 1.0), ("b", "a", 9.0, 1.0), ("a", "d", 3.0, 1.0), ("a", "b", 100.0, 0.0), ("a", "b", None, 1.0)], "piece_a string, piece_b string, mean double, variance double"
    )
    got = {r.piece: (r.bgn, r.gap) for r in sc.gap_sizes(pieces, edges).collect()}
    assert got == {"a": (0.0, None), "b": (15.0, 5.0), "c": (None, None), "d": (0.0, None)}
    assert sc.gap_sizes(pieces.limit(0), edges).count() == 0


def test_bridges_of_a_long_scaffold(spark):
    n = 60_000  # a path with one ring at its end, longer than a batch and than any recursion
    rows = [("long", k, k + 1) for k in range(n)] + [("long", n, n - 2), ("two", 1, 2), ("two", 1, 2), ("self", 5, 5), (None, 1, 2)]
    got = {(r.scaffold, r.a) for r in sc.bridges(spark.createDataFrame(rows, "scaffold string, a long, b long")).collect()}
    assert got == {("long", k) for k in range(n - 2)}


def test_bridges_against_removal():
    rng = np.random.default_rng(3)

    def reaches(edges, a, b):
        seen, todo = {a}, [a]
        while todo:
            x = todo.pop()
            for u, v in edges:
                for p, q in ((u, v), (v, u)):
                    if p == x and q not in seen:
                        seen.add(q)
                        todo.append(q)
        return b in seen

    for _ in range(60):
        edges = list({tuple(sorted(e)) for e in rng.integers(0, 9, (10, 2)).tolist() if e[0] != e[1]})
        got = sc._bridges(np.array([e[0] for e in edges]), np.array([e[1] for e in edges]))
        assert got.tolist() == [not reaches(edges[:k] + edges[k + 1 :], *edges[k]) for k in range(len(edges))]


def test_simulated_reads_lie_where_they_say(spark):
    seq = "ACGTTGCAAC" * 60
    d = spark.createDataFrame([(1, seq), (2, "ACGT"), (3, None)], "id long, seq string")
    turned = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    for kind in ("paired", "mates"):
        rows = sc.simulated(d, 50, 2.0, 0, kind, insert=200, spread=40).collect()
        assert {r.id for r in rows} == {1} and len(rows) == 2 * 12
        for r in rows:
            whole = seq[r.pos : r.pos + r.insert]
            end = whole[:50] if r.side == 1 else whole[-50:]
            assert 200 <= r.insert < 240 and r.seq == (turned(end) if (kind == "paired") == (r.side == 2) else end)
    wrong = sc.simulated(d, 50, 50.0, 1000).collect()
    rate = np.mean([a != b for r in wrong for a, b in zip(r.seq, seq[r.pos : r.pos + 50])])
    assert 0.08 < rate < 0.12


def test_linkers_and_trusted_stretches(spark):
    d = spark.createDataFrame([(1, "TTTTTACGTACCC"), (2, "ACGAAC"), (3, None), (4, "AC"), (5, "TTTTTACG")], "id long, seq string")
    assert {tuple(r) for r in sc.linkers(d, "ACGTAC", 1).collect()} == {(1, 5, 0, 5, 2), (2, 0, 1, 0, 0)}
    assert {tuple(r) for r in sc.trusted_stretch(d, 5, 2).collect()} == {(1, 0, 8), (5, 0, 8)}


def test_contained_reads(spark):
    best = spark.createDataFrame([(2, 1, 5), (3, 2, 4), (4, 5, 1), (5, 4, 1), (6, 9, 1), (None, 1, 1)], "a_iid long, container long, offset long")
    placed = spark.createDataFrame([(1, 7, 100)], "iid long, tig long, bgn long")
    assert {tuple(r) for r in sc.placed_contained(best, placed).collect()} == {(2, 7, 105, 1), (3, 7, 109, 2)}


def plan(df):
    return df._jdf.queryExecution().toString()


def test_linkers_make_no_row_for_a_window(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i % 37 if i % 9 else None, "".join(rng.choice(list("ACGTÉ"), rng.integers(0, 90), p=[0.24, 0.24, 0.24, 0.24, 0.04]))) for i in range(60)] + [(3, None), (90, "A" * 70 + "ACGTAC" * 3)]
    d = spark.createDataFrame(rows, "id long, seq string")
    want = {}
    for i, s in rows:
        for p in range(len(s or "") - 5):
            wrong = sum(a != b for a, b in zip(s[p : p + 6], "ACGTAC"))
            if i is not None and wrong <= 2:
                want[i] = min(want.get(i, (9, 0)), (wrong, p))
    want = sorted(((i, want[i][1], want[i][0], want[i][1], None if s is None else len(s) - want[i][1] - 6) for i, s in rows if i in want), key=str)
    got = sc.linkers(d, "ACGTAC", 2)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert "Generate" not in plan(got)


def test_trusted_stretches_make_no_row_for_a_window(spark):
    rng = np.random.default_rng(4)
    rows = [(i if i < 40 else i % 7, "".join(rng.choice(list("ACGTÉ"), rng.integers(0, 90), p=[0.3, 0.3, 0.3, 0.08, 0.02]))) for i in range(46)] + [(90, "ACGT" * 9), (91, None), (None, "ACACACC")]
    n = {}
    for _, s in rows:
        for p in range(len(s or "") - 3):
            n[s[p : p + 4]] = n.get(s[p : p + 4], 0) + 1
    places = {}
    for i, s in rows:
        places.setdefault(i, []).extend(p for p in range(len(s or "") - 3) if n[s[p : p + 4]] >= 9)
    want = set()
    for i, at in places.items():
        runs = {}
        for r, p in enumerate(sorted(at)):
            runs.setdefault(p - r, []).append(p)
        if runs:
            want.add((i, *max((max(x) + 4 - min(x), -min(x), min(x), max(x) + 4) for x in runs.values())[2:]))
    assert {tuple(r) for r in sc.trusted_stretch(spark.createDataFrame(rows, "id long, seq string"), 4, 9).collect()} == want
    plain = spark.createDataFrame([(r, s) for r, (_, s) in enumerate(rows) if s and "É" not in s], "id long, seq string")
    assert "Generate" not in plan(sc.trusted_stretch(plain, 4, 9))
