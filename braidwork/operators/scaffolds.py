"""Scaffolds and tigs put together and taken apart: gap sizes, bridges, fills, repeats, bubbles, contained reads, and simulated reads."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows as ws
from ..functions.probability import normal_cdf
from ..functions.sequence import reverse_complement
from . import intervals as iv
from .lineage import dropped, settled

#: Letters of a block.
BLOCK = 512
#: Deviations beyond which a mate is not looked for.
REACH = 5
#: Multiplier and modulus of the minimal standard generator.
MULTIPLIER, MODULUS = 48271, 2147483647


def gap_fill(gaps: DataFrame, anchors: DataFrame, mean: float, stddev: float) -> DataFrame:
    """(scaffold, gap, mates, expected): how many mates are likely to lie in each gap.

    gaps(scaffold, gap, bgn, end), anchors(scaffold, pos, reverse): a mate lies
    `mean` ahead of its anchor, normally spread.  Anchors further off than
    REACH deviations don't count; a gap without any has mates 0 and expected 0.
    Gaps are cut into bins and each anchor has one bin, so the join is an
    equi-join.  Gaps with a null or without length are left out.
    """
    off = REACH * stddev
    width = float(2 * off)
    at = F.when(F.col("reverse"), F.col("pos") - float(mean)).otherwise(F.col("pos") + float(mean))
    a = anchors.select(F.col("scaffold").alias("s"), at.cast("double").alias("at")).withColumn("bin", F.floor(F.col("at") / width)).where("at is not null")
    g = gaps.where("bgn < end and scaffold is not null").select("scaffold", "gap", "bgn", "end")
    b = g.withColumn("b", F.explode(F.sequence(F.floor((F.col("bgn") - off) / width), F.floor((F.col("end") + off) / width))))
    near = (F.col("at") > F.col("bgn") - off) & (F.col("at") < F.col("end") + off)
    part = normal_cdf((F.col("end") - F.col("at")) / stddev) - normal_cdf((F.col("bgn") - F.col("at")) / stddev)
    hit = b.join(a, (F.col("scaffold") == F.col("s")) & (F.col("b") == F.col("bin")) & near).groupBy("scaffold", "gap").agg(F.count(F.lit(1)).alias("mates"), F.sum(part).alias("expected"))
    out = g.select("scaffold", "gap").join(hit, ["scaffold", "gap"], "left")
    return out.select("scaffold", "gap", F.coalesce("mates", F.lit(0)).alias("mates"), F.coalesce("expected", F.lit(0.0)).alias("expected"))


def _bridges(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the edges a - b of one graph are bridges, by one depth-first search without recursion."""
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = ends[: len(a)], ends[len(a) :]
    order = np.argsort(np.concatenate([u, v]), kind="stable")
    to, edge = np.concatenate([v, u])[order].tolist(), np.tile(np.arange(len(a)), 2)[order].tolist()
    first = np.searchsorted(np.concatenate([u, v])[order], np.arange(len(names) + 1)).tolist()
    seen, low, at = [0] * len(names), [0] * len(names), first[:-1]
    out, clock = np.zeros(len(a), bool), 0
    for root in range(len(names)):
        if seen[root]:
            continue
        clock += 1
        seen[root] = low[root] = clock
        path = [(root, -1)]
        while path:
            x, by = path[-1]
            if at[x] < first[x + 1]:
                y, e = to[at[x]], edge[at[x]]
                at[x] += 1
                if e == by:
                    continue
                if seen[y]:
                    low[x] = min(low[x], seen[y])
                else:
                    clock += 1
                    seen[y] = low[y] = clock
                    path.append((y, e))
            else:
                path.pop()
                if path:
                    above = path[-1][0]
                    low[above] = min(low[above], low[x])
                    out[by] = low[x] > seen[above]
    return out


def _whole(frames: Iterator[pd.DataFrame], key: str, rows: int = 20_000) -> Iterator[pd.DataFrame]:
    """Frames sorted by `key`, put together and cut so that each has all rows of its keys and, if it can, `rows` rows."""
    held: list[pd.DataFrame] = []
    n = 0
    for f in frames:
        held.append(f)
        n += len(f)
        if n < rows:
            continue
        all_ = pd.concat(held, ignore_index=True)
        k = all_[key].to_numpy()
        cut = int(np.flatnonzero(k == k[-1])[0])
        if cut:
            yield all_.iloc[:cut].reset_index(drop=True)
        held = [all_.iloc[cut:].reset_index(drop=True)]
        n = max(0, n - cut) if cut else 0  # a long scaffold is looked at again only after as many rows more
    if held:
        all_ = pd.concat(held, ignore_index=True)
        if len(all_):
            yield all_


def bridges(edges: DataFrame) -> DataFrame:
    """(scaffold, a, b): edges without which the pieces of their scaffold fall apart.

    edges(scaffold, a, b); repeated edges hold each other, edges of a piece to
    itself are no bridges, those with a null are left out.  One task searches all of a
    scaffold, or of several short ones at once; its memory grows with the edges of the longest.
    """
    e = edges.where("scaffold is not null and a is not null and b is not null and a <> b").select("scaffold", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    e = e.groupBy("scaffold", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    kinds = ", ".join(f"{c} {e.schema[c].dataType.simpleString()}" for c in ("scaffold", "a", "b"))

    def search(frames):
        for g in _whole(frames, "scaffold"):
            of = pd.factorize(g["scaffold"])[0].astype(np.int64)
            names, uniques = pd.factorize(pd.concat([g["a"], g["b"]], ignore_index=True))
            u, v = names[: len(g)] + of * len(uniques), names[len(g) :] + of * len(uniques)
            yield g.loc[_bridges(u, v) & (g["n"].to_numpy() == 1), ["scaffold", "a", "b"]]

    return e.repartition("scaffold").sortWithinPartitions("scaffold").mapInPandas(search, kinds)


def _positions(i: np.ndarray, j: np.ndarray, apart: np.ndarray, weight: np.ndarray, fixed: np.ndarray) -> np.ndarray:
    """x with x[j] - x[i] nearest to `apart` by weighted least squares and 0 where fixed: conjugate gradients on the normal equations."""
    n = len(fixed)

    def balance(d: np.ndarray) -> np.ndarray:
        out = np.bincount(j, d, n) - np.bincount(i, d, n)
        out[fixed] = 0.0
        return out

    r = balance(weight * apart)
    scale = np.maximum(np.bincount(i, weight, n) + np.bincount(j, weight, n), 1e-300)
    x, z = np.zeros(n), r / scale
    p, rz, start = z.copy(), float(r @ z), float(r @ r)
    for _ in range(4 * n):
        if float(r @ r) <= 1e-28 * start:
            break
        q = balance(weight * (p[j] - p[i]))
        step = rz / float(p @ q)
        x += step * p
        r -= step * q
        z = r / scale
        rz, old = float(r @ z), rz
        p = z + rz / old * p
    return x


def gap_sizes(pieces: DataFrame, edges: DataFrame) -> DataFrame:
    """(scaffold, piece, bgn, gap): places of the pieces of a scaffold by least squares of its edges, and the gap before each (null before the first).

    pieces(scaffold, piece, ord, length), each piece once; edges(piece_a, piece_b, mean, variance):
    `mean` is the distance between the end of one piece and the begin of a later
    one.  Each edge is weighted by 1 / variance; edges whose variance is not
    positive, and those between scaffolds or against the order, are left out.  A piece that no
    edges join to the first one gets null.  The matrix is never built: one
    task holds the pieces and edges of a scaffold, or of several short ones, in proportion to their number.
    """
    p = pieces.where("scaffold is not null and piece is not null").select("scaffold", "piece", "ord", "length")
    a = p.select(F.col("piece").alias("piece_a"), F.col("scaffold").alias("sa"), F.col("ord").alias("oa"), F.col("length").alias("la"))
    b = p.select(F.col("piece").alias("piece_b"), F.col("scaffold").alias("sb"), F.col("ord").alias("ob"))
    e = edges.where("variance > 0 and mean is not null").join(a, "piece_a").join(b, "piece_b").where("sa = sb and oa < ob")
    apart, weight = (F.col("mean") + F.col("la")).cast("double"), (1 / F.col("variance")).cast("double")
    one = p.select("scaffold", "piece", F.lit(None).cast(p.schema["piece"].dataType).alias("other"), F.col("ord").cast("double").alias("ord"), F.col("length").cast("double").alias("x"), F.lit(0.0).alias("w"))
    both = one.unionByName(e.select(F.col("sa").alias("scaffold"), F.col("piece_a").alias("piece"), F.col("piece_b").alias("other"), F.lit(None).cast("double").alias("ord"), apart.alias("x"), weight.alias("w")))
    piece, key = p.schema["piece"].dataType.simpleString(), p.schema["scaffold"].dataType.simpleString()

    def solve(frames):
        for g in _whole(frames, "scaffold"):
            link = g["ord"].isna().to_numpy()
            own = g[~link].sort_values(["scaffold", "ord", "piece"], ignore_index=True)
            n, at = len(own), pd.Index(own["piece"])
            first = np.flatnonzero(own["scaffold"].ne(own["scaffold"].shift()).to_numpy())
            i, j = at.get_indexer(g["piece"][link]), at.get_indexer(g["other"][link])
            tied = np.arange(n)
            while True:  # the first piece that each is joined to
                new = tied.copy()
                np.minimum.at(new, i, tied[j])
                np.minimum.at(new, j, tied[i])
                new = new[new]
                if (new == tied).all():
                    break
                tied = new
            on, fixed = np.isin(tied, first), np.zeros(n, bool)
            fixed[first] = True
            held = on[i]
            x = _positions(i[held], j[held], g["x"].to_numpy()[link][held], g["w"].to_numpy()[link][held], fixed)
            x[~on] = np.nan
            gap = np.append(np.nan, x[1:] - x[:-1] - own["x"].to_numpy()[:-1])
            gap[first] = np.nan
            none = lambda v: pd.Series(v).astype(object).where(~np.isnan(v), None)
            yield pd.DataFrame({"scaffold": own["scaffold"], "piece": own["piece"], "bgn": none(x), "gap": none(gap)})

    return both.repartition("scaffold").sortWithinPartitions("scaffold").mapInPandas(solve, f"scaffold {key}, piece {piece}, bgn double, gap double")


def placed_contained(best: DataFrame, placed: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(iid, tig, bgn, depth) of contained reads by best(a_iid, container, offset): the begin of the container that is placed, and all offsets on the way.

    placed(iid, tig, bgn) are the reads that are in tigs already; a read's way ends at
    the first of them.  Pointer doubling, so the rounds are the logarithm of the
    depth.  Reads whose containers run in a circle or end at a read without a place are left out.
    """
    fixed = placed.select(F.col("iid").alias("p"))
    links = best.where("a_iid is not null and container is not null").join(fixed, F.col("a_iid") == F.col("p"), "left_anti")
    state = settled(links.select(F.col("a_iid").alias("iid"), F.col("container").alias("root"), F.col("offset").cast("long").alias("offset"), F.lit(1).cast("long").alias("depth"), F.lit(True).alias("open")), "placed")
    before = None
    for _ in range(max_rounds):
        hop = state.select(F.col("iid").alias("n"), F.col("root").alias("r"), F.col("offset").alias("o"), F.col("depth").alias("d"))
        new = state.join(hop, F.col("root") == F.col("n"), "left").select(
            "iid", F.coalesce("r", "root").alias("root"), (F.col("offset") + F.coalesce("o", F.lit(0))).alias("offset"),
            (F.col("depth") + F.coalesce("d", F.lit(0))).alias("depth"), F.col("n").isNotNull().alias("open"),
        )
        new = settled(new, "placed")
        dropped(state)
        state, left = new, new.where("open").count()
        if left == 0 or left == before:
            break
        before = left
    at = placed.select(F.col("iid").alias("root"), "tig", F.col("bgn").alias("b"))
    return state.where("not open").join(at, "root").select("iid", "tig", (F.col("b") + F.col("offset")).alias("bgn"), "depth")


def moved_contained(options: DataFrame, mates: DataFrame, placed: DataFrame) -> DataFrame:
    """(iid, tig, moved): the tig that holds a contained read, by options(iid, tig, score).

    Of the tigs that could hold it the one in which its mate lies is taken, else that of
    the best score, of equals the least tig; moved says if the mate decided otherwise than the score.
    mates(iid, mate) hold both ways, placed(iid, tig) the places of mates.
    """
    by = placed.select(F.col("iid").alias("mate"), F.col("tig").alias("m"))
    near = mates.join(by, "mate").select("iid", F.col("m").alias("tig")).distinct().withColumn("near", F.lit(1))
    o = options.groupBy("iid", "tig").agg(F.max("score").alias("score")).join(near, ["iid", "tig"], "left")
    g = o.groupBy("iid").agg(F.min(F.struct(-F.coalesce("near", F.lit(0)), -F.col("score"), "tig")).alias("x"), F.min(F.struct(-F.col("score"), "tig")).alias("y"))
    return g.select("iid", F.col("x.tig").alias("tig"), (F.col("x.tig") != F.col("y.tig")).alias("moved"))


def repeat_marks(foreign: DataFrame, own: DataFrame, least: int, anchor: int, bin_size: int) -> DataFrame:
    """(key, bgn, end): stretches of a tig that `least` foreign reads or more cover and no read of its own spans.

    foreign, own(key, bgn, end) are places in tigs; an own read spans a stretch if it goes on for `anchor` letters on both sides.
    """
    hot = iv.at_least(foreign, least)
    spans = own.select("key", (F.col("bgn") + anchor).alias("bgn"), (F.col("end") - anchor).alias("end")).where("bgn < end")
    return hot.join(iv.intersecting(hot, spans, bin_size, "inside"), ["key", "bgn", "end"], "left_anti").select("key", "bgn", "end")


def bubbles(ends: DataFrame, tigs: DataFrame, longest: int, slop: int) -> DataFrame:
    """(tig, target, bgn, end): tigs of at most `longest` letters that lie on another tig with both ends.

    ends(tig, last, target, pos) are places of a tig's first and last read on other
    tigs, tigs(tig, length).  The distance between both must be within slop of the tig's length; of many
    such places the nearest to it is taken, then the least target and begin.
    """
    short = tigs.where(F.col("length") <= longest).select("tig", "length")
    e = ends.where("tig <> target").join(short, "tig").distinct()
    a = e.where("not last").select("tig", "target", "length", F.col("pos").alias("p"))
    b = e.where("last").select("tig", "target", F.col("pos").alias("q"))
    off = F.abs(F.abs(F.col("q") - F.col("p")) - F.col("length"))
    j = a.join(b, ["tig", "target"]).where(off <= slop)
    best = j.groupBy("tig").agg(F.min(F.struct(off.alias("off"), "target", F.least("p", "q").alias("bgn"), F.greatest("p", "q").alias("end"))).alias("k"))
    return best.select("tig", "k.target", "k.bgn", "k.end")


def joins(links: DataFrame, least: int) -> DataFrame:
    """(a, a_end, b, b_end, weight): ends of two tigs that are each other's heaviest link, of `least` or more; a < b.

    links(a, a_end, b, b_end) are single links in one direction.  Of equal weights the least partner counts.
    """
    l = links.where("a <> b")
    both = l.select("a", "a_end", "b", "b_end").unionByName(l.select(F.col("b").alias("a"), F.col("b_end").alias("a_end"), F.col("a").alias("b"), F.col("a_end").alias("b_end")))
    w = both.groupBy("a", "a_end", "b", "b_end").agg(F.count(F.lit(1)).alias("weight")).where(F.col("weight") >= least)
    best = w.groupBy("a", "a_end").agg(F.min(F.struct(-F.col("weight"), "b", "b_end", "weight")).alias("k")).select("a", "a_end", "k.b", "k.b_end", "k.weight")
    back = best.select(F.col("a").alias("b"), F.col("a_end").alias("b_end"), F.col("b").alias("a"), F.col("b_end").alias("a_end"))
    return best.join(back, ["a", "a_end", "b", "b_end"], "left_semi").where("a < b")


def both_ways(spans: DataFrame, least: int) -> DataFrame:
    """(a_iid, n, bgn, end): the stretch of a read that `least` partners or more match in both orientations, where it may have been read twice.

    spans(a_iid, b_iid, fwd, a_beg, a_end); a partner's stretch is what its longest match of each
    orientation shares, and the read's one is what all partners share (null if nothing).
    """
    long_ = lambda way: F.max(F.when(F.col("fwd") == way, F.struct(F.col("a_end") - F.col("a_beg"), "a_beg", "a_end")))
    g = spans.groupBy("a_iid", "b_iid").agg(long_(True).alias("f"), long_(False).alias("r")).where("f is not null and r is not null")
    s = g.select("a_iid", F.greatest("f.a_beg", "r.a_beg").alias("x"), F.least("f.a_end", "r.a_end").alias("y")).where("x < y")
    t = s.groupBy("a_iid").agg(F.count(F.lit(1)).alias("n"), F.max("x").alias("x"), F.min("y").alias("y")).where(F.col("n") >= least)
    return t.select("a_iid", "n", F.when(F.col("x") < F.col("y"), F.col("x")).alias("bgn"), F.when(F.col("x") < F.col("y"), F.col("y")).alias("end"))


def windows(seqs: DataFrame, k: int) -> DataFrame:
    """(id, pos, window): every window of k letters of seqs(id, seq), cut in blocks; shorter and null ones have none."""
    s = seqs.where(F.length("seq") >= k).select("id", "seq", F.explode(F.sequence(F.lit(0), F.floor((F.length("seq") - k) / BLOCK).cast("int"))).alias("b"))
    s = s.select("id", "b", F.substring("seq", F.col("b") * BLOCK + 1, F.lit(BLOCK + k - 1)).alias("run"))
    s = s.select("id", "b", "run", F.explode(F.sequence(F.lit(1), F.length("run") - (k - 1))).alias("i"))
    return s.select("id", (F.col("b").cast("long") * BLOCK + F.col("i") - 1).alias("pos"), F.substring("run", F.col("i"), F.lit(k)).alias("window"))


def trusted_stretch(seqs: DataFrame, k: int, least: int) -> DataFrame:
    """(id, bgn, end): the longest stretch of each sequence whose k-mers all occur `least` times or more, of equals the first.

    K-mers of at most MOST_CODED letters are counted in tables of 4**k cells, a table for each task, in which counts end
    at `least`; the flags of trusted ones are sent to all tasks (512 KB at k = 11), so no row is made for a window.
    Sequences with other letters than ACGT, rows that repeat an id and longer k-mers go by rows of windows.
    """
    if k > ws.MOST_CODED:
        w = windows(seqs, k)
        good = w.groupBy("window").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("window")
        return _longest(w.join(good, "window", "left_semi"), k)
    spark, kind = seqs.sparkSession, seqs.schema["id"].dataType.simpleString()
    flags = spark.sparkContext.broadcast(np.packbits(_trusted(seqs, k, least), bitorder="little"))

    def known(code):
        return (flags.value[code >> 3] >> (code & 7).astype(np.uint8)) & 1 == 1

    def run(batches):
        for batch in batches:
            buf, off = ws.letters(batch.column("seq"))
            n = batch.num_rows
            most, bgn = np.zeros(n, np.int64), np.zeros(n, np.int64)
            odd = np.zeros(n, bool)
            odd[ws.rows_of(np.flatnonzero(~np.isin(buf, list(b"ACGT"))), off, 1)[0]] = True
            left = np.zeros(0, np.int64)  # begin and end of a stretch that may go on
            for lo, hi in ws.stretches(len(buf), k):
                code, ok = ws.codes(buf, off, lo, hi, k)
                edge = np.flatnonzero(np.diff(np.concatenate([[0], (ok & known(code)).view(np.int8), [0]]))) + lo
                edge = np.concatenate([left[:-1], edge[1:]]) if len(left) and len(edge) and left[-1] == edge[0] else np.concatenate([left, edge])
                left = edge[-2:] if len(edge) and edge[-1] == hi and hi + k <= len(buf) else edge[:0]
                edge = edge[: len(edge) - len(left)]
                x, size = edge[::2], edge[1::2] - edge[::2]
                row = np.searchsorted(off, x, "right") - 1
                order = np.lexsort((x, -size, row))
                order = order[np.flatnonzero(np.append(True, row[order][1:] != row[order][:-1]))] if len(order) else order
                r = row[order]
                more = size[order] > most[r]
                most[r[more]], bgn[r[more]] = size[order][more], (x - off[row])[order][more]
            keep = (most > 0) | odd
            ids = batch.column("id").filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([ids, pa.array(bgn[keep]), pa.array((bgn + most)[keep] + k - 1), pa.array(odd[keep])], ["id", "bgn", "end", "odd"])

    each = settled(seqs.select("id", "seq").mapInArrow(run, f"id {kind}, bgn long, end long, odd boolean"), "trusted")
    g = each.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max("odd").alias("odd"), F.max("bgn").alias("bgn"), F.max("end").alias("end"))
    out = g.where("n = 1 and not odd").select("id", "bgn", "end")
    rest = g.where("n > 1 or odd").select(F.col("id").alias("__id"))
    if rest.isEmpty():
        return out

    def marked(batches):
        for b in batches:
            buf, off = ws.letters(b.column("window"))
            code, ok = ws.codes(buf, off, 0, max(len(buf) - k + 1, 0), k)
            at = off[:-1]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ok[at] & known(code[at])), pa.array(~ok[at])], [*b.schema.names, "good", "other"])

    w = windows(seqs.join(rest, F.col("id").eqNullSafe(F.col("__id")), "left_semi"), k).mapInArrow(marked, f"id {kind}, pos long, window string, good boolean, other boolean")
    other = w.where("other").groupBy("window").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("window")
    w = w.where("good").select("window", "id", "pos").unionByName(w.where("other").select("window", "id", "pos").join(other, "window", "left_semi"))
    return out.unionByName(_longest(w, k))


def _trusted(seqs: DataFrame, k: int, least: int) -> np.ndarray:
    """A flag for each code of k letters of ACGT: whether it occurs `least` times or more in seqs."""
    cells = 4**k
    kind = np.uint8 if least <= 127 else np.int64

    def count(batches):
        table, held = np.zeros(cells, kind), [np.zeros(0, np.int32)]

        def put():
            np.minimum(table + np.minimum(np.bincount(np.concatenate(held), minlength=cells), least).astype(kind), least, out=table)
            held.clear()

        for batch in batches:
            buf, off = ws.letters(batch.column("seq"))
            for lo, hi in ws.stretches(len(buf), k):
                code, ok = ws.codes(buf, off, lo, hi, k)
                held.append(code[ok])
                if len(held) >= 4:  # a table takes as long as some stretches
                    put()
        if held:
            put()
        yield from ws.packed(table)

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, n in zip(batch.column("part").to_pylist(), batch.column("n").to_pylist()):
                own = np.frombuffer(n, kind)
                total[p] = np.minimum(total[p] + own, least).astype(kind) if p in total else own
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([np.packbits(n >= least, bitorder="little").tobytes() for n in total.values()], pa.binary())], ["part", "bits"])

    parts = seqs.select("seq").mapInArrow(count, "part int, n binary").repartition("part").mapInArrow(add, "part int, bits binary")
    return ws.bits(parts.collect(), cells) | (least <= 0)


def _longest(trusted: DataFrame, k: int) -> DataFrame:
    """(id, bgn, end): the longest run of places of trusted(id, pos), of equals the first."""
    order = Window.partitionBy("id").orderBy("pos")
    g = trusted.select("id", "pos", (F.col("pos") - F.row_number().over(order)).alias("g"))
    s = g.groupBy("id", "g").agg(F.min("pos").alias("bgn"), (F.max("pos") + k).alias("end"))
    best = s.groupBy("id").agg(F.max(F.struct(F.col("end") - F.col("bgn"), -F.col("bgn"), "bgn", "end")).alias("m"))
    return best.select("id", "m.bgn", "m.end")


def linkers(seqs: DataFrame, linker: str, most: int) -> DataFrame:
    """(id, pos, errors, before, after): where each sequence holds the linker with at most `most` other letters.

    The fewest errors, then the first place; before and after are the letters on both sides, which become mates.
    A map over the sequences gives the best place of each row; rows that repeat an id share the best of all of them.
    """
    k, kind = len(linker), seqs.schema["id"].dataType.simpleString()
    want = [ord(c) for c in linker]

    def run(batches):
        for batch in batches:
            buf, off = ws.letters(batch.column("seq"))
            best = np.full(batch.num_rows, -1, np.int64)
            for lo, hi in ws.stretches(len(buf), k):
                wrong = np.zeros(hi - lo, np.uint16)
                for i, c in enumerate(want):
                    wrong += buf[lo + i : hi + i] != c
                at = np.flatnonzero(wrong <= most)
                row, whole = ws.rows_of(at + lo, off, k)
                at, row = at[whole], row[whole]
                if len(at):
                    first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                    least = np.minimum.reduceat((wrong[at].astype(np.int64) << 40) | (at + lo - off[row]), first)
                    own = best[row[first]]
                    best[row[first]] = np.where((own >= 0) & (own < least), own, least)
            none = pa.array(best < 0)
            far = pa.compute.if_else(none, pa.scalar(None, pa.int64()), pa.array(best))
            size = pa.compute.if_else(batch.column("seq").is_null(), pa.scalar(None, pa.int32()), pa.array(np.diff(off).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), size, far], ["id", "len", "best"])

    each = seqs.select("id", "seq").mapInArrow(run, f"id {kind}, len int, best long").where("id is not null")
    b = each.withColumn("best", F.min("best").over(Window.partitionBy("id"))).where("best is not null")
    b = b.select("id", "len", F.col("best").bitwiseAND((1 << 40) - 1).alias("pos"), F.shiftright("best", 40).cast("int").alias("errors"))
    return b.select("id", "pos", "errors", F.col("pos").alias("before"), (F.col("len") - F.col("pos") - k).alias("after"))


def draw(number: Column, salt: int) -> Column:
    """A number from 0 to MODULUS - 1 that depends on `number` and salt alone, so lost tasks give the same ones again."""
    x = F.pmod(F.pmod(number, F.lit(MODULUS)) * MULTIPLIER + salt * 16807, F.lit(MODULUS))
    for _ in range(2):
        x = F.pmod(x * MULTIPLIER + 1, F.lit(MODULUS))
    return x


def simulated(refs: DataFrame, length: int, coverage: float, rate: int, kind: str = "single", insert: int = 0, spread: int = 1, seed: int = 1) -> DataFrame:
    """(id, read, side, pos, insert, seq): simulated reads of refs(id, seq), of ACGT, with known origin.

    Reads of `length` letters to `coverage` in all; kind "single", "paired" (both
    face each other, `insert` letters apart and up to `spread` - 1 more) or "mates" (both face outwards).  `rate`
    of 10,000 letters are replaced by the one that follows in ACGT.  References shorter than the
    insert give no read.  Every number is drawn from id, read and seed.
    """
    pair = kind != "single"
    most = insert + spread - 1 if pair else length
    n = F.ceil(F.length("seq") * float(coverage) / (length * (2 if pair else 1))).cast("int")
    r = refs.where(F.length("seq") >= most).select("id", "seq", F.explode(F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).alias("read"))
    number = F.col("id").cast("long") * 65537 + F.col("read")
    size = (F.lit(insert) + draw(number, seed) % spread if pair else F.lit(length)).cast("long")
    r = r.select("id", "read", "seq", number.alias("number"), size.alias("insert"))
    r = r.withColumn("pos", draw(F.col("number"), seed + 1) % (F.length("seq") - F.col("insert") + 1))
    whole = r.select("id", "read", "number", "pos", "insert", F.expr("substring(seq, cast(pos + 1 as int), cast(insert as int))").alias("whole"))
    left = F.substring("whole", 1, length)
    if not pair:
        ends = F.array(F.struct(F.lit(1).alias("side"), left.alias("s")))
    else:
        right = F.expr(f"substring(whole, cast(insert - {length} + 1 as int), {length})")
        one, two = (left, reverse_complement(right)) if kind == "paired" else (reverse_complement(left), right)
        ends = F.array(F.struct(F.lit(1).alias("side"), one.alias("s")), F.struct(F.lit(2).alias("side"), two.alias("s")))
    e = whole.select("id", "read", "number", "pos", "insert", F.explode(ends).alias("e")).select("id", "read", "number", "pos", "insert", "e.side", "e.s")
    letter = lambda x, i: F.when(draw((F.col("number") * 2 + F.col("side")) * 1024 + i, seed + 2) % 10000 < rate, F.translate(x, "ACGT", "CGTA")).otherwise(x)
    return e.select("id", "read", "side", "pos", "insert", F.array_join(F.transform(F.split("s", ""), letter), "").alias("seq"))
