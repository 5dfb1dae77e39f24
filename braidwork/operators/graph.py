"""Graphs of reads and tigs: best-edge paths, components, transitive edges, bounded search, mate edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import dropped, settled
from .overlaps import length_on_a, overlap_class


def dovetails(ov: DataFrame) -> DataFrame:
    """(a_iid, a_end, b_iid, b_end, olen, erate, grow) of symmetrised overlaps: the end that each read turns to the
    other, and by how many letters b reaches beyond a."""
    d = ov.withColumn("cls", overlap_class()).where("cls in ('dovetail5', 'dovetail3')")
    three = F.col("cls") == "dovetail3"
    return d.select(
        "a_iid", F.when(three, 1).otherwise(0).alias("a_end"), "b_iid", F.when(three == F.col("flipped"), 1).otherwise(0).alias("b_end"),
        length_on_a().alias("olen"), "erate", F.when(three, F.col("b_hang")).otherwise(-F.col("a_hang")).alias("grow"),
    )


def best_of_ends(d: DataFrame) -> DataFrame:
    """The best dovetail of each read end: longest, then least error, then least b_iid and b_end, then least grow."""
    key = F.struct("olen", (-F.col("erate")).alias("e"), (-F.col("b_iid")).alias("b"), (-F.col("b_end")).alias("t"), (-F.col("grow")).alias("g"))
    k = d.groupBy("a_iid", "a_end").agg(F.max(key).alias("k"))
    return k.select("a_iid", "a_end", (-F.col("k.b")).alias("b_iid"), (-F.col("k.t")).alias("b_end"), F.col("k.olen").alias("olen"), (-F.col("k.g")).alias("grow"))


def mutual(best: DataFrame) -> DataFrame:
    """Best edges whose other end has them as its best edge too."""
    back = best.select(F.col("b_iid").alias("a_iid"), F.col("b_end").alias("a_end"), F.col("a_iid").alias("b_iid"), F.col("a_end").alias("b_end"))
    return best.join(back, ["a_iid", "a_end", "b_iid", "b_end"], "left_semi")


def steps_of(best: DataFrame) -> DataFrame:
    """(node, to, length): a read left by an end (2 * iid + end) is followed by the next read, left by its other end."""
    return best.select((F.col("a_iid") * 2 + F.col("a_end")).alias("node"), (F.col("b_iid") * 2 + 1 - F.col("b_end")).alias("to"), F.col("grow").alias("length"))


def follow(steps: DataFrame) -> DataFrame:
    """(node, last, steps, length, cyclic) of steps(node, to, length), one step for each node.

    Pointer doubling: a path of n steps takes log2 n joins.  Nodes that run into
    a cycle never come to an end: their number is the same before and after a
    doubling, which ends the loop; last, steps and length are then null.
    """
    state = settled(steps.select("node", F.col("to").alias("last"), F.lit(1).cast("long").alias("steps"), F.col("length").cast("long").alias("length"), F.lit(True).alias("moved")), "paths")
    before = None
    while True:
        hop = state.select(F.col("node").alias("n"), F.col("last").alias("l"), F.col("steps").alias("s"), F.col("length").alias("g"))
        new = state.join(hop, F.col("last") == F.col("n"), "left").select(
            "node", F.coalesce("l", "last").alias("last"), (F.col("steps") + F.coalesce("s", F.lit(0))).alias("steps"), (F.col("length") + F.coalesce("g", F.lit(0))).alias("length"),
            F.col("n").isNotNull().alias("moved"),
        )
        new = settled(new, "paths")
        dropped(state)
        state = new
        moved = state.where("moved").count()
        if moved == 0 or moved == before:
            break
        before = moved
    on = ~F.col("moved")
    return state.select("node", F.when(on, F.col("last")).alias("last"), F.when(on, F.col("steps")).alias("steps"), F.when(on, F.col("length")).alias("length"), F.col("moved").alias("cyclic"))


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of links(a, b): component is the least node that can be reached.

    Alternating large-star and small-star steps on distinct edges.  Only minima
    are aggregated (combined before each shuffle), never lists of neighbours, so
    a hub of any degree stays spread; the joins are plain equi-joins that
    adaptive execution may split.  Each round is a table in the shared folder.
    Links with a null end are ignored; a node linked to itself alone is its own component.  No links: no rows.
    """

    def step(e: DataFrame, large: bool) -> DataFrame:
        if large:  # each node's larger neighbours go to its least neighbour
            both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
            low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
            return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = e.groupBy("a").agg(F.min("b").alias("m"))  # a > b: each node's smaller neighbours
        up = e.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return up.unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()

    first = settled(links.where("a is not null and b is not null").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    edges, seen = first.where("a <> b"), None
    for _ in range(max_rounds):
        nxt = settled(step(step(edges, True), False), "links")
        now = tuple(nxt.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        if seen is not None:
            dropped(edges)
        edges = nxt
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    out = edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
    alone = first.where("a = b").select(F.col("a").alias("node"), F.col("b").alias("component"))
    return out if alone.isEmpty() else out.unionByName(alone.join(out.select("node"), "node", "left_anti"))


def transitive(edges: DataFrame, slop: int, max_degree: int | None = None) -> DataFrame:
    """Edges(src, dst, length) that two others explain: src -> via -> dst, their lengths adding up to within slop.

    Only pairs that an edge joins directly are looked for, so a walk is dropped
    as soon as it is made; adaptive execution splits a hub's rows.  With
    max_degree, nodes of more outgoing edges are taken as repeats and not passed through.
    """
    through = edges
    if max_degree is not None:
        out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= max_degree).select(F.col("src").alias("via"))
        through = edges.join(out, F.col("src") == F.col("via"), "left_semi")
    second = through.select(F.col("src").alias("via"), F.col("dst").alias("z"), F.col("length").alias("l2"))
    first = edges.select(F.col("src").alias("x"), F.col("dst").alias("via"), F.col("length").alias("l1"))
    walks = first.join(second, "via").where("x <> via and via <> z").select("x", "z", (F.col("l1") + F.col("l2")).alias("sum"))
    same = (F.col("src") == F.col("x")) & (F.col("dst") == F.col("z")) & (F.abs(F.col("length") - F.col("sum")) <= slop)
    return edges.join(walks, same, "left_semi")


def reach(edges: DataFrame, pairs: DataFrame, hops: int, longest: int) -> DataFrame:
    """(src, dst, hops, length) of pairs(src, dst) that a path of at most `hops` edges and `longest` letters joins:
    the fewest hops, and of these the least length."""
    front = pairs.select("src", "dst", F.col("src").alias("node"), F.lit(0).cast("long").alias("length")).distinct()
    step = edges.select(F.col("src").alias("node"), F.col("dst").alias("to"), F.col("length").alias("l"))
    found = None
    for n in range(1, hops + 1):
        front = front.join(step, "node").where(F.col("length") + F.col("l") <= longest).groupBy("src", "dst", F.col("to").alias("node")).agg(F.min(F.col("length") + F.col("l")).alias("length"))
        front = settled(front, "front")
        hit = front.where("node = dst").select("src", "dst", F.lit(n).cast("long").alias("hops"), "length")
        found = hit if found is None else found.unionByName(hit)
        front = front.where("node <> dst")
    best = found.groupBy("src", "dst").agg(F.min(F.struct("hops", "length")).alias("k"))
    return best.select("src", "dst", "k.hops", "k.length")


def end_classes(ov: DataFrame) -> DataFrame:
    """(iid, class): solo, hanging or thru reads, by dovetails at no, one or both ends; contained ones apart."""
    cls = overlap_class()
    g = ov.groupBy(F.col("a_iid").alias("iid")).agg(*(F.bool_or(cls == c).alias(c) for c in ("dovetail5", "dovetail3", "contained")))
    return g.select("iid", F.when(F.col("contained"), "contained").when(F.col("dovetail5") & F.col("dovetail3"), "thru").when(F.col("dovetail5") | F.col("dovetail3"), "hanging").otherwise("solo").alias("class"))


def mate_edges(reads: DataFrame, mates: DataFrame, mean: float, stddev: float) -> DataFrame:
    """(id_a, id_b, orient, mean, variance): a distance between two tigs for each pair of mates in different ones.

    reads(iid, tig, tig_len, bgn, end, reverse), mates(iid, mate).  An offset is the
    distance from a read's begin to the tig end that it faces; the gap is the
    library's mean less both offsets.  The lower tig id comes first.
    """
    off = F.when(F.col("reverse"), F.col("end")).otherwise(F.col("tig_len") - F.col("bgn"))
    r = reads.select("iid", "tig", off.alias("off"), F.when(F.col("reverse"), "B").otherwise("A").alias("way"))
    a = r.select("iid", F.col("tig").alias("ta"), F.col("off").alias("oa"), F.col("way").alias("wa"))
    b = r.select(F.col("iid").alias("mate"), F.col("tig").alias("tb"), F.col("off").alias("ob"), F.col("way").alias("wb"))
    j = mates.select("iid", "mate").join(a, "iid").join(b, "mate").where("ta <> tb")
    low = F.col("ta") < F.col("tb")
    return j.select(
        F.least("ta", "tb").alias("id_a"), F.greatest("ta", "tb").alias("id_b"), F.when(low, F.concat("wa", "wb")).otherwise(F.concat("wb", "wa")).alias("orient"),
        (F.lit(float(mean)) - F.col("oa") - F.col("ob")).alias("mean"), F.lit(float(stddev) ** 2).alias("variance"),
    )


#: The chi-square below which two distances agree, and the least variance counted.
CHI_SQUARE, LEAST_VARIANCE = 23.637, 25.0


def agree(mean_a: Column, var_a: Column, mean_b: Column, var_b: Column, limit: float = CHI_SQUARE, floor: float = LEAST_VARIANCE) -> Column:
    """Whether the chi-square of two distances about their inverse-variance mean is below the limit; variances are at least `floor`, and none may be 0 or less."""
    va, vb = F.greatest(var_a, F.lit(floor)), F.greatest(var_b, F.lit(floor))
    return (var_a > 0) & (var_b > 0) & ((mean_a - mean_b) ** 2 / (va + vb) < limit)


def bundled(edges: DataFrame) -> DataFrame:
    """(id_a, id_b, orient, weight, mean, variance): edges that agree with the mid distance of their pair, combined by inverse variance.

    The mid distance is the lower median; an edge that disagrees with it is left to the raw edges.
    """
    key = ["id_a", "id_b", "orient"]
    mid = edges.groupBy(*key).agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY mean)").alias("mid"), F.avg("variance").alias("mv"))
    ok = edges.join(mid, key).where(agree(F.col("mean"), F.col("variance"), F.col("mid"), F.col("mv")))
    g = ok.groupBy(*key).agg(F.count(F.lit(1)).alias("weight"), F.sum(F.col("mean") / F.col("variance")).alias("x"), F.sum(1 / F.col("variance")).alias("w"))
    return g.select(*key, "weight", (F.col("x") / F.col("w")).alias("mean"), (1 / F.col("w")).alias("variance"))


def clustered(edges: DataFrame) -> DataFrame:
    """(id_a, id_b, orient, cluster, weight, mean, variance): all edges of a pair, cut into clusters along their distances.

    In the order of mean an edge that agrees with the one before it is in its
    cluster, so none is left out; clusters are combined by inverse variance and
    numbered from 1.  A pair's edges are few against all edges.
    """
    key = ["id_a", "id_b", "orient"]
    w = Window.partitionBy(*key).orderBy("mean", "variance")
    new = ~agree(F.col("mean"), F.col("variance"), F.lag("mean").over(w), F.lag("variance").over(w))
    c = edges.withColumn("new", F.when(F.coalesce(new, F.lit(True)), 1).otherwise(0)).withColumn("cluster", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = c.groupBy(*key, "cluster").agg(F.count(F.lit(1)).alias("weight"), F.sum(F.col("mean") / F.col("variance")).alias("x"), F.sum(1 / F.col("variance")).alias("w"))
    return g.select(*key, "cluster", "weight", (F.col("x") / F.col("w")).alias("mean"), (1 / F.col("w")).alias("variance"))


def lifted(edges: DataFrame, placed: DataFrame) -> DataFrame:
    """(scaffold_a, scaffold_b, weight): edges(id_a, id_b) between pieces of different scaffolds, by placed(piece, scaffold); the lower scaffold first."""
    a = placed.select(F.col("piece").alias("id_a"), F.col("scaffold").alias("sa"))
    b = placed.select(F.col("piece").alias("id_b"), F.col("scaffold").alias("sb"))
    j = edges.join(a, "id_a").join(b, "id_b").where("sa <> sb")
    return j.groupBy(F.least("sa", "sb").alias("scaffold_a"), F.greatest("sa", "sb").alias("scaffold_b")).agg(F.count(F.lit(1)).alias("weight"))


def simple(edges: DataFrame) -> DataFrame:
    """(a, b, n, length): both directions of edges(src, dst, length) as one, with how often it occurs and its least length; self edges are left out."""
    e = edges.where("src <> dst")
    return e.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("length").alias("length"))


def ranked(edges: DataFrame, most: int, by: str = "weight") -> DataFrame:
    """The `most` edges of greatest weight at each id_a, of equals those of least id_b, with their rank."""
    w = Window.partitionBy("id_a").orderBy(F.desc(by), "id_b")
    return edges.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def confirmed(edges: DataFrame, slop: int) -> DataFrame:
    """Edges(src, dst, length) with the number of two-edge paths whose length is within slop of theirs."""
    first = edges.select(F.col("src").alias("x"), F.col("dst").alias("via"), F.col("length").alias("l1"))
    second = edges.select(F.col("src").alias("via"), F.col("dst").alias("z"), F.col("length").alias("l2"))
    walks = first.join(second, "via").groupBy("x", "z", (F.col("l1") + F.col("l2")).alias("sum")).agg(F.count(F.lit(1)).alias("k"))
    same = (F.col("src") == F.col("x")) & (F.col("dst") == F.col("z")) & (F.abs(F.col("length") - F.col("sum")) <= slop)
    return edges.join(walks, same, "left").groupBy("src", "dst", "length").agg(F.coalesce(F.sum("k"), F.lit(0)).alias("paths"))


def essential_ends(edges: DataFrame) -> DataFrame:
    """Nodes of edges(src, dst) with just one neighbour, where a scaffold begins."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()
    return both.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("node")


def contained_order(best: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(iid, root, depth) of best(a_iid, container): the read that holds a contained read at last, and over how many containers.

    Pointer doubling; reads whose containers run in a circle have null root and depth.
    """
    state = settled(best.select(F.col("a_iid").alias("iid"), F.col("container").alias("root"), F.lit(1).cast("long").alias("depth"), F.lit(True).alias("open")), "containers")
    before = None
    for _ in range(max_rounds):
        hop = state.select(F.col("iid").alias("n"), F.col("root").alias("r"), F.col("depth").alias("d"))
        new = state.join(hop, F.col("root") == F.col("n"), "left").select(
            "iid", F.coalesce("r", "root").alias("root"), (F.col("depth") + F.coalesce("d", F.lit(0))).alias("depth"), F.col("n").isNotNull().alias("open")
        )
        new = settled(new, "containers")
        dropped(state)
        state = new
        left = state.where("open").count()
        if left == 0 or left == before:
            break
        before = left
    done = ~F.col("open")
    return state.select("iid", F.when(done, F.col("root")).alias("root"), F.when(done, F.col("depth")).alias("depth"))
