"""Near-duplicates of Jaccard similarity 4/5 or more: candidates by SimHash, those it misses by an exact join of shingle sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, freed, shuffle_partitions, written
from .simhash import drop_near_duplicates, link_fingerprints, text_fingerprints
from .spans import LOWER, NOT_SPACE, mix, pieces, span_hashes, text_buffer, tidied, whole_windows, window_hashes, word_spans

SHINGLE_WORDS = 5
STEP_BYTES = 1 << 20
#: Parts that so many sampled texts share come last in every text's order, of these at most MOST_HOT.
HOT_IN_SAMPLE, MOST_HOT = 10, 100_000
#: Rows of one signature that are held to name it by its sets.
MOST_HELD = 50_000
#: Bits of a parity map are about the shingles of its size class, up to this.
MOST_BITS = 4096
U64 = np.uint64
NONE = np.empty(0, U64)


class Sets:
    """The distinct shingle hashes of some texts, sorted, laid end to end; `bounds` cuts them by text."""

    def __init__(self, h: np.ndarray, row: np.ndarray, n: int):
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        self.h, self.row = h[fresh], row[fresh]
        self.bounds = np.searchsorted(self.row, np.arange(n + 1))
        self.sizes = np.diff(self.bounds)

    def __getitem__(self, i: int) -> np.ndarray:
        return self.h[self.bounds[i] : self.bounds[i + 1]]


def shingle_sets(column: pa.Array, words: int):
    """For a stretch of texts: their sets, in pieces."""
    buf, offsets = text_buffer(column)
    for lo, hi in pieces(offsets, STEP_BYTES):
        own = LOWER[buf[offsets[lo] : offsets[hi]]]
        starts, ends, first = word_spans(own, offsets[lo : hi + 1] - offsets[lo], NOT_SPACE)
        word, n = span_hashes(own, starts, ends), hi - lo
        at = whole_windows(first, words)
        h, row = [window_hashes(word, words)[at]], [np.searchsorted(first, at, "right") - 1]
        counts = np.diff(first)
        for m in range(1, words):  # fewer words: all of them as one
            few = np.flatnonzero(counts == m)
            if len(few):
                h.append(window_hashes(word, m)[first[few]])
                row.append(few)
        yield Sets(np.concatenate(h), np.concatenate(row), n)


def set_key(h: np.ndarray, digest) -> int:
    """A signed 64-bit hash of the set."""
    return int(np.array(digest(h.tobytes(), 7), U64).view(np.int64))


def size_classes(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sets of n > 0: the class c of those of 2**c to 2**(c+1) - 1, and whether a partner may be in the next."""
    c = np.frexp(n.astype(np.float64))[1].astype(np.int64) - 1
    return c, 5 * n >= 8 * (1 << c)


def signatures(sets: Sets, rows: np.ndarray, c: np.ndarray, hot: np.ndarray, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, how many for each of `rows`): contents of the first n // 4 + 1 non-empty parts of the hash range, cut for class c.

    Sets of n and m shingles with a Jaccard similarity of 4/5 or more differ
    in at most (n + m) / 9 <= min(n, m) / 4 shingles, hence in at most as many
    parts.  All sets take their parts in one order: those with contents in
    `hot` last, else along the hash range.  Of the two stretches of parts from
    the first one the shorter holds more parts than that, so one of them is
    equal in both sets, and both have its signature.  Contents that very many
    texts share, such as common passages, are thus used only by texts made of
    little else; any choice of `hot` gives the same links.  A set of too few
    non-empty parts gives all of them and one signature more, which all such
    sets share: of a pair in which only one is such a set, the other's stretch
    has the part.  whole: every part.
    """
    size = sets.sizes[rows]
    at = np.repeat(sets.bounds[rows] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    h, of = sets.h[at], np.repeat(np.arange(len(rows)), size)
    parts = np.maximum(16, -(-(2 << c) // 3)).astype(U64)
    part = ((h >> U64(32)) * parts[of]) >> U64(32)  # rises with h
    start = np.flatnonzero(np.append(True, (part[1:] != part[:-1]) | (of[1:] != of[:-1]))) if len(h) else np.empty(0, np.int64)
    sums = np.add.reduceat(h * U64(0x9E3779B97F4A7C15), start) if len(h) else h
    row = of[start]
    sig = mix(mix(sums) + part[start] * U64(64) + c[row].astype(U64))
    if whole:
        return sig, np.bincount(row, minlength=len(rows))
    last = np.zeros(len(sig), bool)
    if len(hot):
        k = np.searchsorted(hot, sig)
        last = hot[np.minimum(k, len(hot) - 1)] == sig
    order = np.lexsort((np.arange(len(sig)), last, row))
    sig, row = sig[order], row[order]
    first = np.searchsorted(row, np.arange(len(rows) + 1))
    rank = np.arange(len(sig)) - first[row]
    need = size // 4 + 1
    keep = rank < need[row]
    poor = np.flatnonzero(np.diff(first) < need)
    out, owner = np.append(sig[keep], mix(c[poor].astype(U64) + U64(1))), np.append(row[keep], poor)
    order = np.argsort(owner, kind="stable")
    return out[order], np.bincount(owner, minlength=len(rows))


def parity_maps(sets: Sets, rows: np.ndarray, c: np.ndarray) -> list[np.ndarray]:
    """For each set words whose bits say if an odd number of hashes falls on each: two sets differ in at least as many shingles as their maps in bits."""
    bits = np.minimum(MOST_BITS, -(-(2 << c) // 64) * 64)
    base = np.cumsum(bits) - bits
    size = sets.sizes[rows]
    at = np.repeat(sets.bounds[rows] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    of = np.repeat(np.arange(len(rows)), size)
    odd = np.bincount(base[of] + (sets.h[at] % bits[of].astype(U64)).astype(np.int64), minlength=int(bits.sum())) & 1
    return np.split(np.packbits(odd.astype(bool), bitorder="little").view(U64), (np.cumsum(bits) // 64)[:-1])


def spanning(n: np.ndarray, maps: np.ndarray, check=None, group: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that span the components of all links between sets of sizes n that maps do not exclude and `check` confirms.

    Sets of equal `group` are taken as linked.
    """
    k = len(n)
    label = np.arange(k) if group is None else np.unique(group, return_inverse=True)[1]
    out: list[tuple[int, int]] = []
    for i in range(k - 1):
        rest = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        if not len(rest):
            if (label == label[i]).all():
                break
            continue
        m = n[rest]
        rest = rest[(5 * np.minimum(m, n[i]) >= 4 * np.maximum(m, n[i]))]
        if not len(rest):
            continue
        far = np.bitwise_count(maps[rest] ^ maps[i]).sum(axis=1, dtype=np.int64)
        for j in rest[9 * far <= n[rest] + n[i]].tolist():
            if label[i] != label[j] and (check is None or check(i, j)):
                label[label == label[j]] = label[i]
                out.append((i, j))
    return out


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 9 * both >= 4 * (len(a) + len(b))


def _groups(batches, key: str):
    """The rows of each run of equal `key`, as one table, of batches sorted by it; rows of one batch are cut without copies."""
    held: list[pa.RecordBatch] = []
    for b in tidied(batches):
        if not b.num_rows:
            continue
        k = np.asarray(b.column(key))
        cut = np.append(np.flatnonzero(np.append(True, k[1:] != k[:-1])), len(k)).tolist()
        if held and held[0].column(key)[0].as_py() != k[0]:
            yield pa.Table.from_batches(held)
            held = []
        for lo, hi in zip(cut[:-1], cut[1:]):
            if held and lo:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _links(pairs) -> pa.RecordBatch:
    a, b = zip(*pairs) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def sets(docs: DataFrame, id_col: str, text_col: str, words: int, keep: tuple[str, ...] = (), *, marks: bool = False, hot: np.ndarray = NONE) -> DataFrame:
    """(id_col, keep, fp long): the key of every text's shingle set; with marks also its size, signatures by class, parity maps and the text's SimHash `print`."""
    cols = [id_col, *keep]
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in cols)

    def run(batches):
        from xxhash import xxh64_intdigest

        for b in tidied(batches):
            lo, texts = 0, b.column("__text")
            for own in shingle_sets(texts, words):
                n = len(own.sizes)
                arrays = [pa.array([set_key(own[i], xxh64_intdigest) for i in range(n)], pa.int64())]
                if marks:
                    some = np.flatnonzero(own.sizes)
                    c, two = size_classes(own.sizes[some])
                    sigs, cls, maps, counts = ([[] for _ in range(n)] for _ in range(4))
                    for rows, c in ((some, c), (some[two], c[two] + 1)):
                        sig, count = signatures(own, rows, c, hot)
                        bound = np.append(0, np.cumsum(count)).tolist()
                        for k, (i, name, m, number) in enumerate(zip(rows.tolist(), c.tolist(), parity_maps(own, rows, c), count.tolist())):
                            sigs[i].append(sig[bound[k] : bound[k + 1]].tobytes())
                            cls[i].append(name)
                            maps[i].append(m.tobytes())
                            counts[i].append(number)
                    arrays += [
                        pa.array(own.sizes, pa.int32()), pa.array([b"".join(x) for x in sigs], pa.binary()), pa.array(cls, pa.list_(pa.int32())),
                        pa.array(maps, pa.list_(pa.binary())), pa.array(counts, pa.list_(pa.int32())), pa.array(text_fingerprints(texts.slice(lo, n), words)),
                    ]
                names = ["fp", "n", "sigs", "cls", "maps", "counts", "print"]
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(lo, n) for c in cols), *arrays], [*cols, *names[: len(arrays)]])
                lo += n

    more = ", n int, sigs binary, cls array<int>, maps array<binary>, counts array<int>, print long" if marks else ""
    return docs.select(*cols, F.col(text_col).alias("__text")).mapInArrow(run, f"{kinds}, fp long{more}")


def common_parts(docs: DataFrame, id_col: str, text_col: str, words: int, n: int) -> np.ndarray:
    """Signatures of the parts that many texts share, by a sample of documents: at most MOST_HOT, sorted.

    They only set the order of parts (see `signatures`), not which pairs are found.
    """

    def run(batches):
        for b in tidied(batches):
            for own in shingle_sets(b.column("__text"), words):
                some = np.flatnonzero(own.sizes)
                c, two = size_classes(own.sizes[some])
                for rows, c in ((some, c), (some[two], c[two] + 1)):
                    yield pa.RecordBatch.from_arrays([pa.array(signatures(own, rows, c, NONE, whole=True)[0].view(np.int64))], ["sig"])

    share = max(1, min(256, n // 4_000))
    some = docs.where(F.pmod(F.xxhash64(id_col, F.lit(5)), F.lit(share)) == 0).select(F.col(text_col).alias("__text"))
    often = some.mapInArrow(run, "sig long").groupBy("sig").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= HOT_IN_SAMPLE)
    got = often.orderBy(F.desc("k"), "sig").limit(MOST_HOT).select("sig").toArrow()
    return np.sort(np.asarray(got.column("sig"), np.int64).view(U64))


def _candidates(own: DataFrame, named: DataFrame) -> DataFrame:
    """Links (a, b) of the groups of named(fp, print_group) that span the components of all pairs of sets which share a signature and are not excluded by size or parity map.

    Pairs within a group are not looked at.
    """
    spark = own.sparkSession
    one = own.groupBy("fp").agg(F.any_value("sigs").alias("sigs"), F.any_value("cls").alias("cls"), F.any_value("counts").alias("counts"))

    def spread(batches):
        for b in tidied(batches):
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                fps = np.asarray(part.column("fp"))
                s = np.frombuffer(b"".join(part.column("sigs").to_pylist()), np.int64)
                counts = part.column("counts").to_pylist()
                c = np.concatenate([np.repeat(np.array(k, np.int32), np.array(m, np.int64)) for k, m in zip(part.column("cls").to_pylist(), counts)] or [np.empty(0, np.int32)])
                yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(np.repeat(fps, [sum(m) for m in counts])), pa.array(c.astype(np.int8), pa.int8())], ["sig", "fp", "c"])

    def shared(batches):
        """Rows whose signature another set has too, named by a hash of all sets that have it: signatures of the same sets then meet as one.

        The sets of a signature that goes on beyond MOST_HELD rows are named by the signature.
        """

        def told(name, f, c):
            return pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(f), pa.array(c, pa.int8())], ["name", "fp", "c"])

        held = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int8))
        flows = None

        def close(s, f, c):
            cut = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
            size = np.diff(np.append(cut, len(s)))
            keep = np.repeat(size > 1, size)
            name = np.repeat(mix(np.add.reduceat(mix(f.view(U64)), cut)), size)
            return told(name[keep], f[keep], c[keep])

        for b in tidied(batches):
            s, f, c = (np.concatenate([x, np.asarray(b.column(k))]) for x, k in zip(held, ("sig", "fp", "c")))
            if flows is not None:
                on = int(np.searchsorted(s != flows, True))
                if on:
                    yield told(mix(s[:on].view(U64)), f[:on], c[:on])
                s, f, c = s[on:], f[on:], c[on:]
            if not len(s):
                held = (s, f, c)
                continue
            flows = None
            edge = len(s) - int(np.searchsorted(s[::-1] != s[-1], True))  # the last signature may go on
            if edge:
                yield close(s[:edge], f[:edge], c[:edge])
            held = (s[edge:], f[edge:], c[edge:])
            if len(held[0]) > MOST_HELD:
                yield told(mix(held[0].view(U64)), held[1], held[2])
                flows, held = held[0][0], tuple(x[:0] for x in held)
        if len(held[0]):
            yield close(*held)

    rows = one.mapInArrow(spread, "sig long, fp long, c tinyint")
    rows = rows.repartition(shuffle_partitions(spark), "sig").sortWithinPartitions("sig", "fp").mapInArrow(shared, "name long, fp long, c tinyint")
    rows = written(rows.distinct(), "sets-shared")
    maps = own.select("fp", "n", F.explode(F.arrays_zip("cls", "maps")).alias("m")).select("fp", F.col("m.cls").cast("tinyint").alias("c"), "n", F.col("m.maps").alias("map"))
    maps = maps.groupBy("fp", "c").agg(F.any_value("n").alias("n"), F.any_value("map").alias("map"))
    rows = rows.join(named.select("fp", "print_group").hint("merge"), "fp")
    full = rows.join(maps.hint("merge"), ["fp", "c"]).select("name", "fp", "c", "n", "map", "print_group")

    def compare(batches):
        links: list[tuple[int, int]] = []
        for t in _groups(batches, "name"):
            if t.num_rows > 1:
                cls = np.asarray(t.column("c"))
                for c in np.unique(cls).tolist():
                    part = t.filter(pa.array(cls == c)) if (cls != c).any() else t
                    maps = np.frombuffer(b"".join(part.column("map").to_pylist()), U64).reshape(part.num_rows, -1)
                    group = np.asarray(part.column("print_group"))
                    links += [(int(group[i]), int(group[j])) for i, j in spanning(np.asarray(part.column("n")).astype(np.int64), maps, group=group)]
            if len(links) > 50_000:
                yield _links(links)
                links = []
        if links:
            yield _links(links)

    return full.repartition(shuffle_partitions(spark), "name").sortWithinPartitions("name", "fp").mapInArrow(compare, "a long, b long").distinct()


def _print_groups(least: DataFrame) -> DataFrame:
    """least with print_group: a name of the group of linked fingerprints (at most two bits apart) that its `print` is in."""
    groups = connected_components(link_fingerprints(least.select(F.col("print").alias("fp")).distinct()))
    named = least.join(groups.hint("merge"), F.col("print") == F.col("node"), "left")
    return written(named.select("fp", "least", F.coalesce("component", "print").alias("print_group")), "sets-prints")


def similar_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """Every document with the key of its shingle set and the least id of its group of near-duplicates.

    Texts are lower-cased (A-Z), cut at ASCII white space and taken as sets of
    shingles of `words` words (fewer words: all of them as one).  Two texts
    are linked if the Jaccard similarity of their sets is 4/5 or more, and
    groups are the components of the links; no linked pair is missed (up to
    equal 64-bit hashes).  Candidates are texts whose SimHash fingerprints are
    linked, by simhash's deletion variants; between such groups, which many
    similar texts do not share, they are those that share a signature (see
    `signatures`).  The texts of each component of candidates come to one task,
    which counts the common shingles.  Equal sets are taken once, with the
    least of their fingerprints, so copies cost nothing more.

    Null, empty and blank texts are equal.  Each row has a result row,
    repeated rows too.  Rows of null id take their group from the others; a
    group without ids has component null.  Empty table: no rows.

    Returns id_col, fp long, component_id.
    """
    docs = docs.select(id_col, text_col)
    hot = common_parts(docs, id_col, text_col, words, docs.count())
    own = written(sets(docs, id_col, text_col, words, marks=True, hot=hot), "sets")
    least = _print_groups(written(own.groupBy("fp").agg(F.min(id_col).alias("least"), F.min("print").alias("print")), "sets-least"))
    freed(docs.sparkSession)  # here and below: a loop over many small tables is done
    groups = connected_components(_candidates(own, least))
    freed(docs.sparkSession)
    asked = least.join(groups, F.col("print_group") == F.col("node"), "left").select("fp", F.coalesce("component", "print_group").alias("component"), "least")
    several = asked.groupBy("component").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("component")
    asked = written(asked.join(several, "component").select("fp", "component", "least"), "sets-asked")
    asked_ids = asked.select(F.col("fp").alias("k"), "component", F.col("least").alias("__least"))
    # one plan at every size, as in drop_near_duplicates
    texts = docs.join(asked_ids.hint("merge"), F.col(id_col).eqNullSafe(F.col("__least"))).select("k", "component", F.col(text_col).alias("t"))

    def verify(batches):
        from xxhash import xxh64_intdigest

        links: list[tuple[int, int]] = []
        for t in _groups(batches, "component"):
            of: dict[int, np.ndarray] = {}
            keys = iter(t.column("k").to_pylist())
            for got in shingle_sets(t.column("t"), words):
                for i in range(len(got.sizes)):
                    k = next(keys)
                    if k not in of and set_key(got[i], xxh64_intdigest) == k:  # not another row of the id
                        of[k] = got[i].copy()
            keys, hs = list(of), list(of.values())
            if len(keys) > 1:
                n = np.array([len(h) for h in hs])
                all_ = Sets(np.concatenate(hs), np.repeat(np.arange(len(hs)), n), len(hs))
                c = np.full(len(hs), int(n.max()).bit_length() - 1)
                maps = np.stack(parity_maps(all_, np.arange(len(hs)), c))
                links += [(keys[i], keys[j]) for i, j in spanning(n, maps, lambda i, j: similar(hs[i], hs[j]))]
            if len(links) > 50_000:
                yield _links(links)
                links = []
        if links:
            yield _links(links)

    found = texts.repartition(shuffle_partitions(docs.sparkSession), "component").sortWithinPartitions("component").mapInArrow(verify, "a long, b long")
    true = connected_components(written(found, "sets-links"))
    freed(docs.sparkSession)
    named = least.join(true, F.col("fp") == F.col("node")).select("fp", "component", "least")
    best = named.groupBy("component").agg(F.min("least").alias("low"))
    linked = named.select("fp", "component").join(best, "component").select("fp", "low")
    of = written(least.join(linked, "fp", "left").select("fp", F.least("least", "low").alias("component_id")), "sets-groups")
    return own.select(id_col, "fp").join(of, "fp").select(id_col, "fp", "component_id")


def drop_similar_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """docs, all columns, with one document of each group of similar_documents, as drop_near_duplicates keeps it."""
    return drop_near_duplicates(docs, id_col=id_col, text_col=text_col, words=words, similarity=0.8)
