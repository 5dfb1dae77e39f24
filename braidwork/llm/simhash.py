"""SimHash near-duplicates by deletion-variant signatures."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, hidden, shuffle_partitions, written
from .spans import tidied

SHINGLE_WORDS = 3
DISTANCE = 2
SEED = 42
BITS = 64
#: Fingerprints of one signature that a task compares in memory; larger buckets go by two-wildcard variants.
MAX_BUCKET = 4096


def shingle_hashes(text: str | None, words: int, digest) -> list[int]:
    w = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space cuts
    if not w:
        return []
    if len(w) <= words:
        return [digest(b" ".join(w), SEED)]
    if words == 3:
        return [digest(b"%b %b %b" % t, SEED) for t in zip(w, w[1:], w[2:])]
    if words == 5:
        return [digest(b"%b %b %b %b %b" % t, SEED) for t in zip(w, w[1:], w[2:], w[3:], w[4:])]
    return [digest(b" ".join(w[i : i + words]), SEED) for i in range(len(w) - words + 1)]


def _nibbles() -> np.ndarray:
    """Four 16-bit counters in a word for each value of four bits."""
    v = np.arange(16, dtype=np.uint64)
    out = np.zeros(16, np.uint64)
    for b in range(4):
        out |= ((v >> np.uint64(b)) & np.uint64(1)) << np.uint64(16 * b)
    return out


NIBBLE = _nibbles()


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For rows of counts[i] consecutive hashes: the bits set in over half of a row's hashes."""
    n = len(counts)
    total = np.zeros((n, BITS), np.int64)
    some = counts > 0
    if some.any():
        # stretches of at most 2**16 - 1 hashes, so that a 16-bit counter holds their sum
        first = np.cumsum(counts) - counts
        rows = np.flatnonzero(some)
        parts = -(-counts[rows] // 65535)
        of = np.repeat(rows, parts)
        begin = first[of] + 65535 * (np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts))
        for j in range(16):
            sums = np.add.reduceat(NIBBLE[((hashes >> np.uint64(4 * j)) & np.uint64(15)).astype(np.intp)], begin)
            for b in range(4):
                np.add.at(total[:, 4 * j + b], of, ((sums >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64))
    bits = 2 * total > counts[:, None]
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).reshape(n)


def text_fingerprints(texts: pa.Array, words: int) -> np.ndarray:
    from xxhash import xxh64_intdigest

    out = []
    for lo in range(0, len(texts), 256):
        hashes: list[int] = []
        counts = []
        for t in texts.slice(lo, 256).to_pylist():
            h = shingle_hashes(t, words, xxh64_intdigest)
            hashes += h
            counts.append(len(h))
        out.append(majority(np.array(hashes, np.uint64), np.array(counts, np.int64)))
    return np.concatenate(out or [np.empty(0, np.uint64)]).view(np.int64)


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, keep, fp long): the 64-bit SimHash of every text, a map over the documents."""
    cols = [id_col, *keep]
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in cols)

    def run(batches):
        for b in tidied(batches):
            texts = b.column("__text")
            for lo in range(0, b.num_rows, 256):
                fp = text_fingerprints(texts.slice(lo, 256), words)
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(lo, 256) for c in cols), pa.array(fp)], [*cols, "fp"])

    return docs.select(*cols, F.col(text_col).alias("__text")).mapInArrow(run, f"{kinds}, fp long")


def _star(fp: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that span the same components as all links of at most `distance` within fp."""
    n = len(fp)
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for i in range(n - 1):
        near = np.flatnonzero(np.bitwise_count(fp[i + 1 :] ^ fp[i]) <= distance)
        for j in (near + i + 1).tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((i, j))
    return out


def signatures(fps: DataFrame) -> DataFrame:
    """(sig long, fp long): for both 32-bit halves, the half with each one of its bits left out."""
    return (
        fps.select("fp", F.explode(F.array(F.lit(0), F.lit(1))).alias("s"))
        .withColumn("half", F.expr("shiftrightunsigned(fp, s * 32) & 4294967295L"))
        .withColumn("w", F.explode(F.sequence(F.lit(0), F.lit(31))))
        .select(F.expr("(half & (4294967295L ^ shiftleft(1L, w))) | shiftleft(CAST(w AS BIGINT), 32) | shiftleft(CAST(s AS BIGINT), 37)").alias("sig"), "fp")
    )


def link_fingerprints(fps: DataFrame, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """Links (a, b) among distinct fingerprints fps(fp long) that span the components of all links of at most two bits.

    Two fingerprints that differ in at most two bits have a half in which they
    differ in at most one, so they share a signature of that half in which this
    bit is left out.  Rows are dealt by signature and sorted; a task streams
    through the buckets and verifies the pairs of each by their distance,
    giving only a spanning set of links.  A bucket of more than max_bucket
    fingerprints is not compared pairwise: its members go on to _by_variants.
    """
    spark = fps.sparkSession

    def run(batches):
        held: list[np.ndarray] = []
        size, sig, big = 0, None, False
        links: list[tuple[int, int]] = []
        hot: list[np.ndarray] = []

        def close():
            nonlocal held, size
            if size > 1 and not big:
                fp = np.concatenate(held)
                for i, j in _star(fp.view(np.uint64), DISTANCE):
                    links.append((int(fp[i]), int(fp[j])))
            held, size = [], 0

        def out():
            a = [x for x, _ in links]
            b = [y for _, y in links]
            h = np.concatenate(hot).tolist() if hot else []
            links.clear()
            hot.clear()
            return pa.RecordBatch.from_arrays([pa.array(a + h, pa.int64()), pa.array(b + [None] * len(h), pa.int64())], ["a", "b"])

        for batch in tidied(batches):
            if not batch.num_rows:
                continue
            s, f = np.asarray(batch.column("sig")), np.asarray(batch.column("fp"))
            cut = np.append(np.flatnonzero(np.append(True, s[1:] != s[:-1])), len(s))
            # buckets of one row need no look, but for the first and last, which may go on in another batch
            lone = np.diff(cut) == 1
            for k, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())):
                if lone[k] and 0 < k < len(lone) - 1:
                    if size:
                        close()
                    sig, big = None, False
                    continue
                if s[a] != sig:
                    close()
                    sig, big = s[a], False
                part = f[a:b]
                if big:
                    hot.append(part)
                    continue
                held.append(part)
                size += b - a
                if size > max_bucket:
                    hot += held
                    held, size, big = [], 0, True
            if len(links) > 50_000 or sum(map(len, hot)) > 50_000:
                yield out()
        close()
        if links or hot:
            yield out()

    found = signatures(fps).repartition(shuffle_partitions(spark), "sig").sortWithinPartitions("sig", "fp").mapInArrow(run, "a long, b long")
    found = written(found.distinct(), "simhash-links")
    links = found.where("b is not null")
    hot = found.where("b is null").select(F.col("a").alias("fp"))
    if hot.isEmpty():
        return links
    return links.unionByName(_by_variants(hot))


def _by_variants(fps: DataFrame) -> DataFrame:
    """Links to the least fingerprint that shares a two-wildcard variant: exact, without pairs.

    Fingerprints differ in at most two bits just if they agree with some two
    bits left out.  Each of the 2016 variants of a fingerprint gives a link to
    the least one that has it too; minima are combined before the shuffle.
    """
    pairs = fps.sparkSession.range(BITS * BITS).select((F.col("id") % BITS).alias("i"), F.floor(F.col("id") / BITS).alias("j")).where("i < j")
    masks = [int(r.m) for r in pairs.select(F.expr("shiftleft(1L, CAST(i AS INT)) | shiftleft(1L, CAST(j AS INT))").alias("m"), (F.col("i") * BITS + F.col("j")).alias("k")).collect()]
    each = fps.select("fp", F.posexplode(F.array(*[F.lit(m) for m in masks])).alias("w", "m"))
    each = each.select("w", F.expr("fp & ~m").alias("rest"), "fp")
    least = each.groupBy("w", "rest").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").select("w", "rest", "b")
    return each.join(least, ["w", "rest"]).where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, max_bucket: int = MAX_BUCKET, similarity: float | None = None,
) -> DataFrame:
    """Every document with its fingerprint and the least id of its group of near-duplicates.

    With `similarity` (0.8) groups are those of texts whose sets of shingles
    have this Jaccard similarity or more, and fp is the key of the set.  Texts
    of linked fingerprints are then candidates, whose shingles are compared.
    Fingerprints of similar texts differ in up to eleven bits and more, which
    no deletion variants reach: setjoin's exact search adds the candidates
    between groups of fingerprints.

    Texts are lower-cased (A-Z), cut at ASCII white space and taken as shingles
    of `words` words, repeats included (fewer words: all of them as one); a bit
    of the fingerprint is set if it is set in over half of the shingles' XXH64
    hashes.  Fingerprints of at most two differing bits are linked and groups
    are the components of the links.  Links are sought among distinct
    fingerprints, so copies cost nothing more.

    Null, empty and blank texts have fingerprint zero and are linked like any
    other.  Each row has a result row, repeated rows too.  Rows of null id take
    their group from the others; a group without ids has component null.
    Empty table: no rows.  Other columns are not looked at.

    Returns id_col, fp long, fingerprint (16 hex digits), component_id.
    """
    if similarity is not None:
        from .setjoin import similar_documents

        if similarity != 0.8:
            raise ValueError("similarity: only 0.8 is built")
        return similar_documents(docs, id_col=id_col, text_col=text_col, words=words)
    own = written(fingerprints(docs.select(id_col, text_col), id_col=id_col, text_col=text_col, words=words), "simhash")
    least = own.groupBy("fp").agg(F.min(id_col).alias("least"))
    links = link_fingerprints(least.select("fp"), max_bucket)
    groups = connected_components(links)  # of fingerprints; its root is only a name of the group
    named = least.join(groups, F.col("fp") == F.col("node"))
    named = named.select("fp", "component", "least")
    best = named.groupBy("component").agg(F.min("least").alias("low"))
    linked = named.select("fp", "component").join(best, "component").select("fp", "low")
    # as a table, so that a fingerprint of many copies is a skewed join that adaptive execution splits
    of = written(least.join(linked, "fp", "left").select("fp", F.least("least", "low").alias("component_id")), "simhash-groups")
    return own.join(of, "fp").select(id_col, "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, **options) -> DataFrame:
    """docs, all columns, with one document of each group of near_duplicates: that of the least id.

    Of rows that repeat that id in a group one stays.  Rows of null id stay
    only if their group has no id, one of each group.
    """
    near = near_duplicates(docs, id_col=id_col, text_col=text_col, words=words, **options)
    near = written(near.where(F.col(id_col).eqNullSafe(F.col("component_id"))).groupBy(id_col, "fp").agg(F.count(F.lit(1)).alias("n")), "simhash-keep")
    repeats = not near.where("n > 1").isEmpty() or not near.where(F.col(id_col).isNull()).isEmpty()
    if not repeats:  # ids are unique among what stays
        one = near.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        repeats = not one.isEmpty()
    if not repeats and docs.select(id_col).groupBy(id_col).count().where("count > 1").isEmpty():
        # the kept ids grow with the input: the same shuffled join at every size
        return docs.join(near.select(F.col(id_col).alias("__id")).hint("merge"), F.col(id_col) == F.col("__id"), "left_semi")
    own, of = hidden(docs)
    mark = fingerprints
    if options.get("similarity") is not None:
        from .setjoin import sets as mark
    marked = mark(own, id_col=of(id_col), text_col=of(text_col), words=words, keep=tuple(c for c in own.columns if c != of(id_col)))
    best = near.groupBy("fp").agg(F.min(id_col).alias("id")).select(F.col("fp").alias("k"), "id")
    out = marked.join(best, (F.col("fp") == F.col("k")) & F.col(of(id_col)).eqNullSafe(F.col("id")), "left_semi")
    return out.dropDuplicates([of(id_col), "fp"]).select(*own.columns).toDF(*docs.columns)
