"""Labels and bounded labelled samples for the models trained here."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def remainder(id_col: str, modulus: int) -> F.Column:
    """crc32 of the id as text, modulo modulus; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


def held_out(id_col: str, modulus: int, rest: int) -> F.Column:
    return F.coalesce(remainder(id_col, modulus) == rest, F.lit(False))


def known_labels(labels: DataFrame, label_col: str, modulus: int, rest: int, *, id_col: str = "doc_id") -> DataFrame:
    """(__id, y): the greatest label of each labelled id that is not held out."""
    known = labels.where(F.col(label_col).isNotNull() & ~held_out(id_col, modulus, rest) & F.col(id_col).isNotNull())
    return known.groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).alias("y"))


def first_of_each(known: DataFrame, most: int) -> tuple[DataFrame, dict]:
    """(rows (__id, y), number of rows by label): of known(__id, y) at most `most` of each label, the first by a hash of their id.

    The hash is first cut so low that few more than `most` rows of a label are
    left; only those come to the driver, which ranks them.  No task gathers a
    label's rows, however many it has.
    """
    spark = known.sparkSession
    counts = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    h = F.xxhash64("__id")
    low = F.lit(False)
    for y, n in counts.items():
        share = min(1.0, (most + 8 * math.sqrt(most) + 50) / n)
        low = low | ((F.col("y") == F.lit(y)) & (h <= F.lit(int(-(2.0**63) + share * (2.0**64 - 2**11)))))
    by: dict = {y: [] for y in counts}
    for r in known.where(low).select("__id", "y", h.alias("h")).collect():
        by[r.y].append((r.h, r["__id"]))
    rows = [(i, y) for y, own in by.items() for _, i in sorted(own)[:most]]
    return spark.createDataFrame(rows, known.select("__id", "y").schema), counts


def sample(
    docs: DataFrame, labels: DataFrame, label_col: str, per_class: int, modulus: int, rest: int, *, id_col: str = "doc_id", text_col: str = "text", max_bytes: int | None = None,
) -> tuple[DataFrame, dict]:
    """(rows (text, y), number of labelled documents by label), without the held-out ids.

    At most per_class documents of each label, the first by a hash of their id,
    are used, and of these those of at most max_bytes; the counts cover all
    labels.  An id labelled more than once has its greatest label; null labels
    and null ids are left out; documents that share an id are all used; no
    labels: no rows.
    """
    known = known_labels(labels, label_col, modulus, rest, id_col=id_col)
    ids, counts = first_of_each(known, per_class)
    # ids is at most per_class rows for each label
    own = docs.select(F.col(id_col).alias("__own"), F.col(text_col).alias("text"))
    if max_bytes is not None:
        own = own.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= max_bytes)
    return own.join(F.broadcast(ids), F.col("__own") == F.col("__id")).select("text", "y"), counts
