"""Every registered query of the library against its SQL, and operators on hand-made rows."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from braidwork.functions import sequence as sq
from braidwork.operators import intervals as iv
from braidwork.operators import records as rec
from braidwork.plans import assembly, catalog, finishing, scaffolding, storage  # noqa: F401  (the others add their queries to the catalog's)

SF = "/root/testdata/sf0.001"


def rows(cols, data):
    norm = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(norm(r[c]) for c in cols) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    want = con.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    df = catalog.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    cols = sorted(names)
    assert rows(cols, df.collect()) == rows(cols, [dict(zip(names, r)) for r in want.fetchall()])


def test_intervals(spark):
    d = spark.createDataFrame([("a", 0, 10), ("a", 5, 8), ("a", 10, 12), ("b", 3, 3), (None, 0, 4), ("c", None, 4)], "key string, bgn long, end long")
    assert rows(["key", "bgn", "end", "depth"], iv.depth(d).collect()) == sorted([("a", 0, 5, 1), ("a", 5, 8, 2), ("a", 8, 12, 1)], key=str)
    assert {tuple(r) for r in iv.islands(d, 1).select("key", "bgn", "end", "n").collect()} == {("a", 0, 10, 2), ("a", 10, 12, 1)}
    assert {tuple(r) for r in iv.islands(d).select("key", "bgn", "end", "n").collect()} == {("a", 0, 12, 3)}
    assert iv.depth(d.limit(0)).count() == 0


def test_scalars(spark):
    r = spark.range(1).select(
        sq.reverse_complement(F.lit("AACGTNt")).alias("rc"), sq.homopolymer_compressed(F.lit("AAACCGT")).alias("hc"), sq.gc_count(F.lit("GgCAT")).alias("gc"),
        sq.erate_code(F.lit(0.05)).alias("e"), sq.erate_code(F.lit(0.9)).alias("top"), sq.gap_size(F.lit(3.7)).alias("gap"), sq.flip_orientation(F.lit("anti")).alias("o"),
    ).first()
    assert tuple(r) == ("aNACGTT", "ACGT", 3, 500, 4095, 20, "normal")


def test_edits_and_rules(spark):
    d = spark.createDataFrame([(1, "x", 5), (2, None, None)], "id long, f string, n int")
    e = spark.createDataFrame([(1, "f", "a", 1), (1, "f", "b", 2), (2, "n", "9", 1), (3, "f", "z", 1)], "id long, field string, value string, ord long")
    assert {tuple(r) for r in rec.apply_edits(d, e, "id", ["f", "n"]).collect()} == {(1, "b", 5), (2, None, 9)}
    checked = rec.validated(d, {"small": F.col("n") < 6, "none": F.col("f").isNull()})
    assert {tuple(r) for r in rec.catalogue(checked).collect()} == {("small", 1), ("none", 1)}
