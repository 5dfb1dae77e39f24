"""Readers and writers of alignments by other programs, layouts and assembly tables."""

import pytest

from braidwork.sources import layouts as la


def test_coordinates(spark, tmp_path):
    (tmp_path / "c").write_text(
        "/a/ref.fa /b/reads.fa\nNUCMER\n\n    [S1]     [E1]  |     [S2]     [E2]  |  [LEN 1]  [LEN 2]  |  [% IDY]  | [TAGS]\n"
        "       1      500  |      10      509  |      500      500  |    99.20  | g1\tr1\n     600      900  |     301        1  |      301      301  |    97.00  | g1\tr2\n"
        "       1       50  |      1      50  |      50      50  |    80.00  | g1\tr3\n     7      7  |     3        9  |      1      7  |    97.00  | g1\tr4\n 5 6\n"
    )
    got = {(r.read, r.r_bgn, r.r_end, r.reverse, r.genome, r.g_bgn, r.g_end, r.identity) for r in la.coordinates(spark, str(tmp_path / "c"), 90.0).where("error is null").collect()}
    assert got == {("r1", 10, 509, False, "g1", 1, 500, 99.2), ("r2", 1, 301, True, "g1", 600, 900, 97.0)}
    assert sorted(r.error for r in la.coordinates(spark, str(tmp_path / "c")).where("error is not null").collect()) == ["empty_range", "too_short"]


def test_tigs_round_trip(spark, tmp_path):
    rows = [(k, 100 + k, "ACGT" * (k % 3), "1111" * (k % 3), {"unitig_status": "X", "unitig_coverage_stat": "1.5"}, [("R", 10 * k + i, 0, 0, 0, -i, i, 50 + i) for i in range(k % 4)]) for k in range(200)]
    d = spark.createDataFrame(rows, f"id long, length long, cns string, qlt string, data map<string,string>, reads array<{la.READ}>")
    la.write_tigs(d.repartition(3), str(tmp_path / "t"), "contig")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        back = la.tigs(spark, str(tmp_path / "t"), "contig")
        assert back.rdd.getNumPartitions() > 3
        assert sorted(str(r.asDict(True)) for r in back.select("id", "length", "cns", "qlt", "reads").collect()) == sorted(str(r.asDict(True)) for r in d.drop("data").collect())
        assert all(r.data == {"unitig_status": "X", "unitig_coverage_stat": "1.5"} for r in back.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_viewer_round_trip(spark, tmp_path):
    lines = spark.createDataFrame([("1Utg", 5, 90, "0Color", 10, "one"), ("2Utg", -3, 40, "0Color", 11, None)], "name string, bgn long, end long, style string, row int, comment string")
    la.write_viewer(lines, str(tmp_path / "v"), {"0Color": "C00FF00 T2 S # Unitigs"})
    got = {(r.kind, r.name, r.bgn, r.end, r.row, tuple(r.styles or ()), r.color, r.thick, r.comment) for r in la.viewer(spark, str(tmp_path / "v")).collect()}
    assert got == {
        ("style", "0Color", None, None, None, (), "00FF00", 2, "Unitigs"), ("line", "1Utg", 5, 90, 10, ("0Color",), None, None, "one"), ("line", "2Utg", -3, 40, 11, ("0Color",), None, None, ""),
    }
    (tmp_path / "w").write_text("LNK: 1Utg 2Utg A0Color # far\nOVL: 1Utg 2Utg\nATT: 0Color\n3Utg: 1 A0Color 4 A1Color 9\n\n# only a comment\n")
    got = {(r.kind, r.name, tuple(r.words), r.bgn, r.end) for r in la.viewer(spark, str(tmp_path / "w")).collect()}
    assert got == {
        ("link", "LNK", ("1Utg", "2Utg", "A0Color"), None, None), ("overlap", "OVL", ("1Utg", "2Utg"), None, None), ("attribute", "ATT", ("0Color",), None, None),
        ("line", "3Utg", ("1", "A0Color", "4", "A1Color", "9"), 1, 9),
    }


def test_database(spark, tmp_path):
    utg = spark.createDataFrame([(1, "a'b", 0.5), (2, None, None)], "id long, acc string, cov double")
    mps = spark.createDataFrame([(1, 7), (1, 8), (2, 9)], "utg long, afg long")
    kinds = {"utg": "id long, acc string, cov double", "mps": "utg long, afg long"}
    for how in ("parquet", "delimited"):
        la.write_database({"utg": utg, "mps": mps}, str(tmp_path / how), how)
        assert la.database(spark, str(tmp_path / how), kinds, how)["utg"].count() == 2
        assert sorted(tuple(r) for r in spark.sql("SELECT acc, afg FROM utg JOIN mps ON utg.id = mps.utg WHERE acc IS NOT NULL").collect()) == [("a'b", 7), ("a'b", 8)]
    la.write_database({"utg": utg}, str(tmp_path / "insert"), "insert")
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "insert" / "utg")).collect()) == [
        "INSERT INTO utg (id, acc, cov) VALUES (1, 'a''b', 0.5);", "INSERT INTO utg (id, acc, cov) VALUES (2, NULL, NULL);",
    ]
    with pytest.raises(ValueError):
        la.write_database({}, str(tmp_path), "none")


def test_quality_fasta(spark, tmp_path):
    la.quality_fasta(spark.createDataFrame([("r", "0:l"), ("e", None)], "name string, qlt string"), str(tmp_path / "q"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "q")).collect()) == sorted([">r", "00 10 60", ">e", ""])
