import gzip
import json
import zipfile

import pytest
from pyspark.errors import PySparkException

from genoloom.sources import gmt, tables

GMT = "S1\tfirst\tA\tB\tA\n\n# note\nS2\tsecond\tC\t \tD\nS1\tagain\tE\tB\n"


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.mark.parametrize("kind", ["plain", "gzip", "zip"])
def test_gmt_forms(spark, tmp_path, kind):
    path = tmp_path / {"plain": "a.gmt", "gzip": "a.gmt.gz", "zip": "a.zip"}[kind]
    if kind == "plain":
        path.write_text(GMT)
    elif kind == "gzip":
        path.write_bytes(gzip.compress(GMT.encode()))
    else:
        with zipfile.ZipFile(path, "w") as z:
            z.writestr("a.gmt", GMT)
    got = gmt.read_gmt(spark, str(path))
    assert rows(got, "set_name", "pos", "gene") == [("S1", 0, "A"), ("S1", 1, "B"), ("S1", 2, "E"), ("S2", 0, "C"), ("S2", 1, "D")]
    assert {r.description for r in got.where("set_name = 'S1'").collect()} == {"first"}
    assert rows(gmt.read_gmt_last_wins(spark, str(path)).where("set_name = 'S1'"), "gene") == [("B",), ("E",)]


def test_short_lines(spark, tmp_path):
    (tmp_path / "b.gmt").write_text("S1\tonly two\nS2\td\tA\n")
    with pytest.raises(PySparkException):
        gmt.read_gmt(spark, str(tmp_path / "b.gmt")).collect()
    assert rows(gmt.read_gmt(spark, str(tmp_path / "b.gmt"), strict=False), "set_name", "gene") == [("S2", "A")]


def test_round_trips(spark, tmp_path):
    m = spark.createDataFrame([("B", 0, "x", 0.5), ("B", 1, "y", 0.25), ("A", 0, "z", 1.0)], "set_name string, pos int, gene string, weight double")
    gmt.write_gmt(m, str(tmp_path / "g"))
    assert rows(gmt.read_gmt(spark, str(tmp_path / "g")), "set_name", "pos", "gene") == [("A", 0, "z"), ("B", 0, "x"), ("B", 1, "y")]
    gmt.write_gmx(m, str(tmp_path / "x"))
    assert rows(gmt.read_gmx(spark, str(tmp_path / "x")), "set_name", "pos", "gene") == [("A", 0, "z"), ("B", 0, "x"), ("B", 1, "y")]
    gmt.write_weighted_gmt(m, str(tmp_path / "w"))
    assert rows(gmt.read_weighted_gmt(spark, str(tmp_path / "w")), "set_name", "gene", "weight") == [("A", "z", 1.0), ("B", "x", 0.5), ("B", "y", 0.25)]
    with pytest.raises(ValueError):
        gmt.write_gmt(m.limit(0), str(tmp_path / "e"))


def test_weighted_entries_without_weight(spark, tmp_path):
    (tmp_path / "w.gmt").write_text("S\td\ta,0.5\tb\tc,x\nshort\tline\n")
    assert rows(gmt.read_weighted_gmt(spark, str(tmp_path / "w.gmt")), "gene", "weight") == [("a", 0.5), ("b", 1.0), ("c", 1.0)]


def test_normalized_and_stacked_sets(spark):
    m = spark.createDataFrame([("S", i, g) for i, g in enumerate(["a", " A ", "b", "c"])] + [("T", 0, "x")], "set_name string, pos int, gene string")
    one = gmt.normalized_sets(m, "P")
    assert rows(one, "set_name", "pos", "gene") == [("P::S", 0, "A"), ("P::S", 1, "B"), ("P::S", 2, "C")]
    other = spark.createDataFrame([("P::S", 0, "Z")], "set_name string, pos int, gene string")
    assert rows(gmt.stacked_sets([one, other]), "set_name", "gene") == [("P::S", "Z")]
    assert [c for c in gmt.membership_matrix(m).columns] == ["gene", "S", "T"]


def test_matrix_cells(spark):
    df = spark.createDataFrame([("g1", "1", None), ("g2", "2.5", "3")], "gene string, s1 string, s2 string")
    assert rows(tables.wide_to_long(df, "gene"), "sample", "gene", "value") == [("s1", "g1", 1.0), ("s1", "g2", 2.5), ("s2", "g1", 0.0), ("s2", "g2", 3.0)]
    with pytest.raises(PySparkException):
        tables.wide_to_long(spark.createDataFrame([("g", "oops")], "gene string, s1 string"), "gene").collect()


def test_ranked_table_errors(spark):
    ok = spark.createDataFrame([("A", "2"), ("A", "-3"), ("B", "1")], "gene string, score string")
    assert rows(tables.ranked_table(ok), "gene", "score", "rank_no") == [("A", -3.0, 2), ("B", 1.0, 1)]
    for bad in (("A", "inf"), ("A", "x"), ("A", None), (None, "1"), (" ", "1")):
        with pytest.raises(PySparkException):
            tables.ranked_table(spark.createDataFrame([bad], "gene string, score string")).collect()
    with pytest.raises(ValueError):
        tables.ranked_table(ok.drop("score"))


def test_10x_folder(spark, tmp_path):
    (tmp_path / "matrix.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n%x\n2 3 3\n1 1 5\n2 3 7\n1 3 1\n")
    (tmp_path / "barcodes.tsv").write_text("c1\nc2\nc3\n")
    with gzip.open(tmp_path / "features.tsv.gz", "wt") as f:
        f.write("E1\tSYM1\tGene\nE2\tSYM2\tGene\n")
    got = tables.read_10x(spark, str(tmp_path))
    assert rows(got, "cell", "gene", "value") == [("c1", "SYM1", 5.0), ("c3", "SYM1", 1.0), ("c3", "SYM2", 7.0)]
    assert rows(tables.stacked_10x({"a": got, "b": got}), "cell")[0] == ("a:c1",)
    meta = spark.createDataFrame([("c1", "x"), ("c1", "y")], "bc string, t string")
    with pytest.raises(ValueError):
        tables.with_cell_metadata(got, meta, "bc")
    (tmp_path / "barcodes.tsv").write_text("c1\n")
    with pytest.raises(ValueError):
        tables.read_10x(spark, str(tmp_path))


def test_run_files(spark, tmp_path):
    compact = spark.createDataFrame([("p", "A, B,,nan")], "Program string, genes string")
    assert rows(tables.compact_programs(compact), "program", "gene") == [("p", "A"), ("p", "B")]
    gates = spark.createDataFrame([("p", "true", None), ("q", "false", "1"), ("q", "yes", "no")], "program string, gate_fdr string, gate_stability string")
    assert dict(tables.claim_support(gates).collect()) == {"p": True, "q": False}
    assert tables.changed_settings('{"a": 1, "b": 2, "out": 3}', '{"a": 1, "b": 5}', ("out",)) == [("b", "2", "5")]
    tables.write_manifest(str(tmp_path / "m" / "run.json"), {"k": 3}, n_genes=5)
    assert json.loads((tmp_path / "m" / "run.json").read_text()) == {"config": {"k": 3}, "n_genes": 5}
    v = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.5, 0.25])], "gene int, v array<double>")
    tables.save_vectors(v, str(tmp_path / "v"))
    assert rows(tables.load_vectors(spark, str(tmp_path / "v")), "gene") == [(1,), (2,)]
