import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from genoloom.operators import gsea
from genoloom.plans import pipeline


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(42)
    x = rng.lognormal(2, 0.3, (60, 12))
    x[:12, :6] *= 5
    x[12:24, 6:] *= 4
    rows = [(f"s{j}", f"g{i:02d}", float(x[i, j])) for i in range(60) for j in range(12)]
    values = spark.createDataFrame(rows, "sample string, gene string, value double")
    samples = spark.createDataFrame([(f"s{j}", "case" if j < 6 else "control") for j in range(12)], "sample string, grp string")
    refs = spark.createDataFrame([("UP", f"g{i:02d}") for i in range(12)] + [("DOWN", f"g{i:02d}") for i in range(10, 24)], "set_name string, gene string")
    return values, samples, refs


def test_discovery_finds_and_gates_the_planted_programs(spark, planted, tmp_path):
    values, samples, refs = planted
    config = pipeline.Discovery("case", "control", n_programs=3, k_neighbours=8, n_components=4, n_perm=100, least_genes=5)
    out = pipeline.discovery(values, samples, refs, config)
    pipeline.write_results(out, str(tmp_path / "run"), config)
    manifest = json.loads((tmp_path / "run" / "run_manifest.json").read_text())
    assert manifest["de_results"] == 60 and manifest["dynamic_programs_long"] == 60 and manifest["config"]["n_programs"] == 3
    matches = spark.read.parquet(str(tmp_path / "run" / "annotation_matches"))
    assert matches.agg(F.max("jaccard")).first()[0] > 0.4
    gates = spark.read.parquet(str(tmp_path / "run" / "enrichment_gsea_with_claim_gates"))
    assert gates.where("claim_supported").count() >= 1
    de = spark.read.parquet(str(tmp_path / "run" / "de_results")).orderBy("p_value").limit(10)
    assert {r.gene for r in de.collect()} <= {f"g{i:02d}" for i in range(24)}
    with pytest.raises(ValueError):
        pipeline.discovery(values, samples.limit(1), refs, config)


def test_comparison(spark):
    scores = [("APP", 5.0), ("APOE", 4.5), ("TREM2", 4.0), ("TYROBP", 3.8), ("MAPT", 2.0), ("PSEN1", 1.8), ("G1", -1.0), ("G2", -2.0)]
    ranked = gsea.ranking(spark.createDataFrame(scores, "gene string, score double"), [])
    dyn = spark.createDataFrame([("ProgA", g) for g in ("APP", "APOE", "TREM2", "TYROBP")] + [("ProgB", g) for g in ("MAPT", "G1", "G2")], "program string, gene string")
    cur = spark.createDataFrame([("AD", g) for g in ("APP", "APOE", "TYROBP", "PSEN1")] + [("X", g) for g in ("MAPT", "G1", "G2")], "set_name string, gene string")
    focus = spark.createDataFrame([("TREM2",), ("APP",)], "gene string")
    out = pipeline.comparison(ranked, dyn, cur, 100, focus)
    combined = {(r.source, r.set_name): r for r in out["combined"].collect()}
    assert combined["dynamic", "ProgA"].es == pytest.approx(1.0) and len(combined) == 4
    member = {r.gene: (r.programs, r["references"]) for r in out["focus_gene_membership"].collect()}
    assert member["TREM2"] == ("ProgA", "") and member["APP"] == ("ProgA", "AD")
    assert out["curated_panel_gsea"].count() == 2
    # the identical pair ProgB and X is the anchor
    assert {r.set_name for r in out["side_by_side"].collect()} == {"ProgB", "X"}


def test_power_grows_with_the_fold(spark, planted):
    rng = np.random.default_rng(1)
    values = spark.createDataFrame([(j, i, float(v)) for i in range(40) for j, v in enumerate(rng.lognormal(2, 0.2, 20))], "sample int, gene int, value double")
    samples = values.select("sample").distinct()
    members = spark.createDataFrame([("t", i) for i in range(8)] + [("o", i) for i in range(20, 30)], "program string, gene int")
    got = {r.fold: r for r in pipeline.power(values, samples, members, "t", [1.0, 4.0], 2, top=8).collect()}
    assert got[4.0].tpr == 1.0 and got[4.0].tpr_lo < 1 and got[1.0].tpr <= got[4.0].tpr


def test_method_table(spark):
    m = spark.createDataFrame([("a", "p", g) for g in "ABC"] + [("a", "q", g) for g in "DE"] + [("b", "p", g) for g in "XY"], "method string, program string, gene string")
    refs = spark.createDataFrame([("r", g) for g in "ABCD"], "set_name string, gene string")
    got = {r.method: r for r in pipeline.method_table(m, refs).collect()}
    assert got["a"].coverage == 1.0 and got["a"].redundancy == 0 and got["a"].specificity == 1 and got["b"].coverage == 0 and got["b"].novelty == 1


def test_command_line(spark, tmp_path):
    from genoloom.__main__ import main

    (tmp_path / "r.csv").write_text("gene,score\n" + "".join(f"g{i:02d},{20 - i}\n" for i in range(40)))
    (tmp_path / "d.gmt").write_text("P\tx\tg00\tg01\tg02\tg03\nQ\tx\tg30\tg31\tg32\n")
    (tmp_path / "c.gmt").write_text("C\tx\tg00\tg01\tg02\nD\tx\tg10\tg20\tg30\n")
    main(["compare", "--ranking", str(tmp_path / "r.csv"), "--dynamic", str(tmp_path / "d.gmt"), "--curated", str(tmp_path / "c.gmt"), "--permutations", "50", "--focus", "g00, g39", "--out", str(tmp_path / "o")])
    assert spark.read.parquet(str(tmp_path / "o" / "combined")).count() == 4
    assert spark.read.parquet(str(tmp_path / "o" / "focus_gene_membership")).count() == 2
    with pytest.raises(SystemExit):
        main(["unknown"])
