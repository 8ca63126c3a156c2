import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from genoloom.functions import labels
from genoloom.operators import annotate, columns, discover, embed, enrich, evaluate, expression, graph, gsea, modules, plugins, report, stats, suite
from genoloom.sources import gmt


def one(spark, column, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "x string").select(column(F.col("x"))).collect()]


def test_labels(spark):
    assert one(spark, labels.family_display, " IL6 SIGNALING 2B", "", "a-b") == ["Il6 Signaling 2B", "Unlabeled family", "A-B"]
    assert one(spark, labels.reference_keys, "GO_BP::X", "GO_BP::GOBP_X", "WP::Y", "plain", "OTHER::Z") == [
        ["GO_BP::X", "X", "GOBP_X"], ["GO_BP::GOBP_X", "GOBP_X"], ["WP::Y", "Y", "WP_Y"], ["plain"], ["OTHER::Z", "Z"],
    ]
    assert one(spark, lambda c: labels.wrapped(c, 10), "short", "one two three four", "x" * 25, "a " + "y" * 30) == ["short", "one two<br>three four", "x" * 10 + "<br>" + "x" * 10 + "<br>xxxxx", "a<br>" + "y" * 30]
    assert one(spark, labels.program_display, "program_3__GOBP_CELL_CYCLE", "program_1", "p__KEGG", "x__CUSTOM__a-b/c") == ["P3 - GO BP: CELL CYCLE", "P1 - program 1", "p - KEGG: p__KEGG", "x - CUSTOM: a b c"]
    assert one(spark, lambda c: labels.program_display(c, 2, 12, True), "program_3__GOBP_CELL_CYCLE_PHASE") == ["P3 (GO BP) CELL CYC ..."]
    assert one(spark, labels.reference_display, "GO_BP::A_B", "WP::a_b_c_d_e_f_g", "NEW_SRC::x-y", "z_z", "CUSTOM::q") == ["GO BP: A B", "WikiPathways: a b c d e f ...", "NEW SRC: x y", "z z", "Custom: q"]
    assert one(spark, labels.track_of, "Curated-X", "starCAT-Ref", "kmeans") == ["reference_guided", "reference_guided", "de_novo"]


def test_suite_tables(spark):
    keys = "dataset string, seed int, method string"
    rec = spark.createDataFrame([("d", 1, "A", 1.0), ("d", 1, "A", 3.0), ("d", 2, "A", 4.0), ("d", 1, "Curated-H", 9.0)], keys + ", n_sig double")
    dis = spark.createDataFrame([("d", 1, "A", 0.5), ("e", 1, "B", 0.7)], keys + ", coverage double")
    seeds = suite.seed_summary(rec, dis)
    rows = {(r.dataset, r.seed, r.method): r for r in seeds.collect()}
    assert rows[("d", 1, "A")].recovery_n_sig == 2.0 and rows[("d", 2, "A")].discovery_coverage is None and rows[("e", 1, "B")].recovery_n_sig is None
    assert rows[("d", 1, "Curated-H")].track == "reference_guided"
    m = {(r.dataset, r.method): r for r in suite.method_summary(seeds).collect()}
    assert m[("d", "A")].recovery_n_sig_mean == 3.0 and abs(m[("d", "A")].recovery_n_sig_std - math.sqrt(2)) < 1e-12
    assert {r.dataset: r.n_unique_seeds for r in suite.seed_gate(seeds.where("dataset = 'd'"), 2).collect()} == {"d": 2}
    with pytest.raises(suite.GateFailure, match="e:1"):
        suite.seed_gate(seeds, 2)
    manifest = suite.fairness_manifest(seeds, n_programs=20)
    assert {r.method: (r.seed_controlled, r.n_programs_budget) for r in manifest.collect()} == {"A": (True, 20), "B": (True, 20), "Curated-H": (False, 20)}
    stats_ = spark.createDataFrame([("A",), ("new",)], "method string")
    both = {r.method: r for r in suite.with_fairness(suite.with_track(stats_, seeds), manifest).collect()}
    assert both["A"].fairness_pass and both["A"].track == "de_novo" and not both["new"].fairness_pass and both["new"].track == "unknown"
    sets_ = spark.createDataFrame([(f"s{i}",) for i in range(10)] * 2, "set_name string")
    parts = suite.leakage_split(sets_, 0.3, 1).collect()
    assert len(parts) == 10 and sum(r.part == "tune" for r in parts) == 3
    assert suite.leakage_split(sets_.limit(1), 0.3, 1).count() == 2
    scores = spark.createDataFrame([("m", 1.0), ("m", 0.0), ("m", float("nan")), ("k", None)], "method string, score double")
    got = {r.method: r.robust_score for r in suite.robust_score(scores, ["method"]).collect()}
    assert abs(got["m"] - 0.4) < 1e-12 and got["k"] is None


def test_models(spark):
    rows = [("a", "p1", g) for g in "abcd"] + [("a", "p2", g) for g in "xy"] + [("b", "q1", g) for g in "abce"] + [("b", "q2", g) for g in "xy"] + [("c", "r1", g) for g in "abz"]
    m = spark.createDataFrame(rows, "model string, program string, gene string").withColumn("cohort", F.lit(1))
    got = {(r.model_a, r.model_b): r for r in suite.model_agreement(m, ["cohort"]).collect()}
    assert abs(got[("a", "b")].mean_best_match - 0.8) < 1e-12 and got[("a", "b")].ari == 1.0 and (got[("a", "c")].programs_a, got[("a", "c")].programs_b) == (2, 1)
    assert {(r.program, r.gene) for r in suite.consensus_of_models(m, ["cohort"], 0.3).collect()} == {("p1", "a"), ("p1", "b")}
    same = {r.cohort: r.fingerprint for r in suite.programs_fingerprint(m.withColumn("cohort", F.col("model")).union(m.withColumn("cohort", F.lit("z")).where("model = 'a'").orderBy(F.desc("gene"))), ["cohort"]).collect()}
    assert same["a"] == same["z"] and len(set(same.values())) == 3
    g = spark.createDataFrame([("h", "TP53", 1), ("h", "12", 2), ("m", "Trp53", 1), ("m", "Myc", 2), ("m", "A", 3)], "s string, gene string, pos int")
    assert {r.s: r.species for r in suite.species_of(g, ["s"], ["pos"]).collect()} == {"h": "human", "m": "mouse"}


def test_columns(spark):
    rows = [(f"c{i}", f"d{i % 4}", ["case", "ctrl"][i % 2], ["T", "B", "NK"][i % 3], f"b{i % 2}", 30 + i % 4) for i in range(24)]
    cells = spark.createDataFrame(rows, "cell string, Donor_ID string, condition string, cell_type string, seq_batch string, Age int")
    found = columns.detect(cells)
    assert (found.sample, found.group, found.cell_type, found.batch, found.covariates) == ("Donor_ID", "condition", "cell_type", "seq_batch", ["Age"])
    bare = columns.detect(cells.select("cell"))
    assert bare.sample is None and len(bare.warnings) == 3
    with pytest.raises(KeyError):
        columns.detect(cells, batch="plate")
    plan = spark.createDataFrame([("T", 9, True), ("B", 20, True), ("NK", 30, False)], "cell_type string, n_cells long, eligible boolean")
    assert [r.cell_type for r in columns.selected_types(plan, most=1).collect()] == ["B"] and columns.selected_types(plan, every=True).count() == 2
    with pytest.raises(ValueError):
        columns.selected_types(plan, requested=("NK",))
    assert {(r.Donor_ID, r.n_labels) for r in suite.ambiguous_labels(cells.withColumn("x", F.when(F.col("cell") == "c0", None).otherwise(F.col("condition"))), "Donor_ID", "x").collect()} == {("d0", 2)}


def naive_linkage(s, k):
    groups = [[i] for i in range(len(s))]
    while len(groups) > k:
        best = max(((np.mean([s[i, j] for i in a for j in b]), -x, -y) for x, a in enumerate(groups) for y, b in enumerate(groups) if x < y))
        x, y = -best[1], -best[2]
        groups[x] += groups.pop(y)
    return {frozenset(g) for g in groups}


def test_average_linkage_equals_the_naive_one(spark):
    rng = np.random.default_rng(4)
    for n, k in ((20, 5),):
        s = np.triu(rng.random((n, n)), 1)
        s += s.T
        edges = spark.createDataFrame([(i, j, float(s[i, j])) for i in range(n) for j in range(i + 1, n)], "src int, dst int, weight double")
        got = modules.linkage(edges, spark.range(n).select(F.col("id").cast("int").alias("gene")), k).collect()
        groups = {}
        for r in got:
            groups.setdefault(r.label, set()).add(r.gene)
        assert {frozenset(g) for g in groups.values()} == naive_linkage(s, k)
    apart = spark.createDataFrame([(0, 1, 0.5), (2, 3, 0.4)], "src int, dst int, weight double")
    got = {r.gene: r.label for r in modules.linkage(apart, spark.range(5).select(F.col("id").cast("int").alias("gene")), 1).collect()}
    assert got[0] == got[1] != got[2] == got[3] and len(set(got.values())) == 3


def test_coexpression_and_soft_membership(spark):
    rng = np.random.default_rng(1)
    a, b = rng.random(30), rng.random(30)
    rows = [(s, f"{n}{i}", float(x[s] + 0.05 * rng.random())) for n, x in (("a", a), ("b", b)) for i in range(6) for s in range(30)]
    values = spark.createDataFrame(rows, "sample int, gene string, value double")
    r = expression.gene_correlations(values, 30)
    m = np.array([[v for s, g, v in sorted(rows) if g == name] for name in ("a0", "a1", "b0")])
    want = np.corrcoef(m)
    got = {(x.src, x.dst): x.r for x in r.collect()}
    assert abs(got[("a0", "a1")] - want[0, 1]) < 1e-9 and abs(got[("a0", "b0")] - want[0, 2]) < 1e-9
    found = modules.coexpression_modules(r, values, n_modules=2, least=3).collect()
    assert {x.gene[0]: x.module for x in found}.keys() == {"a", "b"} and len({(x.gene[0], x.module) for x in found}) == 2 and max(x.score for x in found) == 1.0
    assert {x.module for x in modules.coexpression_modules(r, values, n_modules=2, least=20).collect()} == {0}
    pairs = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 0.5), ("b", "c", 0.5)], "src string, dst string, weight double")
    lab = spark.createDataFrame([("a", 0), ("b", 0), ("c", 1)], "gene string, label int")
    soft = {(x.gene, x.label): x.weight for x in modules.soft_consensus(pairs, lab).collect()}
    assert abs(soft[("a", 0)] - 0.5) < 1e-12 and abs(soft[("a", 1)] - 0.5) < 1e-12 and soft[("c", 0)] == 1.0


def test_rank_correlation_with_zeros_and_ties(spark):
    rng = random.Random(3)
    dense = [[rng.choice([0, 0, 1, 2, 2, 5]) for _ in range(25)] for _ in range(4)]
    rows = [(s, g, float(v)) for g, row in enumerate(dense) for s, v in enumerate(row) if v]
    got = {(x.src, x.dst): x.r for x in expression.gene_correlations(spark.createDataFrame(rows, "sample int, gene int, value double"), 25, "spearman").collect()}

    def ranks(x):
        return [sum(y < v for y in x) + (sum(y == v for y in x) + 1) / 2 for v in x]

    for i, j in itertools.combinations(range(4), 2):
        assert abs(got[(i, j)] - np.corrcoef(ranks(dense[i]), ranks(dense[j]))[0, 1]) < 1e-9


def blobs(seed=0, n=25, noise=6):
    rng = np.random.default_rng(seed)
    points = [(c, rng.normal(c * 12, 0.6, 3)) for c in range(3) for _ in range(n)] + [(-1, rng.uniform(-60, 90, 3)) for _ in range(noise)]
    return [(i, [float(x) for x in p]) for i, (_, p) in enumerate(points)], [c for c, _ in points]


def test_density_clusters_find_planted_groups(spark):
    rows, truth = blobs()
    v = spark.createDataFrame(rows, "gene int, v array<double>")
    got = {r.gene: r.label for r in modules.density_clusters(v, 5).collect()}
    assert len(got) == len(rows) and len({got[i] for i, c in enumerate(truth) if c >= 0 and got[i] >= 0}) == 3
    assert sum(got[i] >= 0 for i, c in enumerate(truth) if c >= 0) >= 70 and sum(got[i] < 0 for i, c in enumerate(truth) if c < 0) >= 4
    for c in range(3):
        assert len({got[i] for i, t in enumerate(truth) if t == c and got[i] >= 0}) == 1
    assert {r.label for r in modules.density_clusters(v.limit(3), 5).collect()} == {-1}


def test_stable_clusters_of_a_line():
    x = np.array([0.0, 0.1, 0.2, 0.3, 5.0, 5.1, 5.2, 5.3, 20.0])
    u, v = np.arange(8), np.arange(1, 9)
    assert modules.stable_clusters(u, v, np.diff(x), 9, 3).tolist() == [1, 1, 1, 1, 2, 2, 2, 2, -1] or len(set(modules.stable_clusters(u, v, np.diff(x), 9, 3)[:8])) == 2


def test_components(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("q", "q")], "u string, v string")
    assert dict(graph.components(e).collect()) == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    chain = spark.createDataFrame([(i, i + 1) for i in range(30)], "u long, v long")
    assert {r.root for r in graph.components(chain).collect()} == {0}


def test_communities_by_levels(spark):
    cliques = [(c * 10 + i, c * 10 + j, 1.0) for c in range(4) for i in range(6) for j in range(i + 1, 6)] + [(5, 10, 0.1), (15, 20, 0.1), (25, 30, 0.1), (35, 0, 0.1)]
    edges = spark.createDataFrame(cliques, "src int, dst int, weight double")
    got = discover.communities(edges)
    groups = {}
    for r in got.collect():
        groups.setdefault(r.label, set()).add(r.gene // 10)
    assert sorted(map(sorted, groups.values())) == [[0], [1], [2], [3]]
    assert discover.movable(edges, got).count() == 0


def test_adaptive_permutations(spark):
    rng = random.Random(2)
    ranked = spark.createDataFrame([(1, f"g{i}", 5.0 - i / 20, i + 1, 200) for i in range(200)], "l int, gene string, score double, rank_no int, n_genes long")
    rows = [("top", f"g{i}") for i in range(12)] + [("none", f"g{i}") for i in rng.sample(range(200), 15)]
    s = spark.createDataFrame(rows, "set_name string, gene string")
    fixed = {r.set_name: r for r in gsea.preranked(ranked, s, ["l"], "set_name", 400).collect()}
    got = {r.set_name: r for r in gsea.preranked_adaptive(ranked, s, ["l"], "set_name", 400, 200, 30).collect()}
    assert got["top"].n_perm == 400 and got["top"].p_value == fixed["top"].p_value and abs(got["top"].nes - fixed["top"].nes) < 1e-9
    assert got["none"].n_perm == 200 and abs(got["none"].p_value - fixed["none"].p_value) < 0.2


def test_enrichment_entry(spark):
    u = spark.createDataFrame([(f"g{i}",) for i in range(100)], "gene string")
    q = u.where("gene in ('g0','g1','g2','g3')")
    s = spark.createDataFrame([("hit", f"g{i}") for i in range(6)] + [("off", f"g{i}") for i in range(50, 60)], "set_name string, gene string")
    out = {r.set_name: r for r in enrich.run("fisher", s, "set_name", [], query=q, universe=u).collect()}
    assert out["hit"].overlap == 4 and out["hit"].p_value < 1e-4 and out["off"].p_value == 1 and out["hit"].method == "fisher"
    w = s.withColumn("weight", F.when(F.col("gene") == "g0", 0.05).otherwise(0.5))
    soft = {r.set_name: r for r in enrich.weighted_fisher(q, w, u, [], "set_name").collect()}
    assert soft["hit"].overlap == 3 and soft["hit"].program_size == 5 and abs(soft["hit"].weighted_overlap - 1.55) < 1e-12 and soft["off"].weighted_overlap == 0
    for bad in ({"method": "magic"}, {"method": "gsea"}, {"method": "ssgsea"}):
        with pytest.raises(ValueError):
            enrich.run(**bad, sets=s, set_key="set_name", lists=[])
    p = spark.createDataFrame([(x / 40,) for x in range(1, 41)], "p double")
    assert stats.adjusted(p, "p", "q", "storey").count() == 40
    with pytest.raises(ValueError):
        stats.adjusted(p, "p", "q", "holm")


def test_expression_pieces(spark):
    c = spark.createDataFrame([("c", "b", 2.0), ("c", "a", 2.0), ("c", "z", 9.0), ("c", "n", 0.0)], "cell string, gene string, value double")
    assert [(r.gene, r.position) for r in expression.rank_value_tokens(c, 2).orderBy("position").collect()] == [("z", 1), ("a", 2)]
    names = spark.createDataFrame([("A",), ("b",), ("alias",), ("own",), ("lost",)], "gene string")
    tokens = spark.createDataFrame([("A", 1), ("B", 2), ("E1", 3), ("E2", 4)], "id string, token int")
    table = lambda *x: spark.createDataFrame(list(x), "name string, id string")
    got = {r.gene: (r.token, r.how) for r in expression.mapped_identifiers(names, tokens, table(("alias", "E1"), ("A", "E2")), table(("own", "E2"))).collect()}
    assert got == {"A": (1, "name"), "b": (2, "upper"), "alias": (3, "synonym"), "own": (4, "own")}
    sym = spark.createDataFrame([("ENSG1", "TP53"), ("ENSG2", "")], "id string, symbol string")
    assert {r.gene: r.symbol for r in expression.symbols_for(spark.createDataFrame([("ENSG1.7",), ("ENSG2",), ("X",)], "gene string"), sym).collect()} == {"ENSG1.7": "TP53", "ENSG2": "ENSG2", "X": "X"}
    values = spark.createDataFrame([(0, "a", 1.0), (0, "b", 3.0), (1, "a", 4.0), (2, "a", -1.0)], "sample int, gene string, value double")
    samples = spark.createDataFrame([(0,), (1,), (2,)], "sample int")
    got = {(r.sample, r.gene): r.value for r in expression.median_scaled(values, samples).collect()}
    # gene a moves up by 1: 2, 5, 0; libraries 5, 5, 0 (counts 1), the median is 5
    assert abs(got[(0, "a")] - math.log1p(2)) < 1e-12 and abs(got[(1, "a")] - math.log1p(5)) < 1e-12 and (2, "a") not in got
    assert [r.gene for r in expression.top_dispersion(expression.median_scaled(values, samples), 3, 1).collect()] == ["b"]
    mito = {r.cell: r.mito_share for r in expression.mitochondrial_share(spark.createDataFrame([("x", "mt-Co1", 1.0), ("x", "A", 3.0)], "cell string, gene string, value double")).collect()}
    assert mito == {"x": 0.25}


def test_vectors(spark):
    rows = [(i, [float(x) for x in np.random.default_rng(i).normal(size=5)]) for i in range(12)]
    v = spark.createDataFrame(rows, "gene int, v array<double>")
    x = np.array([r[1] for r in rows])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ embed.random_directions(7, 5).T
    got = {(r.sample, r.gene): r.value for r in embed.synthetic_counts(v, 7).collect()}
    for (j, g), value in got.items():
        assert abs(value - (np.exp(s[g, j] - s[:, j].min()) - 1)) < 1e-9
    att = {(r.src, r.dst): r.w for r in embed.cosine_attention(v).collect()}
    assert all(w > 0 for w in att.values()) and len(att) == int(((u @ u.T) > 0).sum()) - 12


def test_bootstrap_and_comparison(spark):
    values = spark.createDataFrame([(s, g, float((s + 1) * (1 if g < 3 else 2))) for s in range(6) for g in range(6)], "sample int, gene int, value double")
    samples = spark.createDataFrame([(s, "a" if s < 3 else "b") for s in range(6)], "sample int, grp string")
    ref = spark.createDataFrame([("p", g) for g in range(3)] + [("q", g) for g in range(3, 6)], "program string, gene int")
    fit = lambda v: v.groupBy("gene").agg(F.sum("value").alias("s")).select("gene", F.dense_rank().over(Window.orderBy("s")).alias("label"))
    got = evaluate.bootstrap_stability(values, samples, fit, ref, 3).collect()
    assert [r.best_match_jaccard for r in got] == [1.0, 1.0, 1.0]
    members = spark.createDataFrame([("p", g) for g in "abcdef"] + [("q", g) for g in "uvw"], "program string, gene string")
    reference = spark.createDataFrame([("s1", g) for g in "abcde"] + [("s2", g) for g in "xyz"], "set_name string, gene string")
    hits = annotate.annotation_hits(members, reference, 12)
    done = annotate.annotated_programs(members, reference, hits)
    out = {r.set_name: r for r in evaluate.side_by_side(hits, done, reference, spark.createDataFrame([("s1", 1.5, 0.01, 0.02)], "set_name string, nes double, p_value double, fdr double")).collect()}
    assert out["s1"].program == "p" and out["s1"].gsea_significant and out["s1"].overlap == 5 and out["s1"].n_novel == 1
    assert out["s2"].program == "" and out["s2"].program_p == 1 and out["s2"].gsea_nes is None and not out["s2"].gsea_significant
    novel = spark.createDataFrame([("q", f"n{i:02d}") for i in range(12)], "program string, gene string")
    text = [r.line for r in report.annotation_report(hits, done, novel).orderBy("part").collect()]
    assert "Programs: 2" in text[0] and "novel only: 1" in text[0] and text[1].startswith("Program: p") and "s1: 5 genes" in text[1] and "(+2 more)" in text[2]
    gates = spark.createDataFrame([("p", 1.2, 0.01, 0.02, True), ("q", -1.0, 0.5, 0.6, False)], "program string, nes double, p_value double, fdr double, claim_supported boolean")
    de = spark.createDataFrame([("a", 0.01), ("b", 0.9)], "gene string, fdr double")
    digest = report.run_summary({"Contrast": "x vs y"}, de, members, gates, stability=(0.5, 0.4, 0.6))
    assert "- Supported programs: 1/2" in digest and "- p: NES=1.200" in digest and "0.500 (95% CI 0.400-0.600)" in digest and "(FDR <= 0.05): 1" in digest


def test_plug_ins(spark, tmp_path):
    rows, truth = blobs(2, 12, 0)
    v = spark.createDataFrame(rows, "gene int, v array<double>")
    labelled = spark.createDataFrame([(i, c) for i, c in enumerate(truth)], "gene int, label int")
    d = plugins.Given(lambda x: labelled)
    with pytest.raises(plugins.NotFitted):
        d.programs()
    d.fit(v)
    assert d.programs().count() == 36 and d.summary().first().n_programs == 3 and d.memberships().count() == 36
    assert abs(d.soft().groupBy("gene").agg(F.sum("weight").alias("s")).agg(F.max("s")).first()[0] - 1) < 1e-9
    d.to_gmt(str(tmp_path / "x.gmt"))
    assert gmt.read_gmt(spark, str(tmp_path / "x.gmt")).select("set_name").distinct().count() == 3

    class Absent(plugins.Discovery):
        needs = ("no_such_package",)

        def find(self, vectors):
            return vectors

    assert not Absent.available() and plugins.KMeans.available()
    with pytest.raises(ImportError):
        Absent().fit(v)

    class Sizes(plugins.Benchmark):
        def run(self, members):
            return members.groupBy("program").count()

    b = Sizes("sizes")
    table = b.compare({"one": d.programs(), "two": d.programs().where("program = 'program_0'")})
    assert {(r.collection, r["count"]) for r in table.collect()} == {("one", 12), ("two", 12)} and b.results().count() == 1
    with pytest.raises(ValueError):
        plugins.vectors_from("nothing")
    v.write.parquet(str(tmp_path / "v"))
    assert plugins.vectors_from(" Table ", spark=spark, path=str(tmp_path / "v")).count() == 36
    ci = plugins.resampled_metric(spark.range(50).select(F.col("id").cast("double").alias("x")), lambda df: df.groupBy("resample").agg(F.avg("x").alias("value")), 200).first()
    assert ci.low < 24.5 < ci.high and abs(ci.mean - 24.5) < 1


def test_local_collections(spark, tmp_path):
    (tmp_path / "h.all.v2024.1.Hs.symbols.gmt").write_text("S1\tx\tA\tB\tC\n")
    (tmp_path / "c2.cp.reactome.v1.gmt").write_text("R1\tx\tD\tE\n")
    assert gmt.load_collection(spark, "hallmark", str(tmp_path)).count() == 3
    both = gmt.load_all_collections(spark, str(tmp_path), names=["hallmark", "reactome", "msigdb_reactome"])
    assert both.select("collection").distinct().count() == 2 and both.count() == 5
    assert "go_bp" in gmt.supported_collections("mouse")
    for bad in (lambda: gmt.load_collection(spark, "hallmark", str(tmp_path), "mouse"), lambda: gmt.load_collection(spark, "nope", str(tmp_path)), lambda: gmt.supported_collections("yeast")):
        with pytest.raises((FileNotFoundError, ValueError)):
            bad()


def test_published_report(spark, tmp_path):
    from xml.etree import ElementTree

    from genoloom.operators import publish

    gates = spark.createDataFrame([("p<1>", 1.2, 0.01, True), ("q", -1.0, 0.6, False)], "program string, nes double, fdr double, claim_supported boolean")
    overlaps = spark.createDataFrame([("p<1>", "s", 0.4), ("q", "t", 0.1)], "program string, set_name string, jaccard double")
    members = spark.createDataFrame([("p<1>", "a"), ("p<1>", "b"), ("q", "c")], "program string, gene string")
    paths = publish.publish(spark, {"enrichment_gsea_with_claim_gates": gates, "reference_overlap_long": overlaps, "dynamic_programs_long": members}, str(tmp_path / "out"))
    page = (tmp_path / "out" / "index.html").read_text()
    assert "p&lt;1&gt;" in page and "<1>" not in page and len(paths) == 7
    for name in ("programs_by_fdr", "overlap_heatmap", "program_sizes"):
        ElementTree.parse(tmp_path / "out" / f"{name}.svg")
    ElementTree.fromstring(publish.curve(spark.createDataFrame([(1, 0.5), (2, -0.2)], "x int, y double"), "x", "y", "walk"))
    assert "The first 1 rows" in publish.table(members, 1)
    row = {r.program: r for r in publish.program_overview(gates, overlaps, members).collect()}
    assert row["p<1>"].n_genes == 2 and row["p<1>"].best_reference == "s" and row["q"].claim_supported is False


def test_streamed_updates_keep_the_latest(spark, tmp_path):
    from genoloom.streaming import context as stream

    schema = "ts timestamp, event_type string, value double"
    rows = lambda *x: spark.sql("values " + ", ".join(f"(timestamp'2024-01-01 {t}', '{e}', double({v}))" for t, e, v in x)).toDF("ts", "event_type", "value")
    src = str(tmp_path / "in")
    rows(("00:10:00", "a", 1), ("00:50:00", "a", 2), ("01:10:00", "b", 5)).write.parquet(src)
    events = spark.readStream.schema(schema).parquet(src)
    first = {(r.context, r.n, r.total) for r in stream.run_updates(stream.windowed_counts(events), str(tmp_path / "out")).collect()}
    assert first == {("a", 2, 3.0), ("b", 1, 5.0)}
    rows(("00:20:00", "a", 4)).write.mode("append").parquet(src)
    second = {(r.context, r.n, r.total) for r in stream.run_updates(stream.windowed_counts(events), str(tmp_path / "out")).collect()}
    assert second == {("a", 3, 7.0), ("b", 1, 5.0)}


def test_signed_rank_p_is_exact_for_few_untied_differences(spark):
    def brute(d):
        n = len(d)
        order = sorted(range(n), key=lambda i: abs(d[i]))
        up = sum(k + 1 for k, i in enumerate(order) if d[i] > 0)
        low = min(up, n * (n + 1) // 2 - up)
        sums = [sum(k + 1 for k in range(n) if m >> k & 1) for m in range(2**n)]
        return min(1.0, 2 * sum(s <= low for s in sums) / 2**n)

    rng = random.Random(5)
    groups = {g: [rng.choice([-1, 1]) * (k + 1 + rng.random() / 2) for k in range(g + 3)] for g in range(5)}
    df = spark.createDataFrame([(g, x) for g, d in groups.items() for x in d] + [(9, 0.0)], "g int, d double")
    got = {r.g: r.signed_rank_p for r in stats.paired_statistics(df, ["g"], "d").collect()}
    assert all(abs(got[g] - brute(d)) < 1e-12 for g, d in groups.items()) and got[9] == 1.0
