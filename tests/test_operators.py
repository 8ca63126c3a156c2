import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from genoloom.functions import labels
from genoloom.functions.digests import Texts
from genoloom.operators import annotate, discover, embed, evaluate, expression, gsea, report, sets, stats, validate


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def programs(spark, d):
    return frame(spark, [(p, g) for p, gs in d.items() for g in gs], "program string, gene string")


def one(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


# sets


def test_jaccard_partial_identical_disjoint(spark):
    a = programs(spark, {"p": "ABC", "q": "XY"})
    b = programs(spark, {"r": "ABD", "s": "XY"}).withColumnRenamed("program", "other")
    got = {(r.program, r.other): r.jaccard for r in sets.overlap(a, b, ["program"], ["other"]).collect()}
    assert got == {("p", "r"): 0.5, ("q", "s"): 1.0}
    assert spark.range(1).select(sets.jaccard(F.lit(0), F.lit(0), F.lit(0))).first()[0] == 0.0


def test_best_match_ties_go_to_the_name(spark):
    o = frame(spark, [("a", "y", 0.5), ("a", "x", 0.5), ("b", "x", 0.1)], "program string, other string, jaccard double")
    assert sorted(one(sets.best_match(o, ["program"], "other"), "program", "other")) == [("a", "x"), ("b", "x")]


def test_identical_partners_are_found_without_overlaps(spark, monkeypatch):
    a = programs(spark, {"a": "AB", "b": "AB", "c": "ABCD", "d": "Z"})
    b = programs(spark, {"a": "AB", "b": "AB", "e": "ABC", "d": "Z"})
    seen, overlap = [], sets.overlap
    monkeypatch.setattr(sets, "overlap", lambda left, *x, **y: seen.append(left) or overlap(left, *x, **y))
    got = sets.fused_scores(a.withColumn("score", F.lit(1.0)), b.withColumn("score", F.lit(1.0)), 9, 0.05, "rrf")
    assert {(r.program, r.gene) for r in got.collect()} == {(p, g) for p, gs in {"a": "AB", "b": "AB", "c": "ABCD", "d": "Z"}.items() for g in gs}
    assert {r.program for r in seen[0].collect()} == {"c"}  # the others have an identical partner
    assert sorted(one(sets.best_partners(a, b), "program", "other", "jaccard")) == [("a", "a", 1.0), ("b", "a", 1.0), ("c", "e", 0.75), ("d", "d", 1.0)]


def test_redundancy_counts_pairs_without_overlap(spark):
    m = programs(spark, {"a": "AB", "b": "AB", "c": "Z"}).withColumn("run", F.lit(1))
    r = sets.mean_pairwise_jaccard(m, ["run"], "program").first()
    assert (r.n_sets, round(r.redundancy, 9)) == (3, round(1 / 3, 9))
    lone = sets.mean_pairwise_jaccard(m.where("program = 'a'"), ["run"], "program").first()
    assert lone.redundancy == 0


def test_label_agreement_of_equal_and_unrelated_labels(spark):
    rows = [(1, x, x) for x in "aabbcc"] + [(2, a, b) for a in "ab" for b in "xy"] + [(3, "a", "x"), (3, "a", "x")]
    got = {r.s: (round(r.ari, 6), round(r.nmi, 6)) for r in sets.label_agreement(frame(spark, rows, "s int, label_a string, label_b string"), ["s"]).collect()}
    assert got[1] == (1.0, 1.0) and got[2][1] == 0.0 and got[2][0] < 0 and got[3] == (1.0, 1.0)


def test_specificity_novelty_coverage(spark):
    m = programs(spark, {"a": "AB", "b": "BC"}).withColumn("run", F.lit(1))
    assert sets.specificity(m, ["run"], "program").first().specificity == 0.5
    ref = programs(spark, {"r": "ABZ"}).withColumn("c", F.lit(1))
    assert sets.novelty(m, ref, ["run"]).first().novelty == 0.25
    assert round(sets.coverage(m, ref, ["c"]).first().coverage, 6) == round(2 / 3, 6)


# statistics


def test_fisher_tail_and_empty_margins(spark):
    df = frame(spark, [(7, 10, 10, 73), (0, 5, 5, 20), (3, 3, 3, 3)], "k long, m long, q long, n long")
    p = [r[0] for r in df.select(stats.fisher_greater("k", "m", "q", "n")).collect()]
    assert p[0] == pytest.approx(7.8121e-06, rel=1e-4) and p[1] == 1.0 and p[2] == 1.0


@settings(max_examples=25, deadline=None)
@given(st.lists(st.floats(0, 1), min_size=1, max_size=12))
def test_bh_properties(spark, ps):
    rows = [(i, p) for i, p in enumerate(ps)]
    got = dict(one(stats.bh(frame(spark, rows, "i int, p double"), "p", "q"), "i", "q"))
    order = sorted(range(len(ps)), key=lambda i: ps[i])
    want, low = {}, 1.0
    for r in range(len(ps), 0, -1):
        low = min(low, ps[order[r - 1]] * len(ps) / r)
        want[order[r - 1]] = low
    assert all(got[i] == pytest.approx(want[i]) and got[i] >= ps[i] - 1e-12 for i in want)


def test_bh_families_and_missing_values(spark):
    rows = [("m1", 0.001), ("m1", 0.01), ("m2", 0.001), ("m2", 0.9), (None, 0.5), ("m1", float("nan")), ("m1", None)]
    df = frame(spark, rows, "m string, p double")
    grouped = {(r.m, r.p): r.q for r in stats.bh(df.where("p is not null and not isnan(p)"), "p", "q", ["m"]).collect()}
    assert grouped["m1", 0.01] == pytest.approx(0.01) and grouped[None, 0.5] == 0.5
    whole = {(r.m, r.p): r.q for r in stats.bh(df.where("m is not null"), "p", "q").collect()}
    assert whole["m1", 0.01] == pytest.approx(0.04 / 3) and whole["m1", None] is None


def test_distributed_bh_equals_the_window(spark):
    rng = np.random.default_rng(4)
    rows = [(i, float(np.round(p, 3))) for i, p in enumerate(rng.random(500) ** 2)] + [(900, None), (901, float("nan"))]
    df = frame(spark, rows, "i int, p double")
    want = dict(one(stats.bh(df, "p", "q"), "i", "q"))
    for block in (7, 100_000):
        got = dict(one(stats.bh_distributed(df, "p", "q", block), "i", "q"))
        assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in want)
    assert stats.bh_distributed(df.where("i >= 900"), "p", "q").count() == 2


def test_storey_is_at_most_bh(spark):
    rng = np.random.default_rng(0)
    df = frame(spark, [(float(p),) for p in np.r_[rng.random(80), rng.random(40) * 0.01]], "p double")
    a = {r.p: r.q for r in stats.bh(df, "p", "q").collect()}
    assert all(r.q <= a[r.p] + 1e-12 for r in stats.storey(df, "p", "q").collect())


def test_student_tail_against_known_values(spark):
    df = frame(spark, [(2.228138852, 10.0), (12.70620474, 1.0), (0.0, 5.0), (None, 3.0)], "t double, d double")
    p = [r[0] for r in df.select(stats.student_two_sided("t", "d")).collect()]
    assert p[:3] == [pytest.approx(0.05, abs=1e-8), pytest.approx(0.05, abs=1e-8), pytest.approx(1.0)] and p[3] is None


def test_paired_statistics(spark):
    df = frame(spark, [("a", d) for d in (3.0, 1.0, -2.0, 0.0, 4.0)] + [("b", 0.0)], "g string, d double")
    got = {r.g: r for r in stats.paired_statistics(df, ["g"], "d").collect()}
    a = got["a"]
    assert (a.wins, a.losses) == (3, 1) and a.rank_biserial == 0.5 and a.signed_rank_biserial == pytest.approx((8 - 2) / 10)
    assert a.sign_p_greater == pytest.approx(5 / 16) and a.sign_p == pytest.approx(10 / 16)
    assert got["b"].sign_p == 1 and got["b"].rank_biserial == 0


def test_wilson(spark):
    lo, hi = spark.range(1).select(*stats.wilson(F.lit(8), F.lit(10))).first()
    assert (round(lo, 4), round(hi, 4)) == (0.4902, 0.9433)


# ranked lists


def walk(scores, members):
    hit = [g in members for g, _ in scores]
    n, m = len(scores), sum(hit)
    total = sum(abs(s) for (g, s), h in zip(scores, hit) if h) or 1.0
    cum, curve = 0.0, []
    for (g, s), h in zip(scores, hit):
        cum += abs(s) / total if h else -1 / (n - m)
        curve.append(cum)
    hi, lo = max(curve), min(curve)
    return hi if round(abs(hi), 12) >= round(abs(lo), 12) else lo


def test_enrichment_scores_equal_the_full_walk(spark):
    rng = np.random.default_rng(3)
    scores, members, want = [], [], {}
    for lst in range(12):
        n = int(rng.integers(4, 40))
        rows = sorted(((f"g{i:02d}", float(np.round(rng.normal(), 2))) for i in range(n)), key=lambda x: (-x[1], x[0]))
        scores += [(lst, *r) for r in rows]
        for s in range(3):
            own = [f"g{i:02d}" for i in rng.choice(n, int(rng.integers(1, n)), replace=False)]
            members += [(f"s{lst}_{s}", g) for g in own]
            want[lst, f"s{lst}_{s}"] = walk(rows, set(own))
    ranked = gsea.ranking(frame(spark, scores, "lst int, gene string, score double"), ["lst"])
    got = gsea.enrichment_scores(gsea.hits(ranked, frame(spark, members, "set_name string, gene string"), "set_name"), ["lst", "set_name"])
    got = {(r.lst, r.set_name): r.es for r in got.collect()}
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-9) and -1 - 1e-9 <= got[k] <= 1 + 1e-9


def test_planted_set_leads(spark):
    genes = [(f"G{i:03d}", 10.0 - i * 0.04) for i in range(400)]
    ranked = gsea.ranking(frame(spark, genes, "gene string, score double").withColumn("l", F.lit(1)), ["l"])
    members = [("top", f"G{i:03d}") for i in range(15)] + [("spread", f"G{i:03d}") for i in range(0, 400, 27)]
    out = {r.set_name: r for r in gsea.preranked(ranked, frame(spark, members, "set_name string, gene string"), ["l"], "set_name", 200).collect()}
    assert out["top"].es > 0.9 and out["top"].p_value < 0.01 and out["top"].fdr <= 0.05 and out["top"].nes > out["spread"].nes
    edge = gsea.leading_edge(gsea.hits(ranked, frame(spark, members, "set_name string, gene string"), "set_name"), ["l", "set_name"])
    assert {r.set_name: r.n_leading for r in edge.collect()}["top"] == 15


def brute_null(genes, own, n_perm, weights=None, seed=42):
    """es, nes, p of one set by a dense walk over every permutation."""
    names, scores = [g for g, _ in genes], [abs(x) for _, x in genes]

    def walk(placed):
        total = sum(scores[i] * w for i, w in placed.items()) or 1.0
        run, high, low = 0.0, 0.0, 0.0
        for i in range(len(names)):
            run += scores[i] * placed[i] / total if i in placed else -1 / (len(names) - len(placed))
            high, low = max(high, run), min(low, run)
        return high if round(abs(high), 12) >= round(abs(low), 12) else low

    weights = weights or dict.fromkeys(own, 1.0)
    es, null = walk({names.index(g): weights[g] for g in own}), []
    for perm in range(1, n_perm + 1):
        place = {g: i for i, g in enumerate(sorted(names, key=lambda g: hashlib.md5(f"{seed}|{perm}|{g}".encode()).hexdigest()))}
        null.append(walk({place[g]: weights[g] for g in own}))
    same = [abs(x) for x in null if (x >= 0) == (es >= 0)]
    p = max(sum(round(x, 12) >= round(abs(es), 12) for x in same) / len(same) if same else 0.0, 1 / (n_perm + 1))
    return es, es / (sum(same) / len(same)) if same else es, p


def test_permutations_grow_with_the_sets(spark):
    assert [gsea.permutations(1000, n) for n in (100, 101, 300, 3000)] == [1000, 1010, 3000, 10_000]
    genes = [(f"G{i:02d}", 30.0 - i - 0.001 * i * i) for i in range(60)]
    ranked = gsea.ranking(frame(spark, genes, "gene string, score double").withColumn("l", F.lit(1)), ["l"])
    own = {f"s{j:03d}": [f"G{(j * 7 + 11 * i) % 60:02d}" for i in range(4)] for j in range(101)} | {"top": [f"G{i:02d}" for i in range(10)]}
    members = frame(spark, [(k, g) for k, gs in own.items() for g in gs], "set_name string, gene string")
    out = {r.set_name: r for r in gsea.preranked(ranked, members, ["l"], "set_name", 100).collect()}
    assert out["top"].p_value == pytest.approx(1 / 1021)  # 102 sets: 1,020 permutations
    order = [(r.gene, r.score) for r in ranked.orderBy("rank_no").collect()]
    for k in ("s000", "s017", "top"):
        assert (out[k].es, out[k].nes, out[k].p_value) == pytest.approx(brute_null(order, own[k], 1020), abs=1e-9)


def test_weights_move_with_their_genes(spark):
    genes = [(f"G{i:02d}", 9.0 - 0.7 * i - 0.003 * i * i) for i in range(25)]
    ranked = gsea.ranking(frame(spark, genes, "gene string, score double").withColumn("l", F.lit(1)), ["l"])
    own = {"a": {"G00": 0.9, "G03": 0.1, "G09": 0.5}, "b": {"G20": 1.0, "G23": 0.25, "G05": 0.05, "G24": 0.7}}
    members = frame(spark, [(k, g, w) for k, ws in own.items() for g, w in ws.items()], "set_name string, gene string, weight double")
    out = {r.set_name: r for r in gsea.preranked(ranked, members, ["l"], "set_name", 200, weight="weight").collect()}
    for k, ws in own.items():
        assert (out[k].es, out[k].nes, out[k].p_value) == pytest.approx(brute_null(genes, list(ws), 200, ws), abs=1e-9)
        assert out[k].fdr >= out[k].p_value


def test_batch_correlation_counts_pairs_without_a_common_gene(spark):
    x = np.array([[1, 2, 0, 0, 0, 0], [2, 1, 0, 1, 0, 0], [0, 0, 3, 1, 0, 0], [0, 0, 0, 0, 5, 2]], float)
    batch = ["p", "p", "q", "q"]
    values = frame(spark, [(i, j, float(v)) for i, r in enumerate(x) for j, v in enumerate(r) if v], "sample int, gene int, value double")
    got = {r.same_batch: (r.n_pairs, r.mean_r) for r in expression.batch_correlation(values, frame(spark, list(enumerate(batch)), "sample int, batch string"), 6).collect()}
    r = np.corrcoef(x)
    for same in (True, False):
        want = [r[i, j] for i in range(4) for j in range(i + 1, 4) if (batch[i] == batch[j]) == same]
        assert got[same][0] == len(want) and got[same][1] == pytest.approx(np.mean(want), abs=1e-9)
    assert len(got) == 2


def test_repeats_keep_the_largest_absolute_score(spark):
    r = gsea.ranking(frame(spark, [("a", 1.0), ("a", -3.0), ("a", 3.0), ("b", 2.0)], "gene string, score double"), [])
    assert one(r.orderBy("rank_no"), "gene", "score", "rank_no") == [("a", 3.0, 1), ("b", 2.0, 2)]


def test_single_sample_scores_against_a_dense_walk(spark):
    rng = np.random.default_rng(5)
    x = np.where(rng.random((5, 30)) < 0.4, rng.integers(1, 9, (5, 30)), 0).astype(float)
    own = {"s1": [0, 3, 9, 20, 21], "s2": [1, 2, 29]}
    values = frame(spark, [(i, j, float(v)) for i, row in enumerate(x) for j, v in enumerate(row) if v], "sample int, gene int, value double")
    m = frame(spark, [(k, g) for k, gs in own.items() for g in gs], "set_name string, gene int")
    hit = gsea.sample_hits(values, "sample", m, "set_name", 30)
    ss = {(r.sample, r.set_name): r.score for r in gsea.ssgsea(hit, "sample", "set_name").collect()}
    au = {(r.sample, r.set_name): r.score for r in gsea.aucell(hit, "sample", "set_name", 0.2).collect()}
    for i, row in enumerate(x):
        for k, gs in own.items():
            # zeros rank last; among them the set's genes come last, where they change nothing
            order = sorted(range(30), key=lambda j: (-row[j], j) if row[j] else (0, 100 * (j in gs) + j))
            total = sum(row[g] ** 0.25 for g in gs if row[g])
            if not total:
                continue
            cum, curve, auc, found = 0.0, [], 0.0, 0
            for place, j in enumerate(order):
                cum += row[j] ** 0.25 / total if j in gs and row[j] else (0 if j in gs else -1 / (30 - len(gs)))
                curve.append(cum)
                found += j in gs and row[j] > 0
                auc += found if place < 6 else 0
            assert ss[i, k] == pytest.approx(max(curve) + min(curve), abs=1e-9)
            assert au[i, k] == pytest.approx(auc / (min(len(gs), 6) * 6 - min(len(gs), 6) * (min(len(gs), 6) - 1) / 2))


# expression


def test_two_group_test_finds_the_shifted_gene(spark):
    rng = np.random.default_rng(1)
    rows = [(s, g, float(rng.poisson(5) + (12 if g == 0 and s < 6 else 0) + 1)) for s in range(12) for g in range(8)]
    samples = frame(spark, [(s, "A" if s < 6 else "B") for s in range(12)], "sample int, grp string")
    de = expression.two_group_test(frame(spark, rows, "sample int, gene int, value double"), samples, ("A", "B")).orderBy("p_value").collect()
    assert de[0].gene == 0 and de[0].p_value < 1e-4 and all(r.fdr >= r.p_value - 1e-12 for r in de)
    a = [v for s, g, v in rows if g == 3 and s < 6]
    b = [v for s, g, v in rows if g == 3 and s >= 6]
    t = (np.mean(a) - np.mean(b)) / math.sqrt(np.var(a, ddof=1) / 6 + np.var(b, ddof=1) / 6)
    assert next(r.t for r in de if r.gene == 3) == pytest.approx(t)


def test_rank_sums_with_implied_zeros(spark):
    rng = np.random.default_rng(2)
    x = np.where(rng.random((9, 4)) < 0.5, rng.integers(1, 4, (9, 4)), 0)
    x[0] = 1
    grp = ["a" if i < 4 else "b" for i in range(9)]
    values = frame(spark, [(i, j, float(v)) for i, r in enumerate(x) for j, v in enumerate(r) if v], "sample int, gene int, value double")
    got = {(r.grp, r.gene): r.z for r in expression.rank_sums(values, frame(spark, list(enumerate(grp)), "sample int, grp string")).collect()}
    for (g, j), z in got.items():
        col = x[:, j]
        ranks = np.array([(col < v).sum() + ((col == v).sum() + 1) / 2 for v in col])
        inside = np.array([k == g for k in grp])
        n, a, b = 9, inside.sum(), (~inside).sum()
        _, c = np.unique(col, return_counts=True)
        var = a * b / 12 * (n + 1 - (c**3 - c).sum() / (n * (n - 1)))
        assert z == pytest.approx((ranks[inside].sum() - a * (n + 1) / 2) / math.sqrt(var) if var else 0.0)


def test_empty_library_gives_zero(spark):
    out = expression.log_cpm(frame(spark, [(1, 1, 0.0), (2, 1, 3.0)], "sample int, gene int, value double"))
    assert {r.sample: round(r.value, 6) for r in out.collect()} == {1: 0.0, 2: round(math.log1p(1e6), 6)}


# vectors and networks


def vectors(spark, n=30, d=6, seed=0):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(0, 0.2, (n // 3, d)) + 2 * np.eye(d)[k] for k in range(3)])
    return x, frame(spark, [(i, int(i // (n // 3)), v.tolist()) for i, v in enumerate(x)], "gene long, label int, v array<double>")


def test_neighbours_equal_brute_force_in_any_block_size(spark):
    x, df = vectors(spark)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 12)
    np.fill_diagonal(s, -2)
    want = {(i, int(j)) for i in range(30) for j in sorted(range(30), key=lambda j: (-s[i, j], j))[:4]}
    for rows in (7, 1000):
        got = {(r.src, r.dst) for r in embed.neighbours(df.select("gene", "v"), 4, rows).collect()}
        assert got == want


def test_soft_rows_sum_to_one_and_diffusion(spark):
    x, df = vectors(spark)
    total = embed.soft_membership(df).groupBy("gene").agg(F.sum("weight").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-9 for r in total)
    knn = embed.neighbours(df.select("gene", "v"), 3)
    t = np.zeros((30, 30))
    for r in knn.collect():
        t[r.src, r.dst] = r.weight
    t /= t.sum(1, keepdims=True)
    want = x
    for _ in range(2):
        want = 0.5 * want + 0.5 * t @ want
    got = {r.gene: r.v for r in embed.diffuse(df.select("gene", "v"), knn, 2).collect()}
    assert np.allclose([got[i] for i in range(30)], want)


def test_communities_find_planted_groups(spark):
    rows = [(a + 10 * g, b + 10 * g, 1.0) for g in range(3) for a in range(10) for b in range(a + 1, 10)] + [(0, 10, 0.1), (10, 20, 0.1)]
    edges = frame(spark, rows, "src long, dst long, weight double")
    got = discover.communities(edges)
    assert {frozenset(r.g) for r in got.groupBy("label").agg(F.collect_list("gene").alias("g")).collect()} == {frozenset(range(k, k + 10)) for k in (0, 10, 20)}
    q = discover.modularity(edges, got.select("gene", "label")).first()[0]
    assert q > 0.6


def test_pagerank_prefers_the_hub(spark):
    edges = frame(spark, [(0, i, 1.0) for i in range(1, 6)], "src long, dst long, weight double")
    got = dict(discover.pagerank(edges).collect())
    assert got[0] == 1.0 and all(got[i] == pytest.approx(0.0, abs=1e-9) for i in range(1, 6))
    central = dict(discover.eigenvector_centrality(edges).collect())
    assert central[0] == 1.0


def test_factor_programs_recover_blocks(spark):
    rows = [(s, f"g{g}", 5.0) for s in range(20) for g in range(10) if (s < 10) == (g < 5)]
    got = discover.factor_programs(frame(spark, rows, "sample int, gene string, value double"), 2, 5, 30)
    groups = {frozenset(r.g) for r in got.groupBy("program").agg(F.collect_set("gene").alias("g")).collect()}
    assert groups == {frozenset(f"g{i}" for i in range(5)), frozenset(f"g{i}" for i in range(5, 10))}


def test_principal_components_match_numpy(spark):
    x, df = vectors(spark)
    c = x - x.mean(0)
    _, sv, _ = np.linalg.svd(c, full_matrices=False)
    got = np.array([r.v for r in sorted(embed.principal_components(df.select("gene", "v"), 3).collect(), key=lambda r: r.gene)])
    assert np.allclose(np.linalg.norm(got, axis=0), sv[:3])


def test_cooccurrence_counts_a_method_once(spark):
    m = frame(spark, [("a", "p", "x"), ("a", "p", "y"), ("a", "q", "x"), ("a", "q", "y"), ("b", "p", "x"), ("b", "p", "z")], "method string, program string, gene string")
    w = frame(spark, [("a", 0.7), ("b", 0.3)], "method string, weight double")
    assert sorted(one(discover.cooccurrence(m, w), "src", "dst", "weight")) == [("x", "y", 0.7), ("x", "z", 0.3)]


# annotation and validation


def test_labels(spark):
    df = frame(spark, [("SRC::GOBP_AXON-GROWTH pathway",), ("KEGG_X",), ("a::***",), ("WP_SET",), ("plain",)], "n string")
    n = F.col("n")
    rows = one(df, labels.source_of(n), labels.program_label(n), labels.family_key(n), labels.relevance(n))
    assert rows[0] == ("SRC", "GOBP_AXON_GROWTH_pathway", "AXON GROWTH", 3.0)
    assert rows[1][:3] == ("KEGG", "KEGG_X", "X") and rows[2][:3] == ("a", "Annotated", "") and rows[2][3] == -4.0
    assert rows[3][2] == "SET" and rows[4][0] == "OTHER"


def test_claim_gates_and_null_stability(spark):
    e = frame(spark, [("p", 0.01, None), ("q", 0.01, False), ("r", 0.5, True)], "program string, fdr double, gate_stability boolean")
    m = programs(spark, {k: [f"{k}{i}" for i in range(10)] for k in "pqr"})
    ch = frame(spark, [(f"{k}{i}", 0.5) for k in "pqr" for i in range(10)], "gene string, change double")
    got = {r.program: r.claim_supported for r in annotate.claim_gates(e, m, ch, ["program"]).collect()}
    assert got == {"p": True, "q": False, "r": False}


def test_robustness_case(spark):
    base = programs(spark, {"p1": "ABC", "p2": "DE"}).withColumn("run", F.lit("v"))
    var = programs(spark, {"q1": "ABC", "q2": "DF"}).withColumn("run", F.lit("v"))
    s = validate.pairwise_stability(base, var, ["run"]).first()
    assert s.baseline_mean == pytest.approx(2 / 3)
    m = frame(spark, [("v", True, True, 1.0), ("v", True, False, 1 / 3)], "run string, baseline_claim_supported boolean, perturbation_claim_supported boolean, best_match_jaccard double")
    c = validate.claim_retention(m, ["run"]).first()
    assert c.claim_jaccard == 0.5 and c.claim_retention == 0.5
    xy = frame(spark, [(1, 2.0, 4.0), (1, 4.0, 8.0), (2, 1.0, 1.0), (3, 1.0, 1.0), (3, 1.0, 2.0)], "k int, x double, y double")
    r = {q.k: q.r for q in xy.groupBy("k").agg(validate.safe_corr("x", "y").alias("r")).collect()}
    assert r[1] == pytest.approx(1.0) and r[2] is None and r[3] is None


def test_evidence_levels(spark):
    rows = [("ok", 10, 8, 0.01, 1.0, 0.5, 1.5, "greater"), ("bad_ci", 10, 8, 0.01, 1.0, -0.5, 1.5, "greater"), ("few", 2, 0, 0.01, 0.0, -1.0, 1.0, "greater"), ("weak", 10, 8, 0.9, 1.0, 0.5, 1.5, "two-sided"), ("null", None, None, None, None, None, None, "less")]
    df = frame(spark, rows, "m string, n_pairs int, n_non_ties int, fdr double, delta_mean double, ci_low double, ci_high double, alternative string")
    got = {r.m: (r.supported, r.risk_level, r.risk_reason) for r in validate.evidence_gates(df, 5, 5, 0.05).collect()}
    assert got["ok"] == (True, "none", "none") and got["bad_ci"] == (False, "high", "ci_direction_fail")
    assert got["few"][1] == "medium" and "no_non_ties" in got["few"][2] and got["weak"] == (False, "low", "fdr_fail") and got["null"][1] == "medium"


def test_report_frames(spark):
    df = frame(spark, [("p", "g", 0.7, 0.3, 0.01)], "program string, gene string, prob_a double, prob_b double, p_value double")
    r = report.ensured_metrics(df).first()
    assert r.context_shift == pytest.approx(0.4) and r.context_evidence == pytest.approx(0.8) and r.signed_significance == pytest.approx(2.0)
    g = frame(spark, [(True,), (None,), (False,)], "g boolean")
    assert one(report.gate_summary(g, ["g"]), "n_tested", "n_passed", "rate") == [(2, 1, 0.5)]


def test_md5_of_many_texts():
    for texts in ([str(i).encode() for i in range(9000)], [b"x" * i for i in range(80)], []):
        for prefix in (b"42|1000|", b"", b"y" * 50):
            want = [hashlib.md5(prefix + t).hexdigest() for t in texts]
            assert ["%016x%016x" % x for x in zip(*(x.tolist() for x in Texts(texts).md5(prefix)))] == want


def test_resampled_means_follow_the_draws_without_a_broadcast(spark, monkeypatch):
    groups = {"a": [0.5, 0.1, 0.9], "b": [0.25], "c": [i / 7 for i in range(40)]}
    df = frame(spark, [(g, x) for g, v in groups.items() for x in v] + [("a", None), (None, 2.0)], "g string, v double")
    for kept in (4_000_000, 100):  # draws kept, and made anew for a large group
        monkeypatch.setattr(validate, "_KEPT_DRAWS", kept)
        out = validate.resampled_means(df, ["g"], "v", 20)
        assert "Broadcast" not in out._jdf.queryExecution().toString() and "Join" not in out._jdf.queryExecution().toString()
        got = {r.g: r for r in out.collect()}
        assert got[None].mean == 2.0 and len(got) == 4
        for g, v in groups.items():
            v = sorted(v)
            m = [np.mean([v[int(hashlib.md5(f"42|{b}|{i}".encode()).hexdigest()[:12], 16) % len(v)] for i in range(len(v))]) for b in range(1, 21)]
            assert np.allclose((got[g].ci_low, got[g].ci_high, got[g]["mean"]), (*np.quantile(m, (0.025, 0.975)), np.mean(m)))


def test_permuted_match_shuffles_no_permutation(spark):
    rng = np.random.default_rng(3)
    members = {p: rng.choice(60, size, replace=False).tolist() for p, size in (("a", 9), ("b", 20), ("c", 5), ("d", 12))}
    curated = {f"s{i}": rng.choice(70, 15, replace=False).tolist() for i in range(6)}
    df, cu = programs(spark, {p: map(str, g) for p, g in members.items()}), programs(spark, {p: map(str, g) for p, g in curated.items()}).withColumnRenamed("program", "set_name")

    def mean_best(groups):
        return np.mean([max((len(g & set(c)) / len(g | set(c)) for c in curated.values()), default=0) for g in map(set, groups) if g])

    for universe in (60, 40):  # the second is too small for all programs
        order = [sorted(range(universe), key=lambda g: hashlib.md5(f"42|{b}|{g}".encode()).hexdigest()) for b in range(1, 31)]
        ends = np.cumsum([len(members[p]) for p in "abcd"])
        null = [mean_best([o[e - len(members[p]) : e] for p, e in zip("abcd", ends)]) for o in order]
        out = evaluate.permuted_match(df, cu, spark.range(universe).select(F.col("id").cast("string").alias("gene")), 30)
        assert "windowspecdefinition(perm" not in out._jdf.queryExecution().optimizedPlan().toString()
        got, observed = out.first(), mean_best(members.values())
        assert np.allclose(tuple(got), (observed, np.mean(null), np.std(null), max(np.mean(np.array(null) >= observed), 1 / 31), (observed - np.mean(null)) / np.std(null)))
