import random
from collections import defaultdict

import numpy as np

from genoloom.llm import clusters


def brute(sets, t=0.5):
    names = sorted(sets)
    root = {n: n for n in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]):
                root[find(b)] = find(a)
    return {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if find(a) == find(b)}


def families(seed, n_families=40, size=5):
    rng, sets = random.Random(seed), {}
    genes = [f"G{i}" for i in range(600)]
    for f in range(n_families):
        base = rng.sample(genes, rng.randint(4, 14))
        for m in range(rng.randint(1, size)):
            own = [g for g in base if rng.random() < 0.9] + rng.sample(genes, rng.randint(0, 2)) + ["HOT"]
            sets[f"p{f:03d}_{m}"] = set(own)
    return sets


def frame(spark, sets):
    rows = [(1, p, g, None, 7) for p, gs in sets.items() for g in gs]
    random.Random(0).shuffle(rows)
    # columns with the names that the operator uses inside
    return spark.createDataFrame(rows, "run_id long, program string, gene string, class_id string, cell int")


def test_pairs_equal_brute_force(spark):
    sets = families(3)
    got = {tuple(r) for r in clusters.cluster_pairs(frame(spark, sets)).collect()}
    assert got == brute(sets)


def test_large_cells_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(clusters, "BLOCK", 15)
    sets = families(5)
    got = {tuple(r) for r in clusters.cluster_pairs(frame(spark, sets)).collect()}
    assert got == brute(sets)


def test_pairs_that_share_no_cell(spark):
    # 10 genes that a third of all programs hold and 5 own rare ones each: Jaccard 0.5, hardly any cosine
    rng, sets = random.Random(11), {}
    common = [f"C{i}" for i in range(30)]
    for i in range(300):
        shared = rng.sample(common, 10)
        for side in "ab":
            sets[f"p{i:03d}{side}"] = {*shared, *(f"R{i}{side}{j}" for j in range(5))}
    got = {tuple(r) for r in clusters.cluster_pairs(frame(spark, sets)).collect()}
    assert got == brute(sets) and len(got) >= 300


def test_dirty_rows(spark):
    rows = [
        (1, " a\t", "x1"), (1, "a", " X1 "), (1, "a", "x2"), (1, "b", "X1"), (1, "b", "x2"), (1, None, "x1"), (1, "c", None), (1, "d", "  "), (1, "e", "y"),
    ]
    df = spark.createDataFrame(rows, "run_id long, program string, gene string")
    assert {tuple(r) for r in clusters.cluster_pairs(df).collect()} == {("a", "b")}
    runs = spark.createDataFrame([(1, 9), (1, 9)], "run_id long, n_programs int")
    report = {r["cluster"]: r for r in clusters.cluster_report(df, runs).collect()}
    assert report["a"]["size"] == 2 and report["a"]["typical_programs"] == "a,b" and report["a"]["asked_programs"] == 9
    assert report["e"]["size"] == 1


def test_empty(spark):
    df = spark.createDataFrame([], "run_id long, program string, gene string")
    assert clusters.cluster_pairs(df).count() == 0


def test_spanning_links_match_brute_force():
    for seed in range(6):
        sets = families(seed, 25, 8)
        names = sorted(sets)
        code = {g: i for i, g in enumerate(sorted({g for s in sets.values() for g in s}))}
        sizes = np.array([len(sets[n]) for n in names])
        items = np.concatenate([np.array(sorted(code[g] for g in sets[n])) for n in names])
        label = clusters.spanning_links(sizes, items, 0.5)
        groups = defaultdict(list)
        for n, l in zip(names, label):
            groups[l].append(n)
        got = {(a, b) for g in groups.values() for i, a in enumerate(g) for b in g[i + 1 :]}
        assert got == brute(sets)


def test_a_family_larger_than_a_posting_width():
    # 200 near copies: settled by the first pass, with all pairs in one group
    rng = np.random.default_rng(1)
    rows = [np.unique(np.r_[np.arange(20), rng.integers(100, 10_000, 2)]) for _ in range(200)]
    label = clusters.spanning_links(np.array([len(r) for r in rows]), np.concatenate(rows), 0.5)
    assert (label == 0).all()


def test_chain_over_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7)], "u long, v long")
    got = dict(clusters.components(links).collect())
    assert all(got[i] == 0 for i in range(1, 41)) and got[102] == 100


def test_large_cells_are_divided_without_losing_a_link(spark, monkeypatch):
    monkeypatch.setattr(clusters, "BLOCK", 6)
    for seed in (11,):
        sets = families(seed, 25, 8)
        assert {tuple(r) for r in clusters.cluster_pairs(frame(spark, sets)).collect()} == brute(sets)
    rows = [(i, [1, 2, 3 + i], [0]) for i in range(40)]
    assigned = spark.createDataFrame(rows, "class_id long, hashes array<long>, cells array<int>")
    parts = clusters.cell_entries(assigned, 6).groupBy("cell", "part").count().collect()
    assert sum(r["count"] for r in parts) == 40 * clusters.SPLITS and max(r["count"] for r in parts) <= 20
    assert clusters.cell_entries(assigned, 40).count() == 40


def test_typical_members_are_nearest_the_weighted_centroid(spark):
    # "hot" is in every program and weighs little; x1 and x2 hold the cluster's own genes
    sets = {"x1": {"a", "b", "c", "hot"}, "x2": {"a", "b", "c", "hot", "d"}, "x3": {"a", "b", "hot", "e"}, **{f"z{i}": {"hot", f"q{i}", f"r{i}"} for i in range(30)}}
    runs = spark.createDataFrame([], "run_id long, n_programs int")
    report = {r["cluster"]: r for r in clusters.cluster_report(frame(spark, sets), runs).collect()}
    assert report["x1"]["size"] == 3 and report["x1"]["typical_programs"].split(",")[0] == "x1"
    w = {g: np.log((len(sets) + 1) / sum(g in s for s in sets.values())) for s in sets.values() for g in s}
    unit = {n: {g: w[g] / sum(w[h] ** 2 for h in sets[n]) ** 0.5 for g in sets[n]} for n in ("x1", "x2", "x3")}
    close = {n: sum(u * sum(o.get(g, 0) for o in unit.values()) for g, u in unit[n].items()) for n in unit}
    assert report["x1"]["typical_programs"].split(",") == sorted(close, key=lambda n: (-round(close[n], 6), n))
