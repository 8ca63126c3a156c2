import random

import numpy as np
from pyspark.sql import functions as F

from genoloom.llm import setjoin

LISTS, REF = "list_id long, genes string, size string, items string, class_id int", "set_id long, gene string, id string"


def data(seed):
    rng = random.Random(seed)
    lists, ref = [], []
    for i in range(60):
        base = [f"G{rng.randrange(400)}" for _ in range(rng.randint(3, 25))]
        for j in range(rng.randint(1, 4)):
            own = [g for g in base if rng.random() < 0.92] + [f"N{rng.randrange(400)}"] * rng.randint(0, 2)
            text = rng.choice([",", ", ", " ,\t"]).join(rng.choice([g, g.lower()]) for g in own) + rng.choice(["", ",", ", ,"])
            lists += [(1000 + i * 10 + j, text, "c", "c", 1)] * rng.choice([1, 1, 2])
        if rng.random() < 0.5:
            ref += [(i, rng.choice([g, g.lower() + " "]), "c") for g in base] + [(i, None, "c"), (i, base[0], "c")]
    lists += [(5000, None, "c", "c", 1), (5001, "", "c", "c", 1), (5002, " , ,", "c", "c", 1), (5003, ",".join(f"L{k}" for k in range(5000)), "c", "c", 1), (5004, ",".join(f"L{k}" for k in range(4000)), "c", "c", 1), (None, "x", "c", "c", 1)]
    return lists, ref


def brute(lists, ref, t=0.6):
    sets = {}
    for i, text, *_ in lists:
        if i is not None:
            sets.setdefault((i, True), set()).update(g.strip().upper() for g in (text or "").split(",") if g.strip())
    for i, g, _ in ref:
        if g and g.strip():
            sets.setdefault((i, False), set()).add(g.strip().upper())
    keys = sorted(sets)
    out = set()
    for x, a in enumerate(keys):
        for b in keys[x + 1 :]:
            if (a[1] or b[1]) and sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b]):
                out.add((a[0], b[0]))
    return out


def test_pairs_equal_brute_force(spark, monkeypatch):
    # all neighbourhoods small, all large, and all cut by rare items and in blocks
    for seed, block, small in ((1, 2000, 64), (2, 2000, 1), (3, 5, 4)):
        monkeypatch.setattr(setjoin, "BLOCK", block)
        monkeypatch.setattr(setjoin, "SMALL", small)
        monkeypatch.setattr(setjoin.blocked, "__defaults__", (block,))
        lists, ref = data(seed)
        got = setjoin.similar_sets(spark.createDataFrame(lists, LISTS), spark.createDataFrame(ref, REF)).collect()
        assert len(got) == len({(r.id_a, r.id_b) for r in got})
        assert {(r.id_a, r.id_b) for r in got} == brute(lists, ref)


def sets_of(seed, n=120):
    rng = random.Random(seed)
    base = [f"B{i}" for i in range(20)]
    return [sorted({*(g for g in base if rng.random() < 0.9), *(f"N{rng.randrange(500)}" for _ in range(3))}) for _ in range(n)]


def classes_of(spark, sets):
    rows = [(i, True, s) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "class_id long, has_list boolean, items array<string>")
    return df.withColumn("hashes", F.transform("items", lambda x: F.xxhash64(x)))


def test_repeats_of_large_neighbourhoods_stay_in_their_tasks(spark, monkeypatch):
    for block, small in ((2000, 1), (30, 1)):
        monkeypatch.setattr(setjoin, "BLOCK", block)
        monkeypatch.setattr(setjoin.blocked, "__defaults__", (block,))
        sets = sets_of(5)
        classes = classes_of(spark, sets)
        nodes = setjoin.with_hashes(setjoin.forest(classes, 0.6, 3, 5), classes)
        out = [nodes.mapInArrow(setjoin._verified(0.6, d, d == 5), "a long, b long, k int, t int").collect() for d in (5, 4, 3)]
        got = [(r.a, r.b) for rows in out for r in rows]
        want = {(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets) if i < j and 5 * len({*x} & {*y}) >= 3 * len({*x, *y})}
        assert set(got) == want and len(got) == len(want)


def test_the_forest_is_sorted_and_levels_part_the_pairs(spark):
    classes = classes_of(spark, sets_of(6, 60))
    nodes = setjoin.forest(classes, 0.6, 2, 4).collect()
    assert nodes and all(r.labels == sorted(r.labels) and len({x[:5] for x in r.labels}) == 1 for r in nodes)
    pairs = {}
    for r in nodes:
        for i, a in enumerate(r.ids):
            for j in range(i + 1, len(r.ids)):
                x, y = r.labels[i], r.labels[j]
                level = next((d for d in (4, 3, 2) if x[: 1 + 2 * d] == y[: 1 + 2 * d]))
                if min(r.sizes[i], r.sizes[j]) >= 0.6 * max(r.sizes[i], r.sizes[j]):
                    pairs.setdefault(level, set()).add((r.labels[i][0], *sorted((a, r.ids[j]))))
    df = spark.createDataFrame(nodes, setjoin.NODE)
    for level in (4, 3, 2):
        found = df.mapInArrow(setjoin._candidates(0.6, level, level == 4), "a long, b long").distinct().collect()
        assert {tuple(r) for r in found} == {p[1:] for p in pairs[level]}


def test_measured_recall(spark):
    pairs = spark.createDataFrame([(1, 2, 6, 16), (3, 4, 9, 19)], "a long, b long, k int, t int")
    p = [setjoin.chance(s, 4) for s in (0.6, 0.9)]
    missed = sum((1 - x) / x for x in p)
    want = 3 / (3 + missed + (1 - p[0]) / p[0])
    assert abs(setjoin.measured_recall(pairs, 0.6, 4) - want) < 1e-12
    assert setjoin.measured_recall(pairs.limit(0), 0.6, 4) == 1 / (1 + (1 - p[0]) / p[0])


def test_overlaps_both_ways(monkeypatch):
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40))).astype(np.uint64) for _ in range(50)]
    sizes = np.array([len(x) for x in sets])
    flat, starts = np.concatenate(sets), np.cumsum(sizes) - sizes
    i, j = np.triu_indices(50, 1)
    want = [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j)]
    assert setjoin._overlaps(flat, sizes, starts, i, j).tolist() == want
    assert setjoin._overlaps(flat, sizes, starts, i[:3], j[:3]).tolist() == want[:3]


def test_summary_counts_links_between_different_sets(spark):
    lists = [(1, "a,b,c", "", "", 0), (2, "A, b,c ", "", "", 0), (3, "a,b,c,d", "", "", 0), (4, "z", "", "", 0)]
    out = {r["id"]: (r["n_copies"], r["n_links"]) for r in setjoin.set_summary(spark.createDataFrame(lists, LISTS), spark.createDataFrame([], REF)).collect()}
    assert out == {1: (2, 1), 2: (2, 1), 3: (1, 1), 4: (1, 0)}


def test_ids_of_any_size(spark):
    big = 2**63 - 1
    lists = [(big, "a,b", "", "", 0), (-big, "a,b", "", "", 0), (big - 1, "a,b,c", "", "", 0)]
    got = setjoin.similar_sets(spark.createDataFrame(lists, LISTS), spark.createDataFrame([], REF)).collect()
    assert {(r.id_a, r.id_b) for r in got} == {(-big, big), (-big, big - 1), (big - 1, big)}


def test_empty(spark):
    assert setjoin.similar_sets(spark.createDataFrame([], LISTS), spark.createDataFrame([], REF)).count() == 0


def test_depth_reaches_the_target():
    for t in (0.5, 0.6, 0.8, 0.95):
        d = setjoin.search_depth(t)
        assert d == 1 or 1 - (1 - t**d) ** setjoin.TREES >= setjoin.TARGET
