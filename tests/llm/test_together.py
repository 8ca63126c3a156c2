import random
from collections import Counter
from itertools import combinations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from genoloom.llm import together


def brute(rows, runs, least=4, lift=3):
    ens = {r: e for r, e in runs if e is not None and r is not None}
    recs = {}
    for run, p, g in rows:
        if run in ens and p and p.strip() and g and g.strip():
            recs.setdefault((ens[run], p.strip()), set()).add(g.strip().upper())
    out = set()
    for e in {k[0] for k in recs}:
        own = [v for k, v in recs.items() if k[0] == e]
        n = Counter(g for v in own for g in v)
        ab = Counter(p for v in own for p in combinations(sorted(v), 2))
        out |= {(e, a, b, k, n[a], n[b], len(own)) for (a, b), k in ab.items() if k >= least and k * len(own) >= lift * n[a] * n[b]}
    return out


def data(seed):
    rng = random.Random(seed)
    rows, runs = [], []
    for run in range(60):
        runs += [(run, rng.choice([1, 1, 1, 2, None]))] * rng.randint(1, 2)
        for p in range(4):
            block = rng.randrange(12)
            genes = [f"b{block}_{i}" for i in range(5)] + ["hot"] + [f"r{rng.randrange(80)}" for _ in range(4)]
            rows += [(run, f"r{run}_{p}", rng.choice([g, g.upper(), f" {g}\t"])) for g in genes for _ in range(rng.choice([1, 1, 2]))]
    rows += [(1, None, "x"), (1, " ", "x"), (1, "r1_0", None), (999, "lost", "hot"), (None, "n", "hot")]
    return rows, runs


def test_pairs_equal_brute_force(spark, monkeypatch):
    for seed, part in ((1, 512), (2, 3)):
        monkeypatch.setattr(together, "SLICE", part)
        rows, runs = data(seed)
        a = spark.createDataFrame(rows, "run_id long, program string, gene string").selectExpr("*", "'x' as scope", "1 as code", "2 as n")
        b = spark.createDataFrame(runs, "run_id long, ensemble_id long").selectExpr("*", "'y' as gene")
        found = together.gene_pairs(a, b)
        got = {tuple(r) for r in found.select("ensemble_id", "gene_a", "gene_b", "n_ab", "n_a", "n_b", "n_programs").collect()}
        assert got and got == brute(rows, runs)
        assert all(r["odds_ratio"] > 1 for r in found.collect())


def test_empty(spark):
    a = spark.createDataFrame([], "run_id long, program string, gene string")
    assert together.gene_pairs(a, spark.createDataFrame([], "run_id long, ensemble_id long")).count() == 0


def test_runs_span_batches():
    batch = lambda c, n: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(n, pa.int32())], ["code", "n"])
    out = list(together._run_lengths(iter([batch([1, 1, 2], [1, 2, 1]), batch([], []), batch([2, 2], [5, 1]), batch([2, 9], [1, 4])])))
    assert {k: v for b in out for k, v in zip(b.column("code").to_pylist(), b.column("n_ab").to_pylist())} == {1: 3, 2: 8, 9: 4}


def test_slices_of_one_record_go_to_many_tasks(spark):
    ids = list(range(0, 6000, 2))
    rows = spark.createDataFrame([(1, "r", ids)], "scope long, record string, ids array<long>")
    cut = together.spread_slices(rows, 4, 512)
    got = cut.withColumn("task", F.spark_partition_id()).collect()
    assert len(got) == 6 and len({r.task for r in got}) >= 3
    assert sorted(r.ids[0] for r in got) == ids[::512] and all(r.ids[-1] == ids[-1] for r in got)


def test_a_huge_record_beside_small_ones(spark, monkeypatch):
    # one program with 700 genes in runs of 10,000 codes: its pairs count once, a few of them again in small programs
    monkeypatch.setattr(together, "RUN_CODES", 10_000)
    rows = [(1, "huge", f"g{i}") for i in range(700)] + [(1, f"p{j}", f"g{i}") for j in range(3) for i in (1, 2, 650)] + [(1, f"q{j}", f"z{j}") for j in range(60)]
    a = spark.createDataFrame(rows, "run_id long, program string, gene string")
    got = {tuple(r) for r in together.gene_pairs(a, spark.createDataFrame([(1, 5)], "run_id long, ensemble_id long")).select("ensemble_id", "gene_a", "gene_b", "n_ab", "n_a", "n_b", "n_programs").collect()}
    assert got == brute(rows, [(1, 5)]) and len(got) == 3


def test_codes_that_would_collide_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(together, "CODES", 10)
    rows, runs = data(1)
    a, b = spark.createDataFrame(rows, "run_id long, program string, gene string"), spark.createDataFrame(runs, "run_id long, ensemble_id long")
    with pytest.raises(ValueError, match="usable items"):
        together.gene_pairs(a, b)
