from itertools import combinations

import numpy as np
import pytest

from genoloom.operators import packed, sets
from genoloom.plans import pipeline


def jaccard(a, b):
    return len(a & b) / len(a | b)


@pytest.fixture(scope="module")
def programs():
    rng = np.random.default_rng(5)
    return {(m, f"p{i}"): set(rng.choice(40, rng.integers(1, 12), replace=False).tolist()) for m, n in (("a", 50), ("b", 7), ("c", 1)) for i in range(n)}


@pytest.mark.parametrize(("block", "small"), [(8_192, 200_000), (9, 0)])
def test_tables_match_all_pairs(spark, monkeypatch, programs, block, small):
    def no_pair_rows(*_):
        raise AssertionError("pairs of programs became rows")

    monkeypatch.setattr(sets, "mean_pairwise_jaccard", no_pair_rows)
    monkeypatch.setattr(packed, "BLOCK", block)
    monkeypatch.setattr(packed, "_CELLS", 128)
    monkeypatch.setattr(sets, "SMALL_ROWS", small)
    rng = np.random.default_rng(6)
    refs = {(c, f"r{i}"): set(rng.choice(80, 9, replace=False).tolist()) for c, n in (("x", 5), ("y", 3), ("none", 0)) for i in range(n)} | {("none", "r"): {1000}}
    m = spark.createDataFrame([(*k, str(g)) for k, gs in programs.items() for g in gs] * 2, "method string, program string, gene string")
    r = spark.createDataFrame([(*k, str(g)) for k, gs in refs.items() for g in gs], "c string, set_name string, gene string")
    got = {(x.method, x.c): x for x in packed.tables(m, r, ["c"]).collect()}
    assert len(got) == 9
    for (method, c), x in got.items():
        own, ref = [g for k, g in programs.items() if k[0] == method], [g for k, g in refs.items() if k[0] == c]
        every, rows = set().union(*ref), [g for p in own for g in p]
        pairs = [jaccard(a, b) for a, b in combinations(own, 2)]
        want = (len(own), np.mean(pairs) if pairs else 0, 1 - np.mean([g in every for g in rows]), np.mean([np.mean([rows.count(g) == 1 for g in p]) for p in own]), len(set(rows) & every) / len(every), np.mean([max(jaccard(p, q) for q in ref) for p in own]))
        assert np.allclose((x.n_programs, x.redundancy, x.novelty, x.specificity, x.coverage, x.alignment), want)
    whole = pipeline.method_table(m, r.where("c = 'x'"))
    assert whole.columns == ["method", "n_programs", "redundancy", "novelty", "specificity", "coverage", "alignment"]
    assert {x.method: round(x.alignment, 9) for x in whole.collect()} == {k[0]: round(x.alignment, 9) for k, x in got.items() if k[1] == "x"}
