import math
import random

from genoloom.llm import topn

SCHEMA = "row_id long, run_id long, program string, gene string, context_evidence double, loaded_at timestamp, rank_no string, score string"


def brute(rows, n):
    from datetime import datetime

    cur = {}
    for i, run, p, g, e, at, *_ in rows:
        if p is None or g is None or not p.strip() or not g.strip() or e is None or not math.isfinite(e):
            continue
        k = (p.strip(), run, g.strip().upper())
        v = (at or datetime.min, i, e)
        if k not in cur or v[:2] > cur[k][:2]:
            cur[k] = v
    out = {}
    for (p, run, g), (_, _, e) in cur.items():
        out.setdefault(p, []).append((-e, g.encode(), run is None, run or 0, run, g))
    return {(p, r[4], r[5], k) for p, v in out.items() for k, r in enumerate(sorted(v)[:n], 1)}


def rows(seed, n=600):
    from datetime import datetime

    rng = random.Random(seed)
    out = []
    for i in range(n):
        p = rng.choice(["hot", "hot ", "\thot", "a", "b", "c ", None, "  "])
        e = rng.choice([1.0, 2.0, -3.5, 0.0, -0.0, float("nan"), float("inf"), None, rng.random()])
        at = rng.choice([None, datetime(2024, 1, rng.randint(1, 9))])
        out.append((i, rng.choice([None, 1, 2, 3]), p, rng.choice(["x", "X ", "é", "z", "zz", None, ""] + [f"g{j}" for j in range(30)]), e, at, "clash", "clash"))
    return out


def test_cold_and_hot_groups_equal_brute_force(spark):
    data = rows(1)
    df = spark.createDataFrame(data, SCHEMA)
    for heavy in (10**9, 20, 0):
        got = {tuple(r) for r in topn.top_genes(df, 10, heavy_rows=heavy).collect()}
        assert got == brute(data, 10)


def test_empty(spark):
    assert topn.top_genes(spark.createDataFrame([], SCHEMA)).count() == 0
