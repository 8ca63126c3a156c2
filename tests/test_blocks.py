import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from genoloom.operators import blocks, discover


def dense(made):
    """Names in the order of their numbers, and the whole matrix."""
    ids = {r.id: r.gene for r in made.genes.collect()}
    kind = np.uint16 if made.side <= 1 << 16 else np.uint32
    x = np.zeros((made.count, made.count))
    for r in made.tiles.collect():
        i, j = (np.frombuffer(v, kind).astype(int) + at * made.side for v, at in ((r.i, r.a), (r.j, r.b)))
        np.add.at(x, (i, j), np.frombuffer(r.w))
        np.add.at(x, (j, i), np.frombuffer(r.w))
    return [ids[n] for n in range(made.count)], x


def stepped(x, times=200):
    """Every step of the power iteration, as the SQL does it."""
    v = np.ones(len(x))
    for _ in range(times):
        v = v + x @ v / x.sum(0).max()
        v /= np.linalg.norm(v)
    return (v - v.min()) / (v.max() - v.min())


@pytest.mark.parametrize("how", ["mean", "max"])
def test_shared_rows_give_the_head_average(spark, monkeypatch, how):
    monkeypatch.setattr(blocks, "PAIRS", 30)  # several blocks
    draw = random.Random(3)
    rows = [(u, draw.choice(["l0", "l1", None]), draw.choice(["h0", "h1", "h2"]), f"g{draw.randrange(12)}") for u in range(25) for _ in range(draw.randrange(1, 6))]
    rows += [(100, "l0", "h0", "alone"), (101, "l0", "h0", "twice"), (101, "l1", "h0", "twice"), (None, "l0", "h0", "g1"), (5, "l0", "h0", None)]
    df = spark.createDataFrame(rows, "unit long, layer string, head string, gene string")
    other = df.select("unit", F.col("gene").alias("dst"))
    counts = df.withColumnRenamed("gene", "src").join(other, "unit").where("src <> dst").groupBy("layer", "head", "src", "dst").agg(F.count("*").cast("double").alias("w"))
    want = {(r.src, r.dst): r.weight for r in discover.head_average(counts, how).collect()}
    made = blocks.of_shared(df, how)
    assert made.side < made.count
    names, x = dense(made)
    got = {(min(names[i], names[j]), max(names[i], names[j])): x[i, j] for i, j in zip(*np.nonzero(np.triu(x)), strict=True)}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)
    there = {n for k in want for n in k}
    scores = {r.gene: r.score for r in discover.eigenvector_centrality(made).collect()}
    keep = [n for n, name in enumerate(names) if name in there]
    assert set(scores) == there
    assert [scores[names[n]] for n in keep] == pytest.approx(stepped(x[np.ix_(keep, keep)]), abs=1e-9)


def test_eigenvector_is_that_of_every_step_where_it_never_settles(spark, monkeypatch):
    monkeypatch.setattr(blocks, "PAIRS", 8)
    monkeypatch.setattr(blocks, "WIDE", 0)  # numbers and vectors meet the blocks by shuffle
    edges = [(f"a{i}", f"a{i + 1}", 1.0) for i in range(9)] + [(f"b{i}", f"b{i + 1}", 0.97) for i in range(6)] + [("a3", "a3", 0.25), ("a5", "a4", 0.5), ("b1", "a1", None)]
    names = sorted({n for e in edges for n in e[:2]})
    x = np.zeros((len(names), len(names)))
    for s, d, w in edges:
        x[names.index(s), names.index(d)] += w or 0.0
        x[names.index(d), names.index(s)] += w or 0.0
    got = {r.gene: r.score for r in discover.eigenvector_centrality(spark.createDataFrame(edges, "src string, dst string, weight double")).collect()}
    assert [got[n] for n in names] == pytest.approx(stepped(x), abs=1e-8)


def test_eigenvector_needs_few_products(spark, monkeypatch):
    draw = np.random.default_rng(5)
    x = np.triu(draw.random((120, 120)) < 0.4, 1) * 1.0
    x += x.T
    v, plain = np.ones(120) / np.sqrt(120), 0
    while True:
        new = v + x @ v / x.sum(0).max()
        new, plain = new / np.linalg.norm(new), plain + 1
        if np.abs(new - v).sum() < 1e-8:
            break
        v = new
    made, product = [], blocks._product
    monkeypatch.setattr(blocks, "_product", lambda *a: made.append(1) or product(*a))
    edges = [(int(i), int(j), 1.0) for i, j in zip(*np.nonzero(np.triu(x)), strict=True)]
    got = {r.gene: r.score for r in discover.eigenvector_centrality(spark.createDataFrame(edges, "src long, dst long, weight double")).collect()}
    assert [got[n] for n in range(120)] == pytest.approx(stepped(x), abs=1e-9)
    assert 2 * len(made) < plain


def test_eigenvector_without_edges_and_of_equal_genes(spark):
    kind = "src long, dst long, weight double"
    assert discover.eigenvector_centrality(spark.createDataFrame([], kind)).collect() == []
    ring = spark.createDataFrame([(i, (i + 1) % 5, 2.0) for i in range(5)], kind)
    assert {r.gene: r.score for r in discover.eigenvector_centrality(ring).collect()} == dict.fromkeys(range(5), 1.0)
    nothing = blocks.of_shared(spark.createDataFrame([(1, "l", "h", "x"), (2, "l", "h", "y")], "unit long, layer string, head string, gene string"))
    assert discover.eigenvector_centrality(nothing).collect() == []
