"""Modules of genes from similarities: average linkage, co-expression modules, density clusters, soft membership."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genoloom.operators import discover, graph
from genoloom.runtime import materialize


def merge_steps(n: int, i: np.ndarray, j: np.ndarray, weight: np.ndarray) -> list[tuple[float, int, int]]:
    """(similarity, a, b) of the merges of average linkage, most similar first; a and b are each cluster's smallest place.

    Similarities are 0 where no (i, j, weight) names them, and clusters keep sums to their neighbours
    only, so memory follows the edges. The nearest-neighbour chain merges two clusters that are
    nearest to each other at once, which for average linkage gives the same tree as always merging
    the nearest pair. Ties go to the smaller place; clusters of similarity 0 are never merged.
    """
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in zip(i.tolist(), j.tolist(), weight.tolist()):
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    size, steps, chain, start = [1] * n, [], [], 0
    while True:
        if not chain:
            while start < n and not near[start]:
                start += 1
            if start == n:
                break
            chain.append(start)
        at = chain[-1]
        score, best = max((t / (size[at] * size[c]), -c) for c, t in near[at].items())
        before = chain[-2] if len(chain) > 1 else None
        if before is None or near[at][before] / (size[at] * size[before]) < score:
            chain.append(-best)
            continue
        del chain[-2:]
        a, b = min(at, before), max(at, before)
        steps.append((score, a, b))
        del near[a][b]
        for c, t in near[b].items():
            if c != a:
                near[a][c] = near[c][a] = near[a].get(c, 0.0) + t
                del near[c][b]
        near[b] = {}
        size[a] += size[b]
    return sorted(steps, key=lambda x: -x[0])  # stable: equal steps keep the order of the chain


def linkage(edges: DataFrame, genes: DataFrame, k: int) -> DataFrame:
    """gene, label: average linkage over similarities (src, dst, weight), cut where k clusters are left.

    Pairs without an edge have similarity 0. Clusters of different components of the graph would
    merge only at similarity 0, so each component is linked by a task of its own, and the merges of
    all components are applied in order of similarity. Components without any tie are never merged,
    so there are at least as many clusters as components.
    """
    e = materialize(edges.where("weight > 0").select("src", "dst", "weight"))
    root = graph.components(e.select(F.col("src").alias("u"), F.col("dst").alias("v")))
    inside = e.join(root.select(F.col("node").alias("src"), "root"), "src")
    kind = dict(e.dtypes)["src"]

    def steps(pdf: pd.DataFrame) -> pd.DataFrame:
        names = np.unique(np.r_[pdf.src.to_numpy(), pdf.dst.to_numpy()])
        i, j = np.searchsorted(names, pdf.src.to_numpy()), np.searchsorted(names, pdf.dst.to_numpy())
        got = merge_steps(len(names), i, j, pdf.weight.to_numpy())
        return pd.DataFrame({"u": names[[a for _, a, _ in got]], "v": names[[b for _, _, b in got]], "similarity": [x for x, _, _ in got], "step": range(len(got))})

    merges = materialize(inside.groupBy("root").applyInPandas(steps, f"u {kind}, v {kind}, similarity double, step int"))
    n = genes.select("gene").distinct().count()
    applied = merges.orderBy(F.desc(F.round("similarity", 12)), "step", "u").limit(max(n - k, 0))  # how many merges leave k clusters
    label = graph.components(applied.select("u", "v"))
    out = genes.select("gene").distinct().join(label.select(F.col("node").alias("gene"), F.col("root").alias("label")), "gene", "left")
    return discover.relabelled(out.select("gene", F.coalesce("label", "gene").alias("label")))


def hierarchical_consensus(memberships: DataFrame, weights: DataFrame, k: int | None = None, quantile: float = 0.0) -> DataFrame:
    """gene, label: average linkage on the co-occurrence of genes in the methods' programs; k is a tenth of the genes unless given.

    With a quantile only the strong edges count, and only their genes.
    """
    pairs = discover.cooccurrence(memberships, weights)
    if quantile:
        pairs = materialize(discover.strong_edges(pairs, quantile))
        genes = pairs.select(F.col("src").alias("gene")).union(pairs.select("dst")).distinct()
    else:
        genes = memberships.select("gene").distinct()
    return linkage(pairs, genes, k or max(2, genes.count() // 10))


def soft_consensus(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """gene, label, weight: the mean co-occurrence of a gene with a label's members (itself as 0), made to sum to 1 over labels.

    Labels without any tie to a gene have weight 0 and give no row.
    """
    n = labels.groupBy("label").agg(F.count("*").alias("n"))
    tie = discover.both_ways(pairs).join(labels.select(F.col("gene").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("gene"), "label").agg(F.sum("weight").alias("w"))
    tie = tie.join(n, "label").withColumn("w", F.col("w") / F.col("n")).join(labels.select("gene"), "gene", "left_semi")
    return tie.withColumn("weight", F.col("w") / F.sum("w").over(Window.partitionBy("gene"))).where("w > 0").select("gene", "label", "weight")


def coexpression_modules(correlations: DataFrame, genes: DataFrame, power: int = 6, n_modules: int | None = None, least: int = 10) -> DataFrame:
    """module, gene, score: average linkage on the topological overlap of |r|^power; modules of fewer than ``least`` genes drop out.

    correlations: src, dst, r. The score is a gene's mean adjacency within the module (1 to itself)
    over the largest. Without any module all genes are one of score 1.
    """
    universe = genes.select("gene").distinct()
    adjacency = materialize(correlations.select("src", "dst", F.pow(F.abs("r"), F.lit(power)).alias("weight")).where("weight > 0"))
    tom = discover.topological_overlap(adjacency).select("src", "dst", F.col("tom").alias("weight"))
    found = materialize(linkage(tom, universe, n_modules or max(2, universe.count() // least)))
    size = found.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    kept = found.join(size, "label")
    if kept.isEmpty():
        return universe.select(F.lit(0).alias("module"), "gene", F.lit(1.0).alias("score"))
    own = discover.both_ways(adjacency).join(kept.select(F.col("gene").alias("src"), "label"), "src").join(kept.select(F.col("gene").alias("dst"), "label"), ["dst", "label"])
    own = own.groupBy(F.col("src").alias("gene")).agg(F.sum("weight").alias("w"))
    mean = kept.join(own, "gene", "left").withColumn("c", (F.coalesce("w", F.lit(0.0)) + 1) / F.col("n"))
    return mean.select(F.col("label").alias("module"), "gene", (F.col("c") / F.max("c").over(Window.partitionBy("label"))).alias("score"))


def stable_clusters(u: np.ndarray, v: np.ndarray, distance: np.ndarray, n: int, least: int) -> np.ndarray:
    """Labels of the most stable clusters of a spanning tree over 0..n-1, -1 for noise.

    The tree's edges are merged from the shortest on. A side of at least ``least`` points is a
    cluster of its own from the merge that joins it to another such side; smaller sides fall out
    of the cluster there. A cluster's stability is the sum over its points of 1 / distance where a
    point leaves less 1 / distance where the cluster begins; parents win over children by it.
    """
    order = np.argsort(distance, kind="stable")
    size = np.ones(2 * n - 1, int)
    top, left, right, height = list(range(n)), {}, {}, np.zeros(2 * n - 1)

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    node = list(range(n))  # the dendrogram node of each set
    new = n
    for e in order:
        a, b = find(int(u[e])), find(int(v[e]))
        if a == b:
            continue
        left[new], right[new], height[new] = node[a], node[b], distance[e]
        size[new] = size[node[a]] + size[node[b]]
        top[b] = a
        node[a] = new
        new += 1
    roots = {node[find(i)] for i in range(n)}

    def points(x: int) -> list[int]:
        stack, out = [x], []
        while stack:
            y = stack.pop()
            if y < n:
                out.append(y)
            else:
                stack += [left[y], right[y]]
        return out

    density = lambda h: 1.0 / h if h > 0 else np.inf
    clusters: list[dict] = []

    def open_cluster(x: int, birth: float, up: int | None) -> int:
        clusters.append({"birth": birth, "up": up, "points": [], "stable": 0.0, "children": []})
        if up is not None:
            clusters[up]["children"].append(len(clusters) - 1)
        return len(clusters) - 1

    for r in sorted(roots):
        if size[r] < least:
            continue
        todo = [(r, open_cluster(r, 0.0, None))]
        while todo:
            x, c = todo.pop()
            own = clusters[c]
            if x < n:
                own["points"].append(x)
                continue
            at = density(height[x])
            big = [y for y in (left[x], right[x]) if size[y] >= least]
            gain = lambda k: (0.0 if at == own["birth"] else k * (at - own["birth"]))
            if len(big) == 2:
                own["stable"] += gain(size[x])
                todo += [(y, open_cluster(y, at, c)) for y in big]
                continue
            for y in (left[x], right[x]):
                if y in big:
                    todo.append((y, c))
                else:
                    own["stable"] += gain(size[y])
                    own["points"] += points(y)
    alone = sum(c["up"] is None for c in clusters) == 1  # all points as one cluster say nothing
    best = [c["stable"] for c in clusters]
    chosen = [True] * len(clusters)
    for i in range(len(clusters) - 1, -1, -1):  # children come after parents
        below = sum(best[j] for j in clusters[i]["children"])
        if (alone and clusters[i]["up"] is None) or (clusters[i]["children"] and below > best[i]):
            chosen[i], best[i] = False, below
    labels = np.full(n, -1)
    for i, c in enumerate(clusters):
        up = c["up"]
        owner = i if chosen[i] else None
        while up is not None:
            if chosen[up]:
                owner = up  # the uppermost chosen cluster takes all its points
            up = clusters[up]["up"]
        if owner is not None:
            labels[c["points"]] = owner
    return labels


def density_clusters(vectors: DataFrame, least: int = 5, samples: int | None = None, k: int | None = None) -> DataFrame:
    """gene, label (0, 1, ... by falling size; -1 is noise): density clusters by mutual reachability.

    The k nearest neighbours (64 unless given, all for a smaller table) come block by block. A
    gene's core distance is that to its ``samples``-th neighbour counting itself; an edge is as
    long as its distance and both core distances. Boruvka rounds join every component by its
    shortest outgoing edge, each round a few joins; the spanning tree, one row a gene, is read by one task.
    The tree is exact when k reaches all genes; otherwise it is that of the neighbour graph, and
    parts of the graph without a joining edge are clustered apart.
    """
    n = vectors.count()
    kind = dict(vectors.dtypes)["gene"]
    samples = samples or least
    near = materialize(nearest_by_distance(vectors, min(max(k or 64, samples), max(n - 1, 1))))
    core = near.where(F.col("rank") == max(samples - 1, 1)).select(F.col("src").alias("gene"), F.col("distance").alias("core"))
    reach = near.join(core.toDF("src", "ca"), "src").join(core.toDF("dst", "cb"), "dst")
    reach = reach.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"), F.greatest("distance", "ca", "cb").alias("d"))
    edges = materialize(reach.groupBy("u", "v").agg(F.min("d").alias("d")))
    tree, comp = None, materialize(vectors.select("gene", F.col("gene").alias("comp")))
    while True:
        out = edges.join(comp.toDF("u", "a"), "u").join(comp.toDF("v", "b"), "v").where("a <> b")
        ends = out.select(F.col("a").alias("comp"), "u", "v", "d").unionByName(out.select(F.col("b").alias("comp"), "u", "v", "d"))
        pick = materialize(ends.groupBy("comp").agg(F.min(F.struct("d", "u", "v")).alias("e")).select("e.*").distinct())  # one order of all edges: no cycles
        if pick.isEmpty():
            break
        tree = pick if tree is None else tree.unionByName(pick)
        joined = pick.join(comp.toDF("u", "a"), "u").join(comp.toDF("v", "b"), "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
        roots = graph.components(joined)
        comp = materialize(comp.join(roots.toDF("comp", "root"), "comp", "left").select("gene", F.coalesce("root", "comp").alias("comp")))
    everyone = vectors.select("gene")
    if tree is None:
        return everyone.select("gene", F.lit(-1).alias("label"))

    def read(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf.d.isna()].u.to_numpy()
        names, e = np.sort(own), pdf[pdf.d.notna()]
        got = stable_clusters(np.searchsorted(names, e.u.to_numpy()), np.searchsorted(names, e.v.to_numpy()), e.d.to_numpy(), len(names), least)
        return pd.DataFrame({"gene": names, "label": got})

    rows = tree.select("u", "v", "d").unionByName(everyone.select(F.col("gene").alias("u"), F.col("gene").alias("v"), F.lit(None).cast("double").alias("d")))
    found = materialize(rows.withColumn("tree", F.lit(0)).groupBy("tree").applyInPandas(read, f"gene {kind}, label int"))
    noise = found.where("label < 0")
    return discover.relabelled(found.where("label >= 0")).select("gene", "label").unionByName(noise.select("gene", "label"))


def nearest_by_distance(vectors: DataFrame, k: int, block_rows: int = 2_000) -> DataFrame:
    """src, dst, distance, rank of the k nearest by Euclidean distance, ties by dst; pairs of blocks are tasks."""
    blocks = max(1, -(-vectors.count() // block_rows))
    df = vectors.select("gene", "v", F.pmod(F.xxhash64("gene"), F.lit(blocks)).cast("int").alias("b"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = df.select(F.col("b").alias("lb"), every.alias("rb"), "gene", "v", F.lit(0).alias("side"))
    right = df.select(every.alias("lb"), F.col("b").alias("rb"), "gene", "v", F.lit(1).alias("side"))

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf.side == 0], pdf[pdf.side == 1]
        if not len(a) or not len(b):
            return pd.DataFrame({"src": [], "dst": [], "distance": []})
        x, y = np.array(a.v.tolist()), np.array(b.v.tolist())
        d = np.round(np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0)), 12)
        src, dst = a.gene.to_numpy(), b.gene.to_numpy()
        d[src[:, None] == dst[None]] = np.inf
        m = min(k, d.shape[1])
        i, j = np.nonzero((d <= np.partition(d, m - 1, axis=1)[:, m - 1 : m]) & np.isfinite(d))
        return pd.DataFrame({"src": src[i], "dst": dst[j], "distance": d[i, j]})

    kind = dict(vectors.dtypes)["gene"]
    out = left.unionByName(right).groupBy("lb", "rb").applyInPandas(best, f"src {kind}, dst {kind}, distance double")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy("distance", "dst"))).where(F.col("rank") <= k)


def program_summary(members: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """scope..., n_programs, sizes: smallest, median, largest, total, and distinct genes."""
    scope = scope or []
    size = members.groupBy(*scope, "program").agg(F.count("*").alias("n"))
    out = size.groupBy(*scope).agg(F.count("*").alias("n_programs"), F.min("n").alias("smallest"), F.median("n").alias("median_size"), F.max("n").alias("largest"), F.sum("n").alias("total"))
    genes = members.groupBy(*scope).agg(F.countDistinct("gene").alias("n_genes"))
    return out.join(genes, scope) if scope else out.join(F.broadcast(genes))
