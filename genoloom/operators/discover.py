"""Program discovery: clustering, consensus, networks, factor models.

Where a reference method has no counterpart here (Leiden, HDBSCAN, UMAP, the variational topic
model) the substitute is named in the README.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import LDA, KMeans, PowerIterationClustering
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genoloom.operators import blocks
from genoloom.runtime import dense_ids, materialize, release


def relabelled(df: DataFrame, label: str = "label") -> DataFrame:
    """Labels 0, 1, ... by falling size, ties by the smallest gene."""
    size = df.groupBy(label).agg(F.count("*").alias("n"), F.min("gene").alias("g"))
    order = dense_ids(size.orderBy(F.desc("n"), "g"), "_new").select(label, F.col("_new").cast("int").alias("_new"))
    return df.join(order, label).drop(label).withColumnRenamed("_new", label)


def kmeans_programs(vectors: DataFrame, k: int, seed: int = 42, starts: int = 3) -> DataFrame:
    """gene, label: the best of several starts of k-means."""
    data = materialize(vectors.select("gene", "v")).select("gene", array_to_vector("v").alias("features"))
    models = [KMeans(k=k, seed=seed + i, maxIter=100).fit(data) for i in range(starts)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    return relabelled(materialize(best.transform(data).select("gene", F.col("prediction").alias("label"))))


def spectral_programs(edges: DataFrame, k: int, iterations: int = 20) -> DataFrame:
    """gene, label by power iteration clustering of (src, dst, weight) with long ids."""
    pic = PowerIterationClustering(k=k, maxIter=iterations, weightCol="weight")
    out = pic.assignClusters(edges.where("weight > 0").select(F.col("src").cast("long"), F.col("dst").cast("long"), "weight"))
    return relabelled(materialize(out.select(F.col("id").alias("gene"), F.col("cluster").alias("label"))))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def _wishes(e: DataFrame, state: DataFrame, resolution: float, m2: float) -> DataFrame:
    """node, to: the nodes that gain by a move, with the neighbouring community of the largest gain.

    The gain of a community is w(node, C) - resolution * k_node * K_C / 2m, without the node itself.
    """
    total = state.groupBy("label").agg(F.sum("k").alias("tot"))
    near = e.join(state.select(F.col("node").alias("dst"), F.col("label").alias("to")), "dst").groupBy("src", "to").agg(F.sum("weight").alias("w"))
    df = near.join(total.withColumnRenamed("label", "to"), "to").join(state.withColumnRenamed("node", "src"), "src")
    # the own community counts as one of the choices even where no neighbour is in it
    stay = state.join(total, "label").select(F.col("node").alias("src"), F.col("label").alias("to"), F.lit(0.0).alias("w"), "tot", "label", "k")
    df = df.select("src", "to", "w", "tot", "label", "k").unionByName(stay).groupBy("src", "to").agg(F.max("w").alias("w"), *[F.first(c).alias(c) for c in ("tot", "label", "k")])
    rest = F.col("tot") - F.when(F.col("to") == F.col("label"), F.col("k")).otherwise(0.0)
    df = df.withColumn("g", F.round(F.col("w") - resolution * F.col("k") * rest / m2, 9))
    # ties: staying, then one fixed order of the names
    best = F.max(F.struct("g", (F.col("to") == F.col("label")).alias("stays"), F.xxhash64("to").alias("order"), "to", "label")).alias("b")
    return df.groupBy("src").agg(best).where("b.to <> b.label").select(F.col("src").alias("node"), F.col("b.to").alias("to"))


def communities(edges: DataFrame, resolution: float = 1.0, rounds: int = 200) -> DataFrame:
    """gene, label: communities by local moving on the resolution-adjusted modularity, level by level.

    In a round, of the nodes that would gain by a move a half (by a keyed hash) moves, which keeps
    pairs from swapping for ever; a level ends when no node at all would gain. Then communities
    become the nodes of the next level, until no two of them merge. State lives in written tables.
    """
    e = materialize(both_ways(edges.where("weight > 0 and src <> dst")))
    k = e.groupBy("src").agg(F.sum("weight").alias("k"))
    m2 = e.agg(F.sum("weight")).first()[0] or 1.0
    state = materialize(k.select(F.col("src").alias("node"), F.col("src").alias("label"), "k"))
    home, turn = None, 0
    while True:
        moved_any = False
        for _ in range(rounds):
            turn += 1
            may = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(2)) == 0
            wish = state.join(_wishes(e, state, resolution, m2), "node", "left")
            new = materialize(wish.select("node", F.when(may & F.col("to").isNotNull(), F.col("to")).otherwise(F.col("label")).alias("label"), "k", F.col("to").isNotNull().alias("wished")))
            still = not new.where("wished").isEmpty()
            release(state)
            state = new.drop("wished")
            state._genoloom_path = new._genoloom_path
            moved_any |= still
            if not still:
                break
        now = state.select("node", "label")
        home = materialize(now.withColumnRenamed("node", "gene") if home is None else home.join(now.toDF("label", "up"), "label").select("gene", F.col("up").alias("label")))
        if not moved_any:
            break
        a, b = now.toDF("src", "a"), now.toDF("dst", "b")
        up = materialize(e.join(a, "src").join(b, "dst").where("a <> b").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("weight").alias("weight")))
        grown = materialize(state.groupBy(F.col("label").alias("node")).agg(F.sum("k").alias("k")).select("node", F.col("node").alias("label"), "k"))
        release(e, state)
        e, state = up, grown
    out = relabelled(home)
    release(e, state)
    return out


def movable(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    """gene, to: the genes that would still gain by a move to another community; none after ``communities`` of one level."""
    e = both_ways(edges.where("weight > 0 and src <> dst"))
    k = e.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("k"))
    m2 = e.agg(F.sum("weight")).first()[0] or 1.0
    return _wishes(e, labels.select(F.col("gene").alias("node"), "label").join(k, "node"), resolution, m2).withColumnRenamed("node", "gene")


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row: modularity of (gene, label) over (src, dst, weight)."""
    e = both_ways(edges)
    a, b = labels.toDF("src", "la"), labels.toDF("dst", "lb")
    inner = e.join(a, "src").join(b, "dst").agg(F.sum(F.when(F.col("la") == F.col("lb"), F.col("weight")).otherwise(0.0)).alias("inside"), F.sum("weight").alias("m2"))
    tot = e.join(a, "src").groupBy("la").agg(F.sum("weight").alias("k")).agg(F.sum(F.col("k") * F.col("k")).alias("k2"))
    return inner.join(F.broadcast(tot)).select((F.col("inside") / F.col("m2") - resolution * F.col("k2") / (F.col("m2") * F.col("m2"))).alias("modularity"))


def cooccurrence(memberships: DataFrame, weights: DataFrame) -> DataFrame:
    """src < dst, weight: the weight share of methods that put both genes into one program.

    memberships: method, program, gene; weights: method, weight. Pairs are formed within a
    program only, as one 64-bit code of dense gene numbers, and a method counts once for a pair.
    """
    genes = dense_ids(memberships.select("gene").distinct(), "id")
    if genes._genoloom_rows > 1 << 31:
        raise ValueError("more genes than a pair code holds")
    m = memberships.join(genes, "gene").select("method", "program", "id")
    other = m.withColumnRenamed("id", "to")
    code = F.shiftleft("id", 32).bitwiseOR(F.col("to")).alias("code")
    pairs = m.join(other, ["method", "program"]).where("id < to").select("method", code).distinct()
    pairs = pairs.join(weights, "method").groupBy("code").agg(F.sum("weight").alias("weight"))
    name = lambda i, x: genes.select(F.col("id").alias(i), F.col("gene").alias(x))
    pairs = pairs.select(F.shiftrightunsigned("code", 32).alias("i"), F.col("code").bitwiseAND((1 << 32) - 1).alias("j"), "weight").join(name("i", "x"), "i").join(name("j", "y"), "j")
    return pairs.select(F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst"), "weight")


def strong_edges(pairs: DataFrame, quantile: float) -> DataFrame:
    """Edges of at least the given quantile of the positive weights."""
    positive = pairs.where("weight > 0")
    cut = positive.agg(F.percentile("weight", quantile)).first()[0]
    return positive.where(F.col("weight") >= F.lit(cut)) if cut is not None else positive


def consensus_programs(memberships: DataFrame, weights: DataFrame, quantile: float = 0.5, resolution: float = 1.0) -> DataFrame:
    """gene, label: communities of the strong co-occurrence edges."""
    return communities(strong_edges(cooccurrence(memberships, weights), quantile), resolution)


def member_confidence(memberships: DataFrame, weights: DataFrame, labels: DataFrame) -> DataFrame:
    """gene, label, confidence: the weight share of methods that put the gene beside another member of its label."""
    m = memberships.join(labels, "gene")
    n = m.groupBy("method", "program", "label").agg(F.countDistinct("gene").alias("n"))
    kept = m.join(n, ["method", "program", "label"]).where("n > 1").select("method", "gene", "label").distinct().join(weights, "method")
    total = weights.agg(F.sum("weight").alias("t"))
    out = labels.join(kept.groupBy("gene", "label").agg(F.sum("weight").alias("w")), ["gene", "label"], "left").join(F.broadcast(total))
    return out.select("gene", "label", (F.coalesce("w", F.lit(0.0)) / F.col("t")).alias("confidence"))


def head_average(attention: DataFrame, how: str = "mean") -> DataFrame:
    """src, dst, weight from (layer, head, src, dst, w): layers are averaged first, then heads by mean or max; made symmetric."""
    heads = attention.groupBy("head", "src", "dst").agg(F.avg("w").alias("w"))
    one = heads.groupBy("src", "dst").agg((F.avg if how == "mean" else F.max)("w").alias("w"))
    flat = one.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "w")
    return flat.groupBy("src", "dst").agg((F.sum("w") / 2).alias("weight"))


def _scaled(df: DataFrame) -> DataFrame:
    span = df.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    return df.join(F.broadcast(span)).select("gene", F.when(F.col("hi") - F.col("lo") <= 1e-12, 1.0).otherwise((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("score"))


def pagerank(edges: DataFrame, damping: float = 0.85, iterations: int = 100, tolerance: float = 1e-8, every: int = 5) -> DataFrame:
    """gene, score: PageRank over undirected weights, scaled to [0, 1]; the mass of isolated nodes is not handed on."""
    e = both_ways(edges)
    out = e.groupBy("src").agg(F.sum("weight").alias("t"))
    step = materialize(e.join(out, "src").select("src", "dst", (F.col("weight") / F.col("t")).alias("p")))
    n = out.count()
    held = rank = materialize(out.select(F.col("src").alias("gene"), F.lit(1.0 / max(n, 1)).alias("x")))
    for i in range(iterations):
        flow = step.join(rank.toDF("src", "x"), "src").groupBy(F.col("dst").alias("gene")).agg(F.sum(F.col("p") * F.col("x")).alias("m"))
        new = rank.join(flow, "gene", "left").select("gene", ((1 - damping) / n + damping * F.coalesce("m", F.lit(0.0))).alias("x"))
        if (i + 1) % every == 0 or i + 1 == iterations:
            new = materialize(new)
            gap = new.join(held.toDF("gene", "o"), "gene").agg(F.sum(F.abs(F.col("x") - F.col("o")))).first()[0]
            release(held)
            held = new
            if gap is None or gap < tolerance:
                rank = new
                break
        rank = new
    return _scaled(rank)


def eigenvector_centrality(edges: DataFrame | blocks.Blocks, iterations: int = 200) -> DataFrame:
    """gene, score: power iteration of the adjacency (with half a step kept, so that bipartite parts settle), scaled to [0, 1].

    The vector is that of all iterations; ``blocks.powers`` makes it from fewer products with the adjacency.
    """
    if isinstance(edges, blocks.Blocks):
        return _scaled(blocks.powers(edges, iterations))
    made = blocks.of_edges(edges)
    out = _scaled(blocks.powers(made, iterations))
    release(made.tiles, made.genes)
    return out


def topological_overlap(edges: DataFrame) -> DataFrame:
    """src < dst, tom: (shared + a) / (min degree + 1 - a) of a symmetric adjacency in [0, 1]."""
    e = both_ways(edges)
    k = e.groupBy("src").agg(F.sum("weight").alias("k"))
    two = e.select("src", F.col("dst").alias("mid"), F.col("weight").alias("w1")).join(e.select(F.col("src").alias("mid"), "dst", F.col("weight").alias("w2")), "mid")
    two = two.where("src < dst").groupBy("src", "dst").agg(F.sum(F.col("w1") * F.col("w2")).alias("l"))
    a = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight")
    df = two.join(a, ["src", "dst"], "full").fillna(0.0, ["l", "weight"]).join(k.toDF("src", "ks"), "src").join(k.toDF("dst", "kd"), "dst")
    return df.select("src", "dst", ((F.col("l") + F.col("weight")) / (F.least("ks", "kd") + 1 - F.col("weight"))).alias("tom"))


def topic_programs(counts: DataFrame, k: int, top: int, seed: int = 42, iterations: int = 10) -> DataFrame:
    """topic, gene, weight, position: LDA over documents (sample, gene, value) as bags of genes."""
    bags = counts.groupBy("sample").agg(F.flatten(F.collect_list(F.array_repeat(F.col("gene").cast("string"), F.greatest(F.round("value").cast("int"), F.lit(0))))).alias("words"))
    genes = counts.select("gene").distinct().count()
    vec = CountVectorizer(inputCol="words", outputCol="features", vocabSize=max(genes, 1)).fit(bags)  # every gene
    model = LDA(k=k, maxIter=iterations, seed=seed).fit(vec.transform(bags).select("features"))
    rows = model.describeTopics(top).select("topic", F.posexplode("termIndices").alias("position", "term"), "termWeights")
    names = counts.sparkSession.createDataFrame(list(enumerate(vec.vocabulary)), "term int, gene string")
    rows = rows.withColumn("weight", F.element_at("termWeights", F.col("position") + 1))
    return rows.join(names, "term").select("topic", "gene", "weight", (F.col("position") + 1).alias("position"))


def factor_programs(values: DataFrame, k: int, top: int, rounds: int = 15, seed: int = 42) -> DataFrame:
    """program, gene, score, position: non-negative factors of (sample, gene, value) by multiplicative updates.

    Both factors live in long tables (key, weights array); a round is two joins with the values
    and two k x k products on the driver. Scores are over the program's largest.
    """
    start = lambda c: F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: 0.1 + F.pmod(F.xxhash64(F.col(c), i, F.lit(seed)), F.lit(1000)) / 1000.0)
    v = materialize(values.select("sample", "gene", "value").where("value > 0"))
    w = materialize(v.select("sample").distinct().withColumn("w", start("sample")))
    h = materialize(v.select("gene").distinct().withColumn("h", start("gene")))

    def gram(df: DataFrame, c: str) -> np.ndarray:
        pairs = df.select(F.posexplode(c).alias("i", "x"), c).select("i", "x", F.posexplode(c).alias("j", "y"))
        out = np.zeros((k, k))
        for r in pairs.groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("s")).collect():  # k x k numbers
            out[r["i"], r["j"]] = r["s"]
        return out

    def update(side: DataFrame, key: str, own: str, other: DataFrame, other_key: str, theirs: str) -> DataFrame:
        g = gram(other, theirs)
        top_ = v.join(other, other_key).select(key, "value", F.posexplode(theirs).alias("i", "x")).groupBy(key, "i").agg(F.sum(F.col("value") * F.col("x")).alias("num"))
        top_ = top_.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "num"))), lambda s: s["num"]).alias("num"))

        def run(frames):
            for f in frames:
                if len(f):
                    x, num = np.array(f[own].tolist()), np.array(f["num"].tolist())
                    yield pd.DataFrame({key: f[key], own: list(x * num / np.maximum(x @ g, 1e-12))})

        kind = dict(side.dtypes)[key]
        return materialize(side.join(top_, key).mapInPandas(run, f"{key} {kind}, {own} array<double>"))

    for _ in range(rounds):
        new_h = update(h, "gene", "h", w, "sample", "w")
        release(h)
        h = new_h
        new_w = update(w, "sample", "w", h, "gene", "h")
        release(w)
        w = new_w
    long = h.select("gene", F.posexplode("h").alias("program", "x"))
    part = Window.partitionBy("program")
    long = long.withColumn("score", F.try_divide(F.col("x"), F.max("x").over(part)))
    return long.withColumn("position", F.row_number().over(part.orderBy(F.desc("score"), "gene"))).where(F.col("position") <= top).drop("x")


def random_programs(genes: DataFrame, n_programs: int, size: int, seed: int = 42) -> DataFrame:
    """program, gene, score 1, position: for each program the genes first in the order of md5(seed|program|gene)."""
    p = genes.select("gene").distinct().withColumn("program", F.explode(F.sequence(F.lit(0), F.lit(n_programs - 1))))
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("program").cast("string"), F.col("gene").cast("string")))
    order = Window.partitionBy("program").orderBy(key, "gene")
    return p.withColumn("position", F.row_number().over(order)).where(F.col("position") <= size).withColumn("score", F.lit(1.0))


def spectra_programs(spectra: DataFrame, genes: DataFrame, top: int, least: int = 3) -> DataFrame:
    """program, gene, score, position: reference spectra mapped to the dataset's genes without regard to case."""
    own = genes.select("gene", F.upper("gene").alias("key")).groupBy("key").agg(F.min("gene").alias("gene"))
    df = spectra.select("program", F.upper("gene").alias("key"), "score").groupBy("program", "key").agg(F.max("score").alias("score")).join(own, "key")
    df = df.withColumn("position", F.row_number().over(Window.partitionBy("program").orderBy(F.desc("score"), "gene"))).where(F.col("position") <= top)
    return df.withColumn("n", F.count("*").over(Window.partitionBy("program"))).where(F.col("n") >= least).select("program", "gene", "score", "position")


def topic_coherence(top_genes: DataFrame, values: DataFrame, n_samples: int) -> DataFrame:
    """topic, NPMI over pairs of its top genes; a gene occurs in a sample where its value is above the gene's median (zeros included)."""
    v = values.join(top_genes.select("gene").distinct(), "gene", "left_semi")
    part = Window.partitionBy("gene")
    # with more zeros than values the median is 0 or the mean of 0 and the smallest value
    v = v.withColumn("nz", F.count("*").over(part)).withColumn("r", F.row_number().over(part.orderBy("value")))
    zeros = F.lit(n_samples) - F.col("nz")
    at = lambda p: F.coalesce(F.max(F.when(F.col("r") + zeros == p, F.col("value"))).over(part), F.lit(0.0))
    lo, hi = (n_samples + 1) // 2, n_samples // 2 + 1
    on = v.withColumn("med", (at(lo) + at(hi)) / 2).where(F.col("value") > F.col("med")).select("sample", "gene")
    g = on.groupBy("gene").agg(F.count("*").alias("n"))
    t = top_genes.select("topic", "gene")
    pairs = t.join(t.withColumnRenamed("gene", "other"), "topic").where("gene < other")
    both = on.join(on.withColumnRenamed("gene", "other"), "sample").where("gene < other").groupBy("gene", "other").agg(F.count("*").alias("k"))
    df = pairs.join(both, ["gene", "other"], "left").join(g, "gene", "left").join(g.toDF("other", "m"), "other", "left").fillna(0, ["k", "n", "m"])
    floor = 1.0 / (n_samples + 1)
    p = lambda c: F.greatest(F.col(c) / n_samples, F.lit(floor))
    npmi = F.try_divide(F.log(p("k") / (p("n") * p("m"))), -F.log(p("k")))
    return df.groupBy("topic").agg(F.avg(F.coalesce(npmi, F.lit(1.0))).alias("coherence"))
