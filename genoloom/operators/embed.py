"""Vectors of genes: centroids, soft membership, neighbours, diffusion, cluster quality.

Vectors are arrays of doubles in (gene, v) rows. Everything that compares genes with clusters
joins against the few centroids; comparisons of all genes go block by block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genoloom.runtime import materialize, release


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column, eps: float = 0.0) -> Column:
    """The vector over its length; a vector of length 0 stays."""
    n = norm(v) + eps
    return F.transform(v, lambda x: x / F.when(n == 0, 1.0).otherwise(n))


def element_mean(df: DataFrame, keys: list[str], v: str = "v") -> DataFrame:
    """keys..., v: the mean vector of each group; sums are taken per place, partially before the shuffle."""
    long = df.select(*keys, F.posexplode(v).alias("i", "x")).groupBy(*keys, "i").agg(F.avg("x").alias("x"))
    return long.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias(v))


def program_scores(vectors: DataFrame, label: str = "label") -> DataFrame:
    """label, gene, cosine to the centroid of unit vectors, score (min-max within the label), position."""
    unit_v = vectors.select("gene", label, unit(F.col("v"), 1e-12).alias("u"))
    centre = element_mean(vectors, [label]).select(label, unit(F.col("v"), 1e-12).alias("c"))
    df = unit_v.join(centre, label).withColumn("cosine", dot(F.col("u"), F.col("c")))
    part = Window.partitionBy(label)
    lo, hi = F.min("cosine").over(part), F.max("cosine").over(part)
    df = df.withColumn("score", F.when(hi - lo <= 1e-12, 1.0).otherwise((F.col("cosine") - lo) / (hi - lo)))
    return df.withColumn("position", F.row_number().over(part.orderBy(F.desc(F.round("score", 12)), "gene"))).drop("u", "c")


#: Centroids that travel together; up to this many are broadcast, more are joined block by block.
CENTROIDS = 1_000


def centroid_cosines(vectors: DataFrame, label: str = "label") -> DataFrame:
    """gene, own label, label of a centroid, cosine: every gene against every centroid."""
    centre = materialize(element_mean(vectors, [label]).select(F.col(label).alias("centroid"), unit(F.col("v")).alias("c")))
    blocks = max(1, -(-centre.count() // CENTROIDS))
    packed = centre.groupBy(F.pmod(F.xxhash64("centroid"), F.lit(blocks)).cast("int").alias("_b")).agg(F.collect_list(F.struct("centroid", "c")).alias("cs"))
    own = vectors.select("gene", label, unit(F.col("v")).alias("u"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_b"))
    df = own.join(F.broadcast(packed) if blocks == 1 else packed, "_b").select("gene", label, "u", F.explode("cs").alias("k"))
    return df.select("gene", label, F.col("k.centroid").alias("centroid"), dot(F.col("u"), F.col("k.c")).alias("cosine"))


def soft_membership(vectors: DataFrame, label: str = "label") -> DataFrame:
    """gene, centroid, weight: the softmax of the cosines of a gene."""
    e = F.exp("cosine")
    return centroid_cosines(vectors, label).withColumn("weight", e / F.sum(e).over(Window.partitionBy("gene"))).select("gene", "centroid", "weight")


def discriminative(vectors: DataFrame, top: int = 50, label: str = "label") -> DataFrame:
    """label, gene, margin: own cosine less the best other one; the top genes of each label."""
    c = centroid_cosines(vectors, label)
    own = F.max(F.when(F.col("centroid") == F.col(label), F.col("cosine")))
    other = F.max(F.when(F.col("centroid") != F.col(label), F.col("cosine")))
    df = c.groupBy("gene", label).agg((own - F.coalesce(other, F.lit(0.0))).alias("margin"))
    order = Window.partitionBy(label).orderBy(F.desc(F.round("margin", 12)), "gene")
    return df.withColumn("position", F.row_number().over(order)).where(F.col("position") <= top)


def neighbours(vectors: DataFrame, k: int, block_rows: int = 2_000, drop_self: bool = True) -> DataFrame:
    """src, dst, weight, rank: the k nearest by cosine, weight cut at 0, ties by dst.

    Rows are dealt into blocks; every pair of blocks is one task of a matrix product that keeps
    k rows, and the best k over the blocks remain. Nothing of size n x n is written.
    """
    n = vectors.count()
    blocks = max(1, -(-n // block_rows))
    df = vectors.select("gene", "v", F.pmod(F.xxhash64("gene"), F.lit(blocks)).cast("int").alias("b"))
    left = df.select(F.col("b").alias("lb"), "gene", "v", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("rb"), F.lit(0).alias("side"))
    right = df.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("lb"), "gene", "v", F.col("b").alias("rb"), F.lit(1).alias("side"))

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf.side == 0], pdf[pdf.side == 1]
        if not len(a) or not len(b):
            return pd.DataFrame({"src": [], "dst": [], "weight": []})
        x, y = np.array(a.v.tolist()), np.array(b.v.tolist())
        unit_ = lambda m: m / np.where((l := np.linalg.norm(m, axis=1, keepdims=True)) == 0, 1, l)
        s = np.round(unit_(x) @ unit_(y).T, 12)
        src, dst = a.gene.to_numpy(), b.gene.to_numpy()
        if drop_self:
            s[src[:, None] == dst[None, :]] = -2
        m = min(k, s.shape[1])
        # all that reach the m-th value stay, so that ties are settled by name later
        cut = np.partition(s, -m, axis=1)[:, -m][:, None]
        i, j = np.nonzero((s >= cut) & (s > -2))
        return pd.DataFrame({"src": src[i], "dst": dst[j], "weight": s[i, j]})

    kind = dict(vectors.dtypes)["gene"]
    out = left.unionByName(right).groupBy("lb", "rb").applyInPandas(best, f"src {kind}, dst {kind}, weight double")
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("weight"), "dst"))
    out = out.withColumn("rank", rank).where(F.col("rank") <= k)
    return out.withColumn("weight", F.greatest("weight", F.lit(0.0)))


def symmetric_edges(knn: DataFrame) -> DataFrame:
    """src < dst, weight: an edge where either side has the other among its neighbours."""
    return knn.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight").groupBy("src", "dst").agg(F.max("weight").alias("weight"))


def diffuse(vectors: DataFrame, knn: DataFrame, steps: int = 3, alpha: float = 0.5) -> DataFrame:
    """gene, v after E = alpha E + (1 - alpha) T E, T the row-normalised neighbour weights (uniform if all are 0)."""
    part = Window.partitionBy("src")
    total, n = F.sum("weight").over(part), F.count("*").over(part)
    t = knn.select("src", "dst", F.when(total > 0, F.col("weight") / total).otherwise(1.0 / n).alias("t"))
    held = current = materialize(vectors.select("gene", F.posexplode("v").alias("i", "x")))
    for _ in range(steps):
        moved = t.join(current.withColumnsRenamed({"gene": "dst"}), "dst").groupBy(F.col("src").alias("gene"), "i").agg(F.sum(F.col("t") * F.col("x")).alias("m"))
        new = current.join(moved, ["gene", "i"], "left").select("gene", "i", (alpha * F.col("x") + (1 - alpha) * F.coalesce("m", F.lit(0.0))).alias("x"))
        current = materialize(new)
        release(held)
        held = current
    return current.groupBy("gene").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))


def cluster_quality(vectors: DataFrame, label: str = "label") -> DataFrame:
    """One row: n, k, Calinski-Harabasz and Davies-Bouldin by aggregates over places."""
    long = vectors.select("gene", label, F.posexplode("v").alias("i", "x"))
    c = long.groupBy(label, "i").agg(F.avg("x").alias("c"), F.count("*").alias("n"))
    g = long.groupBy("i").agg(F.avg("x").alias("g"))
    between = c.join(g, "i").agg(F.sum(F.col("n") * F.pow(F.col("c") - F.col("g"), F.lit(2))).alias("between"))
    far = long.join(c, [label, "i"]).groupBy(label, "gene").agg(F.sum(F.pow(F.col("x") - F.col("c"), F.lit(2))).alias("d2"))
    spread = far.groupBy(label).agg(F.avg(F.sqrt("d2")).alias("s"), F.sum("d2").alias("w"), F.count("*").alias("m"))
    total = spread.agg(F.sum("w").alias("within"), F.sum("m").alias("n"), F.count("*").alias("k"))
    other = c.select(F.col(label).alias("o"), "i", F.col("c").alias("oc"))
    gap = c.join(other, "i").where(F.col(label) != F.col("o")).groupBy(label, "o").agg(F.sqrt(F.sum(F.pow(F.col("c") - F.col("oc"), F.lit(2)))).alias("gap"))
    gap = gap.join(spread.select(label, "s"), label).join(spread.select(F.col(label).alias("o"), F.col("s").alias("so")), "o")
    db = gap.groupBy(label).agg(F.max(F.try_divide(F.col("s") + F.col("so"), "gap")).alias("r")).agg(F.avg("r").alias("davies_bouldin"))
    df = total.join(F.broadcast(between)).join(F.broadcast(db))  # one row each
    ch = F.try_divide(F.col("between") / (F.col("k") - 1), F.col("within") / (F.col("n") - F.col("k")))
    return df.select("n", "k", F.when(F.col("k") > 1, ch).alias("calinski_harabasz"), "davies_bouldin")


def coherence(vectors: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """key, n, mean cosine of the members' unit vectors to their unit centroid, for two members or more."""
    u = members.join(vectors.select("gene", unit(F.col("v")).alias("v")), "gene")
    centre = element_mean(u.select(key, "v"), [key]).select(key, unit(F.col("v")).alias("c"))
    df = u.join(centre, key).groupBy(key).agg(F.count("*").alias("n"), F.avg(dot(F.col("v"), F.col("c"))).alias("coherence"))
    return df.where("n >= 2")


def centroid_distance(vectors: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """One row: n sets and the mean 1 - cosine over pairs of unit centroids."""
    u = members.join(vectors.select("gene", unit(F.col("v")).alias("v")), "gene")
    centre = element_mean(u.select(key, "v"), [key]).select(key, unit(F.col("v")).alias("c"))
    # sum of cosines over pairs from the sum vector: no pair is formed
    total = centre.select(F.posexplode("c").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    total = total.agg(((F.sum(F.col("s") * F.col("s")) - F.sum("q")) / 2).alias("dots"))
    n = centre.agg(F.count("*").alias("n"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return n.join(F.broadcast(total)).select("n", F.coalesce(1 - F.try_divide("dots", pairs), F.lit(0.0)).alias("mean_distance"))


def principal_components(vectors: DataFrame, n: int) -> DataFrame:
    """gene, v: scores on the first n principal components of centred columns; the largest loading of each is positive."""
    long = vectors.select("gene", F.posexplode("v").alias("i", "x"))
    mean = {r["i"]: r["m"] for r in long.groupBy("i").agg(F.avg("x").alias("m")).collect()}  # one row a dimension
    dims = len(mean)
    if not dims:
        return vectors.select("gene", "v")
    centre = np.array([mean[i] for i in range(dims)])

    def gram(frames):
        total = np.zeros((dims, dims))
        for frame in frames:
            if len(frame):
                x = np.array(frame.v.tolist()) - centre
                total += x.T @ x
        yield pd.DataFrame({"g": [total.ravel().tolist()]})

    parts = vectors.select("v").mapInPandas(gram, "g array<double>")
    flat = parts.select(F.posexplode("g").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()
    cov = np.zeros(dims * dims)
    for r in flat:  # dims x dims numbers
        cov[r["i"]] = r["x"]
    values, axes = np.linalg.eigh(cov.reshape(dims, dims))
    axes = axes[:, np.argsort(-values)][:, : min(n, dims)]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])

    def project(frames):
        for frame in frames:
            if len(frame):
                yield pd.DataFrame({"gene": frame.gene, "v": list((np.array(frame.v.tolist()) - centre) @ axes)})

    return vectors.select("gene", "v").mapInPandas(project, f"gene {dict(vectors.dtypes)['gene']}, v array<double>")


def cosine_attention(vectors: DataFrame, block_rows: int = 2_000) -> DataFrame:
    """layer, head, src, dst, w: cosines above 0 of all ordered pairs of genes as the attention of one head.

    The result itself is of all pairs; each pair of blocks is one task.
    """
    near = neighbours(vectors, vectors.count(), block_rows)
    return near.where("weight > 0").select(F.lit(0).alias("layer"), F.lit(0).alias("head"), "src", "dst", F.col("weight").alias("w"))


def random_directions(n: int, dims: int, seed: int = 42) -> np.ndarray:
    """n unit vectors; place i of vector j is the first 8 hex digits of md5(seed|j|i) over 2^31, less 1."""
    import hashlib

    draw = lambda j, i: int(hashlib.md5(f"{seed}|{j}|{i}".encode()).hexdigest()[:8], 16) / 2**31 - 1
    x = np.array([[draw(j, i) for i in range(dims)] for j in range(n)])
    return x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-12)


def synthetic_counts(vectors: DataFrame, n: int = 500, seed: int = 42) -> DataFrame:
    """sample, gene, value: for each random direction exp(cosine - smallest cosine of the direction) - 1, values above 0."""
    dims = len(vectors.select("v").first()[0])
    shared = vectors.sparkSession.sparkContext.broadcast(random_directions(n, dims, seed))  # n x dims numbers
    kind = dict(vectors.dtypes)["gene"]

    def run(frames):
        for f in frames:
            if len(f):
                v = np.array(f["v"].tolist())
                s = (v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-12)) @ shared.value.T
                yield pd.DataFrame({"gene": np.repeat(f["gene"].to_numpy(), n), "sample": np.tile(np.arange(n), len(f)), "s": s.ravel()})

    s = materialize(vectors.select("gene", "v").mapInPandas(run, f"gene {kind}, sample int, s double"))
    low = s.groupBy("sample").agg(F.min("s").alias("low"))
    return s.join(low, "sample").select("sample", "gene", (F.exp(F.col("s") - F.col("low")) - 1).alias("value")).where("value > 0")


def hybrid_vectors(vectors: DataFrame, expression: DataFrame, k: int = 15, steps: int = 3, alpha: float = 0.5) -> DataFrame:
    """gene, v: the vectors of one source diffused over the neighbour graph of another, for the genes that both have."""
    own = vectors.join(expression.select("gene"), "gene", "left_semi").select("gene", "v")
    return diffuse(own, neighbours(expression.join(own.select("gene"), "gene", "left_semi").select("gene", "v"), k), steps, alpha)
