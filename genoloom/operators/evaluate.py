"""Coherence against networks and annotations, permutation nulls, silhouettes, sweeps and refits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genoloom.functions.digests import Texts
from genoloom.operators import discover, embed, sets
from genoloom.runtime import materialize, release


def edge_density(members: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """key, n, density: the share of pairs of a program's genes that an undirected edge joins; 0 under two genes."""
    n = members.groupBy(key).agg(F.count("*").alias("n"))
    e = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src <> dst").distinct()
    inside = e.join(members.select(key, F.col("gene").alias("src")), "src").join(members.select(key, F.col("gene").alias("dst")), [key, "dst"])
    k = inside.groupBy(key).agg(F.count("*").alias("k"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return n.join(k, key, "left").select(key, "n", F.coalesce(F.try_divide(F.coalesce("k", F.lit(0)), pairs), F.lit(0.0)).alias("density"))


def term_coherence(members: DataFrame, terms: DataFrame, key: str) -> DataFrame:
    """key, n_pairs, coherence, shared: over pairs of a program's annotated genes the mean Jaccard of their terms and the share with a common term.

    Pairs with a common term come from a join on (program, term); the others only count.
    """
    t = members.join(terms.select("gene", "term").distinct(), "gene")
    size = t.groupBy(key, "gene").agg(F.count("*").alias("n"))
    pairs = size.groupBy(key).agg((F.count("*") * (F.count("*") - 1) / 2).cast("long").alias("n_pairs"))
    other = t.select(key, "term", F.col("gene").alias("other"))
    k = t.join(other, [key, "term"]).where("gene < other").groupBy(key, "gene", "other").agg(F.count("*").alias("k"))
    k = k.join(size, [key, "gene"]).join(size.select(key, F.col("gene").alias("other"), F.col("n").alias("m")), [key, "other"])
    total = k.groupBy(key).agg(F.sum(sets.jaccard(F.col("k"), F.col("n"), F.col("m"))).alias("s"), F.count("*").alias("c"))
    rate = lambda c: F.coalesce(F.try_divide(F.coalesce(c, F.lit(0.0)), "n_pairs"), F.lit(0.0))
    return pairs.join(total, key, "left").select(key, "n_pairs", rate(F.col("s")).alias("coherence"), rate(F.col("c").cast("double")).alias("shared"))


def permuted_match(members: DataFrame, curated: DataFrame, universe: DataFrame, n_perm: int, seed: int = 42) -> DataFrame:
    """One row: observed mean best Jaccard, mean and deviation of the null, p (at least 1 / (n_perm + 1)) and z.

    A permutation orders the universe by md5(seed|perm|gene) and cuts it into consecutive blocks
    of the programs' sizes, in order of their names. Every task gets the universe once and makes its share
    of the permutations from it in memory (some 150 bytes a gene), so no permutation is shuffled; a null is no gene.
    """

    def mean_best(df: DataFrame, scope: list[str]) -> DataFrame:
        pairs = df.join(curated.select("set_name", "gene"), "gene").groupBy(*scope, "program", "set_name").agg(F.count("*").alias("k"))
        na, nb = df.groupBy(*scope, "program").agg(F.count("*").alias("n")), curated.groupBy("set_name").agg(F.count("*").alias("m"))
        best = pairs.join(na, [*scope, "program"]).join(nb, "set_name").groupBy(*scope, "program").agg(F.max(sets.jaccard(F.col("k"), F.col("n"), F.col("m"))).alias("j"))
        return na.join(best, [*scope, "program"], "left").groupBy(*scope).agg(F.avg(F.coalesce("j", F.lit(0.0))).alias("v"))

    spark = members.sparkSession
    size = members.groupBy("program").agg(F.count("*").alias("n")).orderBy("program").collect()  # one row a program
    named, n = np.array([r["program"] is not None for r in size], bool), np.array([r["n"] for r in size], np.int64)
    known = curated.where("set_name is not null")
    sets_ = known.groupBy("set_name").agg(F.count("*").alias("m")).withColumn("id", F.row_number().over(Window.orderBy("set_name")) - 1)  # one row a set
    m = np.array([r["m"] for r in sets_.orderBy("id").select("m").collect()], np.int64)
    held = known.join(sets_, "set_name").groupBy("gene").agg(F.collect_list("id").alias("ids"))
    tasks = min(n_perm, 2 * spark.sparkContext.defaultParallelism)
    # a number for each partition that its hash leads to
    lead = spark.range(64 * tasks).groupBy(F.pmod(F.hash(F.col("id").cast("int")), F.lit(tasks))).agg(F.min("id").cast("int")).collect()
    lead = sorted(r[1] for r in lead)
    every = F.explode(F.array(*[F.lit(x) for x in lead])).alias("task")
    genes = universe.select("gene").where("gene is not null").distinct().join(held, "gene", "left").select(F.col("gene").cast("string").alias("gene"), "ids")

    def permuted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got or not len(n):
            return
        table = pa.Table.from_batches(got)
        texts = Texts(table.column("gene").cast("binary").to_pylist())
        ids = table.column("ids").combine_chunks()
        row = np.repeat(np.arange(len(ids)), ids.value_lengths().fill_null(0).to_numpy())
        group = ids.flatten().to_numpy()
        first = lead.index(got[0].column("task")[0].as_py())
        del got, table, ids
        end = np.minimum(np.cumsum(n), len(texts.size))
        own = np.diff(end, prepend=0)
        inner = end[end < len(texts.size)]
        v = {}
        for perm in range(first + 1, n_perm + 1, len(lead)):
            high, low = texts.md5(f"{seed}|{perm}|".encode())
            order = np.sort(high)
            block = np.searchsorted(order[inner], high, "right")
            if (order[inner] == order[inner - 1]).any():  # a border between equal first halves
                place = np.empty(len(high), np.int64)
                place[np.lexsort((low, high))] = np.arange(len(high))
                block = np.searchsorted(inner, place, "right")
            j = np.zeros(len(n) + 1)
            cell = block[row] * len(m) + group
            if len(j) * len(m) <= max(1 << 20, 4 * len(cell)):
                k = np.bincount(cell, minlength=len(j) * len(m))
                cell = np.flatnonzero(k)
                k = k[cell]
            else:
                cell, k = np.unique(cell, return_counts=True)
            inside = cell < len(n) * len(m)
            cell, k = cell[inside], k[inside]
            at = cell // max(len(m), 1)
            np.maximum.at(j, at, k / (own[at] + m[cell % max(len(m), 1)] - k))
            j = np.where(named, j[:-1], 0.0)[own > 0]
            if len(j):
                v[perm] = j.mean()
        yield pa.RecordBatch.from_pydict({"perm": pa.array(list(v), pa.int32()), "v": pa.array(list(v.values()), pa.float64())})

    null = genes.select(every, "gene", "ids").repartition(tasks, "task").mapInArrow(permuted, "perm int, v double")
    seen = mean_best(members.withColumn("perm", F.lit(0)), ["perm"]).select(F.col("v").alias("observed"))
    both = null.join(F.broadcast(seen))  # one row
    out = both.groupBy("observed").agg(F.avg("v").alias("null_mean"), F.stddev_pop("v").alias("null_sd"), F.count(F.when(F.round("v", 12) >= F.round("observed", 12), 1)).alias("n_extreme"))
    p = F.greatest(F.col("n_extreme") / n_perm, F.lit(1.0 / (n_perm + 1)))
    return out.select("observed", "null_mean", "null_sd", p.alias("p_value"), F.coalesce(F.try_divide(F.col("observed") - F.col("null_mean"), "null_sd"), F.lit(0.0)).alias("z"))


def silhouettes(vectors: DataFrame, label: str = "label", block_rows: int = 2_000) -> DataFrame:
    """gene, label, silhouette by Euclidean distance; 0 for a cluster of one. Block by block, only sums by label are kept."""
    blocks = max(1, -(-vectors.count() // block_rows))
    df = vectors.select("gene", F.col(label).alias("label"), "v", F.pmod(F.xxhash64("gene"), F.lit(blocks)).cast("int").alias("b"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = df.select(F.col("b").alias("lb"), every.alias("rb"), "gene", "label", "v", F.lit(0).alias("side"))
    right = df.select(every.alias("lb"), F.col("b").alias("rb"), "gene", "label", "v", F.lit(1).alias("side"))

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf.side == 0], pdf[pdf.side == 1]
        if not len(a) or not len(b):
            return pd.DataFrame({"gene": [], "label": [], "other": [], "s": [], "n": []})
        x, y = np.array(a.v.tolist()), np.array(b.v.tolist())
        d = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0))
        d[a.gene.to_numpy()[:, None] == b.gene.to_numpy()[None]] = 0
        names, at = np.unique(b.label.to_numpy(), return_inverse=True)
        total = np.stack([d[:, at == k].sum(1) for k in range(len(names))], 1)
        return pd.DataFrame(
            {"gene": np.repeat(a.gene.to_numpy(), len(names)), "label": np.repeat(a.label.to_numpy(), len(names)), "other": np.tile(names, len(a)), "s": total.ravel(), "n": np.tile(np.bincount(at), len(a))}
        )

    g, lab = dict(vectors.dtypes)["gene"], dict(vectors.dtypes)[label]
    part = left.unionByName(right).groupBy("lb", "rb").applyInPandas(sums, f"gene {g}, label {lab}, other {lab}, s double, n long")
    part = part.groupBy("gene", "label", "other").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    own, n = F.max(F.when(F.col("label") == F.col("other"), F.col("s"))), F.max(F.when(F.col("label") == F.col("other"), F.col("n")))
    away = F.min(F.when(F.col("label") != F.col("other"), F.col("s") / F.col("n")))
    df = part.groupBy("gene", "label").agg(own.alias("own"), n.alias("n"), away.alias("b"))
    a = F.col("own") / F.greatest(F.col("n") - 1, F.lit(1))
    score = F.when((F.col("n") > 1) & F.col("b").isNotNull(), F.try_divide(F.col("b") - a, F.greatest(F.col("b"), a)))
    return df.select("gene", F.col("label").alias(label), F.coalesce(score, F.lit(0.0)).alias("silhouette"))


def gene_confidence(vectors: DataFrame, label: str = "label") -> DataFrame:
    """gene, label, confidence: the mean of (silhouette + 1) / 2 and the min-max scaled mean cosine to the other members.

    The mean cosine comes from the sum of the cluster's unit vectors, so no pair is formed.
    """
    u = vectors.select("gene", label, embed.unit(F.col("v")).alias("u"))
    total = u.select(label, F.posexplode("u").alias("i", "x")).groupBy(label, "i").agg(F.sum("x").alias("s"))
    total = total.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda r: r["s"]).alias("t"))
    n = u.groupBy(label).agg(F.count("*").alias("n"))
    own = embed.dot(F.col("u"), F.col("t")) - embed.dot(F.col("u"), F.col("u"))
    c = u.join(total, label).join(n, label).withColumn("c", F.when(F.col("n") > 1, own / F.greatest(F.col("n") - 1, F.lit(1))))
    part = Window.partitionBy(label)
    lo, hi = F.min("c").over(part), F.max("c").over(part)
    c = c.withColumn("link", F.when(F.col("c").isNull() | (hi - lo <= 1e-12), 1.0).otherwise((F.col("c") - lo) / (hi - lo)))
    out = c.join(silhouettes(vectors, label), ["gene", label])
    value = ((F.col("silhouette") + 1) / 2 + F.col("link")) / 2
    return out.select("gene", label, F.greatest(F.least(value, F.lit(1.0)), F.lit(0.0)).alias("confidence"))


def method_weights(coherence: DataFrame) -> DataFrame:
    """method, weight from (method, coherence): cut at min(0.05, 1 / m) from below, made to sum to 1."""
    n = F.count("*").over(Window.partitionBy())  # one row a method
    w = F.greatest(F.coalesce(F.nanvl("coherence", F.lit(0.0)), F.lit(0.0)), F.least(F.lit(0.05), 1.0 / n))
    df = coherence.withColumn("w", w)
    return df.select("method", (F.col("w") / F.sum("w").over(Window.partitionBy())).alias("weight"))


def merged_small(labels: DataFrame, pairs: DataFrame, least: int = 3) -> DataFrame:
    """gene, label: programs of fewer than ``least`` genes join the large one of best mean co-occurrence.

    A gene without any tie to a large program joins the largest one.
    """
    n = labels.groupBy("label").agg(F.count("*").alias("n"))
    tagged = labels.join(n, "label")
    large, small = tagged.where(F.col("n") >= least), tagged.where(F.col("n") < least)
    e = discover.both_ways(pairs)
    tie = small.select(F.col("gene").alias("src"), F.col("label").alias("own")).join(e, "src").join(large.select(F.col("gene").alias("dst"), "label", "n"), "dst")
    tie = tie.groupBy("own", "label", "n").agg(F.sum("weight").alias("w"))
    best = tie.withColumn("k", F.row_number().over(Window.partitionBy("own").orderBy(F.desc(F.round(F.col("w") / F.col("n"), 9)), "label"))).where("k = 1").select("own", F.col("label").alias("to"))
    first = n.where(F.col("n") >= least).agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("f")).select(F.col("f.label").alias("fallback"))
    moved = small.select("gene", F.col("label").alias("own")).join(best, "own", "left").join(F.broadcast(first))
    return large.select("gene", "label").unionByName(moved.select("gene", F.coalesce("to", "fallback", "own").alias("label")))


def resolution_sweep(vectors: DataFrame, edges: DataFrame, resolutions: list[float]) -> DataFrame:
    """resolution, n_programs, modularity, coherence, score (their mean) of communities at each resolution."""
    rows = []
    for r in resolutions:
        found = discover.communities(edges, r)
        q = discover.modularity(edges, found.select("gene", "label")).first()[0] or 0.0
        c = embed.coherence(vectors, found.select("gene", "label"), "label").agg(F.avg("coherence")).first()[0] or 0.0
        rows.append((float(r), found.select("label").distinct().count(), q, c, (q + c) / 2))
    return vectors.sparkSession.createDataFrame(rows, "resolution double, n_programs long, modularity double, coherence double, score double")


def voted_k(vectors: DataFrame, ks: list[int], n_reference: int = 5, seed: int = 42) -> DataFrame:
    """k, cost, silhouette, calinski_harabasz, gap, gap_se, votes: the three criteria vote, ties by silhouette."""
    data = materialize(vectors.select("gene", "v")).withColumn("features", array_to_vector("v"))
    size = data.count()
    span = vectors.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    lo, hi = zip(*[(r["lo"], r["hi"]) for r in span.orderBy("i").collect()])  # one row a dimension
    low, high = F.array(*[F.lit(a) for a in lo]), F.array(*[F.lit(b) for b in hi])

    def uniform(b: int):
        """A point of the box for every gene, by a keyed hash."""

        def draw(x, i):
            u = F.pmod(F.xxhash64("gene", i, F.lit(b), F.lit(seed)), F.lit(1_000_003)) / 1_000_003.0
            return F.element_at(low, i + 1) + (F.element_at(high, i + 1) - F.element_at(low, i + 1)) * u

        return materialize(data.select(F.transform("v", draw).alias("v")))

    boxes = [uniform(b) for b in range(n_reference)]
    rows = []
    for k in ks:
        model = KMeans(k=k, seed=seed, maxIter=50).fit(data)
        got = model.transform(data).select("gene", "v", F.col("prediction").alias("label"))
        sil = silhouettes(got).agg(F.avg("silhouette")).first()[0]
        ch = embed.cluster_quality(got).first()["calinski_harabasz"]
        logs = [np.log(max(KMeans(k=k, seed=seed, maxIter=20).fit(x.select(array_to_vector("v").alias("features"))).summary.trainingCost, 1e-12)) for x in boxes]
        cost = model.summary.trainingCost
        rows.append([k, cost, sil, ch or 0.0, float(np.mean(logs) - np.log(max(cost, 1e-12))), float(np.std(logs) * np.sqrt(1 + 1 / n_reference))])
    release(*boxes)
    votes = {k: 0 for k in ks}
    votes[max(rows, key=lambda r: r[2])[0]] += 1
    votes[max(rows, key=lambda r: r[3])[0]] += 1
    votes[next((a[0] for a, b in zip(rows, rows[1:]) if a[4] >= b[4] - b[5]), rows[-1][0])] += 1
    return vectors.sparkSession.createDataFrame([(*r, votes[r[0]], size) for r in rows], "k int, cost double, silhouette double, calinski_harabasz double, gap double, gap_se double, votes int, n long")


def refit_stability(vectors: DataFrame, discover_fn: Callable[[DataFrame], DataFrame], rounds: int = 3, fraction: float = 0.8, seed: int = 42) -> DataFrame:
    """round, n_genes, mean_best_jaccard: programs of keyed subsamples against those of all genes.

    ``discover_fn`` maps (gene, v) to (gene, label); the subsamples are the statistic's own.
    """
    whole = materialize(discover_fn(vectors).select(F.col("label").cast("string").alias("program"), "gene"))
    out = None
    for r in range(rounds):
        part = vectors.where(F.pmod(F.xxhash64("gene", F.lit(seed + r)), F.lit(10_000)) < int(fraction * 10_000))
        sub = materialize(discover_fn(part).select(F.col("label").cast("string").alias("other"), "gene"))
        base = whole.join(sub.select("gene"), "gene", "left_semi")
        pairs = sets.best_match(sets.overlap(base, sub, ["program"], ["other"]), ["program"], "other")
        row = base.select("program").distinct().join(pairs.select("program", "jaccard"), "program", "left").agg(F.avg(F.coalesce("jaccard", F.lit(0.0))).alias("mean_best_jaccard"))
        row = row.select(F.lit(r).alias("round"), F.lit(sub.count()).alias("n_genes"), "mean_best_jaccard")
        out = row if out is None else out.unionByName(row)
    return out


def best_program_of_sets(hits: DataFrame) -> DataFrame:
    """set_name, program, p_value, fdr, fold, n_programs: for each reference the program of smallest p, ties by name."""
    w = Window.partitionBy("set_name")
    df = hits.withColumn("k", F.row_number().over(w.orderBy("p_value", "program"))).withColumn("n_programs", F.count("*").over(w))
    return df.where("k = 1").select("set_name", "program", "p_value", "fdr", "fold", "n_programs")


def bootstrap_stability(values: DataFrame, samples: DataFrame, discover_fn: Callable[[DataFrame], DataFrame], reference: DataFrame, rounds: int = 20, seed: int = 42) -> DataFrame:
    """bootstrap_id, best_match_jaccard: programs refitted to samples drawn with replacement within each group, against the reference.

    Draw j of group g in round b takes the sample at place md5(seed|b|g|j) mod size of the group's
    order by name; a sample drawn again is another sample of the same values. ``discover_fn`` maps
    (sample, gene, value) to (gene, label); reference is (program, gene). The rounds are the statistic's own.
    """
    part = Window.partitionBy("grp")
    place = samples.select("sample", "grp").distinct().withColumn("i", F.row_number().over(part.orderBy("sample")) - 1).withColumn("n", F.count("*").over(part))
    place = materialize(place)
    out = None
    for b in range(rounds):
        key = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(str(b)), F.col("grp").cast("string"), F.col("i").cast("string"))), 1, 12), 16, 10).cast("long")
        drawn = place.select("grp", F.pmod(key, F.col("n")).alias("i"), F.concat_ws("#", F.col("grp").cast("string"), F.col("i").cast("string")).alias("as_sample"))
        drawn = drawn.join(place.select("grp", "i", "sample"), ["grp", "i"])
        resampled = values.join(drawn.select("sample", "as_sample"), "sample").select(F.col("as_sample").alias("sample"), "gene", "value")
        found = materialize(discover_fn(resampled).select(F.col("label").cast("string").alias("other"), "gene"))
        pairs = sets.best_match(sets.overlap(reference.select("program", "gene"), found, ["program"], ["other"]), ["program"], "other")
        score = reference.select("program").distinct().join(pairs.select("program", "jaccard"), "program", "left").agg(F.coalesce(F.avg(F.coalesce("jaccard", F.lit(0.0))), F.lit(0.0)).alias("best_match_jaccard"))
        row = score.select(F.lit(b).alias("bootstrap_id"), "best_match_jaccard")
        out = row if out is None else out.unionByName(row)
    return out


def side_by_side(hits: DataFrame, annotated: DataFrame, reference: DataFrame, tested: DataFrame | None = None, fdr: float = 0.25) -> DataFrame:
    """For every reference set: size, the ranked test's nes, p and FDR, and the best significant program with its annotation.

    hits are those of ``annotate.annotation_hits``, annotated ``annotate.annotated_programs``, tested
    (set_name, nes, p_value, fdr). Sets without a significant program have overlap and fold 0, p and FDR 1.
    """
    size = reference.select("set_name", "gene").distinct().groupBy("set_name").agg(F.count("*").alias("pathway_size"))
    order = Window.partitionBy("set_name").orderBy(F.round("p_value", 14), "program")
    best = hits.where(F.col("fdr") <= fdr).withColumn("_k", F.row_number().over(order)).where("_k = 1")
    best = best.join(annotated.select("program", "n_novel", "pathway_span"), "program").select(
        "set_name", "program", F.col("overlap_n").alias("overlap"), F.col("p_value").alias("program_p"), F.col("fdr").alias("program_fdr"), "fold", "fraction", "n_novel", "pathway_span"
    )
    out = size.join(best, "set_name", "left")
    if tested is not None:
        out = out.join(tested.select("set_name", F.col("nes").alias("gsea_nes"), F.col("p_value").alias("gsea_p"), F.col("fdr").alias("gsea_fdr")), "set_name", "left")
        out = out.withColumn("gsea_significant", F.coalesce(F.col("gsea_fdr") <= fdr, F.lit(False)))
    out = out.withColumn("program_significant", F.col("program").isNotNull()).fillna({"program": "", "program_p": 1.0, "program_fdr": 1.0, "fold": 0.0, "fraction": 0.0})
    return out.fillna(0, ["overlap", "n_novel", "pathway_span"])
