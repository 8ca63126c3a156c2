"""Ranked-list enrichment: running sums over hits only, keyed permutations, leading edges.

A ranking is (list keys..., gene, score, rank_no, n_genes); sets are (set key, gene[, weight]).
Between two hits the running sum only falls, so its extremes lie at the hits: nothing of size
genes x sets is ever formed, only the hits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genoloom.operators.stats import bh, cohens_d
from genoloom.runtime import materialize


def ranking(scores: DataFrame, lists: list[str], gene: str = "gene", score: str = "score") -> DataFrame:
    """One row a gene: of repeats the largest absolute score counts (ties: the larger signed); ranked from the top, ties by gene."""
    best = Window.partitionBy(*lists, gene).orderBy(F.desc(F.abs(score)), F.desc(score))
    one = scores.withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k")
    part = Window.partitionBy(*lists)
    return one.select(
        *lists,
        F.col(gene).alias("gene"),
        F.col(score).alias("score"),
        F.row_number().over(part.orderBy(F.desc(score), gene)).alias("rank_no"),
        F.count("*").over(part).alias("n_genes"),
    )


def hits(ranked: DataFrame, sets: DataFrame, set_key: str, least: int = 1, weight: str | None = None, power: float = 1.0) -> DataFrame:
    """The genes of each set that a list holds, with their walk weight; sets of fewer than ``least`` hits drop out."""
    w = F.pow(F.abs("score"), F.lit(power)) if power != 1.0 else F.abs("score")
    if weight:
        w = w * F.col(weight)
    joined = ranked.join(sets, "gene").withColumn("w", w)
    keys = [c for c in ranked.columns if c not in ("gene", "score", "rank_no", "n_genes")]
    out = joined.withColumn("n_hits", F.count("*").over(Window.partitionBy(*keys, set_key)))
    return out.where(F.col("n_hits") >= least)


def walk(hit: DataFrame, keys: list[str], rank: str = "rank_no") -> DataFrame:
    """Adds the running sum right after and right before each hit."""
    part = Window.partitionBy(*keys)
    run = part.orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    df = hit.withColumn("_sum", F.sum("w").over(part)).withColumn("_cum", F.sum("w").over(run)).withColumn("_i", F.count("*").over(run))
    total = F.when(F.col("_sum") == 0, 1.0).otherwise(F.col("_sum"))
    miss = F.coalesce(F.try_divide((F.col(rank) - F.col("_i")).cast("double"), F.col("n_genes") - F.col("n_hits")), F.lit(0.0))
    return (
        df.withColumn("after", F.col("_cum") / total - miss)
        .withColumn("before", F.when(F.col(rank) > 1, (F.col("_cum") - F.col("w")) / total - miss))
        .withColumn("end", F.col("_sum") / total - F.when(F.col("n_genes") > F.col("n_hits"), 1.0).otherwise(0.0))
        .drop("_sum", "_cum", "_i")
    )


def score_of(high: Column, low: Column) -> Column:
    """The larger deviation; the positive one on a tie (compared at 12 digits)."""
    return F.when(F.round(F.abs(high), 12) >= F.round(F.abs(low), 12), high).otherwise(low)


def enrichment_scores(hit: DataFrame, keys: list[str], rank: str = "rank_no", all_hits_zero: bool = False) -> DataFrame:
    """keys..., n_genes, n_hits, es."""
    df = walk(hit, keys, rank).groupBy(*keys).agg(
        F.first("n_genes").alias("n_genes"), F.first("n_hits").alias("n_hits"), F.max("after").alias("high"), F.min("before").alias("low"), F.min("end").alias("end")
    )
    low = F.least(F.coalesce("low", F.lit(0.0)), F.col("end"), F.lit(0.0))
    es = score_of(F.col("high"), low)
    if all_hits_zero:
        es = F.when(F.col("n_genes") == F.col("n_hits"), 0.0).otherwise(es)
    return df.select(*keys, "n_genes", "n_hits", es.alias("es"))


def leading_edge(hit: DataFrame, keys: list[str]) -> DataFrame:
    """keys..., n_leading, leading_genes: hits up to the peak, or from the trough on for a negative score."""
    df = walk(hit, keys)
    part = Window.partitionBy(*keys)
    df = df.withColumn("high", F.max("after").over(part)).withColumn("low", F.least(F.coalesce(F.min("before").over(part), F.lit(0.0)), F.lit(0.0)))
    up = F.round(F.abs("high"), 12) >= F.round(F.abs("low"), 12)
    peak = F.min(F.when(F.round("after", 12) == F.round("high", 12), F.col("rank_no"))).over(part)
    trough = F.min(F.when(F.round("before", 12) == F.round("low", 12), F.col("rank_no"))).over(part)
    df = df.withColumn("up", up).withColumn("peak", peak).withColumn("trough", trough)
    inside = F.when(F.col("up"), F.col("rank_no") <= F.col("peak")).otherwise(F.col("rank_no") >= F.col("trough"))
    edge = df.where(inside).groupBy(*keys).agg(F.count("*").alias("n_leading"), F.array_sort(F.collect_list(F.struct("rank_no", "gene"))).alias("x"))
    return edge.select(*keys, "n_leading", F.array_join(F.col("x.gene"), ",").alias("leading_genes"))


CHUNK_ROWS, PERM_BLOCKS = 1_000_000, 20


def permutations(n_perm: int, n_sets: int) -> int:
    """More than 100 sets get 10 permutations a set, up to 10,000: else no p-value passes the correction."""
    return max(n_perm, min(10 * n_sets, 10_000)) if n_sets > 100 else n_perm


def _orders(genes: list[str], perm: int, seed: int) -> np.ndarray:
    """The place of each gene in the order of md5(seed|perm|gene)."""
    head = hashlib.md5(f"{seed}|{perm}|".encode())
    digests = []
    for g in genes:
        h = head.copy()
        h.update(g)
        digests.append(h.digest())
    halves = np.frombuffer(b"".join(digests), ">u8").astype(np.uint64).reshape(-1, 2)
    place = np.empty(len(genes), np.int64)
    place[np.lexsort((halves[:, 1], halves[:, 0]))] = np.arange(len(genes))
    return place


def _null(done: int, n_perm: int, seed: int):
    """For a chunk of packed lists and a block of the permutations done + 1 to n_perm: same-sign counts and sums of each set."""

    def counted(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        block = table.column("block")[0].as_py()
        ranked, hit = (table.column(c).combine_chunks() for c in ("genes", "hits"))
        n_genes = ranked.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        start = np.cumsum(n_genes) - n_genes
        coded = pc.dictionary_encode(ranked.flatten().field("gene"))
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        genes = [g.encode() for g in coded.dictionary.to_pylist()]
        code, score = coded.indices.to_numpy().astype(np.int64), ranked.flatten().field("score").to_numpy()
        owner = np.repeat(np.arange(len(n_genes)), n_genes)
        # sets by falling size, hits of a set in a row
        flat, size = hit.flatten(), hit.value_lengths().to_numpy(zero_copy_only=False)
        sets = flat.field("size").to_numpy().astype(np.int64)
        by = np.argsort(-sets, kind="stable")
        of = np.repeat(np.arange(len(size)), size)[by]
        m, es = sets[by], flat.field("es").to_numpy()[by]
        places = flat.field("places").take(pa.array(by))
        at = places.flatten().field("rank_no").to_numpy().astype(np.int64) - 1 + np.repeat(start[of], m)
        weight = places.flatten().field("weight").to_numpy()
        n, first = n_genes[of], np.cumsum(m) - m
        row = np.repeat(np.arange(len(m)), m)
        base = np.repeat(start[of], m)
        live = [int(np.searchsorted(-m, -k, side="left")) for k in range(int(m[0]))]  # sets of more than k hits
        wide = n > m
        gap = np.where(wide, n - m, 1)
        up, big = ~(es < 0), np.round(np.abs(es), 12)
        n_same, n_extreme, total = np.zeros(len(m), np.int64), np.zeros(len(m), np.int64), np.zeros(len(m))
        width = int(n_genes.max()) + 1
        for perm in range(done + 1 + block, n_perm + 1, PERM_BLOCKS):
            order = np.argsort(owner * len(genes) + _orders(genes, perm, seed)[code])
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order)) - start[owner] + 1
            r = rank[at]
            o = np.argsort(row * width + r)
            r = r[o]
            w = score[base + r - 1] * weight[o]
            cum, tot = np.empty(len(w)), np.zeros(len(m))
            for k, c in enumerate(live):
                ix = first[:c] + k
                tot[:c] += w[ix]
                cum[ix] = tot[:c]
            end = np.where(tot == 0, 0.0, 1.0) - wide
            tot = np.where(tot == 0, 1.0, tot)
            high, low = np.full(len(m), -np.inf), np.minimum(end, 0.0)
            for k, c in enumerate(live):
                ix = first[:c] + k
                miss = np.where(wide[:c], (r[ix] - (k + 1)) / gap[:c], 0.0)
                np.maximum(high[:c], cum[ix] / tot[:c] - miss, out=high[:c])
                np.fmin(low[:c], np.where(r[ix] > 1, (cum[ix] - w[ix]) / tot[:c] - miss, 0.0), out=low[:c])
            null = np.where(wide, np.where(np.round(np.abs(high), 12) < np.round(np.abs(low), 12), low, high), 0.0)
            same = ~(null < 0) == up
            n_same += same
            n_extreme += same & (np.isnan(null) | (np.round(np.abs(null), 12) >= big))
            total += np.where(same, np.abs(null), 0.0)
        return pa.table({"list": table.column("list").combine_chunks().take(pa.array(of)), "set": flat.field("set").take(pa.array(by)), "n_same": n_same, "n_extreme": n_extreme, "total": total})

    def run(table: pa.Table) -> pa.Table:
        with np.errstate(invalid="ignore"):  # infinite scores give NaN, which counts as the largest number as in SQL
            return counted(table)

    return run


def preranked(
    ranked: DataFrame, sets: DataFrame, lists: list[str], set_key: str, n_perm: int = 1000, least: int = 3, seed: int = 42, weight: str | None = None, raised: bool = True
) -> DataFrame:
    """lists..., set, n_hits, es, nes, p_value, fdr.

    The permutation moves the set's genes to other places of the ranking, whose scores stay: for
    each list and permutation the order of md5(seed|perm|gene), one for all sets. A membership
    ``weight`` moves with its gene. p is the share of the same-sign null that is as extreme, at
    least 1 / (n_perm + 1); NES is ES over the mean size of the same-sign null (where that is
    empty or 0: ES, and 0 with weights). Without weights n_perm is raised for more than 100 sets
    (see ``permutations``), unless ``raised`` is false.
    """
    keys = [*lists, set_key]
    if raised and weight is None:
        n_perm = permutations(n_perm, sets.select(set_key).distinct().count())
    genes, observed = _observed(ranked, sets, lists, set_key, least, weight)
    null = _null_counts(genes, observed, 0, n_perm, seed)
    return _tested(observed.join(null, ["list", "set"]).withColumn("done", F.lit(n_perm)), keys, lists, set_key, F.lit(0.0) if weight else F.col("es"))


def _observed(ranked: DataFrame, sets: DataFrame, lists: list[str], set_key: str, least: int, weight: str | None) -> tuple[DataFrame, DataFrame]:
    """(list, genes) and (list, set, n_hits, es, places), written."""
    hit = hits(ranked, sets, set_key, least, weight)
    scores = enrichment_scores(hit, [*lists, set_key]).select(F.struct(*lists).alias("list"), F.col(set_key).alias("set"), "n_hits", "es")
    place = F.struct("rank_no", (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("weight")).alias("place")
    own = hit.select(F.struct(*lists).alias("list"), F.col(set_key).alias("set"), place).groupBy("list", "set").agg(F.collect_list("place").alias("places"))
    packed = ranked.select(F.struct(*lists).alias("list"), F.struct("rank_no", F.col("gene").cast("string").alias("gene"), F.abs("score").cast("double").alias("score")).alias("g"))
    return materialize(packed.groupBy("list").agg(F.array_sort(F.collect_list("g")).alias("genes"))), materialize(scores.join(own, ["list", "set"]))


def _null_counts(genes: DataFrame, observed: DataFrame, done: int, n_perm: int, seed: int) -> DataFrame:
    """list, set, n_same, n_extreme, total over the permutations done + 1 to n_perm."""
    own = observed.groupBy("list").agg(F.collect_list(F.struct("set", "es", F.col("n_hits").alias("size"), "places")).alias("hits"))
    packed = materialize(genes.join(own, "list"))
    rows = packed.agg(F.sum(F.size("genes"))).first()[0] or 0
    chunk = F.pmod(F.xxhash64("list"), F.lit(-(-rows // CHUNK_ROWS) or 1)).alias("chunk")
    spread = packed.select("list", "genes", "hits", chunk, F.explode(F.sequence(F.lit(0), F.lit(min(n_perm - done, PERM_BLOCKS) - 1))).alias("block"))
    spread = spread.repartition(4 * PERM_BLOCKS, "chunk", "block")
    kinds = {c: observed.schema[c].dataType.simpleString() for c in ("list", "set")}
    null = spread.groupBy("chunk", "block").applyInArrow(_null(done, n_perm, seed), f"list {kinds['list']}, set {kinds['set']}, n_same long, n_extreme long, total double")
    return null.groupBy("list", "set").agg(F.sum("n_same").alias("n_same"), F.sum("n_extreme").alias("n_extreme"), F.sum("total").alias("total"))


def _tested(counts: DataFrame, keys: list[str], lists: list[str], set_key: str, empty: Column) -> DataFrame:
    """es, nes, p_value and fdr from the counts over ``done`` permutations; ``empty`` is the NES without a null."""
    p = F.greatest(F.coalesce(F.try_divide(F.col("n_extreme"), F.col("n_same")), F.lit(0.0)), 1.0 / (F.col("done") + 1))
    mean = F.coalesce(F.try_divide("total", "n_same"), F.lit(0.0))
    nes = F.when(mean > 0, F.col("es") / mean).otherwise(empty)
    out = counts.select("list.*", F.col("set").alias(set_key), "n_hits", "es", nes.alias("nes"), F.least(p, F.lit(1.0)).alias("p_value"), F.col("done").alias("n_perm"))
    return bh(out, "p_value", "fdr", lists, [set_key]).select(*keys, "n_hits", "es", "nes", "p_value", "fdr", *(["n_perm"] if "rounds" in counts.columns else []))


def preranked_adaptive(
    ranked: DataFrame, sets: DataFrame, lists: list[str], set_key: str, n_perm: int = 1000, batch: int = 200, enough: int = 50, least: int = 3, seed: int = 42, fewest: int = 100
) -> DataFrame:
    """As ``preranked`` (with n_perm, the permutations done), but a set leaves once its p-value is settled.

    Permutations come in batches; a set with ``enough`` extreme ones of its sign after at least
    ``fewest`` takes no part in the next batch, so the long run is left to the few sets of small p.
    """
    keys = [*lists, set_key]
    genes, observed = _observed(ranked, sets, lists, set_key, least, None)
    state, active, done, settled = None, observed, 0, None
    while done < n_perm:
        upto = min(done + batch, n_perm)
        new = _null_counts(genes, active, done, upto, seed)
        if state is not None:
            new = new.unionByName(state).groupBy("list", "set").agg(*[F.sum(c).alias(c) for c in ("n_same", "n_extreme", "total")])
        new, done = materialize(new.withColumn("done", F.lit(upto))), upto
        ready = (F.col("n_extreme") >= enough) & F.lit(done >= fewest) | F.lit(done >= n_perm)
        settled = new.where(ready) if settled is None else settled.unionByName(new.where(ready))
        state = new.where(~ready).drop("done")
        active = materialize(observed.join(state.select("list", "set"), ["list", "set"], "left_semi"))
        if active.isEmpty():
            break
    return _tested(observed.join(settled, ["list", "set"]).withColumn("rounds", F.lit(1)), keys, lists, set_key, F.col("es"))


def effect_sizes(ranked: DataFrame, sets: DataFrame, lists: list[str], set_key: str) -> DataFrame:
    """Cohen's d, Hedges' g, fold of mean absolute score with its interval, g over the list's largest |g|.

    Genes outside a set enter through the list's totals, so only hits are joined.
    """
    s, a = F.col("score"), F.abs("score")
    total = ranked.groupBy(*lists).agg(F.count("*").alias("n"), F.sum(s).alias("t1"), F.sum(s * s).alias("t2"), F.sum(a).alias("ta"))
    inside = ranked.join(sets, "gene").groupBy(*lists, set_key).agg(F.count("*").alias("n1"), F.sum(s).alias("s1"), F.sum(s * s).alias("s2"), F.sum(a).alias("sa"))
    df = inside.join(total, lists).withColumn("n2", F.col("n") - F.col("n1"))
    m1, m2 = F.col("s1") / F.col("n1"), F.try_divide(F.col("t1") - F.col("s1"), "n2")
    v1 = F.greatest((F.col("s2") - F.col("n1") * m1 * m1) / F.greatest(F.col("n1") - 1, F.lit(1)), F.lit(0.0))
    v2 = F.greatest((F.col("t2") - F.col("s2") - F.col("n2") * m2 * m2) / F.greatest(F.col("n2") - 1, F.lit(1)), F.lit(0.0))
    usable = (F.col("n1") >= 2) & (F.col("n2") >= 2)
    d = F.when(usable, cohens_d(F.col("n1"), m1, v1, F.col("n2"), m2, v2)).otherwise(0.0)
    fold = F.when(usable, F.coalesce(F.try_divide(F.col("sa") / F.col("n1"), (F.col("ta") - F.col("sa")) / F.col("n2")), F.lit(0.0))).otherwise(0.0)
    df = df.withColumn("cohens_d", d).withColumn("hedges_g", d * (1 - 3 / (4.0 * F.col("n") - 9))).withColumn("fold", fold)
    top = F.max(F.abs("hedges_g")).over(Window.partitionBy(*lists))
    se = 1.96 * F.abs("fold") / F.sqrt(F.greatest("n1", F.lit(1)))
    return df.select(
        *lists, set_key, F.col("n1").alias("n_hits"), "cohens_d", "hedges_g", F.col("fold").alias("fold_enrichment"),
        F.greatest(F.col("fold") - se, F.lit(0.0)).alias("fold_lo"), (F.col("fold") + se).alias("fold_hi"),
        (F.col("hedges_g") / F.when(top == 0, 1.0).otherwise(top)).alias("normalised_effect"),
    )


def curve(ranked: DataFrame, hit: DataFrame, keys: list[str], max_points: int = 400) -> DataFrame:
    """keys..., rank_no, running: the walk at hits, thinned to at most about ``max_points`` points."""
    df = walk(hit, keys)
    part = Window.partitionBy(*keys).orderBy("rank_no")
    i, step = F.row_number().over(part) - 1, F.greatest(F.ceil(F.col("n_hits") / max_points), F.lit(1))
    return df.withColumn("_i", i).where(F.col("_i") % step == 0).select(*keys, "rank_no", "gene", F.col("after").alias("running"))


def sample_hits(values: DataFrame, sample: str, sets: DataFrame, set_key: str, n_genes: int) -> DataFrame:
    """Hits of each (sample, set) for single-sample scores; ``values`` holds the positive values only.

    Genes of value 0 rank behind all others, ordered by name as all ties are; of a set's genes
    that a sample lacks only the count matters.
    """
    ranked = values.withColumn("rank_no", F.row_number().over(Window.partitionBy(sample).orderBy(F.desc("value"), "gene")))
    sizes = sets.groupBy(set_key).agg(F.count("*").alias("set_size"))
    return ranked.join(sets, "gene").join(sizes, set_key).withColumn("n_genes", F.lit(n_genes))


def ssgsea(hit: DataFrame, sample: str, set_key: str, alpha: float = 0.25) -> DataFrame:
    """sample, set, score: maximum plus minimum of the walk with weights value^alpha.

    The set's genes of value 0 add nothing at their places; they only shorten the misses.
    """
    keys = [sample, set_key]
    df = hit.withColumn("w", F.pow("value", F.lit(alpha)))
    part = Window.partitionBy(*keys)
    run = part.orderBy("rank_no").rowsBetween(Window.unboundedPreceding, 0)
    i, cum, total = F.count("*").over(run), F.sum("w").over(run), F.sum("w").over(part)
    miss = F.coalesce(F.try_divide((F.col("rank_no") - i).cast("double"), F.col("n_genes") - F.col("set_size")), F.lit(0.0))
    df = df.withColumn("after", cum / total - miss).withColumn("before", F.when(F.col("rank_no") > 1, (cum - F.col("w")) / total - miss))
    df = df.groupBy(*keys).agg(F.max("after").alias("high"), F.min("before").alias("low"), F.max("n_genes").alias("n"), F.max("set_size").alias("m"))
    end = F.when(F.col("n") > F.col("m"), 0.0).otherwise(1.0)
    return df.select(*keys, (F.greatest("high", end) + F.least(F.coalesce("low", F.col("high")), F.col("high"), end)).alias("score"))


def aucell(hit: DataFrame, sample: str, set_key: str, top_fraction: float = 0.05) -> DataFrame:
    """sample, set, score: area under the recovery curve of the top genes over its maximum (closed form)."""
    r = F.greatest(F.ceil(F.lit(top_fraction) * F.col("n_genes")), F.lit(1))
    m = F.least("set_size", r)
    area = F.sum(F.when(F.col("rank_no") <= r, r - F.col("rank_no") + 1).otherwise(0))
    most = F.max(m * r - m * (m - 1) / 2.0)
    return hit.groupBy(sample, set_key).agg((area / most).alias("score"))


def batch_centred(scores: DataFrame, batch: str, set_key: str, score: str = "score") -> DataFrame:
    """Each batch of a set is moved to the set's overall mean."""
    own, all_ = F.avg(score).over(Window.partitionBy(batch, set_key)), F.avg(score).over(Window.partitionBy(set_key))
    return scores.withColumn("corrected", F.col(score) - own + all_)
