"""One entry to the enrichment methods, and the tests of gene lists against hard and soft sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoloom.operators import gsea, stats

METHODS = ("fisher", "gsea", "ssgsea", "aucell")


def fisher_lists(query: DataFrame, sets: DataFrame, universe: DataFrame, lists: list[str], set_key: str, correction: str = "bh") -> DataFrame:
    """lists..., set, overlap, program_size, query_size, background_size, odds_ratio, p_value, folds, fdr.

    query and universe are (lists..., gene), sets (set, gene); a set counts with its genes of the
    universe, a list with its genes of the universe. Sets without a gene there drop out.
    """
    u = universe.select(*lists, "gene").distinct()
    q = u.join(query.select(*lists, "gene").distinct().withColumn("hit", F.lit(1)), [*lists, "gene"], "left")
    sizes = q.groupBy(*lists).agg(F.count("*").alias("background_size"), F.count("hit").alias("query_size"))
    rows = q.join(sets.select(set_key, "gene").distinct(), "gene").groupBy(*lists, set_key).agg(F.count("hit").alias("overlap"), F.count("*").alias("program_size"))
    rows = rows.join(sizes, lists) if lists else rows.join(F.broadcast(sizes))  # one row
    k, m, qs, n = (F.col(c) for c in ("overlap", "program_size", "query_size", "background_size"))
    rows = rows.withColumn("odds_ratio", F.try_divide((k * (n - m - qs + k)).cast("double"), (m - k) * (qs - k)))
    rows = rows.withColumn("p_value", stats.fisher_greater(k, m, qs, n)).withColumns(stats.fold_columns(k, m, qs, n))
    lo, hi = stats.four_term_interval(k, m, qs, n)
    rows = rows.withColumn("fold_lo", lo).withColumn("fold_hi", hi)
    return stats.adjusted(rows, "p_value", "fdr", correction, lists) if lists else stats.adjusted(rows, "p_value", "fdr", correction)


def weighted_fisher(query: DataFrame, weighted: DataFrame, universe: DataFrame, lists: list[str], set_key: str, threshold: float = 0.1) -> DataFrame:
    """Soft sets (set, gene, weight) at a threshold, tested as hard ones, with weighted_overlap: the weights of all query genes in the set."""
    tested = fisher_lists(query, weighted.where(F.col("weight") >= threshold), universe, lists, set_key)
    sums = query.select(*lists, "gene").distinct().join(weighted, "gene").groupBy(*lists, set_key).agg(F.sum("weight").alias("weighted_overlap"))
    out = tested.join(sums, [*lists, set_key], "left")
    return out.withColumn("weighted_overlap", F.coalesce("weighted_overlap", F.lit(0.0)))


def run(
    method: str, sets: DataFrame, set_key: str, lists: list[str], query: DataFrame | None = None, universe: DataFrame | None = None, ranked: DataFrame | None = None,
    values: DataFrame | None = None, n_genes: int | None = None, batches: DataFrame | None = None, n_perm: int = 1000, seed: int = 42, top_fraction: float = 0.05, correction: str = "bh",
) -> DataFrame:
    """The results of one of METHODS with its name.

    fisher takes query and universe (lists..., gene), gsea ranked, the single-sample methods values (sample, gene, value) and n_genes, with
    batches (sample, batch) the scores centred by batch. ``lists`` names the one key of a sample there.
    """
    name = method.lower().strip()
    if name not in METHODS:
        raise ValueError(f"no method {method!r}; there are {', '.join(METHODS)}")
    needs = {"fisher": {"query": query, "universe": universe}, "gsea": {"ranked": ranked}, "ssgsea": {"values": values, "n_genes": n_genes}, "aucell": {"values": values, "n_genes": n_genes}}[name]
    if absent := [k for k, v in needs.items() if v is None]:
        raise ValueError(f"{name} needs {' and '.join(absent)}")
    if name == "fisher":
        out = fisher_lists(query, sets, universe, lists, set_key, correction)
    elif name == "gsea":
        out = gsea.preranked(ranked, sets, lists, set_key, n_perm, seed=seed)
        if correction == "storey":
            out = stats.adjusted(out.drop("fdr"), "p_value", "fdr", correction)
    else:
        hit = gsea.sample_hits(values, lists[0], sets, set_key, n_genes)
        out = gsea.ssgsea(hit, lists[0], set_key) if name == "ssgsea" else gsea.aucell(hit, lists[0], set_key, top_fraction)
        if batches is not None:
            out = gsea.batch_centred(out.join(batches, lists[0]), "batch", set_key).drop("score", "batch").withColumnRenamed("corrected", "score")
    return out.withColumn("method", F.lit(name))
