"""The two product paths as one call each: discovery from an expression table, and comparison on one ranking."""

from __future__ import annotations

import os
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genoloom.operators import annotate, discover, embed, enrich, expression, gsea, packed, report, sets, stats
from genoloom.runtime import materialize
from genoloom.sources import gmt, tables


@dataclass
class Discovery:
    group_a: str
    group_b: str
    n_programs: int = 20
    k_neighbours: int = 15
    n_components: int = 30
    diffusion_steps: int = 3
    n_perm: int = 1000
    seed: int = 42
    fdr: float = 0.05
    fallback_genes: int = 200
    least_effect: float = 0.2
    least_genes: int = 10
    normalise: bool = True


def expression_vectors(values: DataFrame, samples: DataFrame) -> DataFrame:
    """gene, v: the values of a gene over the samples in a fixed order, zeros filled in the array only."""
    order = samples.select("sample").distinct().withColumn("i", F.row_number().over(Window.orderBy("sample")) - 1)  # samples are few
    n = order.count()
    rows = values.join(order, "sample").groupBy("gene").agg(F.map_from_entries(F.collect_list(F.struct("i", "value"))).alias("m"))
    return rows.select("gene", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0))).alias("v"))


def discovery(values: DataFrame, samples: DataFrame, references: DataFrame, config: Discovery) -> dict[str, DataFrame]:
    """(sample, gene, value), (sample, grp) and (set_name, gene) -> the result tables by name.

    Vectors are principal components of the genes, smoothed over the neighbour graph; k-means and
    communities vote by co-occurrence; the consensus programs are annotated, tested and gated.
    """
    samples = samples.where(F.col("grp").isin(config.group_a, config.group_b)).select("sample", "grp").distinct()
    sizes = dict(samples.groupBy("grp").count().collect())
    if min(sizes.get(config.group_a, 0), sizes.get(config.group_b, 0)) < 2:
        raise ValueError("each group needs two samples or more")
    values = values.join(samples.select("sample"), "sample", "left_semi").groupBy("sample", "gene").agg(F.sum("value").alias("value"))
    values = materialize(expression.log_cpm(values) if config.normalise else values)
    vectors = embed.principal_components(expression_vectors(values, samples), config.n_components)
    knn = materialize(embed.neighbours(vectors, config.k_neighbours))
    vectors = materialize(embed.diffuse(vectors, knn, config.diffusion_steps))
    found = {
        "kmeans": discover.kmeans_programs(vectors, config.n_programs, config.seed),
        "communities": discover.communities(embed.symmetric_edges(knn)),
    }
    memberships = None
    for name, df in found.items():
        df = df.select(F.lit(name).alias("method"), F.col("label").cast("string").alias("program"), "gene")
        memberships = df if memberships is None else memberships.unionByName(df)
    weights = values.sparkSession.createDataFrame([(m, 1.0 / len(found)) for m in found], "method string, weight double")
    labels = discover.consensus_programs(memberships, weights, quantile=0.5)
    scored = materialize(embed.program_scores(vectors.join(labels, "gene")).withColumn("program", F.concat(F.lit("program_"), F.col("label").cast("string"))))
    members = scored.select("program", "gene")

    de = materialize(expression.two_group_test(values, samples, (config.group_a, config.group_b)))
    ranked = materialize(gsea.ranking(expression.rank_score(de).select("gene", "score").withColumn("l", F.lit(1)), ["l"]))
    overlaps = sets.overlap(members, references.select("set_name", "gene").distinct(), ["program"], ["set_name"], collection=True).withColumnsRenamed({"size_a": "program_n", "size_b": "reference_n"})
    tested = gsea.preranked(ranked, members, ["l"], "program", config.n_perm, 1, config.seed).drop("l")
    changed = de.where(F.col("fdr") <= config.fdr).select("gene")
    if changed.isEmpty():
        changed = de.orderBy("p_value", "gene").limit(config.fallback_genes).select("gene")  # the fallback's size
    gates = annotate.claim_gates(tested, members, de.select("gene", F.col("logfc").alias("change")), ["program"], config.least_effect, config.least_genes)
    scores = scored.join(de.select("gene", "logfc", "p_value"), "gene", "left").withColumns(annotate.context_scores(F.col("score"), F.col("logfc"), F.col("p_value")))
    return {
        "de_results": de,
        "ranked_genes": ranked.select("gene", "score", "rank_no"),
        "dynamic_programs_long": scored.select("program", F.col("position").alias("pos"), "gene", "score"),
        "annotation_matches": annotate.top_references(overlaps, 1).select("program", "set_name", "jaccard", "overlap_n"),
        "reference_overlap_long": overlaps,
        "enrichment_fisher": fisher(members, changed, de.select("gene")),
        "enrichment_gsea_with_claim_gates": gates,
        "contextual_membership_scores": scores.drop("v", "label"),
        "membership_top": report.membership_table(scored.select("program", "gene", F.col("score").alias("base_membership")), 20),
    }


def fisher(members: DataFrame, query: DataFrame, universe: DataFrame) -> DataFrame:
    """One-sided Fisher test of a gene list against every program, the universe as background, with BH over programs."""
    u = universe.select("gene").distinct()
    n, q = u.count(), query.select("gene").distinct().join(u, "gene", "left_semi").withColumn("hit", F.lit(1))
    n_q = q.count()
    rows = members.join(u, "gene", "left_semi").join(q, "gene", "left").groupBy("program")
    rows = rows.agg(F.count("hit").alias("overlap"), F.count("*").alias("program_size"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("hit") == 1, F.col("gene").cast("string")))), ",").alias("overlap_genes"))
    rows = rows.withColumn("query_size", F.lit(n_q)).withColumn("background_size", F.lit(n))
    k, m, qs, bs = (F.col(c) for c in ("overlap", "program_size", "query_size", "background_size"))
    rows = rows.withColumn("p_value", stats.fisher_greater(k, m, qs, bs)).withColumns(stats.fold_columns(k, m, qs, bs))
    return stats.bh(rows, "p_value", "fdr", ties=["program"])


def comparison(ranked: DataFrame, dynamic: DataFrame, curated: DataFrame, n_perm: int = 1000, focus: DataFrame | None = None, least: int = 3) -> dict[str, DataFrame]:
    """Dynamic programs (program, gene) and curated sets (set_name, gene) tested on one ranking (gene, score, rank_no, n_genes)."""
    ranked = materialize(ranked.withColumn("l", F.lit(1)))
    a = gmt.universe_restricted(dynamic.select(F.col("program").alias("set_name"), "gene"), ranked, least)
    b = gmt.universe_restricted(curated.select("set_name", "gene"), ranked, least)
    run = lambda s, source: gsea.preranked(ranked, s, ["l"], "set_name", n_perm, least).drop("l").withColumn("source", F.lit(source))
    dyn, cur = materialize(run(a, "dynamic")), materialize(run(b, "curated"))
    programs = a.withColumnRenamed("set_name", "program")
    overlaps = materialize(sets.overlap(programs, b, ["program"], ["set_name"]))
    out = {"combined": dyn.unionByName(cur), "overlap": overlaps}
    anchor = report.anchor(overlaps, [], "program", "set_name").first()
    if focus is not None:
        out["focus_gene_membership"] = report.focus_genes(focus, programs, b)
    if anchor is not None:
        panel = report.curated_panel(cur, overlaps, anchor["program"])
        chosen = b.join(panel.select("set_name"), "set_name", "left_semi")
        out["curated_panel_gsea"] = run(chosen, "panel")  # corrected over the panel only
        best = dyn.where(F.col("set_name") == anchor["program"]).unionByName(cur.where(F.col("set_name") == anchor["set_name"]))
        out["side_by_side"] = best
    return out


def write_results(results: dict[str, DataFrame], folder: str, config: object) -> None:
    """One Parquet table a result, the programs as GMT too, and a manifest with the row counts."""
    counts = {}
    for name, df in results.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        counts[name] = df.sparkSession.read.parquet(f"{folder}/{name}").count()
    if "dynamic_programs_long" in results:
        programs = results["dynamic_programs_long"].withColumnRenamed("program", "set_name").withColumn("gene", F.col("gene").cast("string"))
        gmt.write_gmt(programs, f"{folder}/dynamic_programs.gmt")
    tables.write_manifest(os.path.join(folder, "run_manifest.json"), asdict(config), **counts)


def power(values: DataFrame, samples: DataFrame, members: DataFrame, target: str, folds: list[float], replicates: int, treated_share: float = 0.3, top: int = 200, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """fold, tpr with its Wilson interval, fpr: how often a spiked program is found, and others with it.

    In a replicate the samples first in md5(seed|replicate|sample) are treated and the target's
    genes multiplied there; the top genes by rank-sum are tested against every program. Replicates
    and folds are columns of one plan.
    """
    one = samples.select("sample").distinct()
    n_treated = max(2, round(treated_share * one.count()))
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("rep").cast("string"), F.col("sample").cast("string")))
    place = F.row_number().over(Window.partitionBy("rep").orderBy(key, "sample"))
    grp = one.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("k", place)
    grp = materialize(grp.select("rep", "sample", F.when(F.col("k") <= n_treated, "treated").otherwise("control").alias("grp")))
    spiked = members.where(F.col("program") == target).select("gene").distinct().withColumn("hit", F.lit(True))
    every = F.explode(F.array(*[F.lit(float(x)) for x in folds])).alias("fold")
    factor = F.when(F.col("hit") & (F.col("grp") == "treated"), F.col("fold")).otherwise(1.0)
    moved = values.join(spiked, "gene", "left").join(grp, "sample").select("rep", "sample", "gene", "hit", "grp", "value", every)
    moved = moved.select("rep", "sample", F.struct("fold", "gene").alias("gene"), (F.col("value") * factor).alias("value"))
    z = expression.rank_sums(moved, grp, scope=["rep"]).where("grp = 'treated'").select("rep", "gene.*", "z")
    best = F.row_number().over(Window.partitionBy("rep", "fold").orderBy(F.desc("z"), "gene"))
    query = z.withColumn("k", best).where(F.col("k") <= top).select("rep", "fold", "gene")  # the tested list's size
    universe = values.select("gene").distinct().select("gene", every).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    tested = enrich.fisher_lists(query, members.withColumnRenamed("program", "set_name"), universe, ["rep", "fold"], "set_name")
    own, found = F.col("set_name") == target, F.col("fdr") <= alpha
    run = tested.groupBy("rep", "fold").agg(F.max(F.when(own, found.cast("int"))).alias("tp"), F.avg(F.when(~own, found.cast("double"))).alias("fp"))
    df = run.groupBy("fold").agg(F.coalesce(F.sum("tp"), F.lit(0)).alias("k"), F.count("*").alias("n"), F.avg(F.coalesce("fp", F.lit(0.0))).alias("fpr"))
    lo, hi = stats.wilson(F.col("k"), F.col("n"))
    return df.select("fold", (F.col("k") / F.col("n")).alias("tpr"), lo.alias("tpr_lo"), hi.alias("tpr_hi"), "fpr")


def method_table(memberships: DataFrame, references: DataFrame) -> DataFrame:
    """method, n_programs, coverage, redundancy, novelty, specificity, alignment (mean best Jaccard to the references).

    memberships: method, program, gene; references: set_name, gene.
    """
    return packed.tables(memberships, references.select("set_name", "gene").distinct(), [])
