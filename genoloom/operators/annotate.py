"""Annotation of programs by reference sets, claim gates, context scores, reproducibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genoloom.functions import labels
from genoloom.operators import sets, stats
from genoloom.runtime import materialize


def annotation_hits(members: DataFrame, reference: DataFrame, universe: int) -> DataFrame:
    """program, set_name, overlap, p_value, fold, fraction, fdr of all pairs with a common gene.

    members are (program, gene), reference (set_name, gene); the background is the union of both.
    Pairs without a common gene have p = 1 and count in the correction.
    """
    n_sets = reference.select("set_name").distinct().count()
    pairs = sets.overlap(members, reference, ["program"], ["set_name"], collection=True)
    k, m, q = F.col("overlap_n"), F.col("size_b"), F.col("size_a")
    pairs = pairs.withColumn("p_value", stats.fisher_greater(k, m, q, F.lit(universe)))
    pairs = pairs.withColumn("fold", k * F.lit(float(universe)) / (m * q)).withColumn("fraction", k / q)
    part = Window.partitionBy("program")
    rank = F.row_number().over(part.orderBy("p_value", "set_name"))
    step = F.least(F.col("p_value") * n_sets / rank, F.lit(1.0))
    pairs = pairs.withColumn("_s", step).withColumn("_r", rank)
    q_ = F.min("_s").over(part.orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, 0))
    return pairs.withColumn("fdr", q_).drop("_s", "_r", "jaccard")


def annotated_programs(members: DataFrame, reference: DataFrame, hits: DataFrame, fdr: float = 0.25) -> DataFrame:
    """program, n_genes, pathway_span, n_novel, novelty, multi_pathway_score from the hits at the given rate."""
    # read twice below, worked out once
    significant = materialize(hits.where(F.col("fdr") <= fdr).select("program", "set_name"))
    # only genes that program and set share: far fewer rows than the sets' whole memberships
    shared = members.join(reference.select("set_name", "gene"), "gene")
    covered = shared.join(significant, ["program", "set_name"], "left_semi").select("program", "gene").distinct()
    novel = members.join(covered, ["program", "gene"], "left_anti").groupBy("program").agg(F.count("*").alias("n_novel"))
    span = significant.groupBy("program").agg(F.count("*").alias("pathway_span"))
    out = sets.with_sizes(members, ["program"], "n_genes").join(span, "program", "left").join(novel, "program", "left")
    out = out.fillna(0, ["pathway_span", "n_novel"]).withColumn("novelty", F.col("n_novel") / F.col("n_genes"))
    score = F.col("pathway_span") * (1 - F.col("novelty")) + F.when(F.col("novelty") > 0.1, 0.5 * F.col("novelty")).otherwise(0.0)
    return out.withColumn("multi_pathway_score", score)


def top_references(overlaps: DataFrame, n: int = 15) -> DataFrame:
    """The n best references of each program by Jaccard, overlap and smaller size, then name."""
    order = Window.partitionBy("program").orderBy(F.desc(F.round("jaccard", 12)), F.desc("overlap_n"), F.asc("reference_n"), F.asc("set_name"))
    return overlaps.withColumn("position", F.row_number().over(order)).where(F.col("position") <= n)


def renamed_programs(best: DataFrame, least: float = 0.03) -> DataFrame:
    """program, label: the program with its best reference's label, or Unmatched below ``least``."""
    label = F.when(F.col("jaccard") >= least, labels.program_label(F.col("set_name"))).otherwise("Unmatched")
    return best.select("program", F.concat_ws("__", "program", label).alias("label"))


def source_layer(overlaps: DataFrame) -> DataFrame:
    """One row for each reference source."""
    df = overlaps.withColumn("source", labels.source_of(F.col("set_name"))).withColumn("priority", labels.relevance(F.col("set_name")))
    out = df.groupBy("source").agg(
        F.countDistinct("program").alias("programs_covered"), F.countDistinct("set_name").alias("references_covered"), F.count("*").alias("n_rows"),
        F.max("jaccard").alias("best_jaccard"), F.avg("jaccard").alias("mean_jaccard"), F.max("priority").alias("best_priority"), F.avg("priority").alias("mean_priority"),
    )
    score = labels.source_score(F.col("best_priority"), F.col("best_jaccard"), F.col("programs_covered"), F.col("references_covered"))
    return out.withColumn("source_display", labels.source_display(F.col("source"))).withColumn("interpretation_score", score)


def family_layer(overlaps: DataFrame) -> DataFrame:
    """One row for each collapsed family of references, with its best row."""
    df = overlaps.withColumn("family_key", labels.family_key(F.col("set_name"))).withColumn("source", labels.source_of(F.col("set_name")))
    out = df.groupBy("family_key").agg(
        F.max(F.struct(F.round("jaccard", 12).alias("j"), "overlap_n", F.col("program"), F.col("set_name"))).alias("top"),
        F.max("jaccard").alias("best_jaccard"), F.avg("jaccard").alias("mean_jaccard"), F.countDistinct("program").alias("programs_covered"),
        F.countDistinct("set_name").alias("references_merged"), F.array_sort(F.collect_set("source")).alias("sources"),
    )
    priority = labels.relevance(F.col("top.set_name"))
    out = out.withColumn("priority", priority).withColumn("band", labels.relevance_band(F.col("priority")))
    score = labels.family_score(F.col("priority"), F.col("best_jaccard"), F.col("programs_covered"), F.size("sources"))
    return out.select(
        "family_key", F.col("top.program").alias("top_program"), F.col("top.set_name").alias("top_reference"), "priority", "band", score.alias("interpretation_score"),
        "best_jaccard", "mean_jaccard", "programs_covered", "references_merged", F.size("sources").alias("source_count"), F.array_join("sources", ", ").alias("sources"),
    )


def claim_gates(enrichment: DataFrame, members: DataFrame, changes: DataFrame, on: list[str], least_effect: float = 0.2, least_genes: int = 10) -> DataFrame:
    """Adds program size, mean absolute change (a gene without one counts 0), the gates and their conjunction.

    ``enrichment`` has on..., fdr and may have gate_stability; a null gate passes.
    """
    scope = [c for c in on if c in changes.columns]
    known = changes.select(*scope, "gene", F.abs("change").alias("change"))
    sized = enrichment.select(*on).distinct().join(members, [c for c in on if c in members.columns])
    effect = sized.join(known, [*scope, "gene"], "left").groupBy(*on).agg(
        F.count("*").alias("program_size"), F.avg(F.coalesce("change", F.lit(0.0))).alias("mean_abs_change")
    )
    out = enrichment.join(effect, on, "left")
    out = out.withColumn("gate_fdr", F.col("fdr") <= 0.05)
    out = out.withColumn("gate_effect", F.coalesce("mean_abs_change", F.lit(0.0)) >= least_effect)
    out = out.withColumn("gate_program_size", F.coalesce("program_size", F.lit(0)) >= least_genes)
    stable = F.coalesce(F.col("gate_stability"), F.lit(True)) if "gate_stability" in enrichment.columns else F.lit(True)
    return out.withColumn("claim_supported", F.coalesce("gate_fdr", F.lit(True)) & F.col("gate_effect") & F.col("gate_program_size") & stable)


def context_scores(base: Column, change: Column, p: Column) -> dict[str, Column]:
    """Membership in both contexts from a static membership, a change (null 0) and a p-value (null 1)."""
    lf, pv = F.coalesce(change, F.lit(0.0)), F.coalesce(p, F.lit(1.0))
    base = F.coalesce(F.nanvl(base, F.lit(0.0)), F.lit(0.0))
    neglog = -F.log10(F.greatest(F.least(pv, F.lit(1.0)), F.lit(1e-300)))
    shift = F.tanh(lf / 2)
    a = 0.5 * (1 + shift)
    return {
        "prob_a": a, "prob_b": 1 - a, "contextual_score_a": base * a, "contextual_score_b": base * (1 - a), "neglog10_p_value": neglog,
        "context_shift": shift, "signed_significance": F.signum(lf) * neglog, "context_evidence": shift * neglog,
    }


def overlap_detail(left: DataFrame, right: DataFrame, a: str, b: str, on: list[str]) -> DataFrame:
    """on..., a, b, jaccard with sorted lists of shared, left-only and right-only genes."""
    lists = lambda df, key, out: df.groupBy(*on, key).agg(F.array_sort(F.collect_set("gene")).alias(out))
    pairs = left.join(right, [*on, "gene"]).select(*on, a, b).distinct()
    df = pairs.join(lists(left, a, "x"), [*on, a]).join(lists(right, b, "y"), [*on, b])
    join = lambda c: F.array_join(c, ",")
    shared = F.size(F.array_intersect("x", "y"))
    return df.select(
        *on, a, b, shared.alias("overlap_n"), (shared / F.size(F.array_union("x", "y"))).alias("jaccard"),
        join(F.array_sort(F.array_intersect("x", "y"))).alias("shared_genes"), join(F.array_sort(F.array_except("x", "y"))).alias("left_only"),
        join(F.array_sort(F.array_except("y", "x"))).alias("right_only"),
    )
