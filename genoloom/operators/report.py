"""Frames behind reports: top programs by top references, rankings, membership tables, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genoloom.functions import labels


def top_programs(enrichment: DataFrame, n: int, scope: list[str] | None = None) -> DataFrame:
    """program (and scope) of the n smallest corrected p-values, ties by larger |nes|, then name."""
    order = [F.asc_nulls_last("fdr"), *([F.desc(F.abs("nes"))] if "nes" in enrichment.columns else []), F.asc("program")]
    w = Window.partitionBy(*scope).orderBy(*order) if scope else Window.orderBy(*order)
    return enrichment.withColumn("program_rank", F.row_number().over(w)).where(F.col("program_rank") <= n)


def heatmap(overlaps: DataFrame, programs: DataFrame, n_references: int) -> DataFrame:
    """program, set_name, jaccard of the chosen programs and the references of the largest Jaccard among them."""
    df = overlaps.join(programs.select("program"), "program", "left_semi")
    best = df.groupBy("set_name").agg(F.max("jaccard").alias("m"))
    best = best.withColumn("_k", F.row_number().over(Window.orderBy(F.desc(F.round("m", 12)), "set_name"))).where(F.col("_k") <= n_references)
    return df.join(best.select("set_name"), "set_name", "left_semi").select("program", "set_name", "jaccard")


def references_of_programs(overlaps: DataFrame, programs: DataFrame, n: int) -> DataFrame:
    """The n best references of each chosen program, with the estimate of novel genes."""
    order = Window.partitionBy("program").orderBy(F.desc(F.round("jaccard", 12)), F.desc("overlap_n"), "set_name")
    df = overlaps.join(programs.select("program"), "program", "left_semi").withColumn("position", F.row_number().over(order)).where(F.col("position") <= n)
    return df.withColumn("novel_estimate", F.greatest(F.col("program_n") - F.col("overlap_n"), F.lit(0)))


def references_by_source(overlaps: DataFrame, programs: DataFrame, n: int) -> DataFrame:
    df = overlaps.join(programs.select("program"), "program", "left_semi").withColumn("source", labels.source_of(F.col("set_name")))
    df = df.groupBy("source", "set_name").agg(F.max("jaccard").alias("best_jaccard"), F.countDistinct("program").alias("programs"))
    order = Window.partitionBy("source").orderBy(F.desc(F.round("best_jaccard", 12)), "set_name")
    return df.withColumn("position", F.row_number().over(order)).where(F.col("position") <= n)


def calibrated_ranking(overlaps: DataFrame, n: int) -> DataFrame:
    """References by raw overlap and by overlap with relevance; those among the first n of either."""
    df = overlaps.groupBy("set_name").agg(F.max("jaccard").alias("best_jaccard"), F.countDistinct("program").alias("programs"))
    df = df.withColumn("priority", labels.relevance(F.col("set_name")))
    score = labels.family_score(F.col("priority"), F.col("best_jaccard"), F.col("programs"), F.lit(1))
    df = df.withColumn("score", score)
    raw = F.row_number().over(Window.orderBy(F.desc(F.round("best_jaccard", 12)), "set_name"))
    first = F.row_number().over(Window.orderBy(F.desc(F.round("score", 9)), F.desc(F.round("best_jaccard", 12)), "set_name"))
    return df.withColumn("raw_rank", raw).withColumn("priority_rank", first).where((F.col("raw_rank") <= n) | (F.col("priority_rank") <= n))


def membership_table(context: DataFrame, n: int) -> DataFrame:
    """program, gene, position: the n genes of largest membership, ties by gene."""
    order = Window.partitionBy("program").orderBy(F.desc("base_membership"), "gene")
    return context.withColumn("position", F.row_number().over(order)).where(F.col("position") <= n)


def compact_lists(table: DataFrame) -> DataFrame:
    """program, n, genes: comma lists in order of position."""
    return table.groupBy("program").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "gene"))), lambda x: x["gene"]), ",").alias("genes"))


def gate_summary(gated: DataFrame, gates: list[str]) -> DataFrame:
    """gate, n_tested, n_passed, rate: nulls are not tested."""
    row = lambda g: F.struct(F.lit(g).alias("gate"), F.count(g).alias("n_tested"), F.count(F.when(F.col(g), 1)).alias("n_passed"))
    out = gated.agg(*[row(g).alias(g) for g in gates]).select(F.inline(F.array(*gates)))
    return out.withColumn("rate", F.try_divide("n_passed", "n_tested"))


def headline(gated: DataFrame, changes: DataFrame) -> DataFrame:
    """One row: programs, supported programs, genes tested, genes changed, and whether few genes carry the claims."""
    a = gated.agg(F.count("*").alias("n_programs"), F.count(F.when(F.col("claim_supported"), 1)).alias("n_supported"))
    b = changes.agg(F.count("*").alias("n_genes"), F.count(F.when(F.col("fdr") <= 0.05, 1)).alias("n_changed"))
    return a.join(F.broadcast(b)).withColumn("few_genes_alert", (F.col("n_changed") <= 5) & (F.col("n_supported") > 0))


def ensured_metrics(df: DataFrame) -> DataFrame:
    """Adds context_shift, significance and evidence from whatever older columns there are."""
    have = set(df.columns)
    if "context_shift" not in have:
        if {"prob_a", "prob_b"} <= have:
            shift = F.col("prob_a") - F.col("prob_b")
        elif {"contextual_score_a", "contextual_score_b"} <= have:
            a, b = F.col("contextual_score_a"), F.col("contextual_score_b")
            shift = F.coalesce(F.try_divide(a - b, a + b), F.lit(0.0))
        else:
            shift = F.lit(0.0)
        df = df.withColumn("context_shift", shift)
    if "neglog10_p_value" not in have:
        p = F.coalesce("p_value", F.lit(1.0)) if "p_value" in have else F.lit(1.0)
        df = df.withColumn("neglog10_p_value", -F.log10(F.greatest(F.least(p, F.lit(1.0)), F.lit(1e-300))))
    if "signed_significance" not in have:
        df = df.withColumn("signed_significance", F.signum("context_shift") * F.col("neglog10_p_value"))
    if "context_evidence" not in have:
        df = df.withColumn("context_evidence", F.col("context_shift") * F.col("neglog10_p_value"))
    return df


def flows(members: DataFrame) -> DataFrame:
    """context, program, width."""
    return members.groupBy("context", "program").agg(F.count("*").alias("width"))


def anchor(overlaps: DataFrame, scope: list[str], left: str, right: str) -> DataFrame:
    """The pair of largest Jaccard, overlap, then names, of each scope."""
    w = Window.partitionBy(*scope).orderBy(F.desc(F.round("jaccard", 12)), F.desc("overlap_n"), left, right)
    return overlaps.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def focus_genes(focus: DataFrame, members: DataFrame, curated: DataFrame) -> DataFrame:
    """gene, programs, references: sorted comma lists of the sets that hold each focus gene, empty where none does."""
    lists = lambda df, key, out: df.groupBy("gene").agg(F.array_join(F.array_sort(F.collect_set(key)), ",").alias(out))
    out = focus.select("gene").distinct().join(lists(members, "program", "programs"), "gene", "left").join(lists(curated, "set_name", "references"), "gene", "left")
    return out.fillna("", ["programs", "references"])


def curated_panel(enrichment: DataFrame, overlaps: DataFrame, anchor_program: str, n: int = 5) -> DataFrame:
    """Up to n curated sets: the anchor program's best overlaps first (two at most), then the best of the enrichment."""
    near = overlaps.where(F.col("program") == anchor_program)
    near = near.withColumn("o", F.row_number().over(Window.orderBy(F.desc(F.round("jaccard", 12)), F.desc("overlap_n"), "set_name"))).where("o <= 2")
    near = near.select("set_name", F.lit(0).alias("tier"), "o")
    order = Window.orderBy(F.asc("fdr"), F.desc(F.round(F.abs("nes"), 12)), F.asc("p_value"), "set_name")
    rest = enrichment.select("set_name", F.lit(1).alias("tier"), F.row_number().over(order).alias("o"))
    both = near.unionByName(rest).groupBy("set_name").agg(F.min(F.struct("tier", "o")).alias("k"))
    return both.withColumn("position", F.row_number().over(Window.orderBy("k"))).where(F.col("position") <= n).select("set_name", "position")


def annotation_report(hits: DataFrame, annotated: DataFrame, novel: DataFrame, fdr: float = 0.25, title: str = "Multi-pathway annotation") -> DataFrame:
    """part, line: a text report as rows, the head first, then the programs by falling score (ties by name), the lines of a program in one row.

    novel: (program, gene) of the genes that no significant set covers; the first ten are named.
    """
    a = annotated
    head = a.agg(F.count("*").alias("n"), *[F.count(F.when(c, 1)).alias(x) for x, c in (("multi", F.col("pathway_span") >= 2), ("one", F.col("pathway_span") == 1), ("none", F.col("pathway_span") == 0))])
    text = F.concat_ws("\n", F.lit(title), F.format_string("Programs: %d", "n"), F.format_string("  of several pathways: %d", "multi"), F.format_string("  of one pathway: %d", "one"), F.format_string("  novel only: %d", "none"))
    rows = hits.where(F.col("fdr") <= fdr).withColumn(
        "text", F.format_string("    %s: %d genes (p=%.2e, FDR=%.3f, fold=%.1f, %.0f%% of program)", "set_name", F.col("overlap_n").cast("long"), "p_value", "fdr", "fold", F.col("fraction") * 100)
    )
    rows = rows.groupBy("program").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_value", "set_name", "text"))), lambda x: x["text"]), "\n").alias("pathways"))
    order = Window.partitionBy("program").orderBy("gene")
    n = novel.withColumn("k", F.row_number().over(order)).groupBy("program").agg(F.count("*").alias("n_new"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("k") <= 10, F.col("gene")))), ", ").alias("names"))
    n = n.withColumn("names", F.concat(F.lit("  Novel genes: "), "names", F.when(F.col("n_new") > 10, F.format_string(" (+%d more)", F.col("n_new") - 10)).otherwise("")))
    one = a.join(rows, "program", "left").join(n, "program", "left")
    line = F.concat_ws(
        "\n", F.concat(F.lit("Program: "), "program"), F.format_string("  Size: %d genes", F.col("n_genes").cast("long")), F.format_string("  Pathway span: %d", F.col("pathway_span").cast("long")),
        F.format_string("  Multi-pathway score: %.2f", "multi_pathway_score"), F.format_string("  Novelty: %.1f%%", F.col("novelty") * 100),
        F.when(F.col("pathways").isNotNull(), F.concat(F.lit("  Significant pathways:\n"), "pathways")), F.col("names"),
    )
    place = F.row_number().over(Window.orderBy(F.desc(F.round("multi_pathway_score", 9)), "program"))  # one row a program
    return head.select(F.lit(0).alias("part"), text.alias("line")).unionByName(one.select(place.alias("part"), line.alias("line")))


def run_summary(run: dict[str, object], de: DataFrame, programs: DataFrame, gates: DataFrame, alpha: float = 0.05, stability: tuple[float, float, float] | None = None, best: int = 10) -> str:
    """The digest of a run in Markdown: counts, the gates, and the ``best`` programs by FDR, which is what comes to the driver."""
    n_de, n_sig = de.agg(F.count("*"), F.count(F.when(F.col("fdr") <= alpha, 1))).first()
    n, ok = gates.agg(F.count("*"), F.count(F.when(F.col("claim_supported"), 1))).first()
    top = gates.orderBy(F.asc_nulls_last("fdr"), "program").limit(best).collect()  # the list's length is the feature
    lines = ["# Run summary", "", "## Run", *(f"- {k}: {v}" for k, v in run.items())]
    lines += [f"- Genes used: {n_de}", f"- Programs: {programs.select('program').distinct().count()}", f"- Changed genes (FDR <= {alpha}): {n_sig}", "", "## Claims", f"- Supported programs: {ok}/{n}"]
    if stability is not None:
        lines.append("- Bootstrap stability (mean best-match Jaccard): {:.3f} (95% CI {:.3f}-{:.3f})".format(*stability))
    lines += ["", "## Programs by FDR"]
    lines += [f"- {r['program']}: NES={r['nes']:.3f}, p={r['p_value']:.3g}, FDR={r['fdr']:.3g}, supported={bool(r['claim_supported'])}" for r in top] or ["- None."]
    return "\n".join(lines) + "\n"
