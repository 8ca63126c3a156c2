"""Set algebra over long membership tables: (set key, gene) rows, each pair once.

Overlaps come from an equi-join on the gene (an inverted index), never from all pairs of sets;
pairs without a common gene only enter through counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genoloom.runtime import clean_gene, clean_name


def membership(df: DataFrame, key: str, gene: str = "gene", keep: list[str] | None = None) -> DataFrame:
    """Distinct clean (key, gene) rows, with other key columns if asked for."""
    cols = [clean_name(key).alias(key), clean_gene(gene).alias("gene"), *(keep or [])]
    return df.select(*cols).where(f"{key} is not null and gene is not null").distinct()


def jaccard(shared: Column, a: Column, b: Column) -> Column:
    """|A & B| / |A or B|; 0 for two empty sets."""
    return F.coalesce(F.try_divide(shared, a + b - shared), F.lit(0.0))


def with_sizes(members: DataFrame, keys: list[str], name: str) -> DataFrame:
    return members.groupBy(*keys).agg(F.count("*").alias(name))


#: Memberships of a collection that may travel to every task, some 10 MB.
SMALL_ROWS = 200_000


def overlap(left: DataFrame, right: DataFrame, a: list[str], b: list[str], on: list[str] | None = None, collection: bool = False) -> DataFrame:
    """a..., b..., overlap_n, size_a, size_b, jaccard of all pairs with a common gene.

    ``on`` names scope columns of both sides that must agree besides the gene. With ``collection``
    the right side may be small: if it has at most SMALL_ROWS rows, it goes to the sets of the left,
    each of which stays in one task, and neither a hot gene nor the pairs are shuffled; otherwise
    both sides meet by gene, and skewed genes are split at run time.
    """
    on = on or []
    if collection and right.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS:
        left, right = left.repartition(*on, *a), F.broadcast(right)
    sizes_a, sizes_b = with_sizes(left, on + a, "size_a"), with_sizes(right, on + b, "size_b")
    pairs = left.join(right, [*on, "gene"]).groupBy(*on, *a, *b).agg(F.count("*").alias("overlap_n"))
    out = pairs.join(sizes_a, on + a).join(sizes_b, on + b)
    return out.withColumn("jaccard", jaccard(F.col("overlap_n"), F.col("size_a"), F.col("size_b")))


def best_match(overlaps: DataFrame, source: list[str], target: str, extra: list[Column] | None = None) -> DataFrame:
    """The row of highest Jaccard for each source; ties by ``extra``, then by target name."""
    order = Window.partitionBy(*source).orderBy(F.desc(F.round("jaccard", 12)), *(extra or []), F.asc(target))
    return overlaps.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def best_partners(left: DataFrame, right: DataFrame) -> DataFrame:
    """program, other, jaccard: for each left (program, gene) set the right one of highest Jaccard, ties by name.

    A set with an identical partner needs no overlaps, as no Jaccard is above 1: such pairs meet by size and
    hashes of their genes and are verified gene by gene. Only the other sets are joined by gene.
    """
    prints = [F.count("*").alias("n"), F.bit_xor(F.xxhash64("gene")).alias("h"), F.bit_xor(F.xxhash64("gene", F.lit(1))).alias("g")]
    first = right.groupBy("program").agg(*prints).groupBy("n", "h", "g").agg(F.min("program").alias("other"))
    alike = left.groupBy("program").agg(*prints).join(first, ["n", "h", "g"]).select("program", "other", "n")
    held = left.join(alike, "program").join(right.withColumnRenamed("program", "other"), ["other", "gene"])
    same = held.groupBy("program", "other").agg((F.count("*") == F.first("n")).alias("all"))
    same = same.where("all").select("program", "other", F.lit(1.0).alias("jaccard"))
    rest = left.join(same, "program", "left_anti")
    pairs = overlap(rest.select("program", "gene"), right.select(F.col("program").alias("other"), "gene"), ["program"], ["other"])
    return same.unionByName(best_match(pairs, ["program"], "other").select("program", "other", "jaccard"))


def mean_pairwise_jaccard(members: DataFrame, scope: list[str], key: str) -> DataFrame:
    """scope..., n_sets, redundancy: the mean Jaccard over all pairs, those without overlap included."""
    other = members.withColumnRenamed(key, "_other")
    size = members.groupBy(*scope, key).agg(F.count("*").alias("n"))
    pairs = members.join(other, [*scope, "gene"]).where(F.col(key) < F.col("_other")).groupBy(*scope, key, "_other").agg(F.count("*").alias("k"))
    pairs = pairs.join(size, [*scope, key]).join(size.withColumnsRenamed({key: "_other", "n": "m"}), [*scope, "_other"])
    total = pairs.groupBy(*scope).agg(F.sum(jaccard(F.col("k"), F.col("n"), F.col("m"))).alias("total"))
    sets = size.groupBy(*scope).agg(F.count("*").alias("n_sets"))
    n = F.col("n_sets")
    return sets.join(total, scope, "left").select(
        *scope, "n_sets", F.coalesce(F.try_divide(F.col("total"), n * (n - 1) / 2), F.lit(0.0)).alias("redundancy")
    )


def coverage(members: DataFrame, reference: DataFrame, scope: list[str]) -> DataFrame:
    """Share of the distinct reference genes of each scope that are in any set."""
    genes = reference.select(*scope, "gene").distinct()
    held = members.select("gene").distinct().withColumn("held", F.lit(1))
    out = genes.join(held, "gene", "left").groupBy(*scope)
    return out.agg(F.count("*").alias("n_genes"), F.count("held").alias("n_covered"), (F.count("held") / F.count("*")).alias("coverage"))


def novelty(members: DataFrame, curated: DataFrame, scope: list[str]) -> DataFrame:
    """Share of memberships whose gene is in no curated set."""
    known = curated.select("gene").distinct().withColumn("known", F.lit(1))
    out = members.join(known, "gene", "left").groupBy(*scope)
    return out.agg(F.count("*").alias("n_memberships"), (1 - F.count("known") / F.count("*")).alias("novelty"))


def specificity(members: DataFrame, scope: list[str], key: str) -> DataFrame:
    """Mean over programs of the share of genes that are in no other program of the scope; 1 for a lone program."""
    per = members.withColumn("n", F.count("*").over(Window.partitionBy(*scope, "gene")))
    per = per.groupBy(*scope, key).agg(F.avg(F.when(F.col("n") == 1, 1.0).otherwise(0.0)).alias("share"))
    return per.groupBy(*scope).agg(F.count("*").alias("n_sets"), F.avg("share").alias("specificity"))


def first_labels(members: DataFrame, scope: list[str], key: str) -> DataFrame:
    """One program for each gene: the first by name wins."""
    return members.groupBy(*scope, "gene").agg(F.min(key).alias("label"))


def label_agreement(pairs: DataFrame, scope: list[str]) -> DataFrame:
    """Adjusted Rand index and normalised mutual information of (scope, label_a, label_b) rows."""
    cell = pairs.groupBy(*scope, "label_a", "label_b").agg(F.count("*").alias("n"))
    row = cell.groupBy(*scope, "label_a").agg(F.sum("n").alias("a"))
    col = cell.groupBy(*scope, "label_b").agg(F.sum("n").alias("b"))
    c2 = lambda x: F.sum(F.col(x) * (F.col(x) - 1) / 2)
    rows = row.groupBy(*scope).agg(c2("a").alias("sa"), F.sum("a").alias("n"), F.sum(F.col("a") * F.log("a")).alias("la"), F.count("*").alias("ka"))
    cols = col.groupBy(*scope).agg(c2("b").alias("sb"), F.sum(F.col("b") * F.log("b")).alias("lb"), F.count("*").alias("kb"))
    cells = cell.groupBy(*scope).agg(c2("n").alias("sc"), F.sum(F.col("n") * F.log("n")).alias("lc"))
    df = rows.join(cols, scope).join(cells, scope)
    n = F.col("n")
    expected = F.coalesce(F.try_divide(F.col("sa") * F.col("sb"), n * (n - 1) / 2), F.lit(0.0))
    top = (F.col("sa") + F.col("sb")) / 2
    h = lambda s: F.log(n) - F.col(s) / n
    mutual = F.log(n) + (F.col("lc") - F.col("la") - F.col("lb")) / n
    flat = (F.col("ka") == 1) & (F.col("kb") == 1)
    return df.select(
        *scope,
        n.alias("n_genes"),
        F.when(F.abs(top - expected) < 1e-12, 1.0).otherwise(F.try_divide(F.col("sc") - expected, top - expected)).alias("ari"),
        F.when(flat, 1.0).otherwise(F.coalesce(F.try_divide(F.greatest(mutual, F.lit(0.0)), (h("la") + h("lb")) / 2), F.lit(0.0))).alias("nmi"),
    )


def soft_metrics(weights: DataFrame, scope: list[str], threshold: float = 0.1) -> DataFrame:
    """Of (scope, program, gene, weight): coverage count, redundancy, specificity and mean entropy.

    A gene's weights are divided by their sum; a gene without weight has entropy 0.
    """
    part = Window.partitionBy(*scope, "gene")
    w = weights.withColumn("p", F.coalesce(F.try_divide("weight", F.sum("weight").over(part)), F.lit(0.0)))
    gene = w.groupBy(*scope, "gene").agg(
        (-F.sum(F.col("p") * F.log(F.col("p") + 1e-12))).alias("entropy"),
        F.max("weight").alias("top"),
        F.count(F.when(F.col("weight") >= threshold, 1)).alias("n_over"),
    )
    programs = weights.groupBy(*scope).agg(F.countDistinct("program").alias("n_programs"))
    out = gene.groupBy(*scope).agg(
        F.count("*").alias("n_genes"),
        F.count(F.when(F.col("top") >= threshold, 1)).alias("n_covered"),
        F.avg(F.when(F.col("n_over") > 0, F.col("n_over"))).alias("mean_over"),
        F.avg(F.greatest("entropy", F.lit(0.0))).alias("mean_entropy"),
    )
    out = out.join(programs, scope)
    return out.select(
        *scope,
        "n_programs",
        "n_genes",
        "n_covered",
        (F.coalesce("mean_over", F.lit(1.0)) - 1).alias("redundancy"),
        "mean_entropy",
        F.when(F.col("n_programs") < 2, 1.0).otherwise(1 - F.col("mean_entropy") / F.log("n_programs")).alias("specificity"),
    )


def fused_scores(primary: DataFrame, secondary: DataFrame, top: int, least_jaccard: float = 0.0, mode: str = "score_sum", rrf_k: int = 40) -> DataFrame:
    """Scores of each primary program fused with its best overlapping secondary program.

    Both are (program, gene, score). Scores are cut at 0 and divided by the program's largest;
    ``score_sum`` adds them, ``rrf`` adds 1 / (rrf_k + rank). Without a partner of at least
    ``least_jaccard`` a program keeps its own scores. The ``top`` best genes remain.
    """

    def scaled(df: DataFrame) -> DataFrame:
        part = Window.partitionBy("program")
        cut = F.greatest("score", F.lit(0.0))
        df = df.select("program", "gene", cut.alias("score")).withColumn("m", F.max("score").over(part))
        df = df.withColumn("score", F.when(F.col("m") > 0, F.col("score") / F.col("m")).otherwise(1.0)).drop("m")
        return df.withColumn("r", F.row_number().over(part.orderBy(F.desc("score"), "gene")))

    a, b = scaled(primary), scaled(secondary)
    pairs = best_partners(a.select("program", "gene"), b.select("program", "gene")).where(F.col("jaccard") >= least_jaccard).select("program", "other")
    value = (lambda s, r: s) if mode == "score_sum" else (lambda s, r: 1 / (F.lit(rrf_k) + r))
    own = a.select("program", "gene", value(F.col("score"), F.col("r")).alias("score"))
    lent = pairs.join(b.withColumnRenamed("program", "other"), "other").select("program", "gene", value(F.col("score"), F.col("r")).alias("score"))
    both = own.unionByName(lent).groupBy("program", "gene").agg(F.sum("score").alias("score"))
    order = Window.partitionBy("program").orderBy(F.desc(F.round("score", 9)), "gene")
    return both.withColumn("position", F.row_number().over(order)).where(F.col("position") <= top)
