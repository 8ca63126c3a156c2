"""Expression tables in long form: normalisation, contrasts, rankings, pseudobulk, quality filters.

(sample, gene, value) holds non-zero values only; zeros enter through counts, so nothing is
filled to a dense matrix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genoloom.operators import stats
from genoloom.runtime import dense_ids, materialize


def log_cpm(values: DataFrame, sample: str = "sample", scale: float = 1e6) -> DataFrame:
    """log1p of the value per ``scale`` of the sample's sum; an empty library gives 0."""
    total = F.sum("value").over(Window.partitionBy(sample))
    return values.withColumn("value", F.log1p(F.coalesce(F.try_divide(F.col("value") * scale, total), F.lit(0.0))))


def gene_moments(values: DataFrame, samples: DataFrame, groups: tuple[str, str], sample: str = "sample") -> DataFrame:
    """gene, n_a, mean_a, var_a, n_b, mean_b, var_b over all samples of the two groups, zeros included."""
    sized = samples.where(F.col("grp").isin(*groups))
    n = sized.groupBy().agg(*[F.count(F.when(F.col("grp") == g, 1)).alias(f"n_{x}") for g, x in zip(groups, "ab")])
    v = values.join(sized, sample)
    aggs = []
    for g, x in zip(groups, "ab"):
        inside = F.col("grp") == g
        aggs += [F.coalesce(F.sum(F.when(inside, F.col("value"))), F.lit(0.0)).alias(f"s_{x}"), F.coalesce(F.sum(F.when(inside, F.col("value") * F.col("value"))), F.lit(0.0)).alias(f"q_{x}")]
    df = v.groupBy("gene").agg(*aggs).join(F.broadcast(n))  # one row
    for x in "ab":
        m = F.try_divide(F.col(f"s_{x}"), F.col(f"n_{x}"))
        df = df.withColumn(f"mean_{x}", m)
        df = df.withColumn(f"var_{x}", F.greatest((F.col(f"q_{x}") - F.col(f"n_{x}") * m * m) / F.greatest(F.col(f"n_{x}") - 1, F.lit(1)), F.lit(0.0)))
    return df


def two_group_test(values: DataFrame, samples: DataFrame, groups: tuple[str, str], sample: str = "sample") -> DataFrame:
    """gene, mean_a, mean_b, logfc, t, p_value (null becomes 1, cut to [1e-300, 1]), fdr."""
    df = gene_moments(values, samples, groups, sample)
    c = {k: F.col(k) for k in ("n_a", "mean_a", "var_a", "n_b", "mean_b", "var_b")}
    t, dof = stats.welch(*c.values())
    df = df.withColumn("t", t).withColumn("dof", dof)
    p = F.greatest(F.least(F.coalesce(stats.student_two_sided("t", "dof"), F.lit(1.0)), F.lit(1.0)), F.lit(1e-300))
    df = df.select("gene", "mean_a", "mean_b", (F.col("mean_a") - F.col("mean_b")).alias("logfc"), "t", "dof", p.alias("p_value"))
    return stats.bh(df, "p_value", "fdr", ties=["gene"])


def rank_score(de: DataFrame) -> DataFrame:
    """gene, score, rank_no: -log10 p with the sign of the change, from the top."""
    score = -F.log10(F.greatest("p_value", F.lit(1e-300))) * F.signum("logfc")
    df = de.select("gene", score.alias("score"))
    return dense_ids(df.orderBy(F.desc("score"), "gene"), "rank_no", 1).withColumn("rank_no", F.col("rank_no").cast("int"))


def rank_sums(values: DataFrame, samples: DataFrame, sample: str = "sample", scope: list[str] | None = None) -> DataFrame:
    """scope..., grp, gene, n_in, z: one-against-rest rank sums with averaged ties over all samples, zeros included.

    ``scope`` names columns of both sides, each value of which is a comparison of its own.
    """
    scope = scope or []
    n = samples.groupBy(*scope).agg(F.count("*").alias("n"))
    sizes = samples.groupBy(*scope, "grp").agg(F.count("*").alias("n_in"))
    v = values.where("value > 0").join(samples, [*scope, sample])
    part = Window.partitionBy(*scope, "gene")
    v = v.withColumn("nz", F.count("*").over(part)).withColumn("r", stats.average_rank([*scope, "gene"], "value"))
    v = v.withColumn("ties", F.count("*").over(Window.partitionBy(*scope, "gene", "value")))
    gene = v.groupBy(*scope, "gene").agg(F.first("nz").alias("nz"), F.sum(F.col("ties") * F.col("ties") - 1.0).alias("tie"))
    gene = (gene.join(n, scope) if scope else gene.join(F.broadcast(n))).withColumn("zeros", F.col("n") - F.col("nz"))  # one row a comparison
    gene = gene.withColumn("tie", F.col("tie") + F.pow("zeros", F.lit(3.0)) - F.col("zeros"))
    own = v.groupBy(*scope, "gene", "grp").agg(F.sum("r").alias("rs"), F.count("*").alias("k"))
    df = own.join(gene, [*scope, "gene"]).join(sizes, [*scope, "grp"])
    # all zeros share the lowest ranks
    total = F.col("rs") + F.col("k") * F.col("zeros") + (F.col("n_in") - F.col("k")) * (F.col("zeros") + 1) / 2
    n_, a = F.col("n").cast("double"), F.col("n_in").cast("double")
    b = n_ - a
    var = a * b / 12 * (n_ + 1 - F.col("tie") / (n_ * (n_ - 1)))
    z = F.when((var > 0) & (b > 0), (total - a * (n_ + 1) / 2) / F.sqrt(var)).otherwise(0.0)
    return df.select(*scope, "grp", "gene", "n_in", z.alias("z"))


def top_variance(values: DataFrame, n_samples: int, n: int) -> DataFrame:
    """gene, variance, position of the n genes of largest population variance, ties by gene."""
    mean = F.sum("value") / n_samples
    df = values.groupBy("gene").agg((F.sum(F.col("value") * F.col("value")) / n_samples - mean * mean).alias("variance"))
    order = Window.orderBy(F.desc(F.round("variance", 9)), "gene")
    return df.withColumn("position", F.row_number().over(order)).where(F.col("position") <= n)


def quality_filter(counts: DataFrame, least_genes: int, least_cells: int) -> DataFrame:
    """(sample, gene, value) of cells with enough genes and then genes in enough of those cells."""
    counts = counts.where("value > 0")
    cells = counts.withColumn("_g", F.count("*").over(Window.partitionBy("sample"))).where(F.col("_g") >= least_genes).drop("_g")
    return cells.withColumn("_c", F.count("*").over(Window.partitionBy("gene"))).where(F.col("_c") >= least_cells).drop("_c")


def pseudobulk(counts: DataFrame, cells: DataFrame, group: list[str], cell: str = "cell") -> tuple[DataFrame, DataFrame]:
    """(group..., gene, value) sums and (group..., n_cells)."""
    joined = counts.join(cells, cell)
    return joined.groupBy(*group, "gene").agg(F.sum("value").alias("value")), cells.groupBy(*group).agg(F.countDistinct(cell).alias("n_cells"))


def cell_type_plan(cells: DataFrame, groups: tuple[str, str], least_cells: int, least_donors: int = 2) -> DataFrame:
    """For each cell type the cells, donors with enough cells in each group and whether both suffice."""
    donors = cells.groupBy("cell_type", "donor", "condition").agg(F.count("*").alias("n"))
    ok = F.col("n") >= least_cells
    one = lambda g: F.count(F.when(ok & (F.col("condition") == g), 1))
    out = donors.groupBy("cell_type").agg(F.sum("n").alias("n_cells"), one(groups[0]).alias("donors_a"), one(groups[1]).alias("donors_b"))
    return out.withColumn("eligible", (F.col("donors_a") >= least_donors) & (F.col("donors_b") >= least_donors))


def sample_correlation(values: DataFrame, n_genes: int, sample: str = "sample") -> DataFrame:
    """a < b, r: Pearson over all genes, zeros included, of samples that share a gene."""
    m = values.groupBy(sample).agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    left, right = values.withColumnsRenamed({sample: "a", "value": "x"}), values.withColumnsRenamed({sample: "b", "value": "y"})
    dot = left.join(right, "gene").where("a < b").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("d"))
    ma, mb = m.toDF("a", "sa", "qa"), m.toDF("b", "sb", "qb")
    df = dot.join(ma, "a").join(mb, "b")
    cov = F.col("d") - F.col("sa") * F.col("sb") / n_genes
    var = (F.col("qa") - F.col("sa") * F.col("sa") / n_genes) * (F.col("qb") - F.col("sb") * F.col("sb") / n_genes)
    return df.select("a", "b", F.try_divide(cov, F.sqrt(F.greatest(var, F.lit(0.0)))).alias("r"))


def batch_correlation(values: DataFrame, samples: DataFrame, n_genes: int, sample: str = "sample") -> DataFrame:
    """same_batch, n_pairs, mean_r: mean Pearson over all pairs of samples within and between batches.

    Every pair of samples that have values counts, with or without a common gene; r is over all
    genes, zeros included, and undefined (not in the mean) for a constant sample. The sums of r
    come from sums over samples by gene and by batch, so no pairs are formed. Pairs with a null
    batch are in a group of their own (null).
    """
    moments = values.groupBy(sample).agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    var = F.col("q") - F.col("s") * F.col("s") / n_genes
    m = moments.join(samples.select(sample, "batch"), sample).select(sample, "batch", "s", F.when(var > 0, F.sqrt(var)).alias("sd"))
    z, u = F.col("s") / F.col("sd"), F.col("value") / F.col("sd")
    pairs = lambda one, two: (F.sum(one) * F.sum(one) - F.sum(two)) / 2
    n = m.groupBy("batch").agg(F.count("*").alias("n"), F.count("sd").alias("k"), F.sum(z).alias("z"), F.sum(z * z).alias("zz"))
    g = values.join(m.where("sd is not null"), sample).groupBy("batch", "gene").agg(F.sum(u).alias("u"), F.sum(u * u).alias("uu"))
    dot = g.groupBy("batch").agg(F.sum((F.col("u") * F.col("u") - F.col("uu")) / 2).alias("d"))
    choose = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    own = n.where("batch is not null").join(dot, "batch", "left")
    own = own.agg(choose("n").alias("n"), choose("k").alias("k"), F.sum(F.coalesce("d", F.lit(0.0)) - F.coalesce((F.col("z") * F.col("z") - F.col("zz")) / 2, F.lit(0.0)) / n_genes).alias("r"))

    def whole(counts: DataFrame, sums: DataFrame) -> DataFrame:
        d = sums.groupBy("gene").agg(pairs("u", "uu").alias("d")).agg(F.sum("d").alias("d"))
        c = counts.agg(F.sum("n").alias("a"), F.sum("k").alias("b"), pairs("z", "zz").alias("z"))
        two = lambda x: F.col(x) * (F.col(x) - 1) / 2
        return c.join(F.broadcast(d)).select(two("a").alias("n"), two("b").alias("k"), (F.coalesce("d", F.lit(0.0)) - F.coalesce("z", F.lit(0.0)) / n_genes).alias("r"))  # one row

    known, all_ = whole(n.where("batch is not null"), g.where("batch is not null")), whole(n, g)
    x, y, w = (df.select(*[F.coalesce(c, F.lit(0.0)).alias(f"{c}{i}") for c in "nkr"]) for i, df in enumerate((own, known, all_)))
    row = lambda same, n_, k, r: F.struct(F.lit(same).cast("boolean").alias("same_batch"), n_.cast("long").alias("n_pairs"), F.try_divide(r, k).alias("mean_r"))
    c = F.col
    rows = [row(True, c("n0"), c("k0"), c("r0"))] + [row(same, *(c(f"{v}{i}") - c(f"{v}{i - 1}") for v in "nkr")) for i, same in ((1, False), (2, None))]
    return x.join(F.broadcast(y)).join(F.broadcast(w)).select(F.inline(F.array(*rows))).where("n_pairs > 0")  # one row each


def gene_correlations(values: DataFrame, n_samples: int, method: str = "pearson") -> DataFrame:
    """src < dst, r over all samples, zeros included, of the genes that share a sample; r is 0 for a constant gene.

    For ranks (spearman, values of 0 and more) a gene's zeros share their mean rank, which is taken
    from all of its ranks: that changes no correlation and leaves the zeros out of the join. The r of
    genes without a common sample follows from ``moments`` alone.
    """
    if method not in ("pearson", "spearman"):
        raise ValueError(f"no correlation {method!r}; there are 'pearson' and 'spearman'")
    x = values.select("sample", "gene", F.col("value").cast("double").alias("x")).where("x <> 0")
    if method == "spearman":
        # rank among all values: the zeros come first; less the zeros' own mean rank
        zeros = F.lit(n_samples) - F.count("*").over(Window.partitionBy("gene"))
        x = x.select("sample", "gene", (stats.average_rank(["gene"], "x") + zeros - (zeros + 1) / 2.0).alias("x"))
    x = materialize(x)
    m = x.groupBy("gene").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    other = x.select("sample", F.col("gene").alias("dst"), F.col("x").alias("y"))
    dots = x.withColumnRenamed("gene", "src").join(other, "sample").where("src < dst").groupBy("src", "dst").agg(F.sum(F.col("x") * F.col("y")).alias("xy"))
    side = lambda g, a: m.select(F.col("gene").alias(g), F.col("s").alias(f"s{a}"), F.greatest(F.col("q") - F.col("s") * F.col("s") / n_samples, F.lit(0.0)).alias(f"v{a}"))
    df = dots.join(side("src", "x"), "src").join(side("dst", "y"), "dst")
    cov, size = F.col("xy") - F.col("sx") * F.col("sy") / n_samples, F.sqrt(F.col("vx")) * F.sqrt(F.col("vy"))
    return df.select("src", "dst", F.when((F.col("vx") > 1e-24) & (F.col("vy") > 1e-24), cov / size).otherwise(0.0).alias("r"))


def rank_value_tokens(counts: DataFrame, longest: int = 2048, cell: str = "cell") -> DataFrame:
    """cell, gene, position: the genes of positive value in falling order, ties by gene, as many as a model's input holds."""
    order = Window.partitionBy(cell).orderBy(F.desc("value"), "gene")
    return counts.where("value > 0").withColumn("position", F.row_number().over(order)).where(F.col("position") <= longest).select(cell, "gene", "position")


def mapped_identifiers(names: DataFrame, tokens: DataFrame, synonyms: DataFrame | None = None, own: DataFrame | None = None) -> DataFrame:
    """gene, token, how of the names that a vocabulary (id, token) knows.

    Looked up in this order: the name itself, the id of the synonyms (name, id), the id of the
    table's own column (name, id), the name in upper case. A name's first synonym by id counts.
    """
    n, t = names.select("gene").distinct(), tokens.groupBy("id").agg(F.min("token").alias("token"))
    steps = [("name", n.select("gene", F.col("gene").alias("id")))]
    for how, table in (("synonym", synonyms), ("own", own)):
        if table is not None:
            steps.append((how, n.join(table.groupBy(F.col("name").alias("gene")).agg(F.min("id").alias("id")), "gene")))
    steps.append(("upper", n.select("gene", F.upper("gene").alias("id"))))
    found = None
    for place, (how, ids) in enumerate(steps):
        hit = ids.join(t, "id").select("gene", F.struct(F.lit(place).alias("place"), F.col("token"), F.lit(how).alias("how")).alias("x"))
        found = hit if found is None else found.unionByName(hit)
    return found.groupBy("gene").agg(F.min("x").alias("x")).select("gene", "x.token", "x.how")


def symbols_for(names: DataFrame, table: DataFrame) -> DataFrame:
    """gene, symbol: (id, symbol) of the table where it has the name, without its version (.n), else the name."""
    t = table.where("symbol is not null and symbol <> ''").groupBy("id").agg(F.min("symbol").alias("symbol"))
    df = names.select("gene").distinct().withColumn("id", F.regexp_replace("gene", r"\.[0-9]+\z", ""))
    return df.join(t, "id", "left").select("gene", F.coalesce("symbol", "gene").alias("symbol"))


def median_scaled(values: DataFrame, samples: DataFrame) -> DataFrame:
    """(sample, gene, value) scaled to the median library size (an empty one counts 1) and log1p; a gene with values below 0 is first moved up to 0.

    Only genes with negative values become dense, as their zeros move too.
    """
    low = values.groupBy("gene").agg(F.min("value").alias("low")).where("low < 0")
    dense = low.join(samples.select("sample").distinct(), F.lit(True)).join(values, ["gene", "sample"], "left")  # few genes, all samples
    moved = dense.select("sample", "gene", (F.coalesce("value", F.lit(0.0)) - F.col("low")).alias("value"))
    x = values.join(low, "gene", "left_anti").select("sample", "gene", F.col("value").cast("double").alias("value")).unionByName(moved).where("value > 0")
    lib = samples.select("sample").distinct().join(x.groupBy("sample").agg(F.sum("value").alias("t")), "sample", "left").select("sample", F.coalesce(F.nullif("t", F.lit(0.0)), F.lit(1.0)).alias("t"))
    mid = lib.agg(F.median("t").alias("mid"))
    return x.join(lib, "sample").join(F.broadcast(mid)).select("sample", "gene", F.log1p(F.col("value") / F.col("t") * F.col("mid")).alias("value"))  # one row


def top_dispersion(values: DataFrame, n_samples: int, n: int) -> DataFrame:
    """gene, dispersion, position of the n genes of largest variance over mean, zeros included."""
    mean = F.sum("value") / n_samples
    var = F.sum(F.col("value") * F.col("value")) / n_samples - mean * mean
    df = values.groupBy("gene").agg(F.when(mean == 0, var).otherwise(var / mean).alias("dispersion"))
    order = Window.orderBy(F.desc(F.round("dispersion", 9)), "gene")  # one row a gene
    return df.withColumn("position", F.row_number().over(order)).where(F.col("position") <= n)


def markers(values: DataFrame, samples: DataFrame, n: int = 50) -> DataFrame:
    """grp, gene, z, p_value, fdr, log2_fold, position: the n genes of largest rank-sum z of each group against the rest.

    The fold is that of the mean values, zeros included, with 1e-9 added to both.
    """
    z = rank_sums(values, samples)
    total = samples.agg(F.count("*").alias("n_all"))
    size = samples.groupBy("grp").agg(F.count("*").alias("n_grp")).join(F.broadcast(total))  # one row
    own = values.join(samples, "sample").groupBy("grp", "gene").agg(F.sum("value").alias("s"))
    every = values.join(samples.select("sample"), "sample", "left_semi").groupBy("gene").agg(F.sum("value").alias("t"))
    df = z.join(own, ["grp", "gene"], "left").join(every, "gene", "left").join(size, "grp").fillna(0, ["s", "t"])
    inside, rest = F.col("s") / F.col("n_grp"), F.try_divide(F.col("t") - F.col("s"), F.col("n_all") - F.col("n_grp"))
    df = df.withColumn("log2_fold", F.log2((inside + 1e-9) / (F.coalesce(rest, F.lit(0.0)) + 1e-9))).withColumn("p_value", stats.normal_two_sided("z"))
    df = stats.bh(df, "p_value", "fdr", ["grp"], ["gene"])
    order = Window.partitionBy("grp").orderBy(F.desc(F.round("z", 9)), "gene")
    return df.withColumn("position", F.row_number().over(order)).where(F.col("position") <= n).select("grp", "gene", "z", "p_value", "fdr", "log2_fold", "position")


def mitochondrial_share(counts: DataFrame, cell: str = "cell", prefix: str = "MT-") -> DataFrame:
    """cell, n_genes, total, mito_share: the share of a cell's counts on genes of the prefix, in any case."""
    mito = F.upper(F.col("gene").cast("string")).startswith(prefix)
    out = counts.where("value > 0").groupBy(cell).agg(F.count("*").alias("n_genes"), F.sum("value").alias("total"), F.sum(F.when(mito, F.col("value")).otherwise(0)).alias("m"))
    return out.select(cell, "n_genes", "total", (F.col("m") / F.col("total")).alias("mito_share"))
