"""Tables of a benchmark suite: summaries by seed and method, gates, fairness, splits, tuning, comparisons of models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genoloom.functions import labels
from genoloom.operators import sets, validate
from genoloom.operators.stats import average_rank

SEED_KEYS = ["dataset", "seed", "method"]


class GateFailure(ValueError):
    """A gate that a table must pass before its figures may be used."""


def seed_summary(recovery: DataFrame, discovery: DataFrame, power: DataFrame | None = None) -> DataFrame:
    """One row for each (dataset, seed, method) of any of the tables, with the means of each table's metrics and the track.

    Columns other than the keys are metrics; the names of a table are set before its metrics.
    """

    def means(df: DataFrame, prefix: str) -> DataFrame:
        metrics = [c for c in df.columns if c not in SEED_KEYS]
        return df.groupBy(*SEED_KEYS).agg(*[F.avg(c).alias(f"{prefix}_{c}") for c in metrics])

    tables = [means(recovery, "recovery"), means(discovery, "discovery")] + ([means(power, "power")] if power is not None else [])
    out = reduce(lambda a, b: a.join(b, SEED_KEYS, "full"), tables)
    return out.withColumn("track", labels.track_of(F.col("method")))


def method_summary(seeds: DataFrame) -> DataFrame:
    """dataset, method, track and the mean and sample deviation over seeds of every metric."""
    metrics = [c for c in seeds.columns if c not in (*SEED_KEYS, "track")]
    both = [f(c).alias(f"{c}_{name}") for c in metrics for name, f in (("mean", F.avg), ("std", F.stddev_samp))]
    return seeds.groupBy("dataset", "method").agg(*both).withColumn("track", labels.track_of(F.col("method")))


def seed_counts(seeds: DataFrame, least: int) -> DataFrame:
    """dataset, n_unique_seeds, passes."""
    out = seeds.groupBy("dataset").agg(F.countDistinct("seed").alias("n_unique_seeds"))
    return out.withColumn("passes", F.col("n_unique_seeds") >= least)


def seed_gate(seeds: DataFrame, least: int) -> DataFrame:
    """The counts, or GateFailure naming the datasets (one row each) of too few seeds."""
    counts = seed_counts(seeds, least)
    failing = counts.where(~F.col("passes")).orderBy("dataset").collect()
    if failing:
        raise GateFailure(f"fewer than {least} seeds: " + ", ".join(f"{r['dataset']}:{r['n_unique_seeds']}" for r in failing))
    return counts


def fairness_manifest(seeds: DataFrame, **budgets: int | float | str) -> DataFrame:
    """One row for each method: its track, whether input and seeds are shared, and the budgets as columns."""
    own = ~F.col("method").startswith("Curated-")
    out = seeds.where("method is not null").select("method").distinct()
    out = out.withColumn("track", labels.track_of(F.col("method"))).withColumn("shared_input_pipeline", own).withColumn("seed_controlled", own)
    return out.withColumns({f"{name}_budget": F.lit(value) for name, value in budgets.items()})


def with_track(stats: DataFrame, seeds: DataFrame) -> DataFrame:
    """A missing track is taken from the seeds' table, else it is unknown."""
    known = seeds.groupBy("method").agg(F.min("track").alias("_track"))
    own = F.col("track") if "track" in stats.columns else F.lit(None).cast("string")
    return stats.join(known, "method", "left").withColumn("track", F.coalesce(own, "_track", F.lit("unknown"))).drop("_track")


def with_fairness(stats: DataFrame, manifest: DataFrame) -> DataFrame:
    """Adds shared_input_pipeline, seed_controlled and fairness_pass, false for methods the manifest lacks."""
    both = ["shared_input_pipeline", "seed_controlled"]
    flags = manifest.groupBy("method").agg(*[F.max_by(labels.flag(F.col(c)), "track").alias(c) for c in both])
    out = stats.join(flags, "method", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in both})
    return out.withColumn("fairness_pass", F.col(both[0]) & F.col(both[1]))


def rank_leaderboard(summary: DataFrame, metrics: list[str], smaller: tuple[str, ...] = (), scope: tuple[str, ...] = ("dataset", "track")) -> DataFrame:
    """scope..., method, n_metrics, mean_rank, position: the mean of average ranks over the metrics a method has."""
    has = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    df = summary
    for m in metrics:
        rank = average_rank([*scope, has(m)], F.col(m), descending=m not in smaller)
        df = df.withColumn(f"_r_{m}", F.when(has(m), rank))
    ranks = F.array_compact(F.array(*[F.col(f"_r_{m}").cast("double") for m in metrics]))
    mean = F.try_divide(F.aggregate(ranks, F.lit(0.0), lambda a, x: a + x), F.size(ranks))
    df = df.select(*scope, "method", F.size(ranks).alias("n_metrics"), mean.alias("mean_rank"))
    order = Window.partitionBy(*scope).orderBy(F.asc_nulls_last(F.round("mean_rank", 9)), "method")
    return df.withColumn("position", F.row_number().over(order))


def leakage_split(collection: DataFrame, fraction: float, seed: int, name: str = "set_name") -> DataFrame:
    """name, part: tune or eval for the sets of one collection, so that tuning never sees what is judged; under two sets: both."""
    one = collection.select(name).where(F.col(name).isNotNull()).distinct()
    n = one.count()
    if n < 2:
        return one.withColumn("part", F.explode(F.array(F.lit("tune"), F.lit("eval"))))
    n_tune = min(max(round(n * min(max(fraction, 0.1), 0.9)), 1), n - 1)
    order = Window.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(name))), name)  # one row a set
    return one.withColumn("part", F.when(F.row_number().over(order) <= n_tune, "tune").otherwise("eval"))


def tuning_score(row: DataFrame) -> DataFrame:
    """Adds score: alignment, with a little coverage and specificity and less redundancy; null without alignment."""
    c = lambda x: F.col(x)
    return row.withColumn("score", c("alignment") + 0.08 * c("coverage") + 0.05 * c("specificity") - 0.02 * c("redundancy"))


def robust_score(scores: DataFrame, scope: list[str], worst: float = 0.2) -> DataFrame:
    """scope..., n_collections, robust_score: (1 - w) times the mean plus w times the worst of the finite scores."""
    w = min(max(float(worst), 0.0), 0.8)
    ok = F.when(F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf")), F.col("score"))
    return scores.groupBy(*scope).agg(F.count(ok).alias("n_collections"), ((1 - w) * F.avg(ok) + w * F.min(ok)).alias("robust_score"))


def programs_fingerprint(members: DataFrame, scope: list[str], program: str = "program") -> DataFrame:
    """scope..., fingerprint: equal for equal programs of equal genes, whatever their order."""
    one = members.select(*scope, program, "gene").distinct().groupBy(*scope, program).agg(F.array_join(F.array_sort(F.collect_list("gene")), ",").alias("genes"))
    whole = one.groupBy(*scope).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", program, "genes"))), ";").alias("text"))
    return whole.select(*scope, F.md5("text").alias("fingerprint"))


def species_of(genes: DataFrame, scope: list[str], order: list[str], first: int = 500) -> DataFrame:
    """scope..., species: mouse where, of the first symbols that hold a letter, more look like Abc1 than like ABC1."""
    g = F.col("gene")
    head = genes.where(g.rlike(r"\p{L}")).withColumn("_k", F.row_number().over(Window.partitionBy(*scope).orderBy(*order))).where(F.col("_k") <= first)
    title = (F.length(g) >= 2) & g.rlike(r"\A\p{Lu}") & F.substring(g, 2, 3).rlike(r"\p{Ll}")
    out = head.groupBy(*scope).agg(F.count("*").alias("n"), F.avg((g == F.upper(g)).cast("int")).alias("upper_share"), F.avg(title.cast("int")).alias("title_share"))
    return out.withColumn("species", F.when(F.col("title_share") > F.col("upper_share"), "mouse").otherwise("human"))


def model_agreement(members: DataFrame, scope: list[str], model: str = "model") -> DataFrame:
    """scope..., model_a < model_b, mean_best_match over both sides, ari, nmi of the genes that both assign, programs of each.

    members: scope..., model, program, gene. Every ordered pair of models is one join on the gene.
    """
    side = lambda c, p: members.select(*scope, F.col(model).alias(c), F.col("program").alias(p), "gene")
    a, b = side("model_a", "pa"), side("model_b", "pb")
    size = members.groupBy(*scope, model, "program").agg(F.count("*").alias("n"))
    k = a.join(b, [*scope, "gene"]).where("model_a <> model_b").groupBy(*scope, "model_a", "pa", "model_b", "pb").agg(F.count("*").alias("k"))
    k = k.join(size.withColumnsRenamed({model: "model_a", "program": "pa", "n": "na"}), [*scope, "model_a", "pa"]).join(size.withColumnsRenamed({model: "model_b", "program": "pb", "n": "nb"}), [*scope, "model_b", "pb"])
    best = k.groupBy(*scope, "model_a", "pa", "model_b").agg(F.max(sets.jaccard(F.col("k"), F.col("na"), F.col("nb"))).alias("best"))
    models = size.groupBy(*scope, model).agg(F.count("*").alias("n_programs"))
    pairs = models.withColumnsRenamed({model: "model_a", "n_programs": "programs_a"}).join(models.withColumnsRenamed({model: "model_b", "n_programs": "programs_b"}), scope or F.lit(True)).where("model_a <> model_b")
    every = pairs.join(best.groupBy(*scope, "model_a", "model_b").agg(F.sum("best").alias("s")), [*scope, "model_a", "model_b"], "left")
    lo, hi = F.least("model_a", "model_b"), F.greatest("model_a", "model_b")
    match = every.select(*scope, lo.alias("model_a"), hi.alias("model_b"), F.coalesce("s", F.lit(0.0)).alias("s"), F.col("programs_a").alias("n")).groupBy(*scope, "model_a", "model_b").agg((F.sum("s") / F.sum("n")).alias("mean_best_match"))
    own = sets.first_labels(members, [*scope, model], "program")
    both = own.withColumnsRenamed({model: "model_a", "label": "label_a"}).join(own.withColumnsRenamed({model: "model_b", "label": "label_b"}), [*scope, "gene"]).where("model_a < model_b")
    agree = sets.label_agreement(both, [*scope, "model_a", "model_b"]).select(*scope, "model_a", "model_b", "ari", "nmi")
    out = pairs.where("model_a < model_b").join(match, [*scope, "model_a", "model_b"]).join(agree, [*scope, "model_a", "model_b"], "left")
    return out.fillna(0.0, ["ari", "nmi"]).select(*scope, "model_a", "model_b", "mean_best_match", "ari", "nmi", "programs_a", "programs_b")


def consensus_of_models(members: DataFrame, scope: list[str], threshold: float, model: str = "model") -> DataFrame:
    """scope..., program, gene: genes of the first model's programs that the best match in every other model holds too.

    A program counts only if each other model has a match of at least the threshold; ties of the
    best match go to the smaller name. The first model of a scope is the smallest name.
    """
    first = members.groupBy(*scope).agg(F.min(model).alias("_first"), F.countDistinct(model).alias("_n")).where("_n > 1")
    m = members.join(first, scope) if scope else members.join(F.broadcast(first))
    base = m.where(F.col(model) == F.col("_first")).select(*scope, "_n", "program", "gene")
    rest = m.where(F.col(model) != F.col("_first")).select(*scope, F.col(model).alias("other_model"), F.col("program").alias("other"), "gene")
    size_a, size_b = base.groupBy(*scope, "program").agg(F.count("*").alias("na")), rest.groupBy(*scope, "other_model", "other").agg(F.count("*").alias("nb"))
    k = base.join(rest, [*scope, "gene"]).groupBy(*scope, "program", "other_model", "other").agg(F.count("*").alias("k"))
    k = k.join(size_a, [*scope, "program"]).join(size_b, [*scope, "other_model", "other"]).withColumn("jaccard", sets.jaccard(F.col("k"), F.col("na"), F.col("nb")))
    best = sets.best_match(k, [*scope, "program", "other_model"], "other").where(F.col("jaccard") >= threshold)
    held = best.select(*scope, "program", "other_model", "other").join(rest, [*scope, "other_model", "other"]).select(*scope, "program", "gene")
    held = held.groupBy(*scope, "program", "gene").agg(F.count("*").alias("in_models"))
    return base.join(held, [*scope, "program", "gene"]).where(F.col("in_models") == F.col("_n") - 1).select(*scope, "program", "gene")


def compared_collections(cases: DataFrame, scope: str = "collection") -> DataFrame:
    """The recovery figures of several collections in one table, with their position by mean reciprocal rank."""
    out = validate.recovery(cases, [scope])
    return out.withColumn("position", F.row_number().over(Window.orderBy(F.desc(F.round("mrr", 9)), scope)))  # one row a collection


def reproducibility_rates(matches: DataFrame, on: list[str]) -> DataFrame:
    """on..., programs, replicated ones, their rate and the share of replicated ones of one direction, of best matches."""
    ok = F.col("reproduced")
    out = matches.groupBy(*on).agg(
        F.count("*").alias("n_top_programs"), F.count(F.when(ok, 1)).alias("n_replicated"), F.count(F.when(ok & F.col("same_direction"), 1)).alias("n_concordant"),
        F.avg("jaccard").alias("mean_jaccard"), F.median("jaccard").alias("median_jaccard"),
    )
    return out.withColumn("replication_rate", F.try_divide("n_replicated", "n_top_programs")).withColumn("direction_rate", F.try_divide("n_concordant", "n_replicated"))


def reproducibility_summary(matches: DataFrame, scope: list[str]) -> DataFrame:
    """scope..., comparisons, mean rates over the ordered pairs of cohorts, mean and median of all best matches."""
    pairs = reproducibility_rates(matches, [*scope, "baseline", "replicate"])
    rates = pairs.groupBy(*scope).agg(F.count("*").alias("n_comparisons"), F.avg("replication_rate").alias("mean_replication_rate"), F.avg("direction_rate").alias("mean_direction_rate"))
    whole = matches.groupBy(*scope).agg(F.avg("jaccard").alias("mean_jaccard"), F.median("jaccard").alias("median_jaccard"))
    return rates.join(whole, scope)


def ambiguous_labels(cells: DataFrame, key: str, label: str) -> DataFrame:
    """key, n_labels of the donors whose cells name more than one label; a missing label is one too."""
    return cells.groupBy(key).agg(F.countDistinct(F.coalesce(F.col(label).cast("string"), F.lit("\x00"))).alias("n_labels")).where("n_labels > 1")


def sentences(rows: DataFrame, *parts: Column | str, name: str = "sentence") -> DataFrame:
    """Adds a text of literal parts and columns; numbers get four significant digits."""
    kinds = dict(rows.dtypes)
    text = [F.format_string("%.4g", F.col(p)) if kinds.get(p) in ("double", "float") else F.col(p).cast("string") if p in kinds else F.lit(p) for p in parts]
    return rows.withColumn(name, F.concat(*text))
