"""Stability, robustness, reproducibility, context benchmarks and evidence gates."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from genoloom.functions.digests import Texts
from genoloom.operators import sets


def directional_best(left: DataFrame, right: DataFrame, on: list[str], a: str, b: str) -> DataFrame:
    """on..., a, best_jaccard, b (null without overlap): the best partner of every set of the left."""
    pairs = sets.overlap(left, right, [a], [b], on)
    best = sets.best_match(pairs, [*on, a], b).select(*on, a, b, "jaccard", "overlap_n")
    everyone = left.select(*on, a).distinct()
    return everyone.join(best, [*on, a], "left").withColumn("best_jaccard", F.coalesce("jaccard", F.lit(0.0))).drop("jaccard")


def best_summary(best: DataFrame, on: list[str], prefix: str) -> DataFrame:
    v = F.col("best_jaccard")
    return best.groupBy(*on).agg(
        F.avg(v).alias(f"{prefix}_mean"), F.median(v).alias(f"{prefix}_median"), F.min(v).alias(f"{prefix}_min"), F.max(v).alias(f"{prefix}_max"), F.count("*").alias(f"{prefix}_n")
    )


def pairwise_stability(baseline: DataFrame, variant: DataFrame, on: list[str]) -> DataFrame:
    """Best-match Jaccard in both directions; both sides are (on..., program, gene)."""
    v = variant.withColumnRenamed("program", "other")
    there = best_summary(directional_best(baseline, v, on, "program", "other"), on, "baseline")
    back = best_summary(directional_best(v, baseline, on, "other", "program"), on, "variant")
    return there.join(back, on, "full")


def claim_retention(matches: DataFrame, on: list[str]) -> DataFrame:
    """Supported, retained and the Jaccard of the supported sets mapped to the baseline."""
    base, other = F.coalesce("baseline_claim_supported", F.lit(False)), F.coalesce("perturbation_claim_supported", F.lit(False))
    out = matches.groupBy(*on).agg(
        F.count("*").alias("n_matches"), F.count(F.when(base, 1)).alias("n_supported"), F.count(F.when(base & other, 1)).alias("n_retained"),
        F.count(F.when(base | other, 1)).alias("n_either"), F.avg("best_match_jaccard").alias("mean_best_match"),
    )
    return out.withColumn("claim_retention", F.try_divide(F.col("n_retained"), F.col("n_supported"))).withColumn(
        "claim_jaccard", F.coalesce(F.try_divide(F.col("n_retained"), F.col("n_either")), F.lit(0.0))
    )


def safe_corr(x: str, y: str) -> Column:
    """Pearson; null for fewer than two pairs or a constant side."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    ok = (F.count(a) >= 2) & (F.stddev_pop(a) > 1e-12) & (F.stddev_pop(b) > 1e-12)
    # the built-in corr fails on a constant side under ANSI rules
    return F.when(ok, F.try_divide(F.covar_pop(a, b), spread))


def reproducibility(cohorts: DataFrame, top_k: int = 20, threshold: float = 0.1) -> DataFrame:
    """All ordered pairs of cohorts of a group: best replicate of each of the top_k baseline programs.

    cohorts: group, cohort, program, genes (array), rank_value (smaller is better), sign. Ties of
    Jaccard (at 12 digits) go to the smaller rank value, then the name.
    """
    order = Window.partitionBy("grp", "cohort").orderBy(F.asc_nulls_last("rank_value"), "program")
    top = cohorts.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= top_k).drop("_k")
    long = lambda df, c, p: df.select("grp", F.col("cohort").alias(c), F.col("program").alias(p), F.explode("genes").alias("gene"))
    left, right = long(top, "baseline", "program"), long(cohorts, "replicate", "other")
    shared = left.join(right, ["grp", "gene"]).where("baseline <> replicate").groupBy("grp", "baseline", "program", "replicate", "other").agg(F.count("*").alias("k"))
    side = lambda c, p, n, s, r: cohorts.select("grp", F.col("cohort").alias(c), F.col("program").alias(p), F.size("genes").alias(n), F.col("sign").alias(s), F.col("rank_value").alias(r))
    df = shared.join(side("baseline", "program", "na", "sa", "ra"), ["grp", "baseline", "program"]).join(side("replicate", "other", "nb", "sb", "rb"), ["grp", "replicate", "other"])
    df = df.withColumn("jaccard", sets.jaccard(F.col("k"), F.col("na"), F.col("nb")))
    best = Window.partitionBy("grp", "baseline", "program", "replicate").orderBy(F.desc(F.round("jaccard", 12)), F.asc_nulls_last("rb"), "other")
    df = df.withColumn("_k", F.row_number().over(best)).where("_k = 1")
    pairs = top.select("grp", F.col("cohort").alias("baseline"), "program").join(
        cohorts.select("grp", F.col("cohort").alias("replicate")).distinct(), "grp"
    ).where("baseline <> replicate")
    out = pairs.join(df, ["grp", "baseline", "program", "replicate"], "left")
    j = F.coalesce("jaccard", F.lit(0.0))
    return out.select(
        "grp", "baseline", "replicate", "program", F.col("other").alias("matched_program"), j.alias("jaccard"),
        (j >= threshold).alias("reproduced"), F.coalesce(F.col("sa") == F.col("sb"), F.lit(False)).alias("same_direction"),
    )


def context_reassignment(members: DataFrame) -> DataFrame:
    """gene, n_contexts, entropy: base-2 entropy of a gene's programs over contexts, over log2 of their count."""
    n = members.groupBy("gene", "program").agg(F.count("*").alias("n"))
    n = n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("gene")))
    out = n.groupBy("gene").agg(F.sum("n").alias("n_contexts"), F.count("*").alias("n_programs"), (-F.sum(F.col("p") * F.log2("p"))).alias("h"))
    return out.select("gene", "n_contexts", "n_programs", F.when(F.col("n_programs") > 1, F.col("h") / F.log2("n_programs")).otherwise(0.0).alias("entropy"))


def cross_context_jaccard(members: DataFrame) -> DataFrame:
    """program, mean Jaccard of the same-named program over all pairs of contexts (pairs without overlap count 0)."""
    other = members.withColumnRenamed("context", "other")
    size = members.groupBy("context", "program").agg(F.count("*").alias("n"))
    pairs = size.join(size.withColumnsRenamed({"context": "other", "n": "m"}), "program").where("context < other")
    k = members.join(other, ["program", "gene"]).where("context < other").groupBy("program", "context", "other").agg(F.count("*").alias("k"))
    df = pairs.join(k, ["program", "context", "other"], "left").fillna(0, ["k"])
    return df.groupBy("program").agg(F.count("*").alias("n_pairs"), F.avg(sets.jaccard(F.col("k"), F.col("n"), F.col("m"))).alias("mean_jaccard"))


def context_share(members: DataFrame) -> DataFrame:
    """program, context, share of the program's memberships that fall into the context."""
    n = members.groupBy("program", "context").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("program")))


def recovery(ranks: DataFrame, scope: list[str], ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Of (scope..., rank of the expected item, n items): mean reciprocal rank, recall at k and the area under recall."""
    r, n = F.col("rank"), F.col("n_items")
    return ranks.groupBy(*scope).agg(
        F.count("*").alias("n_cases"), F.avg(F.coalesce(1 / r, F.lit(0.0))).alias("mrr"),
        *[F.avg(F.when(r <= k, 1.0).otherwise(0.0)).alias(f"recall_{k}") for k in ks],
        F.avg(F.coalesce(F.greatest((n - r + 1) / n, F.lit(0.0)), F.lit(0.0))).alias("aurc"),
    )


def trapezoid(points: DataFrame, scope: list[str], x: str, y: str) -> DataFrame:
    """Area under y over x by trapezoids, over the span of x."""
    w = Window.partitionBy(*scope).orderBy(x)
    df = points.withColumn("_a", (F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2)
    return df.groupBy(*scope).agg(F.coalesce(F.try_divide(F.sum("_a"), F.max(x) - F.min(x)), F.lit(0.0)).alias("area"))


def evidence_gates(rows: DataFrame, least_pairs: int, least_non_ties: int, alpha: float) -> DataFrame:
    """Six gates over (n_pairs, n_non_ties, fdr, delta_mean, ci_low, ci_high, alternative), their conjunction, reasons and a level."""
    up, down = F.col("alternative") == "greater", F.col("alternative") == "less"
    t = lambda c: F.coalesce(c, F.lit(False))
    df = rows.withColumns(
        {
            "pairs_ok": t(F.col("n_pairs") >= least_pairs),
            "any_difference": t(F.col("n_non_ties") > 0),
            "non_ties_ok": t(F.col("n_non_ties") >= least_non_ties),
            "fdr_ok": t(F.col("fdr") <= alpha),
            "interval_ok": t(F.when(up, F.col("ci_low") > 0).when(down, F.col("ci_high") < 0).otherwise((F.col("ci_low") > 0) | (F.col("ci_high") < 0))),
            "effect_ok": t(F.when(up, F.col("delta_mean") > 0).when(down, F.col("delta_mean") < 0).otherwise(F.col("delta_mean") != 0)),
        }
    )
    why = [
        F.when(~F.col("pairs_ok"), "insufficient_pairs"),
        F.when(~F.col("any_difference"), "no_non_ties").when(~F.col("non_ties_ok"), "low_non_ties"),
        F.when(~F.col("fdr_ok"), "fdr_fail"),
        F.when(~F.col("interval_ok"), "ci_direction_fail"),
        F.when(~F.col("effect_ok"), "effect_direction_fail"),
    ]
    df = df.withColumn("reasons", F.array_compact(F.array(*why)))
    has = lambda *xs: F.arrays_overlap("reasons", F.array(*[F.lit(x) for x in xs]))
    level = (
        F.when(F.size("reasons") == 0, "none")
        .when(~has("fdr_fail", "no_non_ties", "low_non_ties") & has("ci_direction_fail", "effect_direction_fail"), "high")
        .when(has("insufficient_pairs", "no_non_ties", "low_non_ties"), "medium")
        .otherwise("low")
    )
    return df.withColumn("supported", F.size("reasons") == 0).withColumn("risk_level", level).withColumn(
        "risk_reason", F.when(F.size("reasons") == 0, "none").otherwise(F.array_join("reasons", ";"))
    ).drop("reasons")


def leaderboard(scores: DataFrame, scope: list[str], method: str, metrics: list[str], smaller: tuple[str, ...] = ()) -> DataFrame:
    """scope..., method, mean_rank: the mean of average ranks over the metrics (larger is better unless named)."""
    from genoloom.operators.stats import average_rank

    df = scores
    for m in metrics:
        df = df.withColumn(f"_r_{m}", average_rank(scope, m, descending=m not in smaller))
    mean = sum((F.col(f"_r_{m}") for m in metrics), F.lit(0.0)) / len(metrics)
    return df.select(*scope, method, mean.alias("mean_rank"))


#: Draws that a task keeps for its small groups.
_KEPT_DRAWS = 4_000_000


def resampled_means(values: DataFrame, scope: list[str], value: str, n: int, seed: int = 42, alpha: float = 0.05) -> DataFrame:
    """Percentile interval of a group's mean from ``n`` resamples with keyed draws; null values are left out.

    Draw j of resample b takes the value at place md5(seed|b|j) mod size of the group's order by
    value. A draw's number is the same for all groups, so a task makes it once and reads its sorted rows
    group by group; nothing but the values is shuffled, and a task holds the values of one group.
    """
    part = Window.partitionBy(*scope)
    sorted_ = values.where(F.col(value).isNotNull()).select(*scope, F.col(value).cast("double").alias("v"))
    sorted_ = sorted_.withColumn("i", F.row_number().over(part.orderBy("v")) - 1)
    most = max(1, _KEPT_DRAWS // n)

    def intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.empty((0, n), np.uint64)

        def drawn(first: int, last: int) -> Iterator[np.ndarray]:
            places = Texts([str(i).encode() for i in range(first, last)])
            for b in range(1, n + 1):
                yield places.md5(f"{seed}|{b}|".encode())[0] >> np.uint64(16)  # twelve hexadecimal digits

        def means(v: np.ndarray) -> np.ndarray:
            nonlocal kept
            size = np.uint64(len(v))
            if len(v) <= most:
                if len(v) > len(kept):
                    upto = min(most, max(64, 2 * len(v)))
                    kept = np.stack(list(drawn(0, upto)), axis=1)
                return v[kept[: len(v)] % size].sum(axis=0) / len(v)
            total = np.zeros(n)
            for first in range(0, len(v), 1 << 16):
                for b, x in enumerate(drawn(first, min(len(v), first + (1 << 16)))):
                    total[b] += v[x % size].sum()
            return total / len(v)

        def at(m: np.ndarray, share: float) -> float:
            place = share * (len(m) - 1)
            low, high = math.floor(place), math.ceil(place)
            return float(m[low] if low == high or m[low] == m[high] else (high - place) * m[low] + (place - low) * m[high])

        def rows(heads: list[pa.RecordBatch], groups: list[np.ndarray]) -> pa.RecordBatch:
            found = []
            for v in groups:
                m = means(v)
                mean, m = sum(m.tolist()) / n, np.sort(m)
                found.append((at(m, alpha / 2), at(m, 1 - alpha / 2), mean))
            head = pa.Table.from_batches(heads).combine_chunks().select(scope)
            for name, x in zip(("ci_low", "ci_high", "mean"), zip(*found)):
                head = head.append_column(name, pa.array(x, pa.float64()))
            return head.to_batches()[0]

        head, open_ = None, []
        for batch in batches:
            starts = np.flatnonzero(batch.column("i").to_numpy() == 0)
            pieces = np.split(batch.column("v").to_numpy(), starts)
            open_.append(pieces[0])
            if not len(starts):
                continue
            before = [] if head is None else [head]
            groups = [np.concatenate(open_)] * len(before) + pieces[1:-1]
            if groups:
                yield rows([*before, batch.take(pa.array(starts[:-1]))], groups)
            head, open_ = batch.take(pa.array(starts[-1:])), [pieces[-1]]
        if head is not None:
            yield rows([head], [np.concatenate(open_)])

    kinds = [T.StructField(f.name, f.dataType) for f in values.select(*scope).schema]
    return sorted_.mapInArrow(intervals, T.StructType([*kinds, *(T.StructField(c, T.DoubleType()) for c in ("ci_low", "ci_high", "mean"))]))


def matrix_report(raw: DataFrame, ids: list[str], value: str) -> DataFrame:
    """One row for each input rule of a long matrix with text values: rule, n_failed, ok."""
    v = F.col(value).try_cast("double")
    one = raw.agg(
        F.count("*").alias("n"),
        F.count(F.when(F.col(value).isNull(), 1)).alias("missing"),
        F.count(F.when(F.col(value).isNotNull() & v.isNull(), 1)).alias("not_numeric"),
        F.count(F.when(F.isnan(v) | (F.abs(v) == float("inf")), 1)).alias("not_finite"),
        F.count(F.when(v < 0, 1)).alias("negative"),
        F.count(F.when(v != F.floor(v), 1)).alias("not_integer"),
        (F.count("*") - F.count_distinct(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ids])).alias("duplicate_ids"),
    )
    rules = ["missing", "not_numeric", "not_finite", "negative", "not_integer", "duplicate_ids"]
    out = one.select(F.inline(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("n_failed")) for r in rules])))
    return out.withColumn("ok", F.col("n_failed") == 0)
