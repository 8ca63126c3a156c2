"""Stability, robustness, reproducibility, context benchmarks, evidence gates."""

from pyspark.sql import functions as F

from genoloom.operators import validate
from genoloom.plans import frames as f
from genoloom.plans.registry import query
from genoloom.runtime import clean_name

_COHORT = f.with_(f.LISTS) + """, l as (select distinct split_part(run_label, '/', 1) as cohort, split_part(run_label, '/', 2) as run, program, gene from lists where run_label like '%/%'),
 b as (select distinct cohort, program, gene from l where run = 'baseline'), v as (select cohort, run, program as other, gene from l where run <> 'baseline'),
 bx as (select b.cohort, run, program, gene from b join (select distinct cohort, run from v) using (cohort)),
 nb as (select cohort, run, program, count(*) as n from bx group by all), nv as (select cohort, run, other, count(*) as m from v group by all),
 k as (select cohort, run, program, other, count(*) as k from bx join v using (cohort, run, gene) group by all),
 o as (select k.*, k / (n + m - k) as j from k join nb using (cohort, run, program) join nv using (cohort, run, other)),
 fb as (select nb.cohort, nb.run, nb.program, coalesce(max(j), 0) as j from nb left join o using (cohort, run, program) group by all),
 rv as (select nv.cohort, nv.run, nv.other, coalesce(max(j), 0) as j from nv left join o using (cohort, run, other) group by all)
"""


def cohort_sides(s, d):
    df = f.list_sets(s, d).where("run_label like '%/%'")
    df = df.select(F.split_part("run_label", F.lit("/"), F.lit(1)).alias("cohort"), F.split_part("run_label", F.lit("/"), F.lit(2)).alias("run"), "program", "gene").distinct()
    variant = df.where("run <> 'baseline'")
    base = df.where("run = 'baseline'").drop("run").distinct().join(variant.select("cohort", "run").distinct(), "cohort")
    return base.select("cohort", "run", "program", "gene"), variant


@query(_COHORT + """, x as (select cohort, run, avg(j) as a, median(j) as b, min(j) as c, max(j) as d, count(*) as n from fb group by 1, 2), y as (select cohort, run, avg(j) as a, median(j) as b, min(j) as c, max(j) as d, count(*) as n from rv group by 1, 2)
select cohort, run, round(x.a, 6) as baseline_mean, round(x.b, 6) as baseline_median, round(x.c, 6) as baseline_min, round(x.d, 6) as baseline_max, x.n as baseline_n,
 round(y.a, 6) as variant_mean, round(y.b, 6) as variant_median, round(y.c, 6) as variant_min, round(y.d, 6) as variant_max, y.n as variant_n from x full join y using (cohort, run)""")
def stability_summary(s, d):
    out = validate.pairwise_stability(*cohort_sides(s, d), ["cohort", "run"])
    return out.withColumns({c: F.round(c, 6) for c, t in out.dtypes if t == "double"})


@query(_COHORT + """ select fb.cohort, fb.run, fb.program, round(fb.j, 6) as best_jaccard, o.other, coalesce(o.k, 0) as overlap_n from fb left join (select * from o qualify row_number() over (partition by cohort, run, program order by round(j, 12) desc, other) = 1) o using (cohort, run, program)""")
def robustness_best_match(s, d):
    base, variant = cohort_sides(s, d)
    out = validate.directional_best(base, variant.withColumnRenamed("program", "other"), ["cohort", "run"], "program", "other")
    return out.withColumns({"best_jaccard": F.round("best_jaccard", 6), "overlap_n": F.coalesce("overlap_n", F.lit(0))})


@query("""with x as (select *, coalesce(baseline_claim_supported, false) as b, coalesce(perturbation_claim_supported, false) as p from robustness_program_matches where perturbation_label is not null)
select perturbation_label, count(*) as n_matches, count(*) filter (b) as n_supported, count(*) filter (b and p) as n_retained, count(*) filter (b or p) as n_either, round(avg(best_match_jaccard), 6) as mean_best_match,
 round(count(*) filter (b and p) / nullif(count(*) filter (b), 0), 6) as claim_retention, round(coalesce(count(*) filter (b and p) / nullif(count(*) filter (b or p), 0), 0), 6) as claim_jaccard from x group by 1""")
def claim_retention(s, d):
    df = f.load(s, d, "robustness_program_matches").where("perturbation_label is not null")
    out = validate.claim_retention(df, ["perturbation_label"])
    return out.withColumns({c: F.round(c, 6) for c in ("mean_best_match", "claim_retention", "claim_jaccard")})


@query(f.with_(f.CONTEXT) + """, e as (select distinct run_id, ensemble_id from discovery_runs where run_id is not null and ensemble_id is not null), h as (select ensemble_id, min(run_id) as first_run from e group by 1),
 g as (select run_id, gene, avg(context_evidence) as v from context where context_evidence is not null group by 1, 2),
 j as (select e.ensemble_id, e.run_id, a.v as x, b.v as y from e join h using (ensemble_id) join g a on a.run_id = first_run join g b on b.run_id = e.run_id and b.gene = a.gene where e.run_id <> first_run)
select ensemble_id, run_id, count(*) as n_pairs, round(case when count(*) >= 2 and stddev_pop(x) > 1e-12 and stddev_pop(y) > 1e-12 then corr(x, y) end, 6) as r from j group by 1, 2""")
def context_correlation(s, d):
    """Mean evidence by gene of the first run of an ensemble against its other runs."""
    g = f.context(s, d).where("context_evidence is not null").groupBy("run_id", "gene").agg(F.avg("context_evidence").alias("v"))
    runs = f.load(s, d, "discovery_runs").select("run_id", "ensemble_id").where("run_id is not null and ensemble_id is not null").distinct()
    pairs = runs.join(runs.groupBy("ensemble_id").agg(F.min("run_id").alias("first_run")), "ensemble_id").where("run_id <> first_run")
    df = pairs.join(g.toDF("first_run", "gene", "x"), "first_run").join(g.toDF("run_id", "gene", "y"), ["run_id", "gene"])
    return df.groupBy("ensemble_id", "run_id").agg(F.count("*").alias("n_pairs"), F.round(validate.safe_corr("x", "y"), 6).alias("r"))


_REPRO = f.with_(f.LISTS) + f""", c0 as (select distinct split_part(run_label, '/', 1) as grp, run_label as cohort, program, gene from lists where run_label like '%/%'),
 c as (select grp, cohort, program, count(*) as n, list(distinct gene) as genes from c0 group by all),
 rf as (select program, max(jaccard) as best, case when max(overlap_n) % 2 = 0 then 1 else -1 end as sg from (select {f.NAME('program')} as program, case when isfinite(jaccard) then jaccard end as jaccard, overlap_n from program_reference_overlap_long) where program is not null group by 1),
 z as (select c.*, -best as rv, coalesce(sg, 0) as sg from c left join rf using (program)),
 tp as (select * from z qualify row_number() over (partition by grp, cohort order by rv nulls last, program) <= 20),
 sh as (select a.grp, a.cohort as baseline, a.program, b.cohort as replicate, b.program as other, count(*) as k from (select t.grp, t.cohort, t.program, c0.gene from tp t join c0 using (grp, cohort, program)) a join c0 b on a.grp = b.grp and a.gene = b.gene and a.cohort <> b.cohort group by all),
 jj as (select sh.*, k / (x.n + y.n - k) as j, x.sg as sa, y.sg as sb, y.rv as rb from sh join z x on x.grp = sh.grp and x.cohort = baseline and x.program = sh.program join z y on y.grp = sh.grp and y.cohort = replicate and y.program = other),
 bm as (select * from jj qualify row_number() over (partition by grp, baseline, program, replicate order by round(j, 12) desc, rb nulls last, other) = 1),
 pr as (select t.grp, t.cohort as baseline, t.program, r.replicate from tp t join (select distinct grp, cohort as replicate from z) r on r.grp = t.grp and r.replicate <> t.cohort)
select pr.grp, pr.baseline, pr.replicate, pr.program, other as matched_program, round(coalesce(j, 0), 6) as jaccard, coalesce(j, 0) >= 0.1 as reproduced, coalesce(sa = sb, false) as same_direction
 from pr left join bm using (grp, baseline, program, replicate)"""


@query(_REPRO)
def cohort_reproducibility(s, d):
    """Runs of a cohort as replicates of each other; the annotation report gives the order and a sign."""
    df = f.list_sets(s, d).where("run_label like '%/%'").select(F.split_part("run_label", F.lit("/"), F.lit(1)).alias("grp"), F.col("run_label").alias("cohort"), "program", "gene")
    c = df.groupBy("grp", "cohort", "program").agg(F.collect_set("gene").alias("genes"))
    rep = f.load(s, d, "program_reference_overlap_long").select(clean_name("program").alias("program"), F.when(F.abs("jaccard") < float("inf"), F.col("jaccard")).alias("jaccard"), "overlap_n")
    rep = rep.where("program is not null").withColumn("jaccard", F.when(~F.isnan("jaccard"), F.col("jaccard")))
    rep = rep.groupBy("program").agg((-F.max("jaccard")).alias("rank_value"), F.when(F.max("overlap_n") % 2 == 0, 1).otherwise(-1).alias("sign"))
    c = c.join(rep, "program", "left").withColumn("sign", F.coalesce("sign", F.lit(0)))
    return validate.reproducibility(c).withColumn("jaccard", F.round("jaccard", 6))


_CTX = """m as (select distinct event_type as context, cast(floor(cast(json_extract_string(props, '$.k') as int) / 10) as int) as program, user_id as gene from events)"""


def context_members(s, d):
    """Event types stand for contexts, buckets of k for programs, users for genes."""
    df = f.load(s, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return df.select(F.col("event_type").alias("context"), F.floor(k / 10).cast("int").alias("program"), F.col("user_id").alias("gene")).distinct()


@query(f.with_(_CTX) + """, n as (select gene, program, count(*) as n from m group by 1, 2), p as (select *, n / sum(n) over (partition by gene) as p from n)
select gene, sum(n)::bigint as n_contexts, count(*) as n_programs, round(case when count(*) > 1 then -sum(p * log2(p)) / log2(count(*)) else 0 end, 6) as entropy from p group by 1""")
def gene_reassignment(s, d):
    return validate.context_reassignment(context_members(s, d)).withColumn("entropy", F.round("entropy", 6))


@query(f.with_(_CTX) + """, z as (select context, program, count(*) as n from m group by 1, 2), k as (select a.program, a.context, b.context as other, count(*) as k from m a join m b on a.program = b.program and a.gene = b.gene and a.context < b.context group by all)
select x.program, count(*) as n_pairs, round(avg(coalesce(k, 0) / (x.n + y.n - coalesce(k, 0))), 6) as mean_jaccard from z x join z y on x.program = y.program and x.context < y.context
 left join k on k.program = x.program and k.context = x.context and k.other = y.context group by 1""")
def cross_context_jaccard(s, d):
    return validate.cross_context_jaccard(context_members(s, d)).withColumn("mean_jaccard", F.round("mean_jaccard", 6))


@query(f.with_(_CTX) + ", n as (select program, context, count(*) as n from m group by 1, 2) select program, context, n, round(n / sum(n) over (partition by program), 6) as share from n")
def context_share(s, d):
    return validate.context_share(context_members(s, d)).withColumn("share", F.round("share", 6))


_RANKS = f.with_(f.LISTS) + """, x as (select list_id, n, row_number() over (partition by run_label order by n desc, list_id) as rank, count(*) over (partition by run_label) as n_items, run_label from (select list_id, run_label, count(*) as n from lists group by all))
select run_label, count(*) as n_cases, round(avg(1 / rank), 6) as mrr, round(avg(case when rank <= 1 then 1.0::double else 0 end), 6) as recall_1, round(avg(case when rank <= 5 then 1.0::double else 0 end), 6) as recall_5,
 round(avg(case when rank <= 10 then 1.0::double else 0 end), 6) as recall_10, round(avg((n_items - rank + 1) / n_items), 6) as aurc from x group by 1"""


@query(_RANKS)
def rank_recovery(s, d):
    from pyspark.sql import Window

    n = f.list_sets(s, d).groupBy("list_id", "run_label").agg(F.count("*").alias("n"))
    part = Window.partitionBy("run_label")
    ranks = n.select("run_label", F.row_number().over(part.orderBy(F.desc("n"), "list_id")).alias("rank"), F.count("*").over(part).alias("n_items"))
    out = validate.recovery(ranks, ["run_label"])
    return out.withColumns({c: F.round(c, 6) for c, t in out.dtypes if t == "double"})


_SEEDS = """x as (select o_orderpriority as method, year(o_orderdate) as seed, avg(o_totalprice) as price, count(*) as n from orders group by 1, 2),
 r as (select seed, price as ref from x where method = '5-LOW'), dl as (select method, seed, price - ref as delta from x join r using (seed) where method <> '5-LOW')"""


def seed_deltas(s, d):
    """Priorities as methods, years as seeds: mean price against that of the lowest priority."""
    x = f.load(s, d, "orders").groupBy(F.col("o_orderpriority").alias("method"), F.year("o_orderdate").alias("seed")).agg(F.avg("o_totalprice").alias("price"), F.count("*").alias("n"))
    r = x.where("method = '5-LOW'").select("seed", F.col("price").alias("ref"))
    return x, x.where("method <> '5-LOW'").join(r, "seed").select("method", "seed", (F.col("price") - F.col("ref")).alias("delta"))


@query(f.with_(_SEEDS) + """, q as (select method, count(*) as n_pairs, count(*) filter (delta <> 0) as n_non_ties, avg(delta) as m, stddev_samp(delta) as sd, 'greater' as alternative from dl group by 1),
 g as (select *, n_pairs >= 5 as p1, n_non_ties > 0 as p2, n_non_ties >= 5 as p3, m - 1.96 * sd / sqrt(n_pairs) > 0 as p5, m > 0 as p6 from q)
select method, n_pairs, n_non_ties, p1 as pairs_ok, p2 as any_difference, p3 as non_ties_ok, true as fdr_ok, coalesce(p5, false) as interval_ok, p6 as effect_ok, p1 and p2 and p3 and coalesce(p5, false) and p6 as supported,
 case when p1 and p2 and p3 and coalesce(p5, false) and p6 then 'none' when p3 and (not coalesce(p5, false) or not p6) then 'high' when not p1 or not p2 or not p3 then 'medium' else 'low' end as risk_level,
 case when p1 and p3 and coalesce(p5, false) and p6 then 'none' else array_to_string(list_filter([case when not p1 then 'insufficient_pairs' end, case when not p2 then 'no_non_ties' when not p3 then 'low_non_ties' end,
  case when not coalesce(p5, false) then 'ci_direction_fail' end, case when not p6 then 'effect_direction_fail' end], lambda x: x is not null), ';') end as risk_reason from g""")
def evidence_gates(s, d):
    _, dl = seed_deltas(s, d)
    q = dl.groupBy("method").agg(F.count("*").alias("n_pairs"), F.count(F.when(F.col("delta") != 0, 1)).alias("n_non_ties"), F.avg("delta").alias("delta_mean"), F.stddev_samp("delta").alias("sd"))
    half = 1.96 * F.col("sd") / F.sqrt("n_pairs")
    q = q.withColumns({"ci_low": F.col("delta_mean") - half, "ci_high": F.col("delta_mean") + half, "fdr": F.lit(0.0), "alternative": F.lit("greater")})
    return validate.evidence_gates(q, 5, 5, 0.05).drop("delta_mean", "sd", "ci_low", "ci_high", "fdr", "alternative")


@query(f.with_(_SEEDS) + """, a as (select seed, method, rank() over (partition by seed order by price desc) + (count(*) over (partition by seed, price) - 1) / 2 as r1, rank() over (partition by seed order by n desc) + (count(*) over (partition by seed, n) - 1) / 2 as r2 from x)
select seed, method, round((r1 + r2) / 2, 6) as mean_rank from a""")
def method_leaderboard(s, d):
    x, _ = seed_deltas(s, d)
    return validate.leaderboard(x, ["seed"], "method", ["price", "n"]).withColumn("mean_rank", F.round("mean_rank", 6))


@query(f.with_(_SEEDS) + """, o as (select method, price, seed, lag(price) over (partition by method order by seed) as pp, lag(seed) over (partition by method order by seed) as ps from x)
select method, round(coalesce(sum((seed - ps) * (price + pp) / 2) / nullif(max(seed) - min(seed), 0), 0), 4) as area from o group by 1""")
def trapezoid_area(s, d):
    x, _ = seed_deltas(s, d)
    return validate.trapezoid(x, ["method"], "seed", "price").withColumn("area", F.round("area", 4))


@query("""with v as (select baseline_label as g, best_match_jaccard as v from robustness_program_matches where baseline_label is not null and isfinite(best_match_jaccard)),
 nm as (select *, row_number() over (partition by g order by v) - 1 as i, count(*) over (partition by g) as size from v),
 dr as (select g, b, (('0x' || substr(md5('42|' || b || '|' || i), 1, 12))::bigint % size) as i from nm, range(1, 1001) t(b)),
 ms as (select g, b, avg(v) as m from dr join nm using (g, i) group by 1, 2)
select g as baseline_label, round(quantile_cont(m, 0.025), 6) as ci_low, round(quantile_cont(m, 0.975), 6) as ci_high, round(avg(m), 6) as mean from ms group by 1""")
def bootstrap_interval(s, d):
    df = f.load(s, d, "robustness_program_matches").where("baseline_label is not null and best_match_jaccard is not null and not isnan(best_match_jaccard)")
    out = validate.resampled_means(df, ["baseline_label"], "best_match_jaccard", 1_000)
    return out.withColumns({c: F.round(c, 6) for c in ("ci_low", "ci_high", "mean")})


@query("""with o as (select count(*) filter (l_quantity is null) as missing, 0::bigint as not_numeric, count(*) filter (not isfinite(l_quantity)) as not_finite, count(*) filter (l_quantity < 0) as negative,
  count(*) filter (l_quantity <> floor(l_quantity)) as not_integer, count(*) - count(distinct (l_suppkey, l_partkey)) as duplicate_ids from lineitem)
select rule, n_failed, n_failed = 0 as ok from (unpivot o on missing, not_numeric, not_finite, negative, not_integer, duplicate_ids into name rule value n_failed)""")
def matrix_report(s, d):
    raw = f.load(s, d, "lineitem").select("l_suppkey", "l_partkey", F.col("l_quantity").cast("string").alias("v"))
    return validate.matrix_report(raw, ["l_suppkey", "l_partkey"], "v")
