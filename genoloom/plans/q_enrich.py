"""Enrichment, corrections, paired tests, single-sample scores."""


from pyspark.sql import functions as F

from genoloom.operators import gsea, stats
from genoloom.plans import frames as f
from genoloom.plans.registry import query


def _r(df, *cols, n=6, nudge=0.0):
    """Rounded columns; a nudge moves values that lie exactly between two results off that place."""
    return df.withColumns({c: F.round(F.col(c) + nudge, n) for c in cols})


def sets_of(s, d):
    return f.references(s, d).select("set_name", "gene").distinct()


_SETS = f.with_(f.RANKED, f.REFERENCES) + ", sets as (select distinct set_name, gene from refs)"

_FISHER = _SETS + f""", u as (select file_id, count(*) as background_size, count(*) filter (score >= 2) as query_size from ranked group by 1),
 p as (select file_id, set_name, count(*) as program_size, count(*) filter (score >= 2) as overlap, coalesce(string_agg(gene, ',' order by gene) filter (score >= 2), '') as overlap_genes
   from ranked join sets using (gene) group by 1, 2),
 x as (select *, overlap as a, program_size as m, query_size as q, background_size as n from p join u using (file_id)),
 t as (select *, case when a = 0 then 1.0 else least(1.0, list_sum(list_transform(range(a, least(m, q) + 1), lambda x: case when n - m - q + x < 0 then 0 else
   exp(lgamma(m + 1) - lgamma(x + 1) - lgamma(m - x + 1) + lgamma(n - m + 1) - lgamma(q - x + 1) - lgamma(n - m - q + x + 1) - lgamma(n + 1) + lgamma(q + 1) + lgamma(n - q + 1)) end))) end as p_value,
   coalesce(a / nullif(m * q / n, 0), 0) as fold from x),
 z as (select *, count(*) over (partition by file_id) as k, row_number() over (partition by file_id order by p_value, set_name) as r from t),
 w as (select *, least(1.0, min(p_value * k / r) over (partition by file_id order by r desc)) as fdr from z)
"""


def fisher_rows(s, d):
    """Genes of score >= 2 of each file against the reference sets, the file's genes as background."""
    ranked = f.ranked(s, d).select("file_id", "gene", (F.col("score") >= 2).alias("hit"))
    universe = ranked.groupBy("file_id").agg(F.count("*").alias("background_size"), F.count(F.when(F.col("hit"), 1)).alias("query_size"))
    rows = ranked.join(sets_of(s, d), "gene").groupBy("file_id", "set_name").agg(
        F.count("*").alias("program_size"),
        F.count(F.when(F.col("hit"), 1)).alias("overlap"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("hit"), F.col("gene")))), ",").alias("overlap_genes"),
    )
    rows = rows.join(universe, "file_id")
    k, m, q, n = (F.col(c) for c in ("overlap", "program_size", "query_size", "background_size"))
    odds = F.try_divide((k * (n - m - q + k)).cast("double"), (m - k) * (q - k))
    rows = rows.withColumn("p_value", stats.fisher_greater(k, m, q, n)).withColumn("odds_ratio", odds).withColumns(stats.fold_columns(k, m, q, n))
    return stats.bh(rows, "p_value", "fdr", ["file_id"], ["set_name"])


@query(_FISHER + """select file_id, set_name, overlap, overlap_genes, program_size, query_size, background_size, round(a * (n - m - q + a) / nullif((m - a) * (q - a), 0), 6) as odds_ratio,
 round(p_value, 9) as p_value, round(fold, 6) as fold_enrichment, round(case when a > 0 then exp(ln(fold) - 1.959963984540054 / sqrt(a)) else 0 end, 6) as fold_enrichment_ci_lo,
 round(case when a > 0 then exp(ln(fold) + 1.959963984540054 / sqrt(a)) else 0 end, 6) as fold_enrichment_ci_hi, round(fdr, 9) as fdr from w""")
def fisher_enrichment(s, d):
    out = _r(fisher_rows(s, d), "odds_ratio", "fold_enrichment", "fold_enrichment_ci_lo", "fold_enrichment_ci_hi")
    return _r(out, "p_value", "fdr", n=9)


@query(f.with_(f.REFERENCES, f.RANKED) + """, w as (select set_name, gene, max(coalesce(case when isnan(weight) then null else weight end, 1)) as weight from
   (select set_name, """ + f.GENE + """ as gene, weight from gene_set) where set_name is not null and gene is not null group by 1, 2)
select file_id, set_name, count(*) filter (weight > 0.1) as set_size, count(*) filter (weight > 0.1 and score >= 2) as overlap,
 round(coalesce(sum(weight) filter (weight > 0.1 and score >= 2), 0), 6) as weight_sum from ranked join w using (gene) group by 1, 2""")
def weighted_fisher_overlap(s, d):
    w = f.load(s, d, "gene_set").select("set_name", f.clean_gene("gene").alias("gene"), F.coalesce(F.nanvl("weight", F.lit(1.0)), F.lit(1.0)).alias("weight"))
    w = w.where("set_name is not null and gene is not null").groupBy("set_name", "gene").agg(F.max("weight").alias("weight"))
    heavy, hit = F.col("weight") > 0.1, F.col("score") >= 2
    return f.ranked(s, d).join(w, "gene").groupBy("file_id", "set_name").agg(
        F.count(F.when(heavy, 1)).alias("set_size"), F.count(F.when(heavy & hit, 1)).alias("overlap"),
        F.round(F.coalesce(F.sum(F.when(heavy & hit, F.col("weight"))), F.lit(0.0)), 6).alias("weight_sum"),
    )


_HITS = _SETS + """, h0 as (select file_id, set_name, gene, score, rank_no, n_genes, abs(score) as w, count(*) over (partition by file_id, set_name) as n_hits from ranked join sets using (gene)),
 h as (select *, row_number() over (partition by file_id, set_name order by rank_no) as i, sum(w) over (partition by file_id, set_name order by rank_no) as cum,
   case when sum(w) over (partition by file_id, set_name) = 0 then 1 else sum(w) over (partition by file_id, set_name) end as tot from h0 where n_hits >= 3),
 wk as (select *, cum / tot - coalesce((rank_no - i) / nullif(n_genes - n_hits, 0), 0) as af, case when rank_no > 1 then (cum - w) / tot - coalesce((rank_no - i) / nullif(n_genes - n_hits, 0), 0) end as bf from h),
 e0 as (select file_id, set_name, max(n_genes) as n_genes, max(n_hits) as n_hits, max(af) as hi, least(coalesce(min(bf), 0), 0, max(cum / tot) - case when max(n_genes) > max(n_hits) then 1 else 0 end) as lo from wk group by 1, 2),
 es as (select *, case when round(abs(hi), 12) >= round(abs(lo), 12) then hi else lo end as es from e0)
"""


@query(_HITS + "select file_id, set_name, n_genes, n_hits, round(es, 6) as es from es")
def gsea_es(s, d):
    hit = gsea.hits(f.ranked(s, d), sets_of(s, d), "set_name", 3)
    return _r(gsea.enrichment_scores(hit, ["file_id", "set_name"]), "es")


@query(_HITS + """, l as (select wk.*, hi, least(coalesce(min(bf) over (partition by wk.file_id, wk.set_name), 0), 0) as lw from wk join e0 using (file_id, set_name)),
 m as (select *, round(abs(hi), 12) >= round(abs(lw), 12) as up, min(case when round(af, 12) = round(hi, 12) then rank_no end) over (partition by file_id, set_name) as pk,
   min(case when round(bf, 12) = round(lw, 12) then rank_no end) over (partition by file_id, set_name) as tr from l)
select file_id, set_name, count(*) as n_leading, string_agg(gene, ',' order by rank_no) as leading_genes from m where case when up then rank_no <= pk else rank_no >= tr end group by 1, 2""")
def gsea_leading_edge(s, d):
    return gsea.leading_edge(gsea.hits(f.ranked(s, d), sets_of(s, d), "set_name", 3), ["file_id", "set_name"])


PERMS = 100


SQL_100 = _HITS + f""", pm as (select file_id, perm, gene, n_genes, row_number() over (partition by file_id, perm order by md5('42|' || perm || '|' || gene), gene) as pr from ranked, range(1, {PERMS + 1}) t(perm)),
 mv as (select h0.file_id, h0.set_name, pm.perm, pm.pr, h0.n_hits, pm.n_genes, abs(r.score) as w from h0 join pm on pm.file_id = h0.file_id and pm.gene = h0.gene
   join ranked r on r.file_id = h0.file_id and r.rank_no = pm.pr where n_hits >= 3),
 mi as (select *, row_number() over g as i, sum(w) over g as cum, sum(w) over (partition by file_id, set_name, perm) as s from mv window g as (partition by file_id, set_name, perm order by pr)),
 ma as (select *, case when s = 0 then 1 else s end as tot from mi),
 mb as (select *, cum / tot - coalesce((pr - i) / nullif(n_genes - n_hits, 0), 0) as af, case when pr > 1 then (cum - w) / tot - coalesce((pr - i) / nullif(n_genes - n_hits, 0), 0) end as bf from ma),
 mc as (select file_id, set_name, perm, max(n_genes) as n, max(n_hits) as m, max(af) as hi, least(coalesce(min(bf), 0), 0, max(cum / tot) - 1) as lo from mb group by 1, 2, 3),
 nl as (select file_id, set_name, perm, case when n = m then 0 when round(abs(hi), 12) >= round(abs(lo), 12) then hi else lo end as ne from mc),
 st as (select es.file_id, es.set_name, n_hits, es, count(*) filter (same) as ns, count(*) filter (same and round(abs(ne), 12) >= round(abs(es), 12)) as nx, avg(abs(ne)) filter (same) as mn
   from (select nl.*, es.es, es.n_hits, case when es.es >= 0 then ne >= 0 else ne < 0 end as same from nl join es using (file_id, set_name)) es group by all),
 pv as (select *, greatest(coalesce(nx / nullif(ns, 0), 0), 1 / {PERMS + 1}.0::double) as p_value, es / case when coalesce(mn, 0) > 0 then mn else 1 end as nes from st),
 rk as (select *, count(*) over (partition by file_id) as k, row_number() over (partition by file_id order by p_value, set_name) as r from pv)
select file_id, set_name, n_hits, round(es, 6) as es, round(nes, 6) as nes, round(p_value, 6) as p_value, round(least(1.0, min(p_value * k / r) over (partition by file_id order by r desc)), 6) as fdr from rk"""


@query(SQL_100)
def gsea_preranked_100(s, d):
    """The null at a fixed count, which SQL can follow."""
    return _r(gsea.preranked(f.ranked(s, d), sets_of(s, d), ["file_id"], "set_name", PERMS, raised=False), "es", "nes", "p_value", "fdr")


@query()
def gsea_preranked(s, d):
    return _r(gsea.preranked(f.ranked(s, d), sets_of(s, d), ["file_id"], "set_name"), "es", "nes", "p_value", "fdr")


@query(_SETS + """, t as (select file_id, count(*) as n, sum(score) as t1, sum(score * score) as t2, sum(abs(score)) as ta from ranked group by 1),
 i as (select file_id, set_name, count(*) as n1, avg(score) as m1, coalesce(var_samp(score), 0) as v1, sum(score) as s1, sum(score * score) as s2, sum(abs(score)) as sa from ranked join sets using (gene) group by 1, 2),
 x as (select *, n - n1 as n2, (t1 - s1) / nullif(n - n1, 0) as m2 from i join t using (file_id)),
 y as (select *, greatest((t2 - s2 - n2 * m2 * m2) / greatest(n2 - 1, 1), 0) as v2 from x),
 z as (select *, case when n1 >= 2 and n2 >= 2 and sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) >= 1e-12 then (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) else 0 end as dd,
   case when n1 >= 2 and n2 >= 2 then coalesce((sa / n1) / nullif((ta - sa) / n2, 0), 0) else 0 end as fo from y),
 g as (select *, dd * (1 - 3 / (4.0::double * n - 9)) as hg from z)
select file_id, set_name, n1 as n_hits, round(dd, 6) as cohens_d, round(hg, 6) as hedges_g, round(fo, 6) as fold_enrichment, round(greatest(fo - 1.96 * abs(fo) / sqrt(n1), 0), 6) as fold_lo,
 round(fo + 1.96 * abs(fo) / sqrt(n1), 6) as fold_hi, round(hg / case when max(abs(hg)) over (partition by file_id) = 0 then 1 else max(abs(hg)) over (partition by file_id) end, 6) as normalised_effect from g""")
def gsea_effect_sizes(s, d):
    out = gsea.effect_sizes(f.ranked(s, d), sets_of(s, d), ["file_id"], "set_name")
    return _r(out, "cohens_d", "hedges_g", "fold_enrichment", "fold_lo", "fold_hi", "normalised_effect")


@query(_HITS + """, c as (select *, row_number() over (partition by file_id, set_name order by rank_no) - 1 as k from wk)
 select file_id, set_name, rank_no, gene, round(af, 6) as running from c where k % greatest(ceil(n_hits / 400), 1) = 0""")
def gsea_curve(s, d):
    ranked = f.ranked(s, d)
    return _r(gsea.curve(ranked, gsea.hits(ranked, sets_of(s, d), "set_name", 3), ["file_id", "set_name"]), "running")


_WEIGHTED = f.with_(f.RANKED) + """, ws as (select set_name, gene, max(coalesce(case when isnan(weight) then null else weight end, 1)) as weight from
   (select set_name, """ + f.GENE + """ as gene, weight from gene_set) where set_name is not null and gene is not null group by 1, 2),
 h0 as (select file_id, set_name, gene, rank_no, n_genes, abs(score) * weight as w, count(*) over (partition by file_id, set_name) as n_hits from ranked join ws using (gene)),
 h as (select *, row_number() over (partition by file_id, set_name order by rank_no) as i, sum(w) over (partition by file_id, set_name order by rank_no) as cum,
   case when sum(w) over (partition by file_id, set_name) = 0 then 1 else sum(w) over (partition by file_id, set_name) end as tot from h0 where n_hits >= 3),
 wk as (select *, cum / tot - (rank_no - i) / (n_genes - n_hits) as af, case when rank_no > 1 then (cum - w) / tot - (rank_no - i) / (n_genes - n_hits) end as bf from h),
 e as (select file_id, set_name, max(n_hits) as n_hits, max(af) as hi, least(coalesce(min(bf), 0), 0, max(cum / tot) - 1) as lo from wk group by 1, 2)
select file_id, set_name, n_hits, round(case when round(abs(hi), 12) >= round(abs(lo), 12) then hi else lo end, 6) as es from e"""


def weighted_sets_of(s, d):
    w = f.load(s, d, "gene_set").select("set_name", f.clean_gene("gene").alias("gene"), F.coalesce(F.nanvl("weight", F.lit(1.0)), F.lit(1.0)).alias("weight"))
    return w.where("set_name is not null and gene is not null").groupBy("set_name", "gene").agg(F.max("weight").alias("weight"))


@query(_WEIGHTED)
def gsea_weighted_es(s, d):
    out = gsea.enrichment_scores(gsea.hits(f.ranked(s, d), weighted_sets_of(s, d), "set_name", 3, "weight"), ["file_id", "set_name"])
    return _r(out, "es").select("file_id", "set_name", "n_hits", "es")


@query()
def gsea_weighted(s, d):
    out = gsea.preranked(f.ranked(s, d), weighted_sets_of(s, d), ["file_id"], "set_name", weight="weight")
    return _r(out, "es", "nes", "p_value", "fdr")


_BH = f.with_(f.CONTEXT) + """, x as (select *, count(p_value) over (partition by program) as n, row_number() over (partition by program, p_value is null order by p_value) as r from context)
select run_id, program, gene, p_value, round(case when p_value is not null then least(1.0, min(p_value * n / r) over (partition by program, p_value is null order by r desc)) end + 1e-9, 6) as q from x"""


@query(_BH)
def bh_grouped(s, d):
    out = stats.bh(f.context(s, d).select("run_id", "program", "gene", "p_value"), "p_value", "q", ["program"])
    return _r(out, "q", nudge=1e-9)


@query(f.with_(f.CONTEXT) + """, x as (select *, count(*) over () as n, row_number() over (order by p_value) as r from context where p_value is not null)
select run_id, program, gene, p_value, round(least(1.0, min(p_value * n / r) over (order by r desc)) + 1e-9, 6) as q from x union all select run_id, program, gene, p_value, null from context where p_value is null""")
def bh_whole(s, d):
    out = stats.bh_distributed(f.context(s, d).select("run_id", "program", "gene", "p_value"), "p_value", "q")
    return _r(out, "q", nudge=1e-9)


_STOREY = " + ".join(f"{w!r} * count(*) filter (p_value > {float(x)!r}) / (count(*) * {float(1 - x)!r})" for w, x in zip(stats.STOREY_WEIGHTS.tolist(), stats.np.arange(0.05, 0.95, 0.05)))


@query(f.with_(f.CONTEXT) + f""", ok as (select * from context where p_value is not null), pi as (select least(greatest({_STOREY}, 0.01), 1) as pi0 from ok),
 x as (select *, count(*) over () as n, row_number() over (order by p_value) as r from ok)
select run_id, program, gene, p_value, round(least(1.0, min(p_value * n / r) over (order by r desc)) * pi0 + 1e-9, 6) as q from x, pi union all select run_id, program, gene, p_value, null from context where p_value is null""")
def storey_qvalues(s, d):
    out = stats.storey(f.context(s, d).select("run_id", "program", "gene", "p_value"), "p_value", "q")
    return _r(out, "q", nudge=1e-9)


_PAIRED = """with x as (select baseline_label, (perturbation_gene_n - baseline_gene_n)::double as dl from robustness_program_matches where baseline_label is not null and perturbation_gene_n - baseline_gene_n is not null),
 nz as (select *, rank() over (partition by baseline_label order by abs(dl)) + (count(*) over (partition by baseline_label, abs(dl)) - 1) / 2 as rk from x where dl <> 0),
 r as (select baseline_label, sum(case when dl > 0 then rk else 0 end) as wp, sum(case when dl < 0 then rk else 0 end) as wm from nz group by 1),
 b as (select baseline_label, count(*) as n_pairs, count(*) filter (dl > 0) as wins, count(*) filter (dl < 0) as losses, avg(dl) as mean_delta, stddev_samp(dl) as sd from x group by 1),
 z as (select b.*, wins + losses as n, coalesce(wp, 0) as wp, coalesce(wm, 0) as wm from b left join r using (baseline_label)),
 pr as (select *, list_transform(range(0, n + 1), lambda k: exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * ln(2))) as ps from z)
select baseline_label, n_pairs, wins, losses, round(mean_delta, 6) as mean_delta, round(coalesce((wins - losses) / nullif(n, 0), 0), 6) as rank_biserial,
 round(coalesce((wp - wm) / nullif(wp + wm, 0), 0), 6) as signed_rank_biserial, round(coalesce(mean_delta / nullif(sd, 0), 0), 6) as dz,
 round(least(1.0, list_sum(ps[wins + 1:])), 6) as sign_p_greater, round(least(1.0, list_sum(list_filter(ps, lambda p: p <= ps[wins + 1] * (1 + 1e-7)))), 6) as sign_p from pr"""


@query(_PAIRED)
def paired_tests(s, d):
    df = f.load(s, d, "robustness_program_matches").where("baseline_label is not null").withColumn("delta", F.col("perturbation_gene_n") - F.col("baseline_gene_n"))
    out = stats.paired_statistics(df.select("baseline_label", "delta"), ["baseline_label"], "delta").drop("signed_rank_p")
    return _r(out, "mean_delta", "rank_biserial", "signed_rank_biserial", "dz", "sign_p_greater", "sign_p")


@query(f.with_(f.CONTEXT) + """select program, count(contextual_score_a) as n_a, count(contextual_score_b) as n_b,
 round(case when count(contextual_score_a) >= 2 and count(contextual_score_b) >= 2 and
   sqrt(((count(contextual_score_a) - 1) * var_samp(contextual_score_a) + (count(contextual_score_b) - 1) * var_samp(contextual_score_b)) / (count(contextual_score_a) + count(contextual_score_b) - 2)) >= 1e-12
   then (avg(contextual_score_a) - avg(contextual_score_b)) / sqrt(((count(contextual_score_a) - 1) * var_samp(contextual_score_a) + (count(contextual_score_b) - 1) * var_samp(contextual_score_b)) / (count(contextual_score_a) + count(contextual_score_b) - 2)) else 0 end, 6) as cohens_d
 from context group by 1""")
def context_effect(s, d):
    a, b = "contextual_score_a", "contextual_score_b"
    m = f.context(s, d).groupBy("program").agg(
        F.count(a).alias("n_a"), F.avg(a).alias("ma"), F.var_samp(a).alias("va"), F.count(b).alias("n_b"), F.avg(b).alias("mb"), F.var_samp(b).alias("vb")
    )
    d_ = stats.cohens_d(*(F.col(c) for c in ("n_a", "ma", "va", "n_b", "mb", "vb")))
    return m.select("program", "n_a", "n_b", F.round(d_, 6).alias("cohens_d"))


@query("""with x as (select perturbation_label, count(*) filter (claim_supported_retained) as k, count(*) as n from robustness_program_matches
   where claim_supported_retained is not null and perturbation_label is not null group by 1), z as (select *, k / n as p, 1.959963984540054 * 1.959963984540054 as z2 from x)
select perturbation_label, n as n_matches, k as n_retained, round(greatest((p + z2 / (2 * n) - sqrt(z2) * sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n), 0), 6) as wilson_lo,
 round(least((p + z2 / (2 * n) + sqrt(z2) * sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n), 1), 6) as wilson_hi from z""")
def claim_retention_interval(s, d):
    df = f.load(s, d, "robustness_program_matches").where("claim_supported_retained is not null and perturbation_label is not null")
    df = df.groupBy("perturbation_label").agg(F.count("*").alias("n_matches"), F.count(F.when(F.col("claim_supported_retained"), 1)).alias("n_retained"))
    lo, hi = stats.wilson(F.col("n_retained"), F.col("n_matches"))
    return df.withColumns({"wilson_lo": F.round(lo, 6), "wilson_hi": F.round(hi, 6)})


_EDGES = f.with_(f.EXPRESSION, f.BRANDS) + """, ng as (select count(*) as n_genes from part), sz as (select set_name, count(*) as set_size from brands group by 1),
 rk as (select *, row_number() over (partition by sample order by value desc, gene) as rank_no from expr where value > 0),
 h as (select sample, set_name, rank_no, value, set_size, n_genes from rk join brands using (gene) join sz using (set_name), ng),
"""


@query(_EDGES + """ c as (select *, row_number() over w as i, sum(pow(value, 0.25)) over w as cum, sum(pow(value, 0.25)) over (partition by sample, set_name) as tot, pow(value, 0.25) as wt from h
   window w as (partition by sample, set_name order by rank_no)),
 wk as (select *, cum / tot - (rank_no - i) / (n_genes - set_size) as af, case when rank_no > 1 then (cum - wt) / tot - (rank_no - i) / (n_genes - set_size) end as bf from c)
select sample, set_name, round(greatest(max(af), 0) + least(coalesce(min(bf), max(af)), max(af), 0) + 1e-9, 6) as score from wk group by 1, 2""")
def ssgsea_scores(s, d):
    hit = gsea.sample_hits(f.expression(s, d).where("value > 0"), "sample", f.brands(s, d), "set_name", f.load(s, d, "part").count())
    return _r(gsea.ssgsea(hit, "sample", "set_name"), "score", nudge=1e-9)


_AUC = _EDGES + """ r as (select *, greatest(ceil(0.05 * n_genes), 1) as top from h),
 a as (select sample, set_name, sum(case when rank_no <= top then top - rank_no + 1 else 0 end) / max(least(set_size, top) * top - least(set_size, top) * (least(set_size, top) - 1) / 2) as score from r group by 1, 2)
"""


@query(_AUC + "select sample, set_name, round(score, 6) as score from a")
def aucell_scores(s, d):
    hit = gsea.sample_hits(f.expression(s, d).where("value > 0"), "sample", f.brands(s, d), "set_name", f.load(s, d, "part").count())
    return _r(gsea.aucell(hit, "sample", "set_name"), "score")


@query(_AUC + f""", sm as (select s_suppkey as sample, s_nationkey as batch from supplier), x as (select a.*, batch from a join sm using (sample))
select sample, set_name, round(score - avg(score) over (partition by batch, set_name) + avg(score) over (partition by set_name), 6) as corrected from x""")
def aucell_batch_centred(s, d):
    hit = gsea.sample_hits(f.expression(s, d).where("value > 0"), "sample", f.brands(s, d), "set_name", f.load(s, d, "part").count())
    scores = gsea.aucell(hit, "sample", "set_name").join(f.samples(s, d), "sample")
    return _r(gsea.batch_centred(scores, "batch", "set_name"), "corrected").select("sample", "set_name", "corrected")


@query(_HITS + """, l as (select wk.*, hi, least(coalesce(min(bf) over (partition by wk.file_id, wk.set_name), 0), 0) as lw from wk join e0 using (file_id, set_name)),
 m as (select *, round(abs(hi), 12) >= round(abs(lw), 12) as up, min(case when round(af, 12) = round(hi, 12) then rank_no end) over (partition by file_id, set_name) as pk,
   min(case when round(bf, 12) = round(lw, 12) then rank_no end) over (partition by file_id, set_name) as tr from l),
 le as (select file_id, set_name, gene from m where case when up then rank_no <= pk else rank_no >= tr end), n as (select file_id, set_name, count(*) as n from le group by 1, 2),
 k as (select a.file_id, a.set_name as sa, b.set_name as sb, count(*) as k from le a join le b on a.file_id = b.file_id and a.gene = b.gene and a.set_name < b.set_name group by 1, 2, 3)
select k.file_id, sa as set_a, sb as set_b, k as shared, round(k / (x.n + y.n - k), 6) as jaccard from k join n x on x.file_id = k.file_id and x.set_name = sa join n y on y.file_id = k.file_id and y.set_name = sb""")
def leading_edge_overlap(s, d):
    edge = gsea.leading_edge(gsea.hits(f.ranked(s, d), sets_of(s, d), "set_name", 3), ["file_id", "set_name"])
    genes = edge.select("file_id", "set_name", F.explode(F.split("leading_genes", ",")).alias("gene"))
    from genoloom.operators.sets import overlap

    other = genes.withColumnRenamed("set_name", "set_b")
    out = overlap(genes.withColumnRenamed("set_name", "set_a"), other, ["set_a"], ["set_b"], ["file_id"]).where("set_a < set_b")
    return out.select("file_id", "set_a", "set_b", F.col("overlap_n").alias("shared"), F.round("jaccard", 6).alias("jaccard"))


