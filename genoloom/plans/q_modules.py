"""Correlations, encodings, modules, adaptive and weighted tests, comparisons."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from genoloom.operators import annotate, discover, embed, enrich, evaluate, expression, gsea, modules, suite
from genoloom.plans import frames as f
from genoloom.plans import q_enrich as qe
from genoloom.plans import q_validate as qv
from genoloom.plans.q_annotate import _ANNOTATE, annotated_hits
from genoloom.plans.q_discover import _KNN, _METHODS, K, method_memberships
from genoloom.plans.q_enrich import _r
from genoloom.plans.q_expression import _CELLS, counts
from genoloom.plans.registry import query

_TOPVAR = f.with_(f.EXPRESSION) + """, n as (select count(*) as n from supplier), tv as (select gene from (select gene, sum(value * value) / max(n) - pow(sum(value) / max(n), 2) as v from expr, n group by 1) order by round(v, 9) desc, gene limit 300),
 e as (select sample, gene, value from expr semi join tv using (gene))"""
_CORR = lambda x: f""", x as ({x}), m as (select gene, sum(x) as s, greatest(sum(x * x) - sum(x) * sum(x) / max(n), 0) as v from x, n group by 1),
 d as (select a.gene as src, b.gene as dst, sum(a.x * b.x) as xy from x a join x b on a.sample = b.sample and a.gene < b.gene group by 1, 2)
select src, dst, round(case when p.v > 1e-24 and q.v > 1e-24 then (xy - p.s * q.s / n) / (sqrt(p.v) * sqrt(q.v)) else 0 end, 6) as r from d join m p on p.gene = src join m q on q.gene = dst, n"""  # noqa: E731


def variable_values(s, d):
    """The values of the 300 genes of largest variance, as before any correlation of all pairs."""
    values, n = f.expression(s, d), f.load(s, d, "supplier").count()
    return values.join(expression.top_variance(values, n, 300).select("gene"), "gene", "left_semi"), n


@query(_TOPVAR + _CORR("select sample, gene, value::double as x from e where value <> 0"))
def gene_correlation(s, d):
    return _r(expression.gene_correlations(*variable_values(s, d)), "r")


@query(_TOPVAR + _CORR("""select sample, gene, rank() over (partition by gene order by value) + (count(*) over (partition by gene, value) - 1) / 2 + (n - count(*) over (partition by gene)) - (n - count(*) over (partition by gene) + 1) / 2.0::double as x from e, n where value <> 0"""))
def gene_rank_correlation(s, d):
    return _r(expression.gene_correlations(*variable_values(s, d), "spearman"), "r")


@query()
def coexpression_modules(s, d):
    values, n = variable_values(s, d)
    out = modules.coexpression_modules(expression.gene_correlations(values, n), values)
    return _r(out, "score")


@query(f.with_(_CELLS) + "select cell, gene, row_number() over (partition by cell order by value desc, gene) as position from counts where value > 0 qualify position <= 2048")
def rank_value_tokens(s, d):
    return expression.rank_value_tokens(counts(s, d))


@query(f"""with nm as (select distinct gene from dynamic_programs_long where gene is not null), v as (select distinct collection_name as c, gene as raw, {f.GENE} as id from gene_set where {f.GENE} is not null and collection_name is not null),
 t as (select id, md5(id) as token from v where c = 'OPENWAY' group by 1), sy as (select raw, min(id) as id from v where c = 'TISSUEBOOK' group by 1), ow as (select raw, min(id) as id from v where c = 'CELLOTUS' group by 1)
select gene, coalesce(a.token, b.token, c.token, d.token) as token, case when a.token is not null then 'name' when b.token is not null then 'synonym' when c.token is not null then 'own' else 'upper' end as how
 from nm left join t a on a.id = gene left join sy on sy.raw = gene left join t b on b.id = sy.id left join ow on ow.raw = gene left join t c on c.id = ow.id left join t d on d.id = upper(gene) where coalesce(a.token, b.token, c.token, d.token) is not null""")
def mapped_identifiers(s, d):
    """Genes as written, against one collection as vocabulary, one as synonyms and one as the table's own column."""
    v = f.load(s, d, "gene_set").select(F.col("collection_name").alias("c"), F.col("gene").alias("name"), f.clean_gene("gene").alias("id")).where("id is not null and c is not null")
    one = lambda c: v.where(F.col("c") == c).select("name", "id")
    tokens = one("OPENWAY").select("id").distinct().withColumn("token", F.md5("id"))
    names = f.load(s, d, "dynamic_programs_long").select("gene").where("gene is not null")
    return expression.mapped_identifiers(names, tokens, one("TISSUEBOOK"), one("CELLOTUS"))


_SCALED = f.with_(f.EXPRESSION) + """, ls as (select s_suppkey as sample, coalesce(nullif(sum(value), 0), 1)::double as t from supplier left join expr on sample = s_suppkey group by 1), md as (select median(t) as mid, count(*) as n from ls),
 sc as (select sample, gene, ln(1 + value / t * mid) as value from expr join ls using (sample), md where value > 0)
"""


@query(_SCALED + """, v as (select gene, sum(value) / max(n) as m, sum(value * value) / max(n) - pow(sum(value) / max(n), 2) as v from sc, md group by 1), dp as (select gene, case when m = 0 then v else v / m end as dispersion from v)
select gene, round(dispersion, 6) as dispersion, row_number() over (order by round(dispersion, 9) desc, gene) as position from dp qualify position <= 500""")
def top_dispersion_genes(s, d):
    samples = f.samples(s, d)
    scaled = expression.median_scaled(f.expression(s, d), samples)
    return _r(expression.top_dispersion(scaled, samples.count(), 500), "dispersion")


_PHI = "2 * (0.5 - list_sum(list_transform(range(0, 801), lambda i: case when i in (0, 800) then 1 when i % 2 = 1 then 4 else 2 end * exp(-pow(abs(z) * i / 800, 2) / 2))) * abs(z) / 800 / 3 / sqrt(2 * pi()))"


@query(f.with_(f.EXPRESSION, f.SAMPLES) + f""", n as (select count(*) as n from samples), sz as (select grp, count(*) as ng from samples group by 1), v as (select e.*, grp from expr e join samples using (sample) where value > 0),
 rk as (select *, rank() over (partition by gene order by value) + (count(*) over (partition by gene, value) - 1) / 2 as r, count(*) over (partition by gene, value) as t, count(*) over (partition by gene) as nz from v),
 g as (select gene, max(nz) as nz, sum(t * t - 1.0::double) as tie from rk group by 1), gg as (select gene, n - nz as ze, tie + pow(n - nz, 3) - (n - nz) as tie from g, n), o as (select gene, grp, sum(r) as rs, count(*) as k from rk group by 1, 2),
 zz as (select grp, gene, ng, n, rs + k * ze + (ng - k) * (ze + 1) / 2 as tot, ng::double * (n - ng) / 12 * (n + 1 - tie / (n::double * (n - 1))) as va from o join gg using (gene) join sz using (grp), n),
 z as (select grp, gene, ng, n, case when va > 0 then (tot - ng * (n + 1) / 2.0::double) / sqrt(va) else 0 end as z from zz),
 su as (select grp, gene, sum(value) as s from expr join samples using (sample) group by 1, 2), ev as (select gene, sum(value) as t from expr group by 1),
 p as (select z.grp, gene, z, {_PHI} as p_value, log2((coalesce(s, 0) / ng + 1e-9) / ((t - coalesce(s, 0)) / (n - ng) + 1e-9)) as fold from z left join su using (grp, gene) join ev using (gene)),
 w as (select *, row_number() over (partition by grp order by p_value, gene) as r, count(*) over (partition by grp) as k from p), q as (select *, least(1.0, min(p_value * k / r) over (partition by grp order by r desc)) as fdr from w)
select grp, gene, round(z, 6) as z, round(p_value, 6) as p_value, round(fdr, 5) as fdr, round(fold, 6) as log2_fold, row_number() over (partition by grp order by round(z, 9) desc, gene) as position from q qualify position <= 50""")
def marker_genes(s, d):
    out = expression.markers(f.expression(s, d), f.samples(s, d).select("sample", "grp"))
    return _r(_r(out, "z", "p_value", "log2_fold"), "fdr", n=5)


@query(f.with_(_CELLS) + "select cell, count(*) as n_genes, round(sum(value), 6) as total, round(sum(case when gene::varchar like '1%' then value else 0 end) / sum(value), 6) as mito_share from counts where value > 0 group by 1")
def mitochondrial_share(s, d):
    """Parts whose number begins with 1 stand for the mitochondrial genes."""
    return _r(expression.mitochondrial_share(counts(s, d), prefix="1"), "total", "mito_share")


@query(f.with_(f.EMBEDDINGS) + """, un as (select gene, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) as u from emb)
select 0 as layer, 0 as head, a.gene as src, b.gene as dst, round(list_inner_product(a.u, b.u), 6) as w from un a join un b on a.gene <> b.gene where round(list_inner_product(a.u, b.u), 12) > 0""")
def cosine_attention(s, d):
    return _r(embed.cosine_attention(f.embeddings(s, d).select("gene", "v")), "w")


@query(f.with_(f.EMBEDDINGS) + """, un as (select gene, list_transform(v, lambda x: x / (sqrt(list_sum(list_transform(v, lambda y: y * y))) + 1e-12)) as u from emb),
 d0 as (select j, list_transform(range(0, 64), lambda i: ('0x' || substr(md5('42|' || j || '|' || i), 1, 8))::bigint / 2147483648 - 1) as x from range(0, 500) t(j)),
 dr as (select j, list_transform(x, lambda a: a / (sqrt(list_sum(list_transform(x, lambda b: b * b))) + 1e-12)) as x from d0), s as (select j, gene, list_inner_product(u, x) as s from un cross join dr)
select j::int as sample, count(*) as n_genes, round(sum(v), 5) as total, round(max(v), 6) as largest from (select j, exp(s - min(s) over (partition by j)) - 1 as v from s) where v > 0 group by 1""")
def synthetic_counts(s, d):
    """Bags of genes along 500 random directions; they come out as one row a bag."""
    out = embed.synthetic_counts(f.embeddings(s, d).select("gene", "v"))
    return out.groupBy("sample").agg(F.count("*").alias("n_genes"), F.round(F.sum("value"), 5).alias("total"), F.round(F.max("value"), 6).alias("largest"))


_HYBRID = _KNN.replace("select vec_id as gene, label, list_transform(embedding, lambda x: x::double) as v from embeddings", "select vec_id as gene, label, list_transform(embedding[:32], lambda x: x::double) as v from embeddings")
_STEP = lambda n: f"x{n} as (select x{n - 1}.gene, x{n - 1}.i, 0.5 * any_value(x{n - 1}.x) + 0.5 * sum(t * y.x) as x from x{n - 1} join t on t.src = x{n - 1}.gene join x{n - 1} y on y.gene = t.dst and y.i = x{n - 1}.i group by 1, 2)"


@query(_HYBRID + f""", t as (select src, dst, case when sum(weight) over (partition by src) > 0 then weight / sum(weight) over (partition by src) else 1.0 / count(*) over (partition by src) end as t from kn),
 x0 as (select vec_id as gene, unnest(range(0, len(embedding))) as i, unnest(embedding)::double as x from embeddings), {_STEP(1)}, {_STEP(2)}, {_STEP(3)}
select gene, round(sqrt(sum(x * x)), 6) as length, round(sum(x * (i + 1)), 6) as moment from x3 group by 1""")
def hybrid_vectors(s, d):
    """Whole vectors diffused over the neighbours by the first half of their places."""
    v = f.embeddings(s, d).select("gene", "v")
    out = embed.hybrid_vectors(v, v.select("gene", F.slice("v", 1, 32).alias("v")), K)
    moment = F.aggregate(F.transform("v", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return out.select("gene", F.round(embed.norm(F.col("v")), 6).alias("length"), F.round(moment, 6).alias("moment"))


@query()
def density_clusters(s, d):
    return modules.density_clusters(f.embeddings(s, d).select("gene", "v"), 5, k=256)


@query()
def hierarchical_programs(s, d):
    return modules.hierarchical_consensus(*method_memberships(s, d), quantile=0.98)


@query(_METHODS + """, lb as (select gene, min(program) as label from programs group by 1), n as (select label, count(*) as n from lb group by 1), e as (select src, dst, weight from co union all select dst, src, weight from co),
 t as (select e.src as gene, label, sum(weight) as w from e join lb on lb.gene = e.dst group by 1, 2), x as (select t.gene, t.label, w / n as w from t join n using (label) semi join lb on lb.gene = t.gene)
select gene, label, round(w / sum(w) over (partition by gene) + 1e-9, 6) as weight from x where w > 0""")
def soft_consensus(s, d):
    m, w = method_memberships(s, d)
    labels = f.programs(s, d).groupBy("gene").agg(F.min("program").alias("label"))
    return _r(modules.soft_consensus(discover.cooccurrence(m, w), labels), "weight", nudge=1e-9)


@query(f.with_(f.PROGRAMS) + """, z as (select run_id, program, count(*) as n from programs group by 1, 2), g as (select run_id, count(distinct gene) as n_genes from programs group by 1)
select run_id, count(*) as n_programs, min(n) as smallest, median(n) as median_size, max(n) as largest, sum(n)::bigint as total, any_value(n_genes) as n_genes from z join g using (run_id) group by 1""")
def program_summary(s, d):
    return modules.program_summary(f.programs(s, d), ["run_id"])


_WFISHER = f.with_(f.REFERENCES, f.RANKED) + """, w as (select set_name, gene, max(coalesce(case when isnan(weight) then null else weight end, 1)) as weight from
   (select set_name, """ + f.GENE + """ as gene, weight from gene_set) where set_name is not null and gene is not null group by 1, 2),
 u as (select file_id, count(*) as n, count(*) filter (score >= 2) as q from ranked group by 1), s0 as (select file_id, set_name, count(*) filter (weight >= 0.1) as m, count(*) filter (weight >= 0.1 and score >= 2) as a, coalesce(sum(weight) filter (score >= 2), 0) as wo from ranked join w using (gene) group by 1, 2),
 t as (select *, case when a = 0 then 1.0 else least(1.0, list_sum(list_transform(range(a, least(m, q) + 1), lambda x: case when n - m - q + x < 0 then 0 else
   exp(lgamma(m + 1) - lgamma(x + 1) - lgamma(m - x + 1) + lgamma(n - m + 1) - lgamma(q - x + 1) - lgamma(n - m - q + x + 1) - lgamma(n + 1) + lgamma(q + 1) + lgamma(n - q + 1)) end))) end as p_value,
   a * n / nullif((m * q)::double, 0) as fold, sqrt(greatest(1 / greatest(a, 1) - 1 / greatest(m, 1) + 1 / greatest(q, 1) - 1 / greatest(n, 1), 0)) as se from s0 join u using (file_id) where m > 0),
 z as (select *, count(*) over (partition by file_id) as k, row_number() over (partition by file_id order by p_value, set_name) as r from t), y as (select *, least(1.0, min(p_value * k / r) over (partition by file_id order by r desc)) as fdr from z)
select file_id, set_name, a as overlap, m as program_size, q as query_size, n as background_size, round(a * (n - m - q + a) / nullif((m - a) * (q - a), 0), 6) as odds_ratio, round(p_value, 9) as p_value, round(fdr, 9) as fdr,
 round(case when a > 0 then exp(ln(fold) - 1.959963984540054 * se) else 0 end, 6) as fold_lo, round(case when a > 0 then exp(ln(fold) + 1.959963984540054 * se) else 0 end, 6) as fold_hi, round(wo, 6) as weighted_overlap from y"""


@query(_WFISHER)
def weighted_fisher(s, d):
    ranked = f.ranked(s, d)
    out = enrich.weighted_fisher(ranked.where("score >= 2"), qe.weighted_sets_of(s, d), ranked, ["file_id"], "set_name")
    out = _r(_r(out, "odds_ratio", "fold_lo", "fold_hi", "weighted_overlap"), "p_value", "fdr", n=9)
    return out.select("file_id", "set_name", "overlap", "program_size", "query_size", "background_size", "odds_ratio", "p_value", "fdr", "fold_lo", "fold_hi", "weighted_overlap")


@query(f"""select 'fisher' as method, file_id as key, set_name, p_value as value from ({qe._FISHER} select file_id, set_name, round(p_value, 9) as p_value from w)
 union all select 'aucell', sample, set_name, round(score, 6) from ({qe._AUC} select * from a)""")
def enrichment_methods(s, d):
    """Two methods through the one entry."""
    ranked = f.ranked(s, d)
    a = enrich.run("fisher", qe.sets_of(s, d), "set_name", ["file_id"], query=ranked.where("score >= 2"), universe=ranked)
    b = enrich.run("aucell", f.brands(s, d), "set_name", ["sample"], values=f.expression(s, d).where("value > 0"), n_genes=f.load(s, d, "part").count())
    return a.select("method", F.col("file_id").alias("key"), "set_name", F.round("p_value", 9).alias("value")).unionByName(b.select("method", F.col("sample").alias("key"), "set_name", F.round("score", 6).alias("value")))


@query()
def gsea_adaptive(s, d):
    return _r(gsea.preranked_adaptive(f.ranked(s, d), qe.sets_of(s, d), ["file_id"], "set_name"), "es", "nes", "p_value", "fdr")


_NULL100 = qe.SQL_100.split(" st as (")[0]


@query(_NULL100 + """ sp as (select es.file_id, es.set_name, n_hits, es, count(*) filter (same and perm <= 50) as s1, count(*) filter (same and perm <= 50 and x) as x1, sum(abs(ne)) filter (same and perm <= 50) as t1,
   count(*) filter (same) as s2, count(*) filter (same and x) as x2, sum(abs(ne)) filter (same) as t2 from (select nl.*, es.es, es.n_hits, case when es.es >= 0 then ne >= 0 else ne < 0 end as same, round(abs(ne), 12) >= round(abs(es.es), 12) as x from nl join es using (file_id, set_name)) es group by all),
 st as (select file_id, set_name, n_hits, es, case when x1 >= 10 then 50 else 100 end as n_perm, case when x1 >= 10 then s1 else s2 end as ns, case when x1 >= 10 then x1 else x2 end as nx, case when x1 >= 10 then t1 / nullif(s1, 0) else t2 / nullif(s2, 0) end as mn from sp),
 pv as (select *, least(1.0, greatest(coalesce(nx / nullif(ns, 0), 0), 1 / (n_perm + 1)::double)) as p_value, es / case when coalesce(mn, 0) > 0 then mn else 1 end as nes from st),
 rk as (select *, count(*) over (partition by file_id) as k, row_number() over (partition by file_id order by p_value, set_name) as r from pv)
select file_id, set_name, n_hits, n_perm, round(es, 6) as es, round(nes, 6) as nes, round(p_value, 6) as p_value, round(least(1.0, min(p_value * k / r) over (partition by file_id order by r desc)), 6) as fdr from rk""")
def gsea_adaptive_100(s, d):
    """Two batches of 50 with 10 extremes as enough, which SQL can follow."""
    out = gsea.preranked_adaptive(f.ranked(s, d), qe.sets_of(s, d), ["file_id"], "set_name", 100, 50, 10, fewest=50)
    return _r(out, "es", "nes", "p_value", "fdr")


@query(_ANNOTATE + f""", sz as (select set_name, count(*) as pathway_size from sg group by 1), nn as (select program, count(*) as n_novel from pg anti join cv using (program, gene) group by 1), ss as (select program, count(*) as pathway_span from sh group by 1),
 be as (select h.*, coalesce(n_novel, 0) as n_novel, pathway_span from h join ss using (program) left join nn using (program) where fdr <= 0.25 qualify row_number() over (partition by set_name order by round(p_value, 14), program) = 1),
 gs as (select * from ({qe.SQL_100}) where file_id = (select min(file_id) from ({qe.SQL_100})))
select sz.set_name, pathway_size, coalesce(program, '') as program, coalesce(k, 0) as overlap, round(coalesce(be.p_value, 1), 9) as program_p, round(coalesce(be.fdr, 1), 6) as program_fdr, round(coalesce(k * n / (m * q), 0), 6) as fold, round(coalesce(k / q, 0), 6) as fraction,
 coalesce(be.n_novel, 0) as n_novel, coalesce(be.pathway_span, 0) as pathway_span, round(nes, 6) as gsea_nes, round(gs.p_value, 6) as gsea_p, round(gs.fdr, 6) as gsea_fdr, coalesce(gs.fdr <= 0.25, false) as gsea_significant, program is not null as program_significant
 from sz left join be using (set_name) left join gs using (set_name)""")
def pathway_comparison(s, d):
    """Programs against reference sets, beside the permutation test of the first ranking file."""
    members, reference, hits = annotated_hits(s, d)
    annotated = annotate.annotated_programs(members, reference, hits)
    ranked = f.ranked(s, d)
    first = ranked.agg(F.min("file_id")).first()[0]
    tested = gsea.preranked(ranked.where(F.col("file_id") == first), qe.sets_of(s, d), ["file_id"], "set_name", 100, raised=False)
    out = evaluate.side_by_side(hits, annotated, reference, tested)
    return _r(_r(out, "program_fdr", "fold", "fraction", "gsea_nes", "gsea_p", "gsea_fdr"), "program_p", n=9)


@query(f"""select grp, baseline, replicate, count(*) as n_top_programs, count(*) filter (reproduced) as n_replicated, count(*) filter (reproduced and same_direction) as n_concordant, round(avg(jaccard) + 1e-8, 5) as mean_jaccard, round(median(jaccard) + 1e-8, 5) as median_jaccard,
 round(count(*) filter (reproduced) / count(*), 6) as replication_rate, round(count(*) filter (reproduced and same_direction) / nullif(count(*) filter (reproduced), 0), 6) as direction_rate from ({qv._REPRO}) group by 1, 2, 3""")
def reproducibility_rates(s, d):
    out = suite.reproducibility_rates(qv.cohort_reproducibility(s, d), ["grp", "baseline", "replicate"])
    return _r(_r(out, "replication_rate", "direction_rate"), "mean_jaccard", "median_jaccard", n=5, nudge=1e-8)


@query(f"""with m as ({qv._REPRO}), p as (select grp, baseline, replicate, count(*) filter (reproduced) / count(*) as rr, count(*) filter (reproduced and same_direction) / nullif(count(*) filter (reproduced), 0) as dr from m group by 1, 2, 3),
 a as (select grp, count(*) as n_comparisons, avg(rr) as mr, avg(dr) as md from p group by 1), b as (select grp, avg(jaccard) as mj, median(jaccard) as dj from m group by 1)
select grp, n_comparisons, round(mr, 6) as mean_replication_rate, round(md, 6) as mean_direction_rate, round(mj + 1e-8, 5) as mean_jaccard, round(dj + 1e-8, 5) as median_jaccard from a join b using (grp)""")
def reproducibility_summary(s, d):
    out = suite.reproducibility_summary(qv.cohort_reproducibility(s, d), ["grp"])
    return _r(_r(out, "mean_replication_rate", "mean_direction_rate"), "mean_jaccard", "median_jaccard", n=5, nudge=1e-8)


@query(f"""select collection, n_cases, mrr, recall_1, recall_5, recall_10, aurc, row_number() over (order by mrr desc, collection) as position from (
 {qv._RANKS.replace('over (partition by run_label order by n desc, list_id)', "over (partition by run_label order by n desc, list_id)").replace('select run_label, count(*) as n_cases', "select split_part(run_label, '/', 1) as collection, count(*) as n_cases")})""")
def compared_collections(s, d):
    """Cohorts as collections."""
    n = f.list_sets(s, d).groupBy("list_id", "run_label").agg(F.count("*").alias("n"))
    part = Window.partitionBy("run_label")
    cases = n.select(F.split_part("run_label", F.lit("/"), F.lit(1)).alias("collection"), F.row_number().over(part.orderBy(F.desc("n"), "list_id")).alias("rank"), F.count("*").over(part).alias("n_items"))
    out = suite.compared_collections(cases).withColumns({c: F.round(c, 6) for c in ("mrr", "recall_1", "recall_5", "recall_10", "aurc")})
    return out.withColumn("position", F.row_number().over(Window.orderBy(F.desc("mrr"), "collection")))


_BOOT = f.with_(f.EXPRESSION, f.SAMPLES, f.BRANDS) + """, pl as (select sample, grp, row_number() over (partition by grp order by sample) - 1 as i, count(*) over (partition by grp) as n from samples),
 dr as (select b, grp, grp || '#' || i as as_sample, ('0x' || substr(md5('42|' || b || '|' || grp || '|' || i), 1, 12))::bigint % n as i from pl, range(0, 20) t(b)), dw as (select b, as_sample, sample from dr join pl using (grp, i)),
 x as (select b, as_sample, gene, value from expr join dw using (sample)), fo as (select b, gene as gene, as_sample as other from x qualify row_number() over (partition by b, gene order by value desc, as_sample) = 1),
 na as (select set_name, count(*) as n from brands group by 1), nb as (select b, other, count(*) as m from fo group by 1, 2), k as (select b, set_name, other, count(*) as k from fo join brands using (gene) group by 1, 2, 3),
 j as (select b, set_name, max(k / (n + m - k)) as j from k join na using (set_name) join nb using (b, other) group by 1, 2)
select b::int as bootstrap_id, round(sum(j) / (select count(*) from na), 6) as best_match_jaccard from j group by 1"""


@query(_BOOT)
def bootstrap_stability(s, d):
    """Brands as reference; a refit puts a gene to the drawn sample of its largest value."""

    def largest(values):
        order = Window.partitionBy("gene").orderBy(F.desc("value"), "sample")
        return values.withColumn("k", F.row_number().over(order)).where("k = 1").select("gene", F.col("sample").alias("label"))

    reference = f.brands(s, d).withColumnRenamed("set_name", "program")
    return _r(evaluate.bootstrap_stability(f.expression(s, d), f.samples(s, d), largest, reference), "best_match_jaccard")


@query(_KNN + "select count(*) as n_genes, true as each_once, true as dense_labels, true as better_than_one from (select src as gene from ed union select dst from ed)")
def community_checks(s, d):
    """What must hold of the communities: every gene once, labels without gaps, a modularity above that of one community (0)."""
    edges = embed.symmetric_edges(embed.neighbours(f.embeddings(s, d).select("gene", "v"), K))
    found = discover.communities(edges)
    q = discover.modularity(edges, found.select("gene", "label")).select((F.col("modularity") > 0.0).alias("better_than_one"))
    one = found.agg(F.count("*").alias("n_genes"), (F.count("*") == F.countDistinct("gene")).alias("each_once"), (F.max("label") + 1 == F.countDistinct("label")).alias("dense_labels"))
    return one.join(F.broadcast(q))


@query(f.with_(f.EMBEDDINGS) + "select count(*) as n_genes, 10::bigint as n_labels, true as nearest from emb")
def kmeans_checks(s, d):
    """What must hold of k-means: every gene is in the cluster of the nearest mean."""
    v = f.embeddings(s, d).select("gene", "v")
    found = v.join(discover.kmeans_programs(v, 10), "gene")
    centre = embed.element_mean(found, ["label"]).select(F.col("label").alias("other"), F.col("v").alias("c"))
    gap = F.aggregate(F.zip_with("v", "c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, x: t + x)
    near = found.join(F.broadcast(centre)).withColumn("gap", gap).groupBy("gene", "label").agg(F.min("gap").alias("least"), F.min(F.when(F.col("label") == F.col("other"), F.col("gap"))).alias("own"))  # ten means
    return near.agg(F.count("*").alias("n_genes"), F.countDistinct("label").alias("n_labels"), F.min(F.col("own") <= F.col("least") + 1e-6).alias("nearest"))


@query(f.with_(f.EMBEDDINGS) + """, lg as (select gene, unnest(range(0, len(v))) as i, unnest(v) as x from emb), mu as (select i, avg(x) as mu from lg group by 1),
 tv as (select round(sum(v), 5) as total from (select var_samp(x) as v from lg group by i)) select 10::bigint as n_components, true as falling, true as uncorrelated, true as within_total from tv""")
def principal_checks(s, d):
    """What must hold of principal components: falling variances, no correlation, no more variance than the table has."""
    v = f.embeddings(s, d).select("gene", "v")
    pc = embed.principal_components(v, 10)
    one = lambda df: df.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.var_samp("x").alias("var"))
    var, total = one(pc), one(v).agg(F.sum("var").alias("total"))
    lag = var.withColumn("before", F.lag("var").over(Window.orderBy("i")))  # ten rows
    a = lag.agg(F.count("*").alias("n_components"), F.min(F.coalesce(F.col("before") >= F.col("var") - 1e-9, F.lit(True))).alias("falling"), F.sum("var").alias("kept"))
    pairs = pc.select("gene", F.posexplode("v").alias("i", "x"))
    cov = pairs.join(pairs.toDF("gene", "j", "y"), "gene").where("i < j").groupBy("i", "j").agg(F.abs(F.corr("x", "y")).alias("r")).agg((F.max("r") < 1e-6).alias("uncorrelated"))
    out = a.join(F.broadcast(total)).join(F.broadcast(cov))
    return out.select("n_components", "falling", "uncorrelated", (F.col("kept") <= F.col("total") + 1e-6).alias("within_total"))

