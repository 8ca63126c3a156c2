"""Coherence, permutation nulls, silhouettes, sweeps, refits."""

from pyspark.sql import functions as F

from genoloom.operators import discover, embed, evaluate
from genoloom.plans import frames as f
from genoloom.plans import pipeline
from genoloom.plans.q_annotate import _ANNOTATE, annotated_hits
from genoloom.plans.q_discover import _ATT, _METHODS, K, attention, method_memberships
from genoloom.plans.registry import query


@query(f.with_(_ATT, f.BRANDS) + """, n as (select set_name, count(*) as n from brands group by 1), k as (select a.set_name, count(*) as k from ed join brands a on a.gene = src join brands b on b.gene = dst and a.set_name = b.set_name group by 1)
select set_name, n, round(coalesce(k / nullif(n * (n - 1) / 2, 0), 0), 6) as density from n left join k using (set_name)""")
def network_density(s, d):
    out = evaluate.edge_density(f.brands(s, d), discover.head_average(attention(s, d)), "set_name")
    return out.withColumn("density", F.round("density", 6))


_TERMS = f.with_(f.PROGRAMS, f.REFERENCES) + """, pg as (select distinct program, gene from programs), tm as (select distinct gene, set_name as term from refs), t as (select program, gene, term from pg join tm using (gene)),
 z as (select program, gene, count(*) as n from t group by 1, 2), pr as (select program, (count(*) * (count(*) - 1) / 2)::bigint as n_pairs from z group by 1),
 k as (select a.program, a.gene, b.gene as other, count(*) as k from t a join t b on a.program = b.program and a.term = b.term and a.gene < b.gene group by 1, 2, 3),
 g as (select k.program, sum(k / (x.n + y.n - k)) as s, count(*) as c from k join z x on x.program = k.program and x.gene = k.gene join z y on y.program = k.program and y.gene = k.other group by 1)
select program, n_pairs, round(coalesce(s / nullif(n_pairs, 0), 0), 6) as coherence, round(coalesce(c / nullif(n_pairs, 0), 0), 6) as shared from pr left join g using (program)"""


@query(_TERMS)
def term_coherence(s, d):
    """Reference sets as the terms of their genes."""
    terms = f.references(s, d).select("gene", F.col("set_name").alias("term"))
    out = evaluate.term_coherence(f.programs(s, d).select("program", "gene").distinct(), terms, "program")
    return out.withColumns({c: F.round(c, 6) for c in ("coherence", "shared")})


PERMS = 1_000


@query(f"""with pg as (select p_brand as program, p_partkey as gene from part), cu as (select 's' || p_size as set_name, p_partkey as gene from part), z as (select program, count(*) as n from pg group by 1),
 bl as (select program, sum(n) over (order by program) - n as lo, sum(n) over (order by program) - 1 as hi from z), dr as (select perm, p_partkey as gene, row_number() over (partition by perm order by md5('42|' || perm || '|' || p_partkey), p_partkey) - 1 as place from part, range(1, {PERMS + 1}) t(perm)),
 al as (select perm, program, gene from dr join bl on place between lo and hi union all select 0, program, gene from pg), m as (select set_name, count(*) as m from cu group by 1),
 k as (select perm, program, set_name, count(*) as k from al join cu using (gene) group by 1, 2, 3), b as (select perm, program, max(k / (n + m - k)) as j from k join z using (program) join m using (set_name) group by 1, 2),
 v as (select perm, avg(j) as v from b group by 1), o as (select v as observed from v where perm = 0)
select round(observed, 6) as observed, round(avg(v), 6) as null_mean, round(stddev_pop(v), 6) as null_sd, round(greatest(count(*) filter (round(v, 12) >= round(observed, 12)) / {PERMS}, 1 / {PERMS + 1}.0::double), 6) as p_value,
 round((observed - avg(v)) / stddev_pop(v), 4) as z from v, o where perm > 0 group by observed""")
def permutation_test(s, d):
    """Brands against sets of parts of one size."""
    part = f.load(s, d, "part")
    curated = part.select(F.concat(F.lit("s"), F.col("p_size").cast("string")).alias("set_name"), F.col("p_partkey").alias("gene"))
    out = evaluate.permuted_match(f.brands(s, d).withColumnRenamed("set_name", "program"), curated, curated, PERMS)
    return out.withColumns({**{c: F.round(c, 6) for c in ("observed", "null_mean", "null_sd", "p_value")}, "z": F.round("z", 4)})


_SIL = f.with_(f.EMBEDDINGS) + """, dd as (select a.gene, a.label, b.label as other, sum(list_distance(a.v, b.v)) as s, count(*) as n from emb a join emb b on true group by 1, 2, 3),
 z as (select gene, label, max(case when label = other then s end) as own, max(case when label = other then n end) as n, min(case when label <> other then s / n end) as b from dd group by 1, 2),
 si as (select gene, label, coalesce(case when n > 1 and b is not null then (b - own / (n - 1)) / greatest(b, own / (n - 1)) end, 0) as silhouette from z)
"""


@query(_SIL + "select gene, label, round(silhouette, 6) as silhouette from si")
def gene_silhouettes(s, d):
    return evaluate.silhouettes(f.embeddings(s, d)).withColumn("silhouette", F.round("silhouette", 6))


@query(_SIL + """, un as (select gene, label, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) as u from emb),
 c as (select a.gene, a.label, avg(list_inner_product(a.u, b.u)) as c from un a join un b on a.label = b.label and a.gene <> b.gene group by 1, 2),
 l as (select un.gene, un.label, case when c is null or max(c) over (partition by un.label) - min(c) over (partition by un.label) <= 1e-12 then 1 else (c - min(c) over (partition by un.label)) / (max(c) over (partition by un.label) - min(c) over (partition by un.label)) end as link
   from un left join c using (gene))
select l.gene, l.label, round(greatest(least(((silhouette + 1) / 2 + link) / 2, 1), 0), 6) as confidence from l join si on si.gene = l.gene""")
def gene_confidence(s, d):
    return evaluate.gene_confidence(f.embeddings(s, d)).withColumn("confidence", F.round("confidence", 6))


@query(_METHODS + """, pn as (select method, program, count(*) as n from mm group by 1, 2), sc as (select method, avg(case when n >= 2 then least(n / 40.0::double, 1) else 0 end) as coherence from pn group by 1),
 w as (select method, greatest(coherence, least(0.05, 1.0::double / count(*) over ())) as w from sc) select method, round(w / sum(w) over (), 6) as weight from w""")
def method_weights(s, d):
    """The mean size of a method's programs, cut at 40 genes, stands for its coherence."""
    m, _ = method_memberships(s, d)
    n = m.groupBy("method", "program").agg(F.count("*").alias("n"))
    score = F.when(F.col("n") >= 2, F.least(F.col("n") / 40.0, F.lit(1.0))).otherwise(0.0)
    return evaluate.method_weights(n.groupBy("method").agg(F.avg(score).alias("coherence"))).withColumn("weight", F.round("weight", 6))


@query(_METHODS + """, lb as (select gene, min(program) as label from programs group by 1), n as (select label, count(*) as n from lb group by 1), tg as (select lb.*, n from lb join n using (label)),
 e as (select src, dst, weight from co union all select dst, src, weight from co),
 ti as (select s.label as own, l.label, l.n, sum(weight) as w from tg s join e on e.src = s.gene join tg l on l.gene = e.dst where s.n < 3 and l.n >= 3 group by 1, 2, 3),
 be as (select own, label as to_ from ti qualify row_number() over (partition by own order by round(w / n, 9) desc, label) = 1), fb as (select label as fb from n where n.n >= 3 order by n.n desc, label limit 1)
select gene, label from tg where n >= 3 union all select gene, coalesce(to_, fb, label) from tg left join be on own = label, fb where n < 3""")
def merged_programs(s, d):
    m, w = method_memberships(s, d)
    labels = f.programs(s, d).groupBy("gene").agg(F.min("program").alias("label"))
    return evaluate.merged_small(labels, discover.cooccurrence(m, w))


@query(_ANNOTATE + """select set_name, program, round(p_value, 9) as p_value, round(fdr, 6) as fdr, round(k * n / (m * q), 6) as fold, count(*) over (partition by set_name) as n_programs from h qualify row_number() over (partition by set_name order by round(p_value, 14), program) = 1""")
def best_program_of_sets(s, d):
    out = evaluate.best_program_of_sets(annotated_hits(s, d)[2].withColumn("p_value", F.round("p_value", 14)))
    return out.withColumns({"p_value": F.round("p_value", 9), "fdr": F.round("fdr", 6), "fold": F.round("fold", 6)})


@query()
def resolution_sweep(s, d):
    v = f.embeddings(s, d).select("gene", "v")
    return evaluate.resolution_sweep(v, embed.symmetric_edges(embed.neighbours(v, K)), [0.3, 1.0, 3.0])


@query()
def voted_k(s, d):
    return evaluate.voted_k(f.embeddings(s, d).select("gene", "v"), [5, 10, 15], 10)


@query()
def refit_stability(s, d):
    return evaluate.refit_stability(f.embeddings(s, d).select("gene", "v"), lambda v: discover.kmeans_programs(v, 10))


@query(_METHODS + f""", {f.REFERENCES}, rs as (select distinct set_name, gene from refs), rg as (select distinct gene from rs), m as (select distinct method, program, gene from mm), z as (select method, program, count(*) as n from m group by 1, 2),
 mk as (select a.method, a.program as p, b.program as q, count(*) as k from m a join m b on a.method = b.method and a.gene = b.gene and a.program < b.program group by 1, 2, 3),
 rd as (select mk.method, sum(k / (x.n + y.n - k)) as t from mk join z x on x.method = mk.method and x.program = p join z y on y.method = mk.method and y.program = q group by 1), c as (select method, count(*) as n_programs from z group by 1),
 cv as (select method, count(distinct m.gene) / (select count(*) from rg) as coverage from m semi join rg on rg.gene = m.gene group by 1), nv as (select method, 1 - count(rg.gene) / count(*) as novelty from m left join rg on rg.gene = m.gene group by 1),
 sp as (select method, avg(s) as specificity from (select method, program, avg(case when k = 1 then 1.0::double else 0 end) as s from (select *, count(*) over (partition by method, gene) as k from m) group by 1, 2) group by 1),
 sb as (select set_name, count(*) as b from rs group by 1), bk as (select method, program, set_name, count(*) as k from m join rs using (gene) group by 1, 2, 3), bj as (select method, program, max(k / (n + b - k)) as j from bk join z using (method, program) join sb using (set_name) group by 1, 2),
 al as (select z.method, avg(coalesce(j, 0)) as alignment from z left join bj using (method, program) group by 1)
select c.method, n_programs, round(case when n_programs < 2 then 0 else coalesce(t, 0) / (n_programs * (n_programs - 1) / 2) end, 8) as redundancy, round(novelty, 6) as novelty, round(specificity, 6) as specificity, round(coalesce(coverage, 0), 6) as coverage, round(alignment, 6) as alignment
 from c left join rd using (method) join nv using (method) join sp using (method) left join cv using (method) join al using (method)""")
def method_table(s, d):
    """Every method's programs held against the reference sets."""
    m, _ = method_memberships(s, d)
    out = pipeline.method_table(m, f.references(s, d))
    return out.withColumns({c: F.round(c, 8 if c == "redundancy" else 6) for c in ("redundancy", "novelty", "specificity", "coverage", "alignment")})
