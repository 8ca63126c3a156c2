"""Annotation, label functions, layers, gates, context scores."""

from pyspark.sql import functions as F

from genoloom.functions import labels
from genoloom.operators import annotate
from genoloom.plans import frames as f
from genoloom.plans.q_enrich import sets_of
from genoloom.plans.q_expression import _DE, de_rows
from genoloom.plans.q_sets import _OVERLAP, _overlap
from genoloom.plans.registry import query

_PRE = "|".join(labels.PREFIXES)
_AFTER = "case when set_name like '%::%' then regexp_replace(set_name, '^.*?::', '') else set_name end"
_LABEL = f"""upper(replace(regexp_replace({_AFTER}, '^(?:{_PRE}|CUSTOM)_+', '', 'i'), '_', ' '))"""
_N = lambda words: "list_sum([" + ", ".join(f"contains(lb, '{w}')::int" for w in words) + "])"
_SCORE = f"""(least(10.0, {_N(labels.ANCHOR_WORDS)} * 6.0) + least(12.0, {_N(labels.HIGH_WORDS)} * 3.0) + least(6.0, {_N(labels.MEDIUM_WORDS)} * 2.0)
 - case when {_N(labels.HIGH_WORDS)} = 0 then least(8.0, {_N(labels.LOW_WORDS)} * 2.0) else least(2.0, {_N(labels.LOW_WORDS)} * 0.5) end
 - case when regexp_matches(lb, '\\p{{L}}') then 0 else 4 end)::double"""
_STOP = ", ".join(f"'{w}'" for w in labels.STOP_WORDS)
_SOURCE = """case when set_name like '%::%' then split_part(set_name, '::', 1) when set_name like 'WP\\_%' escape '\\' then 'WP' when set_name like 'KEGG\\_%' escape '\\' then 'KEGG'
 when set_name like 'HALLMARK\\_%' escape '\\' then 'HALLMARK' when set_name like 'REACTOME\\_%' escape '\\' then 'REACTOME' else 'OTHER' end"""
_DISPLAY = "case source " + " ".join(f"when '{k}' then '{v}'" for k, v in labels.SOURCE_NAMES.items()) + " else replace(source, '_', ' ') end"
_FAMILY = f"""list_filter(string_split_regex(upper(regexp_replace({_AFTER}, '^(?:{_PRE})_+', '', 'i')), '[^A-Za-z0-9]+'), lambda x: x <> '')"""
_REFS = f"""rf as (select *, case when len(kept) > 0 then array_to_string(kept, ' ') else array_to_string(words, ' ') end as family_key, {_SOURCE} as source, {_SCORE} as priority
   from (select *, list_filter(words, lambda x: x not in ({_STOP})) as kept from (select set_name, {_LABEL} as lb, {_FAMILY} as words from (select distinct set_name from gene_set where set_name is not null))))"""


@query(f.with_(_REFS) + """select set_name, source, family_key, priority, case when priority >= 6 then 'Disease-prioritized' when priority >= 2 then 'Supportive' else 'Background' end as band, """ + _DISPLAY + """ as source_display,
 substr(case when sf = '' then 'Annotated' else sf end, 1, 60) as label from (select *, trim(regexp_replace(regexp_replace(regexp_replace(""" + _AFTER + """, '[ \\-./:_]+', '_', 'g'), '[^\\p{L}\\p{N}_]', '', 'g'), '_{2,}', '_', 'g'), '_') as sf from rf)""")
def reference_labels(s, d):
    name = F.col("set_name")
    df = f.load(s, d, "gene_set").select("set_name").where("set_name is not null").distinct()
    df = df.select("set_name", labels.source_of(name).alias("source"), labels.family_key(name).alias("family_key"), labels.relevance(name).alias("priority"), labels.program_label(name).alias("label"))
    return df.withColumn("band", labels.relevance_band(F.col("priority"))).withColumn("source_display", labels.source_display(F.col("source")))


_TOP = _OVERLAP + """, t as (select *, row_number() over (partition by program order by round(jaccard, 12) desc, overlap_n desc, reference_n, set_name) as position from o qualify position <= 15)"""


def top_rows(s, d):
    return annotate.top_references(_overlap(s, d))


@query(_TOP + " select program, set_name, position, overlap_n, round(jaccard, 6) as jaccard from t")
def top_references(s, d):
    return top_rows(s, d).select("program", "set_name", "position", "overlap_n", F.round("jaccard", 6).alias("jaccard"))


_LAYER = _TOP.replace("with programs", "with " + _REFS + ",\nprograms", 1) + ", tr as (select * from t join rf using (set_name))"


@query(_LAYER + """, g as (select source, count(distinct program) as programs_covered, count(distinct set_name) as references_covered, count(*) as n_rows, max(jaccard) as bj, avg(jaccard) as mj, max(priority) as bp, avg(priority) as mp from tr group by 1)
 select source, """ + _DISPLAY + """ as source_display, programs_covered, references_covered, n_rows, round(bj, 6) as best_jaccard, round(mj, 6) as mean_jaccard, round(bp, 6) as best_priority, round(mp, 6) as mean_priority,
 round(2 * bp + 14 * bj + 0.8 * least(programs_covered, 8) + 0.15 * least(references_covered, 12), 6) as interpretation_score from g""")
def source_layer(s, d):
    out = annotate.source_layer(top_rows(s, d))
    return out.withColumns({c: F.round(c, 6) for c in ("best_jaccard", "mean_jaccard", "best_priority", "mean_priority", "interpretation_score")})


@query(_LAYER + """, g as (select family_key, max(struct_pack(j := round(jaccard, 12), o := overlap_n, p := program, s := set_name)) as top, max(jaccard) as bj, avg(jaccard) as mj, count(distinct program) as programs_covered,
   count(distinct set_name) as references_merged, count(distinct source)::int as source_count, string_agg(distinct source, ', ' order by source) as sources from tr group by 1)
 select g.family_key, top.p as top_program, top.s as top_reference, priority, case when priority >= 6 then 'Disease-prioritized' when priority >= 2 then 'Supportive' else 'Background' end as band,
 round(2 * priority + 15 * bj + 0.8 * least(programs_covered, 6) + 0.6 * least(source_count, 4), 6) as interpretation_score, round(bj, 6) as best_jaccard, round(mj, 6) as mean_jaccard,
 programs_covered, references_merged, source_count, sources from g join rf on rf.set_name = top.s""")
def family_layer(s, d):
    out = annotate.family_layer(top_rows(s, d))
    return out.withColumns({c: F.round(c, 6) for c in ("interpretation_score", "best_jaccard", "mean_jaccard")})


_ANNOTATE = f.with_(f.PROGRAMS, f.REFERENCES) + """, pg as (select distinct program, gene from programs), sg as (select distinct set_name, gene from refs),
 u as (select count(*) as n from (select gene from pg union select gene from sg)), ns as (select count(distinct set_name) as ns from sg),
 a as (select program, count(*) as q from pg group by 1), b as (select set_name, count(*) as m from sg group by 1),
 k as (select program, set_name, count(*) as k from pg join sg using (gene) group by 1, 2),
 p as (select *, least(1.0, list_sum(list_transform(range(k, least(m, q) + 1), lambda x: case when n - m - q + x < 0 then 0 else exp(lgamma(m + 1) - lgamma(x + 1) - lgamma(m - x + 1) + lgamma(n - m + 1) - lgamma(q - x + 1)
   - lgamma(n - m - q + x + 1) - lgamma(n + 1) + lgamma(q + 1) + lgamma(n - q + 1)) end))) as p_value from k join a using (program) join b using (set_name), u),
 r as (select *, row_number() over (partition by program order by p_value, set_name) as r from p),
 h as (select r.*, least(1.0, min(p_value * ns / r) over (partition by program order by r desc)) as fdr from r, ns),
 sh as (select * from h where fdr <= 0.25), cv as (select distinct program, gene from sh join sg using (set_name)),
 nv as (select program, count(*) as n_novel from pg anti join cv using (program, gene) group by 1), sp as (select program, count(*) as pathway_span from sh group by 1),
 o as (select a.program, a.q as n_genes, coalesce(pathway_span, 0) as pathway_span, coalesce(n_novel, 0) as n_novel from a left join sp using (program) left join nv using (program))
"""


def annotated_hits(s, d):
    members, refs = f.programs(s, d).select("program", "gene").distinct(), sets_of(s, d)
    universe = members.select("gene").union(refs.select("gene")).distinct().count()
    return members, refs, annotate.annotation_hits(members, refs, universe)


@query(_ANNOTATE + "select program, set_name, k as overlap_n, round(p_value, 9) as p_value, round(fdr, 6) as fdr from h where fdr <= 0.25")
def annotation_hits(s, d):
    hits = annotated_hits(s, d)[2].where("fdr <= 0.25")
    return hits.select("program", "set_name", "overlap_n", F.round("p_value", 9).alias("p_value"), F.round("fdr", 6).alias("fdr"))


@query(_ANNOTATE + """select program, n_genes, pathway_span, n_novel, round(n_novel / n_genes, 6) as novelty,
 round(pathway_span * (1 - n_novel / n_genes) + case when n_novel / n_genes > 0.1 then 0.5 * n_novel / n_genes else 0 end, 6) as multi_pathway_score from o""")
def annotated_programs(s, d):
    return annotate.annotated_programs(*annotated_hits(s, d)).withColumns({c: F.round(c, 6) for c in ("novelty", "multi_pathway_score")})


_GATES = _DE + """, fe as (select set_name, gene, logfc, fdr from brands left join de using (gene)),
 cg as (select set_name, count(*) as program_size, min(fdr) as fdr, avg(abs(coalesce(logfc, 0))) as mean_abs_change from fe group by 1)
select set_name, program_size, round(mean_abs_change, 6) as mean_abs_change, coalesce(fdr <= 0.05, false) as gate_fdr, mean_abs_change >= 0.2 as gate_effect, program_size >= 10 as gate_program_size,
 coalesce(fdr <= 0.05, false) and mean_abs_change >= 0.2 and program_size >= 10 as claim_supported from cg"""


@query(_GATES.replace("with expr", "with " + f.BRANDS + ",\nexpr", 1))
def claim_gates(s, d):
    """Brands as programs; the smallest corrected p-value of a brand's parts stands for its enrichment."""
    brands, de = f.brands(s, d), de_rows(s, d)
    enrich = brands.join(de.select("gene", "fdr"), "gene", "left").groupBy("set_name").agg(F.coalesce(F.min("fdr"), F.lit(1.0)).alias("fdr"))
    out = annotate.claim_gates(enrich, brands, de.select("gene", F.col("logfc").alias("change")), ["set_name"])
    cols = ["set_name", "program_size", F.round("mean_abs_change", 6).alias("mean_abs_change"), "gate_fdr", "gate_effect", "gate_program_size", "claim_supported"]
    return out.select(*cols)


@query(_DE.replace("with expr", "with " + f.BRANDS + ",\nexpr", 1) + """, c as (select set_name, gene, coalesce(logfc, 0) as lf, coalesce(p_value, 1) as pv from brands left join de using (gene)),
 x as (select *, tanh(lf / 2) as sh, -log10(greatest(least(pv, 1), 1e-300)) as nl from c)
select set_name, gene, round(0.5 * (1 + sh), 6) as prob_a, round(1 - 0.5 * (1 + sh), 6) as prob_b, round(sh, 6) as context_shift, round(nl, 4) as neglog10_p_value, round(sign(lf) * nl, 4) as signed_significance, round(sh * nl, 4) as context_evidence from x""")
def context_membership(s, d):
    de = de_rows(s, d).select("gene", "logfc", "p_value")
    cols = annotate.context_scores(F.lit(1.0), F.col("logfc"), F.col("p_value"))
    df = f.brands(s, d).join(de, "gene", "left").withColumns(cols)
    digits = {"prob_a": 6, "prob_b": 6, "context_shift": 6, "neglog10_p_value": 4, "signed_significance": 4, "context_evidence": 4}
    return df.select("set_name", "gene", *[F.round(c, n).alias(c) for c, n in digits.items()])


@query(f.with_(f.LISTS) + """, l as (select distinct run_label, program, gene from lists), b as (select split_part(run_label, '/', 1) as cohort, program, gene from l where run_label like '%/baseline'),
 v as (select split_part(run_label, '/', 1) as cohort, program as other, gene from l where run_label not like '%/baseline'), bb as (select distinct * from b), vv as (select distinct * from v),
 pr as (select distinct cohort, program, other from bb join vv using (cohort, gene)),
 x as (select cohort, program, list(gene order by gene) as x from bb group by 1, 2), y as (select cohort, other, list(gene order by gene) as y from vv group by 1, 2)
select cohort, program, other, len(list_intersect(x, y))::int as overlap_n, round(len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))), 6) as jaccard,
 array_to_string(list_sort(list_intersect(x, y)), ',') as shared_genes, array_to_string(list_filter(x, lambda g: not list_contains(y, g)), ',') as left_only,
 array_to_string(list_filter(y, lambda g: not list_contains(x, g)), ',') as right_only from pr join x using (cohort, program) join y using (cohort, other)""")
def overlap_detail(s, d):
    """Baseline programs of a cohort against those of its perturbed runs, gene by gene."""
    df = f.list_sets(s, d).select("run_label", "program", "gene").distinct().withColumn("cohort", F.split_part("run_label", F.lit("/"), F.lit(1)))
    base = F.col("run_label").like("%/baseline")
    a = df.where(base).select("cohort", "program", "gene").distinct()
    b = df.where(~base).select("cohort", F.col("program").alias("other"), "gene").distinct()
    return annotate.overlap_detail(a, b, "program", "other", ["cohort"]).withColumn("jaccard", F.round("jaccard", 6))


