"""Benchmark suite tables, label forms, comparisons of models, column roles."""

from pyspark.sql import functions as F

from genoloom.functions import labels
from genoloom.operators import columns, expression, packed, suite
from genoloom.plans import frames as f
from genoloom.plans.q_discover import _METHODS, method_memberships
from genoloom.plans.q_expression import _CELLS, cells
from genoloom.plans.registry import query

_TITLE = lambda x: f"array_to_string(list_transform(regexp_extract_all(lower({x}), '(\\p{{L}}+|[^\\p{{L}}]+)'), lambda t: upper(t[1]) || t[2:]), '')"
_WRAP = lambda x: f"""case when length({x}) <= 28 then {x} when contains({x}, ' ') then replace(list_reduce(list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> ''),
  lambda a, w: a || case when length(regexp_extract(a, '[^\\x1f]*$')) + 1 + length(w) <= 28 then ' ' else chr(31) end || w), chr(31), '<br>')
  else array_to_string(regexp_extract_all({x}, '.{{1,28}}', 0, 's'), '<br>') end"""  # noqa: E731
_SHORT = lambda x, w, c: f"""(with q as (select case when len(string_split({x}, ' ')) > {w} then array_to_string(string_split({x}, ' ')[:{w}], ' ') || ' ...' else {x} end as p)
  select case when length(p) > {c} then rtrim(p[:{c - 4}]) || ' ...' else p end from q)"""  # noqa: E731
_SOURCES = "case src " + " ".join(f"when '{k}' then '{v}'" for k, v in {**labels.SOURCE_NAMES, "CUSTOM": "Custom"}.items()) + " else replace(src, '_', ' ') end"
_REFERENCE = f"""with n as (select distinct set_name as name from gene_set where set_name is not null union select distinct reference_name from program_reference_overlap_long where reference_name is not null),
 t as (select name, split_part(name, '::', 1) as src, case when contains(name, '::') then regexp_replace(name, '^.*?::', '') else name end as term from n),
 u as (select *, array_to_string(list_filter(string_split(replace(replace(term, '/', '_'), '-', '_'), '_'), lambda x: x <> ''), ' ') as ph from t)
"""


@query(_REFERENCE + f"""select name, case when contains(name, '::') then {_SOURCES} || ': ' else '' end || {_SHORT('ph', 6, 48)} as display, {_WRAP("replace(name, '_', ' ')")} as lines, {_WRAP('name')} as pieces,
 case when not contains(name, '::') then name else name || ' ' || term end as keys_text, {_TITLE('ph')} as family from u""")
def reference_display(s, d):
    name = F.col("name")
    df = f.load(s, d, "gene_set").select(F.col("set_name").alias("name")).union(f.load(s, d, "program_reference_overlap_long").select("reference_name")).where("name is not null").distinct()
    term = F.array_join(F.filter(F.split(F.regexp_replace(labels.after_source(name), "[/-]", "_"), "_"), lambda x: x != ""), " ")
    return df.select(
        "name", labels.reference_display(name).alias("display"), labels.wrapped(F.replace(name, F.lit("_"), F.lit(" "))).alias("lines"), labels.wrapped(name).alias("pieces"),
        F.array_join(labels.reference_keys(name), " ").alias("keys_text"), labels.family_display(term).alias("family"),
    )


_PARTS = f"""with n as (select distinct program_raw as program from program_reference_overlap_long where program_raw is not null union select distinct {f.NAME('program')} from dynamic_programs_long where {f.NAME('program')} is not null),
 t as (select program, case when contains(program, '__') then split_part(program, '__', 1) else program end as head, regexp_replace(regexp_replace(case when contains(program, '__') then regexp_replace(program, '^.*?__', '') else program end, '::|-|/', '_', 'g'), '_{{2,}}', '_', 'g') as term from n),
 u as (select *, regexp_extract(term, '^({'|'.join(labels.PROGRAM_SOURCES)})', 1) as found from t),
 v as (select *, case when found = '' then term else trim(regexp_replace(term, '^(?:{'|'.join(labels.PROGRAM_SOURCES)})_?', ''), '_') end as rest from u),
 w as (select program, replace(head, 'program_', 'P') as head, case found {' '.join(f"when '{k}' then '{x}'" for k, x in labels.PROGRAM_SOURCES.items())} else '' end as source,
   coalesce(nullif(array_to_string(list_filter(string_split(rest, '_'), lambda x: x <> ''), ' '), ''), nullif(rest, ''), program) as phrase from v)
"""


@query(_PARTS + f"""select program, head, source, phrase, head || ' - ' || case when source <> '' then source || ': ' else '' end || phrase as whole,
 head || ' - ' || case when source <> '' then source || ': ' else '' end || {_SHORT('phrase', 5, 52)} as short, head || case when source <> '' then ' (' || source || ')' else '' end || ' ' || {_SHORT('phrase', 4, 36)} as axis from w""")
def program_display(s, d):
    p = F.col("program")
    df = f.load(s, d, "program_reference_overlap_long").select(F.col("program_raw").alias("program")).union(f.load(s, d, "dynamic_programs_long").select(f.clean_name("program"))).where("program is not null").distinct()
    head, source, phrase = labels.program_parts(p)
    return df.select(
        "program", head.alias("head"), source.alias("source"), phrase.alias("phrase"), labels.program_display(p).alias("whole"), labels.program_display(p, 5, 52).alias("short"),
        labels.program_display(p, 4, 36, True).alias("axis"),
    )


@query(f.with_(f.PROGRAMS) + """, g as (select run_id, program, string_agg(gene, ',' order by gene) as genes from programs group by 1, 2)
select run_id, md5(string_agg(program || '=' || genes, ';' order by program || '=' || genes)) as fingerprint from g group by 1""")
def programs_fingerprint(s, d):
    return suite.programs_fingerprint(f.programs(s, d), ["run_id"])


@query("""with h as (select collection_name, gene, row_number() over (partition by collection_name order by set_id, pos, gene) as k from gene_set where collection_name is not null and regexp_matches(gene, '\\p{L}')),
 x as (select collection_name, count(*) as n, avg((gene = upper(gene))::int) as upper_share, avg((length(gene) >= 2 and regexp_matches(gene, '^\\p{Lu}') and regexp_matches(gene[2:4], '\\p{Ll}'))::int) as title_share from h where k <= 500 group by 1)
select collection_name, n, round(upper_share, 6) as upper_share, round(title_share, 6) as title_share, case when title_share > upper_share then 'mouse' else 'human' end as species from x""")
def species_of_collections(s, d):
    out = suite.species_of(f.load(s, d, "gene_set").where("collection_name is not null"), ["collection_name"], ["set_id", "pos", "gene"])
    return out.withColumns({c: F.round(c, 6) for c in ("upper_share", "title_share")})


# runs stand for benchmark rows: the contrast for the dataset, random_state for the seed
_SUITE = f"""r0 as (select group_b as dataset, random_state as seed, lower({f.NAME('method_name')}) as method, n_programs::double as n_programs, n_samples::double as n_samples, run_id from discovery_runs
   where group_b is not null and random_state is not null and {f.NAME('method_name')} is not null),
 rc as (select dataset, seed, method, avg(n_programs) as rn, avg(n_samples) as rj from r0 group by 1, 2, 3), dc as (select dataset, seed, method, avg(n_programs / (n_samples + 1)) as dcov from r0 where n_programs > 5 group by 1, 2, 3),
 pw as (select dataset, seed, method, avg(n_samples / 100) as tpr from r0 where run_id % 2 = 0 group by 1, 2, 3),
 seeds as (select coalesce(rc.dataset, dc.dataset) as dataset, coalesce(rc.seed, dc.seed) as seed, coalesce(rc.method, dc.method) as method, rn as recovery_n_sig, rj as recovery_best_jaccard, dcov as discovery_coverage from rc full join dc
   on rc.dataset = dc.dataset and rc.seed = dc.seed and rc.method = dc.method),
 sm as (select coalesce(s.dataset, pw.dataset) as dataset, coalesce(s.seed, pw.seed) as seed, coalesce(s.method, pw.method) as method, recovery_n_sig, recovery_best_jaccard, discovery_coverage, tpr as power_tpr from seeds s full join pw
   on s.dataset = pw.dataset and s.seed = pw.seed and s.method = pw.method)
"""


def benchmark_rows(s, d):
    df = f.load(s, d, "discovery_runs").select(F.col("group_b").alias("dataset"), F.col("random_state").alias("seed"), F.lower(f.clean_name("method_name")).alias("method"), F.col("n_programs").cast("double"), F.col("n_samples").cast("double"), "run_id")
    df = df.where("dataset is not null and seed is not null and method is not null")
    keys = suite.SEED_KEYS
    # power rows exist for a part of the runs only, so that the outer join has something to fill
    return (
        df.select(*keys, F.col("n_programs").alias("n_sig"), F.col("n_samples").alias("best_jaccard")),
        df.where("n_programs > 5").select(*keys, (F.col("n_programs") / (F.col("n_samples") + 1)).alias("coverage")),
        df.where("run_id % 2 = 0").select(*keys, (F.col("n_samples") / 100).alias("tpr")),
    )


_METRICS = ["recovery_n_sig", "recovery_best_jaccard", "discovery_coverage", "power_tpr"]


@query("with " + _SUITE + "select dataset, seed, method, " + ", ".join(f"round({m}, 6) as {m}" for m in _METRICS) + ", 'de_novo' as track from sm")
def suite_seed_summary(s, d):
    return suite.seed_summary(*benchmark_rows(s, d)).withColumns({m: F.round(m, 6) for m in _METRICS})


@query("with " + _SUITE + "select dataset, method, " + ", ".join(f"round(avg({m}), 6) as {m}_mean, round(stddev_samp({m}), 6) as {m}_std" for m in _METRICS) + ", 'de_novo' as track from sm group by 1, 2")
def suite_method_summary(s, d):
    out = suite.method_summary(suite.seed_summary(*benchmark_rows(s, d)))
    return out.withColumns({f"{m}_{x}": F.round(f"{m}_{x}", 6) for m in _METRICS for x in ("mean", "std")})


_RANKS = "with " + _SUITE + """, a as (select dataset, method, avg(recovery_n_sig) as x, avg(discovery_coverage) as y, avg(power_tpr) as z from sm group by 1, 2),
 rk as (select dataset, method, case when x is not null then rank() over (partition by dataset, x is null order by x desc) + (count(*) over (partition by dataset, x is null, x) - 1) / 2 end as rx,
   case when y is not null then rank() over (partition by dataset, y is null order by y desc) + (count(*) over (partition by dataset, y is null, y) - 1) / 2 end as ry,
   case when z is not null then rank() over (partition by dataset, z is null order by z) + (count(*) over (partition by dataset, z is null, z) - 1) / 2 end as rz from a),
 mr as (select dataset, method, (rx is not null)::int + (ry is not null)::int + (rz is not null)::int as n_metrics, (coalesce(rx, 0) + coalesce(ry, 0) + coalesce(rz, 0)) / nullif((rx is not null)::int + (ry is not null)::int + (rz is not null)::int, 0) as mean_rank from rk)
"""


@query(_RANKS + "select dataset, 'de_novo' as track, method, n_metrics, round(mean_rank, 6) as mean_rank, row_number() over (partition by dataset order by round(mean_rank, 9) nulls last, method) as position from mr")
def suite_leaderboard(s, d):
    summary = suite.method_summary(suite.seed_summary(*benchmark_rows(s, d)))
    out = suite.rank_leaderboard(summary, ["recovery_n_sig_mean", "discovery_coverage_mean", "power_tpr_mean"], ("power_tpr_mean",))
    return out.withColumn("mean_rank", F.round("mean_rank", 6))


@query("with " + _SUITE + "select dataset, count(distinct seed) as n_unique_seeds, count(distinct seed) >= 3 as passes from sm group by 1")
def suite_seed_counts(s, d):
    return suite.seed_counts(suite.seed_summary(*benchmark_rows(s, d)), 3)


@query("with " + _SUITE + """, mf as (select distinct method, 'de_novo' as track, true as shared_input_pipeline, true as seed_controlled from sm where method <> 'topic')
select dataset, method, round(avg(recovery_n_sig), 6) as n_sig, any_value(coalesce(track, 'unknown')) as track, any_value(coalesce(shared_input_pipeline, false)) as shared_input_pipeline,
 any_value(coalesce(seed_controlled, false)) as seed_controlled, any_value(coalesce(shared_input_pipeline and seed_controlled, false)) as fairness_pass, any_value(20) as n_programs_budget from sm left join mf using (method) group by 1, 2""")
def suite_fairness(s, d):
    """A manifest without one method, so that the missing flags show."""
    seeds = suite.seed_summary(*benchmark_rows(s, d))
    known = seeds.where("method <> 'topic'")
    manifest = suite.fairness_manifest(known, n_programs=20)
    stats = seeds.groupBy("dataset", "method").agg(F.round(F.avg("recovery_n_sig"), 6).alias("n_sig"))
    out = suite.with_fairness(suite.with_track(stats, known), manifest)
    return out.withColumn("n_programs_budget", F.lit(20))


@query(f.with_(f.REFERENCES) + """, n as (select distinct set_name from refs where collection_name = 'OPENWAY'), c as (select greatest(least(round(count(*) * 0.3), count(*) - 1), 1) as n_tune from n)
select set_name, case when row_number() over (order by md5('7|' || set_name), set_name) <= n_tune then 'tune' else 'eval' end as part from n, c""")
def leakage_split(s, d):
    return suite.leakage_split(f.references(s, d).where("collection_name = 'OPENWAY'"), 0.3, 7)


_TUNING = _METHODS + f""", {f.REFERENCES}, rs as (select distinct collection_name, set_name, gene from refs), m as (select distinct method, program, gene from mm), z as (select method, program, count(*) as n from m group by 1, 2),
 rg as (select distinct collection_name, gene from rs), ng as (select collection_name, count(*) as n from rg group by 1), cs as (select m.method, rg.collection_name, count(distinct m.gene) as c from m join rg using (gene) group by 1, 2),
 mk as (select a.method, a.program as p, b.program as q, count(*) as k from m a join m b on a.method = b.method and a.gene = b.gene and a.program < b.program group by 1, 2, 3),
 rd as (select mk.method, sum(k / (x.n + y.n - k)) as t from mk join z x on x.method = mk.method and x.program = p join z y on y.method = mk.method and y.program = q group by 1), np as (select method, count(*) as np from z group by 1),
 sp as (select method, avg(s) as specificity from (select method, program, avg(case when k = 1 then 1.0::double else 0 end) as s from (select *, count(*) over (partition by method, gene) as k from m) group by 1, 2) group by 1),
 sb as (select collection_name, set_name, count(*) as b from rs group by 1, 2), bk as (select method, program, collection_name, set_name, count(*) as k from m join rs using (gene) group by 1, 2, 3, 4),
 bj as (select method, program, collection_name, max(k / (n + b - k)) as j from bk join z using (method, program) join sb using (collection_name, set_name) group by 1, 2, 3),
 al as (select z.method, ng.collection_name, avg(coalesce(j, 0)) as alignment from z cross join ng left join bj on bj.method = z.method and bj.program = z.program and bj.collection_name = ng.collection_name group by 1, 2),
 sc as (select al.method, al.collection_name, alignment + 0.08 * coalesce(c, 0) / n + 0.05 * specificity - 0.02 * case when np < 2 then 0 else coalesce(t, 0) / (np * (np - 1) / 2) end as score
   from al join ng using (collection_name) left join cs on cs.method = al.method and cs.collection_name = al.collection_name join np on np.method = al.method left join rd on rd.method = al.method join sp on sp.method = al.method)
"""


@query(_TUNING + "select method, count(*) as n_collections, round(0.8 * avg(score) + 0.2 * min(score), 6) as robust_score from sc group by 1")
def tuning_scores(s, d):
    """Each method's programs against every collection, and the robust mean over collections."""
    m, _ = method_memberships(s, d)
    refs = f.references(s, d).select("collection_name", "set_name", "gene").where("collection_name is not null")
    scored = suite.tuning_score(packed.tables(m, refs, ["collection_name"]))
    return suite.robust_score(scored, ["method"]).withColumn("robust_score", F.round("robust_score", 6))


_MODELS = f.with_(f.LISTS) + """, m as (select distinct split_part(run_label, '/', 1) as cohort, split_part(run_label, '/', 2) as model, program, gene from lists),
 z as (select cohort, model, program, count(*) as n from m group by 1, 2, 3), md as (select cohort, model, count(*) as np from z group by 1, 2),
 k as (select a.cohort, a.model as ma, a.program as pa, b.model as mb, b.program as pb, count(*) as k from m a join m b on a.cohort = b.cohort and a.gene = b.gene and a.model <> b.model group by all),
 j as (select k.*, k / (x.n + y.n - k) as j from k join z x on x.cohort = k.cohort and x.model = ma and x.program = pa join z y on y.cohort = k.cohort and y.model = mb and y.program = pb)
"""


def models(s, d):
    label = F.split("run_label", "/")
    return f.list_sets(s, d).select(F.get(label, F.lit(0)).alias("cohort"), F.coalesce(F.get(label, F.lit(1)), F.lit("")).alias("model"), "program", "gene").distinct()


@query(_MODELS + """, b as (select cohort, ma, pa, mb, max(j) as b from j group by all), bs as (select cohort, ma, mb, sum(b) as s from b group by all), pr as (select a.cohort, a.model as ma, b.model as mb, a.np as na, b.np as nb from md a join md b on a.cohort = b.cohort and a.model <> b.model),
 ev as (select pr.*, coalesce(s, 0) as s from pr left join bs using (cohort, ma, mb)), mt as (select cohort, least(ma, mb) as ma, greatest(ma, mb) as mb, sum(s) / sum(na) as mean_best_match from ev group by 1, 2, 3),
 fl as (select cohort, model, gene, min(program) as label from m group by 1, 2, 3), pl as (select a.cohort, a.model as ma, b.model as mb, a.label as la, b.label as lb from fl a join fl b on a.cohort = b.cohort and a.gene = b.gene and a.model < b.model),
 ce as (select cohort, ma, mb, la, lb, count(*) as n from pl group by all), ro as (select cohort, ma, mb, la, sum(n) as a from ce group by all), co as (select cohort, ma, mb, lb, sum(n) as b from ce group by all),
 r1 as (select cohort, ma, mb, sum(a * (a - 1) / 2) as sa, sum(a) as n, sum(a * ln(a)) as la, count(*) as ka from ro group by all), c1 as (select cohort, ma, mb, sum(b * (b - 1) / 2) as sb, sum(b * ln(b)) as lb, count(*) as kb from co group by all),
 x1 as (select cohort, ma, mb, sum(n * (n - 1) / 2) as sc, sum(n * ln(n)) as lc from ce group by all),
 ag as (select cohort, ma, mb, case when abs((sa + sb) / 2 - coalesce(sa * sb / nullif(n * (n - 1) / 2, 0), 0)) < 1e-12 then 1 else (sc - coalesce(sa * sb / nullif(n * (n - 1) / 2, 0), 0)) / ((sa + sb) / 2 - coalesce(sa * sb / nullif(n * (n - 1) / 2, 0), 0)) end as ari,
   case when ka = 1 and kb = 1 then 1 else coalesce(greatest(ln(n) + (lc - la - lb) / n, 0) / nullif((ln(n) - la / n + ln(n) - lb / n) / 2, 0), 0) end as nmi from r1 join c1 using (cohort, ma, mb) join x1 using (cohort, ma, mb))
select pr.cohort, pr.ma as model_a, pr.mb as model_b, round(mean_best_match, 6) as mean_best_match, round(coalesce(ari, 0), 6) as ari, round(coalesce(nmi, 0), 6) as nmi, na as programs_a, nb as programs_b
 from pr join mt using (cohort, ma, mb) left join ag using (cohort, ma, mb) where pr.ma < pr.mb""")
def model_agreement(s, d):
    out = suite.model_agreement(models(s, d), ["cohort"])
    return out.withColumns({c: F.round(c, 6) for c in ("mean_best_match", "ari", "nmi")})


@query(_MODELS.replace("program, gene from lists)", "program, gene from lists where regexp_matches(run_label, '/(baseline|seed_shift_5)$'))") + """, fm as (select cohort, min(model) as f, count(*) as nm from md group by 1 having count(*) > 1),
 be as (select j.* from j join fm on fm.cohort = j.cohort and j.ma = fm.f qualify row_number() over (partition by j.cohort, pa, mb order by round(j, 12) desc, pb) = 1),
 hd as (select be.cohort, be.pa as program, m.gene, count(*) as c from be join m on m.cohort = be.cohort and m.model = be.mb and m.program = be.pb where j >= 0.1 group by all)
select m.cohort, m.program, m.gene from m join fm on fm.cohort = m.cohort and m.model = fm.f join hd on hd.cohort = m.cohort and hd.program = m.program and hd.gene = m.gene where c = nm - 1""")
def consensus_of_models(s, d):
    """The baseline of each cohort against one run of another seed."""
    return suite.consensus_of_models(models(s, d).where("model in ('baseline', 'seed_shift_5')"), ["cohort"], 0.1)


@query(f.with_(_CELLS) + "select donor, count(distinct cell_type) as n_labels from cells group by 1 having count(distinct cell_type) > 1")
def ambiguous_donors(s, d):
    """Donors whose cells have more than one type."""
    return suite.ambiguous_labels(cells(s, d), "donor", "cell_type")


@query(f.with_(_CELLS) + """, x as (select cell_type, donor, condition, count(*) as n from cells group by 1, 2, 3),
 p as (select cell_type, sum(n)::bigint as n_cells, count(*) filter (n >= 3 and condition = 'case') as donors_a, count(*) filter (n >= 3 and condition = 'control') as donors_b from x group by 1)
select cell_type, n_cells, donors_a, donors_b, true as eligible from p where donors_a >= 2 and donors_b >= 2 order by n_cells desc, cell_type limit 3""")
def selected_cell_types(s, d):
    """The three eligible types of most cells: the limit is the feature."""
    return columns.selected_types(expression.cell_type_plan(cells(s, d), ("case", "control"), 3), most=3)


@query("select 'group' as role, 'condition' as col union all select 'sample', 'donor' union all select 'cell_type', 'cell_type'")
def column_roles(s, d):
    """Found among the columns of the cell table by their names and counts of values."""
    found = columns.detect(cells(s, d))
    rows = [(r, getattr(found, r)) for r in ("group", "sample", "cell_type", "batch") if getattr(found, r)]
    return s.createDataFrame(rows, "role string, col string")


@query("""select baseline_label, perturbation_label, 'Mean best match of ' || perturbation_label || ' is ' || printf('%.2f', round(avg(best_match_jaccard), 2)) || ' over ' || count(*) || ' programs.' as sentence
 from robustness_program_matches where baseline_label is not null and perturbation_label is not null and best_match_jaccard is not null group by 1, 2""")
def robustness_sentences(s, d):
    df = f.load(s, d, "robustness_program_matches").where("baseline_label is not null and perturbation_label is not null and best_match_jaccard is not null")
    df = df.groupBy("baseline_label", "perturbation_label").agg(F.format_string("%.2f", F.round(F.avg("best_match_jaccard"), 2)).alias("mean"), F.count("*").alias("n"))
    out = suite.sentences(df, "Mean best match of ", "perturbation_label", " is ", "mean", " over ", "n", " programs.")
    return out.select("baseline_label", "perturbation_label", "sentence")
