"""Report frames, comparison, text formats, streaming."""

from pyspark.sql import functions as F

from genoloom.operators import report, sets
from genoloom.plans import frames as f
from genoloom.plans.q_annotate import _SCORE, _SOURCE, _LABEL
from genoloom.plans.q_expression import _DE, de_rows
from genoloom.plans.q_sets import _OVERLAP, _overlap
from genoloom.plans.registry import query
from genoloom.runtime import materialize, scratch_path
from genoloom.sources import gmt
from genoloom.streaming import context as stream

_TOPP = _OVERLAP.replace("with programs", "with " + f.CONTEXT + ",\nprograms", 1) + """, en as (select program, min(p_value) as fdr from context group by 1),
 tp as (select program, row_number() over (order by fdr nulls last, program) as program_rank from en qualify program_rank <= 25), ov as (select o.* from o join tp using (program))"""


def top25(s, d):
    en = f.context(s, d).groupBy("program").agg(F.min("p_value").alias("fdr"))
    return report.top_programs(en, 25).select("program", "program_rank")


@query(_TOPP + """, bb as (select set_name, row_number() over (order by round(max(jaccard), 12) desc, set_name) as k from ov group by 1 qualify k <= 20)
select program, set_name, round(jaccard, 6) as jaccard from ov join bb using (set_name)""")
def overlap_heatmap(s, d):
    return report.heatmap(_overlap(s, d), top25(s, d), 20).withColumn("jaccard", F.round("jaccard", 6))


@query(_TOPP + """ select program, set_name, row_number() over (partition by program order by round(jaccard, 12) desc, overlap_n desc, set_name) as position, greatest(program_n - overlap_n, 0) as novel_estimate, round(jaccard, 6) as jaccard from ov qualify position <= 8""")
def multi_pathway_rows(s, d):
    out = report.references_of_programs(_overlap(s, d), top25(s, d), 8)
    return out.select("program", "set_name", "position", "novel_estimate", F.round("jaccard", 6).alias("jaccard"))


@query(_TOPP + f""", x as (select {_SOURCE} as source, set_name, max(jaccard) as bj, count(distinct program) as programs from ov group by 1, 2)
select source, set_name, round(bj, 6) as best_jaccard, programs, row_number() over (partition by source order by round(bj, 12) desc, set_name) as position from x qualify position <= 12""")
def reference_source_rows(s, d):
    return report.references_by_source(_overlap(s, d), top25(s, d), 12).withColumn("best_jaccard", F.round("best_jaccard", 6))


@query(_OVERLAP + f""", g as (select set_name, {_LABEL} as lb, max(jaccard) as bj, count(distinct program) as programs from o group by 1, 2), h as (select *, {_SCORE} as priority from g),
 x as (select *, 2 * priority + 15 * bj + 0.8 * least(programs, 6) + 0.6 as score from h),
 r as (select *, row_number() over (order by round(bj, 12) desc, set_name) as raw_rank, row_number() over (order by round(score, 9) desc, round(bj, 12) desc, set_name) as priority_rank from x)
select set_name, round(bj, 6) as best_jaccard, programs, priority, round(score, 6) as score, raw_rank, priority_rank from r where raw_rank <= 10 or priority_rank <= 10""")
def ranking_calibration(s, d):
    return report.calibrated_ranking(_overlap(s, d), 10).withColumns({"best_jaccard": F.round("best_jaccard", 6), "score": F.round("score", 6)})


_MEMBER = f.with_(f.CONTEXT) + """, g as (select program, gene, max(base_membership) as base_membership from context where base_membership is not null group by 1, 2),
 m as (select *, row_number() over (partition by program order by base_membership desc, gene) as position from g qualify position <= 20)"""


def _members(s, d):
    g = f.context(s, d).where("base_membership is not null").groupBy("program", "gene").agg(F.max("base_membership").alias("base_membership"))
    return report.membership_table(g, 20)


@query(_MEMBER + " select program, gene, base_membership, position from m")
def membership_table(s, d):
    return _members(s, d)


@query(_MEMBER + " select program, count(*) as n, string_agg(gene, ',' order by position) as genes from m group by 1")
def membership_lists(s, d):
    return report.compact_lists(_members(s, d))


_GATED = """gt as (select baseline_claim_supported as gate_baseline, perturbation_claim_supported as gate_perturbation, claim_supported_retained as claim_supported from robustness_program_matches)"""


def _gated(s, d):
    df = f.load(s, d, "robustness_program_matches")
    return df.select(F.col("baseline_claim_supported").alias("gate_baseline"), F.col("perturbation_claim_supported").alias("gate_perturbation"), F.col("claim_supported_retained").alias("claim_supported"))


@query(f.with_(_GATED) + " " + " union all ".join(f"select '{g}' as gate, count({g}) as n_tested, count(*) filter ({g}) as n_passed, round(count(*) filter ({g}) / nullif(count({g}), 0), 6) as rate from gt" for g in ("gate_baseline", "gate_perturbation", "claim_supported")))
def gate_summary(s, d):
    return report.gate_summary(_gated(s, d), ["gate_baseline", "gate_perturbation", "claim_supported"]).withColumn("rate", F.round("rate", 6))


@query(_DE.replace("with expr", "with " + _GATED + ",\nexpr", 1) + """, a as (select count(*) as n_programs, count(*) filter (claim_supported) as n_supported from gt), b as (select count(*) as n_genes, count(*) filter (fdr <= 0.05) as n_changed from de)
select *, n_changed <= 5 and n_supported > 0 as few_genes_alert from a, b""")
def headline_summary(s, d):
    return report.headline(_gated(s, d), de_rows(s, d).select("fdr"))


@query("select event_type as context, cast(floor(cast(json_extract_string(props, '$.k') as int) / 10) as int) as program, count(*) as width from events group by 1, 2")
def alluvial_flows(s, d):
    k = F.get_json_object("props", "$.k").cast("int")
    df = f.load(s, d, "events").select(F.col("event_type").alias("context"), F.floor(k / 10).cast("int").alias("program"))
    return report.flows(df)


@query(_OVERLAP + """, w as (select distinct run_id, program from programs) select run_id, program, set_name, overlap_n, round(jaccard, 6) as jaccard from w join o using (program)
 qualify row_number() over (partition by run_id order by round(jaccard, 12) desc, overlap_n desc, program, set_name) = 1""")
def anchor_programs(s, d):
    """The anchor pair of every run."""
    runs = f.programs(s, d).select("run_id", "program").distinct()
    out = report.anchor(_overlap(s, d).join(runs, "program"), ["run_id"], "program", "set_name")
    return out.select("run_id", "program", "set_name", "overlap_n", F.round("jaccard", 6).alias("jaccard"))


_FOCUS = f.with_(f.PROGRAMS, f.REFERENCES) + """, fg as (select gene from refs group by 1 order by count(distinct set_name) desc, gene limit 20),
 a as (select gene, string_agg(distinct program, ',' order by program) as programs from programs group by 1), b as (select gene, string_agg(distinct set_name, ',' order by set_name) as references_ from refs group by 1)
select fg.gene, coalesce(programs, '') as programs, coalesce(references_, '') as "references" from fg left join a using (gene) left join b using (gene)"""


@query(_FOCUS)
def focus_genes(s, d):
    """The twenty genes that most reference sets hold, and where they are."""
    refs = f.references(s, d)
    focus = refs.groupBy("gene").agg(F.countDistinct("set_name").alias("n")).orderBy(F.desc("n"), "gene").limit(20)  # the report's size
    return report.focus_genes(focus, f.programs(s, d), refs)


_FUSE = f.with_(f.CONTEXT) + """, sc as (select program, gene, greatest(max(contextual_score_a), 0) as a, greatest(max(contextual_score_b), 0) as b from context where contextual_score_a is not null and contextual_score_b is not null group by 1, 2),
 n as (select program, gene, case when max(a) over (partition by program) > 0 then a / max(a) over (partition by program) else 1 end as a, case when max(b) over (partition by program) > 0 then b / max(b) over (partition by program) else 1 end as b from sc),
 r as (select *, row_number() over (partition by program order by a desc, gene) as ra from n), rb as (select *, row_number() over (partition by program order by b desc, gene) as rb from n where program <> 'Unassigned'),
 z as (select program, count(*) as n from n group by 1), k as (select x.program, y.program as other, count(*) as k from n x join rb y using (gene) group by 1, 2),
 m as (select k.program, other from k join z p using (program) join z q on q.program = other where k / (p.n + q.n - k) >= 0.05 qualify row_number() over (partition by k.program order by round(k / (p.n + q.n - k), 12) desc, other) = 1),
 u as (select program, gene, 1 / (40 + ra) as s from r union all select m.program, rb.gene, 1 / (40 + rb.rb) from m join rb on rb.program = other), v as (select program, gene, sum(s) as s from u group by 1, 2)
select program, gene, round(s, 6) as score, row_number() over (partition by program order by round(s, 9) desc, gene) as position from v qualify position <= 20"""


@query(_FUSE)
def fused_programs(s, d):
    """Scores of context A fused by reciprocal rank with the best overlapping named program of context B."""
    c = f.context(s, d).where("contextual_score_a is not null and contextual_score_b is not null").groupBy("program", "gene").agg(F.max("contextual_score_a").alias("a"), F.max("contextual_score_b").alias("b"))
    c = materialize(c)
    a, b = c.select("program", "gene", F.col("a").alias("score")), c.where("program <> 'Unassigned'").select("program", "gene", F.col("b").alias("score"))
    return sets.fused_scores(a, b, 20, 0.05, "rrf").withColumn("score", F.round("score", 6))


_SETPOS = f"""sp as (select set_name, gene, row_number() over (partition by set_name order by p, gene) - 1 as pos from (select set_name, {f.GENE} as gene, min(pos) as p from gene_set where set_name is not null group by 1, 2) where gene is not null)"""


def _positioned(s, d):
    from pyspark.sql import Window

    df = f.load(s, d, "gene_set").select("set_name", f.clean_gene("gene").alias("gene"), "pos").where("set_name is not null and gene is not null")
    df = df.groupBy("set_name", "gene").agg(F.min("pos").alias("p"))
    return df.select("set_name", (F.row_number().over(Window.partitionBy("set_name").orderBy("p", "gene")) - 1).alias("pos"), "gene")


@query(f.with_(_SETPOS) + "select set_name, set_name as description, pos::int as pos, gene from sp")
def gmt_round_trip(s, d):
    """The reference sets written as GMT and read again."""
    path = scratch_path(s)
    gmt.write_gmt(_positioned(s, d), path)
    return gmt.read_gmt(s, path)


@query(f.with_(_SETPOS) + "select set_name, set_name as description, pos::int as pos, gene from sp")
def gmx_round_trip(s, d):
    path = scratch_path(s)
    gmt.write_gmx(_positioned(s, d), path)
    return gmt.read_gmx(s, path)


@query(f"""with w as (select set_name, {f.GENE} as gene, max(coalesce(case when isnan(weight) then null else weight end, 1)) as weight from gene_set where set_name is not null group by 1, 2)
select set_name, (row_number() over (partition by set_name order by weight desc, gene) - 1)::int as pos, gene, round(weight, 5) as weight from w where gene is not null""")
def weighted_gmt_round_trip(s, d):
    w = f.load(s, d, "gene_set").select("set_name", f.clean_gene("gene").alias("gene"), F.coalesce(F.nanvl("weight", F.lit(1.0)), F.lit(1.0)).alias("weight"))
    w = w.where("set_name is not null and gene is not null").groupBy("set_name", "gene").agg(F.max("weight").alias("weight"))
    path = scratch_path(s)
    gmt.write_weighted_gmt(w, path)
    return gmt.read_weighted_gmt(s, path).withColumn("weight", F.round("weight", 5))


@query(f.with_(_SETPOS) + """, n as (select *, count(*) over (partition by set_name) as n from sp) select 'CUSTOM::' || set_name as set_name, pos::int as pos, gene from n where n >= 10""")
def normalized_sets(s, d):
    return gmt.normalized_sets(_positioned(s, d), "CUSTOM", least=10)


@query(f.with_(_SETPOS, f.PROGRAMS) + """, u as (select distinct gene from programs), r as (select sp.* from sp semi join u using (gene)) select set_name, gene from r qualify count(*) over (partition by set_name) >= 3""")
def universe_restricted(s, d):
    return gmt.universe_restricted(_positioned(s, d), f.programs(s, d), 3).select("set_name", "gene")


@query("""select date_trunc('hour', ts) as start, event_type as context, count(*) as n, round(sum(value), 4) as total from events group by 1, 2""")
def streamed_counts(s, d):
    """The events as a stream, counted by hour and context; rows up to two hours late count."""
    events = s.readStream.schema(f.load(s, d, "events").schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")
    out = stream.run_updates(stream.windowed_counts(events), scratch_path(s))
    return out.withColumns({"total": F.round("total", 4), "start": F.col("start").cast("timestamp_ntz")})
