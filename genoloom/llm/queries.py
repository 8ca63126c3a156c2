"""Queries over the driver's tables for the operators of this subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from genoloom.llm import bpe, clusters, langid, mix, setjoin, together, topn
from genoloom.runtime import SPACES, load

_CH = " || ".join(f"chr({ord(c)})" for c in SPACES)
_GENE, _PROGRAM = f"nullif(upper(trim(gene, {_CH})), '')", f"nullif(trim(program, {_CH}), '')"


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return clusters.cluster_pairs(load(spark, d, "dynamic_programs_long"))


def p1_clusters(spark: SparkSession, d: str) -> DataFrame:
    return clusters.cluster_report(load(spark, d, "dynamic_programs_long"), load(spark, d, "discovery_runs"))


_P1 = f"""
with recursive m as (select distinct {_PROGRAM} as program, {_GENE} as gene from dynamic_programs_long),
v as (select * from m where program is not null and gene is not null),
n as (select program, count(*) as n from v group by 1),
k as (select a.program as pa, b.program as pb, count(*) as k from v a join v b on a.gene = b.gene and a.program < b.program group by 1, 2),
l as (select pa, pb from k join n x on x.program = pa join n y on y.program = pb where 3 * k >= x.n + y.n),
e as (select pa as a, pb as b from l union all select pb, pa from l),
r as (select a, b from e union select r.a, e.b from r join e on r.b = e.a)
"""
P1_SQL = _P1 + "select distinct a as program_a, b as program_b from r where a < b"
P1_CLUSTERS_SQL = _P1 + f"""
, c as (select n.program, least(n.program, coalesce(min(r.b), n.program)) as cluster from n left join r on r.a = n.program group by 1),
z as (select cluster, count(*) as size from c group by 1),
w as (select gene, ln(((select count(*) from n) + 1) / count(*)) as w from v group by 1),
q as (select program, sqrt(sum(w * w)) as len from v join w using (gene) group by 1),
u as (select cluster, program, gene, w / len as u from v join w using (gene) join q using (program) join c using (program)),
s as (select cluster, gene, sum(u) as s from u group by 1, 2),
o as (select cluster, program, round(sum(u * s), 6) as closeness from u join s using (cluster, gene) group by 1, 2),
t as (select cluster, string_agg(program, ',' order by k) as typical_programs
      from (select *, row_number() over (partition by cluster order by closeness desc, program) as k from o) where k <= 3 group by 1),
d as (select distinct cluster, run_id from (select {_PROGRAM} as program, run_id from dynamic_programs_long) join c using (program)),
a as (select run_id, max(n_programs) as asked from discovery_runs group by 1),
x as (select cluster, count(*) as n_runs, round(avg(case when asked > 0 then asked end), 6) as asked_programs from d left join a using (run_id) group by 1)
select cluster, size, n_runs, asked_programs, typical_programs from z left join t using (cluster) left join x using (cluster)
"""


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return topn.top_genes(load(spark, d, "contextual_membership_scores"))


P3_SQL = f"""
with v as (select {_PROGRAM} as program, run_id, {_GENE} as gene, context_evidence + 0.0 as score, loaded_at, row_id
           from contextual_membership_scores where isfinite(context_evidence)),
c as (select *, row_number() over (partition by program, run_id, gene order by loaded_at desc nulls last, row_id desc) as k
      from v where program is not null and gene is not null),
r as (select program, run_id, gene, row_number() over (partition by program order by score desc, gene, run_id nulls last) as rank_no
      from c where k = 1)
select program, run_id, gene, cast(rank_no as int) as rank_no from r where rank_no <= 10
"""


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_odds(spark, d).select("ensemble_id", "gene_a", "gene_b")


def p4_odds(spark: SparkSession, d: str) -> DataFrame:
    out = together.gene_pairs(load(spark, d, "dynamic_programs_long"), load(spark, d, "discovery_runs"))
    return out.select(
        "ensemble_id", "gene_a", "gene_b", "n_ab", "n_a", "n_b", "n_programs",
        F.round("lift", 6).alias("lift"), F.round("odds_ratio", 6).alias("odds_ratio"), F.round("log_odds_se", 6).alias("log_odds_se"),
    )


_P4 = f"""
with m as (select distinct e.ensemble_id, {_PROGRAM} as program, {_GENE} as gene from dynamic_programs_long d
           join (select distinct run_id, ensemble_id from discovery_runs where ensemble_id is not null) e using (run_id)),
v as (select * from m where program is not null and gene is not null),
r as (select ensemble_id, count(distinct program) as n_programs from v group by 1),
n as (select ensemble_id, gene, count(*) as n from v group by 1, 2),
p as (select a.ensemble_id, a.gene as gene_a, b.gene as gene_b, count(*) as n_ab from v a
      join v b on a.ensemble_id = b.ensemble_id and a.program = b.program and a.gene < b.gene group by 1, 2, 3 having count(*) >= 4),
o as (select p.*, a.n as n_a, b.n as n_b, n_programs from p join n a on a.ensemble_id = p.ensemble_id and a.gene = gene_a
      join n b on b.ensemble_id = p.ensemble_id and b.gene = gene_b join r on r.ensemble_id = p.ensemble_id
      where n_ab * n_programs >= 3 * a.n * b.n)
"""
P4_SQL = _P4 + "select ensemble_id, gene_a, gene_b from o"
P4_ODDS_SQL = _P4 + """
select ensemble_id, gene_a, gene_b, n_ab, n_a, n_b, n_programs, round(n_ab * n_programs / (n_a * n_b), 6) as lift,
  round((n_ab + 0.5::double) * (n_programs - n_a - n_b + n_ab + 0.5::double) / ((n_a - n_ab + 0.5::double) * (n_b - n_ab + 0.5::double)), 6) as odds_ratio,
  round(sqrt(1 / (n_ab + 0.5::double) + 1 / (n_a - n_ab + 0.5::double) + 1 / (n_b - n_ab + 0.5::double) + 1 / (n_programs - n_a - n_b + n_ab + 0.5::double)), 6) as log_odds_se
from o
"""


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return setjoin.similar_sets(load(spark, d, "program_gene_lists"), load(spark, d, "gene_set")).select("id_a", "id_b")


def p5_summary(spark: SparkSession, d: str) -> DataFrame:
    return setjoin.set_summary(load(spark, d, "program_gene_lists"), load(spark, d, "gene_set")).select("id", "is_list", "n_copies", "n_links")


_P5 = f"""
with l as (select distinct list_id as id, true as is_list, nullif(upper(trim(g, {_CH})), '') as gene
           from (select list_id, unnest(string_split(genes, ',')) as g from program_gene_lists)),
s as (select distinct set_id as id, false as is_list, {_GENE} as gene from gene_set),
v as (select * from l where gene is not null union all select * from s where gene is not null),
n as (select id, is_list, count(*) as n, string_agg(gene, ',' order by gene) as whole from v group by 1, 2),
k as (select a.id as ia, a.is_list as la, b.id as ib, b.is_list as lb, count(*) as k from v a join v b on a.gene = b.gene
      and a.id < b.id and (a.is_list or b.is_list) group by 1, 2, 3, 4),
f as (select ia as id_a, ib as id_b, x.whole as wa, y.whole as wb, la, lb from k join n x on x.id = ia and x.is_list = la join n y on y.id = ib and y.is_list = lb
      where k * 5 >= 3 * (x.n + y.n - k))
"""
P5_SQL = _P5 + "select id_a, id_b from f"
P5_SUMMARY_SQL = _P5 + """
, q as (select distinct wa as u, wb as v from f where wa <> wb union select distinct wb, wa from f where wa <> wb)
select id, is_list, c.n as n_copies, coalesce(x.n, 0) as n_links from n join (select whole, count(*) as n from n group by 1) c using (whole)
left join (select u as whole, count(distinct v) as n from q group by 1) x using (whole)
"""

def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_documents(load(spark, d, "documents"))


def p6_text(spark: SparkSession, d: str) -> DataFrame:
    """The texts again, decoded from their ids: equal to the texts themselves."""
    return bpe.decode_documents(bpe.encode_documents(load(spark, d, "documents")))


P6_TEXT_SQL = "select doc_id, coalesce(text, '') as text from documents"


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix.mixed_blocks(load(spark, d, "documents"), load(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix.mixed_shares(load(spark, d, "documents"), load(spark, d, "mix_targets"))


def p7_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of every source's share: repeats within the cap, and the target met unless the stock ends first.

    The blocks of a source are its share rounded to whole blocks, and its one short block may be
    drawn max_repeats times, so the tokens fall short of the target by 1 + max_repeats blocks at most.
    """
    shares = mix.mixed_shares(load(spark, d, "documents"), load(spark, d, "mix_targets"))
    slack = (F.col("max_repeats") + 1) * mix.BLOCK_TOKENS
    spent = F.col("drawn_tokens") >= F.col("stock_tokens") * F.col("max_repeats")
    return shares.select(
        "source", "target_share", "max_repeats", (F.col("most_repeats") <= F.col("max_repeats")).alias("cap_kept"),
        (spent | (F.col("drawn_tokens") + slack >= F.col("target_share") * F.sum("drawn_tokens").over(Window.partitionBy()))).alias("target_kept"),
        (F.round(F.sum("actual_share").over(Window.partitionBy()), 9) == 1).alias("whole"),  # one row for each source
    )


P7_CHECKS_SQL = f"""
select lower(trim(source, {_CH})) as source, target_share, max_repeats, true as cap_kept, true as target_kept, true as whole from mix_targets
"""


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    documents, tags = load(spark, d, "documents"), load(spark, d, "lang_tags")
    model = langid.train(documents, tags)
    found = langid.segments(langid.labelled(documents, tags), model)
    return langid.label_cases(found.withColumn("langs", F.array_distinct("segments.lang")))


def p8_languages(spark: SparkSession, d: str) -> DataFrame:
    out = langid.document_languages(load(spark, d, "documents"), load(spark, d, "lang_tags"))
    return out.select("doc_id", "label", "lang", "confidence", F.array_join("langs", ",").alias("langs"), F.size("segments").alias("n_segments"))


def p8_segments(spark: SparkSession, d: str) -> DataFrame:
    out = langid.document_languages(load(spark, d, "documents"), load(spark, d, "lang_tags"))
    return out.select("doc_id", F.inline("segments"))


QUERIES = {
    "p1_found": p1_found,
    "p1_clusters": p1_clusters,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p4_odds": p4_odds,
    "p5_found": p5_found,
    "p5_summary": p5_summary,
    "p6_ids": p6_ids,
    "p6_text": p6_text,
    "p7_mix": p7_mix,
    "p7_shares": p7_shares,
    "p7_checks": p7_checks,
    "p8_found": p8_found,
    "p8_languages": p8_languages,
    "p8_segments": p8_segments,
}
SQL = {
    "p1_found": P1_SQL,
    "p1_clusters": P1_CLUSTERS_SQL,
    "p3_found": P3_SQL,
    "p4_found": P4_SQL,
    "p4_odds": P4_ODDS_SQL,
    "p5_found": P5_SQL,
    "p5_summary": P5_SUMMARY_SQL,
    "p6_text": P6_TEXT_SQL,
    "p7_checks": P7_CHECKS_SQL,
}
