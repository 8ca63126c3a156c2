"""The driver's tables as the engine's frames, and the same frames as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoloom.operators import gsea
from genoloom.runtime import SPACES, clean_gene, clean_name, load
from genoloom.sources import rank_lines

CH = " || ".join(f"chr({ord(c)})" for c in SPACES)
NAME = lambda x: f"nullif(trim({x}, {CH}), '')"
GENE = f"nullif(upper(trim(gene, {CH})), '')"


def programs(s: SparkSession, d: str) -> DataFrame:
    """run_id, program, gene: distinct clean memberships."""
    df = load(s, d, "dynamic_programs_long").select("run_id", clean_name("program").alias("program"), clean_gene("gene").alias("gene"))
    return df.where("run_id is not null and program is not null and gene is not null").distinct()


PROGRAMS = f"""programs as (select distinct run_id, program, gene from (select run_id, {NAME('program')} as program, {GENE} as gene from dynamic_programs_long)
  where run_id is not null and program is not null and gene is not null)"""


def references(s: SparkSession, d: str) -> DataFrame:
    """collection_name, set_name, gene: distinct clean memberships of the reference sets."""
    df = load(s, d, "gene_set").select("collection_name", "set_name", clean_gene("gene").alias("gene"))
    return df.where("set_name is not null and gene is not null").distinct()


REFERENCES = f"""refs as (select distinct collection_name, set_name, gene from (select collection_name, set_name, {GENE} as gene from gene_set)
  where set_name is not null and gene is not null)"""


def ranked(s: SparkSession, d: str) -> DataFrame:
    """file_id, gene, score, rank_no, n_genes of every ranking file."""
    rows = rank_lines.valid_rows(load(s, d, "ranked_genes_for_gsea_raw")).withColumn("gene", F.upper("gene"))
    return gsea.ranking(rows, ["file_id"])


def _ranked_sql() -> str:
    inner = rank_lines.judged_sql().strip().removeprefix("with ")
    return (
        inner
        + """, best as (select file_id, upper(gene) as gene, cast(score as double) as score from j where reason is null
    qualify row_number() over (partition by file_id, upper(gene) order by abs(cast(score as double)) desc, cast(score as double) desc) = 1),
  ranked as (select *, row_number() over (partition by file_id order by score desc, gene) as rank_no, count(*) over (partition by file_id) as n_genes from best)"""
    )


RANKED = _ranked_sql()


def context(s: SparkSession, d: str) -> DataFrame:
    """run_id, program, gene and the finite numbers of the latest delivery of each membership score."""
    df = load(s, d, "contextual_membership_scores")
    numbers = ["base_membership", "prob_a", "prob_b", "contextual_score_a", "contextual_score_b", "p_value", "context_shift", "context_evidence"]
    fin = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)).alias(c)
    df = df.select("run_id", clean_name("program").alias("program"), clean_gene("gene").alias("gene"), "loaded_at", "row_id", *[fin(c) for c in numbers])
    df = df.where("run_id is not null and program is not null and gene is not null")
    last = F.max_by(F.struct(*numbers), F.struct("loaded_at", "row_id")).alias("x")
    return df.groupBy("run_id", "program", "gene").agg(last).select("run_id", "program", "gene", "x.*")


_NUM = ["base_membership", "prob_a", "prob_b", "contextual_score_a", "contextual_score_b", "p_value", "context_shift", "context_evidence"]
CONTEXT = f"""context as (select run_id, program, gene, {', '.join(f'case when isfinite({c}) then {c} end as {c}' for c in _NUM)}
  from (select *exclude(program, gene), {NAME('program')} as program, {GENE} as gene from contextual_membership_scores)
  where run_id is not null and program is not null and gene is not null
  qualify row_number() over (partition by run_id, program, gene order by loaded_at desc nulls last, row_id desc) = 1)"""


def list_sets(s: SparkSession, d: str) -> DataFrame:
    """list_id, run_label, program, gene of the robustness analysis' programs, distinct and clean."""
    df = load(s, d, "program_gene_lists").select("list_id", "run_label", clean_name("program").alias("program"), F.explode(F.split("genes", ",")).alias("gene"))
    return df.withColumn("gene", clean_gene("gene")).where("gene is not null and program is not null and run_label is not null").distinct()


LISTS = f"""lists as (select distinct list_id, run_label, program, gene from (select list_id, run_label, {NAME('program')} as program,
    nullif(upper(trim(g, {CH})), '') as gene from (select list_id, run_label, program, unnest(string_split(genes, ',')) as g from program_gene_lists))
  where gene is not null and program is not null and run_label is not null)"""


def expression(s: SparkSession, d: str) -> DataFrame:
    """sample, gene, value: suppliers stand for samples, parts for genes, summed quantities for counts."""
    df = load(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("sample"), F.col("l_partkey").alias("gene"))
    return df.agg(F.sum("l_quantity").alias("value"))


EXPRESSION = "expr as (select l_suppkey as sample, l_partkey as gene, sum(l_quantity) as value from lineitem group by 1, 2)"


def samples(s: SparkSession, d: str) -> DataFrame:
    """sample, grp, batch: the balance of the supplier stands for the contrast, its nation for the batch."""
    df = load(s, d, "supplier")
    return df.select(F.col("s_suppkey").alias("sample"), F.when(F.col("s_acctbal") >= 4500, "case").otherwise("control").alias("grp"), F.col("s_nationkey").alias("batch"))


SAMPLES = "samples as (select s_suppkey as sample, case when s_acctbal >= 4500 then 'case' else 'control' end as grp, s_nationkey as batch from supplier)"


def brands(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "part").select(F.col("p_brand").alias("set_name"), F.col("p_partkey").alias("gene"))


BRANDS = "brands as (select p_brand as set_name, p_partkey as gene from part)"


def embeddings(s: SparkSession, d: str) -> DataFrame:
    """gene (number), label, v: the vectors as arrays of doubles."""
    return load(s, d, "embeddings").select(F.col("vec_id").alias("gene"), "label", F.col("embedding").cast("array<double>").alias("v"))


EMBEDDINGS = "emb as (select vec_id as gene, label, list_transform(embedding, lambda x: x::double) as v from embeddings)"


def with_(*parts: str) -> str:
    return "with " + ",\n".join(parts) + "\n"
