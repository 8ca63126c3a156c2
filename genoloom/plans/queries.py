"""All queries of the core over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from genoloom.plans import q_annotate, q_discover, q_enrich, q_evaluate, q_expression, q_modules, q_report, q_sets, q_suite, q_validate
from genoloom.plans.registry import QUERIES, SQL, query
from genoloom.runtime import load
from genoloom.sources import rank_lines

MODULES = (q_sets, q_enrich, q_expression, q_annotate, q_validate, q_discover, q_report, q_evaluate, q_suite, q_modules)


@query(rank_lines.judged_sql() + "select file_id, line_no, reason from j where reason is not null")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return rank_lines.failing_lines(load(spark, d, "ranked_genes_for_gsea_raw"))


@query(rank_lines.judged_sql() + "select file_id, line_no, gene, cast(score as double) as score from j where reason is null")
def p2_valid(spark: SparkSession, d: str) -> DataFrame:
    return rank_lines.valid_rows(load(spark, d, "ranked_genes_for_gsea_raw"))


__all__ = ["MODULES", "QUERIES", "SQL"]
