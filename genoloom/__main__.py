"""python -m genoloom discovery | compare: the two product paths over Parquet or delimited files."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoloom.plans import pipeline
from genoloom.sources import gmt, tables


def _table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else tables.read_table(spark, path)


def _sets(spark: SparkSession, path: str) -> DataFrame:
    return gmt.read_gmt(spark, path, strict=False).select("set_name", "gene")


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="genoloom")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("discovery", help="programs, tests and gates from a matrix and its samples")
    one.add_argument("--matrix", required=True, help="delimited genes by samples, or Parquet with sample, gene, value")
    one.add_argument("--samples", required=True, help="sample and group of every sample")
    one.add_argument("--sample-col", default="sample")
    one.add_argument("--group-col", default="condition")
    one.add_argument("--group-a", required=True)
    one.add_argument("--group-b", required=True)
    one.add_argument("--references", required=True, help="GMT file")
    one.add_argument("--programs", type=int, default=20)
    one.add_argument("--permutations", type=int, default=1000)
    two = commands.add_parser("compare", help="dynamic programs and curated sets on one ranking")
    two.add_argument("--ranking", required=True)
    two.add_argument("--dynamic", required=True, help="GMT file")
    two.add_argument("--curated", required=True, help="GMT file")
    two.add_argument("--permutations", type=int, default=1000)
    two.add_argument("--focus", default="", help="genes, comma-separated")
    for p in (one, two):
        p.add_argument("--out", required=True)
    a = parser.parse_args(args)
    spark = SparkSession.builder.appName("genoloom").getOrCreate()
    if a.command == "discovery":
        matrix = _table(spark, a.matrix)
        values = matrix if {"sample", "gene", "value"} <= set(matrix.columns) else tables.wide_to_long(matrix, matrix.columns[0])
        samples = _table(spark, a.samples).select(F.col(a.sample_col).alias("sample"), F.col(a.group_col).alias("grp")).dropDuplicates(["sample"])
        config = pipeline.Discovery(a.group_a, a.group_b, n_programs=a.programs, n_perm=a.permutations)
        pipeline.write_results(pipeline.discovery(values, samples, _sets(spark, a.references), config), a.out, config)
    else:
        ranked = tables.ranked_table(_table(spark, a.ranking))
        focus = spark.createDataFrame([(g.strip(),) for g in a.focus.split(",") if g.strip()], "gene string") if a.focus else None
        dynamic = _sets(spark, a.dynamic).withColumnRenamed("set_name", "program")
        for name, df in pipeline.comparison(ranked, dynamic, _sets(spark, a.curated), a.permutations, focus).items():
            df.write.mode("overwrite").parquet(f"{a.out}/{name}")


if __name__ == "__main__":
    main()
