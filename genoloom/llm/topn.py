"""The N highest items of every group, whatever the group's size.

Groups are counted exactly. Groups of more than ``heavy_rows`` rows are sorted by range over
(group, score, ties), which spreads one group over many tasks; every range keeps at most N rows
a group and the few survivors are ranked once more. All other groups go through an ordinary
window. Both results are united.

Defined cases: rows with a null or blank name, or with a null, NaN or infinite score, do not
count; of rows with an equal (group, run, item) the one with the latest loaded_at (null is
earliest), then the highest row_id counts; ties are ordered by item (bytes), then run_id, nulls
last; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genoloom.runtime import clean_gene, clean_name, pick

HEAVY_ROWS = 50_000
#: More heavy groups than this are joined by shuffle instead of broadcast.
BROADCAST_GROUPS = 10_000
FINITE = "score is not null and not isnan(score) and abs(score) <> double('infinity')"


def counted_rows(scores: DataFrame, score: str = "context_evidence") -> DataFrame:
    """program, run_id, gene, score, loaded_at, row_id of the rows that count, before corrections."""
    df = pick(scores, ["program", "run_id", "gene", score, "loaded_at", "row_id"])
    df = df.select(
        clean_name("program").alias("program"),
        "run_id",
        clean_gene("gene").alias("gene"),
        (F.col(score) + F.lit(0.0)).alias("score"),  # -0.0 becomes 0.0
        "loaded_at",
        "row_id",
    )
    return df.where(f"program is not null and gene is not null and {FINITE}")


def current_rows(rows: DataFrame) -> DataFrame:
    """One row for each (program, run_id, gene): the latest delivery."""
    last = F.max_by("score", F.struct("loaded_at", "row_id")).alias("score")
    return rows.groupBy("program", "run_id", "gene").agg(last)


def top_in_groups(rows: DataFrame, group: str, order: list, n: int, heavy: DataFrame, ranges: int | None = None) -> DataFrame:
    """Rank the rows of each group by ``order`` and keep ranks 1 to n; ``heavy`` names the heavy groups."""
    window = Window.partitionBy(group).orderBy(*order)
    light = rows.join(heavy, group, "left_anti")
    hot = rows.join(heavy, group, "left_semi")
    parts = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # salt = the range a row falls into; each range yields at most n rows a group
    hot = hot.repartitionByRange(parts, F.col(group), *order).withColumn("_range", F.spark_partition_id())
    in_range = Window.partitionBy(group, "_range").orderBy(*order)
    hot = hot.withColumn("_k", F.row_number().over(in_range)).where(F.col("_k") <= n).drop("_k", "_range")
    rank = F.row_number().over(window)
    return (
        light.withColumn("rank_no", rank)
        .where(F.col("rank_no") <= n)
        .unionByName(hot.withColumn("rank_no", rank).where(F.col("rank_no") <= n))
    )


def top_genes(scores: DataFrame, n: int = 10, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """program, run_id, gene, rank_no: the n genes of highest context_evidence of each program."""
    rows = counted_rows(scores)
    heavy = rows.groupBy("program").count().where(F.col("count") > heavy_rows).select("program")
    names = [r[0] for r in heavy.limit(BROADCAST_GROUPS + 1).collect()]
    if len(names) <= BROADCAST_GROUPS:
        heavy = F.broadcast(rows.sparkSession.createDataFrame([(x,) for x in names], "program string"))
    order = [F.desc("score"), F.asc("gene"), F.asc_nulls_last("run_id")]
    top = top_in_groups(current_rows(rows), "program", order, n, heavy)
    return top.select("program", "run_id", "gene", F.col("rank_no").cast("int").alias("rank_no"))
