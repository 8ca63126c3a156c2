"""Pairs of items that appear together more often than chance, by external sort of pair codes.

Items get dense 32-bit numbers, so a pair is one 64-bit code. Tasks hold the records in key
order, write the codes of all pairs in sorted runs (equal codes of a run already counted), and
Spark's external sorter spills and merges the runs; one pass over the sorted stream adds up runs
of equal codes. No hash table of pairs exists anywhere, so memory is bounded by the run length.

Before pairs are formed, items that no qualifying pair can hold are left out. With R records in
the scope, n_a <= n_b and n_ab <= n_a, a pair with n_ab >= least needs n_a >= least, and a pair
with n_ab * R >= lift * n_a * n_b needs R >= lift * n_b. Both cuts lose nothing, and the second
removes exactly the items that are in a great many records. A record of very many items is cut
into slices of first items before the records are spread over the tasks, so that one record's
slices go to many tasks, and a slice forms at most RUN_CODES codes and one row of them at a time.

Defined cases: null or blank names and records of an unknown scope do not count; repeats count
once; a record of one item counts in R; empty tables give no rows; other columns are ignored;
more than 2^32 usable (scope, item) pairs don't fit the codes and are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoloom.runtime import clean_gene, clean_name, dense_ids, materialize, pick

RUN_CODES = 1 << 21
SLICE = 512
#: Numbers that half a code can hold.
CODES = 1 << 32


def program_records(programs: DataFrame, runs: DataFrame) -> DataFrame:
    """ensemble_id, program, genes (distinct clean genes) of the programs of ensembles."""
    members = pick(programs, ["run_id", "program", "gene"]).select(
        "run_id", clean_name("program").alias("program"), clean_gene("gene").alias("gene")
    )
    members = members.where("run_id is not null and program is not null and gene is not null")
    ensembles = pick(runs, ["run_id", "ensemble_id"]).where("run_id is not null and ensemble_id is not null").distinct()
    # a program label belongs to one run, so its genes are gathered before the runs are joined
    sets = members.groupBy("run_id", "program").agg(F.collect_set("gene").alias("genes"))
    return sets.join(ensembles, "run_id").groupBy("ensemble_id", "program").agg(
        F.array_distinct(F.flatten(F.collect_list("genes"))).alias("genes")
    )


def _emit(codes: list[np.ndarray]) -> pa.RecordBatch:
    code, n = np.unique(np.concatenate(codes), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(code), pa.array(n.astype(np.int32))], ["code", "n"])


def _pair_runs(width: int):
    """Sorted runs of pair codes: each row's ids (sorted ascending) pair its ``width`` first ones with all that follow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            ids = batch.column("ids")
            sizes = ids.value_lengths().to_numpy(zero_copy_only=False)
            flat = ids.flatten().to_numpy(zero_copy_only=False).astype(np.uint64)
            ends = np.cumsum(sizes)
            for s, e in zip(ends - sizes, ends):
                row = flat[s:e]
                m = len(row)
                step = max(1, RUN_CODES // max(m, 1))
                for lo in range(0, min(width, m - 1), step):
                    a = np.arange(lo, min(lo + step, width, m - 1))
                    lens = m - 1 - a
                    left = np.repeat(row[a], lens)
                    at = np.arange(len(left)) - np.repeat(np.cumsum(lens) - lens, lens) + np.repeat(a + 1, lens)
                    held.append(((left << np.uint64(32)) | row[at]).view(np.int64))
                    count += len(left)
                    if count >= RUN_CODES:
                        yield _emit(held)
                        held, count = [], 0
        if held:
            yield _emit(held)

    return run


def spread_slices(numbered: DataFrame, parts: int, width: int) -> DataFrame:
    """ids of every slice of every (scope, record, ids) row, spread over tasks by (scope, record, slice).

    A slice holds its ``width`` first ids and all ids after them. Records of a scope stand
    together, so that a run counts most of a scope's pairs at once.
    """
    cut = numbered.select("scope", "record", "ids", F.explode(F.sequence(F.lit(0), F.size("ids") - 2, F.lit(width))).alias("first"))
    cut = cut.select("scope", "record", "first", F.slice("ids", F.col("first") + 1, F.size("ids")).alias("ids"))
    return cut.repartitionByRange(parts, "scope", "record", "first").select("ids")


def _run_lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add up neighbours of equal code in a sorted stream."""
    last, total = None, 0
    for batch in batches:
        code, n = batch.column("code").to_numpy(), batch.column("n").to_numpy()
        if not len(code):
            continue
        cuts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        keys, sums = code[cuts], np.add.reduceat(n.astype(np.int64), cuts)
        if last is not None:
            if keys[0] == last:
                sums[0] += total
            else:
                keys, sums = np.r_[last, keys], np.r_[total, sums]
        last, total = keys[-1], sums[-1]
        yield pa.RecordBatch.from_arrays([pa.array(keys[:-1]), pa.array(sums[:-1])], ["code", "n_ab"])
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([total], pa.int64())], ["code", "n_ab"])


def pair_counts(records: DataFrame, scope: str, record: str, items: str, least: int, lift: float) -> DataFrame:
    """scope, item_a, item_b, n_ab, n_a, n_b, n_records of the pairs with n_ab >= least that reach the lift."""
    spark = records.sparkSession
    kept = materialize(records.select(F.col(scope).alias("scope"), F.col(record).alias("record"), F.col(items).alias("items")))
    sizes = kept.groupBy("scope").agg(F.count("*").alias("n_records"))
    counts = kept.select("scope", F.explode("items").alias("item")).groupBy("scope", "item").agg(F.count("*").alias("n"))
    usable = counts.where(F.col("n") >= least).join(sizes, "scope").where(F.col("n") * lift <= F.col("n_records"))
    usable = dense_ids(usable, "id")
    if usable._genoloom_rows > CODES:
        raise ValueError(f"{usable._genoloom_rows} usable items; a pair code holds two of {CODES}")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbered = (
        kept.select("scope", "record", F.explode("items").alias("item"))
        .join(usable.select("scope", "item", "id"), ["scope", "item"])
        .groupBy("scope", "record")
        .agg(F.array_sort(F.collect_list("id")).alias("ids"))
        .where(F.size("ids") > 1)
    )
    runs = spread_slices(numbered, parts, SLICE).mapInArrow(_pair_runs(SLICE), "code long, n int")
    summed = runs.repartition(parts, "code").sortWithinPartitions("code").mapInArrow(_run_lengths, "code long, n_ab long")
    summed = summed.where(F.col("n_ab") >= least)
    side = lambda x: usable.select(F.col("id").alias(f"id_{x}"), F.col("item").alias(f"item_{x}"), F.col("n").alias(f"n_{x}"))
    out = (
        summed.select("n_ab", F.shiftrightunsigned("code", 32).alias("id_a"), F.col("code").bitwiseAND(0xFFFFFFFF).alias("id_b"))
        .join(usable.select(F.col("id").alias("id_a"), "scope", F.col("item").alias("item_a"), F.col("n").alias("n_a"), "n_records"), "id_a")
        .join(side("b"), "id_b")
        .where(F.col("n_ab") * F.col("n_records") >= F.lit(lift) * F.col("n_a") * F.col("n_b"))
    )
    swap = F.col("item_a") > F.col("item_b")
    return out.select(
        "scope",
        F.least("item_a", "item_b").alias("item_a"),
        F.greatest("item_a", "item_b").alias("item_b"),
        "n_ab",
        F.when(swap, F.col("n_b")).otherwise(F.col("n_a")).alias("n_a"),
        F.when(swap, F.col("n_a")).otherwise(F.col("n_b")).alias("n_b"),
        "n_records",
    )


def with_odds(pairs: DataFrame) -> DataFrame:
    """Adds the lift and the log odds ratio with its standard error, 0.5 added to every cell."""
    c = {k: F.col(k).cast("double") for k in ("n_ab", "n_a", "n_b", "n_records")}
    both, only_a, only_b = c["n_ab"] + 0.5, c["n_a"] - c["n_ab"] + 0.5, c["n_b"] - c["n_ab"] + 0.5
    none = c["n_records"] - c["n_a"] - c["n_b"] + c["n_ab"] + 0.5
    return (
        pairs.withColumn("lift", c["n_ab"] * c["n_records"] / (c["n_a"] * c["n_b"]))
        .withColumn("odds_ratio", both * none / (only_a * only_b))
        .withColumn("log_odds_se", F.sqrt(1 / both + 1 / only_a + 1 / only_b + 1 / none))
    )


def gene_pairs(programs: DataFrame, runs: DataFrame, least: int = 4, lift: float = 3.0) -> DataFrame:
    """ensemble_id, gene_a, gene_b with their counts, lift and corrected odds ratio."""
    records = program_records(programs, runs)
    found = with_odds(pair_counts(records, "ensemble_id", "program", "genes", least, lift))
    return found.withColumnsRenamed({"scope": "ensemble_id", "item_a": "gene_a", "item_b": "gene_b", "n_records": "n_programs"})
