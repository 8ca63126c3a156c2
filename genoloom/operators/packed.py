"""Programs as arrays of gene numbers: Jaccard of very many pairs is counted in tasks, no pair is a row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from genoloom.operators import sets
from genoloom.runtime import dense_ids, materialize

#: Programs of a block; a task holds two blocks.
BLOCK = 8_192
#: Cells (program, other) that are counted at once.
_CELLS = 1 << 19


def pack(memberships: DataFrame, scope: list[str], key: str) -> tuple[DataFrame, DataFrame]:
    """(scope..., key, genes, pid) with distinct gene numbers, and (gene, id)."""
    rows = materialize(memberships.select(*scope, key, "gene"))
    genes = dense_ids(rows.select("gene").distinct(), "id")
    if genes._genoloom_rows > 1 << 31:
        raise ValueError("more genes than numbers of 32 bits")
    known = F.broadcast(genes) if genes._genoloom_rows <= sets.SMALL_ROWS else genes
    packed = rows.join(known, "gene").groupBy(*scope, key).agg(F.collect_set(F.col("id").cast("int")).alias("genes"))
    return materialize(packed.withColumn("pid", F.monotonically_increasing_id())), genes


class _Postings:
    """Which of some sets hold a gene: flat gene numbers and the size of each set."""

    def __init__(self, flat: np.ndarray, size: np.ndarray) -> None:
        self.n = len(size)
        self.owner = np.repeat(np.arange(self.n), size)
        order = np.argsort(flat, kind="stable")
        self.owner = self.owner[order]
        self.gene, self.start = np.unique(flat[order], return_index=True)
        self.count = np.diff(self.start, append=len(flat))

    def shared(self, flat: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """first, last, counts (last - first rows, a column a set) of the common genes, some rows at a time."""
        ends, step = np.concatenate([[0], np.cumsum(size)]), max(1, _CELLS // max(self.n, 1))
        for a in range(0, len(size), step):
            b = min(len(size), a + step)
            g, row = flat[ends[a] : ends[b]], np.repeat(np.arange(b - a), size[a:b])
            at = np.searchsorted(self.gene, g)
            at[at == len(self.gene)] = 0
            held = self.gene[at] == g if len(self.gene) else np.zeros(len(g), bool)
            at, row = at[held], row[held]
            count = self.count[at]
            before = np.cumsum(count) - count
            where = np.repeat(self.start[at] - before, count) + np.arange(count.sum())
            yield a, b, np.bincount(np.repeat(row, count) * self.n + self.owner[where], minlength=(b - a) * self.n).reshape(b - a, self.n)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def _total(left: tuple, right: tuple) -> float:
    total = 0.0
    for a, b, k in _Postings(*right).shared(*left):
        total += (k / (left[1][a:b, None] + right[1] - k)).sum()
    return float(total)


def redundancy(packed: DataFrame, scope: list[str]) -> DataFrame:
    """scope..., n_sets, redundancy: the mean Jaccard over all pairs of a scope's programs, those without overlap included.

    A scope is cut into blocks of some BLOCK programs; each pair of blocks meets in one task, which gives one number.
    """
    n = packed.groupBy(*scope).agg(F.count("*").alias("n_sets"))
    blocks = n.select(*scope, F.ceil(F.col("n_sets") / BLOCK).cast("int").alias("_n"))
    own = packed.join(blocks, scope).withColumn("_b", F.pmod(F.xxhash64("pid"), F.col("_n")).cast("int"))
    own = own.select(*scope, "_b", "genes", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_o"))
    own = own.select(*scope, F.least("_b", "_o").alias("_lo"), F.greatest("_b", "_o").alias("_hi"), (F.col("_b") > F.col("_o")).alias("_second"), "genes")

    def pairs(table: pa.Table) -> pa.Table:
        second = table.column("_second")
        split = [_lists(table.filter(x).column("genes").combine_chunks()) for x in (pc.invert(second), second)]
        if table.column("_lo")[0].as_py() == table.column("_hi")[0].as_py():
            total = (_total(split[0], split[0]) - len(split[0][1])) / 2  # without the pairs with itself
        else:
            total = _total(*split)
        return table.slice(0, 1).select(scope).append_column("total", pa.array([total], pa.float64()))

    kinds = T.StructType([*(T.StructField(f.name, f.dataType) for f in packed.select(*scope).schema), T.StructField("total", T.DoubleType())])
    total = own.groupBy(*scope, "_lo", "_hi").applyInArrow(pairs, kinds).groupBy(*scope).agg(F.sum("total").alias("total"))
    m = F.col("n_sets")
    return n.join(total, scope, "left").select(*scope, "n_sets", F.coalesce(F.try_divide("total", m * (m - 1) / 2), F.lit(0.0)).alias("redundancy"))


def alignment(packed: DataFrame, genes: DataFrame, references: DataFrame, scope: list[str], by: list[str]) -> DataFrame:
    """scope..., by..., alignment: the mean over a scope's programs of the highest Jaccard to a reference set.

    References of at most SMALL_ROWS memberships go to the programs, larger ones meet them by gene.
    """
    ref = references.join(genes, "gene", "left").select(*by, "set_name", "id")
    if references.limit(sets.SMALL_ROWS + 1).count() > sets.SMALL_ROWS:
        left = packed.select("pid", F.explode("genes").alias("gene"))
        right = references.join(genes.withColumnRenamed("gene", "_name"), F.col("gene") == F.col("_name"), "left").select(*by, "set_name", F.coalesce(F.col("id"), -1 - F.monotonically_increasing_id()).alias("gene"))
        best = sets.overlap(left, right, ["pid"], [*by, "set_name"]).groupBy("pid", *by).agg(F.max("jaccard").alias("j"))
        every = packed.select(*scope, "pid")
        every = every.crossJoin(F.broadcast(references.select(*by).distinct())) if by else every
        return every.join(best, ["pid", *by], "left").groupBy(*scope, *by).agg(F.avg(F.coalesce("j", F.lit(0.0))).alias("alignment"))
    rows = ref.collect()  # at most SMALL_ROWS
    parts = {k: i for i, k in enumerate(dict.fromkeys(tuple(r[c] for c in by) for r in rows))}
    names: dict[tuple, list] = {}
    for r in rows:
        names.setdefault((parts[tuple(r[c] for c in by)], r["set_name"]), []).append(r["id"])
    kept = sorted(names.items(), key=lambda x: x[0][0])
    size = np.array([len(g) for _, g in kept], np.int64)
    flat = np.array([x for _, g in kept for x in g if x is not None], np.int64)
    held = np.array([sum(x is not None for x in g) for _, g in kept], np.int64)
    first = np.flatnonzero(np.diff([p for (p, _), _ in kept], prepend=-1)) if kept else np.empty(0, np.int64)

    def best_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        postings = _Postings(flat, held)
        for batch in batches:
            own = _lists(batch.column("genes"))
            found = [np.maximum.reduceat(k / (own[1][a:b, None] + size - k), first, axis=1) for a, b, k in postings.shared(*own)]
            j = np.concatenate(found) if found else np.empty((0, len(first)))
            out = pa.Table.from_batches([batch.select(scope)]).append_column("j", pa.array(list(j), pa.list_(pa.float64())))
            yield from out.to_batches()

    kinds = T.StructType([*(T.StructField(f.name, f.dataType) for f in packed.select(*scope).schema), T.StructField("j", T.ArrayType(T.DoubleType()))])
    if not kept:
        return packed.select(*scope).distinct().withColumns({**{c: F.lit(None).cast(references.schema[c].dataType) for c in by}, "alignment": F.lit(0.0)})
    best = packed.select(*scope, "genes").mapInArrow(best_of, kinds).select(*scope, F.posexplode("j").alias("_c", "j"))
    out = best.groupBy(*scope, "_c").agg(F.avg("j").alias("alignment"))
    if not by:
        return out.drop("_c")
    kinds = T.StructType([T.StructField("_c", T.IntegerType()), *(references.schema[c] for c in by)])
    named = packed.sparkSession.createDataFrame([(i, *k) for k, i in parts.items()], kinds)
    return out.join(F.broadcast(named), "_c").drop("_c")  # one row a collection


def tables(memberships: DataFrame, references: DataFrame, by: list[str]) -> DataFrame:
    """method, by..., n_programs, redundancy, novelty, specificity, coverage, alignment of every method and part of the references.

    memberships: method, program, gene; references: by..., set_name, gene, each row once.
    """
    packed, genes = pack(memberships, ["method"], "program")
    size = F.size("genes")
    each = packed.select("method", "pid", F.explode("genes").alias("id")).groupBy("method", "id").agg(F.count("*").alias("n"), F.min("pid").alias("pid"))
    each = materialize(each)  # a row a method and gene
    lone = each.where("n = 1").groupBy("pid").agg(F.count("*").alias("k"))
    share = packed.select("method", "pid", size.alias("n")).join(lone, "pid", "left").groupBy("method")
    share = share.agg(F.avg(F.coalesce("k", F.lit(0)) / F.col("n")).alias("specificity"), F.sum("n").alias("_rows"))
    ref = references.select(*by, "gene").distinct()
    n_ref = ref.groupBy(*by).agg(F.count("*").alias("_ref"))
    held = each.join(ref.join(genes, "gene").select(*by, "id"), "id").groupBy("method", *by).agg(F.sum("n").alias("_known"), F.count("*").alias("_held"))
    out = redundancy(packed, ["method"]).withColumnRenamed("n_sets", "n_programs").join(share, "method").crossJoin(F.broadcast(n_ref))  # one row a part
    out = out.join(held, ["method", *by], "left").join(alignment(packed, genes, references, ["method"], by), ["method", *by])
    novelty = 1 - F.coalesce("_known", F.lit(0)) / F.col("_rows")
    coverage = F.coalesce(F.try_divide(F.coalesce("_held", F.lit(0)), F.col("_ref")), F.lit(0.0))
    return out.select("method", *by, "n_programs", "redundancy", novelty.alias("novelty"), "specificity", coverage.alias("coverage"), "alignment")
