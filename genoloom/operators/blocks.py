"""Symmetric weights between very many genes as square blocks of numbers.

Genes are numbered, the numbers cut into sides of equal length, and a block holds the weights
between two sides as arrays. Products with a vector are counted in tasks, block by block; a vector
is one row a side.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoloom.runtime import dense_ids, materialize, release

#: Pairs of a block, about; a task makes one block.
PAIRS = 400_000
#: Genes up to which their numbers and a vector go to every task; those of more genes are joined by shuffle.
WIDE = 1 << 21
#: Change of the vector (of length 1) by another step of ``powers`` at which no more are made.
_STILL = 1e-12


class Blocks(NamedTuple):
    """tiles: a <= b (sides), i, j (numbers within them), w (weights), as bytes; genes: gene, id.

    linked: genes without a weight are not part of the graph.
    """

    tiles: DataFrame
    genes: DataFrame
    count: int
    side: int
    linked: bool


def _sent(df: DataFrame, count: int) -> DataFrame:
    return F.broadcast(df) if count <= WIDE else df


def _numbered(genes: DataFrame) -> DataFrame:
    out = dense_ids(genes.distinct(), "id")
    if out._genoloom_rows > 1 << 31:
        raise ValueError("more genes than a pair code holds")
    return out


def _side(count: int, pairs: int) -> int:
    return max(-(-count // max(int(np.ceil(np.sqrt(2 * pairs / PAIRS))), 1)), 1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """tile, its distinct keys in order, their sums (counts without a value); repeats are summed up as they come."""
    held: dict[int, list] = {}
    rows: dict[int, tuple[int, int]] = {}

    def summed(parts: list) -> tuple[np.ndarray, np.ndarray]:
        keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return keys, np.bincount(at, weights=np.concatenate([v for _, v in parts]), minlength=len(keys))

    for batch in batches:
        tile, key = (batch.column(c).to_numpy() for c in ("tile", "key"))
        value = batch.column("value").to_numpy() if "value" in batch.schema.names else np.ones(len(key))
        for t in np.unique(tile).tolist():
            on = tile == t
            held.setdefault(t, []).append((key[on], value[on]))
            n, most = rows.get(t, (0, 8 * PAIRS))
            n += int(on.sum())
            if n > most:
                held[t] = [summed(held[t])]
                n = len(held[t][0][0])
                most = max(most, 2 * n)
            rows[t] = n, most
    for t in list(held):
        yield t, *summed(held.pop(t))


def _tiles(pairs: DataFrame, count: int, side: int, weigh) -> DataFrame:
    """pairs: tile, key and perhaps value; weigh makes codes (number in a times side, plus number in b) and weights of a tile's sums."""
    n = -(-max(count, 1) // side)
    kind = np.dtype(np.uint16 if side <= 1 << 16 else np.uint32)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile, keys, sums in _sums(batches):
            code, w = weigh(keys, sums)
            b = int((np.sqrt(8 * tile + 1) - 1) / 2)
            data = [(code // side).astype(kind), (code % side).astype(kind), w.astype(np.float64)]
            yield pa.RecordBatch.from_pydict(
                {"a": pa.array([tile - b * (b + 1) // 2], pa.int32()), "b": pa.array([b], pa.int32())} | {c: pa.array([x.tobytes()], pa.binary()) for c, x in zip("ijw", data, strict=True)}
            )

    out = pairs.repartitionById(n * (n + 1) // 2, F.col("tile")).mapInArrow(build, "a int, b int, i binary, j binary, w binary")
    return materialize(out)


def _tile(i: str, j: str, side: int) -> str:
    """Blocks a <= b of numbers i <= j, numbered row by row of the lower triangle."""
    return f"cast(({j} div {side}) * ({j} div {side} + 1) div 2 + {i} div {side} as int)"


def of_edges(edges: DataFrame) -> Blocks:
    """Of (src, dst, weight): repeats add up, an edge of a gene to itself counts in both directions, a null weight is none."""
    e = materialize(edges.select("src", "dst", F.col("weight").cast("double").alias("weight")))
    genes = _numbered(e.select(F.col("src").alias("gene")).unionByName(e.select(F.col("dst").alias("gene"))))
    count, rows = genes._genoloom_rows, e.count()
    side = _side(count, rows)
    known = genes.select("gene", "id")
    x = e.join(_sent(known.toDF("src", "x"), count), "src").join(_sent(known.toDF("dst", "y"), count), "dst")
    x = x.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), F.coalesce("weight", F.lit(0.0)).alias("value"))
    pairs = x.select(F.expr(_tile("x", "y", side)).alias("tile"), F.expr(f"x % {side} * {side} + y % {side}").alias("key"), "value")
    out = Blocks(_tiles(pairs, count, side, lambda keys, sums: (keys, sums)), genes, count, side, False)
    release(e)
    return out


def of_shared(rows: DataFrame, how: str = "mean") -> Blocks:
    """``discover.head_average`` of attention that counts shared units, from rows (unit, layer, head, gene).

    A row looks at every row of its unit with another gene. Units become arrays of gene numbers;
    each pair of a unit is one 64-bit code with its layers and heads, counted and averaged in the block's task.
    """
    rows = rows.where("unit is not null and gene is not null")
    kinds = rows.select("layer", "head").distinct().collect()  # a row a head of the model
    heads = {h: n for n, h in enumerate(dict.fromkeys(r["head"] for r in kinds))}
    kinds = sorted(((heads[r["head"]], r["layer"], r["head"]) for r in kinds), key=lambda k: k[0])
    n_kinds, head_of = max(len(kinds), 1), np.array([k[0] for k in kinds], np.int64)
    named = rows.sparkSession.createDataFrame([(n, *k[1:]) for n, k in enumerate(kinds)], rows.select(F.lit(0).cast("long").alias("_kind"), F.col("layer").alias("_layer"), F.col("head").alias("_head")).schema)
    genes = _numbered(rows.select("gene"))
    count = genes._genoloom_rows
    own = rows.join(_sent(genes.select("gene", "id"), count), "gene").join(F.broadcast(named), F.col("layer").eqNullSafe(F.col("_layer")) & F.col("head").eqNullSafe(F.col("_head")))
    units = materialize(own.groupBy("unit").agg(F.collect_list(F.col("id") * n_kinds + F.col("_kind")).alias("own")).where(F.size("own") > 1).select("own"))
    side = _side(count, units.agg(F.sum(F.size("own").cast("long") * (F.size("own") - 1) / 2)).first()[0] or 0)
    if side * side * n_kinds * n_kinds >= 1 << 62:
        raise ValueError("more genes and heads than a pair code holds")
    pairs = units.select("own", F.explode("own").alias("p")).select("p", F.explode("own").alias("q"))
    pairs = pairs.selectExpr(f"p div {n_kinds} as x", f"q div {n_kinds} as y", f"p % {n_kinds} * {n_kinds} + q % {n_kinds} as kinds").where("x < y")
    pairs = pairs.select(F.expr(_tile("x", "y", side)).alias("tile"), F.expr(f"(x % {side} * {side} + y % {side}) * {n_kinds * n_kinds} + kinds").alias("key"))

    def weigh(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        code, both = keys // n_kinds**2, keys % n_kinds**2
        looks = np.concatenate([2 * code * n_kinds + both // n_kinds, (2 * code + 1) * n_kinds + both % n_kinds])
        looks, at = np.unique(looks, return_inverse=True)
        w = np.bincount(at, weights=np.concatenate([counts, counts]), minlength=len(looks))
        way, head = looks // n_kinds, head_of[looks % n_kinds]

        def first(*keys: np.ndarray) -> np.ndarray:
            return np.flatnonzero(np.logical_or.reduce([np.diff(k, prepend=-1) != 0 for k in keys]))

        def mean(w: np.ndarray, at: np.ndarray) -> np.ndarray:
            return np.add.reduceat(w, at) / np.diff(at, append=len(w))

        at = first(way, head)
        w, way = mean(w, at), way[at]
        at = first(way)
        w, code = mean(w, at) if how == "mean" else np.maximum.reduceat(w, at), way[at] // 2
        at = first(code)
        return code[at], np.add.reduceat(w, at) / 2

    out = Blocks(_tiles(pairs, count, side, weigh), genes, count, side, True)
    release(units)
    return out


def _array(value: pa.Scalar, kind=np.float64) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), kind)


def _binary(x: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes()], pa.binary())


def _product(blocks: Blocks, state: DataFrame, linked: bool) -> DataFrame:
    """side, y = weights times w, w, p, and the sums w y, w w and the largest y of state (side, w, p); linked: w becomes 1 where y is positive, else 0."""
    side, count = blocks.side, blocks.count
    kind = np.dtype(np.uint16 if side <= 1 << 16 else np.uint32)

    def times(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                a, b = batch.column("a")[row].as_py(), batch.column("b")[row].as_py()
                i, j = (_array(batch.column(c)[row], kind) for c in "ij")
                w, wa, wb = (_array(batch.column(c)[row]) for c in ("w", "wa", "wb"))
                for at, to, x in ((a, i, wb[j]), (b, j, wa[i])):
                    y = np.bincount(to, weights=w * x, minlength=min(side, count - at * side))
                    total[at] = total[at] + y if at in total else y
        for at, y in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), _binary(y)], ["side", "y"])

    def gather(parts: pa.Table, own: pa.Table) -> pa.Table:
        w, y = _array(own.column("w")[0]), np.zeros(len(_array(own.column("w")[0])))
        for part in parts.column("y"):
            y += _array(part)
        if linked:
            w = (y > 0).astype(np.float64)
        numbers = {"wy": w @ y, "ww": w @ w, "top": y.max()}
        return pa.table({"side": own.column("side"), "y": _binary(y), "w": _binary(w), "p": own.column("p")} | {k: pa.array([float(v)]) for k, v in numbers.items()})

    vector = state.select("side", "w")
    x = blocks.tiles.join(_sent(vector.toDF("a", "wa"), count), "a").join(_sent(vector.toDF("b", "wb"), count), "b")
    parts = x.select("a", "b", "i", "j", "w", "wa", "wb").mapInArrow(times, "side int, y binary")
    out = parts.groupBy("side").cogroup(state.groupBy("side")).applyInArrow(gather, "side int, y binary, w binary, p binary, wy double, ww double, top double")
    return materialize(out)


def _next(step: DataFrame, size: float, a: float, before: float) -> DataFrame:
    """State of the next step: p = w / size, w = y / size - a p - before (the old p)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                y, w, p = (_array(batch.column(c)[row]) for c in "ywp")
                now = w / size
                yield pa.RecordBatch.from_arrays([batch.column("side").slice(row, 1), _binary(y / size - a * now - before * p), _binary(now)], ["side", "w", "p"])

    return step.select("side", "y", "w", "p").mapInArrow(run, "side int, w binary, p binary")


def powers(blocks: Blocks, times: int) -> DataFrame:
    """gene, x: (1 + A / top)^times of the vector of ones, to length 1; A the weights, top their largest sum of a gene.

    Lanczos: one product with A for each step, and the power of the small matrix of its numbers
    instead of A's. It ends when the result moves by less than 1e-12 in two steps together, or after
    ``times`` products, when it is the power itself.
    """
    spark, side, count = blocks.tiles.sparkSession, blocks.side, blocks.count

    def ones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in batch.column("side").to_pylist():
                n = min(side, count - at * side)
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), _binary(np.ones(n)), _binary(np.zeros(n))], ["side", "w", "p"])

    state = spark.range(-(-count // side)).select(F.col("id").cast("int").alias("side")).mapInArrow(ones, "side int, w binary, p binary")
    own, sizes, steps, top, result, still = [], [], [], 1.0, np.zeros(0), 0
    for n in range(times + 1):
        step = _product(blocks, state, blocks.linked and n == 0)
        wy, ww, largest = step.agg(F.sum("wy"), F.sum("ww"), F.max("top")).first()
        size = float(np.sqrt(ww or 0.0))
        if n == 0:
            top = largest or 1.0
        if size <= 1e-14 * (abs(top) if n else 1.0):  # nothing new: the steps so far hold the result
            release(step)
            break
        own.append(wy / ww)
        sizes.append(size)
        steps.append(step)
        values, vectors = np.linalg.eigh(np.diag(own) + np.diag(sizes[1:], 1) + np.diag(sizes[1:], -1))
        factor = 1 + values / top
        new = vectors @ ((factor / np.abs(factor).max()) ** times * vectors[0])
        new /= np.linalg.norm(new)
        still = still + 1 if np.linalg.norm(new - np.append(result, 0.0)) < _STILL else 0
        result = new
        if still == 2:
            break
        state = _next(step, size, own[-1], size if n else 0.0)
    if not steps:
        return blocks.genes.select("gene", F.lit(0.0).alias("x")).limit(0)
    kept = []
    for n in range(len(steps) - 1, -1, -2):  # a step has the vector before its own as well
        kept.append(steps[n].select("side", "w", "p", F.lit(n).alias("n"), F.lit(float(result[n] / sizes[n])).alias("cw"), F.lit(float(result[n - 1]) if n else 0.0).alias("cp")))
    linked = blocks.linked

    def add(parts: pa.Table) -> pa.Table:
        cw, cp = parts.column("cw").to_pylist(), parts.column("cp").to_pylist()
        x = sum(cw[n] * _array(parts.column("w")[n]) + cp[n] * _array(parts.column("p")[n]) for n in range(parts.num_rows))
        n = parts.column("n").to_pylist()
        start = _array(parts.column("w")[n.index(0)] if 0 in n else parts.column("p")[n.index(1)])
        there = np.flatnonzero(start) if linked else np.arange(len(x))
        return pa.table({"id": pa.array(there.astype(np.int64) + parts.column("side")[0].as_py() * side), "x": pa.array(x[there])})

    every = kept[0]
    for one in kept[1:]:
        every = every.unionByName(one)
    x = every.groupBy("side").applyInArrow(add, "id long, x double")
    out = materialize(x.join(blocks.genes.select("gene", "id"), "id").select("gene", "x"))
    release(*steps)
    return out
