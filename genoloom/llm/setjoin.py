"""All pairs of similar sets by a forest of sorted minhash sketches.

Equal sets are one class first, so copies are compared once. Every class gets a label of DEPTH
16-bit minhashes in each of TREES independent trees. A tree is the lexicographic order of its
labels: classes with a common prefix stand together at every depth. The forest is sorted and
written once, as rows of neighbourhoods at the shortest prefix that can be needed.

The search starts LEVELS below that, at longer prefixes, and goes up the trees level by level: a
pass over the written neighbourhoods compares the classes whose common prefix in a tree ends at
the level, and verifies them by the exact Jaccard of their sets. After each level the recall is
measured on what was found: a pair of Jaccard s is met with the chance p = 1 - (1 - s^d)^TREES,
so each pair found stands for (1 - p) / p pairs missed, and one pair at the threshold, found or
not, is always counted in. The search ends when found / (found + missed) reaches TARGET, at the
latest at the level where even pairs exactly at the threshold reach it.

Neighbourhoods of up to SMALL classes give their pairs to a join with the sets; a pair met in
several trees is the same row there, and what it costs is bounded by SMALL. Larger ones carry the
sets' item hashes: the task verifies the pairs itself, and from the sketches, which it works out
again, it knows whether a pair was met at a longer prefix or in an earlier tree, so repeats never
leave the task. A neighbourhood that more than BLOCK classes share is cut by the rarest
items of the sets first, if that parts it (two sets at the threshold share an item of their prefixes in one common
order; the first shared one counts), and what is still larger into blocks, all pairs of which are compared in separate tasks. So
no task holds an unbounded group and no pair is lost.

Defined cases: names are cleaned, blank entries and repeats dropped; an empty or null list is an
empty set, which is similar to nothing, not even to another empty set; an id that comes again
has the union of its entries; a set of any length is one sketch; empty tables give no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoloom.runtime import SPACES, clean_gene, dense_ids, materialize, pick

TREES, DEPTH, SEED = 48, 8, 20_240_611
#: Levels below the last one at which the search begins.
LEVELS = 2
#: Members of one neighbourhood that one task compares, and up to which its pairs are verified by a join.
BLOCK, SMALL = 2_000, 64
TARGET = 0.99999


def chance(similarity: float, depth: int, trees: int = TREES) -> float:
    """How likely a pair shares a prefix of the depth in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def search_depth(threshold: float, trees: int = TREES, target: float = TARGET) -> int:
    """The longest prefix at which a pair at the threshold is met with the target chance: the last level."""
    return next((d for d in range(DEPTH, 1, -1) if chance(threshold, d, trees) >= target), 1)


def listed_sets(lists: DataFrame, reference: DataFrame) -> DataFrame:
    """id, is_list, items: the distinct clean genes of every list and reference set, sorted."""
    entry = lambda x: F.nullif(F.upper(F.trim(x, F.lit(SPACES))), F.lit(""))
    one = F.array_distinct(F.array_compact(F.transform(F.split("genes", ","), entry)))
    a = pick(lists, ["list_id", "genes"]).where("list_id is not null")
    a = a.groupBy(F.col("list_id").alias("id")).agg(F.array_distinct(F.flatten(F.collect_list(one))).alias("items"))
    b = pick(reference, ["set_id", "gene"]).where("set_id is not null")
    b = b.groupBy(F.col("set_id").alias("id")).agg(F.collect_set(clean_gene("gene")).alias("items"))
    both = a.withColumn("is_list", F.lit(True)).unionByName(b.withColumn("is_list", F.lit(False)))
    return both.select("id", "is_list", F.array_sort("items").alias("items"))


def set_classes(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(class_id, items, has_list) of the distinct non-empty sets, and (id, is_list, class_id) of all members."""
    key = F.sha2(F.concat_ws("\x1f", "items"), 256)
    kept = materialize(sets.where(F.size("items") > 0).withColumn("key", key))
    classes = kept.groupBy("key").agg(F.max("is_list").alias("has_list"), F.first("items").alias("items"))
    classes = dense_ids(classes, "class_id")
    members = kept.join(classes.select("key", "class_id"), "key").select("id", "is_list", "class_id")
    return classes.select("class_id", "has_list", "items"), members


def _hashing() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    n = TREES * DEPTH
    odd = lambda: (rng.integers(1, 2**63, n, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
    return odd(), rng.integers(0, 2**63, n, dtype=np.uint64), odd()


_MULT, _ADD, _LAST = _hashing()


def sketch(flat: np.ndarray, starts: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """(set, tree, level) minhashes of the sets that begin at ``starts`` of the item hashes, 16 bits each."""
    out = np.empty((len(starts), TREES, depth), np.uint16)
    for t in range(TREES):
        for d in range(depth):
            j = t * DEPTH + d
            v = flat * _MULT[j] + _ADD[j]
            v ^= v >> np.uint64(29)
            least = np.minimum.reduceat((v * _LAST[j]) >> np.uint64(32), starts)
            # the smallest of 32 bits is small for large sets, so it is mixed once more before it is cut
            out[:, t, d] = (least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)
    return out


def _flat(hashes: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = hashes.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return hashes.flatten().to_numpy().view(np.uint64), sizes, np.cumsum(sizes) - sizes


def _labels(depth: int):
    """One row for each class and tree; a label is the tree and the big-endian minhashes, so its byte order is the tree's order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1_000):
                part = batch.slice(lo, 1_000)
                flat, sizes, starts = _flat(part.column("hashes"))
                m, n, width = len(sizes), len(sizes) * TREES, 1 + 2 * depth
                label = np.empty((m, TREES, width), np.uint8)
                label[:, :, 0] = np.arange(TREES, dtype=np.uint8)
                label[:, :, 1:] = sketch(flat, starts, depth).astype(">u2").view(np.uint8).reshape(m, TREES, 2 * depth)
                ends = pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32))
                row = pa.array(np.repeat(np.arange(m), TREES))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.Array.from_buffers(pa.binary(), n, [None, ends, pa.py_buffer(label.tobytes())]),
                        part.column("class_id").take(row),
                        pa.array(np.repeat(sizes.astype(np.int32), TREES)),
                        part.column("has_list").take(row),
                    ],
                    ["label", "class_id", "size", "has_list"],
                )

    return run


LABELS = "label binary, class_id long, size int, has_list boolean"
#: A neighbourhood: its members in the order of the tree.
NODE = "labels array<binary>, ids array<long>, sizes array<int>, lists array<boolean>, sides array<int>, befores array<array<long>>"
PAIRS = 1 << 21


def _nodes(depth: int, cut: bool):
    """Neighbourhoods of a sorted stream, one row each; those that can't hold a pair are left out.

    A neighbourhood is a run of equal prefixes of the depth; in a stream that is ``cut``, of equal
    (prefix, item, pair).
    """
    names = ("label", "class_id", "size", "has_list", "side", "before")

    def rows(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Neighbourhoods that begin at ``starts``; the last one ends with the table."""
        if not len(starts):
            return
        lens = np.diff(np.r_[starts, table.num_rows])
        with_list = np.add.reduceat(table.column("has_list").to_numpy().astype(np.int64), starts)
        use = (lens > 1) & (with_list > 0)
        if not use.any():
            return
        table = table.filter(pa.array(np.repeat(use, lens)))
        if not cut:
            table = table.append_column("side", pa.array(np.full(table.num_rows, 2, np.int32))).append_column("before", pa.nulls(table.num_rows, pa.list_(pa.int64())))
        ends = pa.array(np.r_[0, np.cumsum(lens[use])].astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, table.column(c).combine_chunks()) for c in names]
        yield pa.RecordBatch.from_arrays(lists, ["labels", "ids", "sizes", "lists", "sides", "befores"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table]).combine_chunks()
            if not table.num_rows:
                continue
            prefix = _bytes(table.column("label").combine_chunks())[:, : 1 + 2 * depth]
            new = np.r_[True, (prefix[1:] != prefix[:-1]).any(1)]
            for c in ("item", "pair") if cut else ():
                x = table.column(c).to_numpy()
                new[1:] |= x[1:] != x[:-1]
            starts = np.flatnonzero(new)
            held = table.slice(int(starts[-1]))  # the last run may go on
            yield from rows(table.slice(0, int(starts[-1])), starts[:-1])
        if held is not None:
            yield from rows(held, np.zeros(1, np.int64))

    return run


def _bytes(labels: pa.Array) -> np.ndarray:
    """(label, byte); labels are of one length and never null."""
    ends = np.frombuffer(labels.buffers()[1], np.int32)[labels.offset : labels.offset + len(labels) + 1]
    return np.frombuffer(labels.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(len(labels), -1)


def _codes(labels: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(tree, minhashes) of the labels."""
    raw = _bytes(labels)
    return raw[:, 0].astype(np.int64), np.ascontiguousarray(raw[:, 1:]).view(">u2").astype(np.uint16)


def _within(node: np.ndarray, codes: np.ndarray, size: np.ndarray, lists: np.ndarray, side: np.ndarray, depth: int, deepest: bool, threshold: float):
    """(i, j) of the members whose common prefix ends at the depth (or later, at the first level), PAIRS at a time.

    Members of a node stand in the order of its tree, so a common prefix is a run of neighbours. Within
    a run they are put in the order of size: the partners of i end where size passes size_i / threshold.
    """
    same = np.r_[False, node[1:] == node[:-1]]
    runs = [np.cumsum(~(same & np.r_[False, (codes[1:, :d] == codes[:-1, :d]).all(1)])) for d in (depth, depth + 1)]
    order = np.lexsort((size, runs[0]))
    run, deeper, s = runs[0][order], runs[1][order], size[order].astype(np.int64)
    wide = int(s.max()) * 2 + 2
    most = np.minimum(np.floor(s / threshold + 1e-9).astype(np.int64), wide - 1)
    lens = np.maximum(np.searchsorted(run * wide + s, run * wide + most, side="right") - np.arange(len(s)) - 1, 0)
    ends = np.cumsum(lens)
    lo = 0
    while lo < len(lens):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, side="right")))
        n = lens[lo:hi]
        x = np.repeat(np.arange(lo, hi), n)
        y = np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n) + x + 1
        i, j = order[x], order[y]
        use = (lists[i] | lists[j]) & ((side[i] != side[j]) | (side[i] == 2))
        if not deepest:
            use &= deeper[x] != deeper[y]
        if use.any():
            yield i[use], j[use]
        lo = hi


def _candidates(threshold: float, depth: int, deepest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lens = batch.column("ids").value_lengths().to_numpy(zero_copy_only=False)
            if not len(lens):
                continue
            codes = _codes(batch.column("labels").flatten())[1]
            ids, size, side = (batch.column(c).flatten().to_numpy() for c in ("ids", "sizes", "sides"))
            lists = batch.column("lists").flatten().to_numpy(zero_copy_only=False)
            for i, j in _within(np.repeat(np.arange(len(lens)), lens), codes, size, lists, side, depth, deepest, threshold):
                a, b = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
                pairs = np.unique(np.stack([a, b]), axis=1) if len(a) else np.zeros((2, 0), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    return run


def _keys(sketches: np.ndarray, depth: int) -> np.ndarray:
    """(set, tree) keys of the prefixes of a depth: exact up to four levels, mixed beyond."""
    key = np.zeros(sketches.shape[:2], np.uint64)
    for d in range(depth):
        if d >= 4:
            key = (key ^ (key >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            key = key ^ sketches[:, :, d]
        else:
            key = (key << np.uint64(16)) | sketches[:, :, d]
    return key


def _overlaps(flat: np.ndarray, sizes: np.ndarray, starts: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """|x ∩ y| of the sets at the places i, j."""
    rec = np.repeat(np.arange(len(sizes)), sizes)
    _, item, df = np.unique(flat, return_inverse=True, return_counts=True)
    often = df > 1
    local = np.cumsum(often) - 1
    v = int(often.sum())
    if v and len(sizes) * v <= 1 << 24 and len(sizes) ** 2 * v < len(i) * sizes.mean() * 500:
        m = np.zeros((len(sizes), v), np.float32)
        kept = often[item]
        m[rec[kept], local[item[kept]]] = 1
        return (m @ m.T)[i, j].astype(np.int64)
    held = np.sort(rec * len(df) + item)  # sorted: membership by binary search
    out = np.zeros(len(i), np.int64)
    step = max(1, 4_000_000 // max(int(sizes.max()), 1))
    by_set = held - rec * len(df)
    for lo in range(0, len(i), step):
        x, y = i[lo : lo + step], j[lo : lo + step]
        x, y = np.where(sizes[x] <= sizes[y], x, y), np.where(sizes[x] <= sizes[y], y, x)
        n = sizes[x]
        ends = np.cumsum(n)
        at = np.arange(ends[-1]) - np.repeat(ends - n - starts[x], n)
        want = np.repeat(y, n) * len(df) + by_set[at]
        found = np.searchsorted(held, want)
        out[lo : lo + step] = np.add.reduceat((held[np.minimum(found, len(held) - 1)] == want).astype(np.int64), ends - n)
    return out


def _verified(threshold: float, depth: int, deepest: bool):
    """a, b, k, t of the pairs at the threshold that no earlier level, tree or rare item of a node has met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                labels, ids, lists, side, befores, hashes = (batch.column(c)[r].values for c in ("labels", "ids", "lists", "sides", "befores", "hashes"))
                tree, codes = _codes(labels)
                flat, sizes, starts = _flat(hashes)
                ids, lists, side = ids.to_numpy(), lists.to_numpy(zero_copy_only=False), side.to_numpy()
                sketches = sketch(flat, starts, depth if deepest else depth + 1)
                here, below = _keys(sketches, depth), None if deepest else _keys(sketches, depth + 1)
                cut = befores.null_count == 0 and _flat(befores)
                for i, j in _within(np.zeros(len(ids), np.int64), codes, sizes, lists, side, depth, deepest, threshold):
                    for t in range(int(tree[0])):
                        fresh = here[i, t] != here[j, t]
                        i, j = i[fresh], j[fresh]
                    for t in () if deepest else range(int(tree[0]) + 1, TREES):
                        fresh = below[i, t] != below[j, t]
                        i, j = i[fresh], j[fresh]
                    if cut:
                        fresh = (cut[1][i] == 0) | (cut[1][j] == 0)
                        fresh[~fresh] = _overlaps(*cut, i[~fresh], j[~fresh]) == 0
                        i, j = i[fresh], j[fresh]
                    if not len(i):
                        continue
                    k, total = _overlaps(flat, sizes, starts, i, j), sizes[i] + sizes[j]
                    good = k >= np.round(threshold * (total - k), 9)
                    a, b = ids[i[good]], ids[j[good]]
                    columns = (np.minimum(a, b), np.maximum(a, b), k[good].astype(np.int32), total[good].astype(np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b", "k", "t"])

    return run


def blocked(entries: DataFrame, key: str, unit: str, limit: int = BLOCK) -> DataFrame:
    """Adds (pair, side): rows of a key with more than ``limit`` rows meet in pairs of blocks.

    side 2: all rows of the group meet each other; sides 0 and 1: only rows of unlike sides do.
    """
    heavy = entries.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > limit).select(key, F.ceil(F.col("n") / limit).cast("int").alias("_nb"))
    heavy = materialize(heavy)
    if heavy.isEmpty():
        return entries.withColumn("pair", F.lit(0)).withColumn("side", F.lit(2))
    df = entries.join(heavy, key, "left").withColumn("_b", F.pmod(F.xxhash64(unit), F.col("_nb")).cast("int"))
    other = F.explode(F.when(F.col("_nb").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("_nb") - 1)))
    df = df.withColumn("_o", other)
    lo, hi = F.least("_b", "_o"), F.greatest("_b", "_o")
    return (
        df.withColumn("pair", F.coalesce(lo * F.col("_nb") + hi, F.lit(0)))
        .withColumn("side", F.when(F.col("_nb").isNull() | (F.col("_b") == F.col("_o")), 2).when(F.col("_b") < F.col("_o"), 0).otherwise(1))
        .drop("_nb", "_b", "_o")
    )


def forest(classes: DataFrame, threshold: float, depth: int, deepest: int) -> DataFrame:
    """The neighbourhoods (NODE) of all trees at a prefix of the depth, written."""
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    labels = materialize(classes.select("class_id", "has_list", "hashes").repartition(parts).mapInArrow(_labels(deepest), LABELS))
    prefix = F.substring("label", 1, 1 + 2 * depth)
    heavy = materialize(labels.groupBy(prefix.alias("prefix")).agg(F.count("*").alias("n")).where(F.col("n") > BLOCK))
    if heavy.isEmpty():
        return materialize(labels.repartition(parts, prefix).sortWithinPartitions("label", "class_id").mapInArrow(_nodes(depth, False), NODE))
    light = labels.join(heavy, prefix == F.col("prefix"), "left_anti")
    light = light.repartition(parts, prefix).sortWithinPartitions("label", "class_id").mapInArrow(_nodes(depth, False), NODE)
    # by rarest items: size - ceil(threshold * size) + 1 of them hold one that two sets at the threshold share
    own = labels.join(heavy.select("prefix"), prefix == F.col("prefix"))
    cut = own.join(rare_items(classes, threshold), "class_id").select("prefix", *labels.columns, "rare", F.posexplode("rare").alias("at", "item"))
    cut = cut.withColumn("before", F.slice("rare", F.lit(1), F.col("at"))).drop("rare", "at")
    # where the sets are alike, their rare items part nothing: then the neighbourhood goes to blocks as it is
    work = cut.groupBy("prefix", "item").agg(F.count("*").alias("m")).groupBy("prefix").agg(F.sum(F.col("m") * F.col("m")).alias("work"))
    kind = materialize(heavy.join(work, "prefix").select("prefix", (F.col("work") * 2 >= F.col("n") * F.col("n")).alias("alike")))
    cut = cut.join(kind.where("not alike"), "prefix", "left_semi")
    alike = own.join(kind.where("alike"), "prefix", "left_semi").withColumn("item", F.lit(0).cast("long")).withColumn("before", F.lit(None).cast("array<long>"))
    cut = cut.unionByName(alike.select(*cut.columns))
    cut = blocked(cut.withColumn("key", F.xxhash64("prefix", "item")), "key", "class_id").drop("key")
    cut = cut.repartition(parts, "prefix", "item", "pair").sortWithinPartitions("prefix", "item", "pair", "label", "class_id").drop("prefix")
    return materialize(light.unionByName(cut.mapInArrow(_nodes(depth, True), NODE)))


@contextmanager
def long_rows(spark) -> Iterator[None]:
    """For plans over rows of some MB: read one by one, and handed to Python a few at a time."""
    wanted = {"spark.sql.parquet.enableNestedColumnVectorizedReader": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": "16"}
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def rare_items(classes: DataFrame, threshold: float) -> DataFrame:
    """class_id, rare: the prefix of each set in the order of rarity (then of hash), as hashes."""
    held = classes.select("class_id", F.size("hashes").alias("size"), F.explode("hashes").alias("hash"))
    df = held.groupBy("hash").agg(F.count("*").alias("df"))
    by_set = held.join(df, "hash").groupBy("class_id").agg(F.first("size").alias("size"), F.array_sort(F.collect_list(F.struct("df", "hash"))).alias("all"))
    keep = F.col("size") - F.ceil(F.lit(threshold) * F.col("size") - F.lit(1e-9)).cast("int") + 1
    return by_set.select("class_id", F.slice(F.col("all.hash"), F.lit(1), keep).alias("rare"))


def with_hashes(nodes: DataFrame, classes: DataFrame) -> DataFrame:
    """The nodes with their members' item hashes beside the ids; written."""
    numbered = materialize(nodes.withColumn("node", F.monotonically_increasing_id()))
    members = numbered.select("node", F.posexplode("ids").alias("at", "class_id"))
    sets = members.join(classes.select("class_id", "hashes"), "class_id")
    sets = sets.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("at", "hashes"))).alias("x"))
    return materialize(numbered.join(sets, "node").select(*nodes.columns, F.col("x.hashes").alias("hashes")))


def similar_classes(classes: DataFrame, threshold: float) -> DataFrame:
    """class_a < class_b, jaccard of all pairs of distinct sets of which one has a list."""
    spark = classes.sparkSession
    hashed = materialize(classes.select("class_id", "has_list", "items", F.transform("items", lambda x: F.xxhash64(x)).alias("hashes")))
    last = search_depth(threshold)
    first = min(last + LEVELS, DEPTH)
    nodes = forest(hashed, threshold, last, first)
    small, large = nodes.where(F.size("ids") <= SMALL), nodes.where(F.size("ids") > SMALL)
    with long_rows(spark):
        large = None if large.isEmpty() else with_hashes(large, hashed)
    sets, found = hashed.select("class_id", "items"), []
    enough = lambda: F.col("k") >= F.round(F.lit(threshold) * (F.col("t") - F.col("k")), 9)  # noqa: E731  no division that could round a pair at the threshold away
    for depth in range(first, last - 1, -1):
        met = small.mapInArrow(_candidates(threshold, depth, depth == first), "a long, b long").repartition("a").distinct()
        met = met.join(sets.withColumnsRenamed({"class_id": "a", "items": "x"}), "a").join(sets.withColumnsRenamed({"class_id": "b", "items": "y"}), "b")
        met = met.select("a", "b", F.size(F.array_intersect("x", "y")).alias("k"), (F.size("x") + F.size("y")).alias("t")).where(enough())
        found.append(materialize(met))
        if large is not None:
            with long_rows(spark):
                found.append(materialize(large.mapInArrow(_verified(threshold, depth, depth == first), "a long, b long, k int, t int")))
        pairs = found[0]
        for more in found[1:]:
            pairs = pairs.unionByName(more)
        pairs = pairs.repartition("a").dropDuplicates(["a", "b"])
        if depth > last and measured_recall(pairs, threshold, depth) >= TARGET:
            break
    jaccard = F.col("k") / (F.col("t") - F.col("k"))
    return pairs.select(F.col("a").alias("class_a"), F.col("b").alias("class_b"), jaccard.alias("jaccard"))


def measured_recall(pairs: DataFrame, threshold: float, depth: int) -> float:
    """found / (found + missed) at a level, from the exact similarities of the pairs found."""
    p = 1 - F.pow(1 - F.pow(F.col("k") / (F.col("t") - F.col("k")), F.lit(depth)), F.lit(TREES))
    n, missed = pairs.agg(F.count("*"), F.coalesce(F.sum((1 - p) / p), F.lit(0.0))).first()
    p = chance(threshold, depth)
    return (n + 1) / (n + 1 + missed + (1 - p) / p)


def similar_sets(lists: DataFrame, reference: DataFrame, threshold: float = 0.6) -> DataFrame:
    """id_a < id_b, jaccard of all pairs of sets at the threshold, at least one of them a list."""
    classes, members = set_classes(listed_sets(lists, reference))
    pairs = similar_classes(classes, threshold)
    m = members.select("class_id", "id", "is_list")
    left = m.withColumnsRenamed({"class_id": "class_a", "id": "u", "is_list": "lu"})
    right = m.withColumnsRenamed({"class_id": "class_b", "id": "v", "is_list": "lv"})
    across = pairs.join(left, "class_a").join(right, "class_b").where("lu or lv").select("u", "v", "jaccard")
    within = left.join(right, F.col("class_a") == F.col("class_b")).where("u < v and (lu or lv)").select("u", "v", F.lit(1.0).alias("jaccard"))
    return across.unionByName(within).select(F.least("u", "v").alias("id_a"), F.greatest("u", "v").alias("id_b"), "jaccard")


def set_summary(lists: DataFrame, reference: DataFrame, threshold: float = 0.6) -> DataFrame:
    """id, class_id, n_copies, n_links: one row for each set, copies not expanded into pairs."""
    classes, members = set_classes(listed_sets(lists, reference))
    pairs = similar_classes(classes, threshold)
    n = members.groupBy("class_id").agg(F.count("*").alias("n_copies"))
    ends = pairs.select("class_a", "class_b").union(pairs.select("class_b", "class_a")).toDF("class_id", "other")
    links = ends.groupBy("class_id").agg(F.count("*").alias("n_links"))
    out = members.join(n, "class_id").join(links, "class_id", "left")
    return out.select("id", "is_list", "class_id", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))
