"""Clusters of like records by distributed k-means over hashed weighted features.

A record is a set of items. Equal sets are one class. A class is the vector of its items, each
hashed to one of DIMS signed places with the weight ln(N / n), where n is the number of records
that hold the item's bucket; vectors have length 1. Seeding is parallel and oversampled: in each
of ROUNDS passes every class joins the candidates with a chance in proportion to its squared
distance to the candidates so far, about k a pass; candidates, weighted by the classes next to
them, are thinned to k on the driver. LLOYD passes of Lloyd's algorithm follow. k is K_FACTOR
times the root of the number of classes, K_MOST at most, so what the driver and a broadcast hold
is bounded and a pass is linear in the classes.

A k-means cell alone would cut through groups of like records at its border, so every class goes
into the PROBES cells of its nearest centroids. Within a cell, records of Jaccard >= ``threshold``
are found exactly (prefix filter, then exact intersection), and a cell gives only the links that
span its groups. A cell of more than BLOCK classes is divided by minhashes first (SPLITS entries
for each class, whatever the cell's size). Pairs that share no cell are found by a second, complete
search: two sets at the threshold share an item of their prefixes in one common order, so classes
of unlike groups meet by the buckets of their prefix items; an item that stands in the shorter
prefix of no set (the one that suffices for the smaller set of a pair) connects nothing. Buckets
of more than BLOCK entries are compared in pairs of blocks. Groups that are connected over cells or
buckets, through a chain too, are one cluster. The links come to no driver: components are
contracted with DataFrame joins, each round written to the shared folder.

Typical members are those nearest the centroid of their cluster: the highest sum over their items of
the weighted unit vector of the member times the sum of those vectors over the cluster.

Defined cases: rows with a null or blank name or item do not count, repeats count once; records
without items have no cluster; records with equal sets are in one cluster; a record like no
other is a cluster of one; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genoloom.llm.setjoin import blocked
from genoloom.runtime import clean_gene, clean_name, dense_ids, materialize, pick, release

DIMS, WEIGHTS = 256, 1 << 16
K_FACTOR, ROUNDS, LLOYD, PROBES, SEED = 3.0, 2, 3, 4, 97
#: Bounds k: broadcasts of at most 2 MB, and the thinning on the driver.
K_MOST = 2_048
BLOCK, SPLITS = 3_000, 2
ROWS = 4_096
SLOTS, BUCKET = 1 << 18, 1_000


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = x.astype(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(ids: np.ndarray, seed: int) -> np.ndarray:
    return (_mix(ids, seed) >> np.uint64(11)).astype(np.float64) / 2.0**53


def vectors(hashes: pa.ListArray, weights: np.ndarray) -> np.ndarray:
    sizes = hashes.value_lengths().to_numpy(zero_copy_only=False)
    h = hashes.flatten().to_numpy().view(np.uint64)
    place = ((h >> np.uint64(20)) % np.uint64(DIMS)).astype(np.int64)
    sign = np.where((h >> np.uint64(50)) & np.uint64(1), 1.0, -1.0)
    row = np.repeat(np.arange(len(sizes)), sizes)
    x = np.bincount(row * DIMS + place, weights=sign * weights[(h % np.uint64(WEIGHTS)).astype(np.int64)], minlength=len(sizes) * DIMS)
    x = x.reshape(len(sizes), DIMS).astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _blocks(batches: Iterator[pa.RecordBatch], weights) -> Iterator[tuple[np.ndarray, np.ndarray, pa.RecordBatch]]:
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            part = batch.slice(lo, ROWS)
            yield part.column("class_id").to_numpy(), vectors(part.column("hashes"), weights.value), part


class KMeans:
    """Centroids over a written table of (class_id, hashes)."""

    def __init__(self, classes: DataFrame, n_classes: int, k: int | None = None):
        self.classes, self.n = classes, n_classes
        self.spark = classes.sparkSession
        self.k = max(1, min(n_classes, k or min(K_MOST, round(K_FACTOR * n_classes**0.5))))
        bucket = F.pmod("hash", F.lit(WEIGHTS)).cast("int")  # of the signed hash; equal to the unsigned rest as 2^16 divides 2^64
        counts = classes.select(F.explode("hashes").alias("hash")).groupBy(bucket.alias("b")).agg(F.count("*").alias("n"))
        weights = np.full(WEIGHTS, np.log(n_classes + 1.0))
        for b, n in counts.collect():  # at most WEIGHTS rows
            weights[b] = np.log((n_classes + 1.0) / min(n, n_classes + 0.5))
        self.weights = self.spark.sparkContext.broadcast(np.maximum(weights, 0.01))
        self.centroids = self._thin(*self._seed())
        for _ in range(LLOYD):
            self._lloyd()

    def _chosen(self, df: DataFrame) -> np.ndarray:
        """The vectors of a few sampled classes."""
        rows = sorted((r["class_id"], r["hashes"]) for r in df.collect())
        return vectors(pa.array([h for _, h in rows], pa.list_(pa.int64())), self.weights.value) if rows else np.zeros((0, DIMS), np.float32)

    def _distances(self, centers: np.ndarray):
        """Sum of squared distances to the nearest of the centers."""
        shared, weights = self.spark.sparkContext.broadcast(centers), self.weights

        def run(batches):
            total = 0.0
            for _, x, _ in _blocks(batches, weights):
                total += float(np.maximum(2 - 2 * (x @ shared.value.T).max(1), 0).sum())
            yield pa.RecordBatch.from_arrays([pa.array([total])], ["d"])

        return shared, self.classes.mapInArrow(run, "d double").agg(F.sum("d")).collect()[0][0]

    def _seed(self) -> tuple[np.ndarray, np.ndarray]:
        weights, k = self.weights, self.k
        centers = self._chosen(self.classes.orderBy(F.xxhash64("class_id", F.lit(SEED))).limit(1))
        for r in range(ROUNDS):
            shared, total = self._distances(centers)
            if not total:
                break

            def sample(batches, r=r, shared=shared, total=total):
                for ids, x, part in _blocks(batches, weights):
                    d = np.maximum(2 - 2 * (x @ shared.value.T).max(1), 0)
                    take = _uniform(ids, SEED + r) < k * d / total
                    if take.any():
                        yield part.filter(pa.array(take))

            more = self._chosen(self.classes.mapInArrow(sample, "class_id long, hashes array<long>"))
            centers = np.concatenate([centers, more])
        shared = self.spark.sparkContext.broadcast(centers)

        def near(batches):
            n = np.zeros(len(shared.value), np.int64)
            for _, x, _ in _blocks(batches, weights):
                n += np.bincount((x @ shared.value.T).argmax(1), minlength=len(n))
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(n[used])], ["c", "n"])

        mass = np.zeros(len(centers))
        for c, n in self.classes.mapInArrow(near, "c int, n long").groupBy("c").agg(F.sum("n")).collect():  # one row a candidate
            mass[c] = n
        return centers, mass

    def _thin(self, centers: np.ndarray, mass: np.ndarray) -> np.ndarray:
        """k of the candidates by weighted k-means++."""
        if len(centers) <= self.k:
            return centers
        rng = np.random.default_rng(SEED)
        chosen = [int(mass.argmax())]
        d = np.maximum(2 - 2 * centers @ centers[chosen[0]], 0)
        while len(chosen) < self.k:
            p = np.cumsum(d * np.maximum(mass, 0.1))
            if p[-1] <= 0:
                break
            chosen.append(int(min(np.searchsorted(p, rng.random() * p[-1], side="right"), len(p) - 1)))
            d = np.minimum(d, np.maximum(2 - 2 * centers @ centers[chosen[-1]], 0))
        return centers[chosen]

    def _lloyd(self) -> None:
        shared, weights = self.spark.sparkContext.broadcast(self.centroids), self.weights

        def partial(batches):
            sums = np.zeros_like(shared.value)
            used = np.zeros(len(sums), bool)
            for _, x, _ in _blocks(batches, weights):
                near = (x @ shared.value.T).argmax(1)
                order = np.argsort(near, kind="stable")
                cuts = np.flatnonzero(np.r_[True, np.diff(near[order]) > 0])
                sums[near[order][cuts]] += np.add.reduceat(x[order], cuts, axis=0)
                used[near] = True
            at = np.flatnonzero(used)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array([sums[i].tobytes() for i in at], pa.binary())], ["c", "v"])

        def add(table: pa.Table) -> pa.Table:
            total = np.sum([np.frombuffer(v, np.float32) for v in table.column("v").to_pylist()], axis=0, dtype=np.float64)
            return pa.table({"c": table.column("c")[:1], "v": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

        # a centroid has at most one row from each task; k rows come back
        rows = self.classes.mapInArrow(partial, "c int, v binary").groupBy("c").applyInArrow(add, "c int, v binary").collect()
        new = self.centroids.copy()
        for c, v in rows:
            v = np.frombuffer(v, np.float32)
            new[c] = v / max(np.linalg.norm(v), 1e-12)
        self.centroids = new

    def assign(self, probes: int = PROBES) -> DataFrame:
        """class_id, hashes, cells (nearest first), closeness of the nearest."""
        shared, weights = self.spark.sparkContext.broadcast(self.centroids), self.weights
        m = min(probes, len(self.centroids))

        def run(batches):
            for ids, x, part in _blocks(batches, weights):
                s = x @ shared.value.T
                top = np.argpartition(-s, m - 1, axis=1)[:, :m]
                top = np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable"), 1)
                cells = pa.ListArray.from_arrays(pa.array(np.arange(0, top.size + 1, m, dtype=np.int32)), pa.array(top.astype(np.int32).ravel()))
                close = np.take_along_axis(s, top[:, :1], 1).ravel().astype(np.float64)
                yield pa.RecordBatch.from_arrays([part.column("class_id"), part.column("hashes"), cells, pa.array(close)], ["class_id", "hashes", "cells", "closeness"])

        return self.classes.mapInArrow(run, "class_id long, hashes array<long>, cells array<int>, closeness double")


def cell_entries(assigned: DataFrame, limit: int | None = None) -> DataFrame:
    """cell, part, class_id, hashes: a class in its cells; cells of more than ``limit`` classes are divided.

    A large cell is divided by SPLITS minhashes, so alike classes meet in a part. A part that is still
    larger is dealt to pieces by hash: the search for missing links connects what a piece border parts.
    """
    limit = limit or BLOCK
    entries = assigned.select("class_id", "hashes", F.explode("cells").alias("cell"))
    large = entries.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("cell")
    large = materialize(large)  # at most one row a centroid
    if large.isEmpty():
        return entries.select("cell", F.lit(0).cast("long").alias("part"), "class_id", "hashes")
    low = lambda r: F.array_min(F.transform("hashes", lambda h: F.xxhash64(h, F.lit(r))))
    parts = F.explode(F.when(F.col("large"), F.array(*[F.xxhash64(F.lit(r), low(r)) for r in range(SPLITS)])).otherwise(F.array(F.lit(0).cast("long"))))
    entries = entries.join(F.broadcast(large.withColumn("large", F.lit(True))), "cell", "left").select("class_id", "hashes", "cell", "large", parts.alias("part"))
    sizes = entries.where("large").groupBy("cell", "part").agg(F.count("*").alias("n")).where(F.col("n") > limit)
    sizes = materialize(sizes.select("cell", "part", F.ceil(F.col("n") / limit).alias("pieces")))
    piece = F.pmod(F.xxhash64("class_id"), F.coalesce("pieces", F.lit(1)))
    return entries.join(sizes, ["cell", "part"], "left").select("cell", F.xxhash64("part", piece).alias("part"), "class_id", "hashes")


def _min_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def spanning_links(sizes: np.ndarray, items: np.ndarray, threshold: float, start: np.ndarray | None = None) -> np.ndarray:
    """For each set the smallest set of its group; groups are connected by Jaccard >= threshold.

    ``items`` holds the sets one after another; ``start`` is a grouping known before (the smallest
    set of each set's group). Exact: two sets at the threshold share an item
    among the size - ceil(threshold * size) + 1 first of each in one common order (rarest first).
    """
    n = len(sizes)
    rec = np.repeat(np.arange(n), sizes)
    _, item, df = np.unique(items, return_inverse=True, return_counts=True)
    rank = np.empty(len(df), np.int64)
    rank[np.argsort(df, kind="stable")] = np.arange(len(df))
    r = rank[item]
    order = np.lexsort((r, rec))
    rec, r = rec[order], r[order]
    held = rec * len(df) + r  # sorted: membership by binary search
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(r)) - starts[rec]
    need = np.ceil(threshold * sizes - 1e-9).astype(np.int64)
    kept = (place < (sizes - need + 1)[rec]) & (df[np.argsort(rank)][r] > 1)
    pr, pi = rec[kept], r[kept]
    by = np.lexsort((pr, pi))
    pr, pi = pr[by], pi[by]
    label = np.arange(n) if start is None else start
    if not len(pi):
        return label
    cuts = np.flatnonzero(np.r_[True, np.diff(pi) > 0])
    lens = np.diff(np.r_[cuts, len(pi)])

    def verified(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        small = np.minimum(sizes[a], sizes[b]) >= threshold * np.maximum(sizes[a], sizes[b]) - 1e-9
        a, b = a[small], b[small]
        good = np.zeros(len(a), bool)
        step = max(1, 2_000_000 // max(int(sizes.max()), 1))
        for lo in range(0, len(a), step):
            x, y = a[lo : lo + step], b[lo : lo + step]
            m = sizes[x]
            ends = np.cumsum(m)
            at = np.arange(ends[-1]) - np.repeat(ends - m - starts[x], m)
            want = np.repeat(y, m) * len(df) + r[at]
            found = np.searchsorted(held, want)
            hit = held[np.minimum(found, len(held) - 1)] == want
            k = np.add.reduceat(hit, ends - m)
            good[lo : lo + step] = k >= threshold * (sizes[x] + sizes[y] - k) - 1e-9
        return np.stack([a[good], b[good]])

    # first every posting's first record against the others: this settles large groups in linear time
    edges = [np.zeros((2, 0), np.int64) if start is None else np.stack([np.arange(n), start])]
    first = np.repeat(pr[cuts], lens)
    apart = label[first] != label[pr]
    a, b = first[apart], pr[apart]
    edges.append(verified(*np.unique(np.stack([a, b]), axis=1)))
    label = _min_labels(n, *np.concatenate(edges, axis=1))
    # then all pairs of a posting that are not yet in one group
    width = 64
    small = (lens > 1) & (lens <= width)
    pairs = []
    if small.any():
        sel = np.repeat(small, lens)
        p, m = pr[sel], lens[small]
        ends = np.repeat(np.cumsum(m), m)
        rest = ends - np.arange(len(p)) - 1
        i = np.repeat(np.arange(len(p)), rest)
        j = np.arange(len(i)) - np.repeat(np.cumsum(rest) - rest, rest) + i + 1
        use = label[p[i]] != label[p[j]]
        if use.any():
            pairs.append(np.unique(np.stack([p[i][use], p[j][use]]), axis=1))
    if pairs:
        edges.append(verified(*pairs[0]))
        label = _min_labels(n, *np.concatenate(edges, axis=1))
    for c, m in zip(cuts[lens > width], lens[lens > width]):
        p = pr[c : c + m]
        for i in range(m - 1):
            other = p[i + 1 :][label[p[i + 1 :]] != label[p[i]]]
            if len(other):
                found = verified(np.full(len(other), p[i]), other)
                if found.shape[1]:
                    edges.append(found)
                    label = _min_labels(n, *np.concatenate(edges, axis=1))
    return label


def _cell_links(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids = table.column("class_id").to_numpy()
        hashes = table.column("hashes").chunk(0) if table.num_rows else None
        if table.num_rows < 2:
            return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
        order = np.argsort(ids, kind="stable")
        hashes = hashes.take(pa.array(order))
        ids = ids[order]
        label = spanning_links(hashes.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), hashes.flatten().to_numpy(), threshold)
        linked = label != np.arange(len(ids))
        return pa.table({"u": ids[linked], "v": ids[label[linked]]})

    return run


def _prefixes(batches: Iterator[pa.RecordBatch], weights: np.ndarray, threshold: float) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Batches with the row and the hash of each prefix item, rarest first by the buckets' weights, then by hash.

    The last array tells which items belong to the shorter prefix: with |x| <= |y|, two sets at the
    threshold t share 2t / (1 + t) |x| items, so their first shared one is among the first
    |x| - ceil(2t / (1 + t) |x|) + 1 of x and the first |y| - ceil(t |y|) + 1 of y.
    """
    for batch in batches:
        hashes = batch.column("hashes")
        sizes = hashes.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        h = hashes.flatten().to_numpy()
        rec = np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((h, -weights[(h.view(np.uint64) % np.uint64(WEIGHTS)).astype(np.int64)], rec))
        place = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        kept = place < (sizes - np.ceil(threshold * sizes - 1e-9).astype(np.int64) + 1)[rec]
        short = place < (sizes - np.ceil(2 * threshold / (1 + threshold) * sizes - 1e-9).astype(np.int64) + 1)[rec]
        yield batch, rec[kept], h[order][kept], short[kept]


def _slot(h: np.ndarray, n: int) -> np.ndarray:
    return (_mix(h.view(np.uint64), SEED) % np.uint64(n)).astype(np.int64)


def _bucket_links(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        roots = table.column("root").to_numpy()
        if table.num_rows < 2 or (roots == roots[0]).all():
            return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
        order = np.lexsort((table.column("class_id").to_numpy(), roots))
        hashes, roots = table.column("hashes").chunk(0).take(pa.array(order)), roots[order]
        known = np.searchsorted(roots, roots)
        label = spanning_links(hashes.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), hashes.flatten().to_numpy(), threshold, known)
        u, v = roots, roots[label]
        pairs = np.unique(np.stack([u[u != v], v[u != v]]), axis=1)
        return pa.table({"u": pairs[0], "v": pairs[1]})

    return run


def missing_links(classes: DataFrame, weights, threshold: float) -> DataFrame:
    """u, v: roots of (class_id, hashes, root) that a pair of classes at the threshold connects; complete.

    Prefix items whose slot holds classes of one root only, or no shorter prefix, connect nothing and are left out.
    """

    def slots(batches):
        for batch, row, h, short in _prefixes(batches, weights.value, threshold):
            root = batch.column("root").to_numpy()[row]
            slot = _slot(h, SLOTS)
            order = np.argsort(slot, kind="stable")
            cuts = np.flatnonzero(np.r_[True, np.diff(slot[order]) > 0]) if len(slot) else np.zeros(0, np.int64)
            low, high = (f.reduceat(root[order], cuts) if len(cuts) else cuts for f in (np.minimum, np.maximum))
            n = np.diff(np.r_[cuts, len(slot)])
            within = np.logical_or.reduceat(short[order], cuts) if len(cuts) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(slot[order][cuts]), pa.array(n), pa.array(low), pa.array(high), pa.array(within)], ["slot", "n", "low", "high", "short"])

    found = classes.mapInArrow(slots, "slot long, n long, low long, high long, short boolean").groupBy("slot").agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("short").alias("short")
    )
    mixed = found.where("low < high and short").select("slot", "n").collect()  # at most SLOTS rows
    if not mixed:
        return classes.sparkSession.createDataFrame([], "u long, v long")
    open_ = np.zeros(SLOTS, bool)
    open_[[r["slot"] for r in mixed]] = True
    open_ = classes.sparkSession.sparkContext.broadcast(open_)
    n_buckets = -(-sum(r["n"] for r in mixed) // BUCKET)

    def buckets(batches):
        for batch, row, h, _ in _prefixes(batches, weights.value, threshold):
            use = open_.value[_slot(h, SLOTS)]
            row, bucket = np.unique(np.stack([row[use], _slot(h[use], n_buckets)]), axis=1)
            taken = pa.array(row)
            columns = [batch.column(c).take(taken) for c in ("class_id", "hashes", "root")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(bucket)], ["class_id", "hashes", "root", "bucket"])

    entries = classes.mapInArrow(buckets, "class_id long, hashes array<long>, root long, bucket long")
    entries = blocked(entries, "bucket", "class_id", BLOCK)
    return entries.select("bucket", "pair", "class_id", "hashes", "root").groupBy("bucket", "pair").applyInArrow(_bucket_links(threshold), "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) of all nodes that have a link (u, v)."""
    edges = materialize(links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct())
    roots = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        up = both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("up"))
        up = materialize(up)
        jump = up.join(up.select(F.col("node").alias("up"), F.col("up").alias("top")), "up").select("node", F.col("top").alias("root"))
        jump = materialize(jump)
        a, b = jump.toDF("u", "ru"), jump.toDF("v", "rv")
        shrunk = edges.join(a, "u").join(b, "v").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).where("u <> v").distinct()
        if roots is None:
            grown = jump
        else:
            step = jump.select(F.col("node").alias("root"), F.col("root").alias("next"))
            grown = roots.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
        new_roots, new_edges = (grown if roots is None else materialize(grown)), materialize(shrunk)
        release(edges, up, *([jump, roots] if roots is not None else []))
        roots, edges = new_roots, new_edges
    release(edges)
    if roots is None:
        return links.sparkSession.createDataFrame([], "node long, root long")
    return roots


class Clustering:
    """members(program, class_id, cluster_id), assigned(class_id, hashes, cells, closeness), the k-means."""

    def __init__(self, records: DataFrame, threshold: float = 0.5, k: int | None = None):
        """records: (record, items), items distinct and not empty."""
        hashed = records.select("record", F.array_sort(F.transform("items", lambda x: F.xxhash64(x))).alias("hashes"))
        hashed = materialize(hashed.withColumn("key", F.unhex(F.md5(F.array_join(F.transform("hashes", lambda x: x.cast("string")), ",")))))
        numbered = dense_ids(hashed.groupBy("key").agg(F.first("hashes").alias("hashes")), "class_id")
        keyed = materialize(hashed.select("record", "key").join(numbered.select("key", "class_id"), "key").select("record", "class_id"))
        classes = materialize(numbered.select("class_id", "hashes"))
        release(hashed, numbered)
        n = classes.count()
        self.members, self.kmeans = keyed.withColumn("cluster_id", F.col("class_id")), None
        self.classes = classes
        if n == 0:
            return
        self.kmeans = KMeans(classes, n, k)
        assigned = materialize(self.kmeans.assign())
        release(classes)
        self.classes = assigned
        links = cell_entries(assigned).groupBy("cell", "part").applyInArrow(_cell_links(threshold), "u long, v long")
        near = components(links).withColumnRenamed("node", "class_id")
        rooted = materialize(assigned.select("class_id", "hashes").join(near, "class_id", "left").withColumn("root", F.coalesce("root", "class_id")))
        far = components(missing_links(rooted, self.kmeans.weights, threshold)).toDF("root", "far")
        roots = rooted.select("class_id", "root").join(far, "root", "left").select("class_id", F.coalesce("far", "root").alias("cluster_id"))
        self.members = keyed.join(roots, "class_id").select("record", "class_id", "cluster_id")


def program_sets(programs: DataFrame) -> DataFrame:
    """record (clean program), items (its distinct clean genes)."""
    df = pick(programs, ["program", "gene"]).select(clean_name("program").alias("record"), clean_gene("gene").alias("gene"))
    return df.where("record is not null and gene is not null").groupBy("record").agg(F.collect_set("gene").alias("items"))


def cluster_pairs(programs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """program_a < program_b: all pairs of programs that are in one cluster."""
    members = Clustering(program_sets(programs), threshold).members.select("cluster_id", "record")
    a, b = members.withColumnRenamed("record", "program_a"), members.withColumnRenamed("record", "program_b")
    return a.join(b, "cluster_id").where("program_a < program_b").select("program_a", "program_b")


def cluster_report(programs: DataFrame, runs: DataFrame, threshold: float = 0.5, typical: int = 3) -> DataFrame:
    """cluster_id, size, n_runs, asked_programs, typical_programs of every cluster.

    asked_programs is the mean n_programs (where above 0) of the runs whose programs are in the
    cluster. Typical are the programs nearest the centroid of their cluster, in unit vectors of the
    items weighted ln((N + 1) / n), n of the N programs holding the item; ties go to the smaller
    name. The closeness comes from sums over items, so no task ever holds a whole cluster.
    """
    done = Clustering(program_sets(programs), threshold)
    members, classes = done.members, done.classes.select("class_id", "hashes")
    sizes = members.groupBy("cluster_id").agg(F.count("*").alias("size"), F.min("record").alias("cluster"))
    copies = members.groupBy("class_id", "cluster_id").agg(F.count("*").alias("copies"))  # a class lies in one cluster
    n_records = members.agg(F.count("*").alias("records"))  # one row
    held = materialize(copies.join(classes, "class_id").select("cluster_id", "class_id", "copies", F.explode("hashes").alias("hash")))
    weights = held.groupBy("hash").agg(F.sum("copies").alias("n")).join(F.broadcast(n_records)).select("hash", F.log((F.col("records") + 1) / F.col("n")).alias("w"))
    held = held.join(weights, "hash")
    length = held.groupBy("class_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("len"))
    unit = materialize(held.join(length, "class_id").select("cluster_id", "class_id", "copies", "hash", (F.col("w") / F.col("len")).alias("u")))
    sums = unit.groupBy("cluster_id", "hash").agg(F.sum(F.col("copies") * F.col("u")).alias("s"))
    close = unit.join(sums, ["cluster_id", "hash"]).groupBy("class_id").agg(F.sum(F.col("u") * F.col("s")).alias("closeness"))
    close = members.join(close, "class_id").select("cluster_id", "record", "closeness")
    order = Window.partitionBy("cluster_id").orderBy(F.desc(F.round("closeness", 6)), "record")
    best = close.withColumn("k", F.row_number().over(order)).where(F.col("k") <= typical)
    best = best.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("k", "record"))).alias("x"))
    owner = pick(programs, ["program", "run_id"]).select(clean_name("program").alias("record"), "run_id").where("record is not null").distinct()
    asked = pick(runs, ["run_id", "n_programs"]).groupBy("run_id").agg(F.max("n_programs").alias("asked"))
    asked = members.join(owner, "record").select("cluster_id", "run_id").distinct().join(asked, "run_id", "left").groupBy("cluster_id").agg(
        F.count("*").alias("n_runs"), F.round(F.avg(F.when(F.col("asked") > 0, F.col("asked"))), 6).alias("asked_programs")
    )
    return (
        sizes.join(best, "cluster_id", "left").join(asked, "cluster_id", "left")
        .select("cluster", "size", "n_runs", "asked_programs", F.array_join(F.col("x.record"), ",").alias("typical_programs"))
    )
