"""Mixing sources to target shares of tokens, with a cap on repeats.

The documents of a source are dealt to segments of about SEGMENT_DOCS by a hash of their ids; a
segment is encoded and packed into blocks of a fixed length in the order of that hash. What is left
over of the segments is packed once more, FAN segments at a time, until a source has at most one
short block. So the blocks depend on the documents alone, not on files, splits or the cluster, and
one seed gives one mix. Blocks are numbered by source from running totals over segments; the draws
are joined to these numbers first, so the tokens are moved once. The blocks wanted of each source follow from the target shares, the stock and the cap on
repeats; each output shard draws its source counts from a multinomial law conditioned on these
totals (the multivariate hypergeometric law), so caps and totals hold exactly. The j-th draw of
a source is block P_e(j mod n) with e = j div n, where P_e is a pseudorandom permutation of the
source's n block numbers, so no block is drawn more than ``max_repeats`` times. Draws and blocks
are joined by (source, block).

Totals: the mix has as many tokens as the stock of the wanted sources unless ``total_tokens`` is
given. A source whose share would need more than stock x max_repeats gives all of that, and
the others share the rest in proportion to their targets.

Defined cases: a source is compared in lower case without spaces around it; null, blank and
unlisted sources are not drawn; null and empty texts hold no tokens; a wanted source without
stock has share 0; a target of null or below 0 counts as 0, max_repeats of null as 1, below 1 as
not wanted; a source listed again counts by its largest target; with no stock at all nothing is
drawn and the shares are null; other columns are ignored. Rows of one doc_id are ordered by text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genoloom.llm import bpe
from genoloom.runtime import clean_name, materialize, pick, running_totals

BLOCK_TOKENS, SHARD_BLOCKS, SEED = 512, 256, 71
SEGMENT_DOCS, FAN = 500, 4_096
_BLOCK = "source string, part long, seq int, n_tokens int, tokens binary, docs array<struct<doc_id:long,at:int>>"
_DOC = pa.struct([("doc_id", pa.int64()), ("at", pa.int32())])


class _Packer:
    """Tokens of one part of a source, cut into blocks as they come."""

    def __init__(self, source: str, part: int):
        self.source, self.part, self.held, self.n, self.docs, self.seq = source, part, [], 0, [], 0

    def add(self, doc: int, ids: np.ndarray) -> Iterator[tuple]:
        while len(ids):
            take = ids[: BLOCK_TOKENS - self.n]
            self.docs.append({"doc_id": doc, "at": self.n})
            self.held.append(take)
            self.n += len(take)
            ids = ids[len(take) :]
            if self.n == BLOCK_TOKENS:
                yield self.flush()

    def flush(self) -> tuple:
        row = (self.source, self.part, self.seq, self.n, np.concatenate(self.held).astype("<u2").tobytes(), self.docs)
        self.held, self.n, self.docs, self.seq = [], 0, [], self.seq + 1
        return row


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    s, p, q, n, t, d = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(s, pa.string()), pa.array(p, pa.int64()), pa.array(q, pa.int32()), pa.array(n, pa.int32()), pa.array(t, pa.binary()), pa.array(d, pa.list_(_DOC))],
        ["source", "part", "seq", "n_tokens", "tokens", "docs"],
    )


def _packed(feed, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a stream in which the rows of a (source, part) stand together."""
    packer, out = None, []
    for batch in batches:
        for source, part, doc, ids in feed(batch):
            if packer is None or (packer.source, packer.part) != (source, part):
                if packer is not None and packer.n:
                    out.append(packer.flush())
                packer = _Packer(source, part)
            out.extend(packer.add(doc, ids))
            if len(out) >= 2_000:
                yield _rows(out)
                out = []
    if packer is not None and packer.n:
        out.append(packer.flush())
    if out:
        yield _rows(out)


def token_blocks(documents: DataFrame, targets: DataFrame, folder: str = bpe.TOKENIZERS, name: str = bpe.VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """The stock of the wanted sources, written: (source, part, seq, n_tokens, tokens of 16 bits, docs), and
    (source, part, seq, block_no), which numbers the blocks of a source from 0."""
    spark = documents.sparkSession
    model = bpe._Model(documents, folder, name)
    ranks = len(bpe.read_ranks(folder, name))
    if ranks > 1 << 16:
        raise ValueError(f"{name} has {ranks} ids; blocks hold 16-bit ids")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bpe.encoder(model)

        def feed(batch):
            for piece in bpe.slices(batch, "text"):
                flat, counts = own.encode(piece.column("text").to_pylist())
                ends = np.cumsum(counts)
                for source, part, doc, end, n in zip(*(piece.column(c).to_pylist() for c in ("source", "part", "doc_id")), ends, counts):
                    yield source, part, doc, flat[end - n : end]

        yield from _packed(feed, batches)

    def repack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def feed(batch):
            for source, part, data, docs in zip(*(batch.column(c).to_pylist() for c in ("source", "into", "tokens", "docs"))):
                ids = np.frombuffer(data, "<u2")
                cuts = [d["at"] for d in docs] + [len(ids)]
                for d, a, b in zip(docs, cuts, cuts[1:]):
                    yield source, part, d["doc_id"], ids[a:b]

        yield from _packed(feed, batches)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = pick(documents, ["doc_id", "source", "text"]).select("doc_id", F.lower(clean_name("source")).alias("source"), "text")
    # one row for each source of the targets
    sizes = docs.join(targets.select("source").distinct(), "source").groupBy("source").agg(F.count("*").alias("n")).collect()
    segments = [(r["source"], -(-r["n"] // SEGMENT_DOCS)) for r in sizes]
    small = F.broadcast(spark.createDataFrame(segments, "source string, n_segments long"))  # as bounded as the targets
    order = F.xxhash64("doc_id", F.lit(SEED))
    docs = docs.where("text is not null and text <> ''").join(small, "source").withColumn("_h", order)
    docs = docs.select("source", F.pmod("_h", "n_segments").alias("part"), "_h", "doc_id", "text")
    docs = docs.repartition(parts, "source", "part").sortWithinPartitions("source", "part", "_h", "doc_id", "text")
    found = materialize(docs.select("source", "part", "doc_id", "text").mapInArrow(encode, _BLOCK))
    full, level, most = [found.where(F.col("n_tokens") == BLOCK_TOKENS)], 1, max((n for _, n in segments), default=1)
    short = found.where(F.col("n_tokens") < BLOCK_TOKENS)
    while most > 1:
        # at most one short block for each part: FAN parts of a source at a time are packed by one task
        into = (F.lit(level << 48) + F.floor(F.col("part").bitwiseAND((1 << 48) - 1) / FAN)).alias("into")
        short = short.select("*", into).repartition(parts, "source", "into").sortWithinPartitions("source", "into", "part")
        found = materialize(short.select("source", "into", "tokens", "docs").mapInArrow(repack, _BLOCK))
        full.append(found.where(F.col("n_tokens") == BLOCK_TOKENS))
        short = found.where(F.col("n_tokens") < BLOCK_TOKENS)
        level, most = level + 1, -(-most // FAN)
    blocks = short
    for more in full:
        blocks = blocks.unionByName(more)
    counts = blocks.groupBy("source", "part").agg(F.count("*").alias("n"), F.min("seq").alias("low"))
    first = running_totals(counts, "source", "part", "n", "first").select("source", "part", (F.col("first") - F.col("low")).alias("first"))
    numbers = blocks.select("source", "part", "seq").join(first, ["source", "part"])
    return blocks, numbers.select("source", "part", "seq", (F.col("first") + F.col("seq")).alias("block_no"))


def clean_targets(targets: DataFrame) -> DataFrame:
    """source, target_share, max_repeats of the wanted sources, each once."""
    share = F.greatest(F.coalesce(F.nanvl("target_share", F.lit(0.0)), F.lit(0.0)), F.lit(0.0))
    df = pick(targets, ["source", "target_share", "max_repeats"]).select(
        F.lower(clean_name("source")).alias("source"), share.alias("target_share"), F.coalesce("max_repeats", F.lit(1)).alias("max_repeats")
    )
    best = F.max_by(F.struct("target_share", "max_repeats"), F.struct("target_share", "max_repeats")).alias("x")
    return df.where("source is not null and max_repeats >= 1").groupBy("source").agg(best).select("source", "x.*")


def quotas(shares: list[float], caps: list[int], total: int) -> list[int]:
    """How many blocks of each source: in proportion to the shares, none above its cap."""
    out, open_, left = [0] * len(shares), [i for i, s in enumerate(shares) if s > 0 and caps[i] > 0], min(total, sum(c for s, c in zip(shares, caps) if s > 0))
    while open_ and left > 0:
        whole = sum(shares[i] for i in open_)
        full = [i for i in open_ if shares[i] / whole * left >= caps[i]]
        if not full:
            exact = {i: shares[i] / whole * left for i in open_}
            for i in open_:
                out[i] = int(exact[i])
            for i in sorted(open_, key=lambda i: (out[i] - exact[i], i))[: left - sum(out[i] for i in open_)]:
                out[i] += 1
            return out
        for i in full:
            out[i] = caps[i]
            left -= caps[i]
        open_ = [i for i in open_ if i not in full]
    return out


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 at the given places: a Feistel network, walked until inside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)

    def walk(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for r in range(4):
            h = (right + np.uint64((key * 4 + r + 1) * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((h >> np.uint64(32)) & mask)
        return (left << np.uint64(half)) | right

    out = walk(index.astype(np.uint64))
    while (outside := out >= np.uint64(n)).any():
        out[outside] = walk(out[outside])
    return out.astype(np.int64)


GROUPS = 512


def draw_slots(spark, sources: list[str], stock: list[int], wanted: list[int], seed: int = SEED) -> DataFrame:
    """shard, slot, source, repeat_no, block_no of the whole mix.

    The driver draws the totals of at most GROUPS groups of shards; tasks draw the shards.
    """
    total = sum(wanted)
    shards = -(-total // SHARD_BLOCKS)
    groups = min(GROUPS, shards)
    rng, left, at, rows, lo = np.random.default_rng(seed), np.array(wanted, np.int64), np.zeros(len(wanted), np.int64), [], 0
    for g in range(groups):
        hi = (g + 1) * shards // groups
        size = min(total, hi * SHARD_BLOCKS) - lo * SHARD_BLOCKS
        take = rng.multivariate_hypergeometric(left, size, method="marginals") if g + 1 < groups else left.copy()
        rows.append((g, lo, hi, at.tolist(), take.tolist()))
        left, at, lo = left - take, at + take, hi

    def draw(frames):
        import pandas as pd

        for frame in frames:
            for g, lo, hi, first, take in frame.itertuples(index=False):
                own, at, left = np.random.default_rng([seed, g]), np.array(first, np.int64), np.array(take, np.int64)
                for shard in range(lo, hi):
                    size = min(SHARD_BLOCKS, int(left.sum()))
                    n = own.multivariate_hypergeometric(left, size, method="marginals") if size < left.sum() else left
                    which = np.repeat(np.arange(len(n)), n)
                    serial = np.arange(size) - np.repeat(np.cumsum(n) - n, n) + at[which]
                    block, epoch = np.empty(size, np.int64), serial // np.maximum(np.array(stock)[which], 1)
                    for k in np.unique(which):
                        for e in np.unique(epoch[which == k]):
                            sel = (which == k) & (epoch == e)
                            block[sel] = permuted(serial[sel] - e * stock[k], stock[k], int(seed * 1_000_003 + k * 4_099 + e))
                    left, at = left - n, at + n
                    yield pd.DataFrame(
                        {"shard": shard, "slot": own.permutation(size), "source": [sources[k] for k in which], "repeat_no": epoch + 1, "block_no": block}
                    )

    schema = "shard long, slot int, source string, repeat_no int, block_no long"
    frame = spark.createDataFrame(rows, "g int, lo long, hi long, first array<long>, take array<long>")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return frame.repartition(min(parts, max(groups, 1))).mapInPandas(draw, schema)


def plan_mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, **vocabulary) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(blocks, slots, plan): the stock, the draws (with part and seq of their block) and one row for each wanted source."""
    spark = documents.sparkSession
    wanted = clean_targets(targets)
    blocks, numbers = token_blocks(documents, wanted, **vocabulary)
    stock = blocks.groupBy("source").agg(F.count("*").alias("n_blocks"), F.sum("n_tokens").alias("stock_tokens"))
    # one row for each source of the targets
    rows = sorted(wanted.join(stock, "source", "left").collect(), key=lambda r: r["source"])
    n = [r["n_blocks"] or 0 for r in rows]
    tokens = total_tokens if total_tokens is not None else sum(r["stock_tokens"] or 0 for r in rows)
    take = quotas([r["target_share"] for r in rows], [r["max_repeats"] * k for r, k in zip(rows, n)], round(tokens / BLOCK_TOKENS))
    # the draws come from a small plan, so Spark takes them for small; they grow with the stock
    slots = draw_slots(spark, [r["source"] for r in rows], n, take).hint("merge").join(numbers, ["source", "block_no"])
    plan = [(r["source"], r["target_share"], r["max_repeats"], r["stock_tokens"] or 0, k, t) for r, k, t in zip(rows, n, take)]
    plan = spark.createDataFrame(plan, "source string, target_share double, max_repeats int, stock_tokens long, stock_blocks long, drawn_blocks long")
    return blocks, slots, plan


def _drawn(slots: DataFrame, blocks: DataFrame) -> DataFrame:
    return slots.hint("merge").join(blocks, ["source", "part", "seq"])


def _as_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data = batch.column("tokens")
        lens = np.diff(np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1]) // 2 if len(data) else np.zeros(0, np.int32)
        flat = np.frombuffer(b"".join(data.to_pylist()), "<u2").astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lens)].astype(np.int32)), pa.array(flat))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "tokens"), ids], [*(c for c in batch.schema.names if c != "tokens"), "ids"])


def mixed_blocks(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, **vocabulary) -> DataFrame:
    """shard, slot, source, block_no, repeat_no, n_tokens, docs, ids: the mix itself."""
    blocks, slots, _ = plan_mix(documents, targets, total_tokens, **vocabulary)
    joined = _drawn(slots, blocks).select("shard", "slot", "source", "block_no", "repeat_no", "n_tokens", "docs", "tokens")
    schema = "shard long, slot int, source string, block_no long, repeat_no int, n_tokens int, docs array<struct<doc_id:long,at:int>>, ids array<int>"
    return joined.mapInArrow(_as_ids, schema)


def mixed_shares(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, **vocabulary) -> DataFrame:
    """For each wanted source its target, stock, drawn tokens, actual share and most repeats."""
    blocks, slots, plan = plan_mix(documents, targets, total_tokens, **vocabulary)
    drawn = _drawn(slots, blocks.select("source", "part", "seq", "n_tokens"))
    drawn = drawn.groupBy("source").agg(F.sum("n_tokens").alias("drawn_tokens"), F.max("repeat_no").alias("most_repeats"))
    # one row for each source: the window over all of them is small
    out = plan.join(drawn, "source", "left").withColumn("all_tokens", F.sum("drawn_tokens").over(Window.partitionBy()))
    tokens = F.coalesce("drawn_tokens", F.lit(0))
    return out.select(
        "source", "target_share", "max_repeats", "stock_tokens", tokens.alias("drawn_tokens"),
        F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), F.try_divide(tokens, F.col("all_tokens")).alias("actual_share"),
    )
