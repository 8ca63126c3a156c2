import os
import random
from collections import Counter

import numpy as np
import pytest

from genoloom.llm import bpe, mix

pytestmark = pytest.mark.skipif(not os.path.exists(f"{bpe.TOKENIZERS}/{bpe.VOCABULARY}.tiktoken"), reason="no vocabulary files")

TEXTS = [
    None, "", " ", "Hello world, it's 2024!", "a\x1cb \x1d", "don't  we'll 'tis I'M", "  \n\n \t x\r\n", "<|endoftext|> hi", "𝒜𝒷 ½ ² ⅷ १२३ 漢字仮名", "x" * 30_000, "é" * 3000,
    "​\xad﻿", " a\xa0b　c", "日本語" * 5000, "🏳️‍🌈👩‍👩‍👧", "same", "same",
]


def reference():
    import tiktoken

    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(), special_tokens={})


def test_ids_equal_the_public_tokenizer_and_decode(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").selectExpr("*", "'c' as ids", "1 as part")
    got = dict(bpe.encode_documents(df).collect())
    ref, ranks = reference(), bpe.read_ranks()
    for i, text in enumerate(TEXTS):
        assert got[i] == (ref.encode_ordinary(text) if text else [])
        assert bpe.decode(got[i], ranks).decode() == (text or "")


def test_random_texts_and_a_full_memory(monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN", 50)
    e, ref, rng = bpe.Encoder(bpe.piece_model(bpe.read_ranks())), reference(), random.Random(4)
    for _ in range(20):
        texts = ["".join(rng.choice("ab'st  \n1é漢,.!Ж") for _ in range(rng.randint(0, 60))) for _ in range(20)]
        flat, n = e.encode(texts)
        assert [list(x) for x in np.split(flat, np.cumsum(n)[:-1])] == [ref.encode_ordinary(t) for t in texts]


def test_decoding_is_the_inverse(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = dict(bpe.decode_documents(bpe.encode_documents(df).selectExpr("*", "'c' as text")).collect())
    assert got == {i: t or "" for i, t in enumerate(TEXTS)}
    odd = dict(bpe.decode_documents(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")).collect())
    assert odd == {1: "", 2: ""}


def test_a_changed_vocabulary_is_another_encoder(spark, tmp_path):
    df = spark.createDataFrame([(1, "abab")], "doc_id long, text string")
    import base64

    base = [bytes([i]) for i in range(256)]
    for extra in ([b"ab"], [b"ab", b"abab"]):
        (tmp_path / "v.tiktoken").write_text("".join(f"{base64.b64encode(t).decode()} {i}\n" for i, t in enumerate(base + extra)))
        got = bpe.encode_documents(df, str(tmp_path), "v").collect()[0].ids
        assert got == ([256, 256] if len(extra) == 1 else [257])


def test_encoding_empty_table(spark):
    assert bpe.encode_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_quotas():
    assert mix.quotas([0.5, 0.5], [100, 100], 10) == [5, 5]
    assert mix.quotas([0.9, 0.1], [3, 100], 10) == [3, 7]
    assert mix.quotas([0.9, 0.1], [3, 4], 10) == [3, 4]
    assert mix.quotas([0.3, 0.7, 0.0], [0, 5, 9], 10) == [0, 5, 0]
    assert sum(mix.quotas([0.2, 0.3, 0.5], [100, 100, 100], 101)) == 101
    assert mix.quotas([], [], 5) == []


def test_permutation():
    for n in (1, 2, 3, 7, 64, 1000):
        assert sorted(mix.permuted(np.arange(n), n, 5)) == list(range(n))


def mixture(spark):
    rng = random.Random(1)
    words = ["program", "gene", "signal", "the", "of", "shared", "cluster"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = [(i, rng.choice(["Big", " big\t", "BIG"]), text(900)) for i in range(30)] + [(100 + i, "small", text(700)) for i in range(4)]
    docs += [(200, "small", None), (201, "small", ""), (202, None, text(50)), (203, "other", text(50)), (204, "one", "hi")]
    d = spark.createDataFrame(docs, "doc_id long, source string, text string").selectExpr("*", "1 as part", "2 as slot", "3 as n_tokens")
    t = spark.createDataFrame([("big", 0.5, 2), ("small", 0.4, 2), ("none", 0.05, 3), ("one", 0.05, 1), (None, 0.3, 1)], "source string, target_share double, max_repeats int")
    return d, t


def test_mix_keeps_caps_tokens_and_shares(spark):
    d, t = mixture(spark)
    rows = mix.mixed_blocks(d, t).collect()
    used = Counter((r.source, r.block_no) for r in rows)
    assert all(len(r.ids) == r.n_tokens for r in rows) and len({(r.shard, r.slot) for r in rows}) == len(rows)
    assert len({(r.source, r.block_no, r.repeat_no) for r in rows}) == len(rows)
    assert max(k for (s, _), k in used.items() if s == "small") == 2 and set(s for s, _ in used) <= {"big", "small", "one"}
    shares = {r.source: r for r in mix.mixed_shares(d, t).collect()}
    assert shares["none"].drawn_tokens == 0 and shares["small"].most_repeats <= 2 and shares["one"].most_repeats <= 1
    assert abs(sum(r.actual_share for r in shares.values()) - 1) < 1e-9
    assert {s: sum(r.n_tokens for r in rows if r.source == s) for s in ("big", "small")} == {s: shares[s].drawn_tokens for s in ("big", "small")}


def test_blocks_hold_every_token_once(spark):
    d, t = mixture(spark)
    stock, numbers = mix.token_blocks(d, mix.clean_targets(t))
    blocks = stock.join(numbers, ["source", "part", "seq"]).collect()
    ref, got = reference(), {}
    for b in blocks:
        ids = np.frombuffer(b.tokens, "<u2")
        cuts = [x["at"] for x in b.docs] + [len(ids)]
        for x, lo, hi in zip(b.docs, cuts, cuts[1:]):
            got[x["doc_id"]] = got.get(x["doc_id"], 0) + hi - lo
    want = {r.doc_id: len(ref.encode_ordinary(r.text)) for r in d.collect() if r.text and (r.source or "").strip().lower() in ("big", "small", "one")}
    assert got == want
    assert sorted({(b.source, b.block_no) for b in blocks}) == sorted((b.source, b.block_no) for b in blocks)
    assert sum(b.n_tokens < mix.BLOCK_TOKENS for b in blocks) <= 3


def test_the_mix_depends_on_neither_splits_nor_partitions(spark, monkeypatch):
    monkeypatch.setattr(mix, "SEGMENT_DOCS", 4)
    monkeypatch.setattr(mix, "FAN", 2)
    d, t = mixture(spark)
    got = []
    for splits, parts in ((1, 3), (7, 5)):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got.append({(r.shard, r.slot): (r.source, r.block_no, r.repeat_no, tuple(r.ids)) for r in mix.mixed_blocks(d.repartition(splits), t).collect()})
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert got[0] == got[1] and len(got[0]) > 20
    stock, numbers = mix.token_blocks(d, mix.clean_targets(t))
    blocks = stock.join(numbers, ["source", "part", "seq"]).collect()
    assert sum(b.n_tokens < mix.BLOCK_TOKENS for b in blocks) <= 3
    for s in ("big", "small"):
        own = sorted(b.block_no for b in blocks if b.source == s)
        assert own == list(range(len(own))) and own


def test_mix_without_stock(spark):
    d = spark.createDataFrame([], "doc_id long, source string, text string")
    t = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int")
    assert mix.mixed_blocks(d, t).count() == 0
    assert [(r.drawn_tokens, r.actual_share) for r in mix.mixed_shares(d, t).collect()] == [(0, None)]
