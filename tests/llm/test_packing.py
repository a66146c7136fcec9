"""Packing: ids against the tokenizer itself, every piece once and gapless, few sequences, islands against each other."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import packing
from tidewell.session import materialize


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.tokenizer_path())


def packed(spark, docs, **kw):
    return packing.pack(materialize(packing.pieces(docs), "pieces"), **kw).collect()


def checked(rows, texts, tokenizer, capacity=1024):
    """Pieces are those of the texts (text by document key), and sequences have no gaps, overlaps or excess."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(texts)
    for doc, found in by_doc.items():
        ids = np.array(tokenizer.encode(texts[doc] or "", add_special_tokens=False).ids + [2], "<u4")
        found.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in found] == list(range(len(found))) and sum(r["length"] for r in found) == len(ids)
        at = 0
        for r in found:
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            assert r["length"] == capacity or r["piece"] == 0
            at += r["length"]
    for found in by_sequence.values():
        at = 0
        for r in sorted(found, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return len(by_sequence)


def test_tokens_are_the_tokenizers(tokenizer):
    encode = packing.encoder(packing.tokenizer_path())
    vocabulary = tokenizer.get_vocab()
    assert all(i == 50256 or [t.id for t in tokenizer.model.tokenize(token)] == [i] for token, i in vocabulary.items())
    odd = ["", " ", "a  b\n\n c", "it's we'll I'd", "<|endoftext|> x <|endoftext|>", "日本語 テキスト 😀 é ß", "x" * 3000, "1234567 ½ ² ٣", "​ 　 a\tb\r\n", "ﬁ ǅ ʰ \U00010400", "Áë"]
    blocks = ["".join(map(chr, range(lo, lo + 512))) for lo in [*range(0, 0xD800, 512), *range(0xE000, 0x20000, 512)]]
    for text in odd + blocks:
        assert encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_whole_tables(spark, tokenizer):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = packed(spark, docs)
    n = checked(rows, {r["doc_id"]: r["text"] for r in docs.collect()}, tokenizer)
    assert n <= -(-sum(r["length"] for r in rows) // 1024) + 1


def test_islands_join_up(spark):
    """Many small islands need about as few sequences as one, because loose sequences are packed again."""
    rng = np.random.default_rng(5)
    lengths = np.append(rng.integers(1, 1024, 3000), [1024] * 7).tolist()
    cut_up = materialize(spark.createDataFrame([(i, i, 0, 0, n, 0) for i, n in enumerate(lengths)], "row bigint, doc bigint, piece int, start bigint, length bigint, ids_crc32 bigint"), "pieces")
    small = np.sort([n for n in lengths if n < 1024])[::-1]
    plain = packing.Island(small, 1024, rng).cost(packing.Island(small, 1024, rng).fresh(0.0))[0] + 7
    for island, more in ((500, 1.015), (5000, 1.0)):
        rows = packing.pack(cut_up, island=island).collect()
        assert sorted((r["doc"], r["length"]) for r in rows) == list(enumerate(lengths))
        loads, spans = defaultdict(int), defaultdict(list)
        for r in rows:
            loads[r["sequence_id"]] += r["length"]
            spans[r["sequence_id"]].append((r["offset"], r["length"]))
        assert max(loads.values()) <= 1024 and len(loads) <= plain * more
        for s in spans.values():
            assert [o for o, _ in sorted(s)] == np.cumsum([0] + [n for _, n in sorted(s)][:-1]).tolist()


def test_unsplittable_lengths_end(spark):
    cut_up = materialize(spark.range(900).select(F.col("id").alias("row"), F.col("id").alias("doc"), F.lit(0).alias("piece"), F.lit(0).cast("bigint").alias("start"), F.lit(600).cast("bigint").alias("length"), F.lit(0).cast("bigint").alias("ids_crc32")), "pieces")
    assert packing.pack(cut_up, island=100).select("sequence_id").distinct().count() == 900


def test_genetic_steps_keep_every_piece():
    rng = np.random.default_rng(3)
    lengths = np.sort(rng.integers(1, 100, 400))[::-1]
    island = packing.Island(lengths, 100, rng)
    a, b = island.fresh(0.0), island.fresh(0.5)
    for bins in (island.crossed(a, b), island.shaken(a), island.settled(a, island.elite(b, 20))):
        loads = island.loads(bins)
        assert bins.min() == 0 and (loads > 0).all() and loads.max() <= 100 and loads.sum() == lengths.sum()
    chosen = np.where(np.isin(b, [1, 2]), b, -1)
    child = island.injected(a, chosen)
    for g in (1, 2):  # injected bins come whole
        held = np.flatnonzero(b == g)
        assert len(set(child[held])) == 1 and set(held) <= set(np.flatnonzero(child == child[held[0]]))
    population = island.epoch([], [], 6, 10)
    costs = [island.cost(p) for p in population]
    assert costs == sorted(costs) and costs[0] <= island.cost(a)
    assert island.elite(a, 3) and all(sum(p) <= 100 for p in island.elite(a, 3))


def test_odd_rows(spark, odd_docs, no_docs, tokenizer):
    keyed = odd_docs.withColumn("doc_id", F.monotonically_increasing_id())
    checked(packed(spark, keyed), {r["doc_id"]: r["text"] for r in keyed.collect()}, tokenizer)
    rows = packed(spark, odd_docs)
    assert len({(r["row"], r["piece"]) for r in rows}) == len(rows) and len({r["row"] for r in rows}) == odd_docs.count()
    assert packed(spark, no_docs) == []
    with_ids = packing.pieces(odd_docs, with_ids=True).collect()
    assert all(len(r["ids"]) == r["length"] for r in with_ids)
