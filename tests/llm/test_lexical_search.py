"""Lexical search against a plain version on odd tables, and the query's whole rows against SQL."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewell import compare
from tidewell.llm import lexical_search, registry
from tidewell.session import materialize

ITEMS = "item_id bigint, text string, term string, row string, w string"


def terms(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def plain(docs, items, k=20):
    counts = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    held = [c for c in counts if c[2]]
    n_docs, total = len(held), sum(c[2] for c in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for at, (doc, c, n) in enumerate(held):
            m = 75 + (25 * n * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if score > 0:
                scored.append((-score, doc is None, doc or 0, at))
        out += [(item, rank, held[at][0], -s) for rank, (s, _, _, at) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def found(docs, items, pruned=True, k=20):
    asked = materialize(lexical_search.item_terms(items), "items")
    index = materialize(lexical_search.postings(docs, terms=asked if pruned else None), "postings")
    return sorted(((r["item"], r["rank"], r["doc"], r["score"]) for r in lexical_search.search(index, asked, k=k).collect()), key=repr)


@pytest.mark.parametrize("pruned", [True, False])
def test_odd_rows(spark, odd_docs, no_docs, pruned):
    texts = [(1, "quick QUICK brown fox river"), (2, None), (3, ""), (4, "!!! --"), (5, "日本語 É é ß"), (5, "word1 word2 word1"), (None, "null text id"), (6, "nothing-known zzz"), (6, "nothing-known zzz"), (7, "same ID b a")]
    items = spark.createDataFrame([(i, t, "t", "r", "w") for i, t in texts], ITEMS)
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert found(odd_docs, items, pruned) == plain(docs, texts)
    assert found(no_docs, items, pruned) == [] and found(odd_docs, items.limit(0), pruned) == []


def test_ties_and_cut(spark):
    docs = spark.createDataFrame([(i % 30, "alpha beta " + "gamma " * (i % 3)) for i in range(90)] + [(99, "delta")], "doc_id int, text string")
    texts = [(1, "alpha gamma"), (2, "delta alpha")]
    items = spark.createDataFrame([(i, t, "", "", "") for i, t in texts], ITEMS)
    got = found(docs, items)
    assert [g[:2] + g[3:] for g in got] == [p[:2] + p[3:] for p in plain([(r[0], r[1]) for r in docs.collect()], texts)]
    assert [g[2] for g in got] == [p[2] for p in plain([(r[0], r[1]) for r in docs.collect()], texts)]


def test_both_joins_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text", *[F.lit("").alias(c) for c in ("term", "row", "w")])
    sent = found(docs, items)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert found(docs, items) == sent
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_query_and_sql(spark):
    assert compare.difference(spark, "/root/testdata/sf0.001", registry.queries()["op12_lexical_search"], registry.oracle_sql()["op12_lexical_search"]) == ""
