"""Line dedup against a plain version that compares every pair of lines."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from tidewell.llm import line_dedup as L

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    a, b = (a, b) if len(a) < len(b) else (b, a)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows):
    """Places that go: an earlier line is equal, or within one word where both are long enough."""
    lines = [((k, p), tuple(WORD.findall(x.lower()))) for k, t in rows if t is not None for p, x in enumerate(t.split("\n"))]
    lines = sorted((o, w) for o, w in lines if len(w) >= L.MIN_WORDS)
    first = {}
    for o, w in lines:
        first.setdefault(w, o)
    near = {b for a, b in itertools.permutations(first, 2) if first[a] < first[b] and min(len(a), len(b)) >= L.MIN_FUZZY and within_one(a, b)}
    return {o for o, w in lines if first[w] != o or w in near}


def test_equals_the_plain_version(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    base = [[rng.choice(words) for _ in range(rng.randint(2, 24))] for _ in range(40)]
    base += [[rng.choice(words[:6]) for _ in range(n)] for n in (1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 6, 7, 8) for _ in range(3)]
    rows = []
    for k in range(60):
        made = []
        for _ in range(rng.randint(1, 6)):
            w = list(rng.choice(base))
            for _ in range(min(len(w), rng.choice((0, 0, 1, 1, 2)))):
                i = rng.randrange(len(w))
                w[i : i + 1] = rng.choice(([], [rng.choice(words)], [w[i], rng.choice(words)]))
            made.append((" " if rng.random() < 0.3 else "") + rng.choice((" ", "  ")).join(w).capitalize())
        rows.append((k, "\n".join(made)))
    want = plain(rows)
    assert want
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = {r["doc_id"]: r for r in L.dedup(df, counts="told").collect()}
    for k, t in rows:
        assert got[k]["text"] == "\n".join(x for p, x in enumerate(t.split("\n")) if (k, p) not in want)
        assert got[k]["told"]["n_dropped"] == sum(1 for o in want if o[0] == k)


def test_supplied_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in df.collect()]
    want = plain(rows)
    got = {(r["_k"], p) for r in L.drops(df).collect() for p in r["gone"]}
    assert got == want


def test_odd_rows(spark, odd_docs, no_docs):
    out = L.dedup(odd_docs, counts="told")
    assert out.columns == [*odd_docs.columns, "told"]
    rows = out.collect()
    assert len(rows) == odd_docs.count()
    assert [r["text"] for r in rows if r["doc_id"] == 1] == [None]
    # Rows equal in id and text are one occurrence: both keep it. The later copies and near copies go.
    assert [r["text"] for r in rows if r["doc_id"] == 4] == ["the quick brown fox jumps over the lazy dog near the river bank today"] * 2
    assert [r["text"] for r in rows if r["doc_id"] == 5] == [""]
    assert sorted(r["text"] for r in rows if r["doc_id"] is None) == ["", "null id text one two three four"]
    assert [r["text"] for r in rows if r["doc_id"] == 10] == ["a\n\n\nb\n"]
    assert L.dedup(no_docs).count() == 0


def test_ids_and_names_of_any_kind(spark):
    """Ids that are texts, columns with the operator's own names, short lines."""
    rows = [("b", "Share this\nx y z", "mine"), ("a", "share this\none", "mine"), (None, "one\nSHARE  this\nx q z", "mine")]
    df = spark.createDataFrame(rows, "doc_id string, text string, n_near string").withColumns({"n_lines": F.col("n_near"), "n_dropped": F.col("n_near"), "_k": F.col("n_near")})
    got = {r["doc_id"]: r for r in L.dedup(df, counts="told").collect()}
    assert {k: r["text"] for k, r in got.items()} == {"a": "share this\none", "b": "x y z", None: ""}
    assert all(r[c] == "mine" for r in got.values() for c in ("n_near", "n_lines", "n_dropped", "_k")) and got[None]["told"]["n_near"] == 1
    with pytest.raises(ValueError, match="n_near"):
        L.dedup(df, counts="n_near")
